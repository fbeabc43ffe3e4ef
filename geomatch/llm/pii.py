"""Personal data by fixed patterns and a linear-chain conditional random field.

The base patterns find what is written out; the field finds further forms, such as a phone number
without its country code or an address with "at" and "dot". Its features are word shapes of a
token and its neighbours. It is trained in numpy from the small labelled table below, once, and
its weights go to the tasks. Tasks decode the lines of all texts by Viterbi, many lines in step.
A span must hold a digit, an at sign or the word "dot": lines without any are not decoded, as
nothing in them can be a span. A span of the field counts if it passes its kind's check and
overlaps no base span.

Defined cases: a null or empty text has no span; a text may be one line of any length; ids may
be null or repeat; other columns are ignored; an empty table gives an empty result. Places are
code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import bounded_batches

KINDS = ("email", "ip", "card", "phone")

# ---- base patterns -----------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# from inside a run of digits the rest would fail as from its beginning, so a match begins there
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def is_card(text: str) -> bool:
    d = digits(text)
    return 12 <= len(d) <= 19 and luhn(d)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part is the run before the at sign; looking from there keeps long runs linear."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), sorted."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if is_card(m[0])]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


# ---- the field ---------------------------------------------------------------------------------

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: The labelled table: [kind:text] marks a span; 9 stands for any digit, A for any capital letter.
LABELLED = """
call [phone:(999) 999-9999] today
my number is [phone:999-999-9999].
phone: [phone:999.999.9999], ask for her
tel [phone:(999)999-9999]
you can reach me on [phone:0999 999999] after six
mobile [phone:0999 9999999]
Telefon [phone:099/9999999] oder
fax [phone:999 999 9999] or write
phone [phone:+99 (999) 999-9999] now
text [phone:999-9999] or call [phone:(999) 999-9999]
mail [email:jane at mail dot com] please
write to [email:bob (at) site (dot) org].
contact [email:name [at] host [dot] net] for more
or [email:some.one at example dot com] and wait
[email:name at host dot org]
reach [email:first.last at mail dot net]
mail [email:jane.doe@mail.com] please
[email:a.b@host] is my address
send it to [email:info@localhost] soon
server [ip:99.99.99.9] is down
host [ip:999.999.9.99]:9999 answers
from [ip:9.9.9.9] to [ip:99.9.9.99]
address [ip:999-999-99-9] was logged
card [card:9999 9999 9999 9999] expires
card number [card:9999.9999.9999.9999] and code
pay with [card:9999999999999999] now
visa [card:9999/9999/9999/9999] ok
it was 99 years in 9999 and 99.9 percent
on 99.99.9999 or 99/99/9999 or 9999-99-99
at 99:99 we left, at 9 or so
version 9.9.9 of the tool, v9.99
there are 9999 people at home
look at that, dot by dot, at the end
order 9999999 of 999 items at 99.99
room 999, page 99, line 9999999999
key "a9a99a9aa99a9a9a9aaa9a9a" is secret
AAAA9AAA99AAA9AAA9AA is a key
section 9.9.9.9.9 and figure 9-9
the score was 9-9 and then 99-99
in 9999-9999 the rate of 9.9% fell
see http://www.site.com/9999/99 at once
#9999 costs $99.99 or 99,999 in all
nobody at all came in at first
a 9999 b 99 c 9 d
99 99 99 99 99
id 99999999 and 9999999999999 here
"""
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.S)
_LINES = re.compile(r"[^\n]+")
_TRIGGER = re.compile(r"[0-9@]|\b[dD][oO][tT]\b")
#: The words whose own form is a feature; all others show their shape only.
WORDS = ("at", "dot", "com", "org", "net", "phone", "call", "tel", "telefon", "fax", "mobile", "text", "number", "card", "visa", "host", "server", "ip", "mail", "email", "address", "contact")


def shape(token: str) -> str:
    c = token[0]
    if "0" <= c <= "9":
        return f"d{min(len(token), 12)}"
    if c.isalpha():
        low = token.lower()
        return "w:" + low if low in WORDS else ("Aa" if c.isupper() and not token.isupper() else "A" if token.isupper() else "a")
    return "_" if c.isspace() else "s:" + c if ord(c) < 128 else "s"


def windows(shapes: list[str]) -> list[list[str]]:
    """The features of each token: shapes at -3..3, alone and in runs that touch the token."""
    pad = ["<"] * 3 + shapes + [">"] * 3
    out = []
    for i in range(3, len(pad) - 3):
        own = [f"{k - i}={pad[k]}" for k in range(i - 3, i + 4)]
        out.append([*own, "r2=" + "|".join(pad[i : i + 3]), "l2=" + "|".join(pad[i - 2 : i + 1]), "m=" + "|".join(pad[i - 1 : i + 2]), "r3=" + "|".join(pad[i : i + 4]), "l3=" + "|".join(pad[i - 3 : i + 1])])
    return out


def labelled(repeats: int = 4, seed: int = 7) -> list[tuple[list[str], list[int]]]:
    """(shapes, labels) of the table's lines, with digits filled in at random."""
    rng = np.random.default_rng(seed)
    out = []
    for line in LABELLED.strip().split("\n") * repeats:
        line = "".join(str(rng.integers(0, 10)) if c == "9" else chr(65 + int(rng.integers(0, 26))) if c == "A" else c for c in line)
        text, spans, at = "", [], 0
        for m in re.finditer(r"\[(email|ip|card|phone):((?:[^\[\]]|\[\w+\])+)\]", line):
            text += line[at : m.start()]
            spans.append((len(text), len(text) + len(m[2]), KINDS.index(m[1])))
            text += m[2]
            at = m.end()
        text += line[at:]
        tokens = list(_TOKEN.finditer(text))
        labels = [0] * len(tokens)
        for s, e, k in spans:
            for i, t in enumerate(tokens):
                if s <= t.start() < e:
                    labels[i] = 1 + 2 * k + (t.start() > s)
        out.append(([shape(t[0]) for t in tokens], labels))
    return out


def allowed() -> np.ndarray:
    """0 where a label may follow another, else a large penalty: I-k follows B-k or I-k only."""
    n = len(LABELS)
    out = np.zeros((n + 1, n))  # the last row: before the first token
    for b in range(2, n, 2):
        out[:, b] = -1e4
        out[b - 1, b] = out[b, b] = 0
    return out


@dataclass
class Field:
    """Feature places, emission weights and transition weights."""

    places: dict[str, int]
    emit: np.ndarray
    move: np.ndarray

    def __post_init__(self):
        self.known: dict[tuple[str, ...], np.ndarray] = {}

    def scores(self, shapes: list[str]) -> np.ndarray:
        pad = ("<",) * 3 + tuple(shapes) + (">",) * 3
        rows = []
        for i in range(len(shapes)):
            key = pad[i : i + 7]
            row = self.known.get(key)
            if row is None:
                if len(self.known) > 100_000:
                    self.known.clear()
                row = self.emit[[self.places[f] for f in windows(list(pad[i : i + 7]))[3] if f in self.places]].sum(0)
                self.known[key] = row
            rows.append(row)
        return np.array(rows)

    def decode(self, lines: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of each line; lines of similar length advance in step."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(lines)
        order = sorted(range(len(lines)), key=lambda i: len(lines[i]))
        at = 0
        while at < len(order):
            end, cells = at, 0
            while end < len(order) and (end == at or (end + 1 - at) * len(lines[order[end]]) <= 200_000):
                end += 1
            group = order[at:end]
            lengths = np.array([len(lines[i]) for i in group])
            top = int(lengths.max(initial=0))
            emit = np.zeros((len(group), top, len(LABELS)), np.float32)
            for r, i in enumerate(group):
                emit[r, : len(lines[i])] = lines[i]
            back = np.zeros((len(group), top, len(LABELS)), np.int8)
            best = emit[:, 0] + self.move[-1] if top else None
            for t in range(1, top):
                paths = best[:, :, None] + self.move[None, :-1]
                back[:, t] = paths.argmax(1)
                on = (t < lengths)[:, None]
                best = np.where(on, paths.max(1) + emit[:, t], best)
            labels = np.zeros((len(group), top), int)
            last = best.argmax(1) if top else None
            for t in range(top - 1, -1, -1):
                on = t < lengths
                inside = t + 1 < lengths
                if t + 1 < top:
                    last = np.where(inside, back[np.arange(len(group)), t + 1, last], last)
                labels[:, t] = np.where(on, last, 0)
            for r, i in enumerate(group):
                out[i] = labels[r, : lengths[r]]
            at = end
        return out


def fit(table: list[tuple[list[str], list[int]]] | None = None, steps: int = 120, rate: float = 0.15, decay: float = 0.02) -> Field:
    """Maximum likelihood by forward and backward sums, all lines in step, with Adam."""
    table = table or labelled()
    places: dict[str, int] = {}
    rows = [[[places.setdefault(f, len(places)) for f in w] for w in windows(s)] for s, _ in table]
    n, k, top = len(table), len(LABELS), max(len(s) for s, _ in table)
    per = len(rows[0][0])
    idx = np.zeros((n, top, per), int)
    gold = np.zeros((n, top), int)
    live = np.zeros((n, top), bool)
    for r, (own, (_, labels)) in enumerate(zip(rows, table, strict=True)):
        idx[r, : len(own)], gold[r, : len(own)], live[r, : len(own)] = own, labels, True
    ban = allowed()
    emit, move = np.zeros((len(places), k)), np.zeros((k + 1, k))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (emit, move)]
    hot = np.eye(k)[gold] * live[..., None]
    want = np.zeros((k + 1, k))
    np.add.at(want, (k, gold[:, 0]), 1)
    for t in range(1, top):
        np.add.at(want, (gold[live[:, t], t - 1], gold[live[:, t], t]), 1)

    def logsum(x: np.ndarray, axis: int) -> np.ndarray:
        m = x.max(axis, keepdims=True)
        return np.log(np.exp(x - m).sum(axis)) + m.squeeze(axis)

    for step in range(1, steps + 1):
        e, mv = emit[idx].sum(2), move + ban
        a = np.zeros((n, top, k))
        a[:, 0] = e[:, 0] + mv[-1]
        for t in range(1, top):
            a[:, t] = np.where(live[:, t, None], logsum(a[:, t - 1, :, None] + mv[None, :-1], 1) + e[:, t], a[:, t - 1])
        b = np.zeros((n, top, k))
        for t in range(top - 2, -1, -1):
            b[:, t] = np.where(live[:, t + 1, None], logsum(mv[None, :-1] + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2), 0)
        z = logsum(a[:, -1], 1)
        share = np.exp(np.minimum(a + b - z[:, None, None], 0)) * live[..., None]
        diff = share - hot
        g_emit = decay * emit
        for p in range(per):
            np.add.at(g_emit, idx[..., p][live], diff[live])
        got = np.zeros((k + 1, k))
        got[k] = share[:, 0].sum(0)
        for t in range(1, top):
            joint = a[:, t - 1, :, None] + mv[None, :-1] + (e[:, t] + b[:, t])[:, None, :] - z[:, None, None]
            got[:k] += (np.exp(np.minimum(joint, 0)) * live[:, t, None, None]).sum(0)
        for p, g, (m1, m2) in zip((emit, move), (g_emit, got - want + decay * move), moments, strict=True):
            m1 += 0.1 * (g - m1)
            m2 += 0.001 * (g * g - m2)
            p -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return Field(places, emit, move + ban)


def sound(kind: int, text: str) -> bool:
    """The exact check of a span that the field found."""
    d = digits(text)
    if kind == 0:
        return "@" in text or bool(re.search(r"\bat\b.*\bdot\b", text, re.I | re.S))
    if kind == 1:
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return is_card(text) if kind == 2 else 7 <= len(d) <= 15


def field_spans(texts: list[str], field: Field) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) that the field adds to each text, before the base spans are looked at."""
    owner, tokens, scores = [], [], []
    for i, text in enumerate(texts):
        if not _TRIGGER.search(text):
            continue
        for line in _LINES.finditer(text):
            if not _TRIGGER.search(line[0]):
                continue
            own = [(m.start() + line.start(), m.end() + line.start()) for m in _TOKEN.finditer(line[0])]
            owner.append(i)
            tokens.append(own)
            scores.append(field.scores([shape(text[s:e]) for s, e in own]))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for i, own, labels in zip(owner, tokens, field.decode(scores), strict=True):
        begins = np.flatnonzero(labels % 2 == 1)
        for b in begins.tolist():
            kind, e = (int(labels[b]) - 1) // 2, b + 1
            while e < len(labels) and labels[e] == labels[b] + 1:
                e += 1
            s, t = own[b][0], own[e - 1][1]
            t -= len(texts[i][s:t]) - len(texts[i][s:t].rstrip())
            if sound(kind, texts[i][s:t]):
                out[i].append((s, kind, t))
    return out


def all_spans(texts: list[str | None], field: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, all spans) of each text, sorted by start and kind."""
    texts = [t or "" for t in texts]
    out = []
    for base, more in zip(map(base_spans, texts), field_spans(texts, field), strict=True):
        free = [x for x in more if all(x[2] <= s or e <= x[0] for s, _, e in base)]
        out.append((base, sorted(base + free)))
    return out


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SPANS = "array<struct<kind:string,start:long,end:long>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (by default doc_id, text) with base and spans, and masked: the text with each
    span's place taken by its kind in angle brackets. Columns of these names are left out."""
    spark = docs.sparkSession
    bounded_batches(spark)
    columns = [c for c in columns or ["doc_id", "text"] if c.lower() not in ("base", "spans", "masked")]
    docs = docs.select(*columns)
    sent = spark.sparkContext.broadcast(fit())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            base, spans, masked = [], [], []
            for t, (own, every) in zip(texts, all_spans(texts, sent.value), strict=True):
                base.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in own])
                spans.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in every])
                masked.append(mask(t, every))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(base, _ARROW), pa.array(spans, _ARROW), pa.array(masked, pa.string())], [*columns, "base", "spans", "masked"])

    schema = docs.withColumns({"base": F.array().cast(SPANS), "spans": F.array().cast(SPANS), "masked": F.lit("")}).schema
    for f in schema:
        f.nullable = True
    return docs.mapInArrow(run, schema)


def mask(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """Overlapping spans (of different kinds) leave one mark, that of the first."""
    if not spans:
        return text
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"<{KINDS[k]}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
