"""Token counts, packing, decontamination, chat and vector search against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from geomatch.llm import chat, decontamination, packing, token_counts, vector_search
from geomatch.llm import queries_text as q

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = [None, "", " ", "  a", "a  b", "a \n b", "\n a", "x　 y", "it's I'll", "aaaaaaaaaaaa" * 50, "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "naïve Ünïcode ß 漢字", "1 22 333", "\x1c a \x1f", "tab\tb ", "é" * 3000, "don't  stop"]


def docs_frame(spark, texts):
    rows = [(i, t, "clash", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, `offset` long")


def expected_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab'sT 1\n\t.é漢 　"), max_size=40))
def test_counts_equal_the_library(text):
    assert token_counts.counter(PATH)([text]) == [len(expected_ids(text))]


def test_token_counts_query(spark):
    got = token_counts.count_tokens(docs_frame(spark, ODD + ODD), PATH, 50).collect()
    assert len(got) == 2 * len(ODD)
    for r in got:
        text = ODD[r.doc_id % len(ODD)]
        assert (r.n_tokens, r.n_bytes) == (len(expected_ids(text)), len((text or "").encode()))
        assert r.over_limit == (r.n_tokens > 50)
    assert token_counts.count_tokens(docs_frame(spark, []), PATH).count() == 0


def test_packing_keeps_every_id(spark):
    texts = ODD + ["word " * 5000, "word " * 5000] + ["some text here " * k for k in range(60)]
    rows = packing.pack(docs_frame(spark, texts), PATH).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        by_doc.setdefault(r.doc_id, []).append((r.start, ids, r.doc_tokens))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in enumerate(texts):
        parts = sorted(by_doc[i], key=lambda p: p[0])
        joined = [int(x) for _, ids, _ in parts for x in ids]
        assert joined == expected_ids(t) + [1] and parts[0][2] == len(joined)
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert packing.pack(docs_frame(spark, []), PATH).count() == 0


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(3)
    lengths = [rng.randint(1, 100) for _ in range(400)]
    packer = packing.Packer(100)
    places = packer.place(lengths)
    left: list[int] = []
    for k in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [c for c in left if c >= lengths[k]]
        c = min(fits) if fits else 100
        if fits:
            left.remove(c)
        left.append(c - lengths[k])
        assert places[k][1] == 100 - c
    assert packer.windows == len(left)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(texts, items, window=10):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    split = lambda t: WORD.findall((t or "").translate(lower))
    wins = {}
    for i, t in items:
        ws = split(t)
        m = min(window, len(ws))
        for k in range(len(ws) - m + 1) if m else ():
            wins.setdefault(tuple(ws[k : k + m]), set()).update([str(i)] if i is not None else [])
    out = []
    for t in texts:
        ws = split(t)
        hit, got = set(), set()
        for m in {len(w) for w in wins}:
            for k in range(len(ws) - m + 1):
                if (own := wins.get(tuple(ws[k : k + m]))) is not None:
                    got |= own
                    hit |= set(range(k, k + m))
        out.append((len(ws), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("part_words", [decontamination.PART_WORDS, 5])
def test_decontamination_equals_brute_force(spark, monkeypatch, part_words):
    if part_words == 5:
        monkeypatch.setattr(decontamination, "PIECE", 3)
    rng = random.Random(1)
    words = ["Aa", "b", "ç1", "dd", "e5"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.choice([1, 4, 6, 9, 10, 11, 30]) + (3 if i else 0))) for i in range(12)] + [(20, None), (21, " .. "), (None, "aa b e5 e5 b b b b"), (3, say(14))]
    texts = [None, "", "...", say(3), "\x00aa\x00b"] + [say(rng.randint(1, 700)) for _ in range(30)] + [items[7][1] * 2, "x" + items[8][1].upper() + "-y"]
    texts += texts[5:8]
    texts += [say(30_000), "b " + items[-2][1]]
    got = q.decontamination_digest(decontamination.find(docs_frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"), part_words=part_words)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_hits(texts, items)
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in q.decontamination_digest(decontamination.find(docs_frame(spark, texts), none)).collect())


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("<|\\im_end>a\n"), max_size=30), st.text(st.sampled_from("ab\\n\n<|>"), max_size=12))
def test_chat_escapes_are_reversible(text, role):
    t = chat.Template()
    (head, _), (body, _), (tail, _) = t.segments(role, text)
    assert chat.unescape(body) == text and "<|" not in body and t.role(head) == role and tail == t.tail


def test_chat_machine_and_digest(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", q.PROBE), (1, 2, "assistant", None), (1, 3, "assistant", "again"), (None, 0, None, "x"), (2, None, "user", "u"), (2, None, "user", "u"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes")]
    c = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, loss int")
    seg = chat.format_chat(c)
    bad = {r.conv_id for r in seg.where("not valid").select("conv_id").distinct().collect()}
    assert bad == {1, None, 2}
    for r in q.chat_digest(seg).collect():
        own = [(x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id]
        loss = "".join(t for role, t in own if role == "assistant")
        assert r.n_turns == len(own) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert q.chat_digest(chat.format_chat(c.limit(0))).count() == 0


@pytest.mark.parametrize("per_block", [8192, 7])
def test_vector_search_equals_brute_force(spark, monkeypatch, per_block):
    monkeypatch.setattr(vector_search, "ROWS_PER_BLOCK", per_block)
    monkeypatch.setattr(vector_search, "QUERIES_PER_BLOCK", 3)
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(120)]
    rows += [(300 + i, [1e300, -3e18, 2.5, 0.0, 1.0, 7e4][i:] + [1.0] * i) for i in range(6)]
    rows += [(0, rows[3][1]), (7, rows[7][1]), (200, None), (201, []), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (203, [float("nan")] * 6), (204, [float("inf")] * 6), (250, [1.0, 2.0]), (251, [0.5, 0.5]), (2**62 + 1, rows[5][1])]
    # a null id is a candidate of every query, and the last of its score
    rows += [(None, rows[5][1]), (None, [9.0] * 6), (None, [-9.0] * 6)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = sorted(map(str, map(tuple, vector_search.search(df, df.where("vec_id % 50 = 0"), 5).collect())))
    use = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for i, v in use:
        if i is not None and i % 50 == 0:
            fit = lambda x: min(max(x, -(2**63)), 2**63 - 1)
            s = sorted((-fit(sum(a * b for a, b in zip(v, w, strict=True))), j is None, j or 0, j) for j, w in use if j != i and len(w) == len(v))[:5]
            want += [(i, r + 1, j, -x) for r, (x, _, _, j) in enumerate(s)]
    assert got == sorted(map(str, want))
    assert vector_search.search(df.limit(0), df.limit(0)).count() == 0


def test_cells_bound_every_score():
    rng = np.random.default_rng(1)
    v, w = np.floor(rng.normal(0, 60, (500, 64))), np.floor(rng.normal(0, 60, (20, 64)))
    for bits in (2, 6, 8):
        score, off = vector_search.CellFile(v, bits).scan(w)
        assert (np.abs(score - w @ v.T) <= off[:, None]).all() and off.max() < 64 * 60 * 300 / (1 << bits) + 500


def test_very_long_conversation(spark):
    text = "long <|im_end|> words " * 200_000
    c = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    (r,) = q.chat_digest(chat.format_chat(c)).collect()
    assert r.loss_chars == len(text) and r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
