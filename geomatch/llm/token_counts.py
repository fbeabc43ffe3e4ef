"""Token counts by rank-synchronous array merging.

Texts fall into pieces at spaces that any byte-level split keeps as boundaries; a piece met
before is answered from a bounded cache. New pieces are pre-tokenised, laid out as one ragged
numpy array of byte symbols, and merged in rounds: in every round each sequence applies its own
lowest-rank pair at all its places. What survives is counted. No count leaves the task before
it is whole, and nothing is shuffled.

Defined cases: a null or empty text has 0 bytes and 0 tokens; ids may be null or repeat; other
columns are ignored; an empty table gives an empty result. The special string of the
vocabulary counts as one token wherever it stands, as the library does by default.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .textbytes import bounded_batches

#: Fixed value: the pre-tokenising pattern of the byte-level vocabulary, white space spelled out.
SPLIT = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
_RARE_SPACE = re.compile("[\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_PIECES = re.compile(r" (?=\S)")
CACHE_ENTRIES = 600_000
NEVER = np.int64(1 << 40)


def pieces(text: str) -> list[str]:
    """Cuts before each space that a non-space follows; no token of a byte-level split crosses those.

    A piece but the first has lost the space before it.
    """
    if "  " in text or " \n" in text or " \t" in text or text.endswith(" ") or _RARE_SPACE.search(text):
        return _PIECES.split(text)
    return text.split(" ")


class Vocabulary:
    """Merge ranks of a byte-level BPE file, as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.of_byte = np.array([vocab[letter[b]] for b in range(256)], np.int64)
        self.size = max(vocab.values()) + 1
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NEVER), self.made[at]

    def count(self, sequences: list[bytes]) -> np.ndarray:
        """Symbols left of each byte sequence after all merges."""
        lengths = np.array([len(s) for s in sequences], np.int64)
        out = lengths.copy()
        symbols = self.of_byte[np.frombuffer(b"".join(sequences), np.uint8)]
        owner = np.repeat(np.arange(len(sequences)), lengths)
        rank, made = self.ranked(symbols, owner, np.arange(len(symbols)))
        while len(symbols) > 1:
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(symbols)]))
            # in a run of equal pairs (a a a) every other place merges, from the left
            at = np.flatnonzero((rank == lowest) & (rank < NEVER))
            if not len(at):
                break
            run = np.r_[True, np.diff(at) > 1]
            at = at[(np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0]
            symbols[at] = made[at]
            np.subtract.at(out, owner[at], 1)
            keep = lowest < NEVER  # sequences without a pair are done
            keep[at + 1] = False
            moved = np.cumsum(keep)[at] - 1
            symbols, owner, rank, made = symbols[keep], owner[keep], rank[keep], made[keep]
            changed = np.unique(np.r_[moved, np.maximum(moved - 1, 0)])
            rank[changed], made[changed] = self.ranked(symbols, owner, changed)
        return out

    def ranked(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of the pairs that begin at the places given."""
        after = np.minimum(at + 1, max(0, len(symbols) - 1))
        rank, made = self.pairs(symbols[at], symbols[after])
        return np.where((after > at) & (owner[at] == owner[after]), rank, NEVER), made


class Counter:
    def __init__(self, path: str):
        self.vocab = Vocabulary(path)
        self.cache: dict[str, int] = {}
        self.cut = re.compile("|".join(map(re.escape, self.vocab.special))) if self.vocab.special else None

    def learn(self, new: list[str]) -> None:
        split = [SPLIT.findall(p) for p in new]
        distinct = list({w for words in split for w in words})
        counts = dict(zip(distinct, self.vocab.count([w.encode("utf-8") for w in distinct]).tolist(), strict=True))
        for p, words in zip(new, split, strict=True):
            self.cache[p] = sum(map(counts.__getitem__, words))

    def __call__(self, texts: list[str | None]) -> list[int]:
        firsts: list[str] = []  # texts' own beginnings, which no space precedes
        of: list[int] = []
        rests: list[list[str]] = []
        extra = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            parts = self.cut.split(t) if t and self.cut and self.cut.search(t) else [t or ""]
            extra[i] = len(parts) - 1
            for x in parts:
                own = pieces(x)
                firsts.append(own[0])
                of.append(i)
                rests.append(own[1:])
        seen = self.cache
        new = {p for ps in rests for p in ps if p not in seen}
        if len(seen) + len(new) > CACHE_ENTRIES:
            seen.clear()
            new = {p for ps in rests for p in ps}
        if new:
            # the cache answers for a piece with its space
            before, self.cache = self.cache, {}
            self.learn([" " + p for p in new])
            before.update((p[1:], n) for p, n in self.cache.items())
            self.cache = before
        split = [SPLIT.findall(p) for p in firsts]
        starts = dict.fromkeys(w for words in split for w in words)
        starts = dict(zip(starts, self.vocab.count([w.encode("utf-8") for w in starts]).tolist(), strict=True))
        for i, words, ps in zip(of, split, rests, strict=True):
            extra[i] += sum(map(starts.__getitem__, words)) + sum(map(self.cache.__getitem__, ps))
        return extra.tolist()


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), a row for each row of ``docs``.

    ``vocabulary``: path of a byte-level BPE file, readable by every executor.
    """
    import pyarrow.compute as pc

    bounded_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for b in batches:
            text = b.column("text")
            n_bytes = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            n = np.array(count(text.to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), n_bytes, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
