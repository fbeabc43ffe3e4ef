"""Packing token sequences by best-fit decreasing.

Every task tokenises its rows, cuts overlong documents into full windows, and holds the rest
pieces until ``BUFFER_TOKENS`` are waiting. Those are placed longest first, each into the
tightest window that is still open, which a segment tree over remaining capacities finds. Windows
that stay open take part in the next round of the task. Nothing is shuffled, a task that runs
again gives the same rows, and the padding of a task is a few open windows at its end.

Defined cases: a null or empty text is one end token; equal rows are packed as often as they
occur; other columns are ignored; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .textbytes import bounded_batches
from .token_counts import CACHE_ENTRIES, pieces

#: Fixed value: the splitting pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

BUFFER_TOKENS = 4_000_000
WINDOW = 2048


class Tokenizer:
    """ids of a text as little-endian unsigned 32-bit bytes.

    Texts fall into pieces at safe boundaries; each piece is encoded once and joined from a
    bounded cache. New pieces go through the rank file of the same vocabulary, which gives the
    same ids several times faster than the library that reads the .json file; tests compare the
    two. Texts with a special string go to the latter whole.
    """

    def __init__(self, path: str):
        import base64
        import os

        import tiktoken

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        ranks = path.removesuffix(".json") + ".tiktoken"
        self.fast = None
        if os.path.exists(ranks):
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
            self.opens = np.zeros(len(table), bool)
            self.opens[[n for token, n in table.items() if token.startswith(b" ")]] = True
        self.cache: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, new: list[str]) -> None:
        """Encodes all pieces without inner spaces in one call; the tokens that open with a space part them again."""
        plain = [p for p in new if p and " " not in p] if self.fast else []
        if plain:
            ids = self.fast.encode_to_numpy(" " + " ".join(plain)).astype("<u4")
            cuts = np.flatnonzero(self.opens[ids])
            if len(cuts) == len(plain):
                raw = ids.tobytes()
                for p, lo, hi in zip(plain, (4 * cuts).tolist(), [*(4 * cuts[1:]).tolist(), len(raw)], strict=True):
                    self.cache[p] = raw[lo:hi]
        for p in new:
            if p not in self.cache:
                self.cache[p] = self.encode(" " + p)

    def __call__(self, text: str | None) -> bytes:
        text = text or ""
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = pieces(text)
        try:
            return self.encode(first) + b"".join(map(self.cache.__getitem__, rest))
        except KeyError:
            new = {p for p in rest if p not in self.cache}
            if len(self.cache) + len(new) > CACHE_ENTRIES:
                self.cache.clear()
                new = set(rest)
            self.learn(list(new))
            return self.encode(first) + b"".join([self.cache[p] for p in rest])


class CapacityTree:
    """How many open windows there are of each remaining capacity; finds the least one that fits."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.sums = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = {}

    def add(self, capacity: int, window: int) -> None:
        self.open.setdefault(capacity, []).append(window)
        k = capacity + self.leaves
        while k:
            self.sums[k] += 1
            k >>= 1

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Takes out (capacity, window) with the least capacity >= length."""
        k, sums = length + self.leaves, self.sums
        if not sums[k]:
            while k > 1 and (k & 1 or not sums[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if sums[2 * k] else 2 * k + 1
        capacity = k - self.leaves
        window = self.open[capacity].pop()
        while k:
            sums[k] -= 1
            k >>= 1
        return capacity, window


class Packer:
    """Places pieces; ``place`` returns (window, offset) for each, in the order given."""

    def __init__(self, size: int):
        self.size, self.tree, self.windows = size, CapacityTree(size), 0

    def fresh(self) -> int:
        self.windows += 1
        return self.windows - 1

    def place(self, lengths: list[int]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
        for k in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            n = lengths[k]
            capacity, window = self.tree.tightest(n) or (self.size, self.fresh())
            out[k] = (window, self.size - capacity)
            if capacity > n:
                self.tree.add(capacity - n, window)
        return out


_tokenizers: dict[str, Tokenizer] = {}
SCHEMA = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """A row for each piece: its ids (unsigned 32-bit, little-endian) and its place.

    ``sequence_id`` holds the task in its high bits and the window of that task in the low 33;
    ``offset`` is the place in the window. ``with_ids=False`` leaves ``ids`` null.
    """
    bounded_batches(docs.sparkSession)
    wide = window * 4
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _tokenizers:
            _tokenizers[tokenizer] = Tokenizer(tokenizer)
        encode = _tokenizers[tokenizer]
        base = TaskContext.get().partitionId() << 33
        packer = Packer(window)
        full: list[tuple] = []
        rest: list[tuple] = []
        waiting = 0

        def emit(rows: list[tuple], places: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(rows), 2000):
                some, at = rows[lo : lo + 2000], places[lo : lo + 2000]
                doc, start, length, ids, crc, total = zip(*some, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), pa.array([base + w for w, _ in at], pa.int64()), pa.array([o for _, o in at], pa.int64())],
                    ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = encode(text) + end
                total = len(ids) // 4
                for at in range(0, len(ids), wide):
                    part = ids[at : at + wide]
                    row = (doc, at // 4, len(part) // 4, part if with_ids else None, zlib.crc32(part), total)
                    (full if len(part) == wide else rest).append(row)
                    waiting += len(part) // 4
                if waiting >= BUFFER_TOKENS:
                    yield from emit(full, [(packer.fresh(), 0) for _ in full])
                    yield from emit(rest, packer.place([r[2] for r in rest]))
                    full, rest, waiting = [], [], 0
        if full:
            yield from emit(full, [(packer.fresh(), 0) for _ in full])
        if rest:
            yield from emit(rest, packer.place([r[2] for r in rest]))

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)
