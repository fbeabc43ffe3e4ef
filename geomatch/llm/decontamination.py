"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Symbols are words, hashed to 64 bits from the Arrow buffer. Patterns of one length share tables:
the shift table, addressed by the hash of a block of words, says how far a search window may
jump; where it says 0, the suffix bucket lists the patterns that end in this block, and their
words are compared directly. Segments of all documents of a slice are searched in step, so that a
jump is one numpy operation over all of them.

The patterns are sent in parts of about ``PART_WORDS`` words, one after another: documents with the
hits of one part are written before the next part is built, and a document gathers the hits in its
own row, never shuffled or joined. Long items are cut into pieces that overlap by a window less
one word, which have the same windows, so that no item outgrows a part.

Defined cases: a null text or one without words has no hit; items without words match nothing; the
words that an item of null id matches are hit, but it has no id to be listed or counted by;
repeated items count once by id, repeated documents each keep a row; very long texts are searched
in segments; an empty table on either side works; other columns are ignored unless asked for, and
columns asked for that have the name of a result are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import Spans, bounded_batches, byte_table, mix, row_of, text_slices, word_spans, written

WINDOW = 10
PART_WORDS = 1_000_000
PIECE = 4096
SEGMENT = 512
WORDS = byte_table(lambda b: b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122)
_K = np.uint64(0x9FB21C651E98DF25)


class Patterns:
    """The tables of all patterns of one length, in words."""

    def __init__(self, words: list[list[bytes]], owners: list[list[int]]):
        self.words, self.owners, self.length = words, owners, len(words[0])
        flat = np.frombuffer(b"".join(w for p in words for w in p), np.uint8)
        ends = np.cumsum([len(w) for p in words for w in p])
        h = Spans(flat).hashes(np.r_[0, ends[:-1]], ends).reshape(len(words), self.length)
        self.hashes = h
        self.block = min(2, self.length)
        self.bits = int(np.clip(np.ceil(np.log2(len(words) * self.length + 1)) + 3, 12, 22))
        self.shift = np.full(1 << self.bits, self.length - self.block + 1, np.uint16)
        for j in range(self.block - 1, self.length):  # later places give smaller shifts
            at = self.slot(h[:, j - 1] if self.block == 2 else None, h[:, j])
            self.shift[at] = np.minimum(self.shift[at], self.length - 1 - j)
        last = self.slot(h[:, -2] if self.block == 2 else None, h[:, -1])
        self.order = np.argsort(last, kind="stable")
        self.begin = np.searchsorted(last[self.order], np.arange((1 << self.bits) + 1))

    def slot(self, before: np.ndarray | None, word: np.ndarray) -> np.ndarray:
        key = word if before is None else mix(before * _K + word)
        return (key >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, h: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of every occurrence; row i has the words first[i]:last[i]."""
        m = self.length
        long = last - first >= m
        first, last = first[long], last[long]
        # a segment owns the ends [from, to) of windows; windows reach back over its border
        n = -(-(last - first - m + 1) // SEGMENT)
        row = np.repeat(np.arange(len(first)), n)
        at = first[row] + m - 1 + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * SEGMENT
        to = np.minimum(at + SEGMENT, last[row])
        hits, which = [], []
        while len(at):
            slot = self.slot(h[at - 1] if self.block == 2 else None, h[at])
            jump = self.shift[slot]
            stop = np.flatnonzero(jump == 0)
            if len(stop):
                lo, size = self.begin[slot[stop]], self.begin[slot[stop] + 1] - self.begin[slot[stop]]
                where = np.repeat(at[stop] - m + 1, size)
                pattern = self.order[np.repeat(lo, size) + np.arange(len(where)) - np.repeat(np.cumsum(size) - size, size)]
                for j in range(m):
                    same = h[where + j] == self.hashes[pattern, j]
                    where, pattern = where[same], pattern[same]
                    if not len(where):
                        break
                for w, p in zip(where.tolist(), pattern.tolist(), strict=True):
                    if all(text[start[w + j] : end[w + j]].tobytes() == x for j, x in enumerate(self.words[p])):
                        hits.append(w)
                        which.append(p)
            at = at + np.maximum(jump, 1)
            on = at < to
            at, to = at[on], to[on]
        return np.array(hits, np.int64), np.array(which, np.int64)


def build(items: list[tuple[str, list[bytes]]], window: int) -> tuple[list[str], list[Patterns]]:
    """Item ids, and the tables for each pattern length; a window of several items is one pattern."""
    by_length: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
    for k, (_, words) in enumerate(items):
        m = min(window, len(words))
        for at in range(len(words) - m + 1) if m else ():
            owners = by_length.setdefault(m, {}).setdefault(tuple(words[at : at + m]), [])
            if not owners or owners[-1] != k:
                owners.append(k)
    return [i for i, _ in items], [Patterns([list(p) for p in x], list(x.values())) for _, x in sorted(by_length.items())]


def split_words(texts: list[str | None]) -> list[list[bytes]]:
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
    out: list[list[bytes]] = []
    for _, data, offsets in text_slices(batch):
        low, start, end, before = word_spans(WORDS, data, offsets)
        raw = low.tobytes()
        for lo, hi in zip(before[:-1], before[1:], strict=True):
            out.append([raw[s:e] for s, e in zip(start[lo:hi], end[lo:hi], strict=True)])
    return out


def pattern_parts(items: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items (id, words) in parts of bounded size, one at a time on the driver; each is broadcast by itself."""
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, pieces, sizes = [], [], []
            for i, words in zip(b.column("item_id").to_pylist(), split_words(b.column("text").to_pylist()), strict=True):
                for at in range(0, max(1, len(words) - window + 1), PIECE) if words else ():
                    piece = words[at : at + PIECE + window - 1]
                    ids.append(i)
                    pieces.append(b" ".join(piece))
                    sizes.append(len(piece))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(pieces, pa.binary()), pa.array(sizes, pa.int64())], ["item_id", "piece", "words"])

    cut = written(items.mapInArrow(run, "item_id string, piece binary, words long"), "patterns")
    size = cut.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    parts = int(size // part_words) + 1
    for k in range(parts):
        mine = cut if parts == 1 else cut.where(F.pmod(F.xxhash64("item_id", "piece"), F.lit(parts)) == k)
        rows = sorted(((r.item_id, bytes(r.piece)) for r in mine.collect()), key=lambda r: (r[0] is None, r[0] or "", r[1]))
        if rows:
            yield [(i, piece.split(b" ")) for i, piece in rows]


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, columns: list[str] | None = None, part_words: int = PART_WORDS) -> DataFrame:
    """``columns`` (by default doc_id, text) with n_words long, hits array<struct<start, end>> (merged
    word ranges inside occurrences, end exclusive) and items array<string> (sorted)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    columns = [c for c in columns or ["doc_id", "text"] if c.lower() not in ("n_words", "hits", "items")]
    out = docs.select(*columns).withColumns({"n_words": F.lit(0).cast("long"), "hits": F.array().cast("array<struct<start:long,end:long>>"), "items": F.array().cast("array<string>")})
    schema = out.schema
    names = [f.name for f in schema]

    def searcher(part):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, tables = part.value
            for batch in batches:
                for rows, data, offsets in text_slices(batch):
                    low, start, end, before = word_spans(WORDS, data, offsets)
                    h = Spans(low).hashes(start, end)
                    doc = row_of(before)
                    edge = np.zeros(len(start) + 1, np.int64)
                    found: dict[int, set[str]] = {}
                    for t in tables:
                        at, pattern = t.search(h, low, start, end, before[:-1], before[1:])
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + t.length, -1)
                        for r, p in zip(doc[at].tolist(), pattern.tolist(), strict=True):
                            found.setdefault(r, set()).update(ids[k] for k in t.owners[p] if ids[k] is not None)
                    inside = np.cumsum(edge[:-1]) > 0
                    hits, got = rows.column("hits").to_pylist(), rows.column("items").to_pylist()
                    for r, some in found.items():
                        lo = before[r]
                        flags = np.r_[False, inside[lo : before[r + 1]], False].astype(np.int8)
                        turn = np.flatnonzero(np.diff(flags)).reshape(-1, 2)
                        hits[r] = merged([(x["start"], x["end"]) for x in hits[r]] + [tuple(map(int, x)) for x in turn])
                        got[r] = sorted(some | set(got[r]))
                    cols = {c: rows.column(c) for c in columns}
                    cols["n_words"] = pa.array(np.diff(before), pa.int64())
                    cols["hits"] = pa.array(hits, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                    cols["items"] = pa.array(got, pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([cols[c] for c in names], names)

        return run

    before = None
    for part in pattern_parts(items, window, part_words):
        if before is not None:
            out = written(out, "searched")
            before.destroy()
        before = spark.sparkContext.broadcast(build(part, window))
        out = out.mapInArrow(searcher(before), schema)
    return out if before is not None else out.mapInArrow(searcher(spark.sparkContext.broadcast(([], []))), schema)


def merged(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [{"start": s, "end": e} for s, e in out]


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
