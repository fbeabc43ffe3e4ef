"""Vectorised helpers over the UTF-8 buffers of Arrow string columns.

Everything here works on slices of about ``SLICE_BYTES`` so that the memory of a task does
not depend on how many rows an Arrow batch holds.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomatch.sources import files

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_tables: dict[str, np.ndarray] = {}
_made: list[str] = []


def bounded_batches(spark: SparkSession, rows: int = 512) -> None:
    """Keep Arrow batches small: texts may be long, and a batch is held in memory whole."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        # one machine: what the driver writes all tasks see
        root = "file://" + os.path.join(tempfile.gettempdir(), "geomatch-checkpoints")
    if not root:
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    _made.append(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def mark() -> int:
    """How many tables this driver has written so far, for ``clear``."""
    return len(_made)


def last() -> tuple[str, ...]:
    """The path of the last table written."""
    return tuple(_made[-1:])


def clear(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Deletes the tables written since a mark, but for some; for when nothing reads results made from them any more."""
    for path in [p for p in _made[since:] if p not in keep]:
        files.delete(spark, path)
        _made.remove(path)


def written(df: DataFrame, name: str, compact: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    ``compact`` is for tables of few bytes a row after a shuffle: as many tasks write them as can
    run at once, not one for each shuffle partition.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    if compact:
        df = df.coalesce(spark.sparkContext.defaultParallelism)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def carried(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): all columns but text as the struct row, so that no name of theirs clashes with an operator's own."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*rest).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def restored(rows: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The columns that ``carried`` has taken in, with the text from the column ``text``."""
    return rows.select(*[F.col(text).alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in columns])


def text_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Yields (rows, bytes, offsets); row i is ``bytes[offsets[i]:offsets[i + 1]]``, nulls are empty."""
    col = batch.column(column)
    if pa.types.is_null(col.type):
        col = pa.array([""] * len(col), pa.large_string())
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i up to n."""
    if len(_tables.get("pow", ())) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        for name, step in (("pow", _BASE), ("inv", pow(_BASE, -1, 1 << 64))):
            t = np.full(size, step, np.uint64)
            t[0] = 1
            _tables[name] = np.cumprod(t, dtype=np.uint64)
    return _tables["pow"], _tables["inv"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that any bits of the result can be used."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Spans:
    """Polynomial hashes of any spans of one buffer, in constant time each."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _powers(len(data))
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=self.prefix[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def byte_table(is_word) -> np.ndarray:
    """256 entries: the byte of a word, A-Z lowered, or 0 for a separator (a NUL that counts as a word byte becomes 255, which UTF-8 lacks)."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    out = np.where([is_word(int(b)) for b in t], t, 0).astype(np.uint8)
    out[0] = 255 if is_word(0) else 0
    return out


def word_spans(table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lowered bytes, start, end, words before each row); words are maximal runs inside a row."""
    low = table[data]
    inside = low != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return low, start, end, np.searchsorted(start, offsets)


def row_of(before: np.ndarray) -> np.ndarray:
    """The row of each item, from how many items lie before each row."""
    return np.repeat(np.arange(len(before) - 1), np.diff(before))


def within(row: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The place of each item inside its row."""
    return np.arange(len(row)) - before[:-1][row]
