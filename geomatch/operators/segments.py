"""Long streams cut into segments, so that one stream spreads over tasks.

A row starts a new segment if a hash of its stream and its place in order says so, which is one
row in ``rows``. So cuts depend on content only: lost tasks that run again see the same ones, rows
of one place stay together, and a stream of few rows most often has none. The cuts are what all
tasks get; there are at most MOST_CUTS, since segments grow by 16 until that holds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT_ROWS, MOST_CUTS = 65_536, 1 << 20
FIRST = -(2**63)


class Cuts:
    """Sorted cuts (stream, place) and the search in them."""

    def __init__(self, stream: np.ndarray, place: np.ndarray):
        order = np.lexsort((place, stream))
        self.stream, self.place = stream[order], place[order]

    def find(self, stream: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cuts of the same stream at or before the place, all cuts of the stream), by one binary search for all rows."""
        first, end = np.searchsorted(self.stream, stream, "left"), np.searchsorted(self.stream, stream, "right")
        lo, hi = first.copy(), end.copy()
        while (more := lo < hi).any():
            middle = (lo + hi) // 2
            up = more & (self.place[np.minimum(middle, len(self.place) - 1)] <= place)
            lo, hi = np.where(up, middle + 1, lo), np.where(more & ~up, middle, hi)
        return lo - first, end - first


def cut(df: DataFrame, keys: list[str], place: Column, rows: int | None = None) -> tuple[DataFrame, bool]:
    """df with ``segment``, which grows with the place in a stream, and ``cuts``, 0 for a stream that is one
    segment; and whether any stream has a cut.

    ``keys`` name a stream, null being a key like any other; ``place`` is a long, null the first.
    """
    stream, at = F.xxhash64(*keys), F.coalesce(place.cast("long"), F.lit(FIRST))
    step, cuts = rows or SEGMENT_ROWS, None
    while cuts is None or len(cuts) > MOST_CUTS:
        step = step if cuts is None else 16 * step
        cuts = df.select(stream.alias("s"), at.alias("p")).where(F.pmod(F.xxhash64("s", "p"), F.lit(step)) == 0).distinct().limit(MOST_CUTS + 1).toPandas()
    if cuts.empty:
        return df.withColumns({"segment": F.lit(0).cast("long"), "cuts": F.lit(0).cast("long")}), False
    sent = df.sparkSession.sparkContext.broadcast(Cuts(cuts["s"].to_numpy(), cuts["p"].to_numpy()))

    @F.pandas_udf("segment long, cuts long")
    def find(s: pd.Series, p: pd.Series) -> pd.DataFrame:
        segment, n = sent.value.find(s.to_numpy(), p.to_numpy())
        return pd.DataFrame({"segment": segment, "cuts": n})

    return df.withColumn("_cut", find(stream, at)).select(*df.columns, "_cut.segment", "_cut.cuts"), True


def segmented(df: DataFrame, keys: list[str], place: Column, rows: int | None = None) -> DataFrame:
    return cut(df, keys, place, rows)[0]


def with_previous(df: DataFrame, keys: list[str], place: str, value: Column, name: str, rows: int | None = None) -> DataFrame:
    """df with ``value`` of the row before in its stream, and the columns of ``cut``.

    Each segment looks back inside itself; its first row gets the last row of the segment before,
    of which there is one for each segment.
    """
    parts, any_cut = cut(df, keys, F.col(place), rows)
    inside = parts.withColumn(name, F.lag(value).over(Window.partitionBy(*keys, "segment").orderBy(place)))
    if not any_cut:
        return inside
    last = parts.where("cuts > 0").groupBy(*keys, "segment").agg(F.max_by(F.struct(value.alias("v")), F.col(place)).alias("_last"))
    before = last.select(*keys, "segment", F.lag("_last").over(Window.partitionBy(*keys).orderBy("segment"))["v"].alias("_before"))
    before = before.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("segment").alias("_segment"), "_before")
    same = F.col("segment") == F.col("_segment")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    first = F.row_number().over(Window.partitionBy(*keys, "segment").orderBy(place)) == 1
    joined = inside.withColumn("_first", first).join(before, same, "left")
    return joined.withColumn(name, F.when(F.col("_first"), F.col("_before")).otherwise(F.col(name))).select(*inside.columns)
