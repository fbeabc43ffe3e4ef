"""Cuts of long streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from geomatch.operators import segments


def test_cuts_are_found_as_by_counting():
    rng = np.random.default_rng(1)
    stream, place = rng.integers(-3, 3, 400), rng.integers(-50, 50, 400)
    pairs = np.unique(np.stack([stream[:60], place[:60]]), axis=1)
    order = rng.permutation(pairs.shape[1])
    cuts = segments.Cuts(pairs[0][order], pairs[1][order])
    at, n = cuts.find(stream, place)
    for s, p, a, m in zip(stream, place, at, n, strict=True):
        own = pairs[1][pairs[0] == s]
        assert (a, m) == ((own <= p).sum(), len(own))


def test_segments_follow_the_order_and_part_a_long_stream(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 50 == 0, F.col("id").cast("string")).otherwise("hot").alias("k"), F.when(F.col("id") != 7, F.col("id")).alias("t"), F.lit(1).alias("s"))
    rows = segments.segmented(df, ["k"], F.col("t"), 100).where("k = 'hot'").orderBy("t").collect()
    parts = [r.segment for r in rows]
    assert parts == sorted(parts) and 15 < len(set(parts)) < 100 and rows[0].segment == parts[0] and rows[0].t is None
    assert {r.cuts for r in rows} == {rows[0].cuts} and rows[0].cuts > 0
    one = segments.segmented(df.where("k = '50'"), ["k"], F.col("t"), 1 << 40).collect()
    assert [(r.segment, r.cuts) for r in one] == [(0, 0)]
    assert segments.segmented(df.limit(0), ["k"], F.col("t"), 3).count() == 0
    # the same input has the same cuts however it is dealt
    again = segments.segmented(df.repartition(7), ["k"], F.col("t"), 100)
    assert sorted((r.t or -1, r.segment) for r in again.collect()) == sorted((r.t or -1, r.segment) for r in segments.segmented(df, ["k"], F.col("t"), 100).collect())
