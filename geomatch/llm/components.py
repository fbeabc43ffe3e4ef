"""Connected components of a link table, by repeated joins of edges with their least neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import written


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the least node of its component) for every node of links (a, b).

    Each round joins larger neighbours to the least one (large star), then smaller ones to the
    least one (small star), until nothing changes; the rounds needed grow with the logarithm of a
    component's size. A node of very many links only takes part in sums and one equi-join.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges", compact=True)
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = written(small.where("u <> v").distinct(), "edges", compact=True)
        now = edges.agg(F.count("*"), F.sum(F.shiftrightunsigned(F.xxhash64("u", "v"), 20))).first()
        # the same links came out again: every node has one, to its root
        if before == now:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
