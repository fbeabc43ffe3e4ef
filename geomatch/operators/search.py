"""Exact, geo-filtered and approximate top-k over embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geomatch.functions.geo import MEAN_RADIUS, haversine
from geomatch.functions.vectors import cosine, l2_normalize
from geomatch.sources.shared import written

#: Queries that go to all tasks whole; scores held at a time; rows of a block where neither side does.
QUERY_BYTES, TILE_BYTES, BLOCK_ROWS = 64 << 20, 32 << 20, 16_384
DECIMALS = 6
#: Share of the exact hits of a sample of queries that an approximate search holds, and that sample's
#: size; beyond so many bits more points are read, not more bits.
LEAST, TRIED, MOST_BITS = 0.95, 256, 1024


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ties to the smaller id; only k rows a query leave a task."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_of(queries: pd.DataFrame, points: pd.DataFrame, k: int, exclude_self: bool, rows: Callable[[pd.Series], np.ndarray]) -> Iterator[pd.DataFrame]:
    """The k best of some points (id, v) for each of some queries (query_id, v), in tiles of bounded size."""
    if not len(queries) or not len(points):
        return
    points = points.sort_values("id", kind="stable", na_position="first")
    v, own = rows(points["v"]), points["id"].to_numpy()
    step = max(1, TILE_BYTES // (8 * len(own)))
    for at in range(0, len(queries), step):
        some = queries.iloc[at : at + step]
        ids, s = some["query_id"].to_numpy(), np.round(rows(some["v"]) @ v.T, DECIMALS)
        if exclude_self:
            s[ids[:, None] == own[None, :]] = -np.inf
        if k < len(own):
            kth = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
            over, equal = s > kth, s == kth
            s[~(over | equal & (np.cumsum(equal, 1, dtype=np.int32) <= k - over.sum(1, keepdims=True)))] = -np.inf
        i, j = np.nonzero(np.isfinite(s))
        yield pd.DataFrame({"query_id": ids[i], "id": own[j], "score": s[i, j]})


def stacked(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy())


def nearest(queries: DataFrame, points: DataFrame, k: int, exclude_self: bool, size: int, rows: Callable[[pd.Series], np.ndarray] = stacked) -> DataFrame:
    """(query_id, id, score, rank) by the inner product of rows of v: queries (query_id, v), points (id, v).

    ``size`` says how many bytes the queries are. Up to QUERY_BYTES they go to all tasks and points
    stay where they are; beyond, blocks of queries meet blocks of points.
    """
    kinds = {"query_id": queries.schema["query_id"].dataType.simpleString(), "id": points.schema["id"].dataType.simpleString()}
    schema = f"query_id {kinds['query_id']}, id {kinds['id']}, score double"
    if size <= QUERY_BYTES:
        sent = queries.sparkSession.sparkContext.broadcast(queries.toPandas())

        def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                yield from best_of(sent.value, pdf, k, exclude_self, rows)

        return ranked(points.mapInPandas(run, schema), k)
    nq, np_ = (-(-df.count() // BLOCK_ROWS) or 1 for df in (queries, points))
    # by content, so that a task that runs again deals rows as before; of equal points k are enough
    dealt = lambda df, n, own, other, m: df.withColumn(own, F.pmod(F.xxhash64(df.columns[0], "v"), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))
    few = points.groupBy("id", "v").agg(F.count("*").alias("_n")).select("id", "v", F.explode(F.array_repeat(F.lit(0), F.least("_n", F.lit(k)).cast("int"))).alias("_n")).drop("_n")
    q, p = dealt(queries, nq, "_q", "_p", np_), dealt(few, np_, "_p", "_q", nq)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = list(best_of(left, right, k, exclude_self, rows))
        return pd.concat(found) if found else pd.DataFrame({"query_id": left["query_id"].head(0), "id": right["id"].head(0), "score": np.zeros(0)})

    return ranked(q.groupBy("_q", "_p").cogroup(p.groupBy("_q", "_p")).applyInPandas(meet, schema), k)


def knn(queries: DataFrame, points: DataFrame, k: int = 5, exclude_self: bool = False, eps: float = 1e-12) -> DataFrame:
    """(query_id, id, score, rank) by cosine; scores are rounded to 6 places before they are ranked.

    ``queries`` (query_id, vector), ``points`` (id, vector); see ``nearest`` for how they meet.
    """
    n, dim = queries.agg(F.count("*"), F.max(F.size("vector"))).first()
    unit = lambda df, key: df.select(key, l2_normalize(F.col("vector"), eps).alias("v")).where("v is not null")
    return nearest(unit(queries, "query_id"), unit(points, "id"), k, exclude_self, n * max(1, dim or 1) * 8)


def geo_radius_join(queries: DataFrame, points: DataFrame, radius_m: float) -> DataFrame:
    """Pairs of queries (query_id, lon, lat) and points (id, lon, lat) within a radius, by an equi-join on cells.

    Bands of latitude are one radius high. A band has as many cells as leave each wider than the
    radius reaches there, one near the poles, so that a query meets nine cells at most. Both sides
    of the join are shuffled by cell, so that Spark can split crowded ones.
    """
    d = float(np.degrees(radius_m / MEAN_RADIUS)) * 1.0001
    band = lambda lat: F.floor((lat + 90) / d)

    def cells(cy: Column) -> Column:
        # the cosine where the band and those beside it are nearest to a pole
        far = F.least(F.greatest(F.abs((cy - 1) * d - 90), F.abs((cy + 2) * d - 90)), F.lit(90.0))
        n = F.floor(360 * F.cos(F.radians(far)) / (1.1 * d))
        return F.when(n < 8, F.lit(1).cast("long")).otherwise(n)

    column = lambda lon, n: F.least(F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * n), n - 1)
    q = queries.withColumn("_cy", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: band(F.col("lat")) + k))).withColumn("_n", cells(F.col("_cy")))
    q = q.withColumn("_cx", F.explode(F.array_distinct(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: F.pmod(column(F.col("lon"), F.col("_n")) + k, F.col("_n"))))))
    q = q.select(*queries.columns, "_cx", "_cy").withColumnsRenamed({"lon": "q_lon", "lat": "q_lat"})
    p = points.withColumn("_cy", band(F.col("lat"))).withColumn("_cx", column(F.col("lon"), cells(F.col("_cy"))))
    meters = haversine(F.col("q_lon"), F.col("q_lat"), F.col("lon"), F.col("lat"))
    return q.join(p, ["_cx", "_cy"]).withColumn("meters", meters).where(F.col("meters") <= radius_m).drop("_cx", "_cy")


def knn_within(queries: DataFrame, points: DataFrame, k: int, radius_m: float) -> DataFrame:
    """Top-k of the points inside the radius: queries (query_id, vector, lon, lat), points (id, vector, lon, lat)."""
    q = queries.withColumnRenamed("vector", "q_vector")
    near = geo_radius_join(q, points, radius_m)
    return ranked(near.select("query_id", "id", F.round(cosine(F.col("q_vector"), F.col("vector")), DECIMALS).alias("score"), "meters"), k)


def candidates(queries: DataFrame, priors: DataFrame, points: DataFrame, k: int, radius_m: float) -> DataFrame:
    """Queries with a prior (query_id, lon, lat) search near it, the others everywhere."""
    q = queries.select("query_id", "vector").join(priors.select("query_id", "lon", "lat"), "query_id", "left")
    local = knn_within(q.where("lon is not null"), points, k, radius_m).select("query_id", "id", "score", "rank", F.lit("prior").alias("mode"))
    everywhere = knn(q.where("lon is null").select("query_id", "vector"), points.select("id", "vector"), k)
    return local.unionByName(everywhere.select("query_id", "id", "score", "rank", F.lit("global").alias("mode")))


def signatures(df: DataFrame, key: str, bits: int, seed: int) -> DataFrame:
    """(key, v): on which side of ``bits`` random planes through the origin a vector lies, as bits."""
    own = df.select(key, F.col("vector").cast("array<double>").alias("v")).where("v is not null and size(v) > 0")

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                v = stacked(pdf["v"])
                planes = np.random.default_rng(seed).normal(size=(v.shape[1], bits))
                yield pdf.assign(v=[x.tobytes() for x in np.packbits(v @ planes > 0, axis=1)])

    return own.mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, v binary")


def sides(bits: int) -> Callable[[pd.Series], np.ndarray]:
    """Signatures as rows of +1 and -1, whose inner product counts equal bits."""
    return lambda v: np.unpackbits(np.frombuffer(b"".join(v), np.uint8).reshape(len(v), -1), axis=1)[:, :bits].astype(np.float32) * 2 - 1


def rough(queries: DataFrame, points: DataFrame, k: int, bits: int = 256, seed: int = 42) -> DataFrame:
    """(query_id, id): the k points of each query whose signatures have most bits in common with its own."""
    q, p = signatures(queries, "query_id", bits, seed), signatures(points, "id", bits, seed)
    return nearest(q, p, k, False, queries.count() * (bits // 8 + 64), sides(bits)).select("query_id", "id")


def enough(queries: DataFrame, points: DataFrame, k: int, bits: int, oversample: int, seed: int, least: float) -> tuple[int, int]:
    """bits and oversample, doubled until ``rough`` holds the share ``least`` of the exact hits of TRIED queries."""
    some = written(queries.where("size(vector) > 0").orderBy(F.xxhash64("query_id", "vector")).limit(TRIED), "tried")
    exact, n = written(knn(some, points, k).where("id is not null"), "tried-hits"), points.count()
    while k * oversample < n:
        share = recall(rough(some, points, k * oversample, bits, seed), exact).first()[0]
        if share is None or share >= least:
            break
        bits, oversample = (2 * bits, oversample) if bits < MOST_BITS else (bits, 2 * oversample)
    return bits, oversample


def ann(queries: DataFrame, points: DataFrame, k: int, bits: int = 256, oversample: int = 40, seed: int = 42, least: float = LEAST) -> DataFrame:
    """Approximate top-k: all points are met as signatures of ``bits`` bits, and only the best
    k * oversample of a query by exact cosine, which ranks them. More points have more that come near
    a query, so both are where it begins, see ``enough``."""
    bits, oversample = enough(queries, points, k, bits, oversample, seed, least)
    found = rough(queries, points, k * oversample, bits, seed)
    pairs = found.join(points.select("id", "vector"), "id").join(queries.select("query_id", F.col("vector").alias("q_vector")), "query_id")
    return ranked(pairs.select("query_id", "id", F.round(cosine(F.col("q_vector"), F.col("vector")), DECIMALS).alias("score")), k)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    both = exact.select("query_id", "id").join(approximate.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def scroll(points: DataFrame, n: int) -> DataFrame:
    return points.orderBy("id").limit(n)


def self_recall(points: DataFrame, n: int) -> DataFrame:
    """Share of n stored points whose best hit is the point itself."""
    q = scroll(points, n).select(F.col("id").alias("query_id"), "vector")
    return knn(q, points, 1).agg(F.avg((F.col("query_id") == F.col("id")).cast("double")).alias("recall_at_1"), F.count("*").alias("queries"))
