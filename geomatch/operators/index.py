"""An index of unit vectors on disk: trained centres, posting lists of codes, exact vectors apart.

``build`` trains centres by k-means on a bounded sample and writes, below one path,

- ``lists``: (list, centre, radius, rows, parts), at most MOST_LISTS rows, which all tasks may get;
- ``codes``, partitioned by list: (row, part, code, step, off), one byte a component of what
  lies between a vector and its centre, and how far off that is;
- ``vectors``, partitioned by list: (id, row, part, vector), read only for what the codes leave over.

A search visits the lists nearest to a query. A code gives its vector's score to within ``off``, so
the k-th best lower end is a bar that the true k-th score is not below. A list whose centre and
radius put all its vectors under that bar is not visited, a code whose upper end is under it
not looked up. An exact search then visits every list that the bar leaves open. A search of
``probes`` lists does so only for queries with fewer than k hits; the others go on to as many of
the nearest lists as hold the share ``least`` of the exact hits of a sample of TRIED queries,
since what a fixed number of lists finds falls with the number of lists.

Long lists are cut into parts of about PART_ROWS rows and many queries of a list into blocks, so
that neither a hot list nor a hot query lands in one task. Lists come as partition filters, so
that files of lists nobody visits are not read.

Defined cases: a null or empty vector takes no part, a query without one has no hits; ids may repeat
or be null, and each row counts; ties go to the smaller id; fewer vectors than k give all of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geomatch.functions.vectors import l2_normalize
from geomatch.operators.search import DECIMALS
from geomatch.sources.shared import written

MOST_LISTS, SAMPLE_A_LIST = 65_536, 64
PART_ROWS, QUERY_ROWS, PROBES = 16_384, 2048, 4
#: Of a search of some lists: the share of exact hits to reach, and the queries it is measured on.
LEAST, TRIED = 0.95, 256
#: Rows of visits that leave a task at a time.
VISITS = 4096
SLACK = 1e-9


def trained(unit: DataFrame, n: int, lists: int, seed: int) -> np.ndarray:
    """Centres of k-means on SAMPLE_A_LIST vectors a list, drawn by a hash of their content; equal ones count once."""
    want = lists * SAMPLE_A_LIST
    sample = unit.select("v").where(F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(max(n, 1))) < 2 * want).dropDuplicates(["v"]).orderBy(F.xxhash64("v", F.lit(seed + 1))).limit(want)
    sample = written(sample, "sample").select(array_to_vector("v").alias("features"))
    k = min(lists, sample.count())
    if k < 2:
        return np.array([r.features.toArray() for r in sample.limit(1).collect()])
    return np.array(KMeans(k=k, maxIter=10, seed=seed, initMode="random").fit(sample).clusterCenters())


def units(df: DataFrame, key: str, eps: float) -> DataFrame:
    """(key, v) of the vectors of finite numbers, as unit vectors."""
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return df.where("size(vector) > 0").where(sound).select(key, l2_normalize(F.col("vector"), eps).alias("v"))


def coded(unit: DataFrame, centres: np.ndarray) -> DataFrame:
    """unit (id, v) with the nearest list and the code of what lies between."""
    sent = unit.sparkSession.sparkContext.broadcast((centres, (centres**2).sum(1) / 2))

    @F.pandas_udf("list int, code binary, step double, off double, far double")
    def code(column: pd.Series) -> pd.DataFrame:
        c, half = sent.value
        v = np.stack(column.to_numpy()) if len(column) else np.zeros((0, c.shape[1]))
        own = np.concatenate([np.argmax(v[k : k + 256] @ c.T - half, 1) for k in range(0, len(v), 256)] or [np.zeros(0, int)])
        rest = v - c[own]
        step = np.maximum(np.abs(rest).max(1, initial=0) / 127, 1e-30)
        codes = np.rint(rest / step[:, None]).astype(np.int8)
        off = np.linalg.norm(rest - codes * step[:, None], axis=1) + SLACK
        return pd.DataFrame({"list": own.astype(np.int32), "code": [x.tobytes() for x in codes], "step": step, "off": off, "far": np.linalg.norm(rest, axis=1) + SLACK})

    return unit.withColumn("_c", code("v")).select("id", "v", "_c.*")


def places(near: np.ndarray) -> np.ndarray:
    """For each query the places of all lists in the order of their nearness, from 0."""
    return np.argsort(np.argsort(-near, 1, kind="stable"), 1, kind="stable")


def left_open(pdf: pd.DataFrame, centres: np.ndarray, radius: np.ndarray, names: np.ndarray, first: int, rest: bool, upto: int | None = None) -> Iterator[pd.DataFrame]:
    """The ``first`` nearest lists of queries (q_row, v, bar), or with ``rest`` the others that may hold a
    score of the bar or more, of the ``upto`` nearest only where there is a bar. They come in frames of at
    most VISITS rows: without clusters nearly all lists are left."""
    for at in range(0, len(pdf), 256):
        part = pdf.iloc[at : at + 256]
        near = np.stack(part["v"].to_numpy()) @ centres.T
        place = places(near)
        bar = np.nan_to_num(part["bar"].to_numpy(float), nan=-2.0)[:, None]
        take = (place >= first) & (near + radius + SLACK >= bar) if rest else place < first
        if rest and upto is not None:
            take &= (place < upto) | part["bar"].isna().to_numpy()[:, None]
        i, j = np.nonzero(take)
        for b in range(0, len(i), VISITS):
            own, there = i[b : b + VISITS], j[b : b + VISITS]
            yield pd.DataFrame({"q_row": part["q_row"].to_numpy()[own], "v": part["v"].to_numpy()[own], "bar": bar[own, 0], "list": names[there]})


@dataclass
class Found:
    """The hits, and what was read for them: visited lists (q_row, list, rows) and exact vectors (q_row, row)."""

    hits: DataFrame
    visits: DataFrame
    looked_up: DataFrame

    def reads(self, queries: int, points: int) -> tuple[float, float]:
        """The shares of all codes and of all vectors that a query reads, on average."""
        codes = self.visits.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        return codes / max(1, queries * points), self.looked_up.count() / max(1, queries * points)


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @classmethod
    def build(cls, points: DataFrame, path: str, lists: int | None = None, seed: int = 42, eps: float = 1e-12) -> VectorIndex:
        """points (id, vector) of one length; by default twice the root of their number in lists."""
        index = cls(points.sparkSession, path)
        unit = units(points, "id", eps)
        n = unit.count()
        centres = trained(unit, n, max(1, min(MOST_LISTS, lists or round(2 * n**0.5))), seed)
        if not len(centres):
            raise ValueError("an index needs at least one vector")
        rows = written(coded(unit, centres).withColumn("row", F.monotonically_increasing_id()), "coded")
        about = rows.groupBy("list").agg(F.count("*").alias("rows"), F.max("far").alias("radius")).withColumn("parts", F.ceil(F.col("rows") / PART_ROWS).cast("int"))
        named = index.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "list int, centre array<double>")
        named.join(about, "list").repartition(1).write.mode("overwrite").parquet(f"{index.path}/lists")
        # lists are at most MOST_LISTS
        part = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
        dealt = rows.join(F.broadcast(about.select("list", "parts")), "list").withColumn("part", part).repartition("list", "part").sortWithinPartitions("list", "part", "row")
        for name, cols in (("codes", ["row", "part", "code", "step", "off"]), ("vectors", ["id", "row", "part", F.col("v").alias("vector")])):
            dealt.select("list", *cols).write.mode("overwrite").partitionBy("list").parquet(f"{index.path}/{name}")
        return index

    def of_lists(self, name: str, lists: list[int], all_lists: int) -> DataFrame:
        """A table of some lists; the names reach the scan as a partition filter."""
        df = self.table(name)
        return df if len(lists) == all_lists else df.where(F.col("list").isin(lists) if lists else F.lit(False))

    def search(self, queries: DataFrame, k: int = 5, probes: int | None = None, eps: float = 1e-12, least: float = LEAST) -> Found:
        """query_id, id, score, rank of queries (query_id, vector), exact unless ``probes`` is given: then of
        so many lists, and of further ones as ``least`` asks for (0: none)."""
        q = written(units(queries, "query_id", eps).withColumn("q_row", F.monotonically_increasing_id()), "queries")
        upto = None if probes is None else max(probes, self.lists_for(q, k, least)) if least > 0 else probes
        return self.found(q, k, probes or PROBES, upto)[0]

    def lists_for(self, q: DataFrame, k: int, least: float) -> int:
        """How many of its nearest lists a query visits for that share of the exact hits, by TRIED queries drawn by a hash."""
        some = written(q.orderBy(F.xxhash64("v"), "q_row").limit(TRIED), "tried")
        hits = self.found(some, k, PROBES, None)[1].select("q_row", "list").toPandas()
        if not len(hits):
            return 0
        about, asked = self.table("lists").orderBy("list").toPandas(), some.toPandas()
        place = places(np.stack(asked["v"].to_numpy()) @ np.stack(about["centre"].to_numpy()).T)
        row = pd.Index(asked["q_row"]).get_indexer(hits["q_row"])
        at = np.sort(place[row, np.searchsorted(about["list"].to_numpy(), hits["list"].to_numpy())])
        return int(at[min(len(at), max(1, int(np.ceil(least * len(at))))) - 1]) + 1

    def found(self, q: DataFrame, k: int, first: int, upto: int | None) -> tuple[Found, DataFrame]:
        """What queries (query_id, v, q_row) find, and the lists (q_row, list) of the hits; exact if ``upto`` is None."""
        about = self.table("lists").orderBy("list").toPandas()
        sent = self.spark.sparkContext.broadcast((np.stack(about["centre"].to_numpy()), about["radius"].to_numpy(), about["list"].to_numpy(np.int64)))

        def visits(rows: DataFrame, rest: bool) -> DataFrame:
            """The nearest lists; with ``rest`` the others that may hold a score of the bar or more."""

            def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for pdf in frames:
                    yield from left_open(pdf, *sent.value, first, rest, upto)

            return written(rows.mapInPandas(run, "q_row long, v array<double>, bar double, list int"), "visits")

        def scan(seen: DataFrame) -> DataFrame:
            """(q_row, list, part, row, low, high) of the codes over the bar, or among the k best of their part."""
            load = seen.groupBy("list").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks")).join(self.table("lists").select("list", "parts"), "list")
            load = written(load, "load")
            codes = self.of_lists("codes", [r.list for r in load.select("list").collect()], len(about)).join(F.broadcast(load), "list")
            codes = codes.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("list", "part", "block", "row", "code", "step", "off")
            asked = seen.join(F.broadcast(load), "list").withColumns({"block": F.pmod(F.xxhash64("q_row"), "blocks").cast("int"), "part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))}).select("list", "part", "block", "q_row", "v", "bar")

            def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
                out = []
                if len(left) and len(right):
                    centres, _, names = sent.value
                    step, off = right["step"].to_numpy(), right["off"].to_numpy()
                    code = np.frombuffer(b"".join(right["code"]), np.int8).reshape(len(right), -1).astype(float)
                    centre = centres[int(np.searchsorted(names, left["list"].iloc[0]))]
                    for at in range(0, len(left), 64):
                        part = left.iloc[at : at + 64]
                        v = np.stack(part["v"].to_numpy())
                        about_score = (v @ centre)[:, None] + (v @ code.T) * step
                        low, high = about_score - off, about_score + off
                        bar = part["bar"].to_numpy()
                        if len(right) > k:
                            bar = np.maximum(bar, np.partition(low, len(right) - k, 1)[:, len(right) - k])
                        # scores are rounded before they are ranked
                        i, j = np.nonzero(high >= bar[:, None] - 10.0**-DECIMALS)
                        rows = right.iloc[j]
                        out.append(pd.DataFrame({"q_row": part["q_row"].to_numpy()[i], "list": rows["list"].to_numpy(), "part": rows["part"].to_numpy(), "row": rows["row"].to_numpy(), "low": low[i, j], "high": high[i, j]}))
                return pd.concat(out) if out else pd.DataFrame(columns=["q_row", "list", "part", "row", "low", "high"])

            by = ["list", "part", "block"]
            return written(asked.groupBy(*by).cogroup(codes.groupBy(*by)).applyInPandas(meet, "q_row long, list int, part int, row long, low double, high double"), "scanned")

        def bars(found: DataFrame) -> DataFrame:
            """(q_row, bar): the k-th highest lower end, null for queries with fewer than k codes."""
            order = Window.partitionBy("q_row").orderBy(F.desc("low"))
            best = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
            return best.groupBy("q_row").agg(F.when(F.count("*") == k, F.min("low")).alias("bar"))

        seen = visits(q.withColumn("bar", F.lit(None).cast("double")), False)
        found = scan(seen)
        more = q.join(bars(found), "q_row", "left").select("v", "q_row", "bar")
        more = visits(more, True)
        found = found.unionByName(scan(more))
        left = found.join(bars(found), "q_row").where((F.col("high") >= F.col("bar") - F.lit(10.0**-DECIMALS)) | F.col("bar").isNull()).select("q_row", "list", "part", "row")
        left = written(left, "left")
        lists = [r.list for r in left.select("list").distinct().collect()]
        exact = left.join(self.of_lists("vectors", lists, len(about)), ["list", "part", "row"]).join(q, "q_row")
        score = F.aggregate(F.zip_with("v", "vector", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        scored = exact.select("query_id", "q_row", "list", "id", F.round(score, DECIMALS).alias("score"))
        order = Window.partitionBy("query_id", "q_row").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        hits = best.select("query_id", "id", "score", "rank")
        sizes = self.table("lists").select("list", "rows")
        return Found(hits, seen.unionByName(more).select("q_row", "list").join(sizes, "list"), left.select("q_row", "row")), best.select("q_row", "list")
