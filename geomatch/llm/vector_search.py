"""Exact top-k inner products by vector-approximation files.

Vectors become integers and lie in blocks. A block keeps, beside its exact vectors, a file of
cells: each component in ``2**bits`` equal steps of its dimension's range. A query scans the cells
by one product, which is off by the same at most for all vectors: half a step times each of its
components. That bounds every score from both sides. The query drops what cannot reach its k-th
best lower bound, and reads exact vectors from the highest upper bound on until the k-th score is
certain. The k best of every block then meet in one ranking by query.

A stated query set meets all rows in blocks: the rows of a block are sent once for each block of
queries, so that a task holds one block of each. Only k rows a query and block leave it.

Defined cases: a vector that is null or empty, or holds a null or non-finite component, takes no
part; a query meets vectors of its own length only; ties go to the smaller id; a repeated row
counts as often as it occurs; no row of the query's own id is a candidate; a null id is no query's
own, and comes last among equal scores; other columns are ignored.
Vectors and queries with components so large that a score may not fit a double take part too, by
integers of any size; a score outside the range of a long counts as the end of that range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 8192
QUERIES_PER_BLOCK = 2048


def integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as a double, or null if the vector takes no part."""
    y = lambda v: v.cast("double") * F.lit(float(scale))
    # beyond 2**52 a double has no fraction
    x = F.transform(vector, lambda v: F.when(F.abs(y(v)) < F.lit(2.0**52), F.floor(F.when(F.abs(y(v)) < F.lit(2.0**52), y(v))).cast("double")).otherwise(y(v)))
    sound = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(y(v)) < F.lit(float("inf"))))
    return F.when((F.size(vector) > 0) & F.coalesce(sound, F.lit(False)), x)


class CellFile:
    """The cells of one block and the bounds they give."""

    def __init__(self, vectors: np.ndarray, bits: int):
        low, high = vectors.min(0), vectors.max(0)
        self.step = np.maximum(1.0, np.ceil((high - low + 1) / (1 << bits)))
        self.middle = low + (self.step - 1) / 2
        self.cells = np.floor((vectors - low) / self.step).astype(np.uint8 if bits <= 8 else np.uint16)
        self.span = self.cells.max(0).astype(float)

    def scan(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the middles of cells, and for each query how far they may be off."""
        scaled = queries * self.step
        rough = (scaled.astype(np.float32) @ self.cells.T.astype(np.float32)).astype(np.float64) + (queries @ self.middle)[:, None]
        rounding = (np.abs(scaled) @ self.span + np.abs(queries) @ np.abs(self.middle)) * (queries.shape[1] + 4) * 2.0**-23
        return rough, np.abs(queries) @ ((self.step - 1) / 2) + rounding


def best_of_block(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, no_id: np.ndarray, k: int, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's place, rows, scores) of the k best of a block, ties by id, rows without one last; exact.

    Components are integers held as doubles. Scores of vectors with large ones, or of queries with
    large ones, are products of Python's integers.
    """
    most = np.sqrt(2.0**52 / vectors.shape[1])
    fit, plain = np.abs(vectors).max(1) <= most, np.abs(queries).max(1) <= most
    order = np.lexsort((ids, no_id, ~fit))
    # where a row stands among all by id, which settles ties
    turn_of = np.empty(len(ids), np.int64)
    turn_of[np.lexsort((ids, no_id))] = np.arange(len(ids))
    vectors, ids, no_id, turn_of, n_fit = vectors[order], ids[order], no_id[order], turn_of[order], int(fit.sum())
    small, large = vectors[:n_fit], vectors[n_fit:]
    file = CellFile(small, bits) if n_fit and plain.any() else None
    end = 2**63

    def exact(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        q = [int(x) for x in q]
        return np.array([max(-end, min(end - 1, sum(int(x) * y for x, y in zip(r, q, strict=True)))) for r in rows.tolist()], np.int64)

    for at in range(0, len(queries), 128):
        some = np.flatnonzero(plain[at : at + 128]) + at
        rough = dict(zip(some.tolist(), zip(*file.scan(queries[some]), strict=True), strict=True)) if file is not None and len(some) else {}
        for i in range(at, min(at + 128, len(queries))):
            q = queries[i]
            got_at, got = np.zeros(0, np.int64), np.zeros(0, np.int64)

            def take(where: np.ndarray, scores: np.ndarray) -> None:
                nonlocal got_at, got
                got_at, got = np.r_[got_at, where], np.r_[got, scores]
                # a negated long may not fit one
                first = np.lexsort((turn_of[got_at], ~got))[:k]
                got_at, got = got_at[first], got[first]

            may = (ids != own[i]) | no_id
            whole = np.flatnonzero(may) if i not in rough else np.flatnonzero(may[n_fit:]) + n_fit
            if len(whole):
                take(whole, exact(vectors[whole], q))
            if i in rough:
                score, off = rough[i]
                other = np.flatnonzero(may[:n_fit])
                near = score[other]
                if len(other) > k:
                    keep = near + off >= np.partition(near, len(near) - k)[len(near) - k] - off
                    other, near = other[keep], near[keep]
                turn = np.argsort(-near, kind="stable")
                other, near = other[turn], near[turn]
                for lo in range(0, len(other), 64):
                    if len(got) >= k and near[lo] + off < got[-1]:
                        break
                    part = other[lo : lo + 64]
                    take(part, (small[part].astype(np.int64) @ q.astype(np.int64)))
            if len(got):
                yield i, order[got_at], got


def search(rows: DataFrame, queries: DataFrame, k: int = 5, bits: int = 6, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query.

    ``rows`` and ``queries`` have (vec_id, embedding).
    """

    def prepared(df: DataFrame, per_block: int, tag: str) -> DataFrame:
        """(vec_id, dim, v, block): rows of one length are dealt to blocks by id, hot ids by content."""
        v = df.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), scale).alias("v"), F.monotonically_increasing_id().alias("_at"))
        v = v.where("v is not null").withColumn("dim", F.size("v"))
        blocks = v.groupBy("dim").agg(F.ceil(F.count("*") / per_block).cast("long").alias(f"{tag}_blocks"))
        return v, blocks

    r, r_blocks = prepared(rows, ROWS_PER_BLOCK, "r")
    q, q_blocks = prepared(queries.where("vec_id is not null"), QUERIES_PER_BLOCK, "q")
    # one row a vector length; the number of lengths in use is small, their sizes are what counts
    sizes = r_blocks.join(q_blocks, "dim")
    r = r.join(sizes, "dim").withColumn("rb", F.pmod(F.xxhash64("vec_id", "_at"), "r_blocks")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
    q = q.join(sizes, "dim").withColumn("qb", F.pmod(F.xxhash64("vec_id", "_at"), "q_blocks")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("r_blocks") - 1)))
    keep = ["dim", "rb", "qb", "vec_id", "v"]

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "q_row": [], "vec_id": [], "score": []}).astype("int64")
        qs, vs = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
        own, at = left["vec_id"].to_numpy(np.int64), left["_at"].to_numpy(np.int64)
        ids, no_id = right["vec_id"].to_numpy(np.int64), right["no_id"].to_numpy(bool)
        found = list(best_of_block(qs, own, vs, ids, no_id, k, bits))
        n = [len(i) for _, i, _ in found]
        who = np.repeat(np.array([p for p, _, _ in found], np.int64), n)
        none = np.zeros(0, np.int64)
        rows = np.concatenate([i for _, i, _ in found] or [none])
        return pd.DataFrame({"query_id": own[who], "q_row": at[who], "vec_id": pd.Series(ids[rows], dtype="Int64").mask(no_id[rows]), "score": np.concatenate([s for _, _, s in found] or [none])})

    by = ["dim", "rb", "qb"]
    # a null id would turn the ids of its block into doubles
    r = r.withColumns({"no_id": F.col("vec_id").isNull(), "vec_id": F.coalesce("vec_id", F.lit(0))})
    found = q.select(*keep, "_at").groupBy(*by).cogroup(r.select(*keep, "no_id").groupBy(*by)).applyInPandas(meet, "query_id long, q_row long, vec_id long, score long")
    order = Window.partitionBy("query_id", "q_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
