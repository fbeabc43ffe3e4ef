"""Hard negatives by an STR-packed R-tree over integer vectors.

Vectors lie in blocks. A block packs its vectors, label by label, in sort-tile-recursive order of the
components that vary most into leaves, and leaves into nodes, each with its minimum bounding box.
A box gives an interval for each product of an anchor's component with that of any vector inside;
the sum of the ends bounds the inner product from both sides. A search pops boxes by their upper
bound, the best first. It leaves out boxes whose interval misses the window of scores asked for, and
those whose upper bound is strictly below the k-th score found so far; at the same score a smaller
id may still lie inside.

First each anchor finds its positives, the best other rows of its label. Their scores open one
window each, and one walk through the boxes of all other labels fills the windows of an anchor
together. Anchors and rows meet in blocks, so a task holds one block of each, and k rows an anchor
and window leave it. Rows that are equal throughout travel once with their count, at most k, so that
no repeated row fills a block; blocks are dealt by a hash of the row.

Defined cases: a row whose label or vector is null or empty, or that holds a null or non-finite
component, takes no part; vectors meet those of their own length only; a row of the anchor's own id
is neither its positive nor its negative; a null id is no anchor's, and comes last among equal
scores; ties go to the smaller id; a repeated row counts as often as it occurs, a repeated anchor
gives its rows again; an anchor without positives, and a window without negatives, give no rows;
components of any finite size take part by integers of any size, and a score outside the range of a
long counts as the end of that range; other columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textbytes import written
from .vector_search import integers

ROWS_PER_BLOCK, ANCHORS_PER_BLOCK = 8192, 2048
LEAF, FAN, TILED = 64, 8, 3
END = 2**63


def str_order(v: np.ndarray) -> np.ndarray:
    """Sort-tile-recursive order of vectors by their TILED most varying components."""
    dims = np.argsort(-v.var(0), kind="stable")[:TILED]

    def tile(rows: np.ndarray, left: list[int]) -> np.ndarray:
        rows = rows[np.argsort(v[rows, left[0]], kind="stable")]
        leaves = -(-len(rows) // LEAF)
        if len(left) == 1 or leaves <= 1:
            return rows
        slabs = int(np.ceil(leaves ** (1 / len(left))))
        size = -(-leaves // slabs) * LEAF
        return np.concatenate([tile(rows[k : k + size], left[1:]) for k in range(0, len(rows), size)])

    return tile(np.arange(len(v)), dims.tolist())


class RTree:
    """Boxes over the vectors of a block, one root for each label. Leaves are ranges of ``rows``."""

    def __init__(self, v: np.ndarray, labels: np.ndarray):
        rows, low, high, first, last, leaf = [], [], [], [], [], []
        self.roots: dict[int, int] = {}
        at = 0
        for label in np.unique(labels).tolist():
            own = np.flatnonzero(labels == label)
            own = own[str_order(v[own])]
            rows.append(own)
            starts = np.arange(0, len(own), LEAF)
            lo, hi = np.minimum.reduceat(v[own], starts), np.maximum.reduceat(v[own], starts)
            begin, end, is_leaf = at + starts, at + np.minimum(starts + LEAF, len(own)), True
            at += len(own)
            while True:
                here = sum(map(len, low))
                low.append(lo)
                high.append(hi)
                first.append(begin)
                last.append(end)
                leaf.append(np.full(len(lo), is_leaf))
                if len(lo) == 1:
                    break
                starts = np.arange(0, len(lo), FAN)
                begin, end, is_leaf = here + starts, here + np.minimum(starts + FAN, len(lo)), False
                lo, hi = np.minimum.reduceat(lo, starts), np.maximum.reduceat(hi, starts)
            self.roots[label] = here
        self.rows, self.low, self.high = np.concatenate(rows), np.concatenate(low), np.concatenate(high)
        self.first, self.last, self.leaf = np.concatenate(first).tolist(), np.concatenate(last).tolist(), np.concatenate(leaf).tolist()
        self.v = v[self.rows]

    def intervals(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lowest, highest) inner product of each query with any vector inside each box."""
        plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
        return plus @ self.low.T + minus @ self.high.T, plus @ self.high.T + minus @ self.low.T


@dataclass
class Windows:
    """Score windows of one anchor, and the k best rows found for each: scores and places in the block, best first."""

    low: list[int]
    high: list[int]
    k: int

    def __post_init__(self) -> None:
        self.scores = [np.zeros(0, np.int64)] * len(self.low)
        self.places = [np.zeros(0, np.int64)] * len(self.low)

    def least(self, w: int) -> int:
        """The lowest score that can still be among the k best of a window."""
        return max(self.low[w], int(self.scores[w][-1])) if len(self.scores[w]) == self.k else self.low[w]

    def take(self, w: int, scores: np.ndarray, places: np.ndarray) -> None:
        """Rows stand in order of ids, so places break ties."""
        right = (scores >= self.least(w)) & (scores <= self.high[w])
        if right.any():
            scores, places = np.r_[self.scores[w], scores[right]], np.r_[self.places[w], places[right]]
            # a negated long may not fit one
            best = np.lexsort((places, ~scores))[: self.k]
            self.scores[w], self.places[w] = scores[best], places[best]


def walk(tree: RTree, roots: list[int], lowest: np.ndarray, highest: np.ndarray, query: np.ndarray, allowed: np.ndarray, found: Windows) -> int:
    """Fills the windows from the boxes under roots, the highest bound first; returns how many leaves were read."""
    heap = [(-highest[n], n) for n in roots]
    heapq.heapify(heap)
    read = 0
    windows = range(len(found.low))
    while heap:
        bound, node = heapq.heappop(heap)
        bound = -bound
        least = [found.least(w) for w in windows]
        if bound < min(least):
            break
        live = [w for w in windows if bound >= least[w] and lowest[node] <= found.high[w]]
        if not live:
            continue
        if not tree.leaf[node]:
            for child in range(tree.first[node], tree.last[node]):
                heapq.heappush(heap, (-highest[child], child))
            continue
        read += 1
        rows = slice(tree.first[node], tree.last[node])
        scores, places = (tree.v[rows] @ query).astype(np.int64), tree.rows[rows]
        ok = allowed[places]
        scores, places = scores[ok], places[ok]
        for w in live:
            found.take(w, scores, places)
    return read


class Block:
    """Rows of a block, in order of ids, the null ones last. Vectors too large for exact doubles stay outside the tree."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(["no_id", "vec_id"], kind="stable")
        rows = rows.loc[rows.index.repeat(rows["times"])]
        self.ids, self.no_id, self.labels = rows["vec_id"].to_numpy(np.int64), rows["no_id"].to_numpy(bool), rows["label"].to_numpy(np.int64)
        self.v = np.stack(rows["v"].to_numpy())
        self.most = np.sqrt(2.0**52 / self.v.shape[1])
        fit = np.abs(self.v).max(1) <= self.most
        self.small, self.large = np.flatnonzero(fit), np.flatnonzero(~fit)
        self.tree = RTree(self.v[self.small], self.labels[self.small]) if len(self.small) else None

    def exact(self, places: np.ndarray, query: np.ndarray) -> np.ndarray:
        q = [int(x) for x in query]
        return np.array([max(-END, min(END - 1, sum(int(x) * y for x, y in zip(r, q, strict=True)))) for r in self.v[places].tolist()], np.int64)

    def search(self, anchors: pd.DataFrame, same: bool, windows: list[Windows]) -> None:
        """Fills each anchor's windows with rows of its label, or of all others."""
        q = np.stack(anchors["v"].to_numpy())
        plain = np.abs(q).max(1) <= self.most
        for at in range(0, len(q), 256):
            bounds = self.tree.intervals(np.where(plain[at : at + 256, None], q[at : at + 256], 0)) if self.tree else None
            for i in range(at, min(at + 256, len(q))):
                own, label = anchors["vec_id"].iat[i], int(anchors["label"].iat[i])
                right = (self.labels == label) == same
                right &= (self.ids != own) | self.no_id
                rest = self.large
                if self.tree is not None and plain[i]:
                    roots = [n for name, n in self.tree.roots.items() if (name == label) == same]
                    local = Windows(windows[i].low, windows[i].high, windows[i].k)
                    walk(self.tree, roots, bounds[0][i - at], bounds[1][i - at], q[i], right[self.small], local)
                    for w in range(len(local.low)):
                        windows[i].take(w, local.scores[w], self.small[local.places[w]])
                else:
                    rest = np.arange(len(self.v))
                rest = rest[right[rest]]
                if len(rest):
                    scores = self.exact(rest, q[i])
                    for w in range(len(windows[i].low)):
                        windows[i].take(w, scores, rest)


def prepared(rows: DataFrame, scale: int, k: int) -> DataFrame:
    """(vec_id, label, v, dim, times, key): each different row once; key names it."""
    v = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), integers(F.col("embedding"), scale).alias("v")).where("v is not null and label is not null")
    v = v.groupBy("vec_id", "label", "v").agg(F.count("*").alias("copies"))
    return v.select("vec_id", "label", "v", F.size("v").alias("dim"), "copies", F.least("copies", F.lit(k)).alias("times"), F.xxhash64("vec_id", "label", "v").alias("key"))


def met(anchors: DataFrame, rows: DataFrame, sizes: DataFrame, meet, schema: str) -> DataFrame:
    """What ``meet`` finds in each block of anchors with each block of rows of the same length."""
    r = rows.join(sizes, "dim").withColumn("rb", F.pmod(F.xxhash64("key"), "r_blocks")).withColumn("ab", F.explode(F.sequence(F.lit(0).cast("long"), F.col("a_blocks") - 1)))
    a = anchors.join(sizes, "dim").withColumn("ab", F.pmod(F.xxhash64("key"), "a_blocks")).withColumn("rb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("r_blocks") - 1)))
    by = ["dim", "rb", "ab"]
    # a null id would turn the ids of its block into doubles
    r = r.select(*by, F.coalesce("vec_id", F.lit(0)).alias("vec_id"), F.col("vec_id").isNull().alias("no_id"), "label", "v", "times")
    return a.drop("r_blocks", "a_blocks").groupBy(*by).cogroup(r.groupBy(*by)).applyInPandas(meet, schema)


FOUND = "anchor_id long, key long, copies long, positive_rank int, positive_id long, positive_score long, vec_id long, score long"


def frame(anchors: pd.DataFrame, windows: list[Windows], block: Block | None, positives: list[list[tuple]]) -> pd.DataFrame:
    out = []
    for i, (own, key, copies) in enumerate(zip(anchors["vec_id"], anchors["key"], anchors["copies"], strict=True)):
        for w, positive in enumerate(positives[i]):
            found = windows[i]
            out += [(own, key, copies, *positive, None if block.no_id[p] else int(block.ids[p]), s) for s, p in zip(found.scores[w].tolist(), found.places[w].tolist(), strict=True)]
    names = [f.split()[0] for f in FOUND.split(", ")]
    return pd.DataFrame(out, columns=names).astype({c: "Int64" for c in names})


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` and ``anchors`` have (vec_id, embedding, label). Negatives have a score between low and
    high percent of that of the positive.
    """
    most = max(positives, negatives)
    r = written(prepared(rows, scale, most), "vectors")
    a = written(prepared(anchors.where("vec_id is not null"), scale, most), "anchors")
    count = lambda df, n, name: df.groupBy("dim").agg(F.ceil(F.count("*") / n).cast("long").alias(name))
    # one row for each length of vectors in use
    sizes = written(count(r, ROWS_PER_BLOCK, "r_blocks").join(count(a, ANCHORS_PER_BLOCK, "a_blocks"), "dim"), "blocks", compact=True)

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        windows = [Windows([-END], [END - 1], positives) for _ in range(len(left))]
        block = Block(right) if len(left) and len(right) else None
        if block:
            block.search(left, True, windows)
        return frame(left, windows, block, [[(None, None, None)]] * len(left))

    order = Window.partitionBy("anchor_id", "key").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    first = met(a, r, sizes, nearest, FOUND).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    opened = first.groupBy("anchor_id", "key").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("opened"))
    opened = written(opened, "positives", compact=True)
    ready = a.join(opened.withColumnRenamed("anchor_id", "vec_id"), ["vec_id", "key"])

    def hardest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        opened = [[(x["rank"], x["vec_id"], int(x["score"])) for x in o] for o in left["opened"]] if len(left) else []
        windows = [Windows([-(-low * s // 100) for _, _, s in o], [high * s // 100 for _, _, s in o], negatives) for o in opened]
        block = Block(right) if len(left) and len(right) else None
        if block:
            block.search(left, False, windows)
        return frame(left, windows, block, opened)

    order = Window.partitionBy("anchor_id", "key", "positive_rank").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    found = met(ready, r, sizes, hardest, FOUND).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    again = found.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return again.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
