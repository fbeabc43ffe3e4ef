"""Retrieval scores, latency, losses and pooling."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geomatch.functions.geo import apply_homography
from geomatch.functions.vectors import cosine
from geomatch.sources.shared import written

#: Of fit_homography: pairs of a group that models are drawn from.
POOL = 1000
#: Groups of up to FEW pairs are fitted STACK at a time, those of one size together.
FEW, STACK = 64, 256
#: Of mosaic_blocks: pixels of tiles that are held against each other at a time.
ROUND_PIXELS = 1 << 19


def cumulative_hits(first_hit: DataFrame, k: int = 5) -> DataFrame:
    """rank1..rankk in percent from (query_id, first_hit), null where nothing was hit; fails without a query.

    A gallery of fewer than k has no hit beyond its size, so that its last value repeats.
    """
    some = lambda share: F.when(F.count("*") == 0, F.raise_error(F.lit("no queries to evaluate")).cast("double")).otherwise(share)
    return first_hit.agg(*[some(F.round(F.avg(F.when(F.col("first_hit") <= i, 100.0).otherwise(0.0)), 6)).alias(f"rank{i}") for i in range(1, k + 1)], F.count("*").alias("queries"))


def rank_accuracy(hits: DataFrame, query_labels: DataFrame, point_labels: DataFrame, k: int = 5) -> DataFrame:
    """hits (query_id, id, rank), labels (query_id, label) and (id, label): the cumulative match curve."""
    j = query_labels.withColumnRenamed("label", "q_label").join(hits, "query_id", "left").join(point_labels, "id", "left")
    return cumulative_hits(j.groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("q_label"), F.col("rank"))).alias("first_hit")), k)


def align_labels(anchors: DataFrame, labels: DataFrame) -> DataFrame:
    """(i, label): labels repeat in blocks where anchors are a whole multiple of them, else it fails."""
    n, m = anchors.count(), labels.count()
    if not m or n % m:
        raise ValueError(f"{n} anchors do not divide into {m} labels")
    return anchors.withColumn("_k", F.floor(F.col("i") / (n // m))).join(labels.select(F.col("i").alias("_k"), "label"), "_k").drop("_k")


def spatial_hit_rate(hits: DataFrame, truth: DataFrame, crop: float, k: int = 5) -> DataFrame:
    """hits (query_id, rank, src, x, y), truth (query_id, src, x, y): a hit is in the same raster and less than crop away on both axes."""
    t = truth.select("query_id", F.col("src").alias("t_src"), F.col("x").alias("t_x"), F.col("y").alias("t_y"))
    hit = (F.col("src") == F.col("t_src")) & (F.abs(F.col("x") - F.col("t_x")) < crop) & (F.abs(F.col("y") - F.col("t_y")) < crop)
    return cumulative_hits(t.join(hits, "query_id").groupBy("query_id").agg(F.min(F.when(hit, F.col("rank"))).alias("first_hit")), k)


def elements_at(df: DataFrame, column: str, ranks: Sequence[int], few: int = 10_000, buckets: int = 1024) -> dict[int, float]:
    """The elements at these ranks (from 0) in the order of a column: numbers from -infinity to infinity, then NaN.

    Histograms narrow the ranks down among the finite numbers: only counts by bucket leave the tasks,
    and in the end the values about a rank, ``few`` at most. Others are counted apart.
    """
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    finite = ~F.isnan("x") & (F.abs("x") < F.lit(float("inf")))
    some = F.when(finite, F.col("x"))
    lo, hi, below, n, above = x.agg(F.min(some), F.max(some), F.count_if(F.col("x") == F.lit(float("-inf"))), F.count_if(finite), F.count_if(F.col("x") == F.lit(float("inf")))).first()
    x = x.where(finite)
    out = {r: float("-inf") for r in ranks if r < below}
    out |= {r: float("inf") if r < below + n + above else float("nan") for r in ranks if r >= below + n}
    # (least, most, elements before, elements) of the range that holds each rank
    spans = {r: (lo, hi, below, n) for r in ranks if r not in out}
    while open_ := sorted({s for s in spans.values() if s[0] < s[1] and s[3] > few}):
        which, at = F.lit(None), F.lit(None)
        for k, (lo, hi, _, _) in enumerate(open_):
            inside = F.col("x").between(lo, hi)
            # halves, as the whole range may not fit a double; the least and the most never share a bucket
            part = (F.col("x") / 2 - lo / 2) / (hi / 2 - lo / 2) if hi / 2 > lo / 2 else F.when(F.col("x") > lo, 1.0).otherwise(0.0)
            which, at = F.when(inside, k).otherwise(which), F.when(inside, F.least(F.floor(part * buckets), F.lit(buckets - 1))).otherwise(at)
        rows = x.select("x", which.alias("span"), at.alias("at")).where("span is not null").groupBy("span", "at").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).orderBy("span", "at").collect()
        for r, s in list(spans.items()):
            if s in open_:
                before = s[2]
                for b in (b for b in rows if b.span == open_.index(s)):
                    if r < before + b.n:
                        spans[r] = (b.lo, b.hi, before, b.n)
                        break
                    before += b.n
    out |= {r: s[0] for r, s in spans.items() if s[0] == s[1]}
    for s in {s for r, s in spans.items() if r not in out}:
        values = np.sort([r.x for r in x.where(F.col("x").between(s[0], s[1])).collect()])
        out |= {r: float(values[r - s[2]]) for r, own in spans.items() if own == s}
    return out


def latency_report(df: DataFrame, ms: str, method: str = "interpolated") -> DataFrame:
    """mean, p95, p99, qps, n: percentiles between elements, or the element at floor(n p).

    A NaN is the greatest of all and makes the mean one; infinities are values.
    """
    mean, n = F.avg(ms), df.where(F.col(ms).isNotNull()).count()
    p95 = p99 = F.lit(None).cast("double")
    if n:
        at = {p: (n - 1) * p if method == "interpolated" else min(int(np.floor(n * p)), n - 1) for p in (0.95, 0.99)}
        found = elements_at(df, ms, sorted({k for x in at.values() for k in (int(np.floor(x)), int(np.ceil(x)))}))

        def between(p: float) -> Column:
            low, high, part = found[int(np.floor(at[p]))], found[int(np.ceil(at[p]))], at[p] - int(np.floor(at[p]))
            return F.lit(low if low == high or not part else low + (high - low) * part)

        p95, p99 = between(0.95), between(0.99)
    return df.agg(F.round(mean, 6).alias("mean_ms"), F.first(F.round(p95, 6)).alias("p95_ms"), F.first(F.round(p99, 6)).alias("p99_ms"), F.round(F.when(mean > 0, 1000 / mean).otherwise(0.0), 6).alias("qps"), F.count(ms).alias("n"))


def throughput(df: DataFrame, by: list[str], items: Column, ts: str) -> DataFrame:
    seconds = (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 1e6
    return df.groupBy(*by).agg(F.sum(items).alias("items"), F.round(F.when(seconds > 0, F.sum(items) / seconds).otherwise(0.0), 9).alias("items_per_second"))


def similarities(anchors: DataFrame, positives: DataFrame) -> DataFrame:
    """(batch, anchor, other, own, s) of every anchor and positive of a batch; own marks the anchor's own."""
    a = anchors.select("batch", F.col("id").alias("anchor"), F.col("vector").alias("va"))
    p = positives.select("batch", F.col("id").alias("other"), F.col("anchor_id"), F.col("vector").alias("vp"))
    return a.join(p, "batch").select("batch", "anchor", "other", (F.col("anchor_id") == F.col("anchor")).alias("own"), cosine(F.col("va"), F.col("vp")).alias("s"))


def hard_pairs(s: DataFrame, eps: float = 0.1) -> DataFrame:
    """Mined pairs: own positives under the hardest negative plus eps, negatives over the worst own positive less eps."""
    w = Window.partitionBy("batch", "anchor")
    m = s.withColumns({"max_neg": F.max(F.when(~F.col("own"), F.col("s"))).over(w), "min_pos": F.min(F.when(F.col("own"), F.col("s"))).over(w)})
    kept = F.when(F.col("own"), F.col("s") < F.col("max_neg") + eps).otherwise(F.col("s") > F.col("min_pos") - eps)
    return m.withColumn("kept", F.coalesce(kept, F.lit(False)))


def ms_loss(mined: DataFrame, alpha: float = 2.0, beta: float = 50.0, base: float = 0.5, clamp: float = 80.0) -> DataFrame:
    """(batch, loss): the multi-similarity loss over mined pairs, the mean over all anchors."""
    limit = lambda x: F.least(F.greatest(x, F.lit(-clamp)), F.lit(clamp))
    pos = F.sum(F.when(F.col("own") & F.col("kept"), F.exp(limit(-alpha * (F.col("s") - base)))).otherwise(0.0))
    neg = F.sum(F.when(~F.col("own") & F.col("kept"), F.exp(limit(beta * (F.col("s") - base)))).otherwise(0.0))
    each = mined.groupBy("batch", "anchor").agg(pos.alias("pos"), neg.alias("neg"))
    return each.groupBy("batch").agg(F.round(F.avg(F.log1p("pos") / alpha + F.log1p("neg") / beta), 6).alias("loss"))


def smoothed_ce(logits: Column, label: Column, smoothing: float = 0.1) -> Column:
    """Cross entropy of one row of logits with label smoothing over all classes."""
    top = F.array_max(logits)
    log_sum = top + F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    mean = F.aggregate(logits, F.lit(0.0), lambda s, x: s + x) / F.size(logits)
    return (1 - smoothing) * (log_sum - F.get(logits, label)) + smoothing * (log_sum - mean)


def combined_loss(ms: DataFrame, rows: DataFrame | None, smoothing: float = 0.1) -> DataFrame:
    """(batch, loss): the multi-similarity loss, and where logits and labels (batch, logits, label) exist their mean smoothed cross entropy."""
    if rows is None:
        return ms
    ce = rows.where("logits is not null and label is not null").groupBy("batch").agg(F.avg(smoothed_ce(F.col("logits"), F.col("label"), smoothing)).alias("ce"))
    return ms.join(ce, "batch", "left").select("batch", F.round(F.col("loss") + F.coalesce("ce", F.lit(0.0)), 6).alias("loss"))


def gem_pool(df: DataFrame, by: list[str], value: str, p: float = 3.0) -> DataFrame:
    return df.groupBy(*by).agg(F.round(F.pow(F.avg(F.pow(F.greatest(F.col(value), F.lit(1e-6)), F.lit(p))), F.lit(1 / p)), 6).alias("pooled"))


def count_inliers(matches: DataFrame, threshold: float = 10.0) -> DataFrame:
    """(frame_id, tile, inliers): matches (x, y) whose image under h lies less than threshold from (u, v)."""
    at = apply_homography(F.col("h"), F.col("x"), F.col("y"))
    off = F.sqrt(F.pow(at["x"] - F.col("u"), 2) + F.pow(at["y"] - F.col("v"), 2))
    return matches.groupBy("frame_id", "tile").agg(F.count_if(off < threshold).alias("inliers"), F.count("*").alias("matches"))


def solve_homographies(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least squares of the linear equations of point pairs, coordinates centred and scaled first, for a stack of
    models, and which of them exist.

    ``m`` are the sums over the pairs of the products of all two of their monomials, x, y and 1 times u, v and 1.
    """

    def scaled(first: int, second: int) -> np.ndarray:
        n = m[:, 8, 8, None]
        mid = m[:, [first, second], 8] / n
        square = (m[:, first, first] + m[:, second, second]) / (2 * n[:, 0]) - mid.mean(1) ** 2
        spread = np.maximum(np.sqrt(np.maximum(square, 0.0)), 1e-9)
        s = np.zeros((len(m), 3, 3))
        s[:, 0, 0] = s[:, 1, 1] = 1 / spread
        s[:, :2, 2] = -mid / spread[:, None]
        s[:, 2, 2] = 1
        return s

    s, t = scaled(2, 5), scaled(6, 7)
    both = np.einsum("gij,gkl->gikjl", s, t).reshape(-1, 9, 9)  # monomials of the scaled coordinates
    m = both @ m @ np.swapaxes(both, 1, 2)
    part = lambda k, l: m[:, k::3, l::3]
    a_u, a_v, zero = part(2, 0), part(2, 1), np.zeros((len(m), 3, 3))
    turned = lambda a: np.swapaxes(a, 1, 2)
    normal = np.block([[part(2, 2), zero, -a_u], [zero, part(2, 2), -a_v], [-turned(a_u), -turned(a_v), part(0, 0) + part(1, 1)]])
    h = np.linalg.inv(t) @ np.linalg.eigh(normal)[1][:, :, 0].reshape(-1, 3, 3) @ s
    return over_last(h)


def over_last(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Models with a last number of 1, and which of them exist."""
    ok = np.abs(h[:, 2, 2]) > 1e-12
    return h / np.where(ok, h[:, 2, 2], 1.0)[:, None, None], ok


def moment_sums(x: Column, y: Column, u: Column, v: Column, of: Column) -> list[Column]:
    """Over the pairs that ``of`` is true for: sums of the products of x, y and 1 in twos times 1, u, uu, v and vv."""
    one = F.lit(1.0)
    return [F.sum(F.when(of, a * b * c)) for c in (one, u, u * u, v, v * v) for a, b in ((x, x), (x, y), (x, one), (y, y), (y, one), (one, one))]


def moment_matrix(sums: np.ndarray) -> np.ndarray:
    """The matrix that ``solve_homographies`` takes, from ``moment_sums``; products of u and v, which it does not need, are 0."""
    m = np.zeros((3, 3, 3, 3))  # of x, y, 1 and u, v, 1, twice
    upper = np.triu_indices(3)
    for (j, l), part in zip(((2, 2), (0, 2), (0, 0), (1, 2), (1, 1)), sums.reshape(5, 6), strict=True):
        square = np.zeros((3, 3))
        square[upper] = part
        square.T[upper] = part
        m[:, j, :, l] = m[:, l, :, j] = square
    return m.reshape(9, 9)


def near(h: np.ndarray, src: np.ndarray, dst: np.ndarray, threshold: float) -> np.ndarray:
    """Of one model or a stack of them: which pairs are inliers."""
    p = np.c_[src, np.ones(len(src))] @ np.swapaxes(h, -1, -2)
    with np.errstate(all="ignore"):
        off = p[..., :2] / p[..., 2:] - dst
        return np.hypot(off[..., 0], off[..., 1]) < threshold


def exact_homographies(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Models through 4 pairs each, for a stack of quadruples, and which of them exist."""
    n = len(src)
    x, y, u, v = src[..., 0], src[..., 1], dst[..., 0], dst[..., 1]
    zero, one = np.zeros_like(x), np.ones_like(x)
    a = np.concatenate([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y], -1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y], -1)], 1)
    ok = np.abs(np.linalg.det(a)) > 1e-9
    a[~ok] = np.eye(8)
    h = np.linalg.solve(a, np.concatenate([u, v], 1)[..., None])[..., 0]
    return np.c_[h, np.ones(n)].reshape(n, 3, 3), ok & np.isfinite(h).all(1)


def ransac(src: np.ndarray, dst: np.ndarray, threshold: float, trials: int, rng: np.random.Generator, ranked: bool = False, sure: float = 0.999) -> tuple[np.ndarray | None, int, int]:
    """(best model through 4 pairs, its inliers, trials made); of equal models the first.

    With ``ranked`` pairs stand best first, and quadruples come from the first few, of which there are
    more with every batch of trials. A model is tested on pairs in random order: it stops where
    it can no longer win, or where a sequential test of the inlier share of the best model so far
    against that of a wrong one says so. Trials end when the inlier share makes it sure enough that
    one of them had inliers only.
    """
    n, best, found, made = len(src), 0, None, 0
    if n < 4:
        return None, 0, 0
    order = rng.permutation(n)
    while made < trials:
        batch = min(32, trials - made)
        among = min(n, max(8, -(-n * (made + batch) // trials))) if ranked else n
        pick = np.argpartition(rng.random((batch, among)), min(4, among - 1), axis=1)[:, :4]
        h, ok = exact_homographies(src[pick], dst[pick])
        made += batch
        alive, hits = np.flatnonzero(ok), np.zeros(batch, np.int64)
        # shares of inliers of a right and of a wrong model; 1 in 1000 right ones may stop
        right, wrong, limit = max(best / n, 0.1), 0.02, np.log(1000.0)
        odds, size = np.zeros(batch), 64
        at = 0
        while at < n and len(alive):
            some = order[at : at + size]
            inside = near(h[alive], src[some], dst[some], threshold).sum(-1)
            hits[alive] += inside
            odds[alive] += inside * np.log(wrong / right) + (len(some) - inside) * np.log((1 - wrong) / max(1 - right, 1e-6))
            at += len(some)
            size *= 2
            if at < n:
                alive = alive[(hits[alive] + n - at > best) & (odds[alive] < limit)]
        if len(alive) and hits[alive].max() > best:
            k = alive[np.argmax(hits[alive])]
            best, found = int(hits[k]), h[k]
        if best == n or best >= 4 and made >= np.log(1 - sure) / np.log(max(1 - (best / n) ** 4, 1e-12)):
            break
    return found, best, made


def inside(h: np.ndarray, src: np.ndarray, dst: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs (group, pair) are inliers of each of their group's models (group, model)."""
    h, (x, y), (u, v) = h[..., None], (src[:, None, :, k] for k in (0, 1)), (dst[:, None, :, k] for k in (0, 1))
    with np.errstate(all="ignore"):
        w = h[:, :, 2, 0] * x + h[:, :, 2, 1] * y + h[:, :, 2, 2]
        return np.hypot((h[:, :, 0, 0] * x + h[:, :, 0, 1] * y + h[:, :, 0, 2]) / w - u, (h[:, :, 1, 0] * x + h[:, :, 1, 1] * y + h[:, :, 1, 2]) / w - v) < threshold


def ransac_stacked(src: np.ndarray, dst: np.ndarray, threshold: float, trials: int, rngs: list[np.random.Generator], ranked: bool = False, sure: float = 0.999) -> tuple[np.ndarray, np.ndarray]:
    """``ransac`` of groups of one size, of 4 to FEW pairs: (best models, their inliers), with the same draws.

    So few pairs are tested in one step, so that no test stops early.
    """
    groups, n = src.shape[:2]
    best, found, made = np.zeros(groups, np.int64), np.zeros((groups, 3, 3)), 0
    for rng in rngs:
        rng.permutation(n)  # the order of tests, which counts for larger groups only
    going = np.arange(groups)
    while made < trials and len(going):
        batch = min(32, trials - made)
        among = min(n, max(8, -(-n * (made + batch) // trials))) if ranked else n
        draws = np.stack([rngs[g].random((batch, among)) for g in going])
        pick = np.argpartition(draws, min(4, among - 1), axis=2)[..., :4]
        made += batch
        at = going[:, None, None], pick
        h, ok = exact_homographies(src[at].reshape(-1, 4, 2), dst[at].reshape(-1, 4, 2))
        h = h.reshape(-1, batch, 3, 3)
        hits = np.where(ok.reshape(-1, batch), inside(h, src[going], dst[going], threshold).sum(-1), -1)
        k = hits.argmax(1)
        top = hits.max(1)
        better = top > best[going]
        best[going[better]] = top[better]
        found[going[better]] = h[better, k[better]]
        share = best[going] / n
        with np.errstate(divide="ignore"):
            enough = (best[going] >= 4) & (made >= np.log(1 - sure) / np.log(np.maximum(1 - share**4, 1e-12)))
        going = going[~(enough | (best[going] == n))]
    return found, best


def refitted(h: np.ndarray, src: np.ndarray, dst: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least-squares models of the inliers of models, for groups of one size: (models, their inliers, which exist)."""
    hit = inside(h[:, None], src, dst, threshold)[:, 0]
    a, b = src.mean(1, keepdims=True), dst.mean(1, keepdims=True)
    one = np.ones((*hit.shape, 1))
    x, u = np.concatenate([src - a, one], -1), np.concatenate([dst - b, one], -1)
    each = np.where(hit[..., None], (x[..., :, None] * u[..., None, :]).reshape(*hit.shape, 9), 0.0)
    h, ok = solve_homographies(np.swapaxes(each, 1, 2) @ each)
    to, back = np.zeros_like(h) + np.eye(3), np.zeros_like(h) + np.eye(3)
    to[:, :2, 2], back[:, :2, 2] = -a[:, 0], b[:, 0]
    h, exists = over_last(back @ h @ to)
    return h, inside(h[:, None], src, dst, threshold)[:, 0].sum(-1), ok & exists


def fit_homography(matches: DataFrame, threshold: float = 10.0, trials: int = 200, seed: int = 0, quality: str | None = None) -> DataFrame:
    """(frame_id, tile, h, inliers) by seeded RANSAC; groups of under 4 pairs, or without a model, are left out.

    The model of a group comes from its POOL pairs of lowest hash (see ``ransac``), or with ``quality``,
    a column of which more is better, of highest quality first. It then meets all pairs of the group: at
    once where the pool holds them all, else where they are, and only sums of its inliers meet. These give
    the least-squares model. Pairs with
    a null or non-finite coordinate count for nothing.
    """
    # null names are names too; joins are by text
    by, own = ["_f", "_t"], ["frame_id", "tile"]
    names = [F.to_json(F.struct(F.col(c).alias("k")), {"ignoreNullFields": "false"}).alias(a) for c, a in zip(own, by, strict=True)]
    pairs = matches.select(*own, *[F.col(c).cast("double").alias(c) for c in "xyuv"], (F.col(quality).cast("double") if quality else F.lit(0.0)).alias("_q"))
    pairs = pairs.where(" and ".join(f"abs({c}) < double('infinity')" for c in "xyuv"))
    drawn_by = [F.desc_nulls_last("_q"), F.xxhash64(F.lit(seed), *"xyuv"), *map(F.col, "xyuv")]
    # one pair more says that there are more
    pool = pairs.withColumn("_n", F.row_number().over(Window.partitionBy(*own).orderBy(*drawn_by))).where(F.col("_n") <= POOL + 1)
    # one row a group, of POOL pairs at most; its pairs are where the window has them
    pair = F.when(F.col("_n") <= POOL, F.struct("_n", *"xyuv"))
    pool = pool.groupBy(*own).agg((F.max("_n") <= POOL).alias("_whole"), F.array_sort(F.collect_list(pair)).alias("_p"))
    pool = pool.where(F.size("_p") >= 4).select(*own, *names, "_whole", *[F.col("_p")[c].alias(c) for c in "xyuv"])

    def draw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.cumsum([0, *pc.list_value_length(b.column("x")).to_numpy()])
            sizes, x, y, u, v = np.diff(ends), *(b.column(c).flatten().to_numpy() for c in "xyuv")
            keys = [[zlib.crc32(k.encode()) for k in b.column(c).to_pylist()] for c in by]
            whole = b.column("_whole").to_numpy(zero_copy_only=False)
            models, inliers, is_model = np.zeros((b.num_rows, 3, 3)), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, bool)
            middles = np.zeros((b.num_rows, 4))
            for n in np.unique(sizes):
                same = np.flatnonzero(sizes == n)
                # groups of one size together, in blocks of bounded memory
                block = STACK if n <= FEW else 1
                for i in (same[k : k + block] for k in range(0, len(same), block)):
                    at = ends[i][:, None] + np.arange(n)
                    src, dst = np.stack([x[at], y[at]], -1), np.stack([u[at], v[at]], -1)
                    rngs = [np.random.default_rng([seed, keys[0][k], keys[1][k]]) for k in i]
                    if n <= FEW:
                        h, some = ransac_stacked(src, dst, threshold, trials, rngs, quality is not None)
                    else:
                        one, found, _ = ransac(src[0], dst[0], threshold, trials, rngs[0], quality is not None)
                        h, some = np.zeros((1, 3, 3)) if one is None else one[None], np.array([found])
                    good, rest = i[some >= 4], some >= 4
                    is_model[good], models[good] = True, h[rest]
                    middles[good] = np.concatenate([src[rest].mean(1), dst[rest].mean(1)], 1)
                    full = whole[good]
                    if full.any():
                        models[good[full]], inliers[good[full]], is_model[good[full]] = refitted(h[rest][full], src[rest][full], dst[rest][full], threshold)
            which = np.flatnonzero(is_model)
            numbers = (pa.array(list(a[which]), pa.list_(pa.float64())) for a in (models.reshape(-1, 9), middles))
            counts = pa.array(inliers[which], pa.int64(), mask=~whole[which])
            some = b.select([*own, *by]).take(pa.array(which))
            yield pa.RecordBatch.from_arrays([*some.columns, *numbers, counts], [*own, *by, "h", "middle", "inliers"])

    no = F.array().cast("array<double>")
    # written, as drawing is dear; of a whole group the result is there
    drawn = written(pool.mapInArrow(draw, pool.select(*own, *by, no.alias("h"), no.alias("middle"), F.lit(None).cast("long").alias("inliers")).schema), "models")
    whole = drawn.where("inliers is not null").select(*own, "h", "inliers")
    # of the others the next join asks for their size
    model = written(drawn.where("inliers is null").drop("inliers"), "large")
    if model.isEmpty():
        return whole

    def hit(h: Column) -> Column:
        w = h[6] * F.col("x") + h[7] * F.col("y") + h[8]
        off = [F.try_divide(h[k] * F.col("x") + h[k + 1] * F.col("y") + h[k + 2], w) - F.col(c) for k, c in ((0, "u"), (3, "v"))]
        return F.coalesce(F.hypot(*off) < threshold, F.lit(False))

    places = pairs.select(*names, *"xyuv")
    centred = [F.col(c) - F.col("middle")[k] for k, c in enumerate("xyuv")]
    sums = places.join(model, by).groupBy(*by).agg(*[F.any_value(c).alias(c) for c in (*own, "middle")], F.array(*moment_sums(*centred, hit(F.col("h")))).alias("m"))

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs: list[np.ndarray | None] = []
            for m, (x, y, u, v) in zip(b.column("m").to_pylist(), b.column("middle").to_pylist(), strict=True):
                h, ok = np.zeros((1, 3, 3)), np.array([False])
                if None not in m:
                    h, ok = solve_homographies(moment_matrix(np.array(m))[None])
                    h, exists = over_last(np.array([[1, 0, u], [0, 1, v], [0, 0, 1]]) @ h @ np.array([[1, 0, -x], [0, 1, -y], [0, 0, 1]]))
                    ok &= exists
                hs.append(h.ravel() if ok[0] else None)
            yield pa.RecordBatch.from_arrays([*b.select([*own, *by]).columns, pa.array(hs, pa.list_(pa.float64()))], [*own, *by, "h"])

    solved = sums.mapInArrow(solve, sums.select(*own, *by, no.alias("h")).schema).where("h is not null")
    large = places.join(solved, by).groupBy(*by).agg(*[F.any_value(c).alias(c) for c in (*own, "h")], F.count_if(hit(F.col("h"))).alias("inliers")).select(*own, "h", "inliers")
    return whole.unionByName(large)


def epoch_summary(steps: DataFrame) -> DataFrame:
    return steps.groupBy("run_id", "epoch").agg(F.round(F.avg("loss"), 6).alias("train_loss"), F.count("*").alias("steps"))


def mosaic_plan(tiles: DataFrame, by: Sequence[str] = ("z",)) -> DataFrame:
    """Offsets of tiles (west, south, east, north, width, height) in the mosaic of their group, and its size."""
    # bounds are sums by group that join back, so that a mosaic's tiles need not meet in one task
    bounds = tiles.groupBy(*by).agg(F.min("west").alias("_w"), F.max("north").alias("_n"), F.max("east").alias("_e"), F.min("south").alias("_s"))
    rx, ry = (F.col("east") - F.col("west")) / F.col("width"), (F.col("north") - F.col("south")) / F.col("height")
    return tiles.join(bounds, list(by)).withColumns({
        "off_x": F.round((F.col("west") - F.col("_w")) / rx).cast("long"), "off_y": F.round((F.col("_n") - F.col("north")) / ry).cast("long"),
        "mosaic_width": F.round((F.col("_e") - F.col("_w")) / rx).cast("long"), "mosaic_height": F.round((F.col("_n") - F.col("_s")) / ry).cast("long"),
    }).drop("_w", "_n", "_e", "_s")


def mosaic_pixels(blocks: DataFrame) -> DataFrame:
    """(x, y, value): the first value other than 0 in file-name order, 0 if there is none."""
    first = F.min(F.when(F.col("value") != 0, F.struct("file", "value")))
    return blocks.groupBy("x", "y").agg(F.coalesce(first["value"], F.lit(0)).alias("value"))


def first_of(place: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whichever of ``own`` come first at any place."""
    span = int(place.max()) + 1
    if span > 4 * len(place):
        return np.unique(own[np.unique(place, return_index=True)[1]])
    at = np.full(span, -1, np.int64)
    at[place[::-1]] = own[::-1]
    return np.unique(at[at >= 0])


def rounds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of tiles (data) put together or cut to about ROUND_PIXELS pixels, one tile at least."""
    held, pixels = [], 0
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch["data"]), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(sizes):
            many = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), ROUND_PIXELS - pixels, "right")))
            held.append(batch.slice(at, many))
            pixels, at = pixels + int(sizes[at : at + many].sum()), at + many
            if pixels >= ROUND_PIXELS or at < len(sizes):
                yield pa.Table.from_batches(held)
                held, pixels = [], 0
    if held:
        yield pa.Table.from_batches(held)


def seen(batches: Iterable[pa.RecordBatch], by: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Tiles without those that no pixel of a mosaic can come from, as others of their round lie over it.

    At each pixel the first tile in order of files with a value other than 0 there stays, any if there
    is none, so every pixel that was covered still is.
    """
    for t in rounds(batches):
        number = lambda c: t[c].to_numpy().astype(np.int64)
        width, height, size = number("width"), number("height"), pc.fill_null(pc.list_value_length(t["data"]), -1).to_numpy().astype(np.int64)
        odd = size != width * height
        order = pc.sort_indices(t["file"], null_placement="at_start").to_numpy().astype(np.int64)
        order = order[~odd[order]]
        if len(order):
            group = np.zeros(len(order), np.int64)
            some = t.select([*by, "off_x", "off_y", "width", "data"]).take(order)
            for c in by:
                own = pc.dictionary_encode(some[c].combine_chunks(), null_encoding="encode").indices.to_numpy().astype(np.int64)
                group = np.unique(group * (own.max() + 1) + own, return_inverse=True)[1]
            size, width = size[order], width[order]
            tile = np.repeat(np.arange(len(order)), size)
            k = np.arange(len(tile)) - np.repeat(np.cumsum(size) - size, size)
            x, y = (some[c].to_numpy().astype(np.int64) for c in ("off_x", "off_y"))
            x, y = (x - x.min())[tile] + k % width[tile], (y - y.min())[tile] + k // width[tile]
            if (int(group.max()) + 1) * (int(y.max()) + 1) * (int(x.max()) + 1) < 1 << 63:
                place = (group[tile] * (y.max() + 1) + y) * (x.max() + 1) + x
                value = some["data"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
                empty = np.argsort(value == 0, kind="stable")
                order = order[first_of(place[empty], tile[empty])]
        yield from t.take(np.sort(np.concatenate([order, np.flatnonzero(odd)]))).to_batches(max_chunksize=10_000)


def mosaic_blocks(tiles: DataFrame, by: Sequence[str] = ("z",), block: int = 256) -> DataFrame:
    """(*by, block_x, block_y, data): blocks of a mosaic, row by row; each pixel is the first value other
    than 0 in file-name order, 0 if there is none.

    ``tiles`` (*by, file, off_x, off_y, width, height, data) lie in their mosaic, see ``mosaic_plan``; data
    holds their rows. Tiles that others of their task hide go first, see ``seen``; the rest are cut along
    the blocks' borders, so rows are as many as tiles and borders, not pixels. The pieces of a block
    pass in order of their files, with one block in memory: first in ranges of files, then what each
    range left of the block.
    """
    c = F.col
    cells = lambda off, size: F.sequence(F.floor(c(off) / block), F.floor((c(off) + c(size) - 1) / block))
    p = tiles.where("width > 0 and height > 0 and off_x is not null and off_y is not null").select(*by, "file", *[c(k).cast("long").alias(k) for k in ("off_x", "off_y", "width", "height")], "data")
    p = p.mapInArrow(lambda batches: seen(batches, list(by)), p.schema).withColumn("block_x", F.explode(cells("off_x", "width"))).withColumn("block_y", F.explode(cells("off_y", "height")))
    # the piece inside the tile, from its first column and row to before its last
    p = p.withColumns({"x0": F.greatest(c("block_x") * block - c("off_x"), F.lit(0)), "x1": F.least((c("block_x") + 1) * block - c("off_x"), c("width"))})
    p = p.withColumns({"y0": F.greatest(c("block_y") * block - c("off_y"), F.lit(0)), "y1": F.least((c("block_y") + 1) * block - c("off_y"), c("height"))})
    rows = F.transform(F.sequence(c("y0"), c("y1") - 1), lambda y: F.slice("data", (y * c("width") + c("x0") + 1).cast("int"), (c("x1") - c("x0")).cast("int")))
    place = {"left": c("off_x") + c("x0") - c("block_x") * block, "top": c("off_y") + c("y0") - c("block_y") * block, "wide": c("x1") - c("x0")}
    keys = [*by, "block_x", "block_y"]
    p = p.select(*keys, "file", *[v.cast("int").alias(k) for k, v in place.items()], F.flatten(rows).alias("piece"))
    columns = [*keys, "left", "top", "wide", "piece"]
    # ranges of files, so that a block of many tiles spreads over tasks; equal files stay together
    dealt = p.repartitionByRange(*keys, "file").sortWithinPartitions(*keys, "file").select(*columns)
    schema = dealt.select(*keys, c("piece").alias("data")).schema

    def canvases(frames: Iterable[pd.DataFrame]) -> Iterator[tuple[tuple, np.ndarray]]:
        key: tuple | None = None
        canvas = np.zeros((block, block))
        for pdf in frames:
            for *own, left, top, wide, piece in pdf.astype(object).itertuples(index=False, name=None):
                if tuple(own) != key:
                    if key is not None:
                        yield key, canvas
                    key, canvas = tuple(own), np.zeros((block, block), np.asarray(piece).dtype)
                piece = np.asarray(piece).reshape(-1, wide)
                under = canvas[top : top + len(piece), left : left + wide]
                under[under == 0] = piece[under == 0]
        if key is not None:
            yield key, canvas

    def lines(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, canvas in canvases(frames):
            yield pd.DataFrame([(*key, 0, y, block, line) for y, line in enumerate(canvas)], columns=columns)

    def whole(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, canvas in canvases(frames):
            yield pd.DataFrame([(*key, canvas.ravel())], columns=schema.names)

    # a canvas for each block and range, as pieces of one line; numbers of ranges are in the order of files
    part = dealt.mapInPandas(lines, dealt.schema).withColumn("_part", F.spark_partition_id())
    return part.repartition(*keys).sortWithinPartitions(*keys, "_part").select(*columns).mapInPandas(whole, schema)
