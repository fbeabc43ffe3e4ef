"""Windows over grids, scores and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geomatch.operators.segments import with_previous


def best_checkpoints(metrics: DataFrame) -> DataFrame:
    """Epochs whose rank1 is over the best so far, from 0."""
    before = Window.partitionBy("run_id").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    best = F.coalesce(F.max("rank1").over(before), F.lit(0.0))
    return metrics.withColumn("best_before", F.greatest(best, F.lit(0.0))).where(F.col("rank1") > F.col("best_before"))


def with_dt(imu: DataFrame, by: tuple[str, ...] = ("stream_id", "window_id"), segments: bool = False, rows: int | None = None) -> DataFrame:
    """Seconds since the sample before; a window's first sample is only the baseline and goes.

    A long window spreads over tasks; with ``segments`` the columns ``segment`` and ``cuts`` that part it stay.
    """
    out = with_previous(imu, list(by), "ts_ns", F.col("ts_ns"), "_p", rows).where("_p is not null").withColumn("dt", (F.col("ts_ns") - F.col("_p")) * 1e-9).drop("_p")
    return out if segments else out.drop("segment", "cuts")


def step_distance(track: DataFrame, rows: int | None = None) -> DataFrame:
    """Distance from the place before, null for a session's first; a long session spreads over tasks."""
    axes = ("ecef_x", "ecef_y", "ecef_z")
    out = with_previous(track, ["session_id"], "ts_ns", F.struct(*axes), "_p", rows)
    d = sum((F.pow(F.col(c) - F.col(f"_p.{c}"), 2) for c in axes), F.lit(0.0))
    return out.withColumn("step_m", F.sqrt(d)).drop("_p", "segment", "cuts")


def dual_softmax(sim: DataFrame) -> DataFrame:
    """Row softmax times column softmax times both sides' matchability (logits zi, zj)."""

    def soft(own: str):
        w = Window.partitionBy("pair_id", own)
        e = F.exp(F.col("s") - F.max("s").over(w))
        return e, w

    row = sim.withColumns({"_er": F.exp(F.col("s") - F.max("s").over(Window.partitionBy("pair_id", "i")))})
    row = row.withColumn("_pr", F.col("_er") / F.sum("_er").over(Window.partitionBy("pair_id", "i")))
    col = row.withColumn("_ec", F.exp(F.col("s") - F.max("s").over(Window.partitionBy("pair_id", "j"))))
    col = col.withColumn("_pc", F.col("_ec") / F.sum("_ec").over(Window.partitionBy("pair_id", "j")))
    sigmoid = lambda c: 1 / (1 + F.exp(-F.col(c)))
    return col.withColumn("score", F.col("_pr") * F.col("_pc") * sigmoid("zi") * sigmoid("zj")).drop("_er", "_pr", "_ec", "_pc")


def _spread(scores: DataFrame, value: str, r: int, out: str) -> DataFrame:
    along = lambda line, at: Window.partitionBy("img_id", line).orderBy(at).rangeBetween(-r, r)
    return scores.withColumn("_m", F.max(value).over(along("y", "x"))).withColumn(out, F.max("_m").over(along("x", "y"))).drop("_m")


def grid_nms(scores: DataFrame, r: int = 4, rounds: int = 0) -> DataFrame:
    """is_max: the score is the maximum of its square of 2r + 1. Each further round looks for maxima
    among cells away from those found, their neighbours counting as 0."""
    s = _spread(scores, "score", r, "_top").withColumn("is_max", F.col("score") == F.col("_top")).drop("_top")
    for _ in range(rounds):
        s = _spread(s.withColumn("_f", F.col("is_max").cast("int")), "_f", r, "_near")
        s = s.withColumn("_rest", F.when(F.col("_near") > 0, F.lit(0.0)).otherwise(F.col("score")))
        s = _spread(s, "_rest", r, "_top")
        s = s.withColumn("is_max", F.col("is_max") | ((F.col("_rest") == F.col("_top")) & (F.col("_near") == 0))).drop("_f", "_near", "_rest", "_top")
    return s


def topk_keypoints(scores: DataFrame, k: int, r: int = 4, border: int = 4, width: int = 0, height: int = 0) -> DataFrame:
    """k cells an image inside the border: maxima first by score, then others; ties by place."""
    inside = F.col("x").between(border, width - 1 - border) & F.col("y").between(border, height - 1 - border)
    k = min(k, max(0, width - 2 * border) * max(0, height - 2 * border))
    order = Window.partitionBy("img_id").orderBy(F.desc("is_max"), F.desc("score"), "y", "x")
    return grid_nms(scores, r).where(inside).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def order_by_names(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows with their new position: listed names first in that order, the others after, as they stood."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col("name")) if names else F.lit(0)
    order = F.struct(F.when(place > 0, place).otherwise(F.lit(1 << 40)).alias("p"), F.col("position").cast("long").alias("q"))
    return df.withColumn("sort_key", order)
