"""Joins by metadata, folder, time, score and place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geomatch.functions.vectors import l2_normalize
from geomatch.operators.segments import cut
from geomatch.sources.shared import written


def attach_metadata(images: DataFrame, metadata: DataFrame) -> DataFrame:
    j = images.join(metadata.select("file", "lon", "lat", "yaw"), "file", "left")
    return j.withColumn("yaw", F.coalesce("yaw", F.lit(0.0)))


def pair_views(assets: DataFrame) -> DataFrame:
    """(pair_id, satellite, drones) of numeric folders in both views; fails if no folder is in both."""
    a = assets.where(F.col("folder").rlike(r"^\d+$")).withColumn("pair_id", F.col("folder").cast("long"))
    sat = a.where("view = 'satellite'").groupBy("pair_id").agg(F.min("path").alias("satellite"))
    drone = a.where("view = 'drone'").groupBy("pair_id").agg(F.sort_array(F.collect_list("path")).alias("drones"))
    pairs = sat.join(drone, "pair_id")
    if pairs.isEmpty():
        raise ValueError("no folder is in both views")
    return pairs


def interval_join(samples: DataFrame, windows: DataFrame, span_ns: int) -> DataFrame:
    """Samples (stream_id, ts_ns, ...) of each window (stream_id, window_id, start_ns), both ends included.

    An equi-join on time bins of one span: a window meets two bins at most.
    """
    w = windows.withColumn("end_ns", F.col("start_ns") + span_ns).withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start_ns") / span_ns), F.floor(F.col("end_ns") / span_ns))))
    s = samples.withColumn("_bin", F.floor(F.col("ts_ns") / span_ns))
    return w.join(s, ["stream_id", "_bin"]).where(F.col("ts_ns").between(F.col("start_ns"), F.col("end_ns"))).drop("_bin")


def asof_forward(windows: DataFrame, truth: DataFrame, offset_ns: int, rows: int | None = None) -> DataFrame:
    """The first truth row at or after start_ns + offset_ns, by one sorted pass over each segment of a stream.

    A window that finds none in its segment takes the first truth of the segments after it; there
    is one such row for each segment, so that one hot stream spreads over tasks.
    """
    t = truth.select("stream_id", F.col("ts_ns").alias("_t"), F.struct(*[c for c in truth.columns if c != "stream_id"]).alias("truth"))
    w = windows.select("stream_id", (F.col("start_ns") + offset_ns).alias("_t"), F.struct(*[c for c in windows.columns if c != "stream_id"]).alias("w"))
    both = t.withColumn("w", F.lit(None).cast(w.schema["w"].dataType)).unionByName(w.withColumn("truth", F.lit(None).cast(t.schema["truth"].dataType)))
    parts, any_cut = cut(both, ["stream_id"], F.col("_t"), rows)
    # from the latest on, the last truth seen; at equal times truth comes first
    order = Window.partitionBy("stream_id", "segment").orderBy(F.desc("_t"), F.col("truth").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = parts.withColumn("truth", F.last("truth", ignorenulls=True).over(order)).where("w is not null")
    if any_cut:
        first = parts.where("cuts > 0").groupBy("stream_id", "segment").agg(F.min_by("truth", F.when(F.col("truth").isNotNull(), F.col("_t"))).alias("_own"))
        later = Window.partitionBy("stream_id").orderBy(F.desc("segment")).rowsBetween(Window.unboundedPreceding, -1)
        after = first.select(F.col("stream_id").alias("_s"), F.col("segment").alias("_g"), F.last("_own", ignorenulls=True).over(later).alias("_after"))
        found = found.join(after, F.col("stream_id").eqNullSafe(F.col("_s")) & (F.col("segment") == F.col("_g")), "left").withColumn("truth", F.coalesce("truth", "_after"))
    return found.select("stream_id", "w.*", "truth")


def mutual_nn(scores: DataFrame, threshold: float) -> DataFrame:
    """(pair_id, i, j, score) where each is the other's best, over the threshold; ties to the lowest index."""
    per = lambda own, other: Window.partitionBy("pair_id", own).orderBy(F.desc("score"), other)
    row = scores.withColumn("_r", F.row_number().over(per("i", "j"))).where("_r = 1")
    column = scores.withColumn("_r", F.row_number().over(per("j", "i"))).where("_r = 1")
    return row.join(column.select("pair_id", "i", "j"), ["pair_id", "i", "j"]).where(F.col("score") > threshold).drop("_r")


def nms_points(points: Column, radius: float = 0.2) -> Column:
    """Points of a frame in order, without those strictly nearer than radius to one kept before."""
    near = lambda a, b: sum(((a[c] - b[c]) * (a[c] - b[c]) for c in ("ecef_x", "ecef_y", "ecef_z")), F.lit(0.0)) < radius * radius
    return F.aggregate(points, F.slice(points, 1, 0), lambda kept, p: F.when(F.exists(kept, lambda o: near(o, p)), kept).otherwise(F.concat(kept, F.array(p))))


def zip_tiles(candidates: DataFrame, crops: DataFrame) -> DataFrame:
    return candidates.join(crops, ["frame_id", "rank"])


def grid_cells(grid: DataFrame, grid_width: int, grid_height: int) -> DataFrame:
    """(img_id, _cell, v00, v10, v01, v11): the vectors at the corners of each cell of a grid (gx, gy, vector).

    Cells are numbered by row from their upper left corner; those of the last column and row end at
    it. A cell that lacks a corner is none.
    """
    # the cells along one axis whose nearer (d = 0) or farther corner a vector is
    along = lambda c, d, n: F.explode(F.array_compact(F.array_distinct(F.array(F.when(F.col(c) >= d, F.col(c) - d), F.when(F.col(c) == n - 1, F.col(c))))))
    inside = grid.where(F.col("gx").between(0, grid_width - 1) & F.col("gy").between(0, grid_height - 1))

    def corner(dx: int, dy: int) -> DataFrame:
        at = inside.select("img_id", along("gx", dx, grid_width).alias("_x0"), "gy", "vector").select("img_id", "_x0", along("gy", dy, grid_height).alias("_y0"), "vector")
        return at.select("img_id", (F.col("_y0") * grid_width + F.col("_x0")).cast("long").alias("_cell"), F.col("vector").alias(f"v{dx}{dy}"))

    return reduce(lambda a, b: a.join(b, ["img_id", "_cell"]), [corner(0, 0), corner(1, 0), corner(0, 1), corner(1, 1)])


def bilinear_sample(grid: DataFrame, points: DataFrame, width: int, height: int, grid_width: int, grid_height: int, eps: float = 1e-6) -> DataFrame:
    """(img_id, point_id, vector): descriptors of a coarse grid (gx, gy, vector) at image points, corners aligned, then normalised.

    A point of which the grid lacks a corner gives no row. Points meet the cells of the grid, which
    are no more than its vectors, so that no vector is dealt for a point.
    """
    gx, gy = F.col("x") / (width - 1) * (grid_width - 1), F.col("y") / (height - 1) * (grid_height - 1)
    p = points.select("img_id", "point_id", F.least(F.greatest(gx, F.lit(0.0)), F.lit(grid_width - 1.0)).alias("_x"), F.least(F.greatest(gy, F.lit(0.0)), F.lit(grid_height - 1.0)).alias("_y"))
    p = p.withColumn("_cell", F.floor("_y") * grid_width + F.floor("_x"))
    # points are dealt even if the cells are few: what a point becomes is much more than what is read of it
    j = p.hint("merge").join(written(grid_cells(grid, grid_width, grid_height), "cells"), ["img_id", "_cell"])
    fx, fy = F.col("_x") - F.floor("_x"), F.col("_y") - F.floor("_y")
    # bound once, as what a lambda holds is worked out for every element
    weights = F.array(F.struct(((1 - fx) * (1 - fy)).alias("v00"), (fx * (1 - fy)).alias("v10"), ((1 - fx) * fy).alias("v01"), (fx * fy).alias("v11")))
    part = lambda w, c, i: F.get(F.col(c), i).cast("double") * w[c]
    total = F.transform(weights, lambda w: F.transform("v00", lambda v, i: v.cast("double") * w["v00"] + part(w, "v10", i) + part(w, "v01", i) + part(w, "v11", i)))[0]
    return j.select("img_id", "point_id", l2_normalize(total, eps).alias("vector"))
