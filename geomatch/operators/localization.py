"""From hits and matches to a frame's observations, and embedding of patches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomatch.functions.geo import apply_homography, pixel_to_map, project_center, to_wgs84
from geomatch.functions.vectors import l2_normalize
from geomatch.operators.grid import drop_nodata, failed_frames, gate_matches, patch_grid
from geomatch.sources.table import VectorTable
from geomatch.streaming.tracker import POINT


def frame_observations(frames: DataFrame, hits: DataFrame, matches: DataFrame, models: DataFrame, least: int = 20) -> DataFrame:
    """One row a frame for the tracker: its observations in rank order, or why there is none.

    frames (session_id, ts, seq, frame_id, width, height), hits (frame_id, tile, rank, lon, lat, x, y,
    res_x, res_y), matches (frame_id, tile), models (frame_id, tile, h, inliers).
    """
    gated = gate_matches(matches, least)
    j = gated.select("frame_id", "tile").join(hits, ["frame_id", "tile"]).join(models, ["frame_id", "tile"]).join(frames.select("frame_id", "width", "height"), "frame_id")
    c = apply_homography(F.col("h"), F.col("width") / 2, F.col("height") / 2)
    at = project_center(F.col("lon"), F.col("lat"), F.col("x"), F.col("y"), F.col("res_x"), F.col("res_y"), c["x"], c["y"], F.col("h"))
    j = j.withColumn("_p", at).where("_p.lat is not null")
    point = F.struct("inliers", "_p.pixel_x", "_p.pixel_y", F.col("_p.ecef.x").alias("ecef_x"), F.col("_p.ecef.y").alias("ecef_y"), F.col("_p.ecef.z").alias("ecef_z"), "_p.lat", "_p.lon", "_p.yaw").cast(POINT)
    points = j.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("rank", point.alias("p")))).alias("s")).select("frame_id", F.transform("s", lambda x: x["p"]).alias("points"))
    failed = failed_frames(frames.select("frame_id"), gated).withColumn("failed", F.lit(True))
    out = frames.join(points, "frame_id", "left").join(failed, "frame_id", "left")
    status = F.when(F.col("failed"), "error").when(F.col("points").isNull(), "uncertain").otherwise("ok")
    return out.select("session_id", "ts", "seq", status.alias("status"), F.coalesce("points", F.array().cast(f"array<{POINT}>")).alias("points"))


#: Patches, which may be large, that a task gets at a time.
PATCHES = 256


def embed(patches: DataFrame, load: Callable[[], Callable[[list], np.ndarray]], dim: int, data: str = "data") -> DataFrame:
    """patches with vector: ``load`` runs once a task and gives a function from a list of patches to rows.

    The function's width must be ``dim``. The data column goes, the rest stays. A task holds PATCHES
    patches at a time; Spark reads that setting of the session when the query runs.
    """
    conf, size = patches.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(size)) <= PATCHES:
        conf.set(size, str(PATCHES))
    keep = [c for c in patches.columns if c != data]
    schema = patches.select(*keep).withColumn("raw", F.array().cast("array<double>")).schema

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in frames:
            v = np.asarray(model(list(pdf[data])), float)
            if len(pdf) and v.shape[1] != dim:
                raise ValueError(f"the model gives {v.shape[1]} numbers, the table holds {dim}")
            yield pdf[keep].assign(raw=list(v.tolist()))

    return patches.mapInPandas(run, schema).withColumn("vector", l2_normalize(F.col("raw"), 1e-6).cast("array<float>")).drop("raw")


def patch_points(patches: DataFrame, crop: int) -> DataFrame:
    """location, id and resolution of patches (src, x, y, a..f, epsg), at the middle of the patch."""
    mid = pixel_to_map(F.col("x") + crop // 2, F.col("y") + crop // 2, *(F.col(c) for c in "abcdef"))
    place = to_wgs84(F.col("epsg"), mid["x"], mid["y"])
    return patches.withColumns({"id": F.concat_ws("_", "src", "x", "y"), "location": F.struct(place["lon"].alias("lon"), place["lat"].alias("lat")), "res": F.array(F.col("a"), -F.col("e"))})


def ingest_plan(rasters: DataFrame, crop: int, overlap: float) -> DataFrame:
    """The points that an ingestion of these rasters writes, without their vectors."""
    return patch_points(patch_grid(rasters, crop, overlap), crop)


def ingest(rasters: DataFrame, pixels: DataFrame, load, dim: int, crop: int, overlap: float) -> DataFrame:
    """Grid, pixels (src, x, y, data), nodata filter, embedding and location in one job."""
    patches = drop_nodata(patch_grid(rasters, crop, overlap).join(pixels, ["src", "x", "y"]))
    return embed(patch_points(patches, crop), load, dim)


def ingest_into(table: VectorTable, rasters: DataFrame, pixels: DataFrame, load, crop: int, overlap: float, writer: str | None = None, number: int | None = None) -> int:
    """``ingest`` into a table of points; returns the table's version that holds them.

    A numbered batch of a writer counts once, however often it is delivered.
    """
    return table.upsert(ingest(rasters, pixels, load, table.dim, crop, overlap), None, writer, number)
