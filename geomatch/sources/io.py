"""Readers, writers and checks of the tables the engine works on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geomatch.sources.table import POINTS, VectorTable, check_dim, last_of_each

__all__ = ["POINTS", "VectorTable", "check_dim"]


def upsert(points: DataFrame, batch: DataFrame, seq: str | None = None) -> DataFrame:
    """points with the rows of batch in place of those of the same id; within the batch the last wins,
    by ``seq`` if given, else as the rows stand."""
    batch = last_of_each(batch, seq)
    return points.join(batch.select("id"), "id", "left_anti").unionByName(batch)


def read_flight_csv(spark: SparkSession, path: str) -> DataFrame:
    """file and six numbers; rows with a bad number go, of a file named twice the last row stays.

    Of several files under the path those of a later name count as later. A missing path gives an empty table.
    """
    numbers = ["lat", "lon", "alt", "yaw", "pitch", "roll"]
    schema = "file string, " + ", ".join(f"{c} string" for c in numbers)
    # inside a block the ids only rise with its rows, whichever task reads it
    place = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    try:
        raw = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path).withColumn("_n", place)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raw = spark.createDataFrame([], f"{schema}, _n int")
    rows = raw.select(F.trim("file").alias("file"), *[F.expr(f"try_cast({c} as double)").alias(c) for c in numbers], "_n").dropna(subset=numbers)
    return rows.groupBy("file").agg(F.max_by(F.struct(*numbers), "_n").alias("_l")).select("file", "_l.*")


IMU = "timestamp long, w_x float, w_y float, w_z float, a_x float, a_y float, a_z float"
TRUTH = "timestamp long, p_x float, p_y float, p_z float, q_w float, q_x float, q_y float, q_z float, v_x float, v_y float, v_z float, bg_x float, bg_y float, bg_z float, ba_x float, ba_y float, ba_z float"


def read_strict_csv(spark: SparkSession, path: str, schema: str, stream_id: str = "0") -> DataFrame:
    """Sensor rows with a header; any bad record fails the read."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path).withColumnRenamed("timestamp", "ts_ns").withColumn("stream_id", F.lit(stream_id))


def read_imu_csv(spark: SparkSession, path: str, stream_id: str = "0") -> DataFrame:
    return read_strict_csv(spark, path, IMU, stream_id)


def read_gt_csv(spark: SparkSession, path: str, stream_id: str = "0") -> DataFrame:
    return read_strict_csv(spark, path, TRUTH, stream_id)


def list_assets(spark: SparkSession, path: str, extensions: list[str], ignore_case: bool = False) -> DataFrame:
    """(path, length) of the files with one of the extensions, without reading them."""
    names = "|".join(e.lstrip(".") for e in extensions)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.where(F.col("path").rlike(f"{'(?i)' if ignore_case else ''}\\.({names})$")).orderBy("path")


def validate_rasters(rasters: DataFrame) -> DataFrame:
    """rasters with planar_config filled in and reason, null where the raster can be read."""
    planar = F.coalesce("planar_config", F.lit(1))
    reason = F.when(~F.col("samples_per_pixel").isin(1, 3) | F.col("samples_per_pixel").isNull(), "samples").when(planar == 2, "planar").when(F.col("tile_width").isNull() | F.col("tile_height").isNull(), "untiled")
    return rasters.withColumns({"planar_config": planar, "reason": reason})


def pending_tiles(plan: DataFrame, done: DataFrame) -> DataFrame:
    """Planned tiles (file, ...) whose file is not in done (file)."""
    return plan.join(done.select("file"), "file", "left_anti")


def retry_manifest(results: DataFrame) -> DataFrame:
    """Failures (x, y, z, url_template, output_path, error) of results (…, ok); nothing if all went well."""
    return results.where(~F.col("ok")).select("x", "y", "z", "url_template", "output_path", "error")


def write_retries(results: DataFrame, path: str) -> None:
    retry_manifest(results).write.mode("overwrite").json(path)


def outcome_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("ok").agg(F.count("*").alias("tiles"))


#: What the catalogue's checks allow.
CATEGORIES = ("imagery", "terrain", "3dtiles", "vector")
STATUSES = ("pending", "processing", "ready", "failed")


class Catalog:
    """Resources: required fields, allowed values, and defaults."""

    def __init__(self, df: DataFrame):
        self.df = df

    @staticmethod
    def checked(df: DataFrame, now: Column | None = None, categories=CATEGORIES, statuses=STATUSES) -> DataFrame:
        stamp = F.current_timestamp() if now is None else now
        df = df.withColumns({"status": F.coalesce("status", F.lit("pending")), "extra": F.coalesce("extra", F.lit("{}")), "created_at": F.coalesce("created_at", stamp), "updated_at": F.coalesce("updated_at", stamp)})
        problem = F.when(F.col("name").isNull(), "name").when(F.col("url").isNull(), "url").when(F.col("category").isNull() | ~F.col("category").isin(*categories), "category").when(~F.col("status").isin(*statuses), "status")
        return df.withColumn("problem", problem)

    def insert(self, df: DataFrame) -> Catalog:
        good = self.checked(df).where("problem is null").drop("problem")
        return Catalog(self.df.unionByName(good, allowMissingColumns=True))

    def get(self, resource_id: int) -> DataFrame:
        return self.df.where(F.col("id") == resource_id)

    def by_group(self, name: str) -> DataFrame:
        return self.df.where(F.col("group_name") == name)

    def by_category(self, category: str) -> DataFrame:
        return self.df.where(F.col("category") == category)


def metrics_text(metrics: DataFrame) -> DataFrame:
    """metrics (rank1..rank5) with a line of text."""
    return metrics.withColumn("report", F.format_string(" | ".join(f"Rank-{i}: %.2f%%" for i in range(1, 6)), *[f"rank{i}" for i in range(1, 6)]))


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def calibration_manifest(crops: DataFrame) -> DataFrame:
    """One line for each crop (n, x, y)."""
    return crops.select(F.format_string("crop_%04d_%d_%d.jpg", "n", "y", "x").alias("value"))


def latest_frame(frames: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """The newest frame of each source, of equal times the greatest; see streaming.newest for streams without an end."""
    rest = F.struct(*[c for c in frames.columns if c != key])
    return frames.groupBy(key).agg(F.max_by(rest, F.struct(ts, *[c for c in frames.columns if c not in (key, ts)])).alias("f")).select(key, "f.*")
