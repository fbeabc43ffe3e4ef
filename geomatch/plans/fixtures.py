"""Input views of the queries, each from one of the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def view(spark: SparkSession, d: str, table_name: str, select: str, where: str = "true") -> DataFrame:
    return table(spark, d, table_name).where(where).selectExpr(*[x.strip() for x in select.strip().split("\n")])


def points(spark: SparkSession, d: str) -> DataFrame:
    """vec_id as the id; places on a grid of 40 columns, five labels a raster."""
    x, y = (F.col("vec_id") % 40) * 128, F.floor(F.col("vec_id") / 40) * 128
    p = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label", x.cast("long").alias("x"), y.cast("long").alias("y"), F.concat(F.lit("r"), F.floor(F.col("label") / 5).cast("string")).alias("src"))
    return p.withColumns({"lon": 114.594 + F.col("x") * 5e-6, "lat": 37.931 - F.col("y") * 5e-6})


POINTS_SQL = """points as (
    select *, 114.594 + x * cast(5e-6 as double) as lon, 37.931 - y * cast(5e-6 as double) as lat from (
        select vec_id as id, cast(embedding as double[]) as vector, label, cast((vec_id % 40) * 128 as bigint) as x,
            cast((vec_id // 40) * 128 as bigint) as y, 'r' || cast(label // 5 as varchar) as src from embeddings))"""


def queries(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).where("id % 10 = 0")
    return p.withColumnRenamed("id", "query_id")


def rasters(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "part", """
        p_partkey as src
        256 + 64 * p_size as width
        256 + 32 * p_size as height
        case when p_partkey % 11 = 0 then null else 256 end as tile_width
        256 as tile_height
        cast(1 + p_partkey % 4 as int) as samples_per_pixel
        cast(case when p_partkey % 7 = 0 then 2 when p_partkey % 5 = 0 then null else 1 end as int) as planar_config""")


RASTERS_SQL = """rasters as (
    select p_partkey as src, 256 + 64 * p_size as width, 256 + 32 * p_size as height,
        case when p_partkey % 11 = 0 then null else 256 end as tile_width, 256 as tile_height,
        cast(1 + p_partkey % 4 as int) as samples_per_pixel,
        cast(case when p_partkey % 7 = 0 then 2 when p_partkey % 5 = 0 then null else 1 end as int) as planar_config from part)"""


def bboxes(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "nation", """
        n_nationkey as key
        cast(-170 + 13 * n_nationkey as double) as west
        cast(-60 + 4 * n_nationkey as double) as south
        cast(-168 + 13 * n_nationkey as double) as east
        cast(-58 + 4 * n_nationkey as double) as north""")


BBOXES_SQL = """bboxes as (
    select n_nationkey as key, cast(-170 + 13 * n_nationkey as double) as west, cast(-60 + 4 * n_nationkey as double) as south,
        cast(-168 + 13 * n_nationkey as double) as east, cast(-58 + 4 * n_nationkey as double) as north from nation)"""


def metrics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("epoch")).agg(F.max(F.col("l_discount") * 1000).cast("double").alias("rank1"))


METRICS_SQL = "metrics as (select l_orderkey as run_id, l_linenumber as epoch, cast(max(l_discount * 1000) as double) as rank1 from lineitem group by 1, 2)"


def grid(spark: SparkSession, d: str) -> DataFrame:
    """Images of 40 x 25 cells, one event a cell; the last image may be cut."""
    return view(spark, d, "events", """
        event_id div 1000 as img_id
        cast(event_id % 40 as int) as x
        cast((event_id div 40) % 25 as int) as y
        value as score""")


GRID_SQL = "grid as (select event_id // 1000 as img_id, cast(event_id % 40 as int) as x, cast((event_id // 40) % 25 as int) as y, value as score from events)"


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of 100 vectors: the first 50 (i) against the next 50 (j), with their cosine to 6 places."""
    from geomatch.functions.vectors import cosine

    e = table(spark, d, "embeddings").select((F.col("vec_id") / 100).cast("long").alias("pair_id"), (F.col("vec_id") % 100).alias("k"), "embedding")
    a = e.where("k < 50").select("pair_id", F.col("k").alias("i"), F.col("embedding").alias("va"))
    b = e.where("k >= 50").select("pair_id", (F.col("k") - 50).alias("j"), F.col("embedding").alias("vb"))
    return a.join(b, "pair_id").select("pair_id", "i", "j", F.round(cosine(F.col("va"), F.col("vb")), 6).alias("score"))


SCORES_SQL = """scores as (
    select a.vec_id // 100 as pair_id, a.vec_id % 100 as i, b.vec_id % 100 - 50 as j,
        round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 6) as score
    from embeddings a join embeddings b on a.vec_id // 100 = b.vec_id // 100
    where a.vec_id % 100 < 50 and b.vec_id % 100 >= 50)"""


def imu(spark: SparkSession, d: str) -> DataFrame:
    """Samples of a stream (user) 5 ms apart, in the order of its events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0))
    e = table(spark, d, "events").withColumns({"n": F.row_number().over(w), "k": k})
    return e.select(F.col("user_id").alias("stream_id"), (F.lit(5_000_000) * F.col("n")).cast("long").alias("ts_ns"), (F.col("k") / 1000).alias("w_x"), (F.col("value") / 10000).alias("w_y"), F.lit(0.0).alias("w_z"), (F.col("value") / 100).alias("a_x"), (F.col("k") / 100).alias("a_y"), F.lit(9.81).alias("a_z"))


IMU_SQL = """imu as (
    select user_id as stream_id, cast(5000000 * row_number() over (partition by user_id order by ts, event_id) as bigint) as ts_ns,
        coalesce(cast(props->>'$.k' as double), 0) / 1000 as w_x, value / 10000 as w_y, 0.0 as w_z,
        value / 100 as a_x, coalesce(cast(props->>'$.k' as double), 0) / 100 as a_y, 9.81 as a_z from events)"""


def imu_starts(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth sample of a stream begins a window."""
    return imu(spark, d).where("ts_ns % 20000000 = 5000000").select("stream_id", F.col("ts_ns").alias("window_id"), F.col("ts_ns").alias("start_ns"))


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames of a session (user): one observation moving east by k % 10 m, purchases seen 500 m north,
    errors without one, in the order of events."""
    from geomatch.functions.geo import geodetic_to_ecef
    from geomatch.streaming.tracker import POINT

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    e = table(spark, d, "events").withColumn("east", F.sum(k % 10).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lat = 37.9 + F.when(F.col("event_type") == "purchase", 500.0).otherwise(0.0) / 111000
    lon = 114.6 + F.col("east") / (111000 * F.cos(F.radians(F.lit(37.9))))
    e = e.withColumns({"lat": lat, "lon": lon}).withColumn("p", geodetic_to_ecef(F.col("lat"), F.col("lon"), F.lit(0.0)))
    zero = F.lit(0).cast("long")
    point = F.struct((20 + F.col("event_id") % 30).alias("inliers"), zero.alias("pixel_x"), zero.alias("pixel_y"), F.col("p.x").alias("ecef_x"), F.col("p.y").alias("ecef_y"), F.col("p.z").alias("ecef_z"), "lat", "lon", F.lit(0.0).alias("yaw")).cast(POINT)
    error = F.col("event_type") == "error"
    return e.select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.when(error, "error").otherwise("ok").alias("status"), F.when(error, F.array().cast(f"array<{POINT}>")).otherwise(F.array(point)).alias("points"))


def lone_frames(spark: SparkSession, d: str) -> DataFrame:
    """``frames`` with one thing to follow: sign-ups see nothing, errors fail, every other event sees
    it k % 10 m further east than the last one did."""
    w = Window.partitionBy("session_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    from geomatch.functions.geo import geodetic_to_ecef
    from geomatch.streaming.tracker import POINT

    sees = ~F.col("event_type").isin("error", "signup")
    step = F.when(sees, F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)) % 10).otherwise(0)
    e = table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), "event_type", step.alias("step"))
    e = e.withColumn("lon", 114.6 + F.sum("step").over(w) / (111000 * F.cos(F.radians(F.lit(37.9))))).withColumn("p", geodetic_to_ecef(F.lit(37.9), F.col("lon"), F.lit(0.0)))
    zero = F.lit(0).cast("long")
    point = F.struct((20 + F.col("seq") % 30).alias("inliers"), zero.alias("pixel_x"), zero.alias("pixel_y"), F.col("p.x").alias("ecef_x"), F.col("p.y").alias("ecef_y"), F.col("p.z").alias("ecef_z"), F.lit(37.9).alias("lat"), "lon", F.lit(0.0).alias("yaw")).cast(POINT)
    status = F.when(F.col("event_type") == "error", "error").otherwise("ok")
    return e.select("session_id", "ts", "seq", status.alias("status"), F.when(sees, F.array(point)).otherwise(F.array().cast(f"array<{POINT}>")).alias("points"))


#: Frames of ``lone_frames`` with the state of their session's only track: 0 none, 1 initializing, 2
#: tracking, 3 lost. Steps are whole metres, so that a step of 0 hovers and two metres are far enough.
LONE_SQL = """recursive o as (
    select *, row_number() over (partition by user_id order by ts, event_id) as n, sum(step) over (partition by user_id order by ts, event_id rows unbounded preceding) as east from (
        select user_id, ts, event_id, case event_type when 'error' then 'error' when 'signup' then 'none' else 'seen' end as kind,
            case when event_type in ('error', 'signup') then 0 else coalesce(cast(json_extract_string(props, '$.k') as bigint), 0) % 10 end as step from events)),
    f as (
        select distinct user_id, cast(0 as bigint) as n, 0 as state, 0 as health, 0 as hits, 0 as failures, cast(0 as bigint) as span from o
        union all
        select o.user_id, o.n,
            case when kind = 'error' or kind = 'none' and state = 0 then state when kind = 'none' then case when state = 2 then 3 when state = 1 or failures >= 5 or health <= 3 then 0 else state end
                when state = 0 then 1 when state = 3 or state = 1 and hits >= 2 then 2 else state end,
            case when kind = 'error' then health when kind = 'none' then health - 3 when state = 0 then 15 else least(health + 1, 20) end,
            case when kind = 'error' then hits when kind = 'none' then 0 when state = 0 then 1 else hits + 1 end,
            case when kind = 'error' then failures when kind = 'none' then failures + 1 else 0 end,
            cast(case when kind = 'seen' and state = 0 then 0 else span + step end as bigint)
        from f join o on o.user_id = f.user_id and o.n = f.n + 1),
    told as (select o.*, f.state, case when kind = 'error' then 'error' when state = 2 and span >= 2 then 'location' else 'uncertain' end as status from f join o using (user_id, n))"""
