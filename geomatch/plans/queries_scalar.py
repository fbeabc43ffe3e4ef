"""Registered queries of column functions and of tables' checks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomatch.functions import geo, tiles, urls, vectors
from geomatch.plans import fixtures as fx
from geomatch.sources import io, table
from geomatch.sources.shared import scratch
from geomatch.streaming import newest

Q: dict = {}
SQL: dict = {}
PI2R = repr(2 * math.pi * 6378137.0)
PIR = repr(math.pi * 6378137.0)


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


r6 = lambda c, name: F.round(c, 6).alias(name)


@query(f"select l_orderkey, l_linenumber, cast(round_even(log2({PI2R} / 256 / (l_quantity / 10)), 0) as integer) as zoom from lineitem")
def f1_zoom(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", tiles.zoom_for_resolution(F.col("l_quantity") / 10).alias("zoom"))


@query(f"""select l_orderkey, l_linenumber, round(l_partkey * s - h, 6) as west, round(h - (l_suppkey + 1) * s, 6) as south,
    round((l_partkey + 1) * s - h, 6) as east, round(h - l_suppkey * s, 6) as north
    from (select *, {PI2R} / 262144 as s, {PIR} as h from lineitem)""")
def f2_tile_bounds(spark: SparkSession, d: str) -> DataFrame:
    b = tiles.tile_bounds(F.lit(18), F.col("l_partkey"), F.col("l_suppkey"))
    return fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[r6(b[c], c) for c in ("west", "south", "east", "north")])


@query("""select distinct '18_' || l_partkey || '_' || l_suppkey || '.tif' as file,
    'https://tiles.example/18/' || l_partkey || '/' || l_suppkey || '.png' as url from lineitem""")
def f3_tile_names(spark: SparkSession, d: str) -> DataFrame:
    args = (F.lit(18), F.col("l_partkey"), F.col("l_suppkey"))
    return fx.table(spark, d, "lineitem").select(tiles.tile_name(*args).alias("file"), tiles.tile_url("https://tiles.example/{z}/{x}/{y}.png", *args).alias("url")).distinct()


AFFINE = (0.5, 0.1, 1000.0, -0.1, -0.5, 2000.0)


@query("""select o_orderkey, round(0.5 * x + 0.1 * y + 1000, 6) as map_x, round(-0.1 * x - 0.5 * y + 2000, 6) as map_y
    from (select o_orderkey, cast(o_orderkey % 700 as double) + 0.5 as x, cast(o_custkey % 500 as double) + 0.5 as y from orders)""")
def f4_pixel_to_map(spark: SparkSession, d: str) -> DataFrame:
    p = geo.pixel_to_map(F.col("o_orderkey") % 700, F.col("o_custkey") % 500, *map(F.lit, AFFINE))
    return fx.table(spark, d, "orders").select("o_orderkey", r6(p["x"], "map_x"), r6(p["y"], "map_y"))


@query("""select o_orderkey, cast(floor((-0.5 * x - 0.1 * y) / det) as bigint) as col, cast(floor((0.5 * y + 0.1 * x) / det) as bigint) as row
    from (select o_orderkey, cast(o_totalprice as double) - 1000.0 as x, cast(o_custkey as double) - 2000.0 as y, cast(-0.24 as double) as det from orders)""")
def f5_map_to_pixel(spark: SparkSession, d: str) -> DataFrame:
    p = geo.map_to_pixel(F.col("o_totalprice"), F.col("o_custkey").cast("double"), *map(F.lit, AFFINE))
    return fx.table(spark, d, "orders").select("o_orderkey", p["col"].alias("col"), p["row"].alias("row"))


@query(f"""with {fx.POINTS_SQL}, e as (select *, case id % 3 when 0 then 4326 when 1 then 3857 else 2154 end as epsg from points)
    select id, case epsg when 4326 then round(lon, 6) when 3857 then round(radians(lon) * 6378137, 4) end as x,
    case epsg when 4326 then round(lat, 6) when 3857 then round(6378137 * ln(tan(pi() / 4 + radians(lat) / 2)), 4) end as y,
    case when epsg = 2154 then 'unsupported EPSG:2154' end as reason from e""")
def f6_from_wgs84(spark: SparkSession, d: str) -> DataFrame:
    epsg = F.element_at(F.array(F.lit(4326), F.lit(3857), F.lit(2154)), (F.col("id") % 3 + 1).cast("int"))
    p = geo.from_wgs84(epsg, F.col("lon"), F.col("lat"))
    digits = lambda c: F.when(epsg == 4326, F.round(c, 6)).otherwise(F.round(c, 4))
    return fx.points(spark, d).select("id", digits(p["x"]).alias("x"), digits(p["y"]).alias("y"), p["reason"].alias("reason"))


@query(f"""with {fx.POINTS_SQL} select id, round(degrees(x * 1000.0 / 6378137), 6) as lon,
    round(degrees(2 * atan(exp(y * 1000.0 / 6378137)) - pi() / 2), 6) as lat from points""")
def f6_to_wgs84(spark: SparkSession, d: str) -> DataFrame:
    p = geo.to_wgs84(F.lit(3857), F.col("x") * 1000.0, F.col("y") * 1000.0)
    return fx.points(spark, d).select("id", r6(p["lon"], "lon"), r6(p["lat"], "lat"))


@query(f"""with {fx.BBOXES_SQL} select key, cast(case when south + 1 >= 0 then 32600 else 32700 end + least(floor((west + 1 + 180) / 6), 59) + 1 as integer) as epsg from bboxes""")
def f7_utm_zone(spark: SparkSession, d: str) -> DataFrame:
    return fx.bboxes(spark, d).select("key", geo.utm_epsg(F.col("west") + 1, F.col("south") + 1).alias("epsg"))


@query(f"""with {fx.RASTERS_SQL} select src, cast(round_even(width * 0.5 / 0.3, 0) as integer) as width, cast(round_even(height * 0.5 / 0.4, 0) as integer) as height from rasters""")
def f8_resample_plan(spark: SparkSession, d: str) -> DataFrame:
    size = geo.resample_size(F.lit(0.0), F.lit(0.0), F.col("width") * 0.5, F.col("height") * 0.5, F.lit(0.3), F.lit(0.4))
    return fx.rasters(spark, d).select("src", size["width"].alias("width"), size["height"].alias("height"))


ECEF_SQL = """{p}_n as (select *, 6378137.0 / sqrt(1 - e2 * sin(radians(lat)) * sin(radians(lat))) as n
        from (select *, cast(0.0066943799901413165 as double) as e2 from {p})),
    {p}_ecef as (select *, (n + alt) * cos(radians(lat)) * cos(radians(lon)) as ex, (n + alt) * cos(radians(lat)) * sin(radians(lon)) as ey,
        (n * (1 - e2) + alt) * sin(radians(lat)) as ez from {p}_n)"""


@query(f"with {fx.POINTS_SQL}, g as (select id, lon, lat, cast(label * 10 as double) as alt from points), {ECEF_SQL.format(p='g')} select id, round(ex, 4) as x, round(ey, 4) as y, round(ez, 4) as z from g_ecef")
def f9_geodetic_to_ecef(spark: SparkSession, d: str) -> DataFrame:
    p = geo.geodetic_to_ecef(F.col("lat"), F.col("lon"), F.col("label") * 10.0)
    return fx.points(spark, d).select("id", *[F.round(p[c], 4).alias(c) for c in "xyz"])


@query(f"""with {fx.POINTS_SQL}, g as (select id, lon, lat, cast(label * 10 as double) as alt from points), {ECEF_SQL.format(p='g')},
    o as (select cast(114.6 as double) as lon, cast(37.93 as double) as lat, cast(0 as double) as alt), {ECEF_SQL.format(p='o')},
    j as (select id, g.ex - o.ex as dx, g.ey - o.ey as dy, g.ez - o.ez as dz, o.ex as ox, o.ey as oy, o.ez as oz,
        sqrt(o.ex * o.ex + o.ey * o.ey) as h, sqrt(o.ex * o.ex + o.ey * o.ey + o.ez * o.ez) as r from g_ecef g, o_ecef o)
    select id, round((ox * dy - oy * dx) / h, 4) as e, round((dz * h - (ox * dx + oy * dy) / h * oz) / r, 4) as n,
        round((ox * dx + oy * dy + oz * dz) / r, 4) as u from j""")
def f10_ecef_to_enu(spark: SparkSession, d: str) -> DataFrame:
    p = geo.geodetic_to_ecef(F.col("lat"), F.col("lon"), F.col("label") * 10.0)
    o = geo.geodetic_to_ecef(F.lit(37.93), F.lit(114.6), F.lit(0.0))
    enu = geo.ecef_to_enu(p, o)
    return fx.points(spark, d).select("id", *[F.round(enu[c], 4).alias(c) for c in "enu"])


@query(f"""with {fx.POINTS_SQL} select id, round(lat - (id % 300 - 50.5) * r / 111000, 9) as lat,
    round(lon + (id % 500 - 20.25) * r / (111000 * cos(radians(lat))), 9) as lon,
    x + greatest(0, cast(trunc(id % 500 - 20.25) as bigint)) as pixel_x, y + greatest(0, cast(trunc(id % 300 - 50.5) as bigint)) as pixel_y,
    round(degrees(atan2(cast(label as double) / 10, 0.9)), 6) as yaw from (select *, case when id % 4 = 0 then 0.5 else 0.25 end as r from points)""")
def f11_project_center(spark: SparkSession, d: str) -> DataFrame:
    res = F.when(F.col("id") % 4 != 0, F.lit(0.25))
    h = F.array(F.lit(0.9), F.lit(0.0), F.lit(0.0), F.col("label") / 10, F.lit(0.9), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    p = geo.project_center(F.col("lon"), F.col("lat"), F.col("x"), F.col("y"), res, res, F.col("id") % 500 - 20.25, F.col("id") % 300 - 50.5, h)
    return fx.points(spark, d).select("id", F.round(p["lat"], 9).alias("lat"), F.round(p["lon"], 9).alias("lon"), p["pixel_x"].alias("pixel_x"), p["pixel_y"].alias("pixel_y"), r6(p["yaw"], "yaw"))


@query(f"""with {fx.POINTS_SQL} select id, round((1.1 * x + 0.2 * y + 3) / nullif(w, 0), 6) as hx, round((0.1 * x + 0.9 * y - 4) / nullif(w, 0), 6) as hy
    from (select id, cast(x as double) as x, cast(y as double) as y, 0.0001 * x + 0.0002 * y + label - 3 as w from points)""")
def f12_apply_homography(spark: SparkSession, d: str) -> DataFrame:
    h = F.array(*map(F.lit, (1.1, 0.2, 3.0, 0.1, 0.9, -4.0, 0.0001, 0.0002)), F.col("label") - 3.0)
    p = geo.apply_homography(h, F.col("x").cast("double"), F.col("y").cast("double"))
    return fx.points(spark, d).select("id", r6(p["x"], "hx"), r6(p["y"], "hy"))


@query(f"""with {fx.POINTS_SQL} select a.id, round(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.label - b.label, 2)) + 10.0 / (a.id % 30 + 1), 6) as cost
    from points a join points b on b.id = a.id + 1""")
def f13_track_cost(spark: SparkSession, d: str) -> DataFrame:
    p = fx.points(spark, d).select("id", F.struct("x", "y", F.col("label").alias("z")).alias("p"))
    j = p.join(p.select((F.col("id") - 1).alias("id"), F.col("p").alias("q")), "id")
    return j.select("id", r6(geo.track_cost(geo.distance3(F.col("p"), F.col("q")), F.col("id") % 30), "cost"))


@query("""select vec_id, round(list_sum([x * x for x in u]), 6) as squares, round(u[1], 6) as first from (
    select vec_id, [x / greatest(sqrt(list_dot_product(v, v)), 1e-6) for x in v] as u from (select vec_id, [cast(x as double) * 3 for x in embedding] as v from embeddings))""")
def f14_l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    u = vectors.l2_normalize(F.transform("embedding", lambda x: x.cast("double") * 3), 1e-6)
    return fx.table(spark, d, "embeddings").select("vec_id", u.alias("u")).select("vec_id", r6(vectors.dot(F.col("u"), F.col("u")), "squares"), r6(F.col("u")[0], "first"))


@query("""select a.vec_id, round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 6) as cosine,
    round(list_dot_product(cast(a.embedding as double[]), cast(b.embedding as double[])), 6) as dot from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def f15_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "embeddings").select("vec_id", "embedding")
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    return j.select("vec_id", r6(vectors.cosine(F.col("embedding"), F.col("other")), "cosine"), r6(vectors.dot(F.col("embedding"), F.col("other")), "dot"))


@query("""select vec_id, round((x1 / s - 0.485) / 0.229, 6) as first, round((x2 / s - 0.456) / 0.224, 6) as second from (
    select vec_id, cast(embedding[1] as double) * f as x1, cast(embedding[2] as double) * f as x2,
        case when list_max(cast(embedding as double[])) * f > 1 then 255.0 else 1.0 end as s from (select *, case when vec_id % 2 = 0 then 255 else 1 end as f from embeddings))""")
def f16_imagenet_normalize(spark: SparkSession, d: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double") * F.when(F.col("vec_id") % 2 == 0, 255).otherwise(1))
    n = vectors.imagenet_normalize(v)
    return fx.table(spark, d, "embeddings").select("vec_id", n.alias("n")).select("vec_id", r6(F.col("n")[0], "first"), r6(F.col("n")[1], "second"))


@query("""select vec_id, cast(list_sum([cast(trunc((x - lo) / (hi - lo) * 255) as integer) for x in v]) as bigint) as total from (
    select vec_id, v, list_min(v) as lo, list_max(v) as hi from (select vec_id, cast(embedding as double[]) as v from embeddings))""")
def f17_minmax_u8(spark: SparkSession, d: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    total = F.aggregate(vectors.minmax_u8(F.col("v")), F.lit(0).cast("long"), lambda s, x: s + x)
    return fx.table(spark, d, "embeddings").select("vec_id", v.alias("v")).select("vec_id", total.alias("total"))


@query(f"""with {fx.POINTS_SQL} select id, round(cos(radians(id % 360 + 0.5)), 6) as h00, round(-sin(radians(id % 360 + 0.5)), 6) as h01,
    round(112 - 112 * cos(radians(id % 360 + 0.5)) + 112 * sin(radians(id % 360 + 0.5)), 6) as h02, 1.0::double as h22 from points""")
def f18_pose_homography(spark: SparkSession, d: str) -> DataFrame:
    h = geo.pose_homography(F.lit(224.0), F.lit(224.0), F.lit(0.0), F.lit(0.0), (F.col("id") % 360) + 0.5, F.lit(60.0))
    return fx.points(spark, d).select("id", h.alias("h")).select("id", r6(F.col("h")[0], "h00"), r6(F.col("h")[1], "h01"), r6(F.col("h")[2], "h02"), r6(F.col("h")[8], "h22"))


@query(f"""with {fx.RASTERS_SQL}, r as (select src, width, height, radians(cast(src % 90 as double) + 0.3) as t from rasters)
    select src, cast(floor(height * abs(sin(t)) + width * abs(cos(t))) as bigint) as rotated_width, cast(floor(height * abs(cos(t)) + width * abs(sin(t))) as bigint) as rotated_height,
    greatest(width - 1024, 0) // 2 as x, greatest(1024 - width, 0) // 2 as left, greatest(1024 - width, 0) - greatest(1024 - width, 0) // 2 as right from r""")
def f19_rotation_and_crop(spark: SparkSession, d: str) -> DataFrame:
    s = geo.rotated_size(F.col("width"), F.col("height"), (F.col("src") % 90) + 0.3)
    c = geo.center_crop_plan(F.col("width"), F.col("height"), F.lit(1024))
    return fx.rasters(spark, d).select("src", s["width"].alias("rotated_width"), s["height"].alias("rotated_height"), c["x"].alias("x"), c["left"].alias("left"), c["right"].alias("right"))


URLS = {0: "url", 1: "url || '?SERVICE=WMS&request=GetMap'", 2: "url || '/{z}/{x}/{y}.png'", 3: "'https://t0.tianditu.gov.cn/' || case when page_id % 12 = 3 then 'DataServer?x={x}' else 'cia_w/wmts?' end || url", 4: "url || '?Request=GetCapabilities'", 5: "url || '/model.KML?PointCloud=1'"}
URL_SQL = "case page_id % 6 " + " ".join(f"when {k} then {v}" for k, v in URLS.items()) + " end"


@query(f"""select page_id, provider, case when provider = 'tianditu-wmts' then case when regexp_extract(u, '/([a-z]+)_w/wmts', 1) <> '' then regexp_extract(u, '/([a-z]+)_w/wmts', 1) else 'img' end end as layer from (
    select page_id, u, case when contains(u, 'tianditu.gov.cn') and contains(u, 'DataServer') then 'tianditu-template' when contains(u, 'tianditu.gov.cn') then 'tianditu-wmts'
        when contains(u, '{{z}}') and contains(u, '{{x}}') and contains(u, '{{y}}') then 'template' when contains(lower(u), 'service=wms') or contains(lower(u), 'request=getmap') then 'wms'
        when contains(lower(u), 'service=wmts') or contains(lower(u), 'request=getcapabilities') then 'wmts' else 'unknown' end as provider from (select page_id, {URL_SQL} as u from pages))""")
def f20_imagery_provider(spark: SparkSession, d: str) -> DataFrame:
    c = urls.classify_imagery(F.col("u"))
    return fx.table(spark, d, "pages").selectExpr("page_id", f"{URL_SQL} as u").select("page_id", c["provider"].alias("provider"), c["layer"].alias("layer"))


@query(f"""select page_id, case when ends_with(split_part(lower(u), '?', 1), '.kml') then 'kml' when ends_with(split_part(lower(u), '?', 1), '.czml') then 'czml' else 'geojson' end as kind,
    contains(lower(u), 'pointcloud') as pointcloud from (select page_id, {URL_SQL} as u from pages)""")
def f21_vector_kind(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "pages").selectExpr("page_id", f"{URL_SQL} as u").select("page_id", urls.classify_vector(F.col("u")).alias("kind"), urls.is_pointcloud(F.col("u")).alias("pointcloud"))


HAVERSINE = "2 * 6371008.8 * asin(sqrt(least(1.0, power(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * power(sin(radians({b}.lon - {a}.lon) / 2), 2))))"


@query(f"with {fx.POINTS_SQL} select a.id, round({HAVERSINE.format(a='a', b='b')}, 4) as meters from points a join points b on b.id = a.id + 7")
def f22_haversine(spark: SparkSession, d: str) -> DataFrame:
    p = fx.points(spark, d).select("id", "lon", "lat")
    j = p.join(p.select((F.col("id") - 7).alias("id"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2")), "id")
    return j.select("id", F.round(geo.haversine(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")), 4).alias("meters"))


# ---- sources and sinks ---------------------------------------------------------------------------


@query("select vec_id as id, len(embedding) = 64 as dim_ok from embeddings")
def s1_vector_dimension(spark: SparkSession, d: str) -> DataFrame:
    return io.check_dim(fx.points(spark, d), 64).select("id", "dim_ok")


@query(f"""with {fx.POINTS_SQL} select id, round(vector[1], 6) as first, label from points where id % 3 <> 0
    union all select id, round(vector[1] * 2, 6), 99 from points where id % 3 = 0
    union all select id + 1000000, round(vector[1] * 2, 6), 99 from points where id % 3 = 0""")
def s2_upsert(spark: SparkSession, d: str) -> DataFrame:
    p = fx.points(spark, d).select("id", F.col("vector")[0].cast("double").alias("first"), F.col("label").cast("int").alias("label"))
    changed = p.where("id % 3 = 0").withColumns({"first": F.col("first") * 2, "label": F.lit(99)})
    old = changed.withColumns({"label": F.lit(1), "seq": F.lit(0)})
    new = changed.withColumn("seq", F.lit(1)).unionByName(changed.withColumns({"id": F.col("id") + 1000000, "seq": F.lit(1)}))
    return io.upsert(p, old.unionByName(new), "seq").select("id", r6(F.col("first"), "first"), "label")


def stored(spark: SparkSession, d: str) -> DataFrame:
    """The points as rows of a vector table."""
    p = fx.points(spark, d)
    return p.select(F.col("id").cast("string").alias("id"), "vector", F.struct("lon", "lat").alias("location"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "src", F.array(F.lit(0.5), F.lit(0.5)).alias("res"))


def filled(spark: SparkSession, d: str) -> table.VectorTable:
    """A table that has seen all points, every third again 128 further on, one batch twice, and every seventh go."""
    t, p = table.VectorTable.create(spark, scratch(spark, "points"), 64), stored(spark, d)
    t.upsert(p, writer="all", number=1)
    moved = p.where("id % 3 = 0").withColumn("x", F.col("x") + 128)
    t.upsert(moved, writer="all", number=2)
    t.upsert(moved.withColumn("x", F.lit(0)), writer="all", number=2)
    t.delete(p.where("id % 7 = 0").select("id"))
    return t


@query(f"with {fx.POINTS_SQL} select cast(id as varchar) as id, case when id % 3 = 0 then x + 128 else x end as x, y, src from points where id % 7 <> 0")
def s2_versions(spark: SparkSession, d: str) -> DataFrame:
    """The newest version, read over its tombstones."""
    return filled(spark, d).read().select("id", "x", "y", "src")


@query(f"""with {fx.POINTS_SQL} select 'compacted' as version, case when id % 3 = 0 then x + 128 else x end as x, count(*) as points from points where id % 7 <> 0 group by 2
    union all select 'first', x, count(*) from points group by 2""")
def s2_compacted(spark: SparkSession, d: str) -> DataFrame:
    """What compaction leaves, and what the first version still holds beside it."""
    t = filled(spark, d)
    t.compact()
    both = t.read().withColumn("version", F.lit("compacted")).unionByName(t.read(1).withColumn("version", F.lit("first")))
    return both.groupBy("version", "x").agg(F.count("*").alias("points"))


@query(f"with {fx.POINTS_SQL} select cast(id as varchar) as id, round({HAVERSINE.format(a='q', b='p')}, 4) as meters from points p, (select lon, lat from points where id = 90) q where {HAVERSINE.format(a='q', b='p')} <= 400")
def s1_geo_index(spark: SparkSession, d: str) -> DataFrame:
    """The points around one place, by the ranges of the curve that files are chosen by."""
    t = table.VectorTable.create(spark, scratch(spark, "points"), 64)
    t.upsert(stored(spark, d))
    at = fx.points(spark, d).where("id = 90").select("lon", "lat").first()
    return t.read_within(at.lon, at.lat, 400.0).select("id", F.round("meters", 4).alias("meters"))


@query("select vec_id as id, label from embeddings order by vec_id limit 100")
def s3_scroll(spark: SparkSession, d: str) -> DataFrame:
    from geomatch.operators.search import scroll

    return scroll(fx.points(spark, d).select("id", "label"), 100)


@query(f"""with {fx.RASTERS_SQL} select src, coalesce(planar_config, 1) as planar_config, case when samples_per_pixel not in (1, 3) then 'samples' when coalesce(planar_config, 1) = 2 then 'planar'
    when tile_width is null or tile_height is null then 'untiled' end as reason from rasters""")
def s7_validate_rasters(spark: SparkSession, d: str) -> DataFrame:
    return io.validate_rasters(fx.rasters(spark, d)).select("src", "planar_config", "reason")


TILE_JOBS = "select distinct l_partkey as x, l_suppkey as y, '18_' || l_partkey || '_' || l_suppkey || '.tif' as file, l_returnflag = 'R' as ok from lineitem"


@query(f"with jobs as ({TILE_JOBS}) select distinct x, y, file from jobs where file not in (select file from jobs where ok)")
def s8_pending_tiles(spark: SparkSession, d: str) -> DataFrame:
    jobs = fx.table(spark, d, "lineitem").select(F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"), tiles.tile_name(F.lit(18), F.col("l_partkey"), F.col("l_suppkey")).alias("file"), (F.col("l_returnflag") == "R").alias("ok"))
    return io.pending_tiles(jobs.select("x", "y", "file").distinct(), jobs.where("ok"))


@query("select l_returnflag = 'R' as ok, count(*) as tiles from lineitem group by 1")
def s8_download_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return io.outcome_counts(fx.table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").alias("ok")))


RESOURCES = {
    "id": "page_id",
    "name": "case when page_id % 13 = 0 then null else 'page ' || page_id end",
    "url": "url",
    "category": "case page_id % 5 when 0 then 'imagery' when 1 then 'terrain' when 2 then '3dtiles' when 3 then 'vector' else 'sound' end",
    "status": "case when page_id % 4 = 0 then null when page_id % 17 = 0 then 'lost' else 'ready' end",
    "group_name": "'g' || (page_id % 7)",
    "extra": "cast(null as {s})",
}
RESOURCES_SQL = "resources as (select " + ", ".join(f"{v} as {k}" for k, v in RESOURCES.items()).format(s="varchar") + " from pages)"
PROBLEM = """case when name is null then 'name' when url is null then 'url' when category not in ('imagery', 'terrain', '3dtiles', 'vector') then 'category'
    when coalesce(status, 'pending') not in ('pending', 'processing', 'ready', 'failed') then 'status' end"""


def resources(spark: SparkSession, d: str) -> DataFrame:
    stamp = {c: F.lit(None).cast("timestamp") for c in ("created_at", "updated_at")}
    return fx.table(spark, d, "pages").selectExpr(*[f"{v.format(s='string')} as {k}" for k, v in RESOURCES.items()]).withColumns(stamp)


@query(f"with {RESOURCES_SQL} select id, coalesce(status, 'pending') as status, '{{}}' as extra, {PROBLEM} as problem from resources")
def s9_catalog_check(spark: SparkSession, d: str) -> DataFrame:
    return io.Catalog.checked(resources(spark, d)).select("id", "status", "extra", "problem")


@query("""select l_orderkey as run_id, l_linenumber as epoch, printf('Rank-1: %.2f%% | Rank-2: %.2f%% | Rank-3: %.2f%% | Rank-4: %.2f%% | Rank-5: %.2f%%',
    q, q + 1, q + 2, q + 3, q + 4) as report from (select distinct l_orderkey, l_linenumber, cast(l_linenumber * 7 as double) as q from lineitem)""")
def s10_metric_report(spark: SparkSession, d: str) -> DataFrame:
    m = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("epoch"), (F.col("l_linenumber") * 7.0).alias("q")).distinct()
    return io.metrics_text(m.select("run_id", "epoch", *[(F.col("q") + i).alias(f"rank{i + 1}") for i in range(5)])).select("run_id", "epoch", "report")


@query("select printf('crop_%04d_%d_%d.jpg', o_orderkey, o_custkey % 500, o_orderkey % 700) as value from orders")
def s11_calibration_manifest(spark: SparkSession, d: str) -> DataFrame:
    return io.calibration_manifest(fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("n"), (F.col("o_orderkey") % 700).alias("x"), (F.col("o_custkey") % 500).alias("y")))


@query("""select 'f' || cast(user_id as varchar) as file, arg_max(value, event_id) as lat, cast(arg_max(event_id, event_id) as double) as lon, 1.5::double as alt, 0.0::double as yaw, -1.0::double as pitch, 1000.0::double as roll
    from events where event_id % 13 <> 0 group by user_id""")
def s4_flight_csv(spark: SparkSession, d: str) -> DataFrame:
    """Events written as flight files in their order: padded names, every thirteenth row with a bad number."""
    e = fx.table(spark, d, "events").orderBy("event_id")
    rows = e.select(F.concat(F.lit(" f"), "user_id", F.lit(" ")).alias("file"), F.col("value").cast("string").alias("lat"), F.when(F.col("event_id") % 13 == 0, "n/a").otherwise(F.col("event_id").cast("string")).alias("lon"), F.lit(" 1.5 ").alias("alt"), F.lit("0").alias("yaw"), F.lit("-1").alias("pitch"), F.lit("1e3").alias("roll"))
    path = scratch(spark, "flights")
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return io.read_flight_csv(spark, path)


@query("""select 's' as stream_id, event_id * 1000 as ts_ns, event_id % 7 / 4.0::double as w_x, 0.5::double as w_y, -0.25::double as w_z, event_id % 3 / 2.0::double as a_x, 0.0::double as a_y, 9.75::double as a_z from events""")
def s5_imu_csv(spark: SparkSession, d: str) -> DataFrame:
    """Events written as sensor rows and read under the strict schema; numbers that single precision holds."""
    numbers = {"w_x": F.col("event_id") % 7 / 4, "w_y": F.lit(0.5), "w_z": F.lit(-0.25), "a_x": F.col("event_id") % 3 / 2, "a_y": F.lit(0.0), "a_z": F.lit(9.75)}
    path = scratch(spark, "sensors")
    fx.table(spark, d, "events").select((F.col("event_id") * 1000).alias("timestamp"), *[v.alias(k) for k, v in numbers.items()]).write.option("header", True).csv(path)
    return io.read_imu_csv(spark, path, "s").select("stream_id", "ts_ns", *[F.col(k).cast("double").alias(k) for k in numbers])


@query("select event_type, 1::bigint as files from events group by event_type")
def s6_list_assets(spark: SparkSession, d: str) -> DataFrame:
    """One file for each type of event, beside files of another extension."""
    e = fx.table(spark, d, "events").repartition("event_type")
    path = scratch(spark, "assets")
    e.write.partitionBy("event_type").csv(f"{path}/tables")
    e.select("event_id", "event_type").write.partitionBy("event_type").json(f"{path}/others")
    found = io.list_assets(spark, path, [".CSV"], ignore_case=True).where("length > 0")
    return found.groupBy(F.regexp_extract("path", "event_type=([^/]+)/", 1).alias("event_type")).agg(F.count("*").alias("files"))


@query("select user_id, max(ts) as ts, arg_max(event_id, ts) as event_id from events group by user_id")
def s12_latest_frame(spark: SparkSession, d: str) -> DataFrame:
    return io.latest_frame(fx.table(spark, d, "events").select("user_id", "ts", "event_id"), "user_id")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@query("select user_id, max(ts) as ts, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as event_type from events group by user_id")
def s12_newest_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream of four files, each with frames of all times, so that older frames come late; the
    last change of each source is its newest frame."""
    e = fx.table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    source, sink, progress = (scratch(spark, name) for name in ("frames", "newest", "progress"))
    e.repartition(4, F.xxhash64("event_id")).write.parquet(source)
    # by the clock there is always another batch to run, but for the second setting
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(source)
        found = newest.newest_frames(stream, "user_id", ttl_seconds=86400)
        found.writeStream.outputMode("update").option("checkpointLocation", progress).trigger(availableNow=True).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{sink}/batch={n}")).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    changes = spark.read.schema(e.schema.add("batch", "long")).parquet(sink)
    last = changes.groupBy("user_id").agg(F.max_by(F.struct("ts", "event_id", "event_type"), "batch").alias("f")).select("user_id", "f.*")
    return last.withColumn("ts", F.col("ts").cast(fx.table(spark, d, "events").schema["ts"].dataType))


@query(f"with {RESOURCES_SQL} select id, name, group_name, category from resources where {PROBLEM} is null and (id = 6 or group_name = 'g3' or category = 'terrain')")
def u3_catalog_lookups(spark: SparkSession, d: str) -> DataFrame:
    none = resources(spark, d).limit(0)
    c = io.Catalog(none).insert(resources(spark, d))
    return c.get(6).unionByName(c.by_group("g3")).unionByName(c.by_category("terrain")).select("id", "name", "group_name", "category").distinct()
