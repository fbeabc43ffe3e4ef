"""Registered queries of generators, joins, aggregations, windows, top-k and diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomatch.functions.tiles import tile_bounds
from geomatch.operators import diffs, grid, index, joins, keypoints, localization, metrics, search
from geomatch.operators import imu as inertial
from geomatch.plans import fixtures as fx
from geomatch.plans.queries_scalar import HAVERSINE
from geomatch.sources.shared import scratch, written
from geomatch.streaming import tracker

Q: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


r6 = lambda c, name: F.round(c, 6).alias(name)
KNN_SQL = fx.POINTS_SQL + """, scored as (
    select q.id as query_id, p.id, round(list_cosine_similarity(q.vector, p.vector), 6) as score, q.label as q_label, p.label, q.src as q_src, p.src, q.x as qx, q.y as qy, p.x, p.y
    from points q join points p on q.id <> p.id where q.id % 10 = 0),
    top as (select * from (select *, row_number() over (partition by query_id order by score desc, id) as rank from scored) where rank <= 5)"""


def top5(spark: SparkSession, d: str) -> DataFrame:
    return search.knn(fx.queries(spark, d).select("query_id", "vector"), fx.points(spark, d).select("id", "vector"), 5, exclude_self=True)


# ---- generators and filters ----------------------------------------------------------------------

TILE_X = "cast(least(greatest(floor(({lon} + 180) / 360 * 256), 0), 255) as bigint)"
TILE_Y = "cast(least(greatest(floor((0.5 - ln((1 + sin(radians({lat}))) / (1 - sin(radians({lat})))) / (4 * pi())) * 256), 0), 255) as bigint)"


@query(f"""with {fx.BBOXES_SQL}, t as (select key, {TILE_X.format(lon='west')} as x0, {TILE_X.format(lon='(east - 1e-11)')} as x1, {TILE_Y.format(lat='north')} as y0, {TILE_Y.format(lat='(south + 1e-11)')} as y1 from bboxes)
    select key, 8 as z, x, unnest(range(y0, y1 + 1)) as y from (select *, unnest(range(x0, x1 + 1)) as x from t)""")
def g1_tile_cover(spark: SparkSession, d: str) -> DataFrame:
    return grid.tile_cover(fx.bboxes(spark, d), 8).select("key", "z", "x", "y")


@query(f"""with {fx.RASTERS_SQL}, f as (select * from rasters where width >= 512 and height >= 512)
    select src, x, unnest(range(0, height - 512 + 1, 174)) as y from (select *, unnest(range(0, width - 512 + 1, 174)) as x from f)""")
def g2_patch_grid(spark: SparkSession, d: str) -> DataFrame:
    return grid.patch_grid(fx.rasters(spark, d), 512, 0.66).select("src", "x", "y")


@query("select label, count(*) filter (where vec_id % 9 <> 0) as processed, count(*) filter (where vec_id % 9 = 0) as skipped from embeddings group by label")
def g3_nodata_counts(spark: SparkSession, d: str) -> DataFrame:
    data = F.transform("embedding", lambda x: F.when(F.col("vec_id") % 9 == 0, F.lit(0.0)).otherwise(x))
    return grid.nodata_counts(fx.table(spark, d, "embeddings").select("label", data.alias("data")), ["label"])


def crops(spark: SparkSession, d: str) -> DataFrame:
    n = fx.table(spark, d, "part").agg(F.count("*").alias("n"))
    o = fx.table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 700).alias("x"), (F.col("o_custkey") % 500).alias("y"))
    return o.crossJoin(F.broadcast(n)).select(F.col("o_orderkey").alias("crop_id"), F.pmod("o_orderkey", "n").alias("src"), "x", "y", F.lit(256).alias("w"), F.lit(256).alias("h"))


@query(f"""with {fx.RASTERS_SQL}, c as (select o_orderkey as crop_id, o_orderkey % (select count(*) from part) as src, o_orderkey % 700 as x, o_custkey % 500 as y from orders),
    j as (select c.*, width, height, case when width is null then 'no such raster' when x >= width or y >= height then 'origin outside' end as error,
        least(256, width - x) as w, least(256, height - y) as h from c left join rasters r on r.src = c.src),
    t as (select *, unnest(range(x // 256, (x + w - 1) // 256 + 1)) as tx from j where error is null),
    u as (select *, unnest(range(y // 256, (y + h - 1) // 256 + 1)) as ty from t)
    select crop_id, src, coalesce(error, '') as error, ty * cast(ceil(width / 256) as bigint) + tx as chunk_index, greatest(x, tx * 256) as "left", greatest(y, ty * 256) as top,
        least(x + w, (tx + 1) * 256) - greatest(x, tx * 256) as part_width, least(y + h, (ty + 1) * 256) - greatest(y, ty * 256) as part_height from u
    union all select crop_id, src, error, -1, -1, -1, -1, -1 from j where error is not null""")
def g4_crop_plan(spark: SparkSession, d: str) -> DataFrame:
    r = fx.rasters(spark, d).withColumn("tile_width", F.lit(256))
    places = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("chunk_index", "left", "top", "part_width", "part_height")]
    return grid.crop_plan(crops(spark, d), r).select("crop_id", "src", F.coalesce("error", F.lit("")).alias("error"), *places)


@query(f"""with {fx.RASTERS_SQL}, c as (select o_orderkey as crop_id, o_orderkey % (select count(*) from part) as src, o_orderkey % 700 as x, o_custkey % 500 as y from orders),
    j as (select c.*, width, least(256, width - x) as w, least(8, height - y) as h from c join rasters r on r.src = c.src where x < width and y < height),
    l as (select *, unnest(range(y, y + h)) as yy from j), t as (select *, unnest(range(x // 256, (x + w - 1) // 256 + 1)) as tx from l),
    s as (select crop_id, yy, tx, greatest(x, tx * 256) as lo, least(x + w, (tx + 1) * 256) as hi,
        repeat('k' || right(to_hex((yy // 256) * cast(ceil(width / 256) as bigint) + tx), 1) || lpad(cast(yy % 256 as varchar), 6, '0'), 32) as line from t)
    select crop_id, cast(sum(hi - lo) as bigint) as n_bytes, md5(string_agg(substr(line, lo - tx * 256 + 1, hi - lo), '' order by yy, tx)) as digest from s group by crop_id""")
def g5_crop_assemble(spark: SparkSession, d: str) -> DataFrame:
    """Strips of 256 x 8 bytes of rasters whose bytes say where they lie."""
    r = fx.rasters(spark, d).withColumn("tile_width", F.lit(256))
    small = crops(spark, d).withColumns({"w": F.lit(256), "h": F.lit(8)})
    plan = grid.crop_plan(small, r)
    text = F.repeat(F.concat(F.lit("k"), F.substring(F.hex(F.col("chunk_index")), -1, 1), F.lpad(F.col("row").cast("string"), 6, "0")), 32)
    chunks = grid.rows_wanted(plan).withColumn("data", text.cast("binary"))
    return grid.crop_assemble(plan, chunks).select("crop_id", F.length("data").cast("long").alias("n_bytes"), F.md5("data").alias("digest"))


@query(f"with {fx.POINTS_SQL} select id, greatest(0, x - 128) as x, greatest(0, y - 128) as y, 256 as w, 256 as h from points")
def g6_prior_crop(spark: SparkSession, d: str) -> DataFrame:
    return grid.prior_crop(fx.points(spark, d).select("id", F.col("x").alias("pixel_x"), F.col("y").alias("pixel_y"))).select("id", "x", "y", "w", "h")


MATCHES_SQL = "matches as (select user_id as frame_id, event_type as tile from events)"


def matches(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "events").select(F.col("user_id").alias("frame_id"), F.col("event_type").alias("tile"))


@query(f"with {MATCHES_SQL} select frame_id, tile, count(*) as matches from matches group by all having count(*) >= 20")
def g7_gate_matches(spark: SparkSession, d: str) -> DataFrame:
    return grid.gate_matches(matches(spark, d), 20)


@query(f"with {MATCHES_SQL} select distinct frame_id from matches where frame_id not in (select frame_id from matches group by frame_id, tile having count(*) >= 18)")
def g7_failed_frames(spark: SparkSession, d: str) -> DataFrame:
    m = matches(spark, d)
    return grid.failed_frames(m.select("frame_id").distinct(), grid.gate_matches(m, 18))


@query()
def g9_g10_samples(spark: SparkSession, d: str) -> DataFrame:
    a = grid.sample_anchors(fx.rasters(spark, d).where("width is not null"), 3, 224, seed=7)
    return grid.sample_positives(a, 2, 224, seed=7).select("src", "i", "j", "cx", "cy", "px", "py", "margin", "width", "height")


@query(f"""with {fx.RASTERS_SQL} select src, cast(i as int) as i, cast(j as int) as j, 202 as margin, true as inside from rasters, range(3) a(i), range(2) b(j) where width > 404 and height > 404""")
def g9_g10_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Which samples there are, and that each lies where it may: the draws themselves have no SQL."""
    between = lambda c, dim: F.col(c).between(F.col("margin"), F.col(dim) - F.col("margin"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 56
    a = grid.sample_positives(grid.sample_anchors(fx.rasters(spark, d), 3, 224, seed=7), 2, 224, seed=7)
    return a.select("src", "i", "j", "margin", (between("cx", "width") & between("cy", "height") & between("px", "width") & between("py", "height") & near("px", "cx") & near("py", "cy")).alias("inside"))


@query("""select l_orderkey as key, list_reduce([cast(x as varchar) for x in (l[1:3] || [l[1] for i in range(greatest(3 - len(l), 0))])], (a, b) -> a || ',' || b) as chosen from (
    select l_orderkey, list(distinct l_partkey order by l_partkey) as l from lineitem group by l_orderkey)""".replace("(a, b) -> a || ',' || b", "lambda a, b: a || ',' || b"))
def g11_choose_positives(spark: SparkSession, d: str) -> DataFrame:
    p = fx.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.array_sort(F.collect_set("l_partkey")).alias("images"))
    return grid.choose_positives(p, 3, train=False).select("key", F.array_join(F.transform("chosen", lambda x: x.cast("string")), ",").alias("chosen"))


@query("select p_partkey as raster_idx, i, p_partkey * 4 + i as label from part, range(4) t(i)")
def g12_sample_labels(spark: SparkSession, d: str) -> DataFrame:
    s = fx.table(spark, d, "part").select(F.col("p_partkey").alias("raster_idx"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("i"))
    return grid.label_samples(s, 4)


# ---- top-k and geo joins -------------------------------------------------------------------------


@query(f"with {KNN_SQL} select query_id, id, score, rank from top")
def t1_knn(spark: SparkSession, d: str) -> DataFrame:
    return top5(spark, d).select("query_id", "id", "score", "rank")



NEAR_SQL = fx.POINTS_SQL + f""", near as (select q.id as query_id, p.id, {HAVERSINE.format(a='q', b='p')} as meters, round(list_cosine_similarity(q.vector, p.vector), 6) as score
    from points q join points p on true where q.id % 10 = 0)"""


@query(f"with {NEAR_SQL} select query_id, id, round(meters, 4) as meters from near where meters <= 250")
def j2_geo_radius_join(spark: SparkSession, d: str) -> DataFrame:
    q = fx.queries(spark, d).select("query_id", "lon", "lat")
    return search.geo_radius_join(q, fx.points(spark, d).select("id", "lon", "lat"), 250.0).select("query_id", "id", F.round("meters", 4).alias("meters"))


@query(f"with {NEAR_SQL} select query_id, id, score, rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from near where meters <= 250) where rank <= 3")
def t2_knn_within(spark: SparkSession, d: str) -> DataFrame:
    return search.knn_within(fx.queries(spark, d).select("query_id", "vector", "lon", "lat"), fx.points(spark, d).select("id", "vector", "lon", "lat"), 3, 250.0).select("query_id", "id", "score", "rank")


@query(f"""with {NEAR_SQL} select query_id, id, score, rank, case when query_id % 20 = 0 then 'prior' else 'global' end as mode from (
    select *, row_number() over (partition by query_id order by score desc, id) as rank from near where query_id % 20 <> 0 or meters <= 250) where rank <= 3""")
def j3_prior_or_global(spark: SparkSession, d: str) -> DataFrame:
    q = fx.queries(spark, d)
    return search.candidates(q.select("query_id", "vector"), q.where("query_id % 20 = 0").select("query_id", "lon", "lat"), fx.points(spark, d).select("id", "vector", "lon", "lat"), 3, 250.0)


@query(f"with {KNN_SQL} select count(distinct query_id) as queries, count(*) as hits, true as recall_is_over_90_percent from top")
def t3_ann_recall(spark: SparkSession, d: str) -> DataFrame:
    """The approximate hits against the exact ones of all queries."""
    q, p = fx.queries(spark, d).select("query_id", "vector"), fx.points(spark, d).select("id", "vector")
    found, exact = written(search.ann(q, p, 5), "ann"), search.knn(q, p, 5)
    good = search.recall(found, exact).select((F.col("recall") >= 0.9).alias("recall_is_over_90_percent"))
    return found.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("hits")).crossJoin(good)


@query()
def t3_ann(spark: SparkSession, d: str) -> DataFrame:
    return search.ann(fx.queries(spark, d).select("query_id", "vector"), fx.points(spark, d).select("id", "vector"), 5)


def clustered(spark: SparkSession, d: str) -> DataFrame:
    """The given points moved to 25 places: 3 more in the component of vec_id % 25."""
    p = fx.points(spark, d).select("id", F.transform("vector", lambda x, i: x.cast("double") + F.when(i == F.col("id") % 25, 3.0).otherwise(0.0)).alias("vector"))
    return p


def index_of(spark: SparkSession, points: DataFrame) -> index.VectorIndex:
    return index.VectorIndex.build(points, scratch(spark, "index"))


CLUSTERED_SQL = f"{fx.POINTS_SQL}, moved as (select id, [x + case when i - 1 = id % 25 then 3 else 0 end for x, i in vector] as vector from points)"


@query(f"""with {fx.POINTS_SQL}, scored as (select q.id as query_id, p.id, round(list_cosine_similarity(q.vector, p.vector), 6) as score from points q join points p on true where q.id % 10 = 0)
    select query_id, id, score, rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from scored) where rank <= 5""")
def t3_index_exact(spark: SparkSession, d: str) -> DataFrame:
    """All hits of the index over points without clusters, as a scan of all vectors gives them."""
    p = fx.points(spark, d)
    return index_of(spark, p).search(fx.queries(spark, d), 5).hits


@query(f"""with {CLUSTERED_SQL}, scored as (select q.id as query_id, p.id, round(list_cosine_similarity(q.vector, p.vector), 6) as score from moved q join moved p on true where q.id % 10 = 0)
    select query_id, id, score, rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from scored) where rank <= 5""")
def t3_index_clustered(spark: SparkSession, d: str) -> DataFrame:
    """The same over points in clusters, where most lists are not read at all."""
    p = clustered(spark, d)
    return index_of(spark, p).search(p.where("id % 10 = 0").withColumnRenamed("id", "query_id"), 5).hits


@query(f"""with {KNN_SQL}, f as (select query_id, min(rank) filter (where label = q_label) as first from top group by query_id)
    select {', '.join(f'round(avg(case when first <= {i} then 100.0 else 0.0 end), 6) as rank{i}' for i in range(1, 6))}, count(*) as queries from f""")
def rank_accuracy(spark: SparkSession, d: str) -> DataFrame:
    p = fx.points(spark, d)
    return metrics.rank_accuracy(top5(spark, d), fx.queries(spark, d).select("query_id", "label"), p.select("id", "label"))


def clustered(spark: SparkSession, d: str) -> DataFrame:
    """The given points moved to 25 places: 3 more in the component of vec_id % 25."""
    p = fx.points(spark, d).select("id", F.transform("vector", lambda x, i: x.cast("double") + F.when(i == F.col("id") % 25, 3.0).otherwise(0.0)).alias("vector"))
    return p


def index_of(spark: SparkSession, points: DataFrame) -> index.VectorIndex:
    return index.VectorIndex.build(points, scratch(spark, "index"))


CLUSTERED_SQL = f"{fx.POINTS_SQL}, moved as (select id, [x + case when i - 1 = id % 25 then 3 else 0 end for x, i in vector] as vector from points)"


@query(f"""with {fx.POINTS_SQL}, scored as (select q.id as query_id, p.id, round(list_cosine_similarity(q.vector, p.vector), 6) as score from points q join points p on true where q.id % 10 = 0)
    select query_id, id, score, rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from scored) where rank <= 5""")
def t3_index_exact(spark: SparkSession, d: str) -> DataFrame:
    """All hits of the index over points without clusters, as a scan of all vectors gives them."""
    p = fx.points(spark, d)
    return index_of(spark, p).search(fx.queries(spark, d), 5).hits


@query(f"""with {CLUSTERED_SQL}, scored as (select q.id as query_id, p.id, round(list_cosine_similarity(q.vector, p.vector), 6) as score from moved q join moved p on true where q.id % 10 = 0)
    select query_id, id, score, rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from scored) where rank <= 5""")
def t3_index_clustered(spark: SparkSession, d: str) -> DataFrame:
    """The same over points in clusters, where most lists are not read at all."""
    p = clustered(spark, d)
    return index_of(spark, p).search(p.where("id % 10 = 0").withColumnRenamed("id", "query_id"), 5).hits


@query("""select unnest(['clustered', 'clustered, 4 lists', 'given']) as points, count(*) filter (where vec_id % 10 = 0) as queries, true as recall_is_over_90_percent,
    true as under_10_percent_of_vectors_read, unnest([true, true, false]) as under_10_percent_of_codes_read from embeddings""")
def t3_index_reads(spark: SparkSession, d: str) -> DataFrame:
    """What the index reads for its hits, by points. Without clusters no list can be left out, so all codes are read there.
    A search that begins with 4 lists goes on where a cluster has more."""
    rows = []
    for name, p in (("given", fx.points(spark, d).select("id", "vector")), ("clustered", clustered(spark, d))):
        q, built = p.where("id % 10 = 0").withColumnRenamed("id", "query_id"), index_of(spark, p)
        exact, n, of = written(search.knn(q, p, 5), "exact"), q.count(), p.count()
        for kind, probes in ((name, None), (f"{name}, 4 lists", 4)):
            if kind != "given, 4 lists":
                found = built.search(q, 5, probes)
                codes, vectors = found.reads(n, of)
                rows.append((kind, n, search.recall(found.hits, exact).first()[0] >= 0.9, vectors < 0.1, codes < 0.1))
    return spark.createDataFrame(rows, "points string, queries long, recall_is_over_90_percent boolean, under_10_percent_of_vectors_read boolean, under_10_percent_of_codes_read boolean")


@query(f"""with {KNN_SQL}, f as (select query_id, min(rank) filter (where src = q_src and abs(x - qx) < 640 and abs(y - qy) < 640) as first from top group by query_id)
    select {', '.join(f'round(avg(case when first <= {i} then 100.0 else 0.0 end), 6) as rank{i}' for i in range(1, 6))}, count(*) as queries from f""")
def a3_spatial_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    hits = top5(spark, d).join(fx.points(spark, d).select("id", "src", "x", "y"), "id")
    return metrics.spatial_hit_rate(hits, fx.queries(spark, d).select("query_id", "src", "x", "y"), 640)


@query(f"""with {fx.POINTS_SQL}, q as (select * from points order by id limit 200), s as (select q.id as query_id, p.id, round(list_cosine_similarity(q.vector, p.vector), 6) as score from q, points p)
    select avg(cast(query_id = id as double)) as recall_at_1, count(*) as queries from (select *, row_number() over (partition by query_id order by score desc, id) as r from s) where r = 1""")
def a4_self_recall(spark: SparkSession, d: str) -> DataFrame:
    return search.self_recall(fx.points(spark, d).select("id", "vector"), 200)


@query(f"with {fx.POINTS_SQL}, a as (select id, id // 2 as k from points) select id as i, label from (select a.id, b.label from a join points b on b.id = a.k)")
def a2_align_labels(spark: SparkSession, d: str) -> DataFrame:
    p = fx.points(spark, d)
    half = p.count() // 2
    return metrics.align_labels(p.select(F.col("id").alias("i")), p.where(F.col("id") < half).select(F.col("id").alias("i"), "label"))


# ---- joins ---------------------------------------------------------------------------------------

ASSET = """select case when lang = 'en' then 'satellite' else 'drone' end as view, case when k = 49 then 'n49' else cast(k as {s}) end as folder, 'img' || doc_id || '.jpg' as path
    from (select doc_id, lang, doc_id % 50 as k from documents) t where (lang = 'en' and (k < 40 or k = 49)) or (lang <> 'en' and k >= 5)"""


def assets(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 50
    a = fx.table(spark, d, "documents").select(F.when(F.col("lang") == "en", "satellite").otherwise("drone").alias("view"), F.when(k == 49, "n49").otherwise(k.cast("string")).alias("folder"), F.concat(F.lit("img"), F.col("doc_id"), F.lit(".jpg")).alias("path"), k.alias("k"), "lang")
    return a.where("(lang = 'en' and (k < 40 or k = 49)) or (lang <> 'en' and k >= 5)").drop("k", "lang")


@query(f"""with assets as ({ASSET.format(s='varchar')}), n as (select cast(folder as bigint) as pair_id, view, path from assets where regexp_matches(folder, '^[0-9]+$'))
    select s.pair_id, satellite, drones from (select pair_id, min(path) as satellite from n where view = 'satellite' group by 1) s
    join (select pair_id, string_agg(path, ',' order by path) as drones from n where view = 'drone' group by 1) d on d.pair_id = s.pair_id""")
def j5_pair_views(spark: SparkSession, d: str) -> DataFrame:
    return joins.pair_views(assets(spark, d)).withColumn("drones", F.array_join("drones", ","))


@query(f"with assets as ({ASSET.format(s='varchar')}) select folder from assets where view = 'satellite' intersect select folder from assets where view = 'drone'")
def d1_id_intersection(spark: SparkSession, d: str) -> DataFrame:
    a = assets(spark, d)
    return diffs.id_intersection(a.where("view = 'satellite'"), a.where("view = 'drone'"), "folder")


@query("select o_orderkey as file, coalesce(c_custkey, -1) as lon, coalesce(case when c_custkey % 3 = 0 then cast(c_nationkey as double) end, 0.0) as yaw from orders left join customer on o_custkey = c_custkey and c_custkey % 2 = 0".replace("o_orderkey as file", "o_orderkey"))
def j4_attach_metadata(spark: SparkSession, d: str) -> DataFrame:
    images = fx.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("file"))
    meta = fx.table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("file"), F.col("c_custkey").alias("lon"), F.lit(0.0).alias("lat"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey").cast("double")).alias("yaw"))
    return joins.attach_metadata(images, meta).select("o_orderkey", F.coalesce("lon", F.lit(-1)).alias("lon"), "yaw")


SPAN = 40_000_000
WINDOWS_SQL = fx.IMU_SQL + ", starts as (select stream_id, ts_ns as window_id, ts_ns as start_ns from imu where ts_ns % 20000000 = 5000000)"
IN_WINDOW = f"in_window as (select s.window_id, i.* from starts s join imu i on i.stream_id = s.stream_id and i.ts_ns between s.start_ns and s.start_ns + {SPAN})"


def in_windows(spark: SparkSession, d: str) -> DataFrame:
    return joins.interval_join(fx.imu(spark, d), fx.imu_starts(spark, d), SPAN).drop("start_ns", "end_ns")


@query(f"with {WINDOWS_SQL}, {IN_WINDOW} select stream_id, window_id, ts_ns, round(a_x, 6) as a_x from in_window")
def j6_interval_join(spark: SparkSession, d: str) -> DataFrame:
    return in_windows(spark, d).select("stream_id", "window_id", "ts_ns", F.round("a_x", 6).alias("a_x"))


@query(f"""with {WINDOWS_SQL} select stream_id, window_id, coalesce((select min(i.ts_ns) from imu i where i.stream_id = s.stream_id and i.ts_ns % 15000000 = 0 and i.ts_ns >= s.start_ns + 12000000), -1) as end_ns from starts s""")
def j7_asof_forward(spark: SparkSession, d: str) -> DataFrame:
    truth = fx.imu(spark, d).where("ts_ns % 15000000 = 0").select("stream_id", "ts_ns", "a_x")
    return joins.asof_forward(fx.imu_starts(spark, d), truth, 12_000_000).select("stream_id", "window_id", F.coalesce("truth.ts_ns", F.lit(-1)).alias("end_ns"))


@query(f"with {WINDOWS_SQL}, {IN_WINDOW} select stream_id, window_id, ts_ns, round(dt, 9) as dt from (select *, (ts_ns - lag(ts_ns) over (partition by stream_id, window_id order by ts_ns)) * 1e-9 as dt from in_window) where dt is not null")
def w2_with_dt(spark: SparkSession, d: str) -> DataFrame:
    return keypoints.with_dt(in_windows(spark, d)).select("stream_id", "window_id", "ts_ns", F.round("dt", 9).alias("dt"))


@query(f"""with {fx.SCORES_SQL}, r as (select *, row_number() over (partition by pair_id, i order by score desc, j) as a, row_number() over (partition by pair_id, j order by score desc, i) as b from scores)
    select pair_id, i, j, score from r where a = 1 and b = 1 and score > 0.25""")
def j8_mutual_nn(spark: SparkSession, d: str) -> DataFrame:
    return joins.mutual_nn(fx.scores(spark, d), 0.25).select("pair_id", "i", "j", "score")


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Nine events of a user a frame, in metres along value."""
    p = F.struct("event_id", (F.col("value") / 20).alias("ecef_x"), F.lit(0.0).alias("ecef_y"), F.lit(0.0).alias("ecef_z"))
    return fx.table(spark, d, "events").groupBy("user_id", F.floor(F.col("event_id") / 500).alias("frame")).agg(F.array_sort(F.collect_list(p)).alias("points"))


@query("""select user_id, frame, cast(len(l) as int) as n, array_to_string([x.e for x in list_reduce([[x] for x in l], lambda kept, p: case when len([k for k in kept if (k.v - p[1].v) * (k.v - p[1].v) < 0.2::double * 0.2::double]) > 0 then kept else kept || p end)], ',') as kept
    from (select user_id, event_id // 500 as frame, list({'e': event_id, 'v': value / 20} order by event_id) as l from events group by 1, 2)""")
def j9_nms_points(spark: SparkSession, d: str) -> DataFrame:
    kept = F.transform(joins.nms_points(F.col("points"), 0.2), lambda p: p["event_id"].cast("string"))
    return observations(spark, d).select("user_id", "frame", F.size("points").alias("n"), F.array_join(kept, ",").alias("kept"))


@query(f"with {KNN_SQL} select query_id, t.id, t.rank, p.x, p.y from top t join points p on p.id = t.id".replace("select query_id, t.id", "select t.query_id as frame_id, t.id"))
def j11_zip_tiles(spark: SparkSession, d: str) -> DataFrame:
    hits = top5(spark, d).select(F.col("query_id").alias("frame_id"), "id", "rank")
    cut = hits.join(fx.points(spark, d).select("id", "x", "y"), "id").select("frame_id", "rank", "x", "y")
    return joins.zip_tiles(hits, cut).select("frame_id", "id", "rank", "x", "y")


BILINEAR_SQL = """with g as (select vec_id // 100 as img, cast(vec_id % 10 as bigint) as gx, cast((vec_id // 10) % 10 as bigint) as gy, cast(embedding as double[]) as v from embeddings),
    p as (select event_id, event_id % (select max(vec_id) // 100 + 1 from embeddings) as img, cast(event_id % 97 as double) / 96 * 9 as x, cast(event_id % 89 as double) / 88 * 9 as y from events),
    c as (select p.*, least(floor(x), 9) as x0, least(floor(y), 9) as y0, x - floor(x) as fx, y - floor(y) as fy from p),
    s as (select event_id, [a.v[i] * (1 - fx) * (1 - fy) + b.v[i] * fx * (1 - fy) + e.v[i] * (1 - fx) * fy + f.v[i] * fx * fy for i in range(1, len(a.v) + 1)] as v from c
        join g a on a.img = c.img and a.gx = x0 and a.gy = y0 join g b on b.img = c.img and b.gx = least(x0 + 1, 9) and b.gy = y0
        join g e on e.img = c.img and e.gx = x0 and e.gy = least(y0 + 1, 9) join g f on f.img = c.img and f.gx = least(x0 + 1, 9) and f.gy = least(y0 + 1, 9))
    select event_id as point_id, round(x / greatest(sqrt(list_dot_product(v, v)), 1e-6), 5) + 0::double as value, i from (select event_id, v, unnest(v) as x, unnest(range(0, len(v))) as i from s)"""


@query(BILINEAR_SQL)
def j12_bilinear_sample(spark: SparkSession, d: str) -> DataFrame:
    """Images of 10 x 10 vectors; events are dealt to them in turn."""
    e = fx.table(spark, d, "embeddings")
    g = e.select(F.floor(F.col("vec_id") / 100).alias("img_id"), (F.col("vec_id") % 10).alias("gx"), (F.floor(F.col("vec_id") / 10) % 10).alias("gy"), F.col("embedding").alias("vector"))
    images = e.agg(F.max(F.floor(F.col("vec_id") / 100)) + 1).first()[0] or 1
    p = fx.table(spark, d, "events").select((F.col("event_id") % images).alias("img_id"), F.col("event_id").alias("point_id"), (F.col("event_id") % 97).cast("double").alias("x"), (F.col("event_id") % 89 / F.lit(88.0) * 96).alias("y"))
    out = joins.bilinear_sample(g, p, 97, 97, 10, 10)
    return out.select("point_id", F.posexplode("vector").alias("i", "x")).select("point_id", (F.round("x", 5) + 0.0).alias("value"), F.col("i").cast("long").alias("i"))


# ---- aggregations --------------------------------------------------------------------------------


@query("""select round(avg(value), 6) as mean_ms, round(quantile_cont(value, 0.95), 6) as p95_ms, round(quantile_cont(value, 0.99), 6) as p99_ms,
    round(case when avg(value) > 0 then 1000 / avg(value) else 0 end, 6) as qps, count(value) as n from events""")
def a5_latency_interpolated(spark: SparkSession, d: str) -> DataFrame:
    return metrics.latency_report(fx.table(spark, d, "events"), "value")


@query("""with s as (select value, row_number() over (order by value) - 1 as k, count(*) over () as n from events where value is not null)
    select round(avg(value), 6) as mean_ms, round(max(value) filter (where k = least(cast(floor(n * 0.95) as bigint), n - 1)), 6) as p95_ms,
        round(max(value) filter (where k = least(cast(floor(n * 0.99) as bigint), n - 1)), 6) as p99_ms, round(1000 / avg(value), 6) as qps, count(*) as n from s""")
def a5_latency_index(spark: SparkSession, d: str) -> DataFrame:
    return metrics.latency_report(fx.table(spark, d, "events"), "value", "index")


@query("""with v as (select case when event_id % 200 = 0 then 'nan'::double when event_id % 50 = 1 then 'inf'::double when event_id % 50 = 2 then '-inf'::double else value end as value from events),
    s as (select value, row_number() over (order by value) - 1 as k, count(*) over () as n from v where value is not null)
    select round(max(value) filter (where k = least(cast(floor(n * 0.95) as bigint), n - 1)), 6) as p95_ms, max(value) filter (where k = least(cast(floor(n * 0.99) as bigint), n - 1)) = 'inf'::double as p99_is_endless,
        isnan(avg(value)) as mean_is_no_number, count(*) as n from s""")
def a5_latency_odd(spark: SparkSession, d: str) -> DataFrame:
    """With failures among the latencies: half a percent NaN, two percent infinite to each side."""
    odd = F.when(F.col("event_id") % 200 == 0, float("nan")).when(F.col("event_id") % 50 == 1, float("inf")).when(F.col("event_id") % 50 == 2, float("-inf")).otherwise(F.col("value"))
    r = metrics.latency_report(fx.table(spark, d, "events").select(odd.alias("value")), "value", "index")
    return r.select("p95_ms", (F.col("p99_ms") == float("inf")).alias("p99_is_endless"), F.isnan("mean_ms").alias("mean_is_no_number"), "n")


@query("""select user_id, count(*) * 4 as items, round(case when max(ts) > min(ts) then count(*) * 4 / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) else 0 end, 9) as items_per_second from events group by user_id""")
def a6_throughput(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return metrics.throughput(e, ["user_id"], F.lit(4).cast("long"), "ts")


MS_SQL = """with e as (select vec_id // 20 as batch, vec_id, cast(embedding as double[]) as v from embeddings), n as (select * from e where batch in (select batch from e group by batch having count(*) = 20)),
    s as (select a.batch, a.vec_id as anchor, p.vec_id as other, p.vec_id = a.vec_id + 1 as own, list_cosine_similarity(a.v, p.v) as s from n a join n p on p.batch = a.batch where a.vec_id % 2 = 0 and p.vec_id % 2 = 1),
    m as (select *, max(case when not own then s end) over w as max_neg, min(case when own then s end) over w as min_pos from s window w as (partition by batch, anchor)),
    k as (select *, coalesce(case when own then s < max_neg + 0.1 else s > min_pos - 0.1 end, false) as kept from m)"""


def ms_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "embeddings").select((F.col("vec_id") / 20).cast("long").alias("batch"), "vec_id", F.col("embedding").alias("vector"))
    e = e.join(e.groupBy("batch").count().where("count = 20").select("batch"), "batch")
    a = e.where("vec_id % 2 = 0").select("batch", F.col("vec_id").alias("id"), "vector")
    p = e.where("vec_id % 2 = 1").select("batch", F.col("vec_id").alias("id"), (F.col("vec_id") - 1).alias("anchor_id"), "vector")
    return metrics.hard_pairs(metrics.similarities(a, p))


@query(MS_SQL + "select batch, anchor, other, own from k where kept")
def a7_hard_pairs(spark: SparkSession, d: str) -> DataFrame:
    return ms_pairs(spark, d).where("kept").select("batch", "anchor", "other", "own")


@query(MS_SQL + """, g as (select batch, anchor, sum(case when own and kept then exp(least(greatest(-2 * (s - 0.5), -80), 80)) else 0 end) as pos,
    sum(case when not own and kept then exp(least(greatest(50 * (s - 0.5), -80), 80)) else 0 end) as neg from k group by 1, 2)
    select batch, round(avg(ln(1 + pos) / 2 + ln(1 + neg) / 50), 6) as loss from g group by batch""")
def a7_ms_loss(spark: SparkSession, d: str) -> DataFrame:
    return metrics.ms_loss(ms_pairs(spark, d))


@query("""select vec_id, round(0.9 * (ls - v[label + 1]) + 0.1 * (ls - list_avg(v)), 6) as loss from (
    select vec_id, label, v, ln(list_sum([exp(x) for x in v])) as ls from (select vec_id, label, cast(embedding as double[]) as v from embeddings))""")
def a8_smoothed_ce(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return e.select("vec_id", r6(metrics.smoothed_ce(F.col("v"), F.col("label")), "loss"))


@query(MS_SQL + """, g as (select batch, anchor, sum(case when own and kept then exp(least(greatest(-2 * (s - 0.5), -80), 80)) else 0 end) as pos,
    sum(case when not own and kept then exp(least(greatest(50 * (s - 0.5), -80), 80)) else 0 end) as neg from k group by 1, 2),
    l as (select batch, round(avg(ln(1 + pos) / 2 + ln(1 + neg) / 50), 6) as loss from g group by batch),
    c as (select vec_id // 20 as batch, avg(0.9 * (ls - v[label + 1]) + 0.1 * (ls - list_avg(v))) as ce from (
        select vec_id, label, v, ln(list_sum([exp(x) for x in v])) as ls from (select vec_id, label, cast(embedding as double[]) as v from embeddings where vec_id % 40 < 20)) group by 1)
    select batch, round(loss + coalesce(ce, 0), 6) as loss from l left join c using (batch)""")
def a8_combined_loss(spark: SparkSession, d: str) -> DataFrame:
    """Every second batch has labels."""
    rows = fx.table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("batch"), F.when(F.col("vec_id") % 40 < 20, F.col("label")).alias("label"), F.col("embedding").cast("array<double>").alias("logits"))
    return metrics.combined_loss(metrics.ms_loss(ms_pairs(spark, d)), rows)


@query("select user_id, round(power(avg(power(greatest(value, 1e-6), 3.0)), 1 / 3.0::double), 6) as pooled from events group by user_id")
def a9_gem_pool(spark: SparkSession, d: str) -> DataFrame:
    return metrics.gem_pool(fx.table(spark, d, "events"), ["user_id"], "value")


PAIRS = {"frame_id": "user_id", "tile": "event_type", "x": "value", "y": "cast(event_id % 500 as double)", "u": "value * 1.1 + 3 + event_id % 17", "v": "(event_id % 500) * 0.9 - 4"}


def point_pairs(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "events").selectExpr(*[f"cast({v} as double) as {k}" if k in "xyuv" else f"{v} as {k}" for k, v in PAIRS.items()])


@query("with p as (select " + ", ".join(f"{v} as {k}" for k, v in PAIRS.items()) + " from events) select frame_id, tile, count(*) filter (where sqrt(power(x * 1.1 + 3 - u, 2) + power(y * 0.9 - 4 - v, 2)) < 9.5) as inliers, count(*) as matches from p group by 1, 2")
def a10_count_inliers(spark: SparkSession, d: str) -> DataFrame:
    h = F.array(*map(F.lit, (1.1, 0.0, 3.0, 0.0, 0.9, -4.0, 0.0, 0.0, 1.0)))
    return metrics.count_inliers(point_pairs(spark, d).withColumn("h", h), 9.5)


@query("""select user_id as frame_id, event_type as tile, count(*) as inliers, 1.1::double as h0, 3.0::double as h2, 0.9::double as h4, -4.0::double as h5 from events group by 1, 2 having count(distinct value) >= 6 and count(distinct event_id % 500) >= 6""")
def a10_fit_exact(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of one affine map: every group of six places and more has that model, and all its pairs fit."""
    m = point_pairs(spark, d).withColumns({"u": F.col("x") * 1.1 + 3, "v": F.col("y") * 0.9 - 4})
    spread = m.groupBy("frame_id", "tile").agg(F.countDistinct("x").alias("a"), F.countDistinct("y").alias("b")).where("a >= 6 and b >= 6").select("frame_id", "tile")
    fit = metrics.fit_homography(m).join(spread, ["frame_id", "tile"])
    return fit.select("frame_id", "tile", "inliers", *[F.round(F.col("h")[k], 4).alias(f"h{k}") for k in (0, 2, 4, 5)])


@query()
def a10_fit_homography(spark: SparkSession, d: str) -> DataFrame:
    return metrics.fit_homography(point_pairs(spark, d)).select("frame_id", "tile", "inliers")


@query("select l_orderkey as run_id, l_linenumber as epoch, round(avg(l_tax), 6) as train_loss, count(*) as steps from lineitem group by 1, 2")
def a11_epoch_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.epoch_summary(fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("epoch"), F.col("l_tax").alias("loss")))


@query("""with t as (select distinct l_returnflag as z, l_partkey as x, l_suppkey as y from lineitem)
    select z, x, y, (x - min(x) over (partition by z)) * 256 as off_x, (y - min(y) over (partition by z)) * 256 as off_y,
        (max(x) over (partition by z) - min(x) over (partition by z) + 1) * 256 as mosaic_width, (max(y) over (partition by z) - min(y) over (partition by z) + 1) * 256 as mosaic_height from t""")
def a12_mosaic_plan(spark: SparkSession, d: str) -> DataFrame:
    t = fx.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("z"), F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y")).distinct()
    b = tile_bounds(F.lit(18), F.col("x"), F.col("y"))
    t = t.select("z", "x", "y", *[b[c].alias(c) for c in ("west", "south", "east", "north")], F.lit(256).alias("width"), F.lit(256).alias("height"))
    return metrics.mosaic_plan(t).select("z", "x", "y", "off_x", "off_y", "mosaic_width", "mosaic_height")


@query("""with b as (select l_partkey % 50 as x, l_suppkey % 20 as y, l_orderkey * 10 + l_linenumber as file, cast(l_quantity as bigint) % 4 as v from lineitem)
    select x, y, coalesce(arg_min(v, file * 10 + v) filter (where v <> 0), 0) as value from b group by 1, 2""")
def a12_mosaic_pixels(spark: SparkSession, d: str) -> DataFrame:
    b = fx.table(spark, d, "lineitem").select((F.col("l_partkey") % 50).alias("x"), (F.col("l_suppkey") % 20).alias("y"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("file"), (F.col("l_quantity").cast("long") % 4).alias("value"))
    return metrics.mosaic_pixels(b)


@query("""with t as (select l_returnflag as z, (((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey) * 100 + cast(l_quantity as bigint) as file,
        l_partkey % 50 as off_x, l_suppkey % 20 as off_y, cast(l_quantity as bigint) as q from lineitem),
    p as (select z, file, off_x + k % 5 as x, off_y + k // 5 as y, (q + k) % 4 as v from (select *, unnest(range(0, 15)) as k from t))
    select z, x, y, coalesce(arg_min(v, file) filter (where v <> 0), 0) as value from p group by 1, 2, 3""")
def a12_mosaic_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of 5 by 3 pixels into blocks of 16; their pixels, as a row a pixel gives them."""
    q = F.col("l_quantity").cast("long")
    # numbers of files outgrow a long from 9,223,372 orders on
    file = F.col("l_orderkey").cast("decimal(38,0)")
    for times, part in ((10, "l_linenumber"), (100000, "l_partkey"), (10000, "l_suppkey")):
        file = file * times + F.col(part)
    t = fx.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("z"), (file * 100 + q).alias("file"), (F.col("l_partkey") % 50).alias("off_x"), (F.col("l_suppkey") % 20).alias("off_y"), F.lit(5).alias("width"), F.lit(3).alias("height"), F.transform(F.sequence(F.lit(0).cast("long"), F.lit(14).cast("long")), lambda k: (q + k) % 4).alias("data"))
    px = metrics.mosaic_blocks(t, ["z"], 16).select("z", "block_x", "block_y", F.posexplode("data").alias("k", "value"))
    px = px.select("z", (F.col("block_x") * 16 + F.col("k") % 16).alias("x"), (F.col("block_y") * 16 + F.floor(F.col("k") / 16)).alias("y"), "value")
    # pixels that no tile covers are 0 in a block and no row here
    lit = t.select("z", "off_x", "off_y").distinct().select("z", F.explode(F.transform(F.sequence(F.lit(0), F.lit(14)), lambda k: F.struct((F.col("off_x") + k % 5).alias("x"), (F.col("off_y") + F.floor(k / 5)).alias("y")))).alias("p")).select("z", "p.*").distinct()
    return px.join(lit, ["z", "x", "y"]).select("z", "x", "y", "value")


# ---- windows and keypoints -----------------------------------------------------------------------


@query(f"""with {fx.METRICS_SQL} select run_id, epoch, round(rank1, 6) as rank1 from (select *, greatest(coalesce(max(rank1) over (partition by run_id order by epoch rows between unbounded preceding and 1 preceding), 0), 0) as best from metrics) where rank1 > best""")
def w1_best_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    return keypoints.best_checkpoints(fx.metrics(spark, d)).select("run_id", "epoch", F.round("rank1", 6).alias("rank1"))


@query("""select user_id, event_id, round(sqrt(power(value - lag(value) over w, 2) + power(event_id - lag(event_id) over w, 2)), 4) as step_m from events window w as (partition by user_id order by event_id)""")
def w3_step_distance(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("ts_ns"), F.col("value").alias("ecef_x"), F.col("event_id").cast("double").alias("ecef_y"), F.lit(0.0).alias("ecef_z"))
    return keypoints.step_distance(e).select(F.col("session_id").alias("user_id"), F.col("ts_ns").alias("event_id"), F.round("step_m", 4).alias("step_m"))


@query(f"""with {fx.SCORES_SQL}, z as (select *, (i - 25) / 10.0::double as zi, (j - 25) / 10.0::double as zj, exp(score * 10) as e from scores)
    select pair_id, i, j, round(e / sum(e) over (partition by pair_id, i) * e / sum(e) over (partition by pair_id, j) / (1 + exp(-zi)) / (1 + exp(-zj)), 6) as score from z""")
def w4_dual_softmax(spark: SparkSession, d: str) -> DataFrame:
    s = fx.scores(spark, d).select("pair_id", "i", "j", (F.col("score") * 10).alias("s"), ((F.col("i") - 25) / 10).alias("zi"), ((F.col("j") - 25) / 10).alias("zj"))
    return keypoints.dual_softmax(s).select("pair_id", "i", "j", F.round("score", 6).alias("score"))


NMS = "nms as (select *, score = max(m) over (partition by img_id, x order by y range between 2 preceding and 2 following) as is_max from (select *, max(score) over (partition by img_id, y order by x range between 2 preceding and 2 following) as m from grid))"


@query(f"with {fx.GRID_SQL}, {NMS} select img_id, x, y, is_max from nms")
def w5_grid_nms(spark: SparkSession, d: str) -> DataFrame:
    return keypoints.grid_nms(fx.grid(spark, d), 2).select("img_id", "x", "y", "is_max")


def again_sql(before: str, name: str) -> str:
    """One more round over the cells of ``before``: maxima of what lies away from those found."""
    spread = lambda v, out, src, to: f"{to}_h as (select *, max({v}) over (partition by img_id, y order by x range between 2 preceding and 2 following) as h from {src}), {to} as (select * exclude (h), max(h) over (partition by img_id, x order by y range between 2 preceding and 2 following) as {out} from {to}_h)"
    return ", ".join([spread("cast(is_max as int)", "near", before, f"{name}_a"), f"{name}_b as (select *, case when near > 0 then 0 else score end as rest from {name}_a)", spread("rest", "top", f"{name}_b", f"{name}_c"), f"{name} as (select img_id, x, y, score, is_max or (near = 0 and rest = top) as is_max from {name}_c)"])


@query(f"with {fx.GRID_SQL}, {NMS}, first as (select img_id, x, y, score, is_max from nms), {again_sql('first', 'second')}, {again_sql('second', 'third')} select img_id, x, y, is_max from third")
def w6_iterated_nms(spark: SparkSession, d: str) -> DataFrame:
    return keypoints.grid_nms(fx.grid(spark, d), 2, rounds=2).select("img_id", "x", "y", "is_max")


@query(f"""with {fx.GRID_SQL}, {NMS} select img_id, x, y, is_max, rank from (select *, row_number() over (partition by img_id order by is_max desc, score desc, y, x) as rank from nms where x between 4 and 35 and y between 4 and 20) where rank <= 60""")
def t4_topk_keypoints(spark: SparkSession, d: str) -> DataFrame:
    return keypoints.topk_keypoints(fx.grid(spark, d), 60, 2, 4, 40, 25).select("img_id", "x", "y", "is_max", "rank")


NAMES = ["N7", "N3", "N19", "nowhere"]


@query("select n_nationkey, case n_nationkey when 7 then 1 when 3 then 2 when 19 then 3 else 1099511627776 end as listed, n_nationkey as position from nation")
def t5_order_by_names(spark: SparkSession, d: str) -> DataFrame:
    n = fx.table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("N"), F.col("n_nationkey")).alias("name"), F.col("n_nationkey").alias("position"))
    return keypoints.order_by_names(n, NAMES).orderBy("sort_key").select("n_nationkey", F.col("sort_key.p").cast("long").alias("listed"), F.col("sort_key.q").cast("long").alias("position"))


# ---- diffs ---------------------------------------------------------------------------------------


@query("""with a as (select l_partkey as name, max(l_suppkey) % 5 as shape from lineitem where l_returnflag = 'A' group by 1), b as (select l_partkey as name, max(l_suppkey) % 5 as shape from lineitem where l_returnflag = 'R' group by 1)
    select coalesce(a.name, b.name) as name, coalesce(a.shape, -1) as want, coalesce(b.shape, -1) as got, case when b.shape is null then 'missing' when a.shape is null then 'unexpected' else 'shape' end as issue
    from a full join b on a.name = b.name where a.shape is distinct from b.shape""")
def d2_schema_diff(spark: SparkSession, d: str) -> DataFrame:
    of = lambda flag: fx.table(spark, d, "lineitem").where(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("name")).agg((F.max("l_suppkey") % 5).alias("shape"))
    return diffs.schema_diff(of("A"), of("R")).select("name", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("want", "got")], "issue")


@query("""with p as (select event_id as id, props as saved, lead(props) over (partition by user_id order by ts, event_id) as current from events)
    select id, key, s as saved, c as current from (select id, 'k' as key, saved->>'$.k' as s, current->>'$.k' as c from p where current is not null union all select id, 'absent', null, null from p) where s is distinct from c""")
def d3_config_diff(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = fx.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("props").alias("saved"), F.lead("props").over(w).alias("current")).where("current is not null")
    return diffs.config_diff(p, ["k", "absent"])


@query("""with r as (select page_id as seq, 'n' || page_id % 40 as name from pages), u as (select 'n' || n_nationkey as name, n_nationkey % 2 = 0 as show, n_nationkey / 10.0::double as alpha from nation),
    k as (select *, row_number() over (partition by name order by seq desc) as r from r)
    select seq, k.name, case when r = 1 then coalesce(u.show, true) else true end as show, round(case when r = 1 then coalesce(u.alpha, 1) else 1 end, 6) as alpha from k left join u on u.name = k.name""")
def d4_apply_updates(spark: SparkSession, d: str) -> DataFrame:
    r = fx.table(spark, d, "pages").select(F.col("page_id").alias("seq"), F.concat(F.lit("n"), F.col("page_id") % 40).alias("name"), F.lit(True).alias("show"), F.lit(1.0).alias("alpha"))
    n = fx.table(spark, d, "nation")
    u = n.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("name"), (F.col("n_nationkey") % 2 == 0).alias("show"), (F.col("n_nationkey") / 10).alias("alpha"), F.lit(1).alias("seq"))
    u = u.unionByName(u.withColumns({"seq": F.lit(0), "alpha": F.lit(0.5)}))
    return diffs.apply_updates(r, u).select("seq", "name", "show", F.round("alpha", 6).alias("alpha"))


# ---- tracking and inertial -----------------------------------------------------------------------


@query()
def k3_track(spark: SparkSession, d: str) -> DataFrame:
    return tracker.track(fx.frames(spark, d))


@query(f"""with {fx.LONE_SQL}
    select user_id as session_id, event_id as seq, status, case when status = 'error' then 'No tile with enough matches' when state = 0 then 'No active trajectories available in estimator'
        when state in (1, 3) then 'No trajectories in Tracking state (Initializing: ' || cast(2 - (state + 1) // 2 as varchar) || ', Lost: ' || cast(state // 3 as varchar) || ')'
        when status = 'uncertain' then 'Insufficient spatial span: max current span is , required ' end as reason,
        case when status = 'location' then round(114.6 + east / (111000 * cos(radians(37.9))), 8) end as lon, cast(least(state, 1) as integer) as tracks,
        case when last_value(case status when 'error' then 'retrieve' when 'location' then 'crop' end ignore nulls) over (partition by user_id order by n rows between unbounded preceding and 1 preceding) = 'crop' then 'crop' else 'retrieve' end as mode
    from told""")
def k4_lone_track(spark: SparkSession, d: str) -> DataFrame:
    """States, health, reasons, bypass of failed frames and modes, where each session has one thing to follow."""
    out = tracker.track(fx.lone_frames(spark, d), feedback=True)
    return out.select("session_id", "seq", "status", F.regexp_replace("reason", r"[0-9.]+m", "").alias("reason"), F.round("lon", 8).alias("lon"), F.col("tracks").cast("int").alias("tracks"), "mode")


@query()
def k5_track_with_feedback(spark: SparkSession, d: str) -> DataFrame:
    return tracker.track(fx.frames(spark, d), feedback=True)


@query("""with t as (select user_id, event_type, count(*) as n from events group by 1, 2), g as (select * from t where n >= 18),
    f as (select user_id, max(event_id) as seq from events group by 1)
    select f.user_id % 7 as session_id, seq, case when count(g.n) = 0 then 'error' else 'ok' end as status, cast(count(g.n) as int) as observations, cast(coalesce(sum(g.n), 0) as bigint) as inliers,
        round(max(case when g.n is not null then 37.9 - 111.2 * 0.5 / 111000 end), 8) as lat, round(max(case when g.n is not null then 114.6 + f.user_id * 1e-4 + 143.8 * 0.5 / (111000 * cos(radians(37.9))) end), 8) as lon
    from f left join g on g.user_id = f.user_id group by f.user_id, seq""")
def k1_frame_exact(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of one affine map, so that every gated tile is an observation with all its pairs at a known place."""
    m = point_pairs(spark, d).withColumns({"u": F.col("x") * 1.1 + 3, "v": F.col("y") * 0.9 - 4})
    out = observed(spark, d, m)
    first = F.get("points", F.lit(0))
    return out.select("session_id", "seq", "status", F.size("points").alias("observations"), F.aggregate("points", F.lit(0).cast("long"), lambda s, p: s + p["inliers"]).alias("inliers"), F.round(first["lat"], 8).alias("lat"), F.round(first["lon"], 8).alias("lon"))


@query()
def k1_frame_observations(spark: SparkSession, d: str) -> DataFrame:
    return observed(spark, d, point_pairs(spark, d)).select("session_id", "seq", "status", F.size("points").alias("observations"))


def observed(spark: SparkSession, d: str, m: DataFrame) -> DataFrame:
    models = metrics.fit_homography(m)
    frames = fx.table(spark, d, "events").groupBy(F.col("user_id").alias("frame_id")).agg(F.max("ts").cast("timestamp").alias("ts"), F.max("event_id").alias("seq")).select((F.col("frame_id") % 7).alias("session_id"), "ts", "seq", "frame_id", F.lit(256.0).alias("width"), F.lit(256.0).alias("height"))
    rank = F.array_position(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))), F.col("tile"))
    hits = m.select("frame_id", "tile").distinct().select("frame_id", "tile", rank.alias("rank"), (114.6 + F.col("frame_id") * 1e-4).alias("lon"), F.lit(37.9).alias("lat"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(None).cast("double").alias("res_x"), F.lit(None).cast("double").alias("res_y"))
    return localization.frame_observations(frames, hits, m, models, 18)


def folds(spark: SparkSession, d: str, **bias) -> DataFrame:
    return inertial.preintegrate(keypoints.with_dt(in_windows(spark, d), segments=True), **bias)


_QUATERNION = "q0 * c - (q1 * x + q2 * y + q3 * z) * h", "q0 * x * h + q1 * c + (q2 * z - q3 * y) * h", "q0 * y * h + q2 * c + (q3 * x - q1 * z) * h", "q0 * z * h + q3 * c + (q1 * y - q2 * x) * h"
_TURNED = "ax + 2 * (q0 * (q2 * az - q3 * ay) + q2 * (q1 * ay - q2 * ax) - q3 * (q3 * ax - q1 * az))", "ay + 2 * (q0 * (q3 * ax - q1 * az) + q3 * (q2 * az - q3 * ay) - q1 * (q1 * ay - q2 * ax))", "az + 2 * (q0 * (q1 * ay - q2 * ax) + q1 * (q3 * ax - q1 * az) - q2 * (q2 * az - q3 * ay))"
FOLD_SQL = f"""with recursive {WINDOWS_SQL}, {IN_WINDOW},
    d as (select *, (ts_ns - lag(ts_ns) over w) * cast(1e-9 as double) as t, row_number() over w - 1 as k from in_window window w as (partition by stream_id, window_id order by ts_ns)),
    s as (select stream_id, window_id, k, t, a_x as ax, a_y as ay, a_z as az, w_x as x, w_y as y, w_z as z, cos(t * sqrt(w_x * w_x + w_y * w_y + w_z * w_z) / 2) as c,
        case when w_x * w_x + w_y * w_y + w_z * w_z > 0 then sin(t * sqrt(w_x * w_x + w_y * w_y + w_z * w_z) / 2) / sqrt(w_x * w_x + w_y * w_y + w_z * w_z) else t / 2 end as h from d where k > 0),
    f as (
        select distinct stream_id, window_id, cast(0 as bigint) as k, 0::double as dt, {", ".join(f"0::double as {v}{i}" for v in "pv" for i in range(3))}, 1::double as q0, 0::double as q1, 0::double as q2, 0::double as q3 from s
        union all
        select f.stream_id, f.window_id, s.k, dt + t, {", ".join(f"p{i} + v{i} * t + ({w}) * t * t / 2" for i, w in enumerate(_TURNED))}, {", ".join(f"v{i} + ({w}) * t" for i, w in enumerate(_TURNED))}, {", ".join(_QUATERNION)}
        from f join s on s.stream_id = f.stream_id and s.window_id = f.window_id and s.k = f.k + 1),
    o as (select * from f qualify k = max(k) over (partition by stream_id, window_id))"""


@query(FOLD_SQL + " select stream_id, window_id, round(dt, 9) as dt, k as samples, " + ", ".join(f"round({c}, 9) + 0::double as {c}" for c in ("p0", "p1", "p2", "v0", "v1", "v2", "q0", "q1", "q2", "q3")) + " from o")
def k6_preintegrate(spark: SparkSession, d: str) -> DataFrame:
    f = folds(spark, d)
    return f.select("stream_id", "window_id", F.round("dt", 9).alias("dt"), "samples", *[(F.round(F.col(v)[i], 9) + 0.0).alias(f"{v}{i}") for v, n in (("p", 3), ("v", 3), ("q", 4)) for i in range(n)])


@query(FOLD_SQL + """ select stream_id, window_id, round(sqrt(power(dt + p0 - 0.02, 2) + power(p1, 2) + power(p2 - 9.81 * dt * dt / 2, 2)), 9) as p_error,
    round(sqrt(power(v0, 2) + power(v1, 2) + power(v2 - 9.81 * dt, 2)), 9) as v_error, round(degrees(2 * atan2(sqrt(q1 * q1 + q2 * q2 + q3 * q3), abs(q0))), 9) as r_error from o""")
def k7_predict_pose(spark: SparkSession, d: str) -> DataFrame:
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    f = folds(spark, d).withColumns({"p0": v(0, 0, 0), "v0": v(1, 0, 0), "q0": v(1, 0, 0, 0), "p1": v(0.02, 0, 0), "v1": v(1, 0, 0), "q1": v(1, 0, 0, 0)})
    return inertial.predict_pose(f).select("stream_id", "window_id", *[F.round(c, 9).alias(c) for c in ("p_error", "v_error", "r_error")])


@query()
def k8_bias_correct(spark: SparkSession, d: str) -> DataFrame:
    small = F.array(*[F.lit(0.001)] * 3)
    f = inertial.bias_correct(folds(spark, d), small, small)
    return f.select("stream_id", "window_id", *[F.round(F.col(f"{v}_corrected")[i], 9).alias(f"{v}{i}") for v in ("p", "v") for i in range(3)])


#: The same fold of samples less both biases.
REFOLD_SQL = FOLD_SQL.replace("from in_window window w", "from (select stream_id, window_id, ts_ns, " + ", ".join(f"{c} - 0.0012345::double as {c}" for c in ("a_x", "a_y", "a_z", "w_x", "w_y", "w_z")) + " from in_window) window w")


@query(REFOLD_SQL + " select stream_id, window_id, " + ", ".join(f"round({c}, 5) + 0::double as {c}" for c in ("p0", "p1", "p2", "v0", "v1", "v2")) + " from o")
def k8_bias_refold(spark: SparkSession, d: str) -> DataFrame:
    """Corrected to first order, as folding the samples anew gives it to five places."""
    small = F.array(*[F.lit(0.0012345)] * 3)
    f = inertial.bias_correct(folds(spark, d), small, small)
    return f.select("stream_id", "window_id", *[(F.round(F.col(f"{v}_corrected")[i], 5) + 0.0).alias(f"{v}{i}") for v in ("p", "v") for i in range(3)])


# ---- embedding and ingestion ---------------------------------------------------------------------


def length_embedder():
    """Counts of ASCII words by length modulo 32."""
    import re

    import numpy as np

    word = re.compile("[A-Za-z]+")

    def run(texts: list) -> np.ndarray:
        out = np.zeros((len(texts), 32))
        for i, t in enumerate(texts):
            np.add.at(out[i], [len(w) % 32 for w in word.findall(t or "")], 1)
        return out

    return run


@query("""with w as (select doc_id, len(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'))) % 32 as i from documents), c as (select doc_id, i, count(*) as n from w group by 1, 2),
    s as (select doc_id, sqrt(sum(n * n)) as norm from c group by 1)
    select d.doc_id, k.i, round(cast(cast(coalesce(n, 0) / greatest(coalesce(norm, 0), 1e-6::double) as float) as double), 4) as value from documents d cross join range(32) k(i) left join c on c.doc_id = d.doc_id and c.i = k.i left join s on s.doc_id = d.doc_id""")
def u1_embed(spark: SparkSession, d: str) -> DataFrame:
    t = fx.table(spark, d, "documents").select("doc_id", F.col("text").alias("data"))
    out = localization.embed(t, length_embedder, 32).select("doc_id", F.posexplode("vector").alias("i", "x"))
    return out.select("doc_id", F.col("i").cast("long").alias("i"), F.round(F.col("x").cast("double"), 4).alias("value"))


@query(f"""with {fx.RASTERS_SQL}, g as (select src, x, unnest(range(0, height - 512 + 1, 174)) as y from (select *, unnest(range(0, width - 512 + 1, 174)) as x from rasters where width >= 512 and height >= 512))
    select src || '_' || x || '_' || y as id, round(114.5 + (x + 256.5) * 5e-6, 9) as lon, round(37.9 - (y + 256.5) * 5e-6, 9) as lat from g""")
def u2_ingest_plan(spark: SparkSession, d: str) -> DataFrame:
    affine = dict(zip("abcdef", (5e-6, 0.0, 114.5, 0.0, -5e-6, 37.9), strict=True))
    r = fx.rasters(spark, d).withColumns({k: F.lit(v) for k, v in affine.items()} | {"epsg": F.lit(4326)})
    return localization.ingest_plan(r, 512, 0.66).select("id", F.round("location.lon", 9).alias("lon"), F.round("location.lat", 9).alias("lat"))
