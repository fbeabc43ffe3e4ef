"""Registered queries against their SQL on the smallest tables, and operators without SQL."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from geomatch.functions import geo
from geomatch.operators import diffs, grid, joins, keypoints, localization, metrics, search
from geomatch.plans import fixtures as fx
from geomatch.plans import registry
from geomatch.sources import io

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    return c


def canon(rows):
    def text(v):
        if v is None or (isinstance(v, float) and v != v):
            return "null"
        return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted("|".join(map(text, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, small, duck, name):
    got = registry.QUERIES[name](spark, small)
    columns = sorted(got.columns)
    want = duck.execute(registry.ORACLES[name])
    assert columns == sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    assert canon(tuple(r) for r in got.select(*columns).collect()) == canon(tuple(r[k] for k in order) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_gives_rows(spark, small, name):
    assert registry.QUERIES[name](spark, small).count() > 0


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 1
    names = set(entry.queries())
    assert set(registry.QUERIES) <= names and set(entry.oracle_sql()) <= names
    if entry._llm():
        assert {"pipeline"} <= names


def test_knn_filters_rank_before_and_plans_no_cross_join(spark, small):
    q = fx.queries(spark, small).select("query_id", "lon", "lat")
    near = search.geo_radius_join(q, fx.points(spark, small).select("id", "lon", "lat"), 250.0)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert near.where("meters > 250").count() == 0


@pytest.mark.parametrize(("lon", "lat"), [(179.9999, 10.0), (0.0, 89.95), (10.0, 89.9999), (-180.0, -90.0), (30.0, -60.0), (5.0, 85.0)])
def test_geo_radius_join_at_edges(spark, lon, lat):
    rng = np.random.default_rng(3)
    wide = 180 if abs(lat) > 89 else 0.3 if abs(lat) > 80 else 0.05
    pts = [(i, float(-180 + (lon + 180 + x * wide / 0.05) % 360), float(np.clip(lat + y, -90, 90))) for i, (x, y) in enumerate(rng.uniform(-0.05, 0.05, (200, 2)))]
    p = spark.createDataFrame(pts, "id long, lon double, lat double")
    q = spark.createDataFrame([(1, lon, lat)], "query_id long, lon double, lat double")
    got = {r.id for r in search.geo_radius_join(q, p, 3000.0).collect()}
    d = p.select("id", geo.haversine(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat")).alias("m")).collect()
    assert got == {r.id for r in d if r.m <= 3000}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the larger tables")
def test_ann_recall_and_share_of_pairs(spark):
    d = "/root/testdata/sf0.1"
    q, p = fx.queries(spark, d).select("query_id", "vector"), fx.points(spark, d).select("id", "vector")
    exact = search.knn(q, p, 5)
    assert search.recall(search.ann(q, p, 5), exact).first().recall >= 0.9
    assert search.recall(exact, exact).first().recall == 1
    assert search.rough(q, p, 200).count() <= 0.1 * q.count() * p.count()


def test_ann_takes_as_many_bits_as_its_recall_asks_for(spark):
    v = np.random.default_rng(4).normal(size=(6000, 32))
    p = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    q = p.where("id % 40 = 0").withColumnRenamed("id", "query_id")
    exact = search.knn(q, p, 5)
    recall = lambda found: search.recall(found, exact).first()[0]
    assert recall(search.ann(q, p, 5, bits=64, oversample=8, least=0)) < 0.6 and recall(search.ann(q, p, 5, bits=64, oversample=8)) >= 0.9
    # with all bits there are, more points are read
    assert search.enough(q, p, 5, search.MOST_BITS, 1, 42, 0.95)[1] > 1


def test_ann_gives_k_hits_to_isolated_queries(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(0, 0.05, (60, 8)) + np.eye(8)[0]
    p = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    q = spark.createDataFrame([(1, v[0].tolist()), (2, (-v[1]).tolist()), (3, np.eye(8)[3].tolist())], "query_id long, vector array<double>")
    for oversample in (1, 12):
        got, want = ({k: [r.id for r in rows if r.query_id == k] for k in (1, 2, 3)} for rows in (search.ann(q, p, 5, bits=20, oversample=oversample).orderBy("rank").collect(), search.knn(q, p, 5).orderBy("rank").collect()))
        assert all(len(x) == 5 for x in got.values())
        if oversample == 12:  # all points
            assert got == want


def test_blocks_and_tiles_give_the_same_hits(spark, small, monkeypatch):
    q, p = fx.queries(spark, small).select("query_id", "vector"), fx.points(spark, small).select("id", "vector")
    p = p.unionByName(p.where("id % 7 = 0").select((F.col("id") + 1000).alias("id"), "vector"))
    want = sorted(map(tuple, search.knn(q, p, 3).collect()))
    for name, value in {"QUERY_BYTES": 10_000, "TILE_BYTES": 20_000, "BLOCK_ROWS": 60}.items():
        monkeypatch.setattr(search, name, value)
    blocks = search.knn(q, p, 3)
    assert "FlatMapCoGroupsInPandas" in blocks._jdf.queryExecution().toString() and sorted(map(tuple, blocks.collect())) == want


@pytest.mark.parametrize("epsg", [3857, 4326, 32633, 32733, 32650])
def test_reference_systems_round_trip(spark, epsg):
    zone = (epsg % 100) * 6 - 183 if epsg > 32600 else 14
    rows = [(zone + x, y if epsg < 32700 else -y) for x in (-2.5, 0.1, 2.9) for y in (1.0, 37.9, 70.0)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in rows], "lon double, lat double").withColumn("p", geo.from_wgs84(F.lit(epsg), F.col("lon"), F.col("lat"))).withColumn("q", geo.to_wgs84(F.lit(epsg), F.col("p.x"), F.col("p.y")))
    for r in df.collect():
        assert abs(r.q.lon - r.lon) < 1e-7 and abs(r.q.lat - r.lat) < 1e-7 and r.q.reason is None
    if epsg == 32633:  # on the central meridian the easting is the false one
        one = spark.range(1).select(geo.from_wgs84(F.lit(epsg), F.lit(15.0), F.lit(0.0)).alias("p")).first().p
        assert abs(one.x - 500000) < 1e-6 and abs(one.y) < 1e-6


def test_nms_keeps_order_and_strictness(spark):
    df = spark.createDataFrame([([(0.0, 0.0, 0.0), (0.1, 0.0, 0.0), (0.2, 0.0, 0.0), (0.29, 0.0, 0.0)],)], "p array<struct<ecef_x:double,ecef_y:double,ecef_z:double>>")
    assert [x.ecef_x for x in df.select(joins.nms_points(F.col("p"), 0.2).alias("k")).first().k] == [0.0, 0.2]


def test_crop_assembly(spark):
    img = np.arange(100 * 90, dtype=np.int64).reshape(90, 100) % 251
    chunks = [("a", (y // 32) * 4 + x // 32, r, bytes(np.pad(img, ((0, 38), (0, 28)))[y + r, x : x + 32].astype(np.uint8).tolist())) for y in range(0, 96, 32) for x in range(0, 128, 32) for r in range(32)]
    c = spark.createDataFrame(chunks, "src string, chunk_index long, row int, data binary")
    r = spark.createDataFrame([("a", 100, 90, 32, 32)], "src string, width int, height int, tile_width int, tile_height int")
    crops = spark.createDataFrame([(1, "a", 20, 10, 50, 60), (2, "a", 90, 80, 50, 50), (3, "a", 200, 0, 5, 5), (4, "b", 0, 0, 5, 5), (5, "a", 0, 0, 0, 5)], "crop_id long, src string, x int, y int, w int, h int")
    plan = grid.crop_plan(crops, r)
    assert {x.crop_id: x.error for x in plan.where("error is not null").collect()} == {3: "origin outside", 4: "no such raster", 5: "empty crop"}
    got = {x.crop_id: bytes(x.data) for x in grid.crop_assemble(plan, c).collect()}
    assert got == {1: img[10:70, 20:70].astype(np.uint8).tobytes(), 2: img[80:, 90:].astype(np.uint8).tobytes()}


def test_crop_assembly_from_wanted_rows_only(spark):
    r = spark.createDataFrame([("a", 64, 64, 32, 32)], "src string, width int, height int, tile_width int, tile_height int")
    crops = spark.createDataFrame([(1, "a", 20, 30, 20, 4), (2, "a", 22, 31, 5, 3), (3, "a", 90, 0, 5, 5)], "crop_id long, src string, x int, y int, w int, h int")
    plan = grid.crop_plan(crops, r)
    wanted = grid.rows_wanted(plan)
    # of each of the four chunks the two rows at the middle, not all 32, and none twice
    assert sorted((x.chunk_index, x.row) for x in wanted.collect()) == [(0, 30), (0, 31), (1, 30), (1, 31), (2, 0), (2, 1), (3, 0), (3, 1)]
    data = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda x: F.lpad(F.hex((F.col("chunk_index") * 64 + F.col("row") + x) % 251), 2, "0"))
    got = {x.crop_id: bytes(x.data) for x in grid.crop_assemble(plan, wanted.withColumn("data", F.unhex(F.array_join(data, "")))).collect()}
    at = lambda x, y: (((y // 32) * 2 + x // 32) * 64 + y % 32 + x % 32) % 251
    assert got == {1: bytes(at(x, y) for y in range(30, 34) for x in range(20, 40)), 2: bytes(at(x, y) for y in range(31, 34) for x in range(22, 27))}


def test_samples_stay_inside(spark, small):
    for r in registry.QUERIES["g9_g10_samples"](spark, small).collect():
        for c, p, n in ((r.cx, r.px, r.width), (r.cy, r.py, r.height)):
            assert r.margin <= c <= n - r.margin and r.margin <= p <= n - r.margin and abs(c - p) <= 56
    pairs = spark.createDataFrame([(1, ["a"]), (2, ["a", "b", "c", "d"])], "key long, images array<string>")
    assert [r.chosen for r in grid.choose_positives(pairs, 3, False).orderBy("key").collect()] == [["a"] * 3, ["a", "b", "c"]]
    assert all(len(r.chosen) == 3 and set(r.chosen) <= set(r.images) for r in grid.choose_positives(pairs, 3, True).collect())


def test_tile_cover_over_the_antimeridian(spark):
    b = spark.createDataFrame([(1, 179.0, -1.0, -179.0, 1.0)], "key int, west double, south double, east double, north double")
    assert {r.x for r in grid.tile_cover(b, 4).collect()} == {15, 0}


def test_homography_is_found_among_outliers(spark):
    rng = np.random.default_rng(1)
    h = np.array([[1.1, 0.05, 3], [-0.02, 0.95, -4], [1e-4, 2e-4, 1]])
    src = rng.uniform(0, 200, (60, 2))
    p = np.c_[src, np.ones(60)] @ h.T
    dst = p[:, :2] / p[:, 2:]
    dst[:20] += rng.uniform(50, 100, (20, 2))
    rows = [(1, "t", *map(float, [*a, *b])) for a, b in zip(src, dst, strict=True)] + [(1, "few", 0.0, 0.0, 1.0, 1.0)]
    (r,) = metrics.fit_homography(spark.createDataFrame(rows, "frame_id long, tile string, x double, y double, u double, v double"), 3.0).collect()
    assert r.tile == "t" and r.inliers == 40 and np.allclose(np.reshape(r.h, (3, 3)), h, atol=1e-4)


def test_homography_of_a_large_group_is_fitted_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    h = np.array([[0.9, 0.02, 5], [0.01, 1.05, -2], [1e-4, -1e-4, 1]])
    src = rng.uniform(0, 200, (900, 2))
    p = np.c_[src, np.ones(900)] @ h.T
    dst = p[:, :2] / p[:, 2:]
    dst[::3] += rng.uniform(50, 100, (300, 2))
    monkeypatch.setattr(metrics, "POOL", 100)
    rows = spark.createDataFrame([(None, "t", *map(float, [*a, *b])) for a, b in zip(src, dst, strict=True)], "frame_id long, tile string, x double, y double, u double, v double")
    (r,) = metrics.fit_homography(rows, 3.0).collect()
    assert r.frame_id is None and r.inliers == 600 and np.allclose(np.reshape(r.h, (3, 3)), h, atol=1e-4)


def test_homographies_of_small_groups_meet_their_pairs_once(spark):
    rng = np.random.default_rng(5)
    h = np.array([[0.9, 0.02, 5], [0.01, 1.05, -2], [1e-4, -1e-4, 1]])
    rows, want = [], {}
    for k, n in enumerate([3, 4, 12, 12, 40, 80] * 3):
        src = rng.uniform(0, 200, (n, 2))
        p = np.c_[src, np.ones(n)] @ h.T
        dst = p[:, :2] / p[:, 2:]
        dst[: n // 5] += rng.uniform(50, 100, (n // 5, 2))
        rows += [(k, "t", *map(float, [*a, *b])) for a, b in zip(src, dst, strict=True)]
        want[k] = n - n // 5
    found = metrics.fit_homography(spark.createDataFrame(rows, "frame_id long, tile string, x double, y double, u double, v double"), 3.0)
    # what is left is to read the results
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    got = {r.frame_id: r for r in found.collect()}
    assert set(got) == {k for k, n in want.items() if n > 3}
    for k, r in got.items():
        assert r.inliers == want[k] and np.allclose(np.reshape(r.h, (3, 3)), h, atol=1e-4)


@pytest.mark.parametrize("ranked", [False, True])
def test_groups_fitted_together_have_the_models_of_each(ranked):
    rng = np.random.default_rng(6)
    for n in (4, 7, 30, 64):
        src = rng.uniform(0, 200, (20, n, 2))
        dst = src * 1.5 + 7 + rng.normal(0, 2, src.shape)
        dst[:, ::3] += rng.uniform(50, 100, dst[:, ::3].shape)
        src[0] = src[0, 0]
        models, inliers = metrics.ransac_stacked(src, dst, 3.0, 200, [np.random.default_rng(k) for k in range(20)], ranked)
        for k in range(20):
            one, some, _ = metrics.ransac(src[k], dst[k], 3.0, 200, np.random.default_rng(k), ranked)
            assert some == inliers[k] and (one is None or np.allclose(one, models[k]))


def test_homographies_leave_out_pairs_without_a_place(spark):
    rng = np.random.default_rng(2)
    src = rng.uniform(0, 200, (30, 2))
    rows = [(k % 2 or None, None, *map(float, [*a, *(a * 1.5 + 7)])) for k, a in enumerate(src)]
    rows += [(1, None, bad, 0.0, 0.0, 0.0) for bad in (None, float("nan"), float("inf"))]
    rows += [(9, "line", float(k), float(k), float(k), float(k)) for k in range(9)] + [(8, "same", 1.0, 1.0, 1.0, 1.0)] * 9
    df = spark.createDataFrame(rows, "frame_id long, tile string, x double, y double, u double, v double")
    got = {(r.frame_id, r.tile): r for r in metrics.fit_homography(df, 3.0).collect()}
    assert set(got) == {(None, None), (1, None)}
    for r in got.values():
        assert r.inliers == 15 and np.allclose(np.reshape(r.h, (3, 3)), [[1.5, 0, 7], [0, 1.5, 7], [0, 0, 1]], atol=1e-6)
    assert metrics.fit_homography(df.limit(0)).count() == 0


def test_sums_of_moments_equal_those_of_the_pairs(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(-5, 5, (20, 4))
    df = spark.createDataFrame(p.tolist(), "x double, y double, u double, v double")
    (r,) = df.agg(F.array(*metrics.moment_sums(*map(F.col, "xyuv"), F.col("x") > 0)).alias("m")).collect()
    p = p[p[:, 0] > 0]
    one = np.ones((len(p), 1))
    a = (np.hstack([p[:, :2], one])[:, :, None] * np.hstack([p[:, 2:], one])[:, None, :]).reshape(len(p), 9)
    want, got = a.T @ a, metrics.moment_matrix(np.array(r.m))
    needed = [(i, k) for i in range(9) for k in range(9) if {i % 3, k % 3} != {0, 1}]
    assert all(abs(want[i, k] - got[i, k]) < 1e-8 for i, k in needed)


@pytest.mark.parametrize("ranked", [False, True])
def test_trials_follow_the_share_of_inliers(ranked):
    h = np.array([[1.1, 0.05, 3], [-0.02, 0.95, -4], [1e-4, 2e-4, 1]])
    made = {}
    for good in (1.0, 0.7, 0.45):
        rng = np.random.default_rng(7)
        src = rng.uniform(0, 200, (400, 2))
        p = np.c_[src, np.ones(400)] @ h.T
        dst = p[:, :2] / p[:, 2:] + rng.normal(0, 0.1, (400, 2))
        out = 400 - int(400 * good)
        dst[400 - out :] = rng.uniform(0, 200, (out, 2))  # the last ones, as by quality
        model, inliers, trials = metrics.ransac(src, dst, 3.0, 2000, np.random.default_rng(1), ranked)
        assert abs(inliers - (400 - out)) <= 0.1 * 400 and inliers == metrics.near(model, src, dst, 3.0).sum()
        made[good] = trials
    assert made[1.0] == 32 and made[1.0] <= made[0.7] <= made[0.45] < 2000
    assert metrics.ransac(src[:3], dst[:3], 3.0, 100, np.random.default_rng(1))[0] is None
    assert metrics.ransac(src[:1].repeat(9, 0), dst[:1].repeat(9, 0), 3.0, 100, np.random.default_rng(1))[0] is None


def test_iterated_nms_finds_more(spark, small):
    g = fx.grid(spark, small)
    once, more = (keypoints.grid_nms(g, 2, k).where("is_max").count() for k in (0, 2))
    assert more > once


def test_align_labels_fails_on_a_remainder(spark):
    a = spark.range(5).withColumnRenamed("id", "i")
    with pytest.raises(ValueError):
        metrics.align_labels(a, spark.range(2).selectExpr("id as i", "id as label"))


def test_csv_sources(spark, tmp_path):
    flight = tmp_path / "flight.csv"
    flight.write_text("file,lat,lon,alt,yaw,pitch,roll\n a.jpg ,1,2,3,4,5,6\nb.jpg,x,2,3,4,5,6\na.jpg,9, 1.5 ,3,4,5,6\nc.jpg,,2,3,4,5,6\n")
    rows = io.read_flight_csv(spark, str(flight)).collect()
    assert [(r.file, r.lat, r.lon) for r in rows] == [("a.jpg", 9.0, 1.5)]
    assert io.read_flight_csv(spark, str(tmp_path / "none.csv")).count() == 0
    good = tmp_path / "imu.csv"
    good.write_text("timestamp,w_x,w_y,w_z,a_x,a_y,a_z\n5,1,2,3,4,5,6\n")
    assert io.read_imu_csv(spark, str(good)).first().ts_ns == 5
    good.with_name("bad.csv").write_text("timestamp,w_x,w_y,w_z,a_x,a_y,a_z\n5,1,2,oops,4,5,6\n")
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST|FAILED_READ"):
        io.read_imu_csv(spark, str(good.with_name("bad.csv"))).collect()


def test_assets_and_retries(spark, tmp_path):
    for name in ("b.tif", "a.tiff", "c.TIF", "d.png"):
        (tmp_path / name).write_text("x")
    found = lambda *a: [os.path.basename(r.path) for r in io.list_assets(spark, str(tmp_path), *a).collect()]
    assert found([".tif", ".tiff"]) == ["a.tiff", "b.tif"] and found(["tif"], True) == ["b.tif", "c.TIF"]
    res = spark.createDataFrame([(1, 2, 3, "u", "o", None, True), (4, 5, 6, "u", "o", "timeout", False)], "x int, y int, z int, url_template string, output_path string, error string, ok boolean")
    io.write_retries(res, str(tmp_path / "retry"))
    assert [r.x for r in spark.read.json(str(tmp_path / "retry")).collect()] == [4]


def test_vector_table(spark, tmp_path):
    t = io.VectorTable.create(spark, str(tmp_path / "points"), 2)
    row = lambda i, x, src: (i, [x, 0.0], (1.0, 2.0), 0, 0, src, [0.5, 0.5])
    make = lambda rows: spark.createDataFrame(rows, io.POINTS)
    t.upsert(make([row("a", 1.0, "r"), row("b", 2.0, "r"), row("c", 3.0, "s")]))
    t.upsert(make([row("a", 9.0, "r"), row("d", 4.0, "s")]))
    t.upsert(make([]))
    t = io.VectorTable.create(spark, str(tmp_path / "points"), 2)
    assert {(r.id, r.vector[0], r.src) for r in t.read().collect()} == {("a", 9.0, "r"), ("b", 2.0, "r"), ("c", 3.0, "s"), ("d", 4.0, "s")}
    with pytest.raises(ValueError):
        t.upsert(make([("e", [1.0], (1.0, 2.0), 0, 0, "r", [0.5])]))
    # a raster is emptied, and of an id that repeats the last row stays
    t.upsert(make([row("c", 5.0, "r"), row("d", 6.0, "q/1"), row("d", 7.0, "q/1")]).coalesce(1))
    assert {(r.id, r.vector[0], r.src) for r in t.read().collect()} == {("a", 9.0, "r"), ("b", 2.0, "r"), ("c", 5.0, "r"), ("d", 7.0, "q/1")}


def test_evaluation_without_queries_fails_and_small_galleries_repeat(spark):
    hit = spark.createDataFrame([(1, 1), (2, None), (3, 2)], "query_id long, first_hit int")
    assert tuple(metrics.cumulative_hits(hit, 5).first())[:5] == (33.333333, 66.666667, 66.666667, 66.666667, 66.666667)
    with pytest.raises(Exception, match="no queries to evaluate"):
        metrics.cumulative_hits(hit.limit(0), 5).collect()


def test_elements_at_ranks(spark):
    rng = np.random.default_rng(5)
    x = np.r_[rng.lognormal(0, 4, 3000), np.full(2000, 7.0), -1e12, 1e12]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(5)
    ranks = [0, 1, 2500, 3000, 4999, 5001]
    assert metrics.elements_at(df, "x", ranks, few=50, buckets=16) == {r: float(np.sort(x)[r]) for r in ranks}


def test_elements_among_odd_numbers(spark):
    rng = np.random.default_rng(6)
    x = np.r_[rng.normal(size=4000), [np.nan] * 20, [np.inf] * 15, [-np.inf] * 10, 1.7e308, -1.7e308, 5e-324, 0.0]
    df = spark.createDataFrame([(float(v),) for v in rng.permutation(x)] + [(None,)], "x double").repartition(5)
    ranks = [0, 9, 10, 11, 2000, 4012, 4013, 4014, 4028, 4029, 4048]
    got = metrics.elements_at(df, "x", ranks, few=50, buckets=16)
    assert all(np.array_equal(got[r], np.sort(x)[r], equal_nan=True) for r in ranks)
    for only in (float("nan"), float("inf"), float("-inf")):
        assert np.array_equal(metrics.elements_at(df.limit(1).select(F.lit(only).alias("x")), "x", [0])[0], only, equal_nan=True)


def test_ingest_in_one_job(spark):
    affine = {"a": 1e-5, "b": 0.0, "c": 114.5, "d": 0.0, "e": -1e-5, "f": 37.9, "epsg": 4326}
    r = spark.createDataFrame([("s", 600, 512), ("t", 512, 512)], "src string, width int, height int").withColumns({k: F.lit(v) for k, v in affine.items()})
    px = spark.createDataFrame([("s", 0, 0, [1.0, 2.0]), ("t", 0, 0, [0.0, 0.0])], "src string, x int, y int, data array<double>")
    load = lambda: lambda rows: np.array([[sum(x), 1.0, 0.0] for x in rows])
    (got,) = localization.ingest(r, px, load, 3, 512, 0.5).collect()
    assert got.id == "s_0_0" and abs(got.location.lon - (114.5 + 256.5e-5)) < 1e-9 and np.allclose(got.vector, np.array([3, 1, 0]) / np.sqrt(10))
    with pytest.raises(Exception, match="numbers"):
        localization.ingest(r, px, load, 4, 512, 0.5).collect()


def test_config_errors(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": "x"}', '{"a": 2, "b": "x"}'), (2, '{"a": 1}', '{"a": 1}')], "id int, saved string, current string")
    rows = diffs.config_errors(diffs.config_diff(df, ["a", "b"])).collect()
    assert len(rows) == 1 and "a" in str(rows[0]) and "b:" not in str(rows[0])


def test_bilinear_sample_needs_all_four_corners(spark):
    places = [(x, y) for x in range(3) for y in range(3) if (x, y) != (2, 2)]
    g = spark.createDataFrame([(1, x, y, [1.0 + x, 2.0 + y]) for x, y in places], "img_id long, gx long, gy long, vector array<double>")
    # a corner that is missing counts where its weight is 0 too
    p = spark.createDataFrame([(1, 10, 0.5, 0.5), (1, 11, 1.5, 1.5), (1, 12, 1.0, 1.0), (1, 13, 2.0, 0.0), (2, 14, 0.0, 0.0)], "img_id long, point_id long, x double, y double")
    got = {r.point_id: r.vector for r in joins.bilinear_sample(g, p, 3, 3, 3, 3).collect()}
    assert set(got) == {10, 13}
    assert np.allclose(got[10], np.array([1.5, 2.5]) / np.hypot(1.5, 2.5)) and np.allclose(got[13], np.array([3, 2]) / np.hypot(3, 2))


def test_bilinear_sample_deals_no_vector_for_a_point(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(2, 3, 4, 5)).astype(np.float32)
    g = spark.createDataFrame([(i, x, y, v[i, y, x].tolist()) for i in range(2) for y in range(3) for x in range(4)] + [(0, 4, 0, [1.0] * 5), (0, -1, 0, [1.0] * 5)], "img_id long, gx long, gy long, vector array<float>")
    at = [(int(i), k, float(x), float(y)) for k, (i, x, y) in enumerate(zip(rng.integers(0, 2, 300), rng.uniform(-2, 12, 300), rng.uniform(-2, 8, 300)))]
    at += [(0, 300, 9.0, 6.0), (1, 301, 3.0, 3.0), (1, 301, 3.0, 3.0)]
    out = joins.bilinear_sample(g, spark.createDataFrame(at, "img_id long, point_id long, x double, y double"), 10, 7, 4, 3)
    want = {}
    for i, k, x, y in at:
        x, y = np.clip(x / 9 * 3, 0, 3), np.clip(y / 6 * 2, 0, 2)
        x0, y0 = int(x), int(y)
        x1, y1, fx, fy = min(x0 + 1, 3), min(y0 + 1, 2), x - x0, y - y0
        w = v[i, y0, x0].astype(float) * (1 - fx) * (1 - fy) + v[i, y0, x1] * fx * (1 - fy) + v[i, y1, x0] * (1 - fx) * fy + v[i, y1, x1] * fx * fy
        want[k] = w / np.linalg.norm(w)
    got = out.collect()
    assert sorted(r.point_id for r in got) == sorted(k for _, k, _, _ in at)  # equal points too, each its row
    assert all(np.allclose(r.vector, want[r.point_id]) for r in got)
    # nothing is gathered by point: points meet cells, which hold all four corners, in one join
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" not in plan and "Generate" not in plan
