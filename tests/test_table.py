"""Versions of a vector table, and its places on the curve."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from geomatch.functions import curve, geo
from geomatch.operators import localization
from geomatch.sources import files, table


def rows(spark, ids, x=0.0, src="r"):
    return spark.createDataFrame([(str(i), [x, 1.0], (114.0 + 0.001 * int(i), 30.0), 0, 0, src, [0.5]) for i in ids], table.POINTS)


def state(t, version=None):
    return {r.id: r.vector[0] for r in t.read(version).collect()}


def test_versions_tombstones_and_compaction(spark, tmp_path):
    t = table.VectorTable.create(spark, str(tmp_path / "t"), 2)
    assert t.read().count() == 0 and t.version() == 0
    t.upsert(rows(spark, range(50)))
    t.upsert(rows(spark, range(40, 60), 1.0))
    t.delete(rows(spark, [0, 45]).select("id"))
    t.upsert(rows(spark, [45], 2.0))
    want = {str(i): 0.0 for i in range(1, 40)} | {str(i): 1.0 for i in range(40, 60)} | {"45": 2.0}
    assert state(t) == want and state(t, 1) == {str(i): 0.0 for i in range(50)} and len(state(t, 3)) == 58
    before = t.manifest()
    t.compact()
    after = t.manifest()
    assert state(t) == want and after["gone"] == [] and state(t, 1) == {str(i): 0.0 for i in range(50)}
    # only files with dead rows are written anew
    old = {f["name"] for s in before["segments"] for f in s["files"]}
    kept = old & {f["name"] for s in after["segments"] for f in s["files"]}
    assert kept and sum(f["rows"] for s in after["segments"] for f in s["files"]) == 59
    assert t.compact() == t.version()
    t.upsert(rows(spark, [3], 4.0))
    t.vacuum(keep=1, age_s=0)
    assert state(t) == want | {"3": 4.0} and len(files.listed(spark, str(tmp_path / "t" / "versions"))) == 1
    with pytest.raises(Exception, match="FileNotFound|PATH_NOT_FOUND|does not exist"):
        t.read(1)
    assert table.VectorTable.create(spark, str(tmp_path / "t"), 2).version() == t.version()
    with pytest.raises(ValueError):
        table.VectorTable.create(spark, str(tmp_path / "t"), 3)


@pytest.mark.parametrize("step", ["_stage", "_files", "_bury", "write_new"])
@pytest.mark.parametrize("work", ["upsert", "delete", "compact"])
def test_a_job_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch, step, work):
    t = table.VectorTable.create(spark, str(tmp_path / "t"), 2)
    t.upsert(rows(spark, range(6)))
    t.upsert(rows(spark, [1, 2], 1.0))
    old, version = state(t), t.version()
    run = {"upsert": lambda: t.upsert(rows(spark, [1, 9], 7.0)), "delete": lambda: t.delete(rows(spark, [1]).select("id")), "compact": t.compact}[work]
    if (work, step) in {("delete", "_stage"), ("delete", "_files"), ("compact", "_bury")}:
        pytest.skip("no such step")

    class Killed(Exception):
        pass

    where = files if step == "write_new" else table.VectorTable
    whole = getattr(where, step)

    def dies(*a, **b):
        if step != "write_new":
            whole(*a, **b)  # all is written, but nothing follows
        raise Killed

    monkeypatch.setattr(where, step, dies)
    with pytest.raises(Killed):
        run()
    assert state(t) == old and t.version() == version
    monkeypatch.setattr(where, step, whole)
    run()
    new = {"upsert": old | {"1": 7.0, "9": 7.0}, "delete": {k: v for k, v in old.items() if k != "1"}, "compact": old}[work]
    assert state(t) == new and t.version() == version + 1


def test_two_writers_at_once(spark, tmp_path, monkeypatch):
    t = table.VectorTable.create(spark, str(tmp_path / "t"), 2)
    t.upsert(rows(spark, range(4)))
    other, whole, once = table.VectorTable(spark, t.path, 2), files.write_new, []

    def late(s, path, text):
        if not once:
            once.append(1)
            other.upsert(rows(spark, [1, 5], 1.0))
        return whole(s, path, text)

    monkeypatch.setattr(files, "write_new", late)
    t.upsert(rows(spark, [1, 6], 2.0))
    assert state(t) == {"0": 0.0, "1": 2.0, "2": 0.0, "3": 0.0, "5": 1.0, "6": 2.0} and t.version() == 3
    once.clear()
    t.compact()  # a write comes in between and stays younger than what was compacted
    assert state(t) == {"0": 0.0, "1": 1.0, "2": 0.0, "3": 0.0, "5": 1.0, "6": 2.0}


def test_a_stream_writes_each_batch_once(spark, tmp_path):
    t = table.VectorTable.create(spark, str(tmp_path / "t"), 2)
    for k in range(3):
        rows(spark, [k, k + 1], float(k)).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    source = spark.readStream.schema(table.POINTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    source.writeStream.foreachBatch(t.sink("s")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got, version = state(t), t.version()
    assert set(got) == {"0", "1", "2", "3"} and t.manifest()["writers"] == {"s": 2}
    t.sink("s")(rows(spark, [77], 9.0), 2)  # delivered again
    assert state(t) == got and t.version() == version
    t.sink("s")(rows(spark, []), 3)
    assert state(t) == got and t.manifest()["writers"] == {"s": 3}


def test_ingest_ends_in_a_table(spark, tmp_path):
    affine = {"a": 1e-5, "b": 0.0, "c": 114.5, "d": 0.0, "e": -1e-5, "f": 37.9, "epsg": 4326}
    r = spark.createDataFrame([("s", 600, 512)], "src string, width int, height int").withColumns({k: F.lit(v) for k, v in affine.items()})
    px = spark.createDataFrame([("s", 0, 0, [1.0, 2.0])], "src string, x int, y int, data array<double>")
    load = lambda: lambda data: __import__("numpy").array([[sum(x), 1.0] for x in data])
    t = table.VectorTable.create(spark, str(tmp_path / "t"), 2)
    for _ in range(2):
        assert localization.ingest_into(t, r, px, load, 512, 0.5, "job", 1) == 1
    (got,) = t.read_within(114.5, 37.9, 2000.0).collect()
    assert got.id == "s_0_0"


def test_circles_read_few_files(spark, tmp_path):
    rng = random.Random(2)
    places = [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(2000)] + [(114.0 + rng.gauss(0, 0.02), 30.0 + rng.gauss(0, 0.02)) for _ in range(500)] + [(179.999, 10.0), (-179.999, 10.0), (0.0, 89.9999), (90.0, 90.0), (180.0, -90.0)]
    df = spark.createDataFrame([(str(k), [0.0, 1.0], p, 0, 0, "r", [0.5]) for k, p in enumerate(places)] + [("none", [0.0, 0.0], None, 0, 0, "r", [0.5])], table.POINTS)
    t = table.VectorTable.create(spark, str(tmp_path / "t"), 2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        t.upsert(df)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    total = len(t.manifest()["segments"][0]["files"])
    for lon, lat, radius in [(114.0, 30.0, 2000.0), (180.0, 10.0, 1000.0), (0.0, 90.0, 50_000.0), (10.0, 10.0, 3e6), (0.0, 0.0, 3e7), (114.0, 30.0, 0.0)]:
        got = t.read_within(lon, lat, radius)
        want = df.where(geo.haversine(F.lit(lon), F.lit(lat), F.col("location.lon"), F.col("location.lat")) <= radius)
        assert {r.id for r in got.collect()} == {r.id for r in want.where("location is not null").collect()}
    near = t.read_within(114.0, 30.0, 2000.0)
    plan = near._jdf.queryExecution().toString()
    assert 0 < len(near.inputFiles()) < total / 2 and "PushedFilters: [Or(" in plan
    assert t.read().where("id = 'none'").count() == 1


def test_ranges_cover_their_circle():
    rng = random.Random(4)
    for _ in range(200):
        lon, lat, r = rng.uniform(-180, 180), rng.uniform(-89, 89), 10 ** rng.uniform(0, 6)
        some = curve.ranges(lon, lat, r, 32)
        assert some == sorted(some) and all(a <= b for a, b in some) and len(some) <= 130
        assert all(b < c for (_, b), (c, _) in zip(some, some[1:]))
