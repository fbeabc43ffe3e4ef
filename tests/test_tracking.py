"""The tracker's transitions, and stream against batch."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from geomatch.plans import fixtures as fx
from geomatch.sources import io
from geomatch.streaming import model as m
from geomatch.streaming import newest, tracker


def at(x, inliers=50):
    return {"ecef_x": float(x), "ecef_y": 0.0, "ecef_z": 0.0, "inliers": inliers}


def run(session, xs, config=m.Config()):
    out = None
    for x in xs:
        out = session.frame("ok", [at(v) for v in (x if isinstance(x, list) else [x])], config)
    return out


def test_a_track_matures_and_reports():
    s = m.Session()
    assert run(s, [0])["reason"] == "No trajectories in Tracking state (Initializing: 1, Lost: 0)"
    assert s.tracks[0].health == 15 and s.tracks[0].hits == 1
    run(s, [1])
    assert s.tracks[0].state == m.INITIALIZING
    assert run(s, [2])["status"] == "location"
    assert s.tracks[0].state == m.TRACKING and s.tracks[0].span == 2 and s.tracks[0].health == 17 and s.tracks[0].inliers == 150


def test_hover_keeps_the_anchor():
    s = m.Session()
    got = run(s, [0, 0.3, 0.4])
    t = s.tracks[0]
    assert t.anchor == [0, 0, 0] and t.last["ecef_x"] == 0.4 and t.inliers == 50 and t.span == 0
    assert got["reason"] == "Insufficient spatial span: max current span is 0.00m, required 2.00m"


def test_misses_lose_and_kill():
    s = m.Session()
    run(s, [0])
    assert run(s, [[]])["reason"] == "No active trajectories available in estimator"
    run(s, [0, 1, 2, []])
    assert s.tracks[0].state == m.LOST
    run(s, [3])
    assert s.tracks[0].state == m.TRACKING and s.tracks[0].failures == 0
    run(s, [[]] * 4)
    assert s.tracks[0].state == m.LOST
    run(s, [[]])
    assert not s.tracks


def test_bypass_ages_nothing_and_far_points_open_tracks():
    s = m.Session()
    run(s, [0, 1, 2])
    before = s.dump()
    assert s.frame("error", [], m.Config())["status"] == "error"
    assert s.frame("uncertain", [], m.Config())["status"] == "uncertain"
    assert s.dump() == before
    run(s, [[3, 100]])
    assert [t.state for t in s.tracks] == [m.TRACKING, m.INITIALIZING]


def test_assignment_is_greedy_in_order_and_strict():
    a, b = m.Track(at(0), [0, 0, 0], 1), m.Track(at(1), [1, 0, 0], 1)
    assert m.assign([a, b], [at(0.9), at(0.1)], 15.0) == {0: 1, 1: 0}
    assert m.assign([a, b], [at(0.9)], 15.0) == {0: 0}
    assert m.assign([a], [at(15 - 10 / 51)], 15.0) == {}
    assert m.assign([a], [at(1), at(-1)], 15.0) == {0: 0}


def test_the_last_of_equal_tracks_wins():
    tracks = [m.Track(at(k), [k, 0, 0], 10, m.TRACKING, span=3.0) for k in range(3)]
    assert m.decide(tracks, m.Config())["point"]["ecef_x"] == 2
    assert [p["ecef_x"] for p in m.merge_near([at(0), at(0.1), at(0.2), at(0.3)], 0.2)] == [0, 0.2]


def test_feedback_sets_the_prior():
    s = m.Session()
    for x in (0, 1, 2):
        s.frame("ok", [at(x)], m.Config(), feedback=True)
    assert s.prior is not None and s.frame("ok", [at(3)], m.Config(), True)["mode"] == "crop"
    s.frame("error", [], m.Config(), True)
    assert s.prior is None


@pytest.mark.parametrize("parts", [3])
def test_stream_equals_batch(spark, small, tmp_path, parts):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    frames = fx.frames(spark, small).where("session_id < 4")
    last = frames.orderBy("ts").tail(1)[0].ts
    flush = spark.createDataFrame([(k, last + dt.timedelta(days=300 + k), 0, "error", []) for k in range(2)], frames.schema)
    # shuffled within files; the flush rows come last
    for k in range(parts):
        frames.where(f"pmod(hash(seq), {parts}) = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for k in range(2):
        flush.where(f"session_id = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = tracker.track_stream(stream, delay="100 days").writeStream.format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    key = lambda r: (r.session_id, r.seq, r.ts)
    got = sorted((r for r in spark.table("tracked").collect() if r.ts <= last), key=key)
    want = sorted(tracker.track(frames).collect(), key=key)
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_null_session_is_one_session(spark, small):
    frames = fx.frames(spark, small).where("session_id = 3")
    named, nameless = (sorted((r.seq, r.status, r.tracks) for r in tracker.track(f).collect()) for f in (frames, frames.withColumn("session_id", F.lit(None).cast("long"))))
    assert named == nameless and any(s == "location" for _, s, _ in named)


def test_latest_frame_of_a_stream(spark, small, tmp_path):
    e = fx.table(spark, small, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = io.latest_frame(stream, "user_id", "ts").writeStream.format("memory").queryName("latest").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(spark.table("latest")) == rows(io.latest_frame(e, "user_id", "ts"))


def streamed(spark, df, name, tmp_path, start, **options):
    """The rows of a stream over the files of a folder, one a micro-batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    q = start(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True)
    for k, v in options.items():
        q = getattr(q, k)(v)
    q = q.start()
    try:
        assert q.awaitTermination(100)
    finally:
        q.stop()
    return spark.table(name).collect()


def test_newest_frame_across_micro_batches(spark, small, tmp_path):
    e = fx.table(spark, small, "events").select(F.when(F.col("user_id") != 3, F.col("user_id")).alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type", F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("value"))
    e = e.where("user_id is null or user_id < 12")
    e = e.where("user_id is null or user_id < 5")
    e = e.unionByName(e)
    # newer frames come first, older and equal ones after
    for part in (e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), e.where("ts < timestamp '2024-01-10'")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "newest"))
    # by the clock there is always another batch to run, but for this
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        rows = streamed(spark, e, "newest", tmp_path, lambda s: newest.newest_frames(s, "user_id", ttl_seconds=3600), outputMode="update")
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    last = {}
    for r in rows:
        assert r.user_id not in last or (r.ts, r.event_id) > (last[r.user_id].ts, last[r.user_id].event_id)
        last[r.user_id] = r
    assert sorted(map(str, last.values())) == sorted(map(str, io.latest_frame(e, "user_id", "ts").select(*e.columns).collect()))


def test_a_stream_goes_on_from_a_snapshot(spark, small, tmp_path):
    frames = fx.frames(spark, small).where("session_id < 5").withColumn("session_id", F.when(F.col("session_id") != 2, F.col("session_id")))
    some = sorted(r.ts for r in frames.select("ts").collect())
    middle, last = some[len(some) // 2], some[-1]
    before, after = frames.where(F.col("ts") <= middle), frames.where(F.col("ts") > middle)
    key = lambda r: (r.session_id or -1, r.ts, r.seq)
    want = sorted((tuple(r) for r in tracker.track(frames, feedback=True).collect() if r.ts > middle), key=lambda r: (r[0] or -1, r[1], r[2]))
    tracker.states(before, feedback=True).write.parquet(str(tmp_path / "state"))
    snapshot = spark.read.parquet(str(tmp_path / "state"))
    assert sorted(map(tuple, tracker.track(after, feedback=True, initial=snapshot).collect()), key=lambda r: (r[0] or -1, r[1], r[2])) == want
    whole = lambda df: sorted(map(str, df.collect()))
    assert whole(tracker.states(after, feedback=True, initial=snapshot)) == whole(tracker.states(frames, feedback=True))

    end = [(0, last + dt.timedelta(days=300 + k), k, "error", []) for k in range(2)] + [(0, middle, 9, "error", [])]
    after.coalesce(1).write.mode("append").parquet(str(tmp_path / "resumed"))
    for row in end:
        spark.createDataFrame([row], frames.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "resumed"))
    rows = streamed(spark, frames, "resumed", tmp_path, lambda s: tracker.track_stream(s, "100 days", feedback=True, initial=snapshot, idle_seconds=86400 * 90))
    got = sorted((r for r in rows if r.ts <= last and r.status not in ("late", "closed")), key=key)
    assert [tuple(r) for r in got] == want
    # a late frame changes nothing, whether Spark drops it or it is told
    assert all(r.status == "late" for r in rows if (r.seq, r.ts) == (9, middle))
    closed = [r for r in rows if r.status == "closed"]
    assert {r.session_id for r in closed} >= {1, 3, 4, None} and all(r.reason == "Late frames: 0" for r in closed)


def plain_model(frames, feedback):
    """One session's results by the rules as written down, for frames of one observation at most; dictionaries and loops only."""
    tracks, prior, out = [], False, []
    for f in frames:
        mode = "crop" if prior else "retrieve"
        if f.status == "error":
            prior = False
            out.append((f.seq, "error", None, mode, len(tracks)))
            continue
        p = f.points[0]
        xyz = (p.ecef_x, p.ecef_y, p.ecef_z)
        far = lambda t: sum((a - b) ** 2 for a, b in zip(xyz, t["at"], strict=True)) ** 0.5
        mine = next((t for t in tracks if far(t) + 10 / (p.inliers + 1) < 15), None)
        for t in tracks:
            if t is mine:
                d = far(t)
                t.update(fail=0, hits=t["hits"] + 1, health=min(20, t["health"] + 1), lat=p.lat)
                if d >= 0.5:
                    t.update(at=xyz, inliers=t["inliers"] + p.inliers, span=t["span"] + d)
                if t["state"] == "L" or t["state"] == "I" and t["hits"] >= 3:
                    t["state"] = "T"
            else:
                t.update(fail=t["fail"] + 1, hits=0, health=t["health"] - 3)
                t["state"] = {"T": "L", "I": "D"}.get(t["state"], "D" if t["fail"] > 5 or t["health"] <= 0 else "L")
        if mine is None:
            tracks.append({"at": xyz, "fail": 0, "hits": 1, "health": 15, "lat": p.lat, "inliers": p.inliers, "span": 0.0, "state": "I"})
        tracks = [t for t in tracks if t["state"] != "D"]
        best = None
        for t in tracks:
            if t["state"] == "T" and t["span"] >= 2 and (best is None or (t["inliers"], t["span"]) >= (best["inliers"], best["span"])):
                best = t
        prior = prior or (feedback and best is not None)
        out.append((f.seq, "location" if best else "uncertain", best and best["lat"], mode, len(tracks)))
    return out


@pytest.mark.parametrize("feedback", [False, True])
def test_tracks_equal_a_plain_model(spark, small, feedback):
    sessions = {}
    for f in fx.frames(spark, small).orderBy("session_id", "ts", "seq").collect():
        sessions.setdefault(f.session_id, []).append(f)
    want = sorted((s, *r) for s, fs in sessions.items() for r in plain_model(fs, feedback))
    got = sorted((r.session_id, r.seq, r.status, r.lat, r.mode, r.tracks) for r in tracker.track(fx.frames(spark, small), feedback=feedback).collect())
    assert got == want and {r[2] for r in got} == {"location", "uncertain", "error"}


def test_newest_frame_is_kept_by_rows_without_a_frame_a_key():
    class State:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    p = newest.NewestProcessor(["ts", "seq"], None, None)
    p.newest = State()
    rows = lambda *pairs: iter([Row(_key=1, ts=t, seq=s) for t, s in pairs])
    assert list(p.handleInputRows((1,), rows((5, 1), (None, 9), (5, 3)), None)) == [Row(_key=1, ts=5, seq=3)]
    assert list(p.handleInputRows((1,), rows((5, 3), (4, 9), (5, None)), None)) == []
    assert list(p.handleInputRows((1,), rows((6, float("nan"))), None)) == [Row(_key=1, ts=6, seq=None)]
