"""Long streams in many segments give what one pass over each stream gives."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from geomatch.operators import imu, joins, keypoints

AXES = ["w_x", "w_y", "w_z", "a_x", "a_y", "a_z"]


def samples(seed, sizes):
    rng = np.random.default_rng(seed)
    out = []
    for window, n in enumerate(sizes):
        at = np.cumsum(rng.integers(1_000_000, 9_000_000, n))
        out += [("s", window, int(t), *map(float, np.r_[rng.normal(0, 0.5, 3), rng.normal(0, 3, 3)])) for t in at]
    return out


def test_a_window_in_many_tasks_folds_as_the_walk(spark, monkeypatch):
    monkeypatch.setattr(imu, "FAN", 3)
    rows = samples(1, [700, 1, 2, 40, 0, 9])
    df = spark.createDataFrame(rows, "stream_id string, window_id long, ts_ns long, " + ", ".join(f"{c} double" for c in AXES)).repartition(5)
    walked = imu.preintegrate(keypoints.with_dt(df), (0.01, 0.0, 0.02), (0.0, 0.003, 0.0))
    parted = keypoints.with_dt(df, segments=True, rows=10)
    assert 20 < parted.where("window_id = 0").select("segment").distinct().count()
    for tree in (imu.preintegrate(parted, (0.01, 0.0, 0.02), (0.0, 0.003, 0.0)), imu.preintegrate(keypoints.with_dt(df), (0.01, 0.0, 0.02), (0.0, 0.003, 0.0), rows=7)):
        want = {r.window_id: r for r in walked.collect()}
        got = {r.window_id: r for r in tree.collect()}
        assert set(want) == set(got) == {0, 2, 3, 5}
        for k, w in want.items():
            for c in walked.columns:
                a, b = got[k][c], w[c]
                assert np.allclose(a, b, rtol=1e-9, atol=1e-9) if isinstance(b, (list, float)) else a == b, (k, c)


def test_combine_is_associative_and_has_a_zero():
    rng = np.random.default_rng(2)

    def fold(n):
        f = imu.Fold(1)
        for _ in range(n):
            f.add(rng.normal(0, 3, (1, 3)), rng.normal(0, 1, (1, 3)), rng.uniform(0.001, 0.01, 1))
        return {"dt": f.dt, "samples": np.array([n]), "q": imu.quaternion(f.r), "cov": f.cov} | {k: getattr(f, k) for k in imu.VECTORS} | f.j

    a, b, c, none = fold(30), fold(20), fold(50), fold(0)
    left, right = imu.combine(imu.combine(a, b), c), imu.combine(a, imu.combine(b, c))
    for k in left:
        assert np.allclose(left[k], right[k], rtol=1e-10, atol=1e-12)
        assert np.allclose(imu.combine(a, none)[k], a[k]) and np.allclose(imu.combine(none, a)[k], a[k])


@pytest.mark.parametrize("rows", [None, 8])
def test_steps_and_truth_across_segments(spark, rows):
    rng = np.random.default_rng(3)
    at = sorted(rng.choice(5000, 300, replace=False).tolist())
    track = [(s, int(t), *map(float, rng.normal(size=3))) for s in ("hot", None) for t in at] + [("one", 5, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(track, "session_id string, ts_ns long, ecef_x double, ecef_y double, ecef_z double").repartition(4)
    got = {(r.session_id, r.ts_ns): r.step_m for r in keypoints.step_distance(df, rows).collect()}
    assert len(got) == len(track)
    for a, b in zip([None, *track], track):
        first = a is None or a[0] != b[0]
        step = got[b[0], b[1]]
        assert step is None if first else abs(step - float(np.linalg.norm(np.subtract(a[2:], b[2:])))) < 1e-9

    truth = [("hot", int(t), float(t)) for t in at[::40]] + [("one", 1, 1.0)]
    windows = [("hot", k, int(t)) for k, t in enumerate(range(0, 5200, 37))] + [("one", 0, 2), ("two", 0, 0)]
    found = joins.asof_forward(spark.createDataFrame(windows, "stream_id string, window_id long, start_ns long"), spark.createDataFrame(truth, "stream_id string, ts_ns long, v double"), 3, rows)
    got = {(r.stream_id, r.window_id): r.truth and r.truth.ts_ns for r in found.collect()}
    assert len(got) == len(windows)
    for s, k, start in windows:
        assert got[s, k] == min((t for q, t, _ in truth if q == s and t >= start + 3), default=None)
    assert found.select(F.col("truth.v")).count() == len(windows)
