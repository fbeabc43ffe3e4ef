"""Pre-integration against numerical and random checks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from geomatch.operators import imu, keypoints
from geomatch.plans import fixtures as fx


def samples(n=100, seed=0):
    rng = np.random.default_rng(seed)
    t = np.arange(n) * 0.005
    gyro = np.c_[0.3 * np.sin(t * 5), 0.2 * np.cos(t * 3), 0.1 + 0 * t]
    acc = np.c_[np.sin(t * 4), 0.5 + 0 * t, 9.81 + rng.normal(0, 0.1, n)]
    return acc, gyro


def fold(acc, gyro, m=1, **kw):
    f = imu.Fold(m, **kw)
    for k in range(acc.shape[-2]):
        f.add(np.broadcast_to(acc[..., k, :], (m, 3)), np.broadcast_to(gyro[..., k, :], (m, 3)), np.full(m, 0.005))
    return f


def angle(r):
    return np.degrees(np.arccos(np.clip((np.trace(r) - 1) / 2, -1, 1)))


def test_jacobians_predict_small_bias_changes():
    acc, gyro = samples()
    d = np.full(3, 0.01)
    a, b = fold(acc, gyro), fold(acc, gyro, acc_bias=d, gyro_bias=d)
    p = a.p[0] + a.j["p_ba"][0] @ d + a.j["p_bg"][0] @ d
    v = a.v[0] + a.j["v_ba"][0] @ d + a.j["v_bg"][0] @ d
    r = a.r[0] @ imu.rotation(a.j["r_bg"][0] @ d)
    assert np.linalg.norm(b.p[0] - p) < 1e-3 and np.linalg.norm(b.v[0] - v) < 1e-2 and angle(b.r[0].T @ r) < 1e-2


def test_covariance_matches_random_runs():
    acc, gyro = samples(60)
    rng = np.random.default_rng(42)
    noise = imu.Noise(0.08, 0.004, 0, 0)
    m = 1000
    runs = fold(acc + rng.normal(0, noise.acc, (m, 60, 3)), gyro + rng.normal(0, noise.gyro, (m, 60, 3)), m, noise=noise)
    clean = fold(acc, gyro, noise=noise)
    assert np.allclose(clean.cov[0], clean.cov[0].T)
    for got, lo in ((runs.v.var(0), 3), (runs.p.var(0), 6)):
        ratio = got / np.diag(clean.cov[0])[lo : lo + 3]
        assert (ratio > 0.5).all() and (ratio < 2).all()


def test_table_equals_the_fold_and_corrections(spark, small):
    one = fx.imu(spark, small).where("stream_id < 3").withColumn("window_id", F.floor(F.col("ts_ns") / 50_000_000))
    rows = keypoints.with_dt(one)
    got = {(r.stream_id, r.window_id): r for r in imu.predict_pose(imu.bias_correct(imu.preintegrate(rows), F.array(*[F.lit(0.01)] * 3), F.array(*[F.lit(0.01)] * 3)).withColumns({"p0": F.array(*[F.lit(0.0)] * 3), "v0": F.array(*[F.lit(0.0)] * 3), "q0": F.array(F.lit(1.0), *[F.lit(0.0)] * 3), "p1": F.col("p"), "v1": F.col("v"), "q1": F.col("q")})).collect()}
    want = rows.toPandas().sort_values("ts_ns")
    assert len(got) == len(want.groupby(["stream_id", "window_id"]))
    for key, pdf in want.groupby(["stream_id", "window_id"]):
        f, g = imu.Fold(), imu.Fold(acc_bias=np.full(3, 0.01), gyro_bias=np.full(3, 0.01))
        for x in pdf.itertuples():
            for y in (f, g):
                y.add(np.array([x.a_x, x.a_y, x.a_z]), np.array([x.w_x, x.w_y, x.w_z]), x.dt)
        r = got[key]
        assert np.allclose(r.p, f.p[0]) and np.allclose(r.cov, f.cov[0].ravel()) and r.samples == len(pdf)
        assert abs(np.linalg.norm(r.q) - 1) < 1e-9 and np.allclose(r.p_corrected, g.p[0], atol=1e-4)
        assert abs(r.r_error) < 1e-5 and abs(r.p_error - 9.81 * r.dt**2 / 2) < 1e-9


def test_small_angles_and_quaternions():
    v = np.random.default_rng(1).normal(size=(50, 3))
    assert np.allclose(imu.matrix(imu.quaternion(imu.rotation(v))), imu.rotation(v))
    assert np.allclose(imu.right_jacobian(np.full((1, 3), 1e-6))[0], np.eye(3))


def test_bias_correction_is_a_new_integration(spark):
    """Against a plain loop over rotation matrices with the biases taken off first."""
    acc, gyro = samples(40)
    rows = [(1, 1, int(k * 5e6), 0.005, *map(float, gyro[k]), *map(float, acc[k])) for k in range(40)]
    df = spark.createDataFrame(rows, "stream_id long, window_id long, ts_ns long, dt double, w_x double, w_y double, w_z double, a_x double, a_y double, a_z double")
    d = 1e-3
    got = imu.bias_correct(imu.preintegrate(df), F.array(*[F.lit(d)] * 3), F.array(*[F.lit(d)] * 3)).first()
    p, v, r = np.zeros(3), np.zeros(3), np.eye(3)
    for a, w in zip(acc - d, gyro - d, strict=True):
        p, v = p + v * 0.005 + r @ a * 0.005**2 / 2, v + r @ a * 0.005
        angle = np.linalg.norm(w) * 0.005
        n = w / np.linalg.norm(w)
        k = np.array([[0, -n[2], n[1]], [n[2], 0, -n[0]], [-n[1], n[0], 0]])
        r = r @ (np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k)
    assert np.allclose(got.p_corrected, p, atol=1e-7) and np.allclose(got.v_corrected, v, atol=1e-6)


def test_a_chunk_of_short_windows_takes_little_memory():
    import tracemalloc

    fold = imu.Fold(imu.CHUNK // 2)
    m = len(fold.dt)
    tracemalloc.start()
    try:
        fold.add(np.ones((m, 3)), np.ones((m, 3)), np.full(m, 0.005))
        assert tracemalloc.get_traced_memory()[1] < 64 << 20
    finally:
        tracemalloc.stop()
