"""Pre-integration of inertial samples, and what follows from it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomatch.operators.segments import segmented
from geomatch.sources.shared import written

GRAVITY = np.array([0.0, 0.0, -9.81])


def skew(v: np.ndarray) -> np.ndarray:
    """Cross-product matrices of vectors, (..., 3) to (..., 3, 3)."""
    out = np.zeros((*v.shape[:-1], 3, 3))
    for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1)):
        out[..., j, k], out[..., k, j] = -v[..., i], v[..., i]
    return out


def _angle(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    angle = np.linalg.norm(v, axis=-1)[..., None, None]
    return angle, np.maximum(angle, 1e-12)


def rotation(v: np.ndarray) -> np.ndarray:
    """Rotation matrices of rotation vectors."""
    angle, safe = _angle(v)
    k = skew(v)
    return np.eye(3) + np.sin(safe) / safe * k + 2 * (np.sin(safe / 2) / safe) ** 2 * (k @ k)


def right_jacobian(v: np.ndarray) -> np.ndarray:
    """The identity for angles under 1e-4."""
    angle, safe = _angle(v)
    k = skew(v)
    full = np.eye(3) - (1 - np.cos(safe)) / safe**2 * k + (safe - np.sin(safe)) / safe**3 * (k @ k)
    return np.where(angle < 1e-4, np.eye(3), full)


def quaternion(m: np.ndarray) -> np.ndarray:
    """w, x, y, z of rotation matrices, w >= 0; from the largest of the four, as the root of a small one is mostly rounding."""
    a, b, c = (m[..., i, i] for i in range(3))
    squares = [1 + a + b + c, 1 + a - b - c, 1 - a + b - c, 1 - a - b + c]
    # 4 q q', whose rows are all the quaternion but for a factor
    table = np.empty((*m.shape[:-2], 4, 4))
    for i, x in enumerate(squares):
        table[..., i, i] = x
    for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1)):
        table[..., 0, i + 1] = table[..., i + 1, 0] = m[..., k, j] - m[..., j, k]
        table[..., j + 1, k + 1] = table[..., k + 1, j + 1] = m[..., k, j] + m[..., j, k]
    best = np.argmax(np.stack(squares, -1), -1)[..., None, None]
    q = np.take_along_axis(table, best, -2)[..., 0, :]
    return q / np.linalg.norm(q, axis=-1, keepdims=True) * np.where(q[..., :1] < 0, -1, 1)


def matrix(q: np.ndarray) -> np.ndarray:
    k = skew(q[..., 1:])
    return np.eye(3) + 2 * q[..., :1, None] * k + 2 * k @ k


@dataclass
class Noise:
    acc: float = 0.08
    gyro: float = 0.004
    acc_walk: float = 0.0001
    gyro_walk: float = 0.00001


class Fold:
    """Increments of position, velocity and rotation of m windows in step, each in the frame of its
    first sample, with the Jacobians by bias and the covariances in the order rotation, velocity,
    position, gyro bias, acc bias."""

    def __init__(self, m: int = 1, acc_bias=(0.0, 0.0, 0.0), gyro_bias=(0.0, 0.0, 0.0), noise: Noise = Noise()):
        self.acc_bias, self.gyro_bias, self.noise = np.asarray(acc_bias, float), np.asarray(gyro_bias, float), noise
        self.dt = np.zeros(m)
        self.p, self.v, self.mean_acc, self.mean_gyro = (np.zeros((m, 3)) for _ in range(4))
        self.r = np.broadcast_to(np.eye(3), (m, 3, 3)).copy()
        self.j = {k: np.zeros((m, 3, 3)) for k in ("r_bg", "v_bg", "v_ba", "p_bg", "p_ba")}
        self.cov = np.zeros((m, 15, 15))

    def add(self, acc: np.ndarray, gyro: np.ndarray, dt: np.ndarray) -> None:
        """One sample for each window; where dt is not positive the window stays as it is."""
        acc, gyro, dt = np.atleast_2d(acc), np.atleast_2d(gyro), np.maximum(np.atleast_1d(dt), 0.0)
        a, w = acc - self.acc_bias, gyro - self.gyro_bias
        r, t, t3 = self.r, dt[:, None], dt[:, None, None]
        half = t3 * t3 / 2
        world = (r @ a[..., None])[..., 0]
        total = np.where(self.dt + dt > 0, self.dt + dt, 1.0)[:, None]
        self.mean_acc = (self.dt[:, None] * self.mean_acc + world * t) / total
        self.mean_gyro = (self.dt[:, None] * self.mean_gyro + w * t) / total
        self.p = self.p + self.v * t + world * (t * t / 2)
        self.v = self.v + world * t
        turn, right, ra, j = rotation(w * t), right_jacobian(w * t), r @ skew(a), self.j
        back = np.swapaxes(turn, -1, -2)
        j["p_ba"] = j["p_ba"] + j["v_ba"] * t3 - r * half
        j["p_bg"] = j["p_bg"] + j["v_bg"] * t3 - ra @ j["r_bg"] * half
        j["v_ba"] = j["v_ba"] - r * t3
        j["v_bg"] = j["v_bg"] - ra @ j["r_bg"] * t3
        j["r_bg"] = back @ j["r_bg"] - right * t3
        m = len(dt)
        move = np.broadcast_to(np.eye(9), (m, 9, 9)).copy()
        move[:, :3, :3], move[:, 3:6, :3], move[:, 6:, :3], move[:, 6:, 3:6] = back, -ra * t3, -ra * half, np.eye(3) * t3
        drive = np.zeros((m, 9, 6))
        drive[:, :3, :3], drive[:, 3:6, 3:], drive[:, 6:, 3:] = right * t3, r * t3, r * half
        n = self.noise
        white, walk = np.diag([n.gyro**2] * 3 + [n.acc**2] * 3), np.diag([n.gyro_walk**2] * 3 + [n.acc_walk**2] * 3)
        self.cov[:, :9, :9] = move @ self.cov[:, :9, :9] @ np.swapaxes(move, -1, -2) + drive @ white @ np.swapaxes(drive, -1, -2)
        self.cov[:, 9:, 9:] += walk * t3
        q = quaternion(r @ turn)  # a rotation again, whatever was rounded
        self.r = matrix(q)
        self.dt = self.dt + dt


VECTORS, MATRICES = ("p", "v", "mean_acc", "mean_gyro"), ("r_bg", "v_bg", "v_ba", "p_bg", "p_ba")
SCHEMA = "dt double, samples long, p array<double>, v array<double>, q array<double>, mean_acc array<double>, mean_gyro array<double>, r_bg array<double>, v_bg array<double>, v_ba array<double>, p_bg array<double>, p_ba array<double>, cov array<double>"
#: Samples folded in step, so that a task holds a few MB of covariances and rows of results, however many it has.
CHUNK = 8_192
#: Neighbouring folds that become one in a round.
FAN = 64


def combine(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The folds of windows of which a holds the samples up to some time and b those after it.

    Values by the columns of SCHEMA, of m windows at once. What b holds in the frame of its first
    sample is turned by a; errors of a's rotation move b's velocity and position. This is
    associative, so the folds of a long window may meet in any tree that keeps their order.
    """
    ra, rb = matrix(a["q"]), matrix(b["q"])
    back = np.swapaxes(rb, -1, -2)
    turned = lambda v: (ra @ v[..., None])[..., 0]
    total, t, t3 = a["dt"] + b["dt"], b["dt"][:, None], b["dt"][:, None, None]
    share = lambda x, y: (a["dt"][:, None] * x + t * y) / np.where(total > 0, total, 1.0)[:, None]
    dv, dp = ra @ skew(b["v"]), ra @ skew(b["p"])
    out = {
        "dt": total,
        "samples": a["samples"] + b["samples"],
        "p": a["p"] + a["v"] * t + turned(b["p"]),
        "v": a["v"] + turned(b["v"]),
        "q": quaternion(ra @ rb),
        "mean_acc": share(a["mean_acc"], turned(b["mean_acc"])),
        "mean_gyro": share(a["mean_gyro"], b["mean_gyro"]),
        "r_bg": back @ a["r_bg"] + b["r_bg"],
        "v_bg": a["v_bg"] + ra @ b["v_bg"] - dv @ a["r_bg"],
        "v_ba": a["v_ba"] + ra @ b["v_ba"],
        "p_bg": a["p_bg"] + a["v_bg"] * t3 + ra @ b["p_bg"] - dp @ a["r_bg"],
        "p_ba": a["p_ba"] + a["v_ba"] * t3 + ra @ b["p_ba"],
    }
    m = len(total)
    move = np.broadcast_to(np.eye(15), (m, 15, 15)).copy()
    move[:, :3, :3], move[:, 3:6, :3], move[:, 6:9, :3], move[:, 6:9, 3:6] = back, -dv, -dp, np.eye(3) * t3
    turn = np.broadcast_to(np.eye(15), (m, 15, 15)).copy()
    turn[:, 3:6, 3:6] = turn[:, 6:9, 6:9] = ra
    out["cov"] = move @ a["cov"] @ np.swapaxes(move, -1, -2) + turn @ b["cov"] @ np.swapaxes(turn, -1, -2)
    return out


def as_arrays(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    """The columns of SCHEMA as arrays of one row a fold."""
    shapes = {k: (3,) for k in VECTORS} | {"q": (4,), "cov": (15, 15)} | {k: (3, 3) for k in MATRICES}
    out = {"dt": pdf["dt"].to_numpy(float), "samples": pdf["samples"].to_numpy(np.int64)}
    return out | {k: np.stack(pdf[k].to_numpy()).reshape(-1, *s) for k, s in shapes.items()}


def as_frame(fold: dict[str, np.ndarray], **keys) -> pd.DataFrame:
    flat = {k: list(v.reshape(len(v), -1)) if v.ndim > 1 else v for k, v in fold.items()}
    return pd.DataFrame(keys | {c.split()[0]: flat[c.split()[0]] for c in SCHEMA.split(", ")})


def joined(parts: DataFrame, top: int, keys: str) -> DataFrame:
    """The folds of whole windows from those of their segments, FAN neighbours at a time, up to segment number ``top``."""

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("segment")
        every = as_arrays(pdf)
        fold = {k: v[:1] for k, v in every.items()}
        for i in range(1, len(pdf)):
            fold = combine(fold, {k: v[i : i + 1] for k, v in every.items()})
        return as_frame(fold, stream_id=pdf["stream_id"].iloc[:1].to_numpy(), window_id=pdf["window_id"].iloc[:1].to_numpy(), segment=pdf["_group"].iloc[:1].to_numpy())

    while top > 0:
        parts = parts.withColumn("_group", F.floor(F.col("segment") / FAN)).groupBy("stream_id", "window_id", "_group").applyInPandas(meet, f"{keys}, segment long, {SCHEMA}")
        top //= FAN
    return parts.drop("segment")


def preintegrate(imu: DataFrame, acc_bias=(0.0, 0.0, 0.0), gyro_bias=(0.0, 0.0, 0.0), noise: Noise = Noise(), rows: int | None = None) -> DataFrame:
    """A row for each (stream_id, window_id) of imu with dt (see with_dt).

    A window is cut into segments of about ``rows`` samples, unless imu has the columns ``segment`` and
    ``cuts`` already. Segments lie together in their partition, in order; a task folds about CHUNK
    samples of whole segments at a time, all in step. Those of one window are then combined as a
    tree, so that a window of any length spreads over tasks.
    """
    kinds = {f.name: f.dataType.simpleString() for f in imu.schema}
    if "segment" not in kinds:
        imu = segmented(imu, ["stream_id", "window_id"], F.col("ts_ns"), rows)
    by = ["stream_id", "window_id", "segment"]
    ordered = imu.select(*by, "cuts", "ts_ns", "dt", "w_x", "w_y", "w_z", "a_x", "a_y", "a_z").repartition(*by).sortWithinPartitions(*by, "ts_ns")
    keys = f"stream_id {kinds['stream_id']}, window_id {kinds['window_id']}"

    def folded(pdf: pd.DataFrame) -> pd.DataFrame:
        new = np.logical_or.reduce([(pdf[c] != pdf[c].shift()).to_numpy() for c in by])
        window = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(pdf)])
        place = np.arange(len(pdf)) - starts[window]
        fold = Fold(len(starts), acc_bias, gyro_bias, noise)
        w, a, dt = pdf[["w_x", "w_y", "w_z"]].to_numpy(float), pdf[["a_x", "a_y", "a_z"]].to_numpy(float), pdf["dt"].to_numpy(float)
        for k in range(int(sizes.max(initial=0))):
            at = np.flatnonzero(place == k)
            now = [np.zeros((len(starts), 3)), np.zeros((len(starts), 3)), np.zeros(len(starts))]
            for full, own in zip(now, (a, w, dt), strict=True):
                full[window[at]] = own[at]
            fold.add(*now)
        every = {"dt": fold.dt, "samples": sizes, "q": quaternion(fold.r), "cov": fold.cov} | {k: getattr(fold, k) for k in VECTORS} | fold.j
        return as_frame(every, **{c: pdf[c].to_numpy()[starts] for c in (*by, "cuts")})

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in frames:
            held.append(pdf)
            if sum(map(len, held)) >= CHUNK:
                rows = pd.concat(held, ignore_index=True)
                last = np.logical_and.reduce([(rows[c] == rows[c].iloc[-1]).to_numpy() for c in by])
                if not last.all():
                    yield folded(rows[~last])
                held = [rows[last]]
        if held and sum(map(len, held)):
            yield folded(pd.concat(held, ignore_index=True))

    folds = ordered.mapInPandas(run, f"{keys}, segment long, cuts long, {SCHEMA}")
    if not imu.schema["cuts"].nullable:  # a constant: no window has a cut
        return folds.drop("segment", "cuts")
    folds = written(folds, "folds")
    top = folds.agg(F.max("segment")).first()[0] or 0
    whole = joined(folds.where("cuts > 0").drop("cuts"), top, keys)
    return folds.where("cuts = 0").drop("segment", "cuts").unionByName(whole)


# ---- quaternions and 3x3 products as columns ---------------------------------------------------


def rotate(q: Column, v: Column) -> Column:
    """v turned by the unit quaternion q (w, x, y, z)."""
    w, x, y, z = (q[i] for i in range(4))
    tx, ty, tz = 2 * (y * v[2] - z * v[1]), 2 * (z * v[0] - x * v[2]), 2 * (x * v[1] - y * v[0])
    return F.array(v[0] + w * tx + y * tz - z * ty, v[1] + w * ty + z * tx - x * tz, v[2] + w * tz + x * ty - y * tx)


def multiply(a: Column, b: Column) -> Column:
    return F.array(
        a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3],
        a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2],
        a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1],
        a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0],
    )


def conjugate(q: Column) -> Column:
    return F.array(q[0], -q[1], -q[2], -q[3])


def from_axis(v: Column) -> Column:
    angle = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    s = F.when(angle > 1e-12, F.sin(angle / 2) / angle).otherwise(0.5)
    return F.array(F.cos(angle / 2), s * v[0], s * v[1], s * v[2])


def times(m: Column, v: Column) -> Column:
    return F.array(*[m[3 * i] * v[0] + m[3 * i + 1] * v[1] + m[3 * i + 2] * v[2] for i in range(3)])


def plus(*vs: Column) -> Column:
    return F.array(*[sum((v[i] for v in vs[1:]), vs[0][i]) for i in range(3)])


def length(v: Column) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def angle_degrees(q: Column) -> Column:
    return F.degrees(2 * F.atan2(F.sqrt(q[1] * q[1] + q[2] * q[2] + q[3] * q[3]), F.abs(q[0])))


def predict_pose(df: DataFrame) -> DataFrame:
    """df has dt, p, v, q of the fold, p0, v0, q0 of the start and p1, v1, q1 of the true end: adds the
    predicted end and its errors in m, m/s and degrees."""
    c = F.col
    scaled = lambda v, k: F.array(*[v[i] * k for i in range(3)])
    g = F.array(*[F.lit(float(x)) for x in GRAVITY])
    out = df.withColumns({
        "p_end": plus(c("p0"), scaled(c("v0"), c("dt")), scaled(g, c("dt") * c("dt") / 2), rotate(c("q0"), c("p"))),
        "v_end": plus(c("v0"), scaled(g, c("dt")), rotate(c("q0"), c("v"))),
        "q_end": multiply(c("q0"), c("q")),
    })
    minus = lambda a, b: F.array(*[a[i] - b[i] for i in range(3)])
    return out.withColumns({"p_error": length(minus(c("p_end"), c("p1"))), "v_error": length(minus(c("v_end"), c("v1"))), "r_error": angle_degrees(multiply(conjugate(c("q1")), c("q_end")))})


def bias_correct(df: DataFrame, dba: Column, dbg: Column) -> DataFrame:
    """p, v, q of a fold after small changes of the biases, to first order."""
    c = F.col
    return df.withColumns({
        "p_corrected": plus(c("p"), times(c("p_ba"), dba), times(c("p_bg"), dbg)),
        "v_corrected": plus(c("v"), times(c("v_ba"), dba), times(c("v_bg"), dbg)),
        "q_corrected": multiply(c("q"), from_axis(times(c("r_bg"), dbg))),
    })
