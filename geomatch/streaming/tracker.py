"""The tracker as a keyed batch job and as a stateful stream.

Frames: session_id long, ts timestamp, seq long, status string, points array<struct<...>> (see POINT).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .model import Config, Session

POINT = "struct<inliers:long,pixel_x:long,pixel_y:long,ecef_x:double,ecef_y:double,ecef_z:double,lat:double,lon:double,yaw:double>"
OUT = "session_id long, ts timestamp, seq long, status string, reason string, inliers long, lat double, lon double, yaw double, mode string, tracks int"
COLUMNS = [c.split(" ")[0] for c in OUT.split(", ")]


def known(session_id) -> int | None:
    """A null id is a session of its own; pandas has it as a NaN, which equals nothing."""
    return None if pd.isna(session_id) else int(session_id)


def result_row(session_id: int, ts, seq: int, r: dict) -> tuple:
    p = r["point"] or {}
    return (session_id, ts, seq, r["status"], r["reason"], p.get("inliers"), p.get("lat"), p.get("lon"), p.get("yaw"), r["mode"], r["tracks"])


def frame_of(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=COLUMNS)
    return out.astype({"inliers": "Int64", "session_id": "Int64"})


def as_points(value) -> list[dict]:
    return [dict(p) if isinstance(p, dict) else p.asDict() for p in (value if value is not None else [])]




def struct(text: str, **nested: T.DataType) -> T.StructType:
    """A struct of named types; the parser of DDL needs a session, which tasks have not."""
    kinds = {"long": T.LongType(), "double": T.DoubleType(), "string": T.StringType()} | nested
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (f.split(":") for f in text.split(","))])


POINT_TYPE = struct(POINT[len("struct<") : -1])
TRACK_TYPE = struct("last:point,anchor:places,inliers:long,state:string,health:double,hits:long,failures:long,span:double", point=POINT_TYPE, places=T.ArrayType(T.DoubleType()))
PRIOR_TYPE = struct("pixel_x:long,pixel_y:long,lon:double,lat:double")
SESSION_TYPE = struct("tracks:tracks,prior:prior", tracks=T.ArrayType(TRACK_TYPE), prior=PRIOR_TYPE)
WAITING_TYPE = T.ArrayType(struct("ns:long,seq:long,status:string,points:points", points=T.ArrayType(POINT_TYPE)))
TRACK, PRIOR = TRACK_TYPE.simpleString(), PRIOR_TYPE.simpleString()
#: What is left of a session between frames; a table of these resumes a batch or a stream.
STATE = f"session_id long, tracks array<{TRACK}>, prior {PRIOR}"
TRACK_FIELDS, POINT_FIELDS, PRIOR_FIELDS = TRACK_TYPE.names, POINT_TYPE.names, PRIOR_TYPE.names


def plain(value):
    """Rows and arrays, however they are wrapped, as dictionaries and lists."""
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)) or hasattr(value, "tolist") and getattr(value, "ndim", 0):
        return [plain(v) for v in value]
    return value


def named(value, fields: list[str]) -> dict | None:
    """A struct as a dictionary, also where state gives it as a bare tuple."""
    value = plain(value)
    return value if value is None or isinstance(value, dict) else dict(zip(fields, value, strict=True))


def session_of(tracks, prior) -> Session:
    found = [named(t, TRACK_FIELDS) for t in (tracks if tracks is not None else [])]
    return Session.load({"tracks": [t | {"last": named(t["last"], POINT_FIELDS)} for t in found], "prior": named(prior, PRIOR_FIELDS)})


def typed(session: Session) -> tuple[list[tuple], tuple | None]:
    """(tracks, prior) as tuples in the order of the state's fields."""
    state = session.dump()
    tracks = [tuple(tuple(t["last"].get(c) for c in POINT_FIELDS) if f == "last" else t[f] for f in TRACK_FIELDS) for t in state["tracks"]]
    return tracks, state["prior"] and tuple(state["prior"].get(c) for c in PRIOR_FIELDS)


def track(frames: DataFrame, config: Config = Config(), feedback: bool = False, initial: DataFrame | None = None) -> DataFrame:
    """A result for each frame. Sessions lie in order in their partition; a task walks them with one
    session's state in memory, however many frames it has. Sessions in ``initial`` (see STATE) go on from there."""
    return walked(frames, config, feedback, initial, False)


def states(frames: DataFrame, config: Config = Config(), feedback: bool = False, initial: DataFrame | None = None) -> DataFrame:
    """STATE of each session after its frames, of those without frames as ``initial`` has it."""
    return walked(frames, config, feedback, initial, True)


def walked(frames: DataFrame, config: Config, feedback: bool, initial: DataFrame | None, last: bool) -> DataFrame:
    rows = frames.select("session_id", "ts", "seq", "status", "points").withColumn("first", F.lit(False))
    if initial is not None:
        names = ["session_id", "tracks", "prior"]
        given = initial.select(*names).withColumn("first", F.lit(True))
        rows = rows.unionByName(given, allowMissingColumns=True)
    else:
        rows = rows.select("*", F.lit(None).cast(f"array<{TRACK}>").alias("tracks"), F.lit(None).cast(PRIOR).alias("prior"))
    ordered = rows.repartition("session_id").sortWithinPartitions("session_id", F.desc("first"), "ts", "seq").select("session_id", "ts", "seq", "status", "points", "first", "tracks", "prior")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, session = (), Session()

        def state() -> pd.DataFrame:
            tracks, prior = typed(session)
            return pd.DataFrame([(key, [dict(zip(TRACK_FIELDS, (dict(zip(POINT_FIELDS, t[0], strict=True)), *t[1:]), strict=True)) for t in tracks], prior and dict(zip(PRIOR_FIELDS, prior, strict=True)))], columns=["session_id", "tracks", "prior"]).astype({"session_id": "Int64"})

        for pdf in batches:
            out = []
            for sid, ts, seq, status, points, first, tracks, prior in pdf.itertuples(index=False):
                sid = known(sid)
                if sid != key:
                    if last and key != ():
                        yield state()
                    key, session = sid, session_of(tracks, prior) if first else Session()
                if not first:
                    out.append(result_row(sid, ts, seq, session.frame(status, as_points(points), config, feedback)))
            if not last:
                yield frame_of(out)
        if last and key != ():
            yield state()

    return ordered.mapInPandas(run, STATE if last else OUT)


class TrackProcessor(StatefulProcessor):
    """Buffers frames by event time and releases them in order as the watermark passes; late ones are
    counted with status ``late`` if Spark has not dropped them before (numRowsDroppedByWatermark). A timer
    reads and drops the frames of its own millisecond only.

    Sessions of an initial state go on from there. With ``idle_ms`` a session without a frame for so
    long is closed: its state goes, and a row of status ``closed`` says how many frames came too late.
    """

    def __init__(self, config: Config, feedback: bool, idle_ms: int | None = None):
        self.config, self.feedback, self.idle_ms = config, feedback, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", SESSION_TYPE)
        self.about = handle.getValueState("about", struct("late:long,ends:long"))
        self.waiting = handle.getMapState("waiting", struct("ms:long"), struct("frames:waiting", waiting=WAITING_TYPE))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.itertuples(index=False):
            self.session.update(typed(session_of(r.tracks, r.prior)))

    def seen(self) -> tuple[int, int]:
        """(late frames, the time at which the session is idle) so far."""
        return tuple(self.about.get()) if self.about.exists() else (0, 0)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        late, fresh = [], {}
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                ms = int(r.ts.timestamp() * 1000)
                if ms <= mark:
                    late.append((known(key[0]), r.ts, r.seq, "late", "Frame behind the watermark", None, None, None, None, "late", 0))
                    continue
                fresh.setdefault(ms, []).append((r.ts.value, int(r.seq), r.status, [tuple(p.get(c) for c in POINT_FIELDS) for p in as_points(r.points)]))
        for ms, frames in fresh.items():
            if self.waiting.containsKey((ms,)):
                frames = [tuple(f) for f in self.waiting.getValue((ms,))[0]] + frames
            else:
                self.handle.registerTimer(ms)
            self.waiting.updateValue((ms,), (frames,))
        n, ends = self.seen()
        if self.idle_ms is not None and fresh and max(fresh) + self.idle_ms > ends:
            ends = max(fresh) + self.idle_ms
            self.handle.registerTimer(ends)
        if late or fresh:
            self.about.update((n + len(late), ends))
        yield frame_of(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        rows = []
        if self.waiting.containsKey((at,)):
            due = [named(w, ["ns", "seq", "status", "points"]) for w in self.waiting.getValue((at,))[0]]
            self.waiting.removeKey((at,))
            session = session_of(*self.session.get()) if self.session.exists() else Session()
            for w in sorted(due, key=lambda w: (w["ns"], w["seq"])):
                points = [named(p, POINT_FIELDS) for p in w["points"]]
                rows.append(result_row(known(key[0]), pd.Timestamp(w["ns"]), w["seq"], session.frame(w["status"], points, self.config, self.feedback)))
            self.session.update(typed(session))
        late, ends = self.seen()
        if self.idle_ms is not None and at == ends:
            rows.append((known(key[0]), pd.Timestamp(at, unit="ms"), -1, "closed", f"Late frames: {late}", None, None, None, None, "closed", 0))
            self.session.clear()
            self.about.clear()
        yield frame_of(rows)

    def close(self) -> None:
        pass


def track_stream(frames: DataFrame, delay: str = "1 hour", config: Config = Config(), feedback: bool = False, initial: DataFrame | None = None, idle_seconds: float | None = None) -> DataFrame:
    """Streaming form of track; needs the RocksDB state store. Frames wait until the watermark passes them.

    ``initial`` (see STATE), as ``states`` gives it, resumes sessions; ``idle_seconds`` closes them.
    """
    marked = frames.select("session_id", F.col("ts").cast("timestamp").alias("ts"), "seq", "status", "points").withWatermark("ts", delay)
    start = initial.select("session_id", "tracks", "prior").groupBy("session_id") if initial is not None else None
    processor = TrackProcessor(config, feedback, None if idle_seconds is None else int(1000 * idle_seconds))
    return marked.groupBy("session_id").transformWithStateInPandas(processor, OUT, "Append", "EventTime", start)
