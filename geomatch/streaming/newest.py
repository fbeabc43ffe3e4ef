"""The newest frame of each source on a stream, across micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


class NewestProcessor(StatefulProcessor):
    """Keeps the newest row of a source; one of an older or equal order changes nothing.

    The state goes after the time to live, counted from the last newer row, so that sources that
    fell silent take no room. Rows are compared as Spark compares structs, nulls first.
    """

    def __init__(self, columns: list[str], schema: T.StructType, ttl_ms: int | None):
        self.columns, self.schema, self.ttl_ms = columns, schema, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", self.schema, self.ttl_ms)

    @staticmethod
    def order(row: tuple) -> tuple:
        return tuple((v is not None, v) if v is not None else (False,) for v in row)

    @staticmethod
    def plain(values) -> tuple:
        """NaN counts as null."""
        return tuple(None if v is not None and v != v else v for v in values)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        value = self.newest.get()
        before = None if value is None else tuple(value)
        best, highest = before, None if before is None else self.order(before)
        for r in rows:
            now = self.plain(r[c] for c in self.columns)
            if highest is None or self.order(now) > highest:
                best, highest = now, self.order(now)
        if best != before:
            self.newest.update(best)
            yield Row(**{"_key": key[0], **dict(zip(self.columns, best, strict=True))})

    def close(self) -> None:
        pass


def newest_frames(frames: DataFrame, key: str, ts: str = "ts", ttl_seconds: float | None = None) -> DataFrame:
    """A row whenever a source's newest frame changes: the last row of a source is what ``latest_frame``
    gives for all frames so far. Needs the RocksDB state store, and a trigger other than availableNow, as
    the time to live is measured by the clock and such a query never runs out of work. Columns hold plain values."""
    columns = [ts, *[c for c in frames.columns if c not in (key, ts)]]
    # times pass as whole microseconds, which need no time zone
    times = [f.name for f in frames.schema if f.name != key and isinstance(f.dataType, T.TimestampType)]
    rows = frames.select(F.col(key).alias("_key"), *[F.unix_micros(c).alias(c) if c in times else c for c in columns])
    state = rows.select(*columns).schema
    out = T.StructType([rows.schema["_key"], *state.fields])
    found = rows.groupBy("_key").transformWithState(NewestProcessor(columns, state, None if ttl_seconds is None else int(1000 * ttl_seconds)), out, "Update", "ProcessingTime")
    return found.withColumnRenamed("_key", key).select(*[F.timestamp_micros(c).alias(c) if c in times else c for c in frames.columns])
