"""A table of points with versions: segments, tombstones, and a manifest committed by one rename.

Below the table's path lie

- ``data/<segment>``: Parquet files of points, ordered by their place on a space-filling curve;
- ``gone/<name>``: ids whose rows in older segments no longer count;
- ``versions/<n>.json``: the manifest of version n. It lists the segments with the files that count,
  the range of the curve and the rows of each, the tombstones, and the last batch of each writer.

A write puts its files beside the table first and then adds one manifest, by a rename that never
replaces a file. So a job that is killed at any step leaves the old version or the new one, and of
two writers that commit at once the second tries again on top of the first. A write reads nothing of
the table: the ids of a batch are themselves the tombstones of older rows. A read leaves out the
rows that tombstones name, by one anti join of the segments older than the newest tombstone;
``compact`` rewrites only the files that hold such rows, and drops the tombstones.

The manifest takes about 100 bytes a file. The file system must have an atomic rename (HDFS and
local disks have one).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geomatch.functions.curve import curve, ranges
from geomatch.functions.geo import haversine
from geomatch.sources import files

POINTS = "id string, vector array<float>, location struct<lon:double,lat:double>, x int, y int, src string, res array<double>"
NAMES = ["id", "vector", "location", "x", "y", "src", "res"]
STORED = POINTS + ", curve long"
TRIES = 20


def check_dim(points: DataFrame, dim: int) -> DataFrame:
    return points.withColumn("dim_ok", F.coalesce(F.size("vector") == dim, F.lit(False)))


def last_of_each(batch: DataFrame, seq: str | None = None) -> DataFrame:
    """One row of each id: the last by ``seq`` if given, else as the rows stand."""
    w = Window.partitionBy("id").orderBy(F.desc("_s"))
    batch = batch.withColumn("_s", F.col(seq) if seq else F.monotonically_increasing_id()).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return batch.drop("_r", "_s", *([seq] if seq else []))


class VectorTable:
    """Points with vectors of one length, current and past versions."""

    def __init__(self, spark: SparkSession, path: str, dim: int):
        self.spark, self.path, self.dim = spark, path.rstrip("/"), dim

    @classmethod
    def create(cls, spark: SparkSession, path: str, dim: int) -> VectorTable:
        """A new table, or the one that is there."""
        table = cls(spark, path, dim)
        if table.version() < 0:
            files.write_new(spark, table._manifest_path(0), json.dumps({"version": 0, "dim": dim, "segments": [], "gone": [], "writers": {}}))
        found = table.manifest()["dim"]
        if found != dim:
            raise ValueError(f"the table holds vectors of length {found}, not {dim}")
        return table

    # ---- versions ----------------------------------------------------------------------------------

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/versions/{version:012d}.json"

    def version(self) -> int:
        """The newest version, -1 if there is no table."""
        return max((int(n[:-5]) for n, _ in files.listed(self.spark, f"{self.path}/versions") if n.endswith(".json") and n[0] != "."), default=-1)

    def manifest(self, version: int | None = None) -> dict:
        return json.loads(files.read_text(self.spark, self._manifest_path(self.version() if version is None else version)))

    def _commit(self, change: Callable[[dict], dict | None]) -> int:
        """Adds a version made from the newest one; None from ``change`` leaves the table as it is."""
        for _ in range(TRIES):
            now = self.manifest()
            after = change(now)
            if after is None:
                return now["version"]
            after["version"] = now["version"] + 1
            if files.write_new(self.spark, self._manifest_path(after["version"]), json.dumps(after)):
                return after["version"]
        raise RuntimeError(f"{TRIES} other writers were first")

    # ---- reading -----------------------------------------------------------------------------------

    def _born(self, named: list[dict], kind: str) -> Column:
        """The version that each row's segment or tombstone came with, from the path of its file."""
        name = F.regexp_extract("_metadata.file_path", f"/{kind}/([^/]+)/", 1)
        return F.element_at(F.create_map(*[x for s in named for x in (F.lit(s["name"]), F.lit(s["born"]))]), name)

    def _rows(self, segments: list[dict]) -> DataFrame:
        paths = [f"{self.path}/data/{s['name']}/{f['name']}" for s in segments for f in s["files"]]
        return self.spark.read.schema(STORED).parquet(*paths) if paths else self.spark.createDataFrame([], STORED)

    def _gone(self, manifest: dict) -> DataFrame:
        """(id, born): the newest tombstone of each id."""
        gone = self.spark.read.schema("id string").parquet(*[f"{self.path}/gone/{g['name']}" for g in manifest["gone"]])
        return gone.select("id", self._born(manifest["gone"], "gone").alias("born")).groupBy("id").agg(F.max("born").alias("born"))

    def _alive(self, manifest: dict, segments: list[dict], *keep: Column) -> DataFrame:
        """The rows of some segments that no later tombstone names."""
        newest = max((g["born"] for g in manifest["gone"]), default=-1)
        old = [s for s in segments if s["born"] < newest and s["files"]]
        fresh = self._rows([s for s in segments if s["born"] >= newest]).select(*NAMES, "curve", *keep)
        if not old:
            return fresh
        gone = self._gone(manifest).select(F.col("id").alias("_id"), F.col("born").alias("_gone"))
        rows = self._rows(old).select(*NAMES, "curve", *keep, self._born(old, "data").alias("_born"))
        return fresh.unionByName(rows.join(gone, (F.col("id") == F.col("_id")) & (F.col("_gone") > F.col("_born")), "left_anti").drop("_born"))

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        return self._alive(m, m["segments"]).drop("curve")

    def read_within(self, lon: float, lat: float, radius_m: float, version: int | None = None) -> DataFrame:
        """Points in a circle, with ``meters``. Files whose range of the curve misses the circle are not
        read, and the ranges reach the scan of the others as a filter."""
        m = self.manifest(version)
        wanted = ranges(lon, lat, radius_m)
        some = [s | {"files": [f for f in s["files"] if any(f["low"] <= high and low <= f["high"] for low, high in wanted)]} for s in m["segments"]]
        inside = F.lit(False)
        for low, high in wanted:
            inside = inside | F.col("curve").between(low, high)
        near = self._alive(m, some).where(inside)
        meters = haversine(F.lit(float(lon)), F.lit(float(lat)), F.col("location.lon"), F.col("location.lat"))
        return near.withColumn("meters", meters).where(F.col("meters") <= radius_m).drop("curve")

    # ---- writing -----------------------------------------------------------------------------------

    def _stage(self, rows: DataFrame) -> dict:
        """Writes a segment that no manifest names yet; its files hold ranges of the curve."""
        name = "seg-" + uuid.uuid4().hex
        path = f"{self.path}/data/{name}"
        rows.repartitionByRange("curve", "id").sortWithinPartitions("curve", "id").write.parquet(path)
        return {"name": name, "files": self._files(path)}

    def _files(self, path: str) -> list[dict]:
        rows = self.spark.read.schema(STORED).parquet(path).groupBy(F.col("_metadata.file_name").alias("name"))
        return [r.asDict() for r in rows.agg(F.min("curve").alias("low"), F.max("curve").alias("high"), F.count("*").alias("rows")).orderBy("low", "name").collect()]

    def _bury(self, ids: DataFrame) -> str:
        name = "gone-" + uuid.uuid4().hex
        ids.select(F.col("id").cast("string").alias("id")).write.parquet(f"{self.path}/gone/{name}")
        return name

    def upsert(self, batch: DataFrame, seq: str | None = None, writer: str | None = None, number: int | None = None) -> int:
        """Rows of the batch in place of those of the same id; the version that holds them.

        Within a batch the last row of an id wins. A batch of ``writer`` whose ``number`` is not over the
        last one committed changes nothing, so that a batch may be delivered again.
        """
        seen = lambda m: writer is not None and m["writers"].get(writer, -1) >= number
        now = self.manifest()
        if seen(now):
            return now["version"]
        rows = last_of_each(batch.select(*NAMES, *([seq] if seq else [])), seq)
        typed = self.spark.createDataFrame([], POINTS).unionByName(rows).withColumn("curve", curve(F.col("location.lon"), F.col("location.lat")))
        segment = self._stage(typed)
        staged = self.spark.read.schema(STORED).parquet(f"{self.path}/data/{segment['name']}")
        if not check_dim(staged, self.dim).where("not dim_ok").isEmpty():
            raise ValueError(f"vectors of another length than {self.dim}")
        buried = self._bury(staged) if segment["files"] else None

        def change(m: dict) -> dict | None:
            if seen(m) or (writer is None and not segment["files"]):
                return None
            born = m["version"] + 1
            if segment["files"]:
                m["gone"] = m["gone"] + ([{"name": buried, "born": born}] if m["segments"] else [])
                m["segments"] = [*m["segments"], segment | {"born": born}]
            if writer is not None:
                m["writers"] = m["writers"] | {writer: number}
            return m

        return self._commit(change)

    def delete(self, ids: DataFrame) -> int:
        """Rows of these ids (id) no longer count."""
        buried = self._bury(ids.distinct())
        return self._commit(lambda m: m | {"gone": [*m["gone"], {"name": buried, "born": m["version"] + 1}]})

    def sink(self, writer: str, seq: str | None = None) -> Callable[[DataFrame, int], None]:
        """For ``writeStream.foreachBatch``: every micro-batch once, however often it is delivered."""
        return lambda batch, number: self.upsert(batch, seq, writer, number) and None

    # ---- upkeep ------------------------------------------------------------------------------------

    def compact(self) -> int:
        """Rewrites the files that hold rows which tombstones name, and drops the tombstones."""
        m = self.manifest()
        newest = max((g["born"] for g in m["gone"]), default=-1)
        old = [s for s in m["segments"] if s["born"] < newest and s["files"]]
        dead = set()
        if old:
            gone = self._gone(m).select(F.col("id").alias("_id"), F.col("born").alias("_gone"))
            ids = self._rows(old).select("id", F.col("_metadata.file_name").alias("file"), self._born(old, "data").alias("_born"))
            hit = ids.join(gone, (F.col("id") == F.col("_id")) & (F.col("_gone") > F.col("_born")), "left_semi")
            dead = {r.file for r in hit.select("file").distinct().collect()}
        touched = [s | {"files": [f for f in s["files"] if f["name"] in dead]} for s in old]
        fresh = self._stage(self._alive(m, touched)) if dead else {"files": []}

        def change(now: dict) -> dict | None:
            if not m["gone"]:
                return None
            # tombstones of later writes are younger than the new segment and still count for it
            here = {f["name"] for s in now["segments"] for f in s["files"]}
            if not dead <= here:
                raise RuntimeError("another compaction was first")
            kept = [s | {"files": [f for f in s["files"] if f["name"] not in dead]} for s in now["segments"]]
            kept += [fresh | {"born": m["version"]}] if fresh["files"] else []
            return now | {"segments": [s for s in kept if s["files"]], "gone": [g for g in now["gone"] if g["born"] > m["version"]]}

        return self._commit(change)

    def vacuum(self, keep: int = 1, age_s: float = 3600.0) -> None:
        """Deletes what none of the last ``keep`` versions names and nobody has written lately."""
        last = self.version()
        kept = [self.manifest(v) for v in range(max(0, last - keep + 1), last + 1)]
        for folder, key in (("data", "segments"), ("gone", "gone")):
            named = {x["name"] for m in kept for x in m[key]}
            for name, age in files.listed(self.spark, f"{self.path}/{folder}"):
                if name not in named and age >= age_s:
                    files.delete(self.spark, f"{self.path}/{folder}/{name}")
        used = {(s["name"], f["name"]) for m in kept for s in m["segments"] for f in s["files"]}
        for segment in {s for s, _ in used}:
            for name, age in files.listed(self.spark, f"{self.path}/data/{segment}"):
                if name.startswith("part-") and (segment, name) not in used and age >= age_s:
                    files.delete(self.spark, f"{self.path}/data/{segment}/{name}")
        for name, _ in files.listed(self.spark, f"{self.path}/versions"):
            if name.endswith(".json") and name[0] != "." and int(name[:-5]) <= last - keep:
                files.delete(self.spark, f"{self.path}/versions/{name}")
