"""Small files on any file system that Spark can reach."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def listed(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """(name, age in seconds) of what lies in a folder; nothing if there is no such folder."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return []
    return [(s.getPath().getName(), time.time() - s.getModificationTime() / 1000) for s in fs.listStatus(p)]


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file whole, by one rename; False, and nothing changed, if it is there already."""
    fs, p = _at(spark, path)
    fs.mkdirs(p.getParent())
    jvm = spark._jvm
    hidden = jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{uuid.uuid4().hex}.tmp")
    out = fs.create(hidden, True)
    out.write(bytearray(text.encode()))
    out.close()
    never_over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    never_over[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(p).toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(hidden), fs.makeQualified(p), never_over)
    except Exception as e:
        fs.delete(hidden, False)
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)
