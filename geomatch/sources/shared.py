"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from geomatch.sources import files

_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; below the machine's own folder only if there is one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        root = "file://" + os.path.join(tempfile.gettempdir(), "geomatch-shared")
    if not root:
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    _made.append(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def clear(spark: SparkSession) -> None:
    """Deletes the tables that this driver has written so far, once nothing reads results made from them any more."""
    while _made:
        files.delete(spark, _made.pop())


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once: written as Parquet and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
