"""Set operations, and differences between schemas and configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def id_intersection(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def schema_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(name, issue) of (name, shape) tables: missing, unexpected or another shape."""
    j = expected.select("name", F.col("shape").alias("want")).join(actual.select("name", F.col("shape").alias("got")), "name", "full_outer")
    issue = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("want") != F.col("got"), "shape")
    return j.withColumn("issue", issue).where("issue is not null")


def config_diff(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(id, key, saved, current) of JSON configurations that differ in a listed key; nulls compare as values."""
    k = pairs.withColumn("key", F.explode(F.array(*map(F.lit, keys))))
    value = lambda c: F.coalesce(*[F.when(F.col("key") == x, F.get_json_object(c, f"$.{x}")) for x in keys])
    v = k.select("id", "key", value("saved").alias("saved"), value("current").alias("current"))
    return v.where(~F.col("saved").eqNullSafe(F.col("current")))


def config_errors(diff: DataFrame) -> DataFrame:
    """One message an id that lists every mismatch."""
    part = F.format_string("%s: %s != %s", "key", F.coalesce("saved", F.lit("null")), F.coalesce("current", F.lit("null")))
    return diff.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(part)), "; ").alias("error"))


def apply_updates(resources: DataFrame, updates: DataFrame) -> DataFrame:
    """Resources newest first, where the latest show and alpha of a name go to the first entry of that name."""
    first = Window.partitionBy("name").orderBy(F.desc("seq"))
    latest = Window.partitionBy("name").orderBy(F.desc("seq"))
    u = updates.withColumn("_r", F.row_number().over(latest)).where("_r = 1").select("name", F.col("show").alias("_show"), F.col("alpha").alias("_alpha"))
    r = resources.withColumn("_r", F.row_number().over(first)).join(u, "name", "left")
    mine = F.col("_r") == 1
    return r.withColumns({"show": F.when(mine, F.coalesce("_show", "show")).otherwise(F.col("show")), "alpha": F.when(mine, F.coalesce("_alpha", "alpha")).otherwise(F.col("alpha"))}).drop("_r", "_show", "_alpha")
