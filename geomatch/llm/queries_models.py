"""Queries over trained models, and the n-gram join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, ngram_join, pii, toxicity
from .queries_text import LOWER, UPPER, table

THRESHOLD = 0.3


def remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), remainder(4) != 2)
    scored = toxicity.score(docs.select("doc_id", F.col("text").cast("string").alias("text")), model, ["doc_id", "text"])
    return scored.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, remainder(5) != 0)
    return language_id.predict(docs, model).select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), n=5, percent=75)


def spans_text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


OP6_SQL = rf"""
with recursive d as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') as ws from documents
), s as (
    select distinct doc_id, array_to_string(ws[k:k + 4], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as k from d where len(ws) > 0)
), n as (select doc_id, count(*) as n from s group by doc_id),
e as (
    select x.a, x.b from (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2) x
    join n na on na.doc_id = x.a join n nb on nb.doc_id = x.b where 100 * common >= 75 * (na.n + nb.n - common)
), reach as (select doc_id, doc_id as other from d union select r.doc_id, e.b from reach r join e on e.a = r.other)
select d.doc_id, coalesce(n.n, 0) as n_shingles, (select min(other) from reach r where r.doc_id = d.doc_id) as component_id from d left join n using (doc_id)
"""


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    # the counts are of the base spans, as base_sha256 is; spans lists those of the field too
    counts = [count_of("base", k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("spans").alias("spans"))


QUERIES = {"op1_toxicity": op1_toxicity, "op2_language_id": op2_language_id, "op6_ngram_join": op6_ngram_join, "op9_pii": op9_pii}
ORACLES = {"op6_ngram_join": OP6_SQL}
