"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its result is
written as Parquet to the shared folder and read again. All but the last return the columns of
documents, and whatever other columns docs has, unchanged and of any name: operators only see
doc_id, text and one struct of the rest.

All stages: a null text counts as empty and stays null; ids may be null or repeat; very long texts
are read whole; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomatch.llm import decontamination, ngram_join, packing, pii, toxicity
from geomatch.llm.queries_models import THRESHOLD, remainder
from geomatch.llm.queries_text import VOCABULARY, table
from geomatch.llm.textbytes import carried, clear, last, mark, restored, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold; repeated rows have one score, so all or none stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), remainder(4) != 2)
    kept = toxicity.score(carried(docs), model, ["row", "doc_id", "text"]).where(F.col("score") < THRESHOLD)
    return restored(kept, docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of links the document of the least doc_id, once, a null id after all others;
    documents without words link with nothing and all stay."""
    return ngram_join.one_of_each(docs, n=5, percent=75)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of an item occurs, whether that item has an id or not."""
    found = decontamination.find(carried(docs), table(spark, sf_dir, "benchmark"), columns=["row", "doc_id", "text"])
    return restored(found.where(F.size("hits") == 0), docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, each span's place taken by its kind; n_chars, where there is one, is counted anew."""
    masked = restored(pii.find(carried(docs), ["row", "doc_id", "text"]), docs.columns, "masked")
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, one for an empty text too, and their places in sequences."""
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path(VOCABULARY), window=2048, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal data", mask_personal_data),
    ("packing", pack_sequences),
]

#: Trained models, graph components and tokenisation have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage gives; a stage's own tables, and what it read, are deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    since = mark()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        clear(spark, since, keep=last())
    return docs
