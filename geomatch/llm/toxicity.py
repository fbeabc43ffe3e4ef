"""Toxicity by non-negative positive-unlabelled learning.

A logistic classifier over words and word beginnings is trained in numpy from confirmed toxic
documents and unlabelled ones. The risk of the unlabelled documents as negatives is corrected by
the class prior, and where that correction would make it negative, the step undoes the overfit
instead. Training reads a bounded sample (``positives`` and ``unlabelled`` ids, lowest hash
first, one row an id, of which those that share their least word shingle count once) and keeps the
``n_features`` most telling features at most; the prior is the toxic share of all labelled rows of
the learning part. Where no feature is telling in that sample, as there is little but copies, the
copies count too and less is asked of a feature (a score of 3, not 4, standard deviations). Scoring
looks at every word of every text.

Defined cases: a null or empty text has the score of no evidence; without a confirmed toxic row
every score is 0; ids may be null or repeat, a repeated row is scored again, and of rows of one id
the one of the least text teaches; very long texts are read whole, and their features' density is
a share of all their words; label rows that are
null or disagree count as toxic only where toxic = 1; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ngram_join import shingles
from .textbytes import Spans, bounded_batches, byte_table, row_of, text_slices, word_spans, written

WORDS = byte_table(lambda b: b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122)
PREFIXES = (4, 5, 6, 7, 8)
POSITIVES, UNLABELLED, FEATURES = 4000, 8000, 4096
SLOTS = 20
DENSE = 50


def lowered(data: np.ndarray) -> np.ndarray:
    """Capital Latin-1 letters of UTF-8 to small ones; ASCII is lowered by the word table."""
    out = data.copy()
    if len(out) > 1:
        up = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][up] += 0x20
    return out


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of whole words, then of word beginnings of each length in bytes."""
    low, start, end, before = word_spans(WORDS, lowered(data), offsets)
    spans, row = Spans(low), row_of(before)
    yield row, spans.hashes(start, end)  # first, as the caller counts words by it
    for k in PREFIXES:
        long = end - start > k
        start, end, row = start[long], end[long], row[long]
        yield row, spans.hashes(start, start + k)


@dataclass
class Model:
    """Sorted feature hashes, their weights for presence and then for density, and a bias."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        # features that share a slot are rare: the table keeps where a slot's keys begin
        slot = (self.keys >> np.uint64(64 - SLOTS)).astype(np.int64)
        self.table = np.full(1 << SLOTS, -1, np.int32)
        self.table[slot[::-1]] = np.arange(len(slot), dtype=np.int32)[::-1]
        self.deep = int(np.bincount(slot).max()) if len(slot) else 0

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (row, feature) pairs, and how dense the feature is: its share of the row's words times DENSE, at most 1."""
        found, words = [np.zeros(0, np.int64)], None
        size = max(1, len(self.keys))
        for row, h in features(data, offsets):
            if words is None:
                words = np.bincount(row, minlength=len(offsets) - 1)
            at = self.table[(h >> np.uint64(64 - SLOTS)).astype(np.int64)]
            near = np.flatnonzero(at >= 0)
            for step in range(self.deep):
                k = np.minimum(at[near] + step, len(self.keys) - 1)
                ok = self.keys[k] == h[near]
                if step:
                    ok &= at[near] + step < len(self.keys)
                found.append(row[near[ok]] * size + k[ok])
        pairs, counts = np.unique(np.concatenate(found), return_counts=True)
        row = pairs // size
        return row, pairs % size, np.minimum(1.0, DENSE * counts / words[row])

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n, size = len(offsets) - 1, len(self.keys)
        z = np.full(n, self.bias)
        if size:
            row, k, rate = self.hits(data, offsets)
            z += np.bincount(row, self.weights[k] + self.weights[size + k] * rate, minlength=n)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit_risk(doc: np.ndarray, feature: np.ndarray, value: np.ndarray, positive: np.ndarray, n_features: int, prior: float, steps: int = 300, rate: float = 0.1, decay: float = 2e-3) -> tuple[np.ndarray, float]:
    """Minimises prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) for the logistic loss, by Adam.

    ``doc``, ``feature`` and ``value`` are the entries of the design matrix; ``positive`` says
    of each document whether it is a confirmed positive or an unlabelled one.
    """
    n = len(positive)
    w, b = np.zeros(n_features), float(np.log(prior / (1 - prior)))
    m1, m2 = np.zeros(n_features + 1), np.zeros(n_features + 1)
    n_p, n_u = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    for t in range(1, steps + 1):
        z = np.clip(b + np.bincount(doc, w[feature] * value, minlength=n), -50, 50)
        p = 1 / (1 + np.exp(-z))
        as_negative = np.logaddexp(0, z)
        rest = as_negative[~positive].mean() - prior * as_negative[positive].mean()
        # d loss / d z of each document
        rest_grad = np.where(positive, -prior * p / n_p, p / n_u)
        up_grad = np.where(positive, prior * (p - 1) / n_p, 0.0)
        g = up_grad + rest_grad if rest >= 0 else -rest_grad
        grad = np.r_[np.bincount(feature, g[doc] * value, minlength=n_features) + decay * w / n_features * 50, g.sum()]
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
        step = rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def train(docs: DataFrame, labels: DataFrame, learn: Column, positives: int = POSITIVES, unlabelled: int = UNLABELLED, n_features: int = FEATURES) -> Model:
    """``learn`` is a condition on doc_id that holds for the rows labels may be taken from."""
    spark = docs.sparkSession
    bounded_batches(spark)
    toxic = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(learn).where("doc_id is not null and toxic is not null")
    n_pos, n_all = toxic.agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)), F.count("*")).first()
    if not n_pos:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -50.0)
    prior = min(0.9, n_pos / n_all)
    low = F.xxhash64("doc_id")
    yes = toxic.where("toxic = 1").select("doc_id").distinct().orderBy(low, "doc_id").limit(positives).withColumn("positive", F.lit(True))
    other = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(learn).where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(unlabelled).withColumn("positive", F.lit(False))
    # at most positives + unlabelled rows of ids are broadcast
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(yes.unionByName(other)), "doc_id")
    picked = picked.groupBy("doc_id", "positive").agg(F.min("text").alias("text"))

    def sketched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, data, offsets in text_slices(b):
                h, at = shingles(data, offsets, 5)
                least = np.r_[h, np.uint64(0)][at[:-1]]
                yield pa.RecordBatch.from_arrays([rows.column("text"), rows.column("positive"), pa.array(np.where(np.diff(at) > 0, least, np.uint64(0)).view(np.int64))], ["text", "positive", "same"])

    # a text with many copies, near ones too, teaches few times: else all of its words would look telling;
    # written, as several jobs read the sample
    picked = written(picked.mapInArrow(sketched, "text string, positive boolean, same long"), "sample")
    few = written(picked.groupBy("positive", "same").agg(F.min("text").alias("text")).orderBy("same", "positive").select("text", "positive"), "taught")

    def occurring(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, data, offsets in text_slices(b):
                row, h = (np.concatenate(x) for x in zip(*features(data, offsets), strict=True))
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                new = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])][: len(row)]
                positive = np.asarray(rows.column("positive").to_numpy(zero_copy_only=False), bool)[row[new]]
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(positive)], ["h", "positive"])

    def telling(rows: DataFrame, least: float) -> np.ndarray:
        """Hashes of the features that toxic rows have far more often than others, at most n_features."""
        n = {r.positive: r["count"] for r in rows.groupBy("positive").count().collect()}
        sums = rows.mapInArrow(occurring, "h long, positive boolean").groupBy("h").agg(F.sum(F.col("positive").cast("long")).alias("p"), F.sum((~F.col("positive")).cast("long")).alias("u"))
        lift = F.log((F.col("p") + 0.5) / max(1, n.get(True, 0))) - F.log((F.col("u") + 0.5) / max(1, n.get(False, 0)))
        chosen = sums.where("p >= 5").withColumn("z", lift / F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("u") + 0.5))).where(F.col("z") > least).orderBy(F.desc("z"), "h").limit(n_features).select("h").toArrow()
        return np.sort(chosen.column("h").to_numpy().view(np.uint64))

    keys = telling(few, 4.0)
    if len(keys):
        picked = few
    else:  # where there is little but copies, they count
        picked = picked.orderBy("same", "positive", "text").select("text", "positive")
        keys = telling(picked, 3.0)
    blank = Model(keys, np.zeros(2 * len(keys)), 0.0)
    sent = spark.sparkContext.broadcast(blank)

    def selected(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, data, offsets in text_slices(b):
                row, k, rate = sent.value.hits(data, offsets)
                at = pa.array(np.searchsorted(row, np.arange(len(offsets))), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (k.astype(np.int32), rate)]
                yield pa.RecordBatch.from_arrays([rows.column("positive"), *lists], ["positive", "k", "rate"])

    got = picked.mapInArrow(selected, "positive boolean, k array<int>, rate array<double>").toArrow()
    positive = got.column("positive").to_numpy().astype(bool)
    sizes = pc.list_value_length(got.column("k")).to_numpy()
    doc = np.repeat(np.arange(len(positive)), sizes)
    feature = pc.list_flatten(got.column("k")).to_numpy().astype(np.int64)
    if not len(keys) or not positive.any() or positive.all():
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))))
    rate = pc.list_flatten(got.column("rate")).to_numpy()
    w, b = fit_risk(np.r_[doc, doc], np.r_[feature, feature + len(keys)], np.r_[np.ones(len(rate)), rate], positive, 2 * len(keys), prior)
    return Model(keys, w, b)


def score(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """``columns`` of docs (text among them) with score double; a column of that name is left out."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(*[c for c in columns if c.lower() != "score"])
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, data, offsets in text_slices(b):
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(sent.value.scores(data, offsets), pa.float64())], [*rows.schema.names, "score"])

    return docs.mapInArrow(run, docs.withColumn("score", F.lit(0.0)).schema)
