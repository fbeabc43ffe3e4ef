"""Language identification by error-correcting output codes.

Every learned language has a codeword of bits. A logistic classifier for each bit, over hashed
byte n-grams of the lowered text, is trained in numpy on a bounded sample (``per_language`` rows
of each language, lowest hash first). A text's bit margins are decoded to the codeword of least
exponential loss, each bit weighted by how well its classifier did in training; two codewords whose
losses differ by less than a factor of three make the answer ambiguous. Every text is read whole.

Defined cases: a null text, or one without any letter, is ``und`` with score 0 and not ambiguous;
so is every text if no language is known; with one known language every text with a letter has
it; languages of equal loss go to the first name in order, and are ambiguous; rows of null lang
teach nothing; an id that repeats teaches one of its rows; very long texts are read whole, in
bounded slices of rows; ids may be null or repeat; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textbytes import bounded_batches, text_slices
from .toxicity import lowered

DIM_BITS = 12
PER_LANGUAGE = 600
#: Rows to learn from: about so many, more if a language would have under LEAST, up to LARGEST in all.
ROWS, LEAST, LARGEST = 6000, 20, 20_000
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def histograms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of hashed 1- to 4-gram counts as square roots, at unit length."""
    n, dim = len(offsets) - 1, 1 << DIM_BITS
    out = np.zeros((n, dim), np.float32)
    code = _LETTERS[lowered(data)].astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    gram = np.zeros(len(code), np.uint32)
    for k in range(1, 5):
        gram = gram[: len(code) - k + 1] * np.uint32(0x01000193) + code[k - 1 :]
        if not len(gram):
            break
        inside = row[: len(gram)] == row[k - 1 :]
        place = ((gram * np.uint32(0x9E3779B1)) ^ np.uint32(k * 0x05EBCA6B)) >> np.uint32(32 - DIM_BITS)
        key = row[: len(gram)][inside] * dim + place[inside]
        out += np.bincount(key, minlength=n * dim).reshape(n, dim).astype(np.float32)
    out = np.sqrt(out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def most_alike(c: np.ndarray, rows: int = 1024) -> int:
    """The largest product of two different rows."""
    most = -c.shape[1]
    for k in range(0, len(c), rows):
        like = c[k : k + rows] @ c.T
        like[np.arange(len(like)), np.arange(k, k + len(like))] = -np.inf
        most = max(most, int(like.max()))
    return most


def codewords(n: int) -> np.ndarray:
    """n distinct rows of +1 and -1: all splits for up to 5 languages, else seeded random ones."""
    if n <= 5:
        splits = np.arange(1, 1 << (n - 1))
        bits = (splits[None, :] >> np.arange(n)[:, None]) & 1
        return bits * 2 - 1
    width = 15 * int(np.ceil(np.log2(n)))
    rng = np.random.default_rng(0)
    best, widest = None, -1
    for _ in range(50):
        c = rng.integers(0, 2, (n, width)) * 2 - 1
        apart = (width - most_alike(c.astype(np.float32))) // 2
        if apart > widest and (np.abs(c.sum(0)) < n).all():
            best, widest = c, apart
    return best


@dataclass
class Model:
    names: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, its share, how far the next one's loss lies above its own, from 0 to 1) of each row."""
        if len(self.names) == 1:
            return np.zeros(len(x), int), np.ones(len(x)), np.ones(len(x))
        z = np.clip(x @ self.weights + self.bias, -6, 6)
        up, down = (self.codes > 0).T.astype(float), (self.codes < 0).T.astype(float)
        loss = (np.exp(-z) * self.trust) @ up + (np.exp(z) * self.trust) @ down
        share = np.exp(-(loss - loss.min(1, keepdims=True)))
        share /= share.sum(1, keepdims=True)
        order = np.argsort(-share, axis=1, kind="stable")
        at = np.arange(len(x))
        least, next_ = loss[at, order[:, 0]], loss[at, order[:, 1]]
        return order[:, 0], share[at, order[:, 0]], (next_ - least) / np.maximum(next_ + least, 1e-12)


def fit_bits(x: np.ndarray, target: np.ndarray, steps: int = 150, rate: float = 30.0) -> tuple[np.ndarray, np.ndarray]:
    """A logistic classifier for each column of target (+1, -1), classes weighted evenly; momentum descent."""
    w, b = np.zeros((x.shape[1], target.shape[1]), np.float32), np.zeros(target.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    share = (target > 0).mean(0)
    weight = np.where(target > 0, 0.5 / np.maximum(share, 1e-9), 0.5 / np.maximum(1 - share, 1e-9)).astype(np.float32)
    for _ in range(steps):
        z = np.clip(x @ w + b, -30, 30)
        g = (-target * weight / (1 + np.exp(target * z)) / len(x)).astype(np.float32)
        vw = 0.9 * vw - rate * 0.1 * (x.T @ g + 1e-5 * w)
        vb = 0.9 * vb - rate * 0.01 * g.sum(0)
        w, b = w + vw, b + vb
    return w, b


def train(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE) -> Model | None:
    """``learn`` is a condition on doc_id that holds for the rows to learn from; every language of
    them is learned, only the rows drawn of each are bounded."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).where(learn).where("lang is not null and doc_id is not null")
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    names = sorted(sizes)
    if not names:
        return None
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    per = max(1, min(per_language, max(ROWS // len(names), min(LEAST, LARGEST // len(names)))))
    # a share of each language by hash, several times what is needed, before rows of a language meet
    shares = spark.createDataFrame([(n, min(1.0, 6 * per / sizes[n])) for n in names], "lang string, _share double")
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 20)) < F.col("_share") * (1 << 20)
    picked = known.join(F.broadcast(shares), "lang").where(drawn).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per).select("doc_id").distinct()
    # at most LARGEST ids (or one a language) are broadcast
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null").join(F.broadcast(picked), "doc_id")
    # an id that repeats teaches one row, always the same
    one = Window.partitionBy("doc_id").orderBy("lang", F.xxhash64("text"))
    sample = sample.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, data, offsets in text_slices(b):
                x = histograms(data, offsets).astype(np.float16)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "lang", "x"])

    got = sample.mapInArrow(run, "doc_id long, lang string, x binary").toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).reshape(len(got), -1).astype(np.float32)
    codes = codewords(len(names))
    if len(names) == 1:
        return Model(names, codes, np.zeros((x.shape[1], 0), np.float32), np.zeros(0, np.float32), np.zeros(0))
    target = codes[np.searchsorted(names, np.array(got.column("lang").to_pylist(), str))]
    w, b = fit_bits(x, target)
    wrong = np.clip(((x @ w + b) * target <= 0).mean(0), 1e-3, 0.499)
    trust = np.log((1 - wrong) / wrong)
    return Model(names, codes, w, b, trust / trust.sum() * codes.shape[1])


def predict(docs: DataFrame, model: Model | None, ambiguous_below: float = 0.5) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for each row of docs (doc_id, text).

    With losses a and b of the best two codewords, (b - a) / (b + a) under ``ambiguous_below`` is ambiguous.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            for rows, data, offsets in text_slices(b):
                letters = (_LETTERS[data] != 32) & (data < 128)
                sums = np.r_[0, np.cumsum(letters)]
                has = sums[offsets[1:]] > sums[offsets[:-1]]
                texts = rows.column("text")
                for i in np.flatnonzero(~has):  # no ASCII letter: look at the characters
                    has[i] = any(c.isalpha() for c in texts[int(i)].as_py() or "")
                if m is None:
                    has[:] = False
                    names, score, doubt = ["und"] * len(has), np.zeros(len(has)), np.zeros(len(has), bool)
                else:
                    k, share, margin = m.predict(histograms(data, offsets))
                    names = [m.names[j] if ok else "und" for j, ok in zip(k, has, strict=True)]
                    score, doubt = np.where(has, share, 0.0), has & (margin < ambiguous_below)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(doubt)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")
