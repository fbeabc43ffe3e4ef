"""The Jaccard join and the pipeline against brute force."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from geomatch.llm import components as cc
from geomatch.llm import ngram_join
from geomatch.llm.textbytes import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def ngrams(text, n=5):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows):
    """(n_shingles, component_id) of each row, ids being distinct."""
    sets = [ngrams(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[top(i)] = top(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(i, least.get(top(k), i))
    return {i: (len(sets[k]), least[top(k)]) for k, (i, _) in enumerate(rows)}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 5)))
    passage = [word() for _ in range(60)]
    texts = [None, "", " \n\t ", "One two", "one  TWO", "one", "x\x00y z", "e' f g h i j"]
    for _ in range(10):
        base = [word() for _ in range(rng.randint(5, 150))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy + [word() for _ in range(rng.randint(0, 12))]))
        texts.append(" ".join(passage + base[:20]))
    chain = [word() for _ in range(80)]
    for k in range(40):
        chain = chain[2:] + [word(), word()]
        texts.append(" ".join(chain))
    texts += texts[10:20] + [texts[9]] * 30
    rows = list(enumerate(texts, 100))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "small"), [(1, False), (2, True)])
def test_join_equals_brute_force(spark, monkeypatch, seed, small):
    if small:  # several blocks, salts and rounds, and an order with frequent n-grams
        for name, value in {"PIVOTS": 2, "BLOCK": 2, "SALT_ROWS": 3, "HEAVY_COUNT": 5, "LOCAL_COUNT": 2, "MOST_BITS": 10}.items():
            monkeypatch.setattr(ngram_join, name, value)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "doc_id long, text string, sig string, region int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df).collect()}
    assert got == brute(rows)
    if not small:
        kept = sorted(r.doc_id for r in ngram_join.one_of_each(df).collect())
        assert kept == sorted({c for n, c in got.values() if n} | {i for i, (n, _) in got.items() if not n})


def test_join_cases(spark):
    schema = "doc_id long, text string"
    assert ngram_join.join(spark.createDataFrame([], schema)).count() == 0
    assert ngram_join.one_of_each(spark.createDataFrame([], schema)).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "A b c d e f"), (2, None), (2, None)], schema)
    assert sorted((r.doc_id or 0, r.component_id) for r in ngram_join.join(twice).collect()) == [(0, 1), (1, 1), (1, 1), (2, 2), (2, 2)]
    assert sorted(r.doc_id for r in ngram_join.one_of_each(twice).collect()) == [1, 2, 2]


def test_very_long_texts_link(spark):
    rng = random.Random(2)
    long = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    rows = [(5, " ".join(long)), (6, " ".join(long[:190_000])), (7, " ".join(long[:140_000])), (8, "short one")]
    got = {r.doc_id: r.component_id for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: 5, 6: 5, 7: 7, 8: 8}  # 190 of 200 link; 140 of 190 do not


def test_what_shares_much_and_links_nowhere_meets_in_no_region(spark):
    common = [f"c{k}" for k in range(80)]
    rows = [(i, " ".join(common + [f"o{i}x{k}" for k in range(18)])) for i in range(300)]
    # one pair among them links
    rows.append((900, rows[7][1] + " more"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in ngram_join.join(docs).collect()}
    assert got == {i: i for i in range(300)} | {900: 7}
    _, heavy = ngram_join.classes(docs, 5)
    assert ngram_join.regions(docs.select("text"), 5, 75, heavy).count() <= 4


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 160)}


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = [(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()]
        kept = written(stage(spark, kept, small), "test")
        assert kept.columns == docs.columns, name
        if name == "near duplicates":
            assert {r.doc_id for r in kept.select("doc_id").collect()} == {c for _, c in brute(rows).values()}
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, small)
    assert {"doc_id", "sequence_id", "offset", "length", "ids"} <= set(packed.columns)
    assert packed.select("doc_id").distinct().count() == kept.count()


CLASHES = "score _sig _id _key _doubt key sig row base spans masked hits items n_words ids offset length sequence_id region root positive lang_pred toxic".split()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_pipeline_stages_on_odd_rows(spark, small, name):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "mail a@b.cd now", None, "s", 15), (2, "mail a@b.cd now", None, "s", 15), (3, "w " * 60_000, "en", None, None), (4, "é and \x00 and so on", "", "", 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) if k % 2 else F.lit(k) for k, c in enumerate(CLASHES)})
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, small)
    if name == "packing":
        assert {r.doc_id for r in out.collect()} == {None, 1, 2, 3, 4}
    else:
        assert out.columns == docs.columns
        changed = {"text", "n_chars"} if name == "personal data" else set()
        same = [c for c in docs.columns if c not in changed]
        want = docs.select(*same).distinct() if name == "near duplicates" else docs.select(*same)
        assert sorted(map(str, out.select(*same).collect())) == sorted(map(str, want.collect()))
    assert stage(spark, docs.limit(0), small).count() == 0


def test_masked_text(spark, small):
    docs = spark.createDataFrame([(2, "mail a@b.cd now", 15), (3, None, None)], "doc_id long, text string, n_chars long")
    masked = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.mask_personal_data(spark, docs, small).collect()}
    assert masked[3] == (None, None)
    assert masked[2] == ("mail <email> now", 16)
