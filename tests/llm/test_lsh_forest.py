"""The forest of signatures against brute force over all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from geomatch.llm import lsh_forest as lf

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def grams(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [grams(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[top(i)] = top(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(i, least.get(top(k), i))
    return {i: (len(sets[k]), least[top(k)], least[top(k)] == i) for k, (i, _) in enumerate(rows)}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 5)))
    common = [word() for _ in range(60)]
    texts = [None, "", " \n\t ", "One two", "one  TWO", "one", "x\x00y z", "e' f g h i j"]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(5, 150))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
        # much in common with each other, no link
        texts.append(" ".join(common + base[:25]))
    chain = [word() for _ in range(90)]
    for _ in range(40):
        chain = chain[2:] + [word(), word()]
        texts.append(" ".join(chain))
    texts += texts[10:20] + [texts[9]] * 30
    rows = list(enumerate(texts, 100))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "small"), [(1, False), (2, True)])
def test_classes_equal_brute_force(spark, monkeypatch, seed, small):
    if small:  # many partitions with borders between them
        monkeypatch.setattr(lf, "PARTITION_ROWS", 150)
        monkeypatch.setattr(lf, "WIDTH", 12)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "doc_id long, text string, sig string, root int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in lf.deduplicate(df).collect()}
    assert got == brute(rows)


def test_a_group_of_copies_gives_few_edges(spark):
    rng = random.Random(5)
    base = [str(rng.randrange(10**6)) for _ in range(400)]
    rows = []
    for i in range(600):
        copy = list(base)
        for _ in range(5):
            copy[rng.randrange(400)] = str(rng.randrange(10**6))
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = lf.signed(docs, 2)
    classes = signed.selectExpr("sig", "sketch", "n_shingles as n", "sig as root")
    assert lf.candidates(classes, 80, whole=False).count() < lf.TREES * 600
    assert {r.component_id for r in lf.deduplicate(docs).collect()} == {0}


def test_edges(spark):
    schema = "doc_id long, text string"
    assert lf.deduplicate(spark.createDataFrame([], schema)).count() == 0
    long = "word " * 300_000
    rows = [(None, "a b c"), (None, "a b c"), (4, "a b c"), (None, "d e"), (None, None), (7, None), (7, "d e f g"), (9, long), (8, long + "end")]
    got = sorted(str(tuple(r)) for r in lf.deduplicate(spark.createDataFrame(rows, schema)).collect())
    want = [(None, 2, 4, False)] * 2 + [(4, 2, 4, True), (None, 1, None, False), (None, 0, None, False), (7, 0, 7, True), (7, 3, 7, True), (9, 1, 9, True), (8, 2, 8, True)]
    assert got == sorted(map(str, want))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(6)
    common, own = rng.integers(0, 2**63, 900, np.uint64), rng.integers(0, 2**63, 100, np.uint64)
    h = np.r_[common, own[:50], common, own[50:]]
    row = np.r_[np.zeros(950, int), np.ones(950, int)]
    a, b = lf.sketches(h, row, 2)
    assert abs((a == b).mean() - 0.9) < 0.12
