"""Hard negatives against brute force in Python's integers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from geomatch.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, v string, score string, `copies` int"


def brute(rows, k=5):
    def ints(v):
        ok = v and all(x is not None and math.isfinite(x) for x in v)
        return [math.floor(256 * x) if abs(x) < 1e15 else int(256 * x) for x in v] if ok else None

    rows = [(i, ints(v), label) for i, v, label in rows if label is not None and ints(v)]
    key = lambda x: (-x[1], x[0] is None, x[0] or 0)
    clamp = lambda s: max(-(2**63), min(2**63 - 1, s))
    out = []
    for a in rows:
        if a[0] is None or a[0] % 100:
            continue
        scored = [(c[0], clamp(sum(x * y for x, y in zip(a[1], c[1]))), c[2] == a[2]) for c in rows if c[0] != a[0] and len(c[1]) == len(a[1])]
        for p, ps, _ in sorted([x for x in scored if x[2]], key=key)[:k]:
            found = sorted([x for x in scored if not x[2] and 80 * ps <= 100 * x[1] <= 100 * ps], key=key)[:k]
            out += [(a[0], p, r, n, ps, ns) for r, (n, ns, _) in enumerate(found, 1)]
    return out


def vectors(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        size = rng.choice([3, 3, 3, 2])
        rows.append((rng.choice([i, 100 * i, 25 * i]), [rng.choice([-1.0, -0.5, 0.25, 0.5, 0.75, 1.0]) for _ in range(size)], rng.randrange(4)))
    rows += [(None, [1.0, 1.0, 0.5], 1), (None, [1.0, 0.75, 0.5], 2), (2**62, [1.0, 1.0, 1.0], 3), (5, None, 1), (6, [], 1), (7, [1.0, None, 1.0], 1), (8, [1.0, math.nan, 1.0], 1), (9, [math.inf] * 3, 1), (10, [1.0] * 3, None)]
    rows += [(300, [1e300, 0.5, 1.0], 1), (301, [1e299, -0.5, 1.0], 1), (302, [1e17, 1.0, 1.0], 0), (400, [3e4, 2e4, 1.0], 2), (401, [-3e4, 2e4, 1.0], 1)]
    return rows + [rows[4]] * 9 + [rows[0]]


@pytest.mark.parametrize(("seed", "small"), [(1, False), (2, True)])
def test_mine_equals_brute_force(spark, monkeypatch, seed, small):
    if small:
        for name, value in {"ROWS_PER_BLOCK": 40, "ANCHORS_PER_BLOCK": 10, "LEAF": 2, "FAN": 2}.items():
            monkeypatch.setattr(hn, name, value)
    rows = vectors(seed)
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(4)
    got = [tuple(r) for r in hn.mine(df, df.where("vec_id % 100 = 0")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))
    none = df.limit(0)
    assert hn.mine(none, none).count() == 0 and hn.mine(df, none).count() == 0


def test_boxes_hold_their_vectors_and_spare_leaves():
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 5, 4000)
    v = np.floor(rng.normal(size=(4000, 3)) * 20 + 300 * rng.normal(size=(5, 3))[labels])
    tree = hn.RTree(v, labels)
    assert sorted(tree.rows.tolist()) == list(range(4000)) and set(tree.roots) == set(range(5))

    def inside(node):
        if tree.leaf[node]:
            return tree.v[tree.first[node] : tree.last[node]]
        return np.concatenate([inside(c) for c in range(tree.first[node], tree.last[node])])

    q = np.floor(rng.normal(size=(3, 3)) * 100)
    low, high = tree.intervals(q)
    for node in range(len(tree.first)):
        own = inside(node)
        assert (own.min(0) == tree.low[node]).all() and (own.max(0) == tree.high[node]).all()
        assert ((low[:, node] <= (q @ own.T).min(1)) & (high[:, node] >= (q @ own.T).max(1))).all()
    found = hn.Windows([-(2**63)], [2**63 - 1], 5)
    read = hn.walk(tree, list(tree.roots.values()), low[0], high[0], q[0], np.ones(4000, bool), found)
    assert found.scores[0].tolist() == sorted((v @ q[0]).astype(int).tolist(), reverse=True)[:5]
    assert read < sum(tree.leaf) / 5
