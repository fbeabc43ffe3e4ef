"""The vector index against exact search, and what it reads."""

from __future__ import annotations

import numpy as np
import pytest

from geomatch.operators import index, search


def points(seed, n, clusters, d=16):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d))
    if clusters:
        v += 6 * rng.normal(size=(clusters, d))[rng.integers(0, clusters, n)]
    return [(int(i), x.tolist()) for i, x in enumerate(v)]


def hits(df):
    return sorted((r.query_id, r.rank, r.id, round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize("clusters", [0, 12])
def test_exact_search_equals_a_scan(spark, tmp_path, monkeypatch, clusters):
    monkeypatch.setattr(index, "PART_ROWS", 25)
    monkeypatch.setattr(index, "QUERY_ROWS", 16)
    rows = points(1, 700, clusters)
    rows += [(7, rows[8][1])] * 3 + [(2000, None), (2001, []), (2002, [1.0] * 15 + [float("nan")]), (2003, [0.0] * 16)]
    p = spark.createDataFrame(rows, "id long, vector array<double>").repartition(4)
    q = p.where("id % 30 = 0").withColumnRenamed("id", "query_id")
    built = index.VectorIndex.build(p, str(tmp_path / "i"))
    found = built.search(q, 5)
    sound = p.where("id < 2000 or id = 2003")
    assert hits(found.hits) == hits(search.knn(q, sound, 5).select("query_id", "id", "score", "rank"))
    codes, vectors = found.reads(24, 704)
    assert vectors < 0.03 and (codes < 0.2 if clusters else codes > 0.9)
    if clusters:
        # a few lists only, whose folders are all that is read
        few = built.search(q, 5, probes=5)
        assert search.recall(few.hits, search.knn(q, sound, 5)).first()[0] >= 0.9 and few.reads(24, 704)[0] < 0.1
        plan = built.of_lists("codes", [3, 5], 10**6)._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [list" in plan and "(3,5)" in plan


def test_probes_grow_with_the_lists_of_a_cluster(spark, tmp_path):
    p = spark.createDataFrame(points(3, 1500, 4), "id long, vector array<double>")
    q = p.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    built = index.VectorIndex.build(p, str(tmp_path / "i"), lists=80)
    exact = search.knn(q, p, 5)
    recall = lambda found: search.recall(found.hits, exact).first()[0]
    four, more = built.search(q, 5, probes=4, least=0), built.search(q, 5, probes=4)
    assert recall(four) < 0.9 <= recall(more)
    assert four.reads(150, 1500)[0] < more.reads(150, 1500)[0] < 0.4


def test_queries_of_few_hits_are_filled(spark, tmp_path):
    rows = [(i, [1.0, 0.01 * i]) for i in range(30)] + [(100, [-1.0, 0.0]), (None, [-1.0, 0.001])]
    p = spark.createDataFrame(rows, "id long, vector array<double>")
    built = index.VectorIndex.build(p, str(tmp_path / "i"), lists=6)
    q = spark.createDataFrame([("a", [-1.0, 0.0]), ("b", None)], "query_id string, vector array<double>")
    got = built.search(q, 4, probes=1).hits.orderBy("rank").collect()
    assert [(r.query_id, r.id) for r in got][:2] == [("a", 100), ("a", None)] and len(got) == 4
    assert built.search(q, 100).hits.count() == 32
    assert built.search(q.limit(0), 4).hits.count() == 0
    with pytest.raises(ValueError):
        index.VectorIndex.build(p.limit(0), str(tmp_path / "none"))
