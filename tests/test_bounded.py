"""What a task holds or gets at a time stays bounded, whatever the input."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from geomatch.functions.vectors import l2_normalize
from geomatch.operators import index, localization, metrics


def test_a_mosaic_block_of_many_tiles_spreads_over_tasks(spark):
    t = spark.range(3000).select(F.lit("m").alias("z"), F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("file"), (F.col("id") % 7).alias("off_x"), (F.col("id") % 5).alias("off_y"), F.lit(2).alias("width"), F.lit(1).alias("height"))
    t = t.withColumn("data", F.array((F.col("file") % 3), F.when(F.col("file") % 400 == 0, 5 + F.col("file") % 11).otherwise(0).cast("long")))
    want = np.zeros((8, 8), int)
    for r in sorted(t.collect(), key=lambda r: r.file):
        for k, v in enumerate(r.data):
            if want[r.off_y, r.off_x + k] == 0:
                want[r.off_y, r.off_x + k] = v
    blocks = metrics.mosaic_blocks(t, ["z"], 8)
    assert [np.array(r.data).reshape(8, 8).tolist() for r in blocks.collect()] == [want.tolist()]
    # tiles are dealt by their files too, not by the block alone
    plan = blocks._jdf.queryExecution().optimizedPlan().toString()
    assert any("RepartitionByExpression" in line and "file" in line and "ASC" in line for line in plan.splitlines())


def test_a_model_gets_few_patches_at_a_time(spark):
    def load():
        return lambda texts: np.full((len(texts), 1), float(len(texts)))

    patches = spark.range(1000).coalesce(1).select("id", F.lit("x").alias("data"))
    sizes = localization.embed(patches, load, 1).select("id").count()
    raw = localization.embed(patches, lambda: lambda texts: np.array([[float(len(texts)), 1.0]] * len(texts)), 2)
    assert sizes == 1000 and max(round(r.vector[0] / r.vector[1]) for r in raw.collect()) <= localization.PATCHES


def test_visits_leave_a_task_in_small_frames():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 4))
    v /= np.linalg.norm(v, axis=1)[:, None]
    pdf = pd.DataFrame({"q_row": np.arange(300), "v": list(v), "bar": np.full(300, np.nan)})
    frames = list(index.left_open(pdf, v[:100], np.ones(100), np.arange(100), 4, True))
    assert max(map(len, frames)) <= index.VISITS and sum(map(len, frames)) == 300 * 96
    near = list(index.left_open(pdf, v[:100], np.ones(100), np.arange(100), 4, False))
    both = pd.concat([*frames, *near])
    assert len(both) == len(both.drop_duplicates(["q_row", "list"])) == 300 * 100


def test_a_norm_is_worked_out_once_a_vector(spark):
    import time

    v = F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda x: (x % 5).cast("double"))
    began = time.time()
    # norm by norm for each element this would be 4 billion steps
    rows = spark.range(10).select(l2_normalize(F.when(F.col("id") > 0, v)).alias("v")).collect()
    assert time.time() - began < 20
    assert rows[0].v is None and all(abs(sum(x * x for x in r.v) - 1) < 1e-9 for r in rows[1:])
    assert spark.range(1).select(l2_normalize(F.array(F.lit(0.0), F.lit(0.0))).alias("v")).first().v == [0.0, 0.0]


def test_hidden_tiles_go_before_the_shuffle(monkeypatch):
    rng = np.random.default_rng(5)
    n = 4000
    w, h = rng.integers(1, 5, n), rng.integers(1, 4, n)
    rows = {"z": rng.choice(["a", "b"], n), "file": rng.permutation(n) * 10**12, "off_x": rng.integers(-9, 20, n), "off_y": rng.integers(0, 9, n), "width": w, "height": h, "data": [rng.integers(0, 3, a * b) * rng.integers(0, 2) for a, b in zip(w, h)]}
    rows["off_x"][:20] = 10**9 + 10 * np.arange(20)  # far apart, not dense

    def mosaic(t):
        out = {}
        for r in sorted(t, key=lambda r: r["file"]):
            for k, v in enumerate(r["data"]):
                at = (r["z"], r["off_x"] + k % r["width"], r["off_y"] + k // r["width"])
                out[at] = out.get(at, 0) or v
        return out

    table = pa.table(rows)
    want = mosaic(table.to_pylist())
    for pixels, most in ((1 << 20, 900), (500, n), (1, n)):
        monkeypatch.setattr(metrics, "ROUND_PIXELS", pixels)
        for typed in (table, table.set_column(1, "file", table["file"].cast(pa.decimal128(38, 0)))):
            kept = [r for b in metrics.seen(typed.to_batches(max_chunksize=700), ["z"]) for r in b.to_pylist()]
            assert mosaic(kept) == want and len(kept) <= most
    # tiles that do not fit their size are not judged
    bad = table.slice(0, 5).set_column(4, "width", pa.array([50] * 5))
    assert sum(b.num_rows for b in metrics.seen(bad.to_batches(), ["z"])) == 5
    assert list(metrics.seen(table.slice(0, 0).to_batches(), ["z"])) == []


def test_mosaic_files_of_many_orders(spark, small, tmp_path):
    from geomatch.plans import registry

    line = spark.read.parquet(f"{small}/lineitem.parquet")
    line.withColumn("l_orderkey", F.col("l_orderkey") + 54_000_000).write.parquet(str(tmp_path / "lineitem.parquet"))
    got, want = (sorted(map(tuple, registry.QUERIES["a12_mosaic_blocks"](spark, d).collect())) for d in (str(tmp_path), small))
    assert got == want
