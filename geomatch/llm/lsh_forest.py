"""Near-duplicate classes by an LSH forest over MinHash signatures.

A document's set of word n-grams has a signature of ``VALUES`` minima, one byte of each. The
forest is ``TREES`` sorted orders of all signatures; in the order of tree t the signature is read
from value ``VALUES / TREES * t`` on, so that trees start with different values. Documents near to
each other in an order have the longest common prefixes. A document looks at the next ``WIDTH``
rows that share its first value, so the depth at which two documents meet is not fixed but adapts to
the region: one common value is enough where few documents lie, and where many do, as many as it
takes to be next to each other.

Rows that meet are compared by whole signatures: those whose share of equal values is ``MARGIN``
or more below the similarity (four standard deviations) go no further. Of what is left an order
gives a forest of edges, at most one a row, so that a group of copies does not grow into its pairs.
Edges are confirmed on full sets, the best of each document first, then those between different
components. Where a component of edges still holds several components of links, its documents
alone pass the forest again, with every pair between different components. So a link can be missed
only if no order brings it or a chain of links together; the recall is measured against all pairs.

Orders are partitioned by ranges of (tree, signature, class), so that equal prefixes and even equal
signatures spread over tasks; the first and last rows of neighbouring partitions meet in groups of
their own. Documents of equal sets are one class.

Defined cases: words are lowered A-Z and parted by ASCII white space; fewer words than n are one
n-gram; a null text, or one without words, has an empty set, n_shingles 0, and is linked with
nothing; very long texts are read whole; a null id is no component's least id unless all its ids
are null; repeated rows are one class and each is returned; other columns are ignored; an empty
table gives nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .ngram_join import as_long, bits_of, shingles, signatures
from .textbytes import bounded_batches, mix, row_of, text_slices, written

VALUES, TREES, WIDTH, MARGIN = 128, 16, 32, 0.14
PARTITION_ROWS = 65_536
_RANDOM = np.random.default_rng(20).integers(0, 2**63, (2, VALUES), np.uint64)
FACTORS, SALTS = _RANDOM[0] << np.uint64(1) | np.uint64(1), _RANDOM[1]


def sketches(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """(rows, VALUES) bytes: of each minimum of a set the low byte, once mixed. No set is empty."""
    first = np.searchsorted(row, np.arange(rows))
    out = np.zeros((rows, VALUES), np.uint8)
    for k in range(VALUES if rows else 0):
        out[:, k] = (mix(np.minimum.reduceat((h ^ SALTS[k]) * FACTORS[k], first)) & np.uint64(255)).astype(np.uint8)
    return out


def signed(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, sig, n_shingles, sketch) of every row: sig names its set and is null for an empty one; a task gives a set's sketch once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint64)
        for b in batches:
            for rows, data, offsets in text_slices(b):
                h, at = shingles(data, offsets, n)
                sig = signatures(h, at)
                use = np.zeros(len(sig), bool)
                use[np.unique(sig, return_index=True)[1]] = True
                use &= (sig != 0) & ~np.isin(sig, seen)
                seen = np.union1d(seen, sig[use])
                row = row_of(at)
                made = iter(sketches(h[use[row]], (np.cumsum(use) - 1)[row[use[row]]], int(use.sum())))
                sketch = [next(made).tobytes() if u else None for u in use]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(sig.view(np.int64), mask=sig == 0), pa.array(np.diff(at).astype(np.int64)), pa.array(sketch, pa.binary())], ["doc_id", "sig", "n_shingles", "sketch"])

    return written(docs.mapInArrow(run, "doc_id long, sig long, n_shingles long, sketch binary"), "signed")


class Forest:
    """Rows of one or more orders, sorted, and the pairs among rows next to each other."""

    def __init__(self, rows: pa.Table, percent: int):
        self.tree, self.sig, self.n, self.root = (rows.column(c).to_numpy() for c in ("tree", "sig", "n", "root"))
        raw = rows.column("key").combine_chunks().to_pylist()
        self.key = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), VALUES)
        self.percent, self.need = percent, int(np.ceil(VALUES * (percent / 100 - MARGIN)))

    def pairs(self, whole: bool, side: np.ndarray | None = None) -> pa.RecordBatch:
        """(a, b, equal): with ``whole`` all pairs of different roots, else a forest. With ``side`` only pairs of different sides."""
        up = np.unique(self.root, return_inverse=True)[1] if whole else np.arange(len(self.sig))
        a, b, equal = [], [], []
        for o in range(1, min(WIDTH, len(self.sig) - 1) + 1):
            low, high = np.minimum(self.n[:-o], self.n[o:]), np.maximum(self.n[:-o], self.n[o:])
            near = (self.tree[:-o] == self.tree[o:]) & (self.key[:-o, 0] == self.key[o:, 0]) & (up[:-o] != up[o:]) & (100 * low >= self.percent * high)
            if side is not None:
                near &= side[:-o] != side[o:]
            i = np.flatnonzero(near)
            same = np.concatenate([(self.key[i[k : k + 8192]] == self.key[i[k : k + 8192] + o]).sum(1) for k in range(0, len(i), 8192)] or [i])
            i, same = i[same >= self.need], same[same >= self.need]
            if not whole and len(i):
                kept = self._joined(up, i, i + o)
                i, same = i[kept], same[kept]
                while (up[up] != up).any():
                    up = up[up]
            a.append(self.sig[i])
            b.append(self.sig[i + o])
            equal.append(same)
        a, b, equal = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (a, b, equal))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(equal.astype(np.int32))], ["a", "b", "equal"])

    @staticmethod
    def _joined(up: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[int]:
        """The places of those pairs that join two trees of the forest; ``up`` follows."""
        kept = []
        for at, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            while up[x] != x:
                x = int(up[x])
            while up[y] != y:
                y = int(up[y])
            if x != y:
                up[max(x, y)] = min(x, y)
                kept.append(at)
        return kept


FOUND = "a long, b long, equal int, border long, side int, tree int, key binary, sig long, n long, root long"
ROW = ["tree", "key", "sig", "n", "root"]


def candidates(classes: DataFrame, percent: int, whole: bool) -> DataFrame:
    """(a, b, equal), a < b, of classes (sig, sketch, n, root) that lie next to each other in an order."""
    step = VALUES // TREES
    parts = max(1, -(-classes.count() * TREES // PARTITION_ROWS))
    turned = lambda t: F.expr(f"concat(substring(sketch, {step} * {t} + 1, {VALUES}), substring(sketch, 1, {step} * {t}))")
    trees = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), turned(t).alias("key")) for t in range(TREES)]))
    orders = classes.select("sig", "n", "root", trees.alias("_o")).select("_o.tree", "_o.key", "sig", "n", "root")
    orders = orders.repartitionByRange(parts, "tree", "key", "sig").sortWithinPartitions("tree", "key", "sig")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held or not sum(map(len, held)):
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        found = Forest(rows, percent).pairs(whole)
        none = lambda k, kinds: [pa.nulls(k, t) for t in kinds]
        edge = [pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([*found.columns, *none(len(found), [*edge, pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()])], names)
        # the rows at both ends meet those of the partitions before and after
        own = TaskContext.get().partitionId()
        for side, part in ((0, rows.slice(max(0, len(rows) - WIDTH))), (1, rows.slice(0, WIDTH))):
            k = len(part)
            ends = [part.column(c).combine_chunks() for c in ROW]
            yield pa.RecordBatch.from_arrays([*none(k, [pa.int64(), pa.int64(), pa.int32()]), pa.array([own - side] * k, pa.int64()), pa.array([side] * k, pa.int32()), *ends], names)

    names = [f.split()[0] for f in FOUND.split(", ")]
    found = written(orders.mapInArrow(run, FOUND), "orders")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "tree", "key", "sig"], kind="stable")
        rows = pa.Table.from_pandas(pdf[ROW], schema=pa.schema([("tree", pa.int32()), ("key", pa.binary()), ("sig", pa.int64()), ("n", pa.int64()), ("root", pa.int64())]), preserve_index=False)
        return Forest(rows, percent).pairs(whole, pdf["side"].to_numpy()).to_pandas()

    across = found.where("border is not null").groupBy("border").applyInPandas(meet, "a long, b long, equal int")
    pairs = found.where("a is not null").select("a", "b", "equal").unionByName(across)
    return written(pairs.groupBy("a", "b").agg(F.max("equal").alias("equal")), "candidates")


def sets_of(docs: DataFrame, n: int, needed: DataFrame) -> DataFrame:
    """(sig, set) of the classes in needed (sig), set being the sorted hashes."""
    sent = docs.sparkSession.sparkContext.broadcast(bits_of(needed, "sig"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint64)
        for b in batches:
            for _, data, offsets in text_slices(b):
                h, at = shingles(data, offsets, n)
                sig = signatures(h, at)
                use = np.zeros(len(sig), bool)
                use[np.unique(sig, return_index=True)[1]] = True
                use &= (sig != 0) & ~np.isin(sig, seen) & sent.value.test(sig)
                seen = np.union1d(seen, sig[use])
                raw, own = h.tobytes(), np.flatnonzero(use)
                yield pa.RecordBatch.from_arrays([as_long(sig[own]), pa.array([raw[8 * at[k] : 8 * at[k + 1]] for k in own.tolist()], pa.binary())], ["sig", "set"])

    found = docs.select("text").mapInArrow(run, "sig long, set binary").join(needed, "sig", "left_semi")
    return written(found.dropDuplicates(["sig"]), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs whose full sets are similar enough."""
    both = pairs.select("a", "b").join(sets.select(F.col("sig").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("sig").alias("b"), F.col("set").alias("y")), "b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                at = np.searchsorted(x, y)
                common = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return written(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")


def with_roots(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """pairs with the components ra, rb of both ends; what has no link is a component of its own."""
    for c in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left").withColumn(f"r{c}", F.coalesce(f"r{c}", c))
    return pairs


def class_roots(docs: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, root): the components of the links between classes (sig, sketch, n)."""
    edges = candidates(classes.withColumn("root", F.col("sig")), percent, whole=False)
    ends = edges.select(F.col("a").alias("sig"), "a", "b", "equal").unionByName(edges.select(F.col("b").alias("sig"), "a", "b", "equal"))
    nodes = written(ends.groupBy("sig").agg(F.max(F.struct("equal", "a", "b")).alias("top")), "nodes", compact=True)
    sets = sets_of(docs, n, nodes.select("sig"))
    best = written(nodes.select("top.a", "top.b").distinct(), "best", compact=True)
    links = confirmed(best, sets, percent)
    roots = components(links)
    rest = with_roots(edges.join(best, ["a", "b"], "left_anti"), roots).where("ra <> rb").select("a", "b")
    links = written(links.unionByName(confirmed(rest, sets, percent)), "links", compact=True)
    roots = components(links)
    # components of edges that hold several of links pass the forest again
    linked = roots.withColumnsRenamed({"node": "sig", "root": "link"})
    near = components(edges.select("a", "b")).withColumnsRenamed({"node": "sig", "root": "edge"}).join(linked, "sig", "left").withColumn("link", F.coalesce("link", "sig"))
    near = written(near, "near", compact=True)
    mixed = near.groupBy("edge").agg(F.min("link").alias("_l"), F.max("link").alias("_m")).where("_l <> _m").select("edge")
    again = written(near.join(mixed, "edge", "left_semi").select("sig", F.col("link").alias("root")).join(classes, "sig"), "again")
    if again.isEmpty():
        return roots
    pairs = candidates(again.select("sig", "sketch", "n", "root"), percent, whole=True)
    more = confirmed(pairs.join(edges.select("a", "b"), ["a", "b"], "left_anti"), sets, percent)
    return components(links.unionByName(more))


def deduplicate(docs: DataFrame, n: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = signed(docs, n)
    # a set's sketch and size are the same wherever they come from
    classes = written(rows.where("sketch is not null").groupBy("sig").agg(F.max("sketch").alias("sketch"), F.max("n_shingles").alias("n")), "classes")
    roots = class_roots(docs, classes, n, percent)
    own = rows.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("least"))
    known = own.join(roots, own["sig"] == roots["node"], "left").select("sig", F.coalesce("root", "sig").alias("root"), "least")
    known = written(known, "known", compact=True)
    least = written(known.groupBy("root").agg(F.min("least").alias("component_id")), "least", compact=True)
    named = known.join(least, "root").select("sig", "component_id")
    found = rows.drop("sketch").join(named, "sig", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
