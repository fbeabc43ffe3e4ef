"""Exact Jaccard join of documents' word n-gram sets in metric space.

The Jaccard distance d is a metric. Documents of equal sets form one class first. Two classes can
only link (d <= 1 - t) if their prefixes, the first (1 - t + 0.15) n of a set in one order of all
n-grams, share at least 0.15 n n-grams; the order puts those that many documents hold last. Every
shared prefix n-gram names its least class as a seed, and the classes that meet the same seed form
a region, but for those with fewer than 0.15 n shared ones, which link with nothing. So any linking
pair lies together in some region.

A region is split by pivots, more in each round. Every member is compared with the round's
pivots: within 1 - t it is linked and closed, its nearest pivot being the centre of its Voronoi
cell. Members still open give the next round's pivots, until none is open. By the triangle
inequality a link between two closed members x, y with y in the cell of q puts x within
1 - t and the cell's radius of q: these windows hold copies of the boundary members, of those only
that are not yet in the component of q. A window member then becomes a pivot of its own against the
members of the cell. Classes first meet in one region each, then recursively in those regions that
still hold several components. So every link is found, or joins classes that are connected already;
copies are never expanded into all pairs.

Rows of a region are dealt by (region, block of pivots, salt), with at most ``BLOCK`` pivots and
about ``SALT_ROWS`` members in one group, so that a hot region spreads over tasks. Sets are taken
as 64-bit hashes of n-grams, classes as a 64-bit hash of the set.

Defined cases: words are lowered A-Z and parted by ASCII white space; fewer words than n are one
n-gram; a null text, or one without words, has an empty set, n_shingles 0, and is linked with
nothing; documents of a null id share no id with others and their component_id is the least id of
their component, or null if it has none; repeated ids keep a row each; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .textbytes import Spans, bounded_batches, byte_table, carried, mix, restored, row_of, text_slices, word_spans, written

WORDS = byte_table(lambda b: b != 32 and not 9 <= b <= 13)
HEAVY_COUNT, HEAVY_LIMIT, LOCAL_COUNT = 64, 1_000_000, 4
MOST_BITS = 28
EXTRA = 15
PIVOTS, BLOCK, SALT_ROWS = 16, 64, 1024
_K = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes sorted within each row, how many lie before each row) of the distinct n-grams."""
    low, start, end, before = word_spans(WORDS, data, offsets)
    w, row = Spans(low).hashes(start, end), row_of(before)
    if len(w) >= n:
        acc = w[: len(w) - n + 1].copy()
        for j in range(1, n):
            acc = mix(acc * _K + w[j : len(w) - n + 1 + j])
        inside = row[: len(acc)] == row[n - 1 :]
        acc, own = acc[inside], row[: len(inside)][inside]
    else:
        acc, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = np.diff(before)
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        whole = []
        for r in short:
            h = np.array([size[r]], np.uint64)
            for x in w[before[r] : before[r + 1]]:
                h = mix(h * _K + x)
            whole.append(h)
        acc, own = np.r_[acc, np.concatenate(whole)], np.r_[own, short]
    order = np.lexsort((acc, own))
    acc, own = acc[order], own[order]
    new = np.r_[True, (acc[1:] != acc[:-1]) | (own[1:] != own[:-1])][: len(acc)]
    acc, own = acc[new], own[new]
    return acc, np.searchsorted(own, np.arange(len(offsets)))


def signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each row's set; 0 stands for an empty one."""
    sums = np.r_[np.uint64(0), np.cumsum(mix(h ^ np.uint64(0xA0761D6478BD642F)))]
    sizes = np.diff(at)
    sig = mix(sums[at[1:]] - sums[at[:-1]] + sizes.astype(np.uint64)) | np.uint64(1)
    return np.where(sizes > 0, sig, np.uint64(0))


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """(100 - percent + EXTRA) percent of a set, and never less than one n-gram must be shared in."""
    return np.where(n > 0, np.maximum(n - (percent * n + 99) // 100 + 1, ((100 + EXTRA - percent) * n + 99) // 100), 0)


def least_shared(n: np.ndarray) -> np.ndarray:
    """How many prefix n-grams of a set also lie in the prefix of any set it links to, at least.

    Two sets that link share o >= t max(n, m). Of the first L of either in the common order, all
    but n - o (or m - o) are shared ones, and these are the first shared ones in both; so at least
    min(L_n - n, L_m - m) + o lie in both prefixes, which is EXTRA percent of n or more.
    """
    return np.maximum(1, (EXTRA * n + 99) // 100)


def needed(n: Column, least: Column, most: Column, percent: int) -> Column:
    """How many prefix n-grams a set of n shares at least with any it links to of least to most n-grams."""

    def at(m: Column) -> Column:
        # two under, for what lengths are rounded up by
        return F.floor(percent * (n + m) / (100 + percent) - (percent - EXTRA) * F.greatest(n, m) / 100) - 2

    smallest, largest = F.greatest(least, F.ceil(n * percent / 100)), F.least(most, F.floor(n * 100 / percent))
    return F.greatest(F.lit(1), F.ceil(n * EXTRA / 100), F.least(at(smallest), at(largest)))


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


class Bits:
    """Membership of 64-bit hashes by their top bits; a few others pass as well."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def __contains__(self, _):
        raise TypeError("use test()")

    def test(self, h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(64 - self.bits)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def bits_of(hashes: DataFrame, column: str, bits: int | None = None) -> Bits:
    """The set bits: eight a hash, between 2**20 and 2**MOST_BITS, gathered as words of 64 each."""
    if bits is None:
        bits = min(MOST_BITS, max(20, (8 * hashes.count()).bit_length()))
    at = F.shiftrightunsigned(column, 64 - bits)
    words = hashes.select(F.shiftrightunsigned(at, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - bits}) & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bit").to_numpy().view(np.uint64)
    return Bits(out, bits)


class Reader:
    """Reads texts as sets, each set once a task."""

    def __init__(self, n: int):
        self.n, self.seen = n, np.zeros(0, np.uint64)

    def fresh(self, batches: Iterable[pa.RecordBatch], wanted: Bits | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(hashes, their row, row signatures) of sets not met before; rows are numbered anew."""
        for b in batches:
            for _, data, offsets in text_slices(b):
                h, at = shingles(data, offsets, self.n)
                sig = signatures(h, at)
                use = np.zeros(len(sig), bool)
                use[np.unique(sig, return_index=True)[1]] = True
                use &= (sig != 0) & ~np.isin(sig, self.seen)
                if wanted is not None:
                    use &= wanted.test(sig)
                self.seen = np.union1d(self.seen, sig[use])
                row = row_of(at)
                keep = use[row]
                yield h[keep], (np.cumsum(use) - 1)[row[keep]], sig[use]


def row_keys(rows: pa.RecordBatch, sig: np.ndarray) -> np.ndarray:
    """A hash of each row's id and class."""
    ids = rows.column("doc_id")
    own = np.where(ids.is_null().to_numpy(zero_copy_only=False), _K, mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
    return mix(own * _K + sig)


def classes(docs: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, sig, n_shingles, key) of every row, sig null for empty sets; and the n-grams that many
    sets hold, at most HEAVY_LIMIT of them. Which those are only shapes the order, not the result."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held, size = Reader(n), [], 0

        def counts() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            h, c = h[c >= LOCAL_COUNT], c[c >= LOCAL_COUNT]
            none = pa.nulls(len(h), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, as_long(h), pa.array(c)], names)

        names = ["doc_id", "sig", "n_shingles", "key", "h", "sets"]
        for b in batches:
            for rows, data, offsets in text_slices(b):
                h, at = shingles(data, offsets, n)
                sig = signatures(h, at)
                none = pa.nulls(len(sig), pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(sig.view(np.int64), mask=sig == 0), pa.array(np.diff(at).astype(np.int64)), as_long(row_keys(rows, sig)), none, none], names)
                use = np.zeros(len(sig), bool)
                use[np.unique(sig, return_index=True)[1]] = True
                use &= ~np.isin(sig, reader.seen)
                reader.seen = np.union1d(reader.seen, sig[use])
                held.append(h[use[row_of(at)]])
                size += len(held[-1])
                if size > 2_000_000:
                    yield counts()
                    held, size = [], 0
        if size:
            yield counts()

    both = written(docs.mapInArrow(run, "doc_id long, sig long, n_shingles long, key long, h long, sets long"), "classes")
    heavy = both.where("h is not null").groupBy("h").agg(F.sum("sets").alias("sets")).where(F.col("sets") >= HEAVY_COUNT).orderBy(F.desc("sets"), "h").limit(HEAVY_LIMIT).select("h").toArrow()
    return both.where("n_shingles is not null").select("doc_id", "sig", "n_shingles", "key"), np.sort(heavy.column("h").to_numpy().view(np.uint64))


def prefixes(docs: DataFrame, n: int, percent: int, heavy: np.ndarray, wanted: Bits | None = None) -> DataFrame:
    """(h, sig, n) of the prefix n-grams of every set; with ``wanted``, of those it lets pass, and of sets that have enough of them."""
    sent = docs.sparkSession.sparkContext.broadcast((heavy, Bits(_bit_words(heavy, 20), 20), wanted))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, coarse, wanted = sent.value
        for h, row, sig in Reader(n).fresh(batches):
            size = np.bincount(row, minlength=len(sig))
            last = np.zeros(len(h), bool)
            if len(heavy):
                near = np.flatnonzero(coarse.test(h))
                last[near] = heavy[np.minimum(np.searchsorted(heavy, h[near]), len(heavy) - 1)] == h[near]
                order = np.lexsort((h, last, row))
                h, row = h[order], row[order]
            place = np.arange(len(h)) - (np.cumsum(size) - size)[row]
            keep = place < prefix_length(size, percent)[row]
            if wanted is not None:
                # a set with too few n-grams that others hold as well can have no partner
                keep &= wanted.test(h)
                held = np.bincount(row[keep], minlength=len(sig))
                keep &= (held >= least_shared(size))[row]
            yield pa.RecordBatch.from_arrays([as_long(h[keep]), as_long(sig[row[keep]]), pa.array(size[row[keep]].astype(np.int32))], ["h", "sig", "n"])

    return docs.mapInArrow(run, "h long, sig long, n int")


def _bit_words(h: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(1 << (bits - 6), np.uint64)
    at = h >> np.uint64(64 - bits)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def sizes_of(rows: DataFrame) -> DataFrame:
    """(region, size) of the regions of more than one member; written, so that Spark can split the joins of hot regions with it."""
    return written(rows.groupBy("region").agg(F.count("*").alias("size")).where("size > 1"), "sizes", compact=True)


def regions(docs: DataFrame, n: int, percent: int, heavy: np.ndarray) -> DataFrame:
    """(region, sig, size): the classes that share a prefix n-gram with the least class that holds it.

    Two classes that link share ``least_shared`` prefix n-grams at least, in whatever regions. So
    each class may leave the last of its regions, in one order of all, as long as it leaves fewer
    shared n-grams than that: the first region that two such classes share is kept by both. The
    order puts first the regions that hold large parts of few sets, so that most sets keep one.

    Sets of n and m that link share o >= t (n + m) / (1 + t), so o + min(L_n - n, L_m - m) in their
    prefixes. Over m that is least at an end of the sizes in question: those of the members of a
    class's regions, and from t n to n / t. Classes that share much and are of about one size thus
    need to share 10 percent more of a prefix than EXTRA, or share no region.
    """
    seeds = prefixes(docs, n, percent, heavy).groupBy("h").agg(F.min("sig").alias("region"), F.max("sig").alias("top")).where("region <> top").select("h", "region")
    seeds = written(seeds, "seeds", compact=True)
    wanted = bits_of(seeds, "h")
    found = prefixes(docs, n, percent, heavy, wanted).join(seeds, "h").groupBy("region", "sig").agg(F.count("*").alias("shared"), F.max("n").alias("n"))
    found = written(found, "regions", compact=True)
    part = F.sum(F.col("shared") / F.col("n"))
    sizes = [F.min("n").alias("least"), F.max("n").alias("most")]
    worth = found.groupBy("region").agg(F.count("*").alias("size"), part.alias("part"), *sizes).where("size > 1")
    worth = written(worth.select("region", (F.col("part") / F.col("size") / F.col("size")).alias("worth"), "least", "most"), "worth", compact=True)
    rest = F.sum("shared").over(Window.partitionBy("sig").orderBy(F.desc("worth"), "region").rowsBetween(0, Window.unboundedFollowing))
    every = Window.partitionBy("sig")
    placed = found.join(worth, "region").withColumns({"_rest": rest, "_least": F.min("least").over(every), "_most": F.max("most").over(every)})
    kept = written(placed.where(F.col("_rest") >= needed(F.col("n"), F.col("_least"), F.col("_most"), percent)).select("region", "sig"), "kept", compact=True)
    return written(kept.join(sizes_of(kept), "region"), "members", compact=True)


def first_regions(members: DataFrame) -> DataFrame:
    """(sig, region, salts, is_pivot): every class in the largest of its regions, and whether it is one of the first pivots there."""
    own = members.withColumn("_r", F.row_number().over(Window.partitionBy("sig").orderBy(F.desc("size"), "region"))).where("_r = 1").select("region", "sig")
    own = written(own, "first", compact=True)
    pivots = first_pivots(own, PIVOTS).withColumn("is_pivot", F.lit(True))
    sizes = sizes_of(own).select("region", F.ceil(F.col("size") / SALT_ROWS).cast("int").alias("salts"))
    return written(own.join(sizes, "region").join(pivots, ["region", "sig"], "left").select("sig", "region", "salts", F.coalesce("is_pivot", F.lit(False)).alias("is_pivot")), "dealt", compact=True)


def sets_of(docs: DataFrame, n: int, needed: DataFrame, first: DataFrame) -> DataFrame:
    """(sig, set, region, salts, is_pivot) of the classes in needed (sig); set holds the sorted hashes, the rest is what first has."""
    sent = docs.sparkSession.sparkContext.broadcast(bits_of(needed, "sig"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, row, sig in Reader(n).fresh(batches, sent.value):
            at = np.searchsorted(row, np.arange(len(sig) + 1))
            raw = h.tobytes()
            yield pa.RecordBatch.from_arrays([as_long(sig), pa.array([raw[8 * i : 8 * j] for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["sig", "set"])

    found = docs.mapInArrow(run, "sig long, set binary").join(needed, "sig", "left_semi")
    return written(found.dropDuplicates(["sig"]).join(first, "sig", "left"), "sets")


HOME, JOINED, NEAR = 1, 2, 0
FOUND = ["region", "sig", "pivot", "kind", "far"]
DEALT = ["region", "block", "salt", "is_pivot", "sig", "set"]


class Group:
    """The pivots of one (region, block, salt), and what its members turn out to be."""

    def __init__(self, region: int, percent: int):
        self.region, self.percent = region, percent
        self.ids: list[int] = []
        self.sets: list[np.ndarray] = []
        self.roots: list[int] = []
        self.reach: list[float] = []
        self.flat = None
        self.rows: list[tuple[int, int, int, int, float]] = []

    def ready(self) -> None:
        flat = np.concatenate(self.sets)
        owner = np.repeat(np.arange(len(self.sets)), [len(s) for s in self.sets])
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]
        self.sizes = np.array([len(s) for s in self.sets])
        self.up = list(range(len(self.ids)))
        self.id_of, self.root_of, self.reach_of = np.array(self.ids), np.array(self.roots), np.array(self.reach)

    def top(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def shared(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many n-grams x has in common with each pivot, and in union."""
        if self.flat is None:
            self.ready()
        lo, hi = np.searchsorted(self.flat, x, "left"), np.searchsorted(self.flat, x, "right")
        n = hi - lo
        at = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        shared = np.bincount(self.owner[at], minlength=len(self.ids))
        return shared, self.sizes + len(x) - shared

    def member(self, sig: int, x: np.ndarray) -> None:
        """Links the member with its nearest pivot, the centre of its cell, and joins with that the others in reach."""
        shared, union = self.shared(x)
        linked = np.flatnonzero((100 * shared >= self.percent * union) & (self.id_of != sig))
        if len(linked):
            part = shared[linked] / union[linked]
            home = int(linked[np.argmax(part)])
            self.rows.append((self.region, sig, self.ids[home], HOME, float(1 - part.max())))
            for k in linked.tolist():
                if self.top(k) != self.top(home):
                    self.up[self.top(k)] = self.top(home)
                    self.rows.append((self.region, self.ids[k], self.ids[home], JOINED, 0.0))

    def window(self, sig: int, x: np.ndarray, root: int) -> None:
        """Puts the member into the windows of cells of other components that its distance lets it link into."""
        shared, union = self.shared(x)
        near = (1 - shared / union <= self.reach_of + 1e-9) & (self.root_of != root)
        self.rows += [(self.region, sig, self.ids[k], NEAR, 0.0) for k in np.flatnonzero(near).tolist()]


def compare(rows: DataFrame, percent: int, windows: bool = False) -> DataFrame:
    """(region, sig, pivot, kind, far): HOME links a member to its nearest pivot, at the distance far;
    JOINED are pivots with a common member. With ``windows``: NEAR, for members in the window of a
    pivot's cell.

    ``rows``: (region, block, salt, is_pivot, sig, set), and for windows the component root, and
    reach, how far members may lie from the pivot. The rows of a group lie together, its pivots
    first; members pass one by one.
    """
    dealt = rows.repartition("region", "block", "salt").sortWithinPartitions("region", "block", "salt", F.desc("is_pivot"), "sig")
    dealt = dealt.select(*DEALT, *(["root", "reach"] if windows else [F.lit(0).cast("long").alias("root"), F.lit(0.0).alias("reach")]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, None

        def result(found: list[tuple[int, int, int, int, float]]) -> pa.RecordBatch:
            cols = list(zip(*found, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()), strict=True)], FOUND)

        for b in batches:
            out = []
            for region, block, salt, is_pivot, sig, raw, root, reach in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (region, block, salt) != key:
                    out += group.rows if group else []
                    key, group = (region, block, salt), Group(region, percent)
                if is_pivot:
                    group.ids.append(sig)
                    group.sets.append(np.frombuffer(raw, np.uint64))
                    group.roots.append(root)
                    group.reach.append(reach)
                elif group.ids and windows:
                    group.window(sig, np.frombuffer(raw, np.uint64), root)
                elif group.ids:
                    group.member(sig, np.frombuffer(raw, np.uint64))
            if group:
                out, group.rows = out + group.rows, []
            yield result(out)

    return dealt.mapInArrow(run, "region long, sig long, pivot long, kind int, far double")


def first_pivots(opened: DataFrame, k: int) -> DataFrame:
    """(region, sig) of the k least members of each region."""
    return opened.select("region", "sig", F.row_number().over(Window.partitionBy("region").orderBy("sig")).alias("_n")).where(F.col("_n") <= k).select("region", "sig")


def dealt(pivots: DataFrame, members: DataFrame) -> DataFrame:
    """Rows (region, block, salt, is_pivot, ...) in which every member of a region meets every pivot of it."""
    counts = pivots.groupBy("region").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sizes = members.groupBy("region").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    counts = written(counts.join(sizes, "region"), "blocks", compact=True)
    block, salt = F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("sig"), F.col("salts")).cast("int")
    m = members.join(counts, "region").select(*members.columns, F.lit(False).alias("is_pivot"), salt.alias("salt"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    p = pivots.join(counts, "region").select(*pivots.columns, F.lit(True).alias("is_pivot"), block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return p.unionByName(m, allowMissingColumns=True)


def with_sets(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """rows with the set of their sig; where few sets are needed, a filter of their bits spares the others the shuffle."""
    needed = written(rows, "rows", compact=True)
    bits = bits_of(needed, "sig")
    sent = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(sent.value.test(b.column("sig").to_numpy().view(np.uint64))))

    return needed.join(sets.select("sig", "set").mapInArrow(run, "sig long, set binary"), "sig")


def first_round(sets: DataFrame, percent: int) -> DataFrame:
    """compare() of all sets in their first regions, dealt as the sets were written, with no join."""
    at = F.pmod(F.xxhash64("sig"), F.col("salts")).cast("int")
    own = F.array(F.struct(F.lit(False).alias("is_pivot"), at.alias("salt")))
    more = F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda k: F.struct(F.lit(True).alias("is_pivot"), k.alias("salt")))
    rows = sets.where("region is not null").withColumn("_as", F.explode(F.when(F.col("is_pivot"), F.concat(own, more)).otherwise(own)))
    return compare(rows.select("region", F.lit(0).alias("block"), "_as.salt", "_as.is_pivot", "sig", "set"), percent)


def with_root(df: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    """df with the root of a column's class, which is the class itself where nothing links to it."""
    named = roots.select(F.col("node").alias(column), F.col("root").alias(f"{column}_root"))
    return df.join(named, column, "left").withColumn(f"{column}_root", F.coalesce(f"{column}_root", column))


def pivot_rounds(members: DataFrame, opened: DataFrame, sets: DataFrame, percent: int, first: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """What comparisons with pivots find (see compare), until no member (region, sig) is open; and all pivots.

    ``opened`` are the members that may become pivots; ``first``, if given, is what the first round
    found and its pivots.
    """
    found, used, k = [], [], PIVOTS
    while True:
        if first:
            got, pivots = first
            first = None
        else:
            pivots = written(first_pivots(opened, k), "pivots", compact=True)
            own = members.join(pivots.select("region").distinct(), "region", "left_semi").select("region", "sig")
            got = written(compare(with_sets(dealt(pivots, own), sets), percent), "met", compact=True)
        found.append(got)
        used.append(pivots)
        done = got.where(F.col("kind") == HOME).select("region", "sig").unionByName(pivots).distinct()
        opened = written(opened.select("region", "sig").join(done, ["region", "sig"], "left_anti"), "open", compact=True)
        if opened.isEmpty():
            return reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, used)
        k *= 4


def as_pairs(found: DataFrame) -> DataFrame:
    return found.where(F.col("kind") != NEAR).select(F.col("sig").alias("a"), F.col("pivot").alias("b"))


def window_pairs(members: DataFrame, found: DataFrame, pivots: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """(a, b) between the cells of pivots and members of their regions that are of another component.

    Pivots have met all members, so they count in no cell and need no window. A member that links
    to one of a cell lies within 1 - t and the cell's radius of its centre.
    """
    cell = found.where(F.col("kind") == HOME).select("region", "sig", "pivot", "far").join(pivots, ["region", "sig"], "left_anti")
    cell = written(cell, "cells", compact=True)
    if cell.isEmpty():
        return None
    rooted = written(with_root(members.select("region", "sig").join(pivots, ["region", "sig"], "left_anti"), roots, "sig").withColumnRenamed("sig_root", "root"), "rooted", compact=True)
    live = rooted.groupBy("region").agg(F.min("root").alias("least"), F.max("root").alias("most"))
    reach = F.col("radius") + (100 - percent) / 100
    centres = with_root(cell.groupBy("region", F.col("pivot").alias("sig")).agg(F.max("far").alias("radius")), roots, "sig")
    # a cell whose component holds all other members of its region needs no window
    centres = centres.join(live, "region").where("least <> sig_root or most <> sig_root").select("region", "sig", F.col("sig_root").alias("root"), reach.alias("reach"))
    centres = written(centres, "centres", compact=True)
    if centres.isEmpty():
        return None
    own = rooted.join(centres.select("region").distinct(), "region", "left_semi")
    near = compare(with_sets(dealt(centres, own), sets), percent, windows=True)
    apart = written(near.select(F.col("pivot").alias("region"), "sig").distinct(), "windows", compact=True)
    if apart.isEmpty():
        return None
    inside = cell.select(F.col("pivot").alias("region"), "sig").distinct()
    return as_pairs(compare(with_sets(dealt(apart, inside), sets), percent))


def class_roots(docs: DataFrame, n: int, percent: int, heavy: np.ndarray) -> DataFrame:
    """(node, root): the components of all links, of the classes that have one.

    First every class meets the largest of its regions only, so that its set is sent once. Of
    all regions, only those that still hold several components are joined, and there members
    of the region's largest component need not be pivots.
    """
    members = regions(docs, n, percent, heavy)
    first = first_regions(members)
    sets = sets_of(docs, n, members.select("sig").distinct(), first)
    met = written(first_round(sets, percent), "met", compact=True), first.where("is_pivot").select("region", "sig")
    pairs = written(as_pairs(pivot_rounds(first, first, sets, percent, met)[0]).distinct(), "links", compact=True)
    roots = components(pairs)
    rooted = with_root(members.select("region", "sig"), roots, "sig")
    parts = rooted.groupBy("region", "sig_root").agg(F.count("*").alias("size"))
    largest = parts.groupBy("region").agg(F.max(F.struct("size", "sig_root")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("region", F.col("top.sig_root").alias("top"))
    mixed = written(rooted.join(written(largest, "largest", compact=True), "region"), "mixed", compact=True)
    if mixed.isEmpty():
        return roots
    found, pivots = pivot_rounds(mixed.select("region", "sig"), mixed.where("sig_root <> top").select("region", "sig"), sets, percent)
    # with the components known so far in place of the pairs they came from
    known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    pairs = written(as_pairs(found).unionByName(known).distinct(), "links", compact=True)
    roots = components(pairs)
    more = window_pairs(mixed, found, pivots, roots, sets, percent)
    if more is None:
        return roots
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def named_classes(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, sig, n_shingles, key) of every row, and (sig, component_id, root) of every class."""
    rows, heavy = classes(docs, n)
    roots = class_roots(docs.select("text"), n, percent, heavy)
    # sums by class come before the joins, so that a class of many copies is one row in them
    own = rows.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("least"))
    known = own.join(roots, own["sig"] == roots["node"], "left").select("sig", F.coalesce("root", "sig").alias("root"), "least")
    known = written(known, "known", compact=True)
    # written, so that Spark can split the join of a large component
    least = written(known.groupBy("root").agg(F.min("least").alias("component_id")), "least", compact=True)
    return rows, known.join(least, "root").select("sig", "component_id", "root")


def _ready(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def join(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    rows, named = named_classes(_ready(docs), n, percent)
    return rows.join(named.select("sig", "component_id"), "sig", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """The rows of docs, one of each component: that of the least doc_id. Rows of an empty set stay.

    Columns besides doc_id and text pass through, whatever their names.
    Only rows of which a filter of bounded size says that they may go are joined with what stays;
    the others pass without a shuffle.
    """
    rows, named = named_classes(_ready(docs), n, percent)
    keys = rows.where("sig is not null").groupBy("doc_id", "sig", "key").agg(F.count("*").alias("copies"))
    keys = written(keys.join(named, "sig"), "keys")
    # the least (doc_id, class) of each component stays, with one of its copies
    stay = keys.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "sig", "key")).alias("k")).select(F.col("k.key").alias("key"))
    doubtful = keys.join(stay, "key", "left_anti").select("key").unionByName(keys.where("copies > 1").select("key"))
    sent = docs.sparkSession.sparkContext.broadcast(bits_of(doubtful, "key"))
    source = carried(docs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some, data, offsets in text_slices(b):
                sig = signatures(*shingles(data, offsets, n))
                key = row_keys(some, sig)
                yield pa.RecordBatch.from_arrays([*some.columns, as_long(key), pa.array((sig != 0) & sent.value.test(key))], [*some.schema.names, "_key", "_doubt"])

    signed = source.mapInArrow(run, source.withColumns({"_key": F.lit(None).cast("long"), "_doubt": F.lit(None).cast("boolean")}).schema)
    checked = signed.where("_doubt").join(stay.withColumnRenamed("key", "_key"), "_key", "left_semi").dropDuplicates(["_key"])
    return restored(signed.where("not _doubt").drop("_key", "_doubt").unionByName(checked.select("row", "doc_id", "text")), docs.columns)
