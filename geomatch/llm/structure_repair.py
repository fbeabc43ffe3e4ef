"""Least-cost repair of a conversation's turns, by prefix-doubling path ranking.

Turns may be kept, given another role or deleted, and empty turns inserted, until the roles read
``(s?(ua)+)?``. Nodes are (turns consumed, state of that pattern); the arcs between them are the
edits. A backward DP over blocks of conversations in step gives each node its least cost to the
end, and so the optimal arcs. Audits are the edits' initials. Nodes are then ranked by their least
audits of 1, 2, 4, 8, ... initials: the rank of twice the length is that of the pair of the
node's rank and the rank of the node its doubled pointer leads to. A label leads from a node to
one node only, so nodes of equal rank need no other tie-break and pointers double as the ranks do.
The pointers then give every place of every least path at once.

A conversation of any length spreads over tasks: it is cut into segments (``segments``), each of
which is a 4 x 4 table of least costs between states. These multiply in (min, +), backward to the
costs at the end of each segment; then each segment ranks its paths from all four states, and the
chain of exits picks one. Texts are never held; a segment keeps one byte a turn.

Defined cases: a null role or text is empty; a null conversation id is a conversation of its own;
a null turn comes first; equal turns are ordered by role and text; repeated rows are turns of
their own, all but the first being duplicates; a role of another initial than s, u or a can not be
kept; very long texts are one turn like any other and their last letters are looked at in the JVM;
other columns, of whatever name, are ignored; an empty table gives nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomatch.operators.segments import segmented

from .textbytes import bounded_batches, written

SEGMENT_ROWS, NODES = 4096, 1 << 18
NEVER = 1 << 40
TRUNCATED, BLANK, DUPLICATE = 4, 8, 16
LABELS = np.frombuffer(b"DIKR", np.uint8)
#: The state after a user or assistant turn is put in, by state; and after a kept turn of each class of initials (other, s, u, a).
PUT = np.array([2, 2, 3, 2])
KEPT = np.array([[-1, 1, 2, -1], [-1, -1, 2, -1], [-1, -1, -1, 3], [-1, -1, 2, -1]])
LEGAL = {(1, 2), (2, 3), (3, 2)}
ACCEPTED = np.array([0, NEVER, NEVER, 0])
SPACE = " \t\n\x0b\x0c\r"


def inserted(cost: np.ndarray) -> np.ndarray:
    """Least costs (rows, 4) when turns may be put in before going on."""
    for _ in range(3):
        cost = np.minimum(cost, cost[:, PUT] + 2)
    return cost


def costs(codes: list[np.ndarray], ends: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least cost to the end of every node (place, state), the first place of each block of codes), all blocks in step.

    ``ends`` are the costs at the end of each block; only a last block may put turns in there.
    """
    n = np.array([len(c) for c in codes])
    first = np.cumsum(n + 1) - (n + 1)
    cost = np.zeros((int((n + 1).sum()), 4), np.int64)
    cost[first + n] = np.where(last[:, None], inserted(ends), ends)
    order = np.argsort(-n, kind="stable")
    flat = np.concatenate([*codes, np.zeros(0, np.uint8)]).astype(np.int64)
    start = np.cumsum(n) - n
    for t in range(1, int(n.max(initial=0)) + 1):
        g = order[: int(np.searchsorted(-n[order], -t, "right"))]
        code = flat[start[g] + n[g] - t]
        after = cost[first[g] + n[g] - t + 1]
        extra = np.where(code & (BLANK | DUPLICATE), NEVER, (code & TRUNCATED) // TRUNCATED)[:, None]
        to = KEPT[:, code & 3].T
        keep = np.where(to < 0, NEVER, np.take_along_axis(after, np.maximum(to, 0), 1) + extra)
        best = np.minimum(np.minimum(after + 3, keep), after[:, PUT] + 2 + extra)
        cost[first[g] + n[g] - t] = inserted(best)
    return np.minimum(cost, NEVER), first


def arcs(codes: list[np.ndarray], cost: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """(nodes, 4): where the optimal arcs D, I, K, R of each node lead, -1 for arcs that are not optimal."""
    n = np.array([len(c) for c in codes])
    place = np.ones(len(cost), bool)
    place[first + n] = False
    flat = np.zeros(len(cost), np.int64)
    flat[place] = np.concatenate([*codes, np.zeros(0, np.uint8)])
    may_put = place.copy()
    may_put[(first + n)[last]] = True
    here, state = np.arange(len(cost))[:, None], np.arange(4)[None, :]
    after = np.roll(cost, -1, 0)
    extra = np.where(flat & (BLANK | DUPLICATE), NEVER, (flat & TRUNCATED) // TRUNCATED)[:, None]
    to = KEPT[:, flat & 3].T
    live, on = cost < NEVER, place[:, None]
    out = np.full((len(cost), 4, 4), -1, np.int64)
    for k, (right, target) in enumerate(
        [
            (on & (cost == after + 3), 4 * (here + 1) + state),
            (may_put[:, None] & (cost == cost[:, PUT] + 2), 4 * here + PUT[None, :]),
            (on & (to >= 0) & (cost == np.take_along_axis(after, np.maximum(to, 0), 1) + extra), 4 * (here + 1) + to),
            (on & (cost == after[:, PUT] + 2 + extra), 4 * (here + 1) + PUT[None, :]),
        ]
    ):
        out[:, :, k] = np.where(live & right, target, -1)
    return out.reshape(-1, 4)


def least_paths(arc: np.ndarray, roots: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(labels of the least path, the node where it ends) of each root."""
    nodes = np.arange(len(arc))
    on = (arc >= 0).any(1)
    choice = (arc >= 0).argmax(1)
    rank = np.where(on, choice + 1, 0)
    to = np.where(on, arc[nodes, choice], nodes)
    steps, pointers = on.astype(np.int64), [to]
    while on[to].any():
        # the audit of twice the length: that of the node, then that of the node it leads to
        rank = np.unique(rank * (len(arc) + 1) + rank[to], return_inverse=True)[1]
        steps, to = steps + steps[to], to[to]
        pointers.append(to)
    # ranks of whole audits settle every arc: of equal labels the one to the node of least rank
    key = np.where(arc >= 0, np.arange(4)[None, :] * (len(arc) + 1) + rank[np.maximum(arc, 0)], 4 * (len(arc) + 1))
    choice = key.argmin(1)
    n = steps[roots]
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    node = np.repeat(roots, n)
    for k, pointer in enumerate(pointers):
        node = np.where((at >> k) & 1, pointer[node], node)
    labels, ends = LABELS[choice[node]].tobytes(), np.cumsum(n)
    return [labels[e - m : e] for e, m in zip(ends.tolist(), n.tolist(), strict=True)], to[roots]


def solved(codes: list[np.ndarray], ends: np.ndarray, last: np.ndarray, states: tuple[int, ...]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """For each block and each entry state: the least audit, the state at its end, its cost."""
    cost, first = costs(codes, ends, last)
    roots = (4 * first[:, None] + np.array(states)[None, :]).ravel()
    audits, at = least_paths(arcs(codes, cost, first, last), roots)
    k = len(states)
    return [audits[k * g : k * g + k] for g in range(len(codes))], (at % 4).reshape(-1, k), cost[first][:, list(states)]


def portions(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of blocks of up to NODES nodes together, one block at least."""
    lo, held = 0, 0
    for k, n in enumerate(sizes):
        if held and held + 4 * (n + 1) > NODES:
            yield lo, k
            lo, held = k, 0
        held += 4 * (n + 1)
    if held:
        yield lo, len(sizes)


NOTED = "conv_id long, segment long, cuts long, at long, role string, text string, code int, codes binary, low long, high long, turns long, illegal long, first int, last int"
NAMES = [c.split()[0] for c in NOTED.split(", ")]


def noted(turns: DataFrame, segment_rows: int) -> DataFrame:
    """The turns of every segment in order with a code of initial and fault, and a row of at = -1 with all codes and sums of the segment."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = segmented(rows, ["conv_id"], F.col("turn"), segment_rows)
    end = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0) + F.when(end == "", BLANK).when(end.isin(".", "!", "?"), 0).otherwise(TRUNCATED)
    rows = rows.withColumns({"code": code, "h1": F.xxhash64("role", "text"), "h2": F.xxhash64("text", F.lit(1), "role"), "when": F.struct(F.col("turn").isNotNull().alias("known"), "turn")})
    # where the same role and text stand at several turns, the first of those; copies at one turn lie side by side
    again = rows.groupBy("conv_id", "h1", "h2").agg(F.min("when").alias("earliest"), F.max("when").alias("latest")).where("earliest < latest")
    again = again.select(F.col("conv_id").alias("_c"), F.col("h1").alias("_1"), F.col("h2").alias("_2"), "earliest")
    rows = rows.join(again, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2")), "left")
    rows = rows.select("conv_id", "segment", "cuts", "turn", "role", "text", "code", F.coalesce(F.col("when") > F.col("earliest"), F.lit(False)).alias("again"))
    dealt = rows.repartition("conv_id", "segment").sortWithinPartitions(F.asc_nulls_first("conv_id"), "segment", F.asc_nulls_first("turn"), "role", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        codes, low, high, n_turns, illegal = bytearray(), None, None, 0, 0
        before: tuple | None = None
        out: list[tuple] = []

        def close() -> tuple:
            return (*key, -1, None, None, None, bytes(codes), low, high, n_turns, illegal, codes[0] & 3, codes[-1] & 3)

        def frame() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * len(NAMES)
            kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.split()[1]]) for c, f in zip(cols, NOTED.split(", "), strict=True)], NAMES)

        for b in batches:
            for conv, segment, cuts, turn, role, text, code, again in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != (conv, segment, cuts):
                    if key:
                        out.append(close())
                    key, before = (conv, segment, cuts), None
                    codes, low, high, n_turns, illegal = bytearray(), None, None, 0, 0
                if not code & BLANK and (again or before == (turn, role, text)):
                    code = code & 3 | DUPLICATE
                if codes and (codes[-1] & 3, code & 3) not in LEGAL:
                    illegal += 1
                if turn is not None:
                    n_turns += turn != high
                    low, high = turn if low is None else low, turn
                out.append((*key, len(codes), role, text, code, None, None, None, None, None, None, None))
                codes.append(code)
                before = (turn, role, text)
            yield frame()
            out = []
        if key:
            out.append(close())
            yield frame()

    return written(dealt.mapInArrow(run, NOTED), "noted")


DECIDED = "conv_id long, segment long, low long, high long, turns long, illegal long, blank long, duplicate long, truncated long"
SUMS = ["conv_id", "segment", "low", "high", "turns", "illegal"]


def counted(codes: np.ndarray) -> tuple[int, int, int]:
    return tuple(int(np.count_nonzero(codes & k)) for k in (BLANK, DUPLICATE, TRUNCATED))


def decide(packs: DataFrame, states: tuple[int, ...]) -> DataFrame:
    """DECIDED, and audits, exits and costs by entry state, of packs with the costs at their ``ends`` (null: the last segment)."""
    schema = f"{DECIDED}, audits array<string>, exits array<int>, costs array<long>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [np.frombuffer(c, np.uint8) for c in b.column("codes").to_pylist()]
            ends = b.column("ends").to_pylist()
            last = np.array([e is None for e in ends], bool)
            given = np.array([ACCEPTED if e is None else e for e in ends], np.int64).reshape(-1, 4)
            for lo, hi in portions([len(c) for c in codes]):
                audits, exits, cost = solved(codes[lo:hi], given[lo:hi], last[lo:hi], states)
                sums = list(zip(*map(counted, codes[lo:hi]), strict=True))
                new = [pa.array(s, pa.int64()) for s in sums] + [pa.array([[a.decode() for a in x] for x in audits], pa.list_(pa.string())), pa.array(exits.tolist(), pa.list_(pa.int32())), pa.array(cost.tolist(), pa.list_(pa.int64()))]
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in SUMS], *new], [*SUMS, "blank", "duplicate", "truncated", "audits", "exits", "costs"])

    return packs.select(*SUMS, "codes", "ends").mapInArrow(run, schema)


def tables_of(packs: DataFrame) -> DataFrame:
    """(conv_id, segment, table): least costs of a segment from each state to each state, row by row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [np.frombuffer(c, np.uint8) for c in b.column("codes").to_pylist()]
            for lo, hi in portions([len(c) for c in codes]):
                some, found = codes[lo:hi], []
                for state in range(4):
                    ends = np.full((len(some), 4), NEVER, np.int64)
                    ends[:, state] = 0
                    cost, first = costs(some, ends, np.zeros(len(some), bool))
                    found.append(cost[first])
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), part.column("segment"), pa.array(np.stack(found, 2).reshape(len(some), 16).tolist(), pa.list_(pa.int64()))], ["conv_id", "segment", "table"])

    return packs.select("conv_id", "segment", "codes").mapInArrow(run, "conv_id long, segment long, table array<long>")


def ends_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """The costs at the end of each segment of one conversation, from the last one back; null for the last."""
    pdf = pdf.sort_values("segment")
    ends, now = [], inserted(ACCEPTED[None, :])[0]
    for k, table in enumerate(reversed(pdf["table"].tolist())):
        ends.append(None if k == 0 else now)
        now = np.minimum((np.array(table, np.int64).reshape(4, 4) + now[None, :]).min(1), NEVER)
    return pd.DataFrame({"conv_id": pdf["conv_id"].astype("Int64"), "segment": pdf["segment"], "ends": ends[::-1]})


def entries_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state in which each segment of one conversation is entered, and the illegal pairs across its borders."""
    pdf = pdf.sort_values("segment")
    state, before, out = 0, None, []
    for exits, first, last in zip(pdf["exits"], pdf["first"], pdf["last"], strict=True):
        out.append((state, int(before is not None and (before, first) not in LEGAL)))
        state, before = int(exits[state]), last
    return pd.DataFrame({"conv_id": pdf["conv_id"].astype("Int64"), "segment": pdf["segment"], "entry": [x for x, _ in out], "across": [x for _, x in out]})


def on(a: DataFrame, b: DataFrame) -> DataFrame:
    """a joined with b (conv_id, segment, ...), null being an id like any other."""
    b = b.withColumnsRenamed({"conv_id": "_c", "segment": "_s"})
    return a.join(b, a["conv_id"].eqNullSafe(b["_c"]) & (a["segment"] == b["_s"])).drop("_c", "_s")


def decisions(packs: DataFrame) -> DataFrame:
    """(DECIDED, audit, entry, cost) of each segment; cost is null but for the first of a conversation."""
    ready = "array<long>"
    alone = decide(packs.where("cuts = 0").withColumn("ends", F.lit(None).cast(ready)), (0,))
    alone = alone.select(*[f.split()[0] for f in DECIDED.split(", ")], F.col("audits")[0].alias("audit"), F.lit(0).alias("entry"), F.col("costs")[0].alias("cost"))
    parts = packs.where("cuts > 0")
    ends = tables_of(parts).groupBy("conv_id").applyInPandas(ends_of, "conv_id long, segment long, ends array<long>")
    ways = written(decide(on(parts, ends), (0, 1, 2, 3)), "ways")
    exits = on(ways.select("conv_id", "segment", "exits"), parts.select("conv_id", "segment", "first", "last"))
    entries = exits.groupBy("conv_id").applyInPandas(entries_of, "conv_id long, segment long, entry int, across int")
    least = parts.groupBy("conv_id").agg(F.min("segment").alias("_least")).withColumnRenamed("conv_id", "_c")
    both = on(ways, entries).join(least, F.col("conv_id").eqNullSafe(F.col("_c")))
    cost = F.when(F.col("segment") == F.col("_least"), F.element_at("costs", F.col("entry") + 1))
    both = both.withColumn("illegal", F.col("illegal") + F.col("across"))
    return alone.unionByName(both.select(*[f.split()[0] for f in DECIDED.split(", ")], F.element_at("audits", F.col("entry") + 1).alias("audit"), "entry", cost.alias("cost")))


EDITS = "conv_id long, segment long, place long, edit string, fault string, role string, text string"


def edits_of(rows: DataFrame) -> DataFrame:
    """One row for each edit: rows (conv_id, segment, at, role, text, code) with the audit and entry state before each segment's turns."""
    dealt = rows.repartition("conv_id", "segment").sortWithinPartitions(F.asc_nulls_first("conv_id"), "segment", "at")
    roles = {2: "user", 3: "assistant"}
    faults = {BLANK: "blank", DUPLICATE: "duplicate", TRUNCATED: "truncated"}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = segment = audit = None
        state = done = 0
        out: list[tuple] = []

        def put() -> None:
            """Turns that are put in before what comes next."""
            nonlocal state, done
            while done < len(audit) and audit[done] == "I":
                state = int(PUT[state])
                out.append((conv, segment, done, "I", None, roles[state], ""))
                done += 1

        for b in batches:
            for c, s, at, role, text, code, plan, entry in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if at < 0:
                    conv, segment, audit, state, done = c, s, plan, entry, 0
                    put()
                    continue
                edit = audit[done]
                if edit == "R":
                    state = int(PUT[state])
                    role = roles[state]
                elif edit == "K":
                    state = int(KEPT[state, code & 3])
                out.append((conv, segment, done, edit, faults.get(code & ~3), role, text))
                done += 1
                put()
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 3 + [pa.string()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in EDITS.split(", ")])
            out = []

    return dealt.select("conv_id", "segment", "at", "role", "text", "code", "audit", "entry").mapInArrow(run, EDITS)


def repair(turns: DataFrame, segment_rows: int = SEGMENT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(edits, summary) of conversations (conv_id, turn, role, text).

    edits: (conv_id, segment, place, edit, fault, role, text), one row an edit, ordered by segment and
    place; those whose edit is not D are the repaired turns. summary: (conv_id, gaps, blank, duplicate,
    truncated, illegal, cost), one row a conversation.
    """
    bounded_batches(turns.sparkSession)
    rows = noted(turns, segment_rows)
    decided = written(decisions(rows.where("at < 0")), "decided")
    plan = decided.select("conv_id", "segment", F.lit(-1).cast("long").alias("at"), "audit", "entry")
    edits = edits_of(rows.where("at >= 0").select("conv_id", "segment", "at", "role", "text", "code").unionByName(plan, allowMissingColumns=True))
    wide = lambda c: c.cast("decimal(30,0)")
    # turns may lie anywhere in the range of a long; a gap beyond that range counts as its end
    gaps = F.least(F.coalesce(wide(F.max("high")) - wide(F.min("low")) + 1 - wide(F.sum("turns")), wide(F.lit(0))), wide(F.lit(2**63 - 1))).cast("long")
    sums = [F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    return edits, decided.groupBy("conv_id").agg(gaps.alias("gaps"), *sums)
