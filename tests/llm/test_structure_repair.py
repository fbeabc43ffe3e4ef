"""Repair of conversations against a plain search over all edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from geomatch.llm import queries_mining as q
from geomatch.llm import structure_repair as sr

SCHEMA = "conv_id long, turn long, role string, text string, segment string, at int, codes string"
AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NAMES = {"u": "user", "a": "assistant"}


def brute(turns):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired lines) of turns in order."""
    faults, seen = [], set()
    for _, role, text in turns:
        letters = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("b" if not letters else "d" if (role, text) in seen else "t" if letters[-1] not in ".!?" else "")
        seen.add((role, text))
    known = {t for t, _, _ in turns if t is not None}
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    best = {"": (0, "", ())}

    def put(table):
        for _ in range(4):
            for state, (cost, audit, lines) in list(table.items()):
                to = "a" if state == "u" else "u"
                new = (cost + 2, audit + "I", (*lines, NAMES[to] + ":"))
                table[to] = min(table.get(to, new), new)
        return table

    best = put(best)
    for (_, role, text), fault in zip(turns, faults):
        after = {}
        for state, (cost, audit, lines) in best.items():
            new = [(state, (cost + 3, audit + "D", lines))]
            if fault not in ("b", "d"):
                more = fault == "t"
                to = AFTER.get((state, role[:1]))
                if to:
                    new.append((to, (cost + more, audit + "K", (*lines, f"{role}:{text}"))))
                to = "a" if state == "u" else "u"
                new.append((to, (cost + 2 + more, audit + "R", (*lines, f"{NAMES[to]}:{text}"))))
            for to, value in new:
                after[to] = min(after.get(to, value), value)
        best = put(after)
    cost, audit, lines = min(best[s] for s in ("", "a") if s in best)
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, lines


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def conversations(seed):
    rng = random.Random(seed)
    out = {}
    for conv in [*range(40), None]:
        n = rng.choice([1, 2, 3, 5, 8, 30]) if conv != 7 else 400
        out[conv] = []
        for k in range(n):
            role = rng.choice(["user", "assistant"] if rng.random() < 0.7 else ["system", "", "tool", "sage", "ü"])
            text = rng.choice(["Yes.", "No", "", " \n", "what?\t ", "x! y", f"text {k}.", "é。", "a.b"])
            out[conv].append((rng.choice([k, k, k, k + 5, None]), role, text))
    return out


@pytest.mark.parametrize(("seed", "rows"), [(1, 4096), (2, 6)])
def test_repair_equals_brute_force(spark, seed, rows):
    given = conversations(seed)
    flat = [(c, t, role or None, text or None, "x", 3, "y") for c, turns in given.items() for t, role, text in turns]
    random.Random(3).shuffle(flat)
    edits, summary = sr.repair(spark.createDataFrame(flat, SCHEMA).repartition(5), rows)
    digests = {r.conv_id: r for r in q.edits_digest(edits).collect()}
    sums = {r.conv_id: r for r in summary.collect()}
    assert set(sums) == set(given)
    for conv, turns in given.items():
        *counts, audit, lines = brute(ordered(turns))
        got = sums[conv]
        assert [got.gaps, got.blank, got.duplicate, got.truncated, got.illegal, got.cost] == counts
        assert digests[conv].audit == audit
        assert digests[conv].repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert edits.where("edit = 'I'").where("text <> '' or fault is not null").isEmpty()


def test_paths_are_the_least_of_all():
    rng = np.random.default_rng(4)
    blocks = [rng.choice([1, 2, 3, 0, 5, 6, 7, 8, 18], n).astype(np.uint8) for n in (0, 1, 2, 3, 9, 33, 70)]
    last = np.array([True] * len(blocks))
    cost, first = sr.costs(blocks, np.tile(sr.ACCEPTED, (len(blocks), 1)), last)
    arc = sr.arcs(blocks, cost, first, last)
    audits, _ = sr.least_paths(arc, np.arange(len(arc)))
    for node, targets in enumerate(arc):
        ways = [sr.LABELS[k : k + 1].tobytes() + audits[t] for k, t in enumerate(targets) if t >= 0]
        assert audits[node] == min(ways, default=b"")


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    edits, summary = sr.repair(none)
    assert edits.count() == 0 and summary.count() == 0
    far = [(1, -(2**63), "user", "a." * 200_000, "", 0, ""), (1, 2**63 - 1, "assistant", "b.", "", 0, ""), (2, None, None, None, "", 0, "")]
    edits, summary = sr.repair(spark.createDataFrame(far, SCHEMA))
    got = {r.conv_id: r for r in summary.collect()}
    assert got[1].gaps == 2**63 - 1 and (got[1].cost, got[2].cost, got[2].blank, got[2].gaps) == (0, 3, 1, 0)
    assert {r.conv_id: r.audit for r in q.edits_digest(edits).collect()} == {1: "KK", 2: "D"}


def test_damage(spark):
    rows = [(c, t, r, x) for c in [*range(30), None] for t, r, x in [(0, "assistant", "a. b!"), (1, None, None), (None, "system", "?")]]
    want = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r if r is not None else " ", x if x is not None else " "
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        want += [(c, t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    got = q.damaged(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, kind int")).collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
