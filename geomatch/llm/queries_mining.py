"""Queries over hard negatives, conversation repair and the forest of signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from string import Template

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hard_negatives, lsh_forest, structure_repair
from .queries_models import OP6_SQL
from .queries_text import table


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives.mine(rows, rows.where(F.col("vec_id") % 100 == 0))


OP11_SQL = """
with v as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as v
    from embeddings where label is not null and len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), a as (select row_number() over () as n, * from v where vec_id % 100 = 0),
s as (
    select a.n, a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, cast(list_sum([z[1] * z[2] for z in list_zip(a.v, c.v)]) as bigint) as score
    from a join v c on c.vec_id is distinct from a.vec_id and len(c.v) = len(a.v)
), p as (
    select n, anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by n order by score desc, vec_id nulls last) as place
    from s where same qualify place <= 5
), r as (
    select p.n, p.anchor_id, p.place, positive_id, positive_score, s.vec_id as negative_id, s.score as negative_score,
        cast(row_number() over (partition by p.n, p.place order by s.score desc, s.vec_id nulls last) as integer) as rank
    from p join s on s.n = p.n and not s.same and 80 * positive_score <= 100 * s.score and 100 * s.score <= 100 * positive_score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from r where rank <= 5
"""


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with planted faults: what is null becomes one space, in the hashed key too."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    turns = conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def edits_digest(edits: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256): a conversation's edits pass in order, one at a time."""
    dealt = edits.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "segment", "place").select("conv_id", "edit", "role", "text")

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: tuple | None = None
        audit, hashed, first = [], hashlib.sha256(), True

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["conv_id", "audit", "repaired_sha256"]).astype({"conv_id": "Int64"})

        for pdf in frames:
            out = []
            for conv, edit, role, text in zip(pdf["conv_id"], pdf["edit"], pdf["role"], pdf["text"], strict=True):
                key = (None,) if pd.isna(conv) else (int(conv),)
                if key != now:
                    if now is not None:
                        out.append((now[0], "".join(audit), hashed.hexdigest()))
                    now, audit, hashed, first = key, [], hashlib.sha256(), True
                audit.append(edit)
                if edit != "D":
                    hashed.update((("" if first else "\n") + f"{role}:{text}").encode())
                    first = False
            yield frame(out)
        if now is not None:
            yield frame([(now[0], "".join(audit), hashed.hexdigest())])

    return dealt.mapInPandas(run, "conv_id long, audit string, repaired_sha256 string")


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    edits, summary = structure_repair.repair(damaged(conversations))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    out = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for found in (summary, edits_digest(edits)):
        found = found.withColumnRenamed("conv_id", "_c")
        out = out.join(found, out["conv_id"].eqNullSafe(found["_c"]), "left").drop("_c")
    # a conversation of no turns, and one whose turns gave no edits, has zeros and empty texts
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


#: crc32 of a short text by shifts, as the engine of the SQL has no such function.
CRC = "list_reduce([4294967295] || list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])), lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, _: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end))"
OP12_SQL = r"""
with recursive keyed as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations
), hashed as (select *, xor($crc, 4294967295) % 20 as kind from keyed),
damaged as (
    select conv_id, turn, case when kind = 4 then 'user' else role end as role,
        case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when kind = 3 then 2 else 1 end)) as copy
    from hashed where kind <> 0
), turns as (
    select *, rtrim(text, e' \t\n\x0b\x0c\r') as t, left(role, 1) as i,
        row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as n,
        row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen from damaged
), faulty as (
    select *, case when t = '' then 'blank' when seen > 1 then 'duplicate' when right(t, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
        lag(i) over (partition by conv_id order by n) as before from turns
), sums as (
    select conv_id, count(*) as n_turns, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank,
        count(*) filter (where fault = 'duplicate') as duplicate, count(*) filter (where fault = 'truncated') as truncated,
        count(*) filter (where before is not null and before || i not in ('su', 'ua', 'au')) as illegal
    from faulty group by conv_id
), step as (
    select conv_id, n, role, text, i, case when fault in ('blank', 'duplicate') then 100000000 when fault = 'truncated' then 1 else 0 end as extra from faulty
), walk as (
    select conv_id, n_turns, cast(0 as bigint) as n, {'c': 0, 'a': '', 'o': cast([] as varchar[])} as s0, {'c': 200000000, 'a': '', 'o': cast([] as varchar[])} as s1,
        {'c': 2, 'a': 'I', 'o': ['user:']} as s2, {'c': 4, 'a': 'II', 'o': ['user:', 'assistant:']} as s3 from sums
    union all
    select conv_id, n_turns, n, d0, d1, $u, $v from (
        select w.conv_id, w.n_turns, w.n + 1 as n, $d0 as d0, least($d1, $k1) as d1, $r2 as d2, $r3 as d3
        from walk w join step t on t.conv_id is not distinct from w.conv_id and t.n = w.n + 1
    )
), best as (
    select conv_id, n_turns, least(s0, s3) as b from walk where n = n_turns
)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
    cast(coalesce(b.b.c, 0) as bigint) as cost, coalesce(b.b.a, '') as audit, sha256(coalesce(array_to_string(b.b.o, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join sums s on o.conv_id is not distinct from s.conv_id left join best b on o.conv_id is not distinct from b.conv_id
"""


def _repair_sql() -> str:
    """The walk over turns keeps, by state, the cheapest edits so far, of equal cost the ASCII-least, and what they give."""

    def edit(state: str, cost: str, label: str, role: str | None = None, text: str = "text") -> str:
        after = f"list_append({state}.o, {role} || ':' || {text})" if role else f"{state}.o"
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{label}', 'o': {after}}}"

    def keep(state: str, initial: str) -> str:
        return edit(state, f"extra + case when i = '{initial}' then 0 else 100000000 end", "K", "role")

    def put(state: str, role: str) -> str:
        return edit(state, "2", "I", f"'{role}'", "''")

    def rerole(state: str, role: str) -> str:
        return edit(state, "2 + extra", "R", f"'{role}'")

    user = [edit("s2", "3", "D"), *[keep(s, "u") for s in ("s0", "s1", "s3")], *[rerole(s, "user") for s in ("s0", "s1", "s3")]]
    assistant = f"least(d3, {put('d2', 'assistant')})"
    asked = f"least(d2, {put('d0', 'user')}, {put('d1', 'user')}, {put(assistant, 'user')})"
    return Template(OP12_SQL).substitute(
        crc=CRC,
        d0=edit("s0", "3", "D"),
        d1=edit("s1", "3", "D"),
        k1=keep("s0", "s"),
        r2=f"least({', '.join(user)})",
        r3=f"least({edit('s3', '3', 'D')}, {keep('s2', 'a')}, {rerole('s2', 'assistant')})",
        u=asked,
        v=f"least(d3, {put(asked, 'assistant')})",
    )


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.deduplicate(table(spark, sf_dir, "documents"), n=2, percent=80)


#: All pairs of word pairs in common, as for the n-gram join.
OP13_SQL = f"""
select *, doc_id = component_id as kept from (
{OP6_SQL.replace("ws[k:k + 4]", "ws[k:k + 1]").replace("greatest(len(ws) - 3, 2)", "greatest(len(ws), 2)").replace(">= 75 *", ">= 80 *")})
"""

QUERIES = {"op11_hard_negatives": op11_hard_negatives, "op12_structure_repair": op12_structure_repair, "op13_minhash_dedup": op13_minhash_dedup}
ORACLES = {"op11_hard_negatives": OP11_SQL, "op12_structure_repair": _repair_sql(), "op13_minhash_dedup": OP13_SQL}
