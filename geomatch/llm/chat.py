"""Chat formatting by a finite-state machine over roles.

Turns of a conversation lie together in order; a task walks them once, holding one turn at a
time, so a conversation may be of any length. The machine takes each role to its next state and
marks where the order is broken; a broken conversation is still formatted, and its turns carry
``valid = false`` from there on. Each turn gives three segments from a declarative template: its
head, its text and its tail, and a flag that says whether the segment counts for the loss.

Control strings are escaped inside texts: ``<|`` becomes ``<\\|``, and what already looks like an
escape gets one more backslash, so that the text can be read back whole.

Defined cases: a null text or role is empty; a null conversation id is a conversation of its own;
a null turn comes first; equal turns are ordered by role and text; a repeated row is a turn of its
own; an unknown role breaks the order; other columns are ignored; an empty table gives nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PLAIN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: "<\\" + m[1] + "|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "<" + m[1] + "|", text)


@dataclass(frozen=True)
class Template:
    """What stands around a text, which roles count for the loss, and which role may follow which."""

    head: str = "<|im_start|>{role}\n"
    tail: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "told", "user": "asked"},
            "told": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        name = escape(role).replace("\\", "\\\\").replace("\n", "\\n")
        return [(self.head.format(role="{role}").replace("{role}", name), False), (escape(text), role in self.loss_roles), (self.tail, False)]

    def role(self, head: str) -> str:
        before, after = self.head.split("{role}")
        name = head[len(before) : len(head) - len(after)]
        return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], name))


SEGMENTS = "conv_id long, turn_no long, part int, segment string, loss boolean, valid boolean, state string"


def ordered(conversations: DataFrame) -> DataFrame:
    """Every conversation in one partition and in order; the sort spills, nothing is collected."""
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return c.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")


def format_chat(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Three segments a turn, in order inside their partition; joined, they are the formatted text."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: tuple = ("none",)
        turn_no, state, valid = 0, "start", True
        for pdf in frames:
            out = []
            for conv, role, text in zip(pdf["conv_id"], pdf["role"], pdf["text"], strict=True):
                key = (None,) if pd.isna(conv) else (int(conv),)
                if key != now:
                    now, turn_no, state, valid = key, 0, "start", True
                state = template.moves.get(state, {}).get(role, "broken")
                valid = valid and state != "broken"
                out += [(key[0], turn_no, part, s, loss, valid, state) for part, (s, loss) in enumerate(template.segments(role, text))]
                turn_no += 1
            frame = pd.DataFrame(out, columns=["conv_id", "turn_no", "part", "segment", "loss", "valid", "state"])
            yield frame.astype({"conv_id": "Int64"})

    return ordered(conversations).mapInPandas(run, SEGMENTS)
