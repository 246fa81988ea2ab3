"""Repair of conversations by lightest derivations.

A repaired conversation is one system turn or none, then pairs of a user and an assistant turn.
The item (i, q) stands for "the first i turns are edited into a beginning after which the last
role is q". Each edit is a deduction from an item, and a turn where it uses one, to the next item;
its value adds the edit's cost and initial to (cost, audit), so no conclusion is lighter than what it
comes from. An agenda pops items by (cost, audit): what is popped first is final, until the goal is.
Long conversations are cut into parts; a part is solved between all pairs of states, and
neighbouring parts are joined by the lightest sum.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What may follow each state: nothing yet, a system, a user, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {
    START: {"s": SYSTEM, "u": USER},
    SYSTEM: {"u": USER},
    USER: {"a": ASSISTANT},
    ASSISTANT: {"u": USER},
}
ENDS = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
DELETE, RELABEL, INSERT, TRUNCATED = 4, 3, 3, 3
BLANK_CHARS = " \t\n\x0b\x0c\r"
PART = 256

Value = tuple[int, str]


@dataclass(frozen=True)
class Turn:
    """What an edit needs to know of a turn."""

    initial: str
    must_go: bool
    truncated: bool


def lightest(turns: Sequence[Turn], start: int, goals: Sequence[int]) -> dict[int, Value]:
    """Least cost and then least audit from ``start`` over all turns to each goal state."""
    agenda: list[tuple[int, str, int, int]] = [(0, "", 0, start)]
    final: dict[tuple[int, int], Value] = {}
    wanted = {(len(turns), q) for q in goals}
    while agenda and wanted:
        cost, audit, i, state = heapq.heappop(agenda)
        if (i, state) in final:
            continue
        final[i, state] = cost, audit
        wanted.discard((i, state))
        turn = turns[i] if i < len(turns) else None
        if turn:
            heapq.heappush(agenda, (cost + DELETE, audit + "D", i + 1, state))
        keeps = turn is not None and not turn.must_go
        for initial, then in NEXT[state].items():
            extra = TRUNCATED if keeps and turn.truncated else 0
            if keeps and turn.initial == initial:
                heapq.heappush(agenda, (cost + extra, audit + "K", i + 1, then))
            if initial in ROLES:
                heapq.heappush(agenda, (cost + INSERT, audit + "I", i, then))
                if keeps:
                    heapq.heappush(agenda, (cost + RELABEL + extra, audit + "R", i + 1, then))
    return {q: final[len(turns), q] for q in goals if (len(turns), q) in final}


def _between(turns: Sequence[Turn]) -> dict[tuple[int, int], Value]:
    """Lightest values of a part between all pairs of states.

    Among edits of equal cost between the same states none is the beginning of another (it
    would lack an insertion, and cost less), so least parts make least wholes.
    """
    if len(turns) <= PART:
        return {(p, q): v for p in NEXT for q, v in lightest(turns, p, list(NEXT)).items()}
    half = len(turns) // 2
    left, right = _between(turns[:half]), _between(turns[half:])
    out: dict[tuple[int, int], Value] = {}
    for (p, q), (cost, audit) in left.items():
        for r in NEXT:
            if (q, r) in right:
                value = cost + right[q, r][0], audit + right[q, r][1]
                out[p, r] = min(out.get((p, r), value), value)
    return out


def cheapest_edits(turns: Sequence[Turn]) -> Value:
    """Cost and audit of the edits that make the conversation well-formed.

    The audit names the edits in order: Delete, Insert, Keep, Rerole.
    """
    if len(turns) <= PART:
        # One goal: both accepted states, reached at no cost.
        ends = lightest(turns, START, ENDS)
    else:
        ends = {q: v for (p, q), v in _between(turns).items() if p == START and q in ENDS}
    return min(ends.values())


def edited(turns: Sequence[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """Roles and texts after the edits of an audit. The state fixes the role of each edit."""
    out, state, i = [], START, 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else turns[i]
        i += edit != "I"
        if edit == "D":
            continue
        if edit != "K":
            role = ROLES["a" if state == USER else "u"]
        state = NEXT[state][role[:1]]
        out.append((role, text))
    return out


def faults_of(turns: Sequence[tuple[str, str]]) -> list[str]:
    """The first fault of each turn: blank, duplicate of an earlier one, truncated, or none."""
    seen, out = set(), []
    for turn in turns:
        said = turn[1].strip(BLANK_CHARS)
        if not said:
            out.append("blank")
        elif turn in seen:
            out.append("duplicate")
        else:
            out.append("" if said[-1] in ".!?" else "truncated")
        seen.add(turn)
    return out


LEGAL = {"su", "ua", "au"}
TURN = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


def repair_conversations(turns: DataFrame) -> DataFrame:
    """One row for each conv_id: its faults, the cheapest edits, and the repaired turns.

    ``turns`` has conv_id, turn, role and text; other columns are left out. Turns are ordered by
    number, missing ones first, then by role and text; repeated rows stay and are duplicates of
    each other. A missing role or text is one space, so the text is blank. Turns without a
    conversation form one with the id NULL. ``gaps`` counts the turn numbers that are missing between
    the least and the greatest. Roles are told by their first letter; other letters than s, u
    and a are never kept. Returned are conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit
    and ``turns`` (role, text). Tables without rows give none. A conversation is one row here and in the
    result, so its size is bounded by that of a row; rows are moved once, by conversation.
    """
    space = F.lit(" ")
    held = turns.groupBy("conv_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "turn",
                    F.coalesce("role", space).alias("role"),
                    F.coalesce("text", space).alias("text"),
                )
            )
        ).alias("_turns"),
    )
    number = F.array_compact("_turns.turn")
    span = F.array_max(number) - F.array_min(number) + 1 - F.size(F.array_distinct(number))
    held = held.select(
        "conv_id",
        F.coalesce(span, F.lit(0)).cast("bigint").alias("gaps"),
        F.col("_turns.role"),
        F.col("_turns.text"),
    )
    schema = T.StructType(
        [
            held.schema["conv_id"],
            T.StructField("gaps", T.LongType()),
            *[T.StructField(c, T.LongType()) for c in COUNTS],
            T.StructField("audit", T.StringType()),
            T.StructField("turns", T.ArrayType(TURN)),
        ]
    )
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, audits, repaired = [], [], []
            for roles, texts in zip(batch.column("role"), batch.column("text")):
                said = list(zip(roles.as_py(), texts.as_py()))
                faults = faults_of(said)
                initials = [role[:1] for role, _ in said]
                cost, audit = cheapest_edits(
                    [
                        Turn(initial, fault in ("blank", "duplicate"), fault == "truncated")
                        for initial, fault in zip(initials, faults)
                    ]
                )
                illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
                counts.append([*map(faults.count, COUNTS[:3]), illegal, cost])
                audits.append(audit)
                repaired.append([dict(zip(TURN.names, t)) for t in edited(said, audit)])
            columns = [pa.array(c, pa.int64()) for c in zip(*counts)] or [
                pa.array([], pa.int64()) for _ in COUNTS
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"),
                    batch.column("gaps"),
                    *columns,
                    pa.array(audits, pa.string()),
                    pa.array(repaired, kind),
                ],
                names=schema.names,
            )

    return held.mapInArrow(repair, schema)
