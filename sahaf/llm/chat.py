"""Chat formatting by minimum-cost role repair.

A conversation is legal if it is read by the automaton start -> [system ->] user -> assistant -> user ... -> assistant.
Dynamic programming over its states picks for every turn whether it opens a message or joins the one before, in its
own role or relabelled, and where empty messages go in, at the least total cost; then each turn is rendered.

Turns are range-partitioned by conversation and turn, so a conversation of any length may lie in several partitions.
Each partition sums up a conversation that crosses its border as a table of least costs between states; the driver
chains those few tables, and every partition then solves its own part between known states.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ROLES = ("system", "user", "assistant")
START = 3  # states are the role of the last message, or START
#: Spellings of the roles; any other role is unknown.
ALIASES = {"system": 0, "developer": 0, "user": 1, "human": 1, "prompter": 1, "assistant": 2, "gpt": 2, "bot": 2, "model": 2, "ai": 2, "chatbot": 2}


class Costs(NamedTuple):
    """Of joining the message before, of another role than the turn's, of a role for an unknown one, of an empty message."""

    merge: int = 1
    relabel: int = 2
    assign: int = 1
    insert: int = 3


def _next(state: int) -> tuple[int, ...]:
    return {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}[state]


def _way(state: int, role: int) -> tuple[int, ...] | None:
    """The shortest run of empty messages after which a message of that role may follow state."""
    edge, seen = [(state, ())], {state}
    while edge:
        s, way = edge.pop(0)
        if role in _next(s):
            return way
        for n in _next(s):
            if n not in seen:
                seen.add(n)
                edge.append((n, (*way, n)))
    return None


WAYS = {(s, r): _way(s, r) for s in range(4) for r in range(3)}
CLOSING = {0: (1, 2), 1: (2,), 2: (), START: ()}  # what must follow the last turn


class Choice(NamedTuple):
    cost: int
    opens: int
    role: int
    before: tuple[int, ...]


def choices(role: int | None, costs: Costs) -> dict[tuple[int, int], Choice]:
    """The best way from state to state over a turn of that role (None: unknown); on a tie, joining."""
    out: dict[tuple[int, int], Choice] = {}
    for s in range(4):
        for r in range(3):
            price = costs.assign if role is None else costs.relabel * (r != role)
            options = [Choice(price + costs.merge, 0, r, ())] if s == r else []
            if (way := WAYS[s, r]) is not None:
                options.append(Choice(price + costs.insert * len(way), 1 + len(way), r, way))
            if options:
                out[s, r] = min(options, key=lambda o: (o.cost, o.opens))
    return out


#: A total is (cost, messages, tie): ties go to fewer messages, then to the lesser sum of a hash of each turn and choice.
def _tie(h: int, role: int) -> int:
    return (h * (2 * role + 0x9E3779B97F4A7C15) >> 7) & 0xFFFFFFFF


def _add(a: tuple, c: Choice, h: int) -> tuple:
    return a[0] + c.cost, a[1] + c.opens, a[2] + _tie(h, c.role)


def forward(turns: list[tuple[int | None, int]], entry: dict[int, tuple], costs: Costs, keep: bool) -> tuple[dict[int, tuple], list[dict[int, tuple[int, Choice]]]]:
    """Least totals by state after turns of (role, hash), from totals by state; with keep, where each came from."""
    tables = {r: choices(r, costs) for r in {r for r, _ in turns}}
    back = []
    for r, h in turns:
        after: dict[int, tuple] = {}
        came: dict[int, tuple[int, Choice]] = {}
        for (s, t), c in tables[r].items():
            if s in entry:
                total = _add(entry[s], c, h)
                if t not in after or (total, s) < (after[t], came[t][0]):
                    after[t], came[t] = total, (s, c)
        entry = after
        if keep:
            back.append(came)
    return entry, back


def end_total(total: tuple, state: int, costs: Costs) -> tuple:
    return total[0] + costs.insert * len(CLOSING[state]), total[1] + len(CLOSING[state]), total[2]


def solve(turns: list[tuple[int | None, int]], entry: int, exit_: int | None, costs: Costs) -> list[Choice]:
    """The choices of turns from state entry to state exit_, or to the best end."""
    last, back = forward(turns, {entry: (0, 0, 0)}, costs, True)
    state = exit_ if exit_ is not None else min(last, key=lambda s: (end_total(last[s], s, costs), s))
    out = []
    for came in reversed(back):
        before, choice = came[state]
        out.append(choice)
        state = before
    return out[::-1]


def render(role: int, text: str) -> str:
    return f"<|{ROLES[role]}|>\n{text}"


CLOSE = "<|end|>\n"


def chain(parts: list[tuple[int, list[dict[int, tuple] | None], bool]], costs: Costs) -> list[tuple[int, int | None, int]]:
    """For the parts of one conversation, in order, their totals by entry state: entry, exit (None for the last) and messages before each."""
    totals: list[dict[int, tuple]] = [{START: (0, 0, 0)}]
    came: list[dict[int, int]] = []
    for table in parts:
        after: dict[int, tuple] = {}
        origin: dict[int, int] = {}
        for s, a in totals[-1].items():
            for t, x in (table[s] or {}).items():
                total = (a[0] + x[0], a[1] + x[1], a[2] + x[2])
                if t not in after or (total, s) < (after[t], origin[t]):
                    after[t], origin[t] = total, s
        totals.append(after)
        came.append(origin)
    state = min(totals[-1], key=lambda s: (end_total(totals[-1][s], s, costs), s))
    out = []
    for k in range(len(parts) - 1, -1, -1):
        before = came[k][state]
        out.append((before, state if k < len(parts) - 1 else None, totals[k][before][1]))
        state = before
    return out[::-1]


def repair(conversations: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """A row per turn: conv_id, turn, role_in, copies, role, action, inserted_before, inserted_after, cost, message, rendered.

    Turns are taken by conv_id, turn (nulls first), role and text; exact repeats of a turn are one turn, and copies
    says how many.  Roles are matched without case and outer white space; unknown and null roles can be given any role.
    A null text is an empty one; rows without conv_id are one conversation.  action is open or merge, with relabel+ or
    assign+ before it; message counts the conversation's messages from 0, empty ones included.  The rendered parts of a
    conversation in order are the whole conversation: what is inserted before, this turn's text, its message's end, and
    after the last turn what closes the conversation.  An empty table gives no rows; columns of other names are ignored.
    """
    role = F.trim(F.lower(F.col("role").cast("string")), F.lit(" \t\r\n"))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = turns.withColumn("h", F.xxhash64("conv_id", "turn", "role", "text"))
    keys = ["conv_id", "turn", "role", "h"]
    spark = conversations.sparkSession

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Number the partition's rows and fold exact repeats."""
        p, n, last = TaskContext.get().partitionId(), 0, None
        for b in batches:
            rows = []
            for conv, turn, r, text, h in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if last is not None and last[0] == (conv, turn, r, text):
                    last[2] += 1
                    continue
                if last is not None:
                    rows.append(last)
                last = [(conv, turn, r, text), h, 1]
            if rows:
                yield placed(rows, p, n)
                n += len(rows)
        if last is not None:
            yield placed([last], p, n)

    def placed(rows: list, p: int, n: int) -> pa.RecordBatch:
        cols = [[x[0][i] for x in rows] for i in range(4)]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([*(pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)), pa.array([x[1] for x in rows], type=pa.int64()), pa.array([x[2] for x in rows], type=pa.int64()), pa.array([p] * len(rows), type=pa.int32()), pa.array(range(n, n + len(rows)), type=pa.int64())], names=["conv_id", "turn", "role", "text", "h", "copies", "part", "pos"])

    fields = "conv_id long, turn long, role string, text string, h long, copies long, part int, pos long"
    dealt = common.materialize(common.map_arrow(turns.repartitionByRange(*keys).sortWithinPartitions(*keys), place, fields), "turns")
    # A conversation that lies in more than one partition is the last of one and the first of the next.
    borders = dealt.groupBy("part").agg(F.min(F.struct("pos", "conv_id")).alias("a"), F.max(F.struct("pos", "conv_id")).alias("b"), F.min("pos").alias("n")).orderBy("part").collect()  # a row per partition
    split = {x["b"]["conv_id"] for x, y in zip(borders, borders[1:], strict=False) if x["b"]["conv_id"] == y["a"]["conv_id"]}

    def known(r: str | None) -> int | None:
        return ALIASES.get(r) if r is not None else None

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Totals between states of each part of a split conversation, folded batch by batch."""
        now: dict = {}
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("part", "conv_id", "role", "h")), strict=True)
            for (p, conv), own in groupby(rows, key=lambda x: x[:2]):
                steps = [(known(r), h) for _, _, r, h in own]
                tables = now.get((p, conv)) or [{s: (0, 0, 0)} for s in range(4)]
                now[p, conv] = [forward(steps, t, costs, False)[0] for t in tables]
        flat = [(p, conv, s, t, *x) for (p, conv), tables in now.items() for s, table in enumerate(tables) for t, x in table.items()]
        if flat:
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*flat, strict=True), kinds, strict=True)], names=["part", "conv_id", "s", "t", "cost", "opens", "tie"])

    ends: dict[tuple[int, int | None], tuple[int, int | None, int]] = {}
    if split:
        ids = spark.createDataFrame([(x,) for x in split], "split long")
        own = dealt.join(F.broadcast(ids), F.col("conv_id").eqNullSafe(F.col("split")), "left_semi").select("part", "pos", "conv_id", "role", "h")
        sums = common.map_arrow(own.repartitionByRange("part").sortWithinPartitions("part", "pos").select("part", "conv_id", "role", "h"), summed, "part int, conv_id long, s int, t int, cost long, opens long, tie long").collect()  # twelve rows per partition and border
        tables: dict = {}
        for p, conv, s, t, *x in sums:
            tables.setdefault(conv, {}).setdefault(p, [None] * 4)
            tables[conv][p][s] = (tables[conv][p][s] or {}) | {t: tuple(x)}
        for conv, by in tables.items():
            order = sorted(by)
            ends |= {(p, conv): e for p, e in zip(order, chain([by[p] for p in order], costs), strict=True)}

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("part", "conv_id", "turn", "role", "text", "h", "copies")), strict=True)

        out: list[tuple] = []
        for (p, conv), own in groupby(rows(), key=lambda x: x[:2]):
            part = list(own)  # no more than a range partition
            entry, exit_, message = ends.get((p, conv), (START, None, 0))
            picked = solve([(known(x[3]), x[5]) for x in part], entry, exit_, costs)
            message -= 1
            state = entry
            for k, (x, c) in enumerate(zip(part, picked, strict=True)):
                message += c.opens
                last = k + 1 == len(part) and exit_ is None
                after = CLOSING[c.role] if last else ()
                text = (CLOSE if c.opens and state != START else "") + "".join(render(r, "") + CLOSE for r in c.before)
                text += render(c.role, x[4]) if c.opens else "\n" + x[4]
                text += (CLOSE + "".join(render(r, "") + CLOSE for r in after)) if last else ""
                how = "assign+" * (known(x[3]) is None) or "relabel+" * (known(x[3]) != c.role)
                out.append((conv, x[2], x[3], x[6], ROLES[c.role], how + ("open" if c.opens else "merge"), [ROLES[r] for r in c.before], [ROLES[r] for r in after], c.cost + costs.insert * len(after), message, text))
                state = c.role
            if len(out) >= common.BATCH_ROWS:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string()]
        names = ["conv_id", "turn", "role_in", "copies", "role", "action", "inserted_before", "inserted_after", "cost", "message", "rendered"]
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    ordered = dealt.repartitionByRange("part", "conv_id").sortWithinPartitions("part", "pos").select("part", "conv_id", "turn", "role", "text", "h", "copies")
    return common.map_arrow(ordered, finish, "conv_id long, turn long, role_in string, copies long, role string, action string, inserted_before array<string>, inserted_after array<string>, cost long, message long, rendered string")
