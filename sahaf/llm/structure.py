"""Repair of conversations whose turns are missing, blank, repeated, cut off or out of order, at the least cost.

Roles must read as an optional system message and then pairs of user and assistant.  A row is kept, given another role or
deleted, and empty messages may be inserted; dynamic programming over the states (nothing yet, after system, after user,
after assistant) finds the cheapest edits, the ASCII-least of several.

Rows are range-partitioned by conversation and turn and numbered, so a conversation may span partitions.  The costs of
what follows a row are found backwards: conversations are bucketed by length, and numpy moves the state costs of all of a
bucket back by one turn at a time.  For every row and state the first edit of the cheapest way on is stored, which is all
that the way forward needs: it streams the rows in order, again all conversations of a bucket turn by turn.  A worker
holds one block of rows, however long a conversation is.  Where a conversation crosses partitions, each part is first
summed up as a table of least costs between states, and later as a map from states to states; those are chained on the
driver, two parts a partition.  What the parts of such a conversation give is strung together in order by one task a
conversation, since a digest of its whole text is a chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Rows that are solved at once, at most.
BLOCK = 16384
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or relabelled message: its role is the one that may come.
TURN = np.array([USER, USER, ASSISTANT, USER])
#: The state after a kept row, by its role's initial (s, u, a, other) and the state before; -1 where it may not come.
KEEP = np.array([[SYSTEM, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1], [-1, -1, -1, -1]])
#: What may end: nothing at all, or an assistant's message.
END = np.array([0, 1 << 40, 1 << 40, 0])
NEVER = 1 << 40
RELABEL, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
SOUND, BLANK, AGAIN, TRUNCATED, GONE = range(5)  # a row's fault; GONE rows are not there
#: Edits in the order of their initials, which settles ties.
D, I, K, R = range(4)
LETTERS = "DIKR"
WHITE = " \t\n\v\f\r"


def closing(costs: np.ndarray) -> np.ndarray:
    """Least costs by state if up to two messages may be inserted first."""
    once = np.minimum(costs, INSERT + costs[..., TURN])
    return np.minimum(once, INSERT + once[..., TURN])


def back(costs: np.ndarray, role: np.ndarray, fault: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least costs before a row by state, from those after it, and the code of the edits there; the last axis is the state.

    A code is 4 * (messages inserted before) + edit.
    """
    cut = (CUT_OFF * (fault == TRUNCATED))[..., None]
    forced = ((fault == BLANK) | (fault == AGAIN))[..., None]
    delete = DELETE + costs
    keep_to = KEEP[role]
    keep = np.where(forced | (keep_to < 0), NEVER, cut + np.take_along_axis(costs, np.maximum(keep_to, 0), -1))
    relabel = np.where(forced, NEVER, RELABEL + cut + costs[..., TURN])
    best = closing(np.minimum(np.minimum(delete, keep), relabel))
    edit = np.where(delete == best, D, np.where(INSERT + best[..., TURN] == best, I, np.where(keep == best, K, R)))
    code, at = np.zeros_like(edit), np.broadcast_to(np.arange(4), edit.shape)
    for _ in range(2):
        on = np.take_along_axis(edit, at, -1) == I
        code, at = code + 4 * on, np.where(on, TURN[at], at)
    code += np.take_along_axis(edit, at, -1)
    gone = (fault == GONE)[..., None]
    return np.where(gone, costs, best), np.where(gone, D, code)


def step_tables() -> np.ndarray:
    """The state after a row by role, code and state before; with code D it is the state before."""
    out = np.empty((4, 12, 4), dtype=np.int64)
    for role in range(4):
        for code in range(12):
            for s in range(4):
                t = s
                for _ in range(code // 4):
                    t = TURN[t]
                out[role, code, s] = {D: t, K: max(KEEP[role, t], 0), R: TURN[t]}.get(code % 4, t)
    return out


NEXT = step_tables()


def buckets(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of the conversations of each bucket: lengths up to 1, 2, 4, 8, ..."""
    size = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for b in np.unique(size):
        yield np.flatnonzero(size == b)


def bounds(rows: int, starts: np.ndarray) -> np.ndarray:
    return np.diff(np.append(starts, rows))


def solve_back(role: np.ndarray, fault: np.ndarray, starts: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(costs before each conversation, codes of each row and state), of conversations that lie one after the other.

    after holds the costs behind each conversation; its axes but the first and last are carried along.
    """
    lengths = bounds(len(role), starts)
    before, codes = after.copy(), np.zeros((len(role), *after.shape[1:]), dtype=np.int8)
    for own in buckets(lengths):
        costs, n, longest = after[own], lengths[own], int(lengths[own].max())
        shape = (len(own),) + (1,) * (after.ndim - 2)
        for t in range(1, longest + 1):  # time-major, from the end
            there = t <= n
            at = starts[own] + np.where(there, n - t, 0)
            r, f = role[at].reshape(shape), np.where(there, fault[at], GONE).reshape(shape)
            r, f = np.broadcast_to(r, costs.shape[:-1]), np.broadcast_to(f, costs.shape[:-1])
            costs, code = back(costs, r, f)
            codes[at[there]] = code[there]
        before[own] = costs
    return before, codes


def trace(role: np.ndarray, codes: np.ndarray, starts: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of each row, state before each row, state after each conversation) on the cheapest way from the entry states."""
    lengths = bounds(len(role), starts)
    picked, state, leave = np.zeros(len(role), dtype=np.int8), np.zeros(len(role), dtype=np.int8), entry.copy()
    for own in buckets(lengths):
        s, n = entry[own], lengths[own]
        for t in range(int(n.max())):
            on = np.flatnonzero(t < n)
            at = starts[own[on]] + t
            code = codes[at, s[on]]
            picked[at], state[at] = code, s[on]
            s[on] = NEXT[role[at], code, s[on]]
        leave[own] = s
    return picked, state, leave


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of damaged rows: dropped ones have 0 copies, repeated ones 2.

    The checksum of conv_id:turn decides; a null there, as in role and text, reads as one space.
    """
    one = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), one), F.lit(":"), F.coalesce(F.col("turn").cast("string"), one))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), one).alias("role"), F.coalesce(F.col("text").cast("string"), one).alias("text"), (F.crc32(key) % 20).alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


def _equal(column: pa.Array) -> np.ndarray:
    """Whether each value but the first equals the one before it; nulls are equal."""
    a, b = column[1:], column[:-1]
    null_a, null_b = a.is_null().to_numpy(zero_copy_only=False), b.is_null().to_numpy(zero_copy_only=False)
    return np.where(null_a | null_b, null_a & null_b, pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False))


def _twins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that equal the row before them repeat it."""
    names = ("conv_id", "turn", "role", "text")
    last = None
    for b in batches:
        if not len(b):
            continue
        with_last = b if last is None else pa.Table.from_batches([last, b]).combine_chunks().to_batches()[0]
        same = np.logical_and.reduce([_equal(with_last.column(n)) for n in names])
        if last is None:
            same = np.r_[False, same]
        fault = b.column("fault").to_numpy()
        fault = np.where(same & ((fault == SOUND) | (fault == TRUNCATED)), AGAIN, fault).astype(np.int8)
        yield b.set_column(b.schema.get_field_index("fault"), "fault", pa.array(fault))
        last = b.slice(len(b) - 1)


def _numbered(rows: DataFrame) -> DataFrame:
    """The rows in order, written: conv_id, turn, role, text, copies, initial, fault, place (ascending with the order).

    Repeats of a text in other turns are told by a table of each text's first turn, made of the texts of several turns;
    equal rows of one turn lie side by side.
    """
    solid = F.rtrim(F.col("text"), F.lit(WHITE))
    rows = rows.withColumns({"blank": solid == "", "cut": ~F.right(solid, F.lit(1)).isin(".", "!", "?"), "digest": F.when(solid != "", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)))})
    firsts = rows.where("copies > 0 and not blank").groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"), F.max(F.struct("turn")).alias("last")).where("first <> last")
    firsts = firsts.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    joined = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    again = F.col("first").isNotNull() & (F.struct("turn") != F.col("first"))
    fault = F.when(F.col("copies") == 0, GONE).when(F.col("blank"), BLANK).when(again, AGAIN).when(F.col("cut"), TRUNCATED).otherwise(SOUND)
    rows = joined.select("conv_id", "turn", "role", "text", F.col("copies").cast("int").alias("copies"), _initial(F.col("role")).cast("byte").alias("initial"), fault.cast("byte").alias("fault"))
    # a turn's rows lie by role and text; the beginning of the text is enough to part many rows of one turn
    ordered = rows.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(32))).sortWithinPartitions("conv_id", "turn", "role", "text")
    return common.materialize(common.map_arrow(ordered, _twins, ordered.schema).withColumn("place", F.monotonically_increasing_id()), "turns")


PART = 33  # bits of a place within its partition
Key = tuple[int, int | None]  # a partition and a conversation


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.Table]:
    """Batches put together into blocks of rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= block or b.nbytes * len(held) > 1 << 25:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _runs(t: pa.Table) -> tuple[np.ndarray, list[Key]]:
    """Where the runs of one conversation in one partition start, and their keys."""
    part, conv = _column(t, "place") >> PART, t.column("conv_id").combine_chunks()
    new = np.r_[True, (part[1:] != part[:-1]) | ~_equal(conv)]
    starts = np.flatnonzero(new)
    return starts, list(zip(part[starts].tolist(), conv.take(pa.array(starts)).to_pylist(), strict=True))


def _backwards(batches: Iterator[pa.RecordBatch], behind: Callable[[Key], np.ndarray], block: int) -> Iterator[tuple[pa.Table, list[tuple[Key, np.ndarray]], np.ndarray]]:
    """Of rows that come last first, block by block in their order: the block, what is known of runs that are done, the codes.

    behind gives the costs behind a run; those before a run that goes on in the next block are handed on.
    """
    now: tuple[Key, np.ndarray] | None = None
    for t in _blocks(batches, block):
        t = t.take(pa.array(np.arange(len(t) - 1, -1, -1)))
        starts, keys = _runs(t)
        done = []
        if now is not None and now[0] != keys[-1]:
            done.append(now)
            now = None
        after = np.stack([behind(k) for k in keys[:-1]] + [behind(keys[-1]) if now is None else now[1]])
        before, codes = solve_back(_column(t, "initial").astype(int), _column(t, "fault").astype(int), starts, after)
        done += list(zip(keys[1:], before[1:], strict=True))
        now = keys[0], before[0]
        yield t, done, codes
    if now is not None:
        yield pa.table({}), [now], np.empty((0, 4), dtype=np.int8)


def _summed(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Least costs from state to state of every run."""
    unit = np.where(np.eye(4, dtype=bool), 0, NEVER)
    for _, done, _ in _backwards(batches, lambda key: unit, block):
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in done], pa.int64()), pa.array([k[1] for k, _ in done], pa.int64()), pa.array([m.ravel().tolist() for _, m in done], pa.list_(pa.int64()))], names=["part", "conv_id", "costs"])


def _forwards(t: pa.Table, now: tuple[Key, np.ndarray] | None, entry: Callable[[Key], np.ndarray]) -> tuple[np.ndarray, list[Key], list]:
    """(starts, keys, per entry state (codes, states, leaving states)) of a block's runs; the first may go on from now."""
    starts, keys = _runs(t)
    role, codes = _column(t, "initial").astype(int), _codes(t)
    states = np.stack([now[1] if now is not None and k == 0 and now[0] == key else entry(key) for k, key in enumerate(keys)])
    return starts, keys, [trace(role, codes, starts, states[:, e]) for e in range(states.shape[1])]


def _pack(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.int32) << np.array([0, 4, 8, 12])).sum(1).astype(np.int32)


def _codes(t: pa.Table) -> np.ndarray:
    return (_column(t, "codes")[:, None] >> np.array([0, 4, 8, 12])) & 15


def _mapped(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """The state after every run for each state before it."""
    now = None

    def done(keys: list[Key], leave: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(leave.tolist(), pa.list_(pa.int64()))], names=["part", "conv_id", "leave"])

    for t in _blocks(batches, block):
        _, keys, by = _forwards(t, now, lambda key: np.arange(4))
        leave = np.stack([x[2] for x in by], axis=1)
        if now is not None and now[0] != keys[0]:
            yield done([now[0]], now[1][None])
        if len(keys) > 1:
            yield done(keys[:-1], leave[:-1])
        now = keys[-1], leave[-1]
    if now is not None:
        yield done([now[0]], now[1][None])


class Piece(NamedTuple):
    """What a run of a conversation's rows comes to; lines are its part of the repaired text."""

    low: int | None
    high: int | None
    distinct: int
    first_role: int
    last_role: int
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    cost: int
    audit: str
    lines: bytes | None
    leave: int


NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {(0, 1), (1, 2), (2, 1)}
_legal = np.array([[(a, b) in LEGAL for b in range(4)] for a in range(4)])


def _inserted(state: int, n: int) -> list[int]:
    out = []
    for _ in range(n):
        state = int(TURN[state])
        out.append(state)
    return out


#: By state and code: the lines inserted before a row, and the role that a relabelled row is given.
_before = [[[f"{NAMES[s]}:".encode() for s in _inserted(state, code // 4)] for code in range(12)] for state in range(4)]
_given = [[NAMES[int(TURN[([state] + _inserted(state, code // 4))[-1]])].encode() for code in range(12)] for state in range(4)]
_letters = ["I" * (code // 4) + LETTERS[code % 4] for code in range(12)]


def _pieces(t: pa.Table, starts: np.ndarray, picked: np.ndarray, state: np.ndarray, leave: np.ndarray) -> list[Piece]:
    fault, role, copies = _column(t, "fault"), _column(t, "initial"), _column(t, "copies").astype(np.int64)
    edit, inserted = picked % 4, picked // 4
    there = fault != GONE
    cost = np.where(there, INSERT * inserted + RELABEL * (edit == R) + DELETE * (edit == D) + DELETE * (copies - 1) + CUT_OFF * ((fault == TRUNCATED) & (edit != D)), 0)
    roles, texts, turns = (t.column(n).to_pylist() for n in ("role", "text", "turn"))
    out = []
    for a, n, last in zip(starts.tolist(), bounds(len(role), starts).tolist(), leave.tolist(), strict=True):
        own = [k for k in range(a, a + n) if there[k]]
        at = np.array(own, dtype=np.int64)
        r, f, c = role[at], fault[at], copies[at]
        lines, audit = [], []
        for k in own:
            code, s = picked[k], state[k]
            lines += _before[s][code]
            if code % 4 != D:
                lines.append((roles[k].encode() if code % 4 == K else _given[s][code]) + b":" + texts[k].encode())
            audit.append(_letters[code] + "D" * (int(copies[k]) - 1))
        seen = [turns[k] for k in own if turns[k] is not None]
        illegal = int((~_legal[r[:-1], r[1:]]).sum() + (c - 1).sum()) if own else 0
        duplicate = int(np.where(f == AGAIN, c, np.where(f == BLANK, 0, c - 1)).sum())
        out.append(Piece(seen[0] if seen else None, seen[-1] if seen else None, len(set(seen)), int(r[0]) if own else -1, int(r[-1]) if own else -1, int(c[f == BLANK].sum()), duplicate, int((f == TRUNCATED).sum()), illegal, int(cost[at].sum()), "".join(audit), b"\n".join(lines) if lines else None, last))
    return out


class Whole:
    """A conversation put together from its pieces, in order."""

    def __init__(self) -> None:
        self.low = self.high = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.role, self.leave, self.audit, self.sha, self.begun = -1, START, [], hashlib.sha256(), False

    def line(self, raw: bytes) -> None:
        if self.begun:
            self.sha.update(b"\n")
        self.sha.update(raw)
        self.begun = True

    def add(self, p: Piece) -> None:
        if p.low is not None:
            self.distinct += p.distinct - (p.low == self.high)
            self.low, self.high = p.low if self.low is None else self.low, p.high
        if p.first_role >= 0:
            self.illegal += self.role >= 0 and (self.role, p.first_role) not in LEGAL
            self.role = p.last_role
        self.illegal += p.illegal
        self.blank += p.blank
        self.duplicate += p.duplicate
        self.truncated += p.truncated
        self.cost += p.cost
        self.audit.append(p.audit)
        if p.lines is not None:
            self.line(p.lines)
        self.leave = p.leave

    def result(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        for s in {SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,)}.get(self.leave, ()):
            self.line(f"{NAMES[s]}:".encode())
            self.audit.append("I")
            self.cost += INSERT
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return gaps, self.blank, self.duplicate, self.truncated, int(self.illegal), self.cost, "".join(self.audit), self.sha.hexdigest()


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
PIECE = ", ".join(f"{n} {'string' if n == 'audit' else 'binary' if n == 'lines' else 'long'}" for n in Piece._fields)
_arrow = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, type=_arrow[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _strung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of pieces that come in order."""
    now, whole = None, Whole()
    for b in batches:
        for conv, *values in zip(*(b.column(n).to_pylist() for n in ("conv_id", *Piece._fields)), strict=True):
            if now is not None and now != (conv,):
                yield _batch([(*now, *whole.result())], RESULT)
                whole = Whole()
            now = (conv,)
            whole.add(Piece(*values))
    if now is not None:
        yield _batch([(*now, *whole.result())], RESULT)


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    rows are conv_id, turn, role, text and copies (how often a row stands there; 0: not at all, but its conversation is
    reported).  Rows are taken by turn (nulls first), role and text.  Rows without conv_id are one conversation.  Null
    roles and texts must have been replaced (damage() does); an empty role has no legal initial; texts and conversations
    may be of any length.  A conversation without rows has zeros, an empty audit and the digest of nothing.  An empty
    table gives no rows; columns of other names are ignored.  A worker holds block rows at a time.
    """
    spark = rows.sparkSession
    turns = _numbered(rows)
    part = F.shiftright("place", PART)
    ends = turns.groupBy(part.alias("part")).agg(F.min_by("conv_id", "place").alias("a"), F.max_by("conv_id", "place").alias("b")).orderBy("part").collect()  # a row a partition
    crossing = {x["b"] for x, y in zip(ends, ends[1:], strict=False) if x["b"] == y["a"]}
    parts = {c: [x["part"] for x in ends if c in (x["a"], x["b"])] for c in crossing}
    ids = F.broadcast(spark.createDataFrame([(c,) for c in crossing], "split long"))  # at most one a partition

    def split(df: DataFrame) -> DataFrame:
        return df.join(ids, F.col("conv_id").eqNullSafe(F.col("split")), "left_semi")

    def ordered(df: DataFrame, *by: Column) -> DataFrame:
        return df.withColumn("part", part).repartitionByRange("part", "conv_id").sortWithinPartitions(*by).drop("part")

    slim = turns.select("conv_id", "place", "initial", "fault")
    behind: dict[Key, np.ndarray] = {}
    if crossing:
        sums = {(r["part"], r["conv_id"]): np.array(r["costs"]).reshape(4, 4) for r in common.map_arrow(ordered(split(slim), F.desc("place")), partial(_summed, block=block), "part long, conv_id long, costs array<long>").collect()}  # two rows a partition
        for c, own in parts.items():
            costs = closing(END)
            for p in reversed(own):
                behind[p, c] = costs
                costs = (sums[p, c] + costs[:, None]).min(axis=0)

    def policy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _, codes in _backwards(batches, lambda key: behind.get(key, closing(END)), block):
            if len(codes):
                yield pa.RecordBatch.from_arrays([t.column("conv_id").combine_chunks(), t.column("place").combine_chunks(), pa.array(_column(t, "initial")), pa.array(_pack(codes))], names=["conv_id", "place", "initial", "codes"])

    codes = common.materialize(common.map_arrow(ordered(slim, F.desc("place")), policy, "conv_id long, place long, initial byte, codes int"), "edits")
    entry: dict[Key, int] = {}
    if crossing:
        maps = {(r["part"], r["conv_id"]): r["leave"] for r in common.map_arrow(ordered(split(codes), F.asc("place")), partial(_mapped, block=block), "part long, conv_id long, leave array<long>").collect()}  # two rows a partition
        for c, own in parts.items():
            state = START
            for p in own:
                entry[p, c] = state
                state = maps[p, c][state]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Conversations of one partition as results (place is null), others as pieces."""
        now, held, open_ = None, None, {}
        for t in _blocks(batches, block):
            if held is not None:
                t = pa.concat_tables([held, t]).combine_chunks()
            is_row = _column(t, "is_row")
            held = None if is_row[-1] else t.slice(len(t) - 1)
            edits, own = t.filter(pa.array(~is_row)), t.filter(pa.array(is_row))
            if not len(own):
                continue
            own = own.set_column(own.schema.get_field_index("codes"), "codes", edits.column("codes").slice(0, len(own))).combine_chunks()
            starts, keys, [(picked, state, leave)] = _forwards(own, now, lambda key: np.array([entry.get(key, START)]))
            pieces = _pieces(own, starts, picked, state, leave)
            done = []
            for key, at, p in zip(keys, starts.tolist(), pieces, strict=True):
                if key[1] in crossing:
                    done.append((key[1], own.column("place")[at].as_py(), *p, *[None] * 8))
                    continue
                if key not in open_:
                    done += [(k[1], None, *[None] * len(Piece._fields), *w.result()) for k, w in open_.items()]
                    open_ = {key: Whole()}
                open_[key].add(p)
            now = keys[-1], leave[-1:]
            if done:
                yield _batch(done, whole_schema)
        if open_:
            yield _batch([(k[1], None, *[None] * len(Piece._fields), *w.result()) for k, w in open_.items()], whole_schema)

    named = ", ".join("whole_" + f for f in RESULT.split(", ")[1:])
    whole_schema = f"conv_id long, place long, {PIECE}, {named}"
    # each row lies next to the codes of its edits
    both = turns.select("conv_id", "place", "turn", "role", "text", "copies", "initial", "fault", F.lit(None).cast("int").alias("codes"), F.lit(True).alias("is_row")).unionByName(codes.select("conv_id", "place", "codes", F.lit(False).alias("is_row")), allowMissingColumns=True)
    out = common.materialize(common.map_arrow(ordered(both, F.asc("place"), F.asc("is_row")), finish, whole_schema), "conversations")
    common.drop(turns, codes)
    results = out.where("place is null").select("conv_id", *(F.col("whole_" + f.split()[0]).alias(f.split()[0]) for f in RESULT.split(", ")[1:]))
    if not crossing:
        return results
    strung = out.where("place is not null").repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", *Piece._fields)
    return results.unionByName(common.map_arrow(strung, _strung, RESULT))
