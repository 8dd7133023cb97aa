"""Removal of repeated passages by suffix arrays.

Every byte that a `length`-byte string covers which starts elsewhere too is removed.  Such a string holds the same
`GRAM`-byte anchor, the least hash of its grams, wherever it stands; strings whose anchor occurs once are no candidates.
The candidates are cut into pieces by shorter anchors, and the pieces with equal anchors meet in one shard.  Pieces of
equal bytes are aggregated first: each stands for all, and its starts are repeated if there are several.  Of the pieces
that share an anchor but not all bytes a suffix array is refined by prefix doubling of the groups that are not sorted
yet (Larsson and Sadakane), common prefixes of neighbours come from Kasai's algorithm, run over all pieces side by side,
and a start is repeated if it shares `length` bytes with a neighbour.  Anchors that occur very often are dealt to
several shards; the sorted strings of those are merged by binary search.

The same is done with words in place of bytes: a text is then the row of its words' hashes, a word being a run of bytes
that are not ASCII white space.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import mix

LENGTH = 400
#: Bytes of the anchors that filter, and of those that cut pieces.
GRAM, CUT_GRAM = 200, 24
#: The same in words.
WORD_GRAM, WORD_CUT_GRAM = 25, 4
#: Starts of strings that are hashed at once; suffixes of a shard; occurrences of an anchor in a shard.
BLOCK, SHARD, OFTEN = 1 << 18, 1_000_000, 4_000
#: Words of 8 bytes that are compared at once for a common prefix.
WIDE = 16
_step = 0x9E3779B97F4A7C15 | 1
_values = np.random.default_rng(11).integers(1, 2**63, (2, 256), dtype=np.uint64)
_space = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP = _powers(_step, BLOCK + 2048)
_DOWN = _powers(pow(_step, -1, 1 << 64), BLOCK + 2048)


def as_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), dtype=np.uint8)


def word_bounds(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the words of a text's bytes."""
    solid = np.r_[False, ~_space[a], False]
    turns = np.flatnonzero(solid[1:] != solid[:-1])
    return turns[::2], turns[1::2]


def as_words(text: str) -> np.ndarray:
    """A 64-bit hash of each word of a text: of its bytes' eights if they are few, else of its digest."""
    raw = text.encode()
    start, end = word_bounds(np.frombuffer(raw, dtype=np.uint8))
    out = np.empty(len(start), dtype=np.uint64)
    short = np.flatnonzero(end - start <= common.SHORT)
    lead, tail = common.edges(raw, start[short], end[short])
    out[short] = mix(mix(mix(lead) + tail) + (end - start)[short].astype(np.uint64))
    for k in np.flatnonzero(end - start > common.SHORT).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(raw[start[k] : end[k]], digest_size=8).digest())
    return out


def gram_hashes(a: np.ndarray, k: int, table: int = 0) -> np.ndarray:
    """A 64-bit hash of each k symbols (bytes or words) of a, which has at most as many as there are powers."""
    total = np.zeros(len(a) + 1, dtype=np.uint64)
    values = _values[table][a] if a.dtype == np.uint8 else mix(a ^ _values[table][0])
    np.cumsum(values * _UP[: len(a)], out=total[1:])
    return mix((total[k:] - total[:-k]) * _DOWN[: len(a) - k + 1])


def anchors(a: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, count, hash): runs of starts of `length`-byte strings that have the same anchor, the k bytes of least hash.

    Of equal hashes the leftmost counts, so equal strings have the same anchor at the same offset.
    """
    h = gram_hashes(a, k)
    low = np.uint64((1 << 20) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, span = length - k + 1, 1
    while 2 * span <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < width:
        key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
    at = (key & low).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return first, np.diff(np.append(first, len(at))), h[at[first]]


def blocks(n: int, length: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of a text of n bytes that hold all its strings, the starts of each once."""
    for a in range(0, n - length + 1, BLOCK):
        yield a, min(n, a + BLOCK + length - 1)


def suffix_array(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array and ranks of pieces: symbols is the pieces' bytes or numbers, ends[i] where i's piece ends.

    A suffix ends with its piece; of two equal ones the one of the earlier piece comes first.
    """
    n = len(symbols)
    bits = max(9, (int(symbols.max(initial=0)) + 1).bit_length())
    h = 63 // bits
    padded = np.zeros(n + h, dtype=np.uint64)
    padded[:n] = symbols.astype(np.uint64) + np.uint64(1)
    left = ends - np.arange(n)
    key = np.zeros(n, dtype=np.uint64)
    for j in range(h):
        key = (key << np.uint64(bits)) | np.where(left > j, padded[j : n + j], np.uint64(0))
    sa = np.argsort(key)
    rank = np.empty(n, dtype=np.int64)
    ordered = key[sa]
    start = np.r_[True, ordered[1:] != ordered[:-1]]
    slots = np.arange(n)
    rank[sa] = np.maximum.accumulate(np.where(start, slots, 0))
    del key, ordered
    longest = int(left.max()) if n else 0
    tied = ~start
    tied[:-1] |= tied[1:].copy()
    slots = slots[tied]
    while len(slots) and h < longest:
        at = sa[slots]
        ahead = np.where(left[at] > h, rank[np.minimum(at + h, n - 1)] + 1, 0)
        key = (rank[at].astype(np.uint64) << np.uint64(32)) | ahead.astype(np.uint64)
        order = np.argsort(key)
        at, key = at[order], key[order]
        sa[slots] = at
        start = np.r_[True, key[1:] != key[:-1]]
        rank[at] = np.maximum.accumulate(np.where(start, slots, 0))
        tied = ~start
        tied[:-1] |= tied[1:].copy()
        slots = slots[tied]
        h *= 2
    if len(slots):  # equal to the end of their pieces
        at = sa[slots]
        sa[slots] = at[np.lexsort((at, rank[at]))]
        rank[sa[slots]] = slots
    return sa, rank


def common_prefixes(symbols: np.ndarray, first: np.ndarray, size: np.ndarray, sa: np.ndarray, rank: np.ndarray, least: int = 1) -> np.ndarray:
    """Kasai: for each place in the suffix array the symbols that its suffix shares with the one before.

    Symbols are bytes, or numbers of 32 bits.  All pieces are walked side by side, from their first suffix to the last
    of `least` symbols; shorter ones count 0.
    """
    n = len(symbols)
    ends = np.repeat(first + size, size)
    bits = 8 * symbols.dtype.itemsize
    per = 64 // bits
    words = np.zeros(n + per, dtype=np.uint64)
    raw = np.concatenate([symbols, np.zeros(per, dtype=symbols.dtype)]).astype(np.uint64)
    for j in range(per):
        words[:n] = (words[:n] << np.uint64(bits)) | raw[j : n + j]
    out = np.zeros(n + 1, dtype=np.int32)
    size = np.maximum(size - least + 1, 0)
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")  # pieces longer than each step
    h = np.zeros(len(first), dtype=np.int64)
    for step in range(len(live)):
        m = live[step]
        i = first[:m] + step
        r = rank[i]
        j = sa[np.maximum(r - 1, 0)]
        most = np.minimum(ends[i] - i, ends[j] - j)
        most[r == 0] = 0
        now = np.minimum(np.maximum(h[:m] - 1, 0), most)
        go = np.flatnonzero(now < most)
        wide = 1
        while len(go):  # the next word first; what still agrees, WIDE words at a time
            ahead = now[go][:, None] + per * np.arange(wide)
            x = words[np.minimum(i[go][:, None] + ahead, n)] ^ words[np.minimum(j[go][:, None] + ahead, n)]
            unlike = x != 0
            k = np.where(unlike.any(1), unlike.argmax(1), wide)
            x = x[np.arange(len(go)), np.minimum(k, wide - 1)]
            top = np.frexp(x.astype(np.float64))[1]  # bits up to the highest that differs
            same = np.where(k == wide, 0, np.maximum(64 - top, 0) // bits)
            same = np.where((k < wide) & (same < per) & ((x >> (np.uint64(64 - bits) - np.uint64(bits) * np.minimum(same, per - 1).astype(np.uint64))) == 0), same + 1, same)
            now[go] = np.minimum(now[go] + per * k + same, most[go])
            go = go[(k == wide) & (now[go] < most[go])]
            wide = WIDE
        out[r] = now
        h[:m] = now
    return out


def repeated_starts(pieces: list[bytes], length: int, kind: type = np.uint8) -> tuple[np.ndarray, np.ndarray]:
    """Which starts in the concatenated pieces (symbols of that kind) are repeated, and the pieces' offsets."""
    size = np.array([*map(len, pieces)], dtype=np.int64) // np.dtype(kind).itemsize
    first = np.cumsum(size) - size
    symbols = np.frombuffer(b"".join(pieces), dtype=kind)
    if kind is not np.uint8:
        symbols = np.unique(symbols, return_inverse=True)[1].astype(np.uint32)
    sa, rank = suffix_array(symbols, np.repeat(first + size, size))
    long = common_prefixes(symbols, first, size, sa, rank, length) >= length
    hit = np.zeros(len(symbols), dtype=bool)
    hit[sa] = long[:-1] | long[1:]
    return hit, first


def spans(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The ranges that strings at sorted starts cover, joined where they overlap or touch."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + length).tolist(), strict=True))


def text_key(text: Column) -> Column:
    """The identity of a text: 128 bits, so that different texts of any corpus never count as copies."""
    return F.unhex(F.md5(text))


class Unit(NamedTuple):
    """What strings are made of: `length` symbols each, anchors of `gram` and `cut_gram` symbols."""

    length: int
    gram: int
    cut_gram: int
    symbols: Callable[[str], np.ndarray]
    kind: type

    @property
    def width(self) -> int:
        return np.dtype(self.kind).itemsize


def units(length: int | None, words: int | None) -> list[Unit]:
    """The units of strings of `length` bytes and of `words` words, as far as they are given."""
    out = [Unit(length, GRAM, CUT_GRAM, as_bytes, np.uint8)] if length else []
    out += [Unit(words, WORD_GRAM, WORD_CUT_GRAM, as_words, np.uint64)] if words else []
    for u in out:
        if u.length < u.gram + u.cut_gram or u.length > 2000:
            raise ValueError(f"length must be from {u.gram + u.cut_gram} to 2000")
    return out


def _runs(hits: pa.ListArray) -> list[list[tuple[int, int, int, int]]]:
    """For each row's hits (by, s, n, salts), in order: (by, begin, end, salts) of those that adjoin and have equal salts, as one."""
    lo, hi = hits.offsets[0].as_py(), hits.offsets[-1].as_py()
    values = hits.values.slice(lo, hi - lo)
    by, s, n, salts = (values.field(c).to_numpy() for c in ("by", "s", "n", "salts"))
    row = np.repeat(np.arange(len(hits)), np.diff(hits.offsets.to_numpy()))
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in range(len(hits))]
    if len(s):
        opens = np.flatnonzero(np.r_[True, (s[1:] != s[:-1] + n[:-1]) | (salts[1:] != salts[:-1]) | (row[1:] != row[:-1]) | (by[1:] != by[:-1])])
        closes = np.append(opens[1:], len(s)) - 1
        for k, *run in zip(row[opens].tolist(), by[opens].tolist(), s[opens].tolist(), (s[closes] + n[closes]).tolist(), salts[opens].tolist(), strict=True):
            out[k].append(tuple(run))
    return out


def find(docs: DataFrame, length: int | None = LENGTH, shard: int = SHARD, often: int = OFTEN, words: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(classes, marks): classes (tk, copies, rep) of equal texts, and marks (tk, spans) of the ranges to remove.

    Strings are of `length` bytes and of `words` words; either may be None.  A span (by, a, b) is in bytes where by is
    the place of bytes in units(), else in words.  tk is a 128-bit digest of the text.  One text of each class is
    searched; what is repeated by copies is repeated anyway, so a class of several texts that are long enough for a
    string needs no marks: all of it goes.
    """
    kinds = units(length, words)
    least = min(2 * u.length - 1 if u.symbols is as_words else u.length for u in kinds)
    texts = common.texts_of(docs).where(F.octet_length("text") >= least).select("doc_id", text_key(F.col("text")).alias("tk"), "text")

    def filter_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, unit, s, n, h = [], [], [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                for j, u in enumerate(kinds):
                    a = u.symbols(text)
                    for x, y in blocks(len(a), u.length):
                        first, count, hashes = anchors(a[x:y], u.length, u.gram)
                        row.append(np.full(len(first), k, dtype=np.int32))
                        unit.append(np.full(len(first), j, dtype=np.int32))
                        s.append(first + x)
                        n.append(count)
                        h.append((hashes ^ np.uint64(j)).view(np.int64))
            if row:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(row))), *(pa.array(np.concatenate(c)) for c in (unit, s, n, h))], names=["tk", "by", "s", "n", "h"])

    # Tables of their own: texts are hashed once, and the join deals both of its sides out and can split an anchor that is everywhere.
    found = common.materialize(common.map_arrow(texts.select("tk", "text"), filter_anchors, "tk binary, by int, s long, n long, h long"), "starts")
    counts = common.materialize(found.groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h", (1 + F.floor(F.col("times") / often)).cast("int").alias("salts")), "anchors")
    hits = common.materialize(found.join(counts, "h").groupBy("tk", "by", "s").agg(F.first("n").alias("n"), F.first("salts").alias("salts")), "hits")
    common.drop(found, counts)
    classes = common.materialize(texts.groupBy("tk").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep")), "classes")
    ranges = hits.groupBy("tk").agg(F.array_sort(F.collect_list(F.struct("by", "s", "n", "salts"))).alias("hits")).join(classes.select("tk", "rep"), "tk")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 100):
                b = whole.slice(lo, 100)
                row, unit, starts, hashed, subs, pieces = [], [], [], [], [], []
                for k, (text, own) in enumerate(zip(b.column(1).to_pylist(), _runs(b.column(2)), strict=True)):
                    read = None
                    for j, begin, end, salts in own:
                        u = kinds[j]
                        if read != j:
                            a = u.symbols(text)
                            raw, read = a.tobytes(), j
                            seed = np.uint64(zlib.crc32(raw) << 32)
                        for p in range(begin, end, BLOCK):
                            first, count, hashes = anchors(a[p : min(end, p + BLOCK) + u.length - 1], u.length, u.cut_gram)
                            first = first + p
                            row.append(np.full(len(first), k, dtype=np.int32))
                            unit.append(np.full(len(first), j, dtype=np.int32))
                            starts.append(first)
                            hashed.append((hashes ^ np.uint64(j)).view(np.int64))
                            subs.append((mix(first.astype(np.uint64) + seed) % np.uint64(salts)).astype(np.int32) if salts > 1 else np.full(len(first), -1, dtype=np.int32))
                            pieces += [raw[f:g] for f, g in zip((first * u.width).tolist(), ((first + count + (u.length - 1)) * u.width).tolist(), strict=True)]
                if row:
                    row, *columns = (np.concatenate(c) for c in (row, unit, hashed, subs, starts))
                    by, h, sub, s = map(pa.array, columns)
                    yield pa.RecordBatch.from_arrays([h, sub, by, b.column(0).take(pa.array(row)), s, pa.array(pieces, type=pa.binary())], names=["h", "sub", "by", "tk", "s", "piece"])

    held = texts.join(ranges, "tk").where(F.col("doc_id").eqNullSafe(F.col("rep"))).select("tk", "text", "hits")
    pieces = common.map_arrow(held, cut, "h long, sub int, by int, tk binary, s long, piece binary")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Marks()
        waiting: list[list[tuple[bytes, list[tuple[bytes, int]]]]] = [[] for _ in kinds]
        size = [0] * len(kinds)

        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        for (_, sub, by), own in groupby(rows(), key=lambda x: x[:3]):
            members: dict[bytes, list[tuple[bytes, int]]] = {}
            for x in own:
                members.setdefault(x[5], []).append(x[3:5])
            u = kinds[by]
            # Equal strings lie equally far before their anchor, so one piece never holds a string twice.
            for piece, at in members.items():
                if len(at) > 1:
                    n = len(piece) // u.width
                    for tk, s in at:
                        out.add(tk, by, s, s + n)
                if sub >= 0:
                    out.add_strings(*at[0], by, piece, u, len(at) > 1)
            if len(members) > 1:
                waiting[by] += members.items()
                size[by] += sum(map(len, members)) // u.width
            if size[by] >= shard:
                shared(waiting[by], by, out)
                waiting[by], size[by] = [], 0
            yield from out.full()
        for by, pieces in enumerate(waiting):
            if pieces:
                shared(pieces, by, out)
        yield from out.full(last=True)

    def shared(pieces: list[tuple[bytes, list[tuple[bytes, int]]]], by: int, out: _Marks) -> None:
        """What pieces of other bytes share with each other, by their suffix array."""
        u = kinds[by]
        hit, first = repeated_starts([x[0] for x in pieces], u.length, u.kind)
        for (piece, at), f in zip(pieces, first.tolist(), strict=True):
            if len(at) == 1 and (found := np.flatnonzero(hit[f : f + len(piece) // u.width])).size:
                for a, b in spans(found + at[0][1], u.length):
                    out.add(at[0][0], by, a, b)

    marked = common.materialize(common.map_arrow(pieces.repartition("h", "sub").sortWithinPartitions("h", "sub", "by", "tk", "s"), search, "tk binary, by int, a long, b long, digest binary"), "marked")
    common.drop(hits)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Strings of other shards, found by binary search in the sorted digests of all."""
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows)
        d0, d1 = np.frombuffer(b"".join(t.column("digest").to_pylist()), dtype=np.int64).reshape(-1, 2).T
        order = np.lexsort((d1, d0))
        sorted0, sorted1 = d0[order], d1[order]
        group = np.cumsum(np.r_[False, (sorted0[1:] != sorted0[:-1]) | (sorted1[1:] != sorted1[:-1])])
        own = np.empty(len(order), dtype=np.int64)
        own[order] = group
        times = np.searchsorted(group, own, side="right") - np.searchsorted(group, own, side="left")
        b = t.column("b").to_numpy()
        take = pa.array(np.flatnonzero((times > 1) & (b >= 0)))
        yield from t.select(["tk", "by", "a", "b"]).take(take).to_batches()

    across = common.map_arrow(marked.where("digest is not null").repartition("digest"), merge, "tk binary, by int, a long, b long")
    every = marked.where("digest is null").select("tk", "by", "a", "b").unionByName(across)
    marks = common.materialize(every.groupBy("tk").agg(F.array_sort(F.collect_list(F.struct("by", "a", "b"))).alias("spans")), "marks")
    common.drop(marked)
    return classes, marks


class _Marks:
    """Rows (tk, by, a, b, digest) of marked ranges, and of single strings to be merged across shards, in large batches."""

    ROWS = 20_000

    def __init__(self):
        self.rows: tuple[list, ...] = ([], [], [], [], [])

    def add(self, tk: bytes, by: int, a: int, b: int, digest: bytes | None = None) -> None:
        for c, v in zip(self.rows, (tk, by, a, b, digest), strict=True):
            c.append(v)

    def add_strings(self, tk: bytes, s: int, by: int, piece: bytes, u: Unit, known: bool) -> None:
        """Each string of a piece of an anchor that has several shards, by a 128-bit digest; b is -1 if it is marked already."""
        for k in range(len(piece) // u.width - u.length + 1):
            self.add(tk, by, s + k, -1 if known else s + k + u.length, hashlib.blake2b(piece[k * u.width : (k + u.length) * u.width], digest_size=16).digest())

    def full(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if len(self.rows[0]) >= self.ROWS or last:
            kinds = (pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(self.rows, kinds, strict=True)], names=["tk", "by", "a", "b", "digest"])
            self.rows = ([], [], [], [], [])


def _joined(own: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(own):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cuts(raw: bytes, copies: int | None, own: list[dict] | None, kinds: list[Unit]) -> list[list[tuple[int, int]]]:
    """For each unit the byte ranges of a text that go; those of words take the white space behind them along."""
    out = []
    bounds = None
    for j, u in enumerate(kinds):
        mine = [(x["a"], x["b"]) for x in own or () if x["by"] == j]
        many = (copies or 0) > 1
        if u.symbols is as_words and (mine or many):
            if bounds is None:
                bounds = np.append(word_bounds(np.frombuffer(raw, dtype=np.uint8))[0], len(raw)).tolist()
            many = many and len(bounds) > u.length
            mine = [(bounds[a], bounds[b]) for a, b in mine]
        else:
            many = many and len(raw) >= u.length
        out.append([(0, len(raw))] if many else _joined(mine))
    return out


def _left(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for x, y in gone:
        kept.append(raw[at:x])
        at = y
    return b"".join([*kept, raw[at:]])


def _with_marks(docs: DataFrame, classes: DataFrame, marks: DataFrame) -> DataFrame:
    """docs with __copies and __spans of their texts; both null where nothing goes."""
    known = classes.join(marks, "tk", "left").where("copies > 1 or spans is not null").select(F.col("tk").alias("__tk"), F.col("copies").alias("__copies"), F.col("spans").alias("__spans"))
    return docs.withColumn("__tk", text_key(F.col("text").cast("string"))).join(known, "__tk", "left").drop("__tk")


def digests(docs: DataFrame, length: int = LENGTH, words: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs, and text: what is left of it.

    The digests are of what strings of `length` bytes leave.  With `words`, text lacks repeats of so many words too
    (see remove()).  A null text is empty in the digests and stays null; texts under `length` bytes and words keep
    everything; repeated rows and rows without doc_id are documents like others, so a repeated row of that length is
    removed.  An empty table gives no rows.
    """
    kinds = units(length, words)
    classes, marks = find(docs, length, words=words)
    common.free_shuffles(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 100):
                b = whole.slice(lo, 100)
                rows = []
                for text, copies, own in zip(*(b.column(c).to_pylist() for c in ("text", "__copies", "__spans")), strict=True):
                    raw = (text or "").encode()
                    gone = cuts(raw, copies, own, kinds)
                    kept = _left(raw, gone[0])
                    rest = _left(raw, _joined([x for g in gone for x in g])).decode("utf-8", "ignore") if any(gone) else text
                    rows.append((len(raw), len(raw) - len(kept), len(gone[0]), hashlib.sha256(kept).hexdigest(), rest))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, type=pa.int64()) for c in cols[:3]), *(pa.array(c, type=pa.string()) for c in cols[3:])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    return common.map_arrow(_with_marks(common.texts_of(docs), classes, marks), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def remove(docs: DataFrame, length: int = LENGTH, words: int | None = None) -> DataFrame:
    """docs with what is left of each text, all other columns as they are; n_chars, if there is one, follows the text.

    With `words`, what a string of so many words covers that stands elsewhere too is removed as well, with the white
    space behind it.  Where a cut parts the bytes of a character, its rest is dropped.  A text all of which goes is
    empty, a null text stays null; odd rows are treated as in digests().
    """
    names, kinds = docs.columns, units(length, words)
    classes, marks = find(docs, length, words=words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, copies, own in zip(*(b.column(c).to_pylist() for c in ("text", "__copies", "__spans")), strict=True):
                if copies or own:
                    raw = text.encode()
                    gone = _joined([x for g in cuts(raw, copies, own, kinds) for x in g])
                    text = _left(raw, gone).decode("utf-8", "ignore") if gone else text
                texts.append(text)
            cols = {n: b.column(n) for n in names}
            cols["text"] = pa.array(texts, type=pa.string())
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([len(t) if t is not None else n for t, n in zip(texts, b.column("n_chars").to_pylist(), strict=True)], type=b.column("n_chars").type)
            yield pa.RecordBatch.from_arrays([*cols.values()], names=names)

    return common.map_arrow(_with_marks(docs, classes, marks), run, docs.schema)
