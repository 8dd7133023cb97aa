"""Best-fit packing by minimum bin slack.

Documents become pieces of at most `capacity` ids.  How many pieces have each length is all that packing needs, and
that histogram has at most `capacity` rows whatever the size of the corpus, so the driver plans on it: for each bin it
fixes the longest piece left and finds, by subset-sum dynamic programming on bitsets, the fullest combination of the
lengths left, and removes it.  The same combination is taken as often as the counts allow.  Ranks of the pieces within
their length, counted over salted groups of bounded size, then map every piece to its place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens
from .tokens import default_tokenizer

CAPACITY = 1024
END_ID = 2
#: Pieces of one length that are ranked together.
RANK_GROUP = 200_000
#: Plans that are tried, as (reserve, slack): lengths under `reserve` are kept back from bins that the others fill to
#: within `slack`.  The plan with the fewest bins is taken.
PLANS = ((0, 0), (64, 2), (128, 4), (200, 8), (300, 8), (300, 16), (400, 16))


def cut(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, tag (unique), and ids if with_ids.

    A null or empty text has only its end id.  Only documents of over `capacity` ids are cut; their first piece takes
    what is over a multiple of `capacity`.  Repeated rows and rows without doc_id are documents of their own.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tag = tokens.encoder(path), TaskContext.get().partitionId() << 33
        for b in batches:
            cols: list[list] = [[], [], [], [], [], [], []]
            for doc, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist()), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                at, k = 0, 0
                while at < len(ids):
                    n = len(ids) % capacity or capacity if at == 0 else capacity
                    raw = ids[at : at + n].tobytes()
                    for c, v in zip(cols, (doc, k, at, n, zlib.crc32(raw), tag, raw), strict=True):
                        c.append(v)
                    at, k, tag = at + n, k + 1, tag + 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, type=t) for c, t in zip(cols, kinds, strict=False)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "tag"]
            if with_ids:
                n = np.concatenate([[0], np.cumsum(cols[3])]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(n), pa.array(np.frombuffer(b"".join(cols[6]), dtype="<u4").astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return common.map_arrow(common.texts_of(docs), run, "doc_id long, piece int, start long, length long, ids_crc32 long, tag long" + ", ids array<int>" * with_ids)


def minimum_bin_slack(counts: dict[int, int], capacity: int, reserve: int = 0, slack: int = 0) -> list[tuple[int, dict[int, int]]]:
    """Bins for counts[length] pieces of each length: how often, and how many of each length are in it."""
    left = {n: c for n, c in sorted(counts.items()) if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must be from 1 to the capacity")
    bins = []
    while left:
        longest = max(left)
        room = capacity - longest
        for least in (reserve, 0) if reserve else (0,):
            mask, reach, layers = (1 << (room + 1)) - 1, 1, []
            for n, c in left.items():
                if n > room:
                    break
                c = min(c - (n == longest), room // n) if n >= least else 0
                if c <= 0:
                    continue
                layers.append((n, c, reach))
                step = 1
                while c > 0:
                    take = min(step, c)
                    reach |= reach << (take * n) & mask
                    c, step = c - take, 2 * step
            total, taken = reach.bit_length() - 1, {longest: 1}
            if room - total <= slack:
                break
        for n, c, before in reversed(layers):  # the longest lengths first, as many as can be
            for m in range(min(c, total // n), -1, -1):
                if before >> (total - m * n) & 1:
                    break
            if m:
                taken[n] = taken.get(n, 0) + m
                total -= m * n
        times = min(left[n] // m for n, m in taken.items())
        bins.append((times, taken))
        for n, m in taken.items():
            left[n] -= times * m
            if not left[n]:
                del left[n]
    return bins


def fewest_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """The plan of PLANS with the fewest bins; one that reaches the bound of all lengths' sum ends the search."""
    bound, best = -(-sum(n * c for n, c in counts.items()) // capacity), None
    for reserve, slack in PLANS:
        bins = minimum_bin_slack(counts, capacity, reserve, slack)
        size = sum(times for times, _ in bins)
        if best is None or size < best[0]:
            best = size, bins
        if size == bound:
            break
    return best[1]


def places(bins: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """By length, rows (first rank, first sequence, offset) in order of rank: rank r has sequence first + r - first rank."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, taken in bins:
        offset = 0
        for n in sorted(taken, reverse=True):
            for _ in range(taken[n]):
                out.setdefault(n, []).append((used.get(n, 0), sequence, offset))
                used[n] = used.get(n, 0) + times
                offset += n
        sequence += times
    return {n: np.array(v, dtype=np.int64) for n, v in out.items()}


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """cut()'s pieces with sequence_id and offset: the place of each in its sequence, gapless from 0."""
    spark = docs.sparkSession
    pieces = common.materialize(cut(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    at = places(fewest_bins({n: c for n, c in counts.items() if n < capacity}, capacity))
    groups = spark.createDataFrame([(int(n), 1 + c // RANK_GROUP) for n, c in counts.items()] or [(0, 1)], "length long, salts long")
    salted = pieces.join(F.broadcast(groups), "length").withColumn("salt", F.pmod(F.xxhash64("tag"), "salts"))
    sizes = salted.groupBy("length", "salt").count()
    before = sizes.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("tag")) - 1).join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rank, tag = (b.column(c).to_numpy() for c in ("length", "rank", "tag"))
            sequence, offset = -1 - tag, np.zeros(len(n), dtype=np.int64)  # a full piece is a sequence of its own
            for x in np.unique(n):
                if x in at:
                    own, t = n == x, at[x]
                    k = np.searchsorted(t[:, 0], rank[own], side="right") - 1
                    sequence[own], offset[own] = t[k, 1] + rank[own] - t[k, 0], t[k, 2]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    return common.map_arrow(ranked.select(*columns, "rank", "tag"), place, "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids array<int>, " * with_ids + "sequence_id long, offset long")


def sequences(docs: DataFrame, **options) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, doc_ids; a row has at most `capacity` ids."""
    packed = pack(docs, with_ids=True, **options).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    return packed.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
