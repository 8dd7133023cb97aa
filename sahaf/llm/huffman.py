"""Token ids on disk: canonical length-limited Huffman codes from global counts.

A store is a folder of two Parquet datasets that Spark commits: `codebook` has the code length of every id (canonical
codes follow from the lengths), `blocks` has a row per document in ascending doc_id order, as runs (shards) of ranges
of doc_id, each in one file.  A block stands alone: its
codes begin at a byte, and every CHECKPOINT ids the bit offset is kept, so that all stretches of a batch of blocks are
decoded side by side with one table lookup per id and step.
"""

from __future__ import annotations

import heapq
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from . import tokens as bpe
from .tokens import default_tokenizer

MAX_BITS = 20
CHECKPOINT = 256
END_ID = 0
#: Ids of a range of doc_id that is written as one run of blocks, and ranges at most: beyond it they grow.
RANGE_TOKENS, MOST_RANGES = 4_000_000, 10_000
#: Documents that are encoded side by side, and accuracy of the quantiles that bound the ranges.
SIDE_BY_SIDE, ACCURACY = 100, 100_000
BLOCK_FIELDS = "shard int, seq long, doc_id long, start_in_shard long, n_tokens long, payload binary, checkpoints binary"


def code_lengths(counts: dict[int, int], max_bits: int = MAX_BITS) -> dict[int, int]:
    """Optimal code lengths of at most max_bits, by merging packages of the cheapest leaves and packages."""
    leaves = sorted((c, s) for s, c in counts.items() if c > 0)
    if len(leaves) < 2:
        return {s: 1 for _, s in leaves}
    if len(leaves) > 1 << max_bits:
        raise ValueError("more symbols than codes of that length")
    weights = np.array([c for c, _ in leaves], dtype=np.int64)
    rounds, merged = [], weights
    for _ in range(max_bits):
        rounds.append(merged)
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.array(list(heapq.merge(weights.tolist(), packages.tolist())), dtype=np.int64)
    # Walk back: of each round's list the first `take` items are used; equal weights count as leaves first.
    lengths, take = np.zeros(len(leaves), dtype=np.int64), 2 * (len(leaves) - 1)
    for k in range(max_bits - 1, -1, -1):
        used = rounds[k][:take]
        if k == 0:
            n = take
        else:
            prior = rounds[k - 1]
            packages = prior[: len(prior) // 2 * 2].reshape(-1, 2).sum(1)
            order = np.argsort(np.concatenate([weights, packages]), kind="stable")[: len(used)]
            n = int((order < len(weights)).sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    return {s: int(b) for (_, s), b in zip(leaves, lengths, strict=True)}


def canonical(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and their bits by id."""
    size = max(lengths, default=0) + 1
    codes, bits = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    code = last = 0
    for n, s in sorted((n, s) for s, n in lengths.items()):
        code <<= n - last
        codes[s], bits[s], last = code, n, n
        code += 1
    return codes, bits


def decode_table(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, int]:
    """For each run of `width` bits the id it begins with and that id's bits."""
    width = max(lengths.values(), default=1)
    ids, bits = np.zeros(1 << width, dtype=np.uint32), np.ones(1 << width, dtype=np.int64)
    codes, n = canonical(lengths)
    for s in lengths:
        a = int(codes[s]) << (width - int(n[s]))
        ids[a : a + (1 << (width - int(n[s])))], bits[a : a + (1 << (width - int(n[s])))] = s, n[s]
    return ids, bits, width


def encode_blocks(ids: list[np.ndarray], codes: np.ndarray, bits: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """For each array of ids its payload, and its checkpoints: bit offsets as little-endian 64-bit integers."""
    n = np.array([*map(len, ids)], dtype=np.int64)
    flat = np.concatenate(ids) if len(ids) else np.empty(0, dtype=np.int64)
    if not len(flat):
        return [b""] * len(ids), [b""] * len(ids)
    width = bits[flat]
    ends = np.concatenate([[0], np.cumsum(width)])
    first = np.concatenate([[0], np.cumsum(n)])
    size = (ends[first[1:]] - ends[first[:-1]] + 7) // 8
    base = np.concatenate([[0], np.cumsum(size)])
    at = ends[:-1] + np.repeat(8 * base[:-1] - ends[first[:-1]], n)
    word = codes[flat] << (32 - width - (at & 7))
    out = np.zeros(base[-1] + 4, dtype=np.float64)
    byte = at >> 3
    for k in range(4):  # codes don't overlap, so adding bytes joins them
        out += np.bincount(byte + k, weights=(word >> (24 - 8 * k) & 255).astype(np.float64), minlength=len(out))[: len(out)]
    raw = out.astype(np.uint8).tobytes()
    local = at - np.repeat(8 * base[:-1], n)
    return [raw[a:b] for a, b in zip(base[:-1], base[1:], strict=True)], [local[a:b:CHECKPOINT].astype("<i8").tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]


def decode_blocks(payloads: list[bytes], checkpoints: list[bytes], n_tokens: np.ndarray, table: tuple[np.ndarray, np.ndarray, int]) -> list[np.ndarray]:
    ids, bits, width = table
    size = np.array([*map(len, payloads)], dtype=np.int64)
    base = np.concatenate([[0], np.cumsum(size)])[:-1]
    raw = np.frombuffer(b"".join(payloads) + b"\0" * 8, dtype=np.uint8).astype(np.int64)
    lanes = np.array([len(c) // 8 for c in checkpoints], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(n_tokens)]).astype(np.int64)
    out = np.empty(first[-1], dtype=np.uint32)
    if not len(out):
        return [out for _ in payloads]
    at = np.frombuffer(b"".join(checkpoints), dtype="<i8") + np.repeat(8 * base, lanes)
    k = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    put = np.repeat(first[:-1], lanes) + k * CHECKPOINT
    left = np.minimum(CHECKPOINT, np.repeat(np.asarray(n_tokens, dtype=np.int64), lanes) - k * CHECKPOINT)
    order = np.argsort(-left, kind="stable")
    at, put, left = at[order].copy(), put[order], left[order]
    live = np.searchsorted(-left, -np.arange(1, CHECKPOINT + 1), side="right")  # lanes with more than that many ids
    for step in range(int(left[0])):
        m = live[step]
        p = at[:m]
        byte = p >> 3
        word = raw[byte] << 24 | raw[byte + 1] << 16 | raw[byte + 2] << 8 | raw[byte + 3]
        w = word >> (32 - width - (p & 7)) & ((1 << width) - 1)
        out[put[:m] + step] = ids[w]
        at[:m] += bits[w]
    return [out[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int | None = END_ID, max_bits: int = MAX_BITS) -> None:
    """Tokenize every whole text once, count ids, and write the store.

    Null and empty texts have only the end id.  Rows without doc_id come first; repeated rows are blocks of their own,
    in an order that their texts' places in the input fix; a doc_id with so many rows that it fills several ranges is
    dealt to them in that order.  An empty table makes a store without blocks.
    """
    file = tokenizer or default_tokenizer()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tag = bpe.encoder(file), TaskContext.get().partitionId() << 33
        kind = "<u2" if encoder.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        for b in batches:
            ids = encoder.encode(b.column(1).to_pylist())
            if end_id is not None:
                ids = [np.append(x, np.uint32(end_id)) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(range(tag, tag + len(ids)), type=pa.int64()), pa.array([np.dtype(kind).itemsize] * len(ids), type=pa.int32()), common.binary_column([x.astype(kind).tobytes() for x in ids])], names=["doc_id", "tag", "wide", "ids"])
            tag += len(ids)

    def ids_in(b: pa.RecordBatch) -> list[np.ndarray]:
        return [np.frombuffer(x, dtype=f"<u{w}").astype(np.int64) for x, w in zip(b.column("ids").to_pylist(), b.column("wide").to_pylist(), strict=True)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for b in batches:
            if b.num_rows:
                new = np.bincount(np.concatenate(ids_in(b)))
                total = np.pad(total, (0, max(0, len(new) - len(total))))
                total[: len(new)] += new
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["id", "n"])

    spark = docs.sparkSession
    tokens = common.materialize(common.map_arrow(common.texts_of(docs), tokenize, "doc_id long, tag long, wide int, ids binary"), "token-ids")
    counts = {r["id"]: r["n"] for r in common.map_arrow(tokens.select("wide", "ids"), count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}  # at most a row per id of the vocabulary
    lengths = code_lengths(counts, max_bits)
    codes, bits = canonical(lengths)
    ranges = min(1 + sum(counts.values()) // RANGE_TOKENS, MOST_RANGES)
    cut = tokens.agg(F.max(F.shiftright("tag", 33)).alias("parts"), F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)] or [0.5], ACCURACY).alias("at")).first()  # at most MOST_RANGES numbers
    bounds, parts = np.array(cut["at"] or [] if ranges > 1 else [], dtype=np.int64), (cut["parts"] or 0) + 1

    def shards(doc_ids: list[int | None], tags: np.ndarray) -> np.ndarray:
        """The range of each row; a doc_id that is the bound of several ranges is dealt to them by place in the input."""
        x = np.array([-(2**63) if d is None else d for d in doc_ids], dtype=np.int64)
        first, last = np.searchsorted(bounds, x), np.searchsorted(bounds, x, side="right")
        known = np.array([d is not None for d in doc_ids], dtype=bool)
        return np.where(known, first + np.where(last > first, (tags >> 33) * (last - first) // parts, 0), 0)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, SIDE_BY_SIDE):
                b = whole.slice(a, SIDE_BY_SIDE)
                ids = ids_in(b)
                payloads, checkpoints = encode_blocks(ids, codes, bits)
                shard = shards(b.column("doc_id").to_pylist(), b.column("tag").to_numpy()).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(shard), b.column("doc_id"), b.column("tag"), pa.array([*map(len, ids)], type=pa.int64()), common.binary_column(payloads), common.binary_column(checkpoints)], names=["shard", "doc_id", "tag", "n_tokens", "payload", "checkpoints"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seq, start = None, 0, 0
        for b in batches:
            seqs, starts = [], []
            for s, n in zip(b.column("shard").to_pylist(), b.column("n_tokens").to_pylist(), strict=True):
                if s != shard:
                    shard, seq, start = s, 0, 0
                seqs.append(seq)
                starts.append(start)
                seq, start = seq + 1, start + n
            yield pa.RecordBatch.from_arrays([b.column("shard"), pa.array(seqs, type=pa.int64()), b.column("doc_id"), pa.array(starts, type=pa.int64()), b.column("n_tokens"), b.column("payload"), b.column("checkpoints")], names=["shard", "seq", "doc_id", "start_in_shard", "n_tokens", "payload", "checkpoints"])

    blocks = common.map_arrow(tokens, encode, "shard int, doc_id long, tag long, n_tokens long, payload binary, checkpoints binary").repartition("shard").sortWithinPartitions("shard", "doc_id", "tag")
    common.map_arrow(blocks, number, BLOCK_FIELDS).write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(int(s), int(n)) for s, n in lengths.items()], "id int, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    common.drop(tokens)


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and the ids of each block, or with digest their crc32 as unsigned 32-bit integers."""
    lengths = {r["id"]: r["bits"] for r in spark.read.schema("id int, bits int").parquet(f"{path}/codebook").collect()}  # a row per id of the vocabulary
    blocks = spark.read.schema(BLOCK_FIELDS).parquet(f"{path}/blocks")
    sums = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # a row per range, at most MOST_RANGES
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    placed = blocks.join(F.broadcast(sums.select("shard", F.coalesce(before, F.lit(0)).alias("base"))), "shard")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = decode_table(lengths)
        for b in batches:
            n = b.column("n_tokens").to_numpy()
            ids = decode_blocks(b.column("payload").to_pylist(), b.column("checkpoints").to_pylist(), n, look)
            last = pa.array([zlib.crc32(x) for x in ids], type=pa.int64()) if digest else pa.array([x.astype(np.int32) for x in ids], type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), last], names=["doc_id", "start", "n_tokens", "last"])

    kind = "long" if digest else "array<int>"
    started = placed.select("doc_id", (F.col("start_in_shard") + F.col("base")).alias("start"), "n_tokens", "payload", "checkpoints")
    return common.map_arrow(started, decode, f"doc_id long, start long, n_tokens long, last {kind}").withColumnRenamed("last", "ids_crc32" if digest else "ids")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write a store in the shared folder and read it back as digests."""
    path = f"{common.shared_folder(docs.sparkSession)}/store-{uuid.uuid4().hex}"
    write(docs, path, tokenizer)
    return read(docs.sparkSession, path, digest=True)
