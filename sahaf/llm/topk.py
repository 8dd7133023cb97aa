"""Exact top-k search by inner product in three phases under a uniform threshold.

The components are dealt to `lists` ranges; a candidate's score is the sum of its partial scores in the ranges.
Phase 1 gathers each range's list of the best partial scores, and the exact scores of the candidates on those lists
only; they give for each query a cutoff that at least k candidates reach.  Phase 2 sends the cutoffs out and collects
from every list the entries of at least cutoff / lists: a candidate without one has a lower sum than the cutoff.
Phase 3 resolves the scores of the collected candidates exactly, and keeps the best k.

Lists depend on the query, so they are never stored: phase 2 makes a range's partial scores again.  The work is that of
all queries on all candidates, twice; exact scores are made for collected candidates only.  Queries come in blocks, and
each block's result is written, so that a plan never grows with the number of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

LISTS = 4
#: Queries that are broadcast at once; partial scores, and pairs to resolve, that are held at once.
QUERY_BLOCK, CELLS, PAIRS = 4096, 1 << 20, 50_000


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part: an id, and only finite components."""
    e = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where(good.eqNullSafe(True))


def quantised(column: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each dimension that occurs: the rows that have it, and their vectors as floor(scale * x)."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    size = np.diff(ends)
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        x = flat[(ends[:-1][rows][:, None] + np.arange(d)[None, :])].reshape(len(rows), d)
        yield rows, np.floor(scale * x)


def partial_scores(c: np.ndarray, q: np.ndarray, lists: int) -> list[np.ndarray]:
    """Exact integer partial inner products of candidates and queries, by range of components."""
    if c.size and q.size and np.abs(c).max() * np.abs(q).max() * c.shape[1] >= 2**53:
        whole = np.vectorize(int, otypes=[object])  # products beyond doubles: integers of any size
        c, q = whole(c), whole(q)
    return [c[:, r] @ q[:, r].T for r in np.array_split(np.arange(c.shape[1]), lists)]


def exact_scores(c: np.ndarray, q: np.ndarray, r: np.ndarray, col: np.ndarray) -> np.ndarray:
    """The whole inner products of candidates c[r] and queries q[col], a few pairs at a time."""
    big = c.size and q.size and np.abs(c).max() * np.abs(q).max() * c.shape[1] >= 2**53
    if big:
        whole = np.vectorize(int, otypes=[object])
        c, q = whole(c), whole(q)
    parts = [(c[r[a : a + PAIRS]] * q[col[a : a + PAIRS]]).sum(1) for a in range(0, len(r), PAIRS)]
    return np.concatenate(parts) if parts else np.empty(0)


def _best(keep: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of columns (group, id, score, ...) the k rows with the highest score of each group, ties to smaller ids."""
    order = np.lexsort((keep[1], -keep[2], keep[0]))
    keep = [x[order] for x in keep]
    group = keep[0]
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, dtype=int)
    rank = np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group))))
    return [x[rank < k] for x in keep]


def _long(x: np.ndarray) -> np.ndarray:
    top = 2**63 - 1
    return np.array([min(max(int(v), -top - 1), top) for v in x], dtype=np.int64) if x.dtype == object else x.astype(np.int64)


def search(candidates: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, lists: int = LISTS) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k highest scores, ties to smaller vec_id.

    Components become floor(scale * x).  Rows with the query's own vec_id are no candidates of it; repeated rows of
    other ids each count.  Vectors that are null, hold nulls or non-finite components, or have no vec_id take no part;
    vectors of another dimension than the query's are no candidates.  Scores beyond a long saturate.
    """
    spark = candidates.sparkSession
    candidates, queries = usable(candidates), usable(queries).distinct()
    total = queries.count()
    blocks = -(-total // QUERY_BLOCK)
    written = []
    for k_block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)) == k_block).toArrow().combine_chunks()
        if not own.num_rows:
            continue
        ids = own.column("vec_id").to_numpy()
        vectors = spark.sparkContext.broadcast([(rows, q) for rows, q in quantised(own.column("embedding").chunk(0), scale)])

        def chunks(b: pa.RecordBatch, vectors=vectors, ids=ids):
            """Candidates' ids and vectors, their queries' places and vectors, and which pairs are a query's own rows."""
            vec = b.column(0).to_numpy()
            for rows, c in quantised(b.column(1), scale):
                for at, q in vectors.value:
                    if q.shape[1] == c.shape[1]:
                        step = max(1, CELLS // max(len(at), 1))
                        for a in range(0, len(rows), step):
                            cand = vec[rows[a : a + step]]
                            yield cand, c[a : a + step], at, q, cand[:, None] == ids[at][None, :]

        def gather(batches: Iterator[pa.RecordBatch], chunks=chunks) -> Iterator[pa.RecordBatch]:
            keep: list[np.ndarray] | None = None
            for b in batches:
                for cand, c, at, q, own_rows in chunks(b):
                    for j, p in enumerate(partial_scores(c, q, lists)):
                        masked = np.where(own_rows, -np.inf, p.astype(np.float64))
                        top = np.argpartition(-masked, min(k, len(cand)) - 1, axis=0)[:k]
                        cols = np.broadcast_to(np.arange(len(at)), top.shape)
                        ok = np.isfinite(masked[top, cols])
                        r, col = top[ok], cols[ok]
                        new = [at[col] * lists + j, cand[r], masked[r, col], _long(exact_scores(c, q, r, col))]
                        keep = _best([np.concatenate(x) for x in zip(keep, new, strict=True)] if keep else new, k)
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(keep[0] // lists), pa.array(keep[0] % lists), pa.array(keep[1]), pa.array(keep[2]), pa.array(keep[3])], names=["q", "list", "vec_id", "partial", "score"])

        lists_ = common.map_arrow(candidates, gather, "q long, list long, vec_id long, partial double, score long")
        first = lists_.withColumn("r", F.row_number().over(Window.partitionBy("q", "list").orderBy(F.desc("partial"), "vec_id"))).where(F.col("r") <= k)
        seen = first.select("q", "vec_id", "score").distinct().withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") == k)
        cut = np.full(len(ids), -(2**63), dtype=np.int64)
        for r in seen.collect():  # a row per query of the block
            cut[r["q"]] = r["score"]
        cutoff = spark.sparkContext.broadcast(cut)

        def resolve(batches: Iterator[pa.RecordBatch], chunks=chunks, cutoff=cutoff, ids=ids) -> Iterator[pa.RecordBatch]:
            keep: list[np.ndarray] | None = None
            for b in batches:
                for cand, c, at, q, own_rows in chunks(b):
                    low = cutoff.value[at]
                    enough = np.zeros(own_rows.shape, dtype=bool)
                    for p in partial_scores(c, q, lists):
                        enough |= p * lists >= low.astype(p.dtype)[None, :]
                    r, col = np.nonzero(enough & ~own_rows)
                    score = exact_scores(c, q, r, col)
                    ok = np.asarray(score >= low[col], dtype=bool)
                    new = [at[col[ok]], cand[r[ok]], _long(score[ok])]
                    keep = _best([np.concatenate(x) for x in zip(keep, new, strict=True)] if keep else new, k)
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep[0]]), pa.array(keep[0]), pa.array(keep[1]), pa.array(keep[2])], names=["query_id", "q", "vec_id", "score"])

        last = common.map_arrow(candidates, resolve, "query_id long, q long, vec_id long, score long").withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        written.append(common.materialize(last, "top-k").written_at)
        vectors.unpersist()
        cutoff.unpersist()
    fields = "query_id long, rank int, vec_id long, score long"
    return spark.read.schema(fields).parquet(*written) if written else spark.createDataFrame([], fields)
