"""A vector index in a folder: inverted lists of coarse cells, of which only those with changed entries are rewritten.

Every entry lies in the list of the cell whose centroid is nearest by cosine; the lists are partitions of a table, so a
search reads those of the cells that its queries probe.  The centroids are fitted once, by distributed k-means on a
bounded sample, and all entries are put into lists.  How many cells a query must probe is measured at the first build
against exact search.  A later build compares the hashes of the entries with the stored ones, embeds only what is new or
changed, and replaces only the lists that lose or gain an entry.  A log of markers says what state the index is in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sahaf.sources.io import forget, settle
from sahaf.sources.store import filesystem

from .retrieval import CELLS, QUERY_BLOCK, Best, cosines, matrix, nearest, unit

LAYOUT = "cells-1"
#: Cells at most, and sampled vectors a cell that the centroids are fitted on: the fit's bound.
MOST_CELLS, SAMPLE_PER_CELL = 4096, 64
#: Share of the true neighbours of the measured queries that probing must find, how many each has, and how many queries are measured.
TARGET, NEIGHBOURS, MEASURED = 0.93, 20, 256
#: Entries of a list's file, about.
FILE_ROWS = 200_000
MARKER = "seq long, status string, model string, layout string, cells int, probes int, total long"
#: The list of entries without a direction: null, empty, zero or not finite.  No search finds them.
NOWHERE = -1


class Build(NamedTuple):
    """What a build did: entries in all, embedded, left alone and deleted; lists in all and rewritten."""

    total: int
    embedded: int
    unchanged: int
    stale_deleted: int
    cells: int
    rewritten: int


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = filesystem(spark, path)
    return fs.exists(at)


def _has_lists(spark: SparkSession, folder: str) -> bool:
    fs, at = filesystem(spark, f"{folder}/lists")
    return fs.exists(at) and any(x.getPath().getName().startswith("cell=") for x in fs.listStatus(at))


def markers(spark: SparkSession, folder: str) -> DataFrame:
    """The index's log, a row for each state that it was in; empty if there is no index."""
    path = f"{folder}/markers"
    return spark.read.schema(MARKER).parquet(path) if _exists(spark, path) else spark.createDataFrame([], MARKER)


def _last(spark: SparkSession, folder: str):
    return markers(spark, folder).orderBy(F.desc("seq")).first()


def _mark(spark: SparkSession, folder: str, status: str, model: str, cells: int, probes: int, total: int) -> None:
    last = _last(spark, folder)
    row = (1 + (last["seq"] if last else 0), status, model, LAYOUT, cells, probes, total)
    spark.createDataFrame([row], MARKER).coalesce(1).write.mode("append").parquet(f"{folder}/markers")


def ready(spark: SparkSession, folder: str) -> bool:
    """Whether the index's last build came to its end."""
    last = _last(spark, folder)
    return last is not None and last["status"] == "ready"


def lists(spark: SparkSession, folder: str) -> DataFrame:
    """Every entry: id, hash, embedding, what else the entries have, and cell."""
    return spark.read.option("basePath", f"{folder}/lists").parquet(f"{folder}/lists")


def _centroids(spark: SparkSession, folder: str) -> np.ndarray:
    rows = spark.read.parquet(f"{folder}/cells").orderBy("cell").collect()  # MOST_CELLS rows at most
    return np.array([r["centroid"] for r in rows], dtype=float)


def _fit(embedded: DataFrame, cells: int) -> list[tuple[int, list[float]]]:
    """Centroids of the sample of vectors whose ids have the least hashes."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    real = embedded.select("id", F.col("embedding").cast("array<double>").alias("embedding")).where((length > 0) & (length < float("inf")))
    sample = settle(real.orderBy(F.xxhash64("id"), "id").limit(cells * SAMPLE_PER_CELL), "sample")
    if sample.isEmpty():
        return []
    points = sample.select(array_to_vector("embedding").alias("features"))
    # blocks of rows are multiplied by all centers; by rows, distances of all pairs of centers would be sent to the driver in each round
    model = KMeans(k=cells, seed=7, maxIter=15, distanceMeasure="cosine", initMode="k-means||", solver="block").fit(points)
    forget(sample)
    return [(i, c.tolist()) for i, c in enumerate(model.clusterCenters())]


def _assign(embedded: DataFrame, centroids: np.ndarray) -> DataFrame:
    """embedded with the cell of each entry."""
    sent = embedded.sparkSession.sparkContext.broadcast(unit(centroids) if len(centroids) else centroids)

    @F.pandas_udf("int")
    def cell(x: pd.Series) -> pd.Series:
        out = np.full(len(x), NOWHERE, dtype=np.int32)
        if len(sent.value):
            right = np.flatnonzero(x.map(lambda v: v is not None and len(v) == sent.value.shape[1]).to_numpy(dtype=bool))
            if len(right):
                step = max(1, CELLS // max(sent.value.shape))
                for a in range(0, len(right), step):
                    u = unit([np.asarray(x.iloc[k], dtype=float) for k in right[a : a + step]])
                    out[right[a : a + step]] = np.where(np.isfinite(u).all(1), np.nan_to_num(u @ sent.value.T, copy=False).argmax(1), NOWHERE)
        return pd.Series(out)

    return embedded.withColumn("cell", cell("embedding"))


def _measure(placed: DataFrame, centroids: np.ndarray) -> int:
    """The least number of probes that finds TARGET of the true neighbours of some of the entries."""
    if not len(centroids):
        return 0
    vectors = placed.where(F.col("cell") != NOWHERE).select(F.col("id").alias("vec_id"), "embedding", "cell")
    asked = settle(vectors.orderBy(F.xxhash64("vec_id", F.lit("asked"))).limit(MEASURED).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), "asked")
    found = nearest(vectors, asked, NEIGHBOURS).select("query_id", "vec_id").join(vectors.select("vec_id", "cell"), "vec_id")
    near = found.join(asked, "query_id").select("query", "cell").collect()  # MEASURED times NEIGHBOURS rows
    forget(asked)
    if not near:
        return len(centroids)
    order = np.argsort(-(unit([r["query"] for r in near]) @ unit(centroids).T), axis=1, kind="stable")
    place = np.argmax(order == np.array([r["cell"] for r in near])[:, None], axis=1)
    return int(np.sort(place)[min(len(place) - 1, int(np.ceil(TARGET * len(place))) - 1)]) + 1


def build(entries: DataFrame, folder: str, embed: Callable[[DataFrame], DataFrame], model: str, cells: int | None = None) -> Build:
    """Bring the index in folder up to entries (id, hash and what else embed needs or searches filter by).

    embed adds the column embedding to the rows it is given: those that are new or whose hash has changed.  ids must be
    there once; rows without id are left out.  An index of another model or layout is an error.  A build that was stopped
    leaves the marker "building", and the next one does again what is missing: lists are replaced whole, and entries in
    them are told by id, so doing it twice changes nothing.
    """
    spark = entries.sparkSession
    entries = entries.where("id is not null and hash is not null")
    last = _last(spark, folder)
    if last is not None and (last["model"], last["layout"]) != (model, LAYOUT):
        raise ValueError(f"the index is of model {last['model']} and layout {last['layout']}")
    fresh = not _exists(spark, f"{folder}/cells/_SUCCESS")
    _mark(spark, folder, "building", model, 0 if fresh else last["cells"], 0 if fresh else last["probes"], last["total"] if last else 0)
    there = _has_lists(spark, folder)
    old = lists(spark, folder).select("id", F.col("hash").alias("old_hash"), "cell") if there else spark.createDataFrame([], entries.select("id").schema).select("id", F.lit("").alias("old_hash"), F.lit(0).alias("cell"))
    diff = settle(entries.select("id", "hash").join(old, "id", "full").where("hash is null or old_hash is null or hash <> old_hash").select("id", F.col("hash").isNull().alias("stale"), "cell"), "diff")
    changed = diff.where("not stale").select("id")
    embedded = settle(embed(entries.join(changed, "id", "left_semi")), "embedded")
    if fresh:
        n = embedded.count()
        _write_cells(spark, folder, _fit(embedded, min(cells or max(1, int(n**0.5)), MOST_CELLS, max(n, 1))))
    centroids = _centroids(spark, folder)
    placed = settle(_assign(embedded, centroids), "placed")
    probes = _measure(placed, centroids) if fresh else last["probes"]
    touched = sorted({r["cell"] for r in placed.select("cell").unionByName(diff.select("cell")).where("cell is not null").distinct().collect()})  # MOST_CELLS at most
    if there:
        kept = lists(spark, folder).where(F.col("cell").isin(touched)).join(diff.select("id"), "id", "left_anti")
        content = settle(kept.unionByName(placed.select(kept.columns)), "content")
    else:
        content = placed
    if touched:
        files = content.groupBy("cell").agg(F.ceil(F.count("*") / FILE_ROWS).alias("_files"))  # MOST_CELLS rows at most
        dealt = content.join(F.broadcast(files), "cell").withColumn("_file", F.pmod(F.xxhash64("id"), F.col("_files")))
        spread = dealt.repartition("cell", "_file").select(*content.columns)  # a large list is written by many tasks
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell").parquet(f"{folder}/lists")
        left = {r["cell"] for r in content.select("cell").distinct().collect()}
        for cell in set(touched) - left:
            fs, at = filesystem(spark, f"{folder}/lists/cell={cell}")
            fs.delete(at, True)
    stale, embedded_n = diff.where("stale").count(), placed.count()
    total = lists(spark, folder).count() if _has_lists(spark, folder) else 0
    forget(diff, embedded, placed, *([content] if there else []))
    _mark(spark, folder, "ready", model, len(centroids), probes, total)
    return Build(total, embedded_n, total - embedded_n, stale, len(centroids), len(touched))


def _write_cells(spark: SparkSession, folder: str, rows: list[tuple[int, list[float]]]) -> None:
    spark.createDataFrame(rows, "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/cells")


def probed(spark: SparkSession, folder: str, queries: DataFrame, probes: int | None = None) -> DataFrame:
    """(query_id, cell): the lists that each query (query_id, query) reads, nearest first by place."""
    centroids = _centroids(spark, folder)
    m = min(probes or _last(spark, folder)["probes"], len(centroids))
    sent = spark.sparkContext.broadcast(unit(centroids) if len(centroids) else centroids)

    @F.pandas_udf("array<int>")
    def near(x: pd.Series) -> pd.Series:
        def one(v) -> list[int]:
            if v is None or not len(sent.value) or len(v) != sent.value.shape[1]:
                return []
            u = unit([np.asarray(v, dtype=float)])[0]
            return np.argsort(-(sent.value @ u), kind="stable")[:m].tolist() if np.isfinite(u).all() else []

        return x.map(one)

    return queries.select("query_id", F.posexplode(near("query")).alias("place", "cell"))


def search(spark: SparkSession, folder: str, queries: DataFrame, k: int, probes: int | None = None, where: Column | None = None, digits: int = 6) -> DataFrame:
    """(query_id, id, score, rank): the k best entries by cosine among those of the cells that each query probes.

    Scores under 0 are 0, ties go to smaller ids, an entry is not found by its own id.  Queries go out in blocks; each
    task keeps k rows of every query.  where filters entries before they are ranked.  Without an index that is ready, or
    of queries without a direction, nothing is found.
    """
    schema = "query_id long, id long, score double"
    if not ready(spark, folder) or not _has_lists(spark, folder):
        return spark.createDataFrame([], schema + ", rank int")
    queries = settle(queries.select("query_id", F.col("query").cast("array<double>").alias("query")).where("query_id is not null and query is not null"), "queries")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    reads = probed(spark, folder, queries, probes).groupBy("query_id").agg(F.collect_list("cell").alias("cells"))
    held = lists(spark, folder)
    held = (held if where is None else held.where(where)).select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), "cell")
    out = None
    for block in range(blocks):
        asked = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).join(reads, "query_id").collect()  # about QUERY_BLOCK rows
        by_cell: dict[int, list[int]] = {}
        for n, r in enumerate(asked):
            for cell in r["cells"]:
                by_cell.setdefault(cell, []).append(n)
        ids, q = np.array([r["query_id"] for r in asked], dtype=np.int64), unit([r["query"] for r in asked]) if asked else np.empty((0, 1))
        sent = spark.sparkContext.broadcast((ids, q, {c: np.array(n) for c, n in by_cell.items()}))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q, by_cell = sent.value
            best = Best(len(ids), k)
            for b in batches:
                for cell in pc.unique(b.column("cell")).to_pylist():
                    who = by_cell.get(cell)
                    if who is None:
                        continue
                    own = b.filter(pc.equal(b.column("cell"), cell))
                    step = max(1, CELLS // max(len(who), q.shape[1]))
                    for a in range(0, len(own), step):
                        some = own.slice(a, step)
                        vec = some.column("id")
                        best.add(vec, cosines(matrix(some.column("embedding"), q.shape[1]), q[who], vec.to_numpy(), ids[who], digits), who)
            yield from best.batches(pa.array(ids), "id")

        found = held.where(F.col("cell").isin(sorted(by_cell))).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
