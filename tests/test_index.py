"""The vector index: recall, what later builds touch, states, and odd entries."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sahaf.operators import index, retrieval
from sahaf.plans import indexes

SCHEMA = "id long, hash string, label int, embedding array<double>"


def entries(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(12, 16))
    rows = [(i, f"h{i}", int(i % 12), (middles[i % 12] + rng.normal(size=16) * 0.4).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def given(rows):
    return rows


def files(folder):
    """The data files of each list."""
    root = folder.removeprefix("file://") + "/lists"
    return {cell: frozenset(f for f in os.listdir(f"{root}/{cell}") if f.endswith(".parquet")) for cell in os.listdir(root) if cell.startswith("cell=")}


def asked(df, every=25):
    return df.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))


def test_probing_few_lists_finds_nearly_all(spark, tmp_path):
    df, folder = entries(spark, 3000), f"file://{tmp_path}/i"
    built = index.build(df, folder, given, "m")
    assert built.total == built.embedded == 3000 and built.cells == 54
    exact = {(r.query_id, r.vec_id): r.score for r in retrieval.nearest(df.withColumnRenamed("id", "vec_id"), asked(df), 20).collect()}
    got = {(r.query_id, r.id): r.score for r in index.search(spark, folder, asked(df), 20).collect()}
    assert all(exact[k] == got[k] for k in exact.keys() & got.keys())
    assert len(exact.keys() & got.keys()) >= 0.9 * len(exact)
    assert index.markers(spark, folder).orderBy(F.desc("seq")).first()["probes"] < 27  # under half of the lists
    plan = index.lists(spark, folder).where(F.col("cell").isin(1, 2))
    assert len(plan.inputFiles()) == len(index.lists(spark, folder).inputFiles())  # pruned at execution only
    assert "PartitionFilters: [cell" in plan._jdf.queryExecution().executedPlan().toString()
    everything = index.search(spark, folder, asked(df), 20, probes=54)
    assert {(r.query_id, r.id): r.score for r in everything.collect()} == exact


def test_recall_of_the_given_vectors(spark, data):
    rows = indexes.r08_recall(spark, data).collect()
    lists = sum(r.lists_read for r in rows) / len(rows)
    assert sum(r.found for r in rows) >= 0.9 * sum(r.neighbours for r in rows)
    assert lists < 22  # of 22


def test_a_later_build_touches_only_changed_lists(spark, tmp_path):
    df, folder = entries(spark, 600), f"file://{tmp_path}/i"
    index.build(df, folder, given, "m")
    before = files(folder)
    cell = {r.id: r.cell for r in index.lists(spark, folder).select("id", "cell").collect()}
    assert index.build(df, folder, given, "m")[1:4] == (0, 600, 0) and files(folder) == before
    seen = []

    def embed(rows):
        seen.extend(r.id for r in rows.select("id").collect())
        return rows

    later = df.where("id <> 5").withColumn("hash", F.when(F.col("id") == 7, "new").otherwise(F.col("hash")))
    later = later.unionByName(df.where("id = 9").withColumns({"id": F.lit(9000).cast("long"), "hash": F.lit("h9000")}))
    built = index.build(later, folder, embed, "m")
    assert (built.total, built.embedded, built.unchanged, built.stale_deleted) == (600, 2, 598, 1) and sorted(seen) == [7, 9000]
    touched = {f"cell={cell[k]}" for k in (5, 7, 9)}
    after = files(folder)
    assert built.rewritten == len(touched)
    assert {c for c in before if before[c] != after.get(c)} <= touched
    assert all(before[c] == after[c] for c in before.keys() - touched)
    assert sorted(r.id for r in index.lists(spark, folder).collect()) == sorted({*range(600)} - {5} | {9000})
    assert index.lists(spark, folder).where("id = 7").first()["hash"] == "new"


def test_lists_that_lose_all_entries_go(spark, tmp_path):
    df, folder = entries(spark, 200), f"file://{tmp_path}/i"
    index.build(df, folder, given, "m", cells=8)
    gone = index.lists(spark, folder).select("cell").first()["cell"]
    ids = [r.id for r in index.lists(spark, folder).where(F.col("cell") == gone).collect()]
    index.build(df.where(~F.col("id").isin(ids)), folder, given, "m")
    assert f"cell={gone}" not in files(folder)
    assert index.build(df.limit(0), folder, given, "m") == index.Build(0, 0, 0, 200 - len(ids), 8, 7)
    assert index.search(spark, folder, asked(df), 5).count() == 0
    assert index.build(df, folder, given, "m").embedded == 200


def test_states_and_strangers(spark, tmp_path):
    df, folder = entries(spark, 60), f"file://{tmp_path}/i"
    assert not index.ready(spark, folder) and index.search(spark, folder, asked(df), 5).count() == 0

    def breaks(rows):
        raise RuntimeError("no model")

    with pytest.raises(RuntimeError):
        index.build(df, folder, breaks, "m")
    assert not index.ready(spark, folder) and [r.status for r in index.markers(spark, folder).collect()] == ["building"]
    index.build(df, folder, given, "m")
    assert index.ready(spark, folder)
    with pytest.raises(ValueError, match="model"):
        index.build(df, folder, given, "other")
    odd = spark.createDataFrame([(1000, "a", 1, None), (1001, "b", 1, []), (1002, "c", 1, [0.0] * 16), (1003, "d", 1, [float("nan")] * 16), (1004, "e", 1, [1.0] * 3), (None, "f", 1, [1.0] * 16), (1005, None, 1, [1.0] * 16)], SCHEMA)
    built = index.build(df.unionByName(odd), folder, given, "m")
    assert built.total == 65 and {r.id for r in index.lists(spark, folder).where(f"cell = {index.NOWHERE}").collect()} == {1000, 1001, 1002, 1003, 1004}
    found = index.search(spark, folder, asked(df.unionByName(odd), 1), 99, probes=99).collect()
    assert {r.id for r in found} == {*range(60)} and {r.query_id for r in found} == {*range(60), 1005}
    only = index.search(spark, folder, asked(df), 99, probes=99, where=F.col("label") == 3).collect()
    assert {r.id % 12 for r in only} == {3}


def test_an_empty_index(spark, tmp_path):
    folder = f"file://{tmp_path}/i"
    assert index.build(entries(spark, 1).limit(0), folder, given, "m").total == 0
    assert index.ready(spark, folder) and index.search(spark, folder, asked(entries(spark, 30)), 3).count() == 0
