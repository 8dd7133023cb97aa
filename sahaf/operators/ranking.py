"""Representatives, ties, normalised scores and rank fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sahaf.sources.io import settle


def finite(x: Column) -> Column:
    """x as a double, null unless it is a finite number."""
    x = x.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The n first rows of each key."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


#: Blocks that each side of a group's pairs is cut into; a group's work is that of their square of tasks.
BLOCKS = 8


def pairs_within(df: DataFrame, keys: list[str], id: str, tasks: int = 8) -> DataFrame:
    """keys, id and other of all pairs of ids, in order, within a group; few groups are dealt to `tasks` tasks a core.

    Every row goes to the cells of its block, BLOCKS on either side, and each pair meets in one cell.  What is shuffled
    grows with the rows, the pairs with their square.
    """
    rows = df.select(*keys, id).withColumn("__b", F.pmod(F.xxhash64(id), F.lit(BLOCKS)))
    every = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)).cast("array<bigint>"))
    cells = [*keys, "__b", "__c"]
    dealt = lambda side: side.repartition(tasks * df.sparkSession.sparkContext.defaultParallelism, *cells)
    left = dealt(rows.withColumn("__c", every))
    right = dealt(rows.select(*keys, F.col(id).alias("other"), every.alias("__b"), F.col("__b").alias("__c")))
    return left.join(right, cells).where(F.col(id) < F.col("other")).select(*keys, id, "other")


def positions(df: DataFrame, order: list[str]) -> DataFrame:
    """df with pos, its place in the order of those columns: ranges are numbered apart, then offset by the ranges before."""
    ranged = settle(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranges")
    ranked = ranged.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("n"))  # a row per range
    before = sizes.select("__p", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    return ranked.join(before, "__p").withColumn("pos", F.col("__r") + F.col("__b")).drop("__p", "__r", "__b")


def best_source(df: DataFrame, key: str, score: str, pos: str) -> DataFrame:
    """Per key the row of highest score, the first of equals; first_pos is where the key was first seen.

    A score that is not finite is lower than all and shown as 0.
    """
    s = finite(F.col(score))
    w = Window.partitionBy(key)
    best = df.withColumn("__s", s).withColumn("first_pos", F.min(pos).over(w)).withColumn("__r", F.row_number().over(w.orderBy(F.col("__s").isNull(), F.desc("__s"), pos)))
    return best.where("__r = 1").withColumn(score, F.coalesce("__s", F.lit(0.0))).drop("__r", "__s")


def extrema(df: DataFrame, group: str, value: str, lowest: bool = True) -> DataFrame:
    """All rows that reach the group's least (or greatest) value; rows without value take no part."""
    known = df.where(F.col(value).isNotNull())
    edge = known.groupBy(F.col(group).alias("__g")).agg((F.min(value) if lowest else F.max(value)).alias("__e"))  # a row a group, however many rows one has
    return known.join(edge, F.col(group).eqNullSafe(F.col("__g")) & (F.col(value) == F.col("__e"))).select(*df.columns)


def min_max(df: DataFrame, column: str, group: list[str], lower_is_better: bool = False) -> Column:
    """A score from 0 to 1 in the group; 0.5 if all known values are equal or only one is; null stays null."""
    w = Window.partitionBy(*group)
    x = finite(F.col(column))
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.when(x.isNull(), None).when((F.count(x).over(w) == 1) | (low == high), F.lit(0.5)).otherwise((high - x) / (high - low) if lower_is_better else (x - low) / (high - low))


def weighted(scores: dict[str, Column], weights: dict[str, float]) -> tuple[Column, Column]:
    """The mean of the known scores by weight, and the known part of all weight."""
    known = sum((F.when(scores[c].isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    total = sum((F.coalesce(scores[c], F.lit(0.0)) * F.lit(w) for c, w in weights.items()), F.lit(0.0))
    return F.when(known > 0, total / known), known / F.lit(sum(weights.values()))


def reciprocal_ranks(lists: DataFrame, constants: dict[str, float], digits: int = 6, group: list[str] | None = None) -> DataFrame:
    """(*group, key, score) of ranked lists (*group, source, key, rank): the sum over sources of 1 / (constant + rank).

    A key counts once per source, at its best rank, and ranks are renumbered after that.
    """
    group = group or []
    once = lists.groupBy(*group, "source", "key").agg(F.min("rank").alias("rank"))
    again = once.withColumn("rank", F.row_number().over(Window.partitionBy(*group, "source").orderBy("rank", "key")))
    k = F.create_map(*[F.lit(x) for pair in constants.items() for x in pair])
    return again.groupBy(*group, "key").agg(F.round(F.sum(F.lit(1.0) / (F.try_element_at(k, F.col("source")) + F.col("rank"))), digits).alias("score"))


def cascade(queries: DataFrame, vectors: dict[str, DataFrame], lexical: DataFrame, graph: DataFrame, limit: int = 5) -> DataFrame:
    """(query_id, backend, key, score, rank): what the first vector backend that answers a query gives, fused with the lexical
    and the graph's list; without any vectors the lexical list alone, fused with the graph's if it has one.

    vectors come in the order in which they are asked; lists are (query_id, key, rank).  A query's backend names what its
    answer came from, and that it fell back; a query that nothing answers has no key.
    """
    found = reduce(DataFrame.unionByName, (df.select("query_id", F.lit(k).alias("k"), F.lit(name).alias("name"), "key", "rank") for k, (name, df) in enumerate(vectors.items())))
    first = found.groupBy("query_id").agg(F.min(F.struct("k", "name")).alias("first")).select("query_id", "first.k", "first.name")
    chosen = found.join(first.select("query_id", "k"), ["query_id", "k"]).select("query_id", F.lit("vector").alias("source"), "key", "rank")
    lists = chosen.unionByName(lexical.select("query_id", F.lit("lexical").alias("source"), "key", "rank")).unionByName(graph.select("query_id", F.lit("graph").alias("source"), "key", "rank"))
    fused = reciprocal_ranks(lists, {"vector": 60.0, "lexical": 60.0, "graph": 10.0}, group=["query_id"])
    has = lambda df, name: df.select("query_id").distinct().withColumn(name, F.lit(True))
    known = queries.select("query_id").join(first, "query_id", "left").join(has(graph, "by_graph"), "query_id", "left").join(has(lexical, "by_words"), "query_id", "left")
    with_graph = F.when(F.col("by_graph"), "+knowledge-graph").otherwise("")
    fallback = F.when(F.col("by_graph") | F.col("by_words"), F.concat(F.lit("bm25"), with_graph, F.lit("-fallback"))).otherwise("none")
    backend = F.when(F.col("name").isNotNull(), F.concat("name", F.lit("+bm25"), with_graph)).otherwise(fallback)
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))).where(F.col("rank") <= limit)
    return known.select("query_id", backend.alias("backend")).join(ranked, "query_id", "left")
