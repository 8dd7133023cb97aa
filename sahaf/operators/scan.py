"""State machines over ordered events, as an associative scan.

An event is a map from the states before it to the states after it.  Maps compose, so the events of a key are cut into
blocks whose maps are composed side by side; the blocks' states follow from a scan over the blocks' maps, and those of
the events from their block's.  A key of any number of events is spread over tasks, and no task holds more than a block.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sahaf.sources.io import settle

#: Events of a block.
BLOCK = 1024


def in_blocks(events: DataFrame, keys: list[str], order: list[str | Column], size: int = BLOCK) -> DataFrame:
    """events in order, written, with _place (ascending) and _block: runs of rows of which none crosses a partition."""
    by = [F.col(c) if isinstance(c, str) else c for c in [*keys, *order]]
    placed = events.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_place", F.monotonically_increasing_id())
    return settle(placed.withColumn("_block", F.floor(F.col("_place") / size)), "events")


def _walk(steps: Column, start: Column, get) -> Column:
    """The states before each of an array of events, from start on."""
    begin = F.struct(start.alias("s"), F.expr("CAST(array() AS ARRAY<INT>)").alias("seen"))
    return F.aggregate(steps, begin, lambda a, e: F.struct(F.element_at(get(e), a["s"] + 1).alias("s"), F.concat(a["seen"], F.array(a["s"])).alias("seen")), lambda a: a["seen"])


def _composed(steps: Column, states: int, get) -> Column:
    return F.aggregate(steps, F.sequence(F.lit(0), F.lit(states - 1)), lambda a, e: F.transform(a, lambda s: F.element_at(get(e), s + 1)))


def states(blocks: DataFrame, keys: list[str], step: str, n: int, start: int = 0, size: int = BLOCK) -> DataFrame:
    """Rows of in_blocks() with before and after: the state that each event finds and leaves.

    step names an array of n ints, the state after the event for each state before it; every key begins in state start.
    """
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    rest = [c for c in blocks.columns if c not in (*keys, "_block")]
    held = settle(blocks.groupBy(*keys, "_block").agg(F.array_sort(F.collect_list(F.struct("_place", *(c for c in rest if c != "_place")))).alias("_events")), "blocks")
    maps = held.select(*keys, F.col("_block").alias("_place"), _composed(F.col("_events"), n, lambda e: e[step]).alias(step))
    begins = _starts(maps, keys, step, n, start, size)
    joined = held.alias("a").join(begins.alias("b"), [*same("a", "b"), F.col("a._block") == F.col("b._place")]).select("a.*", "b.before")
    walked = joined.withColumn("_seen", _walk(F.col("_events"), F.col("before"), lambda e: e[step])).drop("before")
    out = walked.select(*keys, "_block", F.explode(F.arrays_zip(F.col("_events").alias("event"), F.col("_seen").alias("before"))).alias("x"))
    return out.select(*keys, "_block", "x.event.*", "x.before").withColumn("after", F.element_at(F.col(step), F.col("before") + 1))


def _starts(maps: DataFrame, keys: list[str], step: str, n: int, start: int, size: int) -> DataFrame:
    """(keys, _place, before) of blocks: the state before each, by the same scan over their maps until one block is left."""
    counts = maps.groupBy(*keys).agg(F.count("*").alias("n"))
    if (counts.agg(F.max("n")).first()[0] or 0) <= size:  # one block a key
        own = maps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_place", step))).alias("_events"))
        walked = own.withColumn("_seen", _walk(F.col("_events"), F.lit(start), lambda e: e[step]))
        return walked.select(*keys, F.explode(F.arrays_zip(F.transform("_events", lambda e: e["_place"]).alias("place"), F.col("_seen").alias("before"))).alias("x")).select(*keys, F.col("x.place").alias("_place"), "x.before")
    upper = in_blocks(maps.withColumnRenamed("_place", "_of"), keys, ["_of"], size)
    return states(upper, keys, step, n, start, size).select(*keys, F.col("_of").alias("_place"), "before")


def carried(blocks: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of in_blocks() with each value filled by the last one before it of its key that isn't null.

    Each block's last values are carried on from block to block, so windows are of a block's rows, and of a key's blocks.
    """
    inside = Window.partitionBy(*keys, "_block").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    lasts = blocks.groupBy(*keys, "_block").agg(*(F.max_by(v, F.when(F.col(v).isNotNull(), F.col("_place"))).alias(f"_last_{v}") for v in values))
    found = settle(lasts.select(*keys, "_block", *(F.last(f"_last_{v}", ignorenulls=True).over(before).alias(f"_from_{v}") for v in values)), "carried")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_block"]]
    joined = blocks.alias("a").join(found.alias("b"), same).select("a.*", *(f"b._from_{v}" for v in values))
    return joined.withColumns({v: F.coalesce(F.last(v, ignorenulls=True).over(inside), F.col(f"_from_{v}")) for v in values}).drop(*(f"_from_{v}" for v in values))


def recent(events: DataFrame, keys: list[str], order: list[str | Column], name: str, names: list[str], size: int, block: int = BLOCK) -> DataFrame:
    """events with hit: whether a cache of a key's `size` last names holds the event's name.

    What the cache holds is one of the arrangements of at most `size` of the names, so the events of a key are a scan.
    names are few (their arrangements are states); a null name, or one that is none of them, is no hit and changes nothing.
    """
    held = [p for n in range(min(size, len(names)) + 1) for p in permutations(names, n)]
    place = {p: k for k, p in enumerate(held)}
    after = {w: [place[(w, *(x for x in p if x != w))[:size]] for p in held] for w in names}
    table = F.create_map(*[c for w in names for c in (F.lit(w), F.array(*map(F.lit, after[w])))])
    known = F.create_map(*[c for w in names for c in (F.lit(w), F.array(*(F.lit(w in p) for p in held)))])
    step = F.coalesce(F.try_element_at(table, F.col(name)), F.sequence(F.lit(0), F.lit(len(held) - 1)))
    seen = states(in_blocks(events.withColumn("_step", step), keys, order, block), keys, "_step", len(held), 0, block)
    hit = F.coalesce(F.element_at(F.try_element_at(known, F.col(name)), F.col("before") + 1), F.lit(False))
    return seen.withColumn("hit", hit).drop("_step", "_place", "_block", "before", "after")
