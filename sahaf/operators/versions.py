"""Versioned records: what repeated observations of a record say about its history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def history(observations: DataFrame) -> DataFrame:
    """Slowly changing versions of (record_id, content_hash, observed_at, event_id).

    An observation with the hash of the one before adds to its version; another hash closes that and opens the next.
    A version that returns to an older hash is a new one.
    """
    order = Window.partitionBy("record_id").orderBy("observed_at", "event_id")
    changed = (~F.col("content_hash").eqNullSafe(F.lag("content_hash").over(order)) | F.lag("event_id").over(order).isNull()).cast("long")
    numbered = observations.withColumn("changed", changed).withColumn("source_version", F.sum("changed").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    versions = numbered.groupBy("record_id", "source_version").agg(F.min("content_hash").alias("content_hash"), F.min("observed_at").alias("valid_from"), F.max("observed_at").alias("last_seen_at"), F.count("*").alias("occurrence_count"))
    after = Window.partitionBy("record_id").orderBy("source_version")
    end = F.lead("valid_from").over(after)
    return versions.select("record_id", "source_version", "content_hash", "valid_from", end.alias("valid_to"), F.when(end.isNotNull(), F.concat("record_id", F.lit(":"), (F.col("source_version") + 1).cast("string"))).alias("superseded_by"), end.isNull().alias("is_current"), "occurrence_count", "last_seen_at")


def as_of(versions: DataFrame, moment) -> DataFrame:
    """The versions that were valid at a moment."""
    t = F.lit(moment).cast("timestamp")
    return versions.where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))


def apply_updates(current: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Compare-and-set: current with the updates whose expected version and hash are still the stored ones.

    updates has keys, expected_hash, expected_version and payload; each row of the result says if it was applied.
    """
    joined = current.join(updates, keys, "left")
    fresh = F.coalesce((F.col("expected_hash") == F.col("content_hash")) & (F.col("expected_version") == F.col("source_version")), F.lit(False))
    return joined.select(*keys, "content_hash", "source_version", F.when(fresh, F.col("payload")).alias("payload"), F.when(F.col("expected_hash").isNull(), "untouched").when(fresh, "applied").otherwise("stale").alias("outcome"))
