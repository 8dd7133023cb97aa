"""Near-duplicate records of a bank by fingerprints."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sahaf.functions.text import hamming
from sahaf.sources.io import settle

THRESHOLD = 6
#: Bands by the number of fingerprints of a bank: of k bands k - 6 agree at least, and such a group of bands is the key.
BANDS = ((600, 7), (60_000, 8), (2_000_000, 9))
MOST_BANDS = 10


def bands(n: int, threshold: int = THRESHOLD) -> int:
    """The number of bands for n fingerprints: more of them make more, longer keys, so that few others share one."""
    return next((k for most, k in BANDS if n <= most), MOST_BANDS) + threshold - THRESHOLD


def _keys(fp: str, k: int, threshold: int) -> Column:
    """All groups of k - threshold bands of a fingerprint, each as one number and which bands it is of."""
    edges = [64 * i // k for i in range(k + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    whole = [sum(masks[i] for i in group) for group in combinations(range(k), k - threshold)]
    signed = [m - (1 << 64) if m >> 63 else m for m in whole]
    return F.explode(F.transform(F.array(*(F.struct(F.lit(i).alias("k"), F.lit(m).cast("long").alias("m")) for i, m in enumerate(signed))), lambda x: F.struct(x["k"].alias("k"), F.col(fp).bitwiseAND(x["m"]).alias("v"))))


def near_pairs(records: DataFrame, bank: str = "bank", threshold: int = THRESHOLD) -> DataFrame:
    """(bank, a, b) of distinct fingerprints (bank, fp) of a bank that differ in at most `threshold` bits, a < b.

    Equal fingerprints are one, so a group of copies makes no pairs.  Of k bands k - threshold agree, and groups of so
    many bands are the keys of an equi-join; the larger the largest bank, the more bands, so that keys stay rare.
    A row has up to 210 keys, which the planner's estimate leaves out, so the join is told not to broadcast them.
    """
    own = settle(records.select(F.col(bank).alias("bank"), "fp").distinct(), "fingerprints")
    most = own.groupBy("bank").count().agg(F.max("count")).first()[0] or 0
    keyed = own.select("bank", "fp", _keys("fp", bands(most, threshold), threshold).alias("key"))
    left, right = keyed.withColumnRenamed("fp", "a"), keyed.withColumnRenamed("fp", "b")
    return left.hint("merge").join(right, ["bank", "key"]).where((F.col("a") < F.col("b")) & (hamming(F.col("a"), F.col("b")) <= threshold)).select("bank", "a", "b").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(bank, fp, root): the least fingerprint that pairs lead to, by spreading minima until nothing changes."""
    pairs = settle(pairs, "pairs")
    both = pairs.unionByName(pairs.select("bank", F.col("b").alias("a"), F.col("a").alias("b")))
    labels = settle(both.groupBy("bank", F.col("a").alias("fp")).agg(F.least(F.col("fp"), F.min("b")).alias("root")), "labels")
    while True:
        at_b = labels.select("bank", F.col("fp").alias("b"), F.col("root").alias("next"))
        spread = both.join(at_b, ["bank", "b"]).select("bank", F.col("a").alias("fp"), F.col("next").alias("root"))
        at_root = labels.select("bank", F.col("fp").alias("root"), F.col("root").alias("next"))
        hop = labels.join(at_root, ["bank", "root"]).select("bank", "fp", F.col("next").alias("root"))
        after = settle(reduce(DataFrame.unionByName, [labels, spread, hop]).groupBy("bank", "fp").agg(F.min("root").alias("root")), "labels")
        changed = not after.join(labels.withColumnRenamed("root", "old"), ["bank", "fp"]).where("root <> old").isEmpty()
        labels = after
        if not changed:
            return labels


def clusters(records: DataFrame) -> DataFrame:
    """(id, cluster): records (id, bank, fp, content_hash) of a bank whose fingerprints are linked share a cluster.

    Its name is a hash of the bank and the least content hash of its members.
    """
    records = settle(records, "records")  # fingerprints are made once
    pairs = near_pairs(records)
    rooted = records.join(components(pairs), ["bank", "fp"], "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("bank", "root").agg(F.min("content_hash").alias("least"))
    name = F.concat(F.lit("dup-"), F.substring(F.sha2(F.concat_ws("\u0000", F.col("bank"), F.col("least")), 256), 1, 16))
    return rooted.join(least.withColumn("cluster", name), ["bank", "root"]).select("id", "bank", "cluster")


def nearest_existing(new: DataFrame, stored: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(id, cluster) of new records (id, bank, fp, cluster): the least of its own and the stored ones nearby."""
    new, stored = settle(new, "new"), settle(stored, "stored")
    most = stored.select("bank", "fp").distinct().groupBy("bank").count().agg(F.max("count")).first()[0] or 0
    keys = _keys("fp", bands(most, threshold), threshold).alias("key")
    known = stored.groupBy("bank", "fp").agg(F.min("cluster").alias("found")).select("bank", F.col("fp").alias("other"), "found", keys)
    probes = new.select("bank", "fp").distinct().select("bank", "fp", keys)
    near = probes.hint("merge").join(known, ["bank", "key"]).where(hamming(F.col("fp"), F.col("other")) <= threshold).groupBy("bank", "fp").agg(F.min("found").alias("found"))
    return new.join(near, ["bank", "fp"], "left").select("id", F.least("cluster", "found").alias("cluster"))


def summary(clustered: DataFrame) -> DataFrame:
    """Clusters of more than one member, and the records in them."""
    n = clustered.groupBy("cluster").count().where("count > 1")
    return n.agg(F.count("*").alias("clusters"), F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("records"))
