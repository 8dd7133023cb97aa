"""Filters, counts and rankings over campaigns, products and banks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sahaf.functions.fold import ascii_lower, or_unspecified, share


def records(campaigns: DataFrame, products: DataFrame) -> DataFrame:
    """Campaigns and products as one table; what one side lacks is null."""
    return campaigns.unionByName(products, allowMissingColumns=True)


def filter_campaigns(
    campaigns: DataFrame,
    banks: DataFrame | None = None,
    slug: str | None = None,
    slugs: Sequence[str] | None = None,
    product_type: str | None = None,
    financing_type: str | None = None,
    currency: str | None = None,
    search: str | None = None,
) -> DataFrame:
    """The campaigns that meet all conditions given; banks are joined only if one of them needs it.

    A currency matches a campaign's reward or its largest amount.  search is a pattern inside titles, in which % and _
    keep their meaning and only A-Z ignore case.
    """
    if slug is not None and slugs is not None:
        raise ValueError("give one bank or several, not both")
    out = campaigns
    wanted = [slug] if slug is not None else list(dict.fromkeys(slugs)) if slugs is not None else None
    if wanted is not None:
        if banks is None:
            raise ValueError("a bank condition needs the banks")
        out = out.join(banks.where(F.col("slug").isin(wanted)).select("bank_id"), "bank_id")
    if product_type is not None:
        out = out.where(F.col("product_type") == product_type)
    if financing_type is not None:
        out = out.where(F.col("financing_type") == financing_type)
    if currency is not None:
        out = out.where((F.col("reward_currency") == currency) | (F.col("max_currency") == currency))
    if search is not None:
        pattern = "".join(c.lower() if c.isascii() else c for c in search)
        out = out.where(ascii_lower("title").like(f"%{pattern}%"))
    return out


def page(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page by updated_at, newest first, then id, with the number of rows of all pages."""
    total = df.count()
    return df.orderBy(F.desc("updated_at"), "id").offset(offset).limit(limit).withColumn("total", F.lit(total).cast("long"))


def recent(campaigns: DataFrame, banks: DataFrame, k: int) -> DataFrame:
    """The k newest campaigns by scrape, else update, with their banks; k is kept from 1 to 50."""
    seen = F.coalesce("scraped_at", "updated_at")
    newest = campaigns.join(banks, "bank_id").withColumn("seen_at", seen).orderBy(F.desc("seen_at"), "id").limit(min(max(k, 1), 50))
    return newest.select("id", "slug", "title", "seen_at")


def summary(campaigns: DataFrame, products: DataFrame) -> DataFrame:
    """One row: banks with records, campaigns, products, all, the latest update, the mean rate."""
    return records(campaigns, products).agg(
        F.countDistinct("bank_id").alias("bank_count"),
        F.sum((F.col("record_kind") == "campaign").cast("long")).alias("campaign_count"),
        (F.count("*") - F.sum((F.col("record_kind") == "campaign").cast("long"))).alias("product_count"),
        F.count("*").alias("record_count"),
        F.max("updated_at").alias("latest"),
        F.round(F.avg("rate"), 6).alias("mean_rate"),
    )


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(or_unspecified(column).alias("name")).agg(F.count("*").alias("n"))


def bank_totals(campaigns: DataFrame, products: DataFrame, banks: DataFrame) -> DataFrame:
    """A row per bank, also of those without records; both sides are summed before they meet the banks."""
    per = records(campaigns.groupBy("bank_id").agg(F.count("*").alias("campaigns"), F.max("updated_at").alias("latest")), products.groupBy("bank_id").agg(F.count("*").alias("products"), F.max("updated_at").alias("latest")))
    per = per.groupBy("bank_id").agg(F.sum("campaigns").alias("campaigns"), F.sum("products").alias("products"), F.max("latest").alias("latest"))
    return banks.join(per, "bank_id", "left").select("slug", F.coalesce("campaigns", F.lit(0)).alias("campaigns"), F.coalesce("products", F.lit(0)).alias("products"), "latest")


def bank_shares(totals: DataFrame) -> DataFrame:
    """The banks' shares of campaigns and of all records; 0 where there are none."""
    whole = Window.partitionBy()
    both = F.col("campaigns") + F.col("products")
    return totals.select("slug", share(F.col("campaigns"), F.sum("campaigns").over(whole)).alias("campaign_share"), share(both, F.sum(both).over(whole)).alias("record_share"))


def type_distribution(campaigns: DataFrame, products: DataFrame) -> DataFrame:
    """By type: campaigns, products, records, and the share of all records."""
    by = records(campaigns, products).groupBy(or_unspecified("product_type").alias("product_type")).agg(
        F.sum((F.col("record_kind") == "campaign").cast("long")).alias("campaigns"),
        F.sum((F.col("record_kind") == "product").cast("long")).alias("products"),
        F.count("*").alias("records"),
    )
    return by.withColumn("share", F.round(F.col("records") / F.sum("records").over(Window.partitionBy()), 4))


def freshness(campaigns: DataFrame, products: DataFrame) -> DataFrame:
    """The latest times of both kinds and how many records have none, in one row."""
    a = campaigns.agg(F.max("scraped_at").alias("latest_scrape"), F.count(F.when(F.col("scraped_at").isNull(), 1)).alias("never_scraped"))
    return a.crossJoin(products.agg(F.max("updated_at").alias("latest_product")))


def currency_counts(campaigns: DataFrame) -> DataFrame:
    """By currency the campaigns that name it in either column; one that names it twice counts once."""
    long = campaigns.select("id", "reward_currency", "max_currency").unpivot("id", ["reward_currency", "max_currency"], "which", "currency")
    return long.where("currency is not null").groupBy("currency").agg(F.countDistinct("id").alias("campaigns"))


def unique_product(wanted: DataFrame, products: DataFrame) -> DataFrame:
    """wanted with product_id where exactly one product of the bank has the title, case aside; else null."""
    one = products.groupBy("bank_id", F.lower("title").alias("key")).agg(F.min("id").alias("product_id"), F.count("*").alias("n")).where("n = 1").drop("n")
    return wanted.withColumn("key", F.lower("title")).join(one, ["bank_id", "key"], "left").drop("key")


def excluded(campaigns: DataFrame, banned: DataFrame) -> DataFrame:
    """The records that the curated (bank_id, title) pairs do not ban; only campaigns can be banned."""
    pairs = banned.distinct().withColumn("record_kind", F.lit("campaign"))  # the adaptive planner sees how large it is
    return campaigns.join(pairs, ["bank_id", "title", "record_kind"], "left_anti")


def keep_in_snapshot(current: DataFrame, snapshot: DataFrame, complete: bool) -> DataFrame:
    """What prune leaves of current: the ids of the snapshot, or everything if the snapshot isn't complete."""
    return current.join(snapshot.select("id").distinct(), "id", "left_semi") if complete else current


def coverage(catalogue: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """supported (in both), unsupported (in the catalogue only), stale (in the registry only), by key."""
    a, b = catalogue.select(key).distinct().withColumn("c", F.lit(True)), registry.select(key).distinct().withColumn("r", F.lit(True))
    status = F.when(F.col("c") & F.col("r"), "supported").when(F.col("c"), "unsupported").otherwise("stale")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def index_diff(wanted: DataFrame, indexed: DataFrame) -> DataFrame:
    """What an index needs: (id, action) with changed for new or other hashes, stale for ids that are gone."""
    both = wanted.select("id", F.col("hash").alias("new")).join(indexed.select("id", F.col("hash").alias("old")), "id", "full_outer")
    action = F.when(F.col("new").isNull(), "stale").when(~F.col("new").eqNullSafe(F.col("old")), "changed")
    return both.select("id", action.alias("action")).where("action is not null")


def active(end_date: Column, as_of: Column) -> Column:
    """Whether a record still runs; one without a readable end date does."""
    return F.coalesce(F.try_to_date(F.substring(end_date.cast("string"), 1, 10)) >= as_of, F.lit(True))
