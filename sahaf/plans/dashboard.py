"""Catalogue, dashboard and filter queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sahaf.functions.fold import ascii_lower, or_unspecified
from sahaf.operators import catalogue as c

from .registry import query
from .tables import frame, sql_with

UNSPECIFIED = "coalesce(nullif(trim(product_type), ''), 'unspecified')"
ALL = "(SELECT bank_id, id, product_type, rate, updated_at, record_kind FROM campaigns UNION ALL SELECT bank_id, id, product_type, rate, updated_at, record_kind FROM products)"


def three(spark, d):
    return frame(spark, d, "campaigns"), frame(spark, d, "products"), frame(spark, d, "banks")


@query("a01_dashboard_summary", sql_with(f"""
SELECT count(DISTINCT bank_id) AS bank_count, count(*) FILTER (record_kind = 'campaign') AS campaign_count, count(*) FILTER (record_kind = 'product') AS product_count,
    count(*) AS record_count, max(updated_at) AS latest, round(avg(rate), 6) AS mean_rate FROM {ALL}""", "campaigns", "products"))
def a01(spark, d):
    return c.summary(frame(spark, d, "campaigns"), frame(spark, d, "products"))


@query("a02_counts_by_type", sql_with(f"SELECT {UNSPECIFIED} AS name, count(*) AS n FROM products GROUP BY 1", "products"))
def a02(spark, d):
    return c.counts_by(frame(spark, d, "products"), "product_type").orderBy(F.desc("n"), "name")


TOTALS = """, per AS (
    SELECT bank_id, count(*) FILTER (record_kind = 'campaign') AS campaigns, count(*) FILTER (record_kind = 'product') AS products, max(updated_at) AS latest
    FROM (SELECT bank_id, record_kind, updated_at FROM campaigns UNION ALL SELECT bank_id, record_kind, updated_at FROM products) GROUP BY 1
), totals AS (SELECT slug, coalesce(campaigns, 0) AS campaigns, coalesce(products, 0) AS products, latest FROM banks LEFT JOIN per USING (bank_id))
"""


@query("a03_bank_summary", sql_with(TOTALS + "SELECT * FROM totals", "campaigns", "products", "banks"))
def a03(spark, d):
    return c.bank_totals(*three(spark, d))


@query("a04_bank_shares", sql_with(TOTALS + """SELECT slug, CASE WHEN sum(campaigns) OVER () = 0 THEN 0.0 ELSE round(campaigns / sum(campaigns) OVER (), 4) END AS campaign_share,
    CASE WHEN sum(campaigns + products) OVER () = 0 THEN 0.0 ELSE round((campaigns + products) / sum(campaigns + products) OVER (), 4) END AS record_share FROM totals""", "campaigns", "products", "banks"))
def a04(spark, d):
    return c.bank_shares(c.bank_totals(*three(spark, d)))


@query("a05_type_distribution", sql_with(f"""
SELECT {UNSPECIFIED} AS product_type, count(*) FILTER (record_kind = 'campaign') AS campaigns, count(*) FILTER (record_kind = 'product') AS products, count(*) AS records,
    round(count(*) / sum(count(*)) OVER (), 4) AS share FROM {ALL} GROUP BY 1""", "campaigns", "products"))
def a05(spark, d):
    return c.type_distribution(frame(spark, d, "campaigns"), frame(spark, d, "products"))


@query("a06_freshness", sql_with("""SELECT (SELECT max(scraped_at) FROM campaigns) AS latest_scrape, (SELECT count(*) FROM campaigns WHERE scraped_at IS NULL) AS never_scraped,
    (SELECT max(updated_at) FROM products) AS latest_product""", "campaigns", "products"))
def a06(spark, d):
    return c.freshness(frame(spark, d, "campaigns"), frame(spark, d, "products"))


@query("a07_filter_currencies", sql_with("""SELECT currency, count(DISTINCT id) AS campaigns FROM (
    SELECT id, reward_currency AS currency FROM campaigns UNION ALL SELECT id, max_currency FROM campaigns) WHERE currency IS NOT NULL GROUP BY 1""", "campaigns"))
def a07(spark, d):
    return c.currency_counts(frame(spark, d, "campaigns"))


@query("a12_campaign_count_with_samples", sql_with("""SELECT slug, count(*) AS campaigns, list(id ORDER BY id)[1:3] AS samples FROM campaigns JOIN banks USING (bank_id) GROUP BY 1""", "campaigns", "banks"))
def a12(spark, d):
    """Counts in the store; of each bank's records only the three first ids are carried."""
    own = frame(spark, d, "campaigns").join(frame(spark, d, "banks"), "bank_id").select("slug", "id")
    first = own.withColumn("r", F.row_number().over(Window.partitionBy("slug").orderBy("id"))).where("r <= 3").groupBy("slug").agg(F.array_sort(F.collect_list("id")).alias("samples"))
    return own.groupBy("slug").agg(F.count("*").alias("campaigns")).join(first, "slug")


@query("f01_filtered_page", sql_with("""SELECT id, title, updated_at, (SELECT count(*) FROM campaigns JOIN banks USING (bank_id) WHERE slug IN ('nation_1', 'nation_2') AND product_type = '1-URGENT') AS total
FROM campaigns JOIN banks USING (bank_id) WHERE slug IN ('nation_1', 'nation_2') AND product_type = '1-URGENT' ORDER BY updated_at DESC, id LIMIT 20 OFFSET 5""", "campaigns", "banks"))
def f01(spark, d):
    own = c.filter_campaigns(frame(spark, d, "campaigns"), frame(spark, d, "banks"), slugs=["nation_1", "nation_2", "nation_1"], product_type="1-URGENT")
    return c.page(own.select("id", "title", "updated_at"), 20, 5)


@query("f02_either_currency", sql_with("SELECT id FROM campaigns WHERE reward_currency = 'TRY' OR max_currency = 'TRY'", "campaigns"))
def f02(spark, d):
    return c.filter_campaigns(frame(spark, d, "campaigns"), currency="TRY").select("id")


@query("f03_title_search", sql_with("""SELECT id, title FROM campaigns WHERE translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%er 1_%-urg%'""", "campaigns"))
def f03(spark, d):
    return c.filter_campaigns(frame(spark, d, "campaigns"), search="ER 1_%-Urg").select("id", "title")


@query("f04_curated_exclusion", sql_with("SELECT count(*) AS left_over FROM campaigns c WHERE NOT EXISTS (SELECT 1 FROM campaigns b WHERE b.id % 10 = 0 AND b.bank_id = c.bank_id AND b.title = c.title)", "campaigns"))
def f04(spark, d):
    own = frame(spark, d, "campaigns")
    return c.excluded(own, own.where("id % 10 = 0").select("bank_id", "title")).agg(F.count("*").alias("left_over"))


@query("f05_curated_flag", sql_with("SELECT id, id IN (SELECT id FROM campaigns WHERE amount > 400000) AS curated FROM campaigns", "campaigns"))
def f05(spark, d):
    own = frame(spark, d, "campaigns")
    flags = own.where("amount > 400000").select("id").distinct().withColumn("f", F.lit(True))
    return own.select("id").join(flags, "id", "left").select("id", F.coalesce("f", F.lit(False)).alias("curated"))


@query("f06_corpus_prefilter", sql_with("SELECT id FROM campaigns WHERE (product_type = '1-URGENT' OR product_type = '' OR product_type IS NULL) AND (financing_type = 'f2' OR coalesce(financing_type, '') = '')", "campaigns"))
def f06(spark, d):
    """The lexical corpus lets records without the field in."""
    own = frame(spark, d, "campaigns")
    return own.where(F.coalesce("product_type", F.lit("")).isin("1-URGENT", "") & F.coalesce("financing_type", F.lit("")).isin("f2", "")).select("id")


@query("f07_vector_filter", sql_with("SELECT id FROM campaigns WHERE product_type = '1-URGENT' AND financing_type IN ('f2', 'f3')", "campaigns"))
def f07(spark, d):
    """The vector index takes equal values only."""
    return frame(spark, d, "campaigns").where((F.col("product_type") == "1-URGENT") & F.col("financing_type").isin("f2", "f3")).select("id")


@query("f08_active_records", sql_with("SELECT id, coalesce(try_cast(substr(CAST(end_date AS VARCHAR), 1, 10) AS DATE) >= DATE '1999-06-01', true) AS active FROM offers", "offers"))
def f08(spark, d):
    return frame(spark, d, "offers").select("id", c.active(F.col("end_date"), F.lit("1999-06-01").cast("date")).alias("active"))


@query("f15_missing_fields", sql_with("SELECT id, coalesce(trim(product_type), '') = '' AND id % 3 <> 0 AS missing FROM campaigns", "campaigns"))
def f15(spark, d):
    """Missing is an empty value whose status says not stated or not extracted, not one that does not apply."""
    status = F.when(F.col("id") % 3 == 0, "NOT_APPLICABLE").when(F.col("id") % 3 == 1, "NOT_STATED").otherwise("EXTRACTION_FAILED")
    return frame(spark, d, "campaigns").select("id", ((F.coalesce(F.trim("product_type"), F.lit("")) == "") & status.isin("NOT_STATED", "EXTRACTION_FAILED")).alias("missing"))


@query("f21_annotation_queue", "SELECT doc_id FROM labels WHERE quality = 0 AND toxic = 0")
def f21(spark, d):
    return frame(spark, d, "labels").where("quality = 0 and toxic = 0").select("doc_id")


@query("f22_explorer_filter", sql_with("SELECT c.id FROM campaigns c JOIN banks USING (bank_id) WHERE lower(concat(name, ' ', title)) LIKE '%nation_3%' AND product_type = '2-HIGH'", "campaigns", "banks"))
def f22(spark, d):
    own = frame(spark, d, "campaigns").join(frame(spark, d, "banks"), "bank_id")
    return own.where(F.lower(F.concat_ws(" ", "name", "title")).contains("nation_3") & (F.col("product_type") == "2-HIGH")).select("id")


@query("f25_short_tokens", "SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda t: length(t) >= 3))::INT AS n FROM documents")
def f25(spark, d):
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return frame(spark, d, "documents").select("doc_id", F.size(F.filter(tokens, lambda t: F.length(t) >= 3)).alias("n"))


@query("f26_tiered_limits", sql_with("SELECT id, CASE WHEN amount >= 300000 THEN 120 WHEN amount >= 100000 THEN 60 ELSE 36 END AS max_term FROM campaigns", "campaigns"))
def f26(spark, d):
    return frame(spark, d, "campaigns").select("id", F.when(F.col("amount") >= 300000, 120).when(F.col("amount") >= 100000, 60).otherwise(36).alias("max_term"))


@query("f27_catalogue_expiry", sql_with("SELECT id FROM offers WHERE TIMESTAMP '1999-06-01 12:00:00' <= end_date + INTERVAL '1' DAY", "offers"))
def f27(spark, d):
    return frame(spark, d, "offers").where(F.lit("1999-06-01 12:00:00").cast("timestamp") <= F.col("end_date") + F.expr("INTERVAL 1 DAY")).select("id")


@query("j01_recent_with_bank", sql_with("SELECT c.id, b.slug FROM campaigns c JOIN banks b USING (bank_id) WHERE b.slug = 'nation_7'", "campaigns", "banks"))
def j01(spark, d):
    return c.filter_campaigns(frame(spark, d, "campaigns"), frame(spark, d, "banks"), slug="nation_7").join(frame(spark, d, "banks"), "bank_id").select("id", "slug")


@query("j02_banks_with_totals", sql_with("SELECT slug, count(id) AS n FROM banks LEFT JOIN campaigns USING (bank_id) GROUP BY 1", "campaigns", "banks"))
def j02(spark, d):
    per = frame(spark, d, "campaigns").groupBy("bank_id").agg(F.count("*").alias("n"))
    return frame(spark, d, "banks").join(per, "bank_id", "left").select("slug", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("j03_filter_bank_counts", sql_with("SELECT slug, count(*) AS n FROM banks JOIN campaigns USING (bank_id) GROUP BY 1", "campaigns", "banks"))
def j03(spark, d):
    return frame(spark, d, "campaigns").groupBy("bank_id").agg(F.count("*").alias("n")).join(frame(spark, d, "banks"), "bank_id").select("slug", "n")


@query("j04_unique_product", sql_with("""SELECT w.id, p.product_id FROM (SELECT id, bank_id, upper(title) AS title FROM products) w
LEFT JOIN (SELECT bank_id, lower(title) AS key, min(id) AS product_id FROM products GROUP BY 1, 2 HAVING count(*) = 1) p ON p.bank_id = w.bank_id AND p.key = lower(w.title)""", "products"))
def j04(spark, d):
    p = frame(spark, d, "products")
    return c.unique_product(p.select("id", "bank_id", F.upper("title").alias("title")), p).select("id", "product_id")


@query("j19_prune", sql_with("SELECT id FROM products WHERE id % 4 <> 1", "products"))
def j19(spark, d):
    p = frame(spark, d, "products")
    return c.keep_in_snapshot(p, p.where("id % 4 <> 1"), complete=True).select("id")


@query("j20_coverage", sql_with("""SELECT coalesce(a.bank_id, b.bank_id) AS bank_id, CASE WHEN a.bank_id IS NOT NULL AND b.bank_id IS NOT NULL THEN 'supported' WHEN a.bank_id IS NOT NULL THEN 'unsupported' ELSE 'stale' END AS status
FROM (SELECT DISTINCT bank_id FROM campaigns) a FULL JOIN (SELECT DISTINCT s_nationkey AS bank_id FROM supplier) b ON a.bank_id = b.bank_id""", "campaigns"))
def j20(spark, d):
    return c.coverage(frame(spark, d, "campaigns"), frame(spark, d, "supplier").select(F.col("s_nationkey").alias("bank_id")), "bank_id")


@query("j21_index_diff", """SELECT coalesce(a.doc_id, b.doc_id) AS id, CASE WHEN a.doc_id IS NULL THEN 'stale' ELSE 'changed' END AS action
FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 5 <> 0) a FULL JOIN (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '.' ELSE text END) AS h FROM documents WHERE doc_id % 3 <> 0) b USING (doc_id)
WHERE a.h IS DISTINCT FROM b.h""")
def j21(spark, d):
    t = frame(spark, d, "documents")
    wanted = t.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("hash"))
    indexed = t.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("hash"))
    return c.index_diff(wanted, indexed)


@query("j22_eligible_banks", sql_with("SELECT id FROM campaigns WHERE bank_id IN (SELECT bank_id FROM products WHERE rate > 0.045)", "campaigns", "products"))
def j22(spark, d):
    return frame(spark, d, "campaigns").join(frame(spark, d, "products").where("rate > 0.045").select("bank_id"), "bank_id", "left_semi").select("id")


@query("t01_ordered_page", sql_with("SELECT id, updated_at FROM campaigns ORDER BY updated_at DESC, id LIMIT 50 OFFSET 100", "campaigns"))
def t01(spark, d):
    return c.page(frame(spark, d, "campaigns").select("id", "updated_at"), 50, 100).drop("total")


@query("t02_recent_top_k", sql_with("SELECT id, slug, title, coalesce(scraped_at, updated_at) AS seen_at FROM campaigns JOIN banks USING (bank_id) ORDER BY seen_at DESC, id LIMIT 50", "campaigns", "banks"))
def t02(spark, d):
    return c.recent(frame(spark, d, "campaigns"), frame(spark, d, "banks"), 99)


@query("t03_ascii_order", sql_with("SELECT id, row_number() OVER (ORDER BY translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') COLLATE C, id) AS pos FROM products", "products").replace(" COLLATE C", ""))
def t03(spark, d):
    """Positions by folded title: ranges of the order are numbered apart, then offset by the ranges before."""
    key = ascii_lower("title")
    ordered = frame(spark, d, "products").select("id", key.alias("k")).repartitionByRange("k", "id").sortWithinPartitions("k", "id").withColumn("p", F.spark_partition_id())
    ranked = ordered.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("k", "id")))
    before = ranked.groupBy("p").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranked.join(F.broadcast(before.select("p", "before")), "p").select("id", (F.col("r") + F.col("before")).alias("pos"))


@query("t08_distinct_candidates", sql_with("SELECT slug, list(title ORDER BY first)[1:5] AS titles FROM (SELECT slug, title, min(id) AS first FROM products JOIN banks USING (bank_id) GROUP BY 1, 2) GROUP BY 1", "products", "banks"))
def t08(spark, d):
    own = frame(spark, d, "products").join(frame(spark, d, "banks"), "bank_id").groupBy("slug", "title").agg(F.min("id").alias("first"))
    top = own.withColumn("r", F.row_number().over(Window.partitionBy("slug").orderBy("first"))).where("r <= 5")
    return top.groupBy("slug").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "title"))), lambda x: x["title"]).alias("titles"))


@query("t12_seeded_sample", sql_with("SELECT id FROM (SELECT DISTINCT id FROM campaigns) ORDER BY sha256(concat('7:', CAST(id AS VARCHAR))), id LIMIT 25", "campaigns"))
def t12(spark, d):
    """The same rows on every run: the order of a hash of seed and key."""
    return frame(spark, d, "campaigns").select("id").distinct().orderBy(F.sha2(F.concat(F.lit("7:"), F.col("id").cast("string")), 256), "id").limit(25)


@query("u01_union_null_padded", sql_with("SELECT id, title, scraped_at, NULL::VARCHAR AS brand, record_kind FROM campaigns UNION ALL SELECT id, title, NULL, brand, record_kind FROM products", "campaigns", "products"))
def u01(spark, d):
    return c.records(frame(spark, d, "campaigns").select("id", "title", "scraped_at", "record_kind"), frame(spark, d, "products").select("id", "title", "brand", "record_kind"))


@query("u02_unpivot", sql_with("SELECT id, 'reward_currency' AS which, reward_currency AS currency FROM campaigns UNION ALL SELECT id, 'max_currency', max_currency FROM campaigns", "campaigns"))
def u02(spark, d):
    return frame(spark, d, "campaigns").select("id", "reward_currency", "max_currency").unpivot("id", ["reward_currency", "max_currency"], "which", "currency")


@query("u03_corpus_union", sql_with("SELECT concat('c', CAST(id AS VARCHAR)) AS id, 'campaign' AS source FROM campaigns UNION ALL SELECT concat('t', CAST(item_id AS VARCHAR)), 'term' FROM benchmark UNION ALL SELECT concat('p', CAST(page_id AS VARCHAR)), 'page' FROM pages", "campaigns"))
def u03(spark, d):
    parts = [("campaigns", "id", "c", "campaign"), ("benchmark", "item_id", "t", "term"), ("pages", "page_id", "p", "page")]
    a, b, e = (frame(spark, d, t).select(F.concat(F.lit(p), F.col(k).cast("string")).alias("id"), F.lit(s).alias("source")) for t, k, p, s in parts)
    return a.unionByName(b).unionByName(e)


@query("u04_ordered_distinct", """SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS words FROM (SELECT doc_id, w, min(p) AS p FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS p FROM documents) GROUP BY 1, 2) GROUP BY 1""")
def u04(spark, d):
    return frame(spark, d, "documents").select("doc_id", F.array_join(F.array_distinct(F.split("text", " ")), " ").alias("words"))


@query("u05_set_difference", sql_with("(SELECT bank_id FROM campaigns INTERSECT SELECT bank_id FROM products) EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000", "campaigns", "products"))
def u05(spark, d):
    """Banks with campaigns and products that no rich supplier is in."""
    rich = frame(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("bank_id"))
    return frame(spark, d, "campaigns").select("bank_id").intersect(frame(spark, d, "products").select("bank_id")).subtract(rich)


@query("u06_allow_list", "SELECT event_id, list_filter([event_type, CASE WHEN user_id % 2 = 0 THEN 'extra' ELSE 'view' END], lambda x: x NOT IN ('view', 'click', 'purchase')) AS unknown FROM events WHERE event_type NOT IN ('view', 'click', 'purchase') OR user_id % 2 = 0")
def u06(spark, d):
    """What is not on the list, duplicates aside."""
    names = F.array("event_type", F.when(F.col("user_id") % 2 == 0, "extra").otherwise("view"))
    return frame(spark, d, "events").select("event_id", F.array_except(names, F.array(*map(F.lit, ("view", "click", "purchase")))).alias("unknown")).where(F.size("unknown") > 0)


@query("w01_share_over_total", sql_with(f"SELECT {UNSPECIFIED} AS product_type, count(*) / sum(count(*)) OVER () AS share FROM campaigns GROUP BY 1", "campaigns"))
def w01(spark, d):
    return frame(spark, d, "campaigns").groupBy(or_unspecified("product_type").alias("product_type")).agg(F.count("*").alias("n")).select("product_type", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))
