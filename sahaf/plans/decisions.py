"""Versions, windows, comparison and quote queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sahaf.operators import offers as o
from sahaf.operators import ranking as r
from sahaf.operators import versions as v

from .registry import query
from .tables import frame, sql_with

HISTORY = """, flagged AS (
    SELECT *, CASE WHEN lag(event_id) OVER w IS NULL OR content_hash IS DISTINCT FROM lag(content_hash) OVER w THEN 1 ELSE 0 END AS changed FROM observations WINDOW w AS (PARTITION BY record_id ORDER BY observed_at, event_id)
), numbered AS (SELECT *, sum(changed) OVER (PARTITION BY record_id ORDER BY observed_at, event_id)::BIGINT AS source_version FROM flagged),
grouped AS (SELECT record_id, source_version, min(content_hash) AS content_hash, min(observed_at) AS valid_from, max(observed_at) AS last_seen_at, count(*) AS occurrence_count FROM numbered GROUP BY 1, 2),
versions AS (SELECT record_id, source_version, content_hash, valid_from, lead(valid_from) OVER v AS valid_to,
    CASE WHEN lead(valid_from) OVER v IS NOT NULL THEN concat(record_id, ':', source_version + 1) END AS superseded_by, lead(valid_from) OVER v IS NULL AS is_current, occurrence_count, last_seen_at
    FROM grouped WINDOW v AS (PARTITION BY record_id ORDER BY source_version))
"""


@query("w02_version_history", sql_with(HISTORY + "SELECT * FROM versions", "observations"))
def w02(spark, d):
    return v.history(frame(spark, d, "observations"))


@query("w12_current_versions", sql_with(HISTORY + "SELECT record_id, source_version FROM versions WHERE is_current", "observations"))
def w12(spark, d):
    return v.history(frame(spark, d, "observations")).where("is_current").select("record_id", "source_version")


@query("w12_versions_as_of", sql_with(HISTORY + "SELECT record_id, content_hash FROM versions WHERE valid_from <= TIMESTAMP '2024-01-15 00:00:00' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-15 00:00:00')", "observations"))
def w12b(spark, d):
    return v.as_of(v.history(frame(spark, d, "observations")), "2024-01-15 00:00:00").select("record_id", "content_hash")


@query("j17_compare_and_set", sql_with(HISTORY + """SELECT record_id, c.content_hash, c.source_version, CASE WHEN u.h = c.content_hash AND u.n = c.source_version THEN u.h || '!' END AS payload,
    CASE WHEN u.h IS NULL THEN 'untouched' WHEN u.h = c.content_hash AND u.n = c.source_version THEN 'applied' ELSE 'stale' END AS outcome
FROM versions c LEFT JOIN (SELECT record_id, content_hash AS h, source_version AS n FROM versions WHERE valid_from < TIMESTAMP '2024-01-20' AND (valid_to IS NULL OR valid_to >= TIMESTAMP '2024-01-20') AND record_id LIKE '%1%') u USING (record_id) WHERE c.is_current""", "observations"))
def j17(spark, d):
    h = v.history(frame(spark, d, "observations"))
    old = h.where("valid_from < timestamp'2024-01-20' and (valid_to is null or valid_to >= timestamp'2024-01-20') and record_id like '%1%'")
    updates = old.select("record_id", F.col("content_hash").alias("expected_hash"), F.col("source_version").alias("expected_version"), F.concat("content_hash", F.lit("!")).alias("payload"))
    return v.apply_updates(h.where("is_current").select("record_id", "content_hash", "source_version"), updates, ["record_id"])


@query("w03_rank_first_occurrence", "SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY first, event_type) AS rank FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2)")
def w03(spark, d):
    once = frame(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    return once.select("user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("first", "event_type")).cast("long").alias("rank"))


@query("w04_best_source_per_key", """SELECT user_id, event_id, coalesce(s, 0.0) AS value, first_pos FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s IS NULL, s DESC, event_id) AS r, min(event_id) OVER (PARTITION BY user_id) AS first_pos
    FROM (SELECT user_id, event_id, CASE WHEN event_type <> 'error' THEN value END AS s FROM events)) WHERE r = 1""")
def w04(spark, d):
    e = frame(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    return r.best_source(e, "user_id", "value", "event_id").select("user_id", "event_id", "value", "first_pos")


@query("w05_second_dedupe", sql_with("SELECT min(id) AS id, count(*) AS n FROM products GROUP BY bank_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))", "products"))
def w05(spark, d):
    key = F.trim(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", " "))
    return frame(spark, d, "products").groupBy("bank_id", key.alias("k")).agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "n")


@query("w06_balanced_top_two", sql_with("SELECT bank_id, id FROM (SELECT *, row_number() OVER (PARTITION BY bank_id ORDER BY amount DESC, id) AS r FROM campaigns WHERE bank_id IN (3, 1, 7)) WHERE r <= 2", "campaigns"))
def w06(spark, d):
    return r.first_per_key(frame(spark, d, "campaigns").where("bank_id in (3, 1, 7)"), ["bank_id"], [F.desc("amount"), F.col("id")], 2).select("bank_id", "id")


@query("w07_url_representative", """SELECT key, page_id, n FROM (SELECT split_part(split_part(url, '?', 1), '#', 1) AS key, page_id, count(*) OVER (PARTITION BY split_part(split_part(url, '?', 1), '#', 1)) AS n,
    row_number() OVER (PARTITION BY split_part(split_part(url, '?', 1), '#', 1) ORDER BY length(html) < 1500, page_id) AS r FROM pages) WHERE r = 1""")
def w07(spark, d):
    """Of each url's rows the first without an error, else the first."""
    key = F.substring_index(F.substring_index("url", "?", 1), "#", 1)
    p = frame(spark, d, "pages").select(key.alias("key"), "page_id", (F.length("html") < 1500).alias("bad")).withColumn("n", F.count("*").over(Window.partitionBy("key")))
    return r.first_per_key(p, ["key"], [F.col("bad"), F.col("page_id")]).select("key", "page_id", "n")


@query("w08_freshest_per_bank", sql_with("SELECT bank_id, id FROM (SELECT *, row_number() OVER (PARTITION BY bank_id ORDER BY end_date DESC, id) AS r FROM offers) WHERE r = 1", "offers"))
def w08(spark, d):
    return frame(spark, d, "offers").groupBy("bank_id").agg(F.max("end_date").alias("end_date"), F.max_by("id", F.struct("end_date")).alias("any")).drop("any").join(frame(spark, d, "offers"), ["bank_id", "end_date"]).groupBy("bank_id").agg(F.min("id").alias("id"))


@query("w09_best_quote_per_term", sql_with("SELECT term_months, rate, id FROM (SELECT *, row_number() OVER (PARTITION BY term_months ORDER BY rate, id) AS r FROM offers WHERE rate IS NOT NULL AND term_months IS NOT NULL) WHERE r = 1", "offers"))
def w09(spark, d):
    best = frame(spark, d, "offers").where("rate is not null and term_months is not null").groupBy("term_months").agg(F.min(F.struct("rate", "id")).alias("b"))
    return best.select("term_months", "b.rate", "b.id")


@query("w13_label_priority", "SELECT conv_id, min_by(text, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END * 1000000 + turn) AS text FROM conversations GROUP BY 1")
def w13(spark, d):
    priority = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    return frame(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", F.struct(priority.alias("p"), "turn")).alias("text"))


@query("a13_extrema_with_ties", sql_with("SELECT currency, id, rate FROM (SELECT *, min(rate) OVER (PARTITION BY coalesce(currency, '-')) AS low FROM (SELECT id, coalesce(currency, '-') AS currency, rate FROM offers WHERE rate IS NOT NULL)) WHERE rate = low", "offers"))
def a13(spark, d):
    return r.extrema(frame(spark, d, "offers").select("id", F.coalesce("currency", F.lit("-")).alias("currency"), "rate"), "currency", "rate")


@query("a14_min_max_scores", sql_with("""SELECT id, CASE WHEN rate IS NULL THEN NULL WHEN count(rate) OVER w = 1 OR min(rate) OVER w = max(rate) OVER w THEN 0.5 ELSE round((max(rate) OVER w - rate) / (max(rate) OVER w - min(rate) OVER w), 6) END AS score FROM offers WINDOW w AS (PARTITION BY bank_id)""", "offers"))
def a14(spark, d):
    f = frame(spark, d, "offers")
    return f.select("id", F.round(r.min_max(f, "rate", ["bank_id"], lower_is_better=True), 6).alias("score"))


#: What is asked for in the queries below, and the same in SQL: criteria with their values and weights, terms of the match.
FINANCING = o.Wanted("financing", "TRY", duration_days=600, financing_type="housing", amount=50000.0)
INVESTMENT = o.Wanted("investment", "TRY", duration_days=360, eligibility="retiree", amount=20000.0)
CAMPAIGN = o.Wanted("card", "TRY")
OF_FINANCING = [("rate", "rate", 0.45), ("amount", "max_amount", 0.30), ("fee", "CASE WHEN fee = 'masrafsız' THEN 1.0 END", 0.15), ("eligibility", "CASE WHEN audience IS NOT NULL THEN 1.0 END", 0.10)]
OF_INVESTMENT = [("rate", "rate", 0.60), ("amount", "max_amount", 0.20), ("duration", "duration_days", 0.10), ("eligibility", "CASE WHEN audience IS NOT NULL THEN 1.0 END", 0.10)]
OF_CAMPAIGN = [("discount", "discount", 0.35), ("reward", "reward", 0.35), ("installment", "instalments", 0.20), ("eligibility", "CASE WHEN audience IS NOT NULL THEN 1.0 END", 0.10)]
MATCH_FINANCING = [("product_type = 'financing'", 0.35), ("financing_type = 'housing'", 0.20), ("CASE WHEN duration_days IS NOT NULL THEN greatest(0.0, 1 - abs(duration_days - 600) / 600.0::DOUBLE) END", 0.15), ("CASE WHEN max_amount IS NOT NULL THEN greatest(0.0, 1 - abs(max_amount - 50000) / 50000.0::DOUBLE) END", 0.10)]


def shown(x: str) -> str:
    """x to four places, rounded from the digits that a double shows, as Spark rounds."""
    return f"round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 20)), 4)::DOUBLE"


ADVANTAGE, MATCH = shown("CASE WHEN k > 0 THEN t / k END"), shown("CASE WHEN mk > 0 THEN mt / mk END")


def compared(kind: str, criteria: list[tuple[str, str, float]], match: list[tuple[str, float]] = (), extra: str = "") -> str:
    """CTEs over offers: scored has k (known weight), t (weighted sum), and the match's mk and mt."""
    values = ", ".join(f"CAST({x} AS DOUBLE) AS v_{c}" for c, x, _ in criteria)
    lower = lambda c: f"(max(v_{c}) OVER w - v_{c})" if kind == "financing" and c == "rate" else f"(v_{c} - min(v_{c}) OVER w)"
    scores = ", ".join(f"CASE WHEN v_{c} IS NULL THEN NULL WHEN count(v_{c}) OVER w = 1 OR min(v_{c}) OVER w = max(v_{c}) OVER w THEN 0.5::DOUBLE ELSE {lower(c)} / (max(v_{c}) OVER w - min(v_{c}) OVER w) END AS s_{c}" for c, _, _ in criteria)
    known = " + ".join(f"CASE WHEN s_{c} IS NULL THEN 0 ELSE {w}::DOUBLE END" for c, _, w in criteria)
    total = " + ".join(f"coalesce(s_{c}, 0) * {w}::DOUBLE" for c, _, w in criteria)
    mk = " + ".join(f"CASE WHEN ({x}) IS NULL THEN 0 ELSE {w}::DOUBLE END" for x, w in match) or "0"
    mt = " + ".join(f"coalesce(({x})::DOUBLE, 0) * {w}::DOUBLE" for x, w in match) or "0"
    return f""", fit AS (SELECT *, {values} FROM offers WHERE coalesce(product_type = '{kind}', true) AND coalesce(currency = 'TRY', true) {extra}),
scaled AS (SELECT *, {scores} FROM fit WINDOW w AS (PARTITION BY bank_id)), scored AS (SELECT *, {known} AS k, {total} AS t, {mk} AS mk, {mt} AS mt FROM scaled)
"""


@query("a15_weighted_scores", sql_with(compared("investment", OF_INVESTMENT, extra="AND coalesce(audience = 'retiree', true)") + f"SELECT id, {ADVANTAGE} AS advantage, round(k, 4) AS confidence, CASE WHEN s_duration IS NOT NULL THEN {shown('round(s_duration, 4) * 0.1::DOUBLE / k')} END AS duration_part, len(list_filter([s_rate, s_amount, s_duration, s_eligibility], lambda x: x IS NULL))::INT AS missing FROM scored", "offers"))
def a15(spark, d):
    """Advantage and confidence, what the duration adds, and how many criteria are missing."""
    part = F.get(F.filter("criteria", lambda x: x["criterion"] == "duration"), 0)["contribution"]
    return o.compare(frame(spark, d, "offers"), INVESTMENT, ["bank_id"]).select("id", "advantage", "confidence", part.alias("duration_part"), F.size("missing").alias("missing"))


@query("a16_match_scores", sql_with(compared("financing", OF_FINANCING, MATCH_FINANCING) + f"SELECT id, coalesce({MATCH}, 0.0) AS match FROM scored", "offers"))
def a16(spark, d):
    return o.compare(frame(spark, d, "offers"), FINANCING, ["bank_id"]).select("id", "match")


@query("f12_exclusion_reasons", sql_with("SELECT id, CASE WHEN product_type <> 'investment' THEN 'product_type_mismatch' WHEN currency <> 'TRY' THEN 'currency_mismatch' WHEN audience <> 'retiree' THEN 'eligibility_mismatch' END AS reason FROM offers", "offers"))
def f12(spark, d):
    return frame(spark, d, "offers").select("id", o.exclusion_reason(INVESTMENT).alias("reason"))


@query("q18_comparison", sql_with(compared("financing", OF_FINANCING, MATCH_FINANCING) + f""", final AS (SELECT bank_id, id, {ADVANTAGE} AS advantage, round(k, 4) AS confidence, coalesce({MATCH}, 0.0) AS match,
    CASE WHEN s_rate IS NULL AND s_amount IS NULL THEN 'Yeterli karşılaştırılabilir alan yok' ELSE concat_ws(', ', CASE WHEN s_rate IS NOT NULL THEN 'düşük kâr payı oranı' END, CASE WHEN s_amount IS NOT NULL THEN 'açık tutar' END) END AS reason FROM scored)
SELECT bank_id, id, row_number() OVER (PARTITION BY bank_id ORDER BY advantage IS NULL, confidence DESC, advantage DESC NULLS LAST, match DESC, id) AS pos, reason FROM final""", "offers"))
def q18(spark, d):
    """Each bank's offers in order of comparison, with the words for it."""
    c = o.compare(frame(spark, d, "offers"), FINANCING, ["bank_id"])
    return c.select("bank_id", "id", F.row_number().over(Window.partitionBy("bank_id").orderBy(*o.order_keys())).cast("long").alias("pos"), "reason")


@query("q18_campaign_comparison", sql_with(compared("card", OF_CAMPAIGN) + f"SELECT id, {ADVANTAGE} AS advantage, round(k, 4) AS confidence FROM scored", "offers"))
def q18_campaigns(spark, d):
    return o.compare(frame(spark, d, "offers"), CAMPAIGN, ["bank_id"]).select("id", "advantage", "confidence")


@query("j18_pair_keys", sql_with(""", top AS (SELECT bank_id, product_type, id, n_regionkey FROM offers JOIN supplier ON s_suppkey = bank_id JOIN nation ON n_nationkey = s_nationkey WHERE product_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY bank_id, product_type ORDER BY max_amount DESC NULLS LAST, id) = 1)
SELECT a.product_type, concat(a.id, ':', b.id) AS key FROM top a JOIN top b ON a.product_type = b.product_type AND a.n_regionkey = b.n_regionkey AND a.id < b.id""", "offers"))
def j18(spark, d):
    """Keys of all pairs of a comparison's results: of each product, one result a bank, among the banks of one region."""
    region = frame(spark, d, "supplier").join(frame(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("bank_id"), "n_regionkey")
    best = r.first_per_key(frame(spark, d, "offers").where("product_type is not null"), ["bank_id", "product_type"], [F.desc_nulls_last("max_amount"), F.col("id")], 1)
    top = best.join(region, "bank_id").select("product_type", "n_regionkey", "id")
    return r.pairs_within(top, ["product_type", "n_regionkey"], "id").select("product_type", F.concat_ws(":", "id", "other").alias("key"))


@query("t04_comparison_order", sql_with("SELECT id, row_number() OVER (PARTITION BY bank_id ORDER BY rate IS NULL, max_amount DESC NULLS LAST, rate DESC NULLS LAST, id) AS pos FROM offers", "offers"))
def t04(spark, d):
    w = Window.partitionBy("bank_id").orderBy(F.col("rate").isNull(), F.desc_nulls_last("max_amount"), F.desc_nulls_last("rate"), "id")
    return frame(spark, d, "offers").select("id", F.row_number().over(w).cast("long").alias("pos"))


ELIGIBLE = "product_type = 'financing' AND rate IS NOT NULL AND coalesce(max_amount >= 30000, true) AND coalesce(term_months >= 12, true) AND coalesce(CAST(end_date AS DATE) >= DATE '1999-06-01', true)"
QUOTES = f""", fresh AS (SELECT bank_id, rate * 100 AS offer_rate FROM (SELECT *, row_number() OVER (PARTITION BY bank_id ORDER BY end_date DESC, id) AS r FROM offers WHERE {ELIGIBLE}) WHERE r = 1),
official AS (SELECT s_suppkey AS bank_id, (s_suppkey % 5)::DOUBLE AS official_rate FROM supplier WHERE s_suppkey % 3 = 0),
rated AS (SELECT s_suppkey AS bank_id, official_rate, offer_rate, coalesce(official_rate, offer_rate) AS p FROM supplier LEFT JOIN official ON official.bank_id = s_suppkey LEFT JOIN fresh ON fresh.bank_id = s_suppkey),
monthly AS (SELECT *, round(CASE WHEN p = 0 THEN 30000.0::DOUBLE / 12 ELSE 30000.0::DOUBLE * (p / 100) * pow(1 + p / 100, 12) / (pow(1 + p / 100, 12) - 1) END, 2) AS monthly FROM rated),
quotes AS (SELECT bank_id, CASE WHEN official_rate IS NOT NULL THEN 'official' WHEN offer_rate IS NOT NULL THEN 'calculated' ELSE 'unsupported' END AS status, round(p, 6) AS percent, monthly, round(monthly * 12, 2) AS total, round((pow(1 + p / 100, 12) - 1) * 100, 4) AS annual FROM monthly)
"""


def quoted(spark, d):
    banks = frame(spark, d, "supplier").select(F.col("s_suppkey").alias("bank_id"))
    official = banks.where("bank_id % 3 = 0").select("bank_id", (F.col("bank_id") % 5).cast("double").alias("percent"))
    return o.quotes(banks, official, frame(spark, d, "offers"), 30000.0, 12, F.lit("1999-06-01").cast("date"))


@query("f09_quote_eligibility", sql_with(f"SELECT id FROM offers WHERE {ELIGIBLE}", "offers"))
def f09(spark, d):
    return o.eligible(frame(spark, d, "offers"), 30000.0, 12, F.lit("1999-06-01").cast("date")).select("id")


@query("j07_quote_per_bank", sql_with(QUOTES + "SELECT bank_id, status FROM quotes", "offers"))
def j07(spark, d):
    return quoted(spark, d).select("bank_id", "status")


@query("q19_instalment_quotes", sql_with(QUOTES + "SELECT * FROM quotes", "offers"))
def q19(spark, d):
    return quoted(spark, d)


@query("a34_quote_coverage", sql_with(QUOTES + "SELECT status, count(*) AS n FROM quotes GROUP BY 1", "offers"))
def a34(spark, d):
    return quoted(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query("t05_quote_order", sql_with(QUOTES + "SELECT bank_id, row_number() OVER (ORDER BY status = 'unsupported', monthly IS NULL, coalesce(monthly, 0), bank_id) AS pos FROM quotes", "offers"))
def t05(spark, d):
    return r.positions(quoted(spark, d).select("bank_id", (F.col("status") == "unsupported").alias("last"), F.col("monthly").isNull().alias("unknown"), F.coalesce("monthly", F.lit(0.0)).alias("m")), ["last", "unknown", "m", "bank_id"]).select("bank_id", "pos")


@query("f23_chartable_quotes", sql_with(QUOTES + "SELECT bank_id FROM quotes WHERE status <> 'unsupported' AND monthly IS NOT NULL", "offers"))
def f23(spark, d):
    return quoted(spark, d).where("status <> 'unsupported' and monthly is not null").select("bank_id")


@query("f24_verified_quotes", sql_with(QUOTES + "SELECT bank_id FROM quotes WHERE status = 'official' AND isfinite(monthly) AND isfinite(total)", "offers"))
def f24(spark, d):
    return quoted(spark, d).where((F.col("status") == "official") & r.finite(F.col("monthly")).isNotNull() & r.finite(F.col("total")).isNotNull()).select("bank_id")


BANDS = [(0, 1, 12, None, 50000.0, 1.5), (1, 10, 24, 20000.0, None, 1.9), (2, 1, 36, None, None, 2.4), (3, 37, 48, 0.0, 60000.0, 2.9)]
BAND_SQL = ", bands(pos, min_months, max_months, min_amount, max_amount, band_rate) AS (VALUES " + ", ".join(str(b).replace("None", "NULL") for b in BANDS) + ")"


@query("f10_rate_band", sql_with(BAND_SQL + """SELECT o.id AS request_id, min_by(band_rate, pos)::DOUBLE AS band_rate FROM offers o LEFT JOIN bands b ON term_months BETWEEN min_months AND max_months
    AND coalesce(o.max_amount >= b.min_amount, true) AND coalesce(o.max_amount <= b.max_amount, true) GROUP BY 1""", "offers"))
def f10(spark, d):
    bands = spark.createDataFrame(BANDS, "pos int, min_months int, max_months int, min_amount double, max_amount double, band_rate double")
    return o.first_band(frame(spark, d, "offers").select(F.col("id").alias("request_id"), F.col("term_months").alias("months"), F.col("max_amount").alias("amount")), bands)


@query("f11_tiered_eligibility", sql_with("SELECT id, coalesce(term_months, 0) <= CASE WHEN max_amount <= 30000 THEN 48 WHEN max_amount <= 60000 THEN 36 ELSE 24 END AS ok FROM offers", "offers"))
def f11(spark, d):
    limit = F.when(F.col("max_amount") <= 30000, 48).when(F.col("max_amount") <= 60000, 36).otherwise(24)
    return frame(spark, d, "offers").select("id", (F.coalesce("term_months", F.lit(0)) <= limit).alias("ok"))


@query("n07_annuity", sql_with("SELECT id, round(CASE WHEN rate = 0 THEN max_amount / term_months ELSE max_amount * rate * pow(1 + rate, term_months) / (pow(1 + rate, term_months) - 1) END, 6) AS monthly FROM offers WHERE term_months > 0", "offers"))
def n07(spark, d):
    return frame(spark, d, "offers").where("term_months > 0").select("id", F.round(o.instalment(F.col("max_amount"), F.col("term_months"), F.col("rate") * 100), 6).alias("monthly"))


@query("n08_annual_rate", sql_with("SELECT id, round((pow(1 + rate, 12) - 1) * 100, 4) AS annual FROM offers", "offers"))
def n08(spark, d):
    return frame(spark, d, "offers").select("id", F.round(o.annual_cost(F.col("rate") * 100), 4).alias("annual"))


@query("n09_taxed_rate", sql_with("SELECT id, round(rate * CASE WHEN product_type = 'financing' THEN 1.30 WHEN product_type = 'investment' THEN 1.15 ELSE 1 END, 6) AS taxed FROM offers", "offers"))
def n09(spark, d):
    levy = F.when(F.col("product_type") == "financing", 1.30).when(F.col("product_type") == "investment", 1.15).otherwise(1.0)
    return frame(spark, d, "offers").select("id", F.round(F.col("rate") * levy, 6).alias("taxed"))


@query("q12_term_range_quotes", sql_with("""SELECT id, months, round(CASE WHEN rate = 0 THEN 30000.0 / months ELSE 30000.0::DOUBLE * rate * pow(1 + rate, months) / (pow(1 + rate, months) - 1) END, 2) AS monthly
FROM offers, (SELECT unnest(range(12, 16))::INT AS months) WHERE rate IS NOT NULL AND product_type = 'financing'""", "offers"))
def q12(spark, d):
    own = frame(spark, d, "offers").where("rate is not null and product_type = 'financing'")
    return own.select("id", "rate", F.explode(F.sequence(F.lit(12), F.lit(15))).alias("months")).select("id", "months", F.round(o.instalment(F.lit(30000.0), F.col("months"), F.col("rate") * 100), 2).alias("monthly"))
