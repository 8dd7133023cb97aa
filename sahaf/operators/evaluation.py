"""Scores of classifications, spans, routes and calibration; coverage and quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(F.round(a / b, digits))


def classification(pairs: DataFrame) -> DataFrame:
    """(label, support, precision, recall, f1) of rows (gold, predicted)."""
    long = pairs.select(F.explode(F.array(F.struct(F.col("gold").alias("label"), (F.col("gold") == F.col("predicted")).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), F.lit(1).cast("long").alias("support")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("tp"), (F.col("gold") != F.col("predicted")).cast("long").alias("fp"), F.lit(0).cast("long").alias("support")))).alias("x")).select("x.*")
    sums = long.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("support").alias("support"))
    return sums.select("label", "support", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("support")).alias("f1"))


def overall(pairs: DataFrame) -> DataFrame:
    """accuracy, macro and weighted F1 in one row."""
    by = classification(pairs)
    return by.agg(F.round(F.sum(F.col("recall") * F.col("support")) / F.sum("support"), 4).alias("accuracy"), F.round(F.avg("f1"), 4).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 4).alias("weighted_f1"))


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("gold", "predicted").agg(F.count("*").alias("n"))


def multilabel(rows: DataFrame) -> DataFrame:
    """micro and macro F1 and exact matches of rows (gold, predicted), both arrays."""
    labels = rows.select(F.explode(F.array_union("gold", "predicted")).alias("label"), "gold", "predicted")
    g, p = F.array_contains("gold", F.col("label")), F.array_contains("predicted", F.col("label"))
    by = labels.groupBy("label").agg(F.sum((g & p).cast("long")).alias("tp"), F.sum((~g & p).cast("long")).alias("fp"), F.sum((g & ~p).cast("long")).alias("fn"))
    exact = rows.agg(F.round(F.avg((F.array_sort("gold") == F.array_sort("predicted")).cast("double")), 6).alias("exact"))
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    total = 2 * F.sum("tp") + F.sum("fp") + F.sum("fn")
    return by.agg(ratio(2 * F.sum("tp"), total).alias("micro_f1"), F.round(F.avg(f1), 4).alias("macro_f1")).crossJoin(exact)


def spans(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(label, precision, recall, f1) of exact spans (doc, start, end, label)."""
    keys = ["doc", "start", "end", "label"]
    both = gold.select(*keys).distinct().withColumn("g", F.lit(1)).join(predicted.select(*keys).distinct().withColumn("p", F.lit(1)), keys, "full_outer")
    s = both.groupBy("label").agg(F.count(F.expr("g + p")).alias("tp"), F.count("g").alias("g"), F.count("p").alias("p"))
    return s.select("label", ratio(F.col("tp"), F.col("p")).alias("precision"), ratio(F.col("tp"), F.col("g")).alias("recall"), ratio(2 * F.col("tp"), F.col("g") + F.col("p")).alias("f1"))


def calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error of rows (confidence, correct): bins hold both of their ends, so ends count twice."""
    ranges = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    binned = rows.select("confidence", "correct", ranges).where(F.col("confidence").between(F.col("bin") / bins, (F.col("bin") + 1) / bins))
    per = binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.avg(F.col("correct").cast("double")).alias("a"))
    total = rows.agg(F.count("*").alias("total"))
    return per.crossJoin(F.broadcast(total)).agg(F.coalesce(F.round(F.sum(F.abs(F.col("a") - F.col("c")) * F.col("n") / F.col("total")), 6), F.lit(0.0)).alias("ece"))


def event_summary(events: DataFrame, dimensions: list[str] | None = None) -> DataFrame:
    """By event: count, failures, their rate, the latencies at nearest rank of 50 and 95 of 100, and for every dimension
    how often each of its values occurs (`field=value: n`, in order); null values don't count."""
    rank = lambda p: F.expr(f"round(percentile_disc({p}) WITHIN GROUP (ORDER BY latency), 3)")
    rate = F.round(F.avg(F.col("failed").cast("double")), 4).alias("error_rate")
    own = events.groupBy("event").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("errors"), rate, rank(0.5).alias("p50"), rank(0.95).alias("p95"))
    if not dimensions:
        return own
    named = F.filter(F.array(*(F.struct(F.lit(d).alias("field"), F.col(d).cast("string").alias("value")) for d in dimensions)), lambda x: x["value"].isNotNull())
    counted = events.select("event", F.inline(named)).groupBy("event", "field", "value").agg(F.count("*").alias("n"))
    lists = counted.groupBy("event").agg(F.array_sort(F.collect_list(F.concat("field", F.lit("="), "value", F.lit(": "), F.col("n").cast("string")))).alias("dimensions"))
    return own.join(lists, "event", "left").withColumn("dimensions", F.coalesce("dimensions", F.array().cast("array<string>")))


def kpi_report(values: DataFrame, targets: dict[str, float]) -> DataFrame:
    """(kpi, value, target, passed, all_passed, synthetic) of one row of values: a missing value doesn't pass; with
    synthetic rows among the measured the report says so."""
    each = F.array(*(F.struct(F.lit(k).alias("kpi"), F.round(F.col(k).cast("double"), 6).alias("value"), F.lit(float(t)).alias("target"), F.coalesce(F.col(k) >= t, F.lit(False)).alias("passed")) for k, t in targets.items()))
    rows = values.select("synthetic", each.alias("x"))
    return rows.select(F.explode("x").alias("v"), F.forall("x", lambda v: v["passed"]).alias("all_passed"), (F.coalesce("synthetic", F.lit(0)) > 0).alias("synthetic")).select("v.*", "all_passed", "synthetic")


#: The answer that says that the sources don't tell.
FALLBACK = "Bu bilgi sağlanan dokümanlarda bulunmamaktadır."
CODES = r"(?<![\p{L}\p{N}_])(?:%?\d[\d.,/-]*|[A-ZÇĞİÖŞÜ][A-ZÇĞİÖŞÜ0-9_-]{3,})(?![\p{L}\p{N}_])"


def answer_tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9çğıöşü%]+"), F.lit(0))


def _shared(a: Column, b: Column) -> Column:
    """How many words two arrays share, each as often as it stands in both."""
    times = lambda of, w: F.size(F.filter(of, lambda x: x == w))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, w: n + F.least(times(a, w), times(b, w)))


def answer_score(answer: Column, gold: Column, facts: Column, evidence: Column) -> Column:
    """0.68 of the facts that an answer covers and 0.32 of its token F1 with the gold one, less 0.08 for each number or code
    that neither evidence nor gold has (0.35 at most) and 0.08 if it is too long; where the gold answer is that the
    sources don't tell, only that answer scores.  Nulls are empty texts."""
    text = F.trim(F.coalesce(answer, F.lit("")))
    given, wanted = answer_tokens(text), answer_tokens(F.coalesce(gold, F.lit("")))
    said = F.array_join(given, " ")
    covered = F.size(F.filter(facts, lambda f: F.contains(said, F.array_join(answer_tokens(f), " "))))
    coverage = F.when(F.size(facts) > 0, covered / F.size(facts)).otherwise(1.0)
    f1 = F.when((F.size(given) == 0) | (F.size(wanted) == 0), (F.size(given) == F.size(wanted)).cast("double")).otherwise(2 * _shared(given, wanted) / (F.size(given) + F.size(wanted)))
    codes = lambda x: F.transform(F.regexp_extract_all(x, F.lit(CODES), F.lit(0)), lambda c: F.lower(c))
    known = codes(F.concat_ws(" ", F.coalesce(evidence, F.lit("")), F.coalesce(gold, F.lit(""))))
    invented = F.size(F.array_except(codes(text), known))
    long = F.when(F.length(text) > F.greatest(F.lit(900), 2 * F.length(F.coalesce(gold, F.lit("")))), 0.08).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.68 * coverage + 0.32 * f1 - F.least(F.lit(0.35), 0.08 * invented) - long))
    return F.round(F.when(F.trim(gold) == FALLBACK, (text == FALLBACK).cast("double")).otherwise(score), 6)


def counters(df: DataFrame, columns: list[str]) -> DataFrame:
    """(dimension, value, n) of several columns in one pass."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("-")).alias("value")) for c in columns))).alias("x")).select("x.*")
    return long.groupBy("dimension", "value").agg(F.count("*").alias("n"))


def issues(df: DataFrame, rules: dict[str, tuple[str, Column]]) -> Column:
    """The violations of a row: rules give, by field, a severity and when it is violated."""
    return F.array_compact(F.array(*(F.when(bad, F.struct(F.lit(s).alias("severity"), F.lit(f).alias("field"))) for f, (s, bad) in rules.items())))


def leakage(df: DataFrame, family: str, split: str) -> DataFrame:
    """Families that are in more than one split."""
    return df.groupBy(family).agg(F.countDistinct(split).alias("splits")).where("splits > 1")


#: A comment or an element's tag that is left in a text.
TAGS = r"<!--|</?\s*[A-Za-z][A-Za-z0-9]*(\s[^>]*|/)?>"


def record_rules() -> dict[tuple[str, str], Column]:
    """What makes a record (bank_slug, bank_name, title, content, source_url, start_date, end_date, summary) wrong or doubtful, in order."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    both = (text("start_date") != "") & (text("end_date") != "")
    return {
        ("error", "bank_slug"): text("bank_slug") == "",
        ("error", "bank_name"): text("bank_name") == "",
        ("error", "title"): F.length(text("title")) < 5,
        ("error", "content_length"): F.length(text("content")) < 80,
        ("error", "content_tags"): text("content").rlike(TAGS),
        ("error", "source_url"): ~text("source_url").rlike(r"^(?i:https)://[^/?#]+"),
        ("error", "date_order"): both & (F.col("start_date") > F.col("end_date")),
        ("warning", "date_range"): ~both,
        ("warning", "summary"): text("summary") == "",
        ("warning", "summary_length"): F.length(text("summary")) > 500,
    }


def record_issues(records: DataFrame) -> DataFrame:
    """records with issues (severity, field): the rules' findings, and repeated ids and urls as errors."""
    found = [F.when(broken, F.struct(F.lit(severity).alias("severity"), F.lit(field).alias("field"))) for (severity, field), broken in record_rules().items()]
    for c, field in (("id", "id"), ("source_url", "source_url_repeated")):  # counted apart, so that a frequent value is never gathered
        seen = records.groupBy(c).agg((F.count("*") > 1).alias(f"__{c}"))
        records = records.join(seen.where(f"__{c}"), c, "left")
        found.append(F.when(F.col(f"__{c}"), F.struct(F.lit("error").alias("severity"), F.lit(field).alias("field"))))
    return records.withColumn("issues", F.array_compact(F.array(*found))).drop("__id", "__source_url")


def quality_report(checked: DataFrame) -> DataFrame:
    """One row of counts over record_issues(): records, valid and rejected ones, errors, warnings, repeated ids and urls, score."""
    of = lambda test: F.coalesce(F.sum(F.size(F.filter("issues", test))), F.lit(0)).cast("long")
    bad = F.exists("issues", lambda x: x["severity"] == "error").cast("long")
    counts = checked.agg(F.count("*").alias("records"), F.coalesce(F.sum(bad), F.lit(0)).alias("rejected"), of(lambda x: x["severity"] == "error").alias("errors"), of(lambda x: x["severity"] == "warning").alias("warnings"), of(lambda x: x["field"].isin("id", "source_url_repeated")).alias("repeated"))
    return counts.withColumns({"valid": F.col("records") - F.col("rejected"), "score": F.when(F.col("records") > 0, F.round(1 - F.col("rejected") / F.col("records"), 4)).otherwise(0.0)})


def bank_coverage(records: DataFrame, expected: DataFrame, fields: list[str]) -> DataFrame:
    """(bank_slug, expected, records, campaigns, products, and each field's fill rate) of represented and expected (bank_slug) banks."""
    full = lambda c: F.round(F.avg((F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "").cast("int")), 4).alias(f"{c}_rate")
    kind = F.coalesce("record_kind", F.lit("campaign"))
    own = records.where(F.coalesce("bank_slug", F.lit("")) != "").groupBy("bank_slug").agg(F.count("*").alias("records"), F.sum((kind != "product").cast("long")).alias("campaigns"), F.sum((kind == "product").cast("long")).alias("products"), *map(full, fields))
    joined = own.join(expected.select("bank_slug").distinct().withColumn("expected", F.lit(True)), "bank_slug", "full_outer")
    return joined.select("bank_slug", F.coalesce("expected", F.lit(False)).alias("expected"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("records", "campaigns", "products")), *(F.coalesce(f"{c}_rate", F.lit(0.0)).alias(f"{c}_rate") for c in fields))


def repeated_margins(pages: DataFrame, share: float = 0.35, least: int = 3, shortest: int = 4) -> DataFrame:
    """(document, line, n): what stands in the first or last two lines of many pages (document, page, text) of a document.

    Lines are compared without regard to case and runs of white space; empty lines don't count, nor do pages without text.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    own = pages.select("document", "page", lines.alias("lines")).where(F.size("lines") > 0)
    keys = F.transform(F.concat(F.slice("lines", 1, 2), F.slice(F.col("lines"), F.greatest(F.size("lines") - 1, F.lit(1)), F.lit(2))), lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " "))))
    total = own.groupBy("document").agg(F.count("*").alias("pages"))
    counted = own.select("document", F.explode(F.array_distinct(keys)).alias("line")).where(F.length("line") >= shortest).groupBy("document", "line").agg(F.count("*").alias("n"))
    return counted.join(total, "document").where(F.col("n") >= F.greatest(F.lit(least), F.floor(share * F.col("pages")))).select("document", "line", "n")


def golden_scores(pairs: DataFrame) -> DataFrame:
    """(field, total, hits, accuracy) of pairs (field, kind, gold, got) that have a gold value.

    A pair of kind `exact` hits if both are equal, one of kind `contains` if the gold text stands in what was got.
    """
    hit = F.when(F.col("kind") == "contains", F.contains(F.col("got"), F.col("gold"))).otherwise(F.col("got") == F.col("gold"))
    counted = pairs.where(F.col("gold").isNotNull()).groupBy("field").agg(F.count("*").alias("total"), F.sum(F.coalesce(hit, F.lit(False)).cast("long")).alias("hits"))
    return counted.withColumn("accuracy", F.round(F.col("hits") / F.col("total"), 6))
