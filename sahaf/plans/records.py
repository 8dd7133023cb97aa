"""Whole-record jobs, gates and policy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sahaf.functions import extract as x
from sahaf.functions import text as t
from sahaf.operators import retrieval as rt
from sahaf.sources import io

from .language import ANNOUNCE, AUDIENCE, SHARES, B, announced, told
from .registry import query
from .search import BM25, asked, every
from .tables import frame

A = "WITH a AS (" + ANNOUNCE.replace("{orders}", "orders") + ")"


@query("t11_mentions_in_order", f"{A} SELECT id, CASE WHEN contains(text, 'Mobil') AND contains(text, 'şube') THEN 'mobil,şube' WHEN contains(text, 'Mobil') THEN 'mobil' ELSE '' END AS names FROM a")
def t11(spark, d):
    """Names in the order of their places in the text; of names at one place the longer."""
    low = F.lower("text")
    places = F.filter(F.array(*(F.struct(F.instr(low, n).alias("at"), F.lit(-len(n)).alias("l"), F.lit(n).alias("n")) for n in ("mobil", "şube", "banka"))), lambda v: v["at"] > 0)
    return announced(spark, d).select("id", F.array_join(F.transform(F.array_sort(places), lambda v: v["n"]), ",").alias("names"))


@query("e13_rules_then_spans", rf"{B}, r AS (SELECT id, text, {SHARES} AS rates, regexp_extract(text, '%\s*([0-9][0-9.,]*)', 1) AS span FROM b) SELECT id, CASE WHEN len(rates) = 1 THEN list_extract(rates, 1) WHEN span <> '' THEN round(replace(rtrim(span, ',.'), ',', '.')::DOUBLE / 100, 6) END AS rate, CASE WHEN len(rates) = 1 THEN 'rules' WHEN span <> '' THEN 'spans' ELSE 'none' END AS method FROM r")
def e13(spark, d):
    """A rate that the rules leave empty is filled from the text's first rate span."""
    own = told(spark, d, "profit_share_rate").select("id", F.col("f.profit_share_rate").alias("rate"), F.regexp_extract("text", r"%\s*\d[\d.,]*|\d[\d.,]*\s*%", 0).alias("s"))
    filled = F.round(x.n.rate(F.col("s")).cast("double"), 6)
    return own.select("id", F.coalesce("rate", filled).alias("rate"), F.when(F.col("rate").isNotNull(), "rules").when(filled.isNotNull(), "spans").otherwise("none").alias("method"))


@query("e17_valid_audiences", f"{B} SELECT id, {AUDIENCE} IS NOT NULL AS valid FROM b WHERE regexp_matches(low, 'emekli|öğrenci|doktor|kobi|müşteri|hoş geldin')")
def e17(spark, d):
    """An audience that a text names counts unless its sentence excludes it."""
    named = F.col("text").rlike("(?iu)emekli|öğrenci|doktor|kobi|KOBİ|müşteri|hoş geldin")
    return told(spark, d, "target_audience").where(named).select("id", F.col("f.target_audience").isNotNull().alias("valid"))


CANON = r"array_to_string(regexp_extract_all(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[\p{L}\p{N}]+'), ' ')"


@query("e21_preprocessed_records", f"SELECT doc_id, sha256(concat(lower(source), chr(0), {CANON})) AS content_hash, len(regexp_extract_all(lower(translate(text, 'Iİ', 'ıi')), '\\p{{Nd}}+(?:[.,]\\p{{Nd}}+)*|\\p{{L}}+(?:[''’]\\p{{L}}+)?'))::INT AS token_count FROM documents")
def e21(spark, d):
    """Tokens and digests of clean texts."""
    own = frame(spark, d, "documents")
    return own.select("doc_id", "source", "text", t.clean_text("text").alias("clean")).select("doc_id", t.content_hash("source", "clean").alias("content_hash"), F.size(t.tokens("clean")).alias("token_count"))


@query("r03_gated_chunks", "SELECT item_id AS id FROM benchmark WHERE item_id % 5 <> 0 AND item_id % 7 <> 0")
def r03(spark, d):
    """Chunks whose document the manifest knows with the same hash and enough pages."""
    own = frame(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("item_id").alias("document_id"), F.md5("text").alias("md"))
    chunks = own.select("id", "document_id", F.when(F.col("id") % 5 == 0, "x").otherwise(F.col("md")).alias("sha"), F.when(F.col("id") % 7 == 0, 9).otherwise(1).alias("page"))
    bad = rt.page_range_violations(chunks, own.select("document_id", F.col("md").alias("sha"), F.lit(3).alias("pages")))
    return chunks.select("id").join(bad, "id", "left_anti")


@query("r05_page_quality_gate", r"SELECT doc_id, length(regexp_replace(text, '[^%&$#*!|]', '', 'g')) / length(text) <= 0.02 AS good FROM documents WHERE length(text) > 0")
def r05(spark, d):
    odd = F.length(F.regexp_replace("text", r"[^%&$#*!|]", ""))
    return frame(spark, d, "documents").where(F.length("text") > 0).select("doc_id", (odd / F.length("text") <= 0.02).alias("good"))


@query("s23_rule_tables", "SELECT event_id, CASE event_type WHEN 'error' THEN 'failure' WHEN 'purchase' THEN 'sale' ELSE 'other' END AS kind FROM events")
def s23(spark, d):
    """Rules that are kept as JSON, joined by broadcast."""
    path = io.work_folder(spark, "rules")
    spark.createDataFrame([("error", "failure"), ("purchase", "sale")], "event_type string, kind string").coalesce(1).write.json(path)
    rules = spark.read.schema("event_type string, kind string").json(path)
    return frame(spark, d, "events").join(F.broadcast(rules), "event_type", "left").select("event_id", F.coalesce("kind", F.lit("other")).alias("kind"))


@query("x27_page_cleanup", r"SELECT doc_id, regexp_replace(regexp_replace(text, '(\w)-\n(\w)', '\1\2', 'g'), '[ \t]+', ' ', 'g') AS x FROM documents")
def x27(spark, d):
    joined = F.regexp_replace("text", r"(?U)(\w)-\n(\w)", "$1$2")
    return frame(spark, d, "documents").select("doc_id", F.regexp_replace(joined, r"[ \t]+", " ").alias("x"))


@query("q13_hybrid_answers", BM25 + "SELECT query_id, string_agg(id, ',' ORDER BY rank) AS sources FROM lexical WHERE rank <= 3 GROUP BY 1")
def q13(spark, d):
    """The three best documents as an answer's sources."""
    top = rt.bm25(every(spark, d), asked(spark, d), 3)
    return top.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda v: v["id"].cast("string")), ",").alias("sources"))


@query("q15_output_gate", "SELECT doc_id, len(list_distinct(string_split(text, chr(10)))) = len(string_split(text, chr(10))) AND length(text) >= 20 AS passes FROM documents")
def q15(spark, d):
    """An answer passes if it is long enough and repeats no line."""
    lines = F.split("text", "\n")
    return frame(spark, d, "documents").select("doc_id", (~t.mark_repeats(lines) & (F.length("text") >= 20)).alias("passes"))
