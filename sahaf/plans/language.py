"""Extraction, planning and policy queries."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from sahaf.functions import extract as x
from sahaf.functions import fields as v
from sahaf.operators import evaluation as ev
from sahaf.operators import intents as i

from .registry import query
from .tables import frame, spread, sql_with

#: Announcements with a sum, a term, rates, dates, channels and audiences, made from the orders.
ANNOUNCE = """SELECT o_orderkey AS id, concat(CASE o_orderkey % 4 WHEN 0 THEN 'Konut finansmanı' WHEN 1 THEN 'İhtiyaç kredisi' WHEN 2 THEN 'Katılma fonu' ELSE 'Worldpuan kart' END, ' için ', CAST(1 + o_orderkey % 48 AS VARCHAR(4)), ' ay vade ve %', CAST(o_orderkey % 5 AS VARCHAR(4)), ',', CAST(10 + o_orderkey % 80 AS VARCHAR(4)),
    ' oran. En fazla ', CAST(1 + o_orderkey % 9 AS VARCHAR(4)), '00.000 TL verilir. ', CASE o_orderkey % 3 WHEN 0 THEN 'Mobil uygulama ve şube. ' WHEN 1 THEN 'Dosya ücretsiz. ' ELSE '' END, CASE WHEN o_orderkey % 7 = 0 THEN 'Ayrıca %9,99 oran. ' ELSE '' END,
    CAST(1 + o_orderkey % 28 AS VARCHAR(4)), ' Mart - ', CAST(1 + o_orderkey % 28 AS VARCHAR(4)), ' Mayıs 2024. ', CAST(1 + o_orderkey % 12 AS VARCHAR(4)), ' taksit. ', CASE o_orderkey % 5 WHEN 0 THEN 'Emekli müşteriler hariç.' WHEN 1 THEN 'Emekli müşteriler.' ELSE '' END) AS text FROM {orders}"""
K = "o_orderkey"
A = "WITH a AS (" + ANNOUNCE.replace("{orders}", "orders") + ")"
RATE = f"({K} % 5 + (10 + {K} % 80) / 100) / 100"


def announced(spark, d):
    return spark.sql(ANNOUNCE, orders=frame(spark, d, "orders"))



#: Notices in natural wording, put together from sentences that the order's number picks.
SENTENCES = [
    ["Konut finansmanında %1,{n} kâr payı oranı ile {m} ay vade.", "Taşıt finansmanı: kâr payı oranı %2,{n} ve {m} ay vadeli.", "İhtiyaç finansmanı %3,{n} oranla {m} ay vade sunar.", "Worldpuan kart ile {m} taksit; %{n} indirim.",
     "Yatırım için altın hesabı açın, avantaj kazanın.", "Alışveriş puan fırsatı: 2.000 TL harcamaya {n} TL ödül.", "Yeni müşterilere hoş geldin hediyesi.", "Günlük hesap fırsatı; vadeni boz ve %4,{n} oran kazan.", "Kur fırsatı var.", "Avantajlı oran için başvurun.",
     "Müşterimiz olun, kur fırsatı yakalayın.", "Kur fırsatı kazandırır; müşterimiz olun.", "Vadeni boz, günlük hesap aç.", "Hayat Finanslı olun, {n} TL kazanın.", "Paraf kredi kart fırsatı."],
    ["1{n}.000 TL kadar.", "En az 5.0{n} TL ile başvurun.", "1,5 milyon TL tutara kadar.", "", "3 gün içinde sonuç.", "$ 2{n} ile başlar."],
    ["Emekliler için geçerlidir.", "Öğrenciler hariç.", "KOBİ ve esnaf için.", "Mevcut müşterilerimiz kartınızla kazanır.", "Doktorlara açıktır.", "", "Bireysel müşteriler dahil değil; üniversite öğrencileri katılır."],
    ["Başvuru mobil uygulama üzerinden.", "İnternet şubesi yeterlidir.", "Sigorta yaptırma şartı vardır.", "Masrafsız işlem.", ""],
    ["", "", "", "Ayrıca %9,99 kâr payı oranı.", "", "", ""],
]
PICK = ["", " / 3", " / 7", " / 2", ""]
FILLED = {"{n}": "CAST(10 + o_orderkey % 83 AS VARCHAR(4))", "{m}": "CAST(1 + o_orderkey % 120 AS VARCHAR(4))"}


def filled(sentence: str) -> str:
    """A sentence as SQL, its numbers made from the order's."""
    return "concat(" + ", ".join(FILLED.get(part, f"'{part}'") for part in re.split(r"(\{[nm]\})", sentence)) + ")"


NOTICE = "SELECT o_orderkey AS id, concat_ws(' ', " + ", ".join(f"CASE CAST(floor(o_orderkey{pick}) AS BIGINT) % {len(own)} " + " ".join(f"WHEN {k} THEN {filled(s)}" for k, s in enumerate(own)) + " END" for own, pick in zip(SENTENCES, PICK, strict=True)) + ") AS text FROM {orders}"
B = "WITH n AS (" + NOTICE.replace("{orders}", "orders") + "), b AS (SELECT id, text, replace(lower(text), 'i̇', 'i') AS low FROM n)"


def noticed(spark, d):
    return spark.sql(NOTICE, orders=spread(frame(spark, d, "orders").select("o_orderkey")))


def told(spark, d, *names, shown=()):
    """Notices with the fields of names, and the evidence of those of shown."""
    return noticed(spark, d).select("id", "text", v.prd_fields("text", [*names, *(["evidence"] if shown else [])], list(shown)).alias("f"))


#: The same rules over the texts, in SQL.
SHARES = r"list_sort(list_distinct(list_transform(list_concat(regexp_extract_all(text, '%\s*([0-9][0-9.,]*)\s*(?:[Kk][aâ]r\s+pay[ıi]|[Oo]ran)', 1), regexp_extract_all(text, '(?:[Kk][aâ]r\s+pay[ıi](?:\s+oran[ıi])?|[Oo]ran[ıi]?)\s*%\s*([0-9][0-9.,]*)', 1)), lambda x: round(replace(trim(x, ',.'), ',', '.')::DOUBLE / 100, 6))))"
PRODUCT = "CASE WHEN contains(low, 'finansman') THEN 'financing' WHEN (contains(low, 'günlük hesap') AND contains(low, 'vadeni boz')) OR (contains(low, 'kur fırsat') AND contains(low, 'müşterimiz olun')) THEN 'investment' WHEN contains(low, 'kart') OR contains(low, 'bonus') THEN 'card' WHEN contains(low, 'yatırım') OR contains(low, 'katılma hesab') OR contains(low, 'altın') THEN 'investment' WHEN contains(low, 'alışveriş puan') OR contains(low, 'worldpuan') OR contains(low, 'parafpara') THEN 'shopping_points' WHEN contains(low, 'yeni müşteri') OR contains(low, 'ilk kez müşteri') THEN 'new_customer' END"
SUM_OF = r"replace(replace(regexp_extract({0}, '[0-9][0-9.,]*'), '.', ''), ',', '.')::DOUBLE * CASE WHEN contains({0}, 'milyon') THEN 1000000 ELSE 1 END"
MOST = r"regexp_extract(text, '([0-9][0-9.,]*(?:\s+milyon)?\s*TL)(?:\s+tutar[aı])?\s+kadar', 1)"
LEAST = r"regexp_extract(text, '[Ee]n\s+az\s+([0-9][0-9.,]*\s*TL)', 1)"
AUDIENCE = r"list_extract(list_filter(list_transform(list_filter(regexp_split_to_array(low, '[\n.!?;]+'), lambda s: NOT regexp_matches(s, 'hariç|dahil değil|geçerli değil|kapsam dışı')), lambda s: CASE WHEN regexp_matches(s, 'yeni müşteri|hoş geldin|müşteri ol[au]n|hayat finanslı ol') THEN 'new_customer' WHEN contains(s, 'emekli') THEN 'retiree' WHEN contains(s, 'doktor') THEN 'public_sector' WHEN regexp_matches(s, 'kobi|esnaf') THEN 'commercial' WHEN regexp_matches(s, 'öğrenci|üniversite') THEN 'student' WHEN regexp_matches(s, 'kartınız|(bireysel|mevcut) müşteri|paraf kredi kart') THEN 'existing_customer' END), lambda x: x IS NOT NULL), 1)"
TERM = r"try_cast(regexp_extract(text, '([0-9]{1,3})\s*ay\s*vade', 1) AS INT)"


@query("e01_profit_rates", f"{B} SELECT id, CASE WHEN len({SHARES}) = 1 THEN list_extract({SHARES}, 1) END AS rate, CASE WHEN len({SHARES}) > 1 THEN len({SHARES}) ELSE 0 END::INT AS candidates FROM b")
def e01(spark, d):
    n = F.when(F.col("f.rate_candidates").isNotNull(), F.size("f.rate_candidates")).otherwise(0)
    return told(spark, d, "rate_candidates", "profit_share_rate").select("id", F.col("f.profit_share_rate").alias("rate"), n.alias("candidates"))


@query("e02_discount_rates", rf"{B} SELECT id, round(try_cast(regexp_extract(text, '%\s*([0-9]+)\s*(?:indirim|iade)', 1) AS DOUBLE) / 100, 6) AS discount FROM b")
def e02(spark, d):
    return told(spark, d, "discount_rate").select("id", F.col("f.discount_rate").alias("discount"))


@query("e03_terms_and_instalments", rf"{B} SELECT id, {TERM} AS months, coalesce(30 * {TERM}, CASE WHEN contains(text, '3 gün') THEN 3 END)::INT AS days, try_cast(regexp_extract(text, '([0-9]{{1,3}})\s*taksit', 1) AS INT) AS instalments FROM b")
def e03(spark, d):
    return told(spark, d, "term_months", "duration", "installment_count").select("id", F.col("f.term_months").alias("months"), F.col("f.duration.approx_days").alias("days"), F.col("f.installment_count").alias("instalments"))


@query("e04_reward_amounts", rf"{B} SELECT id, try_cast(regexp_extract(text, 'harcamaya ([0-9]+) TL ödül', 1) AS DOUBLE) AS amount FROM b")
def e04(spark, d):
    """The last sum before a word for a reward, not the one that is to be spent."""
    return told(spark, d, "reward_amount").select("id", F.col("f.reward_amount.amount").alias("amount"))


@query("e05_largest_and_least_amounts", f"{B} SELECT id, CASE WHEN {MOST} <> '' THEN {SUM_OF.format(MOST)} END AS most, CASE WHEN {LEAST} <> '' THEN {SUM_OF.format(LEAST)} END AS least, CASE WHEN {MOST} <> '' THEN 'TRY' END AS currency FROM b")
def e05(spark, d):
    return told(spark, d, "max_amount", "min_amount").select("id", F.col("f.max_amount.amount").alias("most"), F.col("f.min_amount.amount").alias("least"), F.col("f.max_amount.currency").alias("currency"))


@query("e06_channels_and_conditions", f"{B} SELECT id, CASE WHEN contains(text, 'mobil uygulama') THEN 'mobil uygulama' WHEN contains(text, 'İnternet şubesi') THEN 'İnternet şubesi' END AS channel, CASE WHEN contains(text, 'yaptırma şart') THEN 'Sigorta yaptırma' END AS condition FROM b")
def e06(spark, d):
    return told(spark, d, "application_channel", "condition").select("id", F.col("f.application_channel").alias("channel"), F.regexp_extract("f.condition", "Sigorta yaptırma$", 0).alias("c"), "f.condition").select("id", "channel", F.when(F.col("condition").isNotNull(), F.nullif("c", F.lit(""))).alias("condition"))


@query("e07_product_types", f"{B} SELECT id, {PRODUCT} AS product_type, CASE WHEN contains(low, 'konut') THEN 'housing' WHEN contains(low, 'taşıt') THEN 'vehicle' WHEN contains(low, 'ihtiyaç') THEN 'consumer' END AS financing_type FROM b")
def e07(spark, d):
    return told(spark, d, "product_type", "financing_type").select("id", F.col("f.product_type").alias("product_type"), F.col("f.financing_type").alias("financing_type"))


@query("e08_audiences", f"{B} SELECT id, {AUDIENCE} AS audience FROM b")
def e08(spark, d):
    return told(spark, d, "target_audience").select("id", F.col("f.target_audience").alias("audience"))


@query("e09_benefit_sentences", r"{B} SELECT id, trim(list_extract(list_filter(regexp_extract_all(text, '(?:[^.!?]|[.!?][^\s])+[.!?]?'), lambda s: regexp_matches(lower(s), 'avantaj|indirim|ödül|iade|masrafsız|ücretsiz|muafiyet|hediye')), 1)) AS sentence FROM b".replace("{B}", B))
def e09(spark, d):
    return told(spark, d, "campaign_benefit").select("id", F.col("f.campaign_benefit").alias("sentence"))


@query("e10_fees", f"{B} SELECT id, CASE WHEN contains(low, 'masrafsız') THEN 'masrafsız' END AS fee FROM b")
def e10(spark, d):
    return told(spark, d, "fee_information").select("id", F.col("f.fee_information").alias("fee"))


@query("e11_all_fields", f"{B} SELECT {PRODUCT} AS product_type, count(*) AS n, count(*) FILTER (len({SHARES}) = 1) AS rates, count(*) FILTER (len({SHARES}) > 1) AS conflicts, count(*) FILTER (contains(low, 'masrafsız')) AS fees, sum({TERM})::BIGINT AS months, count({AUDIENCE}) AS audiences, count(*) FILTER ({MOST} <> '') AS amounts FROM b GROUP BY 1")
def e11(spark, d):
    return told(spark, d, "product_type", "profit_share_rate", "rate_candidates", "fee_information", "term_months", "target_audience", "max_amount").groupBy(F.col("f.product_type").alias("product_type")).agg(F.count("*").alias("n"), F.count("f.profit_share_rate").alias("rates"), F.count("f.rate_candidates").alias("conflicts"), F.count("f.fee_information").alias("fees"), F.sum("f.term_months").alias("months"), F.count("f.target_audience").alias("audiences"), F.count("f.max_amount").alias("amounts"))


@query("e12_field_contracts", f"""{B}, s AS (SELECT *, CASE WHEN len({SHARES}) > 1 THEN 'CONFLICT' WHEN len({SHARES}) = 1 THEN 'EXPLICIT' WHEN {PRODUCT} IN ('card', 'shopping_points', 'new_customer') THEN 'NOT_APPLICABLE' WHEN contains(low, 'avantajlı oran') THEN 'IMPLICIT' WHEN regexp_matches(low, 'k[aâ]r payı|oran') THEN 'EXTRACTION_FAILED' ELSE 'NOT_STATED' END AS status,
    CASE WHEN {TERM} IS NOT NULL THEN 'EXPLICIT' WHEN {PRODUCT} IN ('card', 'shopping_points', 'new_customer') THEN 'NOT_APPLICABLE' WHEN contains(low, 'vade') THEN 'EXTRACTION_FAILED' ELSE 'NOT_STATED' END AS term FROM b)
SELECT id, status, CASE status WHEN 'CONFLICT' THEN 0.5 WHEN 'IMPLICIT' THEN 0.75 WHEN 'EXPLICIT' THEN 0.99 WHEN 'EXTRACTION_FAILED' THEN 0.0 ELSE 1.0 END AS confidence, 'RATIO' AS unit, term, CASE WHEN term = 'EXPLICIT' THEN instr(text, regexp_extract(text, '[0-9]{{1,3}}\\s*ay\\s*vade')) - 1 END::INT AS char_start FROM s""")
def e12(spark, d):
    """Of the rate and the term: stated, vague, failed, not to be expected, or in conflict, and where."""
    f = told(spark, d, "profit_share_rate", "product_type", "rate_candidates", "term_months", shown=["profit_share_rate", "term_months"])
    rate = v.contract("profit_share_rate", F.col("f.profit_share_rate"), F.col("f.evidence")["profit_share_rate"], F.col("text"), F.col("f.product_type"), F.col("f.rate_candidates"))
    term = v.contract("term_months", F.col("f.term_months"), F.col("f.evidence")["term_months"], F.col("text"), F.col("f.product_type"))
    return f.select("id", rate.alias("r"), term.alias("t")).select("id", "r.status", "r.confidence", "r.unit", F.col("t.status").alias("term"), "t.evidence.char_start")


@query("f14_evidence_spans", "SELECT doc_id, substr(text, 5, 10) = substr(text, 5 + (doc_id % 2)::INT, 10) AND length(text) > 20 AS ok FROM documents")
def f14(spark, d):
    return frame(spark, d, "documents").select("doc_id", ((F.substring("text", 5, 10) == F.substring(F.col("text"), 5 + (F.col("doc_id") % 2).cast("int"), F.lit(10))) & (F.length("text") > 20)).alias("ok"))


@query("x23_evidence_anchoring", f"{A} SELECT id, CASE WHEN id % 2 = 0 THEN 0 ELSE instr(text, 'En fazla') - 1 END::INT AS start FROM a")
def x23(spark, d):
    value = F.when(F.col("id") % 2 == 0, F.substring("text", 1, 5)).otherwise("En fazla")
    return announced(spark, d).select("id", x.anchored(F.col("text"), F.lit(0), F.lit(5), value).alias("start"))


@query("u07_merged_spans", "SELECT event_type AS label, count(*) AS n FROM (SELECT event_id, user_id, event_type FROM events WHERE event_id % 2 = 0 UNION SELECT event_id, user_id, event_type FROM events WHERE event_id % 3 = 0) GROUP BY 1")
def u07(spark, d):
    own = frame(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("start"), (F.col("user_id") + 3).alias("end"), F.col("event_type").alias("label"))
    return x.merged_spans(own.where("id % 2 = 0"), own.where("id % 3 = 0")).groupBy("label").agg(F.count("*").alias("n"))


@query("e19_suggestions", "SELECT user_id, event_type AS field, CASE WHEN count(DISTINCT floor(value / 400)) = 1 THEN min(event_id) END AS suggestion, count(DISTINCT floor(value / 400)) > 1 AS conflict FROM events GROUP BY 1, 2")
def e19(spark, d):
    """By record and field: one value, from the method that comes first; values that differ drop each other."""
    g = frame(spark, d, "events").groupBy("user_id", F.col("event_type").alias("field")).agg(F.countDistinct(F.floor(F.col("value") / 400)).alias("n"), F.min("event_id").alias("e"))
    return g.select("user_id", "field", F.when(F.col("n") == 1, F.col("e")).alias("suggestion"), (F.col("n") > 1).alias("conflict"))


@query("e20_merged_suggestions", "WITH l AS (SELECT user_id, min(event_id) AS a FROM events WHERE event_type = 'view' GROUP BY 1), r AS (SELECT user_id, min(event_id) AS b FROM events WHERE event_type <> 'click' GROUP BY 1) SELECT coalesce(l.user_id, r.user_id) AS user_id, CASE WHEN a IS NULL THEN b WHEN b IS NULL OR a = b THEN a END AS v FROM l FULL JOIN r ON l.user_id = r.user_id")
def e20(spark, d):
    e = frame(spark, d, "events")
    a = e.where("event_type = 'view'").groupBy("user_id").agg(F.min("event_id").alias("a"))
    b = e.where("event_type <> 'click'").groupBy("user_id").agg(F.min("event_id").alias("b"))
    v = F.when(F.col("a").isNull(), F.col("b")).when(F.col("b").isNull() | (F.col("a") == F.col("b")), F.col("a"))
    return a.join(b, "user_id", "full_outer").select("user_id", v.alias("v"))


@query("e22_intent_keywords", "SELECT conv_id, turn, CASE WHEN contains(lower(text), 'the') THEN 'en' WHEN contains(lower(text), 'der') THEN 'de' ELSE 'other' END AS intent FROM conversations")
def e22(spark, d):
    low = F.lower("text")
    return frame(spark, d, "conversations").select("conv_id", "turn", F.when(F.contains(low, F.lit("the")), "en").when(F.contains(low, F.lit("der")), "de").otherwise("other").alias("intent"))


@query("f20_admission", "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE doc_id % 10 < 7 AND trim(text) <> '' AND quality IS NOT NULL")
def f20(spark, d):
    return frame(spark, d, "documents").join(frame(spark, d, "labels"), "doc_id").where((F.col("doc_id") % 10 < 7) & (F.trim("text") != "") & F.col("quality").isNotNull()).select("doc_id")


#: Questions of all kinds with what their plan must say: intent, route, product, financing, metric, aggregation, confidence, banks.
EXPECTED = """
Konut finansmanı nedir? | definition | HYBRID_RAG | financing | housing | - | - | 0.98 | -
Murabaha ne demek? | definition | HYBRID_RAG | - | - | - | - | 0.98 | -
Mudarebe nasıl işler? | definition | HYBRID_RAG | - | - | - | - | 0.98 | -
Blockchain nedir? | unknown | SAFE_REDIRECT | - | - | - | - | - | -
Katılım bankaları listesi | bank_list | STRUCTURED_SQL | - | - | - | - | 0.99 | -
Türkiye'de kaç katılım bankası var? | bank_list | STRUCTURED_SQL | - | - | - | - | 0.99 | -
Kaç kampanya var? | campaign_count | STRUCTURED_SQL | - | - | - | COUNT | 0.99 | -
Albaraka kampanya sayısı nedir? | campaign_count | STRUCTURED_SQL | - | - | - | COUNT | 0.99 | albaraka
Kuveyt Türk ile Ziraat Katılım konut finansmanı karşılaştır | product_comparison | HYBRID_RAG | financing | housing | - | - | 0.99 | kuveyt-turk,ziraat-katilim
En düşük kâr payı oranı hangi bankada? | product_comparison | STRUCTURED_SQL | - | - | PROFIT_RATE | MIN | 0.99 | -
Taşıt finansmanı oranları | product_comparison | HYBRID_RAG | financing | vehicle | PROFIT_RATE | - | 0.99 | -
İhtiyaç kredisi için en uygun banka hangisi | product_comparison | HYBRID_RAG | financing | consumer | - | - | 0.99 | -
En uzun vade hangi finansmanda? | product_search | HYBRID_RAG | financing | - | MATURITY | MAX | 0.55 | -
Konut finansmanı kâr payı oranı kaç? | rate_query | STRUCTURED_SQL | financing | housing | PROFIT_RATE | - | 0.98 | -
Taşıt finansmanında oran kaç | rate_query | STRUCTURED_SQL | financing | vehicle | PROFIT_RATE | - | 0.98 | -
İhtiyaç finansmanı kaç ay vadeli? | maturity_query | STRUCTURED_SQL | financing | consumer | MATURITY | - | 0.96 | -
Konut finansmanında vade kaç ay | maturity_query | STRUCTURED_SQL | financing | housing | MATURITY | - | 0.96 | -
Kart kampanyası ne zamana kadar geçerli? | campaign_query | HYBRID_RAG | card | - | - | - | 0.98 | -
Bankkart akaryakıt indirim kampanyası ödül ne kadar | campaign_query | HYBRID_RAG | - | - | REWARD_AMOUNT | - | 0.98 | -
Kampanya koşulları neler, indirim var mı | campaign_query | HYBRID_RAG | - | - | - | - | 0.98 | -
Kimler başvurabilir konut finansmanına? | application_requirements | HYBRID_RAG | financing | housing | - | - | 0.97 | -
Konut finansmanı için hangi belgeler gerekli | application_requirements | HYBRID_RAG | financing | housing | - | - | 0.97 | -
Taşıt finansmanına nasıl başvururum | application_requirements | HYBRID_RAG | financing | vehicle | - | - | 0.97 | -
EFT nasıl yapılır? | transaction_howto | SAFE_REDIRECT | - | - | - | - | 0.96 | -
Kartımla ödeme nasıl yaparım | transaction_howto | SAFE_REDIRECT | card | - | - | - | 0.96 | -
Altın teslimatı nasıl yapılır? | definition | HYBRID_RAG | - | - | - | - | 0.94 | -
Akreditif süreci | trade_finance_query | HYBRID_RAG | - | - | - | - | 0.94 | -
İhracat için teminat mektubu | trade_finance_query | HYBRID_RAG | - | - | - | - | 0.94 | -
Hangi finansman bana uygun | product_search | HYBRID_RAG | financing | - | - | - | 0.55 | -
Uygun ürün öner kobi finansmanı | product_search | HYBRID_RAG | financing | commercial | - | - | 0.55 | -
Çiftçi traktör desteği | agriculture_finance_query | HYBRID_RAG | - | - | - | - | 0.94 | -
Tarım finansmanı başvuru şartları | application_requirements | HYBRID_RAG | financing | - | - | - | 0.97 | -
Sukuk almak istiyorum | investment_query | HYBRID_RAG | - | - | - | - | 0.94 | -
Katılma hesabı getirisi | investment_query | HYBRID_RAG | investment | - | - | - | 0.94 | -
Murabaha ile icare ilişkili mi | relationship_query | HYBRID_RAG | - | - | - | - | 0.97 | -
Şikâyet etmek istiyorum | complaint_support | SAFE_REDIRECT | - | - | - | - | 0.99 | -
Karta itiraz | complaint_support | SAFE_REDIRECT | card | - | - | - | 0.99 | -
Bitcoin almalı mıyım? | unknown | SAFE_REDIRECT | - | - | - | - | - | -
Mevduat faizi ne kadar | unknown | SAFE_REDIRECT | - | - | - | - | - | -
Merhaba | unknown | SAFE_REDIRECT | - | - | - | - | - | -
Bugün hava nasıl | unknown | SAFE_REDIRECT | - | - | - | - | - | -
Ev kredisi | product_search | HYBRID_RAG | financing | housing | - | - | 0.55 | -
Araç kredisi masrafı ne kadar az | product_search | HYBRID_RAG | financing | vehicle | FEE | MIN | 0.55 | -
En yüksek puan veren kart | product_comparison | STRUCTURED_SQL | card | - | REWARD_AMOUNT | MAX | 0.99 | -
Puan kazandıran kart | product_search | HYBRID_RAG | card | - | REWARD_AMOUNT | - | 0.55 | -
Gecikme cezası | product_search | HYBRID_RAG | - | - | - | - | 0.55 | -
Faizsiz bankacılık esasları nelerdir | definition | HYBRID_RAG | - | - | - | - | 0.98 | -
Yatırım vekâleti nedir | definition | HYBRID_RAG | investment | - | - | - | 0.98 | -
Kuveyt Türk | product_search | HYBRID_RAG | - | - | - | - | 0.55 | kuveyt-turk
Konut finansmanı seçenekleri | product_search | HYBRID_RAG | financing | housing | - | - | 0.55 | -
Faiz oranı kaç | rate_query | STRUCTURED_SQL | - | - | PROFIT_RATE | - | 0.98 | -
Aidatsız kart var mı | product_search | HYBRID_RAG | card | - | FEE | - | 0.55 | -
Fon havuzu | investment_query | HYBRID_RAG | - | - | - | - | 0.94 | -
Kira sertifikası saklama | investment_query | HYBRID_RAG | - | - | - | - | 0.94 | -
Kâr payı havuzu nedir | definition | HYBRID_RAG | - | - | - | - | 0.98 | -
Nakit iade fırsatı | campaign_query | HYBRID_RAG | - | - | - | - | 0.94 | -
Teverruk | product_search | HYBRID_RAG | - | - | - | - | 0.55 | -
Ticari finansman | product_search | HYBRID_RAG | financing | commercial | - | - | 0.55 | -
Garanti nedir | definition | HYBRID_RAG | - | - | - | - | 0.98 | -
"""
KNOWN_BANKS = {"kuveyt türk": "kuveyt-turk", "ziraat katılım": "ziraat-katilim", "albaraka": "albaraka"}
QUESTIONS = [tuple(c.strip() for c in line.split(" | ")) for line in EXPECTED.strip().splitlines()]
Q_SQL = "q(k, question, intent, route, product_type, financing_type, metric, aggregation, confidence, banks) AS (VALUES " + ", ".join(f"({k}, " + ", ".join("NULL" if c == "-" else "'" + c.replace("'", "''") + "'" for c in row) + ")" for k, row in enumerate(QUESTIONS)) + ")"
ASKED_BY = f"orders JOIN q ON k = {K} % {len(QUESTIONS)}"


def questions(spark, d):
    q = spark.createDataFrame([(k, row[0]) for k, row in enumerate(QUESTIONS)], "k long, question string")
    own = frame(spark, d, "orders").select(F.col(K).alias("id"), (F.col(K) % len(QUESTIONS)).alias("k")).join(F.broadcast(q), "k")  # as many rows as QUESTIONS
    return i.compiled(own, "question", KNOWN_BANKS).select("id", "q")


@query("q01_plans", f"WITH {Q_SQL} SELECT {K} AS id, intent, route, coalesce(banks, '') AS banks FROM {ASKED_BY}")
def q01(spark, d):
    return questions(spark, d).select("id", "q.intent", "q.route", F.array_join("q.banks", ",").alias("banks"))


@query("q02_intents", f"WITH {Q_SQL} SELECT intent, count(*) AS n FROM {ASKED_BY} GROUP BY 1")
def q02(spark, d):
    return questions(spark, d).groupBy("q.intent").agg(F.count("*").alias("n"))


@query("q03_routes", f"WITH {Q_SQL} SELECT intent, route, count(*) AS n FROM {ASKED_BY} GROUP BY 1, 2")
def q03(spark, d):
    return questions(spark, d).groupBy("q.intent", "q.route").agg(F.count("*").alias("n"))


@query("q04_slots", f"WITH {Q_SQL} SELECT {K} AS id, product_type, financing_type, metric, aggregation FROM {ASKED_BY}")
def q04(spark, d):
    return questions(spark, d).select("id", "q.product_type", "q.financing_type", "q.metric", "q.aggregation")


@query("q05_confidence", f"WITH {Q_SQL} SELECT intent, min(coalesce(confidence, '0')::DOUBLE) AS least, max(coalesce(confidence, '0')::DOUBLE) AS most, count(*) FILTER (product_type IS NOT NULL) AS by_product, count(*) FILTER (banks IS NOT NULL) AS by_bank FROM {ASKED_BY} GROUP BY 1")
def q05(spark, d):
    """Confidence, and how often it rests on a product term or on a bank's name."""
    rests = lambda name: F.sum(F.array_contains("q.sources", name).cast("long"))
    return questions(spark, d).groupBy("q.intent").agg(F.min("q.confidence").alias("least"), F.max("q.confidence").alias("most"), rests("product_term").alias("by_product"), rests("bank_alias").alias("by_bank"))


@query("q11_structured_answers", sql_with("SELECT slug, concat(count(*), ' kampanya, en düşük oran ', format('{:.3f}', min(rate))) AS answer FROM campaigns JOIN banks USING (bank_id) GROUP BY slug", "campaigns", "banks"))
def q11(spark, d):
    g = frame(spark, d, "campaigns").groupBy("bank_id").agg(F.count("*").alias("n"), F.min("rate").alias("r"))
    return g.join(frame(spark, d, "banks"), "bank_id").select("slug", F.concat(F.col("n").cast("string"), F.lit(" kampanya, en düşük oran "), F.format_string("%.3f", "r")).alias("answer"))


@query("q21_prompt_packages", "SELECT lang, count(*)::INT AS sources, max(length(t))::INT AS longest FROM (SELECT lang, left(text, 1800) AS t FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 10) GROUP BY 1")
def q21(spark, d):
    """At most ten sources of a package, each cut to 1800 characters."""
    top = frame(spark, d, "documents").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).where("r <= 10")
    packed = top.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("doc_id", F.substring("text", 1, 1800).alias("t")))).alias("s"))
    return packed.select("lang", F.size("s").alias("sources"), F.array_max(F.transform("s", lambda v: F.length(v["t"]))).alias("longest"))


#: What the first sentence of a notice is about, by its place in SENTENCES.
GOLD_PRODUCT = "CASE id % 10 WHEN 0 THEN 'financing' WHEN 1 THEN 'financing' WHEN 2 THEN 'financing' WHEN 3 THEN 'card' WHEN 4 THEN 'investment' WHEN 5 THEN 'shopping_points' WHEN 6 THEN 'new_customer' WHEN 7 THEN 'investment' END"
GOLD_TERM = "CASE WHEN id % 10 < 3 THEN CAST(1 + id % 120 AS VARCHAR(4)) END"
GOLD_BENEFIT = "CASE id % 10 WHEN 3 THEN 'indirim' WHEN 4 THEN 'avantaj' WHEN 5 THEN 'ödül' WHEN 6 THEN 'hediyesi' END"


@query("a24_golden_fields", rf"""{B}, p AS (SELECT 'product_type' AS field, {GOLD_PRODUCT} AS gold, coalesce({PRODUCT} = {GOLD_PRODUCT}, false) AS hit FROM b UNION ALL SELECT 'term_months', {GOLD_TERM}, coalesce(CAST({TERM} AS VARCHAR) = {GOLD_TERM}, false) FROM b
UNION ALL SELECT 'campaign_benefit', {GOLD_BENEFIT}, coalesce(contains(list_extract(list_filter(regexp_extract_all(text, '(?:[^.!?]|[.!?][^\s])+[.!?]?'), lambda s: regexp_matches(lower(s), 'avantaj|indirim|ödül|iade|masrafsız|ücretsiz|muafiyet|hediye')), 1), {GOLD_BENEFIT}), false) FROM b)
SELECT field, count(*) AS total, count(*) FILTER (hit) AS hits, round(count(*) FILTER (hit) / count(*), 6) AS accuracy FROM p WHERE gold IS NOT NULL GROUP BY 1""")
def a24(spark, d):
    """Extracted fields against what the notices were made from; a benefit counts if its word is in the sentence."""
    own = told(spark, d, "product_type", "term_months", "campaign_benefit")
    one = lambda field, kind, gold, got: F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"), F.expr(gold).alias("gold"), got.cast("string").alias("got"))
    pairs = own.select(F.inline(F.array(one("product_type", "exact", GOLD_PRODUCT, F.col("f.product_type")), one("term_months", "exact", GOLD_TERM, F.col("f.term_months")), one("campaign_benefit", "contains", GOLD_BENEFIT, F.col("f.campaign_benefit")))))
    return ev.golden_scores(pairs)


#: An answer is a turn, its gold the next one (or that the sources don't tell), its evidence the one before, its facts the gold's first two sentences.
_words = lambda x: f"regexp_extract_all(lower({x}), '[a-z0-9çğıöşü%]+')"
_codes = lambda x: f"list_distinct(list_transform(regexp_extract_all(replace({x}, ' ', '  '), '(?:^|[^\\p{{L}}\\p{{N}}_])(%?[0-9][0-9.,/-]*|[A-ZÇĞİÖŞÜ][A-ZÇĞİÖŞÜ0-9_-]{{3,}})(?:$|[^\\p{{L}}\\p{{N}}_])', 1), lambda c: lower(c)))"


@query("a26_answer_scores", f"""WITH t AS (SELECT a.conv_id, a.turn, trim(coalesce(a.text, '')) AS answer, CASE WHEN (a.conv_id + a.turn) % 9 = 0 THEN '{ev.FALLBACK}' ELSE coalesce(b.text, '') END AS gold, coalesce(c.text, '') AS evidence
    FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 LEFT JOIN conversations c ON c.conv_id = a.conv_id AND c.turn = a.turn - 1),
f AS (SELECT *, list_filter(string_split(gold, '.')[1:2], lambda x: trim(x) <> '') AS facts, {_words("answer")} AS g, {_words("gold")} AS w FROM t),
s AS (SELECT *, CASE WHEN len(facts) > 0 THEN len(list_filter(facts, lambda x: contains(array_to_string(g, ' '), array_to_string({_words("x")}, ' ')))) / len(facts) ELSE 1.0 END AS coverage,
    coalesce(list_sum(list_transform(list_distinct(g), lambda x: least(len(list_filter(g, lambda y: y = x)), len(list_filter(w, lambda y: y = x))))), 0) AS shared FROM f)
SELECT conv_id, turn, round(CASE WHEN trim(gold) = '{ev.FALLBACK}' THEN (answer = '{ev.FALLBACK}')::INT::DOUBLE ELSE greatest(0.0, least(1.0, 0.68 * coverage + 0.32 * CASE WHEN len(g) = 0 OR len(w) = 0 THEN (len(g) = len(w))::INT ELSE 2 * shared / (len(g) + len(w)) END
    - least(0.35, 0.08 * len(list_filter({_codes("answer")}, lambda c: NOT list_contains({_codes("concat(evidence, ' ', gold)")}, c)))) - CASE WHEN length(answer) > greatest(900, 2 * length(gold)) THEN 0.08 ELSE 0.0 END)) END, 6)::DOUBLE AS score FROM s""")
def a26(spark, d):
    """Each turn scored as an answer: facts covered, words shared with the gold answer as often as they stand there, length."""
    t = frame(spark, d, "conversations").select("conv_id", "turn", "text")
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("evidence"))
    both = t.join(after, ["conv_id", "turn"]).join(before, ["conv_id", "turn"], "left")
    gold = F.when((F.col("conv_id") + F.col("turn")) % 9 == 0, ev.FALLBACK).otherwise(F.coalesce("next", F.lit("")))
    own = both.select("conv_id", "turn", "text", gold.alias("gold"), "evidence")
    facts = F.filter(F.slice(F.split("gold", r"\."), 1, 2), lambda x: F.trim(x) != "")
    return own.select("conv_id", "turn", ev.answer_score(F.col("text"), F.col("gold"), facts, F.col("evidence")).alias("score"))
