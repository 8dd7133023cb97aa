"""Intents, slots and routes of questions: a table of rules in order of precedence, applied as columns of Spark."""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Other words for the domain's terms, product terms with what they stand for, contracts, outside words.
ALIASES = {
    "faiz oranı": "kâr payı oranı", "faizsiz bankacılık": "katılım esasları", "ev kredisi": "konut finansmanı", "araç kredisi": "taşıt finansmanı", "katılım bankacılığı": "katılım esasları",
    "kâr payı havuzu": "fon havuzu", "kar payı havuzu": "fon havuzu", "faizsiz": "katılım finansmanı", "kredi": "finansman", "faiz": "kâr payı", "mudaraba": "mudârebe", "mudarebe": "mudârebe", "icâre": "icare", "aidatsız": "aidatsız kart",
}
PRODUCT_TERMS = {
    "finansman": ("financing", None), "ev": ("financing", "housing"), "konut": ("financing", "housing"), "ev finansmanı": ("financing", "housing"), "taşıt": ("financing", "vehicle"), "araç finansmanı": ("financing", "vehicle"),
    "ihtiyaç": ("financing", "consumer"), "ticari finansman": ("financing", "commercial"), "kobi finansmanı": ("financing", "commercial"), "kart": ("card", None), "yatırım": ("investment", None), "katılma hesabı": ("investment", None),
}
CONTRACTS = "garanti|icare|istisna|karz-ı hasen|mudârebe|murabaha|müşareke|musareke|müsaveme|musaveme|selem|teverruk|tevliye|yatırım vekâleti".split("|")
OUTSIDE = "mevduat faizi|faiz getirisi|bitcoin|kripto|forex|kaldıraçlı|hisse senedi"

#: How words are looked for: anywhere; as a phrase of whole words; as a phrase whose last word may take endings.
INSIDE, PHRASE, STEM = "inside", "phrase", "stem"


class Rule(NamedTuple):
    """An intent if every group has a word in the question, all flags are set, and no forbidden word is inside."""

    intent: str
    confidence: float
    groups: tuple[tuple[str, str], ...]
    needs: tuple[str, ...] = ()
    forbids: str = ""


# The rules in order of precedence.
RULES = (
    Rule("complaint_support", 0.99, ((INSIDE, "şikâyet|şikayet|itiraz"),)),
    Rule("bank_list", 0.99, ((STEM, "katılım banka"), (INSIDE, "kaç|sayısı|sayisi|say|liste"))),
    Rule("product_comparison", 0.99, ((INSIDE, "finansman|konut|taşıt|araç|ihtiyaç|kobi"), (PHRASE, "oranları|oranlar|oranı nasıl|karşılaştırma tablosu|tablosu|finansmanı arıyorum|finansman çekmek istiyorum|finansman desteği")), ("product",)),
    Rule("campaign_count", 0.99, ((STEM, "kampanya"), (PHRASE, "kaç|sayısı|sayisi|say|sayar|adet"))),
    Rule("product_comparison", 0.99, ((PHRASE, "karşılaştır|kıyasla|hangisi daha|hangi ürün daha avantajlı|arasındaki fark|en düşük|en yüksek|en uygun|en avantajlı|hangisi"),), ("domain or banks",)),
    Rule("campaign_query", 0.98, ((PHRASE, "ne zamana kadar|geçerli|avantaj|fırsat|koşul|şart|indirim|nakit iade|ödül|ne kadar|yapan|veren|uygulayan|hangileridir"),), ("campaign",)),
    Rule("application_requirements", 0.97, ((STEM, "kimler başvur|başvuru şart|başvuru koşul|istenen belge|gerekli evrak|başvurabilir"),), ("domain",)),
    Rule("definition", 0.98, ((PHRASE, "nedir|ne demek|ne anlama gelir|ne anlama geliyor|açıklar mısın|ilkeleri nelerdir|esasları nelerdir|nasıl işler|nasıl hesaplanır|nereye aktarılır"),), ("domain",)),
    Rule("unknown", 0.0, ((PHRASE, "nedir|ne demek|ne anlama gelir|ne anlama geliyor|açıklar mısın|nasıl işler|nasıl hesaplanır|nereye aktarılır"),)),
    Rule("rate_query", 0.98, ((STEM, "kâr payı oranı kaç|kar payı oranı kaç|oran kaç|oranı kaç"),), ("domain", "PROFIT_RATE")),
    Rule("maturity_query", 0.96, ((PHRASE, "vade kaç|kaç ay"),), ("domain", "MATURITY")),
    Rule("definition", 0.94, ((INSIDE, "nasıl yaparım|nasıl yapılır"), (INSIDE, "istisna|fatsi|altın teslimat|altın biriktiren hesap|altın alım-satımı|finansal kiralama"))),
    Rule("transaction_howto", 0.96, ((INSIDE, "nasıl yaparım|nasıl yapılır"),)),
    Rule("trade_finance_query", 0.94, ((STEM, "akreditif|teminat mektubu|ithalat|ihracat|vesaik|taraflar bulunur"),)),
    Rule("product_search", 0.55, ((STEM, "hangi finansman ürün|hangi ürün|uygun ürün|ürün öner|kullanabilirim"),), ("domain",)),
    Rule("agriculture_finance_query", 0.94, ((STEM, "tarım|hayvancılık|çiftçi|hasat|sera|traktör|sulama"),), (), "başvuru|başvur|belge|şart|koşul"),
    Rule("investment_query", 0.94, ((PHRASE, "fon|sukuk|kira sertifikası|halka arz|getiri|getirisi|saklama"),)),
    Rule("relationship_query", 0.97, ((INSIDE, "ilişkili|bağlantılı|arasındaki ilişki"),), ("domain",)),
    Rule("application_requirements", 0.97, ((INSIDE, "hangi belge|hangi teminat|hangi koşul|hangi şart|neleri gerektir|evrak|belge|başvuru için|nasıl başvur"),), ("domain",)),
    Rule("product_search", 0.55, ((STEM, "hangi finansman|finansman bul"),)),
    Rule("product_search", 0.55, ((STEM, "seçenekler|ne kullanabilirim"),), ("domain",)),
)
#: Words that score where no rule fits, in order of precedence; some count within the domain only.
SCORED = {
    "application_requirements": "başvuru şartları|hangi belgeler|kimler başvurabilir|gereken evrak", "rate_query": "oran kaç|kâr payı|indirim oranı|paylaşım oranı", "maturity_query": "kaç ay|vade|ödeme süresi|erteleme",
    "campaign_query": "kampanya|fırsat|indirim|nakit iade|ne zamana kadar", "transaction_howto": "nasıl yapılır|nereden yaparım|nasıl kullanırım|işlem adımları", "definition": "nedir|ne demek|nasıl çalışır|açıklar mısın",
}
DOMAIN_ONLY = {"application_requirements", "rate_query", "maturity_query", "transaction_howto", "definition"}
STRUCTURED = {"bank_list": None, "campaign_count": None, "rate_query": "PROFIT_RATE", "maturity_query": "MATURITY"}
REDIRECTED = {"complaint_support", "transaction_howto", "unknown"}


def small(text: Column) -> Column:
    """Lower case as the language has it, with single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.translate(text, "Iİ", "ıi")), r"(?U)\s+", " "))


_WORD = r"[\p{L}\p{N}_]"
_EDGES = {INSIDE: "(?:{})", PHRASE: f"(?<!{_WORD})(?:{{}})(?!{_WORD})", STEM: f"(?<!{_WORD})(?:{{}})"}


def says(text: Column, how: str, words: str) -> Column:
    """Whether the text has one of the words (parted by |)."""
    return text.rlike(_EDGES[how].replace("{}", "|".join(map(re.escape, words.split("|")))))


def _count(text: Column, how: str, words: str) -> Column:
    return reduce(lambda a, b: a + b, (says(text, how, w).cast("int") for w in words.split("|")))


def rewritten(text: Column) -> Column:
    """The text in the domain's own words, the longest of the others first."""
    return reduce(lambda c, w: F.regexp_replace(c, _EDGES[PHRASE].replace("{}", re.escape(w)), ALIASES[w]), sorted(ALIASES, key=len, reverse=True), text)


#: What is asked about, the words that show it, and those that ask for the least or the most of it.
METRICS = (
    ("PROFIT_RATE", (STEM, "kâr payı|kar payı|oran"), "düşük", "yüksek"),
    ("MATURITY", (INSIDE, "vade|kaç ay"), None, "uzun"),
    ("FEE", (INSIDE, "masraf|ücret|aidat"), "düşük|az", None),
    ("REWARD_AMOUNT", (INSIDE, "ödül|puan"), None, "yüksek"),
)


def metric_of(text: Column) -> Column:
    """(metric, aggregation): what is asked about, and whether the least or the most of it."""
    nothing = F.lit(None).cast("string")

    def pair(name: str, least: str | None, most: str | None) -> Column:
        wish = F.when(says(text, INSIDE, least), "MIN") if least else None
        if most:
            wish = F.when(says(text, INSIDE, most), "MAX") if wish is None else wish.when(says(text, INSIDE, most), "MAX")
        return F.struct(F.lit(name).alias("metric"), (nothing if wish is None else wish).alias("aggregation"))

    (name, words, least, most), *others = METRICS
    out = F.when(says(text, *words), pair(name, least, most))
    return reduce(lambda c, m: c.when(says(text, *m[1]), pair(m[0], *m[2:])), others, out).otherwise(F.struct(nothing.alias("metric"), nothing.alias("aggregation")))


def product_of(text: Column) -> Column:
    """The most telling product term (product_type, financing_type): one with a financing type first, then others before
    `finansman`, then the longest, then the first."""

    def term(k: int, t: str) -> Column:
        product, financing = PRODUCT_TERMS[t]
        rank = 2 if financing else 0 if t == "finansman" else 1
        return F.when(says(text, STEM, t), F.struct(F.lit(rank).alias("rank"), F.lit(len(t)).alias("n"), F.lit(-k).alias("k"), F.lit(product).alias("product_type"), F.lit(financing).cast("string").alias("financing_type")))

    return F.array_max(F.array_compact(F.array(*(term(k, t) for k, t in enumerate(PRODUCT_TERMS)))))


def banks_in(text: Column, banks: dict[str, str]) -> Column:
    """The slugs of the named banks in the order of their first places, longer names before shorter ones at one place."""
    if not banks:
        return F.array().cast("array<string>")
    place = lambda name, slug: F.when(says(text, STEM, name), F.struct(F.position(F.lit(name), text).alias("at"), F.lit(-len(name)).alias("n"), F.lit(slug).alias("slug")))
    found = F.array_sort(F.array_compact(F.array(*(place(*b) for b in banks.items()))))
    return F.array_distinct(F.transform(found, lambda x: x["slug"]))


TERMS = "katılım banka|katılım finans|katılım esas|kâr payı|kar payı|fon havuzu|gecikme cezası|cezai şart|temerrüt|" + "|".join(CONTRACTS)


def _flags(text: Column, product: Column, banks: Column, metric: Column) -> dict[str, Column]:
    """What the rules need: a product, the domain, a campaign, a metric."""
    signal = says(text, PHRASE, "taksit|alışveriş|harcama|akaryakıt|ekstre|bonus|indirim") & says(text, STEM, "banka|kart")
    asked = lambda *names: F.coalesce(metric.isin(*names), F.lit(False))
    domain = product.isNotNull() | (F.size(banks) > 0) | signal | says(text, STEM, TERMS) | asked("REWARD_AMOUNT", "FEE") | says(text, INSIDE, "vade")
    out = {"product": product.isNotNull(), "domain": domain, "domain or banks": domain | (F.size(banks) > 1), "campaign": signal | says(text, STEM, "kampanya")}
    return out | {name: asked(name) for name, *_ in METRICS}


def _intent(text: Column, flags: dict[str, Column]) -> Column:
    """(intent, confidence): the first rule that fits, else the intent with the most words, else a product search within the domain."""
    verdict = lambda intent, sure: F.struct(F.lit(intent).alias("intent"), (F.lit(sure) if isinstance(sure, float) else sure).cast("double").alias("confidence"))

    def fits(rule: Rule) -> Column:
        parts = [flags[k] for k in rule.needs] + [says(text, how, words) for how, words in rule.groups] + [~says(text, INSIDE, rule.forbids)] * bool(rule.forbids)
        return reduce(lambda a, b: a & b, parts)

    out = reduce(lambda c, r: c.when(fits(r), verdict(r.intent, r.confidence)), RULES[1:], F.when(fits(RULES[0]), verdict(RULES[0].intent, RULES[0].confidence)))
    scores = {i: _count(text, STEM, words) * flags["domain"].cast("int") if i in DOMAIN_ONLY else _count(text, STEM, words) for i, words in SCORED.items()}
    most = F.greatest(*scores.values())
    for i, score in scores.items():
        out = out.when((most > 0) & (score == most), verdict(i, F.least(F.lit(0.98), F.lit(0.78) + F.lit(0.08) * score)))
    return out.when(flags["domain"], verdict("product_search", 0.55)).otherwise(verdict("unknown", 0.0))


def route_of(intent: Column, metric: Column, aggregation: Column, trusted: Column) -> Column:
    """Where the answer comes from: typed tables only for what they hold and where the domain is sure."""
    held = reduce(lambda a, b: a | b, ((intent == i) if m is None else (intent == i) & (metric == m) for i, m in STRUCTURED.items()))
    typed = F.coalesce(held, F.lit(False)) | F.coalesce((intent == "product_comparison") & metric.isNotNull() & aggregation.isin("MIN", "MAX"), F.lit(False))
    return F.when(intent.isin(*REDIRECTED), "SAFE_REDIRECT").when(typed & trusted, "STRUCTURED_SQL").otherwise("HYBRID_RAG")


KINDS = "intent string, route string, product_type string, financing_type string, metric string, aggregation string, confidence double, banks array<string>, sources array<string>, warnings array<string>"


def compiled(df: DataFrame, question: str, banks: dict[str, str] | None = None) -> DataFrame:
    """df with q, the plan of each row's question; banks has the slugs of known names.  Of an empty question nothing is known.

    Every step is a projection of its own, so the rules read the rewritten text and don't rewrite it each.
    """
    low, text = F.col("_low"), F.col("_text")
    staged = df.withColumn("_low", F.coalesce(small(F.col(question)), F.lit(""))).withColumn("_text", rewritten(low))
    staged = staged.withColumns({"_product": product_of(text), "_metric": metric_of(text), "_banks": banks_in(text, banks or {}), "_closed": (low == "") | says(low, STEM, OUTSIDE)})
    product, metric, found = F.col("_product"), F.col("_metric"), F.col("_banks")
    staged = staged.withColumn("_intent", _intent(text, _flags(text, product, found, metric["metric"])))
    intent = F.col("_intent.intent")
    sources = {
        "bank_alias": F.size(found) > 0, "campaign_phrase": says(text, STEM, "kampanya"), "domain_terminology": says(text, STEM, "kâr payı|kar payı|fon havuzu|" + "|".join(CONTRACTS)),
        "participation_bank_phrase": says(text, STEM, "katılım banka"), "product_term": product.isNotNull(), "reward_metric_phrase": F.coalesce(metric["metric"] == "REWARD_AMOUNT", F.lit(False)),
    }
    listed = lambda named: F.array_compact(F.array(*(F.when(c, k) for k, c in named.items())))
    staged = staged.withColumn("_sources", listed(sources))
    warnings = listed({"no_transactions": intent == "complaint_support", "banks_not_named": (intent == "product_comparison") & (F.size(found) < 2)})
    aggregation = F.when(intent == "campaign_count", "COUNT").otherwise(metric["aggregation"])
    whole = {
        "intent": intent, "route": route_of(intent, metric["metric"], aggregation, F.size("_sources") > 0), "product_type": product["product_type"], "financing_type": product["financing_type"], "metric": metric["metric"],
        "aggregation": aggregation, "confidence": F.round("_intent.confidence", 6), "banks": found, "sources": F.col("_sources"), "warnings": warnings,
    }
    nothing = {"intent": F.lit("unknown"), "route": F.lit("SAFE_REDIRECT"), "confidence": F.lit(0.0), "banks": F.array(), "sources": F.array(), "warnings": F.when(low == "", F.array()).otherwise(F.array(F.lit("conventional_finance")))}
    kinds = dict(k.split() for k in KINDS.split(", "))
    struct = lambda own: F.struct(*(own.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()))
    return staged.withColumn("q", F.when(F.col("_closed"), struct(nothing)).otherwise(struct(whole))).drop("_low", "_text", "_product", "_metric", "_banks", "_closed", "_intent", "_sources")
