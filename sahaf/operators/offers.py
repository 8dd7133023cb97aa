"""Comparison of offers and instalment quotes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sahaf.functions.text import title_similarity
from sahaf.sources.io import small

from .ranking import finite, first_per_key, min_max, weighted

#: Weights of the criteria by product type (campaigns are all other types), and of what makes a match.
WEIGHTS = {
    "financing": {"rate": 0.45, "amount": 0.30, "fee": 0.15, "eligibility": 0.10},
    "investment": {"rate": 0.60, "amount": 0.20, "duration": 0.10, "eligibility": 0.10},
    "campaign": {"discount": 0.35, "reward": 0.35, "installment": 0.20, "eligibility": 0.10},
}
MATCHING = {"product_type": 0.35, "subcategory": 0.20, "duration": 0.15, "amount": 0.10, "eligibility": 0.10, "title": 0.10}
NO_REASON = "Yeterli karşılaştırılabilir alan yok"


@dataclass(frozen=True)
class Wanted:
    """What offers are compared for; what is None isn't asked."""

    product_type: str
    currency: str
    duration_days: int | None = None
    eligibility: str | None = None
    financing_type: str | None = None
    amount: float | None = None
    title: str | None = None


def exclusion_reason(wanted: Wanted) -> Column:
    """Why an offer can't be compared; the first reason counts, and what isn't known excludes nothing."""
    differs = lambda c, v: F.col(c).isNotNull() & (F.col(c) != v)
    reason = F.when(differs("product_type", wanted.product_type), "product_type_mismatch").when(differs("currency", wanted.currency), "currency_mismatch")
    return reason.when(differs("audience", wanted.eligibility), "eligibility_mismatch") if wanted.eligibility else reason


def criteria_weights(wanted: Wanted) -> dict[str, float]:
    """The weights that apply; a duration counts only if one is asked for."""
    weights = WEIGHTS.get(wanted.product_type, WEIGHTS["campaign"])
    return {c: w for c, w in weights.items() if c != "duration" or wanted.duration_days is not None}


def match_score(wanted: Wanted) -> Column:
    """The weighted mean of what can be told about how near an offer is to what is wanted; 0 if nothing can."""
    nearness = lambda x, v: F.greatest(F.lit(0.0), 1 - F.abs(finite(x) - v) / max(v, 1))
    same = lambda c, v: F.when(F.coalesce(F.col(c), F.lit("")) != "", (F.col(c) == v).cast("double"))
    terms = {"product_type": same("product_type", wanted.product_type)}
    if wanted.financing_type:
        terms["subcategory"] = same("financing_type", wanted.financing_type)
    if wanted.duration_days is not None:
        terms["duration"] = F.when(F.col("duration_days").isNotNull(), nearness(F.col("duration_days"), wanted.duration_days))
    if wanted.amount is not None:
        terms["amount"] = F.when(finite(F.col("max_amount")).isNotNull(), nearness(F.col("max_amount"), wanted.amount))
    if wanted.eligibility:
        terms["eligibility"] = same("audience", wanted.eligibility)
    if wanted.title:
        terms["title"] = F.when(F.coalesce(F.col("title"), F.lit("")) != "", title_similarity(F.col("title"), F.lit(wanted.title)))
    mean, _ = weighted(terms, {c: MATCHING[c] for c in terms})
    return F.round(F.coalesce(mean, F.lit(0.0)), 4)


def compare(offers: DataFrame, wanted: Wanted, group: list[str] | None = None) -> DataFrame:
    """The offers that fit, with scores and their order; what is missing isn't held against an offer.

    Each criterion is scaled within the group, low rates first for financing.  advantage is the weighted mean of the
    known criteria, confidence the weight that is known; criteria has each one's value, score, weight and part in the
    advantage, missing the names of the others, reason the words for it.  Order is order_keys().
    """
    group, weights = group or [], criteria_weights(wanted)
    fit = offers.where(exclusion_reason(wanted).isNull())
    values = {
        "rate": finite(F.col("rate")), "amount": finite(F.col("max_amount")), "discount": finite(F.col("discount")), "reward": finite(F.col("reward")), "installment": finite(F.col("instalments")),
        "fee": F.when(F.col("fee") == "masrafsız", F.lit(1.0)), "eligibility": F.when(F.coalesce(F.col("audience"), F.lit("")) != "", F.lit(1.0)), "duration": finite(F.col("duration_days")),
    }
    fit = fit.withColumns({f"{c}_value": values[c] for c in weights})
    scored = fit.withColumns({f"{c}_score": min_max(fit, f"{c}_value", group, lower_is_better=wanted.product_type == "financing" and c == "rate") for c in weights})
    advantage, confidence = weighted({c: F.col(f"{c}_score") for c in weights}, weights)
    known = sum((F.when(F.col(f"{c}_score").isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    one = lambda c, w: F.struct(F.lit(c).alias("criterion"), F.col(f"{c}_value").alias("value"), F.round(f"{c}_score", 4).alias("score"), F.lit(w).alias("weight"), F.round(F.round(f"{c}_score", 4) * w / known, 4).alias("contribution"))
    there = lambda c: F.col(f"{c}_score").isNotNull()
    said = {"rate": "düşük kâr payı oranı" if wanted.product_type == "financing" else "yüksek kâr payı oranı", "amount": "açık tutar", "reward": "ödül tutarı"}
    reason = F.concat_ws(", ", *(F.when(there(c), text) for c, text in said.items() if c in weights))
    return scored.withColumns({
        "advantage": F.round(advantage, 4), "confidence": F.round(confidence, 4), "match": match_score(wanted), "criteria": F.array_compact(F.array(*(F.when(there(c), one(c, w)) for c, w in weights.items()))),
        "missing": F.array_compact(F.array(*(F.when(~there(c), F.lit(c)) for c in weights))), "reason": F.when(reason != "", reason).otherwise(NO_REASON),
    }).drop(*(f"{c}_{k}" for c in weights for k in ("value", "score")))


def order_keys() -> list[Column]:
    return [F.col("advantage").isNull(), F.desc("confidence"), F.desc("advantage"), F.desc("match"), F.col("id")]


def instalment(amount: Column, months: Column, percent: Column) -> Column:
    """The monthly annuity for a monthly rate in percent; equal parts at rate zero."""
    r = percent / 100
    growth = F.pow(1 + r, months)
    return F.when(r == 0, amount / months).otherwise(amount * r * growth / (growth - 1))


def annual_cost(percent: Column) -> Column:
    """The effective rate of twelve months, in percent."""
    return (F.pow(1 + percent / 100, F.lit(12)) - 1) * 100


def eligible(offers: DataFrame, amount: float, months: int, as_of: Column) -> DataFrame:
    """Financing offers that run, have a rate, and allow amount and term; limits that aren't given allow all."""
    return offers.where((F.col("product_type") == "financing") & F.col("rate").isNotNull() & F.coalesce(F.col("max_amount") >= amount, F.lit(True)) & F.coalesce(F.col("term_months") >= months, F.lit(True)) & F.coalesce(F.col("end_date").cast("date") >= as_of, F.lit(True)))


def quotes(banks: DataFrame, official: DataFrame, offers: DataFrame, amount: float, months: int, as_of: Column) -> DataFrame:
    """A row per bank: its official quote, else its freshest eligible offer, else none.

    Rates of offers are fractions and become percent here, rates of official quotes are percent already.
    """
    fresh = first_per_key(eligible(offers, amount, months, as_of), ["bank_id"], [F.desc("end_date"), F.col("id")]).select("bank_id", (F.col("rate") * 100).alias("offer_rate"))
    joined = banks.join(official.select("bank_id", F.col("percent").alias("official_rate")), "bank_id", "left").join(fresh, "bank_id", "left")
    rate = F.coalesce("official_rate", "offer_rate")
    status = F.when(F.col("official_rate").isNotNull(), "official").when(F.col("offer_rate").isNotNull(), "calculated").otherwise("unsupported")
    monthly = F.round(instalment(F.lit(amount), F.lit(months), rate), 2)
    return joined.select("bank_id", status.alias("status"), F.round(rate, 6).alias("percent"), monthly.alias("monthly"), F.round(monthly * months, 2).alias("total"), F.round(annual_cost(rate), 4).alias("annual"))


def first_band(requests: DataFrame, bands: DataFrame) -> DataFrame:
    """requests (request_id, months, amount) with the rate of the first band (pos) that holds term and amount."""
    holds = (F.col("months").between(F.col("min_months"), F.col("max_months"))) & F.coalesce(F.col("amount") >= F.col("min_amount"), F.lit(True)) & F.coalesce(F.col("amount") <= F.col("max_amount"), F.lit(True))
    found = requests.join(small(bands, 10_000), holds, "left")
    return found.groupBy("request_id").agg(F.min_by("band_rate", "pos").alias("band_rate"))
