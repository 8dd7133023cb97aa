"""What may be asked, which tools may be called with what, and what an answer may claim; all as columns."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sahaf.functions import numbers as n
from sahaf.functions import patterns as pt

#: Letters of which the compatible form is one letter with marks, and that letter.
_MARKED = [c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if c == c.lower() and len(unicodedata.normalize("NFKD", c)) > 1 and unicodedata.combining(unicodedata.normalize("NFKD", c)[1])]
_PLAIN = "".join(unicodedata.normalize("NFKD", c)[0] for c in _MARKED)


def plain(x: Column) -> Column:
    """Lower case without marks on letters, the dotless i as i."""
    return F.translate(F.regexp_replace(F.lower(x), r"\p{M}+", ""), "".join(_MARKED) + "ı", _PLAIN + "i")


# Numbers that no question may hold, and concepts with the actions that make a clause a request.
IDENTIFIERS = [r"(?i)(?<![\p{L}\p{N}_])TR\d{24}(?![\p{L}\p{N}_])", r"(?<!\d)(?:\d[ -]?){15,19}(?!\d)", r"(?<!\d)\d{11}(?!\d)"]
INTERNALS = r"\b(?:(?:sistem|system|gelistirici|developer)\s+(?:prompt\w*|talimat\w*|instruction\w*)|(?:gizli|sakli|hidden)\s+(?:politika\w*|polic\w*|talimat\w*|instruction\w*|prompt\w*|anahtar\w*|kimlik bilg\w*|credential\w*|secret\w*)|api\s+(?:key\w*|anahtar\w*)|(?:credential|secret)\w*)\b"
EXTRACTS = r"\b(?:goster\w*|acikla\w*|paylas\w*|yazdir\w*|ver\w*|ifsa\w*|cikar\w*|show\w*|reveal\w*|print\w*|expose\w*|repeat\w*)\b"
APPLIES = r"\b(?:basvuru\w*|finansman\w*)\b"
REQUESTS = [
    (r"\b(?:havale\w*|eft\w*|para transfer\w*)\b", r"\b(?:yap\w*|gonder\w*|aktar\w*|gerceklestir\w*)\b"),
    (r"\bsikayet\w*\b", r"\b(?:olustur\w*|kaydet\w*|ac(?:mak|in(?:iz)?)?|ilet(?:mek|in(?:iz)?)?)\b"),
    (APPLIES, r"\b(?:basvur(?:mak|mayi|uyorum|urum|alim|un(?:uz)?|acag\w*|abilir\w*)?|yap\w*)\b"),
    (r"\b(?:kart\s+)?sifre\w*\b", r"\b(?:unutt(?:um|un|u|unuz)|sifirla(?:y(?:in|iniz))?|belirle(?:y(?:in|iniz))?|yenile(?:y(?:in|iniz))?|degistir(?:in|iniz)?|(?:sifirla|belirle|yenile|degistir|olustur)mek\s+ist\w*|olustur(?:un|unuz)?)\b"),
    (r"\bpara\s+cek\w*\b", r"\b(?:olustur\w*|talep\s+et\w*|cek(?:in|iniz)?|cekmek\s+ist\w*)\b"),
    (r"\b(?:kart\w*|hesap\w*|hesab\w*|basvuru\w*|finansman\w*|limit\w*|sifre\w*)\b", r"\b(?:iptal\s+e(?:t|din|der\s+misiniz)|(?:kapat|dondur|artir|degistir|gonder|yenile)(?:in|iniz|un|unuz)?|geri\s+cek(?:in|iniz)?|(?:iptal\s+etmek|kapatmak|dondurmak|artirmak|degistirmek|gondermek|yenilemek|geri\s+cekmek)\s+ist(?:iyorum|iyoruz|erim))\b"),
]
#: Questions about applications that ask for advice, not for an application.
ADVICE = r"\b(?:karsilastir\w*|kiyasla\w*|en\s+(?:dusuk|yuksek|uygun|avantajli)\w*|hangi\s+(?:banka|finansman|urun)\w*|nasil\s+(?:yap\w*|uygula\w*|kullan\w*|calis\w*))\b"
WITH_SUM, WITH_TERM = r"(?<!\d)\d[\d.,]*\s*(?:bin|milyon)?\s*(?:tl|try|₺)\b", r"(?<!\d)\d{1,3}\s*ay(?:lik)?\b"
CLAUSES = r"[.!?;,\n]+|\b(?:ve|ama|fakat|ancak|and|but)\b"


def _has(x: Column, pattern: str) -> Column:
    return x.rlike(pt.java(pattern))


def guard(question: Column) -> Column:
    """(action, intent): REDIRECT for personal numbers, REFUSE for internals, REDIRECT for transactions; null if none.

    Internals and transactions need a concept and an action within one clause.  A null question holds nothing.
    """
    low = plain(question)
    clauses = F.split(low, pt.java(CLAUSES))
    asks = lambda concept, action: F.exists(clauses, lambda c: _has(c, concept) & _has(c, action))
    advice = _has(low, APPLIES) & (_has(low, ADVICE) | (_has(low, WITH_SUM) & _has(low, WITH_TERM)))
    wanted = [asks(c, a) & ~advice if c == APPLIES else asks(c, a) for c, a in REQUESTS]
    verdict = lambda action, intent: F.struct(F.lit(action).alias("action"), F.lit(intent).alias("intent"))
    personal = reduce(lambda a, b: a | b, (question.rlike(p) for p in IDENTIFIERS))
    return F.when(personal, verdict("REDIRECT", "sensitive_data")).when(asks(INTERNALS, EXTRACTS), verdict("REFUSE", "internal_information")).when(reduce(lambda a, b: a | b, wanted), verdict("REDIRECT", "transaction_execution"))


# The tools of an intent, a tool's arguments, and the values that arguments may have.
INTENT_TOOLS = {
    "application_requirements": ["hybrid_rag"], "bank_list": ["structured_sql"], "campaign_count": ["structured_sql"], "campaign_query": ["hybrid_rag"], "complaint_support": [], "definition": ["hybrid_rag", "ontology"],
    "maturity_query": ["structured_sql"], "product_comparison": ["structured_sql", "comparison", "financing_quote"], "product_search": ["structured_sql", "hybrid_rag"], "rate_query": ["structured_sql"], "relationship_query": ["hybrid_rag", "ontology"],
    "trade_finance_query": ["hybrid_rag"], "agriculture_finance_query": ["hybrid_rag"], "investment_query": ["hybrid_rag"], "transaction_howto": [],
}
_FILTERS, _CRITERIA = ["banks", "product_type", "financing_type"], ["term_months", "amount", "fee_priority"]
TOOL_ARGUMENTS = {
    "structured_sql": [*_FILTERS, "metric", "aggregation", *_CRITERIA], "hybrid_rag": _FILTERS, "comparison": [*_FILTERS, *_CRITERIA],
    "financing_quote": ["banks", "financing_type", "term_months", "term_months_min", "term_months_max", "amount", "fee_priority"], "ontology": [*_FILTERS, "query", "domain", "term", "term_id"],
}
ENUMS = {"metric": ["PROFIT_RATE", "MATURITY", "FEE", "REWARD_AMOUNT"], "aggregation": ["MIN", "MAX", "COUNT"], "product_type": ["account", "card", "financing", "investment", "payment", "insurance"], "financing_type": ["housing", "vehicle", "consumer", "commercial", "agriculture"]}
QUOTED, QUOTE_NEEDS, MOST_MONTHS, MOST_AMOUNT, WIDEST = ["consumer", "vehicle", "housing", "commercial"], ["financing_type", "term_months", "amount", "fee_priority"], 240, 100_000_000, 23


def _of(table: dict[str, list[str]], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))]), key)


def valid_call(intent: Column, call: Column, banks: list[str]) -> Column:
    """Whether a call, as JSON {"name", "arguments"}, is one of the intent's tools with known arguments of the right kinds and bounds.

    Whole numbers are whole in the JSON too, and truth values are no numbers.  A quote needs its four arguments; a range
    of terms has both ends, is at most two years wide, and ends in the term.  What is no such JSON is no valid call.
    """
    v = F.try_parse_json(call)
    name, arguments = F.try_variant_get(v, "$.name", "string"), F.try_variant_get(v, "$.arguments", "variant")
    outer, keys = F.json_object_keys(call), F.json_object_keys(F.to_json(arguments))
    kind = lambda k: F.schema_of_variant(F.try_variant_get(arguments, f"$.{k}", "variant"))
    has = lambda k: F.array_contains(keys, k)
    whole = lambda k: kind(k) == "BIGINT"
    number = lambda k: kind(k).rlike(r"^(BIGINT|DOUBLE|DECIMAL)")
    get = lambda k, t: F.try_variant_get(arguments, f"$.{k}", t)
    either = lambda k, rule: ~has(k) | F.coalesce(rule, F.lit(False))

    known = F.size(F.array_except(keys, _of(TOOL_ARGUMENTS, name))) == 0
    listed = kind("banks").isin("ARRAY<STRING>", "ARRAY<VOID>") & F.forall(get("banks", "array<string>"), lambda b: b.isin(banks))
    rules = [either("banks", listed)] + [either(k, (kind(k) == "STRING") & get(k, "string").isin(allowed)) for k, allowed in ENUMS.items()]
    rules += [either("term_months", whole("term_months") & (get("term_months", "long") > 0)), either("amount", number("amount") & (get("amount", "double") >= 0)), either("fee_priority", kind("fee_priority") == "BOOLEAN")]
    term, first, last, amount = get("term_months", "long"), get("term_months_min", "long"), get("term_months_max", "long"), get("amount", "double")
    absent = lambda k: ~has(k) | (kind(k) == "VOID")
    no_range = absent("term_months_min") & absent("term_months_max")
    range_ = whole("term_months_min") & whole("term_months_max") & first.between(1, MOST_MONTHS) & (last >= first) & (last <= MOST_MONTHS) & (last - first <= WIDEST) & (term == last)
    needed = F.size(F.array_except(F.array(*map(F.lit, QUOTE_NEEDS)), keys)) == 0
    quote = needed & get("financing_type", "string").isin(QUOTED) & whole("term_months") & term.between(1, MOST_MONTHS) & number("amount") & (amount > 0) & (amount <= MOST_AMOUNT) & (no_range | range_)
    shaped = (F.array_sort(outer) == F.array(F.lit("arguments"), F.lit("name"))) & F.array_contains(_of(INTENT_TOOLS, intent), name) & F.schema_of_variant(arguments).startswith("OBJECT")
    every = reduce(lambda a, b: a & b, rules, shaped & known) & ((name != "financing_quote") | F.coalesce(quote, F.lit(False)))
    return F.coalesce(every, F.lit(False))


def canonical(call: Column) -> Column:
    """A call's JSON with sorted keys, by which calls are compared."""
    return F.to_json(F.try_parse_json(call))


def authorised(validated: Column, call: Column) -> Column:
    """Whether a call may run: it is exactly the one that was validated, whatever the order of its arguments."""
    return F.coalesce(canonical(validated) == canonical(call), F.lit(False))


def missing(criteria: Column) -> Column:
    """The names of a comparison's criteria that aren't known yet, in the order in which they are asked for."""
    return F.array_compact(F.array(*(F.when(criteria[k].isNull(), k) for k in _CRITERIA)))


def decide(in_domain: Column, action: Column, intent: Column, calls: Column, criteria: Column, banks: list[str]) -> Column:
    """(action, reason) of a proposed decision: outside the domain it is refused, then for a bad call; a refusal or a redirect
    stands; a comparison without its criteria is asked for them; else the proposal stands."""
    bad = F.exists(calls, lambda c: ~valid_call(intent, c, banks))
    named = lambda c: F.try_variant_get(F.try_parse_json(c), "$.name", "string")
    argument = lambda c, k: F.try_variant_get(F.try_parse_json(c), f"$.arguments.{k}", "string")
    financing = F.exists(calls, lambda c: F.coalesce((named(c) == "financing_quote") | ((named(c) == "comparison") & (F.coalesce(argument(c, "product_type") == "financing", F.lit(False)) | argument(c, "financing_type").isNotNull())), F.lit(False)))
    ask = (intent == "product_comparison") & (F.size(missing(criteria)) > 0) & ((action == "CLARIFY") | financing | (F.size(calls) == 0))
    out = lambda a, r: F.struct(a.alias("action"), F.lit(r).cast("string").alias("reason"))
    return F.when(~in_domain, out(F.lit("REFUSE"), "out_of_domain")).when(bad, out(F.lit("REFUSE"), "invalid_tool_plan")).when(action.isin("REFUSE", "REDIRECT"), out(action, None)).when(ask, out(F.lit("CLARIFY"), "missing_comparison_criteria")).otherwise(out(action, None))


def merged(local: Column, proposed: Column, names: list[str]) -> Column:
    """A plan whose empty slots are filled from a proposal; nothing that it has is overridden."""
    return reduce(lambda c, k: c.withField(k, F.coalesce(local[k], proposed[k])), names, local)


# Criteria as questions word them.
RANGE = r"(?<!\d)(\d{1,3})\s*\.?\s*[-–—]\s*(\d{1,3})\s*ay(?:l[ıi]k)?\b"
TERM = r"(?<!\d)(\d{1,4})\s*ay(?:l[ıi]k)?\b"
MONEY = r"(?<!\d)(\d[\d.,]*)\s*(bin|milyon)?\s*(?:(?:TL|TRY)\b|₺)"
FEE = r"(?:masraf\s+(?:oncelikli|onemli|oncelig(?:iyle|im(?:\s+var)?|ine\s+gore))|(?:dusuk|az)\s+masraf|masrafsiz|masraf\s+yok)"
NO_FEE = r"(?:masraf\s+(?:oncelikli|onemli)(?:\s+olmasin)?\s+(?:degil|olmasin)|masraf\s+onceligim\s+(?:degil|yok)|masraf\s+onemli\s+degil|(?:dusuk|az)\s+masraf\s+(?:istemiyorum|onceligim\s+degil)|az\s+masraf\s+onceligim\s+degil)"
YES, NO = r"^\s*(?:var|evet|olsun|istiyorum|onemli)\s*[.!]?\s*$", r"^\s*(?:yok|hayir|istemiyorum|onemli\s+degil|fark\s+etmez)\s*[.!]?\s*$"
BARE_MONTHS = r"^\s*(\d{1,3})\s*[.!]?\s*$"


def criteria(text: Column) -> Column:
    """(term_months, term_months_min, term_months_max, amount, fee_priority) as far as a text names them."""
    found = lambda p, g: F.nullif(F.regexp_extract(text, pt.java(p, True), g), F.lit(""))
    a, b = found(RANGE, 1).cast("int"), found(RANGE, 2).cast("int")
    first, last = F.least(a, b), F.greatest(a, b)
    ranged = F.coalesce((first >= 1) & (last <= MOST_MONTHS) & (last - first <= WIDEST), F.lit(False))
    alone = found(TERM, 1).cast("int")
    factor = F.when(F.lower(found(MONEY, 2)) == "bin", 1_000).when(F.lower(found(MONEY, 2)) == "milyon", 1_000_000).otherwise(1)
    amount = (n.parse_number(found(MONEY, 1)) * factor).cast("double")
    clauses = F.split(plain(text), "[;,.!?]+")
    told = F.get(F.filter(F.transform(clauses, lambda c: F.when(_has(c, NO_FEE), False).when(_has(c, FEE), True)), lambda x: x.isNotNull()), 0)
    return F.struct(
        F.when(ranged, last).when(alone.between(1, 1200), alone).alias("term_months"),
        F.when(ranged, first).alias("term_months_min"),
        F.when(ranged, last).alias("term_months_max"),
        F.when((amount > 0) & (amount <= 1_000_000_000), amount).alias("amount"),
        told.alias("fee_priority"),
    )


def bare_months(text: Column) -> Column:
    """A number of months as the whole of an answer."""
    value = F.nullif(F.regexp_extract(text, BARE_MONTHS, 1), F.lit("")).cast("int")
    return F.when(value.between(1, MOST_MONTHS), value)


def bare_choice(text: Column) -> Column:
    """A yes or a no as the whole of an answer."""
    low = plain(text)
    return F.when(_has(low, NO), False).when(_has(low, YES), True)


# What counts as a claim.
CITATION, MARKER = r"\[(\d{1,3})\]", r"(?m)^\s*\d{1,3}[.)]\s+"
RATE_CLAIM = r"%\s*\d[\d.,]*|\d[\d.,]*\s*%"
MONEY_CLAIM = r"(?:[₺$€£]\s*\d[\d.,]*(?:\s*milyon)?|\d[\d.,]*(?:\s*milyon)?\s*(?:TL|TRY|USD|EUR|GBP|₺|\$|€|£))(?![\p{L}\p{N}_])"
DURATION_CLAIM = r"(?<!\d)\d{1,4}\s*(?:gün|gun|ay|yıl|yil)(?![\p{L}\p{N}_])"
NUMBER_CLAIM = r"(?<![\p{L}\p{N}_])\d[\d.,]*"
#: What claims of numbers begin with: looked at first, most places of a text are passed over at once.
STARTS = r"(?=[\d%₺$€£])"
FREE_CLAIM = r"masrafsız|masrafsiz|ücretsiz|ucretsiz"
BULLETS = r"^(?:- |\* |• )"


def claims(text: Column) -> Column:
    """Signatures of what a text claims: rates, sums, durations, other numbers, freedom from fees.

    Citations and the numbers of lists are no claims; a number within a rate, a sum or a duration is told once.
    """
    return pt.let(F.regexp_replace(F.regexp_replace(text, CITATION, ""), MARKER, ""), _claims)


def _claims(bare: Column) -> Column:
    """claims() of a text without citations and numbers of lists."""

    def typed(rest: Column, pattern: str, sign) -> Column:
        return F.transform(F.regexp_extract_all(rest, F.lit(f"(?iu){STARTS}(?:{pattern})"), F.lit(0)), sign)

    number = lambda x: n.parse_number(x).cast("double").cast("string")
    money = lambda x: F.concat(F.lit("money:"), (n.parse_number(x) * F.when(F.lower(x).contains("milyon"), 1_000_000).otherwise(1)).cast("double").cast("string"), F.lit(":"), F.coalesce(n.money(x)["currency"], F.lit("")))
    length = lambda x: pt.let(n.duration(x), lambda d: F.concat(F.lit("duration:"), d["value"].cast("string"), F.lit(":"), d["unit"]))
    others = F.regexp_replace(bare, f"(?iu){STARTS}(?:{RATE_CLAIM}|{MONEY_CLAIM}|{DURATION_CLAIM})", " ")
    none = F.array().cast("array<string>")
    numbers = F.concat(
        F.when(F.contains(bare, F.lit("%")), typed(bare, RATE_CLAIM, lambda x: F.concat(F.lit("rate:"), number(x)))).otherwise(none),
        typed(bare, MONEY_CLAIM, money),
        typed(bare, DURATION_CLAIM, length),
        typed(others, NUMBER_CLAIM, lambda x: F.concat(F.lit("number:"), number(x))),
    )
    every = F.concat(F.when(bare.rlike(r"\d"), numbers).otherwise(none), F.when(bare.rlike(f"(?iu)(?=[müu])(?:{FREE_CLAIM})"), F.array(F.lit("fee:free"))).otherwise(none))
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull()))


def supported(answer: Column, signatures: Column) -> Column:
    """(text, dropped): an answer without the list items whose claims the sources that they cite don't hold.

    signatures are the sources' claims, an array for each, cited from 1.  An item with claims and no citation goes; lines
    that are no list items stay.
    """

    def holds(line: Column) -> Column:
        cited = F.transform(F.regexp_extract_all(line, F.lit(CITATION), F.lit(1)), lambda x: x.cast("int"))
        known = F.flatten(F.transform(F.filter(cited, lambda k: (k >= 1) & (k <= F.size(signatures))), lambda k: F.get(signatures, k - 1)))
        good = pt.let(claims(line), lambda own: (F.size(own) == 0) | ((F.size(cited) > 0) & (F.size(F.array_except(own, known)) == 0)))
        return ~F.trim(line).rlike(BULLETS) | good

    lines = F.split(answer, "\n")
    return pt.let(F.filter(lines, holds), lambda kept: F.struct(F.array_join(kept, "\n").alias("text"), (F.size(lines) - F.size(kept)).alias("dropped")))
