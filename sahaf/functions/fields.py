"""A record's fields out of its text, as columns of Spark, with evidence and status.

Each field is an expression of its own in one struct, so a plan that takes one field computes no other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import numbers as n
from . import patterns as pt

# What fields look like in texts, in the order in which they are tried.
NUMBER = r"\d[\d.,]*"
SHARE = r"k[aâ]r\s+pay[ıi](?:\s+oran[ıi])?"
MONEY = rf"(?:[₺$€£]\s*{NUMBER}|{NUMBER}(?:\s+milyon)?\s*(?:TL|₺|TRY|USD|\$|EUR|€|GBP|£))"
RATES = [rf"%\s*({NUMBER})\s*{SHARE}", rf"{SHARE}\s*%\s*({NUMBER})", rf"({NUMBER})\s*%\s*{SHARE}", rf"%\s*({NUMBER})\s*(?:k[aâ]r\s+pay[ıi]\s+)?oran(?:[ıi]|ından|li|lı)?", rf"oran(?:ı|i)?\s*%\s*({NUMBER})", rf"%\s*({NUMBER})\s+oran"]
DISCOUNT = rf"(?:%\s*({NUMBER})|({NUMBER})\s*%)\s*(?:indirim|iade)"
TERM = r"(?<!\d)(\d{1,3})\s*ay\s*(?:vade|vadeli)"
DURATION = r"(?<!\d)\d{1,4}\s*(?:gün|gun|ay|yıl|yil)(?:\s*(?:vade|vadeli))?"
INSTALMENT = r"(?<!\d)(\d{1,3})\s*(?:aya\s+varan\s+|ay\s+)?taksit"
REWARD = rf"({MONEY})(?=[^.!?]{{0,60}}(?:ödül|odul|iade|puan|bonus|bankkart\s+lira|parafpara|worldpuan|altın\s+puan|altin\s+puan|hediye\s+bakiye|hediye))"
MOST = rf"({MONEY})(?:['’]?ye|\s+tutar[aı])?\s+kadar"
LEAST = rf"en\s+az\s+({MONEY})(?:\s+ile)?"
CHANNEL = r"\b(mobil uygulama|mobil bankacılık|mobil bankacilik|mobilden|internet şubesi|internet subesi|internet şube|internet sube|görüntülü görüşme|goruntulu gorusme|şube|sube|çağrı merkezi|cagri merkezi)\b"
CONDITION = r"((?:en\s+az\s+[^!?]{1,80}?|[^.!?]{1,80}?))\s+(?:şart(?:ı|ını)?|koşul(?:u|uyla)?)"
#: A product: words of which all sets must have one in the text in lower case, and what shows it.
PRODUCTS = [
    ("financing", [["finansman"]]),
    ("investment", [["kur fırsat"], ["müşterimiz olun"]]),
    ("investment", [["günlük hesap"], ["vadeni boz"]]),
    ("card", [["kart", "bonus"]]),
    ("investment", [["yatırım", "yatirim", "katılma hesab", "katilma hesab", "altın", "altin"]]),
    ("shopping_points", [["alışveriş puan", "alisveris puan", "worldpuan", "parafpara"]]),
    ("new_customer", [["yeni müşteri", "yeni musteri", "ilk kez müşteri", "ilk kez musteri"]]),
]
PRODUCT_SHOWN = {
    "financing": r"(?:[^\s.]+\s+)?finansman(?:[ıi])?\b",
    "card": "kart|bonus",
    "investment": r"yatırım|yatirim|katılma hesabı|katilma hesabı|altın|altin|kur\s+fırsat\w*|günlük\s+hesap\w*|vadeni\s+boz\w*",
    "shopping_points": "alışveriş puanı|alisveris puanı|alisveris puan|worldpuan|parafpara",
    "new_customer": "yeni müşteri|yeni musteri|ilk kez müşteri|ilk kez musteri",
}
FINANCINGS = [("housing", ["konut"]), ("vehicle", ["taşıt", "tasit", "araç", "arac"]), ("consumer", ["ihtiyaç", "ihtiyac"])]
FINANCING_SHOWN = "konut|taşıt|tasit|araç|arac|ihtiyaç|ihtiyac"
#: An audience: words of which one must be in the sentence in lower case, and the pattern that must match it and shows it.
AUDIENCES = [
    (
        "new_customer",
        ["yeni müşteri", "yeni musteri", "ilk kez müşteri", "ilk kez musteri", "müşteri olan", "musteri olan", "müşteri olun", "musteri olun", "türkiye finanslı", "turkiye finansli", "kuveyt türklü", "kuveyt turklu", "albarakalı", "albarakali", "hayat finanslı", "hayat finansli", "vakıf katılımlı", "vakif katilimli", "ziraat katılımlı", "ziraat katilimli", "hadi'li", "hadili", "kart sahibi olun", "hoş geldin", "hos geldin", "onboarding"],
        r"yeni\s+müşteri(?:ler[ea]?|miz)?|yeni\s+musteri(?:ler[ea]?|miz)?|ilk\s+kez\s+müşteri(?:ler[ea]?|miz)?|ilk\s+kez\s+musteri(?:ler[ea]?|miz)?|müşteri\s+olan(?:lar)?|musteri\s+olan(?:lar)?|müşteri\s+olun|musteri\s+olun|mobilden\s+[^.!?\n]{1,30}?\s*müşteri\s+ol\w*|mobilden\s+[^.!?\n]{1,30}?\s*musteri\s+ol\w*|(?:türkiye\s+finanslı|turkiye\s+finansli|kuveyt\s+türklü|kuveyt\s+turklu|albarakalı|albarakali|hayat\s+finanslı|hayat\s+finansli|vakıf\s+katılımlı|vakif\s+katilimli|ziraat\s+katılımlı|ziraat\s+katilimli|hadi'li|hadili)\s+ol\w*|kart\s+sahibi\s+olun|hoş\s+geldin|hos\s+geldin|onboarding",
    ),
    ("retiree", ["emekli"], r"emekli(?:ler[ea]?|miz|ye)?|emekli\s+maaş\w*|emekli\s+maas\w*"),
    ("public_sector", ["kamu çalışan", "kamu calisan", "kamu personel", "sağlık meslek", "saglik meslek", "doktor", "öğretmen", "ogretmen"], r"kamu\s+(?:çalışan|calisan|personel)\w*|sağlık\s+meslek|saglik\s+meslek|\bdoktor\w*|\böğretmen\w*|\bogretmen\w*"),
    ("commercial", ["esnaf", "kobi", "ticari", "tüzel", "tuzel", "çiftçi", "ciftci", "tarım", "tarim", "işletme", "isletme", "pilot"], r"\b(?:esnaf|kobi|ticari|tüzel|tuzel|çiftçi|ciftci|tarım|tarim|işletme|isletme|pilot\w*)\b"),
    ("student", ["öğrenci", "ogrenci", "genç", "genc", "üniversite", "universite", "kampüs", "kampus"], r"\b(?:öğrenci\w*|ogrenci\w*|genç\w*|genc\w*|üniversite\w*|universite\w*|kampüs\w*|kampus\w*)\b"),
    (
        "existing_customer",
        ["bankkart", "paraf", "world", "sağlam kart", "saglam kart", "hadi", "vkart", "biz kart", "dkart", "troy", "kartınız", "kartiniz", "kart sahip", "debit kart", "sanal kart", "bireysel müşteri", "bireysel musteri", "mevcut müşteri", "mevcut musteri", "bankamız müşteri", "bankamiz musteri", "müşterilerimize özel", "musterilerimize ozel", "müşterilerine özel", "musterilerine ozel", "müşterimize özel", "musterimize ozel", "müşteri bazlı", "musteri bazli", "işlem yapan müşteri", "islem yapan musteri", "katılma hesabı", "katilma hesabi", "mevduat", "vadesiz hesap", "avantajlı hesap", "avantajli hesap"],
        r"(?:bankkart|paraf|world|sağlam\s+kart|saglam\s+kart|hadi|vkart|biz\s+kart|dkart|troy)\s+(?:kredi\s+)?kart\w*|kartınız(?:la)?|kartiniz(?:la)?|kart\s+sahip\w*|debit\s+kart\w*|sanal\s+kart\w*|(?:bireysel|tüm\s+bireysel|mevcut|bankamız|bankamiz)\s+müşteri\w*|(?:bireysel|tüm\s+bireysel|mevcut|bankamız|bankamiz)\s+musteri\w*|müşteri(?:lerimize|lerine|mize)\s+özel|musteri(?:lerimize|lerine|mize)\s+ozel|müşteri\s+bazlı|musteri\s+bazli|işlem\s+yapan\s+müşteri\w*|islem\s+yapan\s+musteri\w*|(?:hayat\s+finanslı|kuveyt\s+türklü|albarakalı|türkiye\s+finanslı|ziraat\s+katılımlı|vakıf\s+katılımlı|hadi'li)\w*\s+özel|(?:avantajlı|katılma|mevduat|vadesiz)\s+hesap\s+(?:açan\s+)?(?:bireysel\s+)?müşteri\w*",
    ),
]
EXCLUDED = ["dahil değil", "dahil degil", "geçerli değil", "gecerli degil", "hariç", "haric", "kapsam dışı", "kapsam disi"]
BENEFITS = ["avantaj", "indirim", "ödül", "odul", "iade", "masrafsız", "masrafsiz", "ücretsiz", "ucretsiz", "muafiyet", "hediye"]
FREE = ["masrafsız", "masrafsiz"]
#: Units of fields, words that promise one, fields that a product has none of, confidence by status.
FIELD_UNITS = {"profit_share_rate": "RATIO", "discount_rate": "RATIO", "term_months": "MONTH", "installment_count": "COUNT", "campaign_start_date": "DATE", "campaign_end_date": "DATE"}
PROMISES = {
    "profit_share_rate": "kâr payı|kar payı|oran", "term_months": "vade", "installment_count": "taksit", "reward_amount": "ödül|odul|puan|bonus|iade", "discount_rate": "indirim",
    "target_audience": "müşteri|musteri|hedef kitle", "fee_information": "masraf|ücret|ucret|tahsis", "campaign_start_date": "başlangıç|baslangic|tarih", "campaign_end_date": "bitiş|bitis|tarih|kadar",
}
VAGUE_RATE = "avantajlı kâr payı|avantajlı kar payı|avantajlı oran"
NONE_OF = {**dict.fromkeys(("card", "shopping_points", "new_customer"), ("profit_share_rate", "term_months", "financing_amount")), "investment": ("installment_count", "discount_rate")}
CONFIDENCE = {"EXPLICIT": 0.99, "IMPLICIT": 0.75, "NOT_STATED": 1.0, "NOT_APPLICABLE": 1.0, "EXTRACTION_FAILED": 0.0, "CONFLICT": 0.5}
METHOD = "rules-v1"
CORE = "product_type financing_type profit_share_rate financing_amount term_months installment_count campaign_benefit reward_amount discount_rate target_audience campaign_start_date campaign_end_date fee_information application_channel condition".split()

SUM = "struct<amount:double,currency:string,minor:long>"
KINDS = {
    "product_type": "string", "financing_type": "string", "profit_share_rate": "double", "rate_candidates": "array<double>", "financing_amount": SUM, "term_months": "int", "duration": "struct<value:int,unit:string,approx_days:int>",
    "installment_count": "int", "campaign_benefit": "string", "reward_amount": SUM, "min_amount": SUM, "max_amount": SUM, "discount_rate": "double", "target_audience": "string", "fee_information": "string",
    "application_channel": "string", "condition": "string", "evidence": "map<string,string>",
}


def lower(x: Column) -> Column:
    return F.replace(F.lower(x), F.lit("i̇"), F.lit("i"))


def _has(x: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(x, F.lit(w)) for w in words))


def _found(text: Column, pattern: str, group: int = 0, word: str = "") -> Column:
    """The first match, or a group of it; null if there is none.  word is one that stands in every match, and is looked for first."""
    found = F.nullif(F.regexp_extract(text, pt.java(pattern, True), group), F.lit(""))
    return F.when(text.rlike(pt.java(word, True)), found) if word else found


def _every(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pt.java(pattern, True)), F.lit(group))


def ratio(raw: Column) -> Column:
    """A percentage as a fraction of six places."""
    return F.round(n.parse_number(raw).cast("double") / 100, 6)


def total(raw: Column) -> Column:
    """A sum of money as (amount, currency, minor units); null if raw is."""

    def sum_of(raw: Column) -> Column:
        mark = F.lower(F.regexp_extract(raw, "(?i)[₺$€£]|TL|TRY|USD|EUR|GBP", 0))
        currency = F.try_element_at(F.create_map(*[F.lit(v) for kv in n.CURRENCIES.items() for v in kv]), mark)
        amount = n.parse_number(raw) * F.when(lower(raw).contains("milyon"), 1_000_000).otherwise(1)
        return F.when(raw.isNotNull(), pt.let(amount, lambda a: F.struct(a.cast("double").alias("amount"), currency.alias("currency"), n.minor_units(a).alias("minor"))))

    return pt.let(raw, sum_of)


def rates(text: Column) -> Column:
    """The distinct profit rates of a text, ascending."""
    raw = F.when(F.contains(text, F.lit("%")), F.array_distinct(F.concat(*(_every(text, p) for p in RATES)))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.transform(raw, ratio)))


def rate_shown(text: Column) -> Column:
    """The first words that give a profit rate."""

    def place(pattern: str) -> Column:
        raw, at = _found(text, pattern), F.regexp_instr(text, F.lit(pt.java(pattern, True)))
        return F.when(raw.isNotNull(), F.struct(at.alias("at"), F.length(raw).alias("n"), raw.alias("raw")))

    return F.array_min(F.array_compact(F.array(*map(place, RATES))))["raw"]


def product_type(text: Column) -> Column:
    low = lower(text)
    return reduce(lambda c, p: c.when(reduce(lambda a, b: a & b, (_has(low, words) for words in p[1])), p[0]), PRODUCTS[1:], F.when(_has(low, PRODUCTS[0][1][0]), PRODUCTS[0][0]))


def financing_type(text: Column) -> Column:
    low = lower(text)
    return reduce(lambda c, p: c.when(_has(low, p[1]), p[0]), FINANCINGS[1:], F.when(_has(low, FINANCINGS[0][1]), FINANCINGS[0][0]))


def audience(text: Column, shown: bool = True) -> Column:
    """(label, shown): the first audience of the first sentence that names one and excludes nothing, and the words that show it; only the label if they are not wanted."""

    def told(sentence: Column, low: Column) -> Column:
        out = None
        for label, words, pattern in AUDIENCES:
            this = _has(low, words) & sentence.rlike(pt.java(pattern, True))
            value = F.struct(F.lit(label).alias("label"), _found(sentence, pattern).alias("shown")) if shown else F.lit(label)
            out = F.when(this, value) if out is None else out.when(this, value)
        return F.when(~_has(low, EXCLUDED), out)

    sentences = F.split(text, r"(?U)[\n.!?;]+|\s{2,}")
    return F.get(F.filter(F.transform(sentences, lambda s: pt.let(lower(s), lambda low: told(s, low))), lambda x: x.isNotNull()), 0)


def benefit(text: Column) -> Column:
    """The first sentence about an advantage, at most 500 characters of it."""
    return F.left(F.get(F.filter(F.split(F.regexp_replace(text, r"(?U)\A\s+|\s+\z", ""), r"(?U)(?<=[.!?])\s+"), lambda s: pt.let(lower(s), lambda low: _has(low, BENEFITS))), 0), F.lit(500))


def duration(text: Column) -> Column:
    return n.duration(F.coalesce(_found(text, TERM), _found(text, DURATION)))


def evidence(text: Column, product: Column, told: Column, names: list[str] | None = None) -> Column:
    """The words that show each field, or each of names, that has some."""
    shown_product = F.try_element_at(F.create_map(*[x for k, p in PRODUCT_SHOWN.items() for x in (F.lit(k), _found(text, p))]), product)
    most = _found(text, MOST)
    shown = {
        "profit_share_rate": rate_shown(text), "term_months": _found(text, TERM), "installment_count": _found(text, INSTALMENT), "discount_rate": _found(text, DISCOUNT),
        "reward_amount": F.try_element_at(_every(text, REWARD), F.lit(-1)), "max_amount": most, "financing_amount": most, "min_amount": _found(text, LEAST),
        "application_channel": _found(text, CHANNEL), "condition": condition(text), "target_audience": told["shown"], "product_type": shown_product,
        "financing_type": F.when(financing_type(text).isNotNull(), _found(text, FINANCING_SHOWN)), "fee_information": F.when(_has(lower(text), FREE), FREE[0]), "campaign_benefit": benefit(text),
    }
    return F.map_filter(F.create_map(*[x for k, c in shown.items() if names is None or k in names for x in (F.lit(k), c)]), lambda k, v: v.isNotNull())


def condition(text: Column) -> Column:
    # the lazy runs are tried at every place, so texts without the word that ends them are told apart first
    return F.when(text.rlike(pt.java("şart|koşul", True)), F.btrim(_found(text, CONDITION, 1), F.lit(" ,;:-")))


def prd_fields(x: Column | str, names: list[str] | None = None, shown: list[str] | None = None) -> Column:
    """All fields of a text, or those of names, as one struct; what it doesn't say is null.  Rates that differ leave the rate empty, as candidates.

    A plan that takes several fields of a struct has the whole struct made, so it says which it wants; shown are the
    fields whose evidence is wanted, all if None.
    """
    text = F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))
    found, told, most = rates(text), audience(text), total(_found(text, MOST, 1, "kadar"))
    own = {
        "product_type": product_type(text), "financing_type": financing_type(text), "profit_share_rate": F.when(F.size(found) == 1, F.get(found, 0)), "rate_candidates": F.when(F.size(found) > 1, found),
        "financing_amount": most, "term_months": _found(text, TERM, 1).cast("int"), "duration": duration(text), "installment_count": _found(text, INSTALMENT, 1).cast("int"), "campaign_benefit": benefit(text),
        "reward_amount": total(F.try_element_at(_every(text, REWARD), F.lit(-1))), "min_amount": total(_found(text, LEAST, 1, "az")), "max_amount": most,
        "discount_rate": ratio(F.coalesce(_found(text, DISCOUNT, 1), _found(text, DISCOUNT, 2))), "target_audience": audience(text, shown=False), "fee_information": F.when(_has(lower(text), FREE), FREE[0]),
        "application_channel": _found(text, CHANNEL), "condition": condition(text), "evidence": evidence(text, product_type(text), told, shown),
    }
    return F.struct(*(own[k].cast(t).alias(k) if t != "map<string,string>" else own[k].alias(k) for k, t in KINDS.items() if names is None or k in names))


def contract(field: str, value: Column, raw: Column, text: Column, product_type: Column, conflicts: Column | None = None) -> Column:
    """A field with its unit, status, confidence, the place of its evidence, the method and the values in conflict; sums bring their own unit."""
    low, at = F.lower(text), F.position(raw, text)
    clash = F.coalesce(F.size(conflicts) > 1, F.lit(False)) if conflicts is not None else F.lit(False)
    absent = [p for p, names in NONE_OF.items() if field in names]
    status = F.when(clash, "CONFLICT").when(value.isNotNull() & (F.coalesce(raw, F.lit("")) != ""), "EXPLICIT").when(value.isNotNull(), "IMPLICIT")
    status = status.when(F.coalesce(product_type.isin(absent), F.lit(False)) if absent else F.lit(False), "NOT_APPLICABLE")
    if field == "profit_share_rate":
        status = status.when(low.rlike(VAGUE_RATE), "IMPLICIT")
    status = (status.when(low.rlike(PROMISES[field]), "EXTRACTION_FAILED") if field in PROMISES else status).otherwise("NOT_STATED")
    confidence = F.try_element_at(F.create_map(*[F.lit(v) for kv in CONFIDENCE.items() for v in kv]), status)
    evidence = F.when(F.coalesce(raw, F.lit("")) != "", F.struct(raw.alias("text"), F.when(at > 0, at - 1).alias("char_start"), F.when(at > 0, at - 1 + F.length(raw)).alias("char_end")))
    none = F.array().cast("array<double>")
    return F.struct(
        raw.alias("raw"), value.alias("value"), F.lit(FIELD_UNITS.get(field)).cast("string").alias("unit"), status.alias("status"), confidence.alias("confidence"), evidence.alias("evidence"),
        F.lit(METHOD).alias("method"), (none if conflicts is None else F.when(clash, conflicts).otherwise(none)).alias("conflicting_values"),
    )


def each_contract(text: Column, found: Column, names: list[str] = CORE, dates: dict[str, Column] | None = None) -> dict[str, Column]:
    """The contract of each of names by prd_fields() of the text; values as text, dates as the record gives them (dates, by name)."""
    product, shown, dates = found["product_type"], found["evidence"], dates or {}

    def own(name: str) -> Column:
        if name not in KINDS:
            return contract(name, dates.get(name, F.lit(None)).cast("string"), F.lit(None).cast("string"), text, product)
        value = found[name]["minor"] if KINDS[name] == SUM else found[name]
        made = contract(name, value.cast("string"), F.try_element_at(shown, F.lit(name)), text, product, found["rate_candidates"] if name == "profit_share_rate" else None)
        return made.withField("unit", found[name]["currency"]) if KINDS[name] == SUM else made

    return {name: own(name) for name in names}


def contracts(text: Column, found: Column, names: list[str] = CORE, dates: dict[str, Column] | None = None) -> Column:
    """All of each_contract(), as a map by name."""
    return F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*each_contract(text, found, names, dates).values()))
