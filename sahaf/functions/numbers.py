"""Numbers, money, rates, durations and dates in Turkish and international writing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import let

#: Currency marks and what they stand for.
CURRENCIES = {"₺": "TRY", "tl": "TRY", "try": "TRY", "$": "USD", "usd": "USD", "€": "EUR", "eur": "EUR", "£": "GBP", "gbp": "GBP"}
MARK = r"(?:₺|\$|€|£|(?<![\p{L}\p{N}])(?:TL|TRY|USD|EUR|GBP)(?![\p{L}\p{N}]))"
NUMBER = r"\d[\d.,]*(?:\s+milyon)?"
#: Days that a unit stands for, and its name.
UNITS = {"gün": ("day", 1), "gun": ("day", 1), "ay": ("month", 30), "yıl": ("year", 365), "yil": ("year", 365)}
MONTHS = ["ocak", "şubat", "mart", "nisan", "mayıs", "haziran", "temmuz", "ağustos", "eylül", "ekim", "kasım", "aralık"]


def parse_number(x: Column) -> Column:
    """The first number in x as a decimal.

    With both separators the last one parts the decimals.  A lone kind of separator does if one or two digits follow
    its last; else it groups thousands.
    """

    def read(raw: Column) -> Column:
        last_only = F.translate(F.regexp_replace(raw, r"[.,](?=[\d.,]*[.,])", ""), ",", ".")
        decimal = raw.rlike(r"\.[\d.]*,|,[\d,]*\.|[.,]\d{1,2}$")
        return F.when(raw != "", F.when(~raw.rlike("[.,]"), raw).when(decimal, last_only).otherwise(F.translate(raw, ".,", "")).try_cast("decimal(38,10)"))

    return let(F.regexp_extract(x, r"\d[\d.,]*", 0), read)


def money(x: Column) -> Column:
    """(amount, currency, minor) of the first sum of money, its mark before or after; `milyon` is a million."""

    def read(found: Column) -> Column:
        mark = F.lower(F.regexp_extract(found, rf"(?iu){MARK}", 0))
        currency = F.try_element_at(F.create_map(*[F.lit(v) for kv in CURRENCIES.items() for v in kv]), mark)
        amount = parse_number(found) * F.when(found.rlike(r"(?iu)milyon"), 1_000_000).otherwise(1)
        return F.when(found != "", let(amount, lambda a: F.when(a.isNotNull(), F.struct(a.cast("decimal(28,4)").alias("amount"), currency.alias("currency"), minor_units(a).alias("minor")))))

    return let(F.regexp_extract(x, rf"(?iu){MARK}\s*{NUMBER}|{NUMBER}\s*{MARK}", 0), read)


def minor_units(amount: Column) -> Column:
    """Hundredths of a decimal, halves away from zero."""
    return F.round(amount * 100, 0).cast("long")


def rate(x: Column) -> Column:
    """A marked percentage as a fraction; a number without its mark is none."""
    found = F.regexp_extract(x, r"%\s*(\d[\d.,]*)|(\d[\d.,]*)\s*%", 0)
    return F.when(found != "", (parse_number(found) / 100).cast("decimal(28,8)"))


def duration(x: Column) -> Column:
    """(value, unit, approx_days) of the first length of time."""
    pattern = r"(?iu)(?<!\d)(\d{1,4})\s*(gün|gun|ay|yıl|yil)(?![\p{L}\p{N}_])"
    value, unit = F.regexp_extract(x, pattern, 1), F.lower(F.regexp_extract(x, pattern, 2))
    name = F.try_element_at(F.create_map(*[F.lit(v) for k, (n, _) in UNITS.items() for v in (k, n)]), unit)
    days = F.try_element_at(F.create_map(*[F.lit(v) for k, (_, n) in UNITS.items() for v in (k, n)]), unit)
    n = value.try_cast("int")
    return F.when(n.isNotNull(), F.struct(n.alias("value"), name.alias("unit"), (n * days).alias("approx_days")))


def date(x: Column, year: int) -> Column:
    """A date like 5.3.2024 or 5 Mart [2024]; the year is given where the text has none."""
    numeric = r"(\d{1,2})[./](\d{1,2})[./](\d{4})"
    textual = rf"(?iu)(\d{{1,2}})\s+({'|'.join(MONTHS)})(?:\s+(\d{{4}}))?"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.translate(F.regexp_extract(x, textual, 2), "Iİ", "ıi")))
    a = F.concat_ws("-", F.regexp_extract(x, numeric, 3), F.lpad(F.regexp_extract(x, numeric, 2), 2, "0"), F.lpad(F.regexp_extract(x, numeric, 1), 2, "0"))
    y = F.coalesce(F.nullif(F.regexp_extract(x, textual, 3), F.lit("")), F.lit(str(year)))
    b = F.concat_ws("-", y, F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(x, textual, 1), 2, "0"))
    return F.coalesce(F.when(x.rlike(numeric), F.try_to_date(a, "yyyy-MM-dd")), F.when(x.rlike(textual), F.try_to_date(b, "yyyy-MM-dd")))


def plausible(start: Column, end: Column, as_of: Column) -> Column:
    """A range that doesn't run backwards, nor over five years, nor more than ten years on."""
    return (start <= end) & (F.datediff(end, start) <= 5 * 366) & (end <= F.add_months(as_of, 120))
