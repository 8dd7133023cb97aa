"""The period of a campaign out of its text: dated candidates, scored by what stands around them.

A text is cut into segments: lines, of which up to three are joined if a date needs it, parted at sentences and at clauses
about rewards.  A segment's dates are its ranges, else an end alone; a reward's expiry is none.  The best-scored segment
gives the period, the first of equals.  All of it is arrays of Spark: one row a text from scan to result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .patterns import let

#: The months as texts spell them.
MONTHS = {"ocak": 1, "şubat": 2, "subat": 2, "mart": 3, "nisan": 4, "mayıs": 5, "mayis": 5, "haziran": 6, "temmuz": 7, "ağustos": 8, "agustos": 8, "eylül": 9, "eylul": 9, "ekim": 10, "kasım": 11, "kasim": 11, "aralık": 12, "aralik": 12}
MONTH = "|".join(MONTHS)
NUMERIC = r"(?<!\d)\d{1,2}[./-]\d{1,2}[./-]\d{4}"
TEXTUAL = rf"(?<!\d)\d{{1,2}}\s*(?:{MONTH})(?:\s*\d{{4}})?"
FULL = rf"(?<!\d)\d{{1,2}}\s*(?:{MONTH})\s*\d{{4}}"
DASH = r"(?:-|–|—)"
#: Words that tell whose date it is, and what they count for.
REWARDS = ["parafpara", "puan", "bonus", "ödül", "hediye"]
EXPIRES = ["kullanılabilir", "kullanilabilir", "kullanılacaktır", "kullanilacaktir", "silinecek", "silinir"]
ABOUT = ["kampanya", "fırsat", "firsat", "indirim kod", "geçerli", "gecerli", "alışveriş", "alisveris", "harcama", "mağaza", "magaza", "kiralama", "bilet", "taksit", "pos", "vade farksız", "vade farksiz", "bitiş tarihi", "bitis tarihi", "son gün", "son gun", "sona er", "katılım", "katilim", "hesap", "oran", "indirim", "avantaj", "başvuru", "basvuru", "işlem", "islem", "hediye", "ödül", "odul", "puan", "bonus"]
SCORES = [("kampanya tarih", 6), ("kampanya dönemi|kampanya donemi", 4), ("kampanya", 2), ("geçerli|gecerli", 2), ("|".join(REWARDS), -3)]
EXPIRY_SCORE = -4
CLAUSE = r",\s+(?=(?:(?:kampanya\s+kapsam(?:ında|inda)|bu\s+kapsamda)\s+)?(?:kazan\w*|kullanılmayan|kullanilmayan|parafpara|puan\w*|bonus\w*|ödül\w*|hediye\w*)(?![\p{L}\p{N}_]))"
SENTENCE = r"(?<=[.!?;])\s+"
LABELLED = r"kampanya\s+(?:dönemi|donemi|tarihleri|tarihi)"
ENDED = r"tarihinde\s+sona\s+ermiştir|tarihinde\s+sona\s+ermistir"
UNTIL = rf"(?:(?:bitiş|bitis)\s+tarihi[:\s]*|son\s+gün[:\s]*)?({NUMERIC}|{TEXTUAL})(?:\s+tarihine|\s+tarihinde|\s+saat\s+\d{{1,2}}[.:]\d{{2}}(?:['’]?[a-zçğıöşü]+)?|['’](?:a|e|ya|ye))?\s*(?:kadar(?![\p{{L}}\p{{N}}_])|sona\s+ermiştir(?![\p{{L}}\p{{N}}_])|sona\s+ermistir(?![\p{{L}}\p{{N}}_])|sona\s+erdi(?![\p{{L}}\p{{N}}_])|\z)"
RANGES = [
    rf"({NUMERIC})\s*{DASH}\s*({NUMERIC})",
    rf"({TEXTUAL})\s*(?:saat\s+\d{{1,2}}[.:]\d{{2}}\s*)?{DASH}\s*({TEXTUAL})",
    rf"(?<!\d)(\d{{1,2}})\s*{DASH}\s*(?<!\d)(\d{{1,2}})\s*({MONTH})\s*(\d{{4}})?(?=\s+tarih(?:leri|lerinde)(?![\p{{L}}\p{{N}}_]))",
]
#: Line ends within a range or between a label and its date.
JOINED = [
    (rf"({NUMERIC})\s*\n\s*[-–—]\s*\n\s*({NUMERIC})", "$1 - $2"),
    (rf"({NUMERIC})\s*[-–—]\s*\n\s*({NUMERIC})", "$1 - $2"),
    (rf"({NUMERIC})\s*\n\s*[-–—]\s*({NUMERIC})", "$1 - $2"),
    (rf"({TEXTUAL})\s*\n\s*[-–—]\s*\n\s*({TEXTUAL})", "$1 - $2"),
    (rf"({TEXTUAL})\s*[-–—]\s*\n\s*({TEXTUAL})", "$1 - $2"),
    (rf"({LABELLED})\s*\n\s*({NUMERIC}|{TEXTUAL})", "$1 $2"),
    (rf"kampanya\s*\n\s*({NUMERIC})\s*\n\s*({ENDED})", "Kampanya $1 $2"),
]
FLAGS = "(?iuU)"


def lower(x: Column) -> Column:
    return F.replace(F.lower(x), F.lit("i̇"), F.lit("i"))


def _date(day: Column, month: Column, year: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def _numbered(month: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv]), lower(month)).cast("string")


def parse(x: Column, year: Column) -> Column:
    """The date that x is, numeric or with a month's name; the year where x has none."""
    numeric, textual = r"\A(\d{1,2})[./-](\d{1,2})[./-](\d{4})\z", rf"(?iu)\A(\d{{1,2}})\s*({MONTH})(?:\s*(\d{{4}}))?\z"
    own = F.coalesce(F.nullif(F.regexp_extract(x, textual, 3), F.lit("")), year.cast("string"))
    return F.when(x.rlike(numeric), _date(F.regexp_extract(x, numeric, 1), F.regexp_extract(x, numeric, 2), F.regexp_extract(x, numeric, 3))).when(x.rlike(textual), _date(F.regexp_extract(x, textual, 1), _numbered(F.regexp_extract(x, textual, 2)), own))


def _groups(x: Column, pattern: str, *groups: int) -> Column:
    """For every match the array of some groups; each group is looked for once, whatever the matches."""
    names = [f"g{g}" for g in groups]
    found = F.arrays_zip(*(F.regexp_extract_all(x, F.lit(FLAGS + pattern), F.lit(g)).alias(n) for n, g in zip(names, groups, strict=True)))
    return F.transform(found, lambda m: F.array(*(m[n] for n in names)))


def ranges(x: Column, year: Column) -> Column:
    """(start, end) of every range of dates in x; a range without years is of the given one, one without its first year of its second."""

    def pair(start: Column, end: Column) -> Column:
        return F.struct(start.alias("start"), end.alias("end"))

    def textual(g: Column) -> Column:
        end = parse(g[1], year)
        return pair(parse(g[0], F.coalesce(F.year(end), year)), end)

    def shared(g: Column) -> Column:
        month, own = _numbered(g[2]), F.coalesce(F.nullif(g[3], F.lit("")), year.cast("string"))
        return pair(_date(g[0], month, own), _date(g[1], month, own))

    every = F.concat(
        F.transform(_groups(x, RANGES[0], 1, 2), lambda g: pair(parse(g[0], year), parse(g[1], year))),
        F.transform(_groups(x, RANGES[1], 1, 2), textual),
        F.transform(_groups(x, RANGES[2], 1, 2, 3, 4), shared),
    )
    return F.filter(every, lambda r: r["start"] <= r["end"])


def _has(x: Column, words: list[str]) -> Column:
    return x.rlike("|".join(words))


def expires(low: Column) -> Column:
    """Whether a segment, in lower case, is about the end of a reward: a reward before its first date, its end behind it."""
    around = rf"(?sU)\A(.*?)(?:{NUMERIC}|{FULL})(.*)\z"
    return F.coalesce(low.rlike(around) & _has(F.regexp_extract(low, around, 1), REWARDS) & _has(F.regexp_extract(low, around, 2), EXPIRES), F.lit(False))


def end_only(x: Column, year: Column) -> Column:
    """The first date up to which something runs, if the segment is about an offer and not about a reward's end."""
    found = F.filter(F.transform(F.regexp_extract_all(x, F.lit(FLAGS + UNTIL), F.lit(1)), lambda d: parse(d, year)), lambda d: d.isNotNull())
    return let(found, lambda dates: F.when(F.size(dates) > 0, let(lower(x), lambda low: F.when(_has(low, ABOUT) & ~expires(low), F.get(dates, 0)))))


def score(low: Column) -> Column:
    points = sum((F.when(low.rlike(p), n).otherwise(0) for p, n in SCORES), F.lit(0))
    return points + F.when(expires(low), EXPIRY_SCORE).otherwise(0)


DATED = r"\d\s*[./-]\s*\d|\d\s*(?iu:" + MONTH + r")"  # what no segment with a date lacks


def _period(x: Column, year: Column) -> Column:
    """(start, end) of a segment; null if it has none."""

    def told(own: Column, low: Column) -> Column:
        whole = F.struct(F.array_min(F.transform(own, lambda r: r["start"])).alias("start"), F.array_max(F.transform(own, lambda r: r["end"])).alias("end"))
        valid = low.rlike("kampanya|fırsat|firsat") & low.rlike("geçerli|gecerli")
        alone = let(end_only(x, year), lambda until: F.when(until.isNotNull(), F.struct(F.lit(None).cast("date").alias("start"), until.alias("end"))))
        return F.when(F.size(own) > 0, F.when(valid | ~expires(low), whole)).otherwise(alone)

    return let(ranges(x, year), lambda own: let(lower(x), lambda low: told(own, low)))


def _joins(x: Column, year: Column) -> Column:
    """Whether lines that are joined to x hold a date together."""
    return F.when(x.rlike(DATED), let(x, lambda v: (F.size(ranges(v, year)) > 0) | end_only(v, year).isNotNull())).otherwise(False)


def lines(text: Column) -> Column:
    """The lines of a text, blanks folded, none empty or like the one before, ranges over line ends put together."""
    plain = F.regexp_replace(F.translate(text, " ​﻿", " "), r"\r\n?|[\x0b\x0c\x1c-\x1e\x85  ]", "\n")
    each = F.filter(F.transform(F.split(plain, "\n"), lambda v: F.trim(F.regexp_replace(v, r"[ \t]+", " "))), lambda v: v != "")
    first = F.filter(F.transform(each, lambda v, k: F.when((k == 0) | (F.get(each, k - 1) != v), v)), lambda v: v.isNotNull())
    joined = F.array_join(first, "\n")
    for pattern, to in JOINED:
        joined = F.regexp_replace(joined, FLAGS + pattern, to)
    return F.split(joined, "\n")


def with_period(texts: DataFrame, text: str, year: int | Column) -> DataFrame:
    """texts with start and end of the period that the column text names, null where it names none.

    A year is given for dates without one.  Null and empty texts have no period; the result doesn't hang on the clock.
    """
    y = F.lit(year) if isinstance(year, int) else year
    staged = texts.withColumn("_lines", F.when(F.col(text).rlike(DATED) | F.col(text).rlike(r"\d"), lines(F.col(text))).otherwise(F.array().cast("array<string>")))
    at = lambda k: F.get(F.col("_lines"), k)
    joins = F.transform("_lines", lambda v, k: F.struct(
        F.coalesce(at(k + 1).isNotNull() & _joins(F.concat(v, F.lit(" "), at(k + 1)), y), F.lit(False)).alias("two"),
        F.coalesce(at(k + 2).isNotNull() & _joins(F.concat(v, F.lit(" "), at(k + 1), F.lit(" "), at(k + 2)), y), F.lit(False)).alias("three"),
        v.alias("line"), k.alias("k"),
    ))
    staged = staged.withColumn("_joins", F.when(F.size("_lines") > 0, joins))
    empty = F.struct(F.lit(0).alias("next"), F.array().cast("array<string>").alias("taken"))

    def take(a: Column, j: Column) -> Column:
        whole = F.when(j["two"], F.concat(j["line"], F.lit(" "), at(j["k"] + 1))).when(j["three"], F.concat(j["line"], F.lit(" "), at(j["k"] + 1), F.lit(" "), at(j["k"] + 2))).otherwise(j["line"])
        step = F.when(j["two"], 2).when(j["three"], 3).otherwise(1)
        return F.when(j["k"] < a["next"], a).otherwise(F.struct((j["k"] + step).alias("next"), F.concat(a["taken"], F.array(whole)).alias("taken")))

    staged = staged.withColumn("_taken", F.aggregate(F.coalesce("_joins", F.array().cast("array<struct<two: boolean, three: boolean, line: string, k: int>>")), empty, take, lambda a: a["taken"]))
    parts = F.flatten(F.transform("_taken", lambda v: F.flatten(F.transform(F.split(v, FLAGS + CLAUSE), lambda c: F.split(c, SENTENCE)))))
    staged = staged.withColumn("_parts", F.filter(F.transform(parts, lambda v: F.trim(F.regexp_replace(v, r"(?U)\s+", " "))), lambda v: v != ""))
    found = F.transform("_parts", lambda v, k: F.when(v.rlike(DATED), F.struct(let(lower(v), score).alias("score"), (-k).alias("k"), _period(v, y).alias("period"))))
    staged = staged.withColumn("_best", F.array_max(F.filter(F.transform(found, lambda x: F.when(x["period"].isNotNull(), F.struct(x["score"].alias("score"), x["k"].alias("k"), x["period"]["start"].alias("start"), x["period"]["end"].alias("end")))), lambda x: x.isNotNull())))
    return staged.withColumns({"start": F.col("_best.start"), "end": F.col("_best.end")}).drop("_lines", "_joins", "_taken", "_parts", "_best")
