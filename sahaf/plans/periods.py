"""Periods of campaigns: dated texts, and the same rules in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sahaf.functions import dates

from .campaigns import _group, _parted
from .registry import query
from .tables import frame, spread

PERIODS = [
    "Kampanya dönemi\n{d}.03.2025 - {d}.06.2025", "Kampanya tarihleri {d} Mart - {d} Nisan 2025.", "{d} Ocak 2025\n-\n{d} Şubat 2025 arası geçerlidir.", "Kampanya {d}.12.2025 tarihine kadar geçerlidir.", "3-{d} Haziran 2024 tarihleri arasında fırsat.",
    "Son gün: {d} Ekim", "Kampanya\n30-04-2026\nTarihinde Sona Ermiştir", "31 Şubat 2025 tarihine kadar kampanya.", "Geçerlilik {d}/05/2024 – {d}/04/2024.", "{d} Mayıs saat 10.30 - 30 Mayıs 2025 indirim.", "Bilgi.", "Fırsat {d} Kasım\n-\n30 Kasım", "Kampanya\n\nKampanya\n1{n} TL",
]
REWARDS = [
    "Kazanılan puanlar {d}.01.2026 tarihine kadar kullanılabilir.", "Bonus {d} Aralık 2025 sonunda silinir; kampanya geçerlidir {d} Kasım 2025 - 30 Kasım 2025.", "Harcama yapın, kazanılan ödüller {d} Mayıs 2025 tarihine kadar silinecek.", "Taksit fırsatı {d} Temmuz'a kadar.",
    "Hediye {d}.02.2025 - {d}.08.2025 arasında.", "Ödül {d}.02.2025 - {d}.08.2025 arasında silinir.", "Bilet {d} Eylül 2025 saat 23.59'a kadar!", "",
]
_first, _second = _group("o_orderkey * 7 + 3", PERIODS), _group("o_orderkey * 3 + o_custkey", REWARDS)
DATED = f"SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN concat({_first}, {_parted}, {_second}) ELSE concat({_second}, {_parted}, {_first}) END AS text FROM {{orders}}"
#: The year of dates without one.
YEAR = 2025


def dated(spark, d):
    return spark.sql(DATED, orders=spread(frame(spark, d, "orders").select("o_orderkey", "o_custkey")))


_BEFORE, _BEHIND = "(?:^|[^0-9])", r"(?:$|[^\p{L}\p{N}_])"
_NUM, _TEXT, _FULL = (p.replace(r"(?<!\d)", "") for p in (dates.NUMERIC, dates.TEXTUAL, dates.FULL))


def _re2(pattern: str) -> str:
    """A pattern of dates for an engine that doesn't look around: what stands before a date is matched with it."""
    out = pattern.replace(r"((?<!\d)", _BEFORE + "(", 1) if pattern.startswith(r"((?<!\d)") else pattern
    out = out.replace(r"(?<!\d)(\d", _BEFORE + r"(\d", 1) if out.startswith(r"(?<!\d)(\d") else out
    out = out.replace(r"(?=\s+tarih(?:leri|lerinde)(?![\p{L}\p{N}_]))", r"\s+tarih(?:leri|lerinde)" + _BEHIND)
    return out.replace(r"(?<!\d)", "").replace(r"(?![\p{L}\p{N}_])", _BEHIND).replace(r"\z", "$").replace(r"\w", r"[\p{L}\p{N}_]").replace("'", "''")


def _day(d: str, m: str, y: str) -> str:
    return f"try_strptime(concat({y}, '-', {m}, '-', {d}), '%Y-%m-%d')::DATE"


_NAMES, _NUMBERS = "[" + ", ".join(f"'{m}'" for m in dates.MONTHS) + "]", list(dates.MONTHS.values())
_month = lambda x: f"{_NUMBERS}[list_position({_NAMES}, {_low(x)})]"
_low = lambda x: f"replace(lower({x}), 'i̇', 'i')"


def _parse(x: str, year: str) -> str:
    num, text = r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})$", rf"(?i)^(\d{{1,2}})\s*({dates.MONTH})(?:\s*(\d{{4}}))?$"
    of = lambda p, g: f"regexp_extract({x}, '{p}', {g})"
    return f"CASE WHEN regexp_matches({x}, '{num}') THEN {_day(of(num, 1), of(num, 2), of(num, 3))} WHEN regexp_matches({x}, '{text}') THEN {_day(of(text, 1), _month(of(text, 2)), f"coalesce(nullif({of(text, 3)}, ''), CAST({year} AS VARCHAR))")} END"


def _every(x: str, k: int) -> str:
    """The groups of every match of a pattern of ranges."""
    pattern = "(?i)" + _re2(dates.RANGES[k])
    groups = (1, 2, 3, 4) if k == 2 else (1, 2)
    return f"list_zip({', '.join(f"regexp_extract_all({x}, '{pattern}', {g})" for g in groups)})"


def _ranges(x: str) -> str:
    first = f"list_transform({_every(x, 0)}, lambda g: {{'a': {_parse('g[1]', str(YEAR))}, 'b': {_parse('g[2]', str(YEAR))}}})"
    second = f"list_transform(list_transform({_every(x, 1)}, lambda g: {{'g': g[1], 'b': {_parse('g[2]', str(YEAR))}}}), lambda h: {{'a': {_parse('h.g', f'coalesce(year(h.b), {YEAR})')}, 'b': h.b}})"
    month, year = _month("g[3]"), f"coalesce(nullif(g[4], ''), '{YEAR}')"
    third = f"list_transform({_every(x, 2)}, lambda g: {{'a': {_day('g[1]', month, year)}, 'b': {_day('g[2]', month, year)}}})"
    return f"list_filter(flatten([{first}, {second}, {third}]), lambda r: r.a <= r.b)"


def _expires(low: str) -> str:
    around = rf"(?s)^(.*?)(?:{_NUM}|{_FULL})(.*)$"
    return f"(regexp_matches({low}, '{around}') AND regexp_matches(regexp_extract({low}, '{around}', 1), '{'|'.join(dates.REWARDS)}') AND regexp_matches(regexp_extract({low}, '{around}', 2), '{'|'.join(dates.EXPIRES)}'))"


def _until(x: str) -> str:
    pattern = "(?i)" + _re2(dates.UNTIL).replace(r"son\s+gün[:\s]*)?(", rf"son\s+gün[:\s]*|{_BEFORE})(", 1)
    found = f"list_filter(list_transform(regexp_extract_all({x}, '{pattern}', 1), lambda d: {_parse('d', str(YEAR))}), lambda d: d IS NOT NULL)"
    return f"CASE WHEN regexp_matches({_low(x)}, '{'|'.join(dates.ABOUT)}') AND NOT {_expires(_low(x))} THEN {found}[1] END"


def _joins(x: str) -> str:
    return f"coalesce(len({_ranges(x)}) > 0 OR ({_until(x)}) IS NOT NULL, false)"


_joined = "array_to_string(list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda z: z[2] = 1 OR l[z[2] - 1] <> z[1]), lambda z: z[1]), chr(10))"
for _pattern, _to in dates.JOINED:
    _lead = _BEFORE.replace("(?:", "(") if _pattern.startswith(r"((?<!\d)") else ""
    _p = _pattern.replace(r"(?<!\d)", "").replace("'", "''")
    _groups = [f"'\\{k + bool(_lead)}'" if x == f"${k}" else f"'{x}'" for x in _to.split(" ") for k in [int(x[1:]) if x.startswith("$") else 0]]
    _joined = f"regexp_replace({_joined}, '(?i){_lead}{_p}', concat({"'\\1', " if _lead else ''}{", ' ', ".join(_groups)}), 'g')"

_clause = _re2(dates.CLAUSE.replace("(?=", "(", 1))
_score = " + ".join([f"CASE WHEN regexp_matches(low, '{p}') THEN {n} ELSE 0 END" for p, n in dates.SCORES] + [f"CASE WHEN {_expires('low')} THEN {dates.EXPIRY_SCORE} ELSE 0 END"])
PERIODS_SQL = f"""WITH t AS (SELECT id, text FROM ({DATED.replace("{orders}", "orders")})),
a AS (SELECT id, list_filter(list_transform(string_split(text, chr(10)), lambda v: trim(regexp_replace(v, '[ \\t]+', ' ', 'g'))), lambda v: v <> '') AS l FROM t),
b AS MATERIALIZED (SELECT id, string_split({_joined}, chr(10)) AS l FROM a),
c AS MATERIALIZED (SELECT id, k, l[k] AS one, CASE WHEN k + 1 <= len(l) THEN concat(l[k], ' ', l[k + 1]) END AS two, CASE WHEN k + 2 <= len(l) THEN concat(l[k], ' ', l[k + 1], ' ', l[k + 2]) END AS three FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS k FROM b)),
j AS MATERIALIZED (SELECT id, k, one, two, three, {_joins("two")} AS has_two, {_joins("three")} AS has_three FROM c),
w AS (SELECT id, k, CASE WHEN has_two THEN two WHEN has_three THEN three ELSE one END AS whole, CASE WHEN has_two THEN 2 WHEN has_three THEN 3 ELSE 1 END AS step FROM j),
r AS (SELECT id, list_reduce(list({{'next': 0::BIGINT, 'taken': []::VARCHAR[], 'k': k, 'step': step, 'whole': whole}} ORDER BY k), lambda x, y: CASE WHEN y.k < x.next THEN x ELSE {{'next': y.k + y.step, 'taken': list_append(x.taken, y.whole), 'k': y.k, 'step': y.step, 'whole': y.whole}} END,
    {{'next': 0::BIGINT, 'taken': []::VARCHAR[], 'k': 0::BIGINT, 'step': 0, 'whole': ''}}).taken AS taken FROM w GROUP BY id),
s AS (SELECT id, flatten(list_transform(taken, lambda v: string_split(regexp_replace(regexp_replace(v, '(?i){_clause}', concat(chr(1), '\\1'), 'g'), '([.!?;])\\s+', concat('\\1', chr(1)), 'g'), chr(1)))) AS parts FROM r),
p AS MATERIALIZED (SELECT id, k, x, {_low("x")} AS low FROM (SELECT id, k, trim(regexp_replace(parts[k], '\\s+', ' ', 'g')) AS x FROM (SELECT id, parts, unnest(range(1, len(parts) + 1)) AS k FROM s)) WHERE x <> ''),
q AS MATERIALIZED (SELECT id, k, x, low, {_ranges("x")} AS ranges, {_until("x")} AS until FROM p),
found AS (SELECT id, k, {_score} AS score, CASE WHEN len(ranges) > 0 THEN list_min(list_transform(ranges, lambda r: r.a)) END AS a, CASE WHEN len(ranges) > 0 THEN list_max(list_transform(ranges, lambda r: r.b)) ELSE until END AS b
    FROM q WHERE (len(ranges) > 0 AND (NOT {_expires("low")} OR (regexp_matches(low, 'kampanya|fırsat|firsat') AND regexp_matches(low, 'geçerli|gecerli')))) OR (len(ranges) = 0 AND until IS NOT NULL))"""


@query("n12_end_dates", f"""{PERIODS_SQL}, best AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, k) = 1)
SELECT t.id, strftime(a, '%Y-%m-%d') AS start, strftime(b, '%Y-%m-%d') AS "end" FROM t LEFT JOIN best USING (id)""")
def n12(spark, d):
    """The period that a campaign's text names: the best of its dated segments, ends alone among them, rewards' ends not."""
    return dates.with_period(dated(spark, d), "text", YEAR).select("id", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"))


@query("n11_date_ranges", f"""WITH t AS (SELECT id, regexp_replace(text, '\\s+', ' ', 'g') AS x FROM ({DATED.replace("{orders}", "orders")}))
SELECT id, strftime(r.a, '%Y-%m-%d') AS start, strftime(r.b, '%Y-%m-%d') AS "end" FROM (SELECT id, unnest({_ranges("x")}) AS r FROM t)""")
def n11(spark, d):
    """Every range of dates in a text: numeric, with names of months, and within one month."""
    flat = dated(spark, d).select("id", F.regexp_replace("text", r"\s+", " ").alias("x"))
    return flat.select("id", F.inline(dates.ranges(F.col("x"), F.lit(YEAR)))).select("id", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"))
