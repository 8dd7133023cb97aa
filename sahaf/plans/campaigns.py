"""Campaign texts: weak labels, evidence, spans, and what both say in SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sahaf.functions import extract
from sahaf.functions import labels as fixed
from sahaf.functions import patterns as pt
from sahaf.functions import spans
from sahaf.operators import labelling, learning

from .registry import query
from .tables import frame, spread

#: Sentences of campaigns; the order's number picks one of each group and fills in its numbers.
GROUPS = [
    ["Konut finansmanında %1,{n} kâr payı oranı.", "Taşıt finansmanı ile {m} aya varan vade!", "DASK ve kasko sigortanızı kolayca yaptırın.", "Katılım sigortacılığı ile güvendesiniz.", "Çiftçi müşterilerimize gübre ve tohum desteği.",
     "GES için yeşil finansman.", "KOBİ'lere ve esnafa ticari finansman.", "Katılma hesabı açana 1{n}.000 TL hediye.", "Altın hesabı ve kira sertifikası alın.", "Worldpuan kazandıran kartınızla harcayın.",
     "Alışveriş finansmanı: {m} taksit.", "Eğitim finansmanı ve okul finansmanı.", "İş yeri finansmanı masrafsız.", "Kentsel dönüşüm için {n}0.000 TL finansman.", "Cebimpos ile dijital finansman.", "Arsa finansmanında özel kâr payı.",
     "ihtiyaç finansmanı için ekspertiz ücreti yoktur.", "Seyahat sağlık sigortası %{n} indirimli.", "Fon getirisi günlük hesapta.", "Hızlı çiçek siparişinde yüzde {n} indirim.", "Kurumsal duyuru.", ""],
    ["BAHAR{n} indirim kodu ile alışveriş yapın.", "Nakit iade: her {n}00 TL harcamaya %5 iade.", "{n} gün hediye internet paketi.", "Arkadaşını getir, hediye çeki kazan.", "Kupon kodu: YAZ{m}", "Vade farksız {m} taksit, ek taksit yok.",
     "Büyük çekiliş ve altın üyelik.", "{n}0 Worldpuan kazanın.", "2{n} TL değerinde puan hediye.", "Ödemeyi erteleme imkânı.", "Bilgi formu."],
    ["En az {n}00 TL harcama yapan yeni müşterilere özeldir.", "Mevcut müşterilerimiz yararlanamaz.", "Emekli müşteriler dahil değildir; öğrenciler katılır.", "Maaş müşterilerine ve kart sahiplerine.", "Ticari müşterilerimiz için 5{n}.000 TL limit.",
     "Genç müşteriler kampüste kazanır.", "Dijital müşterilere özel oran.", "Özel bankacılık müşterileri hariç tutulur.", "Bireysel müşteriler için geçerlidir.", "Minimum bakiye 1.0{n} TL olmalıdır.", ""],
    ["Başvuru mobil uygulamadan yapılır.", "İnternet şubesi üzerinden katılın.", "Tüm şubelerde geçerlidir.", "Kampanyaya katılmak için çağrı merkezi aranır.", "ATM ve POS işlemleri hariçtir.", "e-ticaret ve online alışveriş.", "Otomatik ödeme talimatı verin.", "Üye işyerlerinde, belirli kartlar ile.", "Bankkart Lira kazan; Bonus ve Paraf Genç fırsatı.",
     "Sağlam Kart Kampüs ile Ziraat Katılım Mobil üzerinden ödeme.", "Bonus kartınız ve Gold Kart her müşteriye.", "Görüntülü görüşme ya da online mağaza.", ""],
    ["{d} Mart 2025 - {d} Nisan 2025 tarihleri arasında.", "1-{d} Haziran 2024 tarihlerinde geçerli.", "Kampanya {d}.12.2025 tarihine kadar.", "Stoklarla sınırlı.", "{d} Ekim 2025'te puanlar silinir.", "Dosya masrafı 2{n} TL.", ""],
]
#: How the number picks from each group, and what parts the groups.
PICKS = ["o_orderkey * 7 + 3", "o_orderkey * 5 + o_custkey", "o_orderkey * 3 + o_custkey * 7", "o_orderkey + o_custkey * 3", "o_orderkey * 11 + o_custkey * 5"]
FILLED = {"{n}": "10 + o_orderkey % 89", "{m}": "1 + o_orderkey % 60", "{d}": "2 + o_custkey % 26"}


def _quoted(text: str) -> str:
    """A literal that both engines read alike: apostrophes and line ends are characters by number."""
    parts = [f"chr({ord(x)})" if x in "'\n" else f"'{x}'" for x in re.split(r"(['\n])", text) if x]
    return f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0]


def _filled(sentence: str) -> str:
    parts = [p for p in re.split(r"(\{[nmd]\})", sentence) if p]
    if not parts:
        return "''"
    return "concat(" + ", ".join(f"CAST({FILLED[p]} AS VARCHAR(8))" if p in FILLED else _quoted(p) for p in parts) + ")"


def _group(pick: str, sentences: list[str]) -> str:
    return f"CASE ({pick}) % {len(sentences)} " + " ".join(f"WHEN {k} THEN {_filled(s)}" for k, s in enumerate(sentences)) + " END"


_parted = "CASE WHEN o_orderkey % 3 = 0 THEN chr(10) ELSE ' ' END"
TEXTS = "SELECT o_orderkey AS id, concat(" + f", {_parted}, ".join(_group(p, g) for p, g in zip(PICKS, GROUPS, strict=True)) + ") AS text FROM {orders}"
CAMPAIGNS = TEXTS.replace("{orders}", "orders")


def campaigns(spark, d):
    return spark.sql(TEXTS, orders=spread(frame(spark, d, "orders").select("o_orderkey", "o_custkey")))


#: Bounds of words without looking around: what stands outside is part of the match.
_LEFT, _RIGHT = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def re2(pattern: str) -> tuple[str, str, str]:
    """(left, core, right) of a pattern for an engine of ASCII words that doesn't look around."""
    left, right = pattern.startswith(r"\b"), pattern.endswith(r"\b")
    core = pattern[2 * left : len(pattern) - 2 * right].replace(r"[\w", r"[\p{L}\p{N}_").replace(r"\w", r"[\p{L}\p{N}_]").replace(r"\b", "").replace("'", "''")
    return (_LEFT if left else ""), core, (_RIGHT if right else "")


def _any(column: str, own: list[str]) -> str:
    return f"regexp_matches({column}, '" + "|".join("(?:" + "".join(re2(p)) + ")" for p in own) + "')"


PRODUCT_SQL = "CASE " + " ".join(f"WHEN {_any('low', own)} THEN '{label}'" for label, own in fixed.PRODUCT_RULES) + f" ELSE '{fixed.UNSURE}' END"
DIMENSION_SQL = {d: "list_filter([" + ", ".join(f"CASE WHEN {_any('low', own)} THEN '{label}' END" for label, own in bank) + "], lambda x: x IS NOT NULL)" for d, bank in fixed.DIMENSION_RULES.items()}
LABELS_SQL = f"""WITH t AS MATERIALIZED (SELECT id, text, lower(replace(text, 'İ', 'i̇')) AS low FROM ({CAMPAIGNS})),
found AS MATERIALIZED (SELECT id, text, {PRODUCT_SQL} AS product_category, {", ".join(f"{sql} AS {d}" for d, sql in DIMENSION_SQL.items())} FROM t),
labelled AS MATERIALIZED (SELECT id, text, product_category, {", ".join(f"CASE WHEN len({d}) = 0 THEN {fixed.DEFAULTS[d]} ELSE {d} END AS {d}" if d in fixed.DEFAULTS else d for d in fixed.DIMENSION_RULES)} FROM found)"""


@query("e14_weak_labels", f"{LABELS_SQL} SELECT id, product_category, {', '.join(fixed.DIMENSION_RULES)} FROM labelled")
def e14(spark, d):
    """The category of the first rule that matches, and every label of five dimensions."""
    return labelling.weak_labels(campaigns(spark, d))


_fold = lambda x: f"translate({x}, '{pt.SAME[0]}', '{pt.SAME[1]}')"


def _evidence_sql(label: str, pattern: str) -> str:
    """One row a text that gives evidence: what stands before it, and the evidence itself."""
    left, core, right = re2(pattern.translate(str.maketrans(*pt.SAME)))
    seen = "masked" if label in fixed.AUDIENCES else "folded"
    if label == "physical_branch":
        seen = r"regexp_replace(folded, '(?i)(internet|mobil|e-)(\s*)([şs]ube)', '\1\2xxxx', 'g')"
    before = r"((?:.*?[^\p{L}\p{N}_])??)" if left else "(.*?)"
    whole = f"(?is)^{before}({core}){right}"
    return f"SELECT id, '{label}' AS label, text, length(regexp_extract({seen}, '{whole}', 1)) AS s, length(regexp_extract({seen}, '{whole}', 2)) AS n FROM masked WHERE regexp_matches({seen}, '{whole}')"


_excludes = fixed.EXCLUDES.translate(str.maketrans(*pt.SAME))
EVIDENCE_SQL = f"""{LABELS_SQL},
sentences AS (SELECT id, text, regexp_extract_all({_fold("text")}, '[^.!?\\n]*[.!?\\n]|[^.!?\\n]+') AS s FROM labelled),
masked AS MATERIALIZED (SELECT id, text, {_fold("text")} AS folded, array_to_string(list_transform(s, lambda x: CASE WHEN regexp_matches(x, '(?i){_excludes}') THEN repeat('#', length(x)) ELSE x END), '') AS masked FROM sentences),
evident AS MATERIALIZED ({" UNION ALL ".join(_evidence_sql(label, p) for label, p in fixed.EVIDENCE.items())}),
predicted AS (SELECT id, 'product_category' AS dimension, product_category AS label FROM labelled {" ".join(f"UNION ALL SELECT id, '{d}', unnest({d}) FROM labelled" for d in fixed.DIMENSION_RULES)})"""


@query("e18_gated_labels", f"""{EVIDENCE_SQL}
SELECT p.id, p.dimension, p.label, e.s::INT AS start, (e.s + e.n)::INT AS "end", substr(e.text, e.s + 1, e.n) AS surface, e.s IS NOT NULL OR p.label NOT IN ({", ".join(f"'{x}'" for x in fixed.SENSITIVE)}) AS kept
FROM predicted p LEFT JOIN evident e ON p.id = e.id AND p.label = e.label""")
def e18(spark, d):
    """Every label with the place of its evidence; a sensitive one counts only if a sentence that doesn't exclude gives some."""
    own = labelling.shown_labels(campaigns(spark, d)).select("id", F.inline_outer("labels"))
    return labelling.counts(own).select("id", "dimension", "label", "start", "end", "surface", "kept")


_AROUND = {r"(?<![\p{L}\p{N}_])": r"(?:^|[^\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])": r"(?:$|[^\p{L}\p{N}_])", r"(?<!\d)": "(?:^|[^0-9])", "(?iu:": "(?i:"}


def _parts(rule: spans.Rule) -> str:
    """A text cut at the bounds of a rule's spans, which are the even parts; what stands around is matched, not looked at."""
    cut = [rule.before, rule.pattern, rule.behind]
    for look, match in _AROUND.items():
        cut = [x.replace(look, match) for x in cut]
    pattern = "".join(f"({x})" for x in cut).replace("'", "''")
    if not rule.sharp:
        pattern = "(?i)" + pattern.translate(str.maketrans(*pt.SAME))
    return f"string_split_regex(regexp_replace({'text' if rule.sharp else 'folded'}, '{pattern}', concat('\\1', chr(1), '\\2', chr(2), '\\3'), 'g'), '[\\x01\\x02]')"


def _places(parts: str, trim: bool) -> str:
    end = "length(rtrim({0}[k], ' .,;:!?' || chr(10)))" if trim else "length({0}[k])"
    return f"list_transform(range(2, len({parts}) + 1, 2), lambda k: {{'s': length(array_to_string({parts}[1:k - 1], '')), 'e': length(array_to_string({parts}[1:k - 1], '')) + {end.format(parts)}}})"


def _apart(found: str, kind: str) -> str:
    return f"list_reduce(list_transform({found}, lambda x: [x]), lambda a, x: CASE WHEN x[1].s < x[1].e AND len(list_filter(a, lambda o: o.s < x[1].e AND x[1].s < o.e)) = 0 THEN list_concat(a, x) ELSE a END, []::STRUCT({kind})[])"


def _near(words: str) -> str:
    first = f"greatest(x.s - {spans.CONTEXT}, 0)"
    return f"regexp_matches(substr(folded, {first} + 1, x.e0 + {spans.CONTEXT} - {first}), '(?i){words.translate(str.maketrans(*pt.SAME))}')"


_ALL = [*spans.CODES, *spans.RULES, spans.Rule("", 0.0, spans.MONEY)]
_SPAN = "s BIGINT, e BIGINT, label VARCHAR, confidence DOUBLE"


def _named(k: int, rule: spans.Rule) -> str:
    found = _places(f"p{k}", True)
    if k < len(spans.CODES):
        found = f"list_filter({found}, lambda x: length(split_part(substr(text, x.s + 1, x.e - x.s), ' ', 1)) BETWEEN 2 AND 25 AND upper(substr(text, x.s + 1, x.e - x.s)) NOT IN ({', '.join(f"'{c}'" for c in spans.NO_CODES)}))"
    if k == len(_ALL) - 1:  # sums: the context is that of the whole match, with what is trimmed
        found = found.replace("{'s': ", f"{{'e0': length(array_to_string(p{k}[1:k], '')), 's': ")
        label = "CASE " + " ".join(f"WHEN {_near(words)} THEN '{name}'" for name, _, words in spans.SUMS[:-1]) + f" ELSE '{spans.SUMS[-1][0]}' END"
        sure = "CASE " + " ".join(f"WHEN {_near(words)} THEN {c}" for _, c, words in spans.SUMS[:-1]) + f" ELSE {spans.SUMS[-1][1]} END"
        return f"list_transform({found}, lambda x: {{'s': x.s, 'e': x.e, 'label': {label}, 'confidence': ({sure})::DOUBLE}})"
    return f"list_transform({found}, lambda x: {{'s': x.s, 'e': x.e, 'label': '{rule.label}', 'confidence': {rule.confidence}::DOUBLE}})"


SPANS_SQL = f"""WITH t AS MATERIALIZED (SELECT id, text, {_fold("text")} AS folded FROM ({CAMPAIGNS})),
p AS MATERIALIZED (SELECT id, text, folded, {", ".join(f"{_parts(r)} AS p{k}" for k, r in enumerate(_ALL))} FROM t),
c AS MATERIALIZED (SELECT id, text, flatten([{", ".join(_named(k, r) for k, r in enumerate(_ALL))}]) AS c FROM p),
k AS MATERIALIZED (SELECT id, text, c, {_apart("c", _SPAN)} AS kept FROM c)"""


@query("e15_weak_spans", f"""{SPANS_SQL} SELECT id, x.s::INT AS start, x.e::INT AS "end", substr(text, x.s + 1, x.e - x.s) AS text, x.label AS label, x.confidence AS confidence FROM (SELECT id, text, unnest(kept) AS x FROM k)""")
def e15(spark, d):
    """Entities of campaign texts: codes, rates, terms, dates, audiences, fees, products, conditions, and sums by their context."""
    return campaigns(spark, d).select("id", F.inline(spans.weak_spans(F.col("text"))))


@query("w11_exclusive_spans", f"{SPANS_SQL} SELECT id, len(c)::INT AS found, len(kept)::INT AS kept, coalesce(list_sum(list_transform(kept, lambda x: x.e - x.s)), 0)::BIGINT AS covered FROM k")
def w11(spark, d):
    """How many spans rules find in a text, how many take a place alone, and the characters that these cover."""
    both = campaigns(spark, d).select("id", spans.candidates(F.col("text")).alias("c"))
    kept = both.select("id", "c", spans.exclusive(F.col("c")).alias("k"))
    return kept.select("id", F.size("c").alias("found"), F.size("k").alias("kept"), F.aggregate("k", F.lit(0), lambda a, s: a + s["end"] - s["start"]).cast("long").alias("covered"))


def _said(x: str, pattern: str) -> str:
    """Whether the sentence of a span matches."""
    whole = f"concat(regexp_extract(substr(folded, 1, {x}.s), '[^.!?\n]*$'), substr(folded, {x}.s + 1, {x}.e - {x}.s), regexp_extract(substr(folded, {x}.e + 1), '^[^.!?\n]*[.!?\n]?'))"
    return f"regexp_matches({whole}, '(?i){pattern.translate(str.maketrans(*pt.SAME))}')"


_WORD = [spans.Rule("", 0.0, p, *spans.NO_LETTER) for _, p in spans.CHANNELS] + [spans.Rule("", 0.0, p, *spans.NO_LETTER) for p in (spans.CARDS, spans.CUSTOMERS)]
_CHANNEL = "flatten([" + ", ".join(f"list_transform({_places(f'p{k}', False)}, lambda x: {{'s': x.s, 'e': x.e, 'name': '{name}'}})" for k, (name, _) in enumerate(spans.CHANNELS)) + "])"
_PLACE = "s BIGINT, e BIGINT"
_LONGEST = "list_transform(list_sort(list_transform({0}, lambda x: {{'n': x.s - x.e, 'x': x}})), lambda y: y.x)"
_cards = f"""list_filter({_places(f'p{len(spans.CHANNELS)}', False)}, lambda x: NOT (lower(substr(text, x.s + 1, x.e - x.s)) = 'bonus' AND NOT {_said('x', f"(?:^|[^\\p{{L}}\\p{{N}}_])(?:{spans.OF_CARDS})(?:$|[^\\p{{L}}\\p{{N}}_])")}) AND NOT (ends_with(lower(substr(text, x.s + 1, x.e - x.s)), 'bankkart') AND regexp_matches(substr(folded, x.e + 1, 25), '(?i)^{spans.OTHER_BANKKART.replace(spans.NO_LETTER[1], "(?:$|[^\\p{L}\\p{N}_])").translate(str.maketrans(*pt.SAME))}')))"""
ENTITIES_SQL = f"""WITH t AS MATERIALIZED (SELECT id, text, {_fold("text")} AS folded FROM ({CAMPAIGNS})),
p AS MATERIALIZED (SELECT id, text, folded, {", ".join(f"{_parts(r)} AS p{k}" for k, r in enumerate(_WORD))} FROM t),
c AS MATERIALIZED (SELECT id, text, folded, {_apart(_CHANNEL, "s BIGINT, e BIGINT, name VARCHAR")} AS channels, {_cards} AS cards, {_places(f"p{len(spans.CHANNELS) + 1}", False)} AS customers FROM p),
k AS MATERIALIZED (SELECT id, text, folded, channels, {_apart(_LONGEST.format("cards"), _PLACE)} AS cards, {_apart(_LONGEST.format("customers"), _PLACE)} AS customers FROM c),
rows AS (
    SELECT id, text, 'APPLICATION_CHANNEL' AS label, x.s AS s, x.e AS e, x.name AS normalized, CASE WHEN {_said("x", spans.ACTS)} THEN 'application_or_transaction_channel' ELSE 'information_channel' END AS kind FROM (SELECT *, unnest(channels) AS x FROM k)
    UNION ALL SELECT id, text, 'CARD_NAME', x.s, x.e, trim(regexp_replace(substr(text, x.s + 1, x.e - x.s), '\\s+', ' ', 'g')), 'named_card_product' FROM (SELECT *, unnest(cards) AS x FROM k)
    UNION ALL SELECT id, text, 'CUSTOMER_REFERENCE', x.s, x.e, 'customer_reference', CASE WHEN {_said("x", spans.EXCLUDES)} THEN 'exclusion' WHEN {_said("x", spans.INVITES)} THEN 'eligibility' ELSE 'generic_address' END FROM (SELECT *, unnest(customers) AS x FROM k))"""


@query("e16_longest_spans", f"""{ENTITIES_SQL} SELECT id, label, s::INT AS start, e::INT AS "end", substr(text, s + 1, e - s) AS text, normalized, kind FROM rows""")
def e16(spark, d):
    """Channels, cards and customers, each with what its sentence says of it."""
    return campaigns(spark, d).select("id", F.inline(spans.context_entities(F.col("text")))).select("id", "label", "start", "end", "text", "normalized", "kind")


@query("x22_span_sentences", f"""{SPANS_SQL} SELECT id, x.s::INT AS start, concat(regexp_extract(substr(text, 1, x.s), '[^.!?\n]*$'), substr(text, x.s + 1, x.e - x.s), regexp_extract(substr(text, x.e + 1), '^[^.!?\n]*[.!?\n]?')) AS sentence,
    regexp_matches({_fold("concat(regexp_extract(substr(text, 1, x.s), '[^.!?\n]*$'), substr(text, x.s + 1, x.e - x.s), regexp_extract(substr(text, x.e + 1), '^[^.!?\n]*[.!?\n]?'))")}, '(?i){spans.EXCLUDES.translate(str.maketrans(*pt.SAME))}') AS excluded FROM (SELECT id, text, unnest(kept) AS x FROM k) WHERE x.label = 'HEDEF_KITLE'""")
def x22(spark, d):
    """The sentence of every audience, and whether it excludes it."""
    own = campaigns(spark, d).select("id", "text", F.explode(F.filter(spans.weak_spans(F.col("text")), lambda s: s["label"] == "HEDEF_KITLE")).alias("s"))
    said = own.select("id", "s.start", spans.sentence(F.col("text"), F.col("s.start"), F.col("s.end")).alias("sentence"))
    return said.select("id", "start", "sentence", F.col("sentence").rlike("(?iuU)" + spans.EXCLUDES).alias("excluded"))


#: Documents' words with a digit or of eight capitals and more stand in for labelled spans; cleaning folds white space.
_LABELLED, _BLANKS = r"[\p{L}]*\d[\p{L}\d]*|\p{Lu}\p{L}{7,}", r"\s+"


def labelled_spans(text: Column) -> Column:
    return F.transform(pt.places(text, _LABELLED), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), F.when(s["text"].rlike(r"\d"), "NUMBER").otherwise("NAME").alias("label"), F.lit(1.0).alias("confidence")))


@query("j16_rebased_spans", r"""WITH c AS (SELECT doc_id, concat(coalesce(source, ''), chr(10), trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')) AS whole, length(concat(coalesce(source, ''), chr(10))) AS lead FROM documents WHERE text IS NOT NULL),
p AS MATERIALIZED (SELECT doc_id, whole, lead, string_split_regex(regexp_replace(substr(whole, lead + 1), '([\p{L}]*[0-9][\p{L}0-9]*|\p{Lu}\p{L}{7,})', concat(chr(1), '\1', chr(2)), 'g'), '[\x01\x02]') AS p FROM c)
SELECT doc_id, lead + length(array_to_string(p[1:k - 1], '')) AS start, lead + length(array_to_string(p[1:k], '')) AS "end", p[k] AS text, CASE WHEN regexp_matches(p[k], '[0-9]') THEN 'NUMBER' ELSE 'NAME' END AS label FROM (SELECT *, unnest(range(2, len(p) + 1, 2)) AS k FROM p)""")
def j16_rebased(spark, d):
    """Spans labelled in raw documents, carried over to the training rows: blanks folded, the source as a title above."""
    own = frame(spark, d, "documents").where("text is not null").select("doc_id", F.coalesce("source", F.lit("")).alias("title"), "text")
    # blanks at both ends go first: what is left of them would be one blank
    bare = own.withColumn("bare", F.regexp_replace("text", r"\A\s+|\s+\z", ""))
    lead = F.position("bare", "text") - 1
    found = F.transform(labelled_spans(F.col("text")), lambda s: s.withField("start", s["start"] - lead).withField("end", s["end"] - lead))
    clean = bare.select("doc_id", "title", F.regexp_replace("bare", _BLANKS, " ").alias("clean"), spans.shifted(found, F.col("bare"), _BLANKS, " ").alias("s"))
    whole = clean.select("doc_id", F.concat("title", F.lit("\n"), "clean").alias("whole"), "clean", "title", "s")
    moved = whole.select("doc_id", "whole", F.inline(spans.based(F.col("s"), F.col("whole"), F.concat(F.lit("\n"), F.col("clean")))))
    return moved.select("doc_id", (F.col("start") + 1).cast("long").alias("start"), (F.col("end") + 1).cast("long").alias("end"), F.substring(F.col("whole"), F.col("start") + 2, F.col("end") - F.col("start")).alias("text"), "label")


@query("e23_entity_overlay", f"""{SPANS_SQL}, a AS (SELECT id, list_filter(kept, lambda x: x.label <> 'HEDEF_KITLE') AS old FROM k),
e AS ({ENTITIES_SQL} SELECT id, list({{'s': s, 'e': e, 'label': 'HEDEF_KITLE', 'confidence': 1.0::DOUBLE}} ORDER BY s, e) AS own FROM rows WHERE label = 'CUSTOMER_REFERENCE' AND kind <> 'exclusion' GROUP BY id),
o AS (SELECT id, old, coalesce(own, []) AS own FROM a LEFT JOIN e USING (id)),
r AS (SELECT id, old, own, {_apart("list_concat(old, own)", _SPAN)} AS whole FROM o)
SELECT id, (len(whole) - len(old))::INT AS added, (len(own) - (len(whole) - len(old)))::INT AS skipped, list_sort(list_transform(whole, lambda x: concat(x.s, '-', x.e, ' ', x.label))) AS spans FROM r""")
def e23(spark, d):
    """Entities whose audiences are replaced by the customers that a text invites; those that overlap others are skipped."""
    texts = campaigns(spark, d).select("id", spans.weak_spans(F.col("text")).alias("old"), spans.context_entities(F.col("text"), ["CUSTOMER_REFERENCE"]).alias("found"))
    invited = F.filter("found", lambda s: s["kind"] != "exclusion")
    new = F.transform(invited, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), F.lit("HEDEF_KITLE").alias("label"), F.lit(1.0).alias("confidence")))
    both = texts.select("id", spans.overlaid(F.col("old"), new, "HEDEF_KITLE").alias("o"))
    named = F.transform("o.spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"), F.lit(" "), s["label"]))
    return both.select("id", "o.added", "o.skipped", F.array_sort(named).alias("spans"))


_later = "CASE WHEN id % 7 = 0 THEN concat('Yeni! ', text) WHEN id % 11 = 0 THEN replace(text, 'müşteri', 'kişi') ELSE text END"


@query("e24_stale_labels", f"""{SPANS_SQL}, r AS (SELECT id, text, {_later} AS now, list_transform(list_filter(kept, lambda x: x.label = 'HEDEF_KITLE'), lambda x: {{'s': x.s, 'e': x.e, 't': substr(text, x.s + 1, x.e - x.s)}}) AS l FROM k),
h AS (SELECT id, text, now, l, len(list_filter(l, lambda x: substr(now, x.s + 1, x.e - x.s) = x.t)) AS kept, len(list_filter(l, lambda x: substr(now, x.s + 1, x.e - x.s) <> x.t AND instr(now, x.t) > 0 AND instr(substr(now, instr(now, x.t) + 1), x.t) = 0)) AS moved FROM r)
SELECT id, CASE WHEN id % 13 = 0 THEN 'missing' WHEN md5(text) <> md5(now) THEN 'stale' ELSE 'good' END AS state, CASE WHEN id % 13 = 0 THEN 0 ELSE kept END::INT AS kept, CASE WHEN id % 13 = 0 THEN 0 ELSE moved END::INT AS moved, CASE WHEN id % 13 = 0 THEN 0 ELSE len(l) - kept - moved END::INT AS removed FROM h""")
def e24(spark, d):
    """Audiences that were labelled in campaigns whose texts have changed since: kept, moved, removed, missing."""
    texts = campaigns(spark, d)
    labels = texts.where("id % 13 <> 0").select("id", F.md5("text").alias("hash"), F.filter(spans.weak_spans(F.col("text")), lambda s: s["label"] == "HEDEF_KITLE").alias("spans"))
    now = texts.select("id", F.expr(_later).alias("text")).withColumn("hash", F.md5("text"))
    rows, _ = learning.revalidated(now, labels)
    return rows.select("id", "state", "kept", "moved", "removed")


@query("f16_fee_free", f"""WITH t AS (SELECT id, regexp_matches({_fold("text")}, '(?i)(?:^|[^\\p{{L}}])(?:masrafsiz|ücretsiz|dosya masrafi yok)(?:$|[^\\p{{L}}])') AS free, regexp_matches({_fold("text")}, '(?i)masraf|ücret') AS about FROM ({CAMPAIGNS}))
SELECT id, free FROM t WHERE free OR (NOT (SELECT bool_or(free) FROM t) AND about)""")
def f16(spark, d):
    """Campaigns that show that they are free of fees; without any, those that speak of fees at all."""
    own = campaigns(spark, d).select("id", F.col("text").rlike(extract.FREE).alias("free"), F.col("text").rlike("(?iu)masraf|ücret").alias("about"))
    any_free = F.broadcast(own.agg(F.coalesce(F.bool_or("free"), F.lit(False)).alias("some")))  # one row
    return own.crossJoin(any_free).where(F.col("free") | (~F.col("some") & F.col("about"))).select("id", "free")


#: What shows each type of financing.
TYPES = {"consumer": r"ihtiyaç|tüketici", "vehicle": r"taşıt|araç|otomobil", "housing": r"konut|\bev\b|kentsel\s+dönüşüm", "commercial": r"ticari|kobi|esnaf|işletme", "agriculture": r"tarım|çiftçi|gübre|tohum", "education": r"eğitim|okul", "land": r"arsa", "workplace": r"iş\s*yeri", "sustainable": r"yeşil|\bges\b"}


@query("f17_type_evidence", f"WITH t AS (SELECT id, {_fold('text')} AS x FROM ({CAMPAIGNS})) " + " UNION ALL ".join(f"SELECT id, '{k}' AS kind FROM t WHERE regexp_matches(x, '(?i){p.translate(str.maketrans(*pt.SAME))}')" for k, p in TYPES.items()))
def f17(spark, d):
    """The types of financing that a text gives evidence of; rules meet texts by their grams."""
    met = labelling.meet(campaigns(spark, d), list(TYPES.items()), "kind string", pt.folded(F.col("text")), ignore_case=True)
    return met.where("pattern is not null").where(F.expr("text rlike pattern")).select("id", "kind").distinct()  # several grams may bring a rule


#: Labels of documents that count only with evidence, and what shows them.
JUNK = r"[%&$#*|!]{2,}|[|]"


@query("l03_gated_predictions")
def l03(spark, d):
    """Margins of the heads on held-out documents; junk counts only where marks of it stand in the text.  Learned, so no SQL."""
    own = frame(spark, d, "documents").select("doc_id", "text").join(frame(spark, d, "labels"), "doc_id").withColumns({"junk": 1 - F.col("quality")})
    model = learning.label_heads(own.where("doc_id % 5 <> 0"), ["junk", "toxic"])
    held = own.where("doc_id % 5 = 0")
    evidence = held.where(F.col("text").rlike(JUNK)).select("doc_id", F.lit("junk").alias("label"))
    return learning.gated_labels(learning.label_margins(model, held, "doc_id"), evidence, "doc_id", ["junk"])
