"""Spans of a text found by rules, none of which overlap, as arrays of Spark."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as pt

MONTH = r"(?:Ocak|Şubat|Mart|Nisan|Mayıs|Haziran|Temmuz|Ağustos|Eylül|Ekim|Kasım|Aralık)"
MONEY = r"(?:\d[\d.]*?(?:,\d+)?\s*(?:TL|₺|Türk Lirası))"
CODE = r"[A-ZÇĞİÖŞÜ0-9_-]*[A-ZÇĞİÖŞÜ][A-ZÇĞİÖŞÜ0-9_-]*"
#: Characters that no span ends with, how far a sum's context reaches, and the characters that a code has.
TRIMMED, CONTEXT, CODE_SIZE = " .,;:!?\n", 55, (2, 25)


class Rule(NamedTuple):
    """What stands before a span, the span, what stands behind it; case counts if sharp."""

    label: str
    confidence: float
    pattern: str
    before: str = ""
    behind: str = ""
    sharp: bool = False


#: Labels, patterns and confidences, in the order in which they take their places.
CODES = [
    Rule("PROMOSYON_KODU", 0.99, rf"{CODE}(?:\s+{CODE})?", "", r"\s+(?:(?iu:indirim|kampanya|promosyon|referans)\s+)?(?iu:kodu(?:yla|nu|nun|nı|na|dur)?)(?![\p{L}\p{N}_])", True),
    Rule("PROMOSYON_KODU", 0.99, rf"{CODE}(?:\s+{CODE})?", "", r"\s*['\"”’]?\s+(?iu:yazıp)(?![\p{L}\p{N}_])", True),
    Rule("PROMOSYON_KODU", 0.99, rf"{CODE}(?:\s+{CODE})?", r"(?iu:(?:indirim|kampanya|promosyon|referans)\s+kodu)\s*[:=-]\s*", "", True),
]
NO_CODES = ["MCC", "QR", "TL", "SIFRE", "İSPARK"]
RULES = [
    Rule("KAR_PAYI_ORANI", 0.99, r"(?:%\s*\d+(?:[,.]\d+)?\s*k[âa]r\s+payı(?:\s+oranı)?|k[âa]r\s+payı(?:\s+oranı)?\s*%\s*\d+(?:[,.]\d+)?)"),
    Rule("INDIRIM_ORANI", 0.98, r"(?:%\s*\d+(?:[,.]\d+)?|yüzde\s+\d+(?:[,.]\d+)?)\s*(?:'?[a-zçğıöşü]+\s+)?indirim"),
    Rule("VADE", 0.94, r"\d{1,3}\s*(?:ay|yıl)(?:a|e)?\s*(?:kadar|varan|vade(?:li|yle)?)?", r"(?<!\d)"),
    Rule("TAKSIT_SAYISI", 0.98, r"\d{1,3}\s*(?:aya\s+varan\s+)?taksit", r"(?<!\d)"),
    Rule("ALISVERIS_PUANI", 0.98, rf"(?:{MONEY}\s*(?:değerinde\s+)?(?:Worldpuan|Sağlam\s*Puan|puan)|\d[\d.]*\s*(?:Worldpuan|Sağlam\s*Puan))"),
    Rule("KAMPANYA_TARIHI", 0.98, rf"(?:\d{{1,2}}\s*[-–]\s*\d{{1,2}}\s+{MONTH}\s+20\d{{2}}|\d{{1,2}}\s+{MONTH}\s+20\d{{2}}(?:\s*(?:[-–]|ile)\s*\d{{1,2}}\s+{MONTH}\s+20\d{{2}})?)"),
    Rule("HEDEF_KITLE", 0.93, r"(?:yeni|mevcut|bireysel|ticari|maaş|emekli|genç|öğrenci)\s+müşteri(?:lerimiz|ler|miz|si)?|kart\s+sahipleri"),
    Rule("TAHSIS_UCRETI", 0.98, r"(?:tahsis\s+ücreti(?:\s+(?:alınmamaktadır|yoktur|muafiyeti))?)"),
    Rule("MASRAF_BILGISI", 0.95, r"(?:(?:dosya|ekspertiz|swift)\s+(?:masrafı|ücreti)(?:[^.!?\n]{0,60})?|masrafsız\s+(?:finansman|bankacılık|hesap|para\s+transferi|döviz\s+havalesi|banka\s+ve\s+kredi\s+kartı)|(?:masraf|ücret)\s+alınma(?:z|maktadır))"),
    Rule("KAMPANYA_AVANTAJI", 0.93, r"(?:vade\s+farksız|ücretsiz\s+(?:hizmet|sigorta|ekspertiz)|k[âa]r\s+payı\s+avantajı|ödeme\s+erteleme)"),
    Rule("URUN_TURU", 0.96, r"(?:konut|taşıt|araç|ihtiyaç|alışveriş|eğitim|arsa|iş\s*yeri|tarım|ticari|KOBİ|dijital|yeşil)\s+finansmanı|katılma\s+hesabı|kira\s+sertifikası|(?:kredi|banka)\s+kartı|BES|Erken\s+BES"),
    Rule("KAMPANYA_KOSULU", 0.91, rf"(?:en\s+az|min(?:imum)?\.?\s*){MONEY}(?:[^.!?]{{0,80}}(?:harcama|alışveriş|işlem))?"),
    Rule("KAMPANYA_KOSULU", 0.91, r"kampanyaya\s+katılmak\s+için"),
    Rule("KAMPANYA_KOSULU", 0.91, r"(?:kampanya|promosyon|kupon)\s+kodu"),
    Rule("KAMPANYA_KOSULU", 0.91, r"otomatik\s+ödeme\s+talimatı"),
]
REWARD, FINANCING = "ödül|hediye|iade|çek|kazan", "finansman|limit|tutar"
SUMS = [("ODUL_MIKTARI", 0.91, REWARD), ("FINANSMAN_TUTARI", 0.90, FINANCING), ("KAMPANYA_KOSULU", 0.90, "")]

SPAN = "STRUCT<start: INT, end: INT, text: STRING, label: STRING, confidence: DOUBLE>"
EMPTY = f"CAST(array() AS ARRAY<{SPAN}>)"


class Seen(NamedTuple):
    """A text without marks, and the same folded."""

    text: Column
    low: Column


def seen(text: Column, use: Callable[[Seen], Column]) -> Column:
    return pt.let(pt.unmarked(text), lambda own: pt.let(pt.folded(own), lambda low: use(Seen(own, low))))


def places(own: Seen, rule: Rule) -> Column:
    """(start, end, text) of a rule's spans, as they stand; the rule runs only on texts that hold its literals."""
    flags, whole = "(?U)" if rule.sharp else "(?iuU)", f"({rule.before})({rule.pattern})({rule.behind})"
    marked = F.when(pt.may_match(own.low, whole), F.regexp_replace(own.text, flags + whole, f"$1{pt.OPEN}$2{pt.CLOSE}$3")).otherwise(own.text)
    return pt.between_marks(marked)


def _trimmed(found: Column, label: Column, confidence: Column) -> Column:
    kept = F.rtrim(found["text"], F.lit(TRIMMED))
    return F.struct(found["start"].alias("start"), (found["start"] + F.length(kept)).alias("end"), kept.alias("text"), label.alias("label"), confidence.cast("double").alias("confidence"))


def _labelled(text: Seen, rule: Rule) -> Column:
    return F.transform(places(text, rule), lambda s: _trimmed(s, F.lit(rule.label), F.lit(rule.confidence)))


def _sums(own: Seen) -> Column:
    """Sums of money, told by the words around them."""

    def told(s: Column) -> Column:
        first = F.greatest(s["start"] - CONTEXT, F.lit(0))
        window = F.substring(own.text, first + 1, s["end"] + CONTEXT - first)
        label, sure = F.lit(SUMS[-1][0]), F.lit(SUMS[-1][1])
        for name, confidence, words in reversed(SUMS[:-1]):
            near = window.rlike(f"(?iu){words}")
            label, sure = F.when(near, name).otherwise(label), F.when(near, confidence).otherwise(sure)
        return _trimmed(s, label, sure)

    return F.transform(places(own, Rule("", 0.0, MONEY)), told)


def candidates(text: Column, bank: Column | None = None) -> Column:
    """All spans that rules find in a text, the first to take their places first: the bank's name, codes, the rules, sums."""
    return seen(text, lambda own: _candidates(text, own, bank))


def _candidates(text: Column, own: Seen, bank: Column | None) -> Column:
    named = F.expr(EMPTY)
    if bank is not None:
        at = F.position(bank, text)
        named = F.when((at > 0) & (bank != ""), F.array(F.struct((at - 1).alias("start"), (at - 1 + F.length(bank)).alias("end"), bank.alias("text"), F.lit("BANKA").alias("label"), F.lit(1.0).alias("confidence")))).otherwise(named)
    size = lambda s: F.length(F.split_part(s["text"], F.lit(" "), F.lit(1))).between(*CODE_SIZE)
    codes = F.filter(F.concat(*(_labelled(own, r) for r in CODES)), lambda s: size(s) & ~F.upper(s["text"]).isin(NO_CODES))
    return F.concat(F.coalesce(named, F.expr(EMPTY)), codes, *(_labelled(own, r) for r in RULES), _sums(own))


def _apart(found: Column, empty: str) -> Column:
    """Of spans in the order in which they take their places those that no earlier one overlaps."""

    def take(taken: Column, s: Column) -> Column:
        clear = (s["start"] < s["end"]) & ~F.exists(taken, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]))
        return F.when(clear, F.concat(taken, F.array(s))).otherwise(taken)

    return F.aggregate(found, F.expr(empty), take)


def _longest(found: Column, empty: str) -> Column:
    """_apart() of spans of which the longest take their places first, the earlier of equals."""
    keyed = F.transform(F.filter(found, lambda s: s["start"] >= 0), lambda s: F.struct((s["start"] - s["end"]).alias("n"), s["start"].alias("at"), s["label"].alias("label"), s.alias("s")))
    return _apart(F.transform(F.array_sort(keyed), lambda x: x["s"]), empty)


def exclusive(found: Column) -> Column:
    """The spans that take their places before others that overlap them, by place."""
    return F.array_sort(_apart(found, EMPTY))


def longest_first(found: Column) -> Column:
    """Of overlapping spans the longest, the earlier of equals, then that of the lesser label; by place."""
    return F.array_sort(_longest(found, EMPTY))


def weak_spans(text: Column, bank: Column | None = None) -> Column:
    """start, end, text, label and confidence of a text's entities, none over another; a null text has none."""
    return F.coalesce(exclusive(candidates(text, bank)), F.expr(EMPTY))


def sentence(text: Column, start: Column, end: Column) -> Column:
    """The sentence or line that a span stands in, with its closing mark."""
    lead = F.regexp_extract(F.substring(text, F.lit(1), start), r"[^.!?\n]*\z", 0)
    rest = F.regexp_extract(F.substring(text, end + 1, F.length(text)), r"^[^.!?\n]*[.!?\n]?", 0)
    return F.concat(lead, F.substring(text, start + 1, end - start), rest)


#: What a text calls channels, cards and customers, and what a sentence says of them.
CHANNELS = [
    ("video_call", r"(?:görüntülü|goruntulu)\s+görüşme"),
    ("internet_branch", r"internet\s+şube(?:si|sinden|sine)?"),
    ("mobile", r"(?:(?:Albaraka|Kuveyt\s+Türk|Türkiye\s+Finans|Vakıf\s+Katılım|Ziraat\s+Katılım|Emlak\s+Katılım|Hayat\s+Finans)\s+Mobil|mobil\s+(?:uygulama|şube)[\p{L}\p{N}_]*)"),
    ("call_center", r"(?:çağrı\s+merkezi|müşteri\s+(?:iletişim|hizmetleri)\s+merkezi)"),
    ("atm", r"(?:ATM|bankamatik)"),
    ("card_pos", r"(?:POS|üye\s+iş\s*yeri)"),
    ("ecommerce", r"(?:e-ticaret|online|internet|web)\s+(?:sitesi|mağaza|alışveriş)"),
    ("physical_branch", r"(?:fiziksel\s+)?şube(?:si|sinden|sine|lerimizden|lerden)?"),
]
CARDS = r"(?:(?:Dünya\s+Katılım\s+)?Paraf(?:ly|ree|\s+Genç|\s+Premium)?|(?:Ziraat\s+Katılım\s+)?Bankkart(?:\s+(?:Aile|Genç|Bağımsız))?|Sağlam\s+(?:Kart(?:\s+(?:Kampüs|Genç))?|Nakit(?:\s+Kart)?)|Albaraka\s+World|Worldcard|Miles&Smiles(?:\s+Kuveyt\s+Türk)?|Hadi\s+Black(?:\s+Kredi\s+Kartı)?|World\s+Elite\s+Kart|Pratik\s+Finansman\s+Kart|Bağımsız(?:\s+Kredi)?\s+Kart|Biz\s+Kart|(?:Happy\s+)?Bonus(?:\s+kredi\s+kartı)?|Âlâ\s+Kart|Trend\s+Kredi\s+Kart|Dkart\s+Debit\s+Kart|İhtiyaç\s+Kart|Eflatun\s+Kredi\s+Kart|(?:Emlak\s+Katılım\s+)?Debit\s+Kart|Master\s+Gold\s+Kart|TROY(?:\s+logolu)?(?:\s+(?:banka|kredi))?\s+Kart|(?:Aile|Genç|Tarım|Business|Esnaf|Gold|Platinum)\s+Kart)"
CUSTOMERS = r"(?:(?:(?:yeni|mevcut|bireysel|ticari|dijital|maaş|emekli|genç|öğrenci|kamu|özel\s+bankacılık|KOBİ|tarım|her|tüm)\s+){1,3})?müşteri(?:lerimiz|leriniz|lerine|leri|ler|miz|niz|si|ye|yi)?"
EXCLUDES = r"(?:dahil|kapsamında|geçerli)\s+(?:değil|değildir)|(?:yararlanamaz|faydalanamaz|hariç|kapsam dışı)"
INVITES = r"faydalan|yararlan|özel|geçerli|katıl|kapsam|için"
ACTS = r"başvur|katıl|giriş|işlem|ödeme|harcama|alışveriş|satın\s+al|kullan|tamamla|gerçekleştir|yap"
OTHER_BANKKART = r"\s+(?:Lira|POS|anlaşmalı|üye|yetkili)(?![\p{L}\p{N}_])"
OF_CARDS = r"(?:kredi\s+)?kart(?:ı|lar|ınız)?"
NO_LETTER = (r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])")
ENTITY = "STRUCT<start: INT, end: INT, text: STRING, label: STRING, normalized: STRING, kind: STRING>"
NO_ENTITY = f"CAST(array() AS ARRAY<{ENTITY}>)"


def _entity(s: Column, label: str, normalized: Column, kind: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), F.lit(label).alias("label"), normalized.alias("normalized"), kind.alias("kind"))


def context_entities(text: Column, labels: list[str] | None = None) -> Column:
    """Channels, cards and customers that a text names (start, end, text, label, normalized, kind), or those of labels, by place.

    A channel's place goes to the first rule that finds it; of overlapping spans of a label the longest stays.  `bonus`
    is a card only in a sentence about cards, and a bankkart that goes on as a currency or a partner is none.
    """
    word = lambda p: Rule("", 0.0, p, *NO_LETTER)
    of = lambda s: sentence(text, s["start"], s["end"])
    flag = "(?iuU)"

    def channel(name: str):
        return lambda s: _entity(s, "APPLICATION_CHANNEL", F.lit(name), F.when(of(s).rlike(flag + ACTS), "application_or_transaction_channel").otherwise("information_channel"))

    def card(s: Column) -> Column:
        return _entity(s, "CARD_NAME", F.trim(F.regexp_replace(s["text"], r"\s+", " ")), F.lit("named_card_product"))

    def customer(s: Column) -> Column:
        said = of(s)
        return _entity(s, "CUSTOMER_REFERENCE", F.lit("customer_reference"), F.when(said.rlike(flag + EXCLUDES), "exclusion").when(said.rlike(flag + INVITES), "eligibility").otherwise("generic_address"))

    def real(s: Column) -> Column:
        low = F.lower(s["normalized"])
        about = of(s).rlike(f"{flag}{NO_LETTER[0]}{OF_CARDS}{NO_LETTER[1]}")
        behind = F.substring(text, s["end"] + 1, F.lit(25)).rlike(f"{flag}\\A{OTHER_BANKKART}")
        return ~((low == "bonus") & ~about) & ~(low.endswith("bankkart") & behind)

    # of each label on its own, so that others need not be made.
    kinds = {
        "APPLICATION_CHANNEL": lambda own: _apart(F.concat(*(F.transform(places(own, word(p)), channel(name)) for name, p in CHANNELS)), NO_ENTITY),
        "CARD_NAME": lambda own: F.filter(F.transform(places(own, word(CARDS)), card), real),
        "CUSTOMER_REFERENCE": lambda own: F.transform(places(own, word(CUSTOMERS)), customer),
    }

    def each(own: Seen) -> Column:
        return F.concat(*(_longest(found(own), NO_ENTITY) for label, found in kinds.items() if labels is None or label in labels))

    found = seen(text, each)
    placed = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("at"), s["end"].alias("to"), s["label"].alias("label"), s.alias("s"))))
    return F.coalesce(F.transform(placed, lambda x: x["s"]), F.expr(NO_ENTITY))


def shifted(found: Column, text: Column, pattern: str, replacement: str) -> Column:
    """Spans (start, end and more) of a text carried over to regexp_replace(text, pattern, replacement).

    The runs between matches keep their letters, so an offset moves by what the matches before it lost.  A span of which
    an end lies within a match that changed is dropped; one that is whole in the new text keeps all its fields.
    """
    changed = F.filter(pt.places(text, pattern), lambda m: m["text"] != replacement)
    lost = F.transform(changed, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), (F.length(m["text"]) - len(replacement)).alias("lost")))

    def carry(moved: Column) -> Column:
        def to(offset: Column) -> Column:
            return offset - F.aggregate(moved, F.lit(0), lambda a, m: a + F.when(m["end"] <= offset, m["lost"]).otherwise(0))

        whole = F.filter(found, lambda s: ~F.exists(moved, lambda m: (m["start"] < s["end"]) & (s["start"] < m["end"])))
        return F.transform(whole, lambda s: s.withField("start", to(s["start"])).withField("end", to(s["end"])))

    return pt.let(lost, carry)


def based(found: Column, whole: Column, part: Column) -> Column:
    """Spans of a part as spans of the text that holds it, at its first place there; none if it doesn't."""
    at = F.position(part, whole) - 1
    return F.when(at >= 0, F.transform(found, lambda s: s.withField("start", s["start"] + at).withField("end", s["end"] + at)))


def overlaid(old: Column, new: Column, label: str, empty: str = EMPTY) -> Column:
    """(spans, added, skipped): old spans but those of label, and of the new ones in order those that overlap nothing before them.

    Old spans must not overlap each other; empty is an empty array of the spans' type.
    """
    kept = F.filter(old, lambda s: s["label"] != label)

    def told(kept: Column, out: Column) -> Column:
        added = F.size(out) - F.size(kept)
        return F.struct(F.array_sort(out).alias("spans"), added.alias("added"), (F.size(new) - added).alias("skipped"))

    return pt.let(kept, lambda own: pt.let(_apart(F.concat(own, new), empty), lambda out: told(own, out)))
