"""Labels, evidence, spans and periods against plain versions that go through every rule and every letter."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from sahaf.functions import dates, labels, patterns, spans
from sahaf.operators import labelling
from sahaf.plans import campaigns, periods

ODD = ["", None, "\x01\x02 %5 iade \x01", "KONUT FİNANSMANI", "İHTİYAÇ FİNANSMANI", "ihtiyaç finansmanı", "internet şubesi ve şube", "e- şube. Mobil   şube; fiziksel şubelerde", "Emekli müşteriler dahil değildir. Emekli müşteriler katılır.", "yeni\nmüşteri kapsamında değil", "POS", "pos", "deposit", "kartları ile ATM'den", "5.000 TL ve üzeri harcama. En az harcama", "% 0 masraf", "masrafsız hesap masrafı yok", "öğrenci" * 200, "MOBİL UYGULAMADAN başvurun"]


@pytest.fixture(scope="module")
def texts(spark, data):
    own = [r.text for r in campaigns.campaigns(spark, data).where("id % 5 = 0").select("text").collect()]
    rng = random.Random(2)
    mixed = [" ".join(rng.sample(own, 2)).upper() if k % 3 == 0 else rng.choice(own) + rng.choice(["\n", " ", "; "]) + rng.choice(own) for k in range(60)]
    return dict(enumerate(ODD + own + mixed))


@pytest.fixture(scope="module")
def table(spark, texts):
    return spark.createDataFrame([(k, t, 0) for k, t in texts.items()], "id long, text string, start int").repartition(4)


def plain_labels(text):
    low = (text or "").casefold()
    product = next((label for label, own in labels.PRODUCT_RULES if any(re.search(p, low) for p in own)), labels.UNSURE)
    out = {d: [label for label, own in bank if any(re.search(p, low) for p in own)] for d, bank in labels.DIMENSION_RULES.items()}
    return {"product_category": product} | {d: own or labels.DEFAULTS.get(d, []) for d, own in out.items()}


def test_labels_equal_a_loop_over_all_rules(texts, table):
    for r in labelling.weak_labels(table).collect():
        assert r.asDict() == {"id": r.id} | plain_labels(texts[r.id]), texts[r.id]


def plain_sentence(text, a, b):
    first = max(text.rfind(c, 0, a) for c in ".!?\n") + 1
    ends = [k for c in ".!?\n" if (k := text.find(c, b)) >= 0]
    return text[first : min(ends) + 1 if ends else len(text)]


def plain_evidence(text, label):
    """The first match that no branch of another kind and no excluding sentence takes away."""
    at = 0
    while m := re.compile(labels.EVIDENCE[label], re.I).search(text, at):
        other = label == "physical_branch" and re.search(r"(?:internet|mobil|e-)\s*$", text[max(0, m.start() - 12) : m.start()].casefold().replace("i̇", "i"))
        left_out = label in labels.AUDIENCES and re.search(labels.EXCLUDES, plain_sentence(text, *m.span()), re.I)
        if not other and not left_out:
            return m.start(), m.end(), m.group()
        at = m.end()
    return None


def test_evidence_equals_a_loop_over_all_labels(texts, table):
    got = {(r.id, r.label): (r.start, r.end, r.surface) for r in labelling.evidence(table).collect()}
    want = {(k, label): e for k, t in texts.items() if t for label in labels.EVIDENCE if (e := plain_evidence(t.replace("\x01", " ").replace("\x02", " "), label))}
    assert {k: (a, b, s.replace("\x01", " ")) for k, (a, b, s) in got.items()} == want


def test_every_rule_has_grams_that_its_matches_hold():
    for pattern in [p for bank in [labels.PRODUCT_RULES, *labels.DIMENSION_RULES.values()] for _, own in bank for p in own] + [*labels.EVIDENCE.values()]:
        keys, literals = patterns.required(pattern)
        assert keys and literals and all(1 <= len(k) <= patterns.GRAM for k in keys)
    assert patterns.required("kar(?:t|şı)la?")[0] == {"kar"}
    assert patterns.required(r"\b(?:ATM|bankamatik)\b")[0] == {"atm", "tik"}
    with pytest.raises(ValueError):
        patterns.required(r"\d+")


def python(pattern, sharp=False):
    out = pattern.replace("(?iu:", "(?i:").replace(r"\p{L}\p{N}_", r"\w")
    return re.compile(out, 0 if sharp else re.I)


def plain_spans(text):
    text = (text or "").replace("\x01", " ").replace("\x02", " ")
    taken, out = set(), []

    def take(a, b, label, sure):
        while b > a and text[b - 1] in spans.TRIMMED:
            b -= 1
        if a < b and not taken & set(range(a, b)):
            taken.update(range(a, b))
            out.append((a, b, text[a:b], label, sure))

    for r in spans.CODES + spans.RULES:
        for m in python(f"({r.before})({r.pattern})({r.behind})", r.sharp).finditer(text):
            code = m.group(2).split(" ")[0].rstrip(spans.TRIMMED)
            if r.label != "PROMOSYON_KODU" or 2 <= len(code) <= 25 and m.group(2).upper() not in spans.NO_CODES:
                take(*m.span(2), r.label, r.confidence)
    for m in python(spans.MONEY).finditer(text):
        near = text[max(0, m.start() - 55) : m.end() + 55]
        label, sure = next((name, sure) for name, sure, words in spans.SUMS if re.search(words, near, re.I))
        take(*m.span(), label, sure)
    return sorted(out)


def test_spans_equal_a_list_of_taken_letters(texts, table):
    for r in table.select("id", spans.weak_spans(F.col("text")).alias("s")).collect():
        assert [tuple(s) for s in r.s] == plain_spans(texts[r.id]), texts[r.id]


def test_a_named_bank_comes_first(spark):
    df = spark.createDataFrame([("Konut finansmanı Bank", "Konut"), ("x", ""), ("x", None)], "text string, bank string")
    got = [[(s.text, s.label) for s in r.s] for r in df.select(spans.weak_spans(F.col("text"), F.col("bank")).alias("s")).collect()]
    assert got == [[("Konut", "BANKA")], [], []]


def test_entities_of_a_sentence(spark):
    cases = {
        "Başvuru mobil uygulamadan. İnternet şubesinden bilgi.": [("mobil uygulamadan", "mobile", "application_or_transaction_channel"), ("İnternet şubesinden", "internet_branch", "information_channel")],
        "Bonus kazan.": [],
        "Bonus kredi kartınız ile öde": [("Bonus", "Bonus", "named_card_product")],
        "Bankkart Lira ve Bankkart Genç": [("Bankkart Genç", "Bankkart Genç", "named_card_product")],
        "Yeni müşteriler hariç. Tüm müşteriler için!": [("Yeni müşteriler", "customer_reference", "exclusion"), ("Tüm müşteriler", "customer_reference", "eligibility")],
        "": [],
    }
    df = spark.createDataFrame([*((t,) for t in cases), (None,)], "text string")
    got = [[(s.text, s.normalized, s.kind) for s in r.s] for r in df.select(spans.context_entities(F.col("text")).alias("s")).collect()]
    assert got == [*cases.values(), []]


def test_spans_are_carried_over_changed_texts(spark):
    rng = random.Random(7)
    rows = []
    for k in range(200):
        text = "".join(rng.choice("ab  \n\té") for _ in range(rng.randint(0, 60 if k else 3000)))
        cuts = sorted(rng.sample(range(len(text) + 1), 2 * min(3, (len(text) + 1) // 2)))
        rows.append((k, text, [(a, b, text[a:b], "x", 1.0) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]))
    df = spark.createDataFrame(rows, f"id long, text string, found ARRAY<{spans.SPAN}>")
    moved = df.select("id", F.regexp_replace("text", r"\s+", " ").alias("new"), spans.shifted(F.col("found"), F.col("text"), r"\s+", " ").alias("s"))
    kept = 0
    for r in moved.collect():
        old, own = rows[r.id][1], rows[r.id][2]
        changed = [m.span() for m in re.finditer(r"\s+", old) if m.group() != " "]
        whole = [s for s in own if not any(a < s[1] and s[0] < b for a, b in changed)]
        assert [s.text for s in r.s] == [s[2] for s in whole]
        for s in r.s:
            assert r.new[s.start : s.end] == s.text
        kept += len(whole)
    assert kept > 50


def test_running_sums_of_long_arrays(spark):
    for n in (0, 1, 255, 256, 257, 5000):
        own = [(k * 7) % 11 for k in range(n)]
        got = spark.createDataFrame([(own,)], "x array<int>").select(patterns.running_sums(F.col("x")).alias("s")).first().s
        assert got == [sum(own[: k + 1]) for k in range(n)] if n < 300 else got[-1] == sum(own) and len(got) == n


def test_overlaid_spans(spark):
    span = lambda a, b, label: (a, b, "", label, 1.0)
    df = spark.createDataFrame([([span(0, 5, "A"), span(6, 9, "B")], [span(5, 7, "A"), span(9, 12, "A"), span(10, 11, "A"), span(0, 2, "A"), span(4, 4, "A")])], f"old ARRAY<{spans.SPAN}>, new ARRAY<{spans.SPAN}>")
    o = df.select(spans.overlaid(F.col("old"), F.col("new"), "A").alias("o")).first().o
    assert [(s.start, s.end, s.label) for s in o.spans] == [(0, 2, "A"), (6, 9, "B"), (9, 12, "A")] and (o.added, o.skipped) == (2, 3)


def day(x):
    return x and datetime.date.fromisoformat(x)


PERIOD_CASES = [
    ("1 Mart - 31 Mayıs 2024", "2024-03-01", "2024-05-31"),
    ("5 - 9 Haziran tarihleri arasında", "2025-06-05", "2025-06-09"),
    ("5 - 9 Haziran", None, None),
    ("fırsat 5 - 9 Haziran", None, "2025-06-09"),
    ("01.02.2024 - 03.02.2024", "2024-02-01", "2024-02-03"),
    ("01.02.2024\n-\n03.02.2024", "2024-02-01", "2024-02-03"),
    ("03.02.2024 - 01.02.2024", None, None),
    ("30 Şubat tarihine kadar kampanya", None, None),
    ("29 Şubat 2024 tarihine kadar kampanya", None, "2024-02-29"),
    ("29 Şubat tarihine kadar kampanya", None, None),
    ("Puanlar 5 Mart 2025 tarihine kadar kullanılabilir.", None, None),
    ("Puanlar 1 Mart 2025 - 5 Mart 2025 silinir.", None, None),
    ("Puanlar 1 Mart 2025 - 5 Mart 2025 silinir. Kampanya 9 Mart 2025 tarihine kadar geçerli.", None, "2025-03-09"),
    ("Kampanya tarihleri\n1.1.2025 - 2.2.2025\nHediye 3.3.2025 - 4.4.2025", "2025-01-01", "2025-04-04"),
    ("Kampanya tarihleri\n1.1.2025 - 2.2.2025.\nHediye 3.3.2025 - 4.4.2025", "2025-01-01", "2025-02-02"),
    ("Hediye 3.3.2025 - 4.4.2025. Kampanya dönemi 1.1.2025 - 2.2.2025.", "2025-01-01", "2025-02-02"),
    ("Fırsat 1 Mart 2025 - 2 Mart 2025, 5 Mart 2025 - 6 Mart 2025", "2025-03-01", "2025-03-06"),
    ("30 Ekim saat 23.59'a kadar indirim", None, "2025-10-30"),
    ("Son gün: 30 Ekim", None, "2025-10-30"),
    ("Kampanya\n30-04-2026\nTarihinde Sona Ermiştir", None, "2026-04-30"),
    ("KAMPANYA 30 KASIM 2025 TARİHİNE KADAR", None, "2025-11-30"),
    ("hiç tarih yok 5 lira", None, None),
    ("", None, None),
    (None, None, None),
]


def test_periods(spark):
    df = spark.createDataFrame([(k, x, 1) for k, (x, _, _) in enumerate(PERIOD_CASES)], "k int, x string, score int")
    got = {r.k: (r.start, r.end) for r in dates.with_period(df, "x", 2025).collect()}
    for k, (x, a, b) in enumerate(PERIOD_CASES):
        assert got[k] == (day(a), day(b)), x


def test_label_plan_has_no_python_and_no_nested_loop(spark, data):
    for df in (labelling.weak_labels(campaigns.campaigns(spark, data)), labelling.evidence(campaigns.campaigns(spark, data)), dates.with_period(periods.dated(spark, data), "text", 2025)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
