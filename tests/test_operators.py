"""Golden values, ties, and inputs in another order."""

import datetime
import hashlib
import json
import random
import re
import unicodedata
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sahaf.__main__ import main
from sahaf.functions import extract, fields, numbers, text, values
from sahaf.operators import catalogue, duplicates, evaluation, offers, ranking, retrieval, versions
from sahaf.sources import io, store
from sahaf.streaming import jobs

numbers_cases = [("10.000 TL", 10000.0, "TRY"), ("10,000.50 USD", 10000.5, "USD"), ("1,5 milyon TL", 1500000.0, "TRY"), ("£25.50", 25.5, "GBP"), ("USD hesapta 100 TL", 100.0, "TRY"), ("yalnız 5", None, None), (None, None, None)]


def test_money(spark):
    df = spark.createDataFrame([(k, x) for k, (x, *_) in enumerate(numbers_cases)], "k int, x string")
    got = [(r["a"] and float(r["a"]), r["c"]) for r in df.select("k", numbers.money(F.col("x")).alias("m")).select("k", F.col("m.amount").alias("a"), F.col("m.currency").alias("c")).orderBy("k").collect()]
    assert got == [(a, c) for _, a, c in numbers_cases]


@pytest.mark.parametrize(("x", "rate"), [("%45", 0.45), ("45%", 0.45), ("45,5%", 0.455), ("45", None)])
def test_rate(spark, x, rate):
    got = spark.createDataFrame([(x,)], "x string").select(numbers.rate(F.col("x"))).first()[0]
    assert (got if got is None else float(got)) == rate


@pytest.mark.parametrize(("x", "days"), [("32 gün", 32), ("3 ay", 90), ("1 yıl", 365), ("aylık", None)])
def test_duration(spark, x, days):
    got = spark.createDataFrame([(x,)], "x string").select(numbers.duration(F.col("x")).alias("d")).select("d.approx_days").first()[0]
    assert got == days


def test_lone_separator_groups_thousands(spark):
    assert float(spark.sql("SELECT '0,125' AS x").select(numbers.parse_number(F.col("x"))).first()[0]) == 125


def test_minor_units_round_half_up(spark):
    assert spark.sql("SELECT CAST(1.005 AS DECIMAL(10,4)) AS x").select(numbers.minor_units(F.col("x"))).first()[0] == 101


def test_instalment():
    assert round(50000 * 0.025 * 1.025**12 / (1.025**12 - 1), 2) == 4874.36


def test_instalment_column(spark):
    row = spark.range(1).select(F.round(offers.instalment(F.lit(50000.0), F.lit(12), F.lit(2.5)), 2).alias("m"), offers.instalment(F.lit(1200.0), F.lit(12), F.lit(0.0)).alias("z")).first()
    assert (row["m"], row["z"]) == (4874.36, 100.0)


def test_turkish_lower(spark):
    assert spark.sql("SELECT 'IİŞ' AS x").select(text.turkish_lower("x")).first()[0] == "ıiş"


def test_clean():
    assert text.clean("<p>A&amp;B  c</p><p>d</p>") == "A&B c\n\nd" or text.clean("<p>A&amp;B  c</p><p>d</p>") == "A&B c\nd"
    assert text.clean(None) == ""


def test_simhash_of_nothing_is_all_ones():
    assert text.simhash64("") == (1 << 64) - 1 and text.simhash64(None) == (1 << 64) - 1


def test_versions_count_repeats_and_returns(spark):
    t = [datetime.datetime(2024, 1, k) for k in range(1, 6)]
    rows = [("r", "a", t[0], 0), ("r", "a", t[1], 1), ("r", "b", t[2], 2), ("r", "a", t[3], 3), ("s", None, t[4], 4), ("s", None, t[4], 5)]
    got = versions.history(spark.createDataFrame(rows, "record_id string, content_hash string, observed_at timestamp, event_id long").repartition(5)).orderBy("record_id", "source_version").collect()
    assert [(r["record_id"], r["source_version"], r["content_hash"], r["occurrence_count"], r["is_current"]) for r in got] == [("r", 1, "a", 2, False), ("r", 2, "b", 1, False), ("r", 3, "a", 1, True), ("s", 1, None, 2, True)]
    assert got[0]["superseded_by"] == "r:2" and got[0]["valid_to"] == t[2]


def test_versions_of_nothing(spark):
    assert versions.history(spark.createDataFrame([], "record_id string, content_hash string, observed_at timestamp, event_id long")).count() == 0


def test_near_pairs_find_all_within_six_bits(spark):
    base = 0x0123456789ABCDEF
    prints = [base ^ sum(1 << (b * 9 % 63) for b in range(k)) for k in range(10)]
    got = {(r["a"], r["b"]) for r in duplicates.near_pairs(spark.createDataFrame([("x", p) for p in prints] * 2, "bank string, fp long")).collect()}
    want = {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 6}
    assert got == want


def test_clusters_of_one_bank_only(spark):
    rows = [(1, "x", 5, "h1"), (2, "x", 4, "h0"), (3, "y", 5, "h1")]
    got = {r["id"]: r["cluster"] for r in duplicates.clusters(spark.createDataFrame(rows, "id long, bank string, fp long, content_hash string")).collect()}
    assert got[1] == got[2] != got[3]


def test_filters_refuse_two_bank_arguments(spark):
    with pytest.raises(ValueError, match="one bank"):
        catalogue.filter_campaigns(spark.range(1), slug="a", slugs=["b"])


def test_min_max_of_equal_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("c", None), ("d", 1.0), ("d", 3.0)], "g string, x double")
    got = sorted((r["g"], r["s"]) for r in df.select("g", ranking.min_max(df, "x", ["g"]).alias("s")).collect() if r["s"] is not None)
    assert got == [("a", 0.5), ("a", 0.5), ("b", 0.5), ("d", 0.0), ("d", 1.0)]


def test_chunks_cover_the_text():
    words = " ".join(f"w{k}." if k % 50 == 0 else f"w{k}" for k in range(1000))
    parts = retrieval.windows(words, 320, 40, 0.7, 32, ".!?")
    assert parts[0][1] == 0 and parts[-1][2] == len(words)
    assert all(a[2] > b[1] for a, b in zip(parts, parts[1:], strict=False))
    assert retrieval.windows("", 320, 40, 0.7, 32, ".") == []


def test_breaker_opens_and_probes(spark):
    rows = [(1, k, k, k not in (0, 1, 2)) for k in range(4)] + [(1, 9, 700, True), (1, 10, 701, True)]
    got = [r["state"] for r in jobs.breaker(spark.createDataFrame(rows, "provider long, event_id long, at long, ok boolean"), 3, 600).orderBy("event_id").collect()]
    assert got == ["closed", "closed", "closed", "open", "half-open", "closed"]


def test_envelopes_without_records_fail(spark, tmp_path):
    (tmp_path / "bad.json").write_text(json.dumps({"schema_version": "1"}))
    with pytest.raises(Exception, match="no records"):
        io.read_envelopes(spark, str(tmp_path), "id: bigint").collect()


def test_crawl_keeps_least_depth(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "source long, target long")
    got = {r["node"]: r["depth"] for r in io.crawl(links, spark.createDataFrame([(1,)], "node long"), 2).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2}


def test_bm25_does_not_depend_on_order(spark):
    docs = spark.createDataFrame([(k, f"alpha {'beta ' * (k % 3)} w{k}") for k in range(30)], "id long, text string")
    q = spark.createDataFrame([(0, "beta alpha beta")], "query_id long, query string")
    a, b = (sorted(map(tuple, retrieval.bm25(d, q, 5).collect())) for d in (docs, docs.orderBy(F.desc("id")).repartition(7)))
    assert a == b


def plain_simhash(value):
    words = text.canonical(value).split()
    found = words if len(words) < 3 else [" ".join(words[k : k + 3]) for k in range(len(words) - 2)]
    if not found:
        return (1 << 64) - 1
    out = 0
    hashed = [int.from_bytes(hashlib.sha256(f.encode()).digest()[:8], "big") for f in found]
    for b in range(64):
        out |= (2 * sum(h >> b & 1 for h in hashed) >= len(hashed)) << b
    return out


def test_simhashes_equal_a_plain_version():
    texts = ["", None, "one", "one two", "one two three", "a b c d e f a b c", "ß Straße STRASSE", "x " * 900, *(f"w{k} v{k % 3} u t s" for k in range(700))]
    assert [int(h) % (1 << 64) for h in text.simhashes(texts)] == [plain_simhash(t) for t in texts]


@pytest.mark.parametrize("bands", [7, 8, 9, 10])
def test_near_pairs_by_any_number_of_bands(spark, monkeypatch, bands):
    monkeypatch.setattr(duplicates, "BANDS", ())
    monkeypatch.setattr(duplicates, "MOST_BANDS", bands)
    rng = random.Random(bands)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 9))) for b in base for _ in range(6)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {(r["a"], r["b"]) for r in duplicates.near_pairs(spark.createDataFrame([("x", p) for p in signed], "bank string, fp long")).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 6}


def test_long_chains_are_one_cluster(spark):
    chain = [(1 << (k + 1)) - 1 for k in range(60)]  # each a bit from the next
    rows = [(k, "x", p, f"h{k:02d}") for k, p in enumerate(chain)]
    assert duplicates.clusters(spark.createDataFrame(rows, "id long, bank string, fp long, content_hash string")).select("cluster").distinct().count() == 1


def test_clean_resolves_and_joins():
    cases = {
        None: "", "  a \t b ": "a b", "a&nbsp;b&amp;c": "a b&c", "<p>x</p><p>y</p>": "x\n\ny", "a​b­c﻿": "abc", "é": "é", "a\n\n\n\nb \n c": "a\n\nb\nc", "1 < 2": "1 < 2", "\n\n a \n\n": "a",
        "<script>no</script>yes": "yes", "a b\r\nc": "a b\nc",
    }
    assert {k: text.clean(k) for k in cases} == cases


def test_titles_mojibake_and_excerpts(spark):
    rows = [("Konut Finansmanı 1,89", "konut finansmanı 1,89"), ("abc", "xyz"), (None, "a")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(text.title_similarity("a", "b")).collect()]
    assert got[0] == 1.0 and got[1] == 0.0 and got[2] == 0.0
    df = spark.createDataFrame([("Ã¶dÃ¼l",), ("düz",), (None,)], "x string")
    assert [r[0] for r in df.select(text.repair_mojibake("x")).collect()] == ["ödül", "düz", None]
    df = spark.createDataFrame([(0, "Bir. İki cümle var. Üç."), (1, "kısa"), (2, "sözcükler noktasız uzar gider"), (3, None)], "k int, x string")
    assert [r[0] for r in df.orderBy("k").select(text.excerpt("x", 15)).collect()] == ["Bir.", "kısa", "sözcükler…", ""]


def plain_excerpt(v, n):
    v = " ".join((v or "").split())
    if len(v) <= n:
        return v
    ends = [m.end() for m in re.finditer(r"[.!?](?=\s|$)", v) if m.end() <= n]
    return v[: ends[-1]] if ends else v[: n - 1].rsplit(" ", 1)[0] + "…"


def plain_repair(v):
    marks, best = re.compile(text.MARKS), v
    for encoding in ("cp1252", "latin-1"):
        try:
            other = v.encode(encoding).decode("utf-8")
        except UnicodeError:
            continue
        if other and len(marks.findall(other)) < len(marks.findall(best)):
            best = other
    return best


def test_native_text_functions_equal_plain_ones(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("ab é.!? \n\tçğıİß€’“ñ中ﬁ²Ａ") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    broken = [t.encode().decode(rng.choice(["cp1252", "latin-1"]), "replace") for t in base]
    rows = [*base, *broken, "Ã", "â€™s", "Ã©Ã", "\x81Ã©"]
    df = spark.createDataFrame(list(enumerate(rows)), "k int, x string")
    got = df.select("k", text.excerpt("x", 25).alias("e"), text.repair_mojibake("x").alias("r"), text.ascii_fold("x").alias("a")).orderBy("k").collect()
    assert [r.e for r in got] == [plain_excerpt(t, 25) for t in rows]
    assert [r.r for r in got] == [plain_repair(t) for t in rows]
    fold = lambda v: "".join(c for c in unicodedata.normalize("NFKD", v.replace("ı", "i").replace("ﬁ", "")) if not unicodedata.combining(c))
    assert [r.a.replace("ﬁ", "") for r in got[: len(base)]] == [fold(t) for t in base]  # the others hold characters of several letters


def test_windows_end_at_sentences_and_overlap():
    words = " ".join(f"w{k}{'.' if k % 37 == 0 else ''}" for k in range(1, 1500))
    parts = retrieval.windows(words, 100, 20, 0.7, 32, ".!?")
    for a, b in zip(parts, parts[1:], strict=False):
        assert len(a[3].split()) <= 100 and a[3] == words[a[1] : a[2]]
        assert len(set(a[3].split()) & set(b[3].split())) == 20
        sentence = [k for k, w in enumerate(a[3].split()) if w.endswith(".") and k >= 70]
        assert not sentence or a[3].endswith(".")


def test_nearest_in_blocks_equals_plain(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(80)] + [(90, [0.0] * 6), (91, [1.0]), (92, None), (None, [1.0] * 6)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.where("vec_id % 10 = 0").selectExpr("vec_id as query_id", "embedding as query")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in retrieval.nearest(v, q, 4).collect()}
    for i, x in rows[:80:10]:
        scored = sorted((-round(max(0.0, float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))), 6), k) for k, y in rows[:80] if k != i)
        assert [got[i, r] for r in (1, 2, 3, 4)] == [(k, -s) for s, k in scored[:4]]


def test_guarded_saves_caches_and_the_store(spark, tmp_path, capsys):
    path = f"file://{tmp_path}/f.txt"
    first = store.save(spark, path, b"one", None)
    with pytest.raises(store.Changed):
        store.save(spark, path, b"two", None)
    assert store.save(spark, path, b"two", first) != first and (tmp_path / "f.txt").read_bytes() == b"two"
    assert not [f for f in tmp_path.iterdir() if f.name.endswith(".tmp")]
    cache = store.FileCache(spark, lambda _, p: len(p))
    assert [cache.get(path)[1] for _ in range(2)] == [False, True]
    with pytest.raises(FileNotFoundError):
        cache.get(f"file://{tmp_path}/none")
    folder = f"file://{tmp_path}/store"
    store.append(spark.createDataFrame([(1, "t")], "id long, title string"), (store.open_store(spark, folder) and folder), "campaigns")
    assert store.open_store(spark, folder)["campaigns"].select("id", "title", "rate").collect() == [(1, "t", None)]
    with pytest.raises(ValueError, match="no columns"):
        store.append(spark.createDataFrame([(1,)], "odd int"), folder, "campaigns")
    (tmp_path / "old" / "banks").mkdir(parents=True)
    with pytest.raises(ValueError, match="isn't known"):
        store.open_store(spark, f"file://{tmp_path}/old")
    assert main(["banks", "/root/testdata/sf0.001", "--limit", "2"], spark) == 0 and capsys.readouterr().out.count("\n") == 2
    assert main(["validate", "/root/testdata/sf0.001"], spark) == 1


def test_frozen_values_and_recent_keys():
    frozen = values.freeze({"a": [1, {"b": None}]})
    with pytest.raises(TypeError):
        frozen["a"] = 1
    assert frozen["a"][1]["b"] is None and values.thaw(frozen) == {"a": [1, {"b": None}]}
    for bad in ({1: 2}, {"a": {3}}, object()):
        with pytest.raises(TypeError):
            values.freeze(bad)
    assert values.recent_hits(list("abacab"), 2) == [False, False, True, False, True, False]


def fields_of(spark, *texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    return [r.f for r in df.select("k", fields.prd_fields("text").alias("f")).orderBy("k").collect()]


def test_fields_of_notices(spark):
    f, g, none, empty = fields_of(
        spark,
        "Konut finansmanında %1,89 kâr payı oranı ile 120 ay vade. 1,5 milyon TL tutara kadar. Emekliler hariç; öğrenciler için. Ayrıca %2,10 oran.",
        "Worldpuan kart ile 3 taksit ve %15 indirim! 2.000 TL harcamaya 250 TL ödül. En az 5.000 TL ile. Masrafsız. Başvuru mobil uygulama üzerinden.",
        None,
        "",
    )
    assert (f["product_type"], f["financing_type"], f["profit_share_rate"], f["rate_candidates"], f["term_months"], f["max_amount"]["minor"], f["target_audience"]) == ("financing", "housing", None, [0.0189, 0.021], 120, 150_000_000, "student")
    assert f["duration"].asDict() == {"value": 120, "unit": "month", "approx_days": 3600}
    assert f["evidence"] == {"profit_share_rate": "%1,89 kâr payı oranı", "term_months": "120 ay vade", "max_amount": "1,5 milyon TL tutara kadar", "financing_amount": "1,5 milyon TL tutara kadar", "target_audience": "öğrenciler", "financing_type": "Konut"}
    assert (g["product_type"], g["installment_count"], g["discount_rate"], g["reward_amount"]["amount"], g["min_amount"]["amount"], g["fee_information"], g["application_channel"]) == ("card", 3, 0.15, 250.0, 5000.0, "masrafsız", "mobil uygulama")
    for r in (none, empty):
        assert {k: v for k, v in r.asDict().items() if v} == {}


PRODUCT_TEXTS = [
    ("Müşterimiz olun, kur fırsatı yakalayın", "investment"),
    ("Kur fırsatı.\nMüşterimiz olun", "investment"),
    ("Günlük hesap açın.\nVadeni boz", "investment"),
    ("Vadeni boz günlük hesap", "investment"),
    ("Kur fırsatı var", None),
    ("KART FIRSATI", "card"),
    ("Alışveriş puan kazanın", "shopping_points"),
    ("Yeni müşteri olun", "new_customer"),
    ("Taşıt finansmanı ve kart", "financing"),
]
AUDIENCE_TEXTS = [
    ("Hayat Finanslı olun", "new_customer", "Hayat Finanslı olun"),
    ("Hayat Finanslı müşteriler", None, None),
    ("Mobilden 5 dakikada müşteri olun", "new_customer", "Mobilden 5 dakikada müşteri olun"),
    ("Emekliler hariç. Doktorlara özel", "public_sector", "Doktorlara"),
    ("Esnafımız", None, None),
    ("KOBİ'ler için", "commercial", "KOBİ"),
    ("Gençlere kartınızla", "student", "Gençlere"),
    ("Paraf kart", "existing_customer", "Paraf kart"),
    ("Paraf", None, None),
    ("Kuveyt Türklülere özel", None, None),
]


def test_products_and_audiences(spark):
    assert [f["product_type"] for f in fields_of(spark, *(t for t, _ in PRODUCT_TEXTS))] == [p for _, p in PRODUCT_TEXTS]
    got = [(f["target_audience"], f["evidence"].get("target_audience")) for f in fields_of(spark, *(t for t, _, _ in AUDIENCE_TEXTS))]
    assert got == [(a, s) for _, a, s in AUDIENCE_TEXTS]


def test_one_field_computes_no_other_and_no_python(spark):
    df = spark.createDataFrame([("x",)], "text string").select(fields.prd_fields("text").alias("f"))
    whole, one = (d._jdf.queryExecution().executedPlan().toString() for d in (df, df.select("f.fee_information")))
    assert "Python" not in whole and "Pandas" not in whole and "taksit" not in one


def test_records_that_are_wrong(spark):
    good = ("b", "Bank", "A title", "x" * 90, "https://bank.example/1", "2024-01-01", "2024-02-01", "short")
    rows = [(1, *good), (2, "", None, "abc", "<b>x</b>", "http://bank.example", "2024-03-01", "2024-02-01", None), (3, *good[:4], "https://bank.example/3", None, "", "s" * 501), (3, *good[:4], "https://bank.example/1", *good[5:])]
    df = spark.createDataFrame(rows, "id long, bank_slug string, bank_name string, title string, content string, source_url string, start_date string, end_date string, summary string")
    got = sorted([x["field"] for x in r["issues"]] for r in evaluation.record_issues(df).collect())
    assert got == sorted([["source_url_repeated"], ["bank_slug", "bank_name", "title", "content_length", "content_tags", "source_url", "date_order", "summary"], ["date_range", "summary_length", "id"], ["id", "source_url_repeated"]])
    assert evaluation.quality_report(evaluation.record_issues(df.limit(0))).first()["score"] == 0.0


def test_comparison_of_titles_and_exclusions(spark):
    columns = "id string, product_type string, currency string, rate double, max_amount double, fee string, audience string, financing_type string, duration_days int, discount double, reward double, instalments int, title string"
    rows = [("a", "financing", "TRY", 0.02, None, "masrafsız", "retiree", "housing", 360, None, None, None, "Konut finansmanı"), ("b", None, None, 0.03, 100.0, None, None, None, None, None, None, None, None), ("c", "financing", "TRY", 0.01, 1.0, None, "student", None, None, None, None, None, "x"), ("d", "card", "TRY", 0.01, 1.0, None, None, None, None, None, None, None, "x")]
    wanted = offers.Wanted("financing", "TRY", duration_days=720, eligibility="retiree", financing_type="housing", amount=200.0, title="konut finansmanı")
    got = {r["id"]: r for r in offers.compare(spark.createDataFrame(rows, columns), wanted).collect()}
    assert set(got) == {"a", "b"} and got["b"]["match"] == 0.5 and got["b"]["missing"] == ["fee", "eligibility"]
    assert got["a"]["match"] == round((0.35 + 0.20 + 0.15 * 0.5 + 0.10 + 0.10) / 0.9, 4)
    assert got["a"]["advantage"] == round((0.45 * 1 + 0.15 * 0.5 + 0.10 * 0.5) / 0.7, 4) and got["a"]["confidence"] == 0.7
    assert abs(sum(c["contribution"] for c in got["a"]["criteria"]) - got["a"]["advantage"]) < 2e-4


def test_line_numbers_over_splits(spark, tmp_path):
    lines = [f'{{"a": {k}, "pad": "{"x" * 90}"}}' if k % 9 else ("" if k % 2 else f"[{k}]") for k in range(1, 400)]
    (tmp_path / "f.jsonl").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        good, bad = io.read_strict_lines(spark, str(tmp_path), "a long")
        assert sorted(r["a"] for r in good.collect()) == [k for k in range(1, 400) if k % 9]
        assert sorted((r["number"], r["line"]) for r in bad.collect()) == [(k, f"[{k}]") for k in range(1, 400) if k % 18 == 0]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("held", ['[{"a": 1}, {"a": 2}]', '{"records": [{"a": 1}, {"a": 2}]}', '{"campaigns": [{"a": 1}, {"a": 2}]}'])
def test_json_lists_and_envelopes(spark, tmp_path, held):
    (tmp_path / "f.json").write_text(held)
    assert sorted(r["a"] for r in io.read_any(spark, f"{tmp_path}/f.json", "a int").collect()) == [1, 2]


def test_positions_over_ranges(spark):
    rows = [(k * 7919 % 1000, k) for k in range(1000)] + [(5, 2000), (None, 3000)]
    got = sorted(ranking.positions(spark.createDataFrame(rows, "a int, b int").repartition(7), ["a", "b"]).collect(), key=lambda r: r["pos"])
    assert [(r["a"], r["b"]) for r in got] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])) and [r["pos"] for r in got] == list(range(1, 1003))


def test_page_records():
    page = """<html><head><title>Site | x</title><meta property="og:image" content="/i.png"><meta name="description" content="meta"></head><body><nav>menu</nav>
    <article><h1>A &amp; <b>B</b></h1><p></p><p>First <i>one</i>.</p><script>no()</script><ul><li>second<br>third</li></ul><form>go</form></article><footer>end</footer></body></html>"""
    assert io.page_record("https://a.example/x/y", page) == {"title": "A & B", "description": "First one.", "content": "A & B\nFirst one.\nsecond\nthird", "image": "https://a.example/i.png"}
    bare = io.page_record(None, "<title>T</title><meta property='og:description' content=' d  e '><div>text</div>")
    assert bare == {"title": "T", "description": "d e", "content": "text", "image": None}
    assert io.page_record(None, None) == {"title": None, "description": None, "content": None, "image": None}


def test_links_are_absolute_allowed_and_no_hubs(spark):
    page = '<a href="b#f">x</a><a class=q href=\'/k/1\'>y</a><a href="//other.example/k/2">z</a><a href="http://a.example/k/3">z</a><a href="https://A.example./k/4?q=1">z</a><a href="/k/kampanyalar/">all</a><a href="/k/5">Tüm <b>Kampanyalar</b></a><a href="/k/1#again">y</a>'
    df = spark.createDataFrame([(1, "https://a.example/k/dir/page?z", page), (2, "https://a.example", '<a href="k/9">q</a>'), (3, None, None)], "page_id int, url string, html string")
    got = sorted((r["page_id"], r["link"]) for r in io.page_links(df, ["a.example"], "^/k/").collect())
    assert got == [(1, "https://A.example./k/4?q=1"), (1, "https://a.example/k/1"), (1, "https://a.example/k/dir/b"), (2, "https://a.example/k/9")]


def test_manifests_differ(spark, tmp_path):
    for name, body in (("a/x.txt", "1\n2\n"), ("b.txt", "3\n"), ("_SUCCESS", "")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    before = io.settle(io.manifest(spark, f"file://{tmp_path}"), "manifest")
    assert {(r["path"], r["bytes"], r["lines"]) for r in before.collect()} == {("a/x.txt", 4, 2), ("b.txt", 2, 1)}
    (tmp_path / "b.txt").write_text("4\n")
    (tmp_path / "c.txt").write_text("5")
    assert {tuple(r) for r in io.manifest_differences(before, io.manifest(spark, f"file://{tmp_path}")).collect()} == {("b.txt", "changed"), ("c.txt", "unexpected")}
    assert io.tree_hash(before).first()[0] != io.tree_hash(io.manifest(spark, f"file://{tmp_path}")).first()[0]
