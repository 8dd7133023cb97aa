"""Scores, summaries, saves, caches, revalidated labels and margins against expected values."""

import collections
import re
import threading

import pytest
from pyspark.sql import functions as F

from sahaf.functions import spans
from sahaf.operators import evaluation, learning
from sahaf.plans import campaigns, jobs
from sahaf.sources import io, store

ANSWERS = [
    ("Kâr payı %1,5 ve 24 ay.", "Kâr payı %1,5 ve 24 ay.", ["kâr payı %1,5"], ""),
    ("bir bir iki", "bir iki iki üç", [], ""),
    ("KOD2024 ile %9 kazan", "kazan", ["kazan"], "KOD2024"),
    ("KOD1 KODA KODB KODC 7 8 9 10", "x", ["y"], ""),
    ("uzun " * 300, "uzun", [], ""),
    (evaluation.FALLBACK, evaluation.FALLBACK, ["x"], ""),
    ("başka", evaluation.FALLBACK, [], ""),
    ("", "", [], ""),
    (None, "x", [], ""),
    ("x", "", [], None),
]


def plain_score(answer, gold, facts, evidence):
    words = lambda t: re.findall(r"[a-z0-9çğıöşü%]+", (t or "").lower())
    codes = lambda t: {c.lower() for c in re.findall(r"(?<!\w)(?:%?\d[\d.,/-]*|[A-ZÇĞİÖŞÜ][A-ZÇĞİÖŞÜ0-9_-]{3,})(?!\w)", t)}
    answer = (answer or "").strip()
    if gold.strip() == evaluation.FALLBACK:
        return float(answer == evaluation.FALLBACK)
    a, g = collections.Counter(words(answer)), collections.Counter(words(gold))
    shared, n = sum((a & g).values()), sum(a.values()) + sum(g.values())
    f1 = 2 * shared / n if a and g else float(a == g)
    covered = sum(" ".join(words(f)) in " ".join(words(answer)) for f in facts)
    coverage = covered / len(facts) if facts else 1.0
    invented = len(codes(answer) - codes(f"{evidence or ''} {gold}"))
    long = 0.08 if len(answer) > max(900, 2 * len(gold)) else 0.0
    return round(max(0.0, min(1.0, 0.68 * coverage + 0.32 * f1 - min(0.35, 0.08 * invented) - long)), 6)


def test_answer_scores(spark):
    df = spark.createDataFrame([(k, *a) for k, a in enumerate(ANSWERS)], "k int, answer string, gold string, facts array<string>, evidence string")
    got = df.select("k", evaluation.answer_score(F.col("answer"), F.col("gold"), F.col("facts"), F.col("evidence")).alias("s")).orderBy("k").collect()
    assert [r.s for r in got] == pytest.approx([plain_score(*a) for a in ANSWERS], abs=1e-6)


def test_event_summary_counts_dimensions(spark):
    rows = [("a", float(k), k == 3, "p" if k % 2 else None, "x") for k in range(5)] + [("b", 1.0, True, None, None)]
    df = spark.createDataFrame(rows, "event string, latency double, failed boolean, provider string, action string")
    got = {r.event: r for r in evaluation.event_summary(df, ["provider", "action"]).collect()}
    assert (got["a"].n, got["a"].errors, got["a"].error_rate, got["a"].p50, got["a"].p95) == (5, 1, 0.2, 2.0, 4.0)
    assert got["a"].dimensions == ["action=x: 5", "provider=p: 2"] and got["b"].dimensions == []
    assert evaluation.event_summary(df.limit(0), ["provider"]).count() == 0


def test_kpi_report(spark):
    df = spark.createDataFrame([(0.9, None, 0)], "f1 double, recall double, synthetic int")
    got = {r.kpi: (r.passed, r.all_passed, r.synthetic) for r in evaluation.kpi_report(df, {"f1": 0.9, "recall": 0.8}).collect()}
    assert got == {"f1": (True, False, False), "recall": (False, False, False)}


def test_saves_leave_no_gap_and_one_winner(spark, tmp_path):
    path = f"file://{tmp_path}/note.txt"
    first = store.save(spark, path, b"one", None)
    with pytest.raises(store.Changed):
        store.save(spark, path, b"two", None)
    won, lost, missing, stop = [], [], [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                (tmp_path / "note.txt").read_bytes()
            except FileNotFoundError:
                missing.append(1)

    def write(k):
        try:
            won.append(store.save(spark, path, b"w%d" % k, first))
        except store.Changed:
            lost.append(k)

    reader = threading.Thread(target=read)
    writers = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    reader.start()
    for t in writers:
        t.start()
    for t in writers:
        t.join()
    stop.set()
    reader.join()
    assert len(won) == 1 and len(lost) == 5 and not missing
    assert store.digest_of(spark, path) == won[0]
    assert [p.name for p in tmp_path.iterdir() if p.name.endswith((".tmp", ".claim"))] == []


def test_a_dead_writers_claim_is_taken_over(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/note.txt"
    (tmp_path / "note.txt.absent.claim").touch()
    with pytest.raises(store.Changed):
        store.save(spark, path, b"one", None)
    monkeypatch.setattr(store, "CLAIM_SECONDS", -1)
    store.save(spark, path, b"one", None)


def test_cache_sees_changes_in_partitions(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(10).selectExpr("id", "id % 3 p").write.partitionBy("p").parquet(path)
    cache = store.FileCache(spark, lambda s, p: s.read.parquet(p).count())
    assert cache.get(path) == (10, False) and cache.get(path) == (10, True)
    spark.range(5).write.mode("append").parquet(f"{path}/p=1")
    assert cache.get(path) == (15, False)


def test_envelopes_of_a_large_group(spark, tmp_path):
    path = f"file://{tmp_path}/e"
    df = spark.range(1000).selectExpr("id", "case when id < 900 then 'hot' end g")
    io.write_envelopes(df, path, F.col("g"), records=100)
    assert spark.read.json(path).selectExpr("size(records) n").agg(F.max("n"), F.sum("n"), F.count("*")).first()[1] == 1000
    assert spark.read.json(path).selectExpr("max(size(records)) n").first().n < 200
    assert sorted(r.id for r in io.read_envelopes(spark, path, "id: bigint, g: string").collect()) == [*range(1000)]


def test_unknown_banks_stop_the_job(spark):
    known = spark.createDataFrame([(1, "a bank")], "bank_id int, slug string")
    assert io.known_banks(spark.createDataFrame([(" A Bank ",)], "name string"), known).first().bank_id == 1
    with pytest.raises(Exception, match="no known bank"):
        io.known_banks(spark.createDataFrame([("Other",)], "name string"), known).collect()


def test_revalidated_labels(spark):
    span = lambda a, b, t: (a, b, t, "X", 1.0)
    records = spark.createDataFrame([(1, "abc def", "h"), (2, "x abc def", "h2"), (3, "abc abc", "h"), (4, "none", "h"), (5, None, "h")], "id long, text string, hash string")
    labels = spark.createDataFrame([(1, "h", [span(0, 3, "abc"), span(4, 7, "def")]), (2, "h", [span(0, 3, "abc"), span(4, 7, "gone")]), (3, "h", [span(1, 4, "abc"), span(0, 3, "abc"), span(0, 0, "")]), (5, "h", [span(0, 1, "a")])], f"id long, hash string, spans ARRAY<{spans.SPAN}>")
    rows, observation = learning.revalidated(records, labels)
    got = {r.id: (r.state, [(s.start, s.end) for s in r.spans or []], r.kept, r.moved, r.removed) for r in rows.collect()}
    assert got == {1: ("good", [(0, 3), (4, 7)], 2, 0, 0), 2: ("stale", [(2, 5)], 0, 1, 1), 3: ("good", [(0, 3)], 1, 0, 2), 4: ("missing", [], 0, 0, 0), 5: ("good", [], 0, 0, 1)}
    assert observation.get == {"records": 5, "missing": 1, "stale": 1, "kept": 3, "moved": 1, "removed": 4}
    assert learning.all_current(rows.where("id in (1, 3)")).count() == 2
    with pytest.raises(Exception, match="labels are stale of 2"):
        learning.all_current(rows).collect()


def test_margins_and_evidence(spark):
    rows = [(k, "good plain words" if k % 2 else "bad ## junk", k % 2, 1) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, text string, good int, same int")
    model = learning.label_heads(df, ["good", "same"])
    margins = learning.label_margins(model, df, "id")
    assert {r.label for r in margins.collect()} == {"good"}
    assert all((r.margin > 0) == (r.id % 2 == 1) for r in margins.collect())
    evidence = df.where("id < 10").selectExpr("id", "'good' label")
    kept = {r.id: r.kept for r in learning.gated_labels(margins, evidence, "id", ["good"]).collect()}
    assert kept == {k: k < 10 for k in range(1, 40, 2)}
    assert all(r.kept for r in learning.gated_labels(margins, evidence, "id", []).collect())


def test_learned_queries_are_right_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    languages = jobs.l01(spark, sf).collect()
    assert sum(r.accuracy * r.n for r in languages) >= 0.95 * sum(r.n for r in languages)
    heads = jobs.l02(spark, sf).first()
    assert heads.quality_accuracy >= 0.85 and heads.toxic_accuracy >= 0.85
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = [r for r in campaigns.l03(spark, sf).collect() if r.kept]
    assert sum({"junk": labels[r.doc_id].quality == 0, "toxic": labels[r.doc_id].toxic == 1}[r.label] for r in kept) >= 0.75 * len(kept) > 0
