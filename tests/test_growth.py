"""What must hold for larger tables: joins that are not broadcast, fields that are not made, rows that many tasks share."""

from __future__ import annotations

import io
import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from sahaf.functions import fields, patterns, spans
from sahaf.functions import text as tx
from sahaf.operators import duplicates, index, labelling, learning, policy, ranking, retrieval
from sahaf.plans import campaigns, language, periods, registry
from sahaf.sources import store


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_of_fingerprints_are_not_broadcast(spark):
    own = spark.range(40).select("id", F.lit("b").alias("bank"), F.expr("shiftleft(1L, CAST(id % 8 AS INT))").alias("fp"), F.lit("c").alias("cluster"))
    for df in (duplicates.near_pairs(own), duplicates.nearest_existing(own.where("id % 2 = 1"), own.where("id % 2 = 0"))):
        joins = [line for line in plan(df).splitlines() if "Join" in line and "key" in line]
        assert joins and not any("Broadcast" in line for line in joins)
    assert duplicates.near_pairs(own).count() == 28


def test_notices_hold_only_the_fields_that_are_asked_for(spark, data):
    assert language.told(spark, data, "product_type", "term_months").select("f.*").columns == ["product_type", "term_months"]
    shown = language.told(spark, data, "term_months", shown=["term_months"]).select(F.explode("f.evidence").alias("field", "words"))
    assert [r.field for r in shown.select("field").distinct().collect()] == ["term_months"]


def test_small_files_of_orders_are_dealt_to_many_tasks(spark, data):
    for df in (language.noticed(spark, data), campaigns.campaigns(spark, data)):
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_rule_runs_only_on_texts_that_hold_its_literals(spark):
    texts = ["12 ay vade", "", None, "BAHAR İNDİRİM KODU", "İNDIRIM yüzde 5 indirim", "Tahsis ücreti", "tahs\x01is"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for rule in [*spans.CODES, *spans.RULES, *(spans.Rule("", 0.0, p, *spans.NO_LETTER) for _, p in spans.CHANNELS)]:
        whole = f"({rule.before})({rule.pattern})({rule.behind})"
        rows = df.select(patterns.may_match(patterns.folded(F.col("t")), whole).alias("may"), F.col("t").rlike(("(?U)" if rule.sharp else "(?iuU)") + whole).alias("does")).collect()
        assert all(r.may or not r.does for r in rows)
        assert rows[2].may is None and not rows[1].may


def test_texts_of_marks_and_other_scripts_are_repaired(spark, tmp_path):
    own = ["Ärger", "5 €", "it’s", "kâr", "мир", "中文", "ödül", "plain", "", None, "Ã©", "\x85", "Å™"]
    spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["x19_mojibake_repair"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r.repaired for r in got] == own


def test_a_claim_that_is_let_go_meanwhile_is_tried_again(monkeypatch):
    class Files:
        tries = 0

        def create(self, at, overwrite):
            self.tries += 1
            if self.tries == 1:
                raise RuntimeError("org.apache.hadoop.fs.FileAlreadyExistsException: File already exists")
            return io.BytesIO()

        def exists(self, at):
            return False

    files = Files()
    monkeypatch.setattr(store, "filesystem", lambda spark, path: (files, path))
    assert store._claim(None, "note", None) == (files, "note.absent.claim")


def test_lexical_scores_shuffle_only_the_best_rows(spark, monkeypatch):
    texts = [(f"d{k}", f"alpha {'beta ' * (k % 4)}w{k % 5} çay") for k in range(40)] + [("d3", "beta w9"), (None, "alpha w1"), ("e", None), ("f", "other")]
    asked = {0: "Beta alpha beta", 1: "w1 w2 çay", 2: "nowhere", 3: "w9", 4: ""}
    docs = spark.createDataFrame(texts, "id string, text string").coalesce(3)
    queries = spark.createDataFrame(list(asked.items()), "query_id long, query string")
    lengths = [len(t.split()) for _, t in texts if t is not None]
    own, dl = {}, {}
    for i, t in texts:
        own.setdefault(i, Counter()).update((t or "").split())
        dl.setdefault(i, set()).add(len((t or "").split()))
    want = {}
    for q, words in asked.items():
        score = dict.fromkeys(own, 0.0)
        for t in set(words.lower().split()):
            df = sum(t in c for c in own.values())
            for i, c in own.items():
                score[i] += math.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * min(dl[i]) / (sum(lengths) / len(lengths)))) if c[t] else 0
        best = sorted(((-round(s, 6), i or "", i) for i, s in score.items() if s and len(dl[i]) == 1))  # of several rows' lengths any counts
        want |= {(q, i): -s for s, _, i in best[:6]}
    one = retrieval.bm25(docs, queries, 6)
    assert plan(one).count("Exchange") == 1 and "Join" not in plan(one)  # before, every token of every text went through one
    monkeypatch.setattr(retrieval, "CELLS", 8)
    for size in (1024, 2):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", size)
        got = {(r.query_id, r.id): r.score for r in retrieval.bm25(docs, queries, 7).where("id is null or id <> 'd3'").collect()}
        assert all(math.isclose(got[k], s, abs_tol=2e-6) for k, s in want.items())
    assert [(r.id, r["rank"]) for r in one.where("query_id = 3").collect()] == [("d3", 1)]


def test_a_task_holds_a_bounded_slice_of_scores(spark, monkeypatch):
    rng = np.random.default_rng(3)
    own = [(k, rng.integers(-3, 4, 4).astype(float).tolist()) for k in range(300)] + [(300, None), (301, [0.0] * 4), (302, [1.0, float("nan"), 0.0, 0.0]), (303, [1.0, 2.0]), (304, [])]
    vectors = spark.createDataFrame(own, "vec_id long, embedding array<double>").coalesce(2)
    asked = vectors.where("vec_id % 7 = 0 or vec_id > 299").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    whole = sorted(map(tuple, retrieval.nearest(vectors, asked, 5).collect()))
    monkeypatch.setattr(retrieval, "CELLS", 100)
    assert sorted(map(tuple, retrieval.nearest(vectors, asked, 5).collect())) == whole
    q, v = np.array([own[k][1] for k in range(0, 300, 7)]), np.array([own[k][1] for k in range(300)])
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    with np.errstate(invalid="ignore"):
        score = np.round(np.maximum(unit(q) @ unit(v).T, 0), 6)
    score[np.isnan(score)] = -1
    for n, row in enumerate(score):
        row[7 * n] = -1
        best = sorted((-s, k) for k, s in enumerate(row) if s >= 0)[:5]
        assert [(r[1], r[2]) for r in sorted(whole, key=lambda r: r[3]) if r[0] == 7 * n] == [(k, -s) for s, k in best]
    task = retrieval.Best(3, 2)
    for a in range(0, 12, 4):
        task.add(pa.array(range(a, a + 4)), np.ones((4, 3)))
        assert task.held.num_rows <= 6 and task.held["id"].to_pylist() == [0, 1] * 3


def test_a_group_of_all_rows_is_not_one_tasks(spark):
    rows = [(k, "a" if k < 90 else None, float("nan") if k == 3 else [0.5, 0.25, None, -0.0][k % 4] if k < 90 else 2.0) for k in range(100)]
    df = spark.createDataFrame(rows, "id long, g string, x double")
    for lowest, want in ((True, {k for k in range(90) if k % 4 == 3 and k != 3} | set(range(90, 100))), (False, {3} | set(range(90, 100)))):
        found = ranking.extrema(df, "g", "x", lowest)
        assert "Window" not in plan(found) and found.columns == df.columns
        assert {r.id for r in found.collect()} == want


def test_texts_are_taken_apart_in_bounded_slices(monkeypatch):
    monkeypatch.setattr(tx, "CHARACTERS", 50)
    texts = pd.Series(["a b c d " * (k % 5) for k in range(40)] + [None, "", "x" * 400, "y"])
    cut = tx.slices(texts)
    assert [k for a, b in cut for k in range(a, b)] == list(range(len(texts)))
    assert all(texts[a + 1 : b].str.len().sum() < 50 for a, b in cut) and tx.slices(texts[:0]) == []
    seen, whole = [], tx.simhashes(texts)
    simhashes = tx.simhashes
    monkeypatch.setattr(tx, "simhashes", lambda x: seen.append(len(x)) or simhashes(x))
    assert tx.simhash.func(texts).tolist() == whole.tolist() and len(seen) == len(cut) > 10


def test_labels_and_evidence_are_columns_of_their_texts(spark):
    texts = spark.createDataFrame([(1, "İnternet şubesi veya şubeden ATM. KOBİ müşterileri yararlanamaz."), (2, None), (3, ""), (4, "KOBİ ve esnaf: %0 taksit")], "id long, text string")
    labels, evident = labelling.weak_labels(texts), labelling.evidence(texts)
    for df in (labels, evident):
        assert not any(x in plan(df) for x in ("Exchange", "Join"))
    assert {(r.id, r.label, r.start, r.end, r.surface) for r in evident.collect()} == {(1, "internet_branch", 0, 15, "İnternet şubesi"), (1, "physical_branch", 21, 28, "şubeden"), (1, "atm", 29, 32, "ATM"), (4, "commercial_sme", 0, 4, "KOBİ"), (4, "installment", 18, 24, "taksit")}
    assert {r.id: r.channels for r in labels.collect()}[2] == ["unspecified"]


def test_dated_texts_are_dealt_to_many_tasks(spark, data):
    assert periods.dated(spark, data).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism

def test_claims_look_only_at_places_where_a_claim_may_begin(spark):
    texts = ["%5 kâr", "5 % oran", "₺100 ve 1.500 TL", "1,5 milyon TL, 12 ay", "Masrafsız", "MASRAFSIZ", "ÜCRETSİZ", "ucretsiz", "[1] 7. madde", "3) 25 gün", "a1 9b 19.12.2025", "", "yok"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = f"(?iu){policy.RATE_CLAIM}|{policy.MONEY_CLAIM}|{policy.DURATION_CLAIM}"
    ahead = f"(?iu){policy.STARTS}(?:{whole[5:]})"
    for old, new in ((whole, ahead), (f"(?iu){policy.FREE_CLAIM}", f"(?iu)(?=[müu])(?:{policy.FREE_CLAIM})")):
        assert all(r.a == r.b for r in df.select(F.regexp_extract_all("t", F.lit(old), F.lit(0)).alias("a"), F.regexp_extract_all("t", F.lit(new), F.lit(0)).alias("b")).collect())
    got = [sorted(r.c) for r in df.select(policy.claims(F.col("t")).alias("c")).collect()]
    assert got[:4] == [["rate:5.0"], ["rate:5.0"], ["money:100.0:TRY", "money:1500.0:TRY"], ["duration:12:month", "money:1500000.0:TRY"]]
    assert got[4:6] == [["fee:free"]] * 2 and got[7] == ["fee:free"] and got[8] == [] and got[11:] == [[], []]


def test_the_claims_of_a_campaign_are_told_once(spark, data):
    asked = registry.QUERIES["q14_claims_in_evidence"](spark, data)._jdf.queryExecution().analyzed().toString()
    assert 1 <= asked.count(policy.MARKER) <= 3  # both sides of the join, and the lines of the answer


def test_an_audience_without_its_words_is_its_label(spark):
    texts = ["Emekliler için. Öğrenciler hariç.", "KOBİ ve esnaf için", "Öğrenciler hariç", "", None, "doktorlara açık; emekliler"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(fields.audience(F.col("t")).alias("a"), fields.audience(F.col("t"), shown=False).alias("b")).collect()
    assert [r.b for r in rows] == [r.a and r.a.label for r in rows] == ["retiree", "commercial", None, None, None, "public_sector"]
    assert fields.KINDS["target_audience"] == "string" and "shown" not in plan(df.select(fields.prd_fields("t", ["target_audience"])))


def test_centers_are_fitted_without_distances_of_all_pairs(spark, monkeypatch):
    asked, fit = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, rows: asked.append(self.getSolver()) or fit(self, rows))
    rows = spark.range(60).select("id", F.array(F.sin("id"), F.cos("id"), F.lit(0.5)).alias("embedding"))
    assert len(index._fit(rows, 5)) == 5 and asked == ["block"]


def test_pairs_of_one_group_are_many_tasks_work(spark):
    own = spark.range(300).select(F.lit("g").alias("g"), F.concat(F.lit("o"), "id").alias("id")).unionByName(spark.createDataFrame([("h", "a"), (None, "b"), (None, "c")], "g string, id string"))
    pairs = ranking.pairs_within(own, ["g"], "id").withColumn("task", F.spark_partition_id())
    assert pairs.count() == pairs.select("id", "other").where("id < other").distinct().count() == 300 * 299 // 2
    assert pairs.select("task").distinct().count() > 8


def test_pair_keys_are_dealt_by_cells(spark, data):
    assert "__b" in plan(registry.QUERIES["j18_pair_keys"](spark, data))


def test_words_of_many_texts_are_hashed_once_into_the_same_vectors(spark):
    from pyspark.ml.feature import HashingTF

    texts = ["", None, "a", "ab c", "  abc  d ", "İSTANBUL ığüş", "x1yy2zzz3wwww4vvvvv5", "𐐀𐐁𐐂 a𐐀b 𐐀", "..", "é éx\n\tq", "日本語テキスト 中", "tekrar tekrar Tekrar"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string").coalesce(1)
    grams = """flatten(transform(filter(split(lower(substring(coalesce(text, ''), 1, 100000)), '[^\\\\p{L}]+'), w -> w <> ''), w -> flatten(transform(sequence(3, 5),
        n -> transform(sequence(1, greatest(length(w) + 3 - n, 1)), i -> substring(concat(' ', w, ' '), i, n))))))"""
    plain = HashingTF(inputCol="grams", outputCol="tf", numFeatures=1 << 14).transform(df.withColumn("grams", F.expr(grams)))
    assert {r.id: r.tf for r in learning.gram_counts(df, "text", 1 << 14).collect()} == {r.id: r.tf for r in plain.collect()}
    assert len(learning.grams_of("tekrar")) == 6 + 5 + 4 and "transform(" not in plan(learning.gram_counts(df, "text", 1 << 14))


def test_statuses_are_of_all_core_fields(spark, data):
    got = registry.QUERIES["a08_field_statuses"](spark, data).groupBy("field").agg(F.sum("n").alias("n")).collect()
    assert sorted(r.field for r in got) == sorted(fields.CORE) and len({r.n for r in got}) == 1


def test_contracts_hold_dates_of_the_record_and_values_in_conflict(spark):
    texts = spark.createDataFrame([("%1,5 oran ve %2 oran. Kampanya tarihe kadar.",), ("",)], "text string").select("text", fields.prd_fields("text").alias("f"))
    dates = {"campaign_start_date": F.when(F.col("text") != "", F.lit("2024-03-01"))}
    got, none = (r.c for r in texts.select(fields.contracts(F.col("text"), F.col("f"), dates=dates).alias("c")).collect())
    assert sorted(got) == sorted(fields.CORE) and {c.method for c in got.values()} == {"rules-v1"}
    assert (got["campaign_start_date"].value, got["campaign_start_date"].status) == ("2024-03-01", "IMPLICIT")
    assert got["campaign_end_date"].status == "EXTRACTION_FAILED" and none["campaign_start_date"].status == "NOT_STATED"
    assert got["profit_share_rate"].conflicting_values == [0.015, 0.02] and none["profit_share_rate"].conflicting_values == []


def test_labels_and_their_evidence_stay_in_the_text_s_row(spark, data):
    for name in ("e18_gated_labels", "r02_trusted_advice"):
        shown = plan(registry.QUERIES[name](spark, data))
        assert "Join" not in shown and "SortAggregate" not in shown and "ObjectHashAggregate" not in shown
    texts = spark.createDataFrame([(1, "Yeni müşteri dahil değildir. Nakit iade!"), (2, ""), (3, None)], "id long, text string")
    got = {(r.id, r.label): (r.start, r.end, r.surface) for r in labelling.shown_labels(texts).select("id", F.inline_outer("labels")).collect() if r.dimension == "campaign_mechanics" or r.dimension == "target_segments" or r.dimension == "channels"}
    assert got == {(1, "cashback"): (29, 39, "Nakit iade"), (1, "new_customer"): (None, None, None), **{(k, "unspecified"): (None, None, None) for k in (1, 2, 3)}}


def test_words_are_told_apart_in_small_batches(spark):
    texts = spark.range(2 * learning.BATCH + 1).select(F.concat(F.lit("kart "), F.repeat(F.lit("ev "), (F.col("id") % 3).cast("int"))).alias("text"), "id").coalesce(1)
    got = learning.gram_counts(texts, "text", 64)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(learning.BATCH)
    assert got.count() == 2 * learning.BATCH + 1 and got.groupBy((F.col("id") % 3).alias("k")).agg(F.countDistinct(F.col("tf").cast("string")).alias("n")).where("n > 1").count() == 0


def test_only_the_entities_that_are_asked_for_are_looked_for(spark):
    texts = spark.createDataFrame([("Yeni müşteri için Bonus kartı ATM ve şube.",), ("",), (None,)], "text string")
    rows = texts.select(spans.context_entities(F.col("text")).alias("a"), spans.context_entities(F.col("text"), ["CUSTOMER_REFERENCE"]).alias("b")).collect()
    assert all([x for x in r.a if x.label == "CUSTOMER_REFERENCE"] == r.b for r in rows) and len(rows[0].a) > len(rows[0].b) == 1
