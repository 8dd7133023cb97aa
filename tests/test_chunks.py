"""Chunks of records, trusted advice, expanded questions and the cascade against plain versions."""

import hashlib

from pyspark.sql import functions as F

from sahaf.operators import ranking, retrieval

RECORDS = "id long, title string, bank string, content string, fields array<string>, advice array<string>"


def test_chunks_of_records(spark):
    long = " ".join(f"kelime{k}." if k % 9 == 0 else f"k{k}" for k in range(700))
    rows = [(1, "T", "B", "kısa metin", ["a: 1", "b: 2"], ["x"]), (2, None, " ", long, ["a: 1"], []), (3, "T", None, long, [], ["y", "z"]), (4, "T", "B", long, [], []), (5, None, None, None, [], []), (None, "T", "B", "x", [], []), (6, "", "", "", ["f: 1"], None)]
    got = {}
    for r in retrieval.campaign_chunks(spark.createDataFrame(rows, RECORDS)).collect():
        got.setdefault(r.id, []).append(r)
        assert r.index_hash == hashlib.sha256(r.text.encode()).hexdigest()
    assert [(r.section, r.text) for r in got[1]] == [("overview", "Başlık: T\nBanka: B\nkısa metin\nYapılandırılmış alanlar: a: 1; b: 2\nNLP danışmanlık sinyalleri (otoriter filtre değildir):\nx")]
    assert set(got) == {1, 2, 3, 4, 6} and got[6][0].text == "Yapılandırılmış alanlar: f: 1"
    for i, header in ((2, ""), (3, "Başlık: T\n"), (4, "Başlık: T\nBanka: B\n")):
        windows = sorted((r.chunk, r.start, r.end, r.text) for r in got[i] if r.section == "content")
        want = retrieval.windows(long, 320, 40, 0.7, 32, ".!?")
        assert windows == [(k, a, b, f"{header}İçerik: {t}") for k, a, b, t in want]
    extra = {i: [(r.section, r.text) for r in got[i] if r.section != "content"] for i in (2, 3, 4)}
    assert extra == {2: [("structured_fields", "Yapılandırılmış alanlar: a: 1")], 3: [("nlp_advisory", "Başlık: T\nNLP danışmanlık sinyalleri (otoriter filtre değildir):\ny\nz")], 4: []}


def test_trusted_lines(spark):
    text = "Yeni müşteri kazanır"
    sha = hashlib.sha256(text.encode()).hexdigest()
    good = {"contract": retrieval.CONTRACT, "provenance": retrieval.PROVENANCE, "content_hash": "h", "source_version": 1, "text_sha256": sha}
    signals = [("b", "v2", 13, 20, "kazanır"), ("a", "v1", 0, 12, "Yeni müşteri"), ("a", "v1", 0, 12, "Yeni müşteri"), ("c", "v", 1, 5, "Yeni"), ("c", "v", -1, 3, "Yen"), ("c", "v", None, None, None)]
    cases = [good, *({**good, k: x} for k, x in (("contract", "x"), ("provenance", None), ("content_hash", "x"), ("content_hash", None), ("source_version", 2), ("source_version", None), ("text_sha256", "x")))]
    df = spark.createDataFrame([(k, text, *c.values(), signals) for k, c in enumerate(cases)], "k int, text string, contract string, provenance string, content_hash string, source_version int, text_sha256 string, signals array<struct<dimension: string, value: string, start: int, end: int, surface: string>>")
    record = F.struct("text", F.lit("h").alias("content_hash"), F.lit(1).alias("source_version"))
    advice = F.struct("contract", "provenance", "content_hash", "source_version", "text_sha256", "signals")
    got = {r.k: r.l for r in df.select("k", retrieval.trusted_lines(record, advice).alias("l")).collect()}
    assert got == {0: [f"{retrieval.SIGNAL}a: v1; kanıt: Yeni müşteri", f"{retrieval.SIGNAL}b: v2; kanıt: kazanır"]} | {k: [] for k in range(1, len(cases))}


def test_expanded_questions(spark):
    questions = spark.createDataFrame([(1, "konut finansmanı nedir"), (2, "bilinmeyen"), (3, None)], "id long, text string")
    aliases = spark.createDataFrame([("konut finansmanı", 1), ("konut", 2), ("ab", 3)], "surface string, term_id int")
    nodes = spark.createDataFrame([(1, "n1"), (2, "n2")], "term_id int, node string")
    edges = spark.createDataFrame([("n1", "x", "r", 0.9), ("n1", "y", "r", 0.95), ("n2", "x", "r", 1.0), ("n2", "z", "r", 0.85), ("n1", "w", "r", 0.5)], "source string, target string, relation string, confidence double")
    got = {r.id: r.expanded for r in retrieval.expanded_queries(questions, aliases, edges, nodes, 8, 3).collect()}
    assert got == {1: "konut finansmanı nedir konut finansmanı konut y x z", 2: "bilinmeyen", 3: ""}


def test_cascade(spark):
    listed = lambda *rows: spark.createDataFrame(list(rows), "query_id long, key long, rank int")
    queries = spark.createDataFrame([(k,) for k in range(5)], "query_id long")
    remote, local = listed((0, 10, 1), (0, 11, 2)), listed((0, 99, 1), (1, 12, 1))
    lexical, graph = listed((0, 11, 1), (1, 12, 1), (2, 13, 1), (3, 14, 1)), listed((0, 10, 1), (2, 15, 1))
    got = {}
    for r in ranking.cascade(queries, {"remote": remote, "local": local}, lexical, graph, 2).collect():
        got.setdefault((r.query_id, r.backend), []).append((r.rank, r.key))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {
        (0, "remote+bm25+knowledge-graph"): [(1, 10), (2, 11)], (1, "local+bm25"): [(1, 12)], (2, "bm25+knowledge-graph-fallback"): [(1, 15), (2, 13)], (3, "bm25-fallback"): [(1, 14)], (4, "none"): [(None, None)],
    }
