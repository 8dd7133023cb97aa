"""The pipeline's stages, and its registered queries against their SQL."""

import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from sahaf.llm import tokens
from sahaf.llm.queries import QUERIES, SQL
from tests.oracle import database, rows


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, name):
    assert rows(QUERIES[name](spark, data).toPandas()) == rows(database(data).sql(SQL[name]).df())


def test_all_eleven_are_registered():
    names = entry.queries()
    assert {re.match(r"op\d+", n)[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 11)} and "pipeline" in names


def test_stages_take_effect_and_keep_the_columns(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kinds, counts = docs.dtypes, [docs.count()]
    benchmark = [r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, data).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.dtypes == kinds
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.6 * counts[0]
    left = [r["text"] for r in docs.select("text").collect()]
    assert not any(b in t for b in benchmark for t in left)
    packed = {r["doc_id"] for r in corpus_pipeline.pack(spark, docs, data).select("doc_id").collect()}
    assert packed == {r["doc_id"] for r in docs.select("doc_id").collect()}
    run = {r["doc_id"] for r in corpus_pipeline.run(spark, data).select("doc_id").collect()}
    assert run == packed


def test_a_planted_passage_of_51_words_goes(spark, data):
    words = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    passage, short = words("p", 51), words("s", 50)
    assert len(passage) < 400
    texts = [f"{words(f'{k}a', 60)} {passage} {words(f'{k}b', 60)} {short}" for k in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.remove_repeated_passages(spark, docs, data).collect()}
    assert left == {k: t.replace(passage + " ", "") for k, t in enumerate(texts)}


def tables(spark, folder, documents, benchmark, labels):
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_run_equals_brute_force_after_the_learned_stage(spark, tmp_path):
    """Toxicity is learned; every later stage is told by plain Python on what that stage left."""
    rng = random.Random(9)
    prose = lambda n, tag: " ".join(f"{tag}{rng.randint(0, 5000)}" for _ in range(n))
    passage, item = prose(60, "p"), prose(25, "q")
    docs = [(k, prose(rng.randint(20, 200), "w")) for k in range(60)]
    docs += [(60 + k, f"{prose(30, 'x')} {passage} {prose(30, 'y')}") for k in range(6)]
    docs += [(70, docs[3][1]), (71, docs[4][1] + " end"), (72, f"{prose(9, 'z')} {item} {prose(9, 'z')}"), (73, None), (74, "")]
    docs += [(80 + k, f"{prose(40, 'w')} grr{k % 3} zug") for k in range(40)]
    labels = [(d, 1, int(d >= 80)) for d, _ in docs if d % 7]
    tables(spark, tmp_path, [(d, t, "en", "s", len(t or "")) for d, t in docs], [(1, item)], labels)
    kept = {r["doc_id"] for r in corpus_pipeline.reject_toxic(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()}
    assert {d for d, _ in docs if d < 80} <= kept and len(kept) < 100
    left = {d: t for d, t in docs if d in kept}
    del left[70], left[71]  # copies of 3 and 4, exact and near
    left = {d: t.replace(passage + " ", "") if t else t for d, t in left.items()}
    del left[72]
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    library = Tokenizer.from_file(tokens.default_tokenizer())
    for d, t in left.items():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        own = got[got.doc_id == d].sort_values("piece")
        assert own.length.sum() == len(ids)
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes())
    assert set(got.doc_id) == set(left)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= 1024 and g.offset.tolist() == np.cumsum([0, *g.length])[:-1].tolist()


def test_run_on_odd_and_empty_tables(spark, tmp_path):
    long = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))
    docs = [(1, "The cat sat on the mat today", None, "s", 5), (1, "The cat sat on the mat today", "en", None, None), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "no id here at all", "en", "s", 1), (4, long, "en", "s", 9), (1, "another text", "en", "s", 3)]
    tables(spark, tmp_path / "odd", docs, [(None, None), (1, "")], [(None, 1, 1), (1, None, None)])
    got = corpus_pipeline.run(spark, str(tmp_path / "odd")).toPandas()
    assert sorted(got[got.piece == 0].doc_id.fillna(-1).astype(int)) == [-1, 1, 1, 2, 3, 4]
    tables(spark, tmp_path / "none", [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
