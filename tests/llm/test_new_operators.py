"""SentencePiece by prefixes, Elkan's clusters and repaired conversations, against the library and plain versions."""

import hashlib
import heapq
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from sahaf.llm import kmeans, pieces, structure
from sahaf.llm.queries import QUERIES, SQL
from tests.oracle import database, rows

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
MODEL = pieces.Model(pieces.default_model())


def encoded(texts, model=MODEL):
    offsets, ids = model.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


@given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet="the an▁ \tx\n", max_size=60), st.text(alphabet=" ", max_size=60)), max_size=5))
@settings(max_examples=300, deadline=None)
def test_pieces_equal_the_library(texts):
    assert encoded(texts) == [LIBRARY.encode(t) for t in texts]
    for ids in encoded(texts):
        assert MODEL.decode(np.array(ids, dtype=np.int64)) == LIBRARY.decode(ids)


@given(st.lists(st.one_of(st.integers(0, 258), st.integers(259, 31999), st.just(29871)), max_size=12))
@settings(max_examples=500, deadline=None)
def test_decoding_equals_the_library(ids):
    assert MODEL.decode(np.array(ids, dtype=np.int64)) == LIBRARY.decode(ids)


def test_pieces_of_a_full_memory(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_SEGMENTS", 5)
    monkeypatch.setattr(pieces, "CACHE_PAIRS", 7)
    small = pieces.Model(pieces.default_model())
    texts = [" ".join(f"word{k % 9}ing x{k}" for k in range(50)), "é" * 300, "", None, "word1ing again"]
    for _ in range(3):
        assert encoded(texts, small) == [LIBRARY.encode(t or "") for t in texts]
    assert len(small.known) <= 5


def test_prefixes_have_one_last_piece():
    """What the table rests on: the encoding of a prefix is a shorter prefix's encoding and one piece more."""
    rng = random.Random(4)
    for _ in range(200):
        text = "▁" + "".join(rng.choice("abcdeinrst") for _ in range(12))
        for n in range(2, len(text) + 1):
            whole = MODEL.merged(text[:n])
            assert MODEL.merged("".join(whole[:-1])) == whole[:-1]
            assert [MODEL.pieces[i] for i in MODEL.encode_segment(text[:n])] == whole


def test_round_trip_of_odd_documents(spark):
    long = " ".join(f"w{k % 977}x{k % 31}" for k in range(40_000)) + "a" * 50_000
    texts = [(1, "Hello  world"), (1, "Hello  world"), (2, None), (3, ""), (None, "no id"), (4, long), (5, " lead ▁ mark <s> </s> <0x41> \x00 \U0001f600 中")]
    df = spark.createDataFrame([(d, t, "x", [1]) for d, t in texts], "doc_id long, text string, n_tokens string, ids array<int>")
    want = []
    for d, t in texts:
        ids = LIBRARY.encode(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, pieces.round_trip(df).collect()), key=key) == sorted(want, key=key)
    assert pieces.round_trip(df.limit(0)).count() == 0
    lists = spark.createDataFrame([(1, [22172, None, 3186]), (2, None), (None, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in pieces.decode(lists).collect()} == {1: LIBRARY.decode([22172, 3186]), 2: "", None: ""}
    with pytest.raises(ValueError):
        MODEL.decode(np.array([32000]))


def test_op11_equals_the_library(spark, data):
    got = {r.doc_id: tuple(r) for r in QUERIES["op11_piece_prefixes"](spark, data).collect()}
    for d, t in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect():
        ids = LIBRARY.encode(t or "")
        assert got[d] == (d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest())


def lloyd(x, ids, k=40, rounds=5, salt="2:"):
    """Plain rounds over all distances."""
    order = sorted((i for i in range(len(ids)) if ids[i] is not None), key=lambda i: (hashlib.sha256(f"{salt}{ids[i]}".encode()).hexdigest(), x[i].tolist()))
    c = x[order[:k]]
    assign = lambda: ((x[:, None, :] - c[None]) ** 2).sum(2)
    for _ in range(rounds):
        a = assign().argmin(1)
        c = np.array([x[a == j].sum(0) // (a == j).sum() if (a == j).any() else c[j] for j in range(len(c))])
    d = assign()
    return d.argmin(1), d.min(1), c


def clusters_of(got):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.centroid_sha256) for r in got)


def expected(x, ids, **how):
    a, d, c = lloyd(x, ids, **how)
    return sorted((str(i), int(j), int(e), hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest()) for i, j, e in zip(ids, a, d, strict=True))


def test_clusters_equal_plain_rounds_with_many_ties(spark):
    """Small integers on a grid, each vector several times: distances tie everywhere, and most are never measured."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-2, 3, (300, 4)), np.repeat(rng.integers(-40, 40, (9, 4)), 60, axis=0)])
    ids = [*range(700), *[None] * 20, *range(120)]
    df = spark.createDataFrame([(i, (v / 4).tolist(), "c", 1) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, cluster string, distance int").repartition(5)
    got = kmeans.cluster(df, k=17, rounds=5, width=4, scale=4, salt="s").collect()
    assert clusters_of(got) == expected(x, ids, k=17, salt="s")
    assert {r.inertia for r in got} == {sum(r.distance for r in got)}
    of = {}
    for r in got:
        of[r.cluster] = of.get(r.cluster, 0) + r.distance
    assert all(r.cluster_inertia == of[r.cluster] for r in got)


def test_bounds_skip_most_distances(spark):
    rng = np.random.default_rng(5)
    x = (rng.integers(-2000, 2000, (12, 8))[rng.integers(0, 12, 3000)] + rng.integers(-9, 9, (3000, 8)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<int>")
    got = kmeans.cluster(df.selectExpr("vec_id", "cast(embedding as array<double>) embedding"), k=12, width=8, scale=1).collect()
    assert clusters_of(got) == expected(x, list(range(3000)), k=12)
    assert sum(r.measured for r in got) < 0.4 * 6 * 12 * 3000


def test_large_components_stay_exact(spark):
    x = np.array([[2**27, -(2**27)], [2**27 - 1, -(2**27)], [5, 2**27 - 3], [5, 2**27 - 2], [0, 0]])
    df = spark.createDataFrame([(i, v.astype(float).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert clusters_of(kmeans.cluster(df, k=3, rounds=2, width=2, scale=1).collect()) == expected(x, list(range(5)), k=3, rounds=2)
    with pytest.raises(Exception, match="too large|overflow|OVERFLOW"):
        kmeans.cluster(spark.createDataFrame([(0, [1e30, 0.0])], df.schema), k=3, width=2, scale=1).collect()


def test_clusters_of_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, [0.5, 0.25]), (1, [0.5, 0.25]), (2, None), (3, [nan, 0.0]), (4, [inf, 0.0]), (5, [1.0]), (6, [None, 1.0]), (None, [-0.001, 0.0]), (7, []), (8, [0.0, 0.0])]
    df = spark.createDataFrame(odd, "vec_id long, embedding array<float>")
    x, ids = np.array([[128, 64], [128, 64], [-1, 0], [0, 0]]), [1, 1, None, 8]
    assert clusters_of(kmeans.cluster(df, k=2, width=2).collect()) == expected(x, ids, k=2)
    assert clusters_of(kmeans.cluster(df, k=40, width=2).collect()) == expected(x, ids, k=40)
    assert kmeans.cluster(df.where("vec_id in (2, 3)"), width=2).count() == 0
    assert kmeans.cluster(df.where("vec_id is null"), width=2).count() == 0


WHITE = " \t\n\v\f\r"


def repaired(turns):
    """The cheapest edits by a search over (row, state), least audit first."""
    seen, faults = set(), []
    for _, role, text in turns:
        solid = text.rstrip(WHITE)
        faults.append("blank" if not solid.strip(WHITE) else "again" if (role, text) in seen else "cut" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in turns]
    counted = [t for t, _, _ in turns if t is not None]
    gaps = max(counted) - min(counted) + 1 - len(set(counted)) if counted else 0
    after, name = {"": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}
    queue, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, s, out = heapq.heappop(queue)
        if (i, s) in done:
            continue
        done.add((i, s))
        if i == len(turns) and s in ("", "a"):
            break
        if i < len(turns):
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, s, out))
            if faults[i] not in ("blank", "again"):
                price = cost + 5 * (faults[i] == "cut")
                if (initials[i], s) == ("s", "") or initials[i] == after[s]:
                    heapq.heappush(queue, (price, audit + "K", i + 1, initials[i], (*out, f"{turns[i][1]}:{turns[i][2]}")))
                heapq.heappush(queue, (price + 1, audit + "R", i + 1, after[s], (*out, f"{name[after[s]]}:{turns[i][2]}")))
        heapq.heappush(queue, (cost + 5, audit + "I", i, after[s], (*out, f"{name[after[s]]}:")))
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return gaps, faults.count("blank"), faults.count("again"), faults.count("cut"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def plain_repair(table):
    conversations = {}
    for conv, turn, role, text in table:
        own = conversations.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        elif kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif kind == 4:
            role = "user"
        own += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return {c: repaired(sorted(own, key=order)) for c, own in conversations.items()}


def same_repairs(df, **how):
    got = {r.conv_id: tuple(r)[1:] for r in structure.repair(structure.damage(df), **how).collect()}
    assert got == plain_repair([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


TEXTS = ["Hi.", "ok", "Yes!", "no end", "  ", "", "Same text.", None, "a. b? c", "x.\t\x0b\n", "\x1c", "é", "Why?\x00"]
ROLES = ["system", "user", "assistant", "tool"]
TURNS = "conv_id long, turn long, role string, text string"


def test_repairs_of_odd_tables(spark):
    rng = random.Random(3)
    some = [(rng.choice([None, *range(300)]), rng.choice([None, *range(12)]), rng.choice(ROLES if rng.random() < 0.8 else [None, "", "useful", "ass", "User", "é"]), rng.choice(TEXTS)) for _ in range(3000)]
    df = spark.createDataFrame([(*r, "c", 0) for r in some], TURNS + ", cost string, fault int")
    same_repairs(df)
    same_repairs(df.limit(0))
    same_repairs(spark.createDataFrame([(1, 0, "user", "w " * 400_000), (1, 0, "user", "w " * 400_000), (1, 1, "assistant", "w " * 300_000 + ".")], TURNS))


@pytest.mark.parametrize("block", [structure.BLOCK, 50])
def test_a_conversation_of_most_rows_spans_partitions_and_blocks(spark, block):
    rng = random.Random(5)
    hot = [(5 if rng.random() < 0.6 else k % 300, k // 3, rng.choice(ROLES), (rng.choice(TEXTS) or "") + (f"{k % 50}." if rng.random() < 0.7 else "")) for k in range(6000)]
    hot += [(7, None, "user", "same")] * 400
    df = spark.createDataFrame(hot, TURNS).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = structure._numbered(structure.damage(df))
        assert numbered.where("conv_id = 5").selectExpr(f"shiftright(place, {structure.PART}) part").distinct().count() > 2
        same_repairs(df, block=block)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_costs_backwards_equal_the_search():
    """The tensor of state costs alone, without Spark, on every short conversation of a few kinds of rows."""
    kinds = [("system", "a."), ("user", "b."), ("assistant", "c"), ("tool", "d."), ("user", " ")]
    for n in range(4):
        for k in range(5**n):
            turns = [(i, *kinds[k // 5**i % 5]) for i in range(n)]
            texts = [(i, r, t.replace(".", f"{i}.") if t != "c" else f"c{i}") for i, r, t in turns]
            role = np.array(["suat".index(r[0]) if r[0] in "sua" else 3 for _, r, _ in texts], dtype=int)
            fault = np.array([structure.BLANK if not t.strip() else structure.SOUND if t.endswith(".") else structure.TRUNCATED for _, _, t in texts], dtype=int)
            before, _ = structure.solve_back(role, fault, np.zeros(min(n, 1), dtype=int), structure.closing(structure.END)[None][: min(n, 1)])
            assert (before[0, structure.START] if n else 0) == repaired(texts)[5]


def test_op13_equals_the_search(spark, data):
    df = spark.read.parquet(f"{data}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op13_structure_repair"](spark, data).collect()}
    assert got == plain_repair([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_op12_equals_sql(spark, data):
    assert rows(QUERIES["op12_elkan_clusters"](spark, data).toPandas()) == rows(database(data).sql(SQL["op12_elkan_clusters"]).df())
