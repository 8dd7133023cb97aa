"""Each operator against a brute-force version, a round trip or held-out accuracy, and on odd tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sahaf.llm import chat, common, decontamination, huffman, neardup, packing, quality, suffixes, tokens, topk, toxicity, urls
from sahaf.llm.components import connected_components

RULES = [urls.Rule("allow", "org", "/"), urls.Rule("block", "example.org", "/es/"), urls.Rule("block", "example.org", "/en/1"), urls.Rule("allow", "com", "/fr/"), urls.Rule("block", "com", "/de/")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, white space of all kinds, an extra column of a clashing name."""
    long = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000))
    rows = [(1, "The cat sat on the mat today"), (1, "The cat sat on the mat today"), (2, None), (3, ""), (None, "no id here at all"), (None, None), (4, long), (5, long + " end"), (6, " \t\n "), (7, "One"), (8, "one"), (9, "a  b c\n\n d <|endoftext|> é"), (10, "\x1c"), (11, "the CAT sat on the mat today")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "tk": F.lit("x"), "score": F.lit(0.5), "source": F.lit(None).cast("string"), "lang": F.lit("en")})


@pytest.fixture(scope="module")
def empty(spark, odd):
    return odd.limit(0)


def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


TOKENIZER = Tokenizer.from_file(tokens.default_tokenizer())  # as the contract calls it, untouched by the operators


def ids_of(text, end):
    return np.append(np.array(TOKENIZER.encode(text or "", add_special_tokens=False).ids, dtype="<u4"), np.uint32(end)).astype("<u4")


def test_encoder_equals_the_library():
    e = tokens.Encoder(tokens.default_tokenizer(), cache_parts=5)
    texts = ["a b c", " lead", "trail ", "x  y", "", None, "tab\tz \n q", "a b c d e f g h", "é ü x y", "b", "<|endoftext|> b", "a<|endoftext|>", "hello <|endoftext|> world<|endoftext|>", "thirteenbytes fourteen_bytes fifteenth_bytes sixteen_bytes_16 seventeen_bytes_2 sixteen_bytes_17"] * 2
    assert [list(x) for x in e.encode(texts)] == [TOKENIZER.encode(t or "", add_special_tokens=False).ids for t in texts]


def thue_morse(n):
    bits = "a"
    while len(bits) < n:
        bits += bits.translate({97: "b", 98: "a"})
    return bits, bits.translate({97: "b", 98: "a"})


def test_parts_that_hash_alike_stay_apart(spark):
    """Polynomial hashes modulo a power of two take the two words for one."""
    one, two = thue_morse(2048)
    specials = "hello <|endoftext|> world<|endoftext|>"
    docs = spark.createDataFrame([(1, f"x {one} y"), (2, f"x {two} y"), (3, specials), (4, two), (5, one)], "doc_id long, text string").coalesce(1)
    texts = dict(docs.collect())
    e = tokens.Encoder(tokens.default_tokenizer())
    assert [list(x) for x in e.encode([*texts.values()] * 2)] == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in [*texts.values()] * 2]
    for r in huffman.round_trip(docs).collect():
        assert r.ids_crc32 == zlib.crc32(ids_of(texts[r.doc_id], 0).tobytes())
    for r in packing.pack(docs).collect():
        assert r.ids_crc32 == zlib.crc32(ids_of(texts[r.doc_id], 2)[r.start : r.start + r.length].tobytes())
    assert (suffixes.as_words(one) != suffixes.as_words(two)).all()


@given(st.lists(st.text(alphabet="ab éx<|endoftext|>\t \n", max_size=40), max_size=6))
@settings(max_examples=150, deadline=None)
def test_encoder_equals_the_library_on_any_text(texts):
    texts = [*texts, "<|endoftext|>".join(texts)]
    assert [list(x) for x in tokens.Encoder.encode(ENCODER, texts)] == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]


ENCODER = tokens.Encoder(tokens.default_tokenizer(), cache_parts=200)


def brute_cost(roles, costs=chat.Costs()):
    best = {chat.START: 0}
    for r in roles:
        after = {}
        for s, c in best.items():
            for t in range(3):
                price = c + (costs.assign if r is None else costs.relabel * (t != r))
                ways = [costs.merge] * (s == t) + [costs.insert * len(w) for w in [chat.WAYS[s, t]] if w is not None]
                for w in ways:
                    after[t] = min(after.get(t, 10**9), price + w)
        best = after
    return min(c + costs.insert * len(chat.CLOSING[s]) for s, c in best.items())


def test_role_repair_costs_least_and_is_legal(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["system", "user", "assistant", "??", None, "User "]), f"t{c}.{t}") for c in range(60) for t in range(rng.randint(1, 6))]
    got = chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).toPandas()
    for _, g in got.groupby("conv_id"):
        g = g.sort_values("turn")
        assert g.cost.sum() == brute_cost([chat.ALIASES.get(x) if x else None for x in g.role_in])
        shown = [r for r in re.findall(r"<\|(\w+)\|>", "".join(g.rendered)) if r != "end"]
        assert re.fullmatch(r"(system )?(user assistant )+", " ".join(shown) + " ")
        assert len(shown) - 1 - len(g.inserted_after.iloc[-1]) == g.message.iloc[-1]


def test_a_conversation_over_many_partitions(spark):
    rng = random.Random(2)
    rows = [(7, t, rng.choice(["system", "user", "assistant", "??", None]), f"x{t}") for t in range(300)] + [(1, 0, "user", "a")]
    got = []
    for n in ("40", "1"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got.append(sorted(map(str, chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got[0] == got[1] and len(got[0]) == 301


def test_role_repair_of_odd_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, None, None), (2, 0, "assistant", None), (2, None, "", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("h", F.lit(1))
    got = chat.repair(df).toPandas()
    assert sorted(got.copies) == [1, 1, 1, 2]
    assert chat.repair(df.limit(0)).count() == 0


def check_packing(got, docs):
    got = sorted(got, key=lambda r: (r["sequence_id"], r["offset"]))
    at = {}
    for r in got:
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values(), default=0) <= 1024
    want = collections.Counter()
    for doc, text in docs:
        ids = ids_of(text, 2)
        first = len(ids) % 1024 or 1024 if len(ids) > 1024 else len(ids)
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    return len(at), sum(at.values())


def test_packing_is_tight(spark, data):
    docs = documents(spark, data)
    bins, total = check_packing(packing.pack(docs).collect(), docs.select("doc_id", "text").collect())
    assert bins <= -(-total // 1024) + 3


def test_packing_of_odd_rows(spark, odd, empty):
    check_packing(packing.pack(odd).collect(), odd.select("doc_id", "text").collect())
    assert packing.pack(empty).count() == 0
    seq = packing.sequences(odd).toPandas()
    assert sum(map(len, seq.ids)) == sum(len(ids_of(t, 2)) for t, in odd.select("text").collect())


def test_minimum_bin_slack_takes_the_fullest():
    assert packing.minimum_bin_slack({7: 2, 3: 2, 5: 1}, 10) == [(2, {7: 1, 3: 1}), (1, {5: 1})]
    assert packing.minimum_bin_slack({}, 10) == []
    with pytest.raises(ValueError, match="lengths"):
        packing.minimum_bin_slack({11: 1}, 10)


def least_bins(pieces, capacity):
    """The fewest bins, by depth-first search."""
    pieces, best = sorted(pieces, reverse=True), [len(pieces)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(pieces):
            best[0] = len(bins)
            return
        for room in sorted({b for b in bins if b >= pieces[k]}):
            j = bins.index(room)
            place(k + 1, [*bins[:j], room - pieces[k], *bins[j + 1 :]])
        place(k + 1, [*bins, capacity - pieces[k]])

    place(0, [])
    return best[0]


def test_packing_is_near_the_exact_minimum():
    rng = random.Random(7)
    over = 0
    for _ in range(40):
        pieces = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        got = sum(times for times, _ in packing.fewest_bins(collections.Counter(pieces), 20))
        assert got <= least_bins(pieces, 20) + 1
        over += got - least_bins(pieces, 20)
    assert over <= 2


def test_ranks_over_salted_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_GROUP", 3)
    docs = spark.createDataFrame([(k, "one two three") for k in range(100)], "doc_id long, text string")
    check_packing(packing.pack(docs).collect(), docs.collect())


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.score(docs, toxicity.learn(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert ((got.predicted == 1) & (got.toxic == 0)).sum() <= 2
    assert ((got.predicted == 1) & (got.toxic == 1)).sum() >= 0.7 * got.toxic.sum()
    assert got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0).all()


def test_machine_learns_a_pair_that_no_word_shows():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.choice(6, 2, replace=False).astype(np.uint32)) for _ in range(4000)]
    y = np.array([float({0, 1} <= set(r) or {2, 3} <= set(r)) for r in rows])
    m = toxicity.fit(rows, y, epochs=120)
    s = m.score([np.array([0, 1], np.uint32), np.array([2, 3], np.uint32), np.array([0, 2], np.uint32), np.array([1, 3], np.uint32)])
    assert min(s[:2]) > 0.5 > max(s[2:])


def test_the_machine_is_the_sum_over_all_pairs_and_its_gradient_is_right():
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(12, rng.integers(0, 7), replace=False)) for _ in range(9)]
    y, b, w, v = rng.integers(0, 2, 9).astype(float), 0.3, rng.normal(size=12), rng.normal(size=(12, 4))
    plain = [b + sum(w[i] for i in r) + sum(v[i] @ v[j] for k, i in enumerate(r) for j in r[:k]) for r in rows]
    assert np.allclose(toxicity._raw(b, w, v, rows)[0], plain)
    loss = lambda b, w, v: np.mean([np.log1p(np.exp(-z)) if t else np.log1p(np.exp(z)) for z, t in zip(toxicity._raw(b, w, v, rows)[0], y, strict=True)])
    d_b, at, d_w, d_v = toxicity.gradient(b, w, v, rows, y)
    step = 1e-6
    assert np.isclose(d_b, (loss(b + step, w, v) - loss(b - step, w, v)) / (2 * step), atol=1e-7)
    for k, i in enumerate(at):
        e = np.eye(12)[i] * step
        assert np.isclose(d_w[k], (loss(b, w + e, v) - loss(b, w - e, v)) / (2 * step), atol=1e-7)
        for f in range(4):
            e = np.zeros((12, 4))
            e[i, f] = step
            assert np.isclose(d_v[k, f], (loss(b, w, v + e) - loss(b, w, v - e)) / (2 * step), atol=1e-7)


def test_terms_that_tell_only_in_company_are_weighed(monkeypatch):
    monkeypatch.setattr(toxicity, "FEATURES", 40)
    monkeypatch.setattr(toxicity, "PAIRED", 60)
    rng = random.Random(8)
    noise, rows, y = [f"n{k}" for k in range(400)], [], []
    for _ in range(3000):
        insult, group = rng.random() < 0.3, rng.random() < 0.5
        toxic = insult and (group if rng.random() < 0.95 else not group)
        rows.append(toxicity.terms(" ".join(rng.sample(noise, 12) + ["grr"] * insult + ["zug"] * group)))
        y.append(float(toxic))
    zug = toxicity.terms("zug")[0]
    assert zug in toxicity.chosen_hashes(rows, np.array(y))
    m = toxicity.fit(rows, np.array(y))
    assert m.score([toxicity.terms("grr zug n1")])[0] > 0.5 > m.score([toxicity.terms("grr n1")])[0]


def test_a_label_that_repeats_teaches_a_bounded_number_of_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"bad word {k}") for k in range(300)] + [(2, "fine text")], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, y: seen.append(len(rows)) or toxicity.Machine(np.empty(0, dtype=np.uint32), 0.0, np.zeros(1), np.zeros((1, 8))))
    toxicity.learn(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"), sample=50)
    assert seen == [50]


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    m = toxicity.learn(odd, labels)
    got = toxicity.score(odd, m).toPandas()
    assert len(got) == odd.count() and got.score.between(0, 1).all() and not got[got.doc_id.isna()].held_out.any()
    assert toxicity.score(empty, m).count() == 0
    assert toxicity.reject(odd, m, 2.0).collect() == odd.collect()
    none = toxicity.learn(odd, labels.limit(0))
    assert set(toxicity.score(odd, none).toPandas().predicted) == {0}


def test_leaks_are_found_and_clean_documents_stay(spark, data):
    docs, items = documents(spark, data), spark.read.parquet(f"{data}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find(docs, items).collect()}
    texts, questions = docs.select("doc_id", "text").collect(), items.collect()
    held = {(d, i) for i, b in questions for d, t in texts if b in t}
    assert held <= got
    plain = lambda t: " ".join(re.findall(r"[^\W\d_]+", t.lower()))
    for d, i in got - held:
        assert plain(dict(questions)[i])[5:60] in plain(dict(texts)[d])
    kept = decontamination.clean(docs, decontamination.find(docs, items))
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({d for d, _ in got})


def test_other_numbers_and_names_are_caught(spark):
    item = "The train travels 60 km in 2 hours, how far does Alice go in 5 hours? Answer now please."
    texts = [(1, item), (2, "So: " + item.replace("60", "75").replace("2 h", "3 h").replace("Alice", "Bob")), (3, "then Bob has 4 cats and 4 dogs and so on it goes"), (4, "then Bob has 4 cats and 5 dogs and so on it goes"), (None, item), (5, None)]
    items = [(10, item), (11, "Alice has 3 cats and 3 dogs and so on it goes"), (12, None), (13, "too short"), (None, item)]
    got = decontamination.find(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["kind"]) for r in got) == [(1, 10, "copy"), (2, 10, "reparameterised"), (3, 11, "reparameterised")]


NAMES = "Alice Bob Carla Deniz Emre Fatma Gina Hugo Ines Jonas Kenan Lisa Maria Nils Olga Pedro Rosa Tom Ulla Viktor".split()
QUESTIONS = (
    "{0} has {4} red apples in the basket. {0} gives {5} of them to {1} on Monday. How many apples are left in the basket?",
    "{2} and {0} walk {4} km in {5} hours. {1} says: the road is {6} km long. How far must {0} still walk?",
    "A train leaves at {4} and {3} buys {5} tickets.\n{3} pays {6} euros for every ticket, then sells them. What does {3} pay in all?",
    '"{0}," said {1}, "you owe me {4} dollars for {5} kg of flour." How much does one kg cost if {0} pays half of it first?',
)


def renamed(rng, question):
    names = rng.sample(NAMES, 4)
    names[rng.randrange(4)] += " " + rng.choice(("Meyer", "Santos", "Yildiz"))  # a name of two words
    return question.format(*names, *(rng.randint(2, 999) for _ in range(3)))


def brute_templates(docs, items, width=5, share=0.8):
    """(doc_id, item_id): (coverage, kind) by trying every alignment; names by exact sets of ordinary words."""
    low = collections.Counter(w for _, t in items for w in regex.findall(r"(?<!\p{L})\p{Ll}+(?!\p{L})", t))
    high = collections.Counter(w.lower() for _, t in items for w in regex.findall(r"(?<=[\p{Ll}\p{N}][,;]? )\p{Lu}\p{Ll}\p{L}*", t))
    ordinary = {w for w, n in low.items() if n >= high[w]}
    units = set(decontamination.UNITS)

    def tokens_of(text, names=True):
        out, end = [], None
        for m in regex.finditer(r"[0-9]+(?:[.,][0-9]+)*|\p{L}+", text):
            w = m[0]
            if w[0].isdigit():
                kind, value = "§n", w
            elif out and out[-1][0] == "§n" and w.lower() in units and not text[end : m.start()].strip():
                kind, value = "§u", w.lower()
            elif names and regex.fullmatch(r"\p{Lu}\p{Ll}\p{L}*", w) and w.lower() not in ordinary:
                kind, value = "§p", w.lower()
                if out and out[-1][0] == "§p" and text[end : m.start()] == " ":
                    out[-1] = "§p", f"{out[-1][1]}_{value}"
                    end = m.end()
                    continue
            else:
                kind = value = w.lower()
            out.append((kind, value))
            end = m.end()
        return out

    best = {}
    for d, text in docs:
        doc = tokens_of(text)
        for i, t in items:
            for item in (tokens_of(t), tokens_of(t, False)):
                n = len(item) - width + 1
                for shift in range(-len(item), len(doc)) if n > 0 else ():
                    other = [doc[shift + k] if 0 <= shift + k < len(doc) else (None, None) for k in range(len(item))]
                    same = [a[0] == b[0] for a, b in zip(item, other, strict=True)]
                    got = sum(all(same[k : k + width]) for k in range(n)) / n
                    slots = {(a[0], a[1], b[1]) for a, b, s in zip(item, other, same, strict=True) if s and a[0].startswith("§")}
                    words = {x for x in slots if x[0] != "§n"}
                    if got >= share and len({x[1] for x in slots}) == len(slots) and len({x[2] for x in words}) == len(words):
                        kind = "copy" if all(x == y for _, x, y in slots) else "reparameterised"
                        best[d, i] = max(best.get((d, i), (0, -(10**9), "")), (got, -shift, kind))
    return {k: (round(c, 9), -shift, kind) for k, (c, shift, kind) in best.items()}


def test_renamed_questions_equal_brute_force(spark):
    rng = random.Random(4)
    items = [(k, renamed(rng, q)) for k, q in enumerate(QUESTIONS)]
    prose = lambda: " ".join(rng.choice("the of and with still some road apples pay".split()) for _ in range(12))
    docs = [(k, f"{prose()}. {renamed(rng, QUESTIONS[k % 4])} {prose()}") for k in range(120)]
    docs += [(200 + k, f"{prose()} {t} {prose()}") for k, t in items] + [(300 + k, t.lower()) for k, t in items] + [(400, prose()), (401, items[0][1].replace("red apples", "green stones"))]
    got = {(r["doc_id"], r["item_id"]): (round(r["coverage"], 9), r["position"], r["kind"]) for r in decontamination.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_templates(docs, items)
    assert got == want
    assert sum((k, k % 4) in got for k in range(120)) >= 0.9 * 120
    assert all(got[200 + k, k][2] == "copy" and (300 + k, k) in got for k in range(4))


def test_short_items_are_found_at_every_offset(spark):
    items = [(n, " ".join(f"{c * 3}{'xyz'[n - 5]}" for c in "abcdefg"[:n])) for n in (5, 6, 7)]
    texts = [(10 * k + n, "pad " * k + item + " tail of it") for n, item in items for k in range(9)]
    got = decontamination.find(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["position"]) for r in got) == sorted((d, d % 10, d // 10) for d, _ in texts)


def test_leaks_in_odd_tables(spark, odd, empty):
    items = spark.createDataFrame([(1, "The cat sat on the mat today"), (2, "")], "item_id long, text string")
    assert {r["doc_id"] for r in decontamination.find(odd, items).collect()} == {1, 11}
    assert decontamination.find(empty, items).count() == 0
    assert decontamination.find(odd, items.limit(0)).count() == 0


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute_components(rows, width):
    sets = [(d, shingle_set(t, width)) for d, t in rows]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 5 * len(x & y) >= 4 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(s), find(d)) for d, s in sets}


def test_near_duplicates_equal_brute_force(spark, data):
    docs = documents(spark, data)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.find(docs, neardup.Similarity(2, 80)).collect()}
    assert got == brute_components(docs.select("doc_id", "text").collect(), 2)


@pytest.mark.parametrize("block", [512, 20])
def test_a_large_group_of_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "GROUP_BLOCK", block)
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for d in range(220):
        own = list(base)
        for k in rng.sample(range(120), 7):
            own[k] = f"e{rng.randrange(10**6)}"
        rows.append((d, " ".join(own)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.find(spark.createDataFrame(rows, "doc_id long, text string"), neardup.Similarity(2, 80)).collect()}
    assert got == brute_components(rows, 2)


def test_near_duplicates_of_odd_rows(spark, odd, empty):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.find(odd, neardup.Similarity(2, 80)).collect())
    by = {x[1]: x[3] for x in got if not x[0]}
    assert len(got) == 14 and by[11] == 1 and by[5] == 4 and by[8] == 7 and by[3] == 3 and by[6] == 6
    assert all(x[4] and x[3] is None for x in got if x[0])
    assert neardup.find(empty, neardup.Similarity(2, 80)).count() == 0
    left = neardup.keep_one(odd, neardup.Similarity(2, 80))
    assert left.columns == odd.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 0, 1, 2, 3, 4, 6, 7, 9, 10]


def test_a_doc_id_with_two_texts_loses_only_the_copy(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text, "a"), (5, text, "b"), (5, "a text of its own that stands nowhere else at all", "c"), (5, "a text of its own that stands nowhere else at all", "d"), (None, text, "e"), (7, None, "f")]
    left = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, ck string"), neardup.Similarity(5, 80)).collect()
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:6]) for r in left) == [(0, "w0 w1 "), (1, "w0 w1 "), (5, "a text"), (7, "")]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(0, k) for k in range(1000, 1100)] + [(5000 + k, 5001 + k) for k in range(40)] + [(None, 1), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = collections.defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for n in sorted(near):
        todo = [n] if n not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = n
                todo += near[x]
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_urls_and_aliases(spark):
    rows = [(1, "http://a.com/de/1", "<link href='http://b.net/x' rel='canonical'>"), (2, "https://b.net/x#f", None), (3, "http://c.net/", "<meta http-equiv=refresh content='0; url=//b.net/x'>"), (4, None, None), (5, "nourl", ""), (6, "http://X.ORG/q", "<link rel=canonical href=http://b.net/x>"), (7, "http://d.net/", ""), (8, "http://e.net/a/b?q", "<link rel=canonical href=../a>"), (9, "http://sub.example.org/en/12", ""), (10, "http://example.org", ""), (7, "http://d.net/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, RULES).collect()}
    assert got[1][2:] == ("com/de/", "block") and got[2][2:] == (None, "block") and got[3][3] == "block"
    assert got[6] == ("x.org", "/q", "org/", "allow") and got[7][3] == "allow" and got[4] == ("", "", None, "allow") and got[5][0] == ""
    assert got[9][2] == "example.org/en/1" and got[10][2:] == (None, "allow")
    moved = urls.judge(pages, RULES, spark.createDataFrame([("http://d.net/", "http://q.com/de/")], "url string, target string"))
    assert moved.where("page_id = 7").select("verdict").distinct().first()[0] == "block" and moved.count() == 11
    assert urls.judge(pages.limit(0), RULES).count() == 0


def brute_removal(texts, length=400):
    seen = collections.Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, dtype=np.uint8)[~gone].tobytes()).hexdigest()))
    return collections.Counter(out)


def digests(docs):
    return collections.Counter((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.digests(docs).collect())


def test_removal_equals_brute_force(spark, data):
    docs = documents(spark, data)
    assert digests(docs) == brute_removal([t.encode() for t, in docs.select("text").collect()])


def test_removal_with_a_hot_passage(spark, monkeypatch):
    rng = np.random.default_rng(0)
    letters = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    base = letters(900)
    texts = [letters(300) + base[: 500 + k % 400] + letters(200) + "é" * 3 for k in range(200)] + [None, "", base, "x" * 2000, "ab" * 700, base]
    find = suffixes.find
    monkeypatch.setattr(suffixes, "find", lambda docs, length=400, words=None: find(docs, length, shard=20000, often=40))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert digests(df) == brute_removal([(t or "").encode() for t in texts])


def test_suffix_arrays_and_common_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(20):
        pieces = [bytes(rng.integers(97, 99, rng.integers(1, 40)).astype(np.uint8)) for _ in range(6)]
        pieces += pieces[:2]
        size = np.array([*map(len, pieces)])
        first = np.cumsum(size) - size
        symbols = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        ends = np.repeat(first + size, size)
        sa, rank = suffixes.suffix_array(symbols, ends)
        order = sorted((bytes(symbols[k : ends[k]]), k) for k in range(len(symbols)))
        assert sa.tolist() == [k for _, k in order] and (sa[rank] == np.arange(len(sa))).all()
        shared = suffixes.common_prefixes(symbols, first, size, sa, rank)
        for k in range(1, len(order)):
            a, b = order[k - 1][0], order[k][0]
            assert shared[k] == next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_removal_from_odd_rows(spark, odd, empty):
    got = suffixes.digests(odd).toPandas()
    assert len(got) == 14 and got[got.doc_id == 2].n_bytes.tolist() == [0] and (got[got.doc_id == 4].n_removed > 0).all()
    assert suffixes.digests(empty).count() == 0
    left = suffixes.remove(odd)
    assert left.columns == odd.columns and left.count() == 14


def brute_words(texts, length):
    """What is left of each text without the repeated strings of so many words."""
    split = [list(re.finditer(rb"\S+", t)) for t in texts]
    seen = collections.Counter(tuple(m[0] for m in w[k : k + length]) for w in split for k in range(len(w) - length + 1))
    out = []
    for t, w in zip(texts, split, strict=True):
        gone = np.zeros(len(t), dtype=bool)
        for k in range(len(w) - length + 1):
            if seen[tuple(m[0] for m in w[k : k + length])] > 1:
                gone[w[k].start() : w[k + length].start() if k + length < len(w) else len(t)] = True
        out.append(np.frombuffer(t, dtype=np.uint8)[~gone].tobytes().decode())
    return out


def test_passages_by_words_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    prose = lambda n: " ".join(bytes(rng.integers(97, 123, rng.integers(1, 4)).astype(np.uint8)).decode() for _ in range(n))
    shared, near = prose(51), prose(50)
    spaced = prose(70)
    texts = [f"{prose(40)} {shared} {prose(40)}", f"{prose(20)} {shared}", f"{prose(30)} {near} {prose(9)}", f"{near} {prose(30)}", f"{prose(9)} {spaced} é", spaced.replace(" ", "\n ", 30), None, "", "a b " * 60, shared[:-1] + "é " + prose(60)]
    long = prose(120).split(" ")
    texts += [" ".join([prose(9), *long[k % 40 : 60 + k % 60], prose(8)]) for k in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_words([(t or "").encode() for t in texts], 51)
    find = suffixes.find
    for small in ({}, {"shard": 500, "often": 10}):
        monkeypatch.setattr(suffixes, "find", lambda docs, length, words=None, small=small: find(docs, length, words=words, **small))
        got = {r["doc_id"]: r["text"] or "" for r in suffixes.remove(df, length=2000, words=51).collect()}
        assert [got[k] for k in range(len(texts))] == want
    monkeypatch.undo()
    both = {r["doc_id"]: r for r in suffixes.digests(df, words=51).collect()}
    only = brute_removal([(t or "").encode() for t in texts])
    assert collections.Counter((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in both.values()) == only
    assert both[0]["text"] == texts[0].replace(shared + " ", "") and both[0]["n_removed"] == 0 and both[6]["text"] is None


def test_texts_that_share_64_bits_of_a_hash_are_not_copies(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "mix", lambda x: x & np.uint64(3))
    texts = ["a" + "b" * k + "c" * (500 - k) + f"{k:03d}" * 70 for k in range(40, 60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert digests(df) == brute_removal([t.encode() for t in texts])


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.judge(docs, quality.learn(docs, labels), F.col("source"), F.col("lang")).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).toPandas()
    assert (got.kept == (got.quality == 1)).mean() > 0.98


def test_posteriors_by_hand(spark):
    rng = random.Random(6)
    sizes = {("a", "x"): 40, ("a", "y"): 3, ("b", "x"): 25, ("b", "y"): 9, ("c", "x"): 1}
    rows = [(site, path, " ".join(rng.choice(("good words here", "!!! @@ %% ||")) for _ in range(rng.randint(1, 9)))) for (site, path), n in sizes.items() for _ in range(n)]
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, site string, path string, text string")
    x = np.array([quality.statistics(t) for *_, t in rows])
    c = quality.fit(x, np.array([float("good" in t) for *_, t in rows]))
    p = c.probability(x)
    at = lambda *key: [k for k, r in enumerate(rows) if r[: len(key)] == key]
    mean = p.mean()

    def strength(groups):  # (members, prior mean)
        n = np.array([len(g) for g, _ in groups], dtype=float)
        m, prior = np.array([p[g].mean() for g, _ in groups]), np.array([q for _, q in groups])
        spread = (n * prior * (1 - prior)).sum() / n.sum()
        variance = max(((n * (m - prior) ** 2).sum() - (len(n) - 1) * spread) / max(n.sum() - (n**2).sum() / n.sum(), 1.0), spread * 1e-4)
        return min(max(spread / variance - 1, 1.0), 1e4)

    sites = {s: at(s) for s in "abc"}
    k_site = strength([(g, mean) for g in sites.values()])
    prior = {s: (p[g].sum() + k_site * mean) / (len(g) + k_site) for s, g in sites.items()}
    k_path = strength([(at(*key), prior[key[0]]) for key in sizes])
    logit = lambda q: np.log(np.clip(q, 1e-4, 1 - 1e-4) / (1 - np.clip(q, 1e-4, 1 - 1e-4)))
    want = []
    for k, (site, path, _) in enumerate(rows):
        g, h = sites[site], at(site, path)
        own_site = (p[g].sum() - p[k] + k_site * mean) / (len(g) - 1 + k_site)
        own_path = (p[h].sum() - p[k] + k_path * own_site) / (len(h) - 1 + k_path)
        want.append((p[k], own_site, own_path, 1 / (1 + np.exp(-(logit(p[k]) + logit(own_path) - logit(mean))))))
    got = quality.judge(docs, c, F.col("site"), F.col("path")).orderBy("doc_id").toPandas()
    assert np.allclose(got[["text_score", "site_score", "path_score", "score"]].to_numpy(), want)
    assert got.text_score.std() > 0.2
    near = abs(got.path_score - mean).groupby([got.site, got.path]).mean()
    assert near["c", "x"] < abs(p[at("c", "x")] - mean).mean()  # one document alone moves its prior little


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1)], "doc_id long, quality int")
    c = quality.learn(odd, labels)
    got = quality.judge(odd, c, F.col("source"), F.col("lang")).toPandas()
    assert len(got) == 14 and got.score.between(0, 1).all()
    assert quality.judge(empty, c, F.col("source"), F.col("lang")).count() == 0


def test_store_round_trip(spark, data, odd, empty, tmp_path):
    for docs in (documents(spark, data), odd, empty):
        path = f"file://{tmp_path}/{docs.count()}"
        huffman.write(docs, path)
        got = sorted(huffman.read(spark, path).collect(), key=lambda r: r["start"])
        rows = docs.select("doc_id", "text").collect()
        assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in got) == collections.Counter((d, tuple(map(int, ids_of(t, 0)))) for d, t in rows)
        assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
        order = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
        assert order == sorted(order)
        assert sorted(r["ids_crc32"] for r in huffman.read(spark, path, digest=True).collect()) == sorted(zlib.crc32(ids_of(t, 0).tobytes()) for _, t in rows)


def test_a_doc_id_of_many_rows_fills_several_ranges(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(huffman, "RANGE_TOKENS", 100)
    monkeypatch.setattr(huffman, "MOST_RANGES", 9)
    docs = spark.createDataFrame([(k % 7 if k % 2 else 3, f"text number {k} of many") for k in range(200)], "doc_id long, text string").repartition(6)
    huffman.write(docs, f"file://{tmp_path}/store")
    got = sorted(huffman.read(spark, f"file://{tmp_path}/store").collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted(r["doc_id"] for r in got)
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    assert collections.Counter(tuple(r["ids"]) for r in got) == collections.Counter(tuple(map(int, ids_of(t, 0))) for _, t in docs.collect())
    shards = spark.read.parquet(f"{tmp_path}/store/blocks").where("doc_id = 3").select("shard").distinct().count()
    assert 3 <= shards <= 9


@pytest.mark.parametrize("seed", range(5))
def test_code_lengths_are_optimal_and_limited(seed):
    rng = np.random.default_rng(seed)
    counts = {k: int(c) for k, c in enumerate(rng.zipf(1.3, 60)) if c}
    lengths = huffman.code_lengths(counts, 8)
    assert max(lengths.values()) <= 8 and sum(2.0**-b for b in lengths.values()) == 1
    free = huffman.code_lengths(counts, 40)
    heap = sorted(counts.values())
    cost = 0
    while len(heap) > 1:
        a = heap.pop(0) + heap.pop(0)
        cost += a
        heap = sorted([*heap, a])
    assert sum(counts[s] * b for s, b in free.items()) == cost <= sum(counts[s] * b for s, b in lengths.items())


def test_blocks_decode_alone():
    rng = np.random.default_rng(9)
    ids = [rng.integers(0, 50, n) for n in (0, 1, 255, 256, 257, 5000)]
    lengths = huffman.code_lengths({k: k + 1 for k in range(50)}, 7)
    payloads, marks = huffman.encode_blocks(ids, *huffman.canonical(lengths))
    table = huffman.decode_table(lengths)
    for x, p, m in zip(ids, payloads, marks, strict=True):
        assert huffman.decode_blocks([p], [m], np.array([len(x)]), table)[0].tolist() == x.tolist()


def brute_top(rows, queries, k=5):
    good = [(i, [int(np.floor(256 * float(x))) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = set()
    for q, a in {(i, tuple(e)) for i, e in good if i in queries}:
        best = sorted((-sum(x * y for x, y in zip(a, e, strict=True)), i) for i, e in good if i != q and len(e) == len(a))[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def test_top_k_equals_brute_force(spark, data):
    v = spark.read.parquet(f"{data}/embeddings.parquet")
    got = {tuple(r) for r in topk.search(v, v.where("vec_id % 50 = 0")).collect()}
    assert got == brute_top(v.select("vec_id", "embedding").collect(), {i for i, in v.select("vec_id").collect() if i % 50 == 0})


def test_top_k_in_blocks_of_queries_and_repeated_rows(spark, monkeypatch):
    for name, small in (("QUERY_BLOCK", 3), ("CELLS", 40), ("PAIRS", 7)):
        monkeypatch.setattr(topk, name, small)
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=9).round(1).tolist()) for k in range(400)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in topk.search(v, v.where("vec_id % 50 = 0")).collect()}
    assert got == brute_top(rows, {k for k in range(400) if k % 50 == 0})
    twice = [*rows[:60], *rows[10:20]]
    found = topk.search(spark.createDataFrame(twice, "vec_id long, embedding array<double>"), v.where("vec_id = 0"), k=8).orderBy("rank").collect()
    q = np.floor(256 * np.array(rows[0][1]))
    want = sorted(((-int(np.floor(256 * np.array(e)) @ q), i) for i, e in twice if i), key=lambda x: x)[:8]
    assert [(-r["score"], r["vec_id"]) for r in found] == want


def test_top_k_of_odd_rows(spark):
    rows = [(0, [1.0, -1.0]), (1, [1.0, -1.0]), (2, [1.0, -1.0]), (3, [0.5, 0.5]), (4, None), (5, [1.0, None]), (6, [float("nan"), 0.0]), (7, [float("inf"), 0.0]), (None, [1.0, 1.0]), (8, [1.0]), (9, [-3.0, -3.0]), (50, [-1.0, -1.0]), (100, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = {tuple(r) for r in topk.search(v, v.where("vec_id % 50 = 0"), k=3).collect()}
    assert got == brute_top(rows, {0, 50}, 3)
    assert topk.search(v.limit(0), v.limit(0)).count() == 0
    big = [(k, [10.0**12 * (k + 1), -(10.0**12)]) for k in range(4)]
    b = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    # Scores beyond a long saturate, so these are ties.
    assert [(r["vec_id"], r["score"]) for r in topk.search(b, b.where("vec_id = 0"), k=2).orderBy("rank").collect()] == [(1, 2**63 - 1), (2, 2**63 - 1)]


def test_shared_folder_must_be_named_on_a_cluster():
    class Far:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Far)
