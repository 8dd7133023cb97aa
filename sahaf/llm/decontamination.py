"""Benchmark decontamination by templates, in DataFrame functions only.

Numbers, names and units of a text become typed placeholders, so a question with other numbers or names keeps its
template.  Every window of `width` tokens of the benchmark's templates is joined by hash with every `stride`-th window
of the documents; what these hits leave possible is compared token by token, and a match counts if the slots are
consistent: one value of the item always stands for one value of the document.

A capitalised word is a name, wherever it stands, unless the benchmark uses it as an ordinary word; neighbouring names
are one placeholder.  Ordinary words are kept as a bitmap of at most 8 MB, which says of a few names in a hundred that
they are ordinary and of an ordinary word never that it is a name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH, STRIDE, COVERAGE = 5, 1, 0.8
#: Units that become a placeholder after a number.
UNITS = "km kg m cm mm mi ft lb lbs oz g mg l ml s ms min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years dollar dollars euro euros cent cents percent mile miles meter meters metre metres gram grams liter liters litre litres degree degrees usd eur gbp try tl mph kmh kwh mb gb".split()
CAPITALISED = r"\p{Lu}\p{Ll}\p{L}*"
INSIDE = r"(?<=[\p{Ll}\p{N}][,;]? )" + CAPITALISED
ORDINARY = r"(?<!\p{L})\p{Ll}+(?!\p{L})"
NUMBER = r"[0-9]+(?:[.,][0-9]+)*"
#: Bits of the bitmap for each word, and at the least and most.
BITS_PER_WORD, BITS = 64, (1 << 16, 1 << 26)


def ordinary_words(texts: DataFrame) -> bytes:
    """The bitmap of the words of `texts` that are written small as often as in capitals inside sentences."""
    small = texts.select(F.lit(1).alias("n"), F.explode(F.regexp_extract_all("text", F.lit(ORDINARY), F.lit(0))).alias("w"))
    large = texts.select(F.lit(-1).alias("n"), F.explode(F.transform(F.regexp_extract_all("text", F.lit(INSIDE), F.lit(0)), F.lower)).alias("w"))
    words = common.materialize(small.unionByName(large).groupBy("w").agg(F.sum("n").alias("n"), F.max("n").alias("small")).where("n >= 0 and small = 1").select("w"), "ordinary")
    bits = min(max(BITS[0], 1 << (words.count() * BITS_PER_WORD).bit_length()), BITS[1])
    capital = F.concat(F.upper(F.substring("w", 1, 1)), F.substr("w", F.lit(2)))  # as it begins a sentence
    longs = words.select(F.pmod(F.xxhash64(capital), F.lit(bits)).alias("at")).select(F.floor(F.col("at") / 64).alias("k"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bits"))
    every = longs.unionByName(texts.sparkSession.range(bits // 64).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("bits")))
    row = every.groupBy("k").agg(F.bit_or("bits").alias("bits")).agg(F.array_sort(F.collect_list(F.struct("k", "bits"))).alias("b"))
    return bytes(row.select(F.unhex(F.array_join(F.transform("b", lambda x: F.lpad(F.hex(x["bits"]), 16, "0")), "")).alias("b")).first()["b"])  # at most 8 MB


def marked(texts: DataFrame, ordinary: bytes | None) -> DataFrame:
    """texts with m in place of text: in lower case, names as §name¤, numbers as №12 and units as ¢km; without a bitmap no names.

    Each step is a column of its own, so that none is evaluated more than once.
    """
    rest = [c for c in texts.columns if c != "text"]
    t = F.translate("text", "§¤№¢", "    ")
    if ordinary is None:
        steps = texts.select(*rest, F.lower(t).alias("t"))
    else:

        def name(word: Column, at: Column) -> Column:
            byte = F.substr(F.lit(ordinary), (F.floor(at / 64) * 8 + 8 - F.floor(at % 64 / 8)).cast("int"), F.lit(1))
            known = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (at % 8).cast("int")) == 1
            return F.when((word != "") & ~known, F.concat(F.lit("§"), word, F.lit("¤"))).otherwise("")

        steps = texts.select(*rest, F.split(t, r"(?=\p{Lu}\p{Ll})(?<!\p{L})", -1).alias("parts"))
        steps = steps.select(*rest, "parts", F.transform("parts", lambda p: F.regexp_extract(p, "^" + CAPITALISED, 0)).alias("words"))
        steps = steps.select(*rest, "parts", F.zip_with("words", F.transform("words", lambda w: F.pmod(F.xxhash64(w), F.lit(8 * len(ordinary)))), name).alias("names"))
        told = F.zip_with("parts", "names", lambda p, n: F.when(n != "", F.concat(n, F.substr(p, F.length(n) - 1))).otherwise(p))
        steps = steps.select(*rest, F.lower(F.replace(F.array_join(told, ""), F.lit("¤ §"), F.lit("_"))).alias("t"))
    numbers = F.regexp_replace(F.regexp_replace("t", NUMBER, " №$0 "), r"(№\S+)\s+(" + "|".join(UNITS) + r")(?!\p{L})", "$1 ¢$2")
    return steps.select(*rest, F.when(F.col("t").rlike("[0-9]"), numbers).otherwise(F.col("t")).alias("m"))


def surface(marked: Column) -> Column:
    """The tokens of a marked text with the values of its slots."""
    return F.regexp_extract_all(marked, F.lit(r"§[^¤]+¤|№[0-9.,]+|¢\p{L}+|\p{L}+"), F.lit(0))


def with_template(marked: DataFrame, name: str) -> DataFrame:
    """marked() texts with the same tokens under a name, names, numbers and units as §p, §n and §u."""
    slots = F.regexp_replace(F.regexp_replace("t", r"№[0-9.,]+", "§n"), r"¢\p{L}+", "§u")
    steps = marked.select("*", F.regexp_replace("m", "§[^¤]+¤", "§p").alias("t")).select(*marked.columns, F.when(F.col("t").contains("№"), slots).otherwise(F.col("t")).alias("t"))
    return steps.select(*marked.columns, F.regexp_extract_all("t", F.lit(r"§[pnu]|\p{L}+"), F.lit(0)).alias(name))


def _windows(df: DataFrame, tokens: str, width: int, stride: int) -> DataFrame:
    """df's columns but tokens, with pos and hash of every stride-th window; no rows where there are fewer tokens than width."""
    rest = [c for c in df.columns if c != tokens]
    hashed = df.select(*rest, F.transform(tokens, lambda x: F.xxhash64(x)).alias("h"))
    one = lambda i: F.struct(i.alias("pos"), F.xxhash64(*(F.get(F.col("h"), i + k) for k in range(width))).alias("hash"))
    starts = F.when(F.size("h") >= width, F.sequence(F.lit(0), F.size("h") - width, F.lit(stride)))  # no filter, which would evaluate all steps once more
    return hashed.select(*rest, F.inline(F.transform(starts, one)))


def find(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, stride: int = STRIDE, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, coverage, position, kind, n_slots: one row per document and item of benchmark that it holds.

    coverage is the share of the item's windows of `width` template tokens that stand in the document in the same
    alignment, at least `coverage`; position is the document's token where the item begins.  kind is "copy" if all
    slots have the item's values, else "reparameterised"; an alignment whose slots are inconsistent is no match: a
    value of the item must always have one value in the document, and different names and units different ones
    (different numbers may become equal).  Items are also looked for without names, as copies in lower case have them.
    Of several alignments the one with the highest coverage counts, then the first.  Items with fewer tokens than
    `width`, null texts, and rows without doc_id or item_id match nothing; rows of one id count as one document.
    """
    common.free_shuffles(docs.sparkSession)
    given = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("item_id is not null")
    ordinary = ordinary_words(given)
    variants = [marked(given.select("item_id", F.lit(k).alias("variant"), "text"), o) for k, o in enumerate((ordinary, None))]
    items = with_template(variants[0].unionByName(variants[1]), "item").select("item_id", "variant", "item", surface(F.col("m")).alias("item_words"))
    items = common.materialize(items.where(F.size("item") >= width).dropDuplicates(["item_id", "item", "item_words"]), "items")
    item_windows = _windows(items.select("item_id", "variant", (F.size("item") - width + 1).alias("windows"), "item"), "item", width, 1).withColumnRenamed("pos", "item_pos")
    item_windows = common.materialize(item_windows, "item-windows")
    texts = common.texts_of(docs).where("doc_id is not null and text is not null")
    doc_windows = _windows(with_template(marked(texts, ordinary), "tokens").select("doc_id", "tokens"), "tokens", width, stride)
    hits = doc_windows.join(common.sized(item_windows), "hash").groupBy("doc_id", "item_id", "variant", (F.col("pos") - F.col("item_pos")).alias("shift"), "windows").count()
    # Unmatched windows come in runs of `width` inside an item, so a match of that coverage leaves at least this many hits.
    # Beyond stride 1 an item of fewer than stride + width - 1 tokens can lie between the windows that are looked up.
    lost = 1 - coverage
    least = F.floor((coverage * F.col("windows") - (stride - 1) * (lost * F.col("windows") / width + 1)) / stride)
    candidates = common.materialize(hits.where(F.col("count") >= F.greatest(least, F.lit(1))).select("doc_id", "item_id", "variant", "shift"), "candidates")
    wanted = common.materialize(candidates.select("doc_id").distinct(), "wanted")
    held = with_template(marked(texts.join(common.sized(wanted), "doc_id", "left_semi"), ordinary), "doc").select("doc_id", "doc", surface(F.col("m")).alias("doc_words"))
    both = candidates.join(held, "doc_id").join(items, ["item_id", "variant"])
    at = F.sequence(F.lit(0), F.size("item") - 1)
    aligned = both.select("doc_id", "item_id", "shift", "item", "item_words", F.transform(at, lambda j: F.get(F.col("doc"), j + F.col("shift"))).alias("doc"), F.transform(at, lambda j: F.get(F.col("doc_words"), j + F.col("shift"))).alias("doc_words"))
    same = F.array_join(F.zip_with("item", "doc", lambda a, b: F.when(a == b, "1").otherwise("0")), "")
    found = F.aggregate(F.split("same", "0"), F.lit(0), lambda n, run: n + F.greatest(F.length(run) - (width - 1), F.lit(0)))
    slots = F.filter(F.transform(F.sequence(F.lit(0), F.size("item") - 1), lambda j: F.struct(F.get(F.col("item"), j).alias("kind"), F.get(F.col("item_words"), j).alias("item"), F.get(F.col("doc_words"), j).alias("doc"), (F.substring("same", j + 1, F.lit(1)) == "1").alias("same"))), lambda x: x["same"] & x["kind"].startswith("§"))
    judged = aligned.withColumn("same", same).withColumn("slots", slots).withColumn("coverage", found / (F.size("item") - width + 1)).where(F.col("coverage") >= coverage)
    distinct = lambda slots, *keys: F.size(F.array_distinct(F.transform(slots, lambda x: F.struct(*(x[k].alias(k) for k in keys)))))
    words = F.filter("slots", lambda x: x["kind"] != "§n")
    consistent = (distinct("slots", "item", "doc") == distinct("slots", "item")) & (distinct(words, "item", "doc") == distinct(words, "doc"))
    copy = F.forall("slots", lambda x: x["item"].eqNullSafe(x["doc"]))
    good = judged.where(consistent).select("doc_id", "item_id", "coverage", F.col("shift").alias("position"), F.when(copy, "copy").otherwise("reparameterised").alias("kind"), F.size("slots").alias("n_slots"))
    best = good.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("coverage", "position", "kind", "n_slots"), F.struct("coverage", -F.col("position"), "kind")).alias("m"))
    return best.select("doc_id", "item_id", "m.coverage", "m.position", "m.kind", "m.n_slots")


def clean(docs: DataFrame, matches: DataFrame) -> DataFrame:
    """The rows of docs without a match; rows without doc_id stay."""
    ids = common.materialize(matches.select("doc_id").distinct(), "leaks")
    return docs.join(common.sized(ids), "doc_id", "left_anti").select(*docs.columns)
