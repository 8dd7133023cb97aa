"""Quality by hierarchical empirical Bayes: what a document's text says, joined with what its site and path are like.

A logistic classifier on statistics and hashed words of the whole text gives each document a probability of being good.  Grouped sums
of those give every site a posterior mean that is shrunk toward the global mean, and every path of a site one that is
shrunk toward its site's; how strongly, the spread of the groups themselves says.  The document's own evidence is
taken out of its groups before they are used on it.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from math import sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .toxicity import held_out

#: Labelled rows that the classifier is fitted on at most, taken in the order of a hash of doc_id.
SAMPLE = 20_000
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
HIGH = bytes(range(128, 256))
CLASSES = (bytes(range(65, 91)), LETTERS + HIGH, b"0123456789", b".,;:'\"-()?", b"!", b"|", b"%#$&*@~^", b"\n", b"<>{}[]\\/=_+")
MARGIN = 1e-4
#: Hashed words whose shares are evidence, and how much more weight on them costs than on the other statistics.
WORDS, WORD_DECAY = 256, 100.0


def statistics(text: str | None) -> list[float]:
    """Shares of character classes, of repetition and of hashed words in a whole text; all finite, also without text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, m = max(len(raw), 1), max(len(words), 1)
    seen = Counter(words)
    top = seen.most_common(1)[0][1] if seen else 0
    lines = raw.split(b"\n")
    shares = [(len(raw) - len(raw.translate(None, c))) / n for c in CLASSES]
    follow = sum(a == b for a, b in zip(words, words[1:], strict=False))
    hashed = [0.0] * WORDS
    for word, times in seen.items():
        hashed[zlib.crc32(word.lower()) % WORDS] += times
    said = [sqrt(x / m) for x in hashed]
    return [np.log1p(len(raw)), np.log1p(len(words)), len(raw) / m / 10, len(seen) / m, top / m, follow / m, len(set(lines)) / len(lines), float(not words), *shares, *(sqrt(x) for x in shares), *said]


class Classifier(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    bias: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w + self.bias, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, decay: float = 1e-3, steps: int = 30) -> Classifier:
    """Logistic regression by Newton steps; with one class only, its share."""
    if not len(y) or y.min() == y.max():
        p = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        k = len(statistics(None))
        return Classifier(np.zeros(k), np.ones(k), np.zeros(k), float(np.log(p / (1 - p))))
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(y), 1))])
    w = np.zeros(z.shape[1])
    dear = np.ones(len(w))
    dear[-1 - WORDS : -1] = WORD_DECAY  # the last statistics; behind them is the bias
    ridge = decay * len(y) * np.diag(dear)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Classifier(mean, scale, w[:-1], float(w[-1]))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Fit on labels (doc_id, quality) that are not held out (as for toxicity)."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([statistics(t) for t in b.column(2).to_pylist()], type=pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    taught = common.texts_of(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")  # at most `sample` rows are broadcast
    got = common.map_arrow(taught, extract, "doc_id long, quality int, x array<double>").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "x").limit(sample).toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending")])  # at most `sample` rows, however often a doc_id repeats
    flat = got.column("x").combine_chunks().flatten().to_numpy() if got.num_rows else np.empty(0)
    x, y = flat.reshape(got.num_rows, -1) if got.num_rows else np.empty((0, len(statistics(None)))), np.array(got.column("quality").to_pylist(), dtype=float)
    del got, flat
    classifier = fit(x, y)
    del x, y
    common.release_memory()  # the driver lives on
    return classifier


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(MARGIN)), F.lit(1 - MARGIN))
    return F.log(p / (1 - p))


def strength(groups: DataFrame, mean: str) -> float:
    """By moments, how many documents the prior counts as: groups has n, m (sum of probabilities) and each one's prior mean."""
    r = groups.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") ** 2).alias("n2"), F.sum(F.col("n") * (F.col("m") / F.col("n") - F.col(mean)) ** 2).alias("between"), F.sum(F.col("n") * F.col(mean) * (1 - F.col(mean))).alias("within")).first()
    if not r["k"] or r["k"] < 2 or not r["within"]:
        return 100.0
    spread = r["within"] / r["n"]
    effective = r["n"] - r["n2"] / r["n"]
    variance = max((r["between"] - (r["k"] - 1) * spread) / max(effective, 1.0), spread * 1e-4)
    return float(min(max(spread / variance - 1, 1.0), 1e4))


def judge(docs: DataFrame, classifier: Classifier, site: Column, path: Column) -> DataFrame:
    """doc_id, site, path, text_score, site_score, path_score, score, kept (score >= 0.5) for every row.

    A null site or path is the group of its own that has none; rows without doc_id are judged all the same; repeated
    rows each count.  A null text has the statistics of an empty one.  An empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in b.column(3).to_pylist()], dtype=float)
            p = sent.value.probability(x) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(p)], names=["doc_id", "site", "path", "p"])

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(site.cast("string"), F.lit("")).alias("site"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col("text").cast("string").alias("text"))
    scored = common.materialize(common.map_arrow(known, run, "doc_id long, site string, path string, p double"), "quality")
    paths = scored.groupBy("site", "path").agg(F.count("*").alias("n"), F.sum("p").alias("m"))
    sites = paths.groupBy("site").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    whole = sites.agg(F.sum("n").alias("n"), F.sum("m").alias("m")).first()
    mean = whole["m"] / whole["n"] if whole["n"] else 0.5
    k_site = strength(sites.withColumn("prior", F.lit(mean)), "prior")
    posterior = sites.select("site", F.col("n").alias("site_n"), F.col("m").alias("site_m"), ((F.col("m") + k_site * mean) / (F.col("n") + k_site)).alias("site_score"))
    placed = paths.join(posterior, "site")
    k_path = strength(placed, "site_score")
    joined = scored.join(placed, ["site", "path"])
    own_site = (F.col("site_m") - F.col("p") + k_site * mean) / (F.col("site_n") - 1 + k_site)
    own_path = (F.col("m") - F.col("p") + k_path * own_site) / (F.col("n") - 1 + k_path)
    z = _logit(F.col("p")) + _logit(own_path) - _logit(F.lit(mean))
    out = joined.select("doc_id", "site", "path", F.col("p").alias("text_score"), own_site.alias("site_score"), own_path.alias("path_score"), (1 / (1 + F.exp(-z))).alias("score"))
    return out.withColumn("kept", F.col("score") >= 0.5)
