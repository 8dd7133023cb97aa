"""Toxicity by a factorization machine over hashed terms.

A document's features are the distinct 32-bit hashes of its words and of their beginnings (stems take many endings).  The machine adds to a linear score the inner products of
learned factors of all pairs of features that occur together, so that a pair can weigh more than its two words do.
It is fitted on the driver from a bounded sample of labelled rows; scoring is one pass over the whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Lengths of the beginnings that are terms too.
STEMS = (4, 5, 6)
#: Labelled rows that the machine is fitted on at most, taken in the order of a hash of doc_id.
SAMPLE = 10_000
#: Hashes that have a weight and factors, all of at least MIN_ROWS sample rows: those whose presence alone tells most
#: about the label, and PAIRED more that tell most in company, among the rows with one of the LEADS leading ones.
FEATURES, PAIRED, LEADS, MIN_ROWS = 4096, 256, 64, 5
RANK, EPOCHS, BATCH = 8, 25, 256
#: Decay of weights and factors; rates of bias, weights and factors.
DECAY, RATES = (1e-5, 1e-3), (0.1, 0.5, 0.05)
EDGES = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~" + "«»“”„’‘…–—¿¡"


def terms(text: str | None) -> np.ndarray:
    """The distinct hashed terms of a whole text: lower-case words without outer punctuation, and their beginnings."""
    words = {w.strip(EDGES) for w in set((text or "").lower().split())}
    words.discard("")
    found = set(words)
    for n in STEMS:
        found |= {w[:n] + "*" for w in words if len(w) > n}
    return np.unique(np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in found), dtype=np.uint32, count=len(found)))


def _places(kept: np.ndarray, rows: list[np.ndarray]) -> list[np.ndarray]:
    """For each row the places in kept of the hashes that are there."""
    n = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows) if len(rows) else np.empty(0, dtype=np.uint32)
    at = np.minimum(np.searchsorted(kept, flat), max(len(kept) - 1, 0))
    ok = kept[at] == flat if len(kept) else np.zeros(len(flat), dtype=bool)
    return [at[a:b][ok[a:b]] for a, b in zip(n[:-1], n[1:], strict=True)]


class Machine(NamedTuple):
    kept: np.ndarray  # sorted hashes that have weights
    bias: float
    w: np.ndarray
    v: np.ndarray

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_raw(self.bias, self.w, self.v, _places(self.kept, rows))[0], -30, 30)))


def _raw(bias: float, w: np.ndarray, v: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores before the link; the concatenated places, their rows, and the sum of factors of each row."""
    n = np.array([*map(len, rows)], dtype=np.int64)
    flat = np.concatenate(rows) if len(rows) else np.empty(0, dtype=np.int64)
    at = np.repeat(np.arange(len(rows)), n)
    total = np.stack([np.bincount(at, weights=v[flat, f], minlength=len(rows)) for f in range(v.shape[1])], 1)
    square = np.bincount(at, weights=(v[flat] ** 2).sum(1), minlength=len(rows))
    return bias + np.bincount(at, weights=w[flat], minlength=len(rows)) + ((total**2).sum(1) - square) / 2, flat, at, total


def fit(rows: list[np.ndarray], y: np.ndarray, rank: int = RANK, epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """Logistic loss, AdaGrad, and a decay of all weights that is stronger on the factors."""
    none = np.empty(0, dtype=np.uint32)
    if not len(y) or y.min() == y.max():
        p = np.clip(y.mean() if len(y) else 0.0, 0.01, 0.99)
        return Machine(none, float(np.log(p / (1 - p))), np.zeros(1), np.zeros((1, rank)))
    kept = chosen_hashes(rows, y)
    known = _places(kept, rows)
    rng = np.random.default_rng(seed)
    bias, w, v = float(np.log(y.mean() / (1 - y.mean()))), np.zeros(max(len(kept), 1)), rng.normal(0, 0.01, (max(len(kept), 1), rank))
    g_b, g_w, g_v = 1e-3, np.full(w.shape, 1e-3), np.full(v.shape, 1e-3)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(order), BATCH):
            own = order[a : a + BATCH]
            d_b, at, d_w, d_v = gradient(bias, w, v, [known[i] for i in own], y[own])
            d_w, d_v = d_w + DECAY[0] * w[at], d_v + DECAY[1] * v[at]
            g_b, g_w[at], g_v[at] = g_b + d_b**2, g_w[at] + d_w**2, g_v[at] + d_v**2
            bias -= RATES[0] * d_b / np.sqrt(g_b)
            w[at] -= RATES[1] * d_w / np.sqrt(g_w[at])
            v[at] -= RATES[2] * d_v / np.sqrt(g_v[at])
    return Machine(kept, bias, w, v)


def _gains(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes that occur often enough, how much each tells about the label, and whether it speaks for it."""
    hashes, seen = np.unique(np.concatenate(rows), return_counts=True)
    toxic, times = np.unique(np.concatenate([np.empty(0, dtype=hashes.dtype), *(r for r, t in zip(rows, y, strict=True) if t)]), return_counts=True)
    bad = np.zeros(len(hashes))
    bad[np.searchsorted(hashes, toxic)] = times
    expected = seen * y.mean()
    usable = seen >= min(MIN_ROWS, max(1, len(y) // 100))
    return hashes[usable], ((bad - expected) ** 2 / np.maximum(expected * (1 - y.mean()), 1e-9))[usable], (bad > expected)[usable]


def chosen_hashes(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The sorted hashes that the machine weighs."""
    hashes, gain, speaks = _gains(rows, y)
    order = np.argsort(-gain, kind="stable")
    alone = hashes[order[:FEATURES]]
    leads = np.sort(hashes[order[speaks[order]][:LEADS]])
    company = [k for k, r in enumerate(rows) if np.isin(r, leads).any()]
    if not company:
        return np.sort(alone)
    hashes, gain, _ = _gains([rows[k] for k in company], y[company])
    other = ~np.isin(hashes, alone)
    hashes, gain = hashes[other], gain[other]
    return np.sort(np.concatenate([alone, hashes[np.argsort(-gain, kind="stable")[:PAIRED]]]))


def gradient(bias: float, w: np.ndarray, v: np.ndarray, rows: list[np.ndarray], y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Of the mean logistic loss: by the bias, and by w and v of the places that occur."""
    z, flat, at, total = _raw(bias, w, v, rows)
    error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
    places, back = np.unique(flat, return_inverse=True)
    n = len(places)
    e = error[at][:, None] * (total[at] - v[flat])
    d_v = np.stack([np.bincount(back, weights=e[:, f], minlength=n) for f in range(v.shape[1])], 1)
    return float(error.sum()), places, np.bincount(back, weights=error[at], minlength=n), d_v


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of doc_id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on labels (doc_id, toxic) that are not held out; a document's repeats and repeated labels teach as they come.

    Labels without doc_id or toxic are left out; without any label, or with one class only, the machine gives every
    text that class's share.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), common.binary_column([terms(t).tobytes() for t in b.column(2).to_pylist()])], names=["doc_id", "toxic", "terms"])

    taught = common.texts_of(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")  # at most `sample` rows are broadcast
    rows = common.map_arrow(taught, extract, "doc_id long, toxic int, terms binary").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", "terms").limit(sample)  # however often a doc_id repeats
    got = rows.toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending")]).combine_chunks()
    y = np.array(got.column("toxic").to_pylist(), dtype=float)
    common.free_shuffles(docs.sparkSession)  # what the rows came through goes before the fit needs memory
    machine = fit(_arrays(got.column("terms").cast(pa.binary())), y)
    del got
    common.free_shuffles(docs.sparkSession)  # the driver lives on
    return machine


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The rows of a binary column as arrays of hashes, without a copy."""
    out: list[np.ndarray] = []
    for c in column.chunks:
        _, offsets, data = c.buffers()
        ends = np.frombuffer(offsets, dtype=np.int32)[c.offset : c.offset + len(c) + 1] // 4
        flat = np.frombuffer(data, dtype=np.uint32) if data is not None and data.size else np.empty(0, dtype=np.uint32)
        out += [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return out


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; a null or empty text has the score of no terms at all.

    Scores come from the text alone.  Rows without doc_id are scored and not held out; repeated rows repeat.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = sent.value.score([terms(t) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = common.map_arrow(common.texts_of(docs), run, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def reject(docs: DataFrame, machine: Machine, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score is below threshold, all columns as they are."""
    sent, names = docs.sparkSession.sparkContext.broadcast(machine), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for b in batches:
            s = sent.value.score([terms(t) for t in b.column(at).to_pylist()])
            yield b.filter(pa.array(s < threshold))

    return common.map_arrow(docs, run, docs.schema)
