"""Centroid clustering with Elkan's bounds, exact over integers.

Every vector keeps an upper bound of its distance to its own centroid and a lower bound of that to each centroid.  When
the centroids have moved, the bounds give way by as much as they moved; distances between centroids and the bounds then
tell most vectors that no other centroid can be as near, and only the rest are measured.  Bounds are square roots,
stored as 32-bit floats and always rounded away from the true distance, and a centroid is skipped only if a bound is
strictly beyond the upper one, so ties are measured and go to the smaller number.  All measured distances are exact
integers.

Each round is one pass over the vectors: it reads a state table in the shared folder and writes the next.  What goes
through the driver are the centroids and their sums: k rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Beyond this sum of squares 64-bit floats are no longer exact, and int64 takes over; beyond LARGEST a distance is no long.
EXACT, LARGEST = 2**52, 2**62
#: Vectors that are measured at once.
ROWS = 8192


def up(x: np.ndarray) -> np.ndarray:
    """32-bit floats that are not below x."""
    out = x.astype(np.float32)
    return np.where(out < x, np.nextafter(out, np.float32(np.inf)), out)


def down(x: np.ndarray) -> np.ndarray:
    """32-bit floats that are not above x, and not below 0."""
    out = x.astype(np.float32)
    return np.maximum(np.where(out > x, np.nextafter(out, np.float32(-np.inf)), out), np.float32(0))


def root_up(squares: np.ndarray) -> np.ndarray:
    """64-bit floats that are not below the square roots of exact integers."""
    return np.nextafter(np.sqrt(np.nextafter(squares.astype(np.float64), np.inf)), np.inf)


def root_down(squares: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.sqrt(np.maximum(np.nextafter(squares.astype(np.float64), -np.inf), 0)), -np.inf), 0)


class Centroids:
    """Centroids of one round: their integers, their distances from each other, and how far they came."""

    def __init__(self, points: np.ndarray, before: np.ndarray | None = None):
        self.points = points
        self.k, self.width = points.shape
        self.largest = int(np.abs(points).max(initial=0))
        wide = points.astype(object) if self.width * (2 * self.largest) ** 2 >= LARGEST else points
        apart = ((wide[:, None, :] - wide[None, :, :]) ** 2).sum(2)
        #: Half the distance between centroids, not above the true one; a centroid is no rival of itself.
        self.half = root_down(np.asarray(apart, dtype=np.float64)) / 2 * (1 - 2**-50)
        np.fill_diagonal(self.half, np.inf)
        self.nearest = self.half.min(axis=1) if self.k else np.empty(0)
        self.moved = np.zeros(self.k) if before is None else root_up(np.asarray(((wide - before.astype(wide.dtype)) ** 2).sum(1), dtype=np.float64))

    def check(self, x: np.ndarray) -> None:
        """Distances to x must be longs."""
        if self.width * (int(np.abs(x).max(initial=0)) + self.largest) ** 2 >= LARGEST:
            raise ArithmeticError("a squared distance is too large for a long")

    def squares(self, x: np.ndarray) -> np.ndarray:
        """Exact squared distances of vectors to all centroids."""
        if self.width * (int(np.abs(x).max(initial=0)) + self.largest) ** 2 < EXACT:
            a, c = x.astype(np.float64), self.points.astype(np.float64)
            return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
        return np.stack([self.pairs(x, np.full(len(x), j)) for j in range(self.k)], axis=1)

    def pairs(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        """Exact squared distances of vectors to one centroid each."""
        d = x - self.points[cluster]
        return np.einsum("ij,ij->i", d, d)


def first(x: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower) of vectors that have no bounds yet: every distance is measured."""
    squares = c.squares(x)
    cluster = squares.argmin(axis=1)  # the smallest number of equals
    own = np.take_along_axis(squares, cluster[:, None], 1)[:, 0]
    return cluster, up(root_up(own)), down(root_down(squares))


def again(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower, number of distances measured for each) after the centroids have moved."""
    measured = np.zeros(len(x), dtype=np.int64)
    upper = up((upper.astype(np.float64) + c.moved[cluster]) * (1 + 2**-50))
    lower = down((lower.astype(np.float64) - c.moved[None, :]) * (1 - 2**-50))
    cluster = cluster.copy()
    open_ = np.flatnonzero(upper >= c.nearest[cluster])
    if not len(open_):
        return cluster, upper, lower, measured
    # The own distance is measured, then only rivals that neither bound rules out.
    own = c.pairs(x[open_], cluster[open_])
    tight = up(root_up(own))
    upper[open_], lower[open_, cluster[open_]] = tight, down(root_down(own))
    rival = (lower[open_] <= tight[:, None]) & (c.half[cluster[open_]] <= tight[:, None])
    at, j = np.nonzero(rival)
    measured[open_] = 1 + rival.sum(1)
    if len(at):
        best, who = own.copy(), cluster[open_].copy()
        for a in range(0, len(at), ROWS):
            r, q = at[a : a + ROWS], j[a : a + ROWS]
            d = c.pairs(x[open_[r]], q)
            lower[open_[r], q] = down(root_down(d))
            # of the block's rivals of a vector, the nearest, the smallest number of equals
            order = np.lexsort((q, d, r))
            lead = order[np.flatnonzero(np.r_[True, r[order][1:] != r[order][:-1]])]
            better = (d[lead] < best[r[lead]]) | ((d[lead] == best[r[lead]]) & (q[lead] < who[r[lead]]))
            win = lead[better]
            best[r[win]], who[r[win]] = d[win], q[win]
        cluster[open_], upper[open_] = who, up(root_up(best))
    return cluster, upper, lower, measured


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, or null if the vector has a component that is null or not finite."""
    whole = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(whole, F.transform(vector, lambda v: F.floor(v.cast("double") * scale).cast("int")))


STATE = "vec_id long, x binary, cluster int, upper float, lower binary, measured long"


def _rows(column: pa.Array, dtype: str, n: int) -> np.ndarray:
    """A binary column as a matrix of n numbers a row."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), n)


def _packed(m: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(m)
    step = raw.dtype.itemsize * raw.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(np.arange(len(raw) + 1, dtype=np.int32) * np.int32(step)), pa.py_buffer(raw.tobytes())])


def _assigned(vectors: DataFrame, c: Centroids, fresh: bool, width: int) -> DataFrame:
    """The next state of vectors (vec_id and x as an array at first, a state later) under centroids c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            if fresh:
                raw = b.column(1).flatten().to_numpy().astype("<i4").reshape(len(b), width)
                x = raw.astype(np.int64)
                c.check(x)
                cluster, upper, lower = first(x, c)
                measured = np.full(len(b), c.k, dtype=np.int64)
            else:
                raw = _rows(b.column(1), "<i4", width)
                x = raw.astype(np.int64)
                cluster, upper, lower, n = again(x, b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy(), _rows(b.column(4), "<f4", c.k), c)
                measured = b.column(5).to_numpy() + n
            yield pa.RecordBatch.from_arrays([b.column(0), _packed(raw), pa.array(cluster, type=pa.int32()), pa.array(upper, type=pa.float32()), _packed(lower), pa.array(measured)], names=["vec_id", "x", "cluster", "upper", "lower", "measured"])

    return common.map_arrow(vectors, run, STATE)


def _sums(state: DataFrame, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(count, componentwise sum) of every cluster's vectors, as exact integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, dtype=np.int64), np.zeros((k, width), dtype=np.int64)
        for b in batches:
            cluster = b.column(1).to_numpy()
            n += np.bincount(cluster, minlength=k)
            np.add.at(total, cluster, _rows(b.column(0), "<i4", width))
        at = np.repeat(np.arange(k, dtype=np.int32), width)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.tile(np.arange(width, dtype=np.int32), k)), pa.array(np.repeat(n, width)), pa.array(total.ravel())], names=["cluster", "pos", "n", "s"])

    parts = common.map_arrow(state.select("x", "cluster"), run, "cluster int, pos int, n long, s long")
    n, total = np.zeros(k, dtype=np.int64), np.zeros((k, width), dtype=np.int64)
    for r in parts.groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():  # k rows a component
        n[r["cluster"]], total[r["cluster"], r["pos"]] = r["n"], r["s"]
    return n, total


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, salt: str = "2:") -> DataFrame:
    """A row per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, and how many distances were measured.

    Components become floor(scale * x); vectors that are null, of another width, or hold null or non-finite components
    take no part.  The first centroids are the k vectors whose salted vec_id has the smallest SHA-256; rows without
    vec_id are clustered but are no first centroids, repeated rows are vectors each, and of rows of one vec_id the lesser
    vector comes first.  With fewer than k vectors there are fewer clusters, and without any no rows.  Empty clusters
    keep their centroid.  Components must be ints, and squared distances longs; others are an error, as they can't be
    returned.  Columns of other names are ignored.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), scale).alias("x")).where(F.size("x") == width)
    seeds = kept.where("vec_id is not null").orderBy(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256), "x").limit(k).collect()  # k rows
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, measured long"
    if not seeds:
        return spark.createDataFrame([], schema)
    c = Centroids(np.array([r["x"] for r in seeds], dtype=np.int64))
    state = common.materialize(_assigned(kept, c, True, width), "clusters")
    for _ in range(rounds):
        n, total = _sums(state, c.k, width)
        c = Centroids(np.where(n[:, None] > 0, total // np.maximum(n, 1)[:, None], c.points), c.points)
        before, state = state, common.materialize(_assigned(state, c, False, width), "clusters")
        common.drop(before)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = c.pairs(_rows(b.column(1), "<i4", width).astype(np.int64), b.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(d), b.column(3)], names=["vec_id", "cluster", "distance", "measured"])

    done = common.materialize(common.map_arrow(state.select("vec_id", "x", "cluster", "measured"), measure, "vec_id long, cluster int, distance long, measured long"), "clustered")
    common.drop(state)
    inertia = {r["cluster"]: r["s"] for r in done.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    own = [(j, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, c.points[j].tolist())).encode()).hexdigest()) for j, s in inertia.items()]
    of = F.broadcast(spark.createDataFrame(own, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return done.join(of, "cluster").select(*(f.split()[0] for f in schema.split(", ")))
