"""What the operators of this subpackage share: the shared folder, written tables, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch; long texts make batches of tens of MB already at this size.
BATCH_ROWS = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; a temporary one only in local mode."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(shared_folder, "own"):
        shared_folder.own = "file://" + tempfile.mkdtemp(prefix="sahaf-")
    return shared_folder.own


def _filesystem(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: later plans start there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    if _open:
        _open[-1].append(out)
    return out


#: Tables written inside scratch() blocks that are open.
_open: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block whose materialize() tables are deleted at its end, but for those that the function it gives was called with."""
    kept: list[DataFrame] = []

    def keep(t: DataFrame) -> DataFrame:
        kept.append(t)
        return t

    _open.append([])
    try:
        yield keep
    finally:
        written = _open.pop()
        drop(*(t for t in written if not any(t is k for k in kept)))
        if _open:
            _open[-1].extend(kept)


def drop(*tables: DataFrame) -> None:
    """Delete tables of materialize() that no later plan reads."""
    for t in tables:
        fs, at = _filesystem(t.sparkSession, t.written_at)
        fs.delete(at, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that are no longer referenced."""
    import gc

    gc.collect()
    release_memory()
    spark._jvm.System.gc()


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    if isinstance(schema, T.StructType):
        schema = T.StructType([T.StructField(x.name, x.dataType) for x in schema])
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release_memory()

    return df.mapInArrow(run, schema)


def release_memory() -> None:
    """Give what a task has freed back to the system: a worker lives on, and others share its executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


#: Runs of up to so many bytes are told apart by their first and last eight bytes and their length.
SHORT = 16
_masks = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1] * (SHORT - 7), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A scrambled form of 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def edges(raw: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last eight bytes, as numbers, of runs of at most SHORT bytes; what a run lacks is 0."""
    wide = np.ndarray(len(raw) + 1, dtype="<u8", buffer=raw + bytes(8), strides=(1,))  # the eight bytes from each place on
    return wide[begin] & _masks[end - begin], np.where(end - begin > 8, wide[np.maximum(end - 8, 0)], np.uint64(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def binary_column(rows: list[bytes | None]) -> pa.Array:
    return pa.array(rows, type=pa.binary())


#: Rows of a table of a few numbers that is broadcast at most (under 64 MB); beyond it a join shuffles.
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, a table in the shared folder, with a broadcast hint if it has at most that many rows."""
    return F.broadcast(df) if df.count() <= rows else df


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id and text only, whatever other columns there are."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
