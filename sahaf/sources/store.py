"""The record store: tables with fixed schemas, migration, guarded saves, a cache that follows its files."""

from __future__ import annotations

import contextlib
import hashlib
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The layout's version, and its tables.
LAYOUT = "1.0.0"
TABLES = {
    "banks": "bank_id int, slug string, name string",
    "campaigns": "id long, bank_id int, title string, product_type string, financing_type string, rate double, amount double, record_kind string, updated_at timestamp",
    "products": "id long, bank_id int, title string, product_type string, rate double, amount double, record_kind string, updated_at timestamp",
    "versions": "record_id string, source_version int, content_hash string, valid_from timestamp, valid_to timestamp, is_current boolean, occurrence_count long",
}


def filesystem(spark: SparkSession, path: str):
    """(file system, path) of the store that path names, local or not."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def layout_of(spark: SparkSession, folder: str) -> str | None:
    """The layout's version; None if nothing is there.  Tables without a version are a layout that isn't known."""
    fs, _ = filesystem(spark, folder)
    at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if fs.exists(at("schema_meta")):
        return spark.read.schema("version string").parquet(f"{folder}/schema_meta").first()["version"]
    if any(fs.exists(at(t)) for t in TABLES):
        raise ValueError(f"{folder} holds tables of a layout that isn't known")
    return None


def open_store(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The store's tables; a new store is laid out, columns that older files lack are null, others are left out."""
    if layout_of(spark, folder) is None:
        for name, schema in TABLES.items():
            spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}")
        spark.createDataFrame([(LAYOUT,)], "version string").coalesce(1).write.parquet(f"{folder}/schema_meta")  # last: a store without it is not finished
    elif (version := layout_of(spark, folder)).split(".")[0] != LAYOUT.split(".")[0]:
        raise ValueError(f"the store has layout {version}, this is {LAYOUT}")
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in TABLES.items()}


def append(df: DataFrame, folder: str, table: str) -> None:
    """Add rows to a table of the store: its columns by name, absent ones null; unknown columns are an error."""
    wanted = df.sparkSession.createDataFrame([], TABLES[table])
    if extra := set(df.columns) - set(wanted.columns):
        raise ValueError(f"{table} has no columns {sorted(extra)}")
    wanted.unionByName(df, allowMissingColumns=True).select(*(F.col(c).cast(t) for c, t in wanted.dtypes)).write.mode("append").parquet(f"{folder}/{table}")


def _read(spark: SparkSession, path: str) -> bytes | None:
    fs, at = filesystem(spark, path)
    if not fs.exists(at):
        return None
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])


def digest_of(spark: SparkSession, path: str) -> str | None:
    """SHA-256 of a file; None if there is none."""
    raw = _read(spark, path)
    return None if raw is None else hashlib.sha256(raw).hexdigest()


class Changed(RuntimeError):
    """The file is no longer what the writer had read."""


#: Seconds after which a writer that holds a file's claim counts as dead.
CLAIM_SECONDS = 600


def _claim(spark: SparkSession, path: str, expected: str | None):
    """The path of a file that one writer at a time can create for what it expects to find; an old one is taken over."""
    fs, at = filesystem(spark, f"{path}.{(expected or 'absent')[:16]}.claim")
    for _ in range(2):
        try:
            fs.create(at, False).close()
            return fs, at
        except Exception as e:  # the JVM's, of whatever file system
            if not fs.exists(at):
                if "FileAlreadyExists" in str(e):  # let go since; who gets it looks at the file again
                    continue
                raise
            if time.time() * 1000 - fs.getFileStatus(at).getModificationTime() < 1000 * CLAIM_SECONDS:
                raise Changed(path) from e
            fs.delete(at, False)
    raise Changed(path)


def _replace(spark: SparkSession, fs, beside: str, path: str, data: bytes) -> None:
    """Flush data to the file beside, and put it in the place of path in one step."""
    own, to = (fs.makeQualified(filesystem(spark, p)[1]) for p in (beside, path))
    if fs.getUri().getScheme() == "file":  # where the JVM's rename deletes first
        local = to.toUri().getPath()
        with open(own.toUri().getPath(), "wb") as out:
            out.write(data)
            out.flush()
            os.fsync(out.fileno())
        with contextlib.suppress(FileNotFoundError):  # a checksum of what was there
            os.remove(f"{os.path.dirname(local)}/.{os.path.basename(local)}.crc")
        os.replace(own.toUri().getPath(), local)
        return
    out = fs.create(own, False)
    try:
        out.write(bytearray(data))
        out.hsync()
    finally:
        out.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    rename = getattr(jvm, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(own, to, how)


def save(spark: SparkSession, path: str, data: bytes, expected: str | None) -> str:
    """Write a small file if it still has the expected digest (None: is still absent), and return the new digest.

    The bytes are flushed to a file beside it, which then takes its place in one step, so readers always find one of the
    two whole.  Of several writers that expect the same digest one gets the claim to it; the others fail, as do those
    that come when the file has changed.
    """
    if digest_of(spark, path) != expected:
        raise Changed(path)
    fs, claim = _claim(spark, path, expected)
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        if digest_of(spark, path) != expected:  # before the claim was ours
            raise Changed(path)
        _replace(spark, fs, beside, path, data)
    finally:
        fs.delete(filesystem(spark, beside)[1], False)
        fs.delete(claim, False)
    return hashlib.sha256(data).hexdigest()


class FileCache:
    """What was made of files, until one of them changes: kept by paths with lengths and times of change."""

    def __init__(self, spark: SparkSession, make: Callable[[SparkSession, str], object]):
        self.spark, self.make, self.known = spark, make, {}

    def stamp(self, path: str) -> tuple:
        fs, at = filesystem(self.spark, path)
        if not fs.exists(at):
            raise FileNotFoundError(path)
        files, found = fs.listFiles(at, True), []  # of all folders below, as tables in partitions have
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return tuple(sorted(found))

    def get(self, path: str) -> tuple[object, bool]:
        """(what make() gives for path, whether it was known)."""
        stamp = self.stamp(path)
        hit = self.known.get(path, (None,))[0] == stamp
        if not hit:
            self.known[path] = stamp, self.make(self.spark, path)
        return self.known[path][1], hit
