"""The vector index: its lists, its builds over changed documents, its markers, and its recall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sahaf.operators import index
from sahaf.operators import retrieval as rt
from sahaf.sources import io

from .registry import query
from .tables import frame

#: The documents as they come at first, and later: one language has gone, and one source's texts are all in lower case.
FIRST = "SELECT doc_id AS id, coalesce(text, '') AS text, lang, source FROM documents"
LATER = "SELECT doc_id AS id, CASE WHEN source = (SELECT min(source) FROM documents) THEN lower(coalesce(text, '')) ELSE coalesce(text, '') END AS text, lang, source FROM documents WHERE lang IS DISTINCT FROM 'de'"
BUILDS = f"WITH one AS (SELECT *, md5(text) AS hash FROM ({FIRST})), two AS (SELECT *, md5(text) AS hash FROM ({LATER}))"


def entries(spark, d, later: bool) -> DataFrame:
    own = frame(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), "lang", "source")
    if later:
        lowered = own.agg(F.min("source")).first()[0]
        own = own.where(~F.col("lang").eqNullSafe("de")).withColumn("text", F.when(F.col("source") == lowered, F.lower("text")).otherwise(F.col("text")))
    return own.withColumn("hash", F.md5("text"))


def embed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("embedding", rt.hash_embedding(F.col("text"))).drop("text")


def twice(spark, d) -> tuple[str, list[index.Build]]:
    """The index of both states of the documents, one after the other, and what each build did."""
    folder = io.work_folder(spark, "index")
    return folder, [index.build(entries(spark, d, later), folder, embed, "digest-8") for later in (False, True)]


@query("r13_incremental_index", f"""{BUILDS}
SELECT 1 AS build, count(*) AS total, count(*) AS embedded, 0::BIGINT AS unchanged, 0::BIGINT AS stale_deleted FROM one
UNION ALL SELECT 2, (SELECT count(*) FROM two), (SELECT count(*) FROM two LEFT JOIN one USING (id) WHERE one.hash IS DISTINCT FROM two.hash), (SELECT count(*) FROM two JOIN one USING (id, hash)), (SELECT count(*) FROM one ANTI JOIN two USING (id))""")
def r13(spark, d):
    """What each build embedded, left alone and deleted."""
    _, builds = twice(spark, d)
    return spark.createDataFrame([(k, b.total, b.embedded, b.unchanged, b.stale_deleted) for k, b in enumerate(builds, 1)], "build int, total long, embedded long, unchanged long, stale_deleted long")


@query("s22_index_upsert", f"""{BUILDS}
SELECT id, hash, lang, list_transform(range(1, 9), lambda i: (CAST(concat('0x', substr(hash, (4 * i - 3)::INT, 4)) AS BIGINT) / 65535)::DOUBLE) AS embedding FROM two""")
def s22(spark, d):
    """The index's entries after both builds."""
    folder, _ = twice(spark, d)
    return index.lists(spark, folder).select("id", "hash", "lang", "embedding")


@query("st08_index_markers", f"""{BUILDS}
SELECT 1::BIGINT AS seq, 'building' AS status, 0::BIGINT AS total UNION ALL SELECT 2, 'ready', (SELECT count(*) FROM one) UNION ALL SELECT 3, 'building', (SELECT count(*) FROM one) UNION ALL SELECT 4, 'ready', (SELECT count(*) FROM two)""")
def st08(spark, d):
    """The states that the index went through, and how many entries each found."""
    folder, _ = twice(spark, d)
    return index.markers(spark, folder).select("seq", "status", "total")


@query("r15_hash_embeddings", "SELECT item_id, list_transform(range(1, 9), lambda i: (CAST(concat('0x', substr(md5(text), (4 * i - 3)::INT, 4)) AS BIGINT) / 65535)::DOUBLE) AS embedding FROM benchmark")
def r15(spark, d):
    """Eight numbers from a digest: stand-ins for embeddings where there is no model."""
    return frame(spark, d, "benchmark").select("item_id", rt.hash_embedding(F.col("text")).alias("embedding"))


def vectors(spark, d) -> DataFrame:
    return frame(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.md5(F.concat_ws(",", F.col("embedding").cast("array<string>"))).alias("hash"), "label", "embedding")


def indexed(spark, d) -> tuple[str, DataFrame]:
    """The folder of an index of all embeddings, and the queries: every hundredth vector."""
    folder = io.work_folder(spark, "vectors")
    index.build(vectors(spark, d), folder, lambda rows: rows, "given")
    return folder, frame(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query("r08_inverted_lists")
def r08_lists(spark, d):
    """The 20 best vectors among the probed lists, for every hundredth vector.  Approximate, so no SQL; r08_recall tells how near."""
    folder, asked = indexed(spark, d)
    return index.search(spark, folder, asked, 20).select("query_id", "id", "score", "rank")


@query("r08_recall")
def r08_recall(spark, d):
    """How many of each query's 20 true neighbours the probed lists gave, and how many lists and vectors were read for it."""
    folder, asked = indexed(spark, d)
    exact = rt.nearest(frame(spark, d, "embeddings").select("vec_id", "embedding"), asked, 20).select("query_id", F.col("vec_id").alias("id"))
    found = index.search(spark, folder, asked, 20).select("query_id", "id", F.lit(1).alias("hit"))
    hits = exact.join(found, ["query_id", "id"], "left").groupBy("query_id").agg(F.count("*").alias("neighbours"), F.count("hit").alias("found"))
    sizes = index.lists(spark, folder).groupBy("cell").agg(F.count("*").alias("n"))  # a row a list
    reads = index.probed(spark, folder, asked).join(F.broadcast(sizes), "cell").groupBy("query_id").agg(F.count("*").alias("lists_read"), F.sum("n").alias("vectors_read"))
    return hits.join(reads, "query_id")
