"""The corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sahaf.llm import decontamination, neardup, packing, suffixes, toxicity
from sahaf.llm.common import drop, free_shuffles, materialize, scratch, table

#: Near-duplicates share 0.8 of their five-word shingles.
NEAR = neardup.Similarity(width=5, percent=80)
#: Passages of over 50 words that repeat go, as do repeated strings of 400 bytes, whatever their words.
PASSAGE_WORDS = 51


#: Characters of each plan's text that the driver keeps for its history; there are hundreds of plans.
PLAN_CHARACTERS = 20_000


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go; the machine learns from the labelled ones among docs.

    Null and empty texts have the score of no terms; rows without doc_id are scored like others; repeated rows share
    their fate; without labels nothing goes.  An empty table stays empty.
    """
    return toxicity.reject(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of least doc_id stays.

    Null and empty texts and rows without doc_id all stay; of exact repeats of a row one stays; of several texts under
    one doc_id each is judged by itself.  An empty table stays empty.
    """
    return neardup.keep_one(docs, NEAR)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat go from every text that has them, wherever they stand; n_chars follows.

    A text all of which repeats is empty then, and stays; null texts stay null; rows without doc_id are documents like
    others.  An empty table stays empty.
    """
    return suffixes.remove(docs, words=PASSAGE_WORDS)


def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go, in its own words or with other numbers, names and units.

    Rows without doc_id and null texts stay; all rows of a doc_id go together; null or short items match nothing.  An
    empty table, of documents or of items, takes nothing away.
    """
    return decontamination.clean(docs, decontamination.find(docs, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 1024 ids.

    Null and empty texts have their end id; repeated rows and rows without doc_id are documents of their own.  An empty
    table gives no pieces.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", keep_one_of_each_group),
    ("repeated_passages", remove_repeated_passages),
    ("benchmark_leaks", remove_benchmark_leaks),
    ("packing", pack),
]
#: Tokenizing and learning are beyond SQL; tests hold run() against a plain version of all that follows the learned stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir, each on the written result of the one before.

    What a stage wrote for itself is deleted when its result is written, and that result when the next one is.
    """
    spark.conf.set("spark.sql.maxPlanStringLength", str(PLAN_CHARACTERS))
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        free_shuffles(spark)
        if k + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        with scratch() as keep:
            docs = keep(materialize(stage(spark, docs, sf_dir), name))
        if before is not None:
            drop(before)
        before = docs
