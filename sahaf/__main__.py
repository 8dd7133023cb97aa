"""The command line: python -m sahaf COMMAND.

banks, campaigns and validate read a folder of Parquet tables; preprocess writes clean records; db init lays a store
out, db load fills it; query runs one of the registered queries.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sahaf import plans
from sahaf.functions import text
from sahaf.operators import evaluation
from sahaf.plans import registry
from sahaf.plans.tables import frame
from sahaf.sources import store

assert plans.__all__


def show(df: DataFrame, limit: int) -> None:
    for r in df.limit(limit).toJSON().collect():  # a report's rows
        print(r)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="sahaf", description=__doc__.splitlines()[0])
    sub = out.add_subparsers(dest="command", required=True)
    for name in ("banks", "campaigns", "validate", "preprocess"):
        one = sub.add_parser(name)
        one.add_argument("tables")
        one.add_argument("--limit", type=int, default=50)
    sub.choices["campaigns"].add_argument("--bank")
    sub.choices["preprocess"].add_argument("--out", required=True)
    db = sub.add_parser("db")
    db.add_argument("action", choices=("init", "load"))
    db.add_argument("folder")
    db.add_argument("--tables")
    query = sub.add_parser("query")
    query.add_argument("name", choices=sorted(registry.QUERIES))
    query.add_argument("tables")
    query.add_argument("--limit", type=int, default=50)
    return out


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("sahaf").getOrCreate()
    if a.command == "banks":
        show(frame(spark, a.tables, "banks").orderBy("bank_id"), a.limit)
    elif a.command == "campaigns":
        own = frame(spark, a.tables, "campaigns").join(frame(spark, a.tables, "banks"), "bank_id")
        show((own.where(F.col("slug") == a.bank) if a.bank else own).select("id", "slug", "title", "product_type", "rate").orderBy("id"), a.limit)
    elif a.command == "validate":
        report = evaluation.quality_report(evaluation.record_issues(frame(spark, a.tables, "records"))).first().asDict()
        print(json.dumps(report))
        return int(report["errors"] > 0)
    elif a.command == "preprocess":
        own = frame(spark, a.tables, "records").withColumn("clean", text.clean_text("content"))
        own.withColumns({"tokens": text.tokens("clean"), "content_hash": text.content_hash("title", "clean"), "duplicate_fingerprint": F.lpad(F.lower(F.hex(text.simhash("clean"))), 16, "0")}).write.mode("overwrite").parquet(a.out)
    elif a.command == "db":
        known = store.open_store(spark, a.folder)
        if a.action == "load":
            for name in ("banks", "campaigns", "products"):
                own = frame(spark, a.tables, name)
                store.append(own.select(*(c for c in known[name].columns if c in own.columns)), a.folder, name)
    else:
        show(registry.QUERIES[a.name](spark, a.tables), a.limit)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
