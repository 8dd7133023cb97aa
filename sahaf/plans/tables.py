"""The engine's input tables, as the synthetic tables stand in for them.

Each adapter is one SELECT that both Spark and the SQL oracle understand; `{name}` is a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

ADAPTERS = {
    "records": """
        SELECT doc_id AS id, CASE WHEN doc_id % 41 = 0 THEN '' ELSE source END AS bank_slug, CASE WHEN doc_id % 37 <> 0 THEN source END AS bank_name, substr(text, 1, CAST(doc_id % 30 AS INT)) AS title, text AS content,
            CASE doc_id % 9 WHEN 0 THEN concat('http://bank.example/', CAST(doc_id AS VARCHAR(20))) WHEN 1 THEN 'https:///none' ELSE concat('https://bank.example/', CAST(doc_id % 700 AS VARCHAR(20))) END AS source_url,
            CASE WHEN doc_id % 4 <> 0 THEN concat('2024-0', CAST(1 + doc_id % 9 AS VARCHAR(4)), '-01') END AS start_date, CASE WHEN doc_id % 5 <> 0 THEN concat('2024-0', CAST(1 + doc_id % 7 AS VARCHAR(4)), '-28') END AS end_date,
            CASE WHEN doc_id % 6 <> 0 THEN substr(text, 1, CAST(30 * (doc_id % 23) AS INT)) END AS summary, CASE WHEN doc_id % 3 = 0 THEN 'product' ELSE 'campaign' END AS record_kind
        FROM {documents}""",
    "banks": "SELECT n_nationkey AS bank_id, lower(n_name) AS slug, n_name AS name FROM {nation}",
    "campaigns": """
        SELECT o_orderkey AS id, c_nationkey AS bank_id, concat('Order ', CAST(o_orderkey AS VARCHAR(20)), ' ', o_orderpriority) AS title,
            CASE o_orderpriority WHEN '5-LOW' THEN '' WHEN '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority END AS product_type,
            CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN NULL ELSE concat('f', CAST(o_orderkey % 4 AS VARCHAR(4))) END AS financing_type,
            CASE o_orderstatus WHEN 'O' THEN 'TRY' WHEN 'F' THEN 'USD' END AS reward_currency,
            CASE WHEN o_orderkey % 3 = 0 THEN 'TRY' WHEN o_orderkey % 3 = 1 THEN 'EUR' END AS max_currency,
            CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 100 AS DOUBLE) / 1000 END AS rate,
            o_totalprice AS amount, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS scraped_at,
            o_orderdate + INTERVAL '1' DAY AS updated_at, 'campaign' AS record_kind
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "products": """
        SELECT p_partkey AS id, CAST(p_partkey % 25 AS INT) AS bank_id, concat(p_name, ' ', CAST(p_partkey % 300 AS VARCHAR(20))) AS title,
            CASE WHEN p_size <= 5 THEN ' ' ELSE p_type END AS product_type, p_brand AS brand,
            CASE WHEN p_size % 4 <> 0 THEN CAST(p_size AS DOUBLE) / 1000 END AS rate, p_retailprice AS amount,
            TIMESTAMP '2001-01-01 00:00:00' AS updated_at, 'product' AS record_kind
        FROM {part}""",
    "observations": "SELECT concat('r', CAST(user_id AS VARCHAR(20))) AS record_id, event_type AS content_hash, ts AS observed_at, event_id FROM {events}",
    "offers": """
        SELECT concat('o', CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(5))) AS id, l_suppkey AS bank_id,
            CASE WHEN l_linenumber % 6 = 0 THEN NULL WHEN l_returnflag = 'R' THEN 'investment' WHEN l_returnflag = 'A' THEN 'card' ELSE 'financing' END AS product_type,
            CASE WHEN l_linestatus = 'F' AND l_linenumber % 4 = 0 THEN 'USD' WHEN l_linenumber % 5 <> 0 THEN 'TRY' END AS currency,
            CASE WHEN l_linenumber % 3 <> 0 THEN l_discount END AS rate, CASE WHEN l_linenumber % 4 <> 1 THEN l_extendedprice END AS max_amount,
            CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS INT) END AS term_months, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity * 30 AS INT) END AS duration_days, l_tax AS tax, l_shipdate AS end_date,
            CASE WHEN l_tax = 0 THEN 'masrafsız' END AS fee, CASE l_orderkey % 4 WHEN 1 THEN 'retiree' WHEN 2 THEN 'student' END AS audience, CASE l_partkey % 3 WHEN 0 THEN 'housing' WHEN 1 THEN 'vehicle' END AS financing_type,
            CASE WHEN l_orderkey % 3 = 0 THEN l_quantity * 10 END AS reward, CASE WHEN l_linenumber % 2 = 1 THEN l_discount END AS discount, CASE WHEN l_linenumber % 5 < 3 THEN CAST(l_partkey % 12 AS INT) END AS instalments
        FROM {lineitem}""",
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter's rows, or a table of sf_dir as it is."""
    if name not in ADAPTERS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = ADAPTERS[name]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in sorted(set(re.findall(r"\{(\w+)\}", sql)))})


def spread(keys: DataFrame, tasks: int = 8) -> DataFrame:
    """Rows of few bytes that much work follows, dealt to `tasks` tasks a core; a file of a few MB would be one task's work."""
    return keys.repartition(tasks * keys.sparkSession.sparkContext.defaultParallelism, *keys.columns)


def sql_with(body: str, *names: str) -> str:
    """body as a query over the adapters named; body may begin with further WITH items after a comma."""
    items = [f"{n} AS ({re.sub(r'\{(\w+)\}', r'\1', ADAPTERS[n])})" for n in names]
    body = body.strip()
    return "WITH " + ",\n".join(items) + ("" if body.startswith(",") else "\n") + body
