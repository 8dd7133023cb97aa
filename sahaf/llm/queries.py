"""The queries of this subpackage: each applies its operator to a whole table and returns the full result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, huffman, kmeans, neardup, packing, pieces, quality, structure, suffixes, topk, toxicity, urls
from .common import table

#: Fixed values of the queries' contract.
RULES = [
    urls.Rule("allow", "org", "/"),
    urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"),
    urls.Rule("block", "com", "/de/"),
]


def op1_chat_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(table(spark, sf_dir, "conversations"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_toxicity_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op4_benchmark_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.find(table(spark, sf_dir, "documents"), neardup.Similarity(width=2, percent=80))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES)


def op7_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digests; text is what is left when repeats of over 50 words go too."""
    return suffixes.digests(table(spark, sf_dir, "documents"), words=51)


def op8_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites are the documents' sources, and a site's paths their languages."""
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.learn(docs, table(spark, sf_dir, "labels")), F.col("source"), F.col("lang"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.round_trip(table(spark, sf_dir, "documents"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"), k=5, scale=256)


def op11_piece_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op12_elkan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, width=64, scale=256, salt="2:").drop("measured")


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.repair(structure.damage(table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_chat_role_repair, op2_best_fit_packing, op3_toxicity_machine, op4_benchmark_templates, op5_chosen_path, op6_url_filter, op7_suffix_arrays, op8_quality_bayes, op9_token_store, op10_exact_top_k, op11_piece_prefixes, op12_elkan_clusters, op13_structure_repair)}

SQL = {
    "op6_url_filter": r"""
WITH RECURSIVE tags AS (
    SELECT url, regexp_extract(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>') AS link,
           regexp_extract(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>') AS meta
    FROM pages WHERE contains(url, '://')
), found AS (
    SELECT url, regexp_extract(link, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS target FROM tags
    UNION ALL SELECT url, regexp_extract(meta, '(?i)\burl\s*=\s*[''"]?([^"''\s>]+)', 1) FROM tags
), absolute AS (
    SELECT url, CASE WHEN contains(target, '://') THEN target WHEN starts_with(target, '//') THEN 'http:' || target
        WHEN starts_with(target, '/') THEN regexp_extract(url, '^(?s:.*?)://[^/?#]*') || target
        ELSE regexp_extract(url, '^(?s:.*?)://[^?#]*/') || target END AS target
    FROM found WHERE target <> ''
), urls AS (
    SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT target FROM absolute)
), split AS (
    SELECT url, CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
           CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
           regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS query
    FROM urls
), rules(verdict, host, path) AS (
    VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), ruled AS (
    SELECT s.url, s.host, s.path, CASE WHEN s.host <> '' THEN s.host || s.path || s.query END AS node, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
    FROM split s LEFT JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
    GROUP BY ALL
), edges AS (
    SELECT a.node AS a, b.node AS b FROM absolute e JOIN ruled a ON a.url = e.url JOIN ruled b ON b.url = e.target
), both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges
), taken(node) AS (
    SELECT node FROM ruled WHERE verdict = 'block' AND node IN (SELECT a FROM both_ways)
    UNION SELECT w.b FROM taken t JOIN both_ways w ON w.a = t.node
)
SELECT p.page_id, coalesce(r.host, '') AS host, coalesce(r.path, '') AS path, r.rule,
       coalesce(r.verdict, CASE WHEN r.node IN (SELECT node FROM taken) THEN 'block' ELSE 'allow' END) AS verdict
FROM pages p LEFT JOIN ruled r ON r.url = p.url
""",
    "op10_exact_top_k": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
""",
    "op5_chosen_path": r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1
), shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached(doc_id, to_id) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, w.b FROM reached r JOIN both_ways w ON w.a = r.to_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(to_id) AS component_id FROM reached GROUP BY 1) USING (doc_id)
""",
    "op7_suffix_arrays": r"""
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), strings AS (
    SELECT doc_id, i, md5(substr(x, 2 * i + 1, 800)) AS h FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 399)) AS i FROM bytes)
), repeated AS (SELECT h FROM strings GROUP BY 1 HAVING count(*) > 1
), byte_spans AS (SELECT doc_id, i AS a, i + 400 AS b FROM strings JOIN repeated USING (h)
), chunks AS (
    SELECT doc_id, strlen(text) AS n, strlen(regexp_extract(text, '^[\x20\x09-\x0D]*')) AS lead, regexp_extract_all(text, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS c FROM documents
), places AS (
    SELECT doc_id, k, chunk, lead + sum(strlen(chunk)) OVER (PARTITION BY doc_id ORDER BY k) - strlen(chunk) AS a FROM (SELECT doc_id, lead, unnest(range(1, len(c) + 1)) AS k, unnest(c) AS chunk FROM chunks)
), windows AS (
    SELECT doc_id, k, md5(array_to_string(w[k:k + 50], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 49)) AS k FROM (SELECT doc_id, list_transform(c, lambda x: regexp_extract(x, '^[^\x20\x09-\x0D]+')) AS w FROM chunks))
), again AS (SELECT h FROM windows GROUP BY 1 HAVING count(*) > 1
), word_spans AS (
    SELECT w.doc_id, p.a::BIGINT AS a, coalesce(q.a, c.n)::BIGINT AS b FROM windows w JOIN again USING (h) JOIN chunks c USING (doc_id)
    JOIN places p ON p.doc_id = w.doc_id AND p.k = w.k LEFT JOIN places q ON q.doc_id = w.doc_id AND q.k = w.k + 51
), every AS (
    SELECT 'bytes' AS unit, doc_id, a, b FROM byte_spans UNION ALL SELECT 'both', doc_id, a, b FROM byte_spans UNION ALL SELECT 'both', doc_id, a, b FROM word_spans
), opened AS (
    SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY unit, doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM every
), runs AS (SELECT unit, doc_id, a, b, sum(opens) OVER (PARTITION BY unit, doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM opened
), spans AS (SELECT unit, doc_id, min(a) AS a, max(b) AS b FROM runs GROUP BY unit, doc_id, run
), kept AS (SELECT unit, doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY unit, doc_id ORDER BY a), 0) AS since FROM spans
), cut AS (
    SELECT unit, doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS rest
    FROM kept JOIN bytes USING (doc_id) GROUP BY unit, doc_id
), whole AS (  -- without bytes of characters that a cut parted
    SELECT doc_id, decode(unhex(array_to_string(list_filter(regexp_extract_all(rest, '[0-7].|[CD].[89AB].|E.[89AB].[89AB].|F.[89AB].[89AB].[89AB].|..'), lambda c: length(c) > 2 OR c < '8'), ''))) AS text FROM cut WHERE unit = 'both'
)
SELECT d.doc_id, length(x) // 2 AS n_bytes, coalesce(c.n_removed, 0) AS n_removed, coalesce(c.n_spans, 0) AS n_spans, sha256(unhex(coalesce(c.rest, x))) AS kept_sha256,
       CASE WHEN w.doc_id IS NULL THEN d.text ELSE w.text END AS text
FROM documents d JOIN bytes USING (doc_id) LEFT JOIN cut c ON c.doc_id = d.doc_id AND c.unit = 'bytes' LEFT JOIN whole w ON w.doc_id = d.doc_id
""",
}


def _rounds(n: int) -> str:
    """SQL of n rounds of assignment a<i> of all vectors v and centroids c<i + 1>, and of the last assignment a<n>."""
    out = []
    for i in range(n + 1):
        out.append(f"""a{i} AS MATERIALIZED (
    SELECT id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d
    FROM (SELECT v.id, c.cluster, list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v CROSS JOIN c{i} c) GROUP BY id
)""")
        if i < n:
            out.append(f"""c{i + 1} AS MATERIALIZED (
    SELECT cluster, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN (
        SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS e
        FROM (SELECT cluster, pos, sum(x) AS s, count(*) AS n FROM (SELECT a.cluster, unnest(range(64)) AS pos, unnest(v.e) AS x FROM a{i} a JOIN v USING (id)) GROUP BY 1, 2) GROUP BY 1
    ) m USING (cluster)
)""")
    return ", ".join(out)


SQL["op12_elkan_clusters"] = f"""
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), e)::INT - 1 AS cluster, e FROM v WHERE vec_id IS NOT NULL QUALIFY cluster < 40
), {_rounds(5)}
SELECT v.vec_id, a.cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a5 a JOIN v USING (id) JOIN c5 c USING (cluster)
"""
