"""Retrieval, graph and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sahaf.functions import fields as v
from sahaf.functions import labels as fixed
from sahaf.functions import spans
from sahaf.operators import evaluation as ev
from sahaf.operators import labelling, ranking
from sahaf.operators import retrieval as rt

from .campaigns import EVIDENCE_SQL, SPANS_SQL, campaigns
from .language import AUDIENCE, MOST, PRODUCT, SHARES, TERM, B, told
from .registry import query
from .tables import frame, sql_with

TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
ASKED = "SELECT item_id AS query_id, text AS query FROM benchmark"
BM25 = f"""WITH docs AS (SELECT doc_id AS id, {TOK} AS w FROM documents), stats AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM docs),
post AS (SELECT id, token, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(w) AS dl, unnest(w) AS token FROM docs) GROUP BY 1, 2),
asked AS ({ASKED}), terms AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+')) AS token FROM asked), df AS (SELECT token, count(*) AS df FROM post GROUP BY 1),
scored AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5 / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM terms JOIN post USING (token) JOIN df USING (token), stats GROUP BY 1, 2),
lexical AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 20)
"""


def every(spark, d):
    return frame(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def asked(spark, d):
    return frame(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query("r06_bm25", BM25 + "SELECT query_id, id, score, rank FROM lexical")
def r06(spark, d):
    return rt.bm25(every(spark, d), asked(spark, d), 20).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@query("a17_corpus_statistics", f"SELECT count(*) AS n, round(avg(len({TOK})), 6) AS avgdl FROM documents WHERE lang = 'en'")
def a17(spark, d):
    """Of the corpus that the caller's filter leaves: filters come before statistics."""
    return rt.corpus_statistics(frame(spark, d, "documents").where("lang = 'en'")).select("n", F.round("avgdl", 6).alias("avgdl"))


@query("j13_postings", BM25 + "SELECT token, count(*) AS df, sum(tf)::BIGINT AS tf FROM post GROUP BY 1")
def j13(spark, d):
    return rt.postings(every(spark, d)).groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query("t06_lexical_order", BM25 + "SELECT query_id, min(id) AS id FROM lexical WHERE rank = 1 GROUP BY 1")
def t06(spark, d):
    return rt.bm25(every(spark, d), asked(spark, d), 20).where("rank = 1").select("query_id", "id")


@query("t07_title_boost", BM25 + r""", first AS (SELECT doc_id, regexp_extract(lower(text), '[\p{L}\p{N}]+') AS word FROM documents)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY NOT EXISTS (SELECT 1 FROM terms t WHERE t.query_id = lexical.query_id AND t.token = first.word), score DESC, id) AS pos FROM lexical JOIN first ON doc_id = id""")
def t07(spark, d):
    """Documents whose title is a term of the question come first, whatever their score; a title is a text's first word here."""
    from pyspark.sql import Window

    titles = every(spark, d).select("id", F.regexp_extract(F.lower("text"), r"[\p{L}\p{N}]+", 0).alias("title"))
    terms = asked(spark, d).select("query_id", rt.words("query").alias("terms"))
    found = rt.bm25(every(spark, d), asked(spark, d), 20).join(titles, "id").join(terms, "query_id")
    w = Window.partitionBy("query_id").orderBy(~F.array_contains("terms", F.col("title")), F.desc("score"), "id")
    return found.select("query_id", "id", F.row_number().over(w).cast("long").alias("pos"))


VECTOR = """vectors AS (SELECT q.vec_id AS query_id, v.vec_id, round(greatest(0.0, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
nearest AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM vectors QUALIFY rank <= 20)
"""


def near(spark, d):
    v = frame(spark, d, "embeddings")
    return rt.nearest(v.select("vec_id", "embedding"), v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 20)


@query("r08_cosine_top_k", "WITH " + VECTOR + "SELECT query_id, vec_id, rank FROM nearest")
def r08(spark, d):
    return near(spark, d).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


@query("t10_vector_candidates", "WITH " + VECTOR + "SELECT query_id, count(*) AS n FROM nearest WHERE rank <= least(20, 3 * 5) GROUP BY 1")
def t10(spark, d):
    return near(spark, d).where(F.col("rank") <= min(20, 3 * 5)).groupBy("query_id").agg(F.count("*").alias("n"))


FUSED = BM25 + ", " + VECTOR + """, lists AS (SELECT query_id, 'lexical' AS source, id AS key, rank FROM lexical UNION ALL SELECT query_id // 100, 'vector', vec_id, rank FROM nearest UNION ALL SELECT query_id - 5, 'graph', id, rank FROM lexical WHERE query_id >= 5),
again AS (SELECT query_id, source, key, row_number() OVER (PARTITION BY query_id, source ORDER BY rank, key) AS rank FROM (SELECT query_id, source, key, min(rank) AS rank FROM lists GROUP BY 1, 2, 3)),
fused AS (SELECT query_id, key, round(sum(1.0::DOUBLE / (CASE source WHEN 'graph' THEN 10 ELSE 60 END + rank)), 6) AS score FROM again GROUP BY 1, 2)
"""


def lists(spark, d):
    """Three lists for every question: lexical, a vector's neighbours, and as a stand-in for the graph the fifth next question's."""
    lexical, vector = rt.bm25(every(spark, d), asked(spark, d), 20), near(spark, d)
    a = lexical.select("query_id", F.lit("lexical").alias("source"), F.col("id").alias("key"), "rank")
    g = lexical.where("query_id >= 5").select((F.col("query_id") - 5).alias("query_id"), F.lit("graph").alias("source"), F.col("id").alias("key"), "rank")
    return a.unionByName(vector.select(F.floor(F.col("query_id") / 100).alias("query_id"), F.lit("vector").alias("source"), F.col("vec_id").alias("key"), "rank")).unionByName(g)


def fused(spark, d):
    return ranking.reciprocal_ranks(lists(spark, d), {"vector": 60.0, "lexical": 60.0, "graph": 10.0}, group=["query_id"])


@query("r10_rank_fusion", FUSED + "SELECT query_id, key, score FROM fused")
def r10(spark, d):
    return fused(spark, d)


@query("a18_reciprocal_ranks", FUSED + "SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS pos FROM fused")
def a18(spark, d):
    from pyspark.sql import Window

    return fused(spark, d).select("query_id", "key", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key")).cast("long").alias("pos"))


RECORD_SQL = f"""{EVIDENCE_SQL}, g AS (SELECT p.id, p.dimension, p.label, e.s::INT AS s, (e.s + e.n)::INT AS e, substr(e.text, e.s + 1, e.n) AS surface FROM predicted p JOIN evident e ON p.id = e.id AND p.label = e.label),
own AS MATERIALIZED (SELECT t.id, t.text, coalesce(list_sort(list(DISTINCT {{'d': g.dimension, 'v': g.label, 'x': g.surface}}) FILTER (g.id IS NOT NULL)), []) AS signals FROM labelled t LEFT JOIN g ON g.id = t.id GROUP BY ALL),
advised AS MATERIALIZED (SELECT id, text, CASE WHEN id % 5 = 0 OR id % 7 = 0 OR id % 11 = 0 OR id % 13 = 0 THEN []::VARCHAR[] ELSE list_transform(signals, lambda x: concat('{rt.SIGNAL}', x.d, ': ', x.v, '; kanıt: ', x.x)) END AS lines FROM own)"""


def advised(spark, d):
    """Campaigns with the lines of their advice that may be quoted; some advice is of another content, version, contract or text."""
    shown = F.transform(F.filter("labels", lambda x: x["start"].isNotNull()), lambda x: F.struct(x["dimension"].alias("dimension"), x["label"].alias("value"), x["start"].alias("start"), x["end"].alias("end"), x["surface"].alias("surface")))
    own = labelling.shown_labels(campaigns(spark, d)).select("id", "text", F.explode(F.array(shown)).alias("signals"))  # unfolded, so that no later filter makes them anew
    i, text = F.col("id"), F.col("text")
    record = F.struct("text", F.md5("text").alias("content_hash"), F.lit(1).alias("source_version"))
    advice = F.struct(
        F.when(i % 5 == 0, "other").otherwise(rt.CONTRACT).alias("contract"), F.lit(rt.PROVENANCE).alias("provenance"), F.when(i % 7 == 0, "old").otherwise(F.md5("text")).alias("content_hash"),
        F.when(i % 11 == 0, 2).otherwise(1).alias("source_version"), F.when(i % 13 == 0, F.lit("x")).otherwise(F.sha2(F.encode(text, "UTF-8"), 256)).alias("text_sha256"), F.col("signals"),
    )
    return own.select("id", "text", F.coalesce(rt.trusted_lines(record, advice), F.array().cast("array<string>")).alias("lines"))


@query("r02_trusted_advice", f"{RECORD_SQL} SELECT id, lines FROM advised")
def r02(spark, d):
    """What analysis may be quoted: of this contract, content, version and text, with its evidence at its place."""
    return advised(spark, d).select("id", "lines")


def chunk_records(spark, d):
    """Campaigns as records to be indexed; those whose number is that of a document have its text behind their own."""
    docs = frame(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("more"))
    own = advised(spark, d).join(docs, "id", "left")
    rate = F.format_string("product_type: %s", F.col("f.product_type"))
    fields = F.array_compact(F.array(F.when(F.col("f.product_type").isNotNull(), rate), F.when(F.col("f.term_months").isNotNull(), F.format_string("term_months: %d MONTH", F.col("f.term_months")))))
    shaped = own.withColumn("f", v.prd_fields("text", ["product_type", "term_months"]))
    return shaped.select("id", F.concat(F.lit("Kampanya "), F.col("id").cast("string")).alias("title"), F.lit("").alias("bank"), F.concat_ws(" ", "text", "more").alias("content"), fields.alias("fields"), F.col("lines").alias("advice"))


_low_text = "replace(lower(replace(text, 'İ', 'i')), 'i̇', 'i')"
_product = PRODUCT.replace("contains(low,", f"contains({_low_text},")


@query("r01_chunks")
def r01(spark, d):
    """Every chunk of campaigns and the documents behind them: overviews, windows of content, fields with advice.  Windows are beyond SQL."""
    return rt.campaign_chunks(chunk_records(spark, d))


@query("r01_field_chunks", f"""{RECORD_SQL}, f AS (SELECT a.id, a.text, a.lines, concat_ws(' ', a.text, d.text) AS content, list_filter([CASE WHEN {_product.replace("text", "a.text")} IS NOT NULL THEN concat('product_type: ', {_product.replace("text", "a.text")}) END, CASE WHEN regexp_matches(a.text, '(?i)(?:^|[^0-9])([0-9]{{1,3}})\\s*ay\\s*vade') THEN concat('term_months: ', regexp_extract(a.text, '(?i)(?:^|[^0-9])([0-9]{{1,3}})\\s*ay\\s*vade', 1)::INT, ' MONTH') END], lambda x: x IS NOT NULL) AS fields
    FROM advised a LEFT JOIN documents d ON d.doc_id = a.id),
x AS (SELECT id, fields, concat('Başlık: Kampanya ', id) AS header, trim(content) AS content, concat_ws(chr(10), CASE WHEN len(fields) > 0 THEN concat('{rt.FIELDS}', array_to_string(fields, '; ')) END, CASE WHEN len(lines) > 0 THEN concat('NLP danışmanlık sinyalleri (otoriter filtre değildir):', chr(10), array_to_string(lines, chr(10))) END) AS extra FROM f),
w AS (SELECT *, concat_ws(chr(10), header, nullif(content, ''), nullif(extra, '')) AS whole FROM x), n AS (SELECT *, len(regexp_extract_all(whole, '\\S+')) AS words FROM w)
SELECT id, 'overview' AS section, sha256(whole) AS index_hash FROM n WHERE words <= 320
UNION ALL SELECT id, CASE WHEN len(fields) > 0 THEN 'structured_fields' ELSE 'nlp_advisory' END, sha256(concat_ws(chr(10), header, extra)) FROM n WHERE words > 320 AND extra <> ''""")
def r01_fields(spark, d):
    """Overviews of short campaigns, and the chunk of fields and advice of long ones, by their hashes."""
    return rt.campaign_chunks(chunk_records(spark, d)).where("section <> 'content'").select("id", "section", "index_hash")


@query("r04_page_windows")
def r04(spark, d):
    return rt.chunk(frame(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), 450, 50, 0.65, 24, ".!?:;")


EDGES_SQL = """SELECT concat('s', CAST(l_suppkey AS VARCHAR(20))) AS source, concat('p', CAST(l_partkey % 500 AS VARCHAR(20))) AS target, CASE WHEN l_returnflag = 'R' THEN 'related' ELSE 'part_of' END AS relation, 1 - l_discount * 4 AS confidence FROM {lineitem}"""
EDGES = f"edges AS ({EDGES_SQL.replace('{lineitem}', 'lineitem')}), good AS (SELECT * FROM edges WHERE confidence >= 0.8), adj AS (SELECT source, target, relation, confidence FROM good UNION SELECT target, source, relation, confidence FROM good), simple AS (SELECT source, target, max(confidence) AS confidence FROM adj GROUP BY 1, 2)"


def edges(spark, d):
    return spark.sql(EDGES_SQL, lineitem=frame(spark, d, "lineitem"))


@query("j10_adjacency", f"WITH {EDGES} SELECT source, count(*) AS n, round(max(confidence), 6) AS best FROM adj GROUP BY 1")
def j10(spark, d):
    return rt.adjacency(edges(spark, d)).groupBy("source").agg(F.count("*").alias("n"), F.round(F.max("confidence"), 6).alias("best"))


@query("f13_sure_edges", f"WITH {EDGES} SELECT relation, count(*) AS n FROM good GROUP BY 1")
def f13(spark, d):
    return edges(spark, d).where((F.col("confidence") >= rt.MIN_CONFIDENCE) & (F.col("source") != "") & (F.col("target") != "")).groupBy("relation").agg(F.count("*").alias("n"))


HOPS = f"""WITH {EDGES}, one AS (SELECT s.source AS seed, s.target AS node, s.confidence AS score FROM simple s WHERE s.source IN ('s1', 's2', 's3', 's50')),
two AS (SELECT o.seed, s.target AS node, max(o.score * s.confidence) AS score FROM one o JOIN simple s ON s.source = o.node GROUP BY 1, 2),
every AS (SELECT seed, node, 1 AS hop, score FROM one UNION ALL SELECT seed, node, 2, score FROM two WHERE node <> seed),
best AS (SELECT seed, node, min(hop) AS hop, arg_min(score, hop) AS score FROM every GROUP BY 1, 2)
"""


@query("j11_two_hops", HOPS + "SELECT seed, node, hop::INT AS hop, round(score, 6) AS score FROM best QUALIFY row_number() OVER (PARTITION BY seed ORDER BY hop, score DESC, node) <= 50")
def j11(spark, d):
    return rt.expand(edges(spark, d), spark.createDataFrame([("s1",), ("s2",), ("s3",), ("s50",)], "node string"), 2, 50)


@query("t09_neighbour_order", HOPS + "SELECT seed, node FROM best WHERE hop = 1 QUALIFY row_number() OVER (PARTITION BY seed ORDER BY score DESC, node) <= 5")
def t09(spark, d):
    return rt.expand(edges(spark, d), spark.createDataFrame([("s1",), ("s2",), ("s3",), ("s50",)], "node string"), 1, 5).select("seed", "node")


@query("j12_documents_of_terms", HOPS + "SELECT seed, p_partkey AS id FROM (SELECT seed, node FROM best WHERE hop = 1 QUALIFY row_number() OVER (PARTITION BY seed ORDER BY score DESC, node) <= 5) JOIN part ON node = concat('p', p_partkey % 500)")
def j12(spark, d):
    terms = rt.expand(edges(spark, d), spark.createDataFrame([("s1",), ("s2",), ("s3",), ("s50",)], "node string"), 1, 5)
    own = frame(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("p"), (F.col("p_partkey") % 500).cast("string")).alias("node"))
    return own.join(terms, "node").select("seed", "id")


@query("r09_graph_ranking", HOPS + """, kept AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY seed ORDER BY hop, score DESC, node) <= 50),
d AS (SELECT seed, p_partkey AS id, min(hop) AS hop, arg_min(score, hop) AS score FROM kept JOIN part ON node = concat('p', p_partkey % 500) GROUP BY 1, 2)
SELECT seed, id, row_number() OVER (PARTITION BY seed ORDER BY hop, round(score, 6) DESC, id) AS rank FROM d QUALIFY rank <= 20""")
def r09(spark, d):
    """The documents that a seed's graph reaches: nearest first, then surest, twenty of each seed."""
    from pyspark.sql import Window

    reached = rt.expand(edges(spark, d), spark.createDataFrame([("s1",), ("s2",), ("s3",), ("s50",)], "node string"), 2, 50)
    own = frame(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("p"), (F.col("p_partkey") % 500).cast("string")).alias("node"))
    best = own.join(reached, "node").groupBy("seed", "id").agg(F.min("hop").alias("hop"), F.min_by("score", "hop").alias("score"))
    rank = F.row_number().over(Window.partitionBy("seed").orderBy("hop", F.desc("score"), "id"))
    return best.select("seed", "id", rank.cast("long").alias("rank")).where("rank <= 20")


ALIASES = [("of the", 1), ("the", 1), ("thing", 2), ("was", 3), ("ou", 4), ("la", 5), ("que", 6), ("ein", 7), ("with", 8)]


@query("r12_term_finder", f"""WITH aliases(surface, term_id) AS (VALUES {", ".join(map(str, ALIASES))}), hits AS (SELECT doc_id AS id, term_id::INT AS term_id, surface FROM documents JOIN aliases ON length(surface) >= 3 AND contains(concat(' ', array_to_string({TOK}, ' '), ' '), concat(' ', surface, ' '))),
once AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY id, term_id ORDER BY length(surface) DESC, surface) = 1) SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(surface) DESC, surface) <= 3""")
def r12(spark, d):
    aliases = spark.createDataFrame(ALIASES, "surface string, term_id int")
    return rt.find_terms(frame(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), aliases, 3)


@query("r07_query_expansion", f"""WITH {EDGES}, aliases(surface, term_id) AS (VALUES {", ".join(map(str, ALIASES))}), hits AS (SELECT item_id AS id, term_id, surface FROM benchmark JOIN aliases ON length(surface) >= 3 AND contains(concat(' ', array_to_string({TOK}, ' '), ' '), concat(' ', surface, ' '))),
once AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY id, term_id ORDER BY length(surface) DESC, surface) = 1), terms AS (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(surface) DESC, surface) <= 8),
near AS (SELECT source, target, round(confidence, 6) AS score FROM simple QUALIFY row_number() OVER (PARTITION BY source ORDER BY confidence DESC, target) <= 3),
names AS (SELECT id, string_agg(surface, ' ' ORDER BY length(surface) DESC, surface) AS t FROM terms GROUP BY 1),
nodes AS (SELECT id, target, row_number() OVER (PARTITION BY id ORDER BY n DESC, surface, score DESC, target) AS k FROM (SELECT id, target, length(surface) AS n, surface, score FROM terms JOIN near ON source = concat('s', term_id) QUALIFY row_number() OVER (PARTITION BY id, target ORDER BY length(surface) DESC, surface, score DESC) = 1))
SELECT b.item_id AS id, concat_ws(' ', b.text, t, g) AS expanded FROM benchmark b LEFT JOIN names ON names.id = b.item_id LEFT JOIN (SELECT id, string_agg(target, ' ' ORDER BY k) AS g FROM nodes WHERE k <= 3 GROUP BY 1) n ON n.id = b.item_id""")
def r07(spark, d):
    """Questions with the terms found in them, and those terms' surest neighbours in the graph."""
    aliases = spark.createDataFrame(ALIASES, "surface string, term_id int")
    nodes = aliases.select("term_id", F.concat(F.lit("s"), F.col("term_id").cast("string")).alias("node")).distinct()
    questions = frame(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return rt.expanded_queries(questions, aliases, edges(spark, d), nodes, 8, 3).select("id", "expanded")


@query("r11_backend_cascade", BM25 + f""", aliases(surface, term_id) AS (VALUES {", ".join(map(str, ALIASES))}), told AS (SELECT item_id AS id, concat(' ', array_to_string({TOK}, ' '), ' ') AS x FROM benchmark), said AS (SELECT doc_id AS id, concat(' ', array_to_string({TOK}, ' '), ' ') AS x FROM documents),
tq AS (SELECT DISTINCT id, term_id FROM told JOIN aliases ON length(surface) >= 3 AND contains(x, concat(' ', surface, ' '))), td AS (SELECT DISTINCT id, term_id FROM said JOIN aliases ON length(surface) >= 3 AND contains(x, concat(' ', surface, ' '))),
graph AS (SELECT tq.id AS query_id, td.id AS key, row_number() OVER (PARTITION BY tq.id ORDER BY count(*) DESC, td.id) AS rank FROM tq JOIN td USING (term_id) GROUP BY 1, 2 QUALIFY rank <= 20),
pairs AS (SELECT q.vec_id AS query_id, v.vec_id AS key, q.label, round(greatest(0.0, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id IN (SELECT query_id FROM asked) AND q.vec_id <> v.vec_id AND q.label = v.label AND q.label < 4),
vector AS (SELECT query_id, key, label, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM pairs QUALIFY rank <= 15),
lists AS (SELECT query_id, key, rank, 60 AS c FROM vector UNION ALL SELECT query_id, id, rank, 60 FROM lexical UNION ALL SELECT query_id, key, rank, 10 FROM graph),
fused AS (SELECT query_id, key, round(sum(1.0::DOUBLE / (c + rank)), 6) AS score FROM lists GROUP BY 1, 2), best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key)::INT AS rank FROM fused QUALIFY rank <= 5),
named AS (SELECT query_id, CASE WHEN query_id IN (SELECT query_id FROM graph) THEN '+knowledge-graph' ELSE '' END AS g, (SELECT any_value(label) FROM vector v WHERE v.query_id = asked.query_id) AS label FROM asked)
SELECT n.query_id, CASE WHEN label < 2 THEN concat('remote+bm25', g) WHEN label < 4 THEN concat('local+bm25', g) WHEN g <> '' OR n.query_id IN (SELECT query_id FROM lexical) THEN concat('bm25', g, '-fallback') ELSE 'none' END AS backend, key, score, rank FROM named n LEFT JOIN best USING (query_id)""")
def r11(spark, d):
    """Answers of the first backend that has any: vectors of two labels are remote, of two others local, the rest falls back."""
    from pyspark.sql import Window

    embedded, questions = frame(spark, d, "embeddings"), asked(spark, d)
    vectors = {}
    for name, labels in (("remote", (0, 1)), ("local", (2, 3))):
        found = None
        for label in labels:
            own = embedded.where(F.col("label") == label)
            q = own.join(questions.select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
            near = rt.nearest(own.select("vec_id", "embedding"), q, 15).select("query_id", F.col("vec_id").alias("key"), "rank")
            found = near if found is None else found.unionByName(near)
        vectors[name] = found
    lexical = rt.bm25(every(spark, d), questions, 20).select("query_id", F.col("id").alias("key"), "rank")
    aliases = spark.createDataFrame(ALIASES, "surface string, term_id int")
    terms = lambda df: rt.find_terms(df, aliases, len(ALIASES)).select("id", "term_id")
    shared = terms(questions.select(F.col("query_id").alias("id"), F.col("query").alias("text"))).withColumnRenamed("id", "query_id").join(terms(every(spark, d)).withColumnRenamed("id", "key"), "term_id").groupBy("query_id", "key").agg(F.count("*").alias("n"))
    graph = shared.select("query_id", "key", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "key")).alias("rank")).where("rank <= 20")
    return ranking.cascade(questions, vectors, lexical, graph, 5)


@query("j08_topic_terms", "SELECT event_type AS topic, list_sort(list(DISTINCT user_id % 7)) AS term_ids FROM events GROUP BY 1")
def j08(spark, d):
    return frame(spark, d, "events").groupBy(F.col("event_type").alias("topic")).agg(F.array_sort(F.collect_set(F.col("user_id") % 7)).alias("term_ids"))


@query("j09_manifest_check", "SELECT doc_id AS id, CASE WHEN doc_id % 9 = 0 THEN 'unknown' WHEN doc_id % 10 = 0 THEN 'hash' WHEN doc_id % 13 = 0 THEN 'page' END AS reason FROM documents WHERE doc_id % 9 = 0 OR doc_id % 10 = 0 OR doc_id % 13 = 0")
def j09(spark, d):
    own = frame(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("document_id"), F.md5("text").alias("md"))
    chunks = own.select("id", "document_id", F.when(F.col("id") % 10 == 0, F.lit("x")).otherwise(F.col("md")).alias("sha"), F.when(F.col("id") % 13 == 0, 99).otherwise(3).alias("page"))
    return rt.page_range_violations(chunks, own.where("id % 9 <> 0").select("document_id", F.col("md").alias("sha"), F.lit(5).alias("pages")))


PREDICTED = "SELECT doc_id, quality AS gold, CASE WHEN regexp_matches(text, '[%&$#*|!]{2,}|[|]') THEN 0 ELSE 1 END AS predicted FROM documents JOIN labels USING (doc_id)"


def predicted(spark, d):
    rule = F.when(F.col("text").rlike(r"[%&$#*|!]{2,}|[|]"), 0).otherwise(1)
    return frame(spark, d, "documents").join(frame(spark, d, "labels"), "doc_id").select("doc_id", F.col("quality").alias("gold"), rule.alias("predicted"))


SCORES = f"""WITH pairs AS ({PREDICTED}), counted AS (SELECT label, count(*) FILTER (gold = label AND predicted = label) AS tp, count(*) FILTER (gold <> label AND predicted = label) AS fp, count(*) FILTER (gold = label) AS support FROM pairs, (VALUES (0), (1)) l(label) GROUP BY 1),
by_label AS (SELECT label, support, CASE WHEN tp + fp = 0 THEN 0.0 ELSE round(tp / (tp + fp), 6) END AS precision, CASE WHEN support = 0 THEN 0.0 ELSE round(tp / support, 6) END AS recall, round(2 * tp / (tp + fp + support), 6) AS f1 FROM counted)
"""


@query("a19_class_scores", SCORES + "SELECT * FROM by_label")
def a19(spark, d):
    return ev.classification(predicted(spark, d))


@query("a19_overall_scores", SCORES + "SELECT round(sum(recall * support) / sum(support), 4) AS accuracy, round(avg(f1), 4) AS macro_f1, round(sum(f1 * support) / sum(support), 4) AS weighted_f1 FROM by_label")
def a19b(spark, d):
    return ev.overall(predicted(spark, d))


@query("a19_confusion", f"WITH pairs AS ({PREDICTED}) SELECT gold, predicted, count(*) AS n FROM pairs GROUP BY 1, 2")
def a19c(spark, d):
    return ev.confusion(predicted(spark, d))


@query("a20_multilabel_scores", """WITH rows AS (SELECT list_filter(['a', CASE WHEN user_id % 2 = 0 THEN 'b' END, CASE WHEN event_type = 'view' THEN 'c' END], lambda x: x IS NOT NULL) AS gold, list_filter(['a', CASE WHEN user_id % 3 = 0 THEN 'b' END, CASE WHEN value < 30 THEN 'c' END], lambda x: x IS NOT NULL) AS predicted FROM events),
counted AS (SELECT l, count(*) FILTER (list_contains(gold, l) AND list_contains(predicted, l)) AS tp, count(*) FILTER (NOT list_contains(gold, l) AND list_contains(predicted, l)) AS fp, count(*) FILTER (list_contains(gold, l) AND NOT list_contains(predicted, l)) AS fn FROM rows, (VALUES ('a'), ('b'), ('c')) x(l) GROUP BY 1)
SELECT round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1, round(avg(round(2 * tp / (2 * tp + fp + fn), 6)), 4) AS macro_f1, (SELECT round(avg((gold = predicted)::INT), 6) FROM rows) AS exact FROM counted""")
def a20(spark, d):
    e = frame(spark, d, "events")
    some = lambda *c: F.array_compact(F.array(F.lit("a"), *c))
    rows = e.select(some(F.when(F.col("user_id") % 2 == 0, "b"), F.when(F.col("event_type") == "view", "c")).alias("gold"), some(F.when(F.col("user_id") % 3 == 0, "b"), F.when(F.col("value") < 30, "c")).alias("predicted"))
    return ev.multilabel(rows)


@query("a21_span_scores", """WITH g AS (SELECT DISTINCT event_id AS doc, user_id AS s, event_type AS label FROM events WHERE event_id % 3 <> 0), p AS (SELECT DISTINCT event_id AS doc, user_id + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS s, event_type AS label FROM events WHERE event_id % 4 <> 0),
b AS (SELECT coalesce(g.label, p.label) AS label, count(*) FILTER (g.doc IS NOT NULL AND p.doc IS NOT NULL) AS tp, count(g.doc) AS g, count(p.doc) AS p FROM g FULL JOIN p ON g.doc = p.doc AND g.s = p.s AND g.label = p.label GROUP BY 1)
SELECT label, round(tp / p, 6) AS precision, round(tp / g, 6) AS recall, round(2 * tp / (g + p), 6) AS f1 FROM b""")
def a21(spark, d):
    e = frame(spark, d, "events")
    gold = e.where("event_id % 3 <> 0").select(F.col("event_id").alias("doc"), F.col("user_id").alias("start"), (F.col("user_id") + 5).alias("end"), F.col("event_type").alias("label"))
    moved = F.col("user_id") + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    found = e.where("event_id % 4 <> 0").select(F.col("event_id").alias("doc"), moved.alias("start"), (moved + 5).alias("end"), F.col("event_type").alias("label"))
    return ev.spans(gold, found)


@query("a22_calibration_error", """WITH r AS (SELECT (event_id % 101) / 100 AS c, (user_id % 3 = 0)::INT AS ok FROM events), b AS (SELECT bin, count(*) AS n, avg(c) AS c, avg(ok) AS a FROM r JOIN (SELECT unnest(range(10)) AS bin) ON c BETWEEN bin / 10 AND (bin + 1) / 10 GROUP BY 1)
SELECT round(sum(abs(a - c) * n / (SELECT count(*) FROM r)), 6) AS ece FROM b""")
def a22(spark, d):
    e = frame(spark, d, "events")
    return ev.calibration_error(e.select(((F.col("event_id") % 101) / 100).alias("confidence"), (F.col("user_id") % 3 == 0).alias("correct")))


@query("a23_routing_scores", """WITH r AS (SELECT CASE WHEN turn = 0 THEN 'sql' ELSE 'rag' END AS expected, CASE WHEN length(text) < 400 THEN 'sql' ELSE 'rag' END AS route FROM conversations)
SELECT round(avg((expected = route)::INT), 6) AS route_accuracy, round(count(*) FILTER (expected = 'sql' AND route = 'sql') / nullif(count(*) FILTER (route = 'sql'), 0), 6) AS sql_precision FROM r""")
def a23(spark, d):
    r = frame(spark, d, "conversations").select(F.when(F.col("turn") == 0, "sql").otherwise("rag").alias("expected"), F.when(F.length("text") < 400, "sql").otherwise("rag").alias("route"))
    hit, sql = F.col("expected") == F.col("route"), F.col("route") == "sql"
    return r.agg(F.round(F.avg(hit.cast("double")), 6).alias("route_accuracy"), F.round(F.sum((hit & sql).cast("long")) / F.nullif(F.sum(sql.cast("long")), F.lit(0)), 6).alias("sql_precision"))


@query("a25_score_slices", """SELECT s AS slice, round(avg(value), 6) AS score FROM (VALUES ('view'), ('click'), ('human')) x(s) LEFT JOIN events ON event_type = s GROUP BY 1""")
def a25(spark, d):
    """A slice without rows has no score."""
    slices = spark.createDataFrame([("view",), ("click",), ("human",)], "slice string")
    per = frame(spark, d, "events").groupBy(F.col("event_type").alias("slice")).agg(F.round(F.avg("value"), 6).alias("score"))
    return slices.join(per, "slice", "left")


@query("a27_split_counters", "SELECT 'event_type' AS dimension, event_type AS value, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'parity', CASE WHEN user_id % 2 = 0 THEN 'even' ELSE '-' END, count(*) FROM events GROUP BY 2")
def a27(spark, d):
    return ev.counters(frame(spark, d, "events").select("event_type", F.when(F.col("user_id") % 2 == 0, "even").alias("parity")), ["event_type", "parity"])


@query("a28_answer_confidence", "SELECT user_id, round(0.45 * avg((value > 20)::INT) + 0.45 * avg((event_type <> 'error')::INT) + 0.10 * least(1.0, count(*) / 5), 6) AS confidence FROM events GROUP BY 1")
def a28(spark, d):
    typed, evidence = F.avg((F.col("value") > 20).cast("double")), F.avg((F.col("event_type") != "error").cast("double"))
    return frame(spark, d, "events").groupBy("user_id").agg(F.round(0.45 * typed + 0.45 * evidence + 0.10 * F.least(F.lit(1.0), F.count("*") / 5), 6).alias("confidence"))


@query("a29_annotation_progress", "SELECT count(*) AS total, count(*) FILTER (quality = 1) AS approved, count(*) FILTER (quality = 0) AS pending FROM labels")
def a29(spark, d):
    q = F.col("quality")
    return frame(spark, d, "labels").agg(F.count("*").alias("total"), F.sum((q == 1).cast("long")).alias("approved"), F.sum((q == 0).cast("long")).alias("pending"))


#: Dimensions of events, as expressions of both engines.
DIMENSIONS = {"provider": "concat('p', CAST(user_id % 4 AS VARCHAR(4)))", "circuit_state": "CASE user_id % 7 WHEN 0 THEN 'open' WHEN 1 THEN 'half-open' ELSE 'closed' END", "fallback_reason": "CASE WHEN user_id % 11 = 0 THEN 'timeout' WHEN user_id % 13 = 0 THEN 'quota' END", "action": "CASE WHEN value > 100 THEN 'ANSWER' ELSE 'CLARIFY' END"}


@query("a11_event_summary", f"""WITH e AS (SELECT event_type AS event, value, user_id % 10 = 0 AS failed, {", ".join(f"{x} AS {k}" for k, x in DIMENSIONS.items())} FROM events),
c AS (SELECT event, field, value, count(*) AS n FROM ({" UNION ALL ".join(f"SELECT event, '{k}' AS field, {k} AS value FROM e WHERE {k} IS NOT NULL" for k in DIMENSIONS)}) GROUP BY 1, 2, 3),
d AS (SELECT event, list_sort(list(concat(field, '=', value, ': ', n))) AS dimensions FROM c GROUP BY 1)
SELECT event, count(*) AS n, sum(failed::INT)::BIGINT AS errors, round(avg(failed::INT), 4) AS error_rate, round(quantile_disc(value, 0.5), 3) AS p50, round(quantile_disc(value, 0.95), 3) AS p95, any_value(dimensions) AS dimensions FROM e JOIN d USING (event) GROUP BY event""")
def a11(spark, d):
    """Counts, failures, latencies and what every dimension's values come to."""
    own = frame(spark, d, "events").select(F.col("event_type").alias("event"), F.col("value").alias("latency"), (F.col("user_id") % 10 == 0).alias("failed"), *(F.expr(x).alias(k) for k, x in DIMENSIONS.items()))
    return ev.event_summary(own, list(DIMENSIONS))


FILLED = ["title", "start_date", "end_date", "summary", "source_url"]
EXPECTED = ["src0", "src1", "src2", "a bank without records"]


@query("a09_coverage", sql_with(""", own AS (SELECT bank_slug, count(*) AS records, count(*) FILTER (record_kind <> 'product') AS campaigns, count(*) FILTER (record_kind = 'product') AS products, """ + ", ".join(f"round(avg((trim(coalesce({c}, '')) <> '')::INT), 4) AS {c}_rate" for c in FILLED) + f""" FROM records WHERE bank_slug <> '' GROUP BY 1),
expected AS (SELECT unnest({EXPECTED}) AS bank_slug)
SELECT coalesce(o.bank_slug, e.bank_slug) AS bank_slug, e.bank_slug IS NOT NULL AS expected, """ + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("records", "campaigns", "products", *(f"{c}_rate" for c in FILLED))) + " FROM own o FULL JOIN expected e ON o.bank_slug = e.bank_slug", "records"))
def a09(spark, d):
    """Counts and fill rates of every bank, also of expected ones without records."""
    expected = spark.createDataFrame([(x,) for x in EXPECTED], "bank_slug string")
    return ev.bank_coverage(frame(spark, d, "records"), expected, FILLED)


RULES_SQL = r"""list_filter([CASE WHEN bank_slug = '' THEN 'error:bank_slug' END, CASE WHEN bank_name IS NULL THEN 'error:bank_name' END, CASE WHEN length(coalesce(title, '')) < 5 THEN 'error:title' END, CASE WHEN length(coalesce(content, '')) < 80 THEN 'error:content_length' END,
    CASE WHEN regexp_matches(content, '<!--|</?\s*[A-Za-z][A-Za-z0-9]*(\s[^>]*|/)?>') THEN 'error:content_tags' END, CASE WHEN NOT regexp_matches(source_url, '^https://[^/?#]') THEN 'error:source_url' END,
    CASE WHEN start_date > end_date THEN 'error:date_order' END, CASE WHEN start_date IS NULL OR end_date IS NULL THEN 'warning:date_range' END, CASE WHEN coalesce(summary, '') = '' THEN 'warning:summary' END, CASE WHEN length(summary) > 500 THEN 'warning:summary_length' END,
    CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'error:id' END, CASE WHEN count(*) OVER (PARTITION BY source_url) > 1 THEN 'error:source_url_repeated' END], lambda x: x IS NOT NULL)"""


@query("f19_record_issues", sql_with(f"SELECT id, {RULES_SQL} AS issues FROM records", "records"))
def f19(spark, d):
    return ev.record_issues(frame(spark, d, "records")).select("id", F.transform("issues", lambda x: F.concat_ws(":", x["severity"], x["field"])).alias("issues"))


@query("a10_quality_report", sql_with(f""", c AS (SELECT {RULES_SQL} AS issues FROM records), n AS (SELECT len(list_filter(issues, lambda x: starts_with(x, 'error'))) AS e, len(list_filter(issues, lambda x: starts_with(x, 'warning'))) AS w, len(list_filter(issues, lambda x: x IN ('error:id', 'error:source_url_repeated'))) AS r FROM c)
SELECT count(*) AS records, count(*) FILTER (e > 0) AS rejected, sum(e)::BIGINT AS errors, sum(w)::BIGINT AS warnings, sum(r)::BIGINT AS repeated, count(*) FILTER (e = 0) AS valid, round(1 - count(*) FILTER (e > 0) / count(*), 4) AS score FROM n""", "records"))
def a10(spark, d):
    return ev.quality_report(ev.record_issues(frame(spark, d, "records")))


#: The statuses of all core fields as SQL over the notices.
STATUSES = {
    "profit_share_rate": f"CASE WHEN len({SHARES}) > 1 THEN 'CONFLICT' WHEN len({SHARES}) = 1 THEN 'EXPLICIT' WHEN {PRODUCT} IN ('card', 'shopping_points', 'new_customer') THEN 'NOT_APPLICABLE' WHEN contains(low, 'avantajlı oran') THEN 'IMPLICIT' WHEN regexp_matches(low, 'k[aâ]r payı|oran') THEN 'EXTRACTION_FAILED' ELSE 'NOT_STATED' END",
    "product_type": rf"CASE WHEN {PRODUCT} = 'financing' AND NOT regexp_matches(low, 'finansman[ıi]?(?:$|[^\p{{L}}\p{{N}}_])') OR {PRODUCT} = 'shopping_points' AND NOT regexp_matches(low, 'al[ıi][şs]veri[şs] puanı|alisveris puan|worldpuan|parafpara') THEN 'IMPLICIT' WHEN {PRODUCT} IS NOT NULL THEN 'EXPLICIT' ELSE 'NOT_STATED' END",
    "financing_amount": f"CASE WHEN {MOST} <> '' THEN 'EXPLICIT' WHEN {PRODUCT} IN ('card', 'shopping_points', 'new_customer') THEN 'NOT_APPLICABLE' ELSE 'NOT_STATED' END",
    "installment_count": f"CASE WHEN regexp_matches(text, '[0-9]\\s*taksit') THEN 'EXPLICIT' WHEN {PRODUCT} = 'investment' THEN 'NOT_APPLICABLE' WHEN contains(low, 'taksit') THEN 'EXTRACTION_FAILED' ELSE 'NOT_STATED' END",
    "financing_type": "CASE WHEN regexp_matches(low, 'konut|taşıt|ihtiyaç') THEN 'EXPLICIT' ELSE 'NOT_STATED' END",
    "term_months": f"CASE WHEN {TERM} IS NOT NULL THEN 'EXPLICIT' WHEN {PRODUCT} IN ('card', 'shopping_points', 'new_customer') THEN 'NOT_APPLICABLE' WHEN contains(low, 'vade') THEN 'EXTRACTION_FAILED' ELSE 'NOT_STATED' END",
    "campaign_benefit": "CASE WHEN regexp_matches(low, 'avantaj|indirim|ödül|iade|masrafsız|ücretsiz|muafiyet|hediye') THEN 'EXPLICIT' ELSE 'NOT_STATED' END",
    "reward_amount": "CASE WHEN regexp_matches(text, 'harcamaya [0-9]+ TL ödül') THEN 'EXPLICIT' WHEN regexp_matches(low, 'ödül|puan|bonus|iade') THEN 'EXTRACTION_FAILED' ELSE 'NOT_STATED' END",
    "discount_rate": rf"CASE WHEN regexp_matches(text, '%\s*[0-9]+\s*(?:indirim|iade)') THEN 'EXPLICIT' WHEN {PRODUCT} = 'investment' THEN 'NOT_APPLICABLE' WHEN contains(low, 'indirim') THEN 'EXTRACTION_FAILED' ELSE 'NOT_STATED' END",
    "target_audience": f"CASE WHEN {AUDIENCE} IS NOT NULL THEN 'EXPLICIT' WHEN regexp_matches(low, 'müşteri|hedef kitle') THEN 'EXTRACTION_FAILED' ELSE 'NOT_STATED' END",
    "campaign_start_date": "CASE WHEN regexp_matches(low, 'başlangıç|tarih') THEN 'EXTRACTION_FAILED' ELSE 'NOT_STATED' END",
    "campaign_end_date": "CASE WHEN regexp_matches(low, 'bitiş|tarih|kadar') THEN 'EXTRACTION_FAILED' ELSE 'NOT_STATED' END",
    "fee_information": "CASE WHEN contains(low, 'masrafsız') THEN 'EXPLICIT' WHEN regexp_matches(low, 'masraf|ücret|tahsis') THEN 'EXTRACTION_FAILED' ELSE 'NOT_STATED' END",
    "application_channel": "CASE WHEN regexp_matches(text, 'mobil uygulama|İnternet şubesi') THEN 'EXPLICIT' ELSE 'NOT_STATED' END",
    "condition": "CASE WHEN contains(text, 'yaptırma şart') THEN 'EXPLICIT' ELSE 'NOT_STATED' END",
}


@query("a08_field_statuses", B + ", s AS (" + " UNION ALL ".join(f"SELECT '{name}' AS field, {sql} AS status FROM b" for name, sql in STATUSES.items()) + ") SELECT field, status, count(*) AS n FROM s GROUP BY 1, 2")
def a08(spark, d):
    """How often each core field is stated, vague, missing, not to be expected, failed or in conflict."""
    # unfolded, as a projection on top would make a field, and all evidence, anew at each of its uses
    own = told(spark, d, "rate_candidates", *STATUSES, shown=STATUSES).select("text", F.explode(F.array("f")).alias("f"))
    each = v.each_contract(F.col("text"), F.col("f"), list(STATUSES))
    stated = own.select(F.inline(F.array(*(F.struct(F.lit(name).alias("field"), c["status"].alias("status")) for name, c in each.items()))))
    return stated.groupBy("field", "status").agg(F.count("*").alias("n"))


@query("a30_repeated_margins", r"""WITH p AS (SELECT source AS document, doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents), own AS (SELECT * FROM p WHERE len(l) > 0),
k AS (SELECT document, doc_id, unnest(list_distinct(list_transform(list_concat(l[1:2], l[-2:]), lambda x: lower(trim(regexp_replace(x, '\s+', ' ', 'g')))))) AS line FROM own), t AS (SELECT document, count(*) AS pages FROM own GROUP BY 1)
SELECT document, line, count(*) AS n FROM k JOIN t USING (document) WHERE length(line) >= 4 GROUP BY document, line, pages HAVING count(*) >= greatest(3, floor(0.35 * pages))""")
def a30(spark, d):
    """Lines at the edges of a third of the pages and more of a source."""
    return ev.repeated_margins(frame(spark, d, "documents").select(F.col("source").alias("document"), F.col("doc_id").alias("page"), "text"))


@query("a31_extraction_totals", "SELECT lang, count(*) AS documents, sum(length(text))::BIGINT AS characters FROM documents GROUP BY ROLLUP (lang)")
def a31(spark, d):
    return frame(spark, d, "documents").rollup("lang").agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("characters"))


@query("a32_weak_label_status", f"""{SPANS_SQL} SELECT id, coalesce(list_min(list_transform(kept, lambda x: x.confidence)), 0.0) AS confidence, len(kept) > 1 AND list_min(list_transform(kept, lambda x: x.confidence)) >= 0.9 AS eligible FROM k""")
def a32(spark, d):
    """A text's weak labels are as sure as the least of its entities; texts of one entity or none need a look."""
    own = campaigns(spark, d).select("id", spans.weak_spans(F.col("text")).alias("s"))
    least = F.coalesce(F.array_min(F.transform("s", lambda x: x["confidence"])), F.lit(0.0))
    return own.select("id", least.alias("confidence"), ((F.size("s") > 1) & (least >= 0.9)).alias("eligible"))


#: What is measured, and the least that is wanted of it.
TARGETS = {"quality": 0.8, "harmless": 0.8, "labelled": 0.2}


@query("a33_targets", f"""WITH k AS (SELECT avg(quality) AS quality, 1 - avg(toxic) AS harmless, count(l.doc_id) / (SELECT count(*) FROM documents) AS labelled, count(*) FILTER (l.doc_id % 17 = 0) AS synthetic FROM labels l),
t AS (SELECT unnest({list(TARGETS)}) AS kpi, unnest([quality, harmless, labelled]) AS value, unnest({list(TARGETS.values())}) AS target, synthetic FROM k)
SELECT kpi, round(value, 6) AS value, target::DOUBLE AS target, value >= target AS passed, bool_and(value >= target) OVER () AS all_passed, synthetic > 0 AS synthetic FROM t""")
def a33(spark, d):
    """Measures of the labels against their targets, and whether synthetic rows are among them."""
    total = frame(spark, d, "documents").agg(F.count("*").alias("total"))
    k = frame(spark, d, "labels").agg(F.avg("quality").alias("quality"), (1 - F.avg("toxic")).alias("harmless"), F.count("doc_id").alias("n"), F.sum((F.col("doc_id") % 17 == 0).cast("long")).alias("synthetic"))
    return ev.kpi_report(k.crossJoin(total).withColumn("labelled", F.col("n") / F.col("total")), TARGETS)  # one row each


@query("a35_split_leakage", "SELECT md5(text) AS family, count(DISTINCT doc_id % 3) AS splits FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id % 3) > 1")
def a35(spark, d):
    return ev.leakage(frame(spark, d, "documents").select(F.md5("text").alias("family"), (F.col("doc_id") % 3).alias("split")), "family", "split")


@query("a36_rate_conflicts", sql_with("SELECT bank_id, term_months, CASE WHEN count(DISTINCT rate) = 1 THEN min(rate) END AS rate, list_sort(list(DISTINCT rate)) AS candidates FROM offers WHERE rate IS NOT NULL GROUP BY 1, 2", "offers"))
def a36(spark, d):
    g = frame(spark, d, "offers").where("rate is not null").groupBy("bank_id", "term_months").agg(F.array_sort(F.collect_set("rate")).alias("candidates"))
    return g.select("bank_id", "term_months", F.when(F.size("candidates") == 1, F.col("candidates")[0]).alias("rate"), "candidates")
