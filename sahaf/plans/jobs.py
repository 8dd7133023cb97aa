"""Source, stream and dataset queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sahaf.operators import learning as le
from sahaf.operators import scan
from sahaf.sources import io, store
from sahaf.streaming import jobs as st

from .decisions import HISTORY
from .registry import query
from .tables import frame, sql_with


@query("s01_envelope_scan", "SELECT doc_id, quality, toxic FROM labels")
def s01(spark, d):
    path = io.work_folder(spark, "envelopes")
    io.write_envelopes(frame(spark, d, "labels"), path, F.floor(F.col("doc_id") / 1000))
    return io.read_envelopes(spark, path, "doc_id: bigint, quality: int, toxic: int")


@query("s02_json_sink", "SELECT vec_id, label FROM embeddings")
def s02(spark, d):
    path = io.work_folder(spark, "json")
    frame(spark, d, "embeddings").select("vec_id", "label").write.mode("overwrite").json(path)
    return spark.read.schema("vec_id long, label int").json(path)


@query("s03_store", sql_with("SELECT id, bank_id, title, product_type, rate, CAST(NULL AS VARCHAR) AS financing_type FROM campaigns", "campaigns"))
def s03(spark, d):
    """A store is laid out and filled; a column that the rows lack is null."""
    path = io.work_folder(spark, "store")
    store.open_store(spark, path)
    store.append(frame(spark, d, "campaigns").select("id", "bank_id", "title", "product_type", "rate"), path, "campaigns")
    return store.open_store(spark, path)["campaigns"].select("id", "bank_id", "title", "product_type", "rate", "financing_type")


@query("s20_guarded_save", "SELECT step, saved, bytes FROM (VALUES ('new', true, (SELECT count(*) FROM nation)), ('stale', false, (SELECT count(*) FROM nation)), ('current', true, 2 * (SELECT count(*) FROM nation))) t(step, saved, bytes)")
def s20(spark, d):
    """A file is replaced only by a writer that knows what it holds now."""
    path, n = io.work_folder(spark, "notes") + "/notes.txt", frame(spark, d, "nation").count()
    first = store.save(spark, path, b"x" * n, None)
    rows = [("new", True, n)]
    for step, expected in (("stale", "0" * 64), ("current", first)):
        try:
            store.save(spark, path, b"y" * 2 * n, expected)
            saved = True
        except store.Changed:
            saved = False
        rows.append((step, saved, spark.read.format("binaryFile").load(path).select("length").first()["length"]))
    return spark.createDataFrame(rows, "step string, saved boolean, bytes long")


@query("s24_command_line", "SELECT count(*) AS banks, count(*) AS stored FROM nation")
def s24(spark, d):
    """A store that the command line lays out and loads."""
    from sahaf.__main__ import main

    path = io.work_folder(spark, "cli")
    main(["db", "load", path, "--tables", d], spark)
    stored = store.open_store(spark, path)["banks"].agg(F.count("*").alias("stored"))
    return frame(spark, d, "banks").agg(F.count("*").alias("banks")).crossJoin(F.broadcast(stored))


@query("r14_file_cache", "SELECT step, hit, n FROM (VALUES ('first', false, (SELECT count(*) FROM benchmark)), ('again', true, (SELECT count(*) FROM benchmark)), ('changed', false, 2 * (SELECT count(*) FROM benchmark))) t(step, hit, n)")
def r14(spark, d):
    """A corpus is read again only after its files have changed."""
    path, own = io.work_folder(spark, "corpus"), frame(spark, d, "benchmark")
    own.write.parquet(path)
    cache, rows = store.FileCache(spark, lambda s, p: s.read.parquet(p).count()), []
    for step in ("first", "again", "changed"):
        if step == "changed":
            own.write.mode("append").parquet(path)
        n, hit = cache.get(path)
        rows.append((step, hit, n))
    return spark.createDataFrame(rows, "step string, hit boolean, n long")


@query("st09_recent_keys", """WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER w AS pos, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT a.event_id, a.before IS NOT NULL AND (SELECT count(DISTINCT b.event_type) FROM e b WHERE b.user_id = a.user_id AND b.event_id > a.before AND b.event_id < a.event_id) < 2 AS hit FROM e a""")
def st09(spark, d):
    """Whether a cache of each user's two last kinds of event holds the next one."""
    own = frame(spark, d, "events").select("user_id", "event_id", "event_type")
    kinds = sorted(r["event_type"] for r in own.select("event_type").where("event_type is not null").distinct().collect())  # a handful
    return scan.recent(own, ["user_id"], ["event_id"], "event_type", kinds, 2).select("event_id", "hit")


@query("s04_strict_lines", "SELECT 'good' AS kind, count(*) AS n FROM labels WHERE doc_id % 10 <> 0 UNION ALL SELECT 'bad', count(*) FROM labels WHERE doc_id % 10 = 0")
def s04(spark, d):
    path = io.work_folder(spark, "lines")
    line = F.when(F.col("doc_id") % 10 == 0, F.lit("[1, 2")).otherwise(F.to_json(F.struct("doc_id", "quality")))
    frame(spark, d, "labels").select(line.alias("value")).write.text(path)
    good, bad = io.read_strict_lines(spark, path, "doc_id long, quality int")
    return good.agg(F.count("*").alias("n")).select(F.lit("good").alias("kind"), "n").unionByName(bad.agg(F.count("*").alias("n")).select(F.lit("bad").alias("kind"), "n"))


@query("s05_formats", "SELECT item_id, text FROM benchmark")
def s05(spark, d):
    """A third of the rows by each format."""
    own, out = frame(spark, d, "benchmark"), None
    for k, kind in enumerate(("jsonl", "csv", "json")):
        path, part = f"{io.work_folder(spark, kind)}.{kind}", own.where(F.col("item_id") % 3 == k)
        if kind == "csv":
            part.write.option("header", True).option("escape", '"').csv(path)
        elif kind == "json":
            io.write_envelopes(part, path, F.lit(0))
        else:
            part.write.json(path)
        rows = io.read_any(spark, path, "item_id long, text string")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("s06_page_fields", "SELECT page_id, trim(regexp_extract(html, '<html lang=\"(\\w+)\"', 1)) AS lang, len(regexp_extract_all(html, '<p>'))::INT AS paragraphs FROM pages")
def s06(spark, d):
    return frame(spark, d, "pages").select("page_id", F.regexp_extract("html", r'<html lang="(\w+)"', 1).alias("lang"), F.regexp_count("html", F.lit("<p>")).alias("paragraphs"))


@query("s06_page_records")
def s06b(spark, d):
    return frame(spark, d, "pages").select("page_id", io.page_fields("url", "html").alias("f")).select("page_id", "f.*")


HOSTS = ["example.com", "blog.tionble.example.com"]


@query("s07_page_links", r"""WITH p AS (SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN 'https://example.com/list/a?x#y' ELSE 'https://blog.tionble.example.com/' END AS base, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]+)"[^>]*>.*?</a>', 1)) AS href FROM pages),
a AS (SELECT page_id, CASE WHEN starts_with(href, '/') THEN regexp_extract(base, '^https://[^/]*') || href WHEN contains(href, ':') THEN href ELSE regexp_extract(split_part(base, '?', 1), '^https://.*/') || href END AS link FROM (SELECT page_id, base, split_part(href, '#', 1) AS href FROM p))
SELECT DISTINCT page_id, link FROM a WHERE regexp_matches(link, '^https://(example\.com|blog\.tionble\.example\.com)/[^?]*[a-m]')""")
def s07(spark, d):
    """Links of pages that stand at two allowed hosts, to paths that hold one of half the letters."""
    own = frame(spark, d, "pages").withColumn("url", F.when(F.col("page_id") % 2 == 0, "https://example.com/list/a?x#y").otherwise("https://blog.tionble.example.com/"))
    return io.page_links(own, HOSTS, "^/.*[a-m]")


CRAWL = "links AS (SELECT DISTINCT user_id AS source, (user_id * 7 + length(event_type)) % 150 AS target FROM events)"


@query("s08_hub_crawl", f"WITH {CRAWL}, one AS (SELECT DISTINCT target AS node FROM links WHERE source IN (1, 2)), two AS (SELECT DISTINCT target AS node FROM links WHERE source IN (SELECT node FROM one)), every AS (SELECT unnest([1, 2])::BIGINT AS node, 0 AS depth UNION ALL SELECT node, 1 FROM one UNION ALL SELECT node, 2 FROM two) SELECT node, min(depth)::INT AS depth FROM every GROUP BY 1")
def s08(spark, d):
    links = frame(spark, d, "events").select(F.col("user_id").alias("source"), ((F.col("user_id") * 7 + F.length("event_type")) % 150).alias("target")).distinct()
    return io.crawl(links, spark.createDataFrame([(1,), (2,)], "node long"), 2)


@query("s11_known_banks", "SELECT n_nationkey AS bank_id, lower(trim(n_name)) AS slug, count(s_suppkey) AS branches FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2")
def s11(spark, d):
    """Banks that the register's page lists, by their known names; an unknown one would stop the job."""
    listed = frame(spark, d, "supplier").join(frame(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit(" "), F.upper("n_name"), F.lit(" ")).alias("name"))
    known = frame(spark, d, "nation").select(F.col("n_nationkey").alias("bank_id"), F.lower(F.trim("n_name")).alias("slug"))
    return io.known_banks(listed, known).groupBy("bank_id", "slug").agg(F.count("*").alias("branches"))


@query("s13_content_registry", "SELECT sha256(text) AS digest, lower(min(concat(source, '/', lang, '-', doc_id, '.TXT'))) AS name, count(*) AS names FROM documents WHERE text IS NOT NULL GROUP BY 1")
def s13(spark, d):
    """Documents as files: one entry for each content, under its first name."""
    files = frame(spark, d, "documents").where("text is not null").select(F.concat("source", F.lit("/"), "lang", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".TXT")).alias("name"), F.encode("text", "UTF-8").alias("content"))
    return io.content_registry(files)


@query("s15_unified_catalogue", "SELECT n_name AS campaign_key, coalesce(min(s_name), min(c_name), n_name) AS display_name, list_filter([CASE WHEN count(s_suppkey) > 0 THEN 'suppliers' END, CASE WHEN count(c_custkey) > 0 THEN 'customers' END, 'nations'], lambda x: x IS NOT NULL).list_sort() AS sources FROM nation LEFT JOIN (SELECT s_nationkey, min(s_name) AS s_name, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey LEFT JOIN (SELECT c_nationkey, min(c_name) AS c_name, min(c_custkey) AS c_custkey FROM customer WHERE c_acctbal > 9900 GROUP BY 1) ON c_nationkey = n_nationkey GROUP BY n_name")
def s15(spark, d):
    """Three catalogues by nation: suppliers, customers of high balance, and the nations themselves."""
    nations = frame(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("campaign_key"))
    by = lambda t, key, name: frame(spark, d, t).join(nations, F.col(key) == F.col("n_nationkey")).groupBy("campaign_key").agg(F.min(name).alias("display_name"))
    rich = frame(spark, d, "customer").where("c_acctbal > 9900").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("campaign_key").agg(F.min("c_name").alias("display_name"))
    return io.unify({"suppliers": by("supplier", "s_nationkey", "s_name"), "customers": rich, "nations": nations.select("campaign_key", F.col("campaign_key").alias("display_name"))})


@query("s17_trace_log", "SELECT event_id FROM events WHERE event_type = 'view' AND event_id % 2 = 0 OR event_type = 'view' AND event_id % 2 = 1")
def s17(spark, d):
    """Appended in two runs; readers keep the approved rows."""
    path, e = io.work_folder(spark, "traces"), frame(spark, d, "events")
    for k in (0, 1):
        e.where(F.col("event_id") % 2 == k).select("event_id", F.when(F.col("event_type") == "view", "approved").otherwise("open").alias("status")).write.mode("append").json(path)
    return spark.read.schema("event_id long, status string").json(path).where("status = 'approved'").select("event_id")


@query("s18_export", sql_with("SELECT id, title FROM products", "products"))
def s18(spark, d):
    path = io.work_folder(spark, "export")
    frame(spark, d, "products").select("id", "title").orderBy("id").write.json(path)
    return spark.read.schema("id long, title string").json(path)


@query("s19_all_records", sql_with("SELECT record_kind, count(*) AS n FROM (SELECT record_kind FROM campaigns UNION ALL SELECT record_kind FROM products) GROUP BY 1", "campaigns", "products"))
def s19(spark, d):
    from sahaf.operators.catalogue import records

    return records(frame(spark, d, "campaigns"), frame(spark, d, "products")).groupBy("record_kind").agg(F.count("*").alias("n"))


@query("s21_last_good_snapshot", "SELECT r_regionkey, r_name FROM region")
def s21(spark, d):
    folder = io.work_folder(spark, "snapshots")
    io.publish(frame(spark, d, "nation"), folder)
    io.publish(frame(spark, d, "region"), folder)
    return io.last_good(spark, folder)


LISTED = "SELECT source, string_agg(doc_id, chr(10) ORDER BY doc_id) || chr(10) AS body, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1"


def listed(spark, d):
    """A file for each source with its doc_ids, and the manifest of those files."""
    folder = io.work_folder(spark, "release")
    own = frame(spark, d, "documents").where("source is not null").select("source", "doc_id").repartition("source").sortWithinPartitions("source", "doc_id")
    own.select(F.col("doc_id").cast("string").alias("value"), "source").write.partitionBy("source").text(folder)
    return io.manifest(spark, folder)


@query("s25_dataset_manifest", f"SELECT source, strlen(body) AS bytes, n AS lines, sha256(body) AS sha256 FROM ({LISTED})")
def s25(spark, d):
    return listed(spark, d).select(F.regexp_extract("path", "source=([^/]*)", 1).alias("source"), "bytes", "lines", "sha256")


@query("s26_listed_options", """SELECT page_id, len(list_filter(regexp_extract_all(html, '<li><a href="/([^"]*)"', 1), lambda v: lower(v) IN ('the', 'and', 'to', 'de', 'la', 'die', 'der')))::INT AS n FROM pages""")
def s26(spark, d):
    """Options whose code is defined."""
    codes = spark.createDataFrame([(c,) for c in ("the", "and", "to", "de", "la", "die", "der")], "code string")
    found = frame(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<li><a href="/([^"]*)"'), F.lit(1))).alias("v")).select("page_id", F.lower("v").alias("code"))
    n = found.join(F.broadcast(codes), "code").groupBy("page_id").agg(F.count("*").cast("int").alias("n"))
    return frame(spark, d, "pages").select("page_id").join(n, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("st01_stream_versions", sql_with(HISTORY + "SELECT record_id, source_version, content_hash, valid_from, occurrence_count, last_seen_at FROM versions WHERE is_current", "observations"))
def st01(spark, d):
    """The observations as a stream of files in order of time; the state holds each record's current version."""
    folder = io.work_folder(spark, "observations")
    own = frame(spark, d, "observations")
    own.write.parquet(f"{folder}/in")
    return st.current_versions(st.source(spark, f"{folder}/in", own, 1000))


@query("s14_last_good_quotes", """WITH e AS (SELECT user_id % 25 AS provider, event_id, ts, event_type <> 'error' AS ok, value FROM events), w AS (SELECT *, last_value(CASE WHEN ok THEN value END IGNORE NULLS) OVER p AS held, last_value(CASE WHEN ok THEN ts END IGNORE NULLS) OVER p AS at FROM e
    WINDOW p AS (PARTITION BY provider ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT provider, event_id, CASE WHEN ok THEN 'live' WHEN ts - w.at <= INTERVAL '15' MINUTE THEN 'last-good' ELSE 'unavailable' END AS status, CASE WHEN ok THEN value WHEN ts - w.at <= INTERVAL '15' MINUTE THEN held END AS value FROM w""")
def s14(spark, d):
    """Snapshots of sources that fail at times, as a stream: the last good quote stands in for a quarter of an hour."""
    folder = io.work_folder(spark, "snapshots")
    own = frame(spark, d, "events").select((F.col("user_id") % 25).alias("provider"), "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"), "value")
    own.write.parquet(f"{folder}/in")
    quotes = st.run_to_parquet(st.last_good(st.source(spark, f"{folder}/in", own, 1000)), "append", "quotes")
    return quotes.select("provider", "event_id", "status", "value")


@query("st02_ring_buffer", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 2000")
def st02(spark, d):
    return st.ring(frame(spark, d, "events")).select("event_id")


@query("st02_hourly_stream", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE date_trunc('hour', ts) + INTERVAL '1' HOUR <= (SELECT max(ts) FROM events) - INTERVAL '1' HOUR GROUP BY 1, 2")
def st02b(spark, d):
    """Windows that the watermark has closed."""
    folder = io.work_folder(spark, "events")
    own = frame(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    own.write.parquet(f"{folder}/in")
    return st.run_to_parquet(st.hourly(st.source(spark, f"{folder}/in", own, 1000)), "append", "hourly")


@query("st03_circuit_breaker", """WITH RECURSIVE e AS MATERIALIZED (SELECT provider, event_id, sec, ok, row_number() OVER (PARTITION BY provider ORDER BY sec, event_id) AS k FROM (SELECT user_id % 10 AS provider, event_id, floor(epoch(ts))::BIGINT AS sec, event_type <> 'error' AS ok FROM events)),
w AS (SELECT provider, 0::BIGINT AS k, NULL::BIGINT AS event_id, '' AS state, 0 AS bad, NULL::BIGINT AS opened FROM (SELECT DISTINCT provider FROM e)
    UNION ALL SELECT provider, k, event_id, state, CASE WHEN state = 'open' THEN bad WHEN ok THEN 0 ELSE bad + 1 END, CASE WHEN state = 'open' THEN opened WHEN ok THEN NULL WHEN state = 'half-open' OR bad + 1 >= 2 THEN sec END
    FROM (SELECT e.provider, e.k, e.event_id, e.sec, e.ok, w.bad, w.opened, CASE WHEN w.opened IS NULL THEN 'closed' WHEN e.sec - w.opened >= 3600 THEN 'half-open' ELSE 'open' END AS state FROM w JOIN e ON e.provider = w.provider AND e.k = w.k + 1))
SELECT provider, event_id, state, state <> 'open' AS allowed FROM w WHERE k > 0""")
def st03(spark, d):
    e = frame(spark, d, "events").select((F.col("user_id") % 10).alias("provider"), "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), (F.col("event_type") != "error").alias("ok"))
    return st.breaker(e, 2, 3600)


@query("st05_rising_sequences", """WITH e AS (SELECT user_id AS stream, event_id // 2 AS event_id, (event_id * 7919) % 1000 AS sequence, event_id AS pos FROM events), once AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY stream, event_id ORDER BY pos) = 1),
b AS (SELECT *, max(sequence) OVER (PARTITION BY stream ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM once) SELECT stream, pos, sequence FROM b WHERE before IS NULL OR sequence > before""")
def st05(spark, d):
    e = frame(spark, d, "events").select(F.col("user_id").alias("stream"), F.floor(F.col("event_id") / 2).alias("event_id"), ((F.col("event_id") * 7919) % 1000).alias("sequence"), F.col("event_id").alias("pos"))
    return st.rising(e).select("stream", "pos", "sequence")


@query("st06_fresh_cache", "SELECT user_id, max_by(event_id, ts) AS event_id FROM events WHERE TIMESTAMP '2024-01-20 12:00:00' - ts < INTERVAL '15' MINUTE AND ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1")
def st06(spark, d):
    now = F.lit("2024-01-20 12:00:00").cast("timestamp")
    return frame(spark, d, "events").where((F.col("ts") > now - F.expr("INTERVAL 15 MINUTES")) & (F.col("ts") <= now)).groupBy("user_id").agg(F.max_by("event_id", "ts").alias("event_id"))


@query("st10_pending_work", "SELECT doc_id FROM documents WHERE NOT (doc_id % 3 = 0 AND doc_id % 4 <> 0)")
def st10(spark, d):
    """What isn't done, or was done for another content."""
    own = frame(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    done = own.where("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "old").otherwise(F.col("h")).alias("h"))
    return own.join(done, ["doc_id", "h"], "left_anti").select("doc_id")


@query("l01_text_classifier")
def l01(spark, d):
    own = frame(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("label"))
    model = le.text_classifier(own.join(frame(spark, d, "labels").select("doc_id"), "doc_id").where("doc_id % 5 <> 0"))
    return model.transform(own.where("doc_id % 5 = 0")).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("prediction") == F.col("target")).cast("double")), 4).alias("accuracy"))


@query("l02_label_heads")
def l02(spark, d):
    """Heads for two labels; a third, which is the same everywhere, gets none."""
    own = frame(spark, d, "documents").select("doc_id", "text").join(frame(spark, d, "labels"), "doc_id").withColumn("same", F.lit(1))
    model = le.label_heads(own.where("doc_id % 5 <> 0"), ["quality", "toxic", "same"])
    scored = le.predict_labels(model, own.where("doc_id % 5 = 0"))
    hit = [F.round(F.avg((F.col(c) == F.col(f"{c}_predicted")).cast("double")), 4).alias(f"{c}_accuracy") for c in ("quality", "toxic")]
    return scored.agg(F.count("*").alias("n"), *hit)


@query("l05_stratified_holdout", "SELECT quality, floor(count(*) * 20 / 100)::BIGINT AS held FROM labels GROUP BY 1")
def l05(spark, d):
    return le.holdout(frame(spark, d, "labels"), "doc_id", "quality").groupBy("quality").agg(F.sum(F.col("holdout").cast("long")).alias("held"))


@query("l06_unified_splits", "SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'train' WHEN source IN ('src1', 'src2') THEN 'test' ELSE 'validation' END AS split FROM documents")
def l06(spark, d):
    rows = frame(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("family"), (F.col("doc_id") % 5 == 0).alias("synthetic"))
    known = spark.createDataFrame([("src1", "test"), ("src2", "test")], "family string, split string")
    return le.unified_splits(rows, known, F.lit("validation")).select("id", "split")


@query("j15_split_lookup", "SELECT family, split, count(*) AS n FROM (SELECT source AS family, CASE WHEN source = 'src1' THEN 'test' ELSE 'train' END AS split FROM documents) GROUP BY 1, 2")
def j15(spark, d):
    rows = frame(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("family"), F.lit(False).alias("synthetic"))
    return le.unified_splits(rows, spark.createDataFrame([("src1", "test")], "family string, split string"), F.lit("train")).groupBy("family", "split").agg(F.count("*").alias("n"))


@query("j14_paired_predictions", "SELECT count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS both_sides, count(*) FILTER (b.doc_id IS NULL) AS left_only, count(*) FILTER (a.doc_id IS NULL) AS right_only FROM (SELECT doc_id FROM labels WHERE quality = 1) a FULL JOIN (SELECT doc_id FROM labels WHERE toxic = 1 OR doc_id % 2 = 0) b ON a.doc_id = b.doc_id")
def j14(spark, d):
    lab = frame(spark, d, "labels")
    a, b = lab.where("quality = 1").select("doc_id", F.lit(1).alias("a")), lab.where("toxic = 1 or doc_id % 2 = 0").select("doc_id", F.lit(1).alias("b"))
    return a.join(b, "doc_id", "full_outer").agg(F.count(F.expr("a + b")).alias("both_sides"), F.count(F.when(F.col("b").isNull(), 1)).alias("left_only"), F.count(F.when(F.col("a").isNull(), 1)).alias("right_only"))


@query("j16_grounded_rows", "SELECT d.doc_id, coalesce(l.quality, -1) AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.toxic = 0")
def j16(spark, d):
    good = frame(spark, d, "labels").where("toxic = 0").select("doc_id", "quality")
    return frame(spark, d, "documents").join(good, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("label"))


@query("l07_provenance", "SELECT doc_id, CASE WHEN quality = 1 AND doc_id % 2 = 0 THEN 'human' WHEN doc_id % 3 = 0 THEN 'synthetic' WHEN doc_id % 5 <> 0 THEN 'auto' ELSE 'excluded' END AS provenance FROM labels")
def l07(spark, d):
    i = F.col("doc_id")
    status = F.when(i % 5 != 0, "auto").otherwise("draft")
    return frame(spark, d, "labels").select("doc_id", le.provenance((F.col("quality") == 1) & (i % 2 == 0), i % 3 == 0, status).alias("provenance"))


@query("l10_annotation_states", """WITH e AS (SELECT user_id AS item, event_id AS seq, CASE WHEN event_type IN ('view', 'click') THEN 'submit' WHEN event_type = 'purchase' THEN 'approve' ELSE 'reject' END AS action, event_id % 3 AS who FROM events),
a AS (SELECT *, last_value(CASE WHEN action = 'submit' THEN who END IGNORE NULLS) OVER (PARTITION BY item ORDER BY seq) AS author FROM e) SELECT item, max_by(action, seq) AS state, count(*) AS events FROM a WHERE action = 'submit' OR (author IS NOT NULL AND who <> author) GROUP BY 1""")
def l10(spark, d):
    action = F.when(F.col("event_type").isin("view", "click"), "submit").when(F.col("event_type") == "purchase", "approve").otherwise("reject")
    return le.annotation_state(frame(spark, d, "events").select(F.col("user_id").alias("item"), F.col("event_id").alias("seq"), action.alias("action"), (F.col("event_id") % 3).alias("who")))


@query("l11_manifest_errors", "SELECT source AS file, CASE WHEN source = 'src1' THEN 'lines' ELSE 'digest' END AS error FROM (SELECT DISTINCT source FROM documents WHERE source IN ('src1', 'src2'))")
def l11(spark, d):
    rows = frame(spark, d, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("pos"), F.md5("text").alias("digest"))
    good = rows.groupBy("file").agg(F.count("*").alias("lines"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda v: v["digest"]), ""), 256).alias("digest"))
    claimed = good.select("file", F.when(F.col("file") == "src1", F.col("lines") + 1).otherwise(F.col("lines")).alias("lines"), F.when(F.col("file") == "src2", "x").otherwise(F.col("digest")).alias("digest"))
    return le.manifest_errors(claimed, rows)


@query("l12_tree_hash", f"SELECT sha256(string_agg(concat('source=', source, ' ', sha256(body)), chr(10) ORDER BY source)) AS tree FROM ({LISTED})")
def l12(spark, d):
    """One digest of a folder's sorted paths and their files' digests."""
    files = listed(spark, d)
    return io.tree_hash(files.select(F.substring_index("path", "/", 1).alias("path"), "sha256"))
