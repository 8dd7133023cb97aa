"""Scans and sinks: envelopes, strict lines, formats by suffix, pages, links, snapshots."""

from __future__ import annotations

import tempfile
import uuid
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sahaf.functions.text import BLOCK_TAGS


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share; a temporary one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sahaf-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """df written to the work folder and read again: what follows starts there, also when an executor is lost."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of settle() that nothing reads any more."""
    for t in tables:
        at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_at)
        at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows; counting stops there."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def read_envelopes(spark: SparkSession, path: str, record: str) -> DataFrame:
    """The records of JSON envelopes; an envelope without a list of records is an error."""
    found = spark.read.schema(f"schema_version string, records array<struct<{record}>>, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    checked = found.select(F.when(F.col("records").isNull(), F.raise_error(F.lit("an envelope has no records"))).otherwise(F.col("records")).alias("records"))
    return checked.select(F.inline("records"))


def write_envelopes(df: DataFrame, path: str, group: Column, records: int = 10_000) -> None:
    """Envelopes of a group's records, at most about so many in one, committed as a whole.

    A large group is dealt to several envelopes by a hash of its rows, after a count of every group.
    """
    rows = df.withColumn("_g", group)
    sizes = rows.groupBy(F.col("_g").alias("_of")).agg(F.count("*").alias("_n"))  # a row a group
    dealt = rows.join(small(sizes), F.col("_g").eqNullSafe(F.col("_of"))).withColumn("_k", F.pmod(F.xxhash64(*df.columns), F.ceil(F.col("_n") / records)))
    held = dealt.groupBy("_g", "_k").agg(F.collect_list(F.struct(*df.columns)).alias("records"))
    held.select(F.lit("1").alias("schema_version"), "records").write.json(path)


def read_strict_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): objects that lines hold, and the lines that hold none, each with its file and number.

    Files are read in splits like any text; a line's number is its place in its split after the lines of the splits before.
    """
    wanted = spark.createDataFrame([], schema).schema
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("k"))
    splits = lines.groupBy("file", "at").agg(F.min("k").alias("first"), F.count("*").alias("n"))  # a row per split
    before = splits.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("file", "at", "first", "before")
    parsed = lines.where(F.trim("value") != "").withColumn("good", F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False)))
    good = parsed.where("good").select(F.from_json("value", wanted).alias("r")).select("r.*")
    numbered = parsed.where("not good").join(before, ["file", "at"])
    return good, numbered.select("file", (F.col("before") + F.col("k") - F.col("first") + 1).alias("number"), F.col("value").alias("line"))


def read_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of .jsonl, .csv (with a header) or .json by the path's suffix; .json holds a list, or an object with `records` or `campaigns`."""
    name = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if name == "jsonl":
        return spark.read.schema(schema).json(path)
    if name == "csv":
        return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if name == "json":
        row = spark.createDataFrame([], schema).schema
        held = T.StructType([*row.fields, T.StructField("records", T.ArrayType(row)), T.StructField("campaigns", T.ArrayType(row))])
        found = spark.read.schema(held).option("multiLine", True).json(path)
        return found.select(F.explode(F.coalesce("records", "campaigns", F.array(F.struct(*row.fieldNames())))).alias("r")).select("r.*")
    raise ValueError(f"no reader for {path}")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, lines, sha256) of the files under a folder, paths relative to it; names that begin with . or _ and empty files are left out.

    Each file is read as a whole, so one may have 2 GB at most.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    relative = F.substring_index("path", "/" + folder.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    own = files.select(relative.alias("path"), F.col("length").alias("bytes"), F.regexp_count(F.col("content").cast("string"), F.lit("\n")).cast("long").alias("lines"), F.sha2("content", 256).alias("sha256"))
    return own.where(~F.col("path").rlike("(^|/)[._]"))


def manifest_differences(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """(path, difference) of two manifests: missing, unexpected or changed files; no rows if they are equal."""
    both = wanted.select("path", F.col("bytes").alias("b"), F.col("sha256").alias("s")).join(there.select("path", "bytes", "sha256"), "path", "full_outer")
    what = F.when(F.col("sha256").isNull(), "missing").when(F.col("s").isNull(), "unexpected").when((F.col("s") != F.col("sha256")) | (F.col("b") != F.col("bytes")), "changed")
    return both.select("path", what.alias("difference")).where("difference is not null")


def tree_hash(files: DataFrame) -> DataFrame:
    """(tree): one digest of a manifest's sorted paths and digests; a row per file is gathered, so of a release's files, not a corpus'."""
    entries = F.array_sort(F.collect_list(F.concat_ws(" ", "path", "sha256")))
    return files.agg(F.sha2(F.array_join(entries, "\n"), 256).alias("tree"))


class _Page(HTMLParser):
    """Title, headings, metadata, and the text of a page's main part without navigation and the like."""

    UNWANTED = frozenset({"script", "style", "noscript", "template", "nav", "header", "footer", "aside", "form"})
    MAIN = frozenset({"main", "article"})
    OWN_LINE = BLOCK_TAGS

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.meta: dict[str, str] = {}
        self.image: str | None = None
        self.parts: dict[str, list[str]] = {"title": [], "h1": [], "main": [], "body": [], "first": []}
        self.first_closed = False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta" and a.get("content"):
            self.meta.setdefault((a.get("name") or a.get("property") or "").lower(), a["content"])
        if tag == "img" and self.image is None and self.within(self.MAIN):
            self.image = a.get("src") or a.get("data-src")
        if tag not in VOID:
            self.open.append(tag)
        self.line(tag)

    def handle_endtag(self, tag):
        self.line(tag)
        if tag in self.open:
            while self.open and self.open.pop() != tag:
                pass
        if tag in ("p", "li") and "".join(self.parts["first"]).strip():
            self.first_closed = True

    def line(self, tag):
        if tag in self.OWN_LINE:
            self.parts["main"].append("\n")
            self.parts["body"].append("\n")

    def within(self, tags) -> bool:
        return any(t in tags for t in self.open)

    def handle_data(self, data):
        if "title" in self.open:
            self.parts["title"].append(data)
        elif not self.within(self.UNWANTED):
            if "h1" in self.open:
                self.parts["h1"].append(data)
            self.parts["body"].append(data)
            if self.within(self.MAIN):
                self.parts["main"].append(data)
                if self.within({"p", "li"}) and not self.first_closed:
                    self.parts["first"].append(data)


#: Elements without an end.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def page_record(url: str | None, page: str | None) -> dict[str, str | None]:
    """title (the first heading, else the page's), description (the first paragraph, else the metadata's), content (of main or article, else all), image."""
    reader = _Page()
    reader.feed(page or "")
    reader.close()
    joined = {k: "".join(v) for k, v in reader.parts.items()}
    one = lambda x: " ".join(x.split())
    lines = lambda x: "\n".join(v for v in map(one, x.split("\n")) if v)
    image = reader.meta.get("og:image") or reader.image
    description = one(joined["first"]) or one(reader.meta.get("description") or reader.meta.get("og:description") or "")
    return {"title": one(joined["h1"]) or one(joined["title"]) or one(reader.meta.get("og:title") or "") or None, "description": description[:500] or None, "content": lines(joined["main"]) or lines(joined["body"]) or None, "image": urljoin(url or "", image) if image else None}


def _pages(url: pd.Series, page: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([page_record(u, p) for u, p in zip(url, page, strict=True)], columns=["title", "description", "content", "image"]).astype(object)


def page_fields(url: Column | str, page: Column | str) -> Column:
    """page_record() of pages, as one struct."""
    return F.pandas_udf(_pages, "title string, description string, content string, image string")(url, page)


def absolute(base: Column, link: Column) -> Column:
    """A link as the page at base means it, without its fragment."""
    plain = F.substring_index(F.trim(link), "#", 1)
    origin = F.regexp_extract(base, "^[^:/?#]+://[^/?#]*", 0)
    folder = F.regexp_extract(F.substring_index(F.substring_index(base, "#", 1), "?", 1), "^(.*://[^/]*(?:/.*)?/)[^/]*$|$", 1)
    return F.when(plain.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), plain).when(plain.startswith("//"), F.concat(F.regexp_extract(base, "^[^:/?#]+:", 0), plain)).when(plain.startswith("/"), F.concat(origin, plain)).otherwise(F.concat(F.when(folder != "", folder).otherwise(F.concat(origin, F.lit("/"))), plain))


def page_links(pages: DataFrame, hosts: list[str], path: str) -> DataFrame:
    """(page_id, link): the distinct links of pages (page_id, url, html) to https pages of those hosts whose path has the pattern.

    Links are made absolute and lose their fragment; links to a hub of campaigns, by path or by text, are left out.
    """
    tags = F.regexp_extract_all("html", F.lit(r'(?is)(<a\s[^>]*href\s*=\s*["\']?[^"\'\s>]+[^>]*>.*?</a>)'), F.lit(1))
    found = pages.select("page_id", "url", F.explode(tags).alias("tag")).select("page_id", absolute(F.col("url"), F.regexp_extract("tag", r'(?is)href\s*=\s*["\']?([^"\'\s>]+)', 1)).alias("link"), F.lower(F.trim(F.regexp_replace("tag", "(?s)<[^>]*>", ""))).alias("text"))
    host = F.regexp_replace(F.lower(F.regexp_extract("link", r"^https://(?:[^@/?#]*@)?([^:/?#]*)", 1)), r"\.$", "")
    where = F.regexp_extract("link", "^https://[^/?#]*([^?#]*)", 1)
    hub = F.lower(where).rlike(r"/kampanyalar(\.html)?/?$") | F.col("text").isin("kampanyalar", "tüm kampanyalar")
    return found.where(host.isin([h.lower() for h in hosts]) & where.rlike(path) & ~hub).select("page_id", "link").distinct()


def crawl(links: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(node, depth): what links (source, target) reach from seeds (node), each node at its least depth."""
    found = seeds.select("node", F.lit(0).alias("depth")).distinct()
    frontier = found
    for k in range(1, depth + 1):
        reached = frontier.join(links, F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct()
        frontier = reached.join(found.select("node"), "node", "left_anti").withColumn("depth", F.lit(k))
        found = found.unionByName(frontier)
    return found


def unify(catalogues: dict[str, DataFrame]) -> DataFrame:
    """Catalogues (campaign_key, display_name) by source as one: the first source's name, and all sources, by key."""
    rows = None
    for k, (source, df) in enumerate(catalogues.items()):
        own = df.select("campaign_key", "display_name", F.lit(source).alias("source"), F.lit(k).alias("pos"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("campaign_key").agg(F.min_by("display_name", F.struct("pos", "display_name")).alias("display_name"), F.array_sort(F.collect_set("source")).alias("sources"))


def known_banks(listed: DataFrame, known: DataFrame) -> DataFrame:
    """listed (name, ...) with bank_id and slug of known (bank_id, slug); names are compared trimmed and in lower case, and an
    unknown one stops the job with its name."""
    joined = listed.withColumn("slug", F.lower(F.trim("name"))).join(small(known), "slug", "left")
    checked = F.when(F.col("bank_id").isNull(), F.raise_error(F.concat(F.lit("no known bank: "), F.col("name")))).otherwise(F.col("bank_id"))
    return joined.withColumn("bank_id", checked)


def content_registry(files: DataFrame) -> DataFrame:
    """(digest, name, names) of files (name, content): one entry for each content, its least name in lower case, and how many names it has."""
    digests = files.select(F.sha2("content", 256).alias("digest"), "name")
    return digests.groupBy("digest").agg(F.lower(F.min("name")).alias("name"), F.count("*").alias("names"))


def publish(df: DataFrame, folder: str) -> str:
    """Write a snapshot beside the others, then point to it; readers of last_good() never see half of one."""
    path = f"{folder}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    df.sparkSession.createDataFrame([(path,)], "path string").coalesce(1).write.mode("overwrite").json(f"{folder}/current")
    return path


def last_good(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(spark.read.schema("path string").json(f"{folder}/current").first()["path"])
