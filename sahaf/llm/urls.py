"""URL rules with redirect equivalence: a blocked url takes the pages that lead to it, or that it leads to, along."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


CANONICAL = r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH_URL = r"(?i)\burl\s*=\s*['\"]?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    rest = F.regexp_replace(url, r"^(?s:.*?)://", "")
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(F.regexp_replace(url, r"^(?s:.*?)://", ""), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def with_rule(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds rule and ruled, the verdict of the longest rule that fits host and path; null if none does.

    A rule fits its host and every subdomain if path begins with the rule's.  Of equally long rules the one with the
    longer host wins, then allow.
    """
    out = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), len(r.host), r.verdict == "allow")):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out, verdict = F.when(fits, r.host + r.path).otherwise(out), F.when(fits, r.verdict).otherwise(verdict)
    return df.withColumns({"rule": out, "ruled": verdict})


def key_of(url: Column) -> Column:
    """What names a url in links: host, path and query, without scheme and fragment."""
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), query))


def links(pages: DataFrame) -> DataFrame:
    """(url, target): where canonical links and refreshes of pages lead, as absolute urls."""
    tag = lambda pattern: F.regexp_extract("html", pattern, 0)
    found = pages.where(F.col("html").rlike("(?i)canonical|http-equiv")).select("url", F.explode(F.array(F.regexp_extract(tag(CANONICAL), HREF, 1), F.regexp_extract(tag(REFRESH), REFRESH_URL, 1))).alias("to")).where("to <> ''")
    site = F.regexp_extract("url", r"^(?s:.*?)://[^/?#]*", 0)
    target = F.when(F.col("to").contains("://"), F.col("to")).when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).when(F.col("to").startswith("/"), F.concat(site, "to")).otherwise(F.concat(F.regexp_extract("url", r"^(?s:.*?)://[^?#]*/", 0), "to"))
    return found.select("url", target.alias("target"))


def judge(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url, html).

    A page that a rule fits has the rule's verdict: an explicit allow stands whatever its aliases are.  Any other page
    is blocked if a url that a rule blocks is in its component of the links: canonical and refresh links of pages, and
    redirects (url, target) if given.  Everything else is allowed.  A null url, or one without ://, has an empty host
    and path and no aliases.  Repeated rows are judged alike; an empty table gives no rows.
    """
    own = with_rule(pages.select("page_id", F.col("url"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), key_of(F.col("url")).alias("key")), rules)
    found = links(pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")))
    if redirects is not None:
        found = found.unionByName(redirects.select("url", "target"))
    keyed = found.select(key_of(F.col("url")).alias("a"), key_of(F.col("target")).alias("b"), "url", "target").where("a is not null and b is not null and a <> b")
    edges = common.materialize(keyed, "links")
    members = connected_components(edges.select("a", "b"))
    urls = edges.select(F.col("a").alias("node"), "url").unionByName(edges.select(F.col("b").alias("node"), F.col("target").alias("url"))).dropDuplicates(["node"])
    known = with_rule(urls.select("node", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    blocked = members.join(known.where("ruled = 'block'").select("node"), "node", "left_semi").select("component").distinct()
    taken = members.join(blocked, "component", "left_semi").select(F.col("node").alias("key"), F.lit("block").alias("alias"))
    open_, ruled = own.where("ruled is null and key is not null"), own.where("ruled is not null or key is null")
    rest = open_.join(taken, "key", "left").select("page_id", "host", "path", "rule", F.coalesce("alias", F.lit("allow")).alias("verdict"))
    return ruled.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict")).unionByName(rest)
