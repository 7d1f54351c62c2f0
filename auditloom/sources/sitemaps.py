"""Sitemaps from raw documents: candidates by rank, indexes that fan out to their children, addresses in order.

Candidates of a site are the addresses that its robots.txt declares, then /sitemap.xml; the first that answers 200 is its
sitemap, whether it can be read or not. An index's children follow in its order, each with its own, in rounds of joins; a document
counts where it comes first, so indexes that point at each other end. Documents whose status isn't 200 or that aren't XML have no addresses.

Limits that a crawl of few pages sets (3 candidates, 5 children of an index, 5000 addresses of a site, no index below an
index) are options; by default everything counts. Native. Repeated rows of a document count once (of several bodies the
smallest text); null statuses are 0, null bodies empty; addresses listed twice stay twice.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.operators import robots as rules
from auditloom.tables import numbered, written

DEFAULT = "/sitemap.xml"


class Sitemaps(NamedTuple):
    """sitemaps: site, source, status, found, is_xml, valid. urls: site, order (from 1), url, source (the document that lists it)."""

    sitemaps: DataFrame
    urls: DataFrame


def declared(robots: DataFrame) -> DataFrame:
    """site, pos, url of the sitemaps that robots.txt (site, status, content_type, body) declares."""
    return rules.directives(robots).where("key = 'sitemap' and value != ''").select("site", F.col("line").alias("pos"), F.col("value").alias("url"))


def locs(documents: DataFrame) -> DataFrame:
    """documents with is_xml, is_index and locs: the loc of every url, or of every sitemap of an index, in whatever namespace prefix their parent has. Comments don't count."""
    body = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("body", F.lit("")), "^[\\s﻿]+", ""), "(?s)<!--.*?-->", ""))
    xml = body.rlike(r"(?i)^(<\?xml|<([\w.-]+:)?urlset|<([\w.-]+:)?sitemapindex)") & ~F.left(body, F.lit(500)).rlike("(?i)<html")
    index = body.rlike(r"<([\w.-]+:)?sitemapindex[\s>]")
    of = lambda name: F.regexp_extract_all(body, F.lit(rf"(?s)<((?:[\w.-]+:)?){name}(?:\s[^>]*)?>.*?<\1loc(?:\s[^>]*)?>\s*(.*?)\s*</\1loc\s*>"), F.lit(2))

    def plain(x):
        bare = F.regexp_replace(x, r"(?s)^<!\[CDATA\[\s*(.*?)\s*\]\]>$", "$1")
        for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#38;", "&"), ("&amp;", "&")):
            bare = F.replace(bare, F.lit(name), F.lit(char))
        return bare

    none = F.array().cast("array<string>")
    found = F.filter(F.transform(F.when(index, of("sitemap")).otherwise(of("url")), plain), lambda x: x != "")
    return documents.withColumns({"is_xml": xml, "is_index": xml & index, "locs": F.when(xml, found).otherwise(none)})


def load_sitemaps(documents: DataFrame, origins: DataFrame, robots: DataFrame | None = None, max_candidates: int | None = None, max_children: int | None = None, max_urls: int | None = None, max_depth: int | None = None) -> Sitemaps:
    """documents: site, url, status, body, as they answered; origins: site, origin (https://host, say)."""
    one = documents.groupBy("site", "url").agg(F.min_by(F.struct(F.coalesce("status", F.lit(0)).alias("status"), "body"), F.struct(F.col("status") != 200, F.coalesce("body", F.lit("")))).alias("d"))
    parsed = written(locs(one.select("site", "url", "d.status", "d.body")).drop("body"))
    asked = origins.select("site", F.lit(None).cast("int").alias("pos"), F.concat("origin", F.lit(DEFAULT)).alias("url"))
    if robots is not None:
        asked = declared(robots).join(origins.select("site").distinct(), "site", "left_semi").unionByName(asked)
    # a robots.txt declares few: its size is bounded by what a crawler reads of it
    firsts = asked.groupBy("site", "url").agg(F.min(F.coalesce("pos", F.lit((1 << 31) - 1))).alias("pos"))
    ranked = firsts.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy("pos", "url")))
    if max_candidates is not None:
        ranked = ranked.where(F.col("rank") <= max_candidates)
    met = ranked.join(parsed, ["site", "url"], "left").withColumn("status", F.coalesce("status", F.lit(0)))
    answer = F.struct("rank", "url", "status", "is_xml")
    chosen = met.groupBy("site").agg(F.min(F.when(F.col("status") == 200, answer)).alias("won"), F.max(answer).alias("last"))
    source = F.coalesce("won", "last")
    chosen = written(chosen.select("site", source["url"].alias("source"), source["status"].alias("status"), F.col("won").isNotNull().alias("found"), F.coalesce(F.col("won.is_xml"), F.lit(False)).alias("is_xml")))

    front = chosen.where("is_xml").select("site", F.col("source").alias("url"), F.array().cast("array<int>").alias("way"))
    seen, lists, depth = front, [], 0
    while True:
        docs = front.join(parsed.where("status = 200 and is_xml"), ["site", "url"])
        fans = F.col("is_index") if max_depth is None or depth < max_depth else F.lit(False)
        lists.append(docs.where(~fans).select("site", F.col("url").alias("source"), "way", F.posexplode("locs").alias("pos", "url")))
        children = docs.where(fans).select("site", "way", F.posexplode("locs").alias("pos", "url"))
        if max_children is not None:
            children = children.where(F.col("pos") < max_children)
        below = children.select("site", "url", F.concat("way", F.array("pos")).alias("way")).groupBy("site", "url").agg(F.min("way").alias("way"))
        front, depth = written(below.join(seen, ["site", "url"], "left_anti")), depth + 1
        if front.isEmpty():
            break
        seen = seen.unionByName(front)  # one part for each level of indexes
    listed = lists[0]
    for x in lists[1:]:
        listed = listed.unionByName(x)
    urls = numbered(listed.withColumn("place", F.concat("way", F.array("pos"))).select("site", "place", "url", "source"), "site", "place")
    if max_urls is not None:
        urls = urls.where(F.col("order") <= max_urls)
    urls = written(urls.select("site", "order", "url", "source"))
    valid = chosen.join(urls.select("site").distinct().withColumn("valid", F.lit(True)), "site", "left").withColumn("valid", F.coalesce("valid", F.lit(False)))
    return Sitemaps(valid.select("site", "source", "status", "found", "is_xml", "valid"), urls)
