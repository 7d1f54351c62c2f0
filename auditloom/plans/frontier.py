"""Which stored pages a crawl with a budget would take, and in which order.

A crawl keeps two queues for a site. It starts at the home page; what a page links to, in the order of its links, goes to the end of
the first queue; addresses of the sitemap that the home page doesn't link to make up the second, which is only asked while the
first is empty. An address enters a queue once, and only if it has the home page's host, isn't a file, and robots.txt lets
the bot have it. Pages that don't open are passed over; they cost nothing and their links don't count.

That order needs no queue. Each address outside of the sitemap belongs to the first start (home, then the sitemap's addresses in order)
from which links lead to it, and among those of a start a first-in-first-out queue takes the smaller number of links first, then the
one whose way (the positions of the links on it) is first in lexicographic order. So a page's place is the least
(start, links, way) of all ways to it, and rounds of joins lower these until nothing changes. A frontier holds what a
round has lowered. With a budget of N pages for a site, a page that N others precede can never come back, nor can what it links
to precede it: so the frontier and the table of what is seen keep N rows of a site, and rounds end after N at most.

Native. Repeated rows of a page count once; pages with a null site or url take no part; a site without a home page has no plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.urls import is_file
from auditloom.operators import robots as rules
from auditloom.tables import numbered, removed, written

_PLACE = "struct<start:array<long>,depth:int,way:array<int>,round:int>"


def canonical_key(url: Column) -> Column:
    """Without its fragment; an empty path is /."""
    bare = F.regexp_replace(url, "#.*$", "")
    return F.regexp_replace(bare, r"^([^/?#]+://[^/?#]*)(?=\?|$)", "$1/")


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"://([^/?#:]*)", 1))


def openable(addresses: DataFrame, homes: DataFrame, robots: DataFrame | None = None, bot: str = "*", url: str = "url") -> DataFrame:
    """The addresses (site, url and more) of their home page's host that aren't files and that robots.txt gives to the bot. homes: site, url."""
    hosts = homes.select(F.col("site").alias("__site"), _host(F.col("url")).alias("__host")).distinct()
    kept = addresses.join(hosts, (F.col("site") == F.col("__site")) & (_host(F.col(url)) == F.col("__host"))).where(~is_file(F.col(url))).drop("__site", "__host")
    if robots is None:
        return kept
    path = F.concat(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.regexp_extract(url, r"(\?[^#]*)", 1))
    asked = kept.select("site", F.lit(bot).alias("bot"), path.alias("path")).distinct()
    closed = rules.allowed(robots, asked).where("not allowed").select(F.col("site").alias("__site"), F.col("path").alias("__path"))
    return kept.join(closed, (F.col("site") == F.col("__site")) & (path == F.col("__path")), "left_anti")


def crawl_links(silver: DataFrame, robots: DataFrame | None = None, bot: str = "*", redirects: DataFrame | None = None) -> DataFrame:
    """site, source, target (keys), pos: the first place of each address that a page links to. redirects (site, url, final_url): an address that redirects stands for where it ends."""
    homes = silver.where("is_home").select("site", "url")
    opened = silver.where("is_home or coalesce(status, 200) = 200") if "status" in silver.columns else silver
    links = opened.select("site", canonical_key(F.col("url")).alias("source"), F.posexplode(F.transform("links", lambda x: F.when(x["internal"], x["abs"]))).alias("pos", "abs")).where("abs is not null")
    links = links.select("site", "source", canonical_key(F.col("abs")).alias("target"), "pos")
    if redirects is not None:
        to = redirects.select(F.col("site").alias("__site"), canonical_key(F.col("url")).alias("__from"), canonical_key(F.col("final_url")).alias("__to"))
        links = links.join(to.groupBy("__site", "__from").agg(F.min("__to").alias("__to")), (F.col("site") == F.col("__site")) & (F.col("target") == F.col("__from")), "left").withColumn("target", F.coalesce("__to", "target"))
    first = links.groupBy("site", "source", "target").agg(F.min("pos").alias("pos"))
    return openable(first, homes, robots, bot, "target")


def plan(pages: DataFrame, links: DataFrame, sitemap: DataFrame | None = None, budget: int | None = None) -> DataFrame:
    """site, order, url, depth (links from its start), via (home, link, sitemap).

    pages: site, url (keys), is_home, of what opens; links: crawl_links; sitemap: site, url (keys that openable kept), order. All pages that
    a crawl reaches, or the first `budget` of each site."""
    stored = written(pages.where("site is not null and url is not null").groupBy("site", "url").agg(F.max("is_home").alias("is_home")))
    links = written(links)
    homes = stored.where("is_home").groupBy("site").agg(F.min("url").alias("url"))
    place = lambda start, depth, way, round_: F.struct(start.cast("array<long>").alias("start"), F.lit(depth).cast("int").alias("depth"), way.cast("array<int>").alias("way"), F.lit(round_).cast("int").alias("round"))
    starts = homes.select("site", "url", place(F.array(), 0, F.array(), 0).alias("place"))
    if sitemap is not None:
        linked = links.join(homes.select("site", F.col("url").alias("source")), ["site", "source"]).select("site", F.col("target").alias("url"))
        listed = sitemap.groupBy("site", "url").agg(F.min("order").alias("order")).join(homes.select("site").distinct(), "site", "left_semi")
        own = listed.join(homes, ["site", "url"], "left_anti").join(linked, ["site", "url"], "left_anti")
        starts = starts.unionByName(own.select("site", "url", place(F.array("order"), 0, F.array(), 0).alias("place")))
    starts = written(starts)

    def first(places: DataFrame) -> DataFrame:
        if budget is None:
            return places
        rank = F.row_number().over(Window.partitionBy("site").orderBy("place", "url"))
        return places.withColumn("rank", rank).where(F.col("rank") <= budget).drop("rank")

    seen, round_ = written(first(starts.join(stored, ["site", "url"], "left_semi"))), 0
    while True:
        front, round_ = seen.where(F.col("place.round") == round_), round_ + 1
        if front.isEmpty():
            break
        steps = front.select("site", F.col("url").alias("source"), "place").join(links, ["site", "source"])
        moved = F.struct(F.col("place.start").alias("start"), (F.col("place.depth") + 1).alias("depth"), F.concat("place.way", F.array("pos")).alias("way"), F.lit(round_).alias("round"))
        found = steps.select("site", F.col("target").alias("url"), moved.cast(_PLACE).alias("place")).groupBy("site", "url").agg(F.min("place").alias("place"))
        found = found.join(stored, ["site", "url"], "left_semi").join(starts, ["site", "url"], "left_anti")
        # of equal places the earlier round is the smaller, so what isn't lowered leaves the frontier
        before, seen = seen, written(first(seen.unionByName(found).groupBy("site", "url").agg(F.min("place").alias("place"))))
        removed(before)
    via = F.when(F.col("place.depth") > 0, "link").when(F.size("place.start") > 0, "sitemap").otherwise("home")
    flat = seen.select("site", "url", F.col("place.start").alias("start"), F.col("place.depth").alias("depth"), F.col("place.way").alias("way"), via.alias("via"))
    return numbered(flat, "site", "start", "depth", "way", "url").select("site", "order", "url", "depth", "via")


def crawl_plan(silver: DataFrame, sitemap: DataFrame | None = None, robots: DataFrame | None = None, bot: str = "*", redirects: DataFrame | None = None, budget: int | None = None) -> DataFrame:
    """plan over silver rows; sites whose robots.txt closes them to the bot by its name have none. sitemap: site, url, order."""
    if robots is not None:
        silver = silver.join(rules.blocked(robots, bot), "site", "left_anti")
    opened = silver.where("is_home or coalesce(status, 200) = 200") if "status" in silver.columns else silver
    if sitemap is not None:
        sitemap = openable(sitemap.withColumn("url", canonical_key(F.col("url"))), silver.where("is_home").select("site", "url"), robots, bot)
    pages = opened.select("site", canonical_key(F.col("url")).alias("url"), "is_home")
    return plan(pages, crawl_links(silver, robots, bot, redirects), sitemap, budget)
