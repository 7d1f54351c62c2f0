"""What checks need beyond a page's own row: the link graph, near-duplicate pages, and the other tables of a crawl.

Tables (all but the pages may be missing; their checks are then left out):
  pages        silver rows, with status, headers (MAP, lower-case names), bytes and ttfb_ms if the crawl has responses
  chains       site, kind (home, http, alt_host), hops ARRAY<STRUCT<url, status>>, final_url, final_status, loop
  probes       site, kind (not_found, favicon), url, status, body
  robots       site, status, content_type, body
  sitemaps     site, found, valid, source;  sitemap_urls: site, url
  assets       site, url, role (image, css, script), status, bytes, content_type, headers, body (of css)
  link_status  site, url, status
Every aggregate combines before its shuffle; joins are on the site or on (site, url), whose hot keys Spark splits.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.operators import robots as rules
from auditloom.sources.html import css_facts
from auditloom.sources.sitemaps import locs
from auditloom.tables import removed, written

from .registry import _COOKIE, _FOREIGN, _GOOD_ALT, _LOCAL, RASTER, q

MIN_WORDS, SHINGLE, LIKENESS = 120, 5, 90
#: Sets before one that it is compared with where they stand.
BESIDE = 3
#: The most shingles that count as common, and the number of sets that must have one.
COMMONEST, COMMON = 4000, 50
MOST_BYTES = 300 * 1024


class Crawl(NamedTuple):
    silver: DataFrame
    chains: DataFrame | None = None
    probes: DataFrame | None = None
    robots: DataFrame | None = None
    sitemaps: DataFrame | None = None
    sitemap_urls: DataFrame | None = None
    assets: DataFrame | None = None
    link_status: DataFrame | None = None

    def tables(self) -> list[str]:
        own = ["responses"] if "headers" in self.silver.columns else []
        return own + [x for x in ("chains", "probes", "robots", "sitemaps", "assets", "link_status") if getattr(self, x) is not None]


def edges(silver: DataFrame) -> DataFrame:
    """site, source, target: distinct internal links of the pages that open, and of the home page whatever its status."""
    opened = silver.where("is_home or coalesce(status, 200) = 200") if "status" in silver.columns else silver
    links = opened.select("site", F.col("url").alias("source"), F.explode(F.filter("links", lambda x: x["internal"] & x["abs"].isNotNull())).alias("l"))
    return links.select("site", "source", F.col("l.abs").alias("target")).distinct()


def _key(url: Column) -> Column:
    return F.when(url.rlike(r"^[^/]+://[^/?#]*$"), F.concat(url, F.lit("/"))).otherwise(url)


def linked_pages(silver: DataFrame, links: DataFrame) -> DataFrame:
    """site, url of the pages that another page links to: under their own key, else without, else with a slash at the end; the first form that anyone links to counts."""
    key = _key(F.col("url"))
    forms = F.array(*[F.struct(F.lit(i).alias("form"), x.alias("target")) for i, x in enumerate((key, F.regexp_replace(key, "/$", ""), F.concat(key, F.lit("/"))))])
    asked = silver.select("site", "url").distinct().select("site", "url", F.explode(forms).alias("f")).select("site", "url", "f.*")
    met = asked.join(links, ["site", "target"]).groupBy("site", "url", "form").agg(F.count_if(F.col("source") != F.col("url")).alias("others"))
    return met.groupBy("site", "url").agg(F.min_by("others", "form").alias("others")).where("others > 0").select("site", "url")


@F.arrow_udf(T.StructType().add("bits", T.ArrayType(T.LongType())).add("beside", T.BooleanType()))
def _sketch(site: pa.Array, sets: pa.Array) -> pa.Array:
    """Of each set, by 1,024 remainders, whether an odd number of shingles has it; and whether the set is alike to one of the BESIDE before or after it."""
    flat, ends = sets.flatten().to_numpy(), np.cumsum([0, *sets.value_lengths().to_pylist()])
    rows = np.repeat(np.arange(len(sets)), np.diff(ends))
    bits = np.packbits(np.bincount(rows * 1024 + (flat & 1023), minlength=len(sets) * 1024).astype(np.uint8) & 1).view(np.int64).reshape(-1, 16)
    sites, beside = site.to_pylist(), np.zeros(len(sets), bool)
    for i in range(len(sets)):
        for j in range(max(0, i - BESIDE), i):
            n, most = ends[i + 1] - ends[i] + ends[j + 1] - ends[j], 100 + LIKENESS
            if sites[i] == sites[j] and not (beside[i] and beside[j]) and most * int(np.bitwise_count((bits[i] ^ bits[j]).view(np.uint64)).sum()) < (100 - LIKENESS) * n:
                both = len(np.intersect1d(flat[ends[i] : ends[i + 1]], flat[ends[j] : ends[j + 1]], assume_unique=True))
                if 100 * both > LIKENESS * (n - both):
                    beside[[i, j]] = True
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * 16, pa.int32()), pa.array(bits.ravel()))
    return pa.StructArray.from_arrays([lists, pa.array(beside)], ["bits", "beside"])


def near_duplicates(silver: DataFrame, body_chars: int | None = None, spent: bool = False) -> DataFrame:
    """site, url of the pages of MIN_WORDS words or more whose 5-word shingles are over 90 % alike to another page's of the site.

    A page's set is its address's: pages of one address put their shingles together, so an address is never its own partner. Equal sets are one class.
    Sets that stand beside one another in the table are compared at once. Classes that are still without a partner ask: they meet others by a prefix of their
    shingles in an order (the commonest last, else by hash), in bands of set sizes of which only neighbours can be alike. Sketches of 128 bytes tell which pairs
    differ in too many shingles; only of what is left the sets travel.
    First each asking class meets the first and the last class of a shingle and band, which takes as many pairs as there are prefixes' shingles, and the likest is compared. Only
    those that found none meet all classes of their shingles and bands, as far as the shingles that still follow in both sets can make them alike.
    Of the body, body_chars characters count (the whole by default). Null texts have no words; pages without site or url take no part.
    spent: silver is a written table that nothing else reads; it goes once the sets are made."""
    long = f"words >= {MIN_WORDS} and site is not null and url is not null" + (" and coalesce(status, 200) = 200" if "status" in silver.columns else "")
    pages = silver.where(long).select("site", "url", F.concat_ws(" ", "top_text", "text" if body_chars is None else F.left("text", F.lit(body_chars))).alias("text"))
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}0-9]+"), lambda w: w != "")
    shingle = lambda i: F.xxhash64("site", *[F.get("w", i + k) for k in range(SHINGLE)])  # noqa: E731  # shingles of two sites never meet
    grams = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - SHINGLE), shingle))

    def shingled(rows: DataFrame) -> DataFrame:
        return rows.select("site", "url", F.explode(F.array(words)).alias("w")).where(F.size("w") >= SHINGLE).select("site", "url", grams.alias("set"))

    # few addresses repeat: a written table of them is small enough to be broadcast, so that texts needn't travel
    repeated = written(pages.groupBy("site", "url").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    several = shingled(pages.join(repeated, ["site", "url"], "left_semi")).select("site", "url", F.explode("set").alias("token")).distinct().groupBy("site", "url").agg(F.collect_list("token").alias("set"))
    each = shingled(pages.join(repeated, ["site", "url"], "left_anti")).unionByName(several).select("site", "url", F.sort_array("set").alias("set"))
    sig = F.array(*[F.xxhash64(F.lit(i), "set") for i in (1, 2)])
    sets = written(each.withColumn("sketch", _sketch(F.col("site"), F.col("set"))).select("site", "url", "set", "sketch.*", sig.alias("sig"), F.monotonically_increasing_id().alias("id"), F.size("set").alias("n")), compact=True)
    if spent:
        removed(silver)
    classes = sets.groupBy("site", "sig").agg(F.min(F.struct("url", "id", "n")).alias("first"), F.max("url").alias("last_url"), F.max("beside").alias("beside"))
    classes = written(classes.select("site", "sig", "first.id", "first.n", (F.col("beside") | (F.col("first.url") != F.col("last_url"))).alias("hit")))

    least = F.floor(F.col("n") * LIKENESS / 100) + 1  # shingles in common, at least
    # which shingles count as common decides how many pairs are asked, not what is found
    top = sets.select(F.explode("set").alias("token")).agg(F.call_function("approx_top_k", "token", F.lit(COMMONEST), F.lit(16 * COMMONEST)).alias("top"))
    common = written(top.select(F.transform(F.filter("top", lambda x: x["count"] > COMMON), lambda x: x["item"]).alias("common"))).select(F.coalesce("common", F.array().cast("array<bigint>"))).scalar()
    ordered = F.concat(F.array_except("set", common), F.array_intersect("set", common))
    lists = sets.select("id", "n", F.slice(ordered, F.lit(1), (F.col("n") - least + 1).cast("int")).alias("list"))
    band = F.floor(F.log("n") / F.log(F.lit(100 / LIKENESS))).alias("band")  # sizes of sets that are alike differ by less than a band
    prefix = lists.join(classes.select("id", "hit"), "id").select("id", "n", "hit", band, F.posexplode("list").alias("pos", "token"))
    members = written(prefix.select("id", "n", "hit", "band", "token", (F.col("n") - F.col("pos")).alias("left")), compact=True)
    heads = members.groupBy("token", "band").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    asking = members.where("not hit").select("id", "token", "n", "left", F.col("band").alias("own_band"))
    # only shingles that another class has in its prefix are asked for again
    asked = written(asking.join(heads, "token").where("abs(band - own_band) <= 1 and (low != id or high != id)").drop("own_band"), compact=True)
    sketches = sets.select("id", "n", "bits")

    def sieved(pairs: DataFrame) -> DataFrame:
        """id, other, apart: the pairs of which sketches allow that they are alike; apart: shingles in one set only, at least."""
        met = pairs.distinct().join(sketches, "id").join(sketches.toDF("other", "m", "others"), "other")
        apart = F.aggregate(F.zip_with("bits", "others", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
        return met.select("id", "other", apart.alias("apart"), "n", "m").where(f"{100 + LIKENESS} * apart < {100 - LIKENESS} * (n + m)").select("id", "other", "apart")

    def alike(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs.select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other")).distinct())
        own = sets.select("id", "set").join(pairs.select(F.explode(F.array("id", "other")).alias("id")).distinct(), "id", "left_semi")
        met = pairs.join(own, "id").join(own.toDF("other", "others"), "other")
        both = F.size(F.array_intersect("set", "others"))
        return met.where(100 * both > LIKENESS * (F.size("set") + F.size("others") - both)).select(F.explode(F.array("id", "other")).alias("id")).distinct()

    likest = sieved(asked.select("id", F.explode(F.array("low", "high")).alias("other")).where("id != other")).groupBy("id").agg(F.min_by("other", F.struct("apart", "other")).alias("other"))
    first = written(alike(likest))
    rest = asked.join(first, "id", "left_anti").select("id", "token", "band", "n", "left")
    others = members.select("token", "band", F.col("id").alias("other"), F.col("n").alias("m"), F.col("left").alias("others_left"))
    fits = f"id != other and 100 * least(n, m) > {LIKENESS} * greatest(n, m) and {100 + LIKENESS} * least(left, others_left) > {LIKENESS} * (n + m)"
    second = written(alike(sieved(rest.join(others, ["token", "band"]).where(fits).select("id", "other")).select("id", "other")))
    classes_hit = first.unionByName(second).unionByName(classes.where("hit").select("id")).distinct()
    return sets.select("site", "url", "sig").join(classes.join(classes_hit, "id").select("site", "sig"), ["site", "sig"]).select("site", "url")


def css_of_homes(assets: DataFrame) -> DataFrame:
    """site, css_width, css_tiny, css_fluid of the style sheets."""

    @F.arrow_udf("max_fixed_width int, tiny_font boolean, fluid_images boolean")
    def facts(css: pa.Array) -> pa.Array:
        found = [css_facts(x.as_py()) for x in css]
        return pa.array(found, pa.struct([("max_fixed_width", pa.int32()), ("tiny_font", pa.bool_()), ("fluid_images", pa.bool_())]))

    found = assets.where("role = 'css' and status = 200").select("site", facts(F.col("body")).alias("f"))
    return found.groupBy("site").agg(F.max("f.max_fixed_width").alias("css_width"), F.max("f.tiny_font").alias("css_tiny"), F.max("f.fluid_images").alias("css_fluid"))


def enriched(crawl: Crawl) -> DataFrame:
    """Silver rows that answered 200, with what the page checks need from elsewhere. Joins carry only the columns that are asked for."""
    silver, links = crawl.silver, edges(crawl.silver)
    pages = silver.where("coalesce(status, 200) = 200") if "status" in silver.columns else silver
    flag = lambda t, name: t.withColumn(name, F.lit(True))
    out = pages.join(flag(near_duplicates(silver), "near_duplicate"), ["site", "url"], "left").join(flag(linked_pages(silver, links), "has_source"), ["site", "url"], "left")
    css = css_of_homes(crawl.assets) if crawl.assets is not None else None
    by_site = pages.groupBy("site").agg(F.sum(F.size("images")).alias("site_images"), F.coalesce(F.max(F.when(F.col("is_home"), F.col("fluid_images"))), F.lit(False)).alias("home_fluid"))
    by_site = by_site.join(css, "site", "left") if css is not None else by_site.withColumns({"css_width": F.lit(0), "css_tiny": F.lit(False), "css_fluid": F.lit(False)})
    if crawl.sitemaps is not None:
        by_site = by_site.join(crawl.sitemaps.groupBy("site").agg(F.max("valid").alias("sitemap_valid")), "site", "left")
        at = F.regexp_replace(_key(F.regexp_replace("url", "#.*$", "")), "/$", "")
        listed = crawl.sitemap_urls.select("site", at.alias("__at")).distinct().withColumn("in_sitemap", F.lit(True))
        out = out.withColumn("__at", at).join(listed, ["site", "__at"], "left").drop("__at")
    out = out.join(by_site, "site")
    if crawl.link_status is not None:
        status = crawl.link_status.groupBy("site", F.col("url").alias("target")).agg(F.max("status").alias("code"))
        bad = links.join(status, ["site", "target"]).groupBy("site", F.col("source").alias("url")).agg(F.count_if(F.expr("code between 400 and 499")).alias("broken_targets"), F.count_if(F.expr("code between 300 and 399")).alias("redirecting_targets"))
        out = out.join(bad, ["site", "url"], "left")
    if crawl.assets is not None:
        weights = crawl.assets.where("role = 'image'").groupBy("site", F.col("url").alias("abs")).agg(F.max("bytes").alias("b"))
        used = pages.select("site", "url", F.explode("images.abs").alias("abs")).join(weights, ["site", "abs"]).groupBy("site", "url").agg(F.sum("b").alias("image_bytes"))
        out = out.join(used, ["site", "url"], "left")
    else:
        out = out.withColumn("image_bytes", F.lit(0))
    own = lambda c, none: F.coalesce(F.col(c), F.lit(none))
    filled = {"near_duplicate": own("near_duplicate", False), "has_source": own("has_source", False), "image_bytes": own("image_bytes", 0), "site_fluid": F.col("home_fluid") | own("css_fluid", False)}
    filled |= {"css_width": F.when(F.col("is_home"), own("css_width", 0)).otherwise(0), "css_tiny": F.when(F.col("is_home"), own("css_tiny", False)).otherwise(False)}
    filled |= {c: own(c, none) for c, none in (("sitemap_valid", False), ("in_sitemap", False), ("broken_targets", 0), ("redirecting_targets", 0)) if c in out.columns}
    return out.withColumns(filled)


def site_facts(crawl: Crawl) -> DataFrame:
    """A row of facts of each site, for the checks of kind `site`."""
    silver = crawl.silver
    ok = "coalesce(status, 200) = 200" if "status" in silver.columns else "true"
    content = "filter(images, i -> i.src != '' and not i.src rlike r'(?i)\\.svg(\\?|$)' and not startswith(i.src, 'data:'))"
    home = lambda c: F.max(F.when(F.col("is_home"), F.col(c)))
    any_page = lambda test: F.coalesce(F.max(F.expr(f"{ok} and ({test})")), F.lit(False))
    facts = silver.withColumn("low", F.lower("html")).groupBy("site").agg(
        home("url").alias("home_url"), home("has_icon").alias("home_icon"), F.count_if(F.expr(ok)).alias("n_pages"),
        any_page(_FOREIGN).alias("foreign"), any_page(_LOCAL).alias("local"), any_page(_COOKIE).alias("cookie"), any_page("exists(images, i -> i.src = '')").alias("empty_images"),
        F.sum(F.expr(f"if({ok}, size({content}), 0)")).alias("content_images"), F.sum(F.expr(f"if({ok}, size(filter({content}, i -> {_GOOD_ALT})), 0)")).alias("good_alts"),
    ).withColumn("tracked", F.col("foreign") | F.col("local"))
    targets = edges(silver).select("site", "target").distinct().withColumn("path", F.regexp_extract("target", r"://[^/?#]*([^?#]*)", 1)).where(r"path not in ('', '/') and not path rlike r'\.[A-Za-z0-9_]{2,5}$'")
    slashes = targets.groupBy("site").agg(F.count_if(F.col("path").endswith("/")).alias("slash"), F.count_if(~F.col("path").endswith("/")).alias("no_slash"))
    facts = facts.join(slashes, "site", "left").fillna(0, ["slash", "no_slash"]).withColumn("home_host", F.lower(F.regexp_extract("home_url", r"://([^/?#:]*)", 1)))
    if crawl.chains is not None:
        chain = F.struct("kind", "hops", "final_url", "final_status", F.coalesce("loop", F.lit(False)).alias("loop"))
        of = lambda k: F.any_value(F.when(F.col("kind") == k, chain), True)
        facts = facts.join(crawl.chains.where("kind in ('home', 'http', 'alt_host')").groupBy("site").agg(of("http").alias("http"), of("alt_host").alias("alt_host"), of("home").alias("home_chain")), "site", "left")
        facts = facts.withColumn("chains", F.filter(F.array("home_chain", "http", "alt_host"), lambda c: c.isNotNull()))
    if crawl.probes is not None:
        of = lambda k: F.any_value(F.when(F.col("kind") == k, F.struct("url", "status", "body")), True)
        facts = facts.join(crawl.probes.groupBy("site").agg(of("not_found").alias("not_found"), of("favicon").alias("favicon")), "site", "left")
    if crawl.robots is not None:
        facts = facts.join(robots_facts(crawl.robots, silver.select("site").distinct()), "site", "left")
    if crawl.sitemaps is not None:
        facts = facts.join(sitemap_facts(crawl.sitemaps, crawl.sitemap_urls, facts.select("site", "home_host")), "site", "left")
    if crawl.assets is not None:
        facts = facts.join(asset_facts(crawl.assets), "site", "left").fillna(0, ["n_images", "n_heavy", "n_raster", "n_modern", "n_broken_images", "n_static", "n_uncached"])
    if crawl.link_status is not None:
        facts = facts.join(crawl.link_status.groupBy("site").agg(F.count_if(F.expr("status >= 500")).alias("n_5xx")), "site", "left").fillna(0, ["n_5xx"])
    return facts


def robots_facts(robots: DataFrame, sites: DataFrame) -> DataFrame:
    """site, robots_status, robots_is_text, n_directives, n_declared (sitemaps), closed_to (search bots), ai_closed (in the order of AI_BOTS)."""
    lines = rules.directives(robots)
    counts = lines.groupBy("site").agg(F.count("*").alias("n_directives"), F.count_if(F.expr("key = 'sitemap' and value != ''")).alias("n_declared"))
    bots = [*dict.fromkeys(["*", "Googlebot", *rules.AI_BOTS])]  # YandexBot is one of the latter
    asked = sites.select("site", F.explode(F.array(*map(F.lit, bots))).alias("bot"), F.lit("/").alias("path"))
    closed = rules.allowed(robots, asked).where("not allowed").groupBy("site").agg(F.collect_set("bot").alias("closed_to"))  # at most a bot each
    status = robots.groupBy("site").agg(F.max("status").alias("robots_status"), F.coalesce(F.max(rules.is_text()), F.lit(False)).alias("robots_is_text"))
    out = sites.join(status, "site", "left").join(counts, "site", "left").join(closed, "site", "left").fillna(0, ["robots_status", "n_directives", "n_declared"]).fillna(False, ["robots_is_text"])
    out = out.withColumn("closed_to", F.coalesce("closed_to", F.array().cast("array<string>")))
    return out.withColumn("ai_closed", F.filter(F.array(*map(F.lit, rules.AI_BOTS)), lambda b: F.array_contains("closed_to", b)))


def sitemap_facts(sitemaps: DataFrame, urls: DataFrame, homes: DataFrame) -> DataFrame:
    """site, sitemap_found, sitemap_valid, sitemap_has_home, n_foreign_urls."""
    found = sitemaps.groupBy("site").agg(F.coalesce(F.max("found"), F.lit(False)).alias("sitemap_found"), F.coalesce(F.max("valid"), F.lit(False)).alias("sitemap_valid"))
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))
    bare = lambda c: F.regexp_replace(c, r"^www\.", "")
    met = urls.join(homes, "site").select("site", "home_host", host.alias("host"), F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1).alias("path"))
    counts = met.groupBy("site").agg(F.max((F.col("host") != "") & (bare(F.col("host")) == bare(F.col("home_host"))) & F.col("path").isin("", "/")).alias("sitemap_has_home"), F.count_if(F.col("host") != F.col("home_host")).alias("n_foreign_urls"))
    out = homes.select("site").join(found, "site", "left").join(counts, "site", "left")
    return out.fillna(False, ["sitemap_found", "sitemap_valid", "sitemap_has_home"]).fillna(0, ["n_foreign_urls"])


def asset_facts(assets: DataFrame) -> DataFrame:
    image, ok = "role = 'image'", "status = 200"
    kind = "coalesce(content_type, '')"
    raster = f"{image} and {ok} and ({kind} rlike '(?i)image/(jpeg|png|gif|webp|avif|bmp)' or url rlike {q(RASTER)})"
    modern = rf"({kind} rlike '(?i)webp|avif' or url rlike r'(?i)\.(webp|avif)(\?|$)')"
    has = " or ".join(f"coalesce(try_element_at(headers, '{h}'), '') != ''" for h in ("cache-control", "etag", "last-modified"))
    one = assets.groupBy("site", "url", "role").agg(F.any_value("status").alias("status"), F.max("bytes").alias("bytes"), F.any_value("content_type").alias("content_type"), F.any_value("headers").alias("headers"))
    tests = {"n_images": image, "n_heavy": f"{image} and {ok} and bytes > {MOST_BYTES}", "n_raster": raster, "n_modern": f"{raster} and {modern}", "n_broken_images": f"{image} and (status >= 400 or status = 0)", "n_static": ok, "n_uncached": f"{ok} and not ({has})"}
    return one.groupBy("site").agg(*[F.count_if(F.expr(test)).alias(name) for name, test in tests.items()])


def sitemap_locs(bodies: DataFrame) -> DataFrame:
    """site, is_xml, is_index, locs of sitemap bodies (site, body)."""
    return locs(bodies).select("site", "is_xml", "is_index", "locs")
