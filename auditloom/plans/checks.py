"""Evaluate the declared checks over the silver table and, if there are any, the other tables of a crawl.

Every page yields (check, in cohort, hit), summed per site; the sums combine before the shuffle, so a hot site costs one row a
task and check. Group checks count keys per site first. Checks that read facts from elsewhere (plans/crawl.py) are evaluated on a
narrow projection of the pages; checks of kind `site` on one row of facts a site.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.tables import written

from .crawl import Crawl, enriched, site_facts
from .registry import CATEGORIES, SEVERITIES, Check, checks_for

MOST_AFFECTED = 200
ALL_CHECKS = checks_for("responses", "chains", "probes", "assets", "robots", "sitemaps", "link_status")
#: Columns that pages get from elsewhere.
_ELSEWHERE = re.compile(r"\b(site_images|site_fluid|near_duplicate|has_source|css_width|css_tiny|image_bytes|sitemap_valid|in_sitemap|broken_targets|redirecting_targets)\b")


def as_crawl(pages: DataFrame | Crawl) -> Crawl:
    return pages if isinstance(pages, Crawl) else Crawl(pages)


def _checks(crawl: Crawl, checks: list[Check] | None) -> list[Check]:
    return checks_for(*crawl.tables()) if checks is None else checks


def _reads_more(c: Check) -> bool:
    return bool(_ELSEWHERE.search(c.cohort + " " + c.test))


def _ok(silver: DataFrame) -> DataFrame:
    return silver.where("coalesce(status, 200) = 200") if "status" in silver.columns else silver


def _outcomes(pages: DataFrame, checks: list[Check]) -> DataFrame:
    def one(c: Check):
        cohort = f"({c.cohort})" + (" and is_home" if c.kind == "home" else "")
        return F.expr(f"struct('{c.id}' as check_id, coalesce({cohort}, false) as within, coalesce({c.test}, false) as hit)")

    rows = F.explode(F.array(*[one(c) for c in checks]))
    return pages.select("site", "page_id", "url", rows.alias("r")).where("r.within").select("site", "page_id", "url", "r.check_id", "r.hit")


def page_outcomes(pages: DataFrame | Crawl, checks: list[Check] | None = None) -> DataFrame:
    """site, page_id, url, check_id, hit: a row of each page and check whose cohort holds it."""
    crawl = as_crawl(pages)
    of_pages = [c for c in _checks(crawl, checks) if c.kind not in ("group", "site")]
    own, more = [c for c in of_pages if not _reads_more(c)], [c for c in of_pages if _reads_more(c)]
    pages_of, homes_of = [c for c in own if c.kind != "home"], [c for c in own if c.kind == "home"]
    parts = []
    if pages_of:
        parts.append(_outcomes(_ok(crawl.silver), pages_of))
    if homes_of:  # the home answers its own checks whatever its status
        parts.append(_outcomes(crawl.silver.where("is_home"), homes_of))
    if more:
        parts.append(_outcomes(enriched(crawl), more))
    return functools.reduce(DataFrame.unionByName, parts)


def group_outcomes(pages: DataFrame | Crawl, checks: list[Check] | None = None) -> DataFrame:
    """site, check_id, n_bad, n_total of the checks that no two pages of a site may share a key."""
    crawl = as_crawl(pages)
    keyed = [c for c in _checks(crawl, checks) if c.kind == "group"]
    keys = _ok(crawl.silver).select("site", F.explode(F.array(*[F.expr(f"struct('{c.id}' as check_id, {c.test} as key)") for c in keyed])).alias("r")).select("site", "r.*")
    sizes = keys.groupBy("site", "check_id", "key").agg(F.count("*").alias("n"))
    shared = (F.coalesce(F.col("key"), F.lit("")) != "") & (F.col("n") > 1)
    return sizes.groupBy("site", "check_id").agg(F.coalesce(F.sum(F.when(shared, F.col("n"))), F.lit(0)).alias("n_bad"), F.sum("n").alias("n_total"))


def site_outcomes(pages: DataFrame | Crawl, checks: list[Check] | None = None) -> DataFrame:
    """site, check_id, status of the checks of kind `site`."""
    crawl = as_crawl(pages)
    rows = F.explode(F.array(*[F.expr(f"struct('{c.id}' as check_id, coalesce({c.test}, 'na') as status)") for c in _checks(crawl, checks) if c.kind == "site"]))
    return site_facts(crawl).select("site", rows.alias("r")).select("site", "r.*")


def judged(sites: DataFrame, counts: DataFrame, checks: list[Check]) -> DataFrame:
    """site, check_id, status, n_bad, n_total of each site and check. counts: site, check_id, n_hit, n_total, own_status (of checks of kind `site`)."""
    rows = [(i, c.id, c.kind, c.cohort == "true") for i, c in enumerate(checks)]
    dim = F.broadcast(sites.sparkSession.createDataFrame(rows, "check_no int, check_id string, kind string, always boolean"))
    every = sites.select("site").distinct().join(dim, how="cross")  # sites x a registry of fixed size
    met = every.join(counts, ["site", "check_id"], "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)), "n_total": F.coalesce("n_total", F.lit(0))})
    status = (
        F.when(F.col("kind") == "site", F.coalesce("own_status", F.lit("na")))
        .when(F.col("kind") == "any", F.when((F.col("n_total") == 0) & ~F.col("always"), "na").when(F.col("n_hit") > 0, "passed").otherwise("failed"))
        .when(F.col("kind") == "group", F.when(F.col("n_hit") > 0, "failed").otherwise("passed"))
        .otherwise(F.when(F.col("n_total") == 0, "na").when(F.col("n_hit") > 0, "failed").otherwise("passed"))
    )
    n_bad = F.when(F.col("kind") == "any", F.when(F.col("n_hit") > 0, 0).otherwise(F.col("n_total"))).otherwise(F.col("n_hit")).cast("long")
    return met.select("site", "check_id", status.alias("status"), n_bad.alias("n_bad"), "n_total")


def run_checks(pages: DataFrame | Crawl, checks: list[Check] | None = None) -> DataFrame:
    """site, check_id, status (passed, failed, na), n_bad, n_total: a row of every site and check. n_bad counts pages; of a failed `site` check it is 1."""
    crawl = as_crawl(pages)
    checks = _checks(crawl, checks)
    nothing = F.lit(None).cast("string").alias("own_status")
    counted = page_outcomes(crawl, checks).groupBy("site", "check_id").agg(F.count_if("hit").alias("n_hit"), F.count("*").alias("n_total")).withColumn("own_status", nothing)
    grouped = group_outcomes(crawl, checks).select("site", "check_id", F.col("n_bad").alias("n_hit"), "n_total", nothing)
    of_sites = site_outcomes(crawl, checks).select("site", "check_id", F.when(F.col("status") == "failed", 1).otherwise(0).cast("long").alias("n_hit"), F.lit(1).cast("long").alias("n_total"), F.col("status").alias("own_status"))
    return judged(crawl.silver, counted.unionByName(grouped).unionByName(of_sites), checks)


def additive(checks: list[Check]) -> list[Check]:
    """The checks whose counts are sums over pages, each of which answers for itself."""
    return [c for c in checks if c.kind in ("page", "any") and not _reads_more(c)]


def additive_counts(silver: DataFrame, checks: list[Check]) -> DataFrame:
    """site, check_id, n_hit, n_total of additive checks: counts of two sets of pages add up, and what left a set is subtracted."""
    return _outcomes(_ok(silver), checks).groupBy("site", "check_id").agg(F.count_if("hit").alias("n_hit"), F.count("*").alias("n_total"))


def affected(pages: DataFrame | Crawl, checks: list[Check] | None = None) -> DataFrame:
    """site, check_id, page_id, url: all pages that a failed check counts against.

    Of page checks the bad pages; of group checks those that share a key; of a failed `any` check its cohort, if that has a condition, else
    the home page; of a failed check of a site the home page."""
    crawl = as_crawl(pages)
    checks = _checks(crawl, checks)
    dim = F.broadcast(crawl.silver.sparkSession.createDataFrame([(c.id, c.kind, c.cohort == "true") for c in checks], "check_id string, kind string, always boolean"))
    page = ["site", "check_id", "page_id", "url"]
    of_pages, of_any = [c for c in checks if c.kind in ("page", "home")], [c for c in checks if c.kind == "any"]
    none = crawl.silver.limit(0).select("site", "page_id", "url", F.lit("").alias("check_id"), F.lit(False).alias("hit"))
    # only what counts against a page is kept; checks that one good page passes are decided by counts first
    own = written((page_outcomes(crawl, of_pages) if of_pages else none).where("hit").select(*page))
    anyhow = page_outcomes(crawl, of_any) if of_any else none
    failed = written(anyhow.groupBy("site", "check_id").agg(F.max("hit").alias("hit")).where("not hit").join(dim, "check_id").select("site", "check_id", "always"))
    homes = crawl.silver.where("is_home").select("site", "page_id", "url")
    of_homes = failed.where("always").select("site", "check_id").unionByName(site_outcomes(crawl, checks).where("status = 'failed'").select("site", "check_id")).join(homes, "site").select(*page)
    # whom a failed check is about its cohort tells; that no page is good is known by then
    about = [c._replace(test="false") for c in of_any if c.cohort != "true"]
    of_cohorts = (page_outcomes(crawl, about) if about else none).join(failed.where("not always").select("site", "check_id"), ["site", "check_id"]).select(*page)
    keyed = [c for c in checks if c.kind == "group"]
    keys = _ok(crawl.silver).select("site", "page_id", "url", F.explode(F.array(*[F.expr(f"struct('{c.id}' as check_id, {c.test} as key)") for c in keyed])).alias("r")).select("site", "page_id", "url", "r.*").where("key != ''")
    shared = keys.groupBy("site", "check_id", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return own.unionByName(of_homes).unionByName(of_cohorts).unionByName(keys.join(shared, ["site", "check_id", "key"]).select(*page))


def affected_pages(pages: DataFrame | Crawl, checks: list[Check] | None = None, most: int | None = None) -> DataFrame:
    """site, check_id, page_id, url: all pages that a failed check counts against; for a display, the first `most` (MOST_AFFECTED, say) by page_id of each."""
    failing = affected(pages, checks)
    if most is None:
        return failing
    order = Window.partitionBy("site", "check_id").orderBy("page_id")
    return failing.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("rank")


def dimension(silver: DataFrame, checks: list[Check] | None = None) -> DataFrame:
    """A row of each check: those of the registry, and those of one's own among `checks`."""
    known = {c.id for c in ALL_CHECKS}
    every = [*ALL_CHECKS, *(c for c in checks or () if c.id not in known)]
    rows = [(i, c.id, c.category, CATEGORIES[c.category], c.severity, SEVERITIES[c.severity], c.kind, c.cohort in ("true", "")) for i, c in enumerate(every)]
    return F.broadcast(silver.sparkSession.createDataFrame(rows, "check_no int, check_id string, category string, category_weight double, severity string, severity_weight int, kind string, always boolean"))


def category_scores(results: DataFrame, checks: list[Check] | None = None) -> DataFrame:
    """site, category, score, passed, failed, na. Checks that are na don't count; a category without others is left out."""
    met = results.join(dimension(results, checks), "check_id")
    counts = met.groupBy("site", "category", "category_weight").agg(
        F.sum(F.when(F.col("status") == "passed", F.col("severity_weight")).otherwise(0)).alias("won"),
        F.sum(F.when(F.col("status") != "na", F.col("severity_weight")).otherwise(0)).alias("most"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("passed", "failed", "na")],
    )
    return counts.where("most > 0").select("site", "category", "category_weight", F.floor(100 * F.col("won") / F.col("most") + 0.5).cast("int").alias("score"), "passed", "failed", "na")


def site_scores(categories: DataFrame) -> DataFrame:
    """site, score: the weighted mean of the rounded category scores that are there. all_sites adds the others with 0."""
    return categories.groupBy("site").agg(F.floor(F.sum(F.col("score") * F.col("category_weight")) / F.sum("category_weight") + 0.5).cast("int").alias("score"))


def all_sites(scores: DataFrame, results: DataFrame) -> DataFrame:
    """scores with a row of 0 of each site whose checks are all na."""
    return results.select("site").distinct().join(scores, "site", "left").select("site", F.coalesce("score", F.lit(0)).alias("score"))


def page_summary(pages: DataFrame | Crawl, checks: list[Check] | None = None, failing: DataFrame | None = None) -> DataFrame:
    """site, page_id, url, issues, critical: pages without issues are there too. Every failing page counts, not just those that a display lists.
    failing: rows of `affected`, if they are there already."""
    crawl = as_crawl(pages)
    found = (affected(crawl, checks) if failing is None else failing).join(dimension(crawl.silver, checks), "check_id").groupBy("site", "page_id", "url").agg(F.countDistinct("check_id").alias("issues"), F.countDistinct(F.when(F.col("severity") == "critical", F.col("check_id"))).alias("critical"))
    met = _ok(crawl.silver).select("site", "page_id", "url").join(found.select("site", F.col("page_id").alias("__id"), F.col("url").alias("__url"), "issues", "critical").withColumnRenamed("site", "__site"), F.col("site").eqNullSafe(F.col("__site")) & F.col("page_id").eqNullSafe(F.col("__id")) & F.col("url").eqNullSafe(F.col("__url")), "left")
    return met.select("site", "page_id", "url", F.coalesce("issues", F.lit(0)).alias("issues"), F.coalesce("critical", F.lit(0)).alias("critical"))


def action_plan(results: DataFrame, most: int = 12, checks: list[Check] | None = None) -> DataFrame:
    """site, step, check_id: failed checks by severity, category weight, addresses that a report lists (one of a check of a whole site, MOST_AFFECTED at most), registry order."""
    listed = F.when(F.col("kind").isin("any", "site") & F.col("always"), 1).otherwise(F.least(F.col("n_bad"), F.lit(MOST_AFFECTED)))
    order = Window.partitionBy("site").orderBy(F.desc("severity_weight"), F.desc("category_weight"), listed.desc(), "check_no")
    failed = results.where("status = 'failed'").join(dimension(results, checks), "check_id")
    return failed.withColumn("step", F.row_number().over(order)).where(F.col("step") <= most).select("site", "step", "check_id", "category", "severity", "n_bad")


def issues(results: DataFrame, checks: list[Check] | None = None) -> DataFrame:
    """site, check_id, category, severity, status, n_bad, by severity (position 0 to 2), then registry order: the rows of a report."""
    met = results.join(dimension(results, checks), "check_id")
    place = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")).cast("int") - 1
    return met.select("site", "check_id", "category", "severity", "status", "n_bad", place.alias("severity_no"), "check_no")


def stats(results: DataFrame, silver: DataFrame | None = None, checks: list[Check] | None = None) -> DataFrame:
    """site, applicable, passed, failed, critical, important, advice (of the failed), check_count; with silver rows also pages (that open)."""
    met = results.join(dimension(results, checks), "check_id")
    failed = F.col("status") == "failed"
    found = met.groupBy("site").agg(F.count_if(F.col("status") != "na").alias("applicable"), F.count_if(F.col("status") == "passed").alias("passed"), F.count_if(failed).alias("failed"), *[F.count_if(failed & (F.col("severity") == s)).alias(s) for s in SEVERITIES], F.count("*").alias("check_count"))
    if silver is None:
        return found
    return found.join(_ok(silver).groupBy("site").agg(F.count("*").alias("pages")), "site", "left").fillna(0, ["pages"])


def weakest_categories(categories: DataFrame, most: int = 3) -> DataFrame:
    """site, rank, category, score: the lowest scores first, in the order of CATEGORIES among equals."""
    place = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    order = Window.partitionBy("site").orderBy("score", place)  # at most as many rows as there are categories
    return categories.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("site", "rank", "category", "score")
