"""A report of each site as one HTML document, put together natively from bounded lists.

Every value that comes from pages is escaped. A check lists its first LISTED pages and says how many more there are; the table of
pages has the ROWS worst. So a document's size is bounded by the registry, however many pages a site has, and what is gathered for
a site is bounded alike. write_reports writes each site's document as one file, by the executors.

Sites without pages that open get their document too. A site that is null is called ''.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.report import escaped
from auditloom.tables import written

from . import checks
from .crawl import Crawl
from .registry import CATEGORIES, SEVERITIES

LISTED, ROWS = 20, 200
HEAD = '<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Audit of {}</title></head><body><h1>{}</h1>'


def share(part: Column, whole: Column) -> Column:
    """Whole per cent, halves up; 0 of nothing."""
    return F.when(whole > 0, F.floor(100 * part / whole + 0.5)).otherwise(0).cast("int")


def _texts(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _joined(order: tuple[str, ...], text: Column, name: str, between: str = "") -> Column:
    """An aggregate: the texts in an order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, text.alias("__text"))))
    return F.array_join(F.transform(rows, lambda r: r["__text"]), between).alias(name)


def conclusion(stats: DataFrame, scores: DataFrame, weakest: DataFrame) -> DataFrame:
    """site, conclusion: sentences on the score, the problems, the weakest categories and the pages."""
    words = weakest.groupBy("site").agg(_joined(("rank",), _texts(F.col("category"), " (", F.col("score"), ")"), "weakest", ", "))
    met = stats.join(scores, "site").join(words, "site", "left")
    critical = F.when(F.col("critical") > 0, _texts("Critical problems: ", F.col("critical"), ".")).otherwise("No critical problems.")
    weak = F.when(F.col("weakest").isNotNull(), _texts("Weakest: ", F.col("weakest"), "."))
    lines = F.array_compact(F.array(_texts("The site scores ", F.col("score"), " of 100."), critical, _texts("Important: ", F.col("important"), ", advice: ", F.col("advice"), "."), weak, _texts("Pages checked: ", F.col("pages"), ".")))
    return met.select("site", lines.alias("conclusion"))


def severity_shares(stats: DataFrame) -> DataFrame:
    """site, severity, failed, share: of a site's failed checks, by severity."""
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("severity_no"), F.lit(s).alias("severity"), F.col(s).alias("n")) for i, s in enumerate(SEVERITIES)]))
    return stats.select("site", "failed", rows.alias("r")).select("site", "r.severity_no", "r.severity", F.col("r.n").alias("failed"), share(F.col("r.n"), F.col("failed")).alias("share"))


def site_reports(crawl: Crawl) -> DataFrame:
    """site, html."""
    silver = crawl.silver
    results = written(checks.run_checks(crawl))
    failing = written(checks.affected(crawl))
    categories = written(checks.category_scores(results))
    scores = checks.all_sites(checks.site_scores(categories), results)
    stats = written(checks.stats(results, silver))
    top = written(conclusion(stats, scores, checks.weakest_categories(categories)).join(scores, "site"))

    place = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    row = _texts("<tr><td>", F.col("category"), "</td><td>", F.col("score"), "</td><td>", F.col("passed"), " of ", F.col("passed") + F.col("failed"), "</td></tr>")
    of_categories = categories.withColumn("place", place).groupBy("site").agg(_joined(("place",), row, "categories"))
    plan = checks.action_plan(results).groupBy("site").agg(_joined(("step",), _texts("<li>", F.col("check_id"), "</li>"), "plan"))

    order = Window.partitionBy("site", "check_id").orderBy("page_id", "url")
    counts = failing.groupBy("site", "check_id").agg(F.count("*").alias("n"))
    listed = failing.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= LISTED)
    lists = listed.groupBy("site", "check_id").agg(_joined(("rank",), _texts("<li>", escaped(F.col("url")), "</li>"), "urls")).join(counts, ["site", "check_id"])
    more = F.when(F.col("n") > LISTED, _texts("<li>and ", F.col("n") - LISTED, " more</li>"))
    failed = checks.issues(results).where("status = 'failed'").join(lists, ["site", "check_id"], "left")
    section = _texts("<h3>", F.col("check_id"), "</h3><p>", F.col("category"), "</p><ul>", F.col("urls"), more, "</ul>")
    of_severities = failed.groupBy("site", "severity_no").agg(_joined(("check_no",), section, "sections"))
    shares = severity_shares(stats).where("failed > 0").join(of_severities, ["site", "severity_no"])
    group = _texts("<h2>", F.col("severity"), ": ", F.col("failed"), " (", F.col("share"), " %)</h2>", F.col("sections"))
    of_checks = shares.groupBy("site").agg(_joined(("severity_no",), group, "checks"))

    worst = Window.partitionBy("site").orderBy(F.desc("issues"), F.desc("critical"), "page_id", "url")
    pages = checks.page_summary(crawl, failing=failing).withColumn("rank", F.row_number().over(worst)).where(F.col("rank") <= ROWS)
    line = _texts("<tr><td>", escaped(F.col("url")), "</td><td>", F.col("issues"), "</td><td>", F.col("critical"), "</td></tr>")
    of_pages = pages.groupBy("site").agg(_joined(("rank",), line, "pages"))

    for part in (of_categories, plan, of_checks, of_pages):
        top = top.join(part, "site", "left")
    name = escaped(F.col("site"))
    before, between, after = HEAD.split("{}")
    said = F.array_join(F.transform("conclusion", lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "")
    html = _texts(before, name, between, name, after, said, "<table>", F.col("categories"), "</table><ol>", F.col("plan"), "</ol>", F.col("checks"), "<table>", F.col("pages"), "</table></body></html>")
    return top.select("site", html.alias("html"))


def write_reports(reports: DataFrame, path: str) -> None:
    """Each document as one file below path/site=<site>/."""
    reports.select("site", F.col("html").alias("value")).repartition("site").write.mode("overwrite").partitionBy("site").text(path)
