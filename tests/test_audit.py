"""The audit engine: goldens by hand, and every query with SQL against that SQL."""

import sys
from pathlib import Path

import duckdb
import pytest

from auditloom.operators import queries
from auditloom.plans import checks
from auditloom.plans.registry import PAGE_CHECKS
from auditloom.sources.html import parse, parse_pages

sys.path.insert(0, str(Path(__file__).resolve().parent))
import sites  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for name_of in ("pages", "events"):
        con.execute(f"create view {name_of} as select * from '{SF}/{name_of}.parquet'")
    cursor = con.execute(queries.SQL[name])
    columns = [d[0] for d in cursor.description]
    want = sorted(repr(sorted(zip(columns, row, strict=True))) for row in cursor.fetchall())
    assert sorted(repr(sorted(r.asDict().items())) for r in queries.QUERIES[name](spark, SF).collect()) == want


def test_registry():
    assert len({c.id for c in PAGE_CHECKS}) == len(PAGE_CHECKS)
    assert {c.kind for c in PAGE_CHECKS} == {"page", "home", "any", "group", "site"}


def test_parser_facts():
    page = parse("<html lang=ru><head><title> T </title><meta name=description content=''></head><body><ul><li>A</li><li>B</li></ul><img src=a.png><img alt='' src=b.svg><form><input name=tel></form></body>", "http://www.x.ru/p")
    assert page["text"] == "AB" and page["title"] == "T" and page["description"] == "" and page["lang"] == "ru"
    assert [i["alt"] for i in page["images"]] == [None, ""] and page["forms"][0]["personal_fields"] == page["forms"][0]["unlabeled_fields"] == 1


def test_sites_by_their_pages_alone(spark):
    """Without a crawl's tables 88 checks run: the sound site passes them, the broken one fails what its pages can show."""
    urls = [sites.GOOD + p for p in sites.GOOD_PAGES] + list(sites.BAD_PAGES)
    bodies = [*sites.GOOD_PAGES.values(), *(h for _, h in sites.BAD_PAGES.values())]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(zip(urls, bodies, strict=True))], "page_id long, url string, html string")
    silver = parse_pages(pages).cache()
    got = {(r.site, r.check_id): r.status for r in checks.run_checks(silver).collect()}
    assert len(got) == 2 * 88 and {s for (site, _), s in got.items() if site == "orchard.test"} == {"passed"}
    # its home now counts among the pages, and no file of styles tells of images that shrink
    assert {c for (site, c), s in got.items() if site == "wreck.test" and s != "failed"} == {"jsonld-present"}
    summary = {r.url: r.issues for r in checks.page_summary(silver).collect()}
    assert len(summary) == len(urls) and all((n == 0) == u.startswith(sites.GOOD) for u, n in summary.items())


def test_scores_of_the_worked_example(spark):
    rows = [("s", c.id, "passed", 0, 1) for c in PAGE_CHECKS]
    results = spark.createDataFrame(rows, "site string, check_id string, status string, n_bad long, n_total long")
    categories = checks.category_scores(results)
    assert {r.score for r in categories.collect()} == {100} and checks.site_scores(categories).first().score == 100
    example = list(zip((50, 70, 90, 30, 10, 80, 60, 40, 20), (20, 20, 15, *[7.5] * 6), strict=True))
    weighted = spark.createDataFrame([("s", str(i), float(w), s) for i, (s, w) in enumerate(example)], "site string, category string, category_weight double, score int")
    assert checks.site_scores(weighted).first().score == 56  # 55.5, rounded up


def test_empty_and_null_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "http://x.test/", "")], "page_id long, url string, html string")
    assert parse_pages(pages).count() == 2 and parse_pages(pages.limit(0)).count() == 0
    assert {r.status for r in checks.run_checks(parse_pages(pages)).collect()} <= {"passed", "failed", "na"}
