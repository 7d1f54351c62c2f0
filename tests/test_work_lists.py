"""Work lists of a crawl, checks of one's own, and report documents."""

import duckdb
import pytest
from pyspark.errors import AnalysisException

from auditloom.operators import queries
from auditloom.plans import checks, documents, work_lists
from auditloom.plans.crawl import Crawl
from auditloom.plans.registry import checks_for, own_check
from auditloom.sources.html import parse_pages

PAGES = [
    (1, "http://w.test/", 200, "<link rel='preload stylesheet' href='/a.css'><link rel=stylesheet href='http://cdn.test/b.css'><link rel=stylesheet href='//www.w.test/c.css'><script src='/x.js'></script><a href='/two'>2</a><a href='/gone'>g</a><a href='/file.pdf'>f</a><img src='/1.png'><img src='data:x'><img src='/2.png'>"),
    (2, "http://w.test/two", 200, "<a href='/known'>k</a><a href='/more#x'>m</a><a href='/gone'>g</a><img src='/1.png'><img src='http://cdn.test/3.png'>"),
    (3, "http://w.test/err", 500, "<a href='/never'>n</a><img src='/never.png'>"),
]


def _silver(spark, rows=PAGES):
    return parse_pages(spark.createDataFrame([(i, u, f"<html><body>{h}</body></html>", s) for i, u, s, h in rows], "page_id long, url string, html string, status int"))


def test_lists_in_order_of_first_places(spark):
    known = spark.createDataFrame([("w.test", "http://w.test/known")], "site string, url string")
    silver = _silver(spark)
    want = [
        ("css", 1, "http://w.test/a.css"), ("css", 2, "http://www.w.test/c.css"), ("image", 1, "http://w.test/1.png"), ("image", 2, "http://w.test/2.png"), ("image", 3, "http://cdn.test/3.png"),
        ("link", 1, "http://w.test/gone"), ("link", 2, "http://w.test/more"), ("script", 1, "http://w.test/x.js"),
    ]
    assert sorted(tuple(r)[1:] for r in work_lists.work_lists(silver.unionByName(silver), known).collect()) == want
    few = work_lists.work_lists(silver, known, {"link": 1, "image": 2, "css": 1, "script": 0})
    assert sorted(tuple(r)[1:] for r in few.collect()) == [x for x in want if x[0] != "script" and x[1] <= {"link": 1, "image": 2, "css": 1}[x[0]]]
    assert work_lists.work_lists(silver.limit(0)).collect() == []


def test_a_check_of_ones_own_beside_the_others(spark):
    silver = _silver(spark).cache()
    registry = checks_for()
    mine = own_check(silver, "title-is-a-number", "meta", "critical", "cast(title as int) < 5")
    raising = own_check(silver, "words-by-depth", "content", "advice", "try_divide(words, depth) > 1", cohort="depth > 0")
    before = {(r.site, r.check_id): tuple(r) for r in checks.run_checks(silver).collect()}
    titled = _silver(spark, [(1, "http://n.test/", 200, "<title>4</title>"), (2, "http://n.test/x", 200, "<title>four</title>")])
    found = {r.check_id: tuple(r)[2:] for r in checks.run_checks(titled, [*registry, mine]).collect()}
    assert found["title-is-a-number"] == ("failed", 1, 1) and len(found) == len(registry) + 1  # "four" is in no cohort
    results = checks.run_checks(silver, [*registry, mine, raising]).cache()
    after = {(r.site, r.check_id): tuple(r) for r in results.collect()}
    assert {k: v for k, v in after.items() if k in before} == before and after["w.test", "title-is-a-number"][2] == "na"
    scores = checks.category_scores(results, [*registry, mine, raising])
    assert scores.count() == 9 and checks.issues(results, [mine, raising]).count() == len(after)


@pytest.mark.parametrize(
    ("args", "error"),
    [
        (("https-enabled", "meta", "critical", "true"), ValueError),
        (("Not An Id", "meta", "critical", "true"), ValueError),
        (("mine", "taste", "critical", "true"), ValueError),
        (("mine", "meta", "fatal", "true"), ValueError),
        (("mine", "meta", "advice", "words"), ValueError),
        (("mine", "meta", "advice", "no_such_column > 1"), AnalysisException),
        (("mine", "meta", "advice", "title", "site"), ValueError),
    ],
)
def test_bad_checks_are_refused_at_once(spark, args, error):
    silver = _silver(spark)
    with pytest.raises(error):
        own_check(silver, *args)


def test_reports_of_a_large_host_and_of_odd_names(spark, tmp_path):
    odd = "/a&b='<x>\""
    rows = [(i, f"https://big.test{odd}{i}", f'<html><head><title>Page {i % 3}</title></head><body><p>x</p></body></html>') for i in range(230)]
    rows += [(900, "https://small.test/", "<html><body></body></html>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = dict(con.execute(queries.SQL["site_reports"]).fetchall())
    reports = queries.site_reports(spark, str(tmp_path)).cache()
    got = {r.site: r.html for r in reports.collect()}
    assert got == want
    assert "<li>and 210 more</li>" in got["big.test"] and "/a&amp;b=&#39;&lt;x&gt;&quot;" in got["big.test"] and odd not in got["big.test"]
    assert got["big.test"].count("<tr><td>https") == 200
    documents.write_reports(reports, str(tmp_path / "reports"))
    files = list((tmp_path / "reports").glob("site=*/part-*.txt"))
    assert len(files) == 2 and {f.read_text().rstrip("\n") for f in files} == set(got.values())
    assert documents.site_reports(Crawl(_silver(spark).limit(0))).collect() == []
