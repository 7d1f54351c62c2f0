"""robots.txt, keywords and the rate limiter against hand-made cases and brute force."""

from collections import defaultdict

import pyarrow.parquet as pq

from auditloom.operators import keywords, robots
from auditloom.sources.html import parse_pages
from auditloom.streaming import ratelimit

SF = "/root/testdata/sf0.001"
BODY = "User-agent: *\nDisallow: /admin/ # no\nAllow: /admin/public\nDisallow: /*.pdf$\nDisallow:\n\nUser-agent: GPTBot\nSitemap: http://x/s.xml\nUser-agent: Quiet\nDisallow: /\n\nUser-agent: Free\n"


def test_robots(spark):
    table = spark.createDataFrame([("s", 200, "text/plain", BODY), ("h", 200, "text/html", "Disallow: /"), ("gone", 404, None, "User-agent: *\nDisallow: /"), ("tie", 200, None, "User-agent: *\nDisallow: /a\nAllow: /a")], "site string, status int, content_type string, body string")
    cases = [("s", "Googlebot", "/", True), ("s", "Googlebot", "/admin/x", False), ("s", "Googlebot", "/admin/public/page", True), ("s", "GPTBot", "/", False), ("s", "Quiet", "/x", False), ("s", "Googlebot", "/f.pdf", False), ("s", "Googlebot", "/f.pdfs", True), ("s", "FreeBot", "/admin/", True), ("h", "any", "/", True), ("gone", "any", "/", True), ("tie", "any", "/a", True)]
    asked = spark.createDataFrame([c[:3] for c in cases], "site string, bot string, path string")
    assert {tuple(r) for r in robots.allowed(table, asked).collect()} == set(cases)


def test_keywords(spark):
    pages = spark.createDataFrame([(1, "http://s.test/", "<title>Roof repair</title><body><h1>Roof repair</h1><p>Roof repair, the best. 2024 roof-tiles and repair.</p></body>")], "page_id long, url string, html string")
    got = {(r.kind, r.term): (r["rank"], r.score) for r in keywords.keywords(parse_pages(pages)).collect()}
    assert got["word", "repair"] == (1, 11) and got["word", "roof"] == (2, 10) and got["phrase", "roof repair"] == (1, 100)
    assert ("word", "2024") not in got and ("word", "the") not in got


def test_rate_limiter_matches_brute_force(spark):
    rows = pq.read_table(f"{SF}/events.parquet", columns=["event_id", "user_id", "ts"]).to_pylist()
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", "ts")
    want, passed = {}, defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["ts"], r["event_id"])):
        young = [t for t in passed[r["user_id"]] if (r["ts"] - t).total_seconds() < 86400]
        want[r["event_id"]] = len(young) < 2
        if want[r["event_id"]]:
            passed[r["user_id"]].append(r["ts"])
    got = {r.event_id: r.passed for r in ratelimit.rate_limited(events, "user_id", "ts", "event_id", 2, 86400).collect()}
    assert got == want and len(set(want.values())) == 2
