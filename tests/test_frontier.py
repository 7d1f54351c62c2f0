"""The plan of a crawl against a queue that is walked by hand, with budgets, robots.txt, redirects and error pages."""

import random
from collections import deque

import pytest

from auditloom.operators import robots
from auditloom.plans import frontier, redirects
from auditloom.sources.html import parse_pages
from auditloom.tables import numbered


def _queue(home, links, sitemap, opens, budget):
    """(url, depth, via) in the order of two first-in-first-out queues."""
    first, second, seen, out = deque(), deque(), {home}, []

    def put(queue, url, depth, via):
        if url not in seen:
            seen.add(url)
            queue.append((url, depth, via))

    def take(url, depth, via):
        out.append((url, depth, via))
        for target in links.get(url, ()):
            put(first, target, depth + 1, "link")

    take(home, 0, "home")
    for url in sitemap:
        put(second, url, 0, "sitemap")
    while (first or second) and (budget is None or len(out) < budget):
        url, depth, via = (first or second).popleft()
        if url in opens:
            take(url, depth, via)
    return out[:budget]


def _site(rng, name, n, most):
    urls = [f"https://{name}/p{i}" for i in range(n)]
    links = {u: [rng.choice(urls + [f"https://{name}/gone{i}" for i in range(n // 4)]) for _ in range(rng.randint(0, most))] for u in urls}
    return urls, {u: list(dict.fromkeys(t)) for u, t in links.items()}


@pytest.mark.parametrize("budget", [None, 1, 7, 60])
def test_plan_equals_a_queue(spark, budget):
    rng = random.Random(11)
    pages, edges, maps, want = [], [], [], []
    for site, n, most in (("a.test", 260, 2), ("b.test", 230, 5), ("c.test", 40, 1), ("d.test", 1, 0), ("e.test", 12, 0)):
        urls, links = _site(rng, site, n, most)
        home, opens = urls[0], {urls[0], *(u for u in urls if rng.random() < 0.9)}
        listed = rng.sample(urls, n // 2) + [f"https://{site}/only-listed"] + rng.sample(urls, n // 9)
        pages += [(site, u, u == home) for u in opens]
        edges += [(site, u, t, i * 3) for u in opens for i, t in enumerate(links[u])]
        maps += [(site, i + 1, u) for i, u in enumerate(listed)]
        want += [(site, i + 1, *x) for i, x in enumerate(_queue(home, links, listed, opens, budget))]
    pages += pages[:3] + [(None, "https://x.test/", True), ("f.test", None, True), ("g.test", "https://g.test/", False)]
    table = spark.createDataFrame
    found = frontier.plan(table(pages, "site string, url string, is_home boolean"), table(edges, "site string, source string, target string, pos int"), table(maps, "site string, order long, url string"), budget)
    assert found.columns == ["site", "order", "url", "depth", "via"]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_a_long_chain_of_pages(spark):
    pages = [("s", f"http://s/{i}", i == 0) for i in range(25)]
    links = [("s", f"http://s/{i}", f"http://s/{i + 1}", 0) for i in range(24)]
    table = spark.createDataFrame
    found = frontier.plan(table(pages, "site string, url string, is_home boolean"), table(links, "site string, source string, target string, pos int"))
    assert [(r.order, r.depth) for r in sorted(found.collect())] == [(i + 1, i) for i in range(25)]
    reached = redirects.reachable(table([x[:3] for x in links], "site string, source string, target string"), table([("s", "http://s/0")], "site string, url string"), parts=3)
    assert sorted((r.depth, r.url) for r in reached.collect()) == sorted((i, f"http://s/{i}") for i in range(25))


PAGES = [
    (1, "https://shop.test", 200, "<a href='/b?x=1#top'>b</a><a href='/moved'>m</a><a href='/closed/x'>c</a><a href='/a.pdf'>f</a><a href='//www.shop.test/w'>w</a><a href='https://else.test/'>o</a><a href='/err'>e</a>"),
    (2, "https://shop.test/b?x=1", 200, "<a href='/'>home</a><a href='/deep/'>d</a>"),
    (3, "https://shop.test/new", 200, ""),
    (4, "https://shop.test/closed/x", 200, ""),
    (5, "https://www.shop.test/w", 200, ""),
    (6, "https://shop.test/err", 500, "<a href='/only-from-error'>x</a>"),
    (7, "https://shop.test/only-from-error", 200, ""),
    (8, "https://shop.test/deep/", 200, ""),
    (9, "https://shop.test/listed", 200, "<a href='/under'>u</a>"),
    (10, "https://shop.test/under", 200, ""),
    (11, "https://shut.test/", 200, "<a href='/y'>y</a>"),
    (12, "https://shut.test/y", 200, ""),
]
ROBOTS = [("shop.test", "User-agent: *\nDisallow: /closed/\n"), ("shut.test", "User-agent: LoomBot\nDisallow: /\n")]


def test_silver_robots_redirects_and_errors(spark):
    table = spark.createDataFrame
    silver = parse_pages(table([(i, u, f"<html><body>{h}</body></html>", s) for i, u, s, h in PAGES], "page_id long, url string, html string, status int"))
    rules = table([(s, 200, "text/plain", b) for s, b in ROBOTS], "site string, status int, content_type string, body string")
    moved = table([("shop.test", "https://shop.test/moved", "https://shop.test/new")], "site string, url string, final_url string")
    listed = table([("shop.test", 1, "https://shop.test/listed"), ("shop.test", 2, "https://else.test/z"), ("shop.test", 3, "https://shop.test/b?x=1"), ("shop.test", 4, "https://shop.test/closed/x")], "site string, order long, url string")
    plan = sorted(map(tuple, frontier.crawl_plan(silver, listed, rules, "LoomBot", moved).collect()))
    at = "https://shop.test"
    assert plan == [("shop.test", i + 1, at + u, d, v) for i, (u, d, v) in enumerate([("/", 0, "home"), ("/b?x=1", 1, "link"), ("/new", 1, "link"), ("/deep/", 2, "link"), ("/listed", 0, "sitemap"), ("/under", 1, "link")])]
    other = frontier.crawl_plan(silver, bot="OtherBot", robots=rules, budget=2)
    assert sorted((r.site, r.order, r.url) for r in other.collect()) == [("shop.test", 1, at + "/"), ("shop.test", 2, at + "/b?x=1"), ("shut.test", 1, "https://shut.test/"), ("shut.test", 2, "https://shut.test/y")]
    assert frontier.crawl_plan(silver.limit(0)).collect() == []
    assert [r.site for r in robots.blocked(rules, "LoomBot").collect()] == ["shut.test"] and robots.blocked(rules, "Loom").collect() == []


@pytest.mark.parametrize(("url", "key"), [("http://a.b", "http://a.b/"), ("http://a.b?x#y", "http://a.b/?x"), ("http://a.b/c#d", "http://a.b/c"), ("http://a.b/?u=http://c.d", "http://a.b/?u=http://c.d")])
def test_canonical_key(spark, url, key):
    assert spark.range(1).select(frontier.canonical_key(frontier.F.lit(url))).first()[0] == key


def test_numbered_spreads_a_hot_site(spark):
    rows = [("hot" if i % 3 else f"s{i % 5}", i * 7 % 1000) for i in range(1000)] + [(None, 1), (None, 2)]
    got = numbered(spark.createDataFrame(rows, "site string, x long").repartition(7), "site", "x").collect()
    for site in {r[0] for r in rows}:
        own = sorted((r.order, r.x) for r in got if r.site == site)
        assert own == list(enumerate(sorted(x for s, x in rows if s == site), 1))
