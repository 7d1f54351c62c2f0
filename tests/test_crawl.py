"""A whole crawl with planted defects, and small tables against the SQL."""

import sys
from pathlib import Path

import duckdb
import pytest

from auditloom.operators import keywords, queries, robots
from auditloom.plans import checks, crawl
from auditloom.sources import sitemaps
from auditloom.sources.html import mobile_css, parse, parse_pages
from auditloom.tables import written

sys.path.insert(0, str(Path(__file__).resolve().parent))
import sites  # noqa: E402

HEADERS = "map<string,string>"
SENT = f"page_id long, url string, html string, status int, headers {HEADERS}, bytes long, ttfb_ms int"


def whole_crawl(spark) -> crawl.Crawl:
    """All tables of a crawl of the three sites."""
    table = spark.createDataFrame
    good, bad = "orchard.test", "wreck.test"
    pages = [(i, sites.GOOD + p, h, 200, sites.GOOD_HEADERS, 20_000, 50) for i, (p, h) in enumerate(sites.GOOD_PAGES.items(), 1)]
    pages += [(i, u, h, status, sites.BAD_HEADERS, 3 << 20, 2000) for i, (u, (status, h)) in enumerate(sites.BAD_PAGES.items(), 101)]
    pages += [(201, sites.BARE, "", 200, {}, 10, 50)]
    hops = lambda *urls: [(u, 301 if i + 1 < len(urls) else 200) for i, u in enumerate(urls)]
    chains = [
        (good, "home", hops(sites.GOOD + "/"), sites.GOOD + "/", 200, False),
        (good, "http", hops("http://orchard.test/", sites.GOOD + "/"), sites.GOOD + "/", 200, False),
        (good, "alt_host", hops("https://www.orchard.test/", sites.GOOD + "/"), sites.GOOD + "/", 200, False),
        (bad, "home", hops(sites.BAD + "/a", sites.BAD + "/b", sites.BAD + "/c", sites.BAD + "/"), sites.BAD + "/", 503, True),
        (bad, "alt_host", hops("http://www.wreck.test/"), "http://www.wreck.test/", 200, False),
        ("bare.test", "http", hops("http://bare.test/"), "http://bare.test/", 200, False),
    ]
    custom = "<a href=/a>a</a><a href=/b>b</a><a href=/c>c</a>" + "." * 1500
    probes = [(good, "not_found", sites.GOOD + "/none", 404, custom), (good, "favicon", sites.GOOD + "/favicon.ico", 200, ""), (bad, "not_found", sites.BAD + "/none", 200, "here"), (bad, "favicon", sites.BAD + "/favicon.ico", 404, "")]
    robots_txt = [(good, 200, "text/plain", "User-agent: *\nDisallow: /basket/\n\nSitemap: https://orchard.test/map.xml"), (bad, 200, "text/html", "<html>User-agent: *"), ("bare.test", 200, "text/plain", "User-agent: *\nDisallow: /")]
    documents = [(good, sites.GOOD + "/map.xml", 200, "<urlset>" + "".join(f"<url><loc>{sites.GOOD}{p}</loc></url>" for p in sites.GOOD_PAGES) + "</urlset>"), (bad, sites.BAD + "/sitemap.xml", 404, ""), ("bare.test", "https://bare.test/sitemap.xml", 200, "<html>")]
    rules_of = table(robots_txt, "site string, status int, content_type string, body string")
    found = sitemaps.load_sitemaps(table(documents, "site string, url string, status int, body string"), table([(good, sites.GOOD), (bad, sites.BAD), ("bare.test", "https://bare.test")], "site string, origin string"), rules_of)
    kept = {"cache-control": "max-age=600"}
    assets = [
        (good, sites.GOOD + "/trees.webp", "image", 200, 20_000, "image/webp", kept, None),
        (good, sites.GOOD + "/main.css", "css", 200, 900, "text/css", kept, "img { max-width: 100% }"),
        (bad, sites.BAD + "/IMG_001.jpg", "image", 200, 900_000, "image/jpeg", {}, None),
        (bad, sites.BAD + "/x.png", "image", 404, 0, "text/html", {}, None),
    ]
    statuses = [(good, sites.GOOD + p, 200) for p in sites.GOOD_PAGES] + [(bad, sites.BAD + "/gone", 404), (bad, sites.BAD + "/moved", 302), (bad, sites.BAD + "/w1", 500)]
    return crawl.Crawl(
        written(parse_pages(table(pages, SENT))),
        chains=table(chains, "site string, kind string, hops array<struct<url:string,status:int>>, final_url string, final_status int, loop boolean"),
        probes=table(probes, "site string, kind string, url string, status int, body string"),
        robots=rules_of,
        sitemaps=found.sitemaps,
        sitemap_urls=found.urls,
        assets=table(assets, f"site string, url string, role string, status int, bytes long, content_type string, headers {HEADERS}, body string"),
        link_status=table(statuses, "site string, url string, status int"),
    )


def expected() -> dict[tuple[str, str], str]:
    """Of each of the 127 checks: the sound site passes it, the broken one fails it, but for what is named in sites.py with its reason."""
    want = {}
    for c in checks.ALL_CHECKS:
        want["orchard.test", c.id] = "na" if c.id in sites.GOOD_NA else "passed"
        want["wreck.test", c.id] = "na" if c.id in sites.BAD_NA else "passed" if c.id in sites.BAD_PASSED else "failed"
    return want


@pytest.fixture(scope="module")
def fixture(spark):
    return whole_crawl(spark)


def test_all_checks_of_a_sound_and_a_broken_site(fixture):
    results = checks.run_checks(fixture).cache()
    got = {(r.site, r.check_id): r.status for r in results.collect()}
    want = expected()
    assert len(want) == 2 * 127 and len(got) == 3 * 127
    assert {k: got[k] for k in want if got[k] != want[k]} == {}
    bare = {c: s for (site, c), s in got.items() if site == "bare.test"}
    planted = {c: status for status, ids in sites.BARE_STATUS.items() for c in ids}
    assert {c: bare[c] for c in planted if bare[c] != planted[c]} == {}
    scores = {r.site: r.score for r in checks.site_scores(checks.category_scores(results)).collect()}
    assert scores["orchard.test"] == 100 and scores["wreck.test"] <= 5
    stats = {r.site: r for r in checks.stats(results).collect()}
    assert all(r.check_count == 127 for r in stats.values()) and stats["orchard.test"].failed == 0 and stats["wreck.test"].failed == 127 - len(sites.BAD_NA) - len(sites.BAD_PASSED)
    assert checks.issues(results).count() == 3 * 127 and checks.weakest_categories(checks.category_scores(results)).count() == 9


def test_pages_that_checks_count_against(fixture):
    found = checks.affected_pages(fixture).collect()
    of = lambda check: {r.url for r in found if r.check_id == check and r.site == "wreck.test"}
    home, yard, deep, cat, naked = sites.BAD_PAGES
    assert not [r for r in found if r.site == "orchard.test"]
    assert of("no-mixed-content") == {deep} and of("url-no-cyrillic") == {cat} and of("title-unique-across-site") == {yard, deep} == of("description-unique-across-site")
    assert of("duplicate-content-across-pages") == {deep, cat} and of("no-broken-internal-links") == {yard} == of("no-links-to-redirects") and of("robots-txt-exists") == {home}
    assert of("https-enabled") == {home} and of("images-have-alt") == {yard, deep}
    summary = {r.url: r for r in checks.page_summary(fixture).collect()}
    assert home not in summary and summary[yard].issues > 20 and summary[sites.GOOD + "/"].issues == 0


ERRORS = [
    (1, "http://e.test/", 500, "<a href='/a'>a</a>"),
    (2, "http://e.test/a", 200, "<h1>apples apples apples</h1><a href='/b'></a>"),
    (3, "http://e.test/b", 404, "<h1>missing page missing page missing page</h1><a href='/c'>c</a>"),
    (4, "http://e.test/c", 200, ""),
]


def test_error_pages_give_no_links_and_no_keywords(spark):
    silver = parse_pages(spark.createDataFrame([(i, u, f"<html><body>{h}</body></html>", s) for i, u, s, h in ERRORS], "page_id long, url string, html string, status int"))
    assert sorted((r.source, r.target) for r in crawl.edges(silver).collect()) == [("http://e.test/", "http://e.test/a"), ("http://e.test/a", "http://e.test/b")]
    assert {r.term for r in keywords.keywords(silver).collect()} == {"apples", "apples apples", "apples apples apples"}
    orphans = {r.url for r in checks.affected_pages(silver).collect() if r.check_id == "no-orphan-crawled-pages"}
    assert orphans == {"http://e.test/c"}


def test_robots_facts_name_the_closed_bots(spark):
    body = "# all\nUser-agent: GPTBot\nUser-agent: Bingbot\nDisallow: /\nAllow: /open\n\nUser-Agent: *\nDisallow:\nSitemap: http://r.test/s.xml\nUnknown: x"
    table = spark.createDataFrame([("r.test", 200, "text/plain", body)], "site string, status int, content_type string, body string")
    facts = crawl.robots_facts(table, table.select("site")).first()
    assert facts.ai_closed == ["GPTBot", "Bingbot"] and sorted(facts.closed_to) == ["Bingbot", "GPTBot"] and facts.n_directives == 7 and facts.n_declared == 1
    assert robots.AI_BOTS[0] == "GPTBot"


def _long(kind, n=150, start=0):
    return " ".join(f"{kind}{i}" for i in range(start, start + n))


ODD = [
    ("http://a.test/", "<html lang=\"en\"><head><title>A title of more than thirty characters</title><meta name=\"description\" content=\"Welcome to the site\"><meta name=\"keywords\" content=\"a,b,c,d,e,f,g,h,i,j,k\"><meta name=\"viewport\" content=\"user-scalable=no\"><link rel=\"canonical\" href=\"//other.test/\"><link rel=\"canonical\" href=\"/x\"></head><body><h1>One</h1><h4>Four</h4><h2></h2><img src=\"IMG_1.jpg\" alt=\"IMG_1.jpg\" width=\"600\"><a href=\"//out.test/\"></a><table><tr><td>1</td></tr></table><button></button><video autoplay></video><object data=\"a.swf\"></object><script src=\"https://www.google-analytics.com/a.js\"></script></body></html>"),
    ("http://a.test/b/c/", "<html><head><title>A title  of more than thirty characters</title><meta name=\"description\" content=\"welcome  to the site\"><meta name=\"robots\" content=\"NOINDEX\"><script type=\"application/ld+json\">{\"@type\":\"WebSite\"</script><style>@media (min-width: 9px){.a{width:900px}} .b{width:700px;font-size:9px}</style></head><body><form><input name=\"email\" placeholder=\"mail\"></form><h1></h1>" + _long("w") + "</body></html>"),
    ("http://a.test/dup1/", "<html><body>" + _long("w", 400) + "</body></html>"),
    ("http://a.test/dup2/", "<html><body>" + _long("w", 400, 2) + "</body></html>"),
    ("http://a.test/dup3/", "<html><body>" + _long("w", 400, 2) + "</body></html>"),
    ("http://b.test/Upper/x.php?id=1", "<html><body class=\"breadcrumbs\"><main>FAQ <h2>Частые вопросы</h2></main><img src=\"a.png\"><a href=\"/policy\">политика</a><form><label>agree <input type=\"checkbox\" name=\"consent\" checked></label><input name=\"q\"><input name=\"phone\" aria-label=\"p\"></form><p>куки googletagmanager.com gtag(</p></body></html>"),
    ("http://b.test/", "<html><body><a href=\"/Upper/x.php?id=1\">x</a><a href=\"/a\">a</a><a href=\"/b/\">b</a><a href=\"/c/\">c</a><a href=\"/d\">d</a><nav><span role=\"link\" onclick=\"x()\">m</span></nav><img src=\"x.svg\"><img src=\"data:image/png;base64,x\"></body></html>"),
    ("http://c.test/", ""),
]


def test_odd_pages_match_the_sql(spark, tmp_path):
    spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(ODD)], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    statuses = set()
    for name in ("site_checks", "near_duplicate_pages", "link_edges", "affected_pages", "page_summary"):
        cursor = con.execute(queries.SQL[name])
        columns = [d[0] for d in cursor.description]
        want = sorted(repr(sorted(zip(columns, row, strict=True))) for row in cursor.fetchall())
        got = queries.QUERIES[name](spark, str(tmp_path)).collect()
        assert sorted(repr(sorted(r.asDict().items())) for r in got) == want, name
        if name == "site_checks":
            statuses = {(r.check_id, r.status) for r in got}
        if name == "near_duplicate_pages":
            assert {r.url for r in got} == {f"http://a.test/dup{i}/" for i in (1, 2, 3)}
    # checks that no page of the given tables sets off are set off here
    assert {(c, "failed") for c in "description-unique-across-site canonical-not-pointing-elsewhere canonical-single no-noindex-on-crawled-pages viewport-allows-zoom no-flash-or-applet jsonld-valid no-foreign-trackers font-size-not-tiny forms-have-consent consent-not-prechecked a11y-button-names a11y-no-autoplay-sound meta-keywords-not-overused description-not-generic images-have-alt duplicate-content-across-pages no-fixed-pixel-width-wrapper no-horizontal-overflow-hint nav-links-are-anchors trailing-slash-consistency cookie-notice-with-trackers".split()} <= statuses


def test_broken_markup_ends_no_job(spark):
    deep = "<div>" * 3000 + "deep"
    rows = [(1, "http://x.test/a", "<![x]><p>kept</p>"), (2, "http://x.test/b", "<![CDATA[ x ]]>y\x00z"), (3, "http://x.test/c", deep), (4, "http://[x/", "<a href='http://['>l</a>"), (5, "http://x.test/d", "<!DOCTYPE [<!ELEMENT a><a <b <<>>")]
    got = {r.page_id: r.text for r in parse_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "kept" and got[3] == "deep" and len(got) == 5


def test_form_facts_and_css():
    form = parse("<form><label for=c>персональных данных</label><input id=c type=checkbox><input name=a><input name=text placeholder=имя><input name=hp type=hidden></form>", "http://x.test/")["forms"][0]
    assert form == {"is_search": False, "personal_fields": 1, "unlabeled_fields": 2, "consent_checkbox": True, "consent_prechecked": False, "consent_text": True, "spam_protected": True}
    assert mobile_css("a{x:y} @media screen and (min-width: 3px) {b{width:999px} c{d:e}} f{g:h}") == "a{x:y}  f{g:h}"
