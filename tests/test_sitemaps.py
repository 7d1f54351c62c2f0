"""Sitemap documents: candidates, nested and cyclic indexes, namespaces, limits."""

from auditloom.sources import sitemaps

S = "https://s.test"


def _set(*urls, ns=""):
    return f"<?xml version='1.0'?><{ns}urlset>" + "".join(f"<{ns}url><{ns}loc>{u}</{ns}loc></{ns}url>" for u in urls) + f"</{ns}urlset>"


def _index(*urls):
    return "<sitemapindex xmlns='x'>" + "".join(f"<sitemap><loc>\n {u} </loc><lastmod>1</lastmod></sitemap>" for u in urls) + "</sitemapindex>"


DOCS = [
    ("a", f"{S}/one.xml", 404, ""),
    ("a", f"{S}/two.xml", 200, _index(f"{S}/c1", f"{S}/gone", f"{S}/nested", f"{S}/c2", f"{S}/page")),
    ("a", f"{S}/c1", 200, _set("u1", "u2")),
    ("a", f"{S}/nested", 200, _index(f"{S}/two.xml", f"{S}/c3", f"{S}/nested", f"{S}/c1")),
    ("a", f"{S}/c3", 200, _set("u3", ns="sm:")),
    ("a", f"{S}/c2", 200, "﻿ <urlset><!-- <url><loc>no</loc></url> --><url><image:image xmlns:image='i'><image:loc>no</image:loc></image:image><loc><![CDATA[u4?a=1&b=2]]></loc></url><url><lastmod/></url><url><loc>u5?a=1&amp;b=&lt;</loc></url><url><loc> </loc></url></urlset>"),
    ("a", f"{S}/page", 200, "<?xml version='1.0'?><html><url><loc>no</loc></url></html>"),
    ("a", f"{S}/sitemap.xml", 200, _set("default")),
    ("b", f"{S}/sitemap.xml", 200, "<html>soft 404</html>"),
    ("c", f"{S}/sitemap.xml", None, None),
    ("d", f"{S}/d.xml", 200, _set()),
]
ROBOTS = [("a", f"Sitemap: {S}/one.xml\nsitemap:{S}/two.xml\nSitemap: {S}/one.xml\n"), ("d", f"User-agent: *\nSitemap: {S}/d.xml"), ("x", "Sitemap: y")]


def _load(spark, **limits):
    documents = spark.createDataFrame(DOCS + DOCS[:3], "site string, url string, status int, body string")
    origins = spark.createDataFrame([(s, S) for s in "abcde"], "site string, origin string")
    robots = spark.createDataFrame([(s, 200, "text/plain", b) for s, b in ROBOTS], "site string, status int, content_type string, body string")
    found = sitemaps.load_sitemaps(documents, origins, robots, **limits)
    return {r.site: tuple(r)[1:] for r in found.sitemaps.collect()}, [(r.url, r.source.removeprefix(S)) for r in sorted(found.urls.collect()) if r.site == "a"]


def test_candidates_and_nested_indexes(spark):
    of_sites, urls = _load(spark)
    assert of_sites == {
        "a": (f"{S}/two.xml", 200, True, True, True),
        "b": (f"{S}/sitemap.xml", 200, True, False, False),
        "c": (f"{S}/sitemap.xml", 0, False, False, False),
        "d": (f"{S}/d.xml", 200, True, True, False),
        "e": (f"{S}/sitemap.xml", 0, False, False, False),
    }
    assert urls == [("u1", "/c1"), ("u2", "/c1"), ("u3", "/c3"), ("u4?a=1&b=2", "/c2"), ("u5?a=1&b=<", "/c2")]


def test_limits_are_options(spark):
    _, urls = _load(spark, max_children=3, max_depth=1)
    assert urls == [("u1", "/c1"), ("u2", "/c1"), (f"{S}/two.xml", "/nested"), (f"{S}/c3", "/nested"), (f"{S}/nested", "/nested"), (f"{S}/c1", "/nested")]
    assert _load(spark, max_urls=3)[1] == [("u1", "/c1"), ("u2", "/c1"), ("u3", "/c3")]
    of_sites, urls = _load(spark, max_candidates=1)
    assert of_sites["a"] == (f"{S}/one.xml", 404, False, False, False) and urls == []


def test_no_documents(spark):
    documents = spark.createDataFrame([], "site string, url string, status int, body string")
    found = sitemaps.load_sitemaps(documents, spark.createDataFrame([], "site string, origin string"))
    assert found.sitemaps.collect() == [] and found.urls.collect() == []
