"""Scalar functions, redirect chains, the stream form of the rate limiter."""

import pytest
from pyspark.sql import functions as F

from auditloom.functions import report, urls
from auditloom.plans import redirects
from auditloom.streaming import ratelimit


def values(spark, column, rows, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(column).collect()]


def test_input_addresses(spark):
    given = ["президент.рф/path", "http://Example.com/path?q=1", "https://example.com:443/", "http://example.com:8080", "localhost", "http://10.0.0.1/", "ftp://example.com", "", None, "http://u:p@example.com", "x" * 3000, "http://printer.local", "http://[::1]/", "http://exa mple.com"]
    want = ["https://xn--d1abbgf6aiiy.xn--p1ai/", "http://example.com/", "https://example.com/", "http://example.com:8080/", *[None] * 10]
    assert [r["url"] for r in values(spark, urls.normalize_input_url(F.col("v")), given)] == want


def test_private_addresses(spark):
    private = ["10.1.2.3", "127.0.0.1", "0.0.0.0", "169.254.1.1", "172.16.0.1", "172.31.9.9", "192.168.1.1", "100.64.0.1", "100.127.0.1", "224.0.0.1", "255.255.255.255", "::1", "::", "FC00::1", "fd12::", "fe80::1", "::ffff:10.0.0.1"]
    public = ["8.8.8.8", "172.32.0.1", "172.15.0.1", "100.128.0.1", "192.169.0.1", "2001:db8::1", "::ffff:8.8.8.8"]
    assert values(spark, urls.is_private_ip(F.col("v")), private + public) == [True] * len(private) + [False] * len(public)


def test_addresses_and_headers(spark):
    v = F.col("v")
    assert values(spark, urls.short_url(v), ["https://A.test/p/q?x=1#h", "https://a.test", "no address"]) == ["a.test/p/q?x=1", "a.test/", "no address"]
    assert values(spark, urls.shortened(v), ["http://a.test/%D0%B0+b%2Fc?x", "http://a.test/" + "x" * 80]) == ["a.test/а+b%2Fc?x", "a.test/" + "x" * 23 + "…" + "x" * 30]
    assert values(spark, urls.is_file(v), ["http://a.test/f.PDF?x", "http://a.test/f", "http://a.test/a.woff2"]) == [True, False, True]
    assert values(spark, urls.charset_from_header(v), ["text/html; Charset = 'UTF-8'", "text/html", None]) == ["utf-8", None, None]
    assert values(spark, urls.is_html(F.lit(""), v), ["<!DOCTYPE html>", " " * 1000 + "<html>"]) == [True, False]
    assert values(spark, urls.client_ip(v, F.lit("9.9.9.9")), ["1.1.1.1, 2.2.2.2", None, " "]) == ["1.1.1.1", "9.9.9.9", "9.9.9.9"]
    assert values(spark, urls.client_ip(v, F.lit(None)), [None]) == ["local"]


def test_report_texts(spark):
    v = F.col("v")
    assert values(spark, report.plural(v, "а", "ы", ""), [1, 2, 5, 11, 12, 21, 22, 111, 114], "v int") == ["а", "ы", "", "", "", "а", "ы", "", ""]
    assert values(spark, report.first_sentence(v, F.lit("none")), ["Do it. Then that.", "No end", "v1.5 is out! Go", "", None, "a\nb."]) == ["Do it.", "No end", "v1.5 is out!", "none", "none", "a"]
    assert values(spark, report.tone(v), [80, 79, 50, 49], "v int") == ["good", "warn", "warn", "bad"]
    assert values(spark, report.rate(v, "lcp_ms"), [2500.0, 2501.0, 4001.0, None], "v double") == ["good", "warn", "bad", None]
    assert values(spark, report.escaped(v), ["<a href=\"x\">'&'</a>", None]) == ["&lt;a href=&quot;x&quot;&gt;&#39;&amp;&#39;&lt;/a&gt;", ""]
    assert values(spark, report.is_audit_id(v), ["0a1b2c3d-0000-1111-2222-333344445555", "0A1B2C3D-0000-1111-2222-333344445555", None]) == [True, False, False]
    json = '{"lighthouseResult":{"categories":{"performance":{"score":0.555},"best-practices":{"score":1}},"audits":{"cumulative-layout-shift":{"numericValue":0.12345}}}}'
    (speed,) = values(spark, report.page_speed(v), [json])
    assert (speed.performance, speed.best_practices, speed.seo, speed.cls, speed.lcp_ms) == (56, 100, None, 0.123, None)


def test_redirect_chains(spark):
    answers = [("/a", 301, "/b"), ("/b", 302, "http://s.test/c?x"), ("/c?x", 200, None), ("/l1", 301, "l2"), ("/l2", 301, "/l1"), ("/n", 301, None), *((f"/x{i}", 301, f"/x{i + 1}") for i in range(20))]
    responses = spark.createDataFrame([("s.test", "http://s.test" + u, s, to) for u, s, to in answers], "site string, url string, status int, location string")
    starts = spark.createDataFrame([("s.test", k, "http://s.test" + u) for k, u in (("home", "/a"), ("loop", "/l1"), ("gone", "/zz"), ("bare", "/n"), ("long", "/x0"))], "site string, kind string, url string")
    got = {r.kind: (len(r.hops), r.final_url.removeprefix("http://s.test"), r.final_status, r.loop) for r in redirects.redirect_chains(responses, starts).collect()}
    assert got == {"home": (3, "/c?x", 200, False), "loop": (2, "/l2", 301, True), "gone": (1, "/zz", 0, False), "bare": (1, "/n", 301, False), "long": (9, "/x8", 301, True)}


def test_reachable(spark):
    edges = spark.createDataFrame([("s", a, b) for a, b in ("ab", "bc", "ca", "bd", "xy")], "site string, source string, target string")
    got = {r.url: r.depth for r in redirects.reachable(edges, spark.createDataFrame([("s", "a")], "site string, url string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 2}


@pytest.mark.parametrize("limit", [2])
def test_stream_limits_like_the_table(spark, tmp_path, limit):
    rows = [(i, i % 3, i * 400) for i in range(60)]
    hits = spark.createDataFrame(rows, "id long, k long, s long").select("id", "k", F.timestamp_seconds("s").alias("at"))
    want = {r.id: r.passed for r in ratelimit.rate_limited(hits, "k", "at", "id", limit, 3600).collect()}
    hits.where("id < 30").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(hits.schema).parquet(str(tmp_path / "in"))
    query = ratelimit.stream_limited(stream, "k", "at", "id", limit, 3600).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).outputMode("append")
    query.trigger(availableNow=True).start().awaitTermination()
    hits.where("id >= 30").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query.trigger(availableNow=True).start().awaitTermination()
    assert {r.id: r.passed for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want and len(set(want.values())) == 2
