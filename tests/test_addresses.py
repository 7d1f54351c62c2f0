"""References against the page they stand on: one table of cases for the native form and for the parser's."""

import random

import pytest
from pyspark.sql import functions as F

from auditloom.functions import urls
from auditloom.sources.html import absolute

BASE = "https://Site.test/a/b/c?x=1#y"
CASES = [
    ("a/../b", "https://site.test/a/b/b"), ("./", "https://site.test/a/b/"), ("..", "https://site.test/a/"), ("../../../../z", "https://site.test/z"), ("d/./e/.", "https://site.test/a/b/d/e/"),
    ("%2E%2e/z", "https://site.test/a/z"), ("/q/%2e/r", "https://site.test/q/r"), ("...", "https://site.test/a/b/..."), ("//H.test/p", "https://h.test/p"), ("//h.test", "https://h.test/"), ("///h.test/x", "https://h.test/x"),
    ("?q=1", "https://site.test/a/b/c?q=1"), ("?", "https://site.test/a/b/c?"), ("", "https://site.test/a/b/c?x=1"), ("#top", "https://site.test/a/b/c?x=1"), ("\\\\h.test\\p", "https://h.test/p"), ("\\x\\y?z=\\w", "https://site.test/x/y?z=\\w"),
    ("http://h.test:80/p", "http://h.test/p"), ("https://h.test:443", "https://h.test/"), ("https://h.test:8443/p", "https://h.test:8443/p"), ("http://h.test:443/", "http://h.test:443/"), ("http://h.test:/", "http://h.test/"),
    ("HTTPS://H.TEST/P", "https://h.test/P"), ("https:rel", "https://site.test/a/b/rel"), ("http:other.test/x", "http://other.test/x"), (" \t/sp\nace ", "https://site.test/space"), ("/a b", "https://site.test/a b"), ("/é", "https://site.test/é"),
    ("http://h.test/a/../../b/./?c=../d#e", "http://h.test/b/?c=../d"), ("https://u:p@h.test/", "https://u:p@h.test/"), ("http://[::1]:80/x", "http://[::1]/x"), ("mailto:x@y.z", None), ("javascript:void(0)", None), ("http://", None), ("data:text/html,x", None), ("tel:+1", None),
]


@pytest.mark.parametrize(("href", "want"), CASES)
def test_parser(href, want):
    assert absolute(href, BASE) == want


def test_native(spark):
    rows = [(h, BASE) for h, _ in CASES] + [(None, BASE), ("/x", None)]
    got = [r.x for r in spark.createDataFrame(rows, "h string, b string").select(urls.resolve(F.col("h"), F.col("b")).alias("x")).collect()]
    assert got == [*(w for _, w in CASES), None, None]


def test_both_agree_on_random_references(spark):
    rng = random.Random(8)
    parts = ["a", "..", ".", "%2e", "/", "//", "\\", "?", "#", ":", "http:", "https://", "h.test", ":80", "x=1", "é", " ", ""]
    bases = [BASE, "http://h.test", "http://h.test:8080/x/", "https://h.test?q"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 6))), rng.choice(bases)) for _ in range(1500)]
    got = [r.x for r in spark.createDataFrame(rows, "h string, b string").select(urls.resolve(F.col("h"), F.col("b")).alias("x")).collect()]
    wrong = [(h, b, x, absolute(h, b)) for (h, b), x in zip(rows, got, strict=True) if x != absolute(h, b)]
    assert wrong == []
