"""Keywords of whole bodies."""

from auditloom.operators import keywords
from auditloom.sources.html import parse_pages


def test_words_past_20000_characters_count(spark):
    page = "<title>A</title><body><p>" + "filler. " * 3000 + "</p><p>" + "latecomer. " * 50 + "</p></body>"
    silver = parse_pages(spark.createDataFrame([(1, "http://s.test/", page)], "page_id long, url string, html string"))
    scores = lambda **how: {r.term: r.score for r in keywords.keywords(silver, **how).collect()}
    assert scores()["latecomer"] == 50 and scores()["filler"] == 3000
    assert "latecomer" not in scores(body_chars=20_000)
