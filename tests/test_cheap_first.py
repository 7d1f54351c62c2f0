"""Patterns are asked only of texts that may match, without any match lost; what a failed check is about is told without them."""

import itertools

from pyspark.sql import functions as F

from auditloom.plans import checks, registry
from auditloom.sources.html import parse_pages

HTML = [
    "x gtag( y", "fbq(1", "STATIC.hotjar.com", "GTAG(", "gtag", "Clarity.MS", "clarity-ms", "ym(12", "YM(a", "Top.Mail.ru", "vK.com/rtrg", "vK.com/rtrg", "cooKie", "COOKIE", "cooKıe", "КУКИ", "куки", "co okie", "cookıe", None, "",
    "<img a src='http://a'>", "<IMG\nSRC=\"HTTP://a\">", "<link href='http://x/a.css", "<a HREF='TEL:1'>", "<a href=\"mailto:a\">", "<a href=tel:1>",
]
TEXT = [
    "Lorem Ipsum", "lorem ıpsum", "LOREM IPſUM", "Dolor ſit amet", "ſample text", "SAMPLE TEXT", "ЗДЕСЬ БУДЕТ ТЕКСТ", "ᲁдесь будет текст", "здесь буᲁет ᲄекст", "Рыба текст", "ТЕКСТ-ЗАГЛУШКА", "тут будет описание", "рыба",
    "10 руб", "10 РУБ.", "ОТ 1 000 ₽", "5 р.", "5 Р.", "5 p.", "₽ 5", "+7 (999) 123-45-67", "8 999 123 45 67", "7 999 123 45 67", "8 999", "a@b.c", "a@b", "@b.c", None, "",
]


def test_no_match_is_lost(spark):
    asked = {f"h{i}": (registry.first(p, "html", *registry.openings(p), folded="low"), f"html rlike {registry.q(p)}") for i, p in enumerate(p for k in registry.TRACKERS.values() for p in k.values())}
    asked |= {"cookie": (registry._COOKIE, "html rlike '(?iu)cookie|куки'"), "mixed": (registry._MIXED, f"html rlike {registry.q(registry.MIXED)}")}
    asked |= {"price": (registry._PRICED, f"text rlike {registry.q(registry.PRICE)}"), "place": (registry._PLACEHOLDER, f"text rlike {registry.q(registry.PLACEHOLDER_TEXT)}")}
    plain = [f"html rlike {registry.q(registry.CONTACT_HTML)}", *(f"text rlike {registry.q(p)}" for p in (registry.CONTACT_PHONE, registry.CONTACT_MAIL))]
    asked["contacts"] = (registry._CONTACTS, " or ".join(plain))
    rows = spark.createDataFrame([(h, t) for h, t in itertools.chain(((h, "") for h in HTML), (("", t) for t in TEXT), [(None, "a@b.c"), (None, None)])], "html string, text string").withColumn("low", F.lower("html"))
    got = rows.select("html", "text", *[F.expr(f"struct(coalesce({a}, false) as quick, coalesce({b}, false) as plain)").alias(n) for n, (a, b) in asked.items()]).collect()
    assert [(r.html, r.text, n) for r in got for n in asked if r[n].quick != r[n].plain] == []
    assert all(any(r[n].plain for r in got) for n in asked)


def test_cohorts_of_failed_checks_ask_no_pattern(spark):
    silver = parse_pages(spark.createDataFrame([(1, "http://a.test/", "<p>x"), (2, "http://a.test/b/c/", "<p>y")], "page_id long, url string, html string"))
    found = checks.affected(silver.cache())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "mailto" not in plan and "privacy" not in plan
    assert ("schema-breadcrumb", 2) in {(r.check_id, r.page_id) for r in found.collect()}
