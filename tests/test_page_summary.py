"""Failing pages and the page summary against brute force, on a host of more pages than a display shows."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from auditloom.plans import checks, crawl
from auditloom.plans.registry import PAGE_CHECKS as ALL
from auditloom.sources.html import parse_pages


PAGE_CHECKS = [c for c in ALL if c.kind != "site"]


def _brute_affected(silver):
    """From each page's own values, without the engine's joins."""
    values = [F.expr(f"struct(coalesce({c.cohort}, false) as within, cast({c.test} as string) as value)").alias(f"c{i}") for i, c in enumerate(PAGE_CHECKS)]
    pages = crawl.enriched(crawl.Crawl(silver)).select("site", "page_id", "is_home", *values).collect()
    sites = defaultdict(list)
    for p in pages:
        sites[p.site].append(p)
    out = set()
    for mine in sites.values():
        for i, c in enumerate(PAGE_CHECKS):
            held = [(p, p[f"c{i}"].value) for p in mine if p[f"c{i}"].within and (c.kind != "home" or p.is_home)]
            if c.kind in ("page", "home"):
                bad = [p for p, v in held if v == "true"]
            elif c.kind == "group":
                n = Counter(v for _, v in held)
                bad = [p for p, v in held if v and n[v] > 1]
            else:
                bad = [] if any(v == "true" for _, v in held) else [p for p, _ in held if p.is_home or c.cohort != "true"]
            out |= {(c.id, p.page_id) for p in bad}
    homes = {p.site: p.page_id for p in pages if p.is_home}
    out |= {(r.check_id, homes[r.site]) for r in checks.site_outcomes(silver).where("status = 'failed'").collect()}
    return out, [p.page_id for p in pages]


def test_all_pages_of_a_host_count(spark):
    rows = [(i, f"http://big.test/a/{i}/" if i else "http://big.test/", f"<title>page {i // 2 if i < 100 else i}</title><body>text {i}") for i in range(230)]
    rows += [(1000, "http://good.test/", "<html lang=en><title>A</title><h1>x</h1><a href='/privacy'>privacy</a>"), (1001, None, None), (1002, "http://good.test/b/", "<title>a</title>")]
    silver = parse_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).cache()
    want, ids = _brute_affected(silver)
    affected = [(r.check_id, r.page_id) for r in checks.affected_pages(silver).collect()]
    assert len(affected) == len(set(affected)) and set(affected) == want
    severity = {c.id: c.severity for c in ALL}
    issues, critical = Counter(p for _, p in want), Counter(p for c, p in want if severity[c] == "critical")
    assert sorted((r.page_id, r.issues, r.critical) for r in checks.page_summary(silver).collect()) == sorted((i, issues[i], critical[i]) for i in ids)
    assert ("title-unique-across-site", 99) in want and ("privacy-policy-linked", 0) in want and ("schema-breadcrumb", 229) in want
    shown = checks.affected_pages(silver, most=checks.MOST_AFFECTED).groupBy("site", "check_id").count().agg(F.max("count")).first()[0]
    assert shown == checks.MOST_AFFECTED
