"""Check results over a stream of pages: any split into batches gives what one go over the pages in force gives."""

import random

import pytest

from auditloom.plans import checks
from auditloom.sources.html import parse_pages
from auditloom.streaming.site_results import SiteResults
from auditloom.tables import shared

SCHEMA = "page_id long, url string, html string, version int"


def _versions(rng):
    """Pages of three sites in up to three versions each; some move to another site."""
    out = []
    for i in range(24):
        for v in range(rng.randint(1, 3)):
            site = rng.choice(["a.test", "b.test", "www.a.test"] if v else ["a.test", "b.test", "c.test"])
            title = rng.choice(["Same title", f"Title {i}", ""])
            links = "".join(f"<a href='/p{rng.randrange(24)}/'>l</a>" for _ in range(rng.randint(0, 4)))
            words = " ".join(f"w{k}" for k in range(rng.choice([3, 150])))
            out.append((i, f"https://{site}/p{i}/" if i else f"https://{site}/", f"<title>{title}</title><h1>{rng.choice(['x', ''])}</h1>{links}<img src=a.png><p>{words}</p>", v))
    return out


def _in_force(rows):
    best = {}
    for r in rows:
        if r[0] not in best or r[3] >= best[r[0]][3]:
            best[r[0]] = r
    return list(best.values())


def _results(df):
    return sorted(map(tuple, df.select("site", "check_id", "status", "n_bad", "n_total").collect()))


@pytest.mark.parametrize("seed", [1])
def test_any_split_equals_one_go(spark, seed):
    rng = random.Random(seed)
    rows = _versions(rng)
    rng.shuffle(rows)  # late versions included
    cuts = sorted(rng.sample(range(1, len(rows)), 2))
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    store = SiteResults(spark, shared(spark))
    for i, part in enumerate(parts):
        store.update(spark.createDataFrame(part, SCHEMA), i)
        if i == 1:
            store.update(spark.createDataFrame(part, SCHEMA), i)  # runs again: nothing changes
            store.compact()
            store.update(spark.createDataFrame(part, SCHEMA), i)
    pages = spark.createDataFrame([r[:3] for r in _in_force(rows)], "page_id long, url string, html string")
    assert _results(store.results()) == _results(checks.run_checks(parse_pages(pages)))
    assert sorted(r.page_id for r in store.in_force().collect()) == list(range(24))


def test_an_unmarked_batch_runs_again_and_a_site_goes(spark, monkeypatch):
    store = SiteResults(spark, shared(spark))
    first = spark.createDataFrame([(1, "https://old.test/", "<h1>a</h1>", 1), (None, "https://new.test/", "", 1)], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(SiteResults, "_mark", lambda self, folder: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            store.update(first, 0)
    assert store._folders() == []
    store.update(first, 0)
    assert {r.site for r in store.results().collect()} == {"old.test", "new.test"}
    store.update(spark.createDataFrame([(1, "https://new.test/x", "<h1>b</h1>", 2), (1, "https://new.test/y", "<h1>c</h1>", 1)], SCHEMA), 1)
    found = {(r.site, r.check_id): r for r in store.results().collect()}
    assert {s for s, _ in found} == {"new.test"} and found["new.test", "h1-present"].n_bad == 1
    store.update(spark.createDataFrame([], SCHEMA), 2)
    store.update(spark.createDataFrame([(1, "https://old.test/z", "<h1>late</h1>", 1)], SCHEMA), 3)
    assert _results(store.results()) == sorted(tuple(r) for r in found.values())


def test_pages_of_touched_sites_are_worked_out_once(spark, monkeypatch):
    """Checks of whole sites read them several times: from a written table, not by finding the pages in force again and again."""
    given = []
    real = checks.run_checks
    monkeypatch.setattr(checks, "run_checks", lambda pages, of=None: given.append(pages) or real(pages, of))
    store = SiteResults(spark, shared(spark))
    store.update(spark.createDataFrame([(1, "https://a.test/", "<h1>a</h1>", 1)], SCHEMA), 0)
    assert len(given) == 1 and "Window" not in given[0]._jdf.queryExecution().optimizedPlan().toString()
