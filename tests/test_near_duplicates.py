"""Near-duplicate pages: editions of the given pages against SQL, and pages of one template against every pair compared."""

import random
from itertools import combinations
from pathlib import Path

import duckdb

from auditloom.operators import queries
from auditloom.plans import crawl

SF = "/root/testdata/sf0.001"


def test_editions_match_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    want = sorted(con.execute(queries.SQL["near_duplicate_editions"]).fetchall())
    got = sorted(map(tuple, queries.near_duplicate_editions(spark, SF).collect()))
    assert got == want and len(got) > 20
    assert len(got) < spark.read.parquet(f"{SF}/pages.parquet").count() * 3


def test_every_page_gets_every_edition(spark):
    """Whatever its page_id: a long page and its exact copy are found, and editions with other words are of all pages."""
    got = {r.url for r in queries.near_duplicate_editions(spark, SF).collect()}
    ids = {r.page_id: r.url.split("#")[0] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    has = lambda url, k: f"{url}{'&' if '?' in url else '?'}edition={k}" in got
    found = {i for i, url in ids.items() if url in got}
    assert len(found) > len(ids) / 2 and found == {i for i, url in ids.items() if has(url, 3)}
    assert {i % 5 for i in found} == {0, 1, 2, 3, 4} and {i % 2 for i, url in ids.items() if has(url, 2)} == {0, 1}


def _pages(seed):
    """Pages of a few paragraphs that many share: most share over half of their shingles with many others, few over nine tenths."""
    rng = random.Random(seed)
    pool = [" ".join(f"w{rng.randrange(400)}" for _ in range(30)) for _ in range(14)]
    rows = []
    for i in range(150):
        parts = rng.sample(pool, rng.choice([5, 6, 11, 13, 14]))
        rows.append(("s" if i % 3 else "t", f"http://s/{i:03d}", " ".join(sorted(parts))))
    for i in range(20):
        site, _, text = rng.choice(rows)
        words = text.split()
        for _ in range(rng.choice([0, 1, 2, 4])):
            words[rng.randrange(len(words))] = f"new{rng.randrange(9)}"
        rows.append((site, f"http://s/e{i}", " ".join(words)))
    return [*rows, rows[0], ("s", "http://s/none", None), ("s", "http://s/short", "a few words")]


def _shingles(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= crawl.MIN_WORDS else set()


def test_pages_of_one_template_match_brute_force(spark):
    for seed in (1, 2):
        rows = _pages(seed)
        silver = spark.createDataFrame([(*r, "", len((r[2] or "").split())) for r in rows], "site string, url string, text string, top_text string, words int")
        sets = {(site, url): _shingles(text) for site, url, text in rows}
        want = {p for x, y in combinations(sets, 2) if x[0] == y[0] and sets[x] and sets[y] and 10 * len(sets[x] & sets[y]) > 9 * len(sets[x] | sets[y]) for p in (x, y)}
        assert {tuple(r) for r in crawl.near_duplicates(silver).collect()} == want and 10 < len(want) < len(sets)


def test_it_does_not_matter_where_pages_stand(spark):
    """Pages beside their like, which are compared where they stand, and pages dealt out at random: both as brute force has it."""
    rows = _pages(3)
    silver = spark.createDataFrame([(*r, "", len((r[2] or "").split())) for r in rows], "site string, url string, text string, top_text string, words int")
    sets = {(site, url): _shingles(text) for site, url, text in rows}
    want = {p for x, y in combinations(sets, 2) if x[0] == y[0] and sets[x] and sets[y] and 10 * len(sets[x] & sets[y]) > 9 * len(sets[x] | sets[y]) for p in (x, y)}
    for placed in (silver.coalesce(1).sortWithinPartitions("site", "text"), silver.repartition(7)):
        assert {tuple(r) for r in crawl.near_duplicates(placed).collect()} == want and len(want) > 10


def test_shuffles_stay_near_the_input(spark):
    """Pages with their editions: not every shingle travels, and sets only where pages may be alike."""
    context, sf = spark.sparkContext, SF.replace("0.001", "0.01")

    def shuffled():
        stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    before = shuffled()
    assert queries.near_duplicate_editions(spark, sf).count() == 590
    size = sum(b for i, b in shuffled().items() if i not in before)
    assert 0 < size < 9 * Path(f"{sf}/pages.parquet").stat().st_size, size


def test_no_pages(spark):
    silver = spark.createDataFrame([], "site string, url string, text string, top_text string, words int")
    assert crawl.near_duplicates(silver).count() == 0


def test_pages_of_one_address_count_together(spark):
    """As in SQL: an address has the shingles of all its pages, so that one of them alone makes it like no other."""
    text = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    rows = [("s", "u1", text("a", 200)), ("s", "u1", text("b", 200)), ("s", "u2", text("a", 200)), ("s", "u3", text("a", 199)), ("s", "u4", text("b", 199)), ("s", "u4", text("a", 200)), ("s", None, text("a", 200))]
    silver = spark.createDataFrame([(*r, "", len(r[2].split())) for r in rows], "site string, url string, text string, top_text string, words int")
    assert sorted(r.url for r in crawl.near_duplicates(silver).collect()) == ["u1", "u2", "u3", "u4"]
    apart = silver.where("url in ('u1', 'u2')")
    assert crawl.near_duplicates(apart).count() == 0
