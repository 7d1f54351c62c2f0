"""Benchmarks of many shards and items of many pieces, against windows compared one by one."""

import random

import pytest
from pyspark.sql import functions as F

from auditloom.llm import decontaminate
from auditloom.llm.common import Scratch

WINDOW = 4


def _case(seed):
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randrange(12)}" for _ in range(n)]
    items = [(i, words(rng.choice([1, 2, 3, 4, 5, 9, 60]))) for i in range(25)]
    items += [(100 + i, items[7][1]) for i in range(30)] + [items[3], items[3], (None, items[5][1]), (200, [])]
    docs = []
    for d in range(40):
        text = words(rng.randrange(30))
        for _ in range(rng.randrange(3)):
            part = rng.choice(items)[1]
            text += part[rng.randrange(len(part) + 1) :][:20] + [f"only{d}"]
        docs.append((d, " ".join(text)))
    return items, [*docs, (40, None), (41, ""), (42, docs[0][1]), (43, "w1 " * 3000)]


def _brute(items, text):
    words, hit, found = (text or "").split(), set(), set()
    for name, item in items:
        n = min(WINDOW, len(item))
        windows = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if item else set()
        for i in range(len(words) - n + 1) if n else ():
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add("null" if name is None else str(name))
    return len(words), len(hit), sorted(found), " ".join(w for i, w in enumerate(words) if i not in hit) if hit else None


@pytest.mark.parametrize(("shard_words", "piece_words"), [(10**6, 5000), (150, 7), (60, 1)])
def test_shards_and_pieces_match_brute_force(spark, shard_words, piece_words):
    items, docs = _case(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit("clash"))
    built = decontaminate.automatons(Scratch(spark), bench, "item_id", "text", WINDOW, shard_words, piece_words)
    assert (built.count() > 1) == (shard_words < 10**6)
    got = decontaminate.find_benchmark_passages(df, bench, window=WINDOW, shard_words=shard_words, piece_words=piece_words)
    assert sorted(got.columns) == ["clean_text", "doc_id", "items", "n_hit", "n_words", "text"]
    want = {d: _brute(items, t) for d, t in docs}
    for r in got.collect():
        clean = None if r.clean_text is None else " ".join(r.clean_text.split())
        assert (r.n_words, r.n_hit, r["items"], clean) == want[r.doc_id], r.doc_id


def test_benchmarks_without_words(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    for rows in ([], [(1, None), (2, " ! "), (None, "")]):
        bench = spark.createDataFrame(rows, "item_id long, text string")
        got = decontaminate.find_benchmark_passages(df, bench).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"], r.clean_text) for r in got) == [(1, 3, 0, [], None), (2, 0, 0, [], None)]
