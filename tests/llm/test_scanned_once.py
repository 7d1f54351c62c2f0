"""No stage asks Python twice of a row: each time more would take a Python worker more for every task."""

import pytest

import corpus_pipeline
from auditloom.llm import decontaminate

BENCH = "/root/testdata/sf0.001"


def _asked(df):
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")


@pytest.mark.parametrize("name", ["language_id", "decontaminate", "byte_bpe"])
def test_stages_ask_python_once(spark, name):
    docs = spark.createDataFrame([(1, "some words of a text", "en", 20)], "doc_id long, text string, lang string, n_chars int")
    assert _asked(dict(corpus_pipeline.STAGES)[name](spark, docs, BENCH)) == 1


@pytest.mark.parametrize("shard_words", [1000, 12])
def test_filters_stay_behind_the_scan(spark, shard_words):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"Before, {item} after that come some more words of its own that no item has"), (2, item), (3, None), (4, ""), (5, "other words")], "doc_id long, text string")
    benchmark = spark.createDataFrame([("a", item), ("b", "an item that is not met anywhere at all in texts")], "item_id string, text string")
    found = decontaminate.find_benchmark_passages(docs, benchmark, shard_words=shard_words)
    assert _asked(found.where("n_hit > 0 and n_words > 10")) == 1
    assert [r.doc_id for r in found.where("n_hit > 0 and n_words > 10").collect()] == [1]
    out = decontaminate.decontaminate(docs, benchmark, shard_words=shard_words)
    assert _asked(out) == 1
    assert sorted(tuple(r) for r in out.collect()) == [(1, "Before, after that come some more words of its own that no item has"), (3, None), (4, ""), (5, "other words")]
