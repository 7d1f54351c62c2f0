"""Every stage on tables with nulls, empty and long texts, repeated rows, clashing columns, and without rows."""

import pytest

import corpus_pipeline

BENCH = "/root/testdata/sf0.001"
LONG = " ".join(f"long{i % 997}word" for i in range(20_000))
ROWS = [
    (1, "plain words of a text that nobody else has written so far", "en"), (1, "plain words of a text that nobody else has written so far", "en"), (2, None, "en"), (3, "", None),
    (None, "a text without an id but with words in it", "en"), (4, LONG, "en"), (5, LONG + " end", "en"), (6, "½ ²", "fr"), (7, "ligne une\nligne deux", "fr"), (8, "ligne une\nligne deux", "fr"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, lang, 0, "mine", -1.5, "r", 7, {"k": "v"}) for i, t, lang in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, lang_pred string, score double, rejected string, n_words int, extra map<string,string>")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_leave_own_columns_alone(spark, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    for docs in (odd, odd.limit(0)):
        out = stage(spark, docs, BENCH)
        assert out.columns == odd.columns and [f.dataType for f in out.schema] == [f.dataType for f in odd.schema]
        rows = out.collect()
        assert all((r.lang_pred, r.score, r.rejected, r.n_words, r.extra) == ("mine", -1.5, "r", 7, {"k": "v"}) for r in rows)
        assert len(rows) <= docs.count() and (docs is odd) == bool(rows)
    ids = sorted(r.doc_id or 0 for r in stage(spark, odd, BENCH).collect())
    if name == "language_id":
        assert not {2, 3, 6} & set(ids) and ids.count(1) == 2
    if name == "ngram_join":
        assert ids == [0, 1, 2, 3, 4, 6, 7]
    if name == "decontaminate":
        assert len(ids) == len(ROWS)
