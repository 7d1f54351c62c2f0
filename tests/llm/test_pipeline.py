import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from auditloom.llm import byte_bpe

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_encode_what_is_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).persist()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(out) == set(texts)
    coder = byte_bpe._coder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert all(coder.decoded(bytes(out[i].token_ids)).decode() == (texts[i] or "") for i in out)


def test_no_near_duplicates_are_left(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "A b c d e f g h i j"), (3, "other words"), (4, None), (None, "a b c d e f g h i j"), (1, "a b c d e f g h i j")], "doc_id long, text string")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted((r.doc_id or 0) for r in out.select(F.col("doc_id")).collect()) == [0, 1, 3, 4]
