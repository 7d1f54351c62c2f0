"""Tables that earlier stages have left go once the next stage's documents don't read them."""

from pathlib import Path

import corpus_pipeline
from auditloom.llm import common

SF = "/root/testdata/sf0.001"


def _there(spark):
    return {p.name for p in Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).glob("auditloom-*")}


def test_swept_keeps_what_is_read(spark):
    with common.recorded() as paths:
        first, second = (common.written(spark.range(5)) for _ in range(2))
    names = [p.rsplit("/", 1)[-1] for p in paths]
    assert common.swept(second.persist(), paths) == paths
    second.unpersist()
    assert common.swept(second, paths) == paths[1:] and set(names) & _there(spark) == {names[1]}
    assert second.count() == 5


def test_stages_leave_little(spark, tmp_path):
    before = _there(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs.write.parquet(str(tmp_path / "0"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, spark.read.parquet(str(tmp_path / str(i))), SF).write.parquet(str(tmp_path / str(i + 1)))
    assert len(_there(spark) - before) <= 3
    rows = corpus_pipeline.run(spark, SF).count()
    assert rows > 100 and len(_there(spark) - before) <= 4
