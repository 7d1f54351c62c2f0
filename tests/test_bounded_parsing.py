"""What a Python worker holds of pages is bounded by bytes, however many pages come in a batch."""

import gc

import pyarrow as pa

from auditloom.sources import html


def test_batches_are_cut_by_bytes():
    pages = ["a" * 600_000, None, "é" * 300_000, "b" * 3_000_000, "", "c"]
    batch = pa.RecordBatch.from_pydict({"url": [str(i) for i in range(6)], "html": pages})
    parts = list(html.bounded(batch))
    assert [p.column(0).to_pylist() for p in parts] == [["0", "1"], ["2"], ["3"], ["4", "5"]]
    assert [h for p in parts for h in p.column(1).to_pylist()] == pages
    assert list(html.bounded(batch.slice(0, 0))) == []


def test_trees_go_with_their_page():
    gc.collect()
    gc.disable()
    try:
        for _ in range(3):
            html.parse("<body>" + "<p>a <b>b</b></p>" * 50, "https://a.test/")
        assert not any(isinstance(x, html.Node) for x in gc.get_objects())
    finally:
        gc.enable()


def test_spark_hands_over_small_batches(spark):
    html.parse_pages(spark.createDataFrame([], "page_id long, url string, html string"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b")) <= 4 << 20
