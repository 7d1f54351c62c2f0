"""The rate limiter whose state ends, over a stream in batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from auditloom.streaming import ratelimit

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
START = dt.datetime(2026, 1, 1)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    yield spark
    spark.conf.set(name, before)


def _run(spark, tmp_path, batches, **options):
    schema = "id long, k string, at timestamp"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    rows = []
    for i, batch in enumerate(batches):
        spark.createDataFrame([(n, k, None if s is None else START + dt.timedelta(seconds=s)) for n, k, s in batch], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        found = ratelimit.expiring_limited(stream, "k", "at", "id", **options)
        query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        rows.append(sum(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress[-1:]))
    return {r.id: r.passed for r in spark.read.schema("k string, at timestamp, id long, passed boolean").parquet(str(tmp_path / "out")).collect()}, rows


def test_hits_in_order_are_answered_as_in_a_table(rocks, tmp_path):
    rng, hits, at = random.Random(1), [], 0
    for n in range(240):
        at += rng.choice([0, 1, 5, 40])
        hits.append((n, rng.choice("abc"), at))
    found, _ = _run(rocks, tmp_path, [hits[:100], hits[100:180], hits[180:]], limit=4, window_s=120, late_s=0)
    table = rocks.createDataFrame([(n, k, START + dt.timedelta(seconds=s)) for n, k, s in hits], "id long, k string, at timestamp")
    want = {r.id: r.passed for r in ratelimit.rate_limited(table, "k", "at", "id", 4, 120).select("id", F.col("passed")).collect()}
    assert found == want and 0 < sum(found.values()) < len(found)


def test_late_hits_and_the_end_of_state(rocks, tmp_path):
    batches = [
        [(1, "a", 0), (2, "a", 10), (3, "b", 5)],
        [(4, "a", 4), (5, "a", 12)],  # 4 is late: it counts as of 10
        [(6, "b", 1000)],  # a's window is long past
        [(7, "b", 1001), (8, "a", 1002)],
    ]
    found, rows = _run(rocks, tmp_path, batches, limit=3, window_s=60, late_s=30)
    assert found == {1: True, 2: True, 3: True, 4: True, 5: False, 6: True, 7: True, 8: True}
    assert rows[2] < rows[1]
