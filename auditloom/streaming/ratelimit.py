"""A sliding-window rate limiter: a hit passes if fewer than `limit` passed hits of its key are younger than the window. Rejected
hits aren't recorded, so this is no window count. Keys are sorted within partitions and streamed; a task holds at most `limit`
times of one key, and reads all hits of a key, as each depends on those before it. stream_limited is the same over a stream: at most
`limit` times are kept as the state of a key.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def _limited(limit: int, window_us: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, passed = object(), deque()
        for batch in batches:
            out = []
            for k, at in zip(batch.column("__key").to_pylist(), batch.column("__at").to_pylist(), strict=True):
                if k != key:
                    key, passed = k, deque()
                while passed and at is not None and at - passed[0] >= window_us:
                    passed.popleft()
                ok = at is not None and len(passed) < limit
                if ok:
                    passed.append(at)
                out.append(ok)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.bool_())], [*batch.schema.names[:-2], "passed"])

    return run


def rate_limited(hits: DataFrame, key: str, at: str, order: str, limit: int = 10, window_s: int = 3600) -> DataFrame:
    """hits with `passed`. Hits of one instant follow `order`; hits without a time are rejected."""
    schema = T.StructType([*hits.schema.fields, T.StructField("passed", T.BooleanType())])
    dealt = hits.withColumns({"__key": F.col(key).cast("string"), "__at": F.unix_micros(F.col(at).cast("timestamp"))})
    return dealt.repartition("__key").sortWithinPartitions("__key", "__at", order).mapInArrow(_limited(limit, window_s * 1_000_000), schema)


def stream_limited(hits: DataFrame, key: str, at: str, order: str, limit: int = 10, window_s: int = 3600) -> DataFrame:
    """key, at, order, passed of a stream. Within a micro-batch hits are taken in the order of (at, order); a later batch's count from there on."""
    import pandas as pd

    window_us = window_s * 1_000_000
    of = {k: hits.schema[k].dataType for k in (key, at, order)}
    out = T.StructType([*(T.StructField(k, t) for k, t in of.items()), T.StructField("passed", T.BooleanType())])

    def run(_key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        passed = deque(state.get[0] if state.exists else [])
        rows = pd.concat(list(batches)).sort_values([at, order], ignore_index=True)
        ok = []
        for t in rows[at]:
            now = None if pd.isna(t) else t.value // 1000
            while passed and now is not None and now - passed[0] >= window_us:
                passed.popleft()
            ok.append(now is not None and len(passed) < limit)
            if ok[-1]:
                passed.append(now)
        state.update((list(passed),))
        yield rows[[key, at, order]].assign(passed=ok)

    return hits.select(key, at, order).groupBy(key).applyInPandasWithState(run, out, "times array<long>", "append", "NoTimeout")


class _Window(StatefulProcessor):
    """The times of a key's passed hits, at most `limit`, and the latest time that was judged; gone when the window behind it has passed."""

    def __init__(self, at: str, order: str, limit: int, window_us: int):
        self.at, self.order, self.limit, self.window_us = at, order, limit, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "t long")
        self.latest = handle.getValueState("latest", "t long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        import pandas as pd

        passed = deque(x[0] for x in self.times.get()) if self.times.exists() else deque()
        latest = self.latest.get()[0] if self.latest.exists() else None
        hits = pd.concat(list(rows)).sort_values([self.at, self.order], ignore_index=True)
        ok = []
        for t in hits[self.at]:
            now = None if pd.isna(t) else t.value // 1000
            if now is not None:
                now = latest = now if latest is None else max(now, latest)
                while passed and now - passed[0] >= self.window_us:
                    passed.popleft()
            ok.append(now is not None and len(passed) < self.limit)
            if ok[-1]:
                passed.append(now)
        if passed:
            self.times.put([(t,) for t in passed])
        else:
            self.times.clear()
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if latest is not None:
            self.latest.update((latest,))
            self.handle.registerTimer((latest + self.window_us) // 1000 + 1)
        yield hits.assign(passed=ok)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        self.times.clear()
        self.latest.clear()
        return iter(())

    def close(self) -> None:
        pass


def expiring_limited(hits: DataFrame, key: str, at: str, order: str, limit: int = 10, window_s: int = 3600, late_s: int = 600) -> DataFrame:
    """key, at, order, passed of a stream whose state ends: a key's goes once the watermark, late_s behind the newest hit of all, is a window past
    the key's latest hit.

    Within a micro-batch hits are taken in the order of (at, order). A hit that is older than one already judged (but within late_s) is
    judged as if it came with that one: the clock of a key never goes back. Hits without a time are rejected and change nothing. Hits behind the watermark
    aren't answered; Spark counts them in the query's progress. If hits come in order, the answers are those of rate_limited.
    The session's state store must be RocksDB (spark.sql.streaming.stateStore.providerClass)."""
    of = {k: hits.schema[k].dataType for k in (key, at, order)}
    out = T.StructType([*(T.StructField(k, t) for k, t in of.items()), T.StructField("passed", T.BooleanType())])
    marked = hits.select(key, at, order).withWatermark(at, f"{late_s} seconds")
    return marked.groupBy(key).transformWithStateInPandas(_Window(at, order, limit, window_s * 1_000_000), out, "append", "eventtime")


def rate_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts")
    return rate_limited(events, "user_id", "ts", "event_id").select("event_id", "user_id", "passed")
