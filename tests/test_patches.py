"""Documents as folds of patches, in a store that is compacted while others write."""

import datetime as dt
import random

from pyspark.sql import functions as F

from auditloom.operators import patches
from auditloom.tables import shared

SCHEMA = "id string, at timestamp, seq long, patch map<string,string>"


def _rows(spark, some):
    df = spark.createDataFrame([(i, None if at is None else dt.datetime(2026, 1, 1) + dt.timedelta(seconds=at), seq, p) for i, at, seq, p in some], SCHEMA)
    return patches.fields(df, F.col("id"), F.col("patch"), F.col("at"), F.col("seq"))


def _plain(some):
    docs = {}
    for i, at, seq, p in sorted((x for x in some if x[0] is not None), key=lambda x: (x[1] is not None, x[1] or 0, x[2])):
        for k, v in (p or {}).items():
            docs.setdefault(i, {})[k] = v
    return docs


def _docs(df):
    return {r.id: dict(r.doc) for r in df.collect()}


def test_folds_of_folds_equal_an_ordered_merge(spark):
    rng = random.Random(3)
    some = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(50)]), n, {rng.choice("xyz"): rng.choice(["1", "2", None]) for _ in range(rng.randint(0, 3))}) for n in range(200)]
    rows = _rows(spark, some)
    want = _plain(some)
    assert _docs(patches.documents(rows)) == want
    halves = patches.folded(rows.where("seq % 2 = 0")).unionByName(patches.folded(rows.where("seq % 3 != 0")))
    assert _docs(patches.documents(patches.folded(halves).unionByName(rows.where("seq % 2 = 1")))) == want
    assert patches.documents(rows.limit(0)).collect() == []


def test_two_compactions_at_once_lose_nothing(spark, monkeypatch):
    store, some = patches.PatchStore(spark, shared(spark)), []

    def add(*new):
        some.extend(new)
        store.append(_rows(spark, new))

    assert store.documents().collect() == [] and store.compact() is None
    add(("a", 1, 1, {"x": "1", "y": "1"}))
    add(("a", 2, 2, {"x": "2"}), ("b", 1, 3, {"z": None}))
    found = store._folders()
    first = store.compact()
    with monkeypatch.context() as m:  # another compaction that had listed the folders before, and a patch that came meanwhile
        m.setattr(store, "_folders", lambda: found)
        add(("a", 3, 4, {"y": "3"}))
        second = store.compact()
    assert {first, second} <= set(store._folders()) and _docs(store.documents()) == _plain(some)
    add(("a", 0, 9, {"x": "late"}), ("c", 1, 1, {"n": "new"}))
    store.compact()
    store.clean()
    add(("b", 5, 5, {"z": "set"}))
    assert len(store._folders()) == 2 and _docs(store.documents()) == _plain(some) == {"a": {"x": "2", "y": "3"}, "b": {"z": "set"}, "c": {"n": "new"}}
