"""Stored documents as the fold of their patches: of each field the last writer's value counts, not of each row.

A patch is a map of some fields of one document. Folded, it is a row for each (id, field) with the value of the greatest
(at, seq); such rows fold again, in any grouping and any number of times, to the same: so partial folds combine before a shuffle, and
stores may be compacted while others write. A field set to null is a field that holds null; a field that no patch names isn't there.

PatchStore keeps patches in folders that count once marked. `compact` folds the folders it finds into one that names them; readers leave
out what a marked fold names. Two compactions at once leave two folds of the same folders, which fold to the same; a patch
that comes meanwhile is in neither list and stays. Patches with a null id take no part; of equal (at, seq) the greater value counts.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.tables import table

_FIELD = "id string, field string, at timestamp, seq long, value string"


def fields(patches: DataFrame, id: Column, patch: Column, at: Column, seq: Column) -> DataFrame:
    """id, field, at, seq, value of each field of each patch (a MAP of texts)."""
    rows = patches.select(id.cast("string").alias("id"), at.cast("timestamp").alias("at"), seq.cast("long").alias("seq"), F.explode(patch).alias("field", "value"))
    return rows.where("id is not null").select("id", "field", "at", "seq", F.col("value").cast("string").alias("value"))


def folded(rows: DataFrame) -> DataFrame:
    """The last of each (id, field)."""
    last = F.max(F.struct("at", "seq", "value"))
    return rows.groupBy("id", "field").agg(last.alias("last")).select("id", "field", "last.at", "last.seq", "last.value")


def documents(rows: DataFrame) -> DataFrame:
    """id, doc (a MAP of its fields in their order), at (of its last change)."""
    # a document has as many entries as it has fields
    entries = F.array_sort(F.collect_list(F.struct("field", "value")))
    return folded(rows).groupBy("id").agg(F.map_from_entries(entries).alias("doc"), F.max("at").alias("at"))


class PatchStore:
    """Patches below a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _write(self, rows: DataFrame, kind: str, of: list[str]) -> str:
        name = f"{kind}={uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}/rows")
        self.spark.createDataFrame([(x,) for x in of], "value string").coalesce(1).write.text(f"{self.path}/{name}/of")
        path, fs, _ = self._fs()
        fs.mkdirs(path(f"{self.path}/{name}/mark"))
        return name

    def append(self, rows: DataFrame) -> str:
        """Adds patches as `fields` gives them."""
        return self._write(rows, "patch", [])

    def _marked(self) -> list[str]:
        path, fs, at = self._fs()
        return sorted(x for x in ([s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []) if fs.exists(path(f"{self.path}/{x}/mark")))

    def _folders(self) -> list[str]:
        """Marked folders that no marked fold names. A fold may be named by a later one, never by one that it names itself."""
        marked = self._marked()
        named = {r.value for x in marked if x.startswith("fold=") for r in self.spark.read.text(f"{self.path}/{x}/of").collect()}
        return [x for x in marked if x not in named]

    def rows(self) -> DataFrame:
        parts = [self.spark.read.schema(_FIELD).parquet(f"{self.path}/{x}/rows") for x in self._folders()]
        return functools.reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], _FIELD)

    def documents(self) -> DataFrame:
        return documents(self.rows())

    def compact(self) -> str | None:
        """Folds the folders found into one. What it names stays until `clean`, for readers under way."""
        of = self._folders()
        return self._write(folded(functools.reduce(DataFrame.unionByName, [self.spark.read.schema(_FIELD).parquet(f"{self.path}/{x}/rows") for x in of])), "fold", of) if len(of) > 1 else None

    def clean(self) -> None:
        """Deletes the rows of folders that a fold names; their names stay in it."""
        live = set(self._folders())
        path, fs, _ = self._fs()
        for x in self._marked():
            if x not in live:
                fs.delete(path(f"{self.path}/{x}/rows"), True)


def merged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's document of the events as patches: an event sets the field of its type, and `last` with its kind; every fifth one nulls `last`."""
    events = table(spark, sf_dir, "events")
    last = F.when(F.col("event_id") % 5 != 0, F.col("event_type"))
    patch = F.create_map(F.col("event_type"), F.col("value").cast("string"), F.lit("last"), last, F.concat(F.lit("k"), F.col("event_id") % 3), F.col("props"))
    docs = documents(fields(events, F.col("user_id"), patch, F.col("ts"), F.col("event_id")))
    return docs.select("id", F.to_json("doc", {"ignoreNullFields": "false"}).alias("doc"), F.size("doc").alias("n_fields"))


MERGED_SQL = """
with f as (
  select user_id::varchar as id, event_type as field, value::varchar as value, ts, event_id from events where user_id is not null
  union all select user_id::varchar, 'last', case when event_id % 5 <> 0 then event_type end, ts, event_id from events where user_id is not null
  union all select user_id::varchar, 'k' || (event_id % 3), props, ts, event_id from events where user_id is not null),
l as (select id, field, value from (select *, row_number() over (partition by id, field order by ts desc, event_id desc) as k from f) where k = 1)
select id, '{' || string_agg(to_json(field) || ':' || coalesce(to_json(value)::varchar, 'null'), ',' order by field) || '}' as doc, count(*)::integer as n_fields from l group by id
"""
