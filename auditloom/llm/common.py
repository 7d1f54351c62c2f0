"""Small helpers that the operators share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by a path that any of Spark's stores may serve."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Only a local session without that setting, as in tests, gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/auditloom-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: a cut in the lineage that a lost executor can't take away."""
    path = shared_dir(df.sparkSession)
    for paths in _RECORDS:
        paths.append(path)
    return _written(df, path)


_RECORDS: list[list[str]] = []


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders of the tables that `written` and Scratch make meanwhile."""
    paths: list[str] = []
    _RECORDS.append(paths)
    try:
        yield paths
    finally:
        _RECORDS.remove(paths)


def swept(docs: DataFrame, paths: list[str]) -> list[str]:
    """Deletes those of the folders that docs doesn't read; the others. Of a cached table it can't be told, so all stay."""
    if docs.storageLevel.useMemory or docs.storageLevel.useDisk:
        return paths
    files = docs.inputFiles()
    kept = [p for p in paths if any(f"/{p.rsplit('/', 1)[-1]}/" in f for f in files)]
    context = docs.sparkSession.sparkContext
    for path in set(paths) - set(kept):
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
    return kept


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables of one job, each of which goes once nothing that is still to run reads it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.held: list[tuple[DataFrame, str]] = []

    def written(self, df: DataFrame) -> DataFrame:
        path = shared_dir(self.spark)
        for paths in _RECORDS:
            paths.append(path)
        out = _written(df, path)
        self.held.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        for _, path in (x for x in self.held if any(x[0] is t for t in tables)):
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        self.held = [x for x in self.held if not any(x[0] is t for t in tables)]

    def keep(self, *tables: DataFrame) -> None:
        """Drops all but these, which what is returned still reads."""
        self.drop(*[t for t, _ in self.held if not any(t is x for x in tables)])


#: Bytes of texts that Spark hands to a Python worker at once, which bounds the memory of both.
BATCH_BYTES = 4 << 20
_DEFAULT = ("67108864b", "67108864", "64m", "64MB")


def small_batches(df: DataFrame) -> DataFrame:
    """df; its session gives Python workers batches of BATCH_BYTES at most from now on (or what is set, if that isn't Spark's default)."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(name) in _DEFAULT:
        conf.set(name, str(BATCH_BYTES))
    return df


def slices(n: int, step: int) -> Iterator[slice]:
    for i in range(0, n, step):
        yield slice(i, min(n, i + step))


#: A-Z to a-z and nothing else, for bytes.translate.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
