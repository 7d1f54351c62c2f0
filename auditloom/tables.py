"""Tables of the given folder, and written tables between the steps of a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share. Only a local session may do without that setting: it gets a
    temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/auditloom-{uuid.uuid4().hex}"


def written(df: DataFrame, compact: bool = False) -> DataFrame:
    """The rows as a Parquet table in the shared folder; compact: smaller, for more CPU time."""
    spark = df.sparkSession
    path = shared(spark)
    (df.write.option("compression", "zstd") if compact else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._auditloom_path = path
    return out


#: Bytes of rows that Spark hands to a Python worker at once.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """The session gives Python workers batches of BATCH_BYTES at most from now on (or what is set, if that isn't Spark's default)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(name, str(BATCH_BYTES))


def removed(df: DataFrame) -> None:
    """Deletes a written table that nothing reads any more."""
    context = df.sparkSession.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(df._auditloom_path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def numbered(df: DataFrame, by: str, *order: str, name: str = "order") -> DataFrame:
    """df with 1, 2, ... in the order of the given columns for each value of `by`.

    The rows are sorted over all partitions at once, so that a hot value is spread like others; what meets in one task is a row for each
    partition that holds the value. Columns of `order` should tell rows apart."""
    rows = written(df.repartitionByRange(by, *order).sortWithinPartitions(by, *order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    runs = rows.groupBy(by, part.alias("__part")).agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select(F.col(by).alias("__by"), F.col("__part").alias("__at"), (before - F.col("__first") + 1).alias("__shift"))
    met = rows.join(starts, F.col(by).eqNullSafe(F.col("__by")) & (part == F.col("__at")))
    return met.withColumn(name, F.col("__id") + F.col("__shift")).drop("__id", "__by", "__at", "__shift")
