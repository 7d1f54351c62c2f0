"""Check results of sites over a stream of pages, of which later versions replace earlier ones.

A page is known by its page_id; of two versions the one with the greater `version` counts, of equal ones the one that came later, so
late and repeated pages change nothing. A micro-batch adds a folder to a store: its pages in force (parsed), what they and the
versions that they replace change in the counts of (site, check) — a retraction is a negative count — and the other checks' results of
the sites that it touches. Checks that each page answers for itself are sums of these changes; those that look at a whole site (its
home page, links, equal titles, near-duplicates) are worked out again for touched sites only, from their pages in force.

A batch counts once its mark is written, last; a batch that runs again after a failure overwrites its folder, or does nothing if it
has its mark. Pages lie in BUCKETS folders by their site, sorted by a bucket of their id, so a batch reads of earlier ones only the folders, or the
parts of files, that it touches. `compact` makes one folder of all that is marked, without replaced pages; the others go.

Pages with a null page_id are one page to the store. A site all of whose pages have moved elsewhere is gone.
"""

from __future__ import annotations

import functools
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from auditloom.plans import checks
from auditloom.sources.html import parse_pages, with_home
from auditloom.tables import shared, table, written

BUCKETS = 8
PAGES = "site"  # stands for a check in the counts: the pages of a site


class SiteResults:
    """The store at a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.checks = checks.checks_for()
        self.sums = checks.additive(self.checks)
        self.others = [c for c in self.checks if c not in self.sums]

    # folders

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _folders(self) -> list[str]:
        """Names of the marked folders: those of the newest base, and of the batches behind it."""
        path, fs, at = self._files()
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        marked = [n for n in names if n.startswith(("batch=", "base=")) and fs.exists(path(f"{self.path}/{n}/mark"))]
        number = lambda n: int(n.split("=")[1])
        base = max((n for n in marked if n.startswith("base=")), key=number, default=None)
        behind = [n for n in marked if n.startswith("batch=") and (base is None or number(n) > number(base))]
        return sorted([*([base] if base else []), *behind], key=lambda n: (number(n), n))

    def _read(self, name: str, also: str | None = None) -> DataFrame | None:
        """A table of all marked folders, and of one more."""
        folders = self._folders() + ([also] if also else [])
        if not folders:
            return None
        schema = T.StructType.fromJson(json.loads(self.spark.read.text(f"{self.path}/schema").first()[0])) if name == "pages" else None
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return functools.reduce(DataFrame.unionByName, [reader.parquet(f"{self.path}/{x}/{name}") for x in folders])

    # pages

    @staticmethod
    def _bucketed(pages: DataFrame) -> DataFrame:
        return pages.withColumns({"id_bucket": F.pmod(F.xxhash64("page_id"), F.lit(BUCKETS)), "site_bucket": F.pmod(F.xxhash64("site"), F.lit(BUCKETS))})

    @staticmethod
    def _newest(pages: DataFrame, *of: str) -> DataFrame:
        """One row of each page: of the greatest (version, batch), and of equal rows of a batch the greatest url and html."""
        order = Window.partitionBy(*of, "page_id").orderBy(F.desc("version"), F.desc("batch"), F.desc_nulls_last("url"), F.desc_nulls_last("html"))
        return pages.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")

    def in_force(self, ids: DataFrame | None = None) -> DataFrame | None:
        """The pages in force, or those among some ids (page_id, id_bucket)."""
        stored = self._read("pages")
        if stored is None:
            return None
        stored = stored.where("not gone")
        if ids is not None:
            buckets = [r[0] for r in ids.select("id_bucket").distinct().collect()]  # BUCKETS at most
            keys = ids.select(F.col("page_id").alias("__id")).distinct()
            stored = stored.where(F.col("id_bucket").isin(buckets)).join(keys, F.col("page_id").eqNullSafe(F.col("__id")), "left_semi")
        return self._newest(stored)

    def of_sites(self, sites: DataFrame, also: str | None = None) -> DataFrame:
        """The pages in force of some sites, with their homes. A page that has left a site has a newer row there that says so."""
        buckets = [r[0] for r in self._bucketed(sites.withColumn("page_id", F.lit(0))).select("site_bucket").distinct().collect()]
        near = self._read("pages", also).where(F.col("site_bucket").isin(buckets)).join(sites.select("site").distinct(), "site", "left_semi")
        return with_home(self._newest(near, "site").where("not gone").drop("is_home", "id_bucket", "site_bucket", "gone"))

    # batches

    def update(self, pages: DataFrame, batch: int) -> None:
        """Takes a micro-batch of pages: page_id, url, html, version."""
        name = f"batch={batch:09d}"
        if name in self._folders() or any(x.startswith("base=") and int(x.split("=")[1]) >= batch for x in self._folders()):
            return
        parsed = self._bucketed(parse_pages(pages).withColumns({"batch": F.lit(batch).cast("long"), "gone": F.lit(False)}))
        self.spark.createDataFrame([(parsed.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/schema")
        new = written(self._newest(parsed))
        old = self.in_force(new.select("page_id", "id_bucket"))
        stay = new
        if old is not None:
            old = written(old)
            same = F.col("page_id").eqNullSafe(F.col("__id"))
            late = written(new.join(old.select(F.col("page_id").alias("__id"), F.col("version").alias("__v")), same).where("__v > version").select(F.col("page_id").alias("__id")))
            new, old = new.join(late, same, "left_anti"), old.join(late, same, "left_anti")
            to = new.select(F.col("page_id").alias("__id"), F.col("site").alias("__to"), F.col("version").alias("__v"))
            moved = old.join(to, same).where("site != __to").withColumns({"version": F.col("__v"), "batch": F.lit(batch).cast("long"), "gone": F.lit(True)})
            stay = new.unionByName(moved.select(*new.columns))
        folder = f"{self.path}/{name}"
        stay.repartition("site_bucket").sortWithinPartitions("site_bucket", "id_bucket").write.mode("overwrite").partitionBy("site_bucket").parquet(f"{folder}/pages")
        changes, touched = self._counts(new, 1), new.select("site")
        if old is not None:
            changes, touched = changes.unionByName(self._counts(old, -1)), touched.unionByName(old.select("site"))
        self._summed(changes).write.mode("overwrite").parquet(f"{folder}/counts")
        touched = written(touched.distinct())
        others = checks.run_checks(written(self.of_sites(touched, name)), self.others)
        touched.withColumn("batch", F.lit(batch).cast("long")).join(others, "site", "left").write.mode("overwrite").parquet(f"{folder}/others")
        self._mark(folder)

    @staticmethod
    def _summed(changes: DataFrame) -> DataFrame:
        return changes.groupBy("site", "check_id").agg(F.sum("n_hit").alias("n_hit"), F.sum("n_total").alias("n_total")).where("n_hit != 0 or n_total != 0")

    def _counts(self, pages: DataFrame, sign: int) -> DataFrame:
        own = checks.additive_counts(pages, self.sums)
        every = pages.groupBy("site").agg(F.lit(0).cast("long").alias("n_hit"), F.count("*").alias("n_total")).withColumn("check_id", F.lit(PAGES))
        both = own.unionByName(every)
        return both.select("site", "check_id", (F.col("n_hit") * sign).alias("n_hit"), (F.col("n_total") * sign).alias("n_total"))

    def _mark(self, folder: str) -> None:
        path, fs, _ = self._files()
        fs.mkdirs(path(f"{folder}/mark"))

    def _latest(self) -> DataFrame:
        others = self._read("others")
        return others.join(others.groupBy("site").agg(F.max("batch").alias("batch")), ["site", "batch"], "left_semi")

    def results(self) -> DataFrame:
        """site, check_id, status, n_bad, n_total, as run_checks gives them for the pages in force."""
        counts = written(self._summed(self._read("counts")))
        alive = counts.where((F.col("check_id") == PAGES) & (F.col("n_total") > 0)).select("site")
        own = checks.judged(alive, counts.where(F.col("check_id") != PAGES).withColumn("own_status", F.lit(None).cast("string")), self.sums)
        rest = self._latest().join(alive, "site", "left_semi").where("check_id is not null")
        return own.unionByName(rest.select("site", "check_id", "status", "n_bad", "n_total"))

    def compact(self) -> None:
        """One folder of all marked ones."""
        folders = self._folders()
        if len(folders) < 2:
            return
        folder = f"{self.path}/base={folders[-1].split('=')[1]}"
        self.in_force().repartition("site_bucket").sortWithinPartitions("site_bucket", "id_bucket").write.mode("overwrite").partitionBy("site_bucket").parquet(f"{folder}/pages")
        self._summed(self._read("counts")).write.mode("overwrite").parquet(f"{folder}/counts")
        self._latest().write.mode("overwrite").parquet(f"{folder}/others")
        self._mark(folder)
        path, fs, _ = self._files()
        for x in folders:
            fs.delete(path(f"{self.path}/{x}"), True)

    def follow(self, pages: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Starts taking a stream of pages (page_id, url, html, version)."""
        return pages.writeStream.foreachBatch(lambda df, batch: self.update(df, batch)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def streamed_site_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as a stream in three files: of every third page an older version first, of every seventh one that comes late."""
    pages = table(spark, sf_dir, "pages")
    first = pages.where("page_id % 3 = 0").select("page_id", F.concat(F.lit("https://moved.test/"), "page_id").alias("url"), F.lit("<h1>old</h1><a href='/x'>x</a>").alias("html"), F.lit(1).alias("version"))
    now = pages.select("page_id", "url", "html", F.lit(2).alias("version"))
    late = pages.where("page_id % 7 = 0").select("page_id", "url", F.lit("<p>late</p>").alias("html"), F.lit(0).alias("version"))
    base = shared(spark)
    for i, part in enumerate((first.unionByName(now.where("page_id % 3 = 1")), now.where("page_id % 3 != 1"), late.unionByName(now.where("page_id % 5 = 0")))):
        part.coalesce(1).write.mode("append").parquet(f"{base}/in/part={i}")
    store = SiteResults(spark, f"{base}/store")
    stream = spark.readStream.schema(now.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(*[f"{base}/in/part=*"])
    store.follow(stream, f"{base}/mark", availableNow=True).awaitTermination()
    return store.results()
