"""What a crawl would still have to ask for: link targets whose status isn't known, images, and the home page's static files.

Lists are in the order in which pages (by page_id) show their addresses first. First places are grouped minima, which combine before
the shuffle; what is known leaves by an anti-join, whose hot sites Spark splits. With `most` each list ends after so many of a
site; a crawl of few pages asks for 80 links, 80 images, 4 style sheets and 2 scripts. Repeated rows and addresses count once; rows
with a null site take no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.urls import is_file
from auditloom.tables import numbered

from .frontier import canonical_key

KINDS = ("link", "image", "css", "script")


def _ranked(found: DataFrame, most: int | None) -> DataFrame:
    """found: site, url, place. site, order, url."""
    first = found.where("site is not null and url is not null").groupBy("site", "url").agg(F.min("place").alias("place"))
    if most is None:
        return numbered(first, "site", "place", "url").select("site", "order", "url")
    # the limit is applied before the shuffle too
    rank = F.row_number().over(Window.partitionBy("site").orderBy("place", "url"))
    return first.withColumn("order", rank.cast("long")).where(F.col("order") <= most).select("site", "order", "url")


def _opened(silver: DataFrame) -> DataFrame:
    return silver.where("is_home or coalesce(status, 200) = 200") if "status" in silver.columns else silver


def links(silver: DataFrame, known: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """site, order, url of the internal link targets that aren't files, nor among the stored pages, nor known (site, url)."""
    targets = _opened(silver).select("site", "page_id", F.posexplode(F.transform("links", lambda x: F.when(x["internal"], x["abs"]))).alias("pos", "abs")).where("abs is not null")
    asked = targets.select("site", canonical_key(F.col("abs")).alias("url"), F.struct("page_id", "pos").alias("place")).where(~is_file(F.col("url")))
    seen = silver.select("site", canonical_key(F.col("url")).alias("url"))
    if known is not None:
        seen = seen.unionByName(known.select("site", canonical_key(F.col("url")).alias("url")))
    return _ranked(asked.join(seen.distinct(), ["site", "url"], "left_anti"), most)


def images(silver: DataFrame, most: int | None = None) -> DataFrame:
    """site, order, url of the pages' images."""
    found = _opened(silver).select("site", "page_id", F.posexplode("images.abs").alias("pos", "url"))
    return _ranked(found.select("site", "url", F.struct("page_id", "pos").alias("place")), most)


def static_files(silver: DataFrame, column: str, most: int | None = None) -> DataFrame:
    """site, order, url of the home pages' `stylesheets` or `scripts` that lie on the site itself."""
    found = silver.where("is_home").select("site", "page_id", F.posexplode(column).alias("pos", "url"))
    own = F.regexp_replace(F.lower(F.regexp_extract("url", r"://([^/?#:]*)", 1)), r"^www\.", "") == F.col("site")
    return _ranked(found.where(own).select("site", "url", F.struct("page_id", "pos").alias("place")), most)


def work_lists(silver: DataFrame, known: DataFrame | None = None, most: dict[str, int] | None = None) -> DataFrame:
    """site, kind, order, url of all lists; `most` by kind."""
    most = most or {}
    lists = (links(silver, known, most.get("link")), images(silver, most.get("image")), static_files(silver, "stylesheets", most.get("css")), static_files(silver, "scripts", most.get("script")))
    out = None
    for kind, rows in zip(KINDS, lists, strict=True):
        rows = rows.select("site", F.lit(kind).alias("kind"), "order", "url")
        out = rows if out is None else out.unionByName(rows)
    return out
