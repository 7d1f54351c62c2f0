"""Connected components of a graph kept as a table of edges.

Alternates two steps until nothing changes: every node hangs its larger neighbours under its smallest neighbour
(large star), then its smaller neighbours and itself (small star). The forest gets flat in a number of rounds that
grows with the logarithm of the component size. Each round is a grouped minimum with partial sums and a join on the
node, whose hot nodes Spark splits; each round's edges are a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u > v) to edges (u > v): large or small star."""
    both = edges.select("u", "v")
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = both.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(u, v) pairs of LONG, in any order, to (node, component): for every node that has an edge to another, its component's smallest node."""
    scratch = scratch or Scratch(edges.sparkSession)
    now = scratch.written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    mark = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if state == mark or state["n"] == 0:
            break
        mark = state
        before, now = now, scratch.written(_stars(_stars(now, True), False))
        scratch.drop(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
