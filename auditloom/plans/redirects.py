"""Redirect chains, and the pages that links reach, over tables. Native; every round is a join of what is still under way."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.urls import resolve
from auditloom.tables import removed, written

MAX_HOPS = 8


def resolved(location: Column, base: Column) -> Column:
    """A Location header against the address that sent it; one of another scheme stays as it is."""
    return F.coalesce(resolve(location, base), location)


def redirect_chains(responses: DataFrame, starts: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """site, kind, hops, final_url, final_status, loop: each start (site, kind, url) followed over responses (site, url, status, location).

    A chain ends where the answer is no redirect or has no location; it loops if it comes back to an address or is longer than max_hops.
    An address without a response ends it with status 0. Rounds are as many as the longest chain has hops, max_hops + 1 at most."""
    hops = "array<struct<url:string,status:int>>"
    answers = responses.groupBy("site", F.col("url").alias("at")).agg(F.max_by(F.struct("status", "location"), "status").alias("answer"))
    now = starts.select("site", "kind", F.array().cast(hops).alias("hops"), F.col("url").alias("at"))
    done: list[DataFrame] = []
    for _ in range(max_hops + 1):
        again = F.exists("hops", lambda h: h["url"] == F.col("at"))
        met = written(now.withColumn("again", again).join(answers, ["site", "at"], "left"))
        done.append(met.where("again").select("site", "kind", "hops", F.lit(True).alias("loop")))
        step = met.where("not again").withColumn("hops", F.concat("hops", F.array(F.struct(F.col("at").alias("url"), F.coalesce("answer.status", F.lit(0)).cast("int").alias("status")))))
        on = F.coalesce(F.expr("answer.status between 300 and 399 and answer.location != ''"), F.lit(False))
        done.append(step.where(~on).select("site", "kind", "hops", F.lit(False).alias("loop")))
        now = step.where(on).select("site", "kind", "hops", resolved(F.col("answer.location"), F.col("at")).alias("at"))
        if now.isEmpty():
            break
    done.append(now.select("site", "kind", "hops", F.lit(True).alias("loop")))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    last = F.try_element_at("hops", F.lit(-1))
    return out.select("site", "kind", "hops", last["url"].alias("final_url"), last["status"].alias("final_status"), "loop")


def reachable(edges: DataFrame, starts: DataFrame, parts: int = 8) -> DataFrame:
    """site, url, depth: what links (site, source, target) reach from starts (site, url), and over how few links.

    A round is a join of the last one's addresses and an anti-join with those seen; of these every `parts` rounds' tables become one, so
    a plan reads so many at most however long paths are."""
    front = written(starts.select("site", "url").distinct().withColumn("depth", F.lit(0)))
    seen = [front]
    while not front.isEmpty():
        links = edges.select("site", F.col("source").alias("url"), "target")
        new = front.join(links, ["site", "url"]).groupBy("site", F.col("target").alias("url")).agg((F.min("depth") + 1).alias("depth"))
        every = functools.reduce(DataFrame.unionByName, seen)
        front = written(new.join(every.select("site", "url"), ["site", "url"], "left_anti"))
        seen.append(front)
        if len(seen) > parts:
            one = written(functools.reduce(DataFrame.unionByName, seen[:-1]))
            for x in seen[:-1]:
                removed(x)
            seen = [one, front]
    return functools.reduce(DataFrame.unionByName, seen)
