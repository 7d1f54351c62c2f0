"""Operator 3: judge urls by many pattern rules of which each url meets only a few.

A rule is a host suffix with a path prefix. It is filed under its rarest literal token, rare by the count of rules
that have it; a url's own tokens fetch candidate rules, and only those run their regular expression. The longest
rule that fits wins. Rules come as a Python list, so their number is known before the job: up to MAX_LITERAL_RULES
the index is a literal of the plan and urls are judged where they are read, without any shuffle; beyond, urls meet
an index table in a join over distinct (host, path), where hot tokens are spread by a salt.

Null urls and urls without :// have an empty host and path, fit no rule and get the default verdict.
Native: built-in functions only.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MAX_LITERAL_RULES = 500
SALTS = 16
DEFAULT_VERDICT = "allow"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules that the query op3 applies.
QUERY_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


class Rule(NamedTuple):
    text: str
    verdict: str
    token: str
    regex: str


def tokens_of(host: str, path: str) -> list[str]:
    """Host labels and whole path segments, told apart by a mark. A path that doesn't end in / has an open last segment, which is no token."""
    return [f".{t}" for t in host.split(".") if t] + [f"/{t}" for t in path.split("/")[:-1] if t]


def compiled(rules: list[tuple[str, str]]) -> list[Rule]:
    """(verdict, host and path) pairs as rules, each filed under its rarest token; of equally rare ones the longest, then the first in order."""
    parts = [(verdict, text, text.partition("/")[0].translate(str.maketrans(UPPER, LOWER)), "".join(text.partition("/")[1:])) for verdict, text in rules]
    seen = Counter(t for _, _, host, path in parts for t in set(tokens_of(host, path)))
    out = []
    for verdict, text, host, path in parts:
        token = min(tokens_of(host, path), key=lambda t: (seen[t], -len(t), t), default="")
        regex = r"(?s)^(?:[^/]*\.)?" + re.sub(r"([^A-Za-z0-9_/-])", r"\\\1", host) + re.sub(r"([^A-Za-z0-9_/-])", r"\\\1", path) if host else "(?!)"
        out.append(Rule(text, verdict, token, regex))
    return out


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    labels = F.transform(F.filter(F.split(host, r"\."), lambda t: t != ""), lambda t: F.concat(F.lit("."), t))
    segments = F.transform(F.filter(F.split(path, "/"), lambda t: t != ""), lambda t: F.concat(F.lit("/"), t))
    return F.array_distinct(F.concat(labels, segments))


def _best(candidates: Column, host: Column, path: Column) -> Column:
    """The longest of the candidate rules whose expression fits; of equally long ones the greatest text, then the greatest verdict."""
    where = F.concat(host, path)
    fits = F.filter(candidates, lambda r: (host != "") & F.regexp(where, r["regex"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def judge_urls(df: DataFrame, rules: list[tuple[str, str]], url: str = "url", max_literal_rules: int = MAX_LITERAL_RULES) -> DataFrame:
    """Adds host, path, rule (null if none fits) and verdict; such columns of df are replaced."""
    index: dict[str, list[Rule]] = defaultdict(list)
    for rule in compiled(rules):
        index[rule.token].append(rule)
    df = df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    host, path = F.col("host"), F.col("path")
    if not index:
        return df.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(DEFAULT_VERDICT)})
    if len(rules) <= max_literal_rules:
        of = lambda r: F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.regex).alias("regex"))
        filed = F.create_map(*[x for token, found in index.items() for x in (F.lit(token), F.array(*map(of, found)))])
        known = F.array(*map(F.lit, index))
        fetched = F.flatten(F.transform(F.array_intersect(url_tokens(host, path), known), lambda t: F.try_element_at(filed, t)))
        df = df.withColumn("__best", _best(fetched, host, path))
    else:
        spark = df.sparkSession
        table_ = spark.createDataFrame([(t, r.text, r.verdict, r.regex) for t, found in index.items() for r in found], "token string, rule string, verdict string, regex string")
        filed = table_.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        places = df.select("host", "path").distinct()
        asked = places.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")).withColumn("token", F.explode(url_tokens(host, path)))
        met = asked.join(filed, ["token", "salt"]).where(F.regexp(F.concat(host, path), F.col("regex")))
        best = met.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("__best"))
        df = df.join(best, ["host", "path"], "left")
    best = F.col("__best")
    return df.withColumns({"rule": best["rule"], "verdict": F.coalesce(best["verdict"], F.lit(DEFAULT_VERDICT))}).drop("__best")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), QUERY_RULES).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = """
with u as (
  select page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
r(rule, rhost, rpath, verdict) as (values
  ('com/', 'com', '/', 'allow'),
  ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
  ('net/es/', 'net', '/es/', 'block'),
  ('net/fr/', 'net', '/fr/', 'block')),
m as (
  select u.*, (
    select max(struct_pack(n := length(r.rule), rule := r.rule, verdict := r.verdict)) from r
    where (u.host = r.rhost or ends_with(u.host, '.' || r.rhost)) and starts_with(u.path, r.rpath)) as b
  from u)
select page_id, host, path, b.rule as rule, coalesce(b.verdict, 'allow') as verdict from m
"""
