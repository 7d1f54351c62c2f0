"""robots.txt as tables: groups, rules, and who may fetch what. Native.

Only a body that was served with status 200 and isn't HTML counts. Neighbouring user-agent lines share a group (a sitemap
line between them doesn't end it); an empty Disallow makes no rule. A bot obeys the groups whose agent its name contains,
all together, else the `*` groups; of the rules that match a path the longest wins, allow before disallow; without one it
may fetch. A group that names a bot but has no rules still hides `*`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Known keys, and the bots whose access is reported, in order.
KNOWN = ("user-agent", "disallow", "allow", "sitemap", "crawl-delay", "host", "clean-param")
AI_BOTS = ("GPTBot", "OAI-SearchBot", "ChatGPT-User", "PerplexityBot", "ClaudeBot", "anthropic-ai", "Google-Extended", "Bingbot", "YandexBot", "Applebot-Extended")


def is_text() -> Column:
    return ~F.coalesce(F.contains(F.lower("content_type"), F.lit("html")), F.lit(False)) & ~F.coalesce(F.col("body").rlike(r"(?is)^\s*<(!doctype|html)"), F.lit(False))


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\u00A0\uFEFF]+|[\s\u00A0\uFEFF]+$", "")


def directives(robots: DataFrame) -> DataFrame:
    """site, line, key, value, group_no: known lines in order. robots: site, status, content_type, body."""
    text = F.coalesce(F.col("status") == 200, F.lit(False)) & is_text()
    lines = robots.where(text).select("site", F.posexplode(F.split("body", "\r?\n")).alias("line", "raw"))
    cut = lines.withColumn("raw", _trim(F.regexp_replace("raw", "#.*$", ""))).withColumn("at", F.instr("raw", ":")).where("at > 1")
    known = cut.select("site", "line", F.lower(_trim(F.expr("left(raw, at - 1)"))).alias("key"), _trim(F.expr("substring(raw, at + 1)")).alias("value")).where(F.col("key").isin(*KNOWN))
    order = Window.partitionBy("site").orderBy("line")
    before = F.last(F.when(F.col("key") != "sitemap", F.col("key")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = (F.col("key") == "user-agent") & (F.coalesce(before, F.lit("")) != "user-agent")
    return known.withColumn("group_no", F.sum(begins.cast("int")).over(order))


def agents(lines: DataFrame) -> DataFrame:
    return lines.where("key = 'user-agent'").select("site", "group_no", F.lower("value").alias("agent")).distinct()


def rules(lines: DataFrame) -> DataFrame:
    return lines.where("key in ('allow', 'disallow') and value != '' and group_no > 0").select("site", "group_no", (F.col("key") == "allow").alias("allow"), F.col("value").alias("path"))


def allowed(robots: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (site, bot, path) with `allowed`."""
    lines = directives(robots)
    named = asked.join(agents(lines), "site").where((F.col("agent") == "*") | F.contains(F.lower("bot"), F.col("agent")))
    every = Window.partitionBy("site", "bot", "path")
    own = named.withColumn("named", F.max((F.col("agent") != "*").cast("int")).over(every)).where("named = 0 or agent != '*'").select("site", "bot", "path", "group_no").distinct()
    pattern = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace("rule", r"([.+?^{}()|\[\]\\])", r"\\$1"), r"\*", ".*"), r"\$(?!$)", r"\\\$"))
    met = own.join(rules(lines).withColumnRenamed("path", "rule"), ["site", "group_no"]).where(F.regexp(F.col("path"), pattern))
    best = met.groupBy("site", "bot", "path").agg(F.max_by("allow", F.struct(F.length("rule"), "allow")).alias("best"))
    return asked.join(best, ["site", "bot", "path"], "left").select("site", "bot", "path", F.coalesce("best", F.lit(True)).alias("allowed"))


def blocked(robots: DataFrame, bot: str) -> DataFrame:
    """site of the robots that name the bot and close the whole site to it; being closed by `*` alone doesn't count."""
    named = agents(directives(robots)).where((F.col("agent") != "*") & F.contains(F.lit(bot.lower()), F.col("agent"))).select("site").distinct()
    return allowed(robots, named.select("site", F.lit(bot).alias("bot"), F.lit("/").alias("path"))).where("not allowed").select("site")
