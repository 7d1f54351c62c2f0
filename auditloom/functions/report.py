"""Texts and grades of a report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Good up to the first, middling up to the second.
RATES = {"lcp_ms": (2500.0, 4000.0), "cls": (0.1, 0.25), "inp_ms": (200.0, 500.0)}


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """The Russian form of a noun after a number."""
    ten, hundred = n % 10, n % 100
    return F.when((ten == 1) & (hundred != 11), one).when(ten.between(2, 4) & ~hundred.between(12, 14), few).otherwise(many)


def first_sentence(text: Column, fallback: Column) -> Column:
    """Up to the first . ! or ? before white space or the end, its first line."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    end = F.regexp_extract(t, r"(?s)^(.+?[.!?])(?:\s|$)", 1)
    return F.when(t == "", fallback).otherwise(F.trim(F.split(F.when(end != "", end).otherwise(t), "\n")[0]))


def tone(score: Column) -> Column:
    """good from 80, warn from 50, else bad: of scores and verdicts."""
    return F.when(score >= 80, "good").when(score >= 50, "warn").otherwise("bad")


def percent(share: Column) -> Column:
    return F.floor(share * 100 + 0.5).cast("int")


def rate(value: Column, of: str) -> Column:
    """good, warn or bad of a page speed figure (a key of RATES); null of null."""
    good, middling = RATES[of]
    return F.when(value.isNull(), None).when(value <= good, "good").when(value <= middling, "warn").otherwise("bad")


def is_audit_id(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.lit(False))


def escaped(text: Column) -> Column:
    """HTML's special characters as references; '' for null."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(c), F.lit(to))
    return out


def download_name(host: Column, created_at: Column) -> Column:
    return F.concat(F.lit("otchet-"), F.regexp_replace(host, "(?i)[^a-z0-9.-]", "_"), F.lit("-"), F.left(created_at, F.lit(10)), F.lit(".html"))


def page_speed(json: Column) -> Column:
    """STRUCT performance, accessibility, best_practices, seo (0 to 100), lcp_ms, cls, inp_ms of a page speed report; missing figures are null."""
    at = lambda p: F.get_json_object(json, p).try_cast("double")
    score = lambda c: percent(at(f"$.lighthouseResult.categories['{c}'].score"))
    audit = lambda a: at(f"$.lighthouseResult.audits['{a}'].numericValue")
    return F.struct(
        score("performance").alias("performance"), score("accessibility").alias("accessibility"), score("best-practices").alias("best_practices"), score("seo").alias("seo"),
        F.floor(audit("largest-contentful-paint") + 0.5).alias("lcp_ms"), (F.floor(audit("cumulative-layout-shift") * 1000 + 0.5) / 1000).alias("cls"), at("$.loadingExperience.metrics.INTERACTION_TO_NEXT_PAINT.percentile").alias("inp_ms"),
    )
