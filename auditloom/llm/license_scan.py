"""Operator 12: find license notices in texts by ordered signature rules.

Hundreds of regular expressions (license_rules) stand in an order of priority. A text is lower-cased (A-Z); one walk of an
Aho-Corasick automaton over the rules' keywords tells which rules could fit at all, and only those run. A detection whose place
lies within that of a more decisive one, or of a longer one as decisive, is dropped: so "Apache License, Version 2.0" isn't
also a mere mention, and a mention within a whole license text isn't counted beside it. Places that only overlap both stay.
Base phrases are rules that give way to nothing: each place where a phrase's words stand one after another counts.

Places are word numbers (words from 0, runs of a-z, 0-9 and everything beyond ASCII). Rules see whole texts. Texts are read where
they are; nothing is shuffled. Null texts are empty; empty texts have no words and no labels. Repeated rows give repeated results.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license_rules
from .common import ASCII_LOWER, small_batches, table
from .license_rules import GAP, RANKS, WEIGHTS, WORD, Rule

_IS_WORD = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])


class Found(NamedTuple):
    kind: str
    label: str
    start: int
    end: int


def base_regex(phrase: str) -> re.Pattern[str]:
    """Matches the first word where the others follow, so that places may overlap."""
    first, *rest = phrase.split(" ")
    return re.compile(f"(?<!{WORD}){first}(?!{WORD})(?={''.join(f'({GAP}){w}' for w in rest)}(?!{WORD}))".replace(f"({GAP})", GAP) if rest else f"(?<!{WORD}){first}(?!{WORD})")


def unsuppressed(found: list[Found]) -> list[Found]:
    """Those that lie within no other of a higher rank, or of the same rank and longer (of equal places the first found stays). Sorted by place.

    The most decisive come first; a tree over the starts keeps the furthest end of what stays, so each is looked up in the log of their number."""
    starts = sorted({x.start for x in found})
    at = {s: i + 1 for i, s in enumerate(starts)}
    far = [-1] * (len(starts) + 1)
    kept: list[Found] = []
    for x in sorted(found, key=lambda x: (-RANKS[x.kind], x.start - x.end, x.start)):
        i, end = at[x.start], -1
        while i:
            end, i = max(end, far[i]), i & (i - 1)
        if end >= x.end:
            continue
        kept.append(x)
        i = at[x.start]
        while i < len(far):
            far[i] = max(far[i], x.end)
            i += i & -i
    return sorted(kept, key=lambda x: (x.start, x.end, x.label, x.kind))


class Scanner:
    def __init__(self, rules: list[Rule], base: list[tuple[str, str]]):
        self.rules = [(r.kind, r.label, re.compile(r.regex)) for r in rules]
        self.base = [(label, base_regex(phrase)) for phrase, label in base]
        self.clauses = [r.clauses for r in rules] + [tuple(frozenset([w]) for w in sorted(set(phrase.split(" ")), key=lambda w: (-len(w), w))) for phrase, _ in base]
        self.filed: dict[str, list[int]] = {}
        for i, found in enumerate(self.clauses):
            for word in found[0]:
                self.filed.setdefault(word, []).append(i)
        self.gate = ahocorasick.Automaton()
        for word in {w for found in self.clauses for clause in found for w in clause if len(w) > 1 or clause == found[0]}:
            self.gate.add_word(word, word)
        self.gate.make_automaton()

    def candidates(self, text: str) -> list[int]:
        """Rules, and behind them base phrases, of whose every clause the text holds a word (words of one letter aren't asked for)."""
        held = {w for _, w in self.gate.iter(text)}
        fits = lambda i: all(len(min(c, key=len)) == 1 or not held.isdisjoint(c) for c in self.clauses[i])
        return sorted({i for w in held for i in self.filed.get(w, ()) if fits(i)})

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, int]], list[tuple[str, str, int, int]]]:
        """Words; (label, word) of each base place; (label, kind, first word, last word) of each detection that stays."""
        raw = (text or "").encode().translate(ASCII_LOWER)
        word = _IS_WORD[np.frombuffer(raw, np.uint8)]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        flat = raw.decode("latin-1")  # a character for each byte
        some, n = self.candidates(flat), len(self.rules)
        found = [Found(kind, label, m.start(), m.end()) for kind, label, regex in (self.rules[i] for i in some if i < n) for m in regex.finditer(flat)]
        base = [(label, m.start()) for label, regex in (self.base[i - n] for i in some if i >= n) for m in regex.finditer(flat)]
        if not found and not base:
            return int(begins.sum()), [], []
        places = np.flatnonzero(begins)
        nth = lambda at: int(np.searchsorted(places, at, "right")) - 1
        kept = [(x.label, x.kind, nth(x.start), nth(x.end - 1)) for x in unsuppressed(found)]
        return len(places), sorted(((label, nth(at)) for label, at in base), key=lambda x: (x[1], x[0])), kept


@functools.cache
def default_scanner() -> Scanner:
    return Scanner(license_rules.rules(), license_rules.BASE)


_BASE = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
_KEPT = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64())]))
_TYPE = "n_words long, base array<struct<label string, word long>>, detections array<struct<label string, kind string, first_word long, last_word long>>"


def scan_licenses(df: DataFrame, text: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """Adds n_words, base (label, word of each base place) and detections (label, kind, first_word, last_word), each in the order of places; such columns of df are replaced."""

    @F.arrow_udf(f"struct<{_TYPE.replace(' string', ': string').replace(' long', ': long').replace(' array', ': array')}>")
    def scanned(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = scanner or default_scanner()
        for part in texts:
            rows = [own.scan(t.as_py()) for t in part]
            base = pa.array([[{"label": a, "word": n} for a, n in r[1]] for r in rows], _BASE)
            kept = pa.array([[dict(zip(("label", "kind", "first_word", "last_word"), x, strict=True)) for x in r[2]] for r in rows], _KEPT)
            yield pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.int64()), base, kept], ["n_words", "base", "detections"])

    met = small_batches(df).withColumn("__scan", scanned(F.col(text)))
    return met.withColumns({c: F.col("__scan")[c] for c in ("n_words", "base", "detections")}).drop("__scan")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score: the weight of the most decisive kind of place that stays, 0 without any."""
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    weight = F.create_map(*[x for k, w in WEIGHTS.items() for x in (F.lit(k), F.lit(w))])
    kinds = F.concat(F.transform("base", lambda x: F.lit("base")), F.transform("detections", lambda x: x["kind"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["word"])).alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["word"])).alias("last_word"),
        joined(F.transform("base", lambda x: x["label"])).alias("base_labels"),
        joined(F.concat(F.transform("base", lambda x: x["label"]), F.transform("detections", lambda x: x["label"]))).alias("labels"),
        F.coalesce(F.array_max(F.transform(kinds, lambda k: weight[k])), F.lit(0.0)).alias("score"),
    )
