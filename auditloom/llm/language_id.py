"""Operator 10: language by the nearest of several centroids.

A text is a TF-IDF vector of hashed letter trigrams (damped counts, unit length). Spherical k-means clusters each
language's training texts into a few centroids; a text gets the language of the centroid with the largest cosine.
The distance rejects: a text farther from every centroid than any training text is from its own language's, by a
margin, is flagged.

The fit reads at most about `max_per_lang` labelled rows of a language, taken by a hash of the whole row (the only
bound; it is a parameter). Prediction reads whole texts and nothing else. A text that is null or has no letter is
`und` with score 0 and is rejected. Equal scores go to the smaller language name. Without a labelled row every
text is `und`.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

BITS = 14
CENTROIDS = 4
MAX_PER_LANG = 800
ROUNDS = 8
#: Share of the least cosine of a training text to its own language's centroids below which a text is rejected.
MARGIN = 0.5
UND = "und"

_NO_LETTERS = re.compile(r"[\W\d_]+")
#: Numbers that aren't decimal digits (Ⅷ, ½, ②) are no letters either.
_NUMBERS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Nl", "No"))


def letters(text: str | None) -> str:
    """The lower-cased letters and marks of a text; one space stands for whatever lies between them."""
    words = _NO_LETTERS.sub(" ", (text or "").lower()).strip()
    if not words.isascii() and (odd := _NUMBERS.intersection(words)):
        words = " ".join(words.translate(dict.fromkeys(map(ord, odd), " ")).split())
    return words


class Model(NamedTuple):
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # buckets x centroids
    owner: np.ndarray  # index into langs of each centroid
    least: float


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's letter trigrams, word ends included, and their counts."""
    words = letters(text)
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = np.frombuffer(f" {words} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    h = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)
    counts = np.bincount((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def _vector(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(counts) * idf[at]
    return v / max(float(np.linalg.norm(v)), 1e-12)


def _k_means(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical; starts from the mean's nearest row and then the farthest rows."""
    chosen = [int(np.argmax(x @ x.sum(0)))]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin((x @ x[chosen].T).max(1))))
    centres = x[chosen]
    for _ in range(ROUNDS):
        near = (x @ centres.T).argmax(1)
        centres = np.stack([x[near == j].sum(0) if (near == j).any() else c for j, c in enumerate(centres)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def _sparse(text: Column) -> Column:
    @F.arrow_udf("at binary, counts binary")
    def counted(texts: pa.Array) -> pa.Array:
        found = [grams(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([a.astype("<i4").tobytes() for a, _ in found], pa.binary()), pa.array([c.astype("<i4").tobytes() for _, c in found], pa.binary())], ["at", "counts"])

    return counted(text)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", max_per_lang: int = MAX_PER_LANG, centroids: int = CENTROIDS) -> Model:
    """From rows with a language; rows without one, or without a letter, teach nothing."""
    rows = small_batches(labelled).select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    of = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not of:
        return Model([], np.zeros(1 << BITS), np.zeros((1 << BITS, 0)), np.zeros(0, int), 0.0)
    share = F.create_map(*[x for k, n in of.items() for x in (F.lit(k), F.lit(min(1.0, max_per_lang / n)))])
    taken = rows.where(F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 20)) < F.try_element_at(share, F.col("lang")) * (1 << 20))
    data = taken.select("lang", _sparse(F.col("text")).alias("v")).select("lang", "v.*").toPandas()
    data = data[data["at"].map(len) > 0].sort_values(["lang", "at", "counts"], ignore_index=True)
    sparse = [(np.frombuffer(a, "<i4"), np.frombuffer(c, "<i4")) for a, c in zip(data["at"], data["counts"], strict=True)]
    seen = np.bincount(np.concatenate([a for a, _ in sparse] or [np.empty(0, np.int64)]), minlength=1 << BITS)
    idf = np.log((1 + len(sparse)) / (1 + seen)) + 1
    langs, parts, owner, least = sorted(set(data["lang"])), [], [], 1.0
    for j, name in enumerate(langs):
        x = np.zeros((int((data["lang"] == name).sum()), 1 << BITS), np.float32)
        for row, i in zip(x, np.flatnonzero(data["lang"] == name), strict=True):
            row[sparse[i][0]] = _vector(*sparse[i], idf)
        centres = _k_means(x, centroids)
        least = min(least, float((x @ centres.T).max(1).min()))
        parts.append(centres)
        owner += [j] * len(centres)
    return Model(langs, idf, np.concatenate(parts).T.astype(np.float32).copy() if parts else np.zeros((1 << BITS, 0)), np.array(owner, int), least)


def predicted(model: Broadcast, text: Column) -> Column:
    """STRUCT lang_pred, score (cosine, 0 to 1), rejected."""

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def nearest(texts: pa.Array) -> pa.Array:
        m: Model = model.value
        langs, scores, rejected = [], [], []
        for t in texts:
            at, counts = grams(t.as_py())
            if not len(at) or not m.langs:
                langs.append(UND)
                scores.append(0.0)
                rejected.append(True)
                continue
            cosines = _vector(at, counts, m.idf).astype(np.float32) @ m.centroids[at]
            j = int(cosines.argmax())  # the first of equals; centroids stand in the order of names
            langs.append(m.langs[m.owner[j]])
            scores.append(min(1.0, max(0.0, float(cosines[j]))))
            rejected.append(scores[-1] < MARGIN * m.least)
        return pa.StructArray.from_arrays([pa.array(langs), pa.array(scores, pa.float64()), pa.array(rejected)], ["lang_pred", "score", "rejected"])

    return nearest(text)


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred, score and rejected; such columns of df are replaced."""
    held = df.sparkSession.sparkContext.broadcast(model)  # of a fixed size: buckets x centroids x languages
    found = "__found"
    return small_batches(df).withColumn(found, predicted(held, F.col(text))).withColumns({x: F.col(found)[x] for x in ("lang_pred", "score", "rejected")}).drop(found)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the folds; null ids are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)), F.lit(0))


def corpus_model(documents: DataFrame) -> Model:
    return fit(documents.where(fold(F.col("doc_id"), 3) != 1))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), corpus_model(docs))
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")
