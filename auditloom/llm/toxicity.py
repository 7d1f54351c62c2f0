"""Operator 8: toxicity by a string-kernel support vector machine.

Two words are as alike as the gapped letter triples they share: each triple of letters in order, within MAX_SPAN
letters, weighs DECAY to the power of the stretch it takes (a subsequence kernel, normalised, then squared; the
ends of a word count as letters). An insult with letters put
in between, left out or spaced apart keeps most of its triples. Words are compared with a few landmark words; a sentence
has, for each landmark, the likeness of its most alike word. Nystroem's map makes these the features of a linear support
vector machine over the sentences; a text scores as its worst sentence.

Labels are given for texts. A toxic text teaches through its worst sentence under the model so far, another through its
worst sentences, all not toxic; two rounds. Landmarks are the words and
beginnings of words that stand in toxic training texts most more than by
chance. The fit reads about `max_per_class` labelled rows of each class (a parameter;
taken by a hash); scoring reads whole texts. Likenesses under TINY count as 0, which an upper bound shows for nearly all
words without comparing them.

Null and empty texts get the score of a sentence without any likeness. Labels that are null teach nothing; without rows
of both classes every score is the share of toxic rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .language_id import fold

DECAY = 0.8
MAX_SPAN = 7
BUCKET_BITS = 14
TINY = 0.5
POWER = 2
LANDMARKS = 64
#: Words as like as this to a landmark don't become another.
SAME = 0.75
#: Beginnings of words, of so many letters, may be landmarks too.
STEMS = (4, 5, 6, 7)
MAX_PER_CLASS = 2500
#: A landmark stands in this share of the toxic training texts' sentences at least.
LEAST_SHARE = 0.001
#: ... and this much more often there than in the others.
LEAST_RATIO = 3
#: Longer words are read in windows of so many letters, half overlapping.
WINDOW = 32
ROUNDS = 2
WORST = 3
#: Words whose likenesses a worker keeps; at this many it starts anew.
KEPT_WORDS = 600_000

_SENTENCE = re.compile(r"[.!?]+(?=\s|$)|\n")
_SPACED = re.compile(r"(?<!\S)(?:\S ){2,}\S(?!\S)")
_NOT_LETTERS = re.compile(r"[\W_]+")


class Model(NamedTuple):
    landmarks: list[str]
    weights: np.ndarray  # of the likenesses (the machine's weights behind Nystroem's map)
    bias: float
    slope: float  # from a text's worst value to a probability
    offset: float


def sentences(text: str | None) -> list[list[str]]:
    """Each sentence's words, lower-cased; three or more single characters in a row make a word too."""
    out = [s.split() for s in _SENTENCE.split((text or "").lower())]
    for words in out:
        if list(map(len, words)).count(1) >= 3:
            words += [w.replace(" ", "") for w in _SPACED.findall(" ".join(words))]
    return out


def marked(word: str) -> str:
    """A word's letters and digits between marks of its two ends."""
    return f"^{_NOT_LETTERS.sub('', word)}$"


def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.array([(i, j, k) for i in range(n - 2) for j in range(i + 1, n - 1) for k in range(j + 1, min(n, i + MAX_SPAN))], np.int64).reshape(-1, 3)
    return at, DECAY ** (at[:, 2] - at[:, 0] + 1.0)


def _hashed(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of one length (rows of letters): bucket and weight of each of their triples."""
    at, weights = _triples(letters.shape[1])
    a, b, c = (letters[:, at[:, i]] for i in range(3))
    h = (a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D) + c * np.uint32(0x27D4EB2F)
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BUCKET_BITS), weights


def _letters(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)


def _profile(word: str) -> np.ndarray:
    """A word's weights by bucket, of unit length."""
    out = np.zeros(1 << BUCKET_BITS)
    if len(word) >= 3:
        buckets, weights = _hashed(_letters([word]))
        np.add.at(out, buckets[0], weights)
        out /= np.linalg.norm(out)
    return out


def _forms(word: str) -> list[str]:
    """A word as it may become a landmark: whole, and its beginnings."""
    form = marked(word)
    return [form, *(form[: n + 1] for n in STEMS if n + 2 < len(form))] if 5 <= len(form) <= WINDOW else []


class Likeness:
    """Of words to the landmarks. Row 0 of `rows` is that of all words with no likeness."""

    def __init__(self, landmarks: list[str]):
        self.profiles = np.stack([_profile(w) for w in landmarks], axis=1) if landmarks else np.zeros((1 << BUCKET_BITS, 0))
        self.most = self.profiles.max(1, initial=0.0)
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.rows: list[np.ndarray] = [np.zeros(self.profiles.shape[1])]

    def learn(self, words: set[str]) -> None:
        by_length: dict[int, list[tuple[str, str]]] = {}
        for word in words:
            self.known[word] = 0
            form = marked(word)
            n = len(form)
            if n > WINDOW:
                for at in range(0, n - WINDOW // 2, WINDOW // 2):
                    part = form[at : at + WINDOW]
                    by_length.setdefault(len(part), []).append((word, part))
            elif n >= 5:
                by_length.setdefault(n, []).append((word, form))
        for length, pairs in by_length.items():
            for start in range(0, len(pairs), 4096):
                some = pairs[start : start + 4096]
                letters = _letters([part for _, part in some])
                for n in (*(s + 1 for s in STEMS if s + 2 < length), length):  # beginnings, and the whole
                    self._compare(some, letters[:, :n])

    def _compare(self, some: list[tuple[str, str]], letters: np.ndarray) -> None:
        buckets, weights = _hashed(letters)
        bound = (self.most[buckets] * weights).sum(1) / np.sqrt((weights**2).sum())
        for i in np.flatnonzero(bound >= TINY).tolist():
            word = some[i][0]
            own, place = np.unique(buckets[i], return_inverse=True)
            profile = np.bincount(place, weights)
            row = (profile / np.sqrt(profile @ profile)) @ self.profiles[own]
            row = np.where(row < TINY, 0.0, row**POWER)
            if row.any():
                if self.known[word]:
                    self.rows[self.known[word]] = np.maximum(self.rows[self.known[word]], row)
                else:
                    self.known[word] = len(self.rows)
                    self.rows.append(row)

    def of(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Of each text: a row of likenesses for each sentence that has any."""
        split = [sentences(t) for t in texts]
        if len(self.known) > KEPT_WORDS:
            self.reset()
        fresh = set().union(*chain.from_iterable(split)).difference(self.known)
        if fresh:
            self.learn(fresh)
        known = self.known.__getitem__
        for parts in split:
            found = []
            for words in parts:
                rows = set(map(known, words))
                rows.discard(0)
                if rows:
                    found.append(np.max([self.rows[i] for i in rows], axis=0))
            yield np.array(found) if found else np.zeros((0, self.profiles.shape[1]))


_likeness: dict[tuple[str, ...], Likeness] = {}


def _of_worker(landmarks: list[str]) -> Likeness:
    key = tuple(landmarks)
    if key not in _likeness:
        _likeness.clear()
        _likeness[key] = Likeness(landmarks)
    return _likeness[key]


def _groups(values: pa.Array, chars: int = 1_000_000) -> Iterator[list[str | None]]:
    group, size = [], 0
    for v in values:
        group.append(v.as_py())
        size += len(group[-1] or "")
        if size > chars:
            yield group
            group, size = [], 0
    if group:
        yield group


def _worst_sentences(landmarks: list[str], weights: np.ndarray, n: int):
    """Rows (toxic, share, place, features) of the n sentences of each text that score highest; of one with none: zeros."""

    def worst(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likeness = _of_worker(landmarks)
        for batch in batches:
            ids, places, rows = [], [], []
            of = chain.from_iterable(map(likeness.of, _groups(batch.column(0))))
            for i, found in enumerate(of):
                best = found[np.argsort(-(found @ weights), kind="stable")[:n]] if len(found) else np.zeros((1, len(landmarks)))
                ids += [i] * len(best)
                places += range(len(best))
                rows += best.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(ids, pa.int64())), batch.column(2).take(pa.array(ids, pa.int64())), pa.array(places, pa.int32()), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "share", "place", "row"])

    return worst


def _machine(x: np.ndarray, y: np.ndarray, w: np.ndarray, l2: float = 3e-3) -> tuple[np.ndarray, float]:
    """Linear, squared hinge, by Newton steps on the rows inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(x.shape[1])
    penalty = np.eye(x.shape[1]) * l2
    penalty[-1, -1] = 1e-9
    for _ in range(50):
        inside = y * (x @ beta) < 1
        a = x[inside] * w[inside, None]
        new = np.linalg.solve(a.T @ x[inside] + penalty, a.T @ y[inside])
        if np.allclose(new, beta, atol=1e-9):
            break
        beta = new
    return beta[:-1], float(beta[-1])


def _probability(values: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through (value, toxic), by Newton steps."""
    x = np.stack([values, np.ones_like(values)], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - y)) + 1e-3 * beta
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit(documents: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> Model:
    """documents: doc_id, text; labels: doc_id, toxic (0 or 1)."""
    marked = labels.where("doc_id is not null and toxic is not null").select("doc_id", (F.col("toxic") != 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    base = counts.get(1, 0) / max(1, sum(counts.values()))
    if len(counts) < 2:
        return Model([], np.zeros(0), 0.0, 0.0, float(np.log((base + 1e-6) / (1 - base + 1e-6))))
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, max_per_class / counts[1]))).otherwise(F.lit(min(1.0, max_per_class / counts[0])))
    taken = marked.withColumn("share", share).where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 20)) < F.col("share") * (1 << 20))
    # of a bounded size: about max_per_class rows of each class
    sample = written(documents.select("doc_id", "text").join(F.broadcast(taken), "doc_id").where("text is not null").groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("share").alias("share")).repartition(24))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                parts = [p for p in sentences(text.as_py()) if p]
                found = [sorted(set(chain.from_iterable(map(_forms, p)))) for p in parts]
                marks = [xxhash.xxh3_64_intdigest(" ".join(p).encode()) >> 1 for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(marks, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array([toxic.as_py()] * len(parts), pa.int32())], ["sentence", "words", "toxic"])

    # sentences that copies of a text share count once
    split = written(sample.select("text", "toxic").mapInArrow(words, "sentence long, words array<string>, toxic int").dropDuplicates(["sentence"]))
    n = {r["toxic"]: r["n"] for r in split.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return Model([], np.zeros(0), 0.0, 0.0, float(np.log((base + 1e-6) / (1 - base + 1e-6))))
    seen = split.select(F.explode("words").alias("word"), "toxic")
    seen = seen.groupBy("word").agg(F.sum("toxic").alias("k1"), F.sum(1 - F.col("toxic")).alias("k0"))
    p1, p0 = (F.col("k1") + 0.5) / (n1 + 1), (F.col("k0") + 0.5) / (n0 + 1)
    z = (F.log(p1) - F.log(p0)) / F.sqrt(1 / (F.col("k1") + 0.5) + 1 / (F.col("k0") + 0.5))
    ranked = seen.where(F.col("k1") >= max(3, LEAST_SHARE * n1)).withColumn("z", z).where((F.col("z") > 3) & (p1 > LEAST_RATIO * p0)).orderBy(F.desc("z"), "word").limit(20 * LANDMARKS)
    landmarks: list[str] = []
    profiles = np.zeros((1 << BUCKET_BITS, 0))
    for word in (r["word"] for r in ranked.collect()):
        own = _profile(word)
        if len(landmarks) < LANDMARKS and (own @ profiles).max(initial=0.0) < SAME:
            landmarks.append(word)
            profiles = np.column_stack([profiles, own])
    values, vectors = np.linalg.eigh((profiles.T @ profiles) ** POWER)
    root = vectors / np.sqrt(np.maximum(values, 1e-3))  # Nystroem's map: likenesses to features
    weights = np.ones(len(landmarks))
    bias = 0.0
    for _ in range(ROUNDS):
        data = sample.mapInArrow(_worst_sentences(landmarks, weights, WORST), "toxic int, share double, place int, row array<double>").toPandas()
        x = np.array(data["row"].tolist()).reshape(len(data), len(landmarks))
        toxic = data["toxic"].to_numpy() == 1
        # of a toxic text's sentences only the worst is known to be one; the rest aren't used
        first = ~toxic | (data["place"].to_numpy() == 0)
        cost = np.where(toxic, 0.5 / max(1, (first & toxic).sum()), 0.5 / max(1, (~toxic).sum()))
        beta, bias = _machine(x[first] @ root, np.where(toxic[first], 1.0, -1.0), cost[first])
        weights = root @ beta
    data = sample.mapInArrow(_worst_sentences(landmarks, weights, 1), "toxic int, share double, place int, row array<double>").toPandas()
    x = np.array(data["row"].tolist()).reshape(len(data), len(landmarks))
    slope, offset = _probability(x @ weights + bias, data["toxic"].to_numpy().astype(float), (1 / data["share"]).to_numpy())
    return Model(landmarks, weights, bias, slope, offset)


def scored(model: Broadcast, text: Column) -> Column:
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        m: Model = model.value
        likeness = _of_worker(m.landmarks)
        worst = [max(float((found @ m.weights).max()), 0.0) if len(found) else 0.0 for found in chain.from_iterable(map(likeness.of, _groups(texts)))]
        return pa.array(1 / (1 + np.exp(-np.clip(m.slope * (np.array(worst, float) + m.bias) + m.offset, -30, 30))), pa.float64())

    return score(text)


def score_texts(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds score and predicted; such columns of df are replaced."""
    held = df.sparkSession.sparkContext.broadcast(model)  # landmarks and their weights
    return df.withColumn("score", scored(held, F.col(text))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0))
    return score_texts(docs, model).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
