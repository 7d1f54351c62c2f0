"""Operator 5: find and cut passages of benchmark items out of training texts.

The items' normalised words make one generalised suffix automaton: a state for each class of word strings that end
at the same places in the items. A text streams through it word by word; the state and the length of the longest
match that ends at the word are all that is kept. A match of at least `window` words, or the whole of a shorter
item, is an occurrence. Stretches of words that no item has reset the automaton, so they are skipped at once.

Items are cut into pieces that overlap by a window less one word, so that each window lies whole in one; equal pieces
are one, with the ids of all their items. Tasks build an automaton of each shard of at most SHARD_WORDS words and ids,
and write it. Of one shard it is known how large it can get (two states a word), so it is broadcast; a benchmark of more
takes as many passes over the texts as it has shards, each of which adds its hits to a written table of the rows.
A benchmark of one shard takes one pass and writes no texts.
Null and empty texts have no words and no hits; an item without words occurs nowhere; a null item_id reads "null".
Repeated items count once, and items of one text under several ids each count.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small_batches, table

WINDOW = 10
#: Words, and ids of items, in one automaton at most: about 140 MB of a Python worker.
SHARD_WORDS = 200_000
#: Windows that start in a piece of an item, and about as many ids of one piece that stay together, at most.
PIECE_WORDS, NAMES = 5_000, 20_000
#: Share of a document's words in hits above which the whole document goes.
MAX_COVERAGE = 0.5

#: A-Z to a-z; everything but digits, letters and bytes of other characters to a space.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


class SuffixAutomaton:
    """Of all items together. `length` is that of a state's longest string, `link` the state of its longest suffix of another class."""

    def __init__(self, items: list[tuple[list[str], list[bytes]]], window: int):
        self.window = window
        self.names = [names for names, words in items if words]
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = list(enumerate([self.ids.setdefault(w, len(self.ids)) for w in words] for _, words in items if words))
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        #: By state: the items (places in names) with a whole window, and (length, item) of short items, that end there.
        self.windows: dict[int, set[int]] = {}
        short: dict[int, set[tuple[int, int]]] = {}
        for name, codes in coded:
            state = 0
            for i, c in enumerate(codes):
                state = self.next[state][c]
                if i + 1 >= window:
                    self.windows.setdefault(self.windowed(state), set()).add(name)
            if len(codes) < window:
                while self.length[self.link[state]] >= len(codes):
                    state = self.link[state]
                short.setdefault(state, set()).add((len(codes), name))
        self.short: dict[int, set[tuple[int, int]]] = {}
        if short:  # a state has what the states of its suffixes have
            for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
                if own := short.get(state, set()) | self.short.get(self.link[state], set()):
                    self.short[state] = own
        self.least = min([window, *(len(codes) for _, codes in coded)])

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = self._state({}, 0, length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _state(self, nxt: dict[int, int], link: int, length: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def windowed(self, state: int) -> int:
        """The state of the last `window` words of a state's longer strings."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans [start, end) of words in occurrences, in order and apart, and the items that occur."""
        codes = list(map(self.ids.get, words))
        if None in codes:
            unknown = np.flatnonzero(np.fromiter((c is None for c in codes), bool, len(codes)))
            starts, ends = np.concatenate([[0], unknown + 1]), np.concatenate([unknown, [len(codes)]])
            long = ends - starts >= self.least
            runs = zip(starts[long].tolist(), ends[long].tolist(), strict=True)
        else:
            runs = iter([(0, len(codes))])
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        nxt, link, length, window, short = self.next, self.link, self.length, self.window, self.short
        for start, end in runs:
            state = matched = 0
            for i in range(start, end):
                c = codes[i]
                while state and c not in nxt[state]:
                    state = link[state]
                    matched = length[state]
                if c in nxt[state]:
                    state, matched = nxt[state][c], matched + 1
                width = 0
                if matched >= window:
                    width = window
                    found |= self.windows[self.windowed(state)]
                for n, name in short.get(state, ()):
                    if n <= matched:
                        width = max(width, n)
                        found.add(name)
                if width:
                    a = i + 1 - width
                    while spans and spans[-1][1] >= a:
                        a = min(a, spans.pop()[0])
                    spans.append((a, i + 1))
        return spans, set(chain.from_iterable(self.names[k] for k in found))


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _pieces(benchmark: DataFrame, item_id: str, text: str, window: int, piece_words: int) -> DataFrame:
    """item, words, n: the pieces of the items' words, each with the window - 1 words that follow; an item of fewer words than a window is one piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, value in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(value.as_py())
                for at in range(0, max(1, len(words) - window + 1), piece_words) if words else ():
                    part = words[at : at + piece_words + window - 1]
                    rows.append({"item": item.as_py(), "words": b" ".join(part), "n": len(part)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("item", pa.string()), ("words", pa.binary()), ("n", pa.int64())]))

    named = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("text"))
    return small_batches(named).mapInArrow(cut, "item string, words binary, n long")


def automatons(scratch: Scratch, benchmark: DataFrame, item_id: str, text: str, window: int, shard_words: int, piece_words: int) -> DataFrame:
    """shard, automaton (pickled): a written table, each row of which one task has built. Empty if no item has words."""
    pieces = scratch.written(_pieces(benchmark, item_id, text, window, piece_words))
    salt = F.pmod(F.xxhash64("item"), F.lit(max(1, -(-pieces.count() // NAMES))))
    classes = scratch.written(pieces.groupBy("words", "n", salt.alias("salt")).agg(F.array_sort(F.collect_set("item")).alias("names")))
    weight = F.sum(F.col("n") + F.size("names"))
    sizes = classes.agg(F.count("*").alias("n"), F.coalesce(weight, F.lit(0)).alias("all")).first()
    shard = lambda n: F.pmod(F.xxhash64("words", "salt"), F.lit(n)).alias("shard")
    shards = 1 if sizes["all"] <= shard_words else -(-2 * sizes["all"] // shard_words)
    while 1 < shards < 4 * sizes["n"] and classes.groupBy(shard(shards)).agg(weight.alias("w")).agg(F.max("w")).first()[0] > shard_words:
        shards *= 2

    def build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        items = sorted((r["words"], r["names"]) for r in rows.to_pylist())
        built = SuffixAutomaton([(names, words.split(b" ")) for words, names in items], window)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "automaton": pa.array([pickle.dumps(built, pickle.HIGHEST_PROTOCOL)], pa.binary())})

    dealt = classes.select(shard(shards).cast("long").alias("shard"), "words", "names")
    out = scratch.written(dealt.groupBy("shard").applyInArrow(build, "shard long, automaton binary"))
    scratch.drop(pieces, classes)
    return out


def _passages(held: Broadcast, last: bool, text: Column, spans: Column) -> Column:
    """STRUCT n_words, n_hit, items, clean_text, spans (flat): the hits of one automaton, united with the spans of those before. The last one cuts."""

    def scan(texts: pa.Array, before: pa.Array) -> Iterator[dict]:
        for value, old in zip(texts, before, strict=True):
            value, old = value.as_py(), old.as_py() or []
            words = words_of(value)
            found, items = held.value.hits(words)
            united = _united([*found, *zip(old[::2], old[1::2], strict=True)])
            clean = None
            if united and last:
                raw = value.encode()
                at = [m.start() for m in _WORD.finditer(raw.translate(_NORMAL))] + [len(raw)]
                kept, done = [], 0
                for a, b in united:
                    kept.append(raw[done : at[a]])
                    done = at[b]
                clean = b"".join([*kept, raw[done:]]).decode()
            yield {"n_words": len(words), "n_hit": sum(b - a for a, b in united), "items": sorted(items), "clean_text": clean, "spans": list(chain.from_iterable(united))}

    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("clean_text", pa.string()), ("spans", pa.list_(pa.int32()))])

    @F.arrow_udf("n_words long, n_hit long, items array<string>, clean_text string, spans array<int>")
    def passages(texts: pa.Array, before: pa.Array) -> pa.Array:
        return pa.array(list(scan(texts, before)), kind)

    return passages(text, spans)


def find_benchmark_passages(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, piece_words: int = PIECE_WORDS) -> DataFrame:
    """Adds n_words, n_hit (words in occurrences), items (ids that occur, sorted as strings) and clean_text (null if nothing was cut).

    clean_text lacks each hit span from its first word to the next word that stays. Such columns of df are replaced.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    built = automatons(scratch, benchmark, item_id, item_text, window, shard_words, piece_words)
    shards = sorted(r["shard"] for r in built.select("shard").collect()) or [None]
    found, spans, items = "__passages", "__spans", "__items"
    rows = small_batches(df).withColumns({spans: F.lit(None).cast("array<int>"), items: F.array().cast("array<string>")})
    for shard in shards:
        one = SuffixAutomaton([], window) if shard is None else pickle.loads(built.where(F.col("shard") == shard).first()["automaton"])
        last = shard == shards[-1]
        passages = _passages(spark.sparkContext.broadcast(one), last, F.col(text), F.col(spans))
        # a generator, through which no filter moves: moved, it would have each text scanned again, by a Python worker more
        met = rows.withColumn(found, F.explode_outer(F.array(passages))).withColumns({spans: F.col(found)["spans"], items: F.array_sort(F.array_union(items, F.col(found)["items"]))})
        if last:
            scratch.keep(rows)
            return met.withColumns({"items": F.col(items)} | {x: F.col(found)[x] for x in ("n_words", "n_hit", "clean_text")}).drop(found, spans, items)
        before, rows = rows, scratch.written(met.drop(found))
        scratch.drop(before)
    raise AssertionError("there is a last shard")


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", max_coverage: float = MAX_COVERAGE, **how) -> DataFrame:
    """df with benchmark passages cut out of its texts, without the documents of which hits cover more than max_coverage."""
    found = find_benchmark_passages(df, benchmark, text, **how)
    return found.where(F.col("n_hit") <= max_coverage * F.col("n_words")).withColumn(text, F.coalesce("clean_text", text)).select(*df.columns)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_benchmark_passages(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP5_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
b as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
g as (
  select distinct item, least(len(w), 10) as n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as gram
  from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct n from g),
p as (
  select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as gram
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d cross join sizes where len(w) >= n)),
h as (select doc_id, i, n, item from p join g using (n, gram)),
words as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from h) group by doc_id),
items as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as names from h group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""
