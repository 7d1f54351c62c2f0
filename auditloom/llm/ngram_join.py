"""Operator 4: documents whose word 5-gram sets have a Jaccard similarity of at least 0.8, and the groups they form.

1. Shingles of whole texts, hashed to 64 bits. A set of n that has a similar one shares at least o = ceil(0.8 n) of its shingles
   with it. First sieve: of the shingles in a low zone of the hash space, all but n - o must stand in other documents too.
   Zone shingles are counted over all documents (48 bits are sent, so a chance match only lets a document through).
   Few documents without a partner pass.
2. What passes is put in classes of equal sets, of which one document each goes on. Its whole set is counted again, and
   ordered by document frequency, the rarest first. Shingles of no other class go no further; a class that has fewer than o
   others drops out.
3. Adaptive prefix filter. Two similar sets of n and m have ceil(4/9 (n + m)) shingles in common, so they share at least L of
   the first n - ceil(4/9 (n + m)) + L of either, for every L. A class takes the L of the fewest estimated candidates (those that
   share L shingles of a prefix are at most the sum of its document frequencies, divided by L), up to o, the overlap that a
   similar set is sure to have; a pair must share the lesser L of its two classes, at positions that their two sizes allow. As no
   partner can share more than a class's s shared shingles, its partners' sizes lie from o to 2.25 s - n.
4. Stars. Each class is compared with the most shared-in class of a prefix shingle, for the heads that it meets most.
5. The rest. Of a prefix shingle whose classes lie in several components, those outside of the shingle's largest component
   meet the others, by bands of size. First the most promising pair of any two components is compared, then every pair that
   still lies across components.

Rows stay linear in the documents as long as a frequent shingle's classes are connected by stars. Every link that is kept
was verified on whole sets; every pair of classes that could link is either verified or already in one component. Texts are
never cut. Null and empty texts have the empty set and link with nothing. Rows that share a doc_id are told apart by
their sets; they get their own counts. A null doc_id gets a null component and links with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, Scratch, small_batches, table
from .components import connected_components

WORDS = 5
PERCENT = 80
#: Share of the hash space whose shingles the first sieve counts; above 1 - PERCENT / 100, as it can't tell anything below.
ZONE = 0.3
#: Hashes of the first sieve have so many bits (all else uses 64).
BITS = 48
MOST_MATCHES = 12
#: Heads with which a class is compared first.
HEADS = 2
#: Sizes of one band differ by this factor at most.
BAND = 1.08

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; of the whole sequence if there are fewer words."""
    found = (text or "").encode().translate(ASCII_LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = len(h) - words + 1
    x = np.zeros(n, np.uint64)
    for j in range(words):
        x = (x ^ h[j : j + n]) * _FACTORS[j % len(_FACTORS)]
        x ^= x >> np.uint64(29)
    return np.unique(x * _FACTORS[0] ^ (x >> np.uint64(32)))


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sure(n: int, percent: int = PERCENT) -> int:
    """The overlap that a similar set has at least with a set of n."""
    return (n * percent + 99) // 100


def needed(n: int, m: int, percent: int = PERCENT) -> int:
    """The overlap of similar sets of n and m."""
    return (percent * (n + m) + 99 + percent) // (100 + percent)


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64)))


def _zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shift, zone = np.uint64(64 - BITS), np.uint64(int(ZONE * 2**BITS))
    for batch in batches:
        found = [shingles(t.as_py()) for t in batch.column(3)]
        short = [np.unique(s >> shift) for s in found]
        sent = [s[: int(np.searchsorted(s, zone))] for s in short]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(map(len, found), pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary()), _lists(sent)],
            ["key", "doc_id", "copy", "n", "sig", "tokens"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists([shingles(t.as_py()) for t in batch.column(2)])], ["key", "n", "tokens"])


def _prefixes(percent: int, most: int):
    """Of each class: its s shingles that other classes have, the sizes of possible partners, how many shingles a pair must share, and its prefix."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {x: [] for x in ("key", "n", "s", "lo", "hi", "matches", "prefix")}
            for key, n, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                tokens, df = (found.values.field(x).to_numpy() for x in ("token", "df"))
                s, o = len(tokens), sure(n, percent)
                if s < o:
                    continue
                order = np.lexsort((tokens, df))
                tokens, costs = tokens[order], np.cumsum(df[order] - 1)
                asks = np.arange(1, min(most, o) + 1)
                lengths = np.clip(s - needed(n, n, percent) + asks, asks, s)  # of the prefix that meets sets of its own size
                matches = int(asks[np.argmin(costs[lengths - 1] / asks)])
                for x, v in zip(rows, (key, n, s, o, (100 + percent) * s // percent - n, matches, tokens[: s - o + matches].tolist()), strict=True):
                    rows[x].append(v)
            yield pa.RecordBatch.from_pydict(rows, pa.schema([(x, pa.int64()) for x in list(rows)[:-1]] + [("prefix", pa.list_(pa.int64()))]))

    return prefixes


def _shared(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, token) of all sets; (token, df) of the tokens that several sets have. Counts combine before the shuffle."""
    tokens = sets.select("key", F.explode("tokens").alias("token"))
    return tokens, tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that are similar. v's set travels to u's, so the set of a much paired u moves once."""
    one, other = (sets.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"tokens_{x}")) for x in "uv")
    met = pairs.select("u", "v").join(other, "v").join(one, "u")
    both = F.size(F.array_intersect("tokens_u", "tokens_v"))
    return met.where(100 * both >= percent * (F.col("n_u") + F.col("n_v") - both)).select("u", "v")


def _band(size: Column) -> Column:
    return F.floor(F.log(size) / F.log(F.lit(BAND))).cast("int")


def _fit(a: str, b: str) -> str:
    return f"n_{b} between lo_{a} and hi_{a}"


def _needed(n: str, m: str, percent: int) -> str:
    return f"(({percent} * ({n} + {m}) + 99 + {percent}) div (100 + {percent}))"


def _across(members: DataFrame, percent: int) -> DataFrame:
    """u, v, common, component_u, component_v: pairs of classes of different components whose prefixes share enough, of sizes that fit.

    members: token, pos (of the token in the prefix), key, n, s, lo, hi, matches, component."""
    several = members.groupBy("token", "component").agg(F.count("*").alias("k")).groupBy("token").agg(F.count("*").alias("components"), F.max(F.struct("k", "component")).alias("most"))
    met = members.join(several.where("components > 1").select("token", F.col("most.component").alias("largest")), "token").withColumn("other", F.col("component") != F.col("largest"))
    one, two = (met.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("key", "pos", "n", "s", "lo", "hi", "matches", "component", "other")]) for x in "ab")
    one = one.where("other_a").withColumn("band", F.explode(F.sequence(_band(F.col("lo_a")), _band(F.col("hi_a")))))
    one = one.where(f"pos_a < s_a - {_needed('n_a', f'greatest(lo_a, cast(floor(pow({BAND}, band)) as long) - 1)', percent)} + matches_a")
    two = two.withColumn("band", _band(F.col("n_b")))
    pairs = one.join(two, ["token", "band"]).where(f"component_a != component_b and (not other_b or key_a < key_b) and {_fit('a', 'b')} and {_fit('b', 'a')}")
    within = lambda x: f"pos_{x} < s_{x} - {_needed('n_a', 'n_b', percent)} + least(matches_a, matches_b)"
    pairs = pairs.where(f"{within('a')} and {within('b')}")
    first = F.col("key_a") < F.col("key_b")
    ends = [F.when(first, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}")).alias(name) for c, x, y, name in (("key", "a", "b", "u"), ("key", "b", "a", "v"), ("component", "a", "b", "component_u"), ("component", "b", "a", "component_v"))]
    counted = pairs.select(*ends, F.least("matches_a", "matches_b").alias("asked")).groupBy("u", "v", "component_u", "component_v").agg(F.count("*").alias("common"), F.min("asked").alias("asked"))
    return counted.where("common >= asked").select("u", "v", "common", "component_u", "component_v")


def similar_groups(df: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """Of each row: doc_id, n_shingles, component_id."""
    scratch = Scratch(df.sparkSession)
    docs = small_batches(df).select(F.monotonically_increasing_id().alias("key"), F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("copy"), F.col(text).alias("text"))
    zones = scratch.written(docs.mapInArrow(_zones, "key long, doc_id long, copy long, n long, sig binary, tokens array<long>"))
    able = zones.where("n > 0 and doc_id is not null")

    # the first sieve, and classes of what passes
    tokens, several = _shared(able)
    held = tokens.join(several.select("token"), "token").groupBy("key").agg(F.count("*").alias("shared"))
    passed = able.withColumn("z", F.size("tokens")).drop("tokens").join(held, "key", "left").where(f"coalesce(shared, 0) >= z - n + (n * {percent} + 99) div 100")
    classes = scratch.written(passed.groupBy("sig", "n").agg(F.min(F.struct("doc_id", "copy", "key")).alias("of")).select("sig", "n", "of.*"))
    texts = docs.select("doc_id", "copy", "text").join(classes.select("doc_id", "copy", "key", "n"), ["doc_id", "copy"])
    texts = texts.groupBy("doc_id", "copy", "key", "n").agg(F.first("text").alias("text")).select("key", "n", "text")
    sets = scratch.written(texts.mapInArrow(_sets, "key long, n long, tokens array<long>"))

    # prefixes
    tokens, several = _shared(sets)
    found = tokens.join(several, "token").groupBy("key").agg(F.collect_list(F.struct("token", "df")).alias("found"))
    prefixes = sets.select("key", "n").join(found, "key").select("key", "n", "found").mapInArrow(_prefixes(percent, MOST_MATCHES), "key long, n long, s long, lo long, hi long, matches long, prefix array<long>")
    prefixes = scratch.written(prefixes.where("hi >= lo"))
    members = prefixes.select("key", "n", "s", "lo", "hi", "matches", (F.col("s") / F.col("n")).alias("share"), F.posexplode("prefix").alias("pos", "token"))

    # stars
    heads = members.groupBy("token").agg(F.max(F.struct("share", (-F.col("key")).alias("less"), F.struct("key", "n", "lo", "hi").alias("of"))).alias("head"), F.count("*").alias("k"))
    heads = heads.where("k > 1").select("token", *[F.col(f"head.of.{c}").alias(f"{c}_h") for c in ("key", "n", "lo", "hi")])
    met = members.join(heads, "token").where("key != key_h and n_h between lo and hi and n between lo_h and hi_h").groupBy("key", "key_h").agg(F.count("*").alias("common"))
    stars = met.groupBy(F.col("key").alias("v")).agg(F.slice(F.sort_array(F.collect_list(F.struct("common", "key_h")), False), 1, HEADS).alias("heads"))
    links = scratch.written(_verified(stars.select("v", F.explode("heads").alias("h")).select(F.col("h.key_h").alias("u"), "v"), sets, percent))
    groups = connected_components(links, scratch)

    # the rest
    placed = members.join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    across = scratch.written(_across(placed, percent))
    ends = F.least("component_u", "component_v"), F.greatest("component_u", "component_v")
    best = scratch.written(across.groupBy(*ends).agg(F.max(F.struct("common", "u", "v")).alias("of")).select("of.u", "of.v"))
    more = scratch.written(links.unionByName(_verified(best, sets, percent)))
    now = connected_components(more, scratch)
    of = lambda x: now.select(F.col("node").alias(x), F.col("component").alias(f"now_{x}"))
    left = across.join(best, ["u", "v"], "left_anti").join(of("u"), "u", "left").join(of("v"), "v", "left").where("coalesce(now_u, u) != coalesce(now_v, v)")
    groups = connected_components(scratch.written(more.unionByName(_verified(left, sets, percent))), scratch)

    # back to documents: the smallest id of a component's classes
    label = classes.select("sig", "doc_id", "key").join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = label.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_sets = scratch.written(label.join(least, "component").select("sig", "component_id"))
    rows = zones.select("doc_id", F.col("n").alias("n_shingles"), "sig")
    scratch.keep(zones, of_sets)
    out = rows.join(of_sets, "sig", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def near_duplicates_removed(df: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """One row of each group of similar documents stays: that with the smallest id, of rows with that id one with the least text. Rows with a null id stay."""
    groups = similar_groups(df, text, doc_id, percent)
    stay = groups.where("doc_id = component_id").select(F.col("doc_id").alias("__stays")).distinct()
    kept = df.join(stay, F.col(doc_id) == F.col("__stays")).drop("__stays")
    rest = [c for c in df.columns if c not in (text, doc_id)]
    order = F.struct(text, F.to_json(F.struct(*rest)) if rest else F.lit(0))  # as JSON, since maps can't be compared
    one = kept.groupBy(doc_id).agg(F.min_by(F.struct(text, *rest), order).alias("__row"))
    one = one.select(*[F.col(doc_id) if c == doc_id else F.col("__row")[c].alias(c) for c in df.columns])
    return one.unionByName(df.where(F.col(doc_id).isNull()))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as materialized (
  select distinct doc_id, array_to_string(w[i : i + 4], ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0)),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as materialized (
  select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
e as materialized (select a, b from l union all select b, a from l),
r(doc_id, reach) as (
  select a, a from e
  union
  select r.doc_id, e.b from r join e on e.a = r.reach)
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(m.c, w.doc_id) as component_id
from w left join n using (doc_id) left join (select doc_id, min(reach) as c from r group by doc_id) m using (doc_id)
"""
