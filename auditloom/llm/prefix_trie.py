"""Operator 13: the prefix trie of conversations, as burst tries.

A turn's id is the md5 of role and text (16 bytes), so a conversation is a string of ids, and strings of ids sort in the
order of a walk through the trie. Copies of a conversation are counted before anything else. A container holds the
suffixes below one prefix. A container that is too large bursts: its prefix becomes a head of the trie, and its suffixes go to
containers by their next turn id. As long shared beginnings would take a round a turn, each round bursts twice as many turns as
that before, with counts of all prefixes in between: a suffix's container is that of its shortest prefix that is small enough
(weights only fall along a suffix), so the heads and containers are those of bursting one turn at a time.
What remains are containers of CONTAINER turns at most, or of one sequence. Spark deals them out by their prefix and sorts their
strings; a sweep compares each string with the one before and turns what is left behind into nodes. Sums of the nodes
below a head are carried up between heads by pointers of doubling length, so their rounds are the logarithm of the depth.

The members that end at a node are digested apart: (sequence, conv_id) pairs are range-partitioned in order, joined into chunks of
CHUNK ids, and the chunks of a sequence go through one sha256 one after another, as that digest demands.

Turns are ordered by turn (null first), then by their id. Null role and text are empty. Rows with a null conv_id take no part. Repeated
rows are turns of their own. A conversation is held as 20 bytes a turn in one row, whatever its texts. No conversations give no rows, not even a root.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

#: Turns of a container, beyond which it bursts.
CONTAINER = 2_000
#: Ids of a chunk of a digest.
CHUNK = 16_384
HEADS, SHARED = 9, 5
NO_ENDS = hashlib.sha256(b"").hexdigest()


def sequences(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, seq (16 bytes a turn), sizes (UTF-8 bytes of each text). Texts are hashed where they are read and don't travel."""
    r, t = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    id_ = F.md5(F.encode(F.concat(F.length(r).cast("string"), F.lit(":"), r, t), "utf-8"))
    rows = turns.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.struct(F.col(turn).alias("turn"), id_.alias("id"), F.octet_length(t).cast("int").alias("size")).alias("x"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return ordered.select("conv_id", F.unhex(F.array_join("x.id", "")).alias("seq"), F.col("x.size").alias("sizes"))


def rebuilt(seqs: DataFrame, shared: int = SHARED, most: int = HEADS) -> DataFrame:
    """Each conversation c begins with the first h turns of c - c % shared, h = crc32(decimal c) % most, and goes on with its own behind its first h."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    base = seqs.select(F.col("conv_id").alias("base"), F.substring("seq", 1, 16 * (most - 1)).alias("base_seq"), F.slice("sizes", 1, most - 1).alias("base_sizes"))
    met = seqs.withColumns({"h": h, "of": F.col("conv_id") - F.col("conv_id") % shared}).join(base, F.col("of") == F.col("base"), "left")
    began = F.expr("substring(coalesce(base_seq, x''), 1, 16 * h)")
    own = F.expr("substring(seq, 16 * h + 1, greatest(0, length(seq) - 16 * h))")
    sizes = F.expr("concat(slice(coalesce(base_sizes, array()), 1, h), if(h < size(sizes), slice(sizes, h + 1, size(sizes)), array()))")
    return met.select("conv_id", F.concat(began, own).alias("seq"), sizes.cast("array<int>").alias("sizes"))


def _key(seq: Column, depth: Column) -> Column:
    return F.unhex(F.md5(F.substring(seq, F.lit(1), depth * 16)))


def _burst(distinct: DataFrame, container: int, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """The sequences with the depth of their container's prefix (null: they end at a head), and the heads below the root (key, depth, conv_id, n_convs, seq)."""
    turns = (F.length("seq") / 16).cast("int")
    depth = F.explode(F.sequence(F.col("from") + 1, F.least(F.col("turns"), F.col("from") + F.col("step"))))
    open_, step, closed, heads = distinct.withColumns({"turns": turns, "from": F.lit(0)}), 1, [], []
    while True:
        below = open_.where(F.col("turns") > F.col("from")).withColumn("step", F.lit(step))
        levels = below.select("conv_id", "n", "turns", depth.alias("depth"), "seq").withColumn("key", _key(F.col("seq"), F.col("depth")))
        weighed = levels.groupBy("key", "depth").agg(F.count("*").alias("k"), F.sum(F.col("turns") - F.col("depth") + 1).alias("w"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"))
        large = scratch.written(weighed.where((F.col("k") > 1) & (F.col("w") > container)).select("key", "depth", "conv_id", "n_convs"))
        if large.isEmpty():
            closed.append(open_.withColumn("at", F.when(F.col("turns") > F.col("from"), F.col("from") + 1)))
            break
        heads.append(large)
        passed = levels.select("conv_id", "key", "depth").join(large.select("key", "depth"), ["key", "depth"], "left_semi").groupBy(F.col("conv_id").alias("id")).agg(F.count("*").cast("int").alias("passed"))
        through = scratch.written(open_.join(passed, F.col("conv_id") == F.col("id"), "left").withColumn("reached", F.col("from") + F.coalesce("passed", F.lit(0))).drop("id", "passed"))
        on = (F.col("reached") == F.col("from") + step) & (F.col("turns") > F.col("reached"))
        closed.append(through.where(~on).withColumn("at", F.when(F.col("turns") > F.col("reached"), F.col("reached") + 1)))
        open_, step = through.where(on).withColumn("from", F.col("reached")), step * 2
    placed = closed[0].select("conv_id", "seq", "sizes", "n", "at")
    for x in closed[1:]:
        placed = placed.unionByName(x.select("conv_id", "seq", "sizes", "n", "at"))
    if not heads:
        return placed, None
    of = heads[0]
    for x in heads[1:]:
        of = of.unionByName(x)
    whole = distinct.select(F.col("conv_id").alias("id"), F.col("seq").alias("whole"), F.col("sizes").alias("s"))
    found = of.join(whole, F.col("conv_id") == F.col("id"))
    return placed, found.select("key", "depth", "conv_id", "n_convs", F.expr("substring(whole, 1, 16 * depth)").alias("seq"), F.element_at("s", F.col("depth")).alias("size"))


_NODES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
_NODE_TYPE = ", ".join(f"{c} long" for c in _NODES) + ", ends binary, under binary, top boolean"


def _common(a: bytes, b: bytes) -> int:
    """Whole turns that both begin with."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // 16
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(differ.argmax()) // 16


class _Sweep:
    """The nodes of one container whose strings come in order. Columns are arrays, so a very long sequence costs bytes, not objects."""

    def __init__(self, at: int, under: bytes):
        self.at, self.under, self.last = at, under, b""
        self.stack: list[int] = []
        self.depth, self.parent, self.conv, self.n, self.children, self.leaves, self.saved, self.size = (array("q") for _ in range(8))
        self.ends: dict[int, bytes] = {}

    def add(self, seq: bytes, sizes: list[int], n: int, conv: int) -> None:
        shared = max(0, _common(self.last, seq) - self.at + 1) if self.stack else 0
        self._leave(shared)
        for d in range(self.at + shared, len(seq) // 16 + 1):
            if self.stack:
                self.children[self.stack[-1]] += 1
            self.stack.append(len(self.depth))
            self.depth.append(d)
            self.parent.append(self.stack[-2] if len(self.stack) > 1 else -1)
            self.size.append(sizes[d - 1])
            for column, value in ((self.conv, conv), (self.n, 0), (self.children, 0), (self.leaves, 0), (self.saved, 0)):
                column.append(value)
        end = self.stack[-1]
        self.ends[end] = hashlib.md5(seq).digest()
        self.n[end] += n
        self.conv[end] = min(self.conv[end], conv)
        self.last = seq

    def _leave(self, keep: int) -> None:
        """Nodes below the first `keep` of the stack are complete: their sums go to their parents."""
        while len(self.stack) > keep:
            i = self.stack.pop()
            self.leaves[i] += self.children[i] == 0
            self.saved[i] += (self.n[i] - 1) * self.size[i]
            if self.stack:
                up = self.stack[-1]
                self.n[up] += self.n[i]
                self.leaves[up] += self.leaves[i]
                self.saved[up] += self.saved[i]
                self.conv[up] = min(self.conv[up], self.conv[i])

    def nodes(self) -> pa.RecordBatch:
        self._leave(0)
        conv, parent = np.array(self.conv, np.int64), np.array(self.parent, np.int64)
        n, top = len(conv), parent < 0
        columns = [pa.array(conv), pa.array(np.array(self.depth, np.int64)), pa.array(conv[parent], mask=top)] + [pa.array(np.array(x, np.int64)) for x in (self.n, self.children, self.leaves, self.saved)]
        ends = pa.array([self.ends.get(i) for i in range(n)], pa.binary())
        return pa.RecordBatch.from_arrays([*columns, ends, pa.array([self.under if x else None for x in top], pa.binary()), pa.array(top)], [*_NODES, "ends", "under", "top"])


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: bytes | None = None
    sweep: _Sweep | None = None
    done: list[pa.RecordBatch] = []
    waiting = 0
    for batch in batches:
        for key, at, under, seq, sizes, n, conv in zip(*(batch.column(c) for c in ("key", "at", "under", "seq", "sizes", "n", "conv_id")), strict=True):
            if sweep is None or key.as_py() != now:
                if sweep is not None:
                    done.append(sweep.nodes())
                    waiting += done[-1].num_rows
                    if waiting > 10_000:  # many small containers leave as one batch
                        yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
                        done, waiting = [], 0
                now, sweep = key.as_py(), _Sweep(at.as_py(), under.as_py())
            sweep.add(seq.as_py(), sizes.as_py(), n.as_py(), conv.as_py())
    if sweep is not None:
        done.append(sweep.nodes())
        yield from pa.Table.from_batches(done).to_batches()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (ends, conv_id) to (ends, first id, joined ids) of CHUNK ids at most, in each partition."""
    now, ids = None, []

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["ends", "first", "ids"])

    for batch in batches:
        out = []
        for ends, conv in zip(batch.column("ends").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if ids and (ends != now or len(ids) == CHUNK):
                out.append(flush())
                ids = []
            now = ends
            ids.append(conv)
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    if ids:
        yield flush()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order to (ends, sha256)."""
    now, digest = None, None
    for batch in batches:
        out = []
        for ends, ids in zip(batch.column("ends").to_pylist(), batch.column("ids"), strict=True):
            if digest is None or ends != now:
                if digest is not None:
                    out.append((now, digest.hexdigest()))
                now, digest = ends, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.as_py().encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["ends", "ends_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], ["ends", "ends_sha256"])


def end_digests(convs: DataFrame) -> DataFrame:
    """(conv_id, seq) to ends (md5 of the sequence) and the digest of the ids that have it."""
    ends = convs.select(F.unhex(F.md5("seq")).alias("ends"), "conv_id")
    chunks = ends.repartitionByRange("ends", "conv_id").sortWithinPartitions("ends", "conv_id").mapInArrow(_chunks, "ends binary, first long, ids string")
    return chunks.repartition("ends").sortWithinPartitions("ends", "first").mapInArrow(_digests, "ends binary, ends_sha256 string")


def _totals(heads: DataFrame, scratch: Scratch) -> DataFrame:
    """heads with n_leaves and saved summed over the heads in their subtree, themselves included; heads know their ancestors by their sequence."""
    deepest, reach = heads.agg(F.max("depth")).first()[0] or 0, 1
    now = heads
    while reach <= deepest:
        up = now.where(F.col("depth") >= reach).groupBy(_key(F.col("seq"), F.col("depth") - reach).alias("up")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        met = now.join(up, F.col("key") == F.col("up"), "left")
        before, now = now, scratch.written(met.withColumns({"n_leaves": F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0))}).select(*heads.columns))
        scratch.drop(before)
        reach *= 2
    return now


def prefix_trie(convs: DataFrame, container: int = CONTAINER) -> DataFrame:
    """(conv_id, seq, sizes) to the nodes of their trie: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    scratch = Scratch(convs.sparkSession)
    convs = scratch.written(convs)
    distinct = scratch.written(convs.groupBy("seq", "sizes").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")))
    placed, heads = _burst(distinct, container, scratch)
    at = F.col("at")
    dealt = placed.where(at.isNotNull()).select(_key(F.col("seq"), at).alias("key"), "at", _key(F.col("seq"), at - 1).alias("under"), "seq", "sizes", "n", "conv_id")
    nodes = scratch.written(dealt.repartition("key").sortWithinPartitions("key", "seq").mapInArrow(_swept, _NODE_TYPE))
    of_all = distinct.agg(F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs is not null")
    root = of_all.select(F.unhex(F.md5(F.lit(b""))).alias("key"), F.lit(0).alias("depth"), "conv_id", "n_convs", F.lit(b"").alias("seq"), F.lit(0).alias("size"))
    heads = root if heads is None else root.unionByName(heads)
    tops = nodes.where("top").groupBy("under").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
    of_heads = heads.where("depth > 0").groupBy(_key(F.col("seq"), F.col("depth") - 1).alias("up")).agg(F.count("*").alias("k"))
    met = heads.join(tops, F.col("key") == F.col("under"), "left").join(of_heads, F.col("key") == F.col("up"), "left")
    own = scratch.written(
        met.select(
            *heads.columns,
            (F.coalesce("n_children", F.lit(0)) + F.coalesce("k", F.lit(0))).alias("n_children"),
            (F.coalesce("n_leaves", F.lit(0)) + F.when(F.coalesce("n_children", "k").isNull(), 1).otherwise(0)).alias("n_leaves"),
            (F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("size")).alias("saved"),
        )
    )
    summed = _totals(own, scratch)
    parents = summed.select(F.col("key").alias("parent"), F.col("conv_id").alias("of_parent"))
    head_nodes = summed.withColumn("up", F.when(F.col("depth") > 0, _key(F.col("seq"), F.col("depth") - 1))).join(parents, F.col("up") == F.col("parent"), "left")
    head_rows = head_nodes.select("conv_id", "depth", F.col("of_parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("key").alias("ends"))
    # most tops hang under the root, whose conv_id is one number; the others join their heads
    first = summed.where("depth = 0").first()
    below = nodes.where("not top").select(*_NODES, "ends")
    at_root = nodes.where("top and depth = 1").withColumn("parent_conv_id", F.lit(first["conv_id"] if first else None).cast("long")).select(*_NODES, "ends")
    deeper = nodes.where("top and depth > 1").drop("parent_conv_id").join(parents, F.col("under") == F.col("parent")).select("conv_id", "depth", F.col("of_parent").alias("parent_conv_id"), *_NODES[3:], "ends")
    every = head_rows.unionByName(at_root).unionByName(deeper).unionByName(below)
    digests = end_digests(convs).select(F.col("ends").alias("of"), "ends_sha256")
    return every.join(digests, F.col("ends") == F.col("of"), "left").select(*[F.col(c).cast("long").alias(c) for c in _NODES], F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(sequences(table(spark, sf_dir, "conversations"))))


OP13_SQL = f"""
with t as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as pos,
         length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') as id, strlen(coalesce(text, '')) as size
  from conversations where conv_id is not null),
c as materialized (
  select conv_id, conv_id - conv_id % {SHARED} as base,
         xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda a, x:
           list_reduce(list_prepend(xor(a, x), range(8)), lambda s, i: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295) % {HEADS} as h
  from (select distinct conv_id from t)),
m as (select c.conv_id, c.h, count(t.pos) as m from c left join t on t.conv_id = c.base and t.pos < c.h group by 1, 2),
r as materialized (
  select c.conv_id, t.pos, t.id, t.size from c join t on t.conv_id = c.base and t.pos < c.h
  union all
  select t.conv_id, m.m + t.pos - m.h, t.id, t.size from t join m on t.conv_id = m.conv_id and t.pos >= m.h),
p as materialized (
  select conv_id, pos + 1 as depth, size, list(id) over (partition by conv_id order by pos) as path from r
  union all
  select conv_id, 0, 0, [] from c),
n as materialized (select depth, path, any_value(size) as size, min(conv_id) as conv_id, count(*) as n_convs, list(distinct conv_id) as members from p group by depth, path),
on_path as (select p.conv_id as of, p.depth, n.conv_id from p join n on p.depth = n.depth and p.path = n.path),
parents as (select n.conv_id, n.depth, o.conv_id as parent_conv_id from n left join on_path o on o.of = n.conv_id and o.depth = n.depth - 1),
kids as (select parent_conv_id as conv_id, depth - 1 as depth, count(*) as n_children from parents where depth > 0 group by 1, 2),
own as (select n.conv_id, n.depth, (n.n_convs - 1) * n.size as saved, case when k.n_children is null then 1 else 0 end as leaf from n left join kids k on n.conv_id = k.conv_id and n.depth = k.depth),
subtree as (
  select a.conv_id, a.depth, sum(own.leaf) as n_leaves, sum(own.saved) as saved_tokens
  from own join on_path a on a.of = own.conv_id and a.depth <= own.depth group by 1, 2),
last as (select conv_id, max(depth) as depth from p group by conv_id),
ends as (
  select o.conv_id, o.depth, string_agg(l.conv_id::varchar, ',' order by l.conv_id) as ids
  from last l join on_path o on o.of = l.conv_id and o.depth = l.depth group by 1, 2)
select n.conv_id, n.depth::bigint as depth, parents.parent_conv_id, n.n_convs::bigint as n_convs, coalesce(k.n_children, 0)::bigint as n_children,
       s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from n join parents using (conv_id, depth) join subtree s using (conv_id, depth) left join kids k using (conv_id, depth) left join ends e using (conv_id, depth)
"""
