"""Operator 9: nearest neighbours by randomly rotated one-bit codes.

A vector is turned by a fixed random rotation and keeps the signs of its components, packed into bytes, with three
scalars: its norm, the inner product of its direction with its code's, and its id. For a query, turned alike and
rounded at random to BITS-bit integers, bit operations give the inner product with a code; divided by the second scalar
it is an unbiased estimate of the inner product of the directions. Its error exceeds SPREAD standard errors with a
probability that falls exponentially in SPREAD; the rounding of the query adds its own term. Every candidate whose upper
bound reaches the k-th best lower bound is reranked by its exact inner product, in double precision, so the codes decide
only what needn't be computed. Of these, a product of matrices tells which can't be among the best whatever rounding adds;
the others' products are summed in order.

Queries and candidates meet in cells of a block of queries and a block of candidates, both of bounded size, so a task
holds two blocks however large the table is; each cell passes on its k best of a query. All candidates are indexed.

Vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors of different lengths
aren't compared. Equal scores go to the smaller id. Rows that share an id each count; no row with the query's own id
is its candidate. Null ids take no part.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, table

SEED = 20_077
BITS = 6
SPREAD = 3.0
#: Sizes of the blocks of a cell.
QUERIES, CANDIDATES = 1024, 4096
#: Pairs whose products are summed in order at once, which bounds memory where many vectors are equal.
SUMMED = 1 << 14
#: Tables are cut into so many blocks at least, which keeps all cores busy.
LEAST_BLOCKS = 6


@functools.lru_cache(8)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _turned(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions in the turned space, and norms."""
    norms = np.linalg.norm(vectors, axis=1)
    return (vectors / norms[:, None]) @ rotation(vectors.shape[1]), norms


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs (rows x words of 64 bits), norms, and inner products of the directions with their codes'."""
    turned, norms = _turned(vectors)
    signs = turned > 0
    agree = np.abs(turned).sum(1) / np.sqrt(vectors.shape[1])
    packed = np.packbits(signs, axis=1)
    packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))
    return np.ascontiguousarray(packed).view(np.uint64), norms, agree


def estimates(queries: np.ndarray, codes: np.ndarray, norms: np.ndarray, agree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries x codes), and how far the true ones may be off."""
    dim = queries.shape[1]
    turned, query_norms = _turned(queries)
    low = turned.min(1, keepdims=True)
    step = np.maximum(turned.max(1, keepdims=True) - low, 1e-12) / (2**BITS - 1)
    levels = np.minimum(np.floor((turned - low) / step + np.random.default_rng(SEED).random(turned.shape)), 2**BITS - 1).astype(np.uint8)
    met = np.zeros((len(queries), len(codes)), np.int32)
    for bit in range(BITS):
        plane = np.packbits(levels >> bit & 1, axis=1)
        plane = np.ascontiguousarray(np.pad(plane, ((0, 0), (0, -plane.shape[1] % 8)))).view(np.uint64)
        for word in range(codes.shape[1]):
            met += np.left_shift(np.bitwise_count(plane[:, word, None] & codes[None, :, word]), bit, dtype=np.int32)
    ones = np.bitwise_count(codes).sum(1)
    # <code, query> with code components +-1/sqrt(dim) and query components low + step * level
    with_code = (2 * (low * ones + step * met) - (low * dim + step * levels.sum(1, keepdims=True))) / np.sqrt(dim)
    off = SPREAD * (np.sqrt(np.maximum(0.0, 1 - agree**2)) / np.sqrt(max(1, dim - 1)) + step / 2) / agree
    scale = query_norms[:, None] * norms
    return with_code / agree * scale, off * scale


def _within(queries: np.ndarray, vectors: np.ndarray, near: np.ndarray, k: int) -> np.ndarray:
    """Those of the near pairs that may be among the k best of a query, by products in any order of summation and what rounding may add to them.

    Sums of n products in two orders differ by 2 n u |q| |v| at most, u being 2**-53, and a few terms of second order."""
    dim = queries.shape[1]
    with np.errstate(all="ignore"):
        got = queries @ vectors.T
        slack = (4 * (dim + 4) * np.finfo(np.float64).eps) * np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(vectors, axis=1) + 4 * dim * np.finfo(np.float64).tiny
        sure = np.where(near, got - slack, -np.inf)
        sure[np.isnan(sure)] = -np.inf
        least = np.partition(sure, -k, axis=1)[:, -k] if len(vectors) > k else np.full(len(queries), -np.inf)
        return near & ~(got + slack < least[:, None])  # what overflows stays


def _cell(k: int):
    def search(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if rows.num_rows:
            asks = rows.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            ids = rows.column("vec_id").to_numpy()
            dim = len(rows.column("embedding")[0])
            values = rows.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            queries, query_ids = values[asks], ids[asks]
            vectors, vector_ids = values[~asks], ids[~asks]
            if len(queries) and len(vectors):
                codes, norms, agree = encode(vectors)
                for at in range(0, len(queries), 256):
                    part, part_ids = queries[at : at + 256], query_ids[at : at + 256]
                    guess, off = estimates(part, codes, norms, agree)
                    own = part_ids[:, None] == vector_ids
                    sure = np.where(own, -np.inf, guess - off)
                    least = np.partition(sure, -k, axis=1)[:, -k] if len(vectors) > k else np.full(len(part), -np.inf)
                    near = (guess + off >= least[:, None]) & ~own
                    rows_, found = np.nonzero(_within(part, vectors, near, k))
                    scores = np.empty(len(found))
                    for s in slices(len(found), SUMMED):  # summed in order
                        scores[s] = (vectors[found[s]] * part[rows_[s]]).cumsum(1)[:, -1]
                    order = np.lexsort((vector_ids[found], -scores, rows_))
                    rows_, found, scores = rows_[order], found[order], scores[order]
                    best = np.arange(len(rows_)) - np.searchsorted(rows_, rows_) < k
                    out["query_id"].append(part_ids[rows_[best]])
                    out["vec_id"].append(vector_ids[found[best]])
                    out["score"].append(scores[best])
        kinds = {"query_id": np.int64, "vec_id": np.int64, "score": np.float64}
        return pa.table({n: np.concatenate(x) if x else np.empty(0, kinds[n]) for n, x in out.items()})

    return search


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(df: DataFrame, asks: Column, k: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row for which asks holds."""
    vectors = df.where(usable(F.col(embedding)) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"), F.coalesce(asks, F.lit(False)).alias("asks"))
    sizes = vectors.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    of_queries, of_vectors = (max(LEAST_BLOCKS, -(-n // size)) for n, size in ((sizes["q"], QUERIES), (sizes["n"], CANDIDATES)))
    dealt = lambda salt, n: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n))
    one = vectors.withColumn("dim", F.size("embedding"))
    queries = one.where("asks").select("dim", dealt(1, of_queries).alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of_vectors - 1).cast("long"))).alias("vb"), "vec_id", "embedding", "asks")
    candidates = one.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of_queries - 1).cast("long"))).alias("qb"), dealt(2, of_vectors).alias("vb"), "vec_id", "embedding", F.lit(False).alias("asks"))
    cells = queries.unionByName(candidates).groupBy("dim", "qb", "vb").applyInArrow(_cell(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


OP9_SQL = """
with v as (
  select vec_id, cast(embedding as double[]) as e from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda a, b: a + b) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 20 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 20
"""
