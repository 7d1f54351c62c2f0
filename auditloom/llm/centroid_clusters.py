"""Operator 11: k-means whose bounds are loosened by geometry, not by whole drifts.

Vectors are turned into whole numbers, so distances, sums and centroids are exact. A row keeps its cluster, the squared
distance to its centroid and a lower bound of the distance to any other centroid. When centroids move, a bound needn't
give up the whole drift D of a centroid that went from a to b: all vectors of cluster i lie in the sphere around its old
centroid whose radius is its largest distance, and what an x of that sphere can lose, |x - a| - |x - b|, is told in the
plane through a, b and the sphere's centre. With o midway between a and b and t the angle at o between b - a and x - o,

    |x - a| - |x - b| = 2 |x - o| D cos(t) / (|x - a| + |x - b|),   2 |x - o| <= |x - a| + |x - b| <= 2 |x - o| + D,

so the loss is D cos(t) at most; the sphere, seen from o, covers the angles from t0 - asin(r / |o - centre|) on. Where that
is more than a right angle the loss is negative and the bound even grows. A row whose exact distance to its own centroid
stays under its bound keeps its cluster; only the others are compared with all centroids, exactly.

A round is one pass over a written table without a shuffle; each task sends one row of sums for a cluster. The driver holds
k centroids and a k by k matrix, nothing that grows with the rows.

Vectors that are null, not of dim components, or hold null or non-finite components take no part; nor do those with a
component beyond BOUND after scaling, whose squared distances needn't fit a long. Repeated rows each count. Rows with a
null id are assigned too; they start a centroid only where other rows are too few. Equal starts: the smaller vector first.
Fewer rows than k start as many centroids; no rows give no rows. Equal distances go to the smaller centroid, so of
two equal centroids the second stays empty. A sum of distances beyond a long is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices, table

K, ROUNDS, SCALE, DIM, SALT = 16, 3, 64, 64, "1"
#: Largest component after scaling: 64 * (2 * 2**27)**2 fits a long.
BOUND = 1 << 27
#: What rounding of roots may take from a bound, as a share.
SLACK = 1e-9
#: Rows that are compared with all centroids at once.
STEP = 4096

_STATE = "vec_id long, v array<int>, cluster int, distance long, lower double, scanned boolean"


class Clusters(NamedTuple):
    """rows: vec_id, cluster, distance (squared), scanned (whether its last round compared it with all centroids)."""

    rows: DataFrame
    centroids: list[list[int]]


def whole_vectors(df: DataFrame, vec_id: str, embedding: str, scale: int, dim: int) -> DataFrame:
    """vec_id and v, the components' floor(scale * x), of the vectors that take part."""
    e = F.col(embedding)
    scaled: Callable[[Column], Column] = lambda x: F.floor(x.cast("double") * F.lit(float(scale)))
    fits = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * F.lit(float(scale))) < BOUND))
    kept = df.where(F.coalesce((F.size(e) == dim) & fits, F.lit(False)))
    return kept.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(e, lambda x: scaled(x).cast("int")).alias("v"))


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (rows x centroids), exact: by doubles where all terms are below 2**53, else by longs."""
    top = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.float64 if 4 * vectors.shape[1] * top**2 < 1 << 53 else np.int64
    x, c = vectors.astype(kind), centroids.astype(kind)
    return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)


def losses(old: np.ndarray, new: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """[i, j]: what the distance from a vector of cluster i (within radii[i] of old[i]) to centroid j can lose by its move from old[j] to new[j]."""
    old, new = old.astype(np.float64), new.astype(np.float64)
    drift = np.linalg.norm(new - old, axis=1)
    off = old[:, None, :] - ((old + new) / 2)[None, :, :]
    away = np.linalg.norm(off, axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        angle = np.arccos(np.clip(np.einsum("ijd,jd->ij", off, new - old) / (away * drift), -1, 1))
        nearest = np.cos(np.maximum(0, angle - np.arcsin(np.clip(radii[:, None] / away, 0, 1))))
        clear = np.maximum(0, away - radii[:, None])
        behind = 2 * clear / (2 * clear + drift)
    found = drift * np.where(nearest < 0, nearest * behind, nearest)
    whole = (drift == 0) | (away <= radii[:, None]) | ~np.isfinite(found)
    return np.where(whole, drift, found)


def _assigned(centroids: np.ndarray, loosened: np.ndarray | None, apart: np.ndarray):
    """A pass: rows with a bound are compared with all centroids only where the bound doesn't decide. apart: of each centroid, the distance to the nearest other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            v = batch.column("v").flatten().to_numpy().reshape(n, -1).astype(np.int64)
            cluster, distance, lower, open_ = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n), np.ones(n, bool)
            if loosened is not None:
                cluster = batch.column("cluster").to_numpy().copy()
                own = v - centroids[cluster]
                distance = (own * own).sum(1)
                root = np.sqrt(distance.astype(np.float64))
                lower = np.maximum(batch.column("lower").to_numpy() - loosened[cluster], apart[cluster] - root) * (1 - SLACK) - SLACK
                open_ = ~(root * (1 + SLACK) < lower)
            at = np.flatnonzero(open_)
            for part in slices(len(at), STEP):
                rows = at[part]
                found = distances(v[rows], centroids)
                cluster[rows] = found.argmin(1)
                distance[rows] = found.min(1)
                lower[rows] = np.sqrt(np.partition(found, 1, axis=1)[:, 1].astype(np.float64)) * (1 - SLACK) if len(centroids) > 1 else np.inf
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cluster, pa.int32()), pa.array(distance), pa.array(lower), pa.array(open_)], ["vec_id", "v", "cluster", "distance", "lower", "scanned"])

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each cluster of the partition: its rows, its componentwise sums, its largest distance."""
    found: dict[int, list] = {}
    for batch in batches:
        v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.int64)
        cluster, distance = batch.column("cluster").to_numpy(), batch.column("distance").to_numpy()
        for c in np.unique(cluster).tolist():
            own = cluster == c
            x = found.setdefault(c, [0, 0, 0])
            found[c] = [x[0] + int(own.sum()), x[1] + v[own].sum(0), max(x[2], int(distance[own].max()))]
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(found), pa.int32()), pa.array([x[0] for x in found.values()], pa.int64()), pa.array([x[1].tolist() for x in found.values()], pa.list_(pa.int64())), pa.array([x[2] for x in found.values()], pa.int64())],
        ["cluster", "n", "sums", "far"],
    )


def _moved(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centroids' next places, and the radii of the clusters around their present ones."""
    parts = state.mapInArrow(_sums, "cluster int, n long, sums array<long>, far long")
    of_clusters = {r.cluster: r for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("far").alias("far")).collect()}
    sums = parts.select("cluster", F.posexplode("sums").alias("pos", "x")).groupBy("cluster", "pos").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    new, radii = centroids.copy(), np.zeros(len(centroids))
    for c, r in of_clusters.items():
        radii[c] = np.sqrt(float(r.far)) * (1 + SLACK)
    for r in sums:
        new[r.cluster, r.pos] = int(r.x) // of_clusters[r.cluster].n
    return new, radii


def centroid_clusters(df: DataFrame, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, dim: int = DIM, salt: str = SALT, vec_id: str = "vec_id", embedding: str = "embedding") -> Clusters:
    """k-means over floor(scale * x): starts are the k vectors with the smallest sha256 of `salt:vec_id`; each round assigns, then moves centroids to the floor of their means; then rows are assigned once more."""
    scratch = Scratch(df.sparkSession)
    vectors = whole_vectors(df, vec_id, embedding, scale, dim)
    by_hash = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    starts = vectors.orderBy(by_hash, "v").limit(k).collect()
    if not starts:
        return Clusters(df.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, scanned boolean"), [])
    now, loosened, state = np.array([r.v for r in starts], np.int64), None, vectors
    for round_ in range(rounds + 1):
        between = np.sqrt(distances(now, now).astype(np.float64))
        np.fill_diagonal(between, np.inf)
        before, state = state, scratch.written(state.mapInArrow(_assigned(now, loosened, between.min(1)), _STATE))
        scratch.drop(before)
        if round_ < rounds:
            new, radii = _moved(state, now)
            lost = losses(now, new, radii)
            np.fill_diagonal(lost, -np.inf)
            loosened, now = lost.max(1) if len(now) > 1 else np.zeros(1), new
    return Clusters(state.select("vec_id", "cluster", "distance", "scanned"), now.tolist())


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = centroid_clusters(table(spark, sf_dir, "embeddings"))
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = {r.cluster: r.x for r in rows.groupBy("cluster").agg(total.alias("x")).collect()}
    as_long = lambda x: int(x) if x < 1 << 63 else None
    of_clusters = [(c, as_long(x), as_long(sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, x in sorted(inertia.items())]
    names = spark.createDataFrame(of_clusters, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # a row for each of K clusters
    return rows.join(F.broadcast(names), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds_sql() -> str:
    out = []
    for i in range(ROUNDS + 1):
        out.append(f"""
a{i} as materialized (
  select r, any_value(vec_id) as vec_id, any_value(v) as v, min(struct_pack(d := d, c := c)) as b
  from (select v.*, c{i}.c, list_sum(list_transform(list_zip(v.v, c{i}.m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from v cross join c{i}) group by r)""")
        if i < ROUNDS:
            out.append(f"""
s{i} as (
  select c, list(cast((x - ((x % n) + n) % n) // n as bigint) order by pos) as m
  from (select b.c as c, pos, cast(sum(x) as hugeint) as x, count(*) as n from (select b, unnest(v) as x, unnest(range({DIM})) as pos from a{i}) group by 1, 2) group by c),
c{i + 1} as materialized (select c{i}.c, coalesce(s{i}.m, c{i}.m) as m from c{i} left join s{i} on c{i}.c = s{i}.c)""")
    return ",".join(out)


OP11_SQL = f"""
with k as (
  select vec_id, embedding from embeddings
  where len(embedding) = {DIM} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: abs(cast(x as double) * {SCALE}) >= {BOUND})) = 0),
v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * {SCALE}) as bigint)) as v from k),
c0 as materialized (
  select row_number() over (order by h nulls last, v) - 1 as c, v as m
  from (select sha256('{SALT}:' || vec_id) as h, v from v order by h nulls last, v limit {K})),{_rounds_sql()},
f as (select vec_id, b.c as c, b.d as d from a{ROUNDS})
select vec_id, cast(f.c as integer) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by f.c) as bigint) as cluster_inertia,
       cast(sum(d) over () as bigint) as inertia, sha256(list_aggregate(m, 'string_agg', ',')) as centroid_sha256
from f join c{ROUNDS} using (c)
"""
