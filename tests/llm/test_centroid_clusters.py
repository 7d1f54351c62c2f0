"""Operator 11 against SQL and plain k-means, and its bounds against points of the spheres."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import centroid_clusters

SF = "/root/testdata/sf0.001"


def test_losses_bound_every_point_of_a_sphere():
    rng, less = np.random.default_rng(5), 0
    for _ in range(150):
        k, d = 5, 4
        old = rng.normal(size=(k, d)) * 4
        new = old + rng.normal(size=(k, d)) * rng.choice([0, 0.01, 0.5, 3])
        radii = rng.random(k) * rng.choice([0, 0.5, 4])
        found, drift = centroid_clusters.losses(old, new, radii), np.linalg.norm(new - old, axis=1)
        assert (found <= drift + 1e-12).all()
        less += int((found < 0.9 * drift).sum())
        for i in range(k):
            x = rng.normal(size=(200, d))
            x = old[i] + x / np.linalg.norm(x, axis=1)[:, None] * radii[i] * rng.choice([1, 0.7, 0.1], size=(200, 1))
            lost = np.linalg.norm(x[:, None] - old, axis=2) - np.linalg.norm(x[:, None] - new, axis=2)
            assert (lost.max(0) <= found[i] + 1e-9).all()
    assert less > 500


def test_query_equals_sql(spark):
    found = centroid_clusters.op11_centroid_clusters(spark, SF)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    cursor = con.execute(centroid_clusters.OP11_SQL)
    names = [d[0] for d in cursor.description]
    assert found.columns == names
    assert sorted(map(tuple, found.collect())) == sorted(cursor.fetchall())


def _plain(rows, k, rounds, scale, salt):
    """(vec_id, vector) to assignments and centroids, by comparing everything with everything."""
    vs = [(i, [math.floor(scale * x) for x in v]) for i, v in rows]
    order = sorted(vs, key=lambda r: (r[0] is None, hashlib.sha256(f"{salt}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cs = [list(v) for _, v in order[:k]]
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cs)) for _, v in vs]
    for _ in range(rounds):
        of = [j for _, j in assign()]
        for j in set(of):
            own = [v for (_, v), a in zip(vs, of, strict=True) if a == j]
            cs[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted((i if i is not None else -1, j, d) for (i, _), (d, j) in zip(vs, assign(), strict=True)), cs


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_bounds_change_no_result_and_spare_scans(spark, spread):
    rng = random.Random(7)
    centres = [[rng.uniform(-5, 5) for _ in range(3)] for _ in range(8)]
    rows = [(i, [x + rng.gauss(0, spread) for x in rng.choice(centres)]) for i in range(400)]
    rows += [rows[0], rows[1], (None, [0.0, 0.0, 0.0])]
    found = centroid_clusters.centroid_clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=6, rounds=4, scale=10, dim=3)
    want, centroids = _plain(rows, 6, 4, 10, "1")
    got = found.rows.collect()
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.cluster, r.distance) for r in got) == want and found.centroids == centroids
    if spread == 0.05:
        assert sum(r.scanned for r in got) < len(rows) / 2


def test_odd_vectors(spark):
    ok = [1.0, -0.51]
    rows = [(1, ok), (2, ok), (3, None), (4, []), (5, [1.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 0.0]), (9, [1e30, 0.0]), (None, ok)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("v", "cluster", "distance", "lower", "label")})
    found = centroid_clusters.centroid_clusters(df, k=4, dim=2)
    assert sorted((r.vec_id or 0, r.cluster, r.distance) for r in found.rows.collect()) == [(0, 0, 0), (1, 0, 0), (2, 0, 0)]
    assert found.centroids == [[64, -33]] * 3
    assert centroid_clusters.centroid_clusters(df.limit(0), dim=2).rows.collect() == []
    big = [[1, 2], [centroid_clusters.BOUND - 1, 1 - centroid_clusters.BOUND]]
    want = [[sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for y in big] for x in big]
    assert centroid_clusters.distances(np.array(big), np.array(big)).tolist() == want


def test_query_on_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/embeddings.parquet").limit(0).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert centroid_clusters.op11_centroid_clusters(spark, str(tmp_path)).collect() == []
