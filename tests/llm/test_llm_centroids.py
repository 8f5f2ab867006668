"""Clustering with bounds against full scans."""

import hashlib
import random

import numpy as np
import pytest

from voxtally.llm.centroids import cluster_vectors

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k, rounds, dims, scale=1024, seed=3):
    kept = [
        (i, np.floor(np.array(v, np.float32).astype(float) * scale).astype(int).tolist())
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)
    ]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in first[:k]]
    for t in range(rounds + 1):
        found = []
        for _, v in kept:
            found.append(min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)))
        if t < rounds:
            for j in range(len(centroids)):
                own = [v for (_, v), (_, o) in zip(kept, found) if o == j]
                if own:
                    centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    total = sum(d for d, _ in found)
    sums = {j: sum(d for d, o in found if o == j) for _, j in found}
    return sorted(((i, j, d, sums[j], total, tuple(centroids[j])) for (i, _), (d, j) in zip(kept, found)), key=str)


def got(spark, rows, **kw):
    out = cluster_vectors(spark.createDataFrame(rows, SCHEMA).repartition(4), **kw).collect()
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in out), key=str)


def vectors(seed, n, dims, ties=False):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        middle = [r.choice([-2, 0, 3]) for _ in range(dims)]
        rows.append((i, [r.randint(-2, 2) / 1024 if ties else x + r.gauss(0, 1) for x in middle]))
    odd = [(9001, None), (9002, []), (9003, [1.0] * (dims + 1)), (9004, [float("nan")] * dims), (9005, [float("inf")] * dims), (9006, [None] * dims)]
    return [*rows, *odd, (None, [0.5] * dims), *rows[:3]]


@pytest.mark.parametrize("ties", [False, True])
def test_equals_full_scans(spark, ties):
    """Small whole numbers make many ties; copies, null ids and unusable vectors are among the rows."""
    rows = vectors(7, 300, 4, ties)
    kw = {"k": 5, "rounds": 6, "dims": 4}
    assert got(spark, rows, chunk_rows=50, **kw) == brute(rows, **kw)


def test_bounds_spare_measures_and_large_components_stay_exact(spark):
    r = random.Random(1)
    rows = [(i, [float(r.choice([0, 1 << 16]) + r.random()) for _ in range(3)]) for i in range(600)]
    measured = []
    kw = {"k": 8, "rounds": 8, "dims": 3}
    out = got(spark, rows, watch=lambda t, n: measured.append(n), **kw)
    assert out == brute(rows, **kw)
    assert measured[0] == 600 * 8 and measured[-1] < 600 * 4


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, -4.0])]
    assert got(spark, rows, k=8, dims=2, rounds=2) == brute(rows, 8, 2, 2)
    assert got(spark, [], dims=2) == got(spark, [(None, [1.0, 2.0])], dims=2) == []


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="leave no exact distance"):
        got(spark, [(1, [1e30, 0.0])], dims=2)


def test_other_columns_and_names(spark):
    rows = vectors(2, 40, 3)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "name long, v array<float>, cluster int, id string, x int")
    out = cluster_vectors(df, k=3, rounds=2, dims=3, id_col="name", vector_col="v").collect()
    assert sorted(((r.name, r.cluster) for r in out), key=str) == sorted(((x[0], x[1]) for x in brute(rows, 3, 2, 3)), key=str)
