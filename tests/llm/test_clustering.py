"""Ball k-means against plain k-means in integers."""

import hashlib
import math

import numpy as np
import pytest

pytest.importorskip("cantus.llm")

from cantus.llm import clustering  # noqa: E402

SCHEMA = "vec_id bigint, embedding array<double>, id string, cluster string, v string"


def plain_kmeans(rows, k, rounds, dims, scale=64):
    kept = [(i, tuple(math.floor(scale * x) for x in e)) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) and abs(x) <= clustering.LARGEST / scale for x in e)]
    digest = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    squared = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((squared(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        centroids = [tuple(sum(x) // len(x) for x in zip(*members[j])) if j in members else c for j, c in enumerate(centroids)]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {}
    for _, j, d in out:
        inertia[j] = inertia.get(j, 0) + d
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, j, d in out), key=str)


def rows_of(seed, n, dims, spread):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(5, dims))
    rows = [(int(i), (middles[i % 5] + spread * rng.normal(size=dims)).tolist()) for i in range(n)]
    rows += [rows[3]] * 40 + [(rows[4][0], rows[5][1]), (None, rows[6][1]), (n + 1, None), (n + 2, [math.nan] * dims), (n + 3, [math.inf] + [0.0] * (dims - 1)), (n + 4, [None] + [0.0] * (dims - 1)), (n + 5, [0.0] * (dims + 1)), (n + 6, []), (n + 7, [1e300] + [0.0] * (dims - 1)), (n + 8, [2097152.0, -2097152.0] + [0.0] * (dims - 2))]
    return rows


@pytest.mark.parametrize("seed, n, dims, k, rounds, spread", [(1, 200, 8, 7, 3, 0.3), (2, 150, 2, 16, 3, 1.0), (3, 60, 3, 4, 0, 0.1), (4, 9, 4, 100, 2, 0.2)])
def test_ball_kmeans(spark, seed, n, dims, k, rounds, spread):
    rows = rows_of(seed, n, dims, spread)
    frame = spark.createDataFrame([(i, e, "x", "y", "z") for i, e in rows], SCHEMA)
    got = clustering.ball_kmeans(frame, k, rounds, dims)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_kmeans(rows, k, rounds, dims)


def test_ties_and_equal_vectors(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(30)]
    got = clustering.ball_kmeans(spark.createDataFrame([(i, e, "", "", "") for i, e in rows], SCHEMA), 6, 3, 2)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_kmeans(rows, 6, 3, 2)


def test_empty(spark):
    for rows in ([], [(1, None, "", "", "")]):
        assert clustering.ball_kmeans(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_balls_spare_comparisons_and_stay_exact():
    rng = np.random.default_rng(5)
    centroids = rng.integers(-1000, 1000, (20, 6))
    vectors = np.concatenate([c + rng.integers(-60, 60, (300, 6)) for c in centroids])
    own = np.repeat(np.arange(20), 300).astype(np.int32)
    own[::17] = rng.integers(0, 20, len(own[::17]))  # some members of far clusters
    got, distance, computed = clustering.ball_assign(vectors, own, centroids)
    every = ((vectors[:, None, :] - centroids[None]) ** 2).sum(2)
    assert np.array_equal(got, every.argmin(1)) and np.array_equal(distance, every.min(1))
    assert computed < every.size / 3
