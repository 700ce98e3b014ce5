"""Centroid clustering against whole numbers of any size."""

import hashlib
import random

import numpy as np

from tracewell.llm import clustering

R = random.Random(11)


def brute(rows, shape):
    """[(id, cluster, distance)], centroids: plain Python integers throughout."""
    usable = [(i, [int(np.floor(np.float64(e) * shape.scale)) for e in v]) for i, v in rows if v is not None and len(v) == shape.dims and all(e is not None and np.isfinite(e) for e in v)]
    first = sorted((hashlib.sha256(f"{shape.salt}:{i}".encode()).hexdigest(), v) for i, v in usable if i is not None)
    centroids = [v for _, v in first[: shape.k]]
    distances = lambda v: [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
    for _ in range(shape.rounds):
        own = [min(range(len(centroids)), key=lambda c, d=distances(v): (d[c], c)) for _, v in usable]
        groups = [[v for (_, v), c in zip(usable, own) if c == k] for k in range(len(centroids))]
        centroids = [[sum(col) // len(g) for col in zip(*g)] if g else old for g, old in zip(groups, centroids)]
    out = []
    for i, v in usable:
        d = distances(v)
        out.append((i, d.index(min(d)), min(d)))
    return out, centroids


def held_to_brute(spark, rows, shape, kind="double"):
    cut = lambda d: max(-(1 << 63), min((1 << 63) - 1, d))
    want, centroids = brute(rows, shape)
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, distance int, cluster string").repartition(3)
    got = clustering.clusters(df, shape).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got) == sorted((str(i), c, cut(d)) for i, c, d in want)
    each = {c: sum(d for _, k, d in want if k == c) for c in range(len(centroids))}
    assert all(r.cluster_inertia == cut(each[r.cluster]) and r.inertia == cut(sum(each.values())) for r in got)
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest() for r in got)
    return want


def test_clusters_equal_whole_numbers_at_every_magnitude(spark):
    shape = clustering.Shape(k=5, dims=4, scale=64.0)
    small = [(i, [R.uniform(-2, 2) for _ in range(4)]) for i in range(300)]
    copies = [(500 + i, small[0][1]) for i in range(200)]
    repeated = [small[1]] * 3
    held_to_brute(spark, small + copies + repeated, shape)
    mixed = [(i, [R.uniform(-1, 1) * 10.0 ** R.choice([0, 3, 7, 9, 12, 30]) for _ in range(4)]) for i in range(200)]
    held_to_brute(spark, mixed, shape)
    whole = [(i, [float(R.randrange(-3, 3)) for _ in range(4)]) for i in range(200)]  # many ties
    held_to_brute(spark, whole, clustering.Shape(k=7, dims=4, scale=1.0, rounds=2))


def test_odd_rows_and_small_tables(spark):
    shape = clustering.Shape(k=16, dims=3)
    good = [(i, [float(i), -0.5, 1.0 / (i + 1)]) for i in range(6)]
    odd = [(20, None), (21, []), (22, [1.0, 2.0]), (23, [1.0, None, 2.0]), (24, [float("nan"), 0.0, 0.0]), (25, [float("inf"), 0.0, 0.0]), (None, [0.5, 0.5, 0.5])]
    assert len(held_to_brute(spark, good + odd, shape, "float")) == 7
    empty = clustering.clusters(spark.createDataFrame([], "vec_id long, embedding array<float>"), shape)
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert clustering.clusters(spark.createDataFrame(odd[:6], "vec_id long, embedding array<double>"), shape).count() == 0


def test_each_tier_of_magnitudes_is_exact():
    centroids = [[0] * 64, [3] * 64, [-(10**9)] * 64]
    for size in (1.0, 2.0**20, 2.0**22, 2.0**24, 2.0**27, 2.0**29, 2.0**60, 2.0**200):
        v = np.floor(np.array([[R.uniform(-1, 1) * size for _ in range(64)] for _ in range(5)]))
        for some in (centroids[:2], centroids):
            at, d = clustering.nearest(v, some)
            for row, a, e in zip(v.tolist(), at.tolist(), list(d)):
                own = [sum((int(x) - y) ** 2 for x, y in zip(row, c)) for c in some]
                assert (own.index(min(own)), min(own)) == (a, int(e))
