"""Clusters against plain rounds in whole numbers, bounds against their definition, and the query against its SQL."""

import hashlib
import math

import numpy as np
import pytest
from check_oracles import compare, connect
from conftest import SMALL

from whisperlake.llm import clustering
from whisperlake.session import work_dir


def plain(rows, size, k, rounds, salt="2:"):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    names = sorted((i is None, hashlib.sha256(f"{salt}{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept)
    c = [v for _, _, v in names[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))

    for _ in range(rounds):
        by = [[] for _ in c]
        for _, v in kept:
            by[nearest(v)[1]].append(v)
        c = [[sum(x) // len(b) for x in zip(*b)] if b else old for b, old in zip(by, c)]
    out = [(i, nearest(v)) for i, v in kept]
    sums = [sum(d for _, (d, j) in out if j == x) for x in range(len(c))]
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return [(i, j, d, sums[j], sum(sums), digest[j]) for i, (d, j) in out]


def frame(spark, rows):
    path = work_dir(spark, "vectors")
    spark.createDataFrame([(i, v, 3, 1.0, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, upper double, v string").repartition(
        3).write.parquet(path)
    return spark.read.parquet(path)


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("size,k,rounds", [(4, 6, 5), (2, 9, 3), (3, 1, 2), (3, 500, 2)])
def test_clusters_equal_plain_rounds(spark, size, k, rounds):
    rng = np.random.default_rng(size)
    rows = []
    for i in range(300):
        centre = rng.integers(-3, 4, size)
        rows.append((i, (centre + rng.normal(0, 0.2, size)).astype(np.float32).tolist()))
    # Copies, ties half-way, ids that are null or repeated, unusable vectors, far ones.
    rows += [(1000 + i, [1.0] * size) for i in range(200)] + [(2000 + i, [float(i % 3)] + [0.5] * (size - 1)) for i in range(60)]
    rows += [(None, [0.25] * size), (7, [2.0] * size), (7, [2.0] * size), (8, [-20000.5] * size), (9, [100000.25] * size)]
    rows += [(3000, None), (3001, []), (3002, [1.0] * (size + 1)), (3003, [None] + [1.0] * (size - 1)), (3004, [float("nan")] * size),
             (3005, [float("-inf")] + [0.0] * (size - 1))]
    got = clustering.clusters(frame(spark, rows), size=size, k=k, rounds=rounds)
    assert order(got.collect()) == order(plain(rows, size, k, rounds))


def test_nothing_usable_and_held_components(spark):
    assert clustering.clusters(frame(spark, [(1, None), (2, [1.0])]), size=3).collect() == []
    assert clustering.clusters(frame(spark, []), size=3).collect() == []
    far = clustering.clusters(frame(spark, [(1, [3e38, 0.0]), (2, [0.0, 0.0])]), size=2, k=1, rounds=1).collect()
    assert sorted(r.distance for r in far) == [(clustering.LARGEST // 2) ** 2] * 2


def test_gain_bounds_what_a_move_can_bring():
    rng = np.random.default_rng(4)
    below = 0
    for _ in range(300):
        size = int(rng.integers(2, 6))
        centre, old = rng.normal(0, 3, (1, size)), rng.normal(0, 3, (5, size))
        new = old + rng.normal(0, 1, (5, size)) * rng.choice([0, 0.1, 1], (5, 1))
        radius = np.array([rng.choice([0, 0.5, 2, 6])])
        x = rng.normal(0, 1, (200, size))
        x = centre + x / np.linalg.norm(x, axis=1)[:, None] * radius * rng.random((200, 1)) ** (1 / size)
        real = np.linalg.norm(x[:, None] - old, axis=2) - np.linalg.norm(x[:, None] - new, axis=2)
        bound = clustering.gain(centre, radius, old, new)[0]
        assert (real.max(0) <= bound + 1e-9).all()
        below += int((bound < 0.7 * np.linalg.norm(new - old, axis=1)).sum())
    assert below > 300  # much less than the full drift for many moves


def test_bounds_save_comparisons():
    rng = np.random.default_rng(6)
    v = (rng.integers(-3, 4, (40, 8)) * 2000)[rng.integers(0, 40, 5000)] + rng.integers(-300, 300, (5000, 8))
    c = v[:40].copy()
    cluster, upper, lower = clustering.assigned(v, c)
    scanned = []
    for _ in range(5):
        new = np.array([v[cluster == j].sum(0) // max(1, (cluster == j).sum()) if (cluster == j).any() else c[j] for j in range(40)])
        radius = np.array([upper[cluster == j].max(initial=0) for j in range(40)])
        m = clustering.moved(c, new, radius)
        cluster, upper, lower, n = clustering.reassigned(v, cluster, upper, lower, m)
        c = new
        scanned.append(n)
        assert (cluster == clustering.squared(v, c).argmin(1)).all()
        exact = np.sqrt(clustering.squared(v, c).astype(float))
        assert (upper >= exact[np.arange(5000), cluster] - 1e-6).all()
        exact[np.arange(5000), cluster] = np.inf
        assert (lower <= exact.min(1) + 1e-6).all()
    assert scanned[-1] < 1500


def test_query_equals_sql(spark):
    ok, note = compare(spark, connect(SMALL), SMALL, "op12_centroid_clusters")
    assert ok, note
