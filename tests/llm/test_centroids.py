"""Clustering against plain rounds over all distances."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np

from seriesloom.llm.centroids import LONGEST, Bounds, _over, cluster, squared

SCHEMA = "vec_id long, embedding array<double>, cluster string, v string, part int"


def plain_rounds(rows, dim, k, rounds, salt="3"):
    kept = []
    for i, e in rows:
        if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e):
            v = [math.floor(1024 * x) for x in e]
            if sum(float(x) * float(x) for x in v) <= LONGEST**2:
                kept.append((i, v))
    starts = sorted((("~" if i is None else hashlib.sha256(f"{salt}:{i}".encode()).hexdigest()), v) for i, v in kept)
    centroids = [list(v) for _, v in starts[:k]]
    nearest = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for n in set(own):
            mine = [v for (_, v), a in zip(kept, own, strict=True) if a == n]
            centroids[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted(((i, *reversed(nearest(v))) for i, v in kept), key=repr), centroids


def check(spark, rows, dim, k, rounds):
    df = spark.createDataFrame([(i, e, "x", "y", 1) for i, e in rows], SCHEMA).repartition(3)
    out, centroids = cluster(df, dim, k, rounds)
    want, last = plain_rounds(rows, dim, k, rounds)
    assert centroids == last
    assert sorted((tuple(r) for r in out.collect()), key=repr) == want


def test_clusters_of_points(spark):
    r = random.Random(3)
    mid = [[r.gauss(0, 1) for _ in range(6)] for _ in range(9)]
    check(spark, [(i, [x + r.gauss(0, 0.2) for x in r.choice(mid)]) for i in range(1500)], 6, 17, 7)


def test_ties_repeated_rows_and_odd_values(spark):
    r = random.Random(4)
    rows = [(i, [float(r.choice([-1, 0, 1])) for _ in range(3)]) for i in range(200)]
    rows += rows[:50] + [(3, [0.5, 0.5, 0.5])] * 4 + [(None, [1.0, 1.0, 1.0]), (None, [0.0, -3.0, 2.0])]
    rows += [(900, None), (901, [1.0, None, 2.0]), (902, [math.nan, 0.0, 0.0]), (903, [1.0, 2.0]), (904, []), (905, [math.inf, 0.0, 0.0]), (906, [1e300, 0.0, 0.0])]
    rows += [(907, [2.0**19, 0.0, 1.0]), (908, [-(2.0**19), 0.0, 1.0])]
    check(spark, rows, 3, 5, 6)


def test_few_and_no_vectors(spark):
    check(spark, [(1, [0.25, 0.5]), (2, [0.25, 0.5])], 2, 8, 3)
    check(spark, [], 2, 8, 3)


def test_bounds_spare_distances_and_never_lie():
    r = np.random.default_rng(1)
    mid = r.integers(-5000, 5000, (24, 8))
    v = mid[r.integers(0, 24, 4000)] + r.integers(-300, 300, (4000, 8))
    centroids = mid + r.integers(-200, 200, mid.shape)
    b = Bounds.scanned(v, centroids, 6)
    needed = []
    for _ in range(6):
        new = np.stack([v[b.a == c].sum(axis=0) // max(1, int((b.a == c).sum())) if (b.a == c).any() else centroids[c] for c in range(24)])
        b.widened(_over(squared(new, centroids)))
        centroids = new
        true = np.stack([np.sqrt(squared(v, c)) for c in centroids], axis=1)
        rows = np.arange(len(v))
        assert (b.upper >= true[rows, b.a]).all() and (b.low <= np.take_along_axis(true, b.near.astype(int), 1)).all()
        others = np.ones_like(true, dtype=bool)
        others[rows[:, None], b.near] = False
        others[rows, b.a] = False
        assert (np.where(others, true, np.inf).min(axis=1) >= b.rest).all()
        needed.append(b.settle(v, centroids))
        assert (b.a == np.argmin(np.stack([squared(v, c) for c in centroids], axis=1), axis=1)).all()
    assert needed[-1] < 6
