"""Exponion search against full scans."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from mnemolake.llm import centroid_clustering as cc


def brute(rows, dims=4, k=3, rounds=5):
    """All distances, in every round."""
    hold = lambda x: int(max(-cc.LIMIT, min(cc.LIMIT, np.floor(256 * x)))) if abs(256 * x) < 1e18 else (cc.LIMIT if x > 0 else -cc.LIMIT)
    kept = [(i, [hold(x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    at = [v for _, v in start[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(at))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        at = [[sum(col) // len(col) for col in zip(*mine, strict=True)] if (mine := [v for (_, v), o in zip(kept, own, strict=True) if o == n]) else c for n, c in enumerate(at)]
    out = [(i, *nearest(v)) for i, v in kept]
    of = lambda n: sum(d for _, d, m in out if m == n)
    sha = lambda n: hashlib.sha256(",".join(map(str, at[n])).encode()).hexdigest()
    return sorted(((i, n, d, of(n), sum(x[1] for x in out), sha(n)) for i, d, n in out), key=repr)


def got(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, cluster int, sums int")
    return sorted(map(tuple, cc.exponion_clusters(df, dims=4, k=more.pop("k", 3), **more).collect()), key=repr)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.25, -0.5, 1.0]), (1, [0.5, 0.25, -0.5, 1.0]), (2, None), (3, []), (4, [1.0, 2.0, 3.0]), (5, [1.0, None, 0.0, 0.0]), (6, [nan, 0.0, 0.0, 0.0]), (7, [inf, 0.0, 0.0, 0.0])]
    rows += [(None, [0.0, 0.0, 0.0, -0.001]), (None, [9.0, 9.0, 9.0, 9.0]), (8, [-0.5, -0.25, 0.5, -1.0]), (9, [1e30, 0.0, 0.0, 0.0]), (10, [float(2**19), -1.0, 0.0, 0.0])]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows, k=40) == brute(rows, k=40)
    assert got(spark, rows, k=1) == brute(rows, k=1)
    assert got(spark, []) == [] and got(spark, rows[2:8]) == []
    with pytest.raises(ValueError, match="k must be"):
        got(spark, rows, k=cc.MOST_CENTROIDS + 1)


@pytest.mark.parametrize("seed", range(3))
def test_ties_and_a_hot_vector(spark, seed):
    """Few distinct components, so that many distances tie; a third of all rows are one vector."""
    rng = random.Random(seed)
    rows = [(i, [rng.choice((-1, 0, 1)) / 256 * 2 for _ in range(4)]) for i in range(200)] + [(1000 + i, [0.0, 0.0, 2 / 256, 0.0]) for i in range(100)]
    assert got(spark, rows, k=12) == brute(rows, k=12)


def test_balls_spare_distances():
    """In clustered data later rounds take few distances, and give what full scans give."""
    rng = np.random.default_rng(5)
    middle = rng.integers(-4000, 4000, (30, 8))
    v = (middle[rng.integers(0, 30, 3000)] + rng.integers(-40, 40, (3000, 8))).astype(np.int64)
    at, before, own, low, high = v[:30].copy(), None, np.full(3000, -1), np.zeros(3000), np.zeros(3000)
    for turn in range(6):
        own, high, low, taken = cc.assign(v, own, high, low, cc.Centroids(at, before))
        d = cc.squared(v, at)
        assert (own == d.argmin(axis=1)).all()
        assert turn == 0 or taken < 0.5 * d.size
        before, at = at, np.stack([v[own == n].sum(axis=0) // max(1, (own == n).sum()) if (own == n).any() else at[n] for n in range(30)])


def test_distances_beyond_doubles():
    rng = np.random.default_rng(6)
    v, c = rng.integers(-cc.LIMIT, cc.LIMIT, (20, 64)), rng.integers(-cc.LIMIT, cc.LIMIT, (7, 64))
    assert cc.squared(v, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)) for y in c] for x in v]
