import hashlib
import math
import random

import numpy as np
import pytest

from gatehouse.llm import yinyang

SCHEMA = "vec_id long, embedding array<double>, cluster string, v string"


def brute(rows, k, rounds, dims, scale):
    """Plain clustering in Python integers: (vec_id, cluster, distance, cluster's sum, sum, digest)."""
    kept = [(i, tuple(max(-yinyang.LIMIT, min(yinyang.LIMIT, math.floor(scale * x))) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    hashed = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "~", v) for i, v in kept)
    centroids = [v for _, v in hashed[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        to = [min((far(v, c), n) for n, c in enumerate(centroids)) for _, v in kept]
        if r < rounds:
            for n in range(len(centroids)):
                own = [v for (_, v), (_, m) in zip(kept, to, strict=True) if m == n]
                if own:
                    centroids[n] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    of = [sum(d for d, m in to if m == n) for n in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, m, d, of[m], sum(of), digest[m]) for (i, _), (d, m) in zip(kept, to, strict=True)), key=repr)


def made(seed, n, dims, spread):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(9)]
    return [(i, [rng.gauss(m, spread) for m in rng.choice(middles)]) for i in range(n)]


@pytest.mark.parametrize(("k", "dims", "scale", "spread"), [(24, 4, 256, 0.2), (12, 3, 2, 0.5), (40, 8, 256, 0.05)])
def test_as_brute_force(spark, k, dims, scale, spread):
    rows = made(k, 400, dims, spread)
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA).repartition(3)
    got = yinyang.cluster(df, k=k, dims=dims, scale=scale).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, k, 5, dims, scale)


def test_odd_vectors(spark):
    """Ties, repeats, huge components, few vectors, and rows that aren't vectors."""
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.5]), (1, [0.5, -0.5]), (1, [0.25, 1e300]), (2, [1e12, -1e12]), (3, None), (4, [1.0]), (5, [1.0, None]), (6, [nan, 0.0]), (7, [inf, 0.0]), (None, [0.0, 0.0]), (8, []), (9, [0.0, 0.0]), (10, [0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)
    for k in (2, 3, 40):
        assert sorted(map(tuple, yinyang.cluster(df, k=k, dims=2).collect()), key=repr) == brute(rows, k, 5, 2, 256)
    assert yinyang.cluster(df.where("vec_id = 3"), dims=2).count() == 0
    assert yinyang.cluster(df.limit(0)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_filters_spare_most_distances():
    """Bounds stay true and leave few distances to compute once centroids hardly move."""
    rng = np.random.default_rng(1)
    v = (rng.integers(-500, 500, (40, 16))[rng.integers(0, 40, 4000)] + rng.integers(-20, 20, (4000, 16))).astype(np.int64)
    now = v[:40].copy()
    groups = yinyang.groups_of(now, 4)
    assert sorted(np.concatenate(groups).tolist()) == list(range(40))
    state, before, work = (np.zeros(len(v), np.int64), np.full(len(v), np.inf), np.full((len(v), len(groups)), -np.inf)), now, []
    for _ in range(8):
        *state, n = yinyang.assign(v, *state, before, now, groups)
        work.append(n)
        d = ((v[:, None, :] - now[None]) ** 2).sum(axis=2)
        assert (state[0] == d.argmin(axis=1)).all()
        exact = np.sqrt(d.astype(float))
        assert (state[1] >= exact[np.arange(len(v)), state[0]] - 1e-6).all()
        for g, own in enumerate(groups):
            others = np.where(own[None] == state[0][:, None], np.inf, exact[:, own]).min(axis=1)
            assert (state[2][:, g] <= others + 1e-6).all()
        before, now = now, np.array([v[state[0] == c].sum(axis=0) // max(1, (state[0] == c).sum()) if (state[0] == c).any() else now[c] for c in range(40)])
    assert work[0] >= 40 * len(v) and work[-1] < 4 * len(v)


def test_large_distances_are_exact():
    rng = np.random.default_rng(2)
    v, c = (rng.integers(-yinyang.LIMIT, yinyang.LIMIT, (n, 64)) for n in (5, 3))
    assert yinyang.distances(v, c).tolist() == [[sum((int(x) - int(y)) ** 2 for x, y in zip(a, b, strict=True)) for b in c] for a in v]
