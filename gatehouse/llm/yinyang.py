"""Exact centroid clustering of integer vectors, with Yinyang's filters.

Centroids are put into groups once. A vector carries its cluster, an upper bound of the distance to its centroid, and for each group a lower
bound of the distance to the group's other centroids. After centroids move, the bounds move by as much; a vector whose upper bound is below all its
lower bounds keeps its cluster unseen (the global filter), others measure their own centroid and scan only the groups whose bound it still reaches.
Distances are compared as integers, bounds with a margin above what floats can lose, so a tie is always scanned and goes to the smaller number.

A round is one pass over a table of vectors with their bounds, written to the shared folder, and one that sums the clusters in every task before
anything is moved; the driver sees the centroids alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatehouse.llm.common import Scratch

#: Components are held within this size, so that every squared distance of 64 of them fits 63 bits.
LIMIT = 1 << 27
#: Below this size products and their sums are exact in double precision.
_EXACT_FLOAT = 1 << 22
STATE = "vec_id long, v array<int>, cluster int, upper double, lower array<double>"


def integer_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v``: floor(scale * x) of every vector with exactly ``dims`` components, none null or non-finite."""
    x = F.col(vector_col).cast("array<double>")
    finite = lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False))
    whole = F.transform(x, lambda e: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(F.lit(float(scale)) * e))).cast("int"))
    return vectors.where((F.size(x) == dims) & F.forall(x, finite)).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (len(v) x len(c))."""
    small = max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) <= _EXACT_FLOAT
    dots = (v.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64) if small else v @ c.T
    return np.einsum("ij,ij->i", v, v)[:, None] + np.einsum("ij,ij->i", c, c)[None, :] - 2 * dots


def groups_of(centroids: np.ndarray, n_groups: int, rounds: int = 5) -> list[np.ndarray]:
    """Numbers of the centroids of each group, ascending: a few rounds of the same clustering over the centroids."""
    points = centroids.astype(np.float64)
    middle = points[np.linspace(0, len(points) - 1, n_groups).astype(int)]
    for _ in range(rounds):
        near = ((points[:, None, :] - middle[None]) ** 2).sum(axis=2).argmin(axis=1)
        middle = np.array([points[near == g].mean(axis=0) if (near == g).any() else middle[g] for g in range(n_groups)])
    return [own for g in range(n_groups) if len(own := np.flatnonzero(near == g))]


def assign(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, before: np.ndarray, now: np.ndarray, groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, upper, lower, distances computed) under the centroids ``now`` of vectors whose bounds hold for ``before``."""
    drift = np.sqrt(((now - before).astype(np.float64) ** 2).sum(axis=1))
    cluster, upper = cluster.copy(), upper + drift[cluster]
    lower = lower - np.array([drift[own].max() for own in groups])
    reach = lambda u: u * (1 + 1e-9) + 1e-6
    rows = np.flatnonzero(lower.min(axis=1) <= reach(upper))
    part = v[rows]
    old = cluster[rows]
    gap = part - now[old]
    own = np.einsum("ij,ij->i", gap, gap)
    upper[rows] = np.sqrt(own.astype(np.float64))
    open_ = lower[rows] <= reach(upper[rows])[:, None]
    best, to, scanned, work = own.copy(), old.copy(), [], len(rows)
    for g, members in enumerate(groups):
        some = np.flatnonzero(open_[:, g])
        if not len(some):
            continue
        d = distances(part[some], now[members])
        work += d.size
        near = d.argmin(axis=1)
        least, number = d[np.arange(len(some)), near], members[near]
        wins = (least < best[some]) | ((least == best[some]) & (number < to[some]))
        best[some[wins]], to[some[wins]] = least[wins], number[wins]
        scanned.append((g, members, some, d))
    for g, members, some, d in scanned:
        others = np.where(members[None, :] == to[some][:, None], np.inf, d.astype(np.float64)).min(axis=1)
        lower[rows[some], g] = np.sqrt(others)
    moved = np.flatnonzero(to != old)
    if len(moved):  # the centroid left behind is now one of its group's others
        home = np.zeros(len(now), np.int64)
        for g, members in enumerate(groups):
            home[members] = g
        left = home[old[moved]]
        lower[rows[moved], left] = np.minimum(lower[rows[moved], left], np.sqrt(own[moved].astype(np.float64)))
    cluster[rows], upper[rows] = to, np.sqrt(best.astype(np.float64))
    return cluster, upper, lower, work


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _rounds(state: DataFrame, before: np.ndarray, now: np.ndarray, groups: list[np.ndarray], dims: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1), dims).astype(np.int64)
            cluster, upper, lower, _ = assign(v, batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy(), _matrix(batch.column(4), len(groups)), before, now, groups)
            bounds = pa.ListArray.from_arrays(pa.array(np.arange(0, lower.size + 1, len(groups)), pa.int32()), pa.array(lower.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(upper), bounds], ["vec_id", "v", "cluster", "upper", "lower"])

    return state.mapInArrow(run, STATE)


def cluster_sums(state: DataFrame, k: int, dims: int) -> DataFrame:
    """``cluster, at, total``: sums of the components, and at ``dims`` the number of vectors; each task gives at most ``k`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            to, v = batch.column(0).to_numpy(), _matrix(batch.column(1), dims)
            order = np.argsort(to, kind="stable")
            found, first = np.unique(to[order], return_index=True)
            if len(found):
                total[found, :dims] += np.add.reduceat(v[order].astype(np.int64), first, axis=0)
                total[found, dims] += np.diff(np.append(first, len(to)))
        some = np.flatnonzero(total[:, dims])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(some) * (dims + 1) + 1, dims + 1), pa.int32()), pa.array(total[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), lists], ["cluster", "sums"])

    parts = state.select("cluster", "v").mapInArrow(run, "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("at", "part"))
    return parts.groupBy("cluster", "at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))


def _moved(state: DataFrame, now: np.ndarray) -> np.ndarray:
    """The floor of each cluster's mean; an empty one's centroid stays."""
    k, dims = now.shape
    sums = {(r["cluster"], r["at"]): int(r["total"]) for r in cluster_sums(state, k, dims).collect()}  # k * (dims + 1) rows at most
    return np.array([[sums[c, i] // sums[c, dims] for i in range(dims)] if (c, dims) in sums else now[c] for c in range(k)], np.int64).reshape(k, dims)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector with ``dims`` finite components.

    Centroids start as the ``k`` vectors with the smallest SHA-256 of ``seed`` and their id (of fewer, all; of rows that repeat an id, the least vector first) and
    move ``rounds`` times to the floor of their vectors' mean; equal distances go to the smaller number. Rows that repeat an id are vectors of their
    own; one without an id is assigned but never starts a centroid, unless too few have an id. Null vectors, other lengths, and null or non-finite components give no row, an
    empty table none. Components beyond ``LIMIT`` in size count as it. A sum of distances beyond 63 bits is null. Further columns, whatever their names, are ignored.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "clusters")
    kept = scratch.put("vectors", integer_vectors(vectors, dims, scale, id_col, vector_col))
    by_hash = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    first = kept.select(by_hash.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    now = np.array([r["v"] for r in first], np.int64)
    groups = groups_of(now, max(1, len(now) // 10))
    # nothing is known before the first round: every group is reached
    none = F.array_repeat(F.lit(float("-inf")), len(groups))
    state, before = kept.select("vec_id", "v", F.lit(0).alias("cluster"), F.lit(float("inf")).alias("upper"), none.alias("lower")), now
    for r in range(rounds + 1):
        state = scratch.put(f"state-{r}", _rounds(state, before, now, groups, dims))
        scratch.drop(f"state-{r - 1}" if r else "vectors")
        if r < rounds:
            before, now = now, _moved(state, now)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gap = _matrix(batch.column(2), dims).astype(np.int64) - now[batch.column(1).to_numpy()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.einsum("ij,ij->i", gap, gap))], ["vec_id", "cluster", "distance"])

    out = scratch.put("result", state.select("vec_id", "cluster", "v").mapInArrow(measured, "vec_id long, cluster int, distance long"))
    scratch.drop(f"state-{rounds}")
    sums = {r["cluster"]: int(r["d"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows at most
    fits = lambda n: F.lit(n if n < 1 << 63 else None).cast("long")
    of = lambda cells: F.element_at(F.array(*cells), F.col("cluster") + 1)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now.tolist()]
    return out.select("vec_id", "cluster", "distance", of([fits(sums.get(c, 0)) for c in range(len(now))]).alias("cluster_inertia"), fits(sum(sums.values())).alias("inertia"), of(map(F.lit, names)).alias("centroid_sha256"))
