"""Centroid clustering of integer vectors with a pivot table (LAESA).

Every vector's distances to ``PIVOTS`` fixed pivots are measured once and stored beside it. In a round each centroid's distances
to the pivots give a lower bound on its distance to a vector, the largest difference over the pivots (triangle inequality).
The centroid with the least bound is measured exactly, and after it only centroids whose bound does not exceed the best
distance found so far. Bounds are rounded down, so they never rule out a centroid that wins or ties: results are those of
the exhaustive comparison. Distances are exact 64-bit integers.

A component x becomes floor(scale * x). Seeds are the ``k`` vectors with the smallest sha256 of ``1:<vec_id>``. A round assigns every
vector to the nearest centroid (ties: the smaller number), then moves each non-empty centroid to the componentwise
floor(sum / count). Tasks add up their own vectors, so a round exchanges ``k`` rows of sums per task whatever the sizes of the
clusters; the driver sees ``k`` centroids and the pivots only.

A vector takes no part if it is null, has another number of components than ``width``, or a component that is null, not finite or
at least ``LIMIT`` after scaling (squares of those would not fit a long). Rows that repeat are vectors of their own. A row without
vec_id is clustered but never a seed; seeds with equal ids are ordered by their components. With fewer than ``k`` vectors
there are as many centroids as seeds; an empty table gives an empty result. Other columns are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarp.llm.texts import stored

PIVOTS, PIVOT_SAMPLE = 16, 1024         # pivots come from a bounded sample; they decide speed, never results
LIMIT = 1 << 27
ROWS = 4096                             # vectors handled at once in a task


def integer_vectors(vectors: DataFrame, scale: int, width: int) -> DataFrame:
    """(vec_id, v) of the rows that take part; v holds the components as little-endian 32-bit integers."""
    x = F.col("embedding").cast("array<double>")
    fine = (F.size(x) == width) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(F.floor(c * scale)) < LIMIT))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(fine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = np.floor(b.column(1).flatten().to_numpy(zero_copy_only=False) * scale).astype("<i4").reshape(b.num_rows, width)
            yield pa.record_batch([b.column(0), pa.array([v.tobytes() for v in flat], pa.binary())], ["vec_id", "v"])

    return rows.mapInArrow(run, "vec_id long, v binary")


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "<i4").reshape(len(col), -1).astype(np.int64)


def _squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of ``v`` to the vector ``c``."""
    d = v - c
    return np.einsum("ij,ij->i", d, d)


def _roots(v: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([_squared(v, p) for p in points], axis=1).astype(np.float64))


def choose_pivots(rows: DataFrame, n: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> np.ndarray:
    """Vectors far from each other, out of a bounded sample that the vectors' hashes pick."""
    picked = rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(sample).collect()
    v = np.array([np.frombuffer(r["v"], "<i4") for r in picked], np.int64)
    chosen: list[int] = []
    far = np.full(len(v), np.iinfo(np.int64).max)
    while len(chosen) < min(n, len(v)):
        chosen.append(int(np.argmax(far)))
        far = np.minimum(far, _squared(v, v[chosen[-1]]))
    return v[chosen]


def pivot_table(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(vec_id, v, far): every vector with its distances to the pivots, little-endian doubles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                far = _roots(_matrix(b.column(1)), pivots).astype("<f8")
                yield pa.record_batch([b.column(0), b.column(1), pa.array([x.tobytes() for x in far], pa.binary())], ["vec_id", "v", "far"])

    return rows.mapInArrow(run, "vec_id long, v binary, far binary")


def assign(v: np.ndarray, far: np.ndarray, centroids: np.ndarray, from_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of each vector, and how many exact distances that took."""
    bound = np.zeros((len(v), len(centroids)))
    for k, c in enumerate(from_pivots):
        # what rounding may have added to a difference is taken off again
        bound[:, k] = (np.abs(far - c) - 1e-12 * (far + c)).max(axis=1) - 1e-9
    bound = np.maximum(bound, 0.0) ** 2 * (1 - 1e-12)
    cluster = np.argmin(bound, axis=1)
    d = v - centroids[cluster]
    best = np.einsum("ij,ij->i", d, d)
    measured = len(v)
    first = cluster.copy()
    for k, c in enumerate(centroids):
        at = np.flatnonzero((bound[:, k] <= best) & (first != k))
        measured += len(at)
        dist = _squared(v[at], c)
        better = (dist < best[at]) | ((dist == best[at]) & (k < cluster[at]))
        best[at[better]], cluster[at[better]] = dist[better], k
    return cluster, best, measured


def _parts(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, from_pivots: np.ndarray):
    for whole in batches:
        for i in range(0, whole.num_rows, ROWS):
            b = whole.slice(i, ROWS)
            v = _matrix(b.column(1))
            far = np.frombuffer(b"".join(b.column(2).to_pylist()), "<f8").reshape(b.num_rows, -1)
            yield b.column(0), v, *assign(v, far, centroids, from_pivots)


def _moved(rows: DataFrame, pivots: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    from_pivots = _roots(centroids, pivots)
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for _, v, cluster, _, _ in _parts(batches, centroids, from_pivots):
            n += np.bincount(cluster, minlength=k)
            for c in np.unique(cluster):
                sums[c] += v[cluster == c].sum(axis=0)
        at, i = np.indices((k, width + 1))
        values = np.column_stack([sums, n])
        some = np.repeat(n > 0, width + 1)
        yield pa.record_batch([pa.array(a.ravel()[some]) for a in (at, i, values)], ["cluster", "i", "s"])

    total = (rows.mapInArrow(run, "cluster long, i long, s long").groupBy("cluster", "i")
             .agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())      # k * (width + 1) numbers
    by = {(r["cluster"], r["i"]): int(r["s"]) for r in total}
    return np.array([[by[c, i] // by[c, width] for i in range(width)] if (c, width) in by else old.tolist()
                     for c, old in enumerate(centroids)], np.int64)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, width: int = 64) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every vector that takes part, the final centroids)."""
    rows = stored(integer_vectors(vectors, scale, width), "integers")
    name = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    seeds = rows.where("vec_id IS NOT NULL").select("v", name.alias("name")).orderBy("name", "v").limit(k).collect()
    schema = "vec_id long, cluster int, distance long"
    if not seeds:
        return vectors.sparkSession.createDataFrame([], schema), np.zeros((0, width), np.int64)
    centroids = np.array([np.frombuffer(r["v"], "<i4") for r in seeds], np.int64)
    pivots = choose_pivots(rows)
    table = stored(pivot_table(rows, pivots), "pivot-table")
    for _ in range(rounds):
        centroids = _moved(table, pivots, centroids)
    from_pivots = _roots(centroids, pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, at, dist, _ in _parts(batches, centroids, from_pivots):
            yield pa.record_batch([ids, pa.array(at, pa.int32()), pa.array(dist)], ["vec_id", "cluster", "distance"])

    return table.mapInArrow(run, schema), centroids


def digests(vectors: DataFrame) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    found, centroids = cluster(vectors)
    found = stored(found, "clusters")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    both = sums.groupBy().agg(F.sum("s").alias("inertia"), F.collect_list(F.struct("cluster", "s")).alias("each"))   # a row per cluster
    each = both.select(F.inline("each"), F.col("inertia").cast("long").alias("inertia")).select(
        "cluster", F.col("s").cast("long").alias("cluster_inertia"), "inertia")
    names = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    named = vectors.sparkSession.createDataFrame(names, "cluster int, centroid_sha256 string")
    return (found.join(F.broadcast(each.join(F.broadcast(named), "cluster")), "cluster")
            .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))
