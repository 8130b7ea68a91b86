import hashlib
import math

import numpy as np

from scarp.llm import laesa as A

KIND = "vec_id long, embedding array<float>, label long, cluster string, far int"


def plain(rows, k=16, rounds=3, scale=64, width=64):
    kept = [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v in rows
            if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    kept = [(i, v) for i, v in kept if all(abs(c) < A.LIMIT for c in v)]
    seeds = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), np.array(v, "<i4").tobytes(), v) for i, v in kept if i is not None)[:k]
    cents = [v for _, _, v in seeds]

    def nearest():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents)) for _, v in kept] if cents else []
    for _ in range(rounds):
        at = nearest()
        for n in range(len(cents)):
            own = [v for (_, v), (_, c) in zip(kept, at) if c == n]
            if own:
                cents[n] = [sum(x) // len(own) for x in zip(*own)]
    at = nearest()
    out = []
    for (i, _), (d, c) in zip(kept, at):
        sha = hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()
        out.append((str(i), c, d, sum(e for e, f in at if f == c), sum(e for e, _ in at), sha))
    return sorted(out)


def table(spark, rows, parts=4):
    return spark.createDataFrame([(i, v, 3, "x", 1) for i, v in rows], KIND).repartition(parts)


def hard_rows(rng, n=300):
    centres = rng.normal(0, 3, (12, 64))
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(0, 1, 64)]) for i in range(n)]
    same = rows[0][1]
    rows += [(1000 + i, same) for i in range(40)]                                     # a common vector
    rows += [(5, same), (5, same), (None, rows[7][1]), (-3, rows[9][1])]              # repeated and missing ids
    rows += [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 63 + [None]), (2004, [1.0] * 63 + [float("nan")]),
             (2005, [float("inf")] + [0.0] * 63), (2006, [0.0] * 64), (2007, [1e30] * 64), (2008, [-2e6] * 64), (2009, [-1e-9] * 64)]
    return rows


def found(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_equals_exhaustive_comparison(spark):
    rows = hard_rows(np.random.default_rng(4))
    assert found(A.digests(table(spark, rows))) == plain(rows)


def test_ties_few_vectors_and_empty_table(spark):
    grid = [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(2).integers(-1, 2, (60, 64)) * 0.5)]
    assert found(A.digests(table(spark, grid + [(i + 100, v) for i, v in grid]))) == plain(grid + [(i + 100, v) for i, v in grid])
    assert found(A.digests(table(spark, grid[:5]))) == plain(grid[:5])
    assert A.digests(table(spark, grid).limit(0)).count() == 0
    assert A.digests(table(spark, [(1, None)])).count() == 0


def test_bounds_spare_distances():
    rng = np.random.default_rng(1)
    c = np.floor(rng.normal(0, 400, (16, 64))).astype(np.int64)
    v = c[rng.integers(0, 16, 2000)] + np.floor(rng.normal(0, 20, (2000, 64))).astype(np.int64)
    cluster, best, measured = A.assign(v, A._roots(v, c[:8]), c, A._roots(c, c[:8]))
    full = ((v[:, None] - c[None]) ** 2).sum(axis=2)
    assert (cluster == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()
    assert measured < 2000 * 4          # of 16
