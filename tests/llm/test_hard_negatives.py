import math

import numpy as np
from pyspark.sql import functions as F

from scarp.llm import hard_negatives as H

KIND = "vec_id long, embedding array<float>, label int, id string, score int, anchor int"


def plain(rows, anchor, relabel, scale=256, low=80):
    by = {}
    for i, v, lab in rows:
        if i is None or lab is None or not v or any(c is None or not math.isfinite(c) for c in v) or len(v) != 64:
            continue
        x = [math.floor(scale * float(np.float32(c))) for c in v]
        if max(abs(c) for c in x) <= int(((1 << 62) / 6400) ** 0.5):
            by[i] = min(by.get(i, (relabel(i, lab), x)), (relabel(i, lab), x))
    out = []
    for a in sorted(by):
        if not anchor(a):
            continue
        dot = sorted((-sum(p * q for p, q in zip(by[a][1], by[i][1])), i) for i in by if i != a)
        pos = [(i, -s) for s, i in dot if by[i][0] == by[a][0]][:5]
        for p, ps in pos:
            neg = [(i, -s) for s, i in dot if by[i][0] != by[a][0] and 80 * ps <= -100 * s <= 100 * ps][:5]
            out += [(a, p, r, i, ps, s) for r, (i, s) in enumerate(neg, 1)]
    return sorted(out)


def mined(spark, rows, every, parts=4):
    df = spark.createDataFrame([(i, v, lab, "x", 1, 2) for i, v, lab in rows], KIND).repartition(parts)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in H.mine(df, F.col("vec_id") % every == 0, label).collect())


def rows_of(rng, n):
    rows = [(i, [float(x) for x in rng.normal(0.2, 1, 64)], int(rng.integers(0, 4))) for i in range(n)]
    same = [abs(x) for x in rows[0][1]]
    rows += [(3000 + i, same, int(i % 3)) for i in range(60)]                         # a common vector: ties everywhere
    rows += [(3, rows[3][1], rows[3][2]), (3, rows[4][1], 9), (None, same, 1), (4000, same, None), (4010, None, 1), (4020, [], 1),
             (4030, [1.0] * 63 + [None], 1), (4040, [float("nan")] + [1.0] * 63, 1), (4050, [1.0] * 3, 1), (4060, [0.0] * 64, 1),
             (4070, [0.0] * 64, 2), (-20, same, 0), (4080, [1e30] * 64, 0)]
    return rows


def relabel(i, lab):
    return (lab + 1) % 10 if i % 7 == 0 else lab


def test_equals_all_pairs_over_several_blocks(spark, monkeypatch):
    rows = rows_of(np.random.default_rng(6), 300)
    expect = plain(rows, lambda i: i % 10 == 0, relabel)
    assert mined(spark, rows, 10) == expect and len(expect) > 100
    monkeypatch.setattr(H, "BLOCK_ROWS", 50)
    monkeypatch.setattr(H, "BLOCK_ANCHORS", 10)
    monkeypatch.setattr(H, "AT_ONCE", 3)
    assert mined(spark, rows, 10, 7) == expect


def test_large_components_are_scored_in_integers():
    a, v = np.full((1, 64), 1 << 25), np.array([[1 << 25] * 64, [(1 << 25) - 1] + [1 << 25] * 63])
    assert H._scores(a, v).tolist() == [[64 << 50, (64 << 50) - (1 << 25)]]


def test_empty_and_single_label(spark):
    rows = rows_of(np.random.default_rng(1), 20)
    assert mined(spark, [(i, v, 1 if lab is not None else None) for i, v, lab in rows if i and i % 7], 10) == []
    assert mined(spark, [(1, None, None)], 1) == []
