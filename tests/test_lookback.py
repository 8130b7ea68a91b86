import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from scarp.operators import lookback as LB
from scarp.operators import metrics as M
from scarp.operators.lookback import Look, look_around

LOOKS = {"mid": Look("v", -24, p=0.5, seen=True), "low": Look("v", -30, 5, 0.25, 3), "n": Look("v", -24),
         "then": Look("v", here=True, at="back", within=(-20, -1)), "mid_then": Look("v", -24, p=0.5, seen=True, at="back"),
         "ahead": Look("v", -6, 12, 0.5, at="next")}


def expected(rows):
    out = {}
    for s, d, v, back, nxt in rows:
        if v is None:
            continue
        mine = [(e, w) for t, e, w, *_ in rows if t == s and e is not None]

        def around(day, lo, hi):
            return [] if day is None else [w for e, w in mine if w is not None and day + lo <= e <= day + hi]

        def pct(x, p, least=1):
            return float(np.quantile(x, p)) if len(x) >= least else None

        if d is None:       # such a row has itself alone
            out[s, d] = (v, None, 1, None, None, None)
            continue
        near = dict(mine).get(back) if back is not None else None
        out[s, d] = (pct(around(d, -24, 0), 0.5), pct(around(d, -30, 5), 0.25, 3), len(around(d, -24, 0)),
                     near if back is not None and d - 20 <= back <= d - 1 else None,
                     None if near is None else pct(around(back, -24, 0), 0.5), pct(around(nxt, -6, 12), 0.5))
    return out


def test_look_around_equals_frames(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = []
    for s in ["a", "b", None, "d"]:
        for d in sorted(rng.choice(np.arange(-40, 200), 40, replace=False).tolist()):
            link = lambda lo, hi: None if rng.random() < 0.2 else d + int(rng.integers(lo, hi))
            rows.append((s, d, None if rng.random() < 0.2 else float(rng.integers(0, 50)), link(-30, 0), link(1, 30)))
    rows += [("a", None, 7.0, None, None), ("e", 5, None, None, None)]
    df = spark.createDataFrame(rows, "transect_id string, day int, v double, back int, next int")
    for size in (1, LB.ROWS):       # cut after every segment, or not at all
        monkeypatch.setattr(LB, "ROWS", size)
        got = {(r["transect_id"], r["day"]): tuple(r[k] for k in LOOKS) for r in look_around(df, LOOKS, where="v").collect()}
        want = expected(rows)
        assert got.keys() == want.keys()
        for k, w in want.items():
            assert [x is None for x in got[k]] == [x is None for x in w], (k, got[k], w)
            np.testing.assert_allclose([x for x in got[k] if x is not None], [x for x in w if x is not None])


def test_two_scores_read_their_rows_once(spark):
    """Both rankings read one written copy, not the plan behind it twice."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def noted(x):
        seen.add(1)
        return float(x)

    rows = [(dt.date(2020, 1, 1 + i // 30), f"t{i % 30}", i, i % 7 == 0) for i in range(90)]
    df = spark.createDataFrame(rows, "forecast_date date, transect_id string, i int, pos boolean")
    df = df.select("forecast_date", "transect_id", noted("i").alias("a"), (-F.col("i")).cast("double").alias("b"), F.col("pos").cast("int").alias("y"))
    assert M.precision_difference(df, "a", "b", 5).count() == 3
    assert seen.value == 90
