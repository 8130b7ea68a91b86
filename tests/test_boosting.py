"""Boosted trees and isotonic steps against plain Python."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from scarp.operators import explain as X
from scarp.operators import isotonic as I
from scarp.operators import models as ML
from scarp.operators.boosting import ONE, RIDGE, BoostedModel, Trial, Tree, fit_trials
from scarp.operators.isotonic import Calibrator, fit_isotonic

KIND = "forecast_date string, transect_id string, a double, b double, c double, y int"


def rows_of(n, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        a, b, c = rng.normal(0, 1, 3).round(2)
        y = int((a if a > 0 else -b) + rng.normal(0, 0.4) > 0.3)
        out.append((f"d{i % 7}", f"t{i}", float(a), None if rng.random() < 0.2 else float(b), float("nan") if rng.random() < 0.1 else float(c), y))
    return out


EDGES = {"a": [-1.0, -0.5, 0.0, 0.5, 1.0], "b": [-0.7, 0.0, 0.7], "c": [0.0]}


def plain_fit(rows, edges, rounds, depth, min_rows, rate):
    """Margins of the rows after growing the trees in plain Python."""
    names = list(edges)
    x = np.array([[np.nan if v is None else v for v in r[2:5]] for r in rows], float)
    y = np.array([r[5] for r in rows], float)
    m = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    val = lambda g, h: -(g / ONE) / (h / ONE + RIDGE)
    term = lambda g, h: (g / ONE) ** 2 / (h / ONE + RIDGE)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-m))
        g, h = np.rint((p - y) * ONE), np.rint(p * (1 - p) * ONE)
        add = np.zeros(len(y))

        def grow(at, d):
            best = (0.0, None)
            for f, name in enumerate(names):
                for c in edges[name]:
                    for left in (False, True):
                        to = np.where(np.isnan(x[at, f]), left, x[at, f] <= c)
                        lo, hi = at[to], at[~to]
                        if min(len(lo), len(hi)) < min_rows:
                            continue
                        gain = round(term(g[lo].sum(), h[lo].sum()) + term(g[hi].sum(), h[hi].sum()) - term(g[at].sum(), h[at].sum()), 9)
                        if gain > best[0] or (gain == best[0] and best[1] and f == best[1][0] and c < best[1][1]):
                            best = (gain, (f, c, lo, hi))
            if best[1] is None or d == depth:
                add[at] = rate * val(g[at].sum(), h[at].sum())
            else:
                grow(best[1][2], d + 1)
                grow(best[1][3], d + 1)
        grow(np.arange(len(y)), 0)
        m = m + add
    return m


@pytest.mark.parametrize("parts", [1, 5])
def test_fit_equals_plain_python(spark, parts, monkeypatch):
    from scarp.operators import boosting as B
    monkeypatch.setattr(B, "ROWS_PER_TASK", 2000 // parts)
    monkeypatch.setattr(B, "KEEP_TREES", 2)
    rows = rows_of(1500)
    df = spark.createDataFrame(rows, KIND).repartition(3)
    trials = [Trial(2, 40, 0.3), Trial(3, 10, 0.1)]
    models = fit_trials(df, ["a", "b", "c"], trials, 5, edges=EDGES, subsample=1, colsample=1)
    x = np.array([[np.nan if v is None else v for v in r[2:5]] for r in rows], float).T
    for t, m in zip(trials, models):
        assert np.allclose(m.margins(x), plain_fit(rows, EDGES, 5, t.depth, t.min_rows, t.rate), atol=1e-9)
    with_null_y = df.unionByName(df.limit(5).withColumn("y", F.lit(None).cast("int")))
    again = fit_trials(with_null_y, ["a", "b", "c"], trials, 5, edges=EDGES, subsample=1, colsample=1)
    assert [t.value for t in again[0].trees] == [t.value for t in models[0].trees]


def test_early_stopping_sampling_and_variants(spark):
    df, val = spark.createDataFrame(rows_of(1200), KIND), spark.createDataFrame(rows_of(600, 1), KIND)
    full, no_a = fit_trials(df, ["a", "b", "c"], [Trial(3, 20, 0.4), Trial(3, 20, 0.4, ("b", "c"))], 40, val, patience=4)
    assert 0 < len(full.trees) < 40 and all(f != 0 for t in no_a.trees for f in t.feature)

    def loss(m, n):
        cut = BoostedModel(m.features, m.trees[:n], m.base)
        x = np.array([[np.nan if v is None else v for v in r[2:5]] for r in rows_of(600, 1)], float).T
        y = np.array([r[5] for r in rows_of(600, 1)])
        z = cut.margins(x)
        return (np.logaddexp(0, z) - y * z).mean()
    n = len(full.trees)
    assert loss(full, n) < min(loss(full, n - 1), loss(full, 0)) and loss(full, n) < loss(no_a, len(no_a.trees))
    model, trials = ML.tune_grid(df, val, ["a", "b", "c"], 10, 20, {"depth": [2, 3], "min_rows": [20], "rate": [0.3]})
    assert len(trials) == 2 and model.params["depth"] in (2, 3) and trials[0]["val_precision_at_k"] > 0.5
    empty = ML.fit_boosted(df.limit(0), ["a", "b", "c"])
    assert not empty.trees and empty.score(val).where("raw = 0.5").count() == 600


def test_contributions_add_up_and_scores_agree(spark):
    rows = rows_of(400)
    df = spark.createDataFrame(rows, KIND)
    m = ML.fit_boosted(df, ["a", "b", "c"], 8, trial=Trial(3, 10, 0.3))
    cal = fit_isotonic(m.score(df), "raw")
    got = X.model_scores(df, m, cal).join(m.score(df.select("transect_id", "a", "b", "c"), "other").select("transect_id", "other"), "transect_id").collect()
    for r in got:
        assert abs(np.log(r.raw / (1 - r.raw)) - (m.bias + r.c_a + r.c_b + r.c_c)) < 1e-9
        assert r.raw == r.other and 0 <= r.p <= 1


def plain_isotonic(x, y):
    out = {}
    for v in sorted(set(x)):
        block = [v, sum(b for a, b in zip(x, y) if a == v), x.count(v), v]
        out.setdefault("b", []).append(block)
        b = out["b"]
        while len(b) > 1 and b[-2][1] / b[-2][2] >= b[-1][1] / b[-1][2]:
            last = b.pop()
            b[-1] = [b[-1][0], b[-1][1] + last[1], b[-1][2] + last[2], last[3]]
    return [(lo, hi, s / n) for lo, s, n, hi in out["b"]]


@pytest.mark.parametrize("part", [1 << 16, 40])
def test_isotonic_equals_pooling(spark, part, monkeypatch):
    monkeypatch.setattr(I, "PART", part)
    monkeypatch.setattr(I, "FAN", 3)
    rng = np.random.default_rng(3)
    x = [float(v) for v in rng.integers(0, 150, 900) / 10]
    y = [int(rng.random() < 0.1 + v / 20) for v in x]
    cal = fit_isotonic(spark.createDataFrame(list(zip(x, y)), "s double, y int").repartition(4), "s")
    want = plain_isotonic(x, y)
    assert list(zip(cal.low, cal.high)) == [(a, b) for a, b, _ in want] and np.allclose(cal.p, [p for *_, p in want])
    df = spark.createDataFrame([(None,), (float("nan"),), (-5.0,), (99.0,), ((want[0][1] + want[1][0]) / 2,)], "s double")
    got = [r.p for r in cal.apply(df, "s", "p").collect()]
    assert np.allclose(got, [want[0][2]] * 3 + [want[-1][2], (want[0][2] + want[1][2]) / 2])


def test_isotonic_without_rows_and_missing_scores(spark):
    df = spark.createDataFrame([(None, 1), (None, 0), (2.0, 1), (3.0, None)], "s double, y int")
    cal = fit_isotonic(df, "s")
    assert cal.fill == 2.0 and [r.p for r in cal.apply(df, "s", "p").collect()] == [2 / 3] * 4
    assert fit_isotonic(df.limit(0), "s").apply(df, "s", "p").where("p IS NULL").count() == 4


def test_tree_walk_by_hand():
    t = Tree()
    left, right = t.split(0, 0, 1, 5.0, True, (-1.0, 2.0))
    t.split(right, 1, 1, 0.0, False, (0.5, 3.0))
    m = BoostedModel(["a", "b"], [t], 0.25)
    x = np.array([[4.0, np.nan, 6.0, 6.0], [1.0, 1.0, -1.0, np.nan]])
    assert m.margins(x).tolist() == [-0.75, -0.75, 0.75, 3.25]
    assert m.contributions(x).tolist() == [[-1.0, 0.0], [-1.0, 0.0], [2.0, -1.5], [2.0, 1.0]]
    assert Calibrator(np.array([0.0]), np.array([1.0]), np.array([0.3]), 0.0).values(np.array([0.5])).tolist() == [0.3]
