"""The tables that trees are walked by, and the number of tasks of a fit."""
import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import functions as F

from scarp.operators import boosting as B

KIND = "forecast_date string, transect_id string, a double, b double, y int"


def slow_margin(m, x):
    out = np.full(x.shape[1], m.base)
    for t in m.trees:
        for j in range(x.shape[1]):
            at = 0
            while t.feature[at] >= 0:
                v = x[t.feature[at], j]
                to_left = t.missing_left[at] if np.isnan(v) else v <= t.cut[at]
                at = t.left[at] if to_left else t.right[at]
            out[j] += t.value[at]
    return out


def test_walks_equal_single_steps():
    rng = np.random.default_rng(5)
    trees = []
    for _ in range(12):
        t, open_ = B.Tree(), [0]
        for _ in range(int(rng.integers(0, 9))):
            cut = float(rng.integers(-3, 4))
            open_ += t.split(open_.pop(int(rng.integers(len(open_)))), int(rng.integers(2)), 1, cut, bool(rng.integers(2)), tuple(rng.normal(size=2)))
        trees.append(t)
    x = rng.integers(-4, 5, (2, 300)).astype(float) + rng.integers(0, 2, (2, 300)) / 2
    x[rng.random((2, 300)) < 0.2] = np.nan
    x[0, :2] = np.inf, -np.inf
    m = B.BoostedModel(["a", "b"], trees, 0.1)
    assert m.margins(x).tolist() == slow_margin(m, x).tolist()
    assert np.allclose(m.bias + m.contributions(x).sum(axis=1), m.margins(x))
    assert B.BoostedModel(["a", "b"], [], 0.5).margins(x).tolist() == [0.5] * 300


def test_tasks_stay_few_and_blocks_may_be_cut(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(f"d{i % 5}", f"t{i}", float(rng.normal()), float(rng.normal()), int(rng.random() < 0.4)) for i in range(900)]
    df = spark.createDataFrame(rows, KIND).withColumn("y", F.when(F.col("a") > 0, 1).otherwise(F.col("y")))
    run = lambda: [(t.feature, t.bin, t.value) for t in B.fit_trials(df, ["a", "b"], [B.Trial(3, 20, 0.3)], 3)[0].trees]
    whole = run()
    sent = []
    repartition = type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, n, *cols: sent.append(n) or repartition(self, n, *cols))
    monkeypatch.setattr(B, "ROWS_PER_TASK", 10)
    monkeypatch.setattr(B, "BLOCK_ROWS", 7)
    assert run() == whole and sent == [2 * spark.sparkContext.defaultParallelism]


def test_places_equal_single_steps():
    rng = np.random.default_rng(8)
    for size in (0, 1, 6, 150):         # 150 splits make more nodes than a byte can name
        t, open_ = B.Tree(), [0]
        for _ in range(size):
            cut = int(rng.integers(1, 7))
            open_ += t.split(open_.pop(int(rng.integers(len(open_)))), int(rng.integers(3)), cut, float(cut), bool(rng.integers(2)), (0.0, 0.0))
        arrays = t.arrays()
        bins = rng.integers(0, 8, (3, 400)).astype(np.uint8)
        walk = B._Walk(arrays, arrays[1], 8)
        assert walk.places(bins).tolist() == walk.leaves(bins).tolist()


def test_one_of_two_sisters_is_added_up_on_the_driver_or_before(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(f"d{i % 5}", f"t{i}", float(rng.normal()), None if i % 7 == 0 else float(rng.normal()), int(rng.random() < 0.4)) for i in range(2000)]
    df = spark.createDataFrame(rows, KIND).withColumn("y", F.when(F.col("a") > 0.3, 1).otherwise(F.col("y")))
    monkeypatch.setattr(B, "ROWS_PER_TASK", 300)
    asked = []
    histograms = B._histograms
    monkeypatch.setattr(B, "_histograms", lambda trials, *a: asked.append({t: list(x[2]) for t, x in trials.items()}) or histograms(trials, *a))
    trials = [B.Trial(3, 20, 0.3), B.Trial(2, 20, 0.3, ("a",))]
    run = lambda: [[(t.feature, t.bin, t.left, t.value) for t in m.trees] for m in B.fit_trials(df, ["a", "b"], trials, 3)]
    trees = run()
    # a level names half of its open nodes, and a round has a job per level
    assert len(asked) == 9 and all(len(nodes) <= max(1, 2 ** (i % 3) // 2) for i, x in enumerate(asked) for nodes in x.values())
    reduced = []
    reduce_by_key = RDD.reduceByKey
    monkeypatch.setattr(RDD, "reduceByKey", lambda self, *a: reduced.append(1) or reduce_by_key(self, *a))
    monkeypatch.setattr(B, "DRIVER_BYTES", 0)
    assert run() == trees and len(reduced) == 9


def test_small_batches_make_one_block():
    assert [len(b.column("y")[0].as_py()) // 8 for b in B._to_block([np.array([0.0])] * 2, 1, 0.0)(batches(25, 10))] == [250]


def batches(many, n):
    for i in range(many):
        yield pa.record_batch([pa.array([[0.1, float(i)]] * n), pa.array([1.0] * n), pa.array([False] * n), pa.array(range(n))], ["x", "y", "val", "key"])


def test_calibrators_fitted_at_once_are_those_of_single_fits(spark, monkeypatch):
    from scarp.operators import models as ML
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(*map(float, rng.random(3)), int(rng.random() < 0.3)) for _ in range(300)], "a double, b double, c double, y int").cache()
    begun, fit = [], ML.fit_isotonic
    monkeypatch.setattr(ML, "fit_isotonic", lambda d, score: begun.append(score) or fit(d, score))
    got = ML._fit_each([(df, s) for s in "abc"])
    assert sorted(begun) == ["a", "b", "c"]
    for s, cal in zip("abc", got):
        one = fit(df, s)
        assert (cal.low.tolist(), cal.high.tolist(), cal.p.tolist(), cal.fill) == (one.low.tolist(), one.high.tolist(), one.p.tolist(), one.fill)
