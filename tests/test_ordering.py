import numpy as np
import pytest
from pyspark.sql import functions as F

from scarp.functions.ordering import exact_percentiles, rank_rows, running_sums
from scarp.operators import metrics as M
from scarp.operators.serving import tier_threshold


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows and a third of all scores are equal; some are missing."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(6000):
        s = None if i % 50 == 0 else 7.0 if i % 3 == 0 else float(rng.normal())
        rows.append(("2020-01-01" if i % 10 else "2020-02-01", f"t{i}", s, int(rng.random() < 0.2)))
    return spark.createDataFrame(rows, "forecast_date string, transect_id string, score double, y int").cache()


def plain_rank(df):
    from pyspark.sql import Window
    from scarp.functions.ordering import key_hash
    order = [F.col("score").desc_nulls_last(), key_hash("forecast_date", "transect_id"), F.col("forecast_date"), F.col("transect_id")]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("forecast_date").orderBy(*order)).cast("int"))


@pytest.mark.parametrize("slots", [2, 16, 300])
def test_ranking_equals_the_plain_window(skewed, slots):
    a = plain_rank(skewed)
    b = rank_rows(skewed, ["forecast_date"], "score", ["forecast_date", "transect_id"], slots=slots)
    assert a.exceptAll(b.select(a.columns)).count() == 0 and b.count() == 6000


def test_ranking_without_any_score(skewed):
    """All missing: one slot, cut by the hash."""
    from scarp.functions.ordering import _with_slots, key_hash
    none = skewed.withColumn("score", F.lit(None).cast("double"))
    a = plain_rank(none)
    b = rank_rows(none, ["forecast_date"], "score", ["forecast_date", "transect_id"], slots=16)
    assert a.exceptAll(b.select(a.columns)).count() == 0 and b.count() == 6000
    s = _with_slots(none.withColumn("_tie", key_hash("transect_id")), "score", True, "_tie", 16)
    assert s.groupBy("forecast_date", "_slot", "_bin").count().agg(F.max("count")).first()[0] < 6000 / 8


def test_building_a_plan_runs_nothing(spark, skewed):
    from scarp.operators.serving import rank_predictions  # noqa: F401
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    rank_rows(skewed, ["forecast_date"], "score", ["forecast_date", "transect_id"], slots=16)
    M.pr_auc(skewed, "score", ["forecast_date"])
    exact_percentiles(skewed, ["forecast_date"], "score", {"m": 0.5})
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before


def test_running_sums_ascending(skewed):
    from pyspark.sql import Window
    s = skewed.dropna()
    w = Window.orderBy("score", "transect_id").rowsBetween(Window.unboundedPreceding, 0)
    a = s.withColumns({"c": F.sum("y").over(w), "n": F.sum(F.lit(1)).over(w)})
    b = running_sums(s, [], "score", {"c": F.col("y"), "n": F.lit(1)}, slots=8, descending=False, keys=["transect_id"])
    assert a.exceptAll(b.select(a.columns)).count() == 0


def test_heavy_ties_are_cut_by_the_hash(skewed):
    from scarp.functions.ordering import _with_slots, key_hash
    s = _with_slots(skewed.withColumn("_tie", key_hash("transect_id")), "score", True, "_tie", 16)
    biggest = s.groupBy("forecast_date", "_slot", "_bin").count().agg(F.max("count")).first()[0]
    assert biggest < 6000 / 8


def test_exact_percentiles(skewed):
    probs = {"a": 0.5, "b": 0.9, "c": 0.025}
    x = {r["forecast_date"]: r for r in exact_percentiles(skewed, ["forecast_date"], "score", probs, slots=16).collect()}
    pdf = skewed.toPandas()
    for d, g in pdf.groupby("forecast_date"):
        for name, p in probs.items():
            assert abs(x[d][name] - np.nanpercentile(g["score"], p * 100)) < 1e-12
    one = exact_percentiles(skewed, [], "score", {"m": 0.5}, slots=4).first()["m"]
    assert abs(one - np.nanmedian(pdf["score"])) < 1e-12


def test_average_precision_does_not_depend_on_slots(skewed):
    a, b = (M.pr_auc(skewed, "score", ["forecast_date"], slots=n).orderBy("forecast_date").collect() for n in (2, 16))
    assert all(abs(x["pr_auc"] - y["pr_auc"]) < 1e-12 for x, y in zip(a, b))


def toy(spark):
    rows = [(f"2020-01-{d + 1:02d}", f"s{i:02d}", float(50 - i) if i else 60.0, int(i < 10), int(i == 0)) for d in range(5) for i in range(50)]
    return spark.createDataFrame(rows, "forecast_date string, transect_id string, s double, y int, major int")


def test_ranking_toy(spark):
    t = toy(spark)
    p = M.precision_at_k(t, "s", 20).collect()
    assert len(p) == 5 and all(r["precision"] == 0.5 for r in p)
    r = M.major_recall(t, "s", 20).first()
    assert (r["hits"], r["total"], r["recall"]) == (5, 5, 1.0)
    gone = t.withColumn("s", F.when(F.col("transect_id") != "s00", F.col("s")))
    last = M.rank_within_date(gone, "s").where("transect_id = 's00'").agg(F.min("rank")).first()[0]
    assert last == 50
    assert M.precision_at_k(t.where("transect_id < 's10'"), "s", 20).count() == 0


def test_one_class_has_no_average_precision(spark):
    assert M.pr_auc(toy(spark).withColumn("y", F.lit(0)), "s").first()["pr_auc"] is None


def test_block_bootstrap_brackets_the_mean(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(0.05, 0.1, 80)
    s = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "forecast_date int, diff double")
    r = M.moving_block_bootstrap(s).first()
    assert r["n_dates"] == 80 and r["lo"] < r["mean"] < r["hi"] and abs(r["mean"] - v.mean()) < 1e-12
    assert 0.01 < r["hi"] - r["lo"] < 0.1
    short = M.moving_block_bootstrap(s.where("forecast_date < 2"), n=50).first()
    assert short["n_dates"] == 2 and abs(short["lo"] - short["hi"]) < 1e-12


def test_reliability_bins_cover_everything(spark):
    p = spark.createDataFrame([(i / 100, i % 2) for i in range(101)], "p double, y int")
    bins = M.reliability(p, "p").collect()
    assert sum(b["n"] for b in bins) == 101 and len(bins) == 10


def test_tier_threshold_rules(spark):
    rows = [("d", f"t{i}", p, y) for i, (p, y) in enumerate([(0.9, 1), (0.8, 0), (0.7, 1), (0.3, 0), (0.2, 0)])]
    v = spark.createDataFrame(rows, "forecast_date string, transect_id string, p double, y int")
    assert tier_threshold(v).first()[0] == 0.3
    assert tier_threshold(v.withColumn("y", F.lit(0))).first()[0] == 0.9
