import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import synthetic
from scarp.operators import features as FT
from scarp.operators import labels as L
from scarp.operators import panel as P


def calendar(spark, days):
    return spark.createDataFrame([(d,) for d in days], "date date").select(F.unix_date("date").alias("day"))


def test_target_pass(spark):
    days = [dt.date(2020, 1, 1), dt.date(2020, 1, 13), dt.date(2020, 1, 25), dt.date(2020, 2, 6), dt.date(2020, 4, 1)]
    got = {r["day"]: r["target"] for r in P.calendar_maps(calendar(spark, days)).collect()}
    n = [(d - dt.date(1970, 1, 1)).days for d in days]
    assert got[n[0]] == n[2] and got[n[3]] is None and got[n[4]] is None


def test_back_map_prefers_the_earlier_pass_and_needs_tolerance(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=d) for d in (0, 8, 34)]
    m = calendar(spark, days).withColumn("k", P.nearest_pass(-30, 12))
    got = [r["k"] for r in m.orderBy("day").collect()]
    first = (days[0] - dt.date(1970, 1, 1)).days
    assert got == [None, None, first]
    with pytest.raises(ValueError):
        P.nearest_pass(-12, 12)


def test_window_statistics_skip_missing_values(spark):
    g = spark.createDataFrame([("a", d, v) for d, v in enumerate([1.0, None, 3.0, 5.0])], "transect_id string, day int, b double")
    r = g.select("day", P.frame_percentile("b", 0.5, -10, 0).alias("m"), P.frame_percentile("b", 0.25, -10, 0, 4).alias("q")).orderBy("day").collect()
    assert r[3]["m"] == 3.0 and r[3]["q"] is None


def test_first_non_null_value_of_a_date_wins(spark):
    d = dt.date(2020, 1, 1)
    p = spark.createDataFrame([("a", d, "p2", 5.0), ("a", d, "p1", None), ("a", d, "p3", 9.0)], "transect_id string, date date, pass_id string, bank_pos_m double")
    assert P.first_per_pass(p, ["bank_pos_m"]).collect()[0]["bank_pos_m"] == 5.0


def test_neighbour_mean_skips_self_and_missing(spark):
    g = spark.createDataFrame([("W", 1, c, f"t{c}", v) for c, v in ((0.0, 1.0), (200.0, 100.0), (400.0, 3.0), (600.0, None))],
                              "bank string, day int, chainage_m double, transect_id string, v double")
    r = g.withColumn("m", P.neighbour_mean("v", 1)).orderBy("chainage_m").collect()
    assert r[1]["m"] == 2.0 and r[0]["m"] == 100.0


def test_curvature_of_an_arc(spark):
    rows = [(f"t{i}", "W", 100.0 * i, float(np.cos(np.pi + 100.0 * i / 3000)), float(np.sin(np.pi + 100.0 * i / 3000))) for i in range(16)]
    t = spark.createDataFrame(rows, "transect_id string, bank string, chainage_m double, nx double, ny double")
    k = np.median([r["baseline_curvature"] for r in FT.curvature(t).collect()])
    assert abs(k - 1 / 3) < 1e-6


def test_fast_segments_stand_out_in_september(spark, positions, transects):
    f = FT.feature_table(positions, transects).where("month(forecast_date) = 9").groupBy("transect_id").agg(F.percentile("ret_84_m", F.lit(0.5)).alias("m"))
    m = {r["transect_id"]: r["m"] for r in f.collect()}
    assert m["W-00100"] > m["W-00300"] + 50


def reference_row(df, tid, j):
    """Independent check of one feature row with plain numpy."""
    dates = sorted(df["date"].unique())
    d = np.array([(x - dt.date(1970, 1, 1)).days for x in dates])
    b = df[df.transect_id == tid].set_index("date").reindex(dates)["bank_pos_m"].to_numpy(dtype=float)

    def stat(lo, hi, q, n):
        v = b[(d >= lo) & (d <= hi)]
        v = v[np.isfinite(v)]
        return np.percentile(v, q) if len(v) >= n else np.nan

    def b0(i):
        return stat(d[i] - 24, d[i], 50, 1) if np.isfinite(b[i]) else np.nan

    def back(days, tol):
        gaps = np.abs(d[:j] - (d[j] - days))
        return int(np.argmin(gaps)) if j and gaps.min() <= tol else None

    out = {}
    for days in (28, 56, 84):
        k = back(days, 12)
        out[f"ret_{days}_m"] = b0(j) - b0(k) if k is not None else np.nan
    k = back(365, 30)
    perm = lambda i: stat(d[i] - 180, d[i], 25, 4)
    out["ret_365_m"] = perm(j) - perm(k) if k is not None else np.nan
    return out


def test_features_match_an_independent_computation(positions, transects):
    df = synthetic()
    dates = sorted(df["date"].unique())
    rows = {(r["transect_id"], r["forecast_date"]): r for r in FT.feature_table(positions, transects).where("transect_id IN ('W-00100', 'E-00900')").collect()}
    seen = 0
    for tid in ("W-00100", "E-00900"):
        for j in (2, 9, 33, 45, 59):
            r = rows.get((tid, dates[j]))
            if r is None:
                continue
            for c, v in reference_row(df, tid, j).items():
                seen += 1
                assert (r[c] is None) == (not np.isfinite(v)) and (r[c] is None or abs(r[c] - v) < 1e-9)
    assert seen > 20


def test_scope_keeps_reaches_apart(spark, positions, transects):
    """Two reaches with their own calendars give what each gives alone."""
    late = positions.where("date >= DATE'2019-06-01'")
    both = positions.withColumn("reach_id", F.lit("a")).unionByName(late.withColumn("reach_id", F.lit("b")))
    tr = transects.withColumn("reach_id", F.lit("a")).unionByName(transects.withColumn("reach_id", F.lit("b")))
    joint = FT.feature_table(both, tr, scope=["reach_id"]).where("reach_id = 'b'").drop("reach_id")
    alone = FT.feature_table(late, transects)
    assert joint.exceptAll(alone).count() == 0 and alone.exceptAll(joint).count() == 0
    lj = L.make_labels(both, 20.0, scope=["reach_id"]).where("reach_id = 'b'").drop("reach_id")
    la = L.make_labels(late, 20.0)
    assert lj.exceptAll(la).count() == 0 and la.count() == lj.count() > 0


def label_series(spark, values):
    d0 = dt.date(2020, 1, 5)
    rows = [("x", name, d0 + dt.timedelta(days=12 * j), float(v)) for name, vs in values.items() for j, v in enumerate(vs)]
    return spark.createDataFrame(rows, "pass_id string, transect_id string, date date, bank_pos_m double")


def test_only_lasting_loss_is_a_positive(spark):
    flood = [0.0] * 4 + [300.0] * 4 + [0.0] * 18
    erode = [0.0] * 4 + [60.0] * 22
    flip = [0.0] * 12 + [-400.0] + [0.0] * 13
    lab = L.make_labels(label_series(spark, {"flood": flood, "erode": erode, "flip": flip}), 20.0).collect()
    at2 = {r["transect_id"]: r["y"] for r in lab if r["forecast_date"] == dt.date(2020, 1, 29)}
    assert at2["erode"] == 1 and at2["flood"] == 0
    assert all(r["y"] == 0 for r in lab if r["transect_id"] == "flip")


def test_labels_follow_their_rule(positions):
    lab = L.make_labels(positions, 20.0)
    r = lab.agg(F.avg("y").alias("p"), F.sum(((F.col("window_retreat_m") >= 20) & (F.col("permanent_retreat_m") >= 20)).cast("int") - F.col("y")).alias("off")).first()
    assert 0 < r["p"] < 0.6 and r["off"] == 0


def test_embargo_drops_rows_next_to_the_border(positions):
    lab = L.make_labels(positions, 20.0)
    plain = L.with_split(lab, [2019], [2020], [2021])
    strict = L.with_split(lab, [2019], [2020], [2021], embargo_days=60)
    assert 0 < strict.count() < plain.count()
    assert strict.where("split = 'train'").agg(F.max("forecast_date")).first()[0] <= dt.date(2019, 11, 1)


def test_curvature_does_not_depend_on_the_parts(spark):
    rng = np.random.default_rng(6)
    turn = np.cumsum(rng.normal(0, 0.9, 80))
    rows = [(f"{b}-{i}", b, 200.0 * (i + 40 * (i > 50)), float(np.cos(a)), float(np.sin(a))) for b in "WE" for i, a in enumerate(turn)]
    t = spark.createDataFrame(rows, "transect_id string, bank string, chainage_m double, nx double, ny double")
    got = {r["transect_id"]: r["baseline_curvature"] for r in FT.curvature(t, part_m=900.0, block=16).collect()}
    angle = np.unwrap(np.arctan2(np.sin(turn), np.cos(turn)))
    place = np.array([r[2] for r in rows[:80]]) / 1000
    for i in range(80):
        lo, hi = max(i - 5, 0), min(i + 5, 79)
        want = (angle[hi] - angle[lo]) / (place[hi] - place[lo])
        assert abs(got[f"W-{i}"] - want) < 1e-9 and abs(got[f"E-{i}"] + want) < 1e-9
    assert len(got) == 160
