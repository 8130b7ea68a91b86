import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from scarp.operators import alerts as AL
from scarp.operators import catalog as CT
from scarp.operators import explain as X
from scarp.operators import linear as G
from scarp.operators import panel as P
from scarp.operators import quality as Q
from scarp.operators import serving as A
from scarp.operators.features import feature_table
from scarp.sources import io


def test_cast_line(spark):
    v = spark.createDataFrame([("W", 0, 0.0, 1000.0), ("W", 1, 0.0, 0.0)], "bank string, seq int, x double, y double")
    t = G.cast_transects(G.line_measure(v), riverward=100.0, landward=300.0).orderBy("chainage_m").collect()
    assert len(t) == 6 and t[0]["transect_id"] == "W-00100"
    assert (t[0]["nx"], abs(t[0]["ny"])) == (-1.0, 0.0) and t[0]["xs"] > t[0]["xe"]
    # the other digitising direction gives the same transects
    flipped = G.cast_transects(G.line_measure(v.withColumn("seq", 1 - F.col("seq"))), riverward=100.0, landward=300.0).orderBy("chainage_m").collect()
    assert [r["y0"] for r in flipped] == [r["y0"] for r in t]
    e = G.cast_transects(G.line_measure(v.withColumn("bank", F.lit("E")))).first()
    assert e["nx"] == 1.0


def test_parts_of_a_line_give_the_whole_line(spark):
    """Gaps in the sequence, parts without a vertex, both directions: measures and segments do not depend on the parts."""
    rng = np.random.default_rng(4)
    rows = []
    for bank, south in (("W", 1), ("E", -1)):
        seq = np.sort(rng.choice(400, 90, replace=False))
        rows += [(bank, int(k), float(x), -30.0 * south * float(k)) for k, x in zip(seq, rng.normal(0, 50, 90))]
    v = spark.createDataFrame(rows, "bank string, seq int, x double, y double")
    for bank in "WE":
        pts = sorted((r for r in rows if r[0] == bank), key=lambda r: -r[3])
        want = np.cumsum([0.0] + [np.hypot(b[2] - a[2], b[3] - a[3]) for a, b in zip(pts, pts[1:])])
        m = G.line_measure(v, part=7)
        got = m.where(F.col("bank") == bank).orderBy("pos").collect()
        assert [r["seq"] for r in got] == [r[1] for r in pts] and np.allclose([r["m"] for r in got], want)
        seg = G.line_segments(m, part=7).where(F.col("bank") == bank).orderBy("ma").collect()
        assert np.allclose([r["mb"] for r in seg], want[1:]) and [r["xb"] for r in seg] == [r[2] for r in pts[1:]]


def test_grid_round_trip(spark):
    d = spark.createDataFrame([(3, 7)], "row int, col int")
    x, y = G.centre_of(F.col("row"), F.col("col"), F.lit(100.0), F.lit(900.0))
    r, c = G.cell_of(x, y, F.lit(100.0), F.lit(900.0))
    assert tuple(d.select(r, c).first()) == (3.0, 7.0)


def test_gauge_and_nearest(spark):
    passes = spark.createDataFrame([(10,), (20,)], "day int")
    series = spark.createDataFrame([(2, 1.0), (9, 4.0), (15, 6.0)], "day int, value double")
    got = {r["day"]: (r["gauge"], r["gauge_change_7d"]) for r in P.asof_series(passes, series).collect()}
    assert got == {10: (4.0, 3.0), 20: (6.0, 2.0)}


def test_gauges_of_many_reaches_across_time_ranges(spark):
    rng = np.random.default_rng(5)
    series = [(g, int(d), float(d % 17)) for g in "ab" for d in np.sort(rng.choice(3000, 25, replace=False))]
    passes = [(g, int(d)) for g in "abc" for d in np.sort(rng.choice(3000, 60, replace=False))]
    got = P.asof_series(spark.createDataFrame(passes, "reach string, day int"),
                        spark.createDataFrame(series, "reach string, day int, value double"), scope=["reach"], span_days=40)

    def last(reach, day):
        return next((v for g, d, v in reversed(series) if g == reach and d <= day), None)

    assert got.count() == len(passes)
    for r in got.collect():
        now, then = last(r["reach"], r["day"]), last(r["reach"], r["day"] - 7)
        assert r["gauge"] == now and r["gauge_change_7d"] == (None if now is None or then is None else now - then)


@pytest.fixture()
def pred(spark):
    d = dt.date(2024, 7, 1)
    rows = [("W-00100", d, 0.7, 1, 30.0), ("W-00300", d, 0.6, 2, 5.0), ("W-00500", d, 0.1, 30, 30.0), ("W-00700", d, 0.2, 31, None)]
    p = spark.createDataFrame(rows, "transect_id string, forecast_date date, p double, rank int, raw_last_change_m double")
    return p.withColumn("tier", A.assign_tiers(F.lit(0.5), 20.0, 20))


def test_tiers(pred):
    assert [r["tier"] for r in pred.orderBy("rank").collect()] == ["warning_eligible", "watch", "monitor", "none"]


def test_alert_flow(spark, pred):
    d = dt.date(2024, 7, 1)
    req = spark.createDataFrame([(1, d, "Chauhali", ["W-00100", "W-00300"]), (2, d, "Chauhali", ["W-00300"]), (3, d, "Chauhali", ["W-00100", "X-1"])],
                                "alert_id int, forecast_date date, place string, segment_ids array<string>")
    drafts = AL.draft_alerts(req, pred)
    got = {r["alert_id"]: r for r in drafts.collect()}
    assert got[1]["segment_ids"] == ["W-00100"] and got[1]["probability"] == 0.7
    assert (got[2]["status"], got[3]["status"], got[3]["unknown"]) == ("not eligible", "unknown segments", ["X-1"])
    dec = spark.createDataFrame([(1, 1, "approve", " x ", "Engineer"), (1, 2, "approve", "A. Rahman", "Engineer"), (1, 3, "approve", "Second", "Engineer")],
                                "alert_id int, ts int, decision string, official_name string, role string")
    done = AL.approve_alerts(drafts, dec)
    r = done.first()
    assert (r["status"], r["approved_by"], r["n_refused"]) == ("logged_not_sent", "A. Rahman", 1)
    people = spark.createDataFrame([("+8801712345678", "YES", "Chauhali"), ("+8801700000000", "no", "Chauhali")], "phone string, opt_in string, list_id string")
    m = AL.alert_messages(done.withColumn("list_id", F.col("place")), people).collect()
    assert len(m) == 2 and {x["kind"] for x in m} == {"sms", "voice"} and m[0]["to"] == "+880…78" and all("Chauhali" in x["body"] for x in m)


def test_rejection_is_final(spark, pred):
    d = dt.date(2024, 7, 1)
    req = spark.createDataFrame([(1, d, "x", ["W-00100"])], "alert_id int, forecast_date date, place string, segment_ids array<string>")
    dec = spark.createDataFrame([(1, 1, "reject", "Officer", "Engineer"), (1, 2, "approve", "Officer", "Engineer")], "alert_id int, ts int, decision string, official_name string, role string")
    r = AL.approve_alerts(AL.draft_alerts(req, pred), dec).first()
    assert r["status"] == "rejected" and r["approved_by"] is None


def test_reason_wording_rounds_half_to_even(spark):
    base = {f: None for f in ("ret_28_m", "ret_84_m", "raw_last_change_m", "ret_365_m", "dist_main_channel_m", "d_dist_main_28_m", "char_shield_frac",
                              "near_channel_width_m", "stage_change_12d", "nb_ret_84_m", "bank_height_m")}
    row = {**base, "ret_28_m": 62.5, "raw_last_change_m": 12.0, "ret_365_m": 1234.0, "dist_main_channel_m": 120.0, "d_dist_main_28_m": -90.0}
    d = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} double" for c in row))
    text = lambda g: d.select(X.reason_text(F.lit(g))).first()[0]
    assert text("recent_retreat") == "Bank retreated 62 m in the last 4 weeks; latest pass shows a further 12 m (unconfirmed)"
    assert text("history") == "Lost 1,234 m of bank over the past year"
    assert text("main_channel") == "Main flowing channel is 120 m from the bank and moved 90 m closer in 4 weeks"
    assert text("bank_height") is None and text("season") == "Monsoon season"


def test_no_leakage_and_a_planted_leak_is_found(positions, transects):
    names = ["ret_84_m", "ret_365_m", "n_obs_365", "stage_anom_km2", "embayment_m"]
    build = lambda rows: feature_table(rows, transects)
    cut = str(sorted({r[0] for r in positions.select("date").distinct().collect()})[40])
    r = Q.leakage_check(build, positions, "date", cut, names).first()
    assert r["rows_compared"] > 50 and r["unmatched"] == 0 and r["changed_values"] == 0

    def leaky(rows):
        return build(rows).withColumn("ret_84_m", F.col("ret_84_m") + rows.agg(F.max("bank_pos_m")).scalar())
    assert Q.leakage_check(leaky, positions, "date", cut, names).first()["changed_values"] > 0


def test_catalogue_helpers(spark):
    p = spark.createDataFrame([(f"S1A_IW_GRDH_1SDV_20240823T{t}_x",) for t in ("234459", "234500", "235959", "000000")], "product_id string")
    assert CT.products_in_window(p).count() == 2
    old = spark.createDataFrame([("a", 1), ("b", 2)], "pass_id string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "pass_id string, v int")
    assert sorted(map(tuple, CT.upsert_by_pass(old, new).collect())) == [("a", 1), ("b", 9), ("c", 3)]


def test_positions_reader_checks_the_schema(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([("a", float("nan"))], "transect_id string, bank_pos_m double").write.parquet(path)
    with pytest.raises(ValueError):
        io.read_positions(spark, path)
