"""Pairs of passes and scenes by hand, and masks of known shift held against each other."""
import datetime as dt

import numpy as np
import pytest

from scarp.operators import validation as V
from tests.test_raster import pixels


def day(s):
    return dt.date.fromisoformat(s)


PASSES = "pass_id string, date date, coverage double, extra string"
SCENES = "scene_id long, day int, cloud double, nodata double, extra string"


def scene(no, date, cloud=1.0, nodata=0.0):
    return no, None if date is None else (day(date) - day("1970-01-01")).days, cloud, nodata, "x"


def test_pairs(spark):
    passes = [("a", day("2018-01-10"), 0.99, "x"), ("b", day("2018-01-12"), 0.99, "x"), ("low", day("2018-02-10"), 0.95, "x"),
              ("wet", day("2018-07-10"), 0.99, "x"), ("old", day("2016-01-10"), 0.99, "x"), ("used", day("2018-03-10"), 0.99, "x"),
              ("c", day("2019-01-10"), 0.96, "x"), ("far", day("2019-02-10"), 0.99, "x"), ("none", None, 0.99, "x"), ("blank", day("2019-03-01"), None, "x"),
              ("d", day("2018-12-20"), 0.99, "x")]
    scenes = [scene(1, "2018-01-11"), scene(2, "2018-01-09", 5.0), scene(3, "2018-02-10"), scene(4, "2018-07-10"), scene(5, "2016-01-10"),
              scene(6, "2018-03-10"), scene(7, "2019-01-10", 5.1), scene(8, "2019-01-12", 2.0), scene(9, "2019-01-08", 1.0, 20.0),
              scene(10, "2019-02-13"), scene(11, None), scene(12, "2019-03-01"), scene(13, "2018-12-20", None), scene(14, "2018-12-21", 3.0)]
    used = spark.createDataFrame([("used",), ("used",), ("else",)], "pass_id string")
    p, s = spark.createDataFrame(passes, PASSES), spark.createDataFrame(scenes, SCENES)
    got = [tuple(r) for r in V.validation_pairs(p, s, used).collect()]
    # scene 1 lies one day from both a and b: the first pass keeps it; scene 7 is too cloudy, 9 lacks data
    assert sorted(got) == [("a", 1, day("2018-01-10"), 1, 1.0, 2018, 0), ("c", 8, day("2019-01-10"), 2, 2.0, 2019, 0),
                           ("d", 14, day("2018-12-20"), 1, 3.0, 2018, 1)]
    assert [r[0] for r in V.validation_pairs(p, s, used, n=2).orderBy("pick", "year").collect()] == ["a", "c"]
    assert V.validation_pairs(p.where("false"), s).count() == 0 and V.validation_pairs(p, s.where("false")).count() == 0


def test_first_window(spark):
    p = spark.createDataFrame([("a", day("2018-01-31"), 0.99, ""), ("b", day("2019-01-30"), 0.96, ""), ("c", day("2019-01-31"), 0.99, ""),
                               ("d", day("2018-03-01"), 0.95, "")], PASSES)
    assert {r["pass_id"] for r in V.first_window(p).collect()} == {"a", "b"}


def test_masks_of_known_shift(spark):
    radar, water, channel = (np.zeros((30, 50), int) for _ in range(3))
    radar[:, 5:30] = 1
    channel[:, 5:33] = 1           # the optical bank lies three pixels landward
    channel[20:, 31:] = 0          # ... one pixel in the last ten rows
    water[:, 5:25] = 1
    water[0:2, 10:12] = channel[0:2, 10:12] = 255
    radar[29, 40] = 255            # the optical mask counts only where the radar saw something
    image = lambda a, name: pixels(spark, a, "p", name)
    keys = ["img", "row", "col"]
    lone = np.zeros((30, 50), int)
    rad = image(radar, "mask").unionByName(pixels(spark, lone, "q"))
    opt = image(water, "water").join(image(channel, "channel"), keys).unionByName(
        pixels(spark, lone, "q", "water").join(pixels(spark, lone, "q", "channel"), keys))
    at = spark.createDataFrame([(r, s, r, s) for r in range(30) for s in range(50)], "transect_id int, sample int, row int, col int")
    per, diffs = V.compare_masks(rad, opt, at, 0.0, 10.0, 100, bridge_px=1, radius=1, core_px=3, near_m=50.0, shield_m=100.0, guard_m=50.0)
    rows = {r["img"]: r for r in per.collect()}
    p, q = rows["p"], rows["q"]
    ok = (radar != 255) & (water != 255)
    assert p["valid_share"] == pytest.approx(ok.mean())
    assert p["iou_water"] == pytest.approx(((radar == 1) & (water == 1)).sum() / (ok & ((radar == 1) | (water == 1))).sum())
    assert p["iou_active_channel"] == pytest.approx(((radar == 1) & (channel == 1)).sum() / (ok & ((radar == 1) | (channel == 1))).sum())
    d = {r["transect_id"]: r["diff"] for r in diffs.collect()}
    assert d[15] == -30.0 and d[25] == -10.0 and len(d) == p["n_transects"] and 29 not in d
    values = np.array(list(d.values()))
    assert p["median_abs_err_m"] == pytest.approx(np.median(np.abs(values))) and p["mean_signed_err_m"] == pytest.approx(values.mean())
    assert q["n_transects"] == 0 and q["median_abs_err_m"] is None and q["iou_water"] == 0.0
    s = V.validation_summary(per, diffs).first()
    assert s["n_pairs"] == 2 and s["n_transect_comparisons"] == len(d) and s["iou_min"] == 0.0
    assert s["label_threshold_m"] == max(20.0, 2 * np.median(np.abs(values)))
