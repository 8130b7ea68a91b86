"""Whole steps: backscatter to masks, masks to bank positions, both against plain arrays."""
import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from scarp.operators import bankpos as B
from scarp.operators import masks as M
from tests.test_raster import distance, image, label, pixels


def cleaned(water, valid, most):
    out = water & valid
    for side in (True, False):
        lab, n = label(out if side else valid & ~out)
        for k in range(1, n + 1):
            if (lab == k).sum() <= most:
                out[lab == k] = not side
    return out


def test_masks_of_several_passes(spark):
    rng = np.random.default_rng(5)
    truth = np.zeros((70, 80), bool)
    truth[:, 20:50] = True
    vv = np.where(truth, -20.0, -9.0) + rng.normal(0, 1.5, truth.shape)
    vh = np.where(truth, -25.0, -15.0) + rng.normal(0, 1.5, truth.shape)
    vv[:6, :6] = np.nan
    vv[40, 30:33] = -12.5     # rough water: bright here, dark in the other band
    dark = np.full((12, 12), -25.0)
    none = np.full((12, 12), np.nan)
    px = None
    for img, a, b in (("full", vv, vh), ("small", dark, dark), ("empty", none, none)):
        one = pixels(spark, a, img, "vv").join(pixels(spark, b, img, "vh"), ["img", "row", "col"]).withColumn("water", F.lit("taken"))
        px = one if px is None else px.unionByName(one)
    got = M.pass_masks(px, speck_px=20, sample=1, tile=16)
    info = {r["img"]: r for r in got.info.collect()}
    full = info["full"]
    valid = ~np.isnan(vv)
    raw = valid & ((vv < full["t_vv"]) | ((vh < full["t_vh"]) & (vv < full["t_vv"] + 3)))
    pad = np.pad(raw, 1)
    er = np.all([pad[i:i + 70, j:j + 80] for i in range(3) for j in range(3)], axis=0)
    pad = np.pad(er, 1)
    want = cleaned(np.any([pad[i:i + 70, j:j + 80] for i in range(3) for j in range(3)], axis=0), valid, 20)
    mask = image(got.pixels.where("img = 'full'"), "mask", truth.shape)
    assert np.array_equal(mask, np.where(valid, want, np.nan), equal_nan=True) and (mask[valid] == truth[valid]).mean() > 0.97
    assert full["otsu_ok"] and full["rescued_fraction"] > 0 and abs(full["coverage"] - valid.mean()) < 1e-12
    assert abs(full["water_area_km2"] - want.sum() * 1e-4) < 1e-9
    assert not info["small"]["otsu_ok"] and info["small"]["t_vv"] == -15.0 and info["small"]["water_fraction"] == 1.0
    assert info["empty"]["coverage"] == 0 and info["empty"]["water_fraction"] == 0 and not info["empty"]["otsu_ok"]
    passes = spark.createDataFrame([("full", dt.date(2020, 1, 2), "A"), ("gone", dt.date(2020, 1, 9), "A")], "pass_id string, date date, platform string")
    row = M.mask_summary(got.info, passes).collect()
    assert [r["pass_id"] for r in row] == ["full"] and row[0]["t_vh"] == full["t_vh"]


def test_masks_without_rows(spark):
    got = M.pass_masks(spark.createDataFrame([], "img string, row int, col int, vv double, vh double"))
    assert got.pixels.count() == 0 and got.info.count() == 0


def test_positions_from_masks(spark):
    """A river with an island: the island belongs to the belt and counts as land in the shares; the lake outside does not."""
    a = np.zeros((60, 64), int)
    a[:, 5:40] = 1
    a[20:40, 30:36] = 0            # island near the bank
    a[50, 36:39] = 255             # no data near the bank of row 50
    a[10:13, 50:54] = 1            # pond
    lake = np.zeros((60, 64), int)
    at = spark.createDataFrame([(f"t{r}", s, r, s) for r in range(60) for s in range(64)], "transect_id string, sample int, row int, col int")
    px = pixels(spark, a, "river").unionByName(pixels(spark, lake, "dry"))
    got = {(r["img"], r["transect_id"]): r for r in B.bank_positions(
        px, at, -100.0, 10.0, 200, None, bridge_px=1, radius=1, core_px=3, near_m=60.0, shield_m=120.0, guard_m=50.0).collect()}
    assert len(got) == 120
    assert all(r["valid"] == 0 and r["bank_pos_m"] is None and r["belt_area_km2"] == 0 for (img, _), r in got.items() if img == "dry")
    plain, island, blind, pond = (got["river", t] for t in ("t5", "t30", "t50", "t11"))
    assert blind["valid"] == 0 and blind["bank_pos_m"] is None and blind["dist_main_channel_m"] is None
    for r in (plain, island, pond):
        assert r["valid"] == 1 and r["idx"] == 39 and r["bank_pos_m"] == 290.0
    water = a == 1
    land = distance(~water)
    core = distance(land >= 3) * 10
    for r, k in ((plain, 5), (island, 30), (pond, 11)):
        assert abs(r["near_channel_width_m"] - 20 * land[k, 33:40].max()) < 1e-9 and abs(r["dist_main_channel_m"] - core[k, 39]) < 1e-9
        assert abs(r["nearbank_water_frac"] - water[k, 33:40].mean()) < 1e-12 and abs(r["char_shield_frac"] - (1 - water[k, 27:40].mean())) < 1e-12
    assert island["char_shield_frac"] > 0 and plain["belt_area_km2"] > plain["belt_water_km2"] > 0
