"""Bank position queries: every image row serves as a transect of 64 samples."""
from __future__ import annotations

from pyspark.sql import functions as F

from scarp.operators import bankpos as B
from scarp.operators import raster as R
from scarp.operators import validation as V
from scarp.plans import q_raster
from scarp.plans.catalogue import register
from scarp.plans.fixtures import Inputs
from scarp.plans.sqltext import day, fragment

S0, STEP, NEAR, SHIELD, GUARD = -150.0, 10.0, 100.0, 300.0, 50.0
SETTINGS = {"min_px": 60, "bridge_px": 1, "radius": 1, "half_width": 60.0, "core_px": 2, "near_m": NEAR, "shield_m": SHIELD, "guard_m": GUARD}


def land(i: Inputs):
    """Masks with the distance of every pixel to the nearest pixel that is not water; NULL in an image of water only."""
    dry = F.coalesce(F.col("mask"), F.lit(0)) != 1
    return R.distance_to(i.masks(), dry, "land_dist")


def row_samples(i: Inputs):
    """Sample points of the transects: the pixels of every image row."""
    at = i.masks().select("row").distinct().select(F.col("row").alias("transect_id"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("sample"))
    return at.select("transect_id", "sample", F.col("transect_id").alias("row"), F.col("sample").alias("col"))


def samples(i: Inputs, width: bool = False):
    px = land(i) if width else i.masks()
    flag = F.coalesce("mask", F.lit(0))
    return px.select("img", F.col("row").alias("transect_id"), F.col("col").alias("sample"), flag.alias("belt"), flag.alias("water"),
                     F.col("mask").isNull().cast("int").alias("nodata"), *(["land_dist"] if width else []))


# nearest land in each column by windows both ways, then the nearest over the columns of a row
fragment("z_land0", """
SELECT *, least(row - last_value(lr IGNORE NULLS) OVER (PARTITION BY img, col ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(lr IGNORE NULLS) OVER (PARTITION BY img, col ORDER BY row ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - row) AS d
FROM (SELECT img, row, col, mask, CASE WHEN coalesce(mask, 0) <> 1 THEN row END AS lr FROM z_masks)""")
fragment("z_land", """
SELECT a.img, a.row, a.col, any_value(a.mask) AS mask, sqrt(min((a.col - b.col) ** 2 + b.d ** 2)) AS land_dist
FROM z_land0 a JOIN z_land0 b ON b.img = a.img AND b.row = a.row GROUP BY a.img, a.row, a.col""")
fragment("z_smp", "SELECT img, row AS transect_id, col AS sample, coalesce(mask, 0) AS belt, (mask IS NULL)::INT AS nodata, land_dist FROM z_land")
fragment("z_idx", """
SELECT img, transect_id, coalesce(max(sample) FILTER (n = 3), -1)::INT AS idx FROM (
  SELECT *, sum(belt) OVER (PARTITION BY img, transect_id ORDER BY sample ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM z_smp) GROUP BY ALL""")
fragment("z_bank", """
SELECT i.img, i.transect_id, i.idx, (i.idx >= 0 AND max(s.nodata) FILTER (s.sample >= CASE WHEN i.idx >= 0 THEN i.idx - 5 ELSE 0 END) = 0 AND max(s.belt) FILTER (s.sample = 63) = 0) AS ok,
  avg(s.belt) FILTER (s.sample BETWEEN i.idx - 10 AND i.idx) AS nearw, 1 - avg(s.belt) FILTER (s.sample BETWEEN i.idx - 30 AND i.idx) AS shield,
  20 * max(s.land_dist) FILTER (s.sample BETWEEN i.idx - 10 AND i.idx) AS width FROM z_idx i JOIN z_smp s USING (img, transect_id) GROUP BY i.img, i.transect_id, i.idx""")


def banks(i: Inputs, width: bool = False):
    return B.measure_banks(samples(i, width), S0, STEP, near_m=NEAR, shield_m=SHIELD, guard_m=GUARD)


@register("first_run_from_end", "SELECT * FROM z_idx")
def _(i):
    return B.first_run_from_land(samples(i))


@register("position_valid", "SELECT img, transect_id, idx, ok::INT AS valid, CASE WHEN ok THEN -150 + idx * 10.0::DOUBLE END AS bank_pos_m FROM z_bank")
def _(i):
    return banks(i).select("img", "transect_id", "idx", "valid", "bank_pos_m")


@register("dist_main_channel", """
WITH c AS (SELECT img, row, col FROM z_land WHERE mask = 1 AND coalesce(land_dist >= 2, true))
SELECT b.img, b.transect_id, round(10 * sqrt(min((c.row - b.transect_id) ** 2 + (c.col - b.idx) ** 2)), 6) AS dist_main_channel_m
FROM z_bank b LEFT JOIN c ON c.img = b.img WHERE ok GROUP BY b.img, b.transect_id""")
def _(i):
    px = land(i).withColumn("core", ((F.col("mask") == 1) & F.coalesce(F.col("land_dist") >= 2, F.lit(True))).cast("int"))
    pts = banks(i).where("valid = 1").select("img", "transect_id", F.col("transect_id").alias("row"), F.col("idx").alias("col"))
    return B.distance_to_core(pts, px, "core").select("img", "transect_id", "dist_main_channel_m")


@register("near_channel_width", "SELECT img, transect_id, CASE WHEN ok THEN round(width, 6) END AS near_channel_width_m FROM z_bank")
def _(i):
    return banks(i, True).select("img", "transect_id", "near_channel_width_m")


@register("nearbank_water_frac", "SELECT img, transect_id, CASE WHEN ok THEN round(nearw, 6) END AS nearbank_water_frac FROM z_bank")
def _(i):
    return banks(i).select("img", "transect_id", "nearbank_water_frac")


@register("char_shield_frac", "SELECT img, transect_id, CASE WHEN ok THEN round(shield, 6) + 0.0::DOUBLE END AS char_shield_frac FROM z_bank")
def _(i):
    return banks(i).select("img", "transect_id", "char_shield_frac")


@register("belt_area", """
SELECT e.img, round(sum(eroded) * 100 / 1e6, 6) AS belt_area_km2, round(count(*) FILTER (eroded = 1 AND mask = 1) * 100 / 1e6, 6) AS belt_water_km2
FROM z_eroded e JOIN z_masks m ON m.img = e.img AND m.row = e.row AND m.col = e.col GROUP BY 1""")
def _(i):
    return B.belt_area(R.erode(i.masks(), "mask", "belt").withColumn("water", F.col("mask")))


def bank_sql(src: str, burned: str) -> str:
    """CTEs down to ``bk`` (img, t, idx, ok, ...), ``dm`` and ``ar``: all that the masks ``src`` with land distances say of the banks."""
    return f"""
{q_raster.belt_sql(burned)},
sm AS MATERIALIZED (SELECT l.img, l.row AS t, l.col AS s, b.large AS belt, coalesce(l.mask, 0) AS water, (l.mask IS NULL)::INT AS nod, l.land_dist
  FROM {src} l JOIN la b ON b.img = l.img AND b.row = l.row AND b.col = l.col),
ix AS (SELECT img, t, coalesce(max(s) FILTER (n = 3), -1)::INT AS idx FROM (
  SELECT *, sum(belt) OVER (PARTITION BY img, t ORDER BY s ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM sm) GROUP BY ALL),
bk AS MATERIALIZED (SELECT i.img, i.t, i.idx, (i.idx >= 0 AND max(nod) FILTER (s >= CASE WHEN i.idx >= 0 THEN i.idx - 5 ELSE 0 END) = 0 AND max(belt) FILTER (s = 63) = 0) AS ok,
  avg(water) FILTER (s BETWEEN i.idx - 10 AND i.idx) AS nearw, 1 - avg(water) FILTER (s BETWEEN i.idx - 30 AND i.idx) AS shield,
  20 * max(land_dist) FILTER (s BETWEEN i.idx - 10 AND i.idx) AS width FROM ix i JOIN sm USING (img, t) GROUP BY i.img, i.t, i.idx),
dm AS (SELECT b.img, b.t, 10 * sqrt(min((c.row - b.t) ** 2 + (c.col - b.idx) ** 2)) AS d FROM bk b JOIN {src} c ON c.img = b.img
  WHERE ok AND c.mask = 1 AND coalesce(c.land_dist >= 2, true) GROUP BY b.img, b.t),
ar AS (SELECT img, sum(belt) * 100 / 1e6 AS a, count(*) FILTER (belt = 1 AND water = 1) * 100 / 1e6 AS w FROM sm GROUP BY img)"""


@register("bank_positions", f"""
WITH RECURSIVE {bank_sql('z_land', 'z_lined')}
SELECT bk.img, bk.t AS transect_id, bk.idx, ok::INT AS valid, CASE WHEN ok THEN -150 + bk.idx * 10.0::DOUBLE END AS bank_pos_m, round(d, 6) AS dist_main_channel_m,
  CASE WHEN ok THEN round(width, 6) END AS near_channel_width_m, CASE WHEN ok THEN round(shield, 6) + 0.0::DOUBLE END AS char_shield_frac,
  CASE WHEN ok THEN round(nearw, 6) END AS nearbank_water_frac, round(a, 6) AS belt_area_km2, round(w, 6) AS belt_water_km2
FROM bk JOIN ar ON ar.img = bk.img LEFT JOIN dm ON dm.img = bk.img AND dm.t = bk.t""")
def _(i):
    """Masks to positions in one operator; belt and water differ."""
    return B.bank_positions(i.masks(), row_samples(i), S0, STEP, line=q_raster.lines(i), **SETTINGS)


# --- masks against optical scenes ----------------------------------------------------------------------------------
def optical(i: Inputs):
    """An optical view of both images: no data on a grid of clouds, the mask as channel with every 13th place turned, less water."""
    r, c = F.col("row"), F.col("col")
    seen = (r * 5 + c) % 41 != 0
    channel = F.when((r * 7 + c * 3) % 13 == 0, 1 - F.coalesce("mask", F.lit(0))).otherwise(F.coalesce("mask", F.lit(0)))
    p = i.masks().withColumn("channel", F.when(seen, channel))
    return p.select("img", "row", "col", F.when((r + c) % 3 == 0, F.when(F.col("channel").isNotNull(), 0)).otherwise(F.col("channel")).alias("water"), "channel")


fragment("z_optical", """
SELECT img, row, col, mask, channel, CASE WHEN (row + col) % 3 = 0 THEN channel * 0 ELSE channel END AS water FROM (SELECT *,
  CASE WHEN (row * 5 + col) % 41 <> 0 THEN CASE WHEN (row * 7 + col * 3) % 13 = 0 THEN 1 - coalesce(mask, 0) ELSE coalesce(mask, 0) END END AS channel FROM z_masks)""")
fragment("z_sides", """
SELECT img || '/r' AS img, row, col, mask, mask AS burned, NULL::DOUBLE AS land_dist FROM z_optical
UNION ALL SELECT img || '/o', row, col, CASE WHEN mask IS NOT NULL THEN channel END, CASE WHEN mask IS NOT NULL THEN channel END, NULL FROM z_optical""")
_DIFF = f"""{bank_sql('z_sides', 'z_sides')},
df AS MATERIALIZED (SELECT a.img[1:2] AS img, a.t, 10.0::DOUBLE * (a.idx - b.idx) AS diff FROM bk a JOIN bk b ON a.t = b.t AND a.img[1:2] = b.img[1:2]
  WHERE a.img[3:4] = '/r' AND b.img[3:4] = '/o' AND a.ok AND b.ok),
ag AS MATERIALIZED (SELECT img, count(*) FILTER (mask = 1 AND water = 1) / greatest(count(*) FILTER (mask IS NOT NULL AND water IS NOT NULL AND (mask = 1 OR water = 1)), 1)::DOUBLE AS iou_water,
  count(*) FILTER (mask = 1 AND channel = 1) / greatest(count(*) FILTER (mask IS NOT NULL AND channel IS NOT NULL AND (mask = 1 OR channel = 1)), 1)::DOUBLE AS iou_active_channel,
  count(*) FILTER (mask IS NOT NULL AND water IS NOT NULL) / count(*)::DOUBLE AS valid_share FROM z_optical GROUP BY img)"""


def compared(i: Inputs):
    return V.compare_masks(i.masks(), optical(i), row_samples(i), S0, STEP, **SETTINGS)


@register("mask_validation", f"""
WITH RECURSIVE {_DIFF}
SELECT ag.img, round(iou_water, 6) AS iou_water, round(iou_active_channel, 6) AS iou_active_channel, round(valid_share, 6) AS valid_share, coalesce(n, 0) AS n_transects,
  med AS median_abs_err_m, p90 AS p90_abs_err_m, bias AS mean_signed_err_m FROM ag LEFT JOIN (SELECT img, count(*) AS n, round(quantile_cont(abs(diff), 0.5::DOUBLE), 6) AS med,
  round(quantile_cont(abs(diff), 0.9::DOUBLE), 6) AS p90, round(avg(diff), 6) + 0.0::DOUBLE AS bias FROM df GROUP BY img) e ON e.img = ag.img""")
def _(i):
    return compared(i)[0]


@register("mask_validation_summary", f"""
WITH RECURSIVE {_DIFF}
SELECT n_pairs, round(lo, 6) AS iou_min, round(hi, 6) AS iou_max, round(mid, 6) AS iou_median, round(wat, 6) AS iou_water_median, n AS n_transect_comparisons, round(med, 6) AS bank_error_median_m,
  round(p90, 6) AS bank_error_p90_m, round(bias, 6) + 0.0::DOUBLE AS bank_error_mean_signed_m, round(greatest(20, 2 * med), 6) AS label_threshold_m
FROM (SELECT count(*) AS n_pairs, min(iou_active_channel) AS lo, max(iou_active_channel) AS hi, quantile_cont(iou_active_channel, 0.5::DOUBLE) AS mid, quantile_cont(iou_water, 0.5::DOUBLE) AS wat FROM ag),
  (SELECT count(*) AS n, quantile_cont(abs(diff), 0.5::DOUBLE) AS med, quantile_cont(abs(diff), 0.9::DOUBLE) AS p90, avg(diff) AS bias FROM df)""")
def _(i):
    return V.validation_summary(*compared(i))


@register("assemble_positions", f"""
SELECT p.transect_id, p.pass_id, {day('s.date')} AS date, platform, round(water_area_km2, 6) AS water_area_km2, otsu_ok, round(coverage, 6) AS coverage, p.bank_pos_m
FROM z_panel p JOIN z_summary s USING (pass_id)""")
def _(i):
    return B.assemble_positions(i.panel().drop("date"), i.pass_summary()).select(
        "transect_id", "pass_id", "date", "platform", "water_area_km2", "otsu_ok", "coverage", "bank_pos_m")


@register("bank_height", f"""
WITH dem AS (SELECT transect_id, j.range AS sample, ((k * 31 + j.range * 17) % 101) / 10.0::DOUBLE AS z FROM z_sup, range(551) j),
p AS (SELECT transect_id, date, round_even((bank_pos_m + 1500) / 10, 0)::INT AS j FROM z_panel)
SELECT p.transect_id, {day('date')} AS date, round(avg(z) FILTER (sample BETWEEN j + 5 AND j + 30) - quantile_cont(z, 0.5::DOUBLE) FILTER (sample BETWEEN greatest(j - 200, 0) AND j - 21), 6) + 0.0::DOUBLE AS bank_height_m
FROM p JOIN dem USING (transect_id) WHERE sample BETWEEN j - 200 AND j + 30 GROUP BY p.transect_id, date""")
def _(i):
    dem = i.suppliers().select("transect_id", "k", F.explode(F.sequence(F.lit(0), F.lit(550))).alias("sample")).select(
        "transect_id", "sample", ((F.col("k") * 31 + F.col("sample") * 17) % 101 / 10.0).alias("z"))
    return B.bank_height(i.panel().drop("bank_height_m"), dem, -1500.0, 10.0).select("transect_id", "date", "bank_height_m")
