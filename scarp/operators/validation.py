"""Masks held against optical scenes: which pairs, how well they agree, and the label threshold that follows.

Passes and scenes are tables of one row each, so pairing is joins on days; pixels meet only for the pairs chosen.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scarp import config as C
from scarp.functions.ordering import exact_percentiles
from scarp.operators import bankpos as B
from scarp.operators import panel as P
from scarp.operators import quality as Q
from scarp.operators import raster as R
from scarp.session import settle

DRY_MONTHS = (11, 12, 1, 2, 3, 4)
FIRST_YEAR = 2017
MIN_COVERAGE = 0.95
MAX_DAYS, MAX_CLOUD, MAX_NODATA = 2, 5.0, 20.0
MAX_PAIRS = 16


def usable_passes(passes: DataFrame, used: DataFrame | None = None, months: Sequence[int] = DRY_MONTHS,
                  first_year: int = FIRST_YEAR, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Passes (pass_id, date, coverage) of the given months from ``first_year`` on with more than ``min_coverage``; those in
    ``used`` (pass_id, the ones a correction was fitted to) are left out. A pass without a date or coverage does not count."""
    ok = passes.where(F.month("date").isin(*months) & (F.year("date") >= first_year) & (F.col("coverage") > min_coverage))
    return ok if used is None else ok.join(used.select("pass_id"), "pass_id", "left_anti")


def clear_scenes(scenes: DataFrame, max_cloud: float = MAX_CLOUD, max_nodata: float = MAX_NODATA) -> DataFrame:
    """Scenes (scene_id, day, cloud, nodata) with at most ``max_cloud`` and less than ``max_nodata`` percent."""
    return scenes.where((F.col("cloud") <= max_cloud) & (F.col("nodata") < max_nodata))


def first_pass_per_scene(pairs: DataFrame) -> DataFrame:
    """One pair per scene: the first in pass order. A scene meets the passes of a few days only."""
    w = Window.partitionBy("scene_id").orderBy("pass_date", "pass_id")
    return pairs.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def spread_over_years(pairs: DataFrame, n: int = MAX_PAIRS) -> DataFrame:
    """Round-robin: the best pair of every year first, then the second best, ... ; ``n`` pairs, the feature of this step."""
    w = Window.partitionBy("year").orderBy("days_apart", "cloud", "scene_id")
    return (pairs.withColumn("year", F.year("pass_date")).withColumn("pick", F.row_number().over(w) - 1)
            .where(F.col("pick") < n).orderBy("pick", "year").limit(n))


def first_window(passes: DataFrame, months: int = 12, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Passes in the first ``months`` of the archive with enough coverage."""
    start = passes.agg(F.min("date")).scalar()
    return passes.where((F.col("date") < F.add_months(start, months)) & (F.col("coverage") > min_coverage))


def nearest_scenes(passes: DataFrame, scenes: DataFrame, max_days: int = MAX_DAYS) -> DataFrame:
    """The scene of each pass: fewest days apart, then least cloud, then smallest id. Passes without one drop out."""
    p = P.with_day(passes).select("pass_id", "day", F.col("date").alias("pass_date"))
    return P.nearest_in_tolerance(p, scenes, max_days, {"cloud": True, "scene_id": True}, "pass_id")


def validation_pairs(passes: DataFrame, scenes: DataFrame, used: DataFrame | None = None, n: int = MAX_PAIRS,
                     months: Sequence[int] = DRY_MONTHS, first_year: int = FIRST_YEAR) -> DataFrame:
    """Pairs (pass_id, scene_id, pass_date, days_apart, cloud, year, pick): usable passes, clear scenes, each scene once,
    spread over the years. Empty if nothing matches."""
    near = nearest_scenes(usable_passes(passes, used, months, first_year), clear_scenes(scenes))
    return spread_over_years(first_pass_per_scene(near), n).select(
        "pass_id", "scene_id", "pass_date", "days_apart", "cloud", "year", "pick")


def compare_masks(radar: DataFrame, optical: DataFrame, samples: DataFrame, s0: float, step: float, min_px: int,
                  **belt) -> tuple[DataFrame, DataFrame]:
    """(a row per pair, differences per pair and transect) of masks of the same grid.

    ``radar``: (img, row, col, mask), ``optical``: (img, row, col, water, channel), NULL for no data; ``img`` names the pair.
    IoU against open water and against the active channel; bank positions of both by the same belt and transects, the
    channel cut to where the radar saw something. Both position sets come from one run over twice the images. A pair without
    a common valid position has NULL errors and n 0. ``belt``: further settings of ``bank_positions``.
    """
    both = settle(radar.select("img", "row", "col", "mask").join(optical.select("img", "row", "col", "water", "channel"), ["img", "row", "col"]))
    a, w, c = F.col("mask") == 1, F.col("water") == 1, F.col("channel") == 1
    on = lambda x: F.col("mask").isNotNull() & F.col(x).isNotNull()
    n = lambda x: F.sum(F.coalesce(x, F.lit(False)).cast("long"))
    share = lambda k, x: n(on(k) & a & x) / F.greatest(n(on(k) & (a | x)), F.lit(1))
    agree = both.groupBy("img").agg(share("water", w).alias("iou_water"), share("channel", c).alias("iou_active_channel"),
                                    (n(on("water")) / F.count(F.lit(1))).alias("valid_share"))
    side = lambda name, value: both.select(F.struct(F.lit(name).alias("side"), "img").alias("key"), "row", "col", value.alias("mask"))
    sets = side("r", F.col("mask")).unionByName(side("o", F.when(F.col("mask").isNotNull(), F.col("channel"))))
    sets = sets.withColumn("img", F.to_json("key")).drop("key")
    pos = B.bank_positions(sets, samples, s0, step, min_px, **belt).select(
        F.from_json("img", "side string, img string").alias("key"), "transect_id", "bank_pos_m")
    pos = settle(pos.select("key.side", "key.img", "transect_id", "bank_pos_m"))
    diffs = settle(Q.position_differences(pos.where("side = 'r'").drop("side"), pos.where("side = 'o'").drop("side"), ["img", "transect_id"]))
    per = agree.join(Q.position_error(diffs, ["img"]).withColumnRenamed("n", "n_transects"), "img", "left")
    return per.withColumn("n_transects", F.coalesce("n_transects", F.lit(0))), diffs


def validation_summary(per_pair: DataFrame, diffs: DataFrame) -> DataFrame:
    """One row: pairs, IoU median and range, position error over all transects, and max(floor, 2 x median error)."""
    iou = per_pair.agg(F.count(F.lit(1)).alias("n_pairs"), F.min("iou_active_channel").alias("iou_min"), F.max("iou_active_channel").alias("iou_max"))
    mid = {k: exact_percentiles(per_pair, [], c, {k: 0.5}) for k, c in (("iou_median", "iou_active_channel"), ("iou_water_median", "iou_water"))}
    err = Q.position_error(diffs, [])
    names = {"n": "n_transect_comparisons", "median_abs_err_m": "bank_error_median_m", "p90_abs_err_m": "bank_error_p90_m",
             "mean_signed_err_m": "bank_error_mean_signed_m"}
    out = iou.withColumns({**{k: d.select(k).scalar() for k, d in mid.items()}, **{v: err.select(k).scalar() for k, v in names.items()}})
    return out.withColumn("label_threshold_m", F.greatest(F.lit(C.THRESHOLD_FLOOR_M), 2 * F.col("bank_error_median_m")))
