"""Pass catalogue: product listing filters, grouping of slices into passes, incremental bookkeeping."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarp import config as C


def products_in_window(products: DataFrame, product: str = "product_id",
                       window: tuple[str, str] = C.PASS_UTC_WINDOW) -> DataFrame:
    """Products whose start time of day, in the fifth '_' token, lies in the window (both ends inclusive)."""
    hhmmss = F.substring(F.split(product, "_")[4], 10, 6)
    return products.where(hhmmss.between(*window))


def slices_over(slices: DataFrame, box: tuple[float, float, float, float], relative_orbit: int) -> DataFrame:
    """Slices of one track whose footprint box (xmin, ymin, xmax, ymax) touches the area box."""
    x0, y0, x1, y1 = box
    return slices.where((F.col("relative_orbit") == relative_orbit) & (F.col("xmin") <= x1) & (F.col("xmax") >= x0)
                        & (F.col("ymin") <= y1) & (F.col("ymax") >= y0))


def group_passes(slices: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per (platform, datatake); its slices in start order.

    A datatake has a handful of slices; listed copies of a slice combine map-side before any list is built.
    """
    once = slices.select("platform", "datatake", "start", *fields).distinct()
    g = once.groupBy("platform", "datatake").agg(
        F.sort_array(F.collect_list(F.struct("start", *fields))).alias("slices"))
    date = F.col("slices")[0]["start"].cast("date")
    return g.select(F.concat_ws("_", F.date_format(date, "yyyyMMdd"), "platform").alias("pass_id"),
                    date.alias("date"), "platform", "datatake", "slices")


def day_spine(bounds: DataFrame) -> DataFrame:
    """Every day from ``first`` to ``last``."""
    return bounds.select(F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias("date"))


def upsert_by_pass(old: DataFrame, new: DataFrame, key: str = "pass_id") -> DataFrame:
    """Rows of the new batch replace the old rows of their passes."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def passes_of_years(passes: DataFrame, years: Sequence[int]) -> DataFrame:
    return passes.where(F.year("date").isin(*years))


def pending_passes(inputs: DataFrame, results: DataFrame) -> DataFrame:
    """Passes without a result or with an input newer than it. inputs: (pass_id, input_ts), results: (pass_id, result_ts)."""
    return inputs.join(results, "pass_id", "left").where("result_ts IS NULL OR input_ts > result_ts").select("pass_id")
