"""Forward-looking labels that must persist, splits and the model table."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scarp import config as C
from scarp.functions.ordering import exact_percentiles
from scarp.operators import panel as P
from scarp.operators.lookback import Look, look_around


def label_components(positions: DataFrame, maps: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """b0, b1, bp for every (segment, pass) that has an observation and a target pass."""
    per_pass = P.first_per_pass(positions, ["bank_pos_m"], scope)
    seen = P.with_links(per_pass, maps, ["target"], scope)
    half = C.TARGET_HALF_DAYS
    then = {"at": "target", "within": (C.HORIZON_DAYS - C.TARGET_TOL_DAYS, C.HORIZON_DAYS + C.TARGET_TOL_DAYS)}
    g = look_around(seen, {
        "b0": Look("bank_pos_m", -C.CURRENT_DAYS, p=0.5),
        "b1": Look("bank_pos_m", -half, half, 0.5, **then),
        "bp": Look("bank_pos_m", 0, C.PERMANENT_DAYS, 0.25, C.PERMANENT_MIN, **then),
    }, scope, where="bank_pos_m")
    return g.where("target IS NOT NULL").select(*scope, "transect_id", "day", "target", "b0", "b1", "bp")


def make_labels(positions: DataFrame, threshold_m: float, major_m: float = C.MAJOR_M, scope: Sequence[str] = (),
                maps: DataFrame | None = None) -> DataFrame:
    if maps is None:
        maps = P.calendar_maps(P.pass_calendar(positions, scope), scope)
    r, p = F.col("b1") - F.col("b0"), F.col("bp") - F.col("b0")
    both = lambda t: ((F.col("window_retreat_m") >= t) & (F.col("permanent_retreat_m") >= t)).cast("int")
    return (label_components(positions, maps, scope)
            .withColumns({"window_retreat_m": r, "permanent_retreat_m": p})
            .where("window_retreat_m IS NOT NULL AND permanent_retreat_m IS NOT NULL")
            .select(*scope, "transect_id", F.date_from_unix_date("day").alias("forecast_date"),
                    F.date_from_unix_date("target").alias("target_date"),
                    F.least("window_retreat_m", "permanent_retreat_m").alias("retreat_m"),
                    "window_retreat_m", "permanent_retreat_m", both(threshold_m).alias("y"),
                    both(major_m).alias("major"), F.year(F.date_from_unix_date("day")).alias("year")))


def label_threshold(errors: DataFrame, error: str) -> DataFrame:
    """max(floor, 2 x median absolute position error)."""
    med = exact_percentiles(errors.select(F.abs(error).alias("_e")), [], "_e", {"median_abs_err_m": 0.5})
    return med.withColumn("label_threshold_m",
                          F.greatest(F.lit(C.THRESHOLD_FLOOR_M), 2 * F.col("median_abs_err_m")))


def split_column(year: Column, train: Sequence[int], val: Sequence[int], test: Sequence[int]) -> Column:
    return (F.when(year.isin(*train), "train").when(year.isin(*val), "val").when(year.isin(*test), "test"))


def with_split(df: DataFrame, train: Sequence[int], val: Sequence[int], test: Sequence[int],
               embargo_days: int = 0) -> DataFrame:
    """Temporal split by year. ``embargo_days`` drops rows whose outcome window reaches into the next split."""
    out = df.withColumn("split", split_column(F.col("year"), train, val, test)).where("split IS NOT NULL")
    if embargo_days:
        ahead = split_column(F.year(F.date_add("forecast_date", embargo_days)), train, val, test)
        out = out.where(F.coalesce(ahead, F.col("split")) == F.col("split"))
    return out


def label_stats(labels: DataFrame) -> DataFrame:
    # two levels: per date first (combined map-side), so the distinct count has no hot task
    per_date = labels.groupBy("split", "forecast_date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"), F.sum("major").alias("maj"))
    return per_date.groupBy("split").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("forecast_dates"),
        (F.sum("pos") / F.sum("n")).alias("positive_rate"), F.sum("maj").alias("major_events"))


def upstream_flag(df: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Upstream half of each bank: chainage up to the median of the bank's distinct chainages."""
    by = [*scope, "bank"]
    med = exact_percentiles(df.select(*by, "chainage_m").distinct(), by, "chainage_m", {"median_chainage_m": 0.5})
    # one row per bank and scope
    return df.join(med if scope else F.broadcast(med), by).withColumn(
        "upstream", F.col("chainage_m") <= F.col("median_chainage_m"))


def model_table(features: DataFrame, labels: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    keys = [*scope, "transect_id", "forecast_date"]
    return features.join(labels.select(*keys, "target_date", "retreat_m", "y", "major"), keys)


def positive_rate_by_month(labels: DataFrame) -> DataFrame:
    return labels.groupBy(F.month("forecast_date").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("positive_rate"))
