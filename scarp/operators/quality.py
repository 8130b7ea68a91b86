"""Data-quality, validation and leak checks."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarp.functions.ordering import exact_percentiles


def pass_coverage(catalog: DataFrame, processed: DataFrame) -> DataFrame:
    """Passes in the catalogue against passes processed: one row."""
    both = catalog.select(F.lit(1).alias("c"), F.lit(0).alias("p")).unionByName(
        processed.select(F.lit(0).alias("c"), F.lit(1).alias("p")))
    return both.agg(F.sum("c").alias("passes_in_catalog"), F.sum("p").alias("passes_processed"))


def position_differences(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str = "bank_pos_m") -> DataFrame:
    return (a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), list(keys))
            .withColumn("diff", F.col("_a") - F.col("_b")).where("diff IS NOT NULL").drop("_a", "_b"))


def position_error(diffs: DataFrame, by: Sequence[str]) -> DataFrame:
    """n, median and 90th percentile of the absolute difference, mean signed difference per group."""
    d = diffs.withColumn("abs_err", F.abs("diff"))
    basic = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("diff").alias("mean_signed_err_m"))
    pct = exact_percentiles(d, by, "abs_err", {"median_abs_err_m": 0.5, "p90_abs_err_m": 0.9})
    if by:
        return basic.join(pct, list(by))
    return basic.withColumns({c: pct.select(c).scalar() for c in ("median_abs_err_m", "p90_abs_err_m")})


def offset_estimate(diffs: DataFrame, by: Sequence[str], azimuth_deg: float, min_proj: float = 0.5,
                    max_diff: float = 400.0) -> DataFrame:
    """Median shift along the look direction per pair; needs nx, ny, diff."""
    az = F.radians(F.lit(azimuth_deg))
    proj = F.col("nx") * F.sin(az) + F.col("ny") * F.cos(az)
    ok = diffs.withColumn("_proj", proj).where((F.abs("_proj") > min_proj) & (F.abs("diff") < max_diff))
    return exact_percentiles(ok.withColumn("_s", F.col("diff") / F.col("_proj")), by, "_s", {"shift_m": 0.5})


def corrected_height(shifts: DataFrame, gcp_height_m: float, incidence_deg: float) -> DataFrame:
    """Median over the pairs and the terrain height that explains it."""
    med = exact_percentiles(shifts, [], "shift_m", {"median_shift_m": 0.5})
    return med.withColumn("terrain_height_m", F.round(
        gcp_height_m - F.col("median_shift_m") * F.tan(F.radians(F.lit(incidence_deg))), 1))


def leakage_check(build: Callable[[DataFrame], DataFrame], rows: DataFrame, date: str, cut: str,
                  features: Sequence[str], tol: float = 1e-9) -> DataFrame:
    """Rebuild from rows up to ``cut`` and compare the rows of ``cut`` with the full build: one row of counts."""
    at = F.col("forecast_date") == F.lit(cut).cast("date")
    full = build(rows).where(at).select("transect_id", *[F.col(c).alias(f"a_{c}") for c in features], F.lit(1).alias("_a"))
    past = build(rows.where(F.col(date) <= F.lit(cut).cast("date"))).where(at).select(
        "transect_id", *[F.col(c).alias(f"b_{c}") for c in features], F.lit(1).alias("_b"))
    both = full.join(past, "transect_id", "full")

    def differs(c: str):
        a, b = F.col(f"a_{c}"), F.col(f"b_{c}")
        return F.when(a.isNull() != b.isNull(), 1).when(F.abs(a - b) > tol, 1).otherwise(0)

    bad = sum([differs(c) for c in features[1:]], differs(features[0]))
    return both.agg(F.count(F.lit(1)).alias("rows_compared"),
                    F.sum(F.when(F.col("_a").isNull() | F.col("_b").isNull(), 1).otherwise(0)).alias("unmatched"),
                    F.sum(bad).alias("changed_values"))


def mask_problems(have: DataFrame, want: DataFrame, width: int, height: int) -> DataFrame:
    """Problem rows: missing masks, wrong grid, unexpected values, low coverage, implausible water share."""
    missing = want.select("pass_id").join(have.select("pass_id"), "pass_id", "left_anti").select(
        "pass_id", F.lit("missing mask").alias("problem"))
    grid_ok = (F.col("width") == width) & (F.col("height") == height)
    # a wrong grid hides the other findings of that mask
    found = F.array_compact(F.when(~grid_ok, F.array(F.lit("wrong grid"))).otherwise(F.array(
        F.when(F.col("bad_values") > 0, F.lit("unexpected values")),
        F.when(F.col("coverage") < 0.5, F.lit("low coverage")),
        F.when(~F.col("water_fraction").between(0.05, 0.6), F.lit("implausible water fraction")))))
    return missing.unionByName(have.select("pass_id", F.explode(found).alias("problem")))


def split_disjoint(model: DataFrame, margin_days: int = 60) -> DataFrame:
    d = lambda s, c, f: f(F.when(F.col("split") == s, F.col(c)))
    return model.agg(d("train", "forecast_date", F.max).alias("last_train"),
                     d("train", "target_date", F.max).alias("last_train_target"),
                     d("test", "forecast_date", F.min).alias("first_test")).withColumns({
        "dates_disjoint": F.col("last_train") < F.col("first_test"),
        "targets_clear": F.col("last_train_target") < F.date_add("first_test", margin_days)})


def timing_summary(runs: DataFrame, total_s: str, sensed: str, ingested: str) -> DataFrame:
    """Median and maximum run time, median hours from sensing to ingestion: one row."""
    hours = (F.unix_micros(F.col(ingested)) - F.unix_micros(F.col(sensed))) / 3.6e9
    r = runs.withColumn("_lat", hours)
    n = r.agg(F.count(F.lit(1)).alias("n_runs"), F.max(total_s).alias("processing_max_s"))
    return n.withColumns({
        "processing_median_s": exact_percentiles(r, [], total_s, {"m": 0.5}).scalar(),
        "ingest_latency_median_h": exact_percentiles(r, [], "_lat", {"m": 0.5}).scalar()})
