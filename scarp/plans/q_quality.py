"""Quality, validation and leak-control queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from scarp import config as C
from scarp.operators import features as FT
from scarp.operators import labels as L
from scarp.operators import quality as Q
from scarp.plans import q_geometry  # noqa: F401
from scarp.plans.catalogue import register
from scarp.plans.fixtures import TEST, TRAIN, VAL, Inputs
from scarp.plans.sqltext import day, fragment, r6

fragment("z_err", """
SELECT strftime(a.date, '%Y%m%d') AS pair, a.transect_id, a.bank_pos_m - b.bank_pos_m AS diff FROM (SELECT * FROM z_dup WHERE pass_id LIKE '%O') a
JOIN (SELECT * FROM z_dup WHERE pass_id LIKE '%F') b ON a.date = b.date AND a.transect_id = b.transect_id WHERE a.bank_pos_m - b.bank_pos_m IS NOT NULL""")


def differences(i: Inputs):
    """Two position sets of the same pass: line items of status O against status F."""
    d = i.panel_dup().withColumn("pair", F.date_format("date", "yyyyMMdd"))
    return Q.position_differences(d.where(F.col("pass_id").endswith("O")), d.where(F.col("pass_id").endswith("F")),
                                  ["pair", "transect_id"])


_PCT = "round(quantile_cont(abs(diff), 0.5::DOUBLE), 6) AS median_abs_err_m, round(quantile_cont(abs(diff), 0.9::DOUBLE), 6) AS p90_abs_err_m, round(avg(diff), 6) + 0.0::DOUBLE AS mean_signed_err_m"


@register("position_error", f"SELECT pair, count(*) AS n, {_PCT} FROM z_err GROUP BY pair")
def _(i):
    return Q.position_error(differences(i), ["pair"])


@register("validation_rollup", f"""
SELECT count(*) AS n, {_PCT}, count(DISTINCT pair) AS n_pairs, string_agg(DISTINCT pair[1:4], ',' ORDER BY pair[1:4]) AS years FROM z_err""")
def _(i):
    d = differences(i)
    pairs = d.groupBy("pair").agg(F.count(F.lit(1)).alias("k"))
    roll = pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.array_join(F.array_sort(F.collect_set(F.substring("pair", 1, 4))), ",").alias("years"))
    return Q.position_error(d, []).withColumns({c: roll.select(c).scalar() for c in ("n_pairs", "years")})


fragment("z_shift", """
SELECT pair, quantile_cont(diff / proj, 0.5::DOUBLE) AS shift_m FROM (SELECT pair, diff, nx * sin(radians(100)) + ny * cos(radians(100)) AS proj FROM z_err JOIN z_transects USING (transect_id))
WHERE abs(proj) > 0.5::DOUBLE AND abs(diff) < 400 GROUP BY pair""")


def shifts(i: Inputs):
    d = differences(i).join(i.transects().select("transect_id", "nx", "ny"), "transect_id")
    return Q.offset_estimate(d, ["pair"], 100.0)


@register("offset_estimate", f"SELECT pair, {r6('shift_m')} FROM z_shift")
def _(i):
    return shifts(i)


@register("offset_height", """
SELECT round(m, 6) + 0.0::DOUBLE AS median_shift_m, round(59.5::DOUBLE - m * tan(radians(38.5::DOUBLE)), 1) AS terrain_height_m FROM (SELECT quantile_cont(shift_m, 0.5::DOUBLE) AS m FROM z_shift)""")
def _(i):
    return Q.corrected_height(shifts(i), 59.5, 38.5)


def _leak(i: Inputs, build, cut: str):
    return Q.leakage_check(build, i.panel(), "date", cut, C.FEATURES)


def _cut(i: Inputs) -> str:
    return str(i.panel().where("date <= DATE'2000-06-30'").agg(F.max("date")).first()[0])


@register("leakage_check", "SELECT count(*) AS rows_compared, 0::BIGINT AS unmatched, 0::BIGINT AS changed_values FROM z_features WHERE forecast_date = (SELECT max(date) FROM z_cal WHERE date <= DATE '2000-06-30')")
def _(i):
    def build(rows):
        with_stage = rows.withColumn("belt_water_km2", F.col("n_items").cast("double"))
        return FT.feature_table(with_stage, i.transects())
    return _leak(i, build, _cut(i))


@register("leakage_planted", "SELECT count(*) AS rows_compared, 0::BIGINT AS unmatched, 1 AS caught FROM z_features WHERE forecast_date = (SELECT max(date) FROM z_cal WHERE date <= DATE '2000-06-30')")
def _(i):
    def build(rows):
        # a planted leak: the reference level uses all rows, later ones included
        level = rows.agg(F.avg("bank_pos_m")).scalar()
        with_stage = rows.withColumn("belt_water_km2", F.col("n_items").cast("double"))
        return FT.feature_table(with_stage, i.transects()).withColumn("ret_28_m", F.col("ret_28_m") - level)
    return _leak(i, build, _cut(i)).select("rows_compared", "unmatched", (F.col("changed_values") > 0).cast("int").alias("caught"))


@register("dq_masks", """
WITH h AS (SELECT *, CASE WHEN month(date) = 2 THEN 63 ELSE 64 END AS width, CASE WHEN day(date) = 1 THEN 2 ELSE 0 END AS bad FROM z_summary WHERE month(date) <> 7)
SELECT pass_id, 'missing mask' AS problem FROM z_summary WHERE month(z_summary.date) = 7 UNION ALL SELECT pass_id, 'wrong grid' FROM h WHERE width <> 64
UNION ALL SELECT pass_id, 'unexpected values' FROM h WHERE width = 64 AND bad > 0 UNION ALL SELECT pass_id, 'low coverage' FROM h WHERE width = 64 AND coverage < 0.85::DOUBLE - 0.35::DOUBLE
UNION ALL SELECT pass_id, 'implausible water fraction' FROM h WHERE width = 64 AND water_fraction NOT BETWEEN 0.05::DOUBLE AND 0.6::DOUBLE""")
def _(i):
    s = i.pass_summary()
    have = s.where(F.month("date") != 7).withColumns({
        "width": F.when(F.month("date") == 2, 63).otherwise(64), "height": F.lit(250),
        "bad_values": F.when(F.dayofmonth("date") == 1, 2).otherwise(0)})
    return Q.mask_problems(have, s, 64, 250)


@register("split_disjoint_check", f"""
WITH s AS (SELECT CASE WHEN year <= 1998 THEN 'train' WHEN year = 1999 THEN 'val' ELSE 'test' END AS split, * FROM z_model),
a AS (SELECT max(forecast_date) FILTER (split = 'train') AS lt, max(target_date) FILTER (split = 'train') AS tt, min(forecast_date) FILTER (split = 'test') AS ft FROM s)
SELECT {day('lt')} AS last_train, {day('tt')} AS last_train_target, {day('ft')} AS first_test, (lt < ft)::INT AS dates_disjoint, (tt < ft + 60)::INT AS targets_clear FROM a""")
def _(i):
    return Q.split_disjoint(L.with_split(i.model_table(), TRAIN, VAL, TEST))


@register("coverage_check", "SELECT (SELECT count(*) FROM z_cal) AS passes_in_catalog, (SELECT count(*) FROM z_summary WHERE otsu_ok = 1) AS passes_processed")
def _(i):
    return Q.pass_coverage(i.calendar(), i.pass_summary().where("otsu_ok = 1"))


@register("timing_summary", """
SELECT count(*) AS n_runs, max(value) AS processing_max_s, round(quantile_cont(value, 0.5::DOUBLE), 6) AS processing_median_s,
  round(quantile_cont((event_id % 400 + 30) / 60.0::DOUBLE, 0.5::DOUBLE), 6) AS ingest_latency_median_h FROM events WHERE event_type = 'purchase'""")
def _(i):
    e = i.table("events").where("event_type = 'purchase'").select("value", F.col("ts").cast("timestamp").alias("sensed"), (F.col("event_id") % 400 + 30).alias("minutes"))
    runs = e.withColumn("ingested", F.timestamp_micros(F.unix_micros("sensed") + F.col("minutes") * 60000000))
    return Q.timing_summary(runs, "value", "sensed", "ingested")
