"""Panel, as-of, stage, feature and label queries."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scarp import config as C
from scarp.operators import features as FT
from scarp.operators import labels as L
from scarp.operators import panel as P
from scarp.operators import validation as V
from scarp.plans import sql_panel  # noqa: F401
from scarp.plans.catalogue import register
from scarp.plans.fixtures import MAJOR_M, TEST, THRESHOLD_M, TRAIN, VAL, Inputs
from scarp.plans.sqltext import day, r6


def _maps(i: Inputs):
    return i.maps()


def _grid(i: Inputs):
    per = P.first_per_pass(i.panel(), FT.FACT_COLUMNS)
    return P.complete_panel(per, P.pass_calendar(i.panel()), FT.FACT_COLUMNS)


def _date(c: str = "day", name: str = "date"):
    return F.date_from_unix_date(c).alias(name)


def _robust(i: Inputs):
    return FT.robust_panel(i.panel(), _maps(i))


@register("panel_dedup_first", f"""
SELECT transect_id, {day('date')} AS date, arg_min(bank_pos_m, pass_id) FILTER (bank_pos_m IS NOT NULL) AS bank_pos_m
FROM z_dup GROUP BY transect_id, date""")
def _(i):
    return P.first_per_pass(i.panel_dup(), ["bank_pos_m"]).select("transect_id", _date(), "bank_pos_m")


@register("panel_complete", f"""
SELECT t.transect_id, {day('c.date')} AS date, p.bank_pos_m FROM z_sup t CROSS JOIN z_cal c
LEFT JOIN z_panel p ON p.transect_id = t.transect_id AND p.date = c.date""")
def _(i):
    per = P.first_per_pass(i.panel(), ["bank_pos_m"])
    return P.complete_panel(per, P.pass_calendar(i.panel()), ["bank_pos_m"], entities=i.transects()).select(
        "transect_id", _date(), "bank_pos_m")


@register("win_median_24d", f"SELECT transect_id, {day('date')} AS date, {r6('b0')} FROM z_robust")
def _(i):
    b = F.when(F.col("bank_pos_m").isNotNull(), P.frame_percentile("bank_pos_m", 0.5, -C.CURRENT_DAYS, 0))
    return _grid(i).withColumn("b0", b).select("transect_id", _date(), "b0")


@register("win_q25_180d", f"SELECT transect_id, {day('date')} AS date, {r6('perm')} FROM z_robust")
def _(i):
    q = P.frame_percentile("bank_pos_m", 0.25, -C.PERMANENT_DAYS, 0, C.PERMANENT_MIN)
    return _grid(i).withColumn("perm", q).select("transect_id", _date(), "perm")


_BACKS = {**C.LAGS, **C.STAGE_LAGS}


@register("asof_back_index", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT {day('c.date')} AS date, {d} AS days, {day('m.date_k')} AS date_k FROM z_cal c LEFT JOIN z_back{d} m USING (date)"
    for d in _BACKS) + ")")
def _(i):
    arms = F.explode(F.array(*[F.struct(F.lit(d).alias("days"), F.col(f"back_{d}").alias("k")) for d in _BACKS]))
    return _maps(i).select(_date(), arms.alias("m")).select("date", "m.days", _date("m.k", "date_k"))


@register("asof_forward_index",
          f"SELECT {day('c.date')} AS date, {day('m.target_date')} AS target_date FROM z_cal c LEFT JOIN z_target m USING (date)")
def _(i):
    return _maps(i).select(_date(), _date("target", "target_date"))


@register("asof_diff", f"""
SELECT transect_id, {day('date')} AS forecast_date, {r6('ret_28_m', 'ret_56_m', 'ret_84_m', 'ret_365_m', 'd_dist_main_28_m')}
FROM z_feat_base""")
def _(i):
    return i.features().select("transect_id", "forecast_date", "ret_28_m", "ret_56_m", "ret_84_m", "ret_365_m",
                               "d_dist_main_28_m")


@register("last_change", f"""
SELECT g.transect_id, {day('g.date')} AS date, g.bank_pos_m - p.bank_pos_m AS raw_last_change_m FROM z_grid g
LEFT JOIN z_prev m USING (date) LEFT JOIN z_grid p ON p.transect_id = g.transect_id AND p.date = m.prev""")
def _(i):
    prev = P.value_at("bank_pos_m", "prev", -C.LAST_CHANGE_MAX_DAYS, -1)
    return (P.attach_maps(_grid(i), _maps(i).select("day", "prev")).withColumn("_p", prev)
            .select("transect_id", _date(), (F.col("bank_pos_m") - F.col("_p")).alias("raw_last_change_m")))


@register("count_obs_365", f"SELECT transect_id, {day('date')} AS date, n_obs_365 FROM z_robust")
def _(i):
    return _grid(i).withColumn("n_obs_365", P.frame_count("bank_pos_m", -364, 0)).select(
        "transect_id", _date(), "n_obs_365")


@register("neighbour_mean", f"""
SELECT transect_id, {day('forecast_date')} AS forecast_date, {r6('nb_ret_84_m', 'nb_ret_365_m', 'embayment_m')} FROM z_features""")
def _(i):
    return i.features().select("transect_id", "forecast_date", "nb_ret_84_m", "nb_ret_365_m", "embayment_m")


def gauge(i: Inputs):
    d = F.col("o_orderdate").cast("date")
    return (i.table("orders").where(~F.dayofweek(d).isin(1, 7)).groupBy(F.unix_date(d).alias("day"))
            .agg(F.count(F.lit(1)).cast("double").alias("value")))


@register("asof_join_gauge", f"""
WITH g AS (SELECT o_orderdate::DATE AS d, count(*)::DOUBLE AS v FROM orders WHERE isodow(o_orderdate) < 6 GROUP BY 1),
n AS (SELECT c.date, arg_max(g.v, g.d) AS gauge FROM z_cal c LEFT JOIN g ON g.d <= c.date GROUP BY c.date),
p AS (SELECT c.date, arg_max(g.v, g.d) AS past FROM z_cal c LEFT JOIN g ON g.d <= c.date - 7 GROUP BY c.date)
SELECT {day('n.date')} AS date, gauge, gauge - past AS gauge_change_7d FROM n JOIN p USING (date)""")
def _(i):
    return P.asof_series(P.pass_calendar(i.panel()), gauge(i)).select(_date(), "gauge", "gauge_change_7d")


@register("asof_join_gauges", f"""
WITH g AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN 'W' ELSE 'E' END AS reach, o_orderdate::DATE AS d, count(*)::DOUBLE AS v
  FROM orders WHERE isodow(o_orderdate) < 6 AND o_custkey % 5 < 2 GROUP BY ALL),
c AS (SELECT DISTINCT substr(transect_id, 1, 1) AS reach, date FROM z_panel),
n AS (SELECT c.reach, c.date, arg_max(g.v, g.d) AS gauge FROM c LEFT JOIN g ON g.reach = c.reach AND g.d <= c.date GROUP BY c.reach, c.date),
p AS (SELECT c.reach, c.date, arg_max(g.v, g.d) AS past FROM c LEFT JOIN g ON g.reach = c.reach AND g.d <= c.date - 7 GROUP BY c.reach, c.date)
SELECT reach, {day('n.date')} AS date, gauge, gauge - past AS gauge_change_7d FROM n JOIN p USING (reach, date)""")
def _(i):
    d = F.col("o_orderdate").cast("date")
    series = (i.table("orders").where(~F.dayofweek(d).isin(1, 7) & (F.col("o_custkey") % 5 < 2))
              .groupBy(F.when(F.col("o_custkey") % 2 == 0, "W").otherwise("E").alias("reach"), F.unix_date(d).alias("day"))
              .agg(F.count(F.lit(1)).cast("double").alias("value")))
    passes = P.pass_calendar(i.panel().withColumn("reach", F.substring("transect_id", 1, 1)), ["reach"])
    return P.asof_series(passes, series, scope=["reach"]).select("reach", _date(), "gauge", "gauge_change_7d")


def scenes(i: Inputs):
    d = F.col("o_orderdate").cast("date")
    return i.table("orders").select(
        F.col("o_orderkey").alias("scene_id"), d.alias("scene_date"), F.unix_date(d).alias("day"),
        F.round(F.pmod(F.col("o_totalprice"), F.lit(100.0)), 2).alias("cloud"), (F.col("o_custkey") % 30).alias("nodata"))


def _pairs(i: Inputs):
    return V.nearest_scenes(i.pass_summary(), V.clear_scenes(scenes(i)))


_SCENES = """sc AS (SELECT o_orderkey AS scene_id, o_orderdate::DATE AS sd, round(o_totalprice % 100, 2) AS cloud, o_custkey % 30 AS nodata
  FROM orders WHERE round(o_totalprice % 100, 2) <= 5 AND o_custkey % 30 < 20),
pr AS (SELECT * FROM (SELECT strftime(c.date, '%Y%m%d') || '_P' AS pass_id, c.date AS pass_date, sc.*, abs(date_diff('day', sd, c.date))::INT AS days_apart,
  row_number() OVER (PARTITION BY c.date ORDER BY abs(date_diff('day', sd, c.date)), cloud, scene_id) AS rn
  FROM z_cal c JOIN sc ON abs(date_diff('day', sd, c.date)) <= 2) WHERE rn = 1)"""


@register("nearest_in_tolerance", f"WITH {_SCENES} SELECT pass_id, scene_id, days_apart, cloud FROM pr")
def _(i):
    return _pairs(i).select("pass_id", "scene_id", "days_apart", "cloud")


@register("dedup_keep_first", f"""WITH {_SCENES} SELECT scene_id, min(pass_id) AS pass_id, min(days_apart) FILTER (pass_date = fd) AS days_apart
FROM (SELECT *, min(pass_date) OVER (PARTITION BY scene_id) AS fd FROM pr) GROUP BY scene_id""")
def _(i):
    return V.first_pass_per_scene(_pairs(i)).select("scene_id", "pass_id", "days_apart")


@register("round_robin_sample", f"""WITH {_SCENES},
dd AS (SELECT * FROM (SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY scene_id ORDER BY pass_date, pass_id) AS r1 FROM pr) WHERE r1 = 1)
SELECT pass_id, scene_id, year(pass_date)::INT AS year,
  (row_number() OVER (PARTITION BY year(pass_date) ORDER BY days_apart, cloud, scene_id) - 1)::INT AS pick
FROM dd ORDER BY 4, 3 LIMIT 16""")
def _(i):
    return V.spread_over_years(V.first_pass_per_scene(_pairs(i)), 16).select("pass_id", "scene_id", "year", "pick")


@register("scene_filter", """
SELECT o_orderkey AS scene_id, round(o_totalprice % 100, 2) AS cloud, o_custkey % 30 AS nodata FROM orders
WHERE round(o_totalprice % 100, 2) <= 5 AND o_custkey % 30 < 20 AND month(o_orderdate) IN (11, 12, 1, 2, 3, 4) AND year(o_orderdate) >= 1997
AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount >= 0.1::DOUBLE AND l_returnflag = 'R')""")
def _(i):
    used = i.table("lineitem").where("l_discount >= 0.1D AND l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("scene_id"))
    ok = scenes(i).where(F.month("scene_date").isin(11, 12, 1, 2, 3, 4) & (F.year("scene_date") >= 1997)
                         & (F.col("cloud") <= 5) & (F.col("nodata") < 20))
    return ok.join(used, "scene_id", "left_anti").select("scene_id", "cloud", "nodata")


# passes of more than 95 % coverage, dry months, from 1994 on; those whose number is a multiple of 11 served a correction
@register("validation_pairs", """
WITH ps AS (SELECT pass_id, date FROM z_summary WHERE coverage > 0.95::DOUBLE AND month(date) IN (11, 12, 1, 2, 3, 4) AND year(date) >= 1994
  AND date_diff('day', DATE '1992-01-01', date) % 11 <> 0),
sc AS (SELECT o_orderkey AS scene_id, o_orderdate::DATE AS sd, round(o_totalprice % 100, 2) AS cloud FROM orders
  WHERE round(o_totalprice % 100, 2) <= 5 AND o_custkey % 30 < 20),
pr AS (SELECT pass_id, date, scene_id, cloud, abs(date_diff('day', sd, date))::INT AS days_apart FROM ps JOIN sc ON sd BETWEEN date - 2 AND date + 2
  QUALIFY row_number() OVER (PARTITION BY pass_id ORDER BY abs(date_diff('day', sd, date)), cloud, scene_id) = 1),
dd AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY date, pass_id) = 1)
SELECT pass_id, scene_id, strftime(date, '%Y-%m-%d') AS pass_date, days_apart, cloud, year(date)::INT AS year,
  (row_number() OVER (PARTITION BY year(date) ORDER BY days_apart, cloud, scene_id) - 1)::INT AS pick FROM dd ORDER BY 7, 6 LIMIT 16""")
def _(i):
    passes = i.pass_summary()
    used = passes.where(F.datediff("date", F.lit("1992-01-01").cast("date")) % 11 == 0)
    return V.validation_pairs(passes, scenes(i), used, first_year=1994)


@register("first_window_select", f"""
SELECT pass_id, {day('date')} AS date, {r6('coverage')} FROM z_summary
WHERE date < (SELECT min(date) FROM z_summary) + INTERVAL 12 MONTH AND coverage > 0.95::DOUBLE""")
def _(i):
    return V.first_window(i.pass_summary()).select("pass_id", "date", "coverage")


sql_panel.fragment("z_summary", """
SELECT strftime(date, '%Y%m%d') || '_P' AS pass_id, date, CASE WHEN b % 2 = 0 THEN 'S1A' ELSE 'S1B' END AS platform,
  1 - (b % 23) / 100.0::DOUBLE AS coverage, -15.0::DOUBLE + (b % 9) / 2.0::DOUBLE AS t_vv, CASE WHEN b % 9 <= 6 THEN 1 ELSE 0 END AS otsu_ok,
  (b % 80) / 100.0::DOUBLE AS water_fraction, q / 10.0::DOUBLE AS water_area_km2, n::DOUBLE AS belt_water_km2
FROM (SELECT b, date, count(*) AS n, sum(l_quantity) AS q FROM z_items GROUP BY b, date)""")


@register("revisit_gaps", f"""
SELECT {day('date')} AS date, gap FROM (SELECT date, date_diff('day', lag(date) OVER (ORDER BY date), date)::INT AS gap FROM z_cal) WHERE gap > 24""")
def _(i):
    gap = F.col("day") - F.lag("day").over(Window.orderBy("day"))   # calendar-sized
    return P.pass_calendar(i.panel()).withColumn("gap", gap).where("gap > 24").select(_date(), "gap")


@register("cloudy_pair_best", f"""
WITH c AS (SELECT o_orderkey AS scene_id, o_orderdate::DATE AS sd, round(o_totalprice % 100, 2) AS cloud FROM orders
  WHERE round(o_totalprice % 100, 2) BETWEEN 85 AND 99 AND o_custkey % 30 <= 20),
n AS (SELECT c.*, z.date, abs(date_diff('day', sd, z.date)) AS gap, row_number() OVER (PARTITION BY scene_id ORDER BY abs(date_diff('day', sd, z.date)), z.date) AS rn
  FROM c JOIN z_cal z ON abs(date_diff('day', sd, z.date)) <= 2)
SELECT scene_id, {day('sd')} AS scene_date, cloud, {day('date')} AS pass_date, gap::INT AS gap FROM n WHERE rn = 1 ORDER BY n.cloud DESC, n.gap, n.scene_id LIMIT 1""")
def _(i):
    cloudy = scenes(i).where("cloud BETWEEN 85 AND 99 AND nodata <= 20")
    passes = P.pass_calendar(i.panel()).withColumn("pass_day", F.col("day"))
    near = P.nearest_in_tolerance(cloudy, passes, 2, {"pass_day": True}, "scene_id")
    return (near.orderBy(F.desc("cloud"), "days_apart", "scene_id").limit(1)
            .select("scene_id", "scene_date", "cloud", _date("right_day", "pass_date"),
                    F.col("days_apart").alias("gap")))


@register("stage_per_pass", f"""
SELECT {day('date')} AS date, arg_min(n_items, (pass_id, transect_id))::DOUBLE AS stage_km2 FROM z_dup_raw GROUP BY date""")
def _(i):
    d = i.panel_dup().withColumns({"belt_water_km2": F.col("n_items").cast("double"),
                                   "pass_id": F.struct("pass_id", "transect_id")})
    return FT.stage_per_pass(d).select(_date(), "stage_km2")


@register("stage_change", f"SELECT {day('date')} AS date, stage_km2, stage_change_12d, stage_change_24d FROM z_stagef")
def _(i):
    return FT.stage_features(i.stage()).select(_date(), "stage_km2", "stage_change_12d", "stage_change_24d")


@register("stage_anomaly", f"SELECT {day('date')} AS date, {r6('stage_anom_km2')} FROM z_stagef")
def _(i):
    return FT.stage_features(i.stage()).select(_date(), "stage_anom_km2")


@register("season_encode", f"""
SELECT {day('date')} AS date, round(sin(dayofyear(date) * (2 * pi() / 365.25::DOUBLE)), 6) + 0.0::DOUBLE AS doy_sin,
  round(cos(dayofyear(date) * (2 * pi() / 365.25::DOUBLE)), 6) + 0.0::DOUBLE AS doy_cos, year(date)::INT AS year FROM z_cal""")
def _(i):
    from scarp.functions.columns import day_angle
    d = F.col("date")
    return P.pass_calendar(i.panel()).select(_date()).select(
        "date", F.sin(day_angle(d)).alias("doy_sin"), F.cos(day_angle(d)).alias("doy_cos"), F.year(d).alias("year"))


@register("inundation", f"""
SELECT transect_id, {day('date')} AS forecast_date, {r6('inundation_m')} FROM z_feat_base""")
def _(i):
    return _robust(i).where("b0 IS NOT NULL").select(
        "transect_id", _date(name="forecast_date"), (F.col("b0") - F.col("perm")).alias("inundation_m"))


@register("feature_table", f"""
SELECT transect_id, {day('forecast_date')} AS forecast_date, {r6(*C.FEATURES)}, {r6('bank_pos_m', 'raw_bank_pos_m')}, bank, chainage_m, year
FROM z_features""")
def _(i):
    return i.build_features()


_UNPIVOT = ", ".join(C.FEATURES)


@register("feature_describe", f"""
WITH u AS (UNPIVOT (SELECT {_UNPIVOT} FROM z_features) ON {_UNPIVOT} INTO NAME feature VALUE value)
SELECT f.feature, coalesce(n, 0) AS n, {r6('mean', 'median')} FROM (SELECT unnest([{', '.join(f"'{f}'" for f in C.FEATURES)}]) AS feature) f
LEFT JOIN (SELECT feature, count(value) AS n, avg(value) AS mean, quantile_cont(value, 0.5::DOUBLE) AS median FROM u GROUP BY feature) x USING (feature)""")
def _(i):
    return FT.feature_describe(i.features())


@register("feature_coverage_corr", f"""
WITH u AS (FROM (SELECT retreat_m AS t, {', '.join(f'round({c}, 9) AS {c}' for c in C.FEATURES)} FROM z_model) UNPIVOT INCLUDE NULLS (value FOR feature IN ({_UNPIVOT}))),
s AS (SELECT feature, count(value) / count(*)::DOUBLE AS share FROM u GROUP BY feature),
k AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS rv,
  rank() OVER (PARTITION BY feature ORDER BY t) + (count(*) OVER (PARTITION BY feature, t) - 1) / 2.0::DOUBLE AS rt FROM u WHERE value IS NOT NULL),
c AS (SELECT feature, corr(rv, rt) AS spearman FROM k GROUP BY feature)
SELECT feature, {r6('share')}, CASE WHEN isnan(spearman) THEN NULL ELSE round(spearman, 5) + 0.0::DOUBLE END AS spearman FROM s LEFT JOIN c USING (feature)""")
def _(i):
    # nine decimals, so that rounding noise does not split tied ranks
    table = i.model_table().select("retreat_m", *[F.round(c, 9).alias(c) for c in C.FEATURES])
    return FT.coverage_and_rank_correlation(table, C.FEATURES, "retreat_m").withColumn(
        "spearman", F.round("spearman", 5))


@register("label_components",
          f"SELECT transect_id, {day('date')} AS date, {day('target_date')} AS target_date, {r6('b0', 'b1', 'bp')} FROM z_comp")
def _(i):
    return L.label_components(i.panel(), _maps(i)).select(
        "transect_id", _date(), _date("target", "target_date"), "b0", "b1", "bp")


@register("make_labels", f"""
SELECT transect_id, {day('forecast_date')} AS forecast_date, {day('target_date')} AS target_date,
{r6('retreat_m', 'window_retreat_m', 'permanent_retreat_m')}, y, major, year FROM z_labels""")
def _(i):
    return i.build_labels()


@register("label_threshold", f"""
WITH m AS (SELECT quantile_cont(abs(inundation_m), 0.5::DOUBLE) AS median_abs_err_m FROM z_feat_base)
SELECT {r6('median_abs_err_m')}, round(greatest(20, 2 * median_abs_err_m), 6) AS label_threshold_m FROM m""")
def _(i):
    return L.label_threshold(i.features(), "inundation_m")


def _split(y: str = "year") -> str:
    return (f"CASE WHEN {y} BETWEEN 1995 AND 1998 THEN 'train' WHEN {y} = 1999 THEN 'val' "
            f"WHEN {y} IN (2000, 2001) THEN 'test' END")


@register("label_stats", f"""
SELECT {_split()} AS split, count(*) AS n_rows, count(DISTINCT forecast_date) AS forecast_dates, round(avg(y), 6) AS positive_rate,
  sum(major)::BIGINT AS major_events FROM z_labels WHERE year BETWEEN 1995 AND 2001 GROUP BY 1""")
def _(i):
    return L.label_stats(L.with_split(i.labels(), TRAIN, VAL, TEST))


@register("temporal_split", f"""
SELECT transect_id, {day('forecast_date')} AS forecast_date, {_split()} AS split, y FROM z_labels WHERE year BETWEEN 1995 AND 2001""")
def _(i):
    return L.with_split(i.labels(), TRAIN, VAL, TEST).select("transect_id", "forecast_date", "split", "y")


@register("spatial_split", f"""
WITH d AS (SELECT bank, quantile_cont(chainage_m, 0.5::DOUBLE) AS med FROM (SELECT DISTINCT bank, chainage_m FROM z_model) GROUP BY bank)
SELECT transect_id, {day('forecast_date')} AS forecast_date, CASE WHEN chainage_m <= med THEN 1 ELSE 0 END AS upstream FROM z_model JOIN d USING (bank)""")
def _(i):
    return L.upstream_flag(i.model_table()).select("transect_id", "forecast_date", "upstream")


@register("model_table", f"""
SELECT transect_id, {day('forecast_date')} AS forecast_date, {day('target_date')} AS target_date, {r6('ret_84_m', 'ret_365_m', 'nb_ret_84_m', 'stage_anom_km2', 'retreat_m')},
  y, major FROM z_model""")
def _(i):
    return i.model_table().select("transect_id", "forecast_date", "target_date", "ret_84_m", "ret_365_m",
                                  "nb_ret_84_m", "stage_anom_km2", "retreat_m", "y", "major")


@register("label_by_month", """
SELECT month(forecast_date)::INT AS month, count(*) AS n, round(avg(y), 6) AS positive_rate FROM z_labels GROUP BY 1""")
def _(i):
    return L.positive_rate_by_month(i.labels())
