"""Metric queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from scarp import config as C
from scarp.operators import metrics as M
from scarp.operators.labels import upstream_flag
from scarp.plans import sql_panel as S
from scarp.plans.catalogue import register
from scarp.plans.fixtures import K, TEST, Inputs
from scarp.plans.sqltext import day, fragment, r6
from scarp.session import stored


def _hash(key: str) -> str:
    return f"('0x' || substr(md5({key}), 1, 8))::BIGINT"


TIE = _hash("strftime(forecast_date, '%Y-%m-%d') || '|' || transect_id")


def rank_sql(score: str, by: str = "forecast_date") -> str:
    return f"row_number() OVER (PARTITION BY {by} ORDER BY {score} DESC NULLS LAST, {TIE}, transect_id)"


fragment("z_ranked", f"""
SELECT *, {rank_sql('B0_persistence')} AS rb0, {rank_sql('B1_history')} AS rb1, {rank_sql('p')} AS rp FROM z_scores""")


def patk(rank: str, src: str = "z_ranked", by: str = "") -> str:
    return (f"SELECT {by}forecast_date, avg(y) FILTER ({rank} <= {K}) AS precision FROM {src} GROUP BY {by}forecast_date "
            f"HAVING count(*) >= {K}")


fragment("z_pk0", patk("rb0"))
fragment("z_pk1", patk("rb1"))
fragment("z_pkp", patk("rp"))
_MON = "month(forecast_date) IN (6, 7, 8, 9, 10)"


@register("baseline_scores", f"SELECT transect_id, {day('forecast_date')} AS forecast_date, {r6('B0_persistence', 'B1_history')} FROM z_scores")
def _(i):
    return i.scores().select("transect_id", "forecast_date", "B0_persistence", "B1_history")


@register("rank_within_date", f"SELECT transect_id, {day('forecast_date')} AS forecast_date, rb0::INT AS rank FROM z_ranked")
def _(i):
    return M.rank_within_date(i.scores().select("transect_id", "forecast_date", "B0_persistence"),
                              "B0_persistence").select("transect_id", "forecast_date", "rank")


@register("precision_at_k", f"SELECT {day('forecast_date')} AS forecast_date, {r6('precision')} FROM z_pk0")
def _(i):
    return M.precision_at_k(i.scores(), "B0_persistence", K)


@register("major_recall", f"""
SELECT sum(major) FILTER (rb0 <= {K})::BIGINT AS hits, sum(major)::BIGINT AS total, round(sum(major) FILTER (rb0 <= {K}) / sum(major)::DOUBLE, 6) AS recall FROM z_ranked""")
def _(i):
    return M.major_recall(i.scores(), "B0_persistence", K)


def ap(score: str, src: str = "z_scores", by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    sel = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""SELECT {sel}CASE WHEN sum(p) > 0 AND sum(p) < sum(n) THEN sum(p * cp / cn::DOUBLE) / sum(p) END AS pr_auc FROM (
  SELECT *, sum(p) OVER ({part} ORDER BY s DESC NULLS LAST)::DOUBLE AS cp, sum(n) OVER ({part} ORDER BY s DESC NULLS LAST) AS cn FROM (
    SELECT {sel}{score} AS s, sum(y) AS p, count(*) AS n FROM {src} GROUP BY {sel}{score})) {grp}"""


@register("pr_auc", f"SELECT {r6('pr_auc')} FROM ({ap('B0_persistence')})")
def _(i):
    return M.pr_auc(i.scores(), "B0_persistence")


@register("brier", "SELECT round(avg((least(greatest(p, 0), 1) - y) ** 2), 6) AS brier FROM z_scores")
def _(i):
    return M.brier(i.scores(), "p")


_BIN = " + ".join(f"(p >= {e}::DOUBLE)::INT" for e in C.RELIABILITY_EDGES)
fragment("z_rel", f"SELECT ({_BIN})::INT AS bin, count(*) AS n, avg(p) AS mean_pred, avg(y) AS observed FROM z_scores GROUP BY 1")


@register("reliability", f"SELECT bin, n, {r6('mean_pred', 'observed')} FROM z_rel")
def _(i):
    return M.reliability(i.scores(), "p")


@register("ece", "SELECT round(sum(n * abs(mean_pred - observed)) / sum(n), 6) AS ece FROM z_rel")
def _(i):
    return M.ece(M.reliability(i.scores(), "p"))


def summary_sql(score: str, rank: str, pk: str, src: str = "z_ranked", by: str = "") -> str:
    b, g = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    one = lambda m, v, s: f"SELECT {b}'{m}' AS metric, ({v})::DOUBLE AS value FROM {s} {g}"
    return " UNION ALL ".join([
        one("precision_at_k", "avg(precision)", pk), one("precision_at_k_monsoon", f"avg(precision) FILTER ({_MON})", pk),
        one("n_dates", "count(*)", pk), one("n_dates_monsoon", f"count(*) FILTER ({_MON})", pk),
        one("pr_auc", "any_value(pr_auc)", f"({ap(score, src, by)})"),
        one("major_hits", f"sum(major) FILTER ({rank} <= {K})", src), one("major_total", "sum(major)", src),
        one("major_recall", f"sum(major) FILTER ({rank} <= {K}) / nullif(sum(major), 0)", src),
        one("brier", "avg((p - y) ** 2)", src)])


@register("summarise", f"SELECT metric, round(value, 6) AS value FROM ({summary_sql('B0_persistence', 'rb0', 'z_pk0')})")
def _(i):
    return M.summarise(i.scores(), "B0_persistence", "p", K)


fragment("z_pk0y", f"SELECT *, year(forecast_date)::INT AS year FROM z_pk0")


@register("per_year_summary", f"""
SELECT year, metric, round(value, 6) AS value FROM (
{summary_sql('B0_persistence', 'rb0', '(SELECT * FROM z_pk0y WHERE year >= 2000)', '(SELECT * FROM z_ranked WHERE year >= 2000)', 'year')})""")
def _(i):
    return M.summarise(i.scores().where(F.col("year").isin(*TEST)), "B0_persistence", "p", K, by=["year"])


def boot(series: str, cols: str = "") -> str:
    """series: (…, forecast_date, diff)"""
    c = f"{cols}, " if cols else ""
    j = f"USING ({cols})" if cols else "ON true"
    return f"""
SELECT {c}round(any_value(m), 6) + 0.0::DOUBLE AS mean, round(quantile_cont(v, 0.025::DOUBLE), 6) + 0.0::DOUBLE AS lo,
  round(quantile_cont(v, 0.975::DOUBLE), 6) + 0.0::DOUBLE AS hi, any_value(t)::INT AS n_dates
FROM (SELECT {c}b, avg(x.v) AS v, any_value(m) AS m, any_value(q.t) AS t FROM (
  SELECT {c}n.t, n.m, b.range AS b, i.range AS pos,
    least(({_hash("b.range || ':' || (i.range // 3)")} % greatest(n.t - 2, 1)) + i.range % 3, n.t - 1) AS idx
  FROM (SELECT {c}count(*) AS t, avg(diff) AS m FROM {series} {"GROUP BY " + cols if cols else ""}) n,
    range({C.BOOT_N}) b, range(3000) i WHERE i.range < n.t) q
  JOIN (SELECT {c}diff AS v, row_number() OVER ({"PARTITION BY " + cols if cols else ""} ORDER BY forecast_date) - 1 AS idx FROM {series}) x
  {"USING (" + c + "idx)"}
  GROUP BY {c}b) {"GROUP BY " + cols if cols else ""}"""


fragment("z_diff", "SELECT a.forecast_date, a.precision AS model, b.precision AS baseline, a.precision - b.precision AS diff FROM z_pk0 a JOIN z_pk1 b USING (forecast_date)")
fragment("z_diffp", f"SELECT 'all_dates' AS period, * FROM z_diff UNION ALL SELECT 'monsoon', * FROM z_diff WHERE {_MON}")


@register("moving_block_bootstrap", boot("z_diff"))
def _(i):
    d = M.precision_difference(i.scores(), "B0_persistence", "B1_history", K)
    return M.moving_block_bootstrap(d)


@register("compare_models", boot("z_diffp", "period"))
def _(i):
    return M.compare_models(i.scores(), "B0_persistence", "B1_history", K)


@register("compare_per_date", f"SELECT {day('forecast_date')} AS forecast_date, {r6('model', 'baseline', 'diff')} FROM z_diff")
def _(i):
    return M.precision_difference(i.scores(), "B0_persistence", "B1_history", K)


fragment("z_up", """
SELECT s.*, chainage_m <= med AS upstream FROM z_scores s JOIN (
  SELECT bank, quantile_cont(chainage_m, 0.5::DOUBLE) AS med FROM (SELECT DISTINCT bank, chainage_m FROM z_scores) GROUP BY bank) USING (bank)""")
fragment("z_down", f"SELECT *, {rank_sql('B0_persistence')} AS rb0, {rank_sql('B1_history')} AS rb1 FROM z_up WHERE NOT upstream AND year >= 2000")


fragment("z_lim", "SELECT s.*, x.limit_m FROM z_scores s, (SELECT unnest([60.0::DOUBLE, 100.0::DOUBLE]) AS limit_m) x WHERE y = 0 OR retreat_m <= limit_m")
fragment("z_limr", f"SELECT *, {rank_sql('B0_persistence', 'limit_m, forecast_date')} AS rb0, {rank_sql('B1_history', 'limit_m, forecast_date')} AS rb1 FROM z_lim")
fragment("z_ldiff", f"SELECT limit_m, forecast_date, a.precision - b.precision AS diff FROM ({patk('rb0', 'z_limr', 'limit_m, ')}) a JOIN ({patk('rb1', 'z_limr', 'limit_m, ')}) b USING (limit_m, forecast_date)")
fragment("z_lboot", boot("z_ldiff", "limit_m"))


@register("sensitivity_large", f"""
WITH a AS (SELECT limit_m, 'B0_persistence' AS score, round(avg(precision), 6) AS precision_at_k, count(*) AS n_dates FROM ({patk('rb0', 'z_limr', 'limit_m, ')}) GROUP BY 1
UNION ALL
SELECT limit_m, 'B1_history' AS score, round(avg(precision), 6) AS precision_at_k, count(*) AS n_dates FROM ({patk('rb1', 'z_limr', 'limit_m, ')}) GROUP BY 1)
SELECT a.*, (SELECT round(avg((retreat_m > a.limit_m)::INT), 6) FROM z_scores WHERE y = 1) AS large_share, (SELECT round(quantile_cont(retreat_m, 0.5::DOUBLE), 6) FROM z_scores WHERE y = 1) AS median_positive_retreat_m,
 round(pr.positive_rate, 6) AS positive_rate, b.mean AS diff_mean, b.lo AS diff_lo, b.hi AS diff_hi
FROM a JOIN (SELECT limit_m, avg(y) AS positive_rate FROM z_lim GROUP BY 1) pr USING (limit_m) JOIN z_lboot b USING (limit_m)""")
def _(i):
    return M.large_event_sensitivity(i.scores(), ["B0_persistence", "B1_history"], [60.0, 100.0], K)


def run_metrics(i: Inputs):
    """One wide metric row: temporal and spatial difference, Brier scores, pass coverage, position error."""
    from scarp.operators.quality import pass_coverage, position_error
    from scarp.plans.q_quality import differences
    s = upstream_flag(stored(i.scores().select("bank", "chainage_m", "year", *M.KEYS, "p", "B0_persistence", "B1_history", "y"), "run-scores"))
    test = s.where(F.col("year").isin(*TEST))
    t = M.compare_models(test, "p", "B1_history", K).where("period = 'all_dates'")
    sp = M.compare_models(test.where(~F.col("upstream")), "p", "B1_history", K).where("period = 'all_dates'")
    e = position_error(differences(i), []).select(F.col("median_abs_err_m").alias("bank_error_median_m"))
    # persistence as a calibrated probability, held against the outcome like the model's
    b0 = 1.0 / (1.0 + F.exp(-(0.02 * F.coalesce(F.col("B0_persistence"), F.lit(0.0)) - 1.0)))
    b = test.agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("model_brier"),
                 F.avg((b0 - F.col("y")) ** 2).alias("persistence_brier"))
    cov = pass_coverage(i.calendar(), i.pass_summary().select(F.unix_date("date").alias("day")))
    one = lambda df, c: df.select(c).scalar()
    # every part is a single row; they meet as scalar subqueries
    return cov.select(
        "passes_in_catalog", "passes_processed", one(e, "bank_error_median_m").alias("bank_error_median_m"),
        one(t, "lo").alias("temporal_lo"), one(sp, "lo").alias("spatial_lo"),
        one(b, "model_brier").alias("model_brier"), one(b, "persistence_brier").alias("persistence_brier"))


fragment("z_test", f"SELECT *, {rank_sql('p')} AS rp, {rank_sql('B1_history')} AS rb1 FROM z_up WHERE year >= 2000")
fragment("z_testd", f"SELECT *, {rank_sql('p')} AS rp, {rank_sql('B1_history')} AS rb1 FROM z_up WHERE year >= 2000 AND NOT upstream")
fragment("z_tdiff", f"SELECT forecast_date, a.precision - b.precision AS diff FROM ({patk('rp', 'z_test')}) a JOIN ({patk('rb1', 'z_test')}) b USING (forecast_date)")
fragment("z_sdiff", f"SELECT forecast_date, a.precision - b.precision AS diff FROM ({patk('rp', 'z_testd')}) a JOIN ({patk('rb1', 'z_testd')}) b USING (forecast_date)")
fragment("z_tboot", boot("z_tdiff"))
fragment("z_sboot", boot("z_sdiff"))
fragment("z_run", """
SELECT (SELECT count(*) FROM z_cal) AS passes_in_catalog, (SELECT count(*) FROM z_summary) AS passes_processed,
  (SELECT quantile_cont(abs(diff), 0.5::DOUBLE) FROM z_err) AS bank_error_median_m,
  (SELECT lo FROM z_tboot) AS temporal_lo, (SELECT lo FROM z_sboot) AS spatial_lo,
  (SELECT avg((p - y) ** 2) FROM z_scores WHERE year >= 2000) AS model_brier,
  (SELECT avg((1 / (1 + exp(-(0.02::DOUBLE * coalesce(B0_persistence, 0) - 1))) - y) ** 2) FROM z_scores WHERE year >= 2000) AS persistence_brier""")


@register("success_levels", f"""
SELECT passes_in_catalog, passes_processed, {r6('bank_error_median_m', 'temporal_lo', 'spatial_lo', 'model_brier', 'persistence_brier')},
 coalesce(bank_error_median_m <= 20 AND passes_processed = passes_in_catalog, false)::INT AS minimum, coalesce(temporal_lo > 0, false)::INT AS good,
 coalesce(temporal_lo > 0 AND spatial_lo > 0 AND model_brier < persistence_brier, false)::INT AS strong FROM z_run""")
def _(i):
    return M.success_levels(run_metrics(i))
