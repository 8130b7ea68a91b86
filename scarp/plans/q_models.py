"""Model queries at full size (100 rounds, the whole grid), and small ones that SQL checks: a fit of two rounds, a fixed ensemble."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from scarp import config as C
from scarp.operators import explain as X
from scarp.operators import labels as L
from scarp.operators import metrics as M
from scarp.operators import models as ML
from scarp.operators import serving as A
from scarp.operators.boosting import BoostedModel, Tree, Trial
from scarp.operators.isotonic import Calibrator
from scarp.plans.catalogue import register
from scarp.plans.fixtures import K, TEST, THRESHOLD_M, TRAIN, VAL, Inputs
from scarp.plans.q_metrics import TIE, rank_sql
from scarp.plans.q_serving import TEXT_SQL
from scarp.plans.sqltext import day, fragment, r6

_MODELS: dict[tuple[str, str], BoostedModel] = {}


def table(i: Inputs):
    return i.warehouse.table("model_table", lambda: M.baseline_scores(
        L.with_split(i.model_table(), TRAIN, VAL, TEST)))


def part(i: Inputs, split: str):
    return table(i).where(F.col("split") == split)


def model(i: Inputs) -> BoostedModel:
    """The fitted model of this application and scale."""
    key = (i.spark.sparkContext.applicationId, i.dir)
    if key not in _MODELS:
        _MODELS[key] = ML.fit_boosted(part(i, "train"), C.FEATURES)
    return _MODELS[key]


def scored_val(i: Inputs):
    return i.warehouse.table("scored_val", lambda: model(i).score(part(i, "val"), "M1_raw"))


def calibrators(i: Inputs):
    return ML.calibrate_all(scored_val(i), ["M1_raw", "B0_persistence", "B1_history"])


def scored_test(i: Inputs):
    return i.warehouse.table("scored_test", lambda: ML.score_temporal(part(i, "test"), model(i), calibrators(i)[0]))


@register("fit_boosted")
def _(i):
    return model(i).score(part(i, "val")).select("transect_id", "forecast_date", "raw", "y")


@register("tune_grid")
def _(i):
    _, trials = ML.tune_grid(part(i, "train"), part(i, "val"), C.FEATURES, k=K)
    return i.spark.createDataFrame(trials)


# max over starts of the min over ends of block means: ends by a running minimum, starts by a group
@register("fit_isotonic", """
WITH b AS (SELECT coalesce(ret_84_m, (SELECT min(ret_84_m) FROM z_scores WHERE year = 1999)) AS s, sum(y)::DOUBLE AS p, count(*)::DOUBLE AS n FROM z_scores WHERE year = 1999 GROUP BY 1),
c AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM b WINDOW w AS (ORDER BY s)),
ae AS (SELECT e.s, a.s AS a, min((e.cp - a.cp + a.p) / (e.cn - a.cn + a.n)) OVER (PARTITION BY a.s ORDER BY e.s DESC ROWS UNBOUNDED PRECEDING) AS low FROM c a JOIN c e ON e.s >= a.s),
i AS (SELECT s, max(low) AS p FROM ae GROUP BY s)
SELECT transect_id, strftime(forecast_date, '%Y-%m-%d') AS forecast_date, round(i.p, 5) + 0.0::DOUBLE AS p
FROM z_scores z JOIN i ON i.s = coalesce(z.ret_84_m, (SELECT min(ret_84_m) FROM z_scores WHERE year = 1999)) WHERE year = 1999""")
def _(i):
    v = part(i, "val")
    return ML.fit_isotonic(v, "ret_84_m").apply(v, "ret_84_m", "p").select("transect_id", "forecast_date", F.round("p", 5).alias("p"))


@register("isotonic_binned", """
WITH b AS (SELECT floor(ret_84_m / 10) * 10 AS s, sum(y)::DOUBLE AS p, count(*)::DOUBLE AS n FROM z_scores WHERE year = 1999 AND ret_84_m IS NOT NULL GROUP BY 1),
c AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM b WINDOW w AS (ORDER BY s)),
ab AS (SELECT i.s, a.s AS a, min((e.cp - a.cp + a.p) / (e.cn - a.cn + a.n)) AS low FROM c i JOIN c a ON a.s <= i.s JOIN c e ON e.s >= i.s GROUP BY ALL)
SELECT s AS score, round(max(low), 6) + 0.0::DOUBLE AS p FROM ab GROUP BY s""")
def _(i):
    v = part(i, "val").where("ret_84_m IS NOT NULL").withColumn("score", (F.floor(F.col("ret_84_m") / 10) * 10).cast("double"))
    return ML.fit_isotonic(v, "score").apply(v.select("score").distinct(), "score", "p")


@register("calibrate_all")
def _(i):
    return calibrators(i)[1]


@register("score_temporal")
def _(i):
    return scored_test(i).select("transect_id", "forecast_date", "M1", "M1_raw", "B0_persistence_p", "B1_history_p", "y")


@register("model_vs_persistence")
def _(i):
    return M.compare_models(scored_test(i), "M1", "B0_persistence", K)


@register("spatial_holdout")
def _(i):
    s = ML.spatial_holdout(table(i), C.FEATURES, k=K)
    return M.summarise(s, "M1_spatial", "M1_spatial", K)


def ablation(i: Inputs):
    return i.warehouse.table("ablation", lambda: ML.ablate_groups(table(i), C.FEATURE_GROUPS, k=K))


@register("ablate_groups")
def _(i):
    return ablation(i)


@register("ablation_rank")
def _(i):
    a = ablation(i).where("split = 'test' AND metric = 'precision_at_k'")
    return A.ablation_rank(a.select("variant", "n_features", F.col("delta_vs_full").alias("delta_precision_at_k")))


@register("tree_contributions")
def _(i):
    m = model(i)
    return X.model_scores(part(i, "test"), m).select("transect_id", "forecast_date", *[F.col(f"c_{f}").alias(f) for f in m.features])


def published(i: Inputs, m: BoostedModel, cal: Calibrator, base: Calibrator):
    return A.publish(i.scoring_rows(), m, cal, base, F.col("year").isin(*VAL), THRESHOLD_M, K)


@register("predictions_trained")
def _(i):
    cals, _ = calibrators(i)
    p = published(i, model(i), cals["M1_raw"], cals["B0_persistence"])
    return p.select("transect_id", "forecast_date", "p", "raw", "b0_p", "rank", "b0_rank", "tier", F.size("reasons").alias("n_reasons"))


# --- a fit of two rounds of one split each, written out in SQL ------------------------------------------------------
STUMP_EDGES = {"ret_84_m": [-20.0, 0.0, 20.0, 40.0], "n_obs_365": [8.0, 16.0, 24.0], "stage_change_12d": [-10.0, 0.0, 10.0]}
_EDGE_ROWS = ", ".join(f"({f}, {b}, {c}::DOUBLE)" for f, cs in enumerate(STUMP_EDGES.values()) for b, c in enumerate(cs, 1))
_BELOW = ("CASE e.f " + " ".join(f"WHEN {n} THEN CASE WHEN {f} IS NULL OR isnan({f}) THEN missing_left ELSE {f}::DOUBLE <= e.c END"
                                 for n, f in enumerate(STUMP_EDGES)) + " END")
_UNIT = 1 << 20


def _round_sql(rows: str, n: int, rate: float = 0.5, least: int = 30) -> str:
    """Rows with margin m -> the best split b<n> -> rows s<n> with the margin after it."""
    term = lambda g, h: f"power(({g}) / {_UNIT}::DOUBLE, 2) / (({h}) / {_UNIT}::DOUBLE + 1)"
    value = lambda g, h: f"{rate}::DOUBLE * -(({g}) / {_UNIT}::DOUBLE) / (({h}) / {_UNIT}::DOUBLE + 1)"
    return f"""
g{n} AS (SELECT *, round((1 / (1 + exp(-m)) - y) * {_UNIT}) AS g, round(1 / (1 + exp(-m)) * (1 - 1 / (1 + exp(-m))) * {_UNIT}) AS h FROM {rows}),
c{n} AS (SELECT e.f, e.b, e.c, missing_left, sum(g) FILTER ({_BELOW}) AS gl, sum(h) FILTER ({_BELOW}) AS hl, count(*) FILTER ({_BELOW}) AS nl,
  sum(g) AS g, sum(h) AS h, count(*) AS n FROM g{n}, (VALUES {_EDGE_ROWS}) e(f, b, c), (VALUES (false), (true)) s(missing_left) WHERE year <> 1999 GROUP BY ALL),
b{n} AS (SELECT *, {value('gl', 'hl')} AS vl, {value('g - gl', 'h - hl')} AS vr FROM c{n} WHERE nl >= {least} AND n - nl >= {least}
  ORDER BY round({term('gl', 'hl')} + {term('g - gl', 'h - hl')} - {term('g', 'h')}, 9) DESC, f, b, missing_left LIMIT 1),
s{n} AS (SELECT r.* REPLACE (m + CASE WHEN {_BELOW} THEN vl ELSE vr END AS m) FROM {rows} r, b{n} e)"""


@register("fit_two_rounds", f"""
WITH s0 AS (SELECT transect_id, forecast_date, year, y, {', '.join(STUMP_EDGES)}, (SELECT ln(avg(y) / (1 - avg(y))) FROM z_scores WHERE year BETWEEN 1995 AND 1998) AS m
  FROM z_scores WHERE year BETWEEN 1995 AND 1999),{_round_sql('s0', 1)},{_round_sql('s1', 2)}
SELECT transect_id, strftime(forecast_date, '%Y-%m-%d') AS forecast_date, round(1 / (1 + exp(-m)), 6) AS raw FROM s2 WHERE year = 1999""")
def _(i):
    m = ML.fit_boosted(part(i, "train"), list(STUMP_EDGES), 2, trial=Trial(depth=1, min_rows=30, rate=0.5), edges=STUMP_EDGES,
                       subsample=1, colsample=1)
    return m.score(part(i, "val")).select("transect_id", "forecast_date", "raw")


# --- a fixed ensemble, written out in SQL ---------------------------------------------------------------------------
def ensemble() -> BoostedModel:
    one, two = Tree(), Tree()
    one.value[0] = 0.05
    _, right = one.split(0, 0, 1, 15.0, True, (-0.4, 0.6))
    one.split(right, 1, 1, 10.0, True, (0.3, 1.1))
    left, _ = two.split(0, 2, 1, 20.0, False, (0.2, -0.1))
    two.split(left, 0, 1, 40.0, False, (0.1, 0.5))
    return BoostedModel(["ret_84_m", "raw_last_change_m", "n_obs_365"], [one, two], -0.9)


def steps(low, high, p, fill=0.0) -> Calibrator:
    return Calibrator(np.array(low), np.array(high), np.array(p), fill)


FIXED_STEPS = steps([0.1, 0.3, 0.5], [0.25, 0.4, 0.7], [0.02, 0.2, 0.55])
FIXED_BASE = steps([0.0, 30.0], [10.0, 60.0], [0.05, 0.4])


def _line_sql(x: str, c: Calibrator) -> str:
    """The steps and the lines between them."""
    out = f"{c.p[-1]}::DOUBLE"
    for j in range(len(c.p) - 2, -1, -1):
        between = f"{c.p[j]}::DOUBLE + ({x} - {c.high[j]}::DOUBLE) / {c.low[j + 1] - c.high[j]}::DOUBLE * {c.p[j + 1] - c.p[j]}::DOUBLE"
        out = f"CASE WHEN {x} <= {c.high[j]} THEN {c.p[j]}::DOUBLE WHEN {x} < {c.low[j + 1]} THEN {between} ELSE {out} END"
    return out


fragment("z_ens0", f"""
SELECT *, 1 / (1 + exp(-(-0.85::DOUBLE + c_ret + c_raw + c_obs))) AS raw, {_line_sql('coalesce(ret_84_m, 0)', FIXED_BASE)} AS b0_p FROM (
  SELECT * EXCLUDE (raw, p, b0_p), CASE WHEN coalesce(ret_84_m, 0) <= 15 THEN -0.45::DOUBLE ELSE 0.55::DOUBLE END
    + CASE WHEN n_obs_365 <= 20 THEN CASE WHEN ret_84_m <= 40 THEN -0.1::DOUBLE ELSE 0.3::DOUBLE END ELSE 0 END AS c_ret,
  CASE WHEN coalesce(ret_84_m, 0) <= 15 THEN 0 WHEN coalesce(raw_last_change_m, 0) <= 10 THEN -0.3::DOUBLE ELSE 0.5::DOUBLE END AS c_raw,
  CASE WHEN n_obs_365 <= 20 THEN 0.2::DOUBLE ELSE -0.1::DOUBLE END AS c_obs FROM z_pred0)""")
fragment("z_ens1", f"SELECT *, {_line_sql('raw', FIXED_STEPS)} AS p, {rank_sql('raw')}::INT AS rank, {rank_sql('ret_84_m')}::INT AS b0_rank FROM z_ens0")
fragment("z_ens_floor", f"""
SELECT round(coalesce(min(p) FILTER (hits >= 0.5::DOUBLE * n), max(p)), 3) AS floor FROM (
  SELECT p, sum(y) OVER w AS hits, count(*) OVER w AS n FROM z_ens1 WHERE year = 1999 AND y IS NOT NULL
  WINDOW w AS (ORDER BY p DESC, {TIE}, forecast_date, transect_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
fragment("z_ens", f"""
SELECT *, CASE WHEN rank <= {K} AND p >= (SELECT floor FROM z_ens_floor) AND coalesce(raw_last_change_m, 0) >= 20 THEN 'warning_eligible'
  WHEN rank <= {K} THEN 'watch' WHEN coalesce(raw_last_change_m, 0) >= 20 THEN 'monitor' ELSE 'none' END AS tier FROM z_ens1""")
fragment("z_ens_told", f"""
SELECT *, {TEXT_SQL} AS text FROM (SELECT *, unnest(['recent_retreat', 'history']) AS g, unnest([c_ret + c_raw, c_obs]) AS value FROM z_ens)
WHERE value > 1e-12 AND rank <= {C.REASONS_TOP_RANK}""")


def fixed_predictions(i: Inputs):
    return published(i, ensemble(), FIXED_STEPS, FIXED_BASE)


@register("predictions_model", f"""
SELECT transect_id, {day('forecast_date')} AS forecast_date, {r6('raw', 'p', 'b0_p')}, rank, b0_rank, tier FROM z_ens""")
def _(i):
    return fixed_predictions(i).select("transect_id", "forecast_date", "raw", "p", "b0_p", "rank", "b0_rank", "tier")


@register("reasons_model", f"""
SELECT transect_id, {day('forecast_date')} AS forecast_date, g AS reason_group, text, round(value, 4) AS value FROM z_ens_told WHERE text IS NOT NULL""")
def _(i):
    return fixed_predictions(i).select("transect_id", "forecast_date", F.explode("reasons").alias("r")).select(
        "transect_id", "forecast_date", F.col("r.group").alias("reason_group"), F.col("r.text").alias("text"), F.col("r.shap").alias("value"))
