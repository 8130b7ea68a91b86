"""Reasons, tiers, predictions, serving and alert queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from scarp import config as C
from scarp.operators import alerts as AL
from scarp.operators import explain as X
from scarp.operators import serving as A
from scarp.plans.catalogue import register
from scarp.plans.fixtures import K, TEST, THRESHOLD_M, VAL, WEIGHTS, Inputs
from scarp.plans.q_metrics import rank_sql, run_metrics, TIE
from scarp.plans.sqltext import day, fragment, r6
from scarp.session import scratch

NAMES = list(WEIGHTS)
fragment("z_pred0", """
SELECT f.*, l.target_date, l.retreat_m, l.y, l.major, 89.5::DOUBLE + t.x0 / 100000 AS lon, 24.5::DOUBLE + t.y0 / 1000000 AS lat,
  0.01::DOUBLE * coalesce(ret_84_m, 0) - 0.5::DOUBLE AS raw, 1 / (1 + exp(-(0.02::DOUBLE * coalesce(ret_84_m, 0) - 1))) AS b0_p,
  1 / (1 + exp(-(0.01::DOUBLE * coalesce(ret_84_m, 0) - 0.5::DOUBLE))) AS p
FROM z_features f LEFT JOIN z_labels l USING (transect_id, forecast_date) LEFT JOIN z_transects t USING (transect_id) WHERE f.year BETWEEN 1999 AND 2001""")
fragment("z_floor", f"""
SELECT round(coalesce(min(p) FILTER (hits >= 0.5::DOUBLE * n), max(p)), 3) AS warning_min_prob FROM (
  SELECT p, sum(y) OVER w AS hits, count(*) OVER w AS n FROM z_pred0 WHERE year = 1999 AND y IS NOT NULL
  WINDOW w AS (ORDER BY p DESC, {TIE}, forecast_date, transect_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
fragment("z_pred1", f"SELECT *, {rank_sql('raw')}::INT AS rank, {rank_sql('ret_84_m')}::INT AS b0_rank FROM z_pred0")
fragment("z_pred2", f"""
SELECT *, CASE WHEN rank <= {K} AND p >= 0.5::DOUBLE AND coalesce(raw_last_change_m, 0) >= 20 THEN 'warning_eligible'
  WHEN rank <= {K} THEN 'watch' WHEN coalesce(raw_last_change_m, 0) >= 20 THEN 'monitor' ELSE 'none' END AS tier FROM z_pred1""")
fragment("z_means", "SELECT " + ", ".join(f"avg({f}) AS {f}" for f in NAMES) + " FROM z_pred0")
fragment("z_contrib", "SELECT p.transect_id, p.forecast_date, p.rank, " + ", ".join(
    f"coalesce({w}::DOUBLE * (p.{f} - m.{f}), 0) AS {f}" for f, w in WEIGHTS.items()) + " FROM z_pred2 p, z_means m")
# which reason a feature belongs to, in the order of the features: written out, so that the SQL stands by itself
GROUP_OF = {
    "ret_28_m": "recent_retreat", "ret_56_m": "recent_retreat", "ret_84_m": "recent_retreat", "raw_last_change_m": "recent_retreat",
    "ret_365_m": "history", "n_obs_365": "history",
    "dist_main_channel_m": "main_channel", "d_dist_main_28_m": "main_channel",
    "near_channel_width_m": "near_bank_channel", "char_shield_frac": "char_shield", "nearbank_water_frac": "near_bank_channel",
    "baseline_curvature": "bank_shape", "embayment_m": "bank_shape",
    "stage_km2": "water_level", "stage_change_12d": "water_level", "stage_change_24d": "water_level", "stage_anom_km2": "water_level",
    "inundation_m": "water_level", "doy_sin": "season", "doy_cos": "season",
    "nb_ret_84_m": "neighbours", "nb_ret_365_m": "neighbours", "bank_height_m": "bank_height",
}
_MAP = "CASE feature " + " ".join(f"WHEN '{f}' THEN '{GROUP_OF[f]}'" for f in NAMES) + " END"
_ORDER = {g: n for n, g in enumerate(dict.fromkeys(GROUP_OF[f] for f in NAMES))}
fragment("z_long", f"SELECT transect_id, forecast_date, feature, value FROM (FROM (SELECT * EXCLUDE (rank) FROM z_contrib) UNPIVOT (value FOR feature IN ({', '.join(NAMES)})))")
fragment("z_group", f"""
SELECT *, row_number() OVER (PARTITION BY transect_id, forecast_date ORDER BY value DESC, CASE g {' '.join(f"WHEN '{g}' THEN {n}" for g, n in _ORDER.items())} END) AS rn
FROM (SELECT transect_id, forecast_date, {_MAP} AS g, sum(value) AS value FROM z_long GROUP BY ALL) WHERE value > 0""")
_m = lambda c: f"format('{{:,.0f}} m', abs({c}))"
TEXT_SQL = f"""CASE g
 WHEN 'recent_retreat' THEN coalesce(nullif(concat_ws('; ', CASE WHEN ret_28_m > 5 THEN 'Bank retreated ' || {_m('ret_28_m')} || ' in the last 4 weeks'
   WHEN ret_84_m > 5 THEN 'Bank retreated ' || {_m('ret_84_m')} || ' in the last 12 weeks' END,
   CASE WHEN raw_last_change_m > 10 THEN 'latest pass shows a further ' || {_m('raw_last_change_m')} || ' (unconfirmed)' END), ''),
   'Little recent retreat, but the recent pattern still raises risk')
 WHEN 'history' THEN CASE WHEN ret_365_m > 0 THEN 'Lost ' || {_m('ret_365_m')} || ' of bank over the past year' ELSE 'Past-year history raises risk' END
 WHEN 'main_channel' THEN coalesce('Main flowing channel is ' || {_m('dist_main_channel_m')} || ' from the bank', 'Main channel position')
   || CASE WHEN d_dist_main_28_m < -20 THEN ' and moved ' || {_m('d_dist_main_28_m')} || ' closer in 4 weeks' ELSE '' END
 WHEN 'char_shield' THEN CASE WHEN char_shield_frac < 0.15::DOUBLE THEN 'No char shields this bank from the flow' ELSE 'Little char protection in front of the bank' END
 WHEN 'near_bank_channel' THEN coalesce('A ' || {_m('near_channel_width_m')} || '-wide channel runs along the bank', 'Deep water close to the bank')
 WHEN 'bank_shape' THEN 'Bank sits on an outer bend / in a recess'
 WHEN 'water_level' THEN CASE WHEN stage_change_12d > 5 THEN 'River is rising (more open water than 12 days ago)'
   WHEN stage_change_12d < -5 THEN 'River is falling after high water' ELSE 'River stage is typical of high-erosion periods' END
 WHEN 'season' THEN 'Monsoon season'
 WHEN 'neighbours' THEN CASE WHEN nb_ret_84_m > 0 THEN 'Neighbouring segments retreated ' || {_m('nb_ret_84_m')} || ' on average in 12 weeks' ELSE 'Nearby segments are active' END
 WHEN 'bank_height' THEN format('Bank height about {{:.1f}} m above the river (DEM)', bank_height_m) END"""
fragment("z_told", f"""
SELECT g.transect_id, g.forecast_date, g.g, g.value, g.rn, {TEXT_SQL} AS text FROM z_group g JOIN z_pred2 p USING (transect_id, forecast_date) WHERE rn <= 3 AND p.rank <= {C.REASONS_TOP_RANK}""")
fragment("z_pred", """
SELECT p.*, r.reasons, r.two, r.texts FROM z_pred2 p LEFT JOIN (
  SELECT transect_id, forecast_date, string_agg(g || ': ' || text || format(' {:.4f}', round(value, 4)), ' | ' ORDER BY rn) AS reasons,
    string_agg(text, '; ' ORDER BY rn) FILTER (rn <= 2) AS two, string_agg(text, ' | ' ORDER BY rn) AS texts
  FROM z_told WHERE text IS NOT NULL GROUP BY ALL) r USING (transect_id, forecast_date)""")


def _told(c: str = "reasons"):
    from scarp.functions.columns import fixed
    return F.array_join(F.transform(c, lambda r: F.concat(r["group"], F.lit(": "), r["text"], F.lit(" "), fixed(r["shap"], 4))), " | ")


@register("reason_groups", "SELECT feature, reason_group FROM (VALUES " + ", ".join(
    f"('{f}', '{g}')" for f, g in GROUP_OF.items()) + ") v(feature, reason_group) WHERE (SELECT count(*) FROM z_pred0) > 0")
def _(i):
    # groups of the features that actually carry a value in the table
    have = i.features().agg(*[F.count(f).alias(f) for f in C.FEATURES]).unpivot([], C.FEATURES, "feature", "n")
    return X.reason_groups(i.spark).join(have.where("n > 0"), "feature").select("feature", "reason_group")


@register("contributions", f"SELECT transect_id, {day('forecast_date')} AS forecast_date, {r6(*NAMES)} FROM z_contrib")
def _(i):
    p = i.predictions()
    c = X.linear_contributions(p, WEIGHTS, X.feature_means(p, NAMES))
    return c.select("transect_id", "forecast_date", *[F.col(f"c_{f}").alias(f) for f in NAMES])


@register("top_reasons", f"""
SELECT transect_id, {day('forecast_date')} AS forecast_date, string_agg(g || format(' {{:.3f}}', value), ', ' ORDER BY rn) AS top FROM z_group WHERE rn <= 3 GROUP BY ALL""")
def _(i):
    from scarp.functions.columns import fixed
    p = i.predictions()
    c = X.linear_contributions(p, WEIGHTS, X.feature_means(p, NAMES))
    named = F.transform(X.top_reasons(NAMES), lambda r: F.concat(r["group"], F.lit(" "), fixed(r["value"], 3)))
    return c.select("transect_id", "forecast_date", F.nullif(F.array_join(named, ", "), F.lit("")).alias("top")).where("top IS NOT NULL")


@register("render_reason", f"SELECT transect_id, {day('forecast_date')} AS forecast_date, g AS reason_group, text FROM z_told WHERE text IS NOT NULL")
def _(i):
    return i.predictions().select("transect_id", "forecast_date", F.explode("reasons").alias("r")).select(
        "transect_id", "forecast_date", F.col("r.group").alias("reason_group"), F.col("r.text").alias("text"))


@register("global_importance", f"""
SELECT feature, round(avg(abs(value)), 6) AS mean_abs_shap FROM (FROM (SELECT * EXCLUDE (rank) FROM z_contrib) UNPIVOT (value FOR feature IN ({', '.join(NAMES)}))) GROUP BY 1""")
def _(i):
    p = i.predictions()
    return X.global_importance(X.linear_contributions(p, WEIGHTS, X.feature_means(p, NAMES)), NAMES)


@register("tier_threshold", "SELECT warning_min_prob FROM z_floor")
def _(i):
    return A.tier_threshold(i.predictions().where(F.col("year").isin(*VAL)))


@register("assign_tiers", f"""
SELECT transect_id, {day('forecast_date')} AS forecast_date, rank, CASE WHEN rank <= {K} AND p >= (SELECT warning_min_prob FROM z_floor)
  AND coalesce(raw_last_change_m, 0) >= 20 THEN 'warning_eligible'
  WHEN rank <= {K} THEN 'watch' WHEN coalesce(raw_last_change_m, 0) >= 20 THEN 'monitor' ELSE 'none' END AS tier FROM z_pred1""")
def _(i):
    p = i.predictions()
    floor = A.tier_threshold(p.where(F.col("year").isin(*VAL))).scalar()
    return p.select("transect_id", "forecast_date", "rank", A.assign_tiers(floor, THRESHOLD_M, K).alias("tier"))


@register("predictions_all", f"""
SELECT transect_id, {day('forecast_date')} AS forecast_date, bank, chainage_m, {r6('lon', 'lat', 'p', 'raw', 'b0_p', 'ret_28_m', 'ret_84_m', 'ret_365_m',
 'raw_last_change_m', 'bank_pos_m', 'char_shield_frac', 'retreat_m')}, rank, b0_rank, tier, {day('target_date')} AS target_date, y, major, reasons FROM z_pred""", doubles=('y', 'major'))
def _(i):
    return i.build_predictions().select(*[c for c in A.KEEP if c not in ("reasons", "dist_main_channel_m")],
                                        F.nullif(_told(), F.lit("")).alias("reasons"))


def _split():
    return F.when(F.year("forecast_date").isin(*VAL), "val").otherwise("test")


def _index(i: Inputs):
    return A.prediction_index(i.predictions(), _split(), K)


def _p20(rank: str) -> str:
    return f"round(avg(y) FILTER (y IS NOT NULL AND {rank} <= {K}), 3)"


fragment("z_index", f"""
SELECT forecast_date, year(forecast_date)::INT AS year, CASE WHEN year(forecast_date) = 1999 THEN 'val' ELSE 'test' END AS split, count(*) AS n,
  CASE WHEN count(y) > 0 THEN 1 ELSE 0 END AS has_outcome, count(*) FILTER (tier = 'warning_eligible') AS n_warning, sum(y)::BIGINT AS positives,
  CASE WHEN count(y) >= {K} THEN {_p20('lr')} END AS p20_model, CASE WHEN count(y) >= {K} THEN {_p20('lb')} END AS p20_persistence
FROM (SELECT *, row_number() OVER (PARTITION BY forecast_date, y IS NULL ORDER BY rank) AS lr,
  row_number() OVER (PARTITION BY forecast_date, y IS NULL ORDER BY b0_rank) AS lb FROM z_pred2) GROUP BY forecast_date""")


@register("prediction_index", f"SELECT * REPLACE ({day('forecast_date')} AS forecast_date) FROM z_index", doubles=('positives',))
def _(i):
    return _index(i)


@register("prediction_rows", f"""
SELECT {day('forecast_date')} AS date, transect_id AS id, round(p, 4) AS p, rank, b0_rank, tier, round_even(ret_28_m, 0) + 0.0::DOUBLE AS ret28,
 round_even(ret_84_m, 0) + 0.0::DOUBLE AS ret84, round_even(ret_365_m, 0) + 0.0::DOUBLE AS ret365, round_even(raw_last_change_m, 0) + 0.0::DOUBLE AS last,
 round_even(bank_pos_m, 0) + 0.0::DOUBLE AS pos, coalesce(raw_last_change_m >= 20, false)::INT AS mon, y, round_even(retreat_m, 0) + 0.0::DOUBLE AS retreat, major,
 {day('target_date')} AS target, texts AS reasons FROM z_pred""", doubles=('y', 'major'))
def _(i):
    return A.prediction_rows(i.predictions(), THRESHOLD_M).withColumn(
        "reasons", F.nullif(F.array_join("reasons", " | "), F.lit("")))


@register("prediction_documents", f"""
SELECT {day('forecast_date')} AS date, count(*) AS n, string_agg(transect_id || ' ' || rank || ' ' || tier, ',' ORDER BY rank) AS segments,
  (SELECT n_warning FROM z_index x WHERE x.forecast_date = p.forecast_date) AS n_warning FROM z_pred2 p GROUP BY forecast_date""")
def _(i):
    """All dates written, then the last year's again as a late pass would, and read back with their index entries."""
    path = scratch(i.spark, "documents")
    pred = i.predictions()
    A.write_documents(A.prediction_rows(pred, THRESHOLD_M), _index(i), path)
    late = F.year("forecast_date") == max(TEST)
    A.write_documents(A.prediction_rows(pred.where(late), THRESHOLD_M), _index(i).where(late), path)
    docs, index = A.read_documents(i.spark, path)
    rows = F.transform("segments", lambda r: F.concat_ws(" ", r["id"], r["rank"].cast("string"), r["tier"]))
    return (docs.join(index.select("forecast_date", "n_warning"), "forecast_date")
            .select(F.col("forecast_date").alias("date"), F.size("segments").cast("bigint").alias("n"), F.array_join(rows, ",").alias("segments"), "n_warning"))


@register("passes_summary", f"""
SELECT pass_id, {day('s.date')} AS date, platform, otsu_ok, round(t_vv, 2) AS t_vv, round(water_area_km2, 1) AS water_area_km2,
  round(stage_km2, 1) AS stage_km2, round(valid_share, 3) AS valid_share
FROM z_summary s LEFT JOIN (SELECT pass_id, arg_min(n_items::DOUBLE, transect_id) AS stage_km2, count(bank_pos_m) / count(*)::DOUBLE AS valid_share
  FROM z_panel GROUP BY pass_id) USING (pass_id)""")
def _(i):
    return A.passes_summary(i.panel().withColumn("belt_water_km2", F.col("n_items").cast("double")), i.pass_summary())


@register("banks_by_year", """
WITH h AS (SELECT DISTINCT year(date)::INT AS year, pass_id FROM z_panel), t AS (SELECT DISTINCT transect_id FROM z_panel)
SELECT h.year, t.transect_id, string_agg(h.pass_id, ',' ORDER BY h.pass_id) AS passes,
  string_agg(coalesce(round_even(p.bank_pos_m, 0)::INT::VARCHAR, '-'), ',' ORDER BY h.pass_id) AS pos
FROM h CROSS JOIN t LEFT JOIN z_panel p ON p.transect_id = t.transect_id AND p.pass_id = h.pass_id GROUP BY ALL""")
def _(i):
    return A.banks_by_year(i.panel()).select("year", "transect_id", F.array_join("passes", ",").alias("passes"),
                                             F.array_join("pos", ",", "-").alias("pos"))


@register("segment_history", f"""
SELECT {day('date')} AS date, round_even(bank_pos_m, 0)::INT AS pos FROM z_panel
WHERE transect_id = (SELECT min(transect_id) FROM z_panel) AND date <= DATE '2000-06-30'""")
def _(i):
    one = i.panel().agg(F.min("transect_id")).first()[0]
    return A.segment_history(i.panel(), one, "2000-06-30")


@register("top_n_predictions", f"""
SELECT transect_id, rank, round(p, 6) AS p FROM z_pred2 WHERE forecast_date = (SELECT max(forecast_date) FROM z_pred2) AND rank <= 10""")
def _(i):
    last = i.predictions().agg(F.max("forecast_date").cast("string")).first()[0]
    return A.top_predictions(i.predictions(), last, 10).select("transect_id", "rank", "p")


@register("brief_table", f"""
SELECT {day('forecast_date')} AS forecast_date, rank, transect_id, CASE bank WHEN 'W' THEN 'West bank' ELSE 'East bank' END AS bank_name,
  format('{{:.4f}}, {{:.4f}}', lat, lon) AS lat_lon, format('{{:.0f}}%', p * 100) AS risk,
  coalesce(format('{{:+.0f}} m', raw_last_change_m), '–') AS latest_pass, coalesce(two, '–') AS why FROM z_pred WHERE rank <= {K}""")
def _(i):
    return A.brief_table(i.predictions(), K)


fragment("z_dates", "SELECT forecast_date, row_number() OVER (ORDER BY forecast_date) - 1 AS n FROM (SELECT DISTINCT forecast_date FROM z_features WHERE year BETWEEN 2000 AND 2001)")
fragment("z_req0", """
SELECT event_id AS alert_id, user_id % 25 AS nk, event_id % nd AS n, j.range AS j, (event_id * 7 + j.range * 13) % ns AS k
FROM events, (SELECT count(*) AS nd FROM z_dates), (SELECT count(*) + 1 AS ns FROM supplier), range(20) j WHERE event_type = 'click'""")
fragment("z_req", """
SELECT alert_id, d.forecast_date, n_name AS place, j, coalesce(s.transect_id, 'X-' || r.k::VARCHAR) AS transect_id
FROM z_req0 r JOIN nation ON n_nationkey = nk JOIN z_dates d ON d.n = r.n LEFT JOIN z_sup s ON s.k = r.k""")


def requests(i: Inputs):
    """Click events as warning requests: a test date and twenty segments each, some of them unknown."""
    from pyspark.sql import Window
    dates = i.predictions().where(F.year("forecast_date") >= 2000).select("forecast_date").distinct().withColumn(
        "n", (F.row_number().over(Window.orderBy("forecast_date")) - 1).cast("bigint"))   # calendar-sized
    n_dates = dates.agg(F.count(F.lit(1))).scalar()
    n_sup = i.suppliers().agg(F.count(F.lit(1)) + 1).scalar()
    e = (i.table("events").where("event_type = 'click'")
         .select(F.col("event_id").alias("alert_id"), (F.col("user_id") % 25).cast("int").alias("n_nationkey"), n_dates.alias("_nd"), n_sup.alias("_ns"))
         .withColumn("n", F.col("alert_id") % F.col("_nd"))
         .withColumn("k", F.explode(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda j: F.col("alert_id") * 7 + j * 13)))
         .withColumn("k", F.col("k") % F.col("_ns")))
    named = e.join(i.suppliers().select("k", "transect_id"), "k", "left").withColumn(
        "transect_id", F.coalesce("transect_id", F.concat(F.lit("X-"), F.col("k").cast("string"))))
    places = i.table("nation").select("n_nationkey", F.col("n_name").alias("place"))
    return (named.join(dates, "n").join(places, "n_nationkey").groupBy("alert_id", "forecast_date", "place")
            .agg(F.collect_list("transect_id").alias("segment_ids")))


fragment("z_draft", """
SELECT alert_id, r.forecast_date, place, string_agg(r.transect_id, ',' ORDER BY r.transect_id) FILTER (tier IS NULL) AS unknown,
  string_agg(r.transect_id, ',' ORDER BY r.transect_id) FILTER (tier = 'warning_eligible') AS segment_ids, max(p) FILTER (tier = 'warning_eligible') AS pm,
  CASE WHEN count(*) FILTER (tier IS NULL) > 0 THEN 'unknown segments' WHEN count(*) FILTER (tier = 'warning_eligible') = 0 THEN 'not eligible' ELSE 'awaiting_approval' END AS status
FROM z_req r LEFT JOIN z_pred2 p ON p.transect_id = r.transect_id AND p.forecast_date = r.forecast_date GROUP BY ALL""")


def drafts(i: Inputs):
    return AL.draft_alerts(requests(i), i.predictions())


@register("alert_draft", f"""
SELECT alert_id, {day('forecast_date')} AS forecast_date, place, coalesce(unknown, '') AS unknown, coalesce(segment_ids, '') AS segment_ids, status,
 CASE WHEN status = 'awaiting_approval' THEN round(pm, 6) END AS probability FROM z_draft""")
def _(i):
    return drafts(i).withColumns({"unknown": F.array_join("unknown", ","), "segment_ids": F.array_join("segment_ids", ",")})


fragment("z_dec", """
SELECT (event_id // 3 * 3 + j.range) AS alert_id, ts, CASE event_type WHEN 'purchase' THEN 'approve' ELSE 'reject' END AS decision,
  CASE WHEN user_id % 4 = 0 THEN '  ab ' ELSE 'Officer ' || user_id END AS official_name, 'Executive engineer' AS role
FROM events CROSS JOIN range(3) j WHERE event_type IN ('purchase', 'error')""")


def decisions(i: Inputs):
    """Purchase events approve, error events reject, the requests numbered next to them."""
    near = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda j: F.floor(F.col("event_id") / 3) * 3 + j)
    return i.table("events").where("event_type IN ('purchase', 'error')").select(
        F.explode(near).alias("alert_id"), "ts",
        F.when(F.col("event_type") == "purchase", "approve").otherwise("reject").alias("decision"),
        F.when(F.col("user_id") % 4 == 0, "  ab ").otherwise(F.concat(F.lit("Officer "), F.col("user_id").cast("string"))).alias("official_name"),
        F.lit("Executive engineer").alias("role"))


fragment("z_appr", """
SELECT d.alert_id, d.forecast_date, d.place, d.pm AS probability,
  CASE WHEN no IS NOT NULL THEN 'rejected' WHEN ok IS NOT NULL THEN 'logged_not_sent' ELSE 'awaiting_approval' END AS status,
  CASE WHEN ok IS NOT NULL AND (no IS NULL OR ok < no) THEN trim(ok_by) END AS approved_by, trim(no_by) AS rejected_by, coalesce(refused, 0) AS n_refused
FROM z_draft d LEFT JOIN (SELECT alert_id, min(ts) FILTER (v AND decision = 'approve') AS ok, arg_min(official_name, ts) FILTER (v AND decision = 'approve') AS ok_by,
  min(ts) FILTER (v AND decision = 'reject') AS no, arg_max(official_name, ts) FILTER (v AND decision = 'reject') AS no_by, count(*) FILTER (NOT v) AS refused
  FROM (SELECT *, length(trim(official_name)) >= 3 AND length(trim(role)) >= 3 AS v FROM z_dec) GROUP BY alert_id) x USING (alert_id)
WHERE d.status = 'awaiting_approval'""")


@register("alert_approve", f"SELECT * REPLACE ({day('forecast_date')} AS forecast_date, round(probability, 6) AS probability) FROM z_appr")
def _(i):
    return AL.approve_alerts(drafts(i), decisions(i))


@register("alert_messages", f"""
WITH r AS (SELECT '+880' || lpad(c_custkey::VARCHAR, 8, '0') AS phone, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING')
SELECT alert_id, phone[1:4] || '…' || phone[-2:] AS "to", k.kind, replace(k.body, '{{place}}', place) AS body, 'console' AS gateway, 'logged_not_sent' AS status
FROM z_appr a JOIN r ON r.n_name = a.place CROSS JOIN (VALUES ('sms', '{C.SMS_TEMPLATE}'), ('voice', '[clip {C.VOICE_CLIP}] {C.VOICE_TEMPLATE}')) k(kind, body)
WHERE a.status = 'logged_not_sent'""")
def _(i):
    people = i.table("customer").join(i.table("nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(
        F.concat(F.lit("+880"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("phone"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Yes").otherwise("no").alias("opt_in"), F.col("n_name").alias("list_id"))
    return AL.alert_messages(AL.approve_alerts(drafts(i), decisions(i)).withColumn("list_id", F.col("place")), people)


_CLAIM = lambda name, ok, value: f"SELECT '{name}' AS claim, CASE WHEN {ok} THEN 'Measured' ELSE 'Not met' END AS status, {value} AS value FROM z_run"


@register("claim_status", " UNION ALL ".join([
    _CLAIM("bank error", "bank_error_median_m <= 20", "format('median {:.0f} m', bank_error_median_m)"),
    _CLAIM("coverage", "passes_processed = passes_in_catalog", "passes_processed || ' of ' || passes_in_catalog || ' passes'"),
    _CLAIM("beats persistence", "temporal_lo > 0", "format('lower bound {:+.1f} pts', temporal_lo * 100)"),
    _CLAIM("beats persistence downstream", "spatial_lo > 0", "format('lower bound {:+.1f} pts', spatial_lo * 100)"),
    _CLAIM("calibrated", "(SELECT sum(n * abs(mean_pred - observed)) / sum(n) FROM z_rel) <= 0.05::DOUBLE AND model_brier < persistence_brier",
           "format('Brier {:.4f} vs {:.4f}; ECE {:.3f}', model_brier, persistence_brier, (SELECT sum(n * abs(mean_pred - observed)) / sum(n) FROM z_rel))"),
    "SELECT 'time to map', 'Target', NULL", "SELECT 'coherence', 'Not built', NULL", "SELECT '24-hour collapse forecast', 'Dropped', NULL"]))
def _(i):
    from scarp.operators import metrics as M
    ece = M.ece(M.reliability(i.scores(), "p")).scalar()
    return A.claim_status(run_metrics(i).withColumns({"ece": ece, "processing_median_s": F.lit(None).cast("double")}))


fragment("z_replay", f"""
SELECT forecast_date, count(*) FILTER (rank <= {K} AND y = 1) AS hits, count(*) FILTER (rank <= {K} AND y = 0) AS false_alarms,
  count(*) FILTER (rank > {K} AND y = 1) AS misses, count(*) FILTER (y = 1) AS positives, count(*) FILTER (major = 1) AS majors,
  count(*) FILTER (rank <= {K} AND major = 1) AS majors_caught FROM z_pred2 GROUP BY 1""")


@register("replay_outcomes", f"SELECT * REPLACE ({day('forecast_date')} AS forecast_date) FROM z_replay")
def _(i):
    return A.replay_outcomes(i.predictions(), "rank", K)


@register("pick_default_date", f"""
SELECT {day('forecast_date')} AS forecast_date FROM z_index WHERE has_outcome = 1 ORDER BY NOT (split = 'test' AND month(z_index.forecast_date) BETWEEN 6 AND 9),
  CASE WHEN split = 'test' AND month(z_index.forecast_date) BETWEEN 6 AND 9 THEN positives END DESC NULLS LAST, z_index.forecast_date LIMIT 1""")
def _(i):
    return A.default_date(_index(i))


@register("segment_label", """
SELECT transect_id, CASE WHEN bank = 'W' THEN 'West' ELSE 'East' END || format(' bank, km {:.1f}', chainage_m / 1000) AS label FROM z_sup""")
def _(i):
    from scarp.functions.columns import segment_label
    return i.suppliers().select("transect_id", segment_label(F.col("transect_id")).alias("label"))


@register("pass_date", f"SELECT DISTINCT pass_id, {day('date')} AS date FROM z_panel")
def _(i):
    from scarp.functions.columns import pass_date
    return i.panel().select("pass_id", pass_date(F.col("pass_id")).alias("date")).distinct()


@register("misses_report", f"""
SELECT {day('forecast_date')} AS forecast_date, transect_id, rank, retreat_m FROM z_pred2 WHERE y = 1 AND rank > {K} ORDER BY retreat_m DESC, z_pred2.forecast_date, transect_id LIMIT 10""")
def _(i):
    return A.misses_report(i.predictions(), K)


@register("net_movement", f"""
WITH c AS (SELECT date, row_number() OVER (ORDER BY date) AS a, row_number() OVER (ORDER BY date DESC) AS z FROM z_cal)
SELECT transect_id, round(quantile_cont(bank_pos_m, 0.5::DOUBLE) FILTER (z <= 20) - quantile_cont(bank_pos_m, 0.5::DOUBLE) FILTER (a <= 20), 6) + 0.0::DOUBLE AS net_m
FROM z_panel JOIN c USING (date) WHERE a <= 20 OR z <= 20 GROUP BY 1""")
def _(i):
    return A.net_movement(i.panel(), i.calendar())


@register("valid_share_by_year", """
SELECT year(date)::INT AS year, round(count(bank_pos_m) / count(*)::DOUBLE, 6) AS valid_share FROM z_dup GROUP BY 1""")
def _(i):
    return A.valid_share_by_year(i.panel_dup())


@register("passes_by_year_platform", """
SELECT year(date)::INT AS year, count(*) FILTER (platform = 'S1A') AS "S1A", count(*) FILTER (platform = 'S1B') AS "S1B" FROM z_summary GROUP BY 1""")
def _(i):
    return A.passes_by_year_platform(i.pass_summary(), ["S1A", "S1B"])


@register("tier_counts", f"""
SELECT {day('forecast_date')} AS date, count(*) FILTER (raw_last_change_m >= 20) AS n_monitor, count(*) FILTER (tier IN ('watch', 'warning_eligible')) AS n_watch,
  count(*) FILTER (tier = 'warning_eligible') AS n_eligible FROM z_pred2 GROUP BY 1""")
def _(i):
    return A.tier_counts(A.prediction_rows(i.predictions(), THRESHOLD_M))


@register("latest_warning_date", f"SELECT {day('max(forecast_date)')} AS latest_warning FROM z_index WHERE n_warning > 0")
def _(i):
    return A.latest_warning_date(_index(i))


@register("prev_pass", f"""
WITH c AS (SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM z_cal)
SELECT a.transect_id, {day('a.date')} AS date, {day('c.prev')} AS prev_date, a.bank_pos_m, b.bank_pos_m AS prev_pos_m
FROM z_panel a JOIN c USING (date) JOIN z_panel b ON b.transect_id = a.transect_id AND b.date = c.prev""")
def _(i):
    d = lambda c: F.date_from_unix_date(c)
    return A.previous_pass_positions(i.panel(), i.calendar()).select(
        "transect_id", d("day").alias("date"), d("prev_day").alias("prev_date"), "bank_pos_m", "prev_pos_m")


@register("season_passes", f"""
SELECT pass_id, {day('date')} AS date FROM z_summary WHERE year(z_summary.date) = 2000 AND month(z_summary.date) BETWEEN 5 AND 10 AND otsu_ok = 1""")
def _(i):
    s = i.pass_summary()
    return A.season_passes(s, 2000, s.where("otsu_ok = 1").select("pass_id"))


@register("eligible_list", f"SELECT {day('forecast_date')} AS forecast_date, transect_id, rank, round(p, 6) AS p FROM z_pred2 WHERE tier = 'warning_eligible'")
def _(i):
    return A.eligible_list(i.predictions()).select("forecast_date", "transect_id", "rank", "p")


@register("outcome_series", f"SELECT {day('forecast_date')} AS forecast_date, p20_model, p20_persistence FROM z_index WHERE split = 'test' AND has_outcome = 1")
def _(i):
    return A.outcome_series(_index(i))
