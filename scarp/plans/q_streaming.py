"""Streaming queries: the panel arrives in files, the results must equal the batch ones."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from scarp import config as C
from scarp.operators.catalog import pending_passes
from scarp.operators.features import curvature
from scarp.plans import q_panel  # noqa: F401
from scarp.plans.catalogue import register
from scarp.plans.fixtures import THRESHOLD_M, Inputs
from scarp.plans.q_metrics import rank_sql
from scarp.plans.sqltext import day, r6
from scarp.session import scratch, stored
from scarp.streaming import incremental as S


def positions(i: Inputs):
    stage = i.stage().select(F.date_from_unix_date("day").alias("date"), F.col("stage_km2").alias("belt_water_km2"))
    return i.panel().join(F.broadcast(stage), "date")   # one row per pass


def land_in_files(df, path: str, cuts: list, files: int = 2) -> None:
    """Append the rows of each interval (cuts[n], cuts[n + 1]] in several files."""
    for a, b in zip(cuts[:-1], cuts[1:]):
        part = df.where((F.col("date") > F.lit(a).cast("date")) & (F.col("date") <= F.lit(b).cast("date")))
        part.repartition(files, "transect_id").write.mode("append").parquet(path)


def last_dates(i: Inputs, n: int) -> list[str]:
    """The last n pass dates of the calendar, oldest first."""
    rows = i.calendar().orderBy(F.desc("day")).limit(n).select(F.date_from_unix_date("day").cast("string")).collect()
    return sorted(r[0] for r in rows)


def calendar_cuts(i: Inputs, parts: int) -> list[str]:
    """Ends of ``parts`` stretches of the calendar (at most one row per day), before its first date to its last."""
    days = sorted(r[0] for r in i.calendar().select("day").collect())
    ends = [days[0] - 1, *(days[(k + 1) * len(days) // parts - 1] for k in range(parts))]
    return [str(dt.date(1970, 1, 1) + dt.timedelta(days=d)) for d in ends]


def _run_passes(i: Inputs) -> str:
    """Four passes on top of the history: one in two files, then an older one that is late, then two more in two files each."""
    base = scratch(i.spark, "pass-stream")
    p = positions(i)
    d = last_dates(i, 5)
    store, incoming = f"{base}/positions", f"{base}/incoming"
    transects = stored(curvature(i.transects()), "transects")
    S.store_positions(p.where(F.col("date") <= F.lit(d[0]).cast("date")), store)
    for a, b in ((1, 2), (0, 1), (2, 3), (3, 4)):
        land_in_files(p, incoming, [d[a], d[b]])
        S.run_incremental(i.spark, incoming, p.schema, store, f"{base}/out", f"{base}/checkpoint", transects,
                          threshold_m=THRESHOLD_M, score="ret_84_m")
    return f"{base}/out"


@register("incremental_pass", f"""
SELECT transect_id, {day('forecast_date')} AS forecast_date, {r6(*C.FEATURES)}, bank_pos_m, {rank_sql('ret_84_m')}::INT AS rank FROM z_features
WHERE forecast_date IN (SELECT date FROM z_cal ORDER BY date DESC LIMIT 4)""")
def _(i):
    out = _run_passes(i)
    f = S.published(i.spark, out, "features").select("transect_id", "forecast_date", *C.FEATURES, "bank_pos_m")
    ranks = S.published(i.spark, out, "ranks").select("transect_id", "forecast_date", "rank")
    return f.join(ranks, ["transect_id", "forecast_date"])


@register("incremental_labels", f"""
SELECT transect_id, {day('forecast_date')} AS forecast_date, {day('target_date')} AS target_date, {r6('retreat_m', 'window_retreat_m', 'permanent_retreat_m')}, y
FROM z_labels WHERE forecast_date >= (SELECT date FROM z_cal ORDER BY date DESC LIMIT 1 OFFSET 3) - INTERVAL {S.LABEL_REACH_DAYS} DAY""")
def _(i):
    labels = S.published(i.spark, _run_passes(i), "labels")
    return labels.select("transect_id", "forecast_date", "target_date", "retreat_m", "window_retreat_m", "permanent_retreat_m", "y")


@register("incremental_skip", "SELECT pass_id FROM z_summary WHERE date_diff('day', DATE '1995-01-01', date) // 12 % 3 = 0 OR water_fraction > 0.5::DOUBLE")
def _(i):
    s = i.pass_summary().withColumn("b", F.floor(F.datediff("date", F.lit("1995-01-01").cast("date")) / 12))
    ts = F.col("date").cast("timestamp")
    inputs = s.select("pass_id", F.when(F.col("water_fraction") > 0.5, ts + F.expr("interval 2 days")).otherwise(ts).alias("input_ts"))
    done = s.where("b % 3 <> 0").select("pass_id", (ts + F.expr("interval 1 day")).alias("result_ts"))
    return pending_passes(inputs, done)


@register("stream_pass_counts", f"SELECT {day('date')} AS date, count(*) AS n, round(count(bank_pos_m) / count(*)::DOUBLE, 6) AS valid_share FROM z_panel GROUP BY 1")
def _(i):
    base = scratch(i.spark, "count-stream")
    p = i.panel().select("transect_id", "date", "bank_pos_m")
    land_in_files(p, f"{base}/incoming", calendar_cuts(i, 4), files=1)
    return S.run_pass_counts(i.spark, f"{base}/incoming", p.schema, f"{base}/out", f"{base}/checkpoint")


@register("stream_last_change", f"""
SELECT transect_id, {day('date')} AS date, CASE WHEN date_diff('day', lag(date) OVER w, date) <= 30 THEN bank_pos_m - lag(bank_pos_m) OVER w END AS change_m
FROM z_panel WINDOW w AS (PARTITION BY transect_id ORDER BY z_panel.date)""")
def _(i):
    base = scratch(i.spark, "change-stream")
    p = i.panel().select("transect_id", "date", "bank_pos_m")
    land_in_files(p, f"{base}/incoming", calendar_cuts(i, 4), files=1)
    return S.run_last_changes(i.spark, f"{base}/incoming", p.schema, f"{base}/out", f"{base}/checkpoint")
