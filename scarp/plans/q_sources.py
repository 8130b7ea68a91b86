"""Catalogue, source and sink queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from scarp.operators import catalog as CT
from scarp.operators import serving as A
from scarp.plans import q_serving  # noqa: F401
from scarp.plans.catalogue import register
from scarp.plans.fixtures import Inputs
from scarp.plans.q_panel import gauge
from scarp.plans.sqltext import day, fragment
from scarp.session import scratch
from scarp.sources import io


@register("src_positions", f"SELECT transect_id, pass_id, {day('date')} AS date, bank_pos_m FROM z_dup")
def _(i):
    # missing values are written as NaN here to show that they come back as NULL
    path = scratch(i.spark, "positions")
    nan = F.coalesce("bank_pos_m", F.lit(float("nan")))
    i.panel_dup().select("transect_id", "pass_id", "date", nan.alias("bank_pos_m")).write.parquet(path)
    return io.read_positions(i.spark, path)


@register("src_csv_series", f"SELECT {day('o_orderdate')} AS date, count(*)::DOUBLE AS value FROM orders WHERE isodow(o_orderdate) < 6 GROUP BY 1")
def _(i):
    path = scratch(i.spark, "gauge")
    gauge(i).select(F.date_from_unix_date("day").alias("date"), "value").write.csv(path, header=True)
    return io.read_series_csv(i.spark, path)


@register("src_csv_summary", f"SELECT pass_id, {day('date')} AS date, platform, round(coverage, 6) AS coverage, otsu_ok FROM z_summary")
def _(i):
    path = scratch(i.spark, "summary")
    i.pass_summary().select("pass_id", "date", "platform", "coverage", "otsu_ok").write.csv(path, header=True)
    return io.read_summary_csv(i.spark, path, "pass_id string, date date, platform string, coverage double, otsu_ok int")


def slices(i: Inputs):
    li = i.table("lineitem")
    x = (F.col("l_partkey") % 180).cast("double")
    return li.select(F.col("l_linestatus").alias("platform"), F.col("l_orderkey").alias("datatake"),
                     (F.col("l_shipdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("l_linenumber").cast("decimal(18,6)"))).alias("start"),
                     F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("product_id"),
                     (F.col("l_suppkey") % 7 + 147).cast("int").alias("relative_orbit"), x.alias("xmin"), (x + 3).alias("xmax"),
                     (F.col("l_quantity") - 10).alias("ymin"), (F.col("l_quantity") - 7).alias("ymax"))


fragment("z_slices", """
SELECT l_linestatus AS platform, l_orderkey AS datatake, l_shipdate + l_linenumber * INTERVAL 1 SECOND AS start, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS product_id,
  (l_suppkey % 7 + 147)::INT AS relative_orbit, l_partkey % 180 AS xmin, l_partkey % 180 + 3 AS xmax, l_quantity - 10 AS ymin, l_quantity - 7 AS ymax FROM lineitem""")
fragment("z_passes", """
SELECT platform, datatake, min(start)::DATE AS date, strftime(min(start), '%Y%m%d') || '_' || platform AS pass_id, string_agg(product_id, ',' ORDER BY start, product_id) AS products, count(*) AS n
FROM z_slices GROUP BY platform, datatake""")


@register("catalog_filter", """
SELECT event_id, strftime(ts, '%H%M%S') AS hhmmss FROM events WHERE strftime(ts, '%H%M%S') BETWEEN '234500' AND '235959'""")
def _(i):
    p = i.table("events").withColumn("product_id", F.concat_ws("_", F.lit("S1A"), F.lit("IW"), F.lit("GRDH"), F.lit("1SDV"),
                                                               F.date_format("ts", "yyyyMMdd'T'HHmmss"), F.col("event_id").cast("string")))
    return CT.products_in_window(p).select("event_id", F.date_format("ts", "HHmmss").alias("hhmmss"))


@register("catalog_aoi", """
SELECT product_id, datatake FROM z_slices WHERE relative_orbit = 150 AND xmin <= 90 AND xmax >= 89 AND ymin <= 25 AND ymax >= 24""")
def _(i):
    return CT.slices_over(slices(i), (89.0, 24.0, 90.0, 25.0), 150).select("product_id", "datatake")


def passes(i: Inputs):
    return CT.group_passes(slices(i), ["product_id", "relative_orbit"])


@register("catalog_group_passes", f"SELECT pass_id, {day('date')} AS date, platform, datatake, products FROM z_passes")
def _(i):
    return passes(i).select("pass_id", "date", "platform", "datatake",
                            F.array_join(F.transform("slices", lambda s: s["product_id"]), ",").alias("products"))


@register("src_json_nested", f"""
SELECT p.pass_id, {day('p.date')} AS date, s.product_id, s.relative_orbit FROM z_passes p JOIN z_slices s USING (platform, datatake)""")
def _(i):
    path = scratch(i.spark, "catalog")
    passes(i).write.json(path)
    return io.read_catalog(i.spark, path).select("pass_id", "date", F.explode("slices").alias("s")).select(
        "pass_id", "date", "s.product_id", "s.relative_orbit")


@register("date_spine", f"""
SELECT {day('d')} AS date FROM (SELECT unnest(generate_series(min(o_orderdate)::DATE, max(o_orderdate)::DATE, INTERVAL 1 DAY)) AS d FROM orders)""")
def _(i):
    d = F.col("o_orderdate").cast("date")
    return CT.day_spine(i.table("orders").agg(F.min(d).alias("first"), F.max(d).alias("last")))


@register("summary_upsert", f"""
WITH n AS (SELECT pass_id, date, water_fraction + 0.5::DOUBLE AS water_fraction FROM z_summary WHERE year(date) = 1999)
SELECT pass_id, {day('date')} AS date, round(water_fraction, 6) AS water_fraction FROM (
  SELECT pass_id, date, water_fraction FROM z_summary WHERE pass_id NOT IN (SELECT pass_id FROM n) UNION ALL SELECT * FROM n)""")
def _(i):
    old = i.pass_summary().select("pass_id", "date", "water_fraction")
    new = CT.passes_of_years(old, [1999]).withColumn("water_fraction", F.col("water_fraction") + 0.5)
    return CT.upsert_by_pass(old, new).orderBy("date")


@register("passes_by_year_filter", f"SELECT pass_id, {day('date')} AS date FROM z_summary WHERE year(z_summary.date) IN (1996, 2000)")
def _(i):
    return CT.passes_of_years(i.pass_summary(), [1996, 2000]).select("pass_id", "date")


_PRED = ("transect_id, {d} AS forecast_date, bank, round(p, 6) AS p, rank, tier, year")


@register("sink_partitioned", f"SELECT {_PRED.format(d=day('forecast_date'))} FROM z_pred2")
def _(i):
    path = scratch(i.spark, "predictions")
    io.write_partitioned(i.predictions(), path, A.KEEP)
    return io.read_partitioned(i.spark, path).select("transect_id", "forecast_date", "bank", "p", "rank", "tier", "year")


@register("src_partitioned", f"SELECT {_PRED.format(d=day('forecast_date'))} FROM z_pred2 WHERE year = 2000")
def _(i):
    path = scratch(i.spark, "predictions")
    io.write_partitioned(i.predictions(), path, A.KEEP)
    # the year predicate prunes whole folders
    return io.read_partitioned(i.spark, path).where("year = 2000").select(
        "transect_id", "forecast_date", "bank", "p", "rank", "tier", "year")


@register("sink_jsonl_append", """
SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('purchase', 'error') ORDER BY ts DESC, event_id DESC LIMIT 50""")
def _(i):
    path = scratch(i.spark, "outbox")
    ev = i.table("events").select("event_id", "ts", "user_id", "event_type")
    for kind in ("purchase", "error"):   # two appends to one log
        io.append_jsonl(ev.where(F.col("event_type") == kind), path)
    return io.read_last_jsonl(i.spark, path, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string",
                              ["ts", "event_id"], 50).select("event_id", "user_id", "event_type")
