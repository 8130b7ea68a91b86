"""Tiers, predictions, serving tables and replay summaries."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scarp import config as C
from scarp.functions import columns as K
from scarp.functions.ordering import key_hash, rank_rows, running_sums, top_rows
from scarp.operators import explain as X
from scarp.operators.boosting import BoostedModel
from scarp.operators.isotonic import Calibrator
from scarp.session import stored

KEEP = ["transect_id", "forecast_date", "bank", "chainage_m", "lon", "lat", "p", "raw", "rank", "b0_rank", "b0_p",
        "tier", "reasons", "ret_28_m", "ret_84_m", "ret_365_m", "raw_last_change_m", "bank_pos_m",
        "dist_main_channel_m", "char_shield_frac", "target_date", "retreat_m", "y", "major"]


def tier_threshold(val: DataFrame, prob: str = "p", keys: Sequence[str] = ("forecast_date", "transect_id")) -> DataFrame:
    """Lowest probability whose cumulative hit rate from the top is >= 0.5 (3 decimals); the maximum if there is none.

    Rows are taken one by one in the order (p desc, key hash), as a running count, not as a global window.
    """
    v = val.where(F.col(prob).isNotNull() & F.col("y").isNotNull()).withColumn("_tie", key_hash(*keys))
    run = running_sums(v, [], prob, {"_hits": F.col("y"), "_n": F.lit(1)}, tie="_tie", keys=keys)
    floor = F.min(F.when(F.col("_hits") >= 0.5 * F.col("_n"), F.col(prob)))
    return run.agg(F.round(F.coalesce(floor, F.max(prob)), 3).alias("warning_min_prob"))


def assign_tiers(floor: Column, threshold_m: float, k: int = C.TOP_K) -> Column:
    moved = F.coalesce("raw_last_change_m", F.lit(0.0)) >= threshold_m
    watch = F.col("rank") <= k
    return (F.when(watch & (F.col("p") >= floor) & moved, "warning_eligible").when(watch, "watch")
            .when(moved, "monitor").otherwise("none"))


def rank_predictions(scored: DataFrame, by: Sequence[str] = ("forecast_date",)) -> DataFrame:
    """rank by the raw score (calibration never reverses it, so this is the order by (p, raw)); b0_rank by ret_84_m.

    The input is evaluated once and written; both rankings read its narrow columns and the ranks are joined back by the number a
    row got there, so rows that repeat a key, or have none, stay as many as they were.
    """
    keys = ("forecast_date", "transect_id")
    rows = stored(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")
    cols = list(dict.fromkeys([*by, *keys]))
    first = rank_rows(rows.select("_row", *cols, "raw"), by, "raw", keys).select("_row", "rank")
    second = rank_rows(rows.select("_row", *cols, "ret_84_m"), by, "ret_84_m", keys, "b0_rank").select("_row", "b0_rank")
    return rows.join(first, "_row").join(second, "_row").drop("_row")


def publish(features: DataFrame, model: BoostedModel, cal: Calibrator, base_cal: Calibrator, measured: Column, threshold_m: float,
            k: int = C.TOP_K, told: int = C.REASONS_TOP_RANK) -> DataFrame:
    """From features (with outcomes, where known, and places) to published rows by a trained model.

    One Arrow pass gives score, probability and attributions. The warning floor is measured on the rows that ``measured``
    picks; ranks, tiers and the reasons of the first ``told`` ranks of each date follow.
    """
    ranked = rank_predictions(base_cal.apply(X.model_scores(features, model, cal), "ret_84_m", "b0_p"))
    floor = tier_threshold(ranked.where(measured)).scalar()
    tiered = ranked.withColumn("tier", assign_tiers(floor, threshold_m, k))
    return tiered.withColumn("reasons", F.when(F.col("rank") <= told, X.reasons(model.features)))


def prediction_index(pred: DataFrame, split: Column, k: int = C.TOP_K) -> DataFrame:
    """One row per date. The top k among labelled rows come from group-limited windows, not from whole dates."""
    labelled = pred.where(F.col("y").isNotNull()).select("forecast_date", "rank", "b0_rank", "y")

    def top(col: str, name: str) -> DataFrame:
        t = top_rows(labelled, ["forecast_date"], [F.col(col)], k, "_r")
        full = F.when(F.count(F.lit(1)) == k, F.round(F.avg("y"), 3))
        return t.groupBy("forecast_date").agg(full.alias(name))

    base = pred.groupBy("forecast_date").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("y").isNotNull()).cast("int").alias("has_outcome"),
        K.sum_if(F.col("tier") == "warning_eligible").alias("n_warning"), F.sum("y").alias("positives"))
    return (base.join(top("rank", "p20_model"), "forecast_date", "left")
            .join(top("b0_rank", "p20_persistence"), "forecast_date", "left")
            .withColumns({"year": F.year("forecast_date"), "split": split}))


def prediction_rows(pred: DataFrame, threshold_m: float) -> DataFrame:
    whole = lambda c: F.bround(c, 0)
    return pred.select(
        F.col("forecast_date").alias("date"), F.col("transect_id").alias("id"), F.round("p", 4).alias("p"), "rank",
        "b0_rank", "tier", whole("ret_28_m").alias("ret28"), whole("ret_84_m").alias("ret84"),
        whole("ret_365_m").alias("ret365"), whole("raw_last_change_m").alias("last"), whole("bank_pos_m").alias("pos"),
        F.coalesce(F.col("raw_last_change_m") >= threshold_m, F.lit(False)).alias("mon"), "y",
        whole("retreat_m").alias("retreat"), "major", F.col("target_date").alias("target"),
        F.transform("reasons", lambda r: r["text"]).alias("reasons"))


def write_documents(rows: DataFrame, index: DataFrame, path: str) -> None:
    """One JSON document per date below ``path``/dates, and its index entry below ``path``/index.

    ``rows`` (``prediction_rows``) and ``index`` (``prediction_index``) name the dates: those are replaced whole, others stay as they are. A
    document holds one date's segments by rank, so it is bounded by the segments, not by the archive.
    """
    cols = [c for c in rows.columns if c != "date"]
    docs = rows.groupBy(F.col("date").alias("forecast_date")).agg(
        F.array_sort(F.collect_list(F.struct("rank", *[c for c in cols if c != "rank"]))).alias("segments"))
    for df, name in ((docs, "dates"), (index, "index")):
        (df.repartition("forecast_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .option("ignoreNullFields", "false").partitionBy("forecast_date").json(f"{path}/{name}"))


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, index) as ``write_documents`` left them."""
    return spark.read.json(f"{path}/dates"), spark.read.json(f"{path}/index")


def passes_summary(positions: DataFrame, summary: DataFrame) -> DataFrame:
    stage = positions.groupBy("pass_id").agg(
        F.min_by("belt_water_km2", F.when(F.col("belt_water_km2").isNotNull(), F.col("transect_id"))).alias("stage_km2"),
        (F.count("bank_pos_m") / F.count(F.lit(1))).alias("valid_share"))
    return summary.join(stage, "pass_id", "left").select(
        "pass_id", "date", "platform", "otsu_ok", F.round("t_vv", 2).alias("t_vv"),
        F.round("water_area_km2", 1).alias("water_area_km2"), F.round("stage_km2", 1).alias("stage_km2"),
        F.round("valid_share", 3).alias("valid_share"))


def banks_by_year(positions: DataFrame) -> DataFrame:
    """(year, transect, passes, pos): positions of a segment over the year's passes, whole metres, NULL gaps.

    One row per segment and year keeps every array within a year of passes, however many segments there are.
    """
    pos = positions.select("transect_id", "pass_id", "bank_pos_m", F.year("date").alias("year"))
    header = pos.select("year", "pass_id").distinct().groupBy("year").agg(
        F.array_sort(F.collect_list("pass_id")).alias("passes"))
    seen = (pos.where("bank_pos_m IS NOT NULL").groupBy("year", "transect_id", "pass_id")
            .agg(F.bround(F.first("bank_pos_m"), 0).cast("int").alias("v"))
            .groupBy("year", "transect_id").agg(F.map_from_entries(F.collect_list(F.struct("pass_id", "v"))).alias("_m")))
    years = header.agg(F.collect_list("year"))
    grid = pos.select("transect_id").distinct().withColumn("year", F.explode(years.scalar()))
    # the header has one row per year of the archive
    return (grid.join(seen, ["year", "transect_id"], "left").join(F.broadcast(header), "year")
            .select("year", "transect_id", "passes",
                    F.transform("passes", lambda p: F.try_element_at("_m", p)).alias("pos")))


def segment_history(positions: DataFrame, transect_id: str, until: str | None = None) -> DataFrame:
    out = positions.where(F.col("transect_id") == transect_id)
    if until:
        out = out.where(F.col("date") <= F.lit(until).cast("date"))
    return out.select("date", F.bround("bank_pos_m", 0).cast("int").alias("pos")).orderBy("date")


def top_predictions(pred: DataFrame, date: str, n: int) -> DataFrame:
    return pred.where(F.col("forecast_date") == F.lit(date).cast("date")).orderBy("rank").limit(n)


def brief_table(pred: DataFrame, k: int = C.TOP_K) -> DataFrame:
    texts = F.transform(F.slice("reasons", 1, 2), lambda r: r["text"])
    bank = F.when(F.col("bank") == "W", C.BANK_NAMES["W"]).otherwise(C.BANK_NAMES["E"])
    return pred.where(F.col("rank") <= k).select(
        "forecast_date", "rank", "transect_id", bank.alias("bank_name"),
        F.concat(K.fixed(F.col("lat"), 4), F.lit(", "), K.fixed(F.col("lon"), 4)).alias("lat_lon"),
        K.percent(F.col("p")).alias("risk"),
        F.coalesce(F.concat(K.signed(F.col("raw_last_change_m")), F.lit(" m")), F.lit("–")).alias("latest_pass"),
        F.coalesce(F.nullif(F.array_join(texts, "; "), F.lit("")), F.lit("–")).alias("why"))


def replay_outcomes(pred: DataFrame, rank: str = "rank", k: int = C.TOP_K) -> DataFrame:
    """Per date: hits, false alarms and misses of the top k, positives, majors and majors caught."""
    top, y, m = F.col(rank) <= k, F.col("y") == 1, F.col("major") == 1
    n = K.sum_if
    return pred.groupBy("forecast_date").agg(
        n(top & y).alias("hits"), n(top & (F.col("y") == 0)).alias("false_alarms"), n(~top & y).alias("misses"),
        n(y).alias("positives"), n(m).alias("majors"), n(top & m).alias("majors_caught"))


def default_date(index: DataFrame) -> DataFrame:
    """Test date in June-September with the most positives; else the first date with an outcome."""
    demanding = index.where((F.col("split") == "test") & (F.col("has_outcome") == 1)
                            & F.month("forecast_date").isin(6, 7, 8, 9))
    a = demanding.orderBy(F.desc_nulls_last("positives"), "forecast_date").limit(1).select(
        F.lit(0).alias("pref"), "forecast_date")
    b = index.where("has_outcome = 1").orderBy("forecast_date").limit(1).select(F.lit(1).alias("pref"), "forecast_date")
    return a.unionByName(b).orderBy("pref").limit(1).select("forecast_date")


def misses_report(pred: DataFrame, k: int = C.TOP_K, n: int = 10) -> DataFrame:
    return (pred.where((F.col("y") == 1) & (F.col("rank") > k))
            .orderBy(F.desc("retreat_m"), "forecast_date", "transect_id").limit(n)
            .select("forecast_date", "transect_id", "rank", "retreat_m"))


def net_movement(positions: DataFrame, calendar: DataFrame, passes: int = 20) -> DataFrame:
    """Median over the last passes minus median over the first; at most 2 x ``passes`` values per segment."""
    w = Window.orderBy("day")   # calendar-sized
    n = calendar.withColumns({"_a": F.row_number().over(w), "_z": F.row_number().over(Window.orderBy(F.desc("day")))})
    ends = n.where((F.col("_a") <= passes) | (F.col("_z") <= passes))
    p = positions.withColumn("day", F.unix_date("date")).join(F.broadcast(ends), "day")
    med = lambda c: F.percentile(F.when(F.col(c) <= passes, F.col("bank_pos_m")), F.lit(0.5))
    return p.groupBy("transect_id").agg((med("_z") - med("_a")).alias("net_m"))


def valid_share_by_year(positions: DataFrame) -> DataFrame:
    return positions.groupBy(F.year("date").alias("year")).agg(
        (F.count("bank_pos_m") / F.count(F.lit(1))).alias("valid_share"))


def passes_by_year_platform(summary: DataFrame, platforms: Sequence[str]) -> DataFrame:
    return summary.groupBy(F.year("date").alias("year")).pivot("platform", list(platforms)).count().fillna(
        0, list(platforms))


def tier_counts(rows: DataFrame) -> DataFrame:
    t = F.col("tier")
    return rows.groupBy("date").agg(
        K.sum_if(F.col("mon")).alias("n_monitor"), K.sum_if(t.isin("watch", "warning_eligible")).alias("n_watch"),
        K.sum_if(t == "warning_eligible").alias("n_eligible"))


def latest_warning_date(index: DataFrame) -> DataFrame:
    return index.where("n_warning > 0").agg(F.max("forecast_date").alias("latest_warning"))


def previous_pass_positions(positions: DataFrame, calendar: DataFrame) -> DataFrame:
    """Each pass with the one before it and both positions. The calendar map is bounded by the days of the archive."""
    prev = calendar.withColumn("prev_day", F.lag("day").over(Window.orderBy("day"))).where("prev_day IS NOT NULL")
    p = positions.select("transect_id", F.unix_date("date").alias("day"), "bank_pos_m")
    before = p.select("transect_id", F.col("day").alias("prev_day"), F.col("bank_pos_m").alias("prev_pos_m"))
    return p.join(F.broadcast(prev), "day").join(before, ["transect_id", "prev_day"])


def season_passes(summary: DataFrame, year: int, images: DataFrame) -> DataFrame:
    return (summary.where((F.year("date") == year) & F.month("date").between(5, 10))
            .join(images, "pass_id", "left_semi").select("pass_id", "date").orderBy("date"))


def ablation_rank(ablation: DataFrame) -> DataFrame:
    return ablation.where(F.col("variant").like("-%")).orderBy("delta_precision_at_k").select(
        "variant", "n_features", "delta_precision_at_k")


def eligible_list(pred: DataFrame) -> DataFrame:
    return pred.where(F.col("tier") == "warning_eligible").orderBy("forecast_date", "rank")


def outcome_series(index: DataFrame) -> DataFrame:
    return index.where((F.col("split") == "test") & (F.col("has_outcome") == 1)).select(
        "forecast_date", "p20_model", "p20_persistence").orderBy("forecast_date")


def claim_status(run: DataFrame) -> DataFrame:
    """Status rules over one wide metric row per run -> (claim, status, value)."""
    c = F.col
    ok = lambda cond: F.when(cond, "Measured").otherwise("Not met")
    pts = lambda x: K.signed(c(x) * 100.0, 1)
    num = lambda x: c(x).cast("string")

    def row(claim: str, have: Column, status: Column, value: Column) -> Column:
        return F.struct(F.lit(claim).alias("claim"), F.when(have, status).otherwise("Target").alias("status"),
                        F.when(have, value).alias("value"))

    fixed_rows = [F.struct(F.lit(n).alias("claim"), F.lit(s).alias("status"), F.lit(None).cast("string").alias("value"))
                  for n, s in (("coherence", "Not built"), ("24-hour collapse forecast", "Dropped"))]
    rows = F.array(
        row("bank error", c("bank_error_median_m").isNotNull(), ok(c("bank_error_median_m") <= 20.0),
            F.concat(F.lit("median "), K.fixed(c("bank_error_median_m")), F.lit(" m"))),
        row("coverage", c("passes_in_catalog").isNotNull(), ok(c("passes_processed") == c("passes_in_catalog")),
            F.concat(num("passes_processed"), F.lit(" of "), num("passes_in_catalog"), F.lit(" passes"))),
        row("beats persistence", c("temporal_lo").isNotNull(), ok(c("temporal_lo") > 0),
            F.concat(F.lit("lower bound "), pts("temporal_lo"), F.lit(" pts"))),
        row("beats persistence downstream", c("spatial_lo").isNotNull(), ok(c("spatial_lo") > 0),
            F.concat(F.lit("lower bound "), pts("spatial_lo"), F.lit(" pts"))),
        row("calibrated", c("ece").isNotNull(), ok((c("ece") <= 0.05) & (c("model_brier") < c("persistence_brier"))),
            F.concat(F.lit("Brier "), K.fixed(c("model_brier"), 4), F.lit(" vs "), K.fixed(c("persistence_brier"), 4),
                     F.lit("; ECE "), K.fixed(c("ece"), 3))),
        row("time to map", c("processing_median_s").isNotNull(), F.lit("Measured"),
            F.concat(F.lit("median "), K.fixed(c("processing_median_s")), F.lit(" s"))),
        *fixed_rows)
    return run.select(*[x for x in ("run",) if x in run.columns], F.inline(rows))
