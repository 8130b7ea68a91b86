"""Incremental updates with Structured Streaming: one new pass at a time, bounded history."""
from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scarp import config as C
from scarp.operators import panel as P
from scarp.operators.features import features_of_dates, stage_per_pass
from scarp.operators.labels import make_labels
from scarp.operators.metrics import rank_within_date

# ret_365_m compares with a pass up to 365 + 30 days back whose permanent bank looks back another 180 days
HISTORY_DAYS = 365 + 30 + C.PERMANENT_DAYS
# a late pass changes labels from this many days before it
LABEL_REACH_DAYS = C.HORIZON_DAYS + C.TARGET_TOL_DAYS + C.PERMANENT_DAYS
LABEL_HISTORY_DAYS = LABEL_REACH_DAYS + max(C.CURRENT_DAYS, C.TARGET_HALF_DAYS)
KEY = ("date", "pass_id", "transect_id")
FIRST_LOAD = -1


def _replace(rows: DataFrame, path: str, *by: str) -> None:
    """Write the partitions that ``rows`` has; the others stay. Rebalancing makes few files each and splits a large one."""
    (rows.hint("rebalance", by[0]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*by).parquet(path))


def _passes(store: str) -> str:
    return f"{store.rstrip('/')}-passes"


def store_positions(rows: DataFrame, store: str, batch: int = FIRST_LOAD) -> None:
    """Positions by (date, batch), and beside them one stage row per pass.

    A replayed batch replaces its own rows only. A pass may arrive in many batches: ``stored_positions`` puts it together.
    """
    _replace(rows.withColumn("batch", F.lit(batch)), store, "date", "batch")
    water = F.max_by("belt_water_km2", F.when(F.col("belt_water_km2").isNotNull(), F.col("transect_id")))
    passes = rows.groupBy("date", "pass_id").agg(water.alias("belt_water_km2")).withColumn("batch", F.lit(batch))
    _replace(passes, _passes(store), "batch")


def stored_positions(spark: SparkSession, store: str) -> DataFrame:
    """One row per (date, pass, segment): the one that came last."""
    return latest_rows(spark.read.parquet(store))


def latest_rows(rows: DataFrame, columns: Sequence[str] | None = None, since_date: Column | None = None) -> DataFrame:
    """The last row of a store per (date, pass, segment). ``columns`` are read besides the key, from ``since_date`` on.

    Rows are dealt out by segment, which serves this and every later grouping of a segment's rows.
    """
    rest = [c for c in rows.columns if c not in (*KEY, "batch") and (columns is None or c in columns)]
    if since_date is not None:
        rows = rows.where(F.col("date") >= since_date)
    rows = rows.select(*KEY, "batch", *rest).repartition("transect_id")
    return rows.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*KEY, "_r.*")


def stored_stage(spark: SparkSession, store: str) -> DataFrame:
    """The stage series from the pass table: a row per pass and batch, not per position."""
    rows = spark.read.parquet(_passes(store)).where("belt_water_km2 IS NOT NULL")
    last = rows.groupBy("date", "pass_id").agg(F.max_by("belt_water_km2", "batch").alias("belt_water_km2"))
    days = spark.read.parquet(_passes(store)).select("date", "pass_id").distinct()
    return stage_per_pass(days.join(last, ["date", "pass_id"], "left"))


def _before(first: object, days: int = 0) -> Column:
    return F.date_sub(F.lit(first).cast("date"), days)


def since(col: str, first: object, days: int = 0) -> Column:
    return F.col(col) >= _before(first, days)


# --- published versions --------------------------------------------------------------------------------------------
def _at(out: str, table: str, version: str) -> str:
    return f"{out.rstrip('/')}/{table}/version={version}"


def _write(rows: DataFrame, out: str, table: str, version: str) -> DataFrame:
    """Write a version of a table by forecast date, of which nobody reads before ``_commit``; gives it back as written."""
    path = _at(out, table, version)
    rows.hint("rebalance", "forecast_date").write.partitionBy("forecast_date").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _commit(written: Mapping[str, DataFrame], out: str, version: str, batch: int) -> None:
    """Show a version of all its tables at once: one manifest file, a row per table and forecast date."""
    dates = [d.select(F.lit(t).alias("name"), "forecast_date").distinct() for t, d in written.items()]
    rows = reduce(DataFrame.unionByName, dates).withColumn("version", F.lit(version))
    rows.coalesce(1).write.mode("overwrite").parquet(f"{out.rstrip('/')}/manifest/batch={batch}")


def published(spark: SparkSession, out: str, table: str) -> DataFrame:
    """What the last committed batch of each forecast date wrote. A refresh under way or failed is not seen.

    The manifest has a row per table, batch and date. The versions in use, at most one per date, name the folders to read.
    """
    seen = spark.read.parquet(f"{out.rstrip('/')}/manifest").where(F.col("name") == table)
    last = seen.groupBy("forecast_date").agg(F.max_by("version", "batch").alias("version"))
    used = [r[0] for r in last.select("version").distinct().collect()]
    if not used:
        raise ValueError(f"nothing published of {table}")
    rows = spark.read.option("basePath", f"{out.rstrip('/')}/{table}").parquet(*[_at(out, table, v) for v in used])
    return rows.join(F.broadcast(last), ["forecast_date", "version"]).drop("version")


def refresh(spark: SparkSession, store: str, first: object, transects: DataFrame, out: str, batch: int = FIRST_LOAD,
            threshold_m: float | None = None, score: str | None = None) -> None:
    """Everything that positions from ``first`` on can change, as one new version below ``out``: ``features`` of the forecast
    dates from then on, their ``ranks`` by ``score``, and ``labels`` (with a threshold) back to ``LABEL_REACH_DAYS`` before.

    Whole positions are read from ``first`` on; of the look-back two columns only. Labels do not wait for features.
    """
    version = f"v{batch}-{uuid.uuid4().hex[:8]}"
    rows = spark.read.parquet(store)   # listed once
    passes = spark.read.parquet(_passes(store)).where(since("date", first, HISTORY_DAYS))
    maps = P.calendar_maps(P.pass_calendar(passes))

    def features() -> dict[str, DataFrame]:
        fresh = latest_rows(rows, since_date=_before(first))
        history = latest_rows(rows, ["bank_pos_m", "dist_main_channel_m"], _before(first, HISTORY_DAYS))
        done = {"features": _write(features_of_dates(fresh, history, transects, stored_stage(spark, store), maps), out, "features", version)}
        if score:
            slim = done["features"].select("forecast_date", "transect_id", score)
            done["ranks"] = _write(rank_within_date(slim, score), out, "ranks", version)
        return done

    def labels() -> dict[str, DataFrame]:
        if threshold_m is None:
            return {}
        near = latest_rows(rows, ["bank_pos_m"], _before(first, LABEL_HISTORY_DAYS))
        y = make_labels(near, threshold_m).where(since("forecast_date", first, LABEL_REACH_DAYS))
        return {"labels": _write(y, out, "labels", version)}

    with ThreadPoolExecutor(2) as pool:
        parts = [pool.submit(inheritable_thread_target(spark)(f)) for f in (features, labels)]
        written = {t: d for p in parts for t, d in p.result().items()}
    _commit(written, out, version, batch)


def run_incremental(spark: SparkSession, incoming: str, schema, store: str, out: str, checkpoint: str, transects: DataFrame,
                    files_per_batch: int = 8, **more) -> None:
    """Process every pending file and stop. A batch is stored, then what its oldest date touches is refreshed.

    ``more`` goes to ``refresh``: the threshold of the labels, the score of the ranks. Transects that carry
    ``baseline_curvature`` save each batch its computation.
    """
    def on_batch(batch: DataFrame, number: int) -> None:
        store_positions(batch, store, number)
        first = spark.read.parquet(_passes(store)).where(F.col("batch") == number).agg(F.min("date").cast("string")).first()[0]
        if first is not None:
            refresh(spark, store, first, transects, out, number, **more)

    (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(incoming)
     .writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def pass_counts(stream: DataFrame, ts: str = "ts", late: str = "30 days") -> DataFrame:
    """Rows and valid share per day of incoming positions; rows later than ``late`` are dropped."""
    return (stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"))
            .agg(F.count(F.lit(1)).alias("n"), F.count("bank_pos_m").alias("n_valid")))


def run_pass_counts(spark: SparkSession, incoming: str, schema, out: str, checkpoint: str) -> DataFrame:
    """Run to the end and return the final state: the last update of every window."""
    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(incoming)
    (pass_counts(s.withColumn("ts", F.col("date").cast("timestamp"))).writeStream.outputMode("update").foreachBatch(
        keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())
    updates = spark.read.parquet(out)
    w = Window.partitionBy("w").orderBy(F.desc("batch"))
    last = updates.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return last.select(F.col("w.start").cast("date").alias("date"), "n", (F.col("n_valid") / F.col("n")).alias("valid_share"))


CHANGE_SCHEMA = "transect_id string, date date, change_m double"


def _changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Change against the last position seen; rows not newer than the state are late and ignored."""
    rows = pd.concat(list(batches)).sort_values("day", kind="stable")
    last_day, last_pos = state.get if state.exists else (None, None)
    if last_day is not None:
        rows = rows[rows["day"] > last_day]
    rows = rows.drop_duplicates("day").astype({"bank_pos_m": float})
    before = rows[["day", "bank_pos_m"]].shift(1)
    if len(rows) and last_day is not None:
        before.iloc[0] = (last_day, float("nan") if last_pos is None else last_pos)
    near = rows["day"] - before["day"] <= C.LAST_CHANGE_MAX_DAYS
    if len(rows):
        last = rows.iloc[-1]
        state.update((int(last["day"]), None if pd.isna(last["bank_pos_m"]) else float(last["bank_pos_m"])))
    yield pd.DataFrame({"transect_id": key[0], "date": pd.to_datetime(rows["day"].astype("int64"), unit="D").dt.date,
                        "change_m": (rows["bank_pos_m"] - before["bank_pos_m"]).where(near)})


def last_changes(stream: DataFrame) -> DataFrame:
    """Stateful move per segment on arrival. State: one day and one position per segment."""
    s = stream.select("transect_id", F.unix_date("date").alias("day"), "bank_pos_m")
    return s.groupBy("transect_id").applyInPandasWithState(
        _changes, CHANGE_SCHEMA, "day int, pos double", "append", GroupStateTimeout.NoTimeout)


def run_last_changes(spark: SparkSession, incoming: str, schema, out: str, checkpoint: str) -> DataFrame:
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(incoming)
    (last_changes(s).writeStream.outputMode("append").format("parquet").option("path", out)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(out)
