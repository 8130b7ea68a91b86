"""Passes that arrive in pieces and late give what a full rebuild gives."""
import pytest
from pyspark.sql import functions as F

from scarp.operators.features import feature_table, stage_per_pass
from scarp.operators.labels import make_labels
from scarp.operators.metrics import rank_within_date
from scarp.streaming import incremental as S


def test_split_and_late_passes_equal_the_rebuild(spark, positions, transects, tmp_path):
    base = str(tmp_path)
    # one stage value per pass, as deployments have it
    stage = positions.groupBy("pass_id").agg(F.max("belt_water_km2").alias("belt_water_km2"))
    p = positions.drop("belt_water_km2").join(F.broadcast(stage), "pass_id")
    days = sorted(r[0] for r in p.select("date").distinct().collect())
    late, first, last = days[-6], days[-3], days[-1]
    store, incoming = f"{base}/store", f"{base}/incoming"
    S.store_positions(p.where((F.col("date") < F.lit(first)) & (F.col("date") != F.lit(late))), store)
    half = F.pmod(F.xxhash64("transect_id"), F.lit(2))
    drops = [p.where((F.col("date") == F.lit(first)) & (half == k)) for k in (0, 1)]
    drops += [p.where(F.col("date") == F.lit(late)), p.where(F.col("date") > F.lit(first))]
    for d in drops:
        d.coalesce(1).write.mode("append").parquet(incoming)
        S.run_incremental(spark, incoming, p.schema, store, f"{base}/out", f"{base}/checkpoint", transects,
                          threshold_m=20.0, score="ret_84_m")
    assert S.stored_positions(spark, store).select(p.columns).exceptAll(p).count() == 0
    assert S.stored_positions(spark, store).count() == p.count()

    def same(got, want, key):
        cols = [c for c in want.columns if c in got.columns]
        rounded = lambda d: d.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c).cast("string").alias(c)
                                       for c, t in d.select(cols).dtypes])
        assert got.count() == want.count() > 0
        assert rounded(got).exceptAll(rounded(want)).count() == 0, key

    now = lambda table: S.published(spark, f"{base}/out", table)
    f = feature_table(p, transects, stage_per_pass(p)).where(F.col("forecast_date") >= F.lit(late))
    same(now("features"), f, "features")
    same(now("ranks"), rank_within_date(f.select("forecast_date", "transect_id", "ret_84_m"), "ret_84_m"), "ranks")
    y = make_labels(p, 20.0).where(S.since("forecast_date", late, S.LABEL_REACH_DAYS))
    same(now("labels"), y, "labels")
    assert last in {r[0] for r in now("features").select("forecast_date").distinct().collect()}


def test_a_replayed_batch_changes_nothing(spark, positions, tmp_path):
    store = str(tmp_path / "s")
    one, two = positions.where("transect_id < 'W'"), positions.where("transect_id >= 'W'")
    for rows, n in ((one, 0), (two, 1), (one, 0), (two.where("date > '2020-06-01'"), 2)):
        S.store_positions(rows, store, n)
    got = S.stored_positions(spark, store).select(positions.columns)
    assert got.count() == positions.count() and got.exceptAll(positions).count() == 0


def test_a_failed_refresh_is_not_seen(spark, positions, transects, tmp_path, monkeypatch):
    store, out = str(tmp_path / "s"), str(tmp_path / "out")
    S.store_positions(positions, store)
    S.refresh(spark, store, "2020-10-01", transects, out, threshold_m=20.0)
    seen = S.published(spark, out, "features").count()

    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(S, "make_labels", broken)
    with pytest.raises(RuntimeError, match="lost"):
        S.refresh(spark, store, "2020-08-01", transects, out, 1, threshold_m=20.0)
    assert S.published(spark, out, "features").count() == seen > 0
    with pytest.raises(ValueError, match="nothing"):
        S.published(spark, out, "ranks")
