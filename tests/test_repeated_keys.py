"""Rows that repeat a key, or have none, stay as many as they are."""
import datetime as dt

from scarp.operators.serving import rank_predictions

DAY = dt.date(2000, 1, 1)


def test_ranks_of_repeated_and_missing_keys(spark):
    rows = [("a", DAY, 0.9, 1.0)] * 3 + [("b", DAY, 0.5, 9.0), (None, DAY, 0.7, None), ("a", dt.date(2000, 1, 13), 0.1, 2.0)]
    got = rank_predictions(spark.createDataFrame(rows, "transect_id string, forecast_date date, raw double, ret_84_m double")).collect()
    assert sorted((str(r.transect_id), r.rank, r.b0_rank) for r in got if r.forecast_date == DAY and r.transect_id != "a") == [
        ("None", 4, 5), ("b", 5, 1)]
    first = [r for r in got if r.forecast_date == DAY and r.transect_id == "a"]
    assert sorted(r["rank"] for r in first) == [1, 2, 3] and sorted(r.b0_rank for r in first) == [2, 3, 4]
    assert len(got) == len(rows) and set(got[0].asDict()) == {"transect_id", "forecast_date", "raw", "ret_84_m", "rank", "b0_rank"}
