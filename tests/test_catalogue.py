"""The query catalogue against its SQL on the smallest scale."""
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")

# one or two per operator family; the full comparison is tools/check_queries.py
SAMPLE = ["panel_complete", "feature_table", "make_labels", "nearest_in_tolerance", "pr_auc", "reliability", "sensitivity_large", "predictions_all",
          "banks_by_year", "alert_draft", "px_focal_lee", "px_otsu_hist", "px_sieve", "cast_transects", "break_lines_on_gaps", "position_valid",
          "bank_height", "catalog_group_passes", "src_positions", "dq_masks", "incremental_pass", "stream_last_change"]


@pytest.fixture(scope="module")
def duck():
    import check_queries
    con = duckdb.connect()
    for t in check_queries.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    import __spark_entry__ as entry
    from check_queries import rows_of
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(cur.fetchall(), cols)


def test_flagship(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0


def test_every_checked_query_is_registered():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150
