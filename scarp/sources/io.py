"""Readers and writers with explicit schemas. NaN becomes NULL on read, sentinels exist in files only."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POSITION_COLUMNS = {"transect_id": "string", "pass_id": "string", "date": "date", "bank_pos_m": "double"}
SLICE = "struct<start:timestamp_ntz, product_id:string, relative_orbit:int>"
CATALOG_SCHEMA = f"pass_id string, date date, platform string, datatake bigint, slices array<{SLICE}>"


def nan_to_null(df: DataFrame) -> DataFrame:
    fl = (T.DoubleType, T.FloatType)
    return df.select(*[F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
                       if isinstance(f.dataType, fl) else F.col(f.name) for f in df.schema.fields])


def require_columns(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    have = dict(df.dtypes)
    wrong = {c: (t, have.get(c)) for c, t in expected.items() if have.get(c) != t}
    if wrong:
        raise ValueError(f"unexpected columns (expected, found): {wrong}")
    return df


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(require_columns(spark.read.parquet(path), POSITION_COLUMNS))


def read_series_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("date date, value double").csv(path, header=True)


def read_summary_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def read_catalog(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Nested pass catalogue; ``multiline`` for one JSON list per file."""
    return spark.read.schema(CATALOG_SCHEMA).json(path, multiLine=multiline)


def write_partitioned(df: DataFrame, path: str, keep: Sequence[str], by: str = "year") -> None:
    """One folder per year; rebalancing keeps the files few and splits a year that outgrows the others."""
    df.select(*keep, by).hint("rebalance", by).write.mode("overwrite").partitionBy(by).parquet(path)


def read_partitioned(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_last_jsonl(spark: SparkSession, path: str, schema: str, order: Sequence[str], n: int) -> DataFrame:
    """The newest ``n`` records, newest first."""
    return spark.read.schema(schema).json(path).orderBy(*[F.desc(c) for c in order]).limit(n)
