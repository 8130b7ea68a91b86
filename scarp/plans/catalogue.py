"""Query catalogue: name -> Spark plan, plus the SQL that checks it on the same tables."""
from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scarp.plans.fixtures import K, Inputs
from scarp.plans.present import present
from scarp.plans.sqltext import query

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_DOUBLES: dict[str, tuple[str, ...]] = {}


def register(name: str, sql: str | None = None, doubles: tuple[str, ...] = ()):
    """Register ``f(inputs) -> DataFrame`` under ``name``.

    ``doubles``: integer columns that may be NULL; they leave as DOUBLE, which every client reads the same way.
    """
    def deco(f: Callable[[Inputs], DataFrame]):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = present(f(Inputs(spark, sf_dir)))
            return out.withColumns({c: F.col(c).cast("double") for c in doubles}) if doubles else out
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
            _DOUBLES[name] = doubles
        return f
    return deco


def _load() -> None:
    from scarp.plans import (q_bankpos, q_geometry, q_metrics, q_models, q_panel, q_quality,  # noqa: F401
                             q_raster, q_serving, q_sources, q_streaming)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return {n: _as_doubles(query(s), _DOUBLES[n]) for n, s in _SQL.items()}


def _as_doubles(sql: str, cols: tuple[str, ...]) -> str:
    if not cols:
        return sql
    return f"SELECT * REPLACE ({', '.join(f'{c}::DOUBLE AS {c}' for c in cols)}) FROM ({sql})"


def flagship(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    """Precision@k per forecast date of the 84-day persistence score."""
    from scarp.operators.metrics import precision_at_k
    i = Inputs(spark, sf_dir)
    return present(precision_at_k(i.scores(), "B0_persistence", k))
