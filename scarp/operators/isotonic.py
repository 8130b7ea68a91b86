"""Isotonic calibration as a convex hull.

The isotonic fit of pooled scores is the slope of the lower convex hull of their running totals (rows, sum of outcomes). Hulls merge: the
hull of a union is the hull of the parts' hulls. So scores are pooled, totalled along the order, cut into parts of ``PART`` rows, and
hulls of parts are joined ``FAN`` at a time until one is left. Outcomes of 0 and 1 make the points whole numbers, so the hull of n
rows has O(n^(2/3)) corners: a billion rows leave a million in the last join. The calibrator is a list of steps that differ by
at least ``RESOLUTION`` in probability (closer ones are pooled), so its size has a bound whatever the data.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarp.functions.ordering import running_sums
from scarp.session import settle

PART, FAN, RESOLUTION = 1 << 16, 64, 1e-6


def lower_hull(n: list, s: list) -> list[int]:
    """Places of the corners of the lower convex hull of points with rising ``n``; points on an edge are no corners."""
    out: list[int] = []
    for i in range(len(n)):
        while len(out) > 1:
            a, b = out[-2], out[-1]
            if (s[b] - s[a]) * (n[i] - n[a]) < (s[i] - s[a]) * (n[b] - n[a]):
                break
            out.pop()
        out.append(i)
    return out


def _hull(t: pa.Table) -> pa.Table:
    t = t.sort_by("n")
    return t.take(lower_hull(t["n"].to_pylist(), t["s"].to_pylist())).select(["part", "score", "n", "s"])


def _steps(t: pa.Table) -> pa.Table:
    """The last join: from corners to steps (upper score, probability)."""
    t = t.sort_by("n")
    n, s, score = [0, *t["n"].to_pylist()], [0, *t["s"].to_pylist()], [None, *t["score"].to_pylist()]
    at = lower_hull(n, s)
    out: list[list] = []            # upper score, outcomes, rows
    for a, b in zip(at, at[1:]):
        step = [score[b], s[b] - s[a], n[b] - n[a]]
        if out and step[1] / step[2] - out[-1][1] / out[-1][2] < RESOLUTION:
            step = [step[0], step[1] + out[-1][1], step[2] + out[-1][2]]
            out.pop()
        out.append(step)
    return pa.table([pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] / x[2] for x in out], pa.float64())], ["high", "p"])


@dataclass
class Calibrator:
    """Steps from ``low`` to ``high`` with probability ``p``, straight lines between them; missing scores take the smallest one seen."""
    low: np.ndarray
    high: np.ndarray
    p: np.ndarray
    fill: float

    def values(self, score: np.ndarray) -> np.ndarray:
        if not len(self.p):
            return np.full(len(score), np.nan)
        x = np.column_stack([self.low, self.high]).ravel()
        return np.interp(np.where(np.isnan(score), self.fill, score), x, np.repeat(self.p, 2))

    def apply(self, df: DataFrame, score: str, out: str) -> DataFrame:
        @F.arrow_udf("double")
        def run(v: pa.Array) -> pa.Array:
            return pa.array(self.values(v.to_numpy(zero_copy_only=False)), from_pandas=True)
        return df.withColumn(out, run(F.coalesce(F.col(score).cast("double"), F.lit(float("nan")))))


def fit_isotonic(df: DataFrame, score: str) -> Calibrator:
    """The rising function of ``score`` nearest to y. Rows without y take no part; without rows it gives no probability."""
    rows = df.where("y IS NOT NULL").select(F.col(score).cast("double").alias("score"), "y")
    seen = rows.agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n")).first()
    if not seen["n"]:
        return Calibrator(np.zeros(0), np.zeros(0), np.zeros(0), 0.0)
    fill = seen["low"] if seen["low"] is not None else 0.0
    pooled = settle(rows.groupBy(F.coalesce("score", F.lit(fill)).alias("score"))
                    .agg(F.sum("y").alias("_s"), F.count(F.lit(1)).alias("_n")))
    points = (running_sums(pooled, [], "score", {"n": F.col("_n"), "s": F.col("_s")}, descending=False)
              .select(F.floor((F.col("n") - 1) / PART).alias("part"), "score", "n", "s"))
    parts, schema = -(-seen["n"] // PART), points.schema
    while parts > 1:
        points = points.groupBy("part").applyInArrow(_hull, schema).withColumn("part", F.floor(F.col("part") / FAN))
        parts = -(-parts // FAN)
    got = points.groupBy("part").applyInArrow(_steps, "high double, p double").orderBy("high").collect()    # at most 1 / RESOLUTION steps
    high, p = np.array([r["high"] for r in got]), np.array([r["p"] for r in got])

    @F.arrow_udf("long")
    def step(v: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(high, v.to_numpy(zero_copy_only=False), side="left"))

    lows = {r["i"]: r["low"] for r in pooled.groupBy(step("score").alias("i")).agg(F.min("score").alias("low")).collect()}
    return Calibrator(np.array([lows[i] for i in range(len(high))]), high, p, fill)
