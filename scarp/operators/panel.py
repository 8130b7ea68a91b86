"""Calendar maps and as-of windows over a (segment, pass date) panel.

All "nearest pass" rules depend on the pass calendar alone. They are resolved once on the calendar, which holds at
most one row per day and scope, and the panel then needs no self joins: every look-back is a bounded day frame of the
window that is sorted by (segment, day) anyway. ``scope`` names extra key columns, such as a reach, that have a
calendar of their own.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scarp import config as C



def with_day(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumn("day", F.unix_date(F.col(date)))


def pass_calendar(positions: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Distinct pass days. One row per day (and scope), so bounded by the days of the archive."""
    return with_day(positions).select(*scope, "day").distinct()


def _calendar_window(scope: Sequence[str]):
    return Window.partitionBy(*scope).orderBy("day")


def nearest_pass(days: int, tol: int, scope: Sequence[str] = ()) -> Column:
    """Day of the pass nearest to day + ``days`` (negative = back) within ``tol``; ties take the earlier pass."""
    if tol >= abs(days):
        raise ValueError("the tolerance must be smaller than the offset, or the pass could match itself")
    near = F.collect_list("day").over(_calendar_window(scope).rangeBetween(days - tol, days + tol))
    goal = F.col("day") + F.lit(days)
    best = F.array_min(F.transform(near, lambda d: F.struct(F.abs(d - goal).alias("gap"), d.alias("day"))))
    return best["day"]


def previous_pass(max_days: int, scope: Sequence[str] = ()) -> Column:
    prev = F.lag("day").over(_calendar_window(scope))
    return F.when(F.col("day") - prev <= max_days, prev)


def calendar_maps(calendar: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Every map the features and labels need, one row per pass day."""
    maps = {f"back_{d}": nearest_pass(-d, tol, scope) for d, tol in {**C.LAGS, **C.STAGE_LAGS}.items()}
    maps["prev"] = previous_pass(C.LAST_CHANGE_MAX_DAYS, scope)
    maps["target"] = nearest_pass(C.HORIZON_DAYS, C.TARGET_TOL_DAYS, scope)
    return calendar.withColumns(maps)


def first_per_pass(positions: DataFrame, values: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """One row per (segment, date): the first non-null value in pass order. Combined map-side, so copies do not travel."""
    return (with_day(positions)
            .groupBy(*scope, "transect_id", "day")
            .agg(*[F.min_by(v, F.when(F.col(v).isNotNull(), F.col("pass_id"))).alias(v) for v in values]))


def complete_panel(per_pass: DataFrame, calendar: DataFrame, values: Sequence[str], scope: Sequence[str] = (),
                   entities: DataFrame | None = None) -> DataFrame:
    """All segments x all pass days of their scope, NULL where nothing was seen.

    A segment has at most one row per day, so its rows fit one array. The missing days are added inside that array and
    the result keeps the partitioning by segment: the windows that follow need no further shuffle.
    """
    keys = [*scope, "transect_id"]
    fields = per_pass.select("day", *values).schema
    seen = per_pass.groupBy(*keys).agg(F.collect_list(F.struct("day", *values)).alias("_seen"))
    if entities is not None:
        none = F.array().cast(f"array<{fields.simpleString()}>")
        seen = entities.select(*keys).distinct().join(seen, keys, "left").withColumn(
            "_seen", F.coalesce("_seen", none))
    days = calendar.groupBy(*scope).agg(F.collect_list("day").alias("_days"))
    if scope:
        seen = seen.join(days, list(scope))
    else:
        seen = seen.withColumn("_days", days.scalar())
    absent = F.array_except("_days", F.transform("_seen", lambda o: o["day"]))
    blank = F.transform(absent, lambda d: F.struct(
        d.alias("day"), *[F.lit(None).cast(fields[v].dataType).alias(v) for v in values]))
    return seen.select(*keys, F.inline(F.concat("_seen", blank)))


def _segment_window(scope: Sequence[str]):
    return Window.partitionBy(*scope, "transect_id").orderBy("day")


def frame_percentile(col: str, p: float, lo: int, hi: int, min_n: int = 1, scope: Sequence[str] = ()) -> Column:
    w = _segment_window(scope).rangeBetween(lo, hi)
    q = F.percentile(col, F.lit(p)).over(w)
    return q if min_n <= 1 else F.when(F.count(col).over(w) >= min_n, q)


def frame_count(col: str, lo: int, hi: int, scope: Sequence[str] = ()) -> Column:
    return F.count(col).over(_segment_window(scope).rangeBetween(lo, hi))


def value_at(col: str, at: str, lo: int, hi: int, scope: Sequence[str] = ()) -> Column:
    """Value of ``col`` on the day held in column ``at``, known to lie in [day + lo, day + hi]."""
    w = _segment_window(scope).rangeBetween(lo, hi)
    frame = F.collect_list(F.struct("day", F.col(col).alias("v"))).over(w)
    return F.get(F.filter(frame, lambda x: x["day"] == F.col(at)), F.lit(0))["v"]


def lagged(col: str, days: int, tol: int, scope: Sequence[str] = ()) -> Column:
    return value_at(col, f"back_{days}", -(days + tol), -(days - tol), scope)


def attach_maps(panel: DataFrame, maps: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Join calendar-sized rows by day. Without a scope they are bounded by the days of the archive: broadcast."""
    return panel.join(maps if scope else F.broadcast(maps), [*scope, "day"], "left")


def with_links(per_pass: DataFrame, maps: DataFrame, names: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """Rows of ``first_per_pass`` with the linked days ``names`` of their day. A scope without a calendar has no rows."""
    if scope:
        per_pass = per_pass.join(maps.select(*scope).distinct(), list(scope), "left_semi")
    return attach_maps(per_pass, maps.select(*scope, "day", *names), scope)


def neighbour_mean(col: str, k: int = 3, by: Sequence[str] = ("bank", "day"), order: str = "chainage_m") -> Column:
    """Mean over the k rows present either side along the bank, self left out, NULLs skipped.

    A group is one bank on one date: bounded by river length / spacing.
    """
    w = Window.partitionBy(*by).orderBy(order, "transect_id").rowsBetween(-k, k)
    v = F.col(col)
    total = F.coalesce(F.sum(v).over(w), F.lit(0.0)) - F.coalesce(v, F.lit(0.0))
    n = F.count(v).over(w) - F.when(v.isNotNull(), 1).otherwise(0)
    return F.when(n > 0, total / n)


def asof_series(passes: DataFrame, series: DataFrame, lag_days: int = 7, scope: Sequence[str] = (),
                span_days: int = 366) -> DataFrame:
    """Last series value at or before each pass day and its change against the last value ``lag_days`` earlier.

    ``passes`` (scope.., day) and ``series`` (scope.., day, value) hold one row per day and scope at most; ``scope`` names
    the reach that a gauge belongs to. Time is cut into ranges: each is ordered on its own and starts from the last value
    of the ranges before it, which a window over one row per range carries on. NULL before the first value.
    """
    part = [*scope, "_span"]
    none = F.lit(None).cast("double")
    src = series.select(*scope, "day", F.lit(0).alias("kind"), F.col("value").cast("double").alias("value"))
    now = passes.select(*scope, "day", F.lit(1).alias("kind"), none.alias("value"))
    past = passes.select(*scope, (F.col("day") - lag_days).alias("day"), F.lit(2).alias("kind"), none.alias("value"))
    rows = src.unionByName(now).unionByName(past).withColumn("_span", F.floor(F.col("day") / span_days))
    ends = rows.groupBy(*part).agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("day"))).alias("_end"))
    earlier = Window.partitionBy(*scope).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*part, F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    w = Window.partitionBy(*part).orderBy("day", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.join(carried, part).withColumn("last", F.coalesce(F.last("value", ignorenulls=True).over(w), "_carried"))
    return (seen.where("kind > 0")
            .withColumn("day", F.when(F.col("kind") == 2, F.col("day") + lag_days).otherwise(F.col("day")))
            .groupBy(*scope, "day").agg(F.max(F.when(F.col("kind") == 1, F.col("last"))).alias("gauge"),
                                        F.max(F.when(F.col("kind") == 2, F.col("last"))).alias("_past"))
            .select(*scope, "day", "gauge", (F.col("gauge") - F.col("_past")).alias("gauge_change_7d")))


def nearest_in_tolerance(left: DataFrame, right: DataFrame, tol: int, right_order: Mapping[str, bool],
                         left_key: str) -> DataFrame:
    """Best right row per left row with |day difference| <= tol, by (difference, right_order).

    The tolerance is spelled out as 2 tol + 1 days on the left, so the join is an equi-join on the day.
    Only ``right_order``-best rows per day are needed, so each day keeps one right row before the join.
    """
    order = [F.col(c).asc() if up else F.col(c).desc() for c, up in right_order.items()]
    best = (right.withColumn("_rn", F.row_number().over(Window.partitionBy("day").orderBy(*order)))
            .where("_rn = 1").drop("_rn").withColumnRenamed("day", "right_day"))
    probes = left.withColumn("_off", F.explode(F.sequence(F.lit(-tol), F.lit(tol)))).withColumn(
        "right_day", F.col("day") + F.col("_off"))
    pairs = probes.join(best, "right_day").withColumn("days_apart", F.abs("_off"))
    pick = Window.partitionBy(left_key).orderBy("days_apart", *order)
    return pairs.withColumn("_rn", F.row_number().over(pick)).where("_rn = 1").drop("_rn", "_off")
