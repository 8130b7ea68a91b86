"""Order statistics that never put one whole group into one task.

Rows are cut into slots along the order by approximate quantiles of the score; slots of one value (heavy ties, missing
scores) are cut again by a hash. The slots of a group are totalled with map-side combine, only the slot totals (at most
slots x tie bins per group) are accumulated in a window, and each slot is then ordered on its own. Results are exact: the
quantiles only balance the work. They are a subquery of the plan, so building a plan runs nothing.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIE_SPACE = 2 ** 32


def key_hash(*cols: str | Column) -> Column:
    """Uniform integer in [0, 2^32) from the key: a tie-break that does not depend on partitioning."""
    text = F.concat_ws("|", *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def _slot_count(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)


def _edges(df: DataFrame, score: str, slots: int) -> Column:
    """Distinct approximate quantiles of ``score``: an array of under ``slots`` values, as a scalar subquery."""
    probs = [i / slots for i in range(1, slots)]
    q = df.agg(F.array_distinct(F.percentile_approx(F.col(score).cast("double"), probs, 20 * slots)).alias("q"))
    return F.coalesce(q.scalar(), F.array().cast("array<double>"))


def _with_slots(df: DataFrame, score: str, descending: bool, tie: str | None, slots: int) -> DataFrame:
    """Add ``_slot`` and ``_bin``, both growing along the requested order (NULL scores last).

    A value equal to an edge gets a slot of its own; only such single-valued slots, and the missing scores, are cut again
    by the tie hash, so heavy ties are spread and the order stays exact.
    """
    # The place among the edges in two steps of about sqrt(slots) comparisons: first among every ``step``-th edge.
    step = max(1, int(slots ** 0.5))
    df = df.withColumns({"_score": F.col(score).cast("double"), "_edges": _edges(df, score, slots)})
    some = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_edges") - 1, F.lit(0)), F.lit(step)), lambda i: F.get("_edges", i))
    coarse = F.greatest(F.size(F.filter(some, lambda e: e <= F.col("_score"))) - 1, F.lit(0)) * step
    df = df.withColumn("_coarse", coarse)
    fine = F.filter(F.slice("_edges", F.col("_coarse") + 1, F.lit(step)), lambda e: e <= F.col("_score"))
    df = df.withColumn("_cut", F.col("_coarse") + F.size(fine))
    at_edge = F.coalesce(F.get("_edges", F.col("_cut") - 1) == F.col("_score"), F.lit(False))
    pos = 2 * F.col("_cut") + F.when(at_edge, 0).otherwise(1)
    last = 2 * slots + 2
    slot = F.when(F.col("_score").isNull(), last).otherwise(last - 1 - pos if descending else pos)
    single = at_edge | F.col("_score").isNull()
    bins = F.lit(0) if tie is None else F.when(
        single, F.floor(F.col(tie) * F.lit(float(slots)) / F.lit(float(TIE_SPACE)))).otherwise(0)
    return df.withColumns({"_slot": slot, "_bin": bins.cast("int")}).drop("_score", "_edges", "_coarse", "_cut")


def running_sums(df: DataFrame, by: Sequence[str], score: str, sums: Mapping[str, Column], *,
                 descending: bool = True, tie: str | None = None, keys: Sequence[str] = (),
                 slots: int | None = None) -> DataFrame:
    """Add inclusive running sums per ``by`` group in the order (score, tie, keys), NULL scores last."""
    slots = slots or _slot_count(df)
    first = F.col(score).desc_nulls_last() if descending else F.col(score).asc_nulls_last()
    order = [first, *([F.col(tie)] if tie else []), *[F.col(k) for k in keys]]
    upto = (Window.unboundedPreceding, 0)
    cut = _with_slots(df.withColumns({f"_v_{m}": c for m, c in sums.items()}), score, descending, tie, slots)
    totals = cut.groupBy(*by, "_slot", "_bin").agg(*[F.sum(f"_v_{m}").alias(f"_t_{m}") for m in sums])
    before = Window.partitionBy(*by).orderBy("_slot", "_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_slot", "_bin",
                            *[F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in sums])
    w = Window.partitionBy(*by, "_slot", "_bin").orderBy(*order).rowsBetween(*upto)
    return (cut.join(offsets, [*by, "_slot", "_bin"])
            .withColumns({m: F.sum(f"_v_{m}").over(w) + F.col(f"_o_{m}") for m in sums})
            .drop("_slot", "_bin", *[f"_v_{m}" for m in sums], *[f"_o_{m}" for m in sums]))


def exact_percentiles(df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float], *,
                      slots: int | None = None) -> DataFrame:
    """Exact linear-interpolation percentiles per group; NULLs are ignored."""
    v = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"))
    counts = v.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_n"))
    slots = slots or _slot_count(df)
    cum = running_sums(counts, by, "_x", {"_cum": F.col("_n")}, descending=False, slots=slots)
    total = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    cum = cum.join(total, list(by)) if by else cum.withColumn("_total", total.select("_total").scalar())
    at = {}
    for name, p in probs.items():
        pos = (F.col("_total") - 1) * F.lit(p)
        at[f"_lo_{name}"] = F.min(F.when(F.col("_cum") > F.floor(pos), F.col("_x")))
        at[f"_hi_{name}"] = F.min(F.when(F.col("_cum") > F.ceil(pos), F.col("_x")))
    out = cum.groupBy(*by).agg(F.max("_total").alias("_total"), *[c.alias(a) for a, c in at.items()])
    cols = []
    for name, p in probs.items():
        pos = (F.col("_total") - 1) * F.lit(p)
        frac = pos - F.floor(pos)
        cols.append((F.col(f"_lo_{name}") * (1 - frac) + F.col(f"_hi_{name}") * frac).alias(name))
    return out.select(*by, *cols)


def top_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows per group. Spark limits each group before the shuffle, so a hot group stays small."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def rank_rows(df: DataFrame, by: Sequence[str], score: str, keys: Sequence[str], name: str = "rank",
              **kw) -> DataFrame:
    """Full ranking, 1 = highest score; NULL scores last; ties by key hash, then key."""
    hashed = df.withColumn("_tie", key_hash(*keys))
    out = running_sums(hashed, by, score, {name: F.lit(1)}, tie="_tie", keys=keys, **kw)
    return out.withColumn(name, F.col(name).cast("int")).drop("_tie")
