"""Ranking and calibration metrics. ``by`` columns (default: none beyond the date) make every metric grouped."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scarp import config as C
from scarp.functions.ordering import exact_percentiles, key_hash, rank_rows, running_sums, top_rows
from scarp.session import stored

KEYS = ("forecast_date", "transect_id")
BOOT_TASKS = 32


def _order(score: str) -> list[Column]:
    return [F.col(score).desc_nulls_last(), key_hash(*KEYS).asc(), F.col("transect_id").asc()]


def rank_within_date(df: DataFrame, score: str, by: Sequence[str] = (), name: str = "rank", **kw) -> DataFrame:
    return rank_rows(df, [*by, "forecast_date"], score, KEYS, name, **kw)


def top_of_date(df: DataFrame, score: str, k: int = C.TOP_K, by: Sequence[str] = ()) -> DataFrame:
    return top_rows(df, [*by, "forecast_date"], _order(score), k)


def precision_at_k(df: DataFrame, score: str, k: int = C.TOP_K, by: Sequence[str] = ()) -> DataFrame:
    """Per date share of positives in the top k; a date needs k rows, which is the case iff k rows came out on top."""
    slim = df.select(*by, *KEYS, score, "y")
    return (top_of_date(slim, score, k, by).groupBy(*by, "forecast_date")
            .agg(F.avg("y").alias("precision"), F.count(F.lit(1)).alias("_n"))
            .where(F.col("_n") == k).drop("_n"))


def major_recall(df: DataFrame, score: str, k: int = C.TOP_K, by: Sequence[str] = ()) -> DataFrame:
    slim = df.select(*by, *KEYS, score, "major")
    hits = top_of_date(slim, score, k, by).select(*by, F.col("major").alias("hit"), F.lit(0).alias("all"))
    total = slim.select(*by, F.lit(0).alias("hit"), F.col("major").alias("all"))
    return (hits.unionByName(total).groupBy(*by)
            .agg(F.sum("hit").alias("hits"), F.sum("all").alias("total"))
            .withColumn("recall", F.when(F.col("total") > 0, F.col("hits") / F.col("total"))))


def pr_auc(df: DataFrame, score: str, by: Sequence[str] = (), **kw) -> DataFrame:
    """Average precision over distinct scores; NULL scores form the lowest group; NULL with one class only."""
    groups = df.groupBy(*by, F.col(score).alias("_s")).agg(F.sum("y").alias("_p"), F.count(F.lit(1)).alias("_n"))
    cum = running_sums(groups, by, "_s", {"_cp": F.col("_p"), "_cn": F.col("_n")}, **kw)
    area = F.sum(F.col("_p") * F.col("_cp") / F.col("_cn")) / F.sum("_p")
    return cum.groupBy(*by).agg(F.when((F.sum("_p") > 0) & (F.sum("_p") < F.sum("_n")), area).alias("pr_auc"))


def _clipped(prob: str) -> Column:
    return F.least(F.greatest(F.col(prob), F.lit(0.0)), F.lit(1.0))


def brier(df: DataFrame, prob: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((_clipped(prob) - F.col("y")) ** 2).alias("brier"))


def reliability(df: DataFrame, prob: str, by: Sequence[str] = ()) -> DataFrame:
    p = _clipped(prob)
    at_or_above = [(p >= F.lit(e)).cast("int") for e in C.RELIABILITY_EDGES]
    bin_no = sum(at_or_above[1:], at_or_above[0])
    return (df.where(F.col(prob).isNotNull()).groupBy(*by, bin_no.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("mean_pred"), F.avg("y").alias("observed")))


def ece(rel: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    gap = F.sum(F.col("n") * F.abs(F.col("mean_pred") - F.col("observed"))) / F.sum("n")
    return rel.groupBy(*by).agg(gap.alias("ece"))


def in_season(date: str = "forecast_date") -> Column:
    return F.month(date).isin(*C.SEASON_MONTHS)


def summarise(df: DataFrame, score: str, prob: str | None = None, k: int = C.TOP_K,
              by: Sequence[str] = ()) -> DataFrame:
    """Long metric table (…, metric, value)."""
    p = precision_at_k(df, score, k, by).groupBy(*by).agg(
        F.avg("precision").alias("precision_at_k"),
        F.avg(F.when(in_season(), F.col("precision"))).alias("precision_at_k_monsoon"),
        F.count(F.lit(1)).cast("double").alias("n_dates"),
        F.count(F.when(in_season(), 1)).cast("double").alias("n_dates_monsoon"))
    m = major_recall(df, score, k, by).select(
        *by, F.col("hits").cast("double").alias("major_hits"), F.col("total").cast("double").alias("major_total"),
        F.col("recall").alias("major_recall"))
    parts = [p, pr_auc(df, score, by), m]
    if prob:
        parts.append(brier(df, prob, by))
    long = [x.unpivot(list(by), [c for c in x.columns if c not in by], "metric", "value") for x in parts]
    out = long[0]
    for x in long[1:]:
        out = out.unionByName(x)
    return out


def moving_block_bootstrap(series: DataFrame, value: str = "diff", by: Sequence[str] = (), n: int = C.BOOT_N,
                           block: int = C.BOOT_BLOCK) -> DataFrame:
    """Interval of the mean of a per-date series from blocks of consecutive dates.

    A series has one value per date: its prefix sums are one array, so a block is one subtraction and a replicate is its
    block starts only. ``BOOT_TASKS`` tasks share a series' replicates, so its array is copied that often and no more. Block starts
    come from a key hash, not from generator order.
    """
    order = Window.partitionBy(*by).orderBy("forecast_date").rowsBetween(Window.unboundedPreceding, 0)
    sums = (series.where(F.col(value).isNotNull()).withColumn("_sum", F.sum(value).over(order)).groupBy(*by)
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("forecast_date", F.col("_sum").alias("v")))),
                             lambda s: s["v"]).alias("_c")))
    one = sums.withColumns({"_c": F.concat(F.array(F.lit(0.0)), F.col("_c")), "_t": F.size("_c")}).where("_t > 0")
    tasks = min(n, BOOT_TASKS)
    rep = one.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartition(tasks, *by, "_k")
    n_blocks = F.ceil(F.col("_t") / F.lit(block)).cast("int")
    room = F.greatest(F.col("_t") - (block - 1), F.lit(1))

    def block_sum(b: Column, j: Column) -> Column:
        start = (key_hash(F.concat_ws(":", b.cast("string"), j.cast("string"))) % room).cast("int")
        # the last block is cut so that a replicate has exactly _t values
        end = F.least(start + F.least(F.lit(block), F.col("_t") - j * block), F.col("_t"))
        return F.get("_c", end) - F.get("_c", start)

    one_mean = lambda b: F.aggregate(F.sequence(F.lit(0), n_blocks - 1), F.lit(0.0), lambda a, j: a + block_sum(b, j)) / F.col("_t")
    means = rep.select(*by, F.explode(F.transform(F.sequence(F.col("_k"), F.lit(n - 1), F.lit(tasks)), one_mean)).alias("_m"))
    bounds = means.groupBy(*by).agg(F.percentile("_m", F.lit(0.025)).alias("lo"),
                                    F.percentile("_m", F.lit(0.975)).alias("hi"))
    plain = series.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).cast("int").alias("n_dates"))
    if by:
        return plain.join(bounds, list(by)).select(*by, "mean", "lo", "hi", "n_dates")
    return plain.select("mean", bounds.select("lo").scalar().alias("lo"), bounds.select("hi").scalar().alias("hi"),
                        "n_dates")


def precision_difference(df: DataFrame, model: str, base: str, k: int = C.TOP_K, by: Sequence[str] = ()) -> DataFrame:
    # both scores read the rows, which may come out of a join: they are written once
    df = stored(df.select(*dict.fromkeys([*by, *KEYS, model, base, "y"])), "two-scores")
    pm = precision_at_k(df, model, k, by).withColumnRenamed("precision", "model")
    pb = precision_at_k(df, base, k, by).withColumnRenamed("precision", "baseline")
    return pm.join(pb, [*by, "forecast_date"]).withColumn("diff", F.col("model") - F.col("baseline"))


def compare_models(df: DataFrame, model: str, base: str, k: int = C.TOP_K, by: Sequence[str] = (), **kw) -> DataFrame:
    """Bootstrap of the per-date difference over all dates and over the season."""
    diff = precision_difference(df, model, base, k, by)
    both = diff.withColumn("period", F.explode(
        F.when(in_season(), F.array(F.lit("all_dates"), F.lit("monsoon"))).otherwise(F.array(F.lit("all_dates")))))
    return moving_block_bootstrap(both, "diff", [*by, "period"], **kw)


def success_levels(m: DataFrame) -> DataFrame:
    """Rules over one wide metric row per run."""
    minimum = (F.col("bank_error_median_m") <= 20.0) & (F.col("passes_processed") == F.col("passes_in_catalog"))
    good = F.col("temporal_lo") > 0
    strong = good & (F.col("spatial_lo") > 0) & (F.col("model_brier") < F.col("persistence_brier"))
    return m.withColumns({"minimum": F.coalesce(minimum, F.lit(False)), "good": F.coalesce(good, F.lit(False)),
                          "strong": F.coalesce(strong, F.lit(False))})


def large_event_sensitivity(df: DataFrame, scores: Sequence[str], limits: Sequence[float],
                            k: int = C.TOP_K) -> DataFrame:
    """P@k again without positives whose retreat exceeds a limit, with the arm's positive rate and the interval of the
    difference of the first two scores. Each row is repeated once per limit it passes."""
    arms = F.array(*[F.when((F.col("y") == 0) | (F.col("retreat_m") <= x), F.lit(float(x))) for x in limits])
    cut = df.withColumn("limit_m", F.explode(F.array_compact(arms)))
    pos = df.where("y = 1")
    shares = pos.agg(*[(F.sum(F.when(F.col("retreat_m") > x, 1).otherwise(0)) / F.count(F.lit(1))).alias(f"s{n}")
                       for n, x in enumerate(limits)])
    share = None
    for n, x in enumerate(limits):
        value = shares.select(f"s{n}").scalar()
        share = F.when(F.col("limit_m") == x, value) if share is None else share.when(F.col("limit_m") == x, value)
    median = exact_percentiles(pos, [], "retreat_m", {"m": 0.5}).scalar()
    out = None
    for s in scores:
        part = (precision_at_k(cut, s, k, ["limit_m"]).groupBy("limit_m")
                .agg(F.avg("precision").alias("precision_at_k"), F.count(F.lit(1)).alias("n_dates"))
                .withColumn("score", F.lit(s)))
        out = part if out is None else out.unionByName(part)
    rate = cut.groupBy("limit_m").agg(F.avg("y").alias("positive_rate"))
    # how far the first score is ahead of the second, with its interval
    ahead = moving_block_bootstrap(precision_difference(cut, scores[0], scores[1], k, ["limit_m"]), by=["limit_m"]).select(
        "limit_m", F.col("mean").alias("diff_mean"), F.col("lo").alias("diff_lo"), F.col("hi").alias("diff_hi"))
    return out.join(rate, "limit_m").join(ahead, "limit_m").withColumns({"large_share": share, "median_positive_retreat_m": median})


def baseline_scores(df: DataFrame) -> DataFrame:
    return df.withColumns({"B0_persistence": F.col("ret_84_m"), "B1_history": F.col("ret_365_m")})
