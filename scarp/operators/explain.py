"""Contributions, grouped reasons and their wording. Everything is row-local: no shuffle."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scarp import config as C
from scarp.functions.columns import fixed, metres
from scarp.operators.boosting import BoostedModel
from scarp.operators.isotonic import Calibrator


def reason_group_of(feature: str) -> str:
    if feature in C.REASON_OVERRIDES:
        return C.REASON_OVERRIDES[feature]
    return next((g for g, fs in C.FEATURE_GROUPS.items() if feature in fs), feature)


def reason_groups(spark) -> DataFrame:
    """feature -> reason group, a 23-row dimension."""
    return spark.createDataFrame([(f, reason_group_of(f)) for f in C.FEATURES], "feature string, reason_group string")


def feature_means(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """One row of averages; small enough to become literals of the plan."""
    return df.agg(*[F.avg(f).alias(f) for f in features]).first().asDict()


def linear_contributions(df: DataFrame, weights: Mapping[str, float], means: Mapping[str, float]) -> DataFrame:
    """Exact attributions of a linear score: weight x (value - mean); a missing value counts as average."""
    return df.withColumns({f"c_{f}": F.coalesce(F.lit(float(w)) * (F.col(f).cast("double") - F.lit(means[f])),
                                                F.lit(0.0)) for f, w in weights.items()})


def model_scores(df: DataFrame, model: BoostedModel, calibrator: Calibrator | None = None) -> DataFrame:
    """Add raw and p of a boosted model and ``c_<feature>``: its path attributions of the log-odds.

    Node tables (bounded by trees x nodes) and the calibrator's steps travel with the closure: one Arrow pass gives all three.
    """
    n = len(model.features)

    @F.arrow_udf("struct<raw: double, p: double, c: array<double>>")
    def run(v: pa.Array) -> pa.Array:
        x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), n).T
        raw = 1.0 / (1.0 + np.exp(-model.margins(x)))
        p = calibrator.values(raw) if calibrator else raw
        ends = pa.array(np.arange(0, n * len(v) + 1, n, dtype=np.int32))
        c = pa.ListArray.from_arrays(ends, pa.array(model.contributions(x).ravel()))
        return pa.StructArray.from_arrays([pa.array(raw), pa.array(p, from_pandas=True), c], ["raw", "p", "c"])

    out = df.withColumn("_m", run(model.vector()))
    return out.withColumns({"raw": F.col("_m.raw"), "p": F.col("_m.p"), **{
        f"c_{f}": F.col("_m.c")[i] for i, f in enumerate(model.features)}}).drop("_m")


def top_reasons(features: Sequence[str], top: int = 3) -> Column:
    """array<struct<group, value>>: groups with a positive total, largest first."""
    groups: dict[str, list[str]] = {}
    for f in features:
        groups.setdefault(reason_group_of(f), []).append(f)
    items = []
    for order, (g, fs) in enumerate(groups.items()):
        total = sum([F.col(f"c_{f}") for f in fs[1:]], F.col(f"c_{fs[0]}"))
        items.append(F.struct((-total).alias("neg"), F.lit(order).alias("order"), F.lit(g).alias("group")))
    positive = F.filter(F.sort_array(F.array(*items)), lambda s: s["neg"] < 0)
    return F.transform(F.slice(positive, 1, top),
                       lambda s: F.struct(s["group"].alias("group"), (-s["neg"]).alias("value")))


def reason_text(group: Column) -> Column:
    """Sentence for a reason group from the row's own feature values. Wording and limits are fixed values."""
    c = F.col
    moved = (F.when(c("ret_28_m") > 5, F.concat(F.lit("Bank retreated "), metres(c("ret_28_m")), F.lit(" in the last 4 weeks")))
             .when(c("ret_84_m") > 5, F.concat(F.lit("Bank retreated "), metres(c("ret_84_m")), F.lit(" in the last 12 weeks"))))
    further = F.when(c("raw_last_change_m") > 10, F.concat(
        F.lit("latest pass shows a further "), metres(c("raw_last_change_m")), F.lit(" (unconfirmed)")))
    recent = F.coalesce(F.nullif(F.concat_ws("; ", moved, further), F.lit("")),
                        F.lit("Little recent retreat, but the recent pattern still raises risk"))
    channel = F.concat(
        F.coalesce(F.concat(F.lit("Main flowing channel is "), metres(c("dist_main_channel_m")), F.lit(" from the bank")),
                   F.lit("Main channel position")),
        F.when(c("d_dist_main_28_m") < -20, F.concat(F.lit(" and moved "), metres(c("d_dist_main_28_m")),
                                                     F.lit(" closer in 4 weeks"))).otherwise(""))
    texts = {
        "recent_retreat": recent,
        "history": F.when(c("ret_365_m") > 0, F.concat(F.lit("Lost "), metres(c("ret_365_m")), F.lit(" of bank over the past year")))
        .otherwise("Past-year history raises risk"),
        "main_channel": channel,
        "char_shield": F.when(c("char_shield_frac") < 0.15, "No char shields this bank from the flow")
        .otherwise("Little char protection in front of the bank"),
        "near_bank_channel": F.coalesce(F.concat(F.lit("A "), metres(c("near_channel_width_m")),
                                                 F.lit("-wide channel runs along the bank")),
                                        F.lit("Deep water close to the bank")),
        "bank_shape": F.lit("Bank sits on an outer bend / in a recess"),
        "water_level": F.when(c("stage_change_12d") > 5, "River is rising (more open water than 12 days ago)")
        .when(c("stage_change_12d") < -5, "River is falling after high water")
        .otherwise("River stage is typical of high-erosion periods"),
        "season": F.lit("Monsoon season"),
        "neighbours": F.when(c("nb_ret_84_m") > 0, F.concat(
            F.lit("Neighbouring segments retreated "), metres(c("nb_ret_84_m")), F.lit(" on average in 12 weeks")))
        .otherwise("Nearby segments are active"),
        "bank_height": F.concat(F.lit("Bank height about "), fixed(c("bank_height_m"), 1), F.lit(" m above the river (DEM)")),
    }
    out = None
    for g, t in texts.items():
        out = F.when(group == g, t) if out is None else out.when(group == g, t)
    return out


def reasons(features: Sequence[str], top: int = 3) -> Column:
    """array<struct<group, text, shap>>; reasons without a text are left out."""
    full = F.transform(top_reasons(features, top), lambda r: F.struct(
        r["group"].alias("group"), reason_text(r["group"]).alias("text"), F.round(r["value"], 4).alias("shap")))
    return F.filter(full, lambda r: r["text"].isNotNull())


def global_importance(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean absolute contribution per feature; one pass, then 23 numbers are unpivoted."""
    wide = df.agg(*[F.avg(F.abs(f"c_{f}")).alias(f) for f in features])
    return wide.unpivot([], list(features), "feature", "mean_abs_shap")
