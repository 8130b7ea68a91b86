"""Training, tuning, calibration, hold-out and ablation of boosted trees (``boosting.py``, ``isotonic.py``)."""
from __future__ import annotations

import itertools
from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarp import config as C
from scarp.operators import metrics as M
from scarp.operators.boosting import BoostedModel, Trial, fit_trials, score_udf
from scarp.operators.isotonic import Calibrator, fit_isotonic
from scarp.operators.labels import upstream_flag
from scarp.session import shared_dir, stored

ROUNDS = 100
AT_ONCE = 4     # calibrators fitted at the same time: each is a row of short jobs
GRID = {"depth": [3, 4, 5], "min_rows": [50, 200], "rate": [0.03, 0.1]}


def fit_boosted(train: DataFrame, features: Sequence[str], rounds: int = ROUNDS, valid: DataFrame | None = None,
                trial: Trial = Trial(), **kw) -> BoostedModel:
    """One ensemble; with ``valid`` the number of trees is chosen by early stopping on its log-loss."""
    return fit_trials(train, features, [trial], rounds, valid, **kw)[0]


def score_trials(df: DataFrame, models: Sequence[BoostedModel], *cols: str) -> DataFrame:
    """(trial, cols, raw) of every row and model, from one pass over the rows."""
    probs = score_udf(models)(models[0].vector())
    return df.select(*cols, F.posexplode(probs).alias("trial", "raw"))


def tune_grid(train: DataFrame, val: DataFrame, features: Sequence[str], rounds: int = ROUNDS, k: int = C.TOP_K,
              grid: Mapping[str, Iterable] | None = None, **kw) -> tuple[BoostedModel, list[dict]]:
    """Fit the whole grid with early stopping; best mean validation P@k wins, average precision breaks ties.

    All points grow together, a level of every one of them per job, and score the validation rows in one pass.
    """
    grid = grid or GRID
    points = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    models = fit_trials(train, features, [Trial(**p) for p in points], rounds, val, **kw)
    scored = stored(score_trials(val, models, *M.KEYS, "y"), "tuning-scores")
    p = M.precision_at_k(scored, "raw", k, ["trial"]).groupBy("trial").agg(F.avg("precision").alias("p"))
    both = M.pr_auc(scored, "raw", ["trial"]).join(p, "trial", "left").collect()   # one row per trial
    by_trial = {r["trial"]: (r["p"] or 0.0, r["pr_auc"] or 0.0) for r in both}
    quality = [by_trial.get(n, (0.0, 0.0)) for n in range(len(models))]
    trials = [{"trial": n, **points[n], "trees": len(models[n].trees), "val_precision_at_k": q[0], "val_pr_auc": q[1]}
              for n, q in enumerate(quality)]
    return models[max(range(len(models)), key=lambda n: quality[n])], trials


def _fit_each(parts: Sequence[tuple[DataFrame, str]]) -> list[Calibrator]:
    """A calibrator for each (rows, score)."""
    shared_dir(parts[0][0].sparkSession)        # chosen once, before the threads
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(lambda p: fit_isotonic(*p), parts))


def calibrate_all(val: DataFrame, scores: Sequence[str]) -> tuple[dict[str, Calibrator], DataFrame]:
    """Calibrators for the model and the baselines and a long report (score, bin, n, mean_pred, observed, brier)."""
    cals = dict(zip(scores, _fit_each([(val, s) for s in scores])))
    long = None
    for s, c in cals.items():
        part = c.apply(val, s, "p").select(F.lit(s).alias("score"), "p", "y")
        long = part if long is None else long.unionByName(part)
    report = M.reliability(long, "p", ["score"]).join(M.brier(long, "p", ["score"]), "score")
    return cals, report


def calibrated(df: DataFrame, cal: Calibrator, raw: str, out: str) -> DataFrame:
    """Calibrated probability; a tiny share of the raw score breaks the ties isotonic steps create."""
    return cal.apply(df, raw, "_p").withColumn(out, F.col("_p") + 1e-9 * F.col(raw)).drop("_p")


def final_score(df: DataFrame, model: BoostedModel, cal: Calibrator, out: str = "M1") -> DataFrame:
    return calibrated(model.score(df, "M1_raw"), cal, "M1_raw", out)


def score_temporal(test: DataFrame, model: BoostedModel, cals: Mapping[str, Calibrator]) -> DataFrame:
    out = M.baseline_scores(test)
    for s in ("B0_persistence", "B1_history"):
        out = cals[s].apply(out, s, f"{s}_p")
    return final_score(out, model, cals["M1_raw"])


def spatial_holdout(df: DataFrame, features: Sequence[str], rounds: int = 100, k: int = C.TOP_K,
                    grid: Mapping[str, Iterable] | None = None) -> DataFrame:
    """Train and tune upstream, test downstream; ``df`` has a split column. Returns the scored downstream rows."""
    half = stored(upstream_flag(df), "halves")
    part = lambda s, up: half.where((F.col("split") == s) & (F.col("upstream") if up else ~F.col("upstream")))
    model, _ = tune_grid(part("train", True), part("val", True), features, rounds, k, grid)
    up_val = part("val", True)
    cal, base = _fit_each([(stored(model.score(up_val).select("raw", "y"), "upstream-scores"), "raw"), (up_val, "ret_84_m")])
    test = M.baseline_scores(part("test", False))
    # every metric reads the scores; the trees are walked once
    return stored(base.apply(final_score(test, model, cal, "M1_spatial"), "B0_persistence", "B0_p"), "downstream-scores")


def ablate_groups(df: DataFrame, groups: Mapping[str, Sequence[str]], trial: Trial = Trial(), rounds: int = ROUNDS, k: int = C.TOP_K,
                  features: Sequence[str] = tuple(C.FEATURES), **kw) -> DataFrame:
    """Refit without each group, recalibrate, and report the metrics of every variant against the full model.

    The variants grow together and are scored in one pass, a column each; the calibrated scores are one long table, whose metrics
    are grouped aggregations.
    """
    rest = df.where("split IN ('val', 'test')")
    variants = {"full": tuple(features), **{f"-{g}": tuple(f for f in features if f not in cols) for g, cols in groups.items()}}
    trials = [Trial(trial.depth, trial.min_rows, trial.rate, fs) for fs in variants.values()]
    models = fit_trials(df.where("split = 'train'"), features, trials, rounds, **kw)
    keep = ["split", *M.KEYS, "y", "major"]
    raw = stored(rest.withColumn("_raw", score_udf(models)(models[0].vector())).select(
        *keep, *[F.col("_raw")[n].alias(f"_raw_{n}") for n in range(len(models))]), "ablation-raw")
    owns = [raw.select(*keep, F.col(f"_raw_{n}").alias("raw")) for n in range(len(models))]
    cals = _fit_each([(own.where("split = 'val'"), "raw") for own in owns])
    parts = []
    for (name, fs), own, cal in zip(variants.items(), owns, cals):
        parts.append(calibrated(own, cal, "raw", "p").select(F.lit(name).alias("variant"), F.lit(len(fs)).alias("n_features"), "split",
                                                             *M.KEYS, "y", "major", "p"))
    long = stored(reduce(DataFrame.unionByName, parts), "ablation-scores")
    by = ["variant", "n_features", "split"]
    s = M.summarise(long, "p", "p", k, by)
    full = s.where("variant = 'full'").select("split", "metric", F.col("value").alias("_full"))
    # as many rows as splits x metrics
    return s.join(F.broadcast(full), ["split", "metric"]).withColumn("delta_vs_full", F.col("value") - F.col("_full")).drop("_full")
