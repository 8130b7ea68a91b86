"""As-of feature table: every value uses only passes at or before the forecast date."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scarp import config as C
from scarp.functions.columns import day_angle
from scarp.functions.ordering import exact_percentiles, running_sums
from scarp.operators import panel as P
from scarp.operators.lookback import Look, look_around

NOW_COLUMNS = ["dist_main_channel_m", "near_channel_width_m", "char_shield_frac", "nearbank_water_frac",
               "bank_height_m"]
FACT_COLUMNS = ["bank_pos_m", *NOW_COLUMNS]


def stage_per_pass(positions: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """One stage value per pass day: the first in pass order."""
    return (P.with_day(positions).groupBy(*scope, "day")
            .agg(F.min_by("belt_water_km2", F.when(F.col("belt_water_km2").isNotNull(), F.col("pass_id")))
                 .alias("stage_km2")))


def stage_features(stage: DataFrame, scope: Sequence[str] = (), days: DataFrame | None = None) -> DataFrame:
    """Change against the passes ~12 and ~24 days back and departure from an as-of seasonal mean.

    ``stage`` has one row per pass day and scope, so the windows here are calendar-sized. ``days`` limits the result.
    """
    w = Window.partitionBy(*scope).orderBy("day")
    maps = {f"back_{d}": P.nearest_pass(-d, tol, scope) for d, tol in C.STAGE_LAGS.items()}
    s = stage.withColumns(maps)

    def change(d: int, tol: int) -> Column:
        frame = F.collect_list(F.struct("day", F.col("stage_km2").alias("v"))).over(
            w.rangeBetween(-(d + tol), -(d - tol)))
        then = F.get(F.filter(frame, lambda x: x["day"] == F.col(f"back_{d}")), F.lit(0))["v"]
        return F.col("stage_km2") - then

    s = s.withColumns({f"stage_change_{d}d": change(d, tol) for d, tol in C.STAGE_LAGS.items()})
    # season: circular day-of-year distance <= 30 on a ring of 366, spelled out as 61 values -> equi-join
    doy = F.dayofyear(F.date_from_unix_date("day"))
    if days is not None:
        s = s.join(days, [*scope, "day"], "left_semi")
    probes = s.select(*scope, "day", F.explode(F.transform(
        F.sequence(F.lit(-30), F.lit(30)), lambda o: F.pmod(doy - 1 + o, F.lit(366)) + 1)).alias("doy"))
    older = stage.select(*scope, F.col("day").alias("_old"), doy.alias("doy"), F.col("stage_km2").alias("_v"))
    clim = (probes.join(older, [*scope, "doy"]).where(F.col("day") - F.col("_old") > 180)
            .groupBy(*scope, "day").agg(F.avg("_v").alias("_mean"), F.count(F.lit(1)).alias("_n")))
    return (s.join(clim, [*scope, "day"], "left")
            .withColumn("stage_anom_km2", F.col("stage_km2") - F.when(F.col("_n") >= 3, F.col("_mean")))
            .select(*scope, "day", "stage_km2", "stage_change_12d", "stage_change_24d", "stage_anom_km2"))


CURVE_PART_M = 100_000.0
CURVE_BLOCK = 4096


def _whole_turns(step: Column) -> Column:
    """What to add after a jump of the angle: jumps larger than half a turn are whole turns."""
    pi = F.pi()
    wrapped = step - 2 * pi * F.floor((step + pi) / (2 * pi))
    wrapped = F.when((wrapped == -pi) & (step > 0), pi).otherwise(wrapped)
    return F.coalesce(F.when(F.abs(step) < pi, F.lit(0.0)).otherwise(wrapped - step), F.lit(0.0))


def curvature(transects: DataFrame, half_window: int = 5, scope: Sequence[str] = (), part_m: float = CURVE_PART_M,
              block: int = CURVE_BLOCK) -> DataFrame:
    """Signed curvature (1/km) from the turning of the landward normal along each bank.

    A bank is cut into parts of ``part_m``; turns and places are counted inside a part and only part totals are summed
    along the bank. The frame of ``half_window`` rows then runs in blocks of ``block`` places whose ends overlap.
    """
    if half_window * 2 >= block:
        raise ValueError("a block must be longer than the window")
    by = [*scope, "bank"]
    part = [*by, "_part"]
    w = Window.partitionBy(*part).orderBy("chainage_m")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    t = transects.withColumns({"_a": F.atan2("ny", "nx"), "_part": F.floor(F.col("chainage_m") / part_m)})
    t = t.withColumn("_turn", _whole_turns(F.col("_a") - F.lag("_a").over(w)))
    t = t.withColumns({"_turned": F.sum("_turn").over(upto), "_i": F.row_number().over(w)})
    ends = t.groupBy(*part).agg(F.sum("_turn").alias("_t"), F.count(F.lit(1)).alias("_n"), F.min_by("_a", "_i").alias("_first"),
                                F.max_by("_a", "_i").alias("_last"))
    along = Window.partitionBy(*by).orderBy("_part")   # a row per part
    ends = ends.withColumn("_gap", _whole_turns(F.col("_first") - F.lag("_last").over(along)))
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    ends = ends.select(*part, (F.coalesce(F.sum("_t").over(before), none) + F.sum("_gap").over(
        along.rowsBetween(Window.unboundedPreceding, 0))).alias("_t0"), F.coalesce(F.sum("_n").over(before), none).alias("_i0"))
    t = t.join(ends, part).withColumns({"_angle": F.col("_a") + F.col("_turned") + F.col("_t0"), "_i": F.col("_i") + F.col("_i0")})
    in_block = lambda o: F.floor((F.col("_i") + o) / block)
    t = t.withColumn("_block", F.explode(F.array_distinct(F.array(in_block(-half_window), in_block(half_window)))))
    near = Window.partitionBy(*by, "_block").orderBy("_i").rowsBetween(-half_window, half_window)
    d_angle = F.last("_angle").over(near) - F.first("_angle").over(near)
    d_km = (F.last("chainage_m").over(near) - F.first("chainage_m").over(near)) / 1000.0
    sign = F.when(F.col("bank") == "W", 1.0).otherwise(-1.0)
    t = t.withColumn("baseline_curvature", F.when(d_km > 0, sign * d_angle / d_km)).where(in_block(0) == F.col("_block"))
    return t.select(*transects.columns, "baseline_curvature")


def robust_panel(positions: DataFrame, maps: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Completed panel with current (b0) and permanent (perm) bank position, plus the calendar maps."""
    per_pass = P.first_per_pass(positions, FACT_COLUMNS, scope)
    grid = P.complete_panel(per_pass, maps, FACT_COLUMNS, scope)
    b = F.col("bank_pos_m")
    return P.attach_maps(grid, maps, scope).withColumns({
        "b0": F.when(b.isNotNull(), P.frame_percentile("bank_pos_m", 0.5, -C.CURRENT_DAYS, 0, scope=scope)),
        "perm": P.frame_percentile("bank_pos_m", 0.25, -C.PERMANENT_DAYS, 0, C.PERMANENT_MIN, scope),
        "n_obs_365": P.frame_count("bank_pos_m", -364, 0, scope),
    })


def feature_table(positions: DataFrame, transects: DataFrame, stage: DataFrame | None = None,
                  scope: Sequence[str] = (), maps: DataFrame | None = None) -> DataFrame:
    """The 23 features for every (segment, pass date) that has a current bank position."""
    if maps is None:
        maps = P.calendar_maps(P.pass_calendar(positions, scope), scope)
    if stage is None:
        stage = stage_per_pass(positions, scope)
    links = [*[f"back_{d}" for d in C.LAGS], "prev"]
    seen = P.with_links(P.first_per_pass(positions, FACT_COLUMNS, scope), maps, links, scope)
    g = look_around(seen, _looks(), scope, where="bank_pos_m").drop(*links)
    return _features_of(g, transects, stage_features(stage, scope), scope)


def _looks() -> dict[str, Look]:
    """What ``robust_panel`` and its lags say of a day with a position, as look-backs."""
    def lag(d: int) -> dict:
        return {"at": f"back_{d}", "within": (-(d + C.LAGS[d]), -(d - C.LAGS[d]))}

    current = {"col": "bank_pos_m", "lo": -C.CURRENT_DAYS, "p": 0.5, "seen": True}
    permanent = {"col": "bank_pos_m", "lo": -C.PERMANENT_DAYS, "p": 0.25, "least": C.PERMANENT_MIN}
    return {"b0": Look(**current), "perm": Look(**permanent), "n_obs_365": Look("bank_pos_m", -364),
            **{f"_b0_{d}": Look(**current, **lag(d)) for d in (28, 56, 84)}, "_perm_365": Look(**permanent, **lag(365)),
            "_dm_28": Look("dist_main_channel_m", here=True, **lag(28)),
            "_b_prev": Look("bank_pos_m", here=True, at="prev", within=(-C.LAST_CHANGE_MAX_DAYS, -1))}


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _quantile(ordered: Column, p: float) -> Column:
    """Linear interpolation in an ordered array; NULL if it is empty."""
    pos = (F.size(ordered) - 1) * F.lit(p)
    lo, hi = F.floor(pos).cast("int"), F.ceil(pos).cast("int")
    return F.when(lo == hi, F.get(ordered, lo)).otherwise((hi - pos) * F.get(ordered, lo) + (pos - lo) * F.get(ordered, hi))


def features_of_dates(fresh: DataFrame, history: DataFrame, transects: DataFrame, stage: DataFrame, maps: DataFrame,
                      scope: Sequence[str] = ()) -> DataFrame:
    """``feature_table`` for the dates in ``fresh`` alone.

    ``fresh`` holds whole positions of the dates asked for, ``history`` (transect_id, pass_id, date, bank_pos_m,
    dist_main_channel_m) those dates and everything they look back on, ``maps`` the calendar maps. A segment's history is
    one array, bounded by its days, and each asked date reads its look-backs there: work grows with the dates asked for,
    not with the windows of the days before them. A segment without a position on a date has no row, as in ``feature_table``.
    """
    keys = [*scope, "transect_id"]
    past = P.first_per_pass(history, ["bank_pos_m", "dist_main_channel_m"], scope).groupBy(*keys).agg(F.collect_list(F.struct(
        "day", F.col("bank_pos_m").alias("b"), F.col("dist_main_channel_m").alias("m"))).alias("_h"))
    now = P.attach_maps(P.first_per_pass(fresh, FACT_COLUMNS, scope).where("bank_pos_m IS NOT NULL"), maps, scope)
    asked = [*FACT_COLUMNS, *[f"back_{d}" for d in C.LAGS], "prev"]
    now = now.groupBy(*keys).agg(F.collect_list(F.struct("day", *asked)).alias("_now"))
    h = F.col("_h")

    def on(day: Column, field: str) -> Column:
        return F.get(F.filter(h, lambda x: x["day"] == day), F.lit(0))[field]

    def seen(day: Column, days: int) -> Column:
        """Positions of the ``days`` up to ``day``, in order."""
        return F.sort_array(F.transform(
            F.filter(h, lambda x: x["b"].isNotNull() & (x["day"] >= day - days) & (x["day"] <= day)), lambda x: x["b"]))

    def current(day: Column) -> Column:
        return F.when(on(day, "b").isNotNull(), _let(seen(day, C.CURRENT_DAYS), lambda a: _quantile(a, 0.5)))

    def permanent(day: Column) -> Column:
        return _let(seen(day, C.PERMANENT_DAYS), lambda a: F.when(F.size(a) >= C.PERMANENT_MIN, _quantile(a, 0.25)))

    def row(t: Column) -> Column:
        day = t["day"]
        return F.struct(
            day.alias("day"), *[t[c].alias(c) for c in FACT_COLUMNS], current(day).alias("b0"), permanent(day).alias("perm"),
            F.size(seen(day, 364)).alias("n_obs_365"), *[current(t[f"back_{d}"]).alias(f"_b0_{d}") for d in (28, 56, 84)],
            F.when(t["back_365"].isNotNull(), permanent(t["back_365"])).alias("_perm_365"),
            on(t["back_28"], "m").alias("_dm_28"), on(t["prev"], "b").alias("_b_prev"))

    g = now.join(past, keys).select(*keys, F.inline(F.transform("_now", row)))
    days = P.with_day(fresh).select(*scope, "day").distinct()
    return _features_of(g, transects, stage_features(stage, scope, days), scope)


def _features_of(g: DataFrame, transects: DataFrame, stage: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Features from panel rows with their look-backs and the stage features per day."""
    b0 = F.col("b0")
    g = g.select(
        *scope, "transect_id", "day", b0.alias("bank_pos_m"), F.col("bank_pos_m").alias("raw_bank_pos_m"),
        *[(b0 - F.col(f"_b0_{d}")).alias(f"ret_{d}_m") for d in (28, 56, 84)],
        (F.col("perm") - F.col("_perm_365")).alias("ret_365_m"),
        (b0 - F.col("perm")).alias("inundation_m"),
        (F.col("bank_pos_m") - F.col("_b_prev")).alias("raw_last_change_m"),
        F.col("n_obs_365").cast("double").alias("n_obs_365"),
        (F.col("dist_main_channel_m") - F.col("_dm_28")).alias("d_dist_main_28_m"),
        *NOW_COLUMNS)
    bent = transects if "baseline_curvature" in transects.columns else curvature(transects, scope=scope)
    meta = bent.select(*scope, "transect_id", "bank", "chainage_m", "baseline_curvature")
    g = g.join(meta, [*scope, "transect_id"], "left")
    by = [*scope, "bank", "day"]
    g = g.withColumns({
        "nb_ret_84_m": P.neighbour_mean("ret_84_m", 3, by),
        "nb_ret_365_m": P.neighbour_mean("ret_365_m", 3, by),
        "embayment_m": F.col("bank_pos_m") - P.neighbour_mean("bank_pos_m", 5, by),
    })
    g = P.attach_maps(g, stage, scope)
    date = F.date_from_unix_date("day")
    return g.withColumns({
        "forecast_date": date, "doy_sin": F.sin(day_angle(date)), "doy_cos": F.cos(day_angle(date)),
        "year": F.year(date),
    }).select(*scope, "transect_id", "forecast_date", *C.FEATURES, "bank_pos_m", "raw_bank_pos_m", "bank",
              "chainage_m", "year")


def long_features(features: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return features.unpivot(list(keep), list(names), "feature", "value")


def feature_describe(features: DataFrame, names: Sequence[str] = tuple(C.FEATURES)) -> DataFrame:
    # one pass gives all counts and means; the long form is only needed for the medians
    wide = features.select(*[F.col(n).cast("double").alias(n) for n in names])
    long = long_features(wide, names)
    basic = long.groupBy("feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    med = exact_percentiles(long, ["feature"], "value", {"median": 0.5})
    return basic.join(med, "feature", "left")


def coverage_and_rank_correlation(table: DataFrame, names: Sequence[str], target: str) -> DataFrame:
    """Non-null share and Spearman correlation of each feature with ``target`` (average ranks for ties)."""
    wide = table.select(F.col(target).cast("double").alias("_t"),
                        *[F.col(n).cast("double").alias(n) for n in names])
    long = long_features(wide, names, ["_t"])
    share = long.groupBy("feature").agg((F.count("value") / F.count(F.lit(1))).alias("share"))
    both = long.where("value IS NOT NULL AND _t IS NOT NULL")

    def mid_ranks(col: str) -> DataFrame:
        counts = both.groupBy("feature", col).agg(F.count(F.lit(1)).alias("_n"))
        cum = running_sums(counts, ["feature"], col, {"_cum": F.col("_n")}, descending=False)
        return cum.select("feature", col, (F.col("_cum") - (F.col("_n") - 1) / 2).alias(f"_r{col}"))

    pairs = both.groupBy("feature", "value", "_t").agg(F.count(F.lit(1)).alias("_w"))
    r = pairs.join(mid_ranks("value"), ["feature", "value"]).join(mid_ranks("_t"), ["feature", "_t"])
    x, y, w = F.col("_rvalue"), F.col("_r_t"), F.col("_w")
    s = r.groupBy("feature").agg(F.sum(w).alias("n"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"),
                                 F.sum(w * x * x).alias("sxx"), F.sum(w * y * y).alias("syy"),
                                 F.sum(w * x * y).alias("sxy"))
    cov = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    var = (F.col("n") * F.col("sxx") - F.col("sx") ** 2) * (F.col("n") * F.col("syy") - F.col("sy") ** 2)
    return share.join(s.select("feature", F.when(var > 0, cov / F.sqrt(var)).alias("spearman")), "feature", "left")
