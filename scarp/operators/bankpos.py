"""Bank position per (transect, pass) and the geometry around it.

Samples: (img, transect_id, sample, belt, water, nodata) with 0/1 flags; sample 0 is the riverward end. A transect
has a fixed number of samples, so its samples form a short array or window group whatever the number of passes.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scarp import config as C
from scarp.operators import raster as R

KEYS = ("img", "transect_id")


def first_run_from_land(samples: DataFrame, run: int = C.BELT_RUN, keys: Sequence[str] = KEYS) -> DataFrame:
    """Landward-most sample of the first run of ``run`` belt samples met from the landward end; -1 if none."""
    w = Window.partitionBy(*keys).orderBy("sample")
    back = F.sum("belt").over(w.rowsBetween(-(run - 1), 0))
    return (samples.select(*keys, "sample", "belt").withColumn("_n", back).groupBy(*keys)
            .agg(F.coalesce(F.max(F.when(F.col("_n") == run, F.col("sample"))), F.lit(-1)).alias("idx")))


def measure_banks(samples: DataFrame, s0: float, step: float, pixel_m: float = C.PIXEL_M, run: int = C.BELT_RUN,
                  near_m: float = C.NEAR_M, shield_m: float = C.SHIELD_M, guard_m: float = C.NODATA_GUARD_M,
                  keys: Sequence[str] = KEYS) -> DataFrame:
    """Position, validity, near width, near water share and char shield of every transect in one aggregation.

    The samples of a transect become one ordered array; all frames around the bank are slices of it.
    ``land_dist`` (px from water to land) is optional in the samples.
    """
    has_width = "land_dist" in samples.columns
    fields = ["sample", "belt", "water", "nodata", *(["land_dist"] if has_width else [])]
    g = samples.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_s"))
    hit = lambda i: F.forall(F.slice("_s", i - run + 2, run), lambda x: x["belt"] == 1)
    ends = F.sequence(F.lit(run - 1), F.size("_s") - 1)
    idx = F.coalesce(F.array_max(F.filter(ends, hit)), F.lit(-1))
    g = g.withColumn("idx", F.when(F.size("_s") >= run, idx).otherwise(-1))
    at = F.col("idx")

    def frame(length_m: float) -> Column:
        """Samples from ``length_m`` riverward of the bank up to the bank, both inclusive."""
        lo = F.greatest(at - int(length_m / step), F.lit(0))
        return F.slice("_s", lo + 1, at - lo + 1)

    guard_from = F.when(at >= 0, F.greatest(at - int(guard_m / step), F.lit(0))).otherwise(0)
    blind = F.exists(F.slice("_s", guard_from + 1, F.size("_s")), lambda x: x["nodata"] == 1)
    end_is_belt = F.element_at("_s", -1)["belt"] == 1
    g = g.withColumn("valid", (at >= 0) & ~blind & ~end_is_belt)
    share = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, x: a + x["water"]) / F.size(arr)
    ok = F.col("valid")
    cols = {"bank_pos_m": F.when(ok, s0 + at * step),
            "nearbank_water_frac": F.when(ok, share(frame(near_m))),
            "char_shield_frac": F.when(ok, 1.0 - share(frame(shield_m)))}
    if has_width:
        cols["near_channel_width_m"] = F.when(ok, 2.0 * pixel_m * F.array_max(
            F.transform(frame(near_m), lambda x: x["land_dist"])))
    return g.withColumns(cols).select(*keys, "idx", F.col("valid").cast("int").alias("valid"), *cols)


def distance_to_core(points: DataFrame, px: DataFrame, core: str, pixel_m: float = C.PIXEL_M,
                     cap_px: int | None = None) -> DataFrame:
    """Exact distance (m) from bank points (img, row, col, ...) to the nearest core pixel of their image.

    Points meet the column distances of their own image row, and all points of a strip of rows are solved together.
    NULL without a core or beyond ``cap_px``; a point outside the rows of its image has none.
    """
    out = "dist_main_channel_m"
    g = R.column_distances(px.select("img", "row", "col", core), F.col(core) == 1, "_g").where("_g IS NOT NULL")
    g = g.select("img", "row", "col", "_g").join(points.select("img", "row"), ["img", "row"], "left_semi")
    g = g.select(*[F.col(c).alias(c) for c in g.columns])   # names of its own, as points may come from the same image
    schema = T.StructType([*points.schema.fields, T.StructField(out, T.DoubleType())])
    names = points.columns

    def measure(p: pa.Table, near: pa.Table) -> pa.Table:
        placed = pc.and_(pc.is_valid(p["row"]), pc.is_valid(p["col"]))
        asked, lost = p.filter(placed).select(names), p.filter(pc.invert(placed)).select(names)
        if not len(asked) or not len(near):
            return p.select(names).append_column(out, pa.nulls(len(p), pa.float64()))
        d2, none = R.row_squares(*(x.to_numpy().astype(np.int64) for x in (asked["row"], asked["col"], near["row"], near["col"], near["_g"])))
        far = none if cap_px is None else none | (d2 > cap_px * cap_px)
        solved = asked.append_column(out, pa.array(np.sqrt(d2.astype(float)) * pixel_m, mask=far))
        return pa.concat_tables([solved, lost.append_column(out, pa.nulls(len(lost), pa.float64()))])

    return points.groupBy("img", R.strip_of()).cogroup(g.groupBy("img", R.strip_of())).applyInArrow(measure, schema)


def belt_area(px: DataFrame, pixel_m: float = C.PIXEL_M) -> DataFrame:
    from scarp.functions.columns import sum_if
    km2 = pixel_m ** 2 / 1e6
    return px.groupBy("img").agg((sum_if(F.col("belt") == 1) * km2).alias("belt_area_km2"),
                                 (sum_if((F.col("belt") == 1) & (F.col("water") == 1)) * km2).alias("belt_water_km2"))


def bank_positions(masks: DataFrame, samples: DataFrame, s0: float, step: float, min_px: int,
                   line: Sequence[tuple[float, float]] | DataFrame | None = None, bridge_px: int = C.BRIDGE_GAP_PX,
                   radius: int = C.OPEN_RADIUS_PX, half_width: float = C.LINE_BUFFER_M, core_px: int = C.CORE_PX,
                   near_m: float = C.NEAR_M, shield_m: float = C.SHIELD_M, guard_m: float = C.NODATA_GUARD_M,
                   pixel_m: float = C.PIXEL_M) -> DataFrame:
    """Positions and channel geometry of every transect in every mask, from the masks alone.

    ``masks``: (img, row, col, mask) with NULL for no data. ``samples``: (transect_id, sample, row, col), sample 0 riverward
    at ``s0`` metres. The belt decides where the bank is; widths, shares and the main channel come from the water of the mask.
    A transect without a valid position has one row with NULL figures; an image without a core has no distance to it.
    Returns (img, transect_id, idx, valid, bank_pos_m, dist_main_channel_m, near_channel_width_m, char_shield_frac,
    nearbank_water_frac, belt_area_km2, belt_water_km2).
    """
    from scarp.operators.components import braid_belt
    from scarp.operators.linear import sample_raster
    from scarp.session import settle
    px = masks.select("img", "row", "col", "mask")
    belt = braid_belt(px, "mask", line, min_px, bridge_px, radius, half_width)
    dry = F.coalesce(F.col("mask"), F.lit(0)) != 1
    px = R.distance_to(belt, dry, "land_dist").select(
        "img", "row", "col", "belt", F.coalesce("mask", F.lit(0)).alias("water"), F.col("mask").isNull().cast("int").alias("nodata"),
        "land_dist")
    core = (F.col("water") == 1) & F.coalesce(F.col("land_dist") >= core_px, F.lit(True))
    px = settle(px.withColumn("core", core.cast("int")))
    # samples are exploded from transects, and the engine takes them for as small as those: it would broadcast them all
    samples = samples.select("transect_id", "sample", "row", "col").hint("merge")
    seen = sample_raster(samples, px, ["belt", "water", "nodata", "land_dist"])
    banks = settle(measure_banks(seen, s0, step, pixel_m, near_m=near_m, shield_m=shield_m, guard_m=guard_m))
    at = banks.where("valid = 1").select("img", "transect_id", F.col("idx").alias("sample")).join(samples, ["transect_id", "sample"])
    far = distance_to_core(at.select("img", "transect_id", "row", "col"), px, "core", pixel_m)
    return (banks.join(far.select("img", "transect_id", "dist_main_channel_m"), ["img", "transect_id"], "left")
            .join(belt_area(px, pixel_m), "img").select(
                "img", "transect_id", "idx", "valid", "bank_pos_m", "dist_main_channel_m", "near_channel_width_m",
                "char_shield_frac", "nearbank_water_frac", "belt_area_km2", "belt_water_km2"))


def assemble_positions(per_pass: DataFrame, summary: DataFrame) -> DataFrame:
    """Add the pass columns to the positions; the engine picks the join by the measured size of the summary."""
    return per_pass.join(summary.select("pass_id", "date", "platform", "water_area_km2", "otsu_ok", "coverage"), "pass_id")


def bank_height(positions: DataFrame, dem: DataFrame, s0: float, step: float, keys: Sequence[str] = ("transect_id",)) -> DataFrame:
    """Mean height 5..30 samples landward of the bank minus the median 21..200 samples riverward.

    ``dem``: (keys, sample, z). Heights do not change over time: one array per transect, sliced per position.
    """
    z = dem.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", "z"))), lambda x: x["z"]).alias("_z"))
    j = F.bround((F.col("bank_pos_m") - s0) / step).cast("int")
    p = positions.join(z, list(keys), "left").withColumn("_j", j)
    part = lambda lo, n: F.array_compact(F.slice("_z", lo + 1, n))
    start = F.greatest(F.col("_j") - 200, F.lit(0))
    p = p.withColumns({
        "_land": F.when(F.col("_j") >= 0, part(F.col("_j") + 5, F.lit(26))),
        "_river": F.when(F.col("_j") >= 0, F.sort_array(part(start, F.greatest(F.col("_j") - 20, F.lit(0)) - start)))})
    n = F.size("_river")
    mid = (F.get("_river", F.floor((n - 1) / 2).cast("int")) + F.get("_river", F.floor(n / 2).cast("int"))) / 2
    mean = F.aggregate("_land", F.lit(0.0), lambda a, x: a + x) / F.size("_land")
    ok = (F.size("_land") > 0) & (n > 0)
    return p.withColumn("bank_height_m", F.when(ok, mean - mid)).drop("_z", "_j", "_land", "_river")
