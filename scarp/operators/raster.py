"""Image operators on pixel tables (img, row, col, ...). No data is NULL.

Focal operators cut images into tiles and repeat only the border pixels a neighbouring tile needs. One exchange by
tile then serves both passes of a separable window: rows first, columns second.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scarp import config as C
from scarp.functions import columns as K

TILE = 256
SMOOTH_STRETCH = 4096
LINE_CELL = 32    # pixels of a side of a cell of the line index
LINE_PART = 4096
BAND_ROWS = 1024
STRIP_ROWS = 32   # image rows solved together


# --- focal machinery -----------------------------------------------------------------------------------------------
def _spread(px: DataFrame, radius: int, tile: int) -> DataFrame:
    """Give each pixel the number of its tile, and of the neighbours whose halo it lies in."""
    span = lambda c: F.explode(F.array_distinct(F.array(
        F.floor((F.col(c) - radius) / tile), F.floor((F.col(c) + radius) / tile))))
    return px.withColumn("_tr", span("row")).withColumn("_tc", span("col"))


def tile_with_halo(px: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    if radius >= tile:
        raise ValueError("the tile must be larger than the radius")
    return _spread(px, radius, tile).repartition("img", "_tr", "_tc")


def only_owned(px: DataFrame, tile: int = TILE) -> DataFrame:
    """Keep each pixel in its own tile only."""
    return px.where((F.floor(F.col("row") / tile) == F.col("_tr")) & (F.floor(F.col("col") / tile) == F.col("_tc"))
                    ).drop("_tr", "_tc")


def _row_window(radius: int):
    return Window.partitionBy("img", "_tr", "_tc", "row").orderBy("col").rangeBetween(-radius, radius)


def _col_window(radius: int):
    return Window.partitionBy("img", "_tr", "_tc", "col").orderBy("row").rangeBetween(-radius, radius)


def focal_sums(px: DataFrame, sums: Mapping[str, Column], radius: int, tile: int = TILE) -> DataFrame:
    """Add square-window sums; pixels outside the image or NULL do not count."""
    t = tile_with_halo(px.withColumns({f"_v_{n}": c for n, c in sums.items()}), radius, tile)
    t = t.withColumns({f"_h_{n}": F.sum(f"_v_{n}").over(_row_window(radius)) for n in sums})
    t = t.withColumns({n: F.sum(f"_h_{n}").over(_col_window(radius)) for n in sums})
    return only_owned(t.drop(*[f"_v_{n}" for n in sums], *[f"_h_{n}" for n in sums]), tile)


def lee_filter(px: DataFrame, value: str, size: int = C.LEE_WINDOW, looks: float = C.LEE_LOOKS, out: str = "filtered",
               tile: int = TILE) -> DataFrame:
    """Lee speckle filter over the valid pixels of the window, which is cut off at the image border."""
    v = F.col(value)
    f = focal_sums(px, {"_n": F.when(v.isNotNull(), 1.0), "_s": v, "_q": v * v}, size // 2, tile)
    mean = F.col("_s") / F.col("_n")
    f = f.withColumn("_m", mean).withColumn("_var", F.greatest(F.col("_q") / F.col("_n") - F.col("_m") ** 2, F.lit(0.0)))
    cu2 = 1.0 / looks
    signal = F.greatest((F.col("_var") - F.col("_m") ** 2 * cu2) / (1.0 + cu2), F.lit(0.0))
    k = F.when(F.col("_var") > 0, signal / F.col("_var")).otherwise(0.0)
    return f.withColumn(out, F.when(v.isNotNull(), F.col("_m") + k * (v - F.col("_m")))).drop("_n", "_s", "_q", "_m", "_var")


def boxcar_db(px: DataFrame, value: str, radius: int = C.LEE_WINDOW // 2, out: str = "smoothed", tile: int = TILE) -> DataFrame:
    """Square mean in linear power, back in dB."""
    lin = K.from_db(F.col(value))
    f = focal_sums(px, {"_s": lin, "_n": F.when(F.col(value).isNotNull(), 1.0)}, radius, tile)
    return f.withColumn(out, K.to_db(F.col("_s") / F.col("_n"))).drop("_s", "_n")


def erode(px: DataFrame, mask: str, out: str = "eroded", tile: int = TILE) -> DataFrame:
    """3 x 3 erosion; beyond the image counts as background."""
    f = focal_sums(px, {"_n": F.when(F.col(mask) == 1, 1).otherwise(0)}, 1, tile)
    return f.withColumn(out, (F.col("_n") == 9).cast("int")).drop("_n")


def dilate(px: DataFrame, mask: str, out: str = "dilated", tile: int = TILE) -> DataFrame:
    f = focal_sums(px, {"_n": F.when(F.col(mask) == 1, 1).otherwise(0)}, 1, tile)
    return f.withColumn(out, (F.col("_n") > 0).cast("int")).drop("_n")


def opening(px: DataFrame, mask: str, out: str = "opened", tile: int = TILE) -> DataFrame:
    return dilate(erode(px, mask, "_e", tile), "_e", out, tile).drop("_e")


def squares_within(hit: np.ndarray, radius: int) -> np.ndarray:
    """Squared distance (px) of every place to the nearest hit, exact up to ``radius`` and above its square beyond: vertical
    shifts first, then the minimum over the horizontal ones."""
    far = np.int32(4 * radius * radius + 4)
    g = np.where(hit, np.int32(0), far)
    for step in (g, g.T):   # a view, so the second pass goes on from the first
        was = step.copy()
        for o in range(1, radius + 1):
            np.minimum(step[o:], was[:-o] + o * o, out=step[o:])
            np.minimum(step[:-o], was[o:] + o * o, out=step[:-o])
    return g


def distance_within(px: DataFrame, target: Column, radius: int, out: str = "dist", tile: int = TILE) -> DataFrame:
    """Exact distance (px) to the nearest target pixel, NULL beyond ``radius``.

    A minimum over shifted distances is no window aggregate, so each tile (with its halo, of fixed size) is an array
    in its task.
    """
    if radius >= tile:
        raise ValueError("the tile must be larger than the radius")
    spread = _spread(px.withColumn("_hit", F.coalesce(target, F.lit(False))), radius, tile)
    schema = T.StructType([*px.schema.fields, T.StructField(out, T.DoubleType())])
    size, names = tile + 2 * radius, px.columns

    def measure(tab: pa.Table) -> pa.Table:
        r = tab["row"].to_numpy() - (tab["_tr"][0].as_py() * tile - radius)
        c = tab["col"].to_numpy() - (tab["_tc"][0].as_py() * tile - radius)
        hit = np.zeros((size, size), dtype=bool)
        hit[r, c] = tab["_hit"].to_numpy(zero_copy_only=False)
        best = squares_within(hit, radius)
        own = (r >= radius) & (r < tile + radius) & (c >= radius) & (c < tile + radius)
        d2 = best[r[own], c[own]]
        kept = tab.filter(pa.array(own)).select(names)
        dist = pa.array(np.sqrt(d2.astype(float)), mask=d2 > radius * radius)
        return kept.append_column(out, dist)

    return spread.groupBy("img", "_tr", "_tc").applyInArrow(measure, schema)


def nearest_squares(at: np.ndarray, src: np.ndarray, g: np.ndarray) -> np.ndarray:
    """min over j of (at - src_j)^2 + g_j for ascending ``at`` and ``src``.

    The best j never moves back along ``at``, so a place half-way between two solved ones looks only between their best j.
    Each halving costs the length of the row: n log n, without a loop over pixels.
    """
    n = len(at)
    low, best = np.empty(n, dtype=np.int64), np.zeros(n + 2, dtype=np.int64)
    best[n + 1] = len(src) - 1
    step = 1 << n.bit_length()
    while step > 1:
        half = step // 2
        mid = np.arange(half, n + 1, step)
        first, last = best[mid - half], best[np.minimum(mid + half, n + 1)]
        size = last - first + 1
        start = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(mid)), size)
        j = np.arange(len(owner)) - (start - first)[owner]
        cost = (at[mid - 1][owner] - src[j]) ** 2 + g[j]
        low[mid - 1] = np.minimum.reduceat(cost, start)
        hit = np.flatnonzero(cost == low[mid - 1][owner])
        best[mid] = j[hit[np.unique(owner[hit], return_index=True)[1]]]
        step = half
    return low


def strip_of(row: str = "row") -> Column:
    return F.floor(F.col(row) / STRIP_ROWS)


def row_squares(row: np.ndarray, col: np.ndarray, src_row: np.ndarray, src_col: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """min over the sources j of the same row of (col - src_col_j)^2 + g_j^2, and where a row has none; any order.

    The rows are laid out one after the other, so far apart that a source of another row is never the nearest.
    """
    names, rank = np.unique(np.concatenate([row, src_row]), return_inverse=True)
    low = min(col.min(), src_col.min())
    width, high = max(col.max(), src_col.max()) - low, g.max()
    apart = width + int(np.sqrt(float(width * width + high * high))) + 2
    at, src = rank[:len(row)] * apart + col - low, rank[len(row):] * apart + src_col - low
    order, by = np.argsort(at, kind="stable"), np.argsort(src, kind="stable")
    out = np.empty(len(at), np.int64)
    out[order] = nearest_squares(at[order], src[by], (g * g)[by])
    return out, ~np.isin(row, src_row)


def column_distances(px: DataFrame, target: Column, out: str, band: int = BAND_ROWS) -> DataFrame:
    """Add the distance (px) to the nearest target pixel of the same image column, NULL without one.

    A column is cut into bands of rows. Inside a band the nearest targets above and below are running values, the second in
    descending order, as a frame that ends at the last row would be read again for every row. The nearest targets of other
    bands come from one row per band, so a higher image adds bands and no window grows with it but that of the bands.
    """
    cut = ["img", "col", "_band"]
    hit = F.when(F.coalesce(target, F.lit(False)), F.col("row"))
    p = px.withColumns({"_hit": hit, "_band": F.floor(F.col("row") / band)})
    ends = p.groupBy(*cut).agg(F.min("_hit").alias("_lo"), F.max("_hit").alias("_hi"))
    over = lambda keys, order, last: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, last)
    ends = ends.select(*cut, F.last("_hi", True).over(over(cut[:2], F.asc("_band"), -1)).alias("_above"),
                       F.last("_lo", True).over(over(cut[:2], F.desc("_band"), -1)).alias("_below"))
    p = p.withColumns({"_up": F.last("_hit", True).over(over(cut, F.asc("row"), 0)), "_down": F.last("_hit", True).over(over(cut, F.desc("row"), 0))})
    near = F.least(F.col("row") - F.coalesce("_up", "_above"), F.coalesce("_down", "_below") - F.col("row"))
    return p.join(ends, cut).select(*px.columns, near.cast("long").alias(out))


def distance_to(px: DataFrame, target: Column, out: str = "dist") -> DataFrame:
    """Exact distance (px) to the nearest target pixel of the image, however far; NULL in an image without one.

    Vertical distances come from bands of each image column; a strip of some image rows then is one array.
    """
    schema = T.StructType([*px.schema.fields, T.StructField(out, T.DoubleType())])
    names = px.columns

    def measure(tab: pa.Table) -> pa.Table:
        src = tab.filter(pc.is_valid(tab["_g"]))
        if not len(src):
            return tab.select(names).append_column(out, pa.nulls(len(tab), pa.float64()))
        d2, none = row_squares(*(x.to_numpy().astype(np.int64) for x in (tab["row"], tab["col"], src["row"], src["col"], src["_g"])))
        return tab.select(names).append_column(out, pa.array(np.sqrt(d2.astype(float)), mask=none))

    return column_distances(px, target, "_g").groupBy("img", strip_of()).applyInArrow(measure, schema)


# --- calibration and thresholds ------------------------------------------------------------------------------------
def lut_cells(lut: DataFrame, step: int) -> DataFrame:
    """One row per look-up cell with its four corner values. ``lut``: (img, row, col, a) on a regular grid."""
    r = Window.partitionBy("img", "col").orderBy("row")
    c = Window.partitionBy("img", "row").orderBy("col")
    rows = lut.withColumn("a10", F.lead("a").over(r))
    cells = rows.withColumns({"a01": F.lead("a").over(c), "a11": F.lead("a10").over(c)})
    return cells.where("a01 IS NOT NULL AND a10 IS NOT NULL").select(
        "img", (F.col("row") / step).cast("int").alias("_cr"), (F.col("col") / step).cast("int").alias("_cc"),
        F.col("a").alias("a00"), "a01", "a10", "a11")


def calibrate(px: DataFrame, lut: DataFrame, step: int, dn: str = "dn", out: str = "sigma0") -> DataFrame:
    """DN^2 / A^2 where DN > 0, A bilinear in the look-up grid and held at its edges."""
    cells = lut_cells(lut, step)
    edge = lut.groupBy("img").agg(F.max("row").alias("_mr"), F.max("col").alias("_mc"))
    p = px.join(edge, "img")
    r, c = F.least("row", "_mr") / float(step), F.least("col", "_mc") / float(step)
    p = p.withColumns({"_cr": F.least(F.floor(r), F.col("_mr") / step - 1).cast("int"),
                       "_cc": F.least(F.floor(c), F.col("_mc") / step - 1).cast("int")})
    fr, fc = r - F.col("_cr"), c - F.col("_cc")
    p = p.withColumns({"_fr": fr, "_fc": fc}).join(cells, ["img", "_cr", "_cc"])
    a = ((1 - F.col("_fr")) * ((1 - F.col("_fc")) * F.col("a00") + F.col("_fc") * F.col("a01"))
         + F.col("_fr") * ((1 - F.col("_fc")) * F.col("a10") + F.col("_fc") * F.col("a11")))
    return p.withColumn("_a", a).withColumn(
        out, F.when(F.col(dn) > 0, F.col(dn) * F.col(dn) / (F.col("_a") * F.col("_a")))).select(*px.columns, out)


def otsu(px: DataFrame, value: str, lo: float, hi: float, sample: int = 1, min_pixels: int = C.OTSU_MIN_PIXELS,
         bins: int = C.OTSU_BINS, out: str = "threshold") -> DataFrame:
    """Otsu threshold per image (NULL with too few pixels); at most ``bins`` rows per image reach the windows. An image of one
    value has that value as its threshold."""
    v = F.col(value)
    used = px.where((F.col("row") % sample == 0) & (F.col("col") % sample == 0) & (v > lo) & (v < hi))
    counts = used.groupBy("img", v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    stats = counts.groupBy("img").agg(F.min("v").alias("v0"), F.max("v").alias("v1"), F.sum("n").alias("total"))
    width = (F.col("v1") - F.col("v0")) / bins
    at = F.least(F.floor(F.coalesce((F.col("v") - F.col("v0")) / F.nullif(width, F.lit(0.0)), F.lit(0.0))), F.lit(bins - 1))
    hist = (counts.join(stats, "img").withColumn("bin", at.cast("int"))
            .groupBy("img", "bin", "v0", "v1").agg(F.sum("n").alias("n")))
    hist = hist.withColumn("c", F.col("v0") + (F.col("bin") + 0.5) * width)
    best = _best_split(hist, "n", "c", "bin", later_wins=False)
    return stats.join(best, "img", "left").select(
        "img", F.when(F.col("total") >= min_pixels, F.coalesce("c", F.when(F.col("v0") == F.col("v1"), F.col("v0")))).alias(out))


def _best_split(hist: DataFrame, n: str, c: str, order: str, later_wins: bool) -> DataFrame:
    w = Window.partitionBy("img").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    full = Window.partitionBy("img")
    h = hist.withColumn("_nc", F.col(n) * F.col(c)).withColumns({
        "_n1": F.sum(n).over(w), "_s1": F.sum("_nc").over(w), "_nt": F.sum(n).over(full), "_st": F.sum("_nc").over(full)})
    n2 = F.col("_nt") - F.col("_n1")
    gap = F.col("_s1") / F.col("_n1") - (F.col("_st") - F.col("_s1")) / n2
    h = h.where(F.col("_n1") < F.col("_nt")).withColumn("_bss", F.col("_n1") * n2 * gap * gap)
    key = F.struct("_bss", F.col(order) if later_wins else -F.col(order))
    return h.groupBy("img").agg(F.max_by(c, key).alias("c"))


def otsu_from_histogram(hist: DataFrame, out: str = "threshold") -> DataFrame:
    """Otsu from (img, bin, n, mean): the bucket mean at the largest between-class variance, later buckets first.

    nA (mA - m)^2 + nB (mB - m)^2 equals nA nB (mA - mB)^2 / N, so the same split search applies.
    """
    return _best_split(hist, "n", "mean", "bin", later_wins=True).withColumnRenamed("c", out)


def plausible_thresholds(th: DataFrame) -> DataFrame:
    """Replace implausible Otsu values by the fallbacks and flag the image."""
    vv_ok = F.coalesce(F.col("t_vv").between(*C.VV_PLAUSIBLE), F.lit(False))
    vh_ok = F.coalesce(F.col("t_vh").between(*C.VH_PLAUSIBLE), F.lit(False))
    return th.select("img", F.when(vv_ok, F.col("t_vv")).otherwise(C.VV_FALLBACK).alias("t_vv"),
                     F.when(vh_ok, F.col("t_vh")).otherwise(C.VH_FALLBACK).alias("t_vh"), (vv_ok & vh_ok).alias("otsu_ok"))


def classify_water(px: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Adds ``water`` and ``rescued`` (0/1, NULL without VV). Thresholds hold one row per image."""
    dark = F.col("vv") < F.col("t_vv")
    rescued = F.coalesce((F.col("vh") < F.col("t_vh")) & (F.col("vv") < F.col("t_vv") + C.RESCUE_MARGIN_DB) & ~dark, F.lit(False))
    seen = F.col("vv").isNotNull()
    return px.join(thresholds, "img").withColumns({
        "rescued": F.when(seen, rescued.cast("int")), "water": F.when(seen, (dark | rescued).cast("int"))})


def zonal_stats(px: DataFrame, pixel_m: float = C.PIXEL_M) -> DataFrame:
    valid = F.count("mask")
    water = K.sum_if(F.col("mask") == 1)
    return px.groupBy("img").agg(
        (valid / F.count(F.lit(1))).alias("coverage"), (water / F.greatest(valid, F.lit(1))).alias("water_fraction"),
        (water * (pixel_m ** 2) / 1e6).alias("water_area_km2"),
        (K.sum_if(F.col("rescued") == 1) / F.greatest(valid, F.lit(1))).alias("rescued_fraction"))


# --- optical scenes ------------------------------------------------------------------------------------------------
def scene_masks(px: DataFrame) -> DataFrame:
    """MNDWI, NDVI, validity by class, open water and active channel; needs green, red, nir, swir, scl."""
    mndwi = K.normalised_difference(F.col("green"), F.col("swir"))
    ndvi = K.normalised_difference(F.col("nir"), F.col("red"))
    p = px.withColumns({"mndwi": mndwi, "ndvi": ndvi})
    valid = F.col("mndwi").isNotNull() & F.col("ndvi").isNotNull() & ~F.col("scl").isin(*C.SCENE_BAD_CLASSES)
    water = F.col("mndwi") > 0
    return p.withColumns({"valid": valid, "water": F.when(valid, water.cast("int")),
                          "channel": F.when(valid, (water | (F.col("ndvi") < C.BARE_NDVI)).cast("int"))})


def iou(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """IoU over the pixels valid in both and their share. Inputs: (by..., row, col, mask)."""
    keys = [*by, "row", "col"]
    j = a.select(*keys, F.col("mask").alias("_a")).join(b.select(*keys, F.col("mask").alias("_b")), keys)
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    x, y = F.col("_a") == 1, F.col("_b") == 1
    return j.groupBy(*by).agg(
        (K.sum_if(both & x & y) / F.greatest(K.sum_if(both & (x | y)), F.lit(1))).alias("iou"),
        (K.sum_if(both) / F.count(F.lit(1))).alias("valid_share"))


# --- resampling ----------------------------------------------------------------------------------------------------
def coarsen(px: DataFrame, factor: int, value: str) -> DataFrame:
    f = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    return px.groupBy("img", f("row"), f("col")).agg(F.avg(value).alias(value))


def stride(px: DataFrame, factor: int) -> DataFrame:
    return px.where((F.col("row") % factor == 0) & (F.col("col") % factor == 0))


def sample_bilinear(points: DataFrame, px: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Bilinear value at fractional (r, c); NULL if a needed neighbour is missing. points: (keys..., img, r, c)."""
    r0, c0 = F.floor("r"), F.floor("c")
    fr, fc = F.col("r") - r0, F.col("c") - c0
    corner = lambda dr, dc: F.struct((r0 + dr).cast("int").alias("row"), (c0 + dc).cast("int").alias("col"),
                                     ((fr if dr else 1 - fr) * (fc if dc else 1 - fc)).alias("w"))
    four = F.filter(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)]), lambda s: s["w"] > 0)
    wide = points.select(*keys, "img", F.inline(four))
    hit = wide.join(px.select("img", "row", "col", F.col(value).alias("_v")), ["img", "row", "col"], "left")
    return hit.groupBy(*keys).agg(F.when(F.count("_v") == F.count(F.lit(1)), F.sum(F.col("w") * F.col("_v"))).alias(value))


def mosaic(slices: DataFrame, value: str, order: str = "slice_no") -> DataFrame:
    """First non-null value per pixel in slice order."""
    return slices.groupBy("img", "row", "col").agg(
        F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias(value))


def preview(px: DataFrame, value: str) -> DataFrame:
    """8-bit stretch with alpha."""
    x = F.least(F.greatest((F.col(value) + 25.0) / 25.0, F.lit(0.0)), F.lit(1.0))
    return px.withColumns({"grey": F.floor(F.pow(x, F.lit(0.9)) * 255).cast("int"),
                           "alpha": F.when(F.col(value).isNull(), 0).otherwise(255)})


# --- belt and edges ------------------------------------------------------------------------------------------------
def on_line(x: Column, y: Column, line: Sequence[tuple[float, float]], half_width: float) -> Column:
    """Inside the flat-capped buffer of a short fixed polyline."""
    hit = None
    for i, ((ax, ay), (bx, by)) in enumerate(zip(line[:-1], line[1:])):
        dx, dy = bx - ax, by - ay
        t = ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)
        lo = t >= 0 if i == 0 else F.lit(True)
        hi = t <= 1 if i == len(line) - 2 else F.lit(True)
        s = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        near = (x - ax - s * dx) ** 2 + (y - ay - s * dy) ** 2 <= half_width ** 2
        part = lo & hi & near
        hit = part if hit is None else hit | part
    return hit


def burn_line(px: DataFrame, mask: str, line: Sequence[tuple[float, float]], half_width: float = C.LINE_BUFFER_M,
              pixel_m: float = C.PIXEL_M, out: str = "burned") -> DataFrame:
    """Water along the line, except on no data. Line coordinates: x right, y down from the image corner, metres."""
    x, y = (F.col("col") + 0.5) * pixel_m, (F.col("row") + 0.5) * pixel_m
    return px.withColumn(out, F.when(F.col(mask).isNotNull(), F.when(on_line(x, y, line, half_width), 1).otherwise(F.col(mask))))


def line_parts(lines: DataFrame, by: Sequence[str] = ("img", "line"), part: int = LINE_PART) -> DataFrame:
    """Segments (by.., ax, ay, bx, by_, first, last) of the lines (by.., seq, x, y), flagged at the ends of their line.

    Vertices without coordinates are left out, repeated ones count once, and a line of one point has no segment. Vertices
    look for the next one inside a part of ``part`` sequence numbers; only the first vertices of the parts meet along a line.
    """
    cut = [*by, "_part"]
    v = lines.where("x IS NOT NULL AND y IS NOT NULL").select(*by, "seq", "x", "y", F.floor(F.col("seq") / part).alias("_part"))
    vertex = F.struct("x", "y")
    heads = v.groupBy(*cut).agg(F.min_by(vertex, "seq").alias("_head"))
    heads = heads.select(*cut, F.lead("_head").over(Window.partitionBy(*by).orderBy("_part")).alias("_head"))
    nxt = F.coalesce(F.lead(vertex).over(Window.partitionBy(*cut).orderBy("seq")), "_head")
    s = v.join(heads, cut).withColumn("_next", nxt).where((F.col("_next.x") != F.col("x")) | (F.col("_next.y") != F.col("y")))
    ends = s.groupBy(*by).agg(F.min("seq").alias("_s0"), F.max("seq").alias("_s1"))
    return s.join(ends, list(by)).select(
        *by, F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("_next.x").alias("bx"), F.col("_next.y").alias("by_"),
        (F.col("seq") == F.col("_s0")).alias("first"), (F.col("seq") == F.col("_s1")).alias("last"))


def spread_parts(parts: DataFrame, half_width: float, cell_m: float) -> DataFrame:
    """(img, _tr, _tc, parts): the segments whose buffer can reach a cell, as one array per cell.

    A segment is cut into the bands of cell rows it passes, and in each band it takes the columns it crosses there, so a
    long slanting segment meets the cells along it and not those of its bounding box.
    """
    cell = lambda x: F.floor(x / cell_m)
    low, high = F.least("ay", "by_"), F.greatest("ay", "by_")
    p = parts.withColumn("_tr", F.explode(F.sequence(cell(low - half_width), cell(high + half_width))))
    rise = F.nullif(F.col("by_") - F.col("ay"), F.lit(0.0))
    inside = lambda y: F.least(F.greatest(F.coalesce((y - F.col("ay")) / rise, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    # where the segment enters and leaves the band, widened by the buffer; a level segment is taken whole
    t0, t1 = inside(F.col("_tr") * cell_m - half_width), inside((F.col("_tr") + 1) * cell_m + half_width)
    level = rise.isNull()
    x = lambda t: F.col("ax") + t * (F.col("bx") - F.col("ax"))
    x0, x1 = F.when(level, F.col("ax")).otherwise(x(t0)), F.when(level, F.col("bx")).otherwise(x(t1))
    p = p.withColumn("_tc", F.explode(F.sequence(cell(F.least(x0, x1) - half_width), cell(F.greatest(x0, x1) + half_width))))
    return p.groupBy("img", "_tr", "_tc").agg(F.collect_list(F.struct("ax", "ay", "bx", "by_", "first", "last")).alias("_parts"))


def burn_lines(px: DataFrame, mask: str, lines: DataFrame, half_width: float = C.LINE_BUFFER_M, pixel_m: float = C.PIXEL_M,
               out: str = "burned", tile: int = LINE_CELL) -> DataFrame:
    """Water along all lines of an image, except on no data. lines: (img, line, seq, x, y) as in ``burn_line``.

    Buffers are flat at the ends of a line and round at its inner vertices. Line parts are spread to the cells of ``tile``
    pixels they reach; a pixel tests the parts of its own cell. Images without lines stay as they are.
    """
    cells = spread_parts(line_parts(lines), half_width, tile * pixel_m)
    x, y = (F.col("col") + 0.5) * pixel_m, (F.col("row") + 0.5) * pixel_m

    def near(s: Column) -> Column:
        dx, dy = s["bx"] - s["ax"], s["by_"] - s["ay"]
        t = ((x - s["ax"]) * dx + (y - s["ay"]) * dy) / (dx * dx + dy * dy)
        u = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        ex, ey = x - s["ax"] - u * dx, y - s["ay"] - u * dy
        return (ex * ex + ey * ey <= half_width * half_width) & (~s["first"] | (t >= 0)) & (~s["last"] | (t <= 1))

    p = px.withColumns({"_tr": F.floor(F.col("row") / tile), "_tc": F.floor(F.col("col") / tile)}).join(cells, ["img", "_tr", "_tc"], "left")
    hit = F.coalesce(F.exists("_parts", near), F.lit(False))
    return p.withColumn(out, F.when(F.col(mask).isNotNull(), F.when(hit, 1).otherwise(F.col(mask)))).select(*px.columns, out)


def reference_share(px: DataFrame, min_share: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    """Pixels that are belt on enough of the passes that saw them. px: (keys.., img, row, col, belt, valid); ``keys`` name
    a reach, whose grid is its own."""
    g = px.groupBy(*keys, "row", "col").agg(K.sum_if(F.col("belt") == 1).alias("n_belt"), K.sum_if(F.col("valid") == 1).alias("n_seen"))
    keep = (F.col("n_belt") >= F.greatest(F.lit(1.0), min_share * F.col("n_seen"))) & (F.col("n_seen") > 0)
    return g.withColumn("belt", keep.cast("int"))


def row_edges(px: DataFrame, mask: str) -> DataFrame:
    """Western- and easternmost belt column per row, NULL where there is none."""
    c = F.when(F.col(mask) == 1, F.col("col"))
    return px.groupBy("img", "row").agg(F.min(c).alias("west"), F.max(c).alias("east"))


def smooth_edge(edges: DataFrame, by: Sequence[str], value: str, sigma: float, trim: int, keep_every: int,
                stretch: int = SMOOTH_STRETCH) -> DataFrame:
    """Gaussian along the rows that have an edge (cut at 4 sigma, end values repeated), trimmed and thinned.

    The edge is cut into stretches that overlap by the radius of the kernel; each is one array, so a row travels two or
    three times at most, whatever the width of the kernel.
    """
    radius = int(4 * sigma + 0.5)
    stretch = max(stretch, 4 * radius)
    w = Window.partitionBy(*by).orderBy("row")   # one edge of one image: bounded by its height
    e = edges.where(F.col(value).isNotNull()).select(*by, "row", F.col(value).cast("double").alias(value),
                                                     (F.row_number().over(w) - 1).alias("_i"))
    n = e.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    place = lambda o: F.floor((F.col("_i") + o) / stretch)
    e = e.join(n, list(by)).withColumn("_s", F.explode(F.array_distinct(F.array(place(-radius), place(radius)))))
    schema = e.select(*by, "row", value).schema
    offsets = np.arange(-radius, radius + 1)
    kernel = np.exp(-(offsets * offsets) / (2.0 * sigma * sigma))
    kernel /= kernel.sum()
    names = [*by, "row"]

    def smooth(tab: pa.Table) -> pa.Table:
        tab = tab.sort_by("_i")
        i, last = tab["_i"].to_numpy(), tab["_n"][0].as_py() - 1
        keep = (i // stretch == tab["_s"][0].as_py()) & (i >= trim) & (i <= last - trim) & ((i - trim) % keep_every == 0)
        # beyond the ends of the edge its end values go on; inside, a stretch holds all that its kept rows need
        v = np.pad(tab[value].to_numpy(), radius, mode="edge")
        at = np.flatnonzero(keep)
        windows = np.lib.stride_tricks.sliding_window_view(v, 2 * radius + 1)
        out = np.array([windows[k] @ kernel for k in at])
        return tab.select(names).take(pa.array(at)).append_column(value, pa.array(out, pa.float64()))

    return e.groupBy(*by, "_s").applyInArrow(smooth, schema)
