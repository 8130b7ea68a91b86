"""From the backscatter of many passes to their water masks and the row of figures that goes with each."""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarp import config as C
from scarp.operators import components as CC
from scarp.operators import raster as R
from scarp.session import settle


class PassMasks(NamedTuple):
    pixels: DataFrame   # img, row, col, mask (1 water, 0 land, NULL no data), rescued
    info: DataFrame     # a row per img


def pass_masks(px: DataFrame, speck_px: int = C.SPECK_PX, sample: int = 4, min_pixels: int = C.OTSU_MIN_PIXELS,
               pixel_m: float = C.PIXEL_M, tile: int = CC.TILE) -> PassMasks:
    """Masks of all images of ``px`` (img, row, col, vv, vh in dB, NULL without data) at once.

    Otsu per image and band on every ``sample``-th row and column, fallbacks where it is not plausible, the second band's
    rescue of rough water, 3 x 3 opening, removal of water blobs and land specks of at most ``speck_px`` pixels. An image
    with too few pixels takes the fallbacks; an image without data has coverage 0 and no water. A pixel listed twice must
    not occur. Other columns of ``px`` are not used.
    """
    px = px.select("img", "row", "col", "vv", "vh")
    found = [R.otsu(px, c, *span, sample, min_pixels, out=f"t_{c}") for c, span in (("vv", C.VV_SEARCH), ("vh", C.VH_SEARCH))]
    # an image without a pixel in the search range has no row of its own in either
    every = px.select("img").distinct()
    th = settle(R.plausible_thresholds(every.join(found[0], "img", "left").join(found[1], "img", "left")))
    raw = settle(R.classify_water(px, th).select("img", "row", "col", "water", "rescued"))
    opened = R.opening(raw, "water", "_o").withColumn("_m", F.when(F.col("water").isNotNull(), F.col("_o")))
    mask = CC.sieve(opened.select("img", "row", "col", "rescued", "_m"), "_m", speck_px, "mask", tile)
    mask = settle(mask.select("img", "row", "col", "mask", "rescued"))
    return PassMasks(mask, R.zonal_stats(mask, pixel_m).join(th, "img"))


def mask_summary(info: DataFrame, passes: DataFrame) -> DataFrame:
    """The mask summary by date: figures of ``info`` with the (pass_id, date, platform) of its image."""
    return passes.select(F.col("pass_id").alias("img"), "date", "platform").join(info, "img").withColumnRenamed("img", "pass_id")
