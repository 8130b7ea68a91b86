"""Column-level helpers shared by the operators. All of them stay inside the JVM."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from scarp import config as C


def to_db(x: Column) -> Column:
    return F.when(x > 0, 10.0 * F.log10(x))


def from_db(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 10.0)


def quantise(db: Column) -> Column:
    """dB to 0..254, half to even; 255 where missing."""
    clipped = F.least(F.greatest(db, F.lit(C.DB_MIN)), F.lit(C.DB_MAX))
    q = F.bround((clipped - C.DB_MIN) / (C.DB_MAX - C.DB_MIN) * float(C.DB_STEPS))
    return F.when(db.isNull(), C.NODATA).otherwise(q).cast("int")


def dequantise(q: Column) -> Column:
    return F.when(q != C.NODATA, q / float(C.DB_STEPS) * (C.DB_MAX - C.DB_MIN) + C.DB_MIN)


def day_angle(date: Column) -> Column:
    return F.dayofyear(date) * F.lit(2 * math.pi / 365.25)


def normalised_difference(a: Column, b: Column) -> Column:
    return (a - b) / F.nullif(a + b, F.lit(0.0))


def sum_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


def fixed(x: Column, digits: int = 0) -> Column:
    """Fixed-point text, half to even, without thousands separators."""
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))


def signed(x: Column, digits: int = 0) -> Column:
    return F.concat(F.when(x >= 0, "+").otherwise(""), fixed(x, digits))


def metres(x: Column) -> Column:
    return F.concat(F.format_number(F.abs(x), 0), F.lit(" m"))


def percent(x: Column, digits: int = 0) -> Column:
    return F.concat(fixed(x * 100.0, digits), F.lit("%"))


def segment_label(transect_id: Column) -> Column:
    parts = F.split(transect_id, "-")
    return F.concat(F.when(parts[0] == "W", "West").otherwise("East"), F.lit(" bank, km "),
                    fixed(parts[1].cast("double") / 1000.0, 1))


def pass_date(pass_id: Column) -> Column:
    return F.concat_ws("-", F.substring(pass_id, 1, 4), F.substring(pass_id, 5, 2), F.substring(pass_id, 7, 2))
