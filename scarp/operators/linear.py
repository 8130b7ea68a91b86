"""Grid arithmetic, linear referencing along polylines and transect geometry."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scarp import config as C

MEASURE_CELL_M = 500.0
LINE_PART = 4096   # sequence numbers in a part of a line


# --- grid ----------------------------------------------------------------------------------------------------------
def snap_box(boxes: DataFrame, pixel_m: float = C.PIXEL_M) -> DataFrame:
    """Snap boxes (xmin, ymin, xmax, ymax) outward to the pixel grid: x0, y1 (top), width, height."""
    low = lambda c: F.floor(F.col(c) / pixel_m) * pixel_m
    high = lambda c: F.ceil(F.col(c) / pixel_m) * pixel_m
    b = boxes.withColumns({"x0": low("xmin").cast("double"), "x1": high("xmax").cast("double"),
                           "y0": low("ymin").cast("double"), "y1": high("ymax").cast("double")})
    return b.withColumns({"width": F.round((F.col("x1") - F.col("x0")) / pixel_m).cast("int"),
                          "height": F.round((F.col("y1") - F.col("y0")) / pixel_m).cast("int")})


def cell_of(x: Column, y: Column, x0: Column, y1: Column, pixel_m: float = C.PIXEL_M) -> tuple[Column, Column]:
    """Fractional (row, col) with pixel centres at whole numbers."""
    return (y1 - y) / pixel_m - 0.5, (x - x0) / pixel_m - 0.5


def centre_of(row: Column, col: Column, x0: Column, y1: Column, pixel_m: float = C.PIXEL_M) -> tuple[Column, Column]:
    return x0 + (col + 0.5) * pixel_m, y1 - (row + 0.5) * pixel_m


def clipped_cell(frac: Column, size: Column) -> Column:
    return F.least(F.greatest(F.bround(frac).cast("int"), F.lit(0)), size - 1)


# --- lines ---------------------------------------------------------------------------------------------------------
def line_measure(vertices: DataFrame, by: Sequence[str] = ("bank",), part: int = LINE_PART) -> DataFrame:
    """Cumulative length m of each vertex, lines turned to run north to south. vertices: (by..., seq, x, y).

    A line is cut into parts of ``part`` sequence numbers. Lengths are summed inside a part; only part totals and the steps
    between parts are summed along the line, so one long line is the work of many tasks. ``seq`` may have gaps.
    """
    cut = [*by, "_part"]
    turn = vertices.groupBy(*by).agg((F.min_by("y", "seq") < F.max_by("y", "seq")).alias("_flip"))
    v = vertices.join(turn, list(by)).withColumn("pos", F.when(F.col("_flip"), -F.col("seq")).otherwise(F.col("seq")))
    v = v.withColumn("_part", F.floor(F.col("pos") / part))
    w = Window.partitionBy(*cut).orderBy("pos")
    step = lambda x, y, x0, y0: F.coalesce(F.sqrt((x - x0) ** 2 + (y - y0) ** 2), F.lit(0.0))
    v = v.withColumn("_step", step(F.col("x"), F.col("y"), F.lag("x").over(w), F.lag("y").over(w)))
    v = v.withColumn("_m", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    p = v.groupBy(*cut).agg(F.max("_m").alias("_len"), *[f(c, "pos").alias(f"{n}{c}") for c in "xy" for n, f in (
        ("a", F.min_by), ("b", F.max_by))])
    along = Window.partitionBy(*by).orderBy("_part")   # a row per part
    p = p.withColumn("_gap", step(F.col("ax"), F.col("ay"), F.lag("bx").over(along), F.lag("by").over(along)))
    start = F.coalesce(F.sum("_len").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + F.sum("_gap").over(
        along.rowsBetween(Window.unboundedPreceding, 0))
    return v.join(p.select(*cut, start.alias("_start")), cut).select(
        *by, "seq", "pos", "x", "y", (F.col("_start") + F.col("_m")).alias("m"))


def line_segments(measured: DataFrame, by: Sequence[str] = ("bank",), part: int = LINE_PART) -> DataFrame:
    """Each vertex with the next one of its line, which for the last vertex of a part is the first of the next part."""
    cut = [*by, "_part"]
    vertex = F.struct("x", "y", "m")
    v = measured.withColumn("_part", F.floor(F.col("pos") / part))
    heads = v.groupBy(*cut).agg(F.min_by(vertex, "pos").alias("_head"))
    heads = heads.select(*cut, F.lead("_head").over(Window.partitionBy(*by).orderBy("_part")).alias("_head"))
    nxt = F.coalesce(F.lead(vertex).over(Window.partitionBy(*cut).orderBy("pos")), "_head")
    return (v.join(heads, cut).withColumn("_next", nxt).where("_next.m > m")
            .select(*by, F.col("x").alias("xa"), F.col("y").alias("ya"), F.col("m").alias("ma"),
                    F.col("_next.x").alias("xb"), F.col("_next.y").alias("yb"), F.col("_next.m").alias("mb")))


def line_interpolate(targets: DataFrame, segments: DataFrame, by: Sequence[str] = ("bank",), d: str = "d",
                     x: str = "x", y: str = "y", cell: float = MEASURE_CELL_M) -> DataFrame:
    """Point at distance ``d`` along the line; the line's end belongs to its last segment.

    Targets and segments meet on (line, measure cell), so a target only sees the few segments of its cell.
    """
    ends = segments.groupBy(*by).agg(F.max("mb").alias("_end"))
    seg = segments.join(ends, list(by)).withColumn("_last", F.col("mb") == F.col("_end"))
    seg = seg.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("ma") / cell), F.floor(F.col("mb") / cell))))
    t = targets.withColumn("_cell", F.floor(F.col(d) / cell))
    on = (F.col(d) >= F.col("ma")) & ((F.col(d) < F.col("mb")) | (F.col("_last") & (F.col(d) <= F.col("mb"))))
    f = (F.col(d) - F.col("ma")) / (F.col("mb") - F.col("ma"))
    j = t.join(seg, [*by, "_cell"]).where(on)
    return j.select(*targets.columns, (F.col("xa") + f * (F.col("xb") - F.col("xa"))).alias(x),
                    (F.col("ya") + f * (F.col("yb") - F.col("ya"))).alias(y))


def cast_transects(measured: DataFrame, by: Sequence[str] = ("bank",), spacing: float = C.SPACING_M,
                   tangent: float = C.TANGENT_M, riverward: float = C.RIVERWARD_M,
                   landward: float = C.LANDWARD_M) -> DataFrame:
    """Transects every ``spacing`` metres with their landward unit normal and end points."""
    segments = line_segments(measured, by)
    length = segments.groupBy(*by).agg(F.max("mb").alias("_len"))
    i = F.explode(F.sequence(F.lit(0), F.floor(F.col("_len") / spacing).cast("int")))
    base = length.withColumn("i", i).withColumn("chainage_m", F.least(F.col("i") * spacing + spacing / 2, F.col("_len")))
    ends = F.explode(F.array(
        F.struct(F.lit("p").alias("role"), F.col("chainage_m").alias("d")),
        F.struct(F.lit("a").alias("role"), F.greatest(F.col("chainage_m") - tangent, F.lit(0.0)).alias("d")),
        F.struct(F.lit("b").alias("role"), F.least(F.col("chainage_m") + tangent, F.col("_len")).alias("d"))))
    asked = base.withColumn("_e", ends).select(*by, "i", "chainage_m", "_e.role", "_e.d")
    pts = line_interpolate(asked, segments, by)
    at = lambda r, c: F.max(F.when(F.col("role") == r, F.col(c))).alias(f"{c}_{r}")
    t = pts.groupBy(*by, "i", "chainage_m").agg(*[at(r, c) for r in "pab" for c in "xy"])
    tx, ty = F.col("x_b") - F.col("x_a"), F.col("y_b") - F.col("y_a")
    side = F.when(F.col("bank") == "W", 1.0).otherwise(-1.0)
    norm = F.sqrt(tx * tx + ty * ty)
    t = t.withColumns({"nx": side * ty / norm, "ny": -side * tx / norm})
    name = F.format_string("%s-%05d", "bank", F.bround("chainage_m").cast("int"))
    return t.select(
        name.alias("transect_id"), *by, "chainage_m", F.col("x_p").alias("x0"), F.col("y_p").alias("y0"), "nx", "ny",
        (F.col("x_p") - riverward * F.col("nx")).alias("xs"), (F.col("y_p") - riverward * F.col("ny")).alias("ys"),
        (F.col("x_p") + landward * F.col("nx")).alias("xe"), (F.col("y_p") + landward * F.col("ny")).alias("ye"))


def inside_box(transects: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    ok = F.lit(True)
    for x, y in (("xs", "ys"), ("xe", "ye")):
        ok = ok & F.col(x).between(xmin, xmax) & F.col(y).between(ymin, ymax)
    return transects.where(ok)


def near_feature(points: DataFrame, segments: DataFrame, key: str, radius: float = C.NEAR_FEATURE_M,
                 out: str = "near_bridge") -> DataFrame:
    """Flag points closer than ``radius`` to any segment (xa, ya, xb, yb).

    Each segment visits the radius-sized cells its own box touches plus one ring; points look into one cell.
    """
    cell = lambda lo, hi: F.sequence(F.floor(lo / radius) - 1, F.floor(hi / radius) + 1)
    s = (segments.select("xa", "ya", "xb", "yb")
         .withColumn("_cx", F.explode(cell(F.least("xa", "xb"), F.greatest("xa", "xb"))))
         .withColumn("_cy", F.explode(cell(F.least("ya", "yb"), F.greatest("ya", "yb")))))
    p = points.select(key, F.col("x0").alias("_x"), F.col("y0").alias("_y")).withColumns(
        {"_cx": F.floor(F.col("_x") / radius), "_cy": F.floor(F.col("_y") / radius)})
    dx, dy = F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya")
    t = ((F.col("_x") - F.col("xa")) * dx + (F.col("_y") - F.col("ya")) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.least(F.greatest(F.coalesce(t, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    d2 = (F.col("_x") - F.col("xa") - t * dx) ** 2 + (F.col("_y") - F.col("ya") - t * dy) ** 2
    hit = p.join(s, ["_cx", "_cy"]).where(d2 < radius * radius).select(key).distinct().withColumn(out, F.lit(1))
    return points.join(hit, key, "left").withColumn(out, F.coalesce(out, F.lit(0)))


# --- transect samples ----------------------------------------------------------------------------------------------
def transect_samples(transects: DataFrame, x0: float, y1: float, width: Column | int, height: Column | int, step: float = C.PIXEL_M,
                     riverward: float = C.RIVERWARD_M, landward: float = C.LANDWARD_M, keys: Sequence[str] = ()) -> DataFrame:
    """Grid cell of every sample point of a grid of ``width`` x ``height`` cells; sample 0 is the riverward end."""
    width, height = (x if isinstance(x, Column) else F.lit(x) for x in (width, height))
    n = int((riverward + landward + step / 2) // step)
    t = transects.select(*keys, "transect_id", "x0", "y0", "nx", "ny", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("sample"))
    s = F.col("sample") * step - riverward
    x, y = F.col("x0") + s * F.col("nx"), F.col("y0") + s * F.col("ny")
    r, c = cell_of(x, y, F.lit(x0), F.lit(y1), step)
    return t.select(*keys, "transect_id", "sample", s.alias("s_m"), clipped_cell(r, height).alias("row"),
                    clipped_cell(c, width).alias("col"))


def sample_raster(samples: DataFrame, px: DataFrame, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Values of each image of the same ``keys`` (a reach) under the samples. Many samples share a pixel, so pixels stay."""
    return samples.join(px.select(*keys, "img", "row", "col", *values), [*keys, "row", "col"])


# --- bank lines ----------------------------------------------------------------------------------------------------
def position_to_point(df: DataFrame, pos: str = "bank_pos_m", riverward: float = C.RIVERWARD_M,
                      landward: float = C.LANDWARD_M) -> DataFrame:
    """Blend of the transect's end points (xs, ys) -> (xe, ye)."""
    f = (F.col(pos) + riverward) / (riverward + landward)
    return df.withColumns({"px": F.col("xs") + f * (F.col("xe") - F.col("xs")),
                           "py": F.col("ys") + f * (F.col("ye") - F.col("ys"))})


def broken_lines(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Polylines along each bank, broken where the position is missing. One bank on one date per window group."""
    w = Window.partitionBy(*by).orderBy("chainage_m", "transect_id")
    gap = F.sum(F.when(F.col("px").isNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = points.withColumn("_run", gap).where("px IS NOT NULL")
    return runs.groupBy(*by, "_run").agg(
        F.array_sort(F.collect_list(F.struct("chainage_m", "transect_id", "px", "py"))).alias("_p")).select(
        *by, F.col("_p")[0]["transect_id"].alias("first_id"), F.size("_p").alias("n_points"),
        F.transform("_p", lambda p: F.struct(p["px"].alias("x"), p["py"].alias("y"))).alias("points"))


def segment_midpoints(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Three points per segment: half-way to the previous bank point, the point, half-way to the next."""
    w = Window.partitionBy(*by).orderBy("chainage_m", "transect_id")
    half = lambda c, f: F.coalesce((f(c).over(w) + F.col(c)) / 2, F.col(c))
    # a neighbour without a position does not count: both its coordinates are NULL
    return points.withColumns({"x_prev": half("px", F.lag), "y_prev": half("py", F.lag),
                               "x_next": half("px", F.lead), "y_next": half("py", F.lead)}).where("px IS NOT NULL")


def geojson_features(reaches: DataFrame, baselines: DataFrame, transects: DataFrame) -> DataFrame:
    """One GeoJSON feature per row: reach polygons, baselines, transects."""
    pt = lambda x, y: F.array(F.round(x, 6), F.round(y, 6))

    def feature(props: Column, kind: str, coordinates: Column) -> Column:
        geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
        return F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), geometry.alias("geometry")))

    c = F.col
    ring = F.array(F.array(pt(c("xmin"), c("ymin")), pt(c("xmax"), c("ymin")), pt(c("xmax"), c("ymax")),
                           pt(c("xmin"), c("ymax")), pt(c("xmin"), c("ymin"))))
    a = reaches.select(F.lit("reach").alias("kind"), c("name").alias("id"), feature(
        F.struct(F.lit("reach").alias("kind"), "name"), "Polygon", ring).alias("feature"))
    line = baselines.groupBy("bank").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))),
                                                     lambda v: pt(v["x"], v["y"])).alias("_c"))
    b = line.select(F.lit("baseline").alias("kind"), c("bank").alias("id"), feature(
        F.struct(F.lit("baseline").alias("kind"), "bank"), "LineString", c("_c")).alias("feature"))
    t = transects.select(F.lit("transect").alias("kind"), c("transect_id").alias("id"), feature(
        F.struct(F.lit("transect").alias("kind"), c("transect_id").alias("id"), "bank",
                 F.bround("chainage_m").cast("int").alias("chainage_m")),
        "LineString", F.array(pt(c("xs"), c("ys")), pt(c("xe"), c("ye")))).alias("feature"))
    return a.unionByName(b).unionByName(t)
