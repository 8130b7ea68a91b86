"""Grid, polyline and transect queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from scarp.functions.columns import fixed
from scarp.operators import linear as G
from scarp.operators import panel as P
from scarp.operators.features import curvature
from scarp.plans import q_raster  # noqa: F401  (raster fragments)
from scarp.plans.catalogue import register
from scarp.plans.fixtures import Inputs
from scarp.plans.sqltext import day, fragment, r6


def with_ends(t):
    return t.withColumns({"xs": F.col("x0") - 1500.0 * F.col("nx"), "ys": F.col("y0") - 1500.0 * F.col("ny"),
                          "xe": F.col("x0") + 4000.0 * F.col("nx"), "ye": F.col("y0") + 4000.0 * F.col("ny")})


fragment("z_ends", "SELECT *, x0 - 1500 * nx AS xs, y0 - 1500 * ny AS ys, x0 + 4000 * nx AS xe, y0 + 4000 * ny AS ye FROM z_transects")


def boxes(i: Inputs):
    return i.transects().groupBy("bank").agg(*[f(c).alias(n) for f, c, n in (
        (F.min, "x0", "xmin"), (F.min, "y0", "ymin"), (F.max, "x0", "xmax"), (F.max, "y0", "ymax"))])


fragment("z_box", """
SELECT *, ((x1 - x0) / 10)::INT AS width, ((y1 - y0) / 10)::INT AS height FROM (
  SELECT bank, floor(min(x0) / 10) * 10 AS x0, ceil(max(x0) / 10) * 10 AS x1, floor(min(y0) / 10) * 10 AS y0, ceil(max(y0) / 10) * 10 AS y1 FROM z_transects GROUP BY bank)""")


@register("grid_snap_box", "SELECT bank, x0, x1, y0, y1, width, height FROM z_box")
def _(i):
    return G.snap_box(boxes(i)).select("bank", "x0", "x1", "y0", "y1", "width", "height")


def _points(i: Inputs):
    t = i.transects().select("transect_id", "bank", "x0", "y0", "nx", "ny")
    p = i.panel().join(t, "transect_id").select("transect_id", "date", "bank", (F.col("x0") + F.col("bank_pos_m") * F.col("nx")).alias("x"),
                                                (F.col("y0") + F.col("bank_pos_m") * F.col("ny")).alias("y"))
    return p.join(G.snap_box(boxes(i)).select("bank", F.col("x0").alias("gx"), F.col("y1").alias("gy"), "width", "height"), "bank")


@register("grid_cell_of", f"""
SELECT transect_id, {day('date')} AS date, round(r, 6) + 0.0::DOUBLE AS frac_row, round(c, 6) + 0.0::DOUBLE AS frac_col, least(greatest(round_even(r, 0), 0), height - 1)::INT AS row,
  least(greatest(round_even(c, 0), 0), width - 1)::INT AS col
FROM (SELECT p.transect_id, p.date, b.width, b.height, (b.y1 - (t.y0 + p.bank_pos_m * t.ny)) / 10 - 0.5::DOUBLE AS r, (t.x0 + p.bank_pos_m * t.nx - b.x0) / 10 - 0.5::DOUBLE AS c
  FROM z_panel p JOIN z_transects t USING (transect_id) JOIN z_box b ON b.bank = t.bank)""")
def _(i):
    r, c = G.cell_of(F.col("x"), F.col("y"), F.col("gx"), F.col("gy"))
    return _points(i).withColumns({"frac_row": r, "frac_col": c}).select(
        "transect_id", "date", "frac_row", "frac_col", G.clipped_cell(F.col("frac_row"), F.col("height")).alias("row"),
        G.clipped_cell(F.col("frac_col"), F.col("width")).alias("col"))


def vertices(i: Inputs):
    k = F.col("k")
    return i.suppliers().select("bank", k.alias("seq"), ((k % 3) * 300.0).alias("x"), (k * -500.0).alias("y"))


def measured(i: Inputs):
    return G.line_measure(vertices(i))


fragment("z_measure", """
SELECT *, sum(step) OVER (PARTITION BY bank ORDER BY seq) AS m FROM (
  SELECT bank, k AS seq, x, y, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS step
  FROM (SELECT bank, k, (k % 3) * 300.0::DOUBLE AS x, k * -500.0::DOUBLE AS y FROM z_sup) WINDOW w AS (PARTITION BY bank ORDER BY k))""")
fragment("z_seg", """
SELECT *, mb = max(mb) OVER (PARTITION BY bank) AS is_last FROM (SELECT bank, x AS xa, y AS ya, m AS ma, lead(x) OVER w AS xb, lead(y) OVER w AS yb, lead(m) OVER w AS mb
FROM z_measure WINDOW w AS (PARTITION BY bank ORDER BY seq)) WHERE mb > ma""")


@register("line_measure", f"SELECT bank, seq, x, y, {r6('m')} FROM z_measure")
def _(i):
    return measured(i).select("bank", "seq", "x", "y", "m")


_ON = "s.bank = t.bank AND t.d >= s.ma AND (t.d < s.mb OR (s.is_last AND t.d <= s.mb))"


@register("line_interpolate", f"""
WITH t AS (SELECT bank, n.range * 137.0::DOUBLE AS d FROM (SELECT bank, max(m) AS l FROM z_measure GROUP BY bank) q, unnest(range(0, floor(q.l / 137)::BIGINT + 1)) n(range))
SELECT t.bank, t.d, round(xa + (d - ma) / (mb - ma) * (xb - xa), 6) + 0.0::DOUBLE AS x, round(ya + (d - ma) / (mb - ma) * (yb - ya), 6) + 0.0::DOUBLE AS y FROM t JOIN z_seg s ON {_ON}""")
def _(i):
    m = measured(i)
    t = m.groupBy("bank").agg(F.max("m").alias("l")).select("bank", F.explode(F.transform(
        F.sequence(F.lit(0), F.floor(F.col("l") / 137).cast("int")), lambda n: n * 137.0)).alias("d"))
    return G.line_interpolate(t, G.line_segments(m))


fragment("z_cast0", f"""
SELECT t.bank, t.i, t.ch, t.role, xa + (d - ma) / (mb - ma) * (xb - xa) AS x, ya + (d - ma) / (mb - ma) * (yb - ya) AS y FROM (
  SELECT bank, i, ch, r.role, CASE r.role WHEN 'p' THEN ch WHEN 'a' THEN greatest(ch - 100, 0) ELSE least(ch + 100, l) END AS d FROM (
    SELECT bank, l, n.range AS i, least(n.range * 200 + 100, l) AS ch FROM (SELECT bank, max(m) AS l FROM z_measure GROUP BY bank), unnest(range(0, floor(l / 200)::BIGINT + 1)) n(range)),
    (VALUES ('p'), ('a'), ('b')) r(role)) t JOIN z_seg s ON {_ON}""")
fragment("z_cast", """
SELECT bank || '-' || lpad(round_even(ch, 0)::BIGINT::VARCHAR, greatest(5, length(round_even(ch, 0)::BIGINT::VARCHAR))::INT, '0') AS transect_id, *,
  x0 - 1500 * nx AS xs, y0 - 1500 * ny AS ys, x0 + 4000 * nx AS xe, y0 + 4000 * ny AS ye FROM (
  SELECT bank, ch AS chainage_m, x0, y0, (CASE bank WHEN 'W' THEN 1 ELSE -1 END) * ty / sqrt(tx * tx + ty * ty) AS nx, (CASE bank WHEN 'W' THEN -1 ELSE 1 END) * tx / sqrt(tx * tx + ty * ty) AS ny, ch FROM (
    SELECT bank, ch, max(x) FILTER (role = 'p') AS x0, max(y) FILTER (role = 'p') AS y0, max(x) FILTER (role = 'b') - max(x) FILTER (role = 'a') AS tx, max(y) FILTER (role = 'b') - max(y) FILTER (role = 'a') AS ty
    FROM z_cast0 GROUP BY bank, i, ch))""")


@register("cast_transects", f"SELECT transect_id, bank, {r6('chainage_m', 'x0', 'y0', 'nx', 'ny', 'xs', 'ys', 'xe', 'ye')} FROM z_cast")
def _(i):
    return G.cast_transects(measured(i))


@register("transect_inside", "SELECT transect_id FROM z_cast WHERE xs BETWEEN -1400 AND 4200 AND xe BETWEEN -1400 AND 4200 AND ys BETWEEN -40000 AND 0 AND ye BETWEEN -40000 AND 0")
def _(i):
    return G.inside_box(G.cast_transects(measured(i)), -1400.0, -40000.0, 4200.0, 0.0).select("transect_id")


@register("near_feature_flag", """
WITH d AS (SELECT t.transect_id, min((x0 - xa - f * (xb - xa)) ** 2 + (y0 - ya - f * (yb - ya)) ** 2) AS d2 FROM (
  SELECT t.*, s.*, least(greatest(((x0 - xa) * (xb - xa) + (y0 - ya) * (yb - ya)) / ((xb - xa) ** 2 + (yb - ya) ** 2), 0), 1) AS f
  FROM z_transects t, (SELECT xa, ya, xb, yb FROM z_seg WHERE bank = 'W') s) t GROUP BY 1)
SELECT transect_id, (d2 < 250 * 250)::INT AS near_bridge FROM d""")
def _(i):
    w = G.line_segments(measured(i)).where("bank = 'W'")
    return G.near_feature(i.transects(), w, "transect_id", 250.0).select("transect_id", "near_bridge")


def samples(i: Inputs):
    px = i.raster()
    width, height = (px.agg(F.max(c) + 1).scalar() for c in ("col", "row"))
    return G.transect_samples(i.transects(), -320.0, 0.0, width, height)


fragment("z_samples", """
SELECT transect_id, j.range::INT AS sample, j.range * 10.0::DOUBLE - 1500 AS s_m,
  least(greatest(round_even((0 - (y0 + (j.range * 10.0::DOUBLE - 1500) * ny)) / 10 - 0.5::DOUBLE, 0), 0), (SELECT max(row) FROM z_raster))::INT AS row,
  least(greatest(round_even((x0 + (j.range * 10.0::DOUBLE - 1500) * nx + 320) / 10 - 0.5::DOUBLE, 0), 0), (SELECT max(col) FROM z_raster))::INT AS col FROM z_transects, range(551) j""")


@register("transect_samples", "SELECT * FROM z_samples")
def _(i):
    return samples(i)


@register("sample_raster", "SELECT transect_id, sample, img, vv FROM z_samples JOIN z_raster USING (row, col)")
def _(i):
    return G.sample_raster(samples(i), i.raster(), ["vv"]).select("transect_id", "sample", "img", "vv")


def bank_points(i: Inputs):
    """Completed panel with the bank point of every (segment, date)."""
    grid = P.complete_panel(P.first_per_pass(i.panel(), ["bank_pos_m"]), i.calendar(), ["bank_pos_m"])
    ends = with_ends(i.transects()).select("transect_id", "bank", "chainage_m", "xs", "ys", "xe", "ye")
    return G.position_to_point(grid.join(ends, "transect_id"))


fragment("z_points", """
SELECT g.transect_id, g.date, t.bank, t.chainage_m, xs + (g.bank_pos_m + 1500) / 5500 * (xe - xs) AS px, ys + (g.bank_pos_m + 1500) / 5500 * (ye - ys) AS py
FROM z_grid g JOIN z_ends t USING (transect_id)""")


@register("position_to_point", f"SELECT transect_id, {day('date')} AS date, {r6('px', 'py')} FROM z_points")
def _(i):
    return bank_points(i).select("transect_id", F.date_from_unix_date("day").alias("date"), "px", "py")


@register("break_lines_on_gaps", f"""
WITH r AS (SELECT *, sum((px IS NULL)::INT) OVER (PARTITION BY bank, date ORDER BY chainage_m, transect_id) AS run FROM z_points)
SELECT bank, {day('date')} AS date, arg_min(transect_id, chainage_m) AS first_id, count(*)::INT AS n_points,
  string_agg(format('{{:.2f}} {{:.2f}}', px, py), ';' ORDER BY chainage_m) AS points FROM r WHERE px IS NOT NULL GROUP BY bank, date, run""")
def _(i):
    text = F.array_join(F.transform("points", lambda p: F.concat(fixed(p["x"], 2), F.lit(" "), fixed(p["y"], 2))), ";")
    return G.broken_lines(bank_points(i), ["bank", "day"]).select(
        "bank", F.date_from_unix_date("day").alias("date"), "first_id", "n_points", text.alias("points"))


@register("segment_midpoints", f"""
SELECT transect_id, {day('date')} AS date, {r6('x_prev', 'y_prev', 'px', 'py', 'x_next', 'y_next')} FROM (
  SELECT *, coalesce((lag(px) OVER w + px) / 2, px) AS x_prev, coalesce((lag(py) OVER w + py) / 2, py) AS y_prev, coalesce((lead(px) OVER w + px) / 2, px) AS x_next,
    coalesce((lead(py) OVER w + py) / 2, py) AS y_next FROM z_points WINDOW w AS (PARTITION BY bank, date ORDER BY chainage_m, transect_id)) WHERE px IS NOT NULL""")
def _(i):
    return G.segment_midpoints(bank_points(i), ["bank", "day"]).select(
        "transect_id", F.date_from_unix_date("day").alias("date"), "x_prev", "y_prev", "px", "py", "x_next", "y_next")


_C6 = lambda x, y: f"'[' || (round({x}, 6))::VARCHAR || ',' || (round({y}, 6))::VARCHAR || ']'"


@register("reach_geojson", """
WITH p AS (
  SELECT 'transect' AS kind, transect_id AS id, unnest([1, 2]) AS i, unnest([xs, xe]) AS x, unnest([ys, ye]) AS y FROM z_ends
  UNION ALL SELECT 'baseline', bank, row_number() OVER (PARTITION BY bank ORDER BY seq), x, y FROM z_measure
  UNION ALL SELECT 'reach', bank, unnest([1, 2, 3, 4, 5]), unnest([min(x0), max(x0), max(x0), min(x0), min(x0)]), unnest([min(y0), min(y0), max(y0), max(y0), min(y0)]) FROM z_transects GROUP BY bank)
SELECT kind, id, count(*) AS n, round(sum(i * round(x, 6)), 3) + 0.0::DOUBLE AS xs, round(sum(i * round(y, 6)), 3) + 0.0::DOUBLE AS ys,
  round(arg_min(x, i), 6) + 0.0::DOUBLE AS first_x, round(arg_min(y, i), 6) + 0.0::DOUBLE AS first_y,
  round(arg_max(x, i), 6) + 0.0::DOUBLE AS last_x, round(arg_max(y, i), 6) + 0.0::DOUBLE AS last_y FROM p GROUP BY kind, id""")
def _(i):
    reaches = boxes(i).withColumn("name", F.col("bank"))
    g = G.geojson_features(reaches, measured(i), with_ends(i.transects()))

    def points(depth: int):
        kind = f"type string, geometry struct<type: string, coordinates: {'array<' * depth}double{'>' * depth}>"
        return F.from_json("feature", kind)["geometry"]["coordinates"]

    g = g.withColumn("c", F.when(F.col("kind") == "reach", points(3)[0]).otherwise(points(2)))
    total = lambda k: F.round(F.aggregate(F.transform("c", lambda v, n: v[k] * (n + 1)), F.lit(0.0), lambda a, x: a + x), 3)
    first, last = F.get("c", F.lit(0)), F.get("c", F.size("c") - 1)
    return g.select("kind", "id", F.size("c").cast("bigint").alias("n"), total(0).alias("xs"), total(1).alias("ys"),
                    first[0].alias("first_x"), first[1].alias("first_y"), last[0].alias("last_x"), last[1].alias("last_y"))


@register("curvature", f"SELECT transect_id, {r6('baseline_curvature')} FROM z_curv")
def _(i):
    return curvature(i.transects()).select("transect_id", "baseline_curvature")
