"""Image queries on the pixel tables derived from the embeddings."""
from __future__ import annotations

from pyspark.sql import functions as F

from scarp import config as C
from scarp.functions import columns as K
from scarp.operators import components as CC
from scarp.operators import masks as M
from scarp.operators import raster as R
from scarp.plans.catalogue import register
from scarp.plans.fixtures import Inputs
from scarp.plans.sqltext import fragment, r6

fragment("z_bands", """
SELECT CASE WHEN vec_id < half THEN 'VV' ELSE 'VH' END AS band, (vec_id % half)::INT AS row, (j - 1)::INT AS col, embedding[j]::DOUBLE AS value,
  CASE WHEN ((vec_id % half) * 64 + j - 1) % 97 <> 0 THEN round(-15 + 20 * embedding[j]::DOUBLE, 3) END AS db
FROM (SELECT *, (SELECT count(*) // 2 FROM embeddings) AS half, unnest(range(1, len(embedding) + 1)) AS j FROM embeddings)""")
fragment("z_raster", """
SELECT 'R0' AS img, row, col, max(db) FILTER (band = 'VV') AS vv, max(db) FILTER (band = 'VH') AS vh FROM z_bands GROUP BY row, col""")
fragment("z_masks", "SELECT band AS img, row, col, CASE WHEN db IS NOT NULL THEN (value > 0)::INT END AS mask FROM z_bands")
fragment("z_lin", "SELECT img, row, col, pow(10, vv / 10) AS v FROM z_raster")


def _lut(i: Inputs):
    near = F.abs(F.col("value")) * 1000.0 + 300.0
    return i.bands().where("band = 'VV' AND row % 16 = 0 AND col % 16 = 0").select(
        F.lit("R0").alias("img"), "row", "col", near.alias("a"))


@register("px_calibrate", """
WITH dn AS (SELECT row, col, round(abs(value) * 1000 - 5) AS dn FROM z_bands WHERE band = 'VV'),
lut AS (SELECT row, col, abs(value) * 1000 + 300 AS a FROM z_bands WHERE band = 'VV' AND row % 16 = 0 AND col % 16 = 0),
m AS (SELECT max(row) AS mr, max(col) AS mc FROM lut),
p AS (SELECT dn.*, least(row, mr) / 16.0::DOUBLE AS r, least(col, mc) / 16.0::DOUBLE AS c, mr // 16 - 1 AS lr, mc // 16 - 1 AS lc FROM dn, m),
q AS (SELECT *, least(floor(r), lr)::INT AS cr, least(floor(c), lc)::INT AS cc FROM p)
SELECT q.row, q.col, CASE WHEN dn > 0 THEN round(dn * dn / ((1 - (r - cr)) * ((1 - (c - cc)) * a.a + (c - cc) * b.a) + (r - cr) * ((1 - (c - cc)) * d.a + (c - cc) * e.a)) ** 2, 6) END AS sigma0
FROM q JOIN lut a ON a.row = cr * 16 AND a.col = cc * 16 JOIN lut b ON b.row = cr * 16 AND b.col = cc * 16 + 16
JOIN lut d ON d.row = cr * 16 + 16 AND d.col = cc * 16 JOIN lut e ON e.row = cr * 16 + 16 AND e.col = cc * 16 + 16""")
def _(i):
    dn = i.bands().where("band = 'VV'").select(F.lit("R0").alias("img"), "row", "col", F.round(F.abs("value") * 1000 - 5).alias("dn"))
    return R.calibrate(dn, _lut(i), 16).select("row", "col", "sigma0")


@register("px_to_db", "SELECT img, row, col, CASE WHEN (vv + 14) > 0 THEN round(10 * log10(vv + 14), 6) + 0.0::DOUBLE END AS db FROM z_raster")
def _(i):
    return i.raster().select("img", "row", "col", K.to_db(F.col("vv") + 14).alias("db"))


@register("px_quantise", "SELECT img, row, col, CASE WHEN vv IS NULL THEN 255 ELSE round_even((least(greatest(vv, -30), 5) + 30) / 35 * 254, 0)::INT END AS q FROM z_raster")
def _(i):
    return i.raster().select("img", "row", "col", K.quantise(F.col("vv")).alias("q"))


@register("px_dequantise", "SELECT img, row, col, CASE WHEN vv IS NOT NULL THEN round(round_even((least(greatest(vv, -30), 5) + 30) / 35 * 254, 0) / 254 * 35 - 30, 6) END AS db FROM z_raster")
def _(i):
    return i.raster().select("img", "row", "col", K.dequantise(K.quantise(F.col("vv"))).alias("db"))


@register("px_focal_lee", """
WITH s AS (SELECT a.row, a.col, any_value(a.v) AS v, avg(b.v) AS m, greatest(avg(b.v * b.v) - avg(b.v) ** 2, 0) AS var
  FROM z_lin a JOIN z_lin b ON b.row BETWEEN a.row - 2 AND a.row + 2 AND b.col BETWEEN a.col - 2 AND a.col + 2 GROUP BY a.row, a.col)
SELECT row, col, round(m + CASE WHEN var > 0 THEN greatest((var - m * m / 4.4::DOUBLE) / (1 + 1 / 4.4::DOUBLE), 0) / var ELSE 0 END * (v - m), 6) AS filtered FROM s""")
def _(i):
    px = i.raster().select("img", "row", "col", K.from_db(F.col("vv")).alias("v"))
    return R.lee_filter(px, "v").select("row", "col", "filtered")


@register("px_focal_mean", """
SELECT a.row, a.col, round(10 * log10(avg(b.v)), 6) + 0.0::DOUBLE AS smoothed FROM z_lin a
JOIN z_lin b ON b.row BETWEEN a.row - 2 AND a.row + 2 AND b.col BETWEEN a.col - 2 AND a.col + 2 GROUP BY a.row, a.col""")
def _(i):
    return R.boxcar_db(i.raster(), "vv").select("row", "col", "smoothed")


def _otsu_sql(v: str, lo: float, hi: float, sample: int) -> str:
    return f"""
SELECT CASE WHEN (SELECT count(*) FROM u{v}) >= 1000 THEN (SELECT c FROM b{v} ORDER BY bss DESC, bin LIMIT 1) END AS t_{v}
""", f"""u{v} AS (SELECT {v} AS v FROM z_raster WHERE row % {sample} = 0 AND col % {sample} = 0 AND {v} > {lo} AND {v} < {hi}),
h{v} AS (SELECT bin, n, v0 + (bin + 0.5::DOUBLE) * (v1 - v0) / 256 AS c FROM (SELECT least(floor((v - v0) / ((v1 - v0) / 256)), 255) AS bin, v0, v1, count(*) AS n
  FROM u{v}, (SELECT min(v) AS v0, max(v) AS v1 FROM u{v}) GROUP BY ALL)),
b{v} AS (SELECT *, n1 * n2 * (s1 / n1 - s2 / n2) ** 2 AS bss FROM (SELECT bin, c, sum(n) OVER w::DOUBLE AS n1, sum(n * c) OVER w AS s1,
  (SELECT sum(n) FROM h{v}) - sum(n) OVER w::DOUBLE AS n2, (SELECT sum(n * c) FROM h{v}) - sum(n * c) OVER w AS s2 FROM h{v}
  WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE n2 > 0)"""


_VV, _VVC = _otsu_sql("vv", -30, 0, 1)
_VH, _VHC = _otsu_sql("vh", -35, -5, 1)
_V4, _V4C = _otsu_sql("vv", -30, 0, 4)
_TH = (f"{_VVC}, {_VHC}, tt AS (SELECT ({_VV}) AS o_vv, ({_VH}) AS o_vh), th AS (SELECT CASE WHEN o_vv BETWEEN -22 AND -11 THEN o_vv ELSE -15 END AS t_vv, "
       "CASE WHEN o_vh BETWEEN -28 AND -16 THEN o_vh ELSE -21 END AS t_vh, (o_vv BETWEEN -22 AND -11 AND o_vh BETWEEN -28 AND -16)::INT AS otsu_ok FROM tt)")


@register("px_otsu", f"WITH {_VVC}, {_VHC} SELECT 'R0' AS img, round(({_VV}), 6) AS t_vv, round(({_VH}), 6) AS t_vh")
def _(i):
    return thresholds(i)


@register("px_otsu_sampled", f"WITH {_V4C} SELECT 'R0' AS img, round(({_V4}), 6) AS threshold")
def _(i):
    return R.otsu(i.raster(), "vv", *C.VV_SEARCH, sample=4)


def thresholds(i: Inputs):
    px = i.raster()
    return R.otsu(px, "vv", *C.VV_SEARCH, sample=1, out="t_vv").join(
        R.otsu(px, "vh", *C.VH_SEARCH, sample=1, out="t_vh"), "img")


@register("px_otsu_hist", """
WITH h AS (SELECT floor(vv / 0.1::DOUBLE) AS bin, count(*) AS n, avg(vv) AS mean FROM z_raster WHERE vv IS NOT NULL GROUP BY 1),
t AS (SELECT sum(n) AS nt, sum(n * mean) AS st FROM h),
c AS (SELECT bin, mean, sum(n) OVER w::DOUBLE AS na, sum(n * mean) OVER w AS sa, nt, st FROM h, t WINDOW w AS (ORDER BY bin))
SELECT 'R0' AS img, round(mean, 6) AS threshold FROM c WHERE na < nt ORDER BY na * (sa / na - st / nt) ** 2 + (nt - na) * ((st - sa) / (nt - na) - st / nt) ** 2 DESC, bin DESC LIMIT 1""")
def _(i):
    h = i.raster().where("vv IS NOT NULL").groupBy("img", F.floor(F.col("vv") / 0.1).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("vv").alias("mean"))
    return R.otsu_from_histogram(h)


@register("px_threshold_fallback", f"WITH {_TH} SELECT 'R0' AS img, round(t_vv, 6) AS t_vv, round(t_vh, 6) AS t_vh, otsu_ok FROM th")
def _(i):
    return R.plausible_thresholds(thresholds(i))


def classified(i: Inputs):
    return R.classify_water(i.raster(), R.plausible_thresholds(thresholds(i)))


_CLS = """cls AS (SELECT row, col, vv, CASE WHEN vv IS NOT NULL THEN (vv < t_vv)::INT END AS dark,
  CASE WHEN vv IS NOT NULL THEN coalesce(vh < t_vh AND vv < t_vv + 3 AND NOT vv < t_vv, false)::INT END AS rescued FROM z_raster, th)"""


@register("px_classify_water", f"WITH {_TH}, {_CLS} SELECT row, col, rescued, CASE WHEN vv IS NOT NULL THEN greatest(dark, rescued) END AS water FROM cls", doubles=('rescued', 'water'))
def _(i):
    return classified(i).select("row", "col", "rescued", "water")


_NEI = """FROM z_masks a JOIN z_masks b ON b.img = a.img AND b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY a.img, a.row, a.col"""
fragment("z_eroded", f"SELECT a.img, a.row, a.col, (count(*) FILTER (b.mask = 1) = 9)::INT AS eroded {_NEI}")


@register("px_erode", "SELECT * FROM z_eroded")
def _(i):
    return R.erode(i.masks(), "mask").select("img", "row", "col", "eroded")


@register("px_dilate", f"SELECT a.img, a.row, a.col, (count(*) FILTER (b.mask = 1) > 0)::INT AS dilated {_NEI}")
def _(i):
    return R.dilate(i.masks(), "mask").select("img", "row", "col", "dilated")


@register("px_open", """
SELECT a.img, a.row, a.col, (count(*) FILTER (b.eroded = 1) > 0)::INT AS opened FROM z_eroded a
JOIN z_eroded b ON b.img = a.img AND b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY a.img, a.row, a.col""")
def _(i):
    return R.opening(i.masks(), "mask").select("img", "row", "col", "opened")


def flood(name: str, where: str) -> str:
    """Component labels (smallest pixel number): runs per row hand smaller numbers to runs they touch in the next rows."""
    return f"""
{name}_g AS MATERIALIZED (SELECT img, row, col, col - row_number() OVER (PARTITION BY img, row ORDER BY col) AS g FROM {where}),
{name}_s AS MATERIALIZED (SELECT img, row, g, min(col) AS c0, max(col) AS c1, row * 100000 + min(col) AS id FROM {name}_g GROUP BY img, row, g),
{name}_e AS MATERIALIZED (SELECT a.img, a.id AS src, b.id FROM {name}_s a JOIN (SELECT *, unnest([row - 1, row + 1]) AS near FROM {name}_s) b
  ON b.img = a.img AND b.near = a.row AND a.c0 <= b.c1 AND b.c0 <= a.c1),
{name}_r AS (SELECT img, id, id AS label FROM {name}_s UNION
  SELECT e.img, e.id, r.label FROM {name}_r r JOIN {name}_e e ON e.img = r.img AND e.src = r.id AND r.label < e.id),
{name} AS MATERIALIZED (SELECT g.img, g.row * 100000 + g.col AS id, label FROM {name}_g g JOIN {name}_s s ON s.img = g.img AND s.row = g.row AND s.g = g.g
  JOIN (SELECT img, id, min(label) AS label FROM {name}_r GROUP BY img, id) m ON m.img = s.img AND m.id = s.id)"""


@register("px_components", f"""
WITH RECURSIVE {flood('lab', "z_masks WHERE mask = 1")}
SELECT img, (id // 100000)::INT AS row, (id % 100000)::INT AS col, count(*) OVER (PARTITION BY img, label) AS size,
  label // 100000 AS label_row, label % 100000 AS label_col FROM lab""")
def _(i):
    runs = CC.label_components(i.masks().where("mask = 1"), tile=64)
    px = CC.run_pixels(runs).join(CC.component_sizes(runs), ["img", "label"])
    return px.select("img", "row", "col", "size", F.floor(F.col("label") / CC.SPAN).cast("int").alias("label_row"),
                     (F.col("label") % CC.SPAN).cast("int").alias("label_col"))


@register("px_large_components", f"""
WITH RECURSIVE {flood('lab', "z_masks WHERE mask = 1")},
k AS (SELECT img, id, count(*) OVER (PARTITION BY img, label) AS size FROM lab)
SELECT m.img, m.row, m.col, coalesce((k.size >= 20)::INT, 0) AS large FROM z_masks m LEFT JOIN k ON k.img = m.img AND k.id = m.row * 100000 + m.col""")
def _(i):
    return CC.large_components(i.masks(), "mask", 20).select("img", "row", "col", "large")


def bridged(name: str, src: str, col: str, least: int, wide: int = 1) -> str:
    """CTE ``name`` (img, row, col, large): components of at least ``least`` own pixels, joined over gaps of ``wide``."""
    return f"""
{name}_d AS (SELECT DISTINCT a.img, a.row, a.col FROM {src} a JOIN {src} b ON b.img = a.img AND b.{col} = 1
  AND b.row BETWEEN a.row - {wide} AND a.row + {wide} AND b.col BETWEEN a.col - {wide} AND a.col + {wide}
  AND (a.row - b.row) ** 2 + (a.col - b.col) ** 2 <= {wide * wide}),
{flood(name + '_l', name + '_d')},
{name} AS (SELECT m.img, m.row, m.col, coalesce((m.{col} = 1 AND sum((m.{col} = 1)::INT) OVER (PARTITION BY m.img, l.label) >= {least})::INT, 0) AS large
  FROM {src} m LEFT JOIN {name}_l l ON l.img = m.img AND l.id = m.row * 100000 + m.col)"""


def filled(name: str, src: str, col: str) -> str:
    """CTE ``name`` (img, row, col, filled): background that reaches neither side is filled."""
    return f"""
{flood(name + '_l', f"{src} WHERE coalesce({col}, 0) <> 1")},
{name}_o AS (SELECT l.img, label FROM {name}_l l JOIN (SELECT img, min(col) AS c0, max(col) AS c1 FROM {src} GROUP BY img) w ON w.img = l.img
  GROUP BY l.img, label, c0, c1 HAVING min(id % 100000) > c0 AND max(id % 100000) < c1),
{name} AS (SELECT m.img, m.row, m.col, (coalesce({col}, 0) = 1 OR o.label IS NOT NULL)::INT AS filled FROM {src} m
  LEFT JOIN {name}_l l ON l.img = m.img AND l.id = m.row * 100000 + m.col LEFT JOIN {name}_o o ON o.img = l.img AND o.label = l.label)"""


def large(name: str, src: str, col: str, least: int) -> str:
    return f"""
{flood(name + '_l', f"{src} WHERE {col} = 1")},
{name} AS (SELECT m.img, m.row, m.col, coalesce((k.size >= {least})::INT, 0) AS large FROM {src} m
  LEFT JOIN (SELECT img, id, count(*) OVER (PARTITION BY img, label) AS size FROM {name}_l) k ON k.img = m.img AND k.id = m.row * 100000 + m.col)"""


@register("px_bridged_components", f"WITH RECURSIVE {bridged('br', 'z_masks', 'mask', 40)} SELECT img, row, col, large FROM br")
def _(i):
    return CC.large_components(i.masks(), "mask", 40, bridge_px=1).select("img", "row", "col", "large")


@register("px_sieve", f"""
WITH RECURSIVE {flood('wl', "z_masks WHERE mask = 1")},
w AS (SELECT m.*, coalesce(k.size > 10, false) AS w FROM z_masks m LEFT JOIN (SELECT img, id, count(*) OVER (PARTITION BY img, label) AS size FROM wl) k ON k.img = m.img AND k.id = m.row * 100000 + m.col),
{flood('ll', "w WHERE mask IS NOT NULL AND NOT w")},
lk AS (SELECT img, id, count(*) OVER (PARTITION BY img, label) AS size FROM ll)
SELECT w.img, w.row, w.col, CASE WHEN mask IS NOT NULL THEN 1 - coalesce((lk.size > 10)::INT, 0) END AS sieved FROM w LEFT JOIN lk ON lk.img = w.img AND lk.id = w.row * 100000 + w.col""", doubles=('sieved',))
def _(i):
    return CC.sieve(i.masks(), "mask", 10).select("img", "row", "col", "sieved")


@register("px_fill_holes", f"""
WITH RECURSIVE {flood('bl', "z_masks WHERE coalesce(mask, 0) <> 1")},
o AS (SELECT img, label FROM bl GROUP BY img, label HAVING min(id % 100000) > 0 AND max(id % 100000) < 63)
SELECT m.img, m.row, m.col, (coalesce(mask, 0) = 1 OR o.label IS NOT NULL)::INT AS filled FROM z_masks m
LEFT JOIN bl ON bl.img = m.img AND bl.id = m.row * 100000 + m.col LEFT JOIN o ON o.img = bl.img AND o.label = bl.label""")
def _(i):
    return CC.fill_holes(i.masks(), "mask").select("img", "row", "col", "filled")


def sieved(name: str, src: str, col: str, most: int) -> str:
    """CTE ``name`` (img, row, col, sieved): water blobs, then land specks of at most ``most`` pixels change sides."""
    size = "SELECT img, id, count(*) OVER (PARTITION BY img, label) AS size FROM"
    return f"""
{flood(name + '_a', f"{src} WHERE {col} = 1")},
{name}_w AS MATERIALIZED (SELECT m.img, m.row, m.col, m.{col} AS m, coalesce(k.size > {most}, false) AS w FROM {src} m
  LEFT JOIN ({size} {name}_a) k ON k.img = m.img AND k.id = m.row * 100000 + m.col),
{flood(name + '_b', f"{name}_w WHERE m IS NOT NULL AND NOT w")},
{name} AS MATERIALIZED (SELECT w.img, w.row, w.col, CASE WHEN m IS NOT NULL THEN 1 - coalesce((k.size > {most})::INT, 0) END AS sieved FROM {name}_w w
  LEFT JOIN ({size} {name}_b) k ON k.img = w.img AND k.id = w.row * 100000 + w.col)"""


_NEAR9 = "b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY a.row, a.col"
_PASS = f"""{_TH}, {_CLS},
er AS (SELECT a.row, a.col, (count(*) FILTER (greatest(b.dark, b.rescued) = 1) = 9)::INT AS e FROM cls a JOIN cls b ON {_NEAR9}),
wo AS MATERIALIZED (SELECT 'R0' AS img, a.row, a.col, CASE WHEN any_value(c.vv) IS NOT NULL THEN (count(*) FILTER (b.e = 1) > 0)::INT END AS water
  FROM er a JOIN cls c ON c.row = a.row AND c.col = a.col JOIN er b ON {_NEAR9}),
{sieved('sv', 'wo', 'water', 12)}"""


def pass_masks(i: Inputs):
    """Masks of the two-band image, with an Otsu sample and speck size that fit it."""
    return M.pass_masks(i.raster(), speck_px=12, sample=1)


@register("px_pass_mask", f"WITH RECURSIVE {_PASS} SELECT img, row, col, sieved AS mask FROM sv", doubles=('mask',))
def _(i):
    return pass_masks(i).pixels.select("img", "row", "col", "mask")


@register("px_pass_info", f"""
WITH RECURSIVE {_PASS}
SELECT 'R0' AS img, round(count(sieved) / count(*)::DOUBLE, 6) AS coverage, round(count(*) FILTER (sieved = 1) / greatest(count(sieved), 1)::DOUBLE, 6) AS water_fraction,
  round(count(*) FILTER (sieved = 1) * 100 / 1e6, 6) AS water_area_km2, round(count(*) FILTER (rescued = 1) / greatest(count(sieved), 1)::DOUBLE, 6) AS rescued_fraction,
  any_value(round(t_vv, 6)) AS t_vv, any_value(round(t_vh, 6)) AS t_vh, any_value(otsu_ok) AS otsu_ok
FROM sv JOIN cls ON cls.row = sv.row AND cls.col = sv.col, th""")
def _(i):
    return pass_masks(i).info


@register("px_distance", """
SELECT a.img, a.row, a.col, round(sqrt(min((a.row - b.row) ** 2 + (a.col - b.col) ** 2)), 6) AS dist FROM z_masks a
LEFT JOIN z_masks b ON b.img = a.img AND b.mask IS NULL AND b.row BETWEEN a.row - 7 AND a.row + 7 AND b.col BETWEEN a.col - 7 AND a.col + 7
  AND (a.row - b.row) ** 2 + (a.col - b.col) ** 2 <= 49 GROUP BY a.img, a.row, a.col""")
def _(i):
    return R.distance_within(i.masks(), F.col("mask").isNull(), 7).select("img", "row", "col", "dist")


LINE = [(100.0, 300.0), (300.0, 320.0), (560.0, 250.0)]


fragment("z_burned", """
WITH p AS (SELECT *, (col + 0.5::DOUBLE) * 10 AS x, (row + 0.5::DOUBLE) * 10 AS y FROM z_masks),
t AS (SELECT *, ((x - 100) * 200 + (y - 300) * 20) / 40400 AS t1, ((x - 300) * 260 + (y - 320) * -70) / 72500 AS t2 FROM p)
SELECT img, row, col, CASE WHEN mask IS NULL THEN NULL WHEN (t1 >= 0 AND (x - 100 - least(greatest(t1, 0), 1) * 200) ** 2 + (y - 300 - least(greatest(t1, 0), 1) * 20) ** 2 <= 3600)
  OR (t2 <= 1 AND (x - 300 - least(greatest(t2, 0), 1) * 260) ** 2 + (y - 320 + least(greatest(t2, 0), 1) * 70) ** 2 <= 3600) THEN 1 ELSE mask END AS burned FROM t""")


@register("px_burn_line", "SELECT img, row, col, burned FROM z_burned", doubles=('burned',))
def _(i):
    return R.burn_line(i.masks(), "mask", LINE, 60.0).select("img", "row", "col", "burned")


def lines(i: Inputs):
    """One line per image, a vertex every 40 rows, its place from the image's first column."""
    return i.bands().where("col = 0 AND row % 40 = 0").select(
        F.col("band").alias("img"), F.lit(1).alias("line"), F.col("row").alias("seq"), (F.col("value") * 250.0 + 320.0).alias("x"),
        (F.col("row") * 10.0 + 5.0).alias("y"))


fragment("z_line", """
SELECT *, row_number() OVER (PARTITION BY img ORDER BY ay) = 1 AS f, row_number() OVER (PARTITION BY img ORDER BY ay DESC) = 1 AS l FROM (
  SELECT img, ax, ay, bx, ay + 400 AS by_ FROM (SELECT band AS img, value * 250 + 320 AS ax, row * 10 + 5::DOUBLE AS ay,
    lead(value) OVER (PARTITION BY band ORDER BY row) * 250 + 320 AS bx FROM z_bands WHERE col = 0 AND row % 40 = 0) WHERE bx IS NOT NULL)""")
fragment("z_lined", """
WITH h AS (SELECT DISTINCT img, row, col FROM (SELECT p.img, p.row, p.col, f, l, bx - ax AS dx, by_ - ay AS dy,
    (col + 0.5::DOUBLE) * 10 - ax AS px, (row + 0.5::DOUBLE) * 10 - ay AS py, (px * dx + py * dy) / (dx * dx + dy * dy) AS t,
    least(greatest(t, 0), 1) AS u FROM z_masks p JOIN z_line s ON s.img = p.img AND (p.row + 0.5::DOUBLE) * 10 BETWEEN ay - 60 AND by_ + 60)
  WHERE (px - u * dx) ** 2 + (py - u * dy) ** 2 <= 3600 AND (t >= 0 OR NOT f) AND (t <= 1 OR NOT l))
SELECT m.img, m.row, m.col, CASE WHEN mask IS NOT NULL THEN CASE WHEN h.img IS NOT NULL THEN 1 ELSE mask END END AS burned
FROM z_masks m LEFT JOIN h ON h.img = m.img AND h.row = m.row AND h.col = m.col""")


@register("px_burn_lines", "SELECT img, row, col, burned FROM z_lined", doubles=('burned',))
def _(i):
    return R.burn_lines(i.masks(), "mask", lines(i), 60.0).select("img", "row", "col", "burned")


def belt(i: Inputs, line=LINE):
    """Braid belt of both masks, with sizes that fit the small images."""
    return CC.braid_belt(i.masks(), "mask", line, min_px=60, bridge_px=1, radius=1, half_width=60.0)


def belt_sql(src: str) -> str:
    """CTEs down to ``la`` (img, row, col, large): the belt of ``src`` (img, row, col, burned)."""
    return f"""
{bridged('br', src, 'burned', 60)},
{filled('fi', 'br', 'large')},
core AS (SELECT a.img, a.row, a.col FROM fi a WHERE filled = 1 AND NOT EXISTS (SELECT 1 FROM fi b WHERE b.img = a.img AND b.filled <> 1
  AND abs(a.row - b.row) + abs(a.col - b.col) <= 1 AND b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1)),
op AS (SELECT a.img, a.row, a.col, (count(b.row) > 0)::INT AS opened FROM fi a LEFT JOIN core b ON b.img = a.img AND b.row BETWEEN a.row - 1 AND a.row + 1
  AND b.col BETWEEN a.col - 1 AND a.col + 1 AND abs(a.row - b.row) + abs(a.col - b.col) <= 1 GROUP BY a.img, a.row, a.col),
{large('la', 'op', 'opened', 60)}"""


@register("px_belt", f"WITH RECURSIVE {belt_sql('z_burned')} SELECT img, row, col, large AS belt FROM la")
def _(i):
    return belt(i).select("img", "row", "col", "belt")


@register("px_belt_lines", f"WITH RECURSIVE {belt_sql('z_lined')} SELECT img, row, col, large AS belt FROM la")
def _(i):
    return belt(i, lines(i)).select("img", "row", "col", "belt")


@register("px_reference_belt", """
SELECT row, col, count(*) FILTER (mask = 1) AS n_belt, count(mask) AS n_seen,
  (count(*) FILTER (mask = 1) >= greatest(1, 0.5::DOUBLE * count(mask)) AND count(mask) > 0)::INT AS belt FROM z_masks GROUP BY row, col""")
def _(i):
    return R.reference_share(i.masks().withColumns({"belt": F.col("mask"), "valid": F.col("mask").isNotNull().cast("int")}))


@register("px_reference_belt_full", f"""
WITH RECURSIVE sh AS (SELECT 'ref' AS img, row, col, (count(*) FILTER (mask = 1) >= greatest(1, 0.5::DOUBLE * count(mask)) AND count(mask) > 0)::INT AS belt
  FROM z_masks GROUP BY row, col),
{filled('fi', 'sh', 'belt')},
{large('la', 'fi', 'filled', 60)}
SELECT row, col, large AS belt FROM la""")
def _(i):
    share = R.reference_share(i.masks().withColumns({"belt": F.col("mask"), "valid": F.col("mask").isNotNull().cast("int")}))
    p = CC.fill_holes(share.withColumn("img", F.lit("ref")), "belt", "_f")
    return CC.large_components(p.drop("belt"), "_f", 60, out="belt").select("row", "col", "belt")


fragment("z_edges", "SELECT img, row, min(col) FILTER (mask = 1) AS west, max(col) FILTER (mask = 1) AS east FROM z_masks GROUP BY img, row")


@register("px_row_edges", "SELECT * FROM z_edges")
def _(i):
    return R.row_edges(i.masks(), "mask")


@register("px_smooth_edge", """
WITH e AS (SELECT img, row, west::DOUBLE AS v, row_number() OVER (PARTITION BY img ORDER BY row) AS i FROM z_edges WHERE west IS NOT NULL),
n AS (SELECT img, max(i) AS n FROM e GROUP BY img),
a AS (SELECT e.img, e.row, o.range AS o, least(greatest(e.i + o.range, 1), n.n) AS j FROM e JOIN n USING (img), range(-12, 13) o WHERE e.i > 5 AND e.i <= n.n - 5 AND (e.i - 6) % 10 = 0)
SELECT a.img, a.row, round(sum(exp(-(o * o) / 18.0::DOUBLE) * e.v) / sum(exp(-(o * o) / 18.0::DOUBLE)), 6) AS west FROM a JOIN e ON e.img = a.img AND e.i = a.j GROUP BY a.img, a.row""")
def _(i):
    return R.smooth_edge(R.row_edges(i.masks(), "mask"), ["img"], "west", 3.0, 5, 10)


def scene(i: Inputs):
    a, b = F.abs("vv"), F.abs("vh")
    return i.raster().select("img", "row", "col", a.alias("green"), b.alias("swir"), (b + 1).alias("red"), (a * 1.1).alias("nir"),
                             ((F.col("row") * 3 + F.col("col")) % 12).alias("scl"))


fragment("z_scene", """
SELECT *, (green - swir) / nullif(green + swir, 0) AS mndwi, (nir - red) / nullif(nir + red, 0) AS ndvi FROM (
  SELECT img, row, col, abs(vv) AS green, abs(vh) AS swir, abs(vh) + 1 AS red, abs(vv) * 1.1::DOUBLE AS nir, (row * 3 + col) % 12 AS scl FROM z_raster)""")


@register("px_index_ratio", f"SELECT row, col, {r6('mndwi', 'ndvi')} FROM z_scene")
def _(i):
    return R.scene_masks(scene(i)).select("row", "col", "mndwi", "ndvi")


@register("px_scene_mask", """
SELECT row, col, v::INT AS valid, CASE WHEN v THEN (mndwi > 0)::INT END AS water, CASE WHEN v THEN (mndwi > 0 OR ndvi < 0.15::DOUBLE)::INT END AS channel
FROM (SELECT *, mndwi IS NOT NULL AND ndvi IS NOT NULL AND scl NOT IN (0, 1, 3, 8, 9, 10) AS v FROM z_scene)""", doubles=('water', 'channel'))
def _(i):
    return R.scene_masks(scene(i)).select("row", "col", "valid", "water", "channel")


@register("px_iou", """
SELECT round(count(*) FILTER (a.mask = 1 AND b.mask = 1) / greatest(count(*) FILTER (a.mask IS NOT NULL AND b.mask IS NOT NULL AND (a.mask = 1 OR b.mask = 1)), 1)::DOUBLE, 6) AS iou,
  round(count(*) FILTER (a.mask IS NOT NULL AND b.mask IS NOT NULL) / count(*)::DOUBLE, 6) AS valid_share
FROM (SELECT * FROM z_masks WHERE img = 'VV') a JOIN (SELECT * FROM z_masks WHERE img = 'VH') b USING (row, col)""")
def _(i):
    m = i.masks()
    return R.iou(m.where("img = 'VV'"), m.where("img = 'VH'"))


@register("px_zonal_stats", f"""
WITH {_TH}, {_CLS}, m AS (SELECT rescued, CASE WHEN vv IS NOT NULL THEN greatest(dark, rescued) END AS mask FROM cls)
SELECT 'R0' AS img, round(count(mask) / count(*)::DOUBLE, 6) AS coverage, round(sum(mask) / count(mask)::DOUBLE, 6) AS water_fraction,
  round(sum(mask) * 100 / 1e6, 6) AS water_area_km2, round(sum(rescued) / count(mask)::DOUBLE, 6) AS rescued_fraction FROM m""")
def _(i):
    return R.zonal_stats(classified(i).withColumn("mask", F.col("water")))


@register("px_coarsen", "SELECT img, (row // 3)::INT AS row, (col // 3)::INT AS col, round(avg(vv), 6) AS vv FROM z_raster GROUP BY ALL")
def _(i):
    return R.coarsen(i.raster(), 3, "vv")


@register("px_stride", "SELECT img, row, col, vv FROM z_raster WHERE row % 3 = 0 AND col % 3 = 0")
def _(i):
    return R.stride(i.raster(), 3).select("img", "row", "col", "vv")


@register("px_regrid_bilinear", """
WITH p AS (SELECT row, col, row * 0.7::DOUBLE + 0.25::DOUBLE AS r, col * 0.7::DOUBLE + 0.5::DOUBLE AS c FROM z_raster),
k AS (SELECT p.row, p.col, floor(r) + d.a AS rr, floor(c) + e.b AS cc, (CASE d.a WHEN 1 THEN r - floor(r) ELSE 1 - (r - floor(r)) END) * (CASE e.b WHEN 1 THEN c - floor(c) ELSE 1 - (c - floor(c)) END) AS w
  FROM p, (VALUES (0), (1)) d(a), (VALUES (0), (1)) e(b))
SELECT k.row, k.col, round(CASE WHEN count(g.vv) = count(*) THEN sum(w * g.vv) END, 6) AS vv FROM k LEFT JOIN z_raster g ON g.row = rr AND g.col = cc WHERE w > 0 GROUP BY k.row, k.col""")
def _(i):
    px = i.raster()
    pts = px.select("img", "row", "col", (F.col("row") * 0.7 + 0.25).alias("r"), (F.col("col") * 0.7 + 0.5).alias("c"))
    pts = pts.select("img", F.col("row").alias("to_row"), F.col("col").alias("to_col"), "r", "c")
    return R.sample_bilinear(pts, px, "vv", ["to_row", "to_col"]).select(F.col("to_row").alias("row"), F.col("to_col").alias("col"), "vv")


@register("px_mosaic", "SELECT row, col, coalesce(max(db) FILTER (band = 'VV' AND (row + col) % 3 > 0), max(db) FILTER (band = 'VH')) AS db FROM z_bands GROUP BY row, col")
def _(i):
    s = i.bands().select(F.lit("R0").alias("img"), "row", "col", F.when(F.col("band") == "VV", 0).otherwise(1).alias("slice_no"),
                         F.when((F.col("band") == "VH") | ((F.col("row") + F.col("col")) % 3 > 0), F.col("db")).alias("db"))
    return R.mosaic(s, "db").select("row", "col", "db")


@register("px_render_stretch", """
SELECT img, row, col, floor(pow(least(greatest((vv + 25) / 25, 0), 1), 0.9::DOUBLE) * 255)::INT AS grey, CASE WHEN vv IS NULL THEN 0 ELSE 255 END AS alpha FROM z_raster""")
def _(i):
    return R.preview(i.raster(), "vv").select("img", "row", "col", "grey", "alpha")
