"""SQL fragments for the panel, the features and the labels."""
from scarp.plans.sqltext import fragment

fragment("z_items", """
SELECT *, DATE '1995-01-01' + 12 * b AS date FROM (
  SELECT *, CAST(floor(date_diff('day', DATE '1995-01-01', l_shipdate::DATE) / 12.0) AS INTEGER) AS b FROM lineitem)
WHERE b % 17 NOT IN (5, 6, 7)""")
fragment("z_sup", """
SELECT s_suppkey AS k, CASE WHEN s_nationkey % 2 = 0 THEN 'W' ELSE 'E' END AS bank,
  (200 * s_suppkey + 100)::DOUBLE AS chainage_m,
  CASE WHEN s_nationkey % 2 = 0 THEN 'W' ELSE 'E' END || '-' || lpad((200 * s_suppkey + 100)::VARCHAR,
    greatest(5, length((200 * s_suppkey + 100)::VARCHAR))::INT, '0') AS transect_id
FROM supplier""")
fragment("z_transects", """
SELECT *, 100.0::DOUBLE * cos(0.05::DOUBLE * k) AS x0, -200.0::DOUBLE * k AS y0, cos(turn) AS nx, sin(turn) AS ny
FROM (SELECT *, 0.02::DOUBLE * k + CASE WHEN bank = 'W' THEN pi() ELSE 0 END AS turn FROM z_sup)""")


def _panel(status: str) -> str:
    return f"""
SELECT p.*, s.transect_id FROM (
  SELECT l_suppkey AS k, date, strftime(date, '%Y%m%d') || '_' || {status} AS pass_id,
    sum(l_quantity) AS bank_pos_m, max(l_quantity) * 10 AS dist_main_channel_m, count(*) * 100.0::DOUBLE AS near_channel_width_m,
    avg(CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0 END) AS nearbank_water_frac,
    avg(CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE ELSE 0 END) AS char_shield_frac,
    max(l_tax) * 100 AS bank_height_m, count(*) AS n_items
  FROM z_items GROUP BY ALL) p JOIN z_sup s USING (k)"""


fragment("z_panel", _panel("'P'"))
fragment("z_dup_raw", _panel("l_linestatus"))
fragment("z_dup", """
SELECT * REPLACE (CASE WHEN NOT (pass_id LIKE '%\\_F' ESCAPE '\\' AND n_items % 7 = 1) THEN bank_pos_m END AS bank_pos_m)
FROM z_dup_raw""")
fragment("z_cal", "SELECT DISTINCT date FROM z_panel")


def back(days: int, tol: int) -> str:
    return f"""
SELECT j AS date, i AS date_k FROM (
  SELECT a.date AS j, b.date AS i, row_number() OVER (PARTITION BY a.date
    ORDER BY abs(date_diff('day', b.date, a.date) - {days}), b.date) AS rn, abs(date_diff('day', b.date, a.date) - {days}) AS gap
  FROM z_cal a JOIN z_cal b ON b.date < a.date) WHERE rn = 1 AND gap <= {tol}"""


for _d, _t in ((28, 12), (56, 12), (84, 12), (365, 30), (12, 8), (24, 8)):
    fragment(f"z_back{_d}", back(_d, _t))
fragment("z_target", """
SELECT j AS date, k AS target_date FROM (
  SELECT a.date AS j, b.date AS k, row_number() OVER (PARTITION BY a.date
    ORDER BY abs(date_diff('day', a.date, b.date) - 28), b.date) AS rn, abs(date_diff('day', a.date, b.date) - 28) AS gap
  FROM z_cal a CROSS JOIN z_cal b) WHERE rn = 1 AND gap <= 8 AND k > j""")
fragment("z_prev", """
SELECT date, prev FROM (SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM z_cal)
WHERE date_diff('day', prev, date) <= 30""")
fragment("z_stage", "SELECT date, count(*)::DOUBLE AS stage_km2 FROM z_items GROUP BY date")
fragment("z_grid", """
SELECT t.transect_id, c.date, date_diff('day', DATE '1970-01-01', c.date) AS dn, p.bank_pos_m, p.dist_main_channel_m,
  p.near_channel_width_m, p.char_shield_frac, p.nearbank_water_frac, p.bank_height_m
FROM (SELECT DISTINCT transect_id FROM z_panel) t CROSS JOIN z_cal c LEFT JOIN z_panel p USING (transect_id, date)""")
fragment("z_robust", """
SELECT *, CASE WHEN bank_pos_m IS NOT NULL THEN quantile_cont(bank_pos_m, 0.5::DOUBLE) OVER
    (PARTITION BY transect_id ORDER BY dn RANGE BETWEEN 24 PRECEDING AND CURRENT ROW) END AS b0,
  CASE WHEN count(bank_pos_m) OVER w180 >= 4 THEN quantile_cont(bank_pos_m, 0.25::DOUBLE) OVER w180 END AS perm,
  count(bank_pos_m) OVER (PARTITION BY transect_id ORDER BY dn RANGE BETWEEN 364 PRECEDING AND CURRENT ROW) AS n_obs_365
FROM z_grid WINDOW w180 AS (PARTITION BY transect_id ORDER BY dn RANGE BETWEEN 180 PRECEDING AND CURRENT ROW)""")
fragment("z_stagef", """
SELECT s.date, s.stage_km2, s.stage_km2 - s12.stage_km2 AS stage_change_12d, s.stage_km2 - s24.stage_km2 AS stage_change_24d,
  s.stage_km2 - c.clim AS stage_anom_km2
FROM z_stage s LEFT JOIN z_back12 m12 ON m12.date = s.date LEFT JOIN z_stage s12 ON s12.date = m12.date_k
LEFT JOIN z_back24 m24 ON m24.date = s.date LEFT JOIN z_stage s24 ON s24.date = m24.date_k
LEFT JOIN (SELECT a.date, avg(b.stage_km2) AS clim FROM z_stage a JOIN z_stage b
  ON date_diff('day', b.date, a.date) > 180
  AND least(abs(dayofyear(a.date) - dayofyear(b.date)), 366 - abs(dayofyear(a.date) - dayofyear(b.date))) <= 30
  GROUP BY a.date HAVING count(*) >= 3) c ON c.date = s.date""")
fragment("z_curv_a", """
SELECT *, atan2(ny, nx) AS a, atan2(ny, nx) - lag(atan2(ny, nx)) OVER (PARTITION BY bank ORDER BY chainage_m) AS st FROM z_transects""")
fragment("z_curv_u", """
SELECT *, a + sum(CASE WHEN st IS NULL OR abs(st) < pi() THEN 0 ELSE
   (st - 2 * pi() * floor((st + pi()) / (2 * pi()))) - st END) OVER (PARTITION BY bank ORDER BY chainage_m) AS ang FROM z_curv_a""")
fragment("z_curv", """
SELECT transect_id, bank, chainage_m, (CASE WHEN bank = 'W' THEN 1 ELSE -1 END)
   * (last_value(ang) OVER w - first_value(ang) OVER w) / ((last_value(chainage_m) OVER w - first_value(chainage_m) OVER w) / 1000) AS baseline_curvature
FROM z_curv_u WINDOW w AS (PARTITION BY bank ORDER BY chainage_m ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)""")
fragment("z_feat_base", """
SELECT g.transect_id, g.date, g.b0 AS bank_pos_m, g.bank_pos_m AS raw_bank_pos_m, g.b0 - g28.b0 AS ret_28_m, g.b0 - g56.b0 AS ret_56_m,
  g.b0 - g84.b0 AS ret_84_m, g.perm - g365.perm AS ret_365_m, g.b0 - g.perm AS inundation_m,
  g.bank_pos_m - gp.bank_pos_m AS raw_last_change_m, g.n_obs_365::DOUBLE AS n_obs_365, g.dist_main_channel_m,
  g.dist_main_channel_m - g28.dist_main_channel_m AS d_dist_main_28_m, g.near_channel_width_m, g.char_shield_frac,
  g.nearbank_water_frac, g.bank_height_m, t.bank, t.chainage_m, t.baseline_curvature
FROM z_robust g LEFT JOIN z_curv t USING (transect_id)
LEFT JOIN z_back28 m28 ON m28.date = g.date LEFT JOIN z_robust g28 ON g28.transect_id = g.transect_id AND g28.date = m28.date_k
LEFT JOIN z_back56 m56 ON m56.date = g.date LEFT JOIN z_robust g56 ON g56.transect_id = g.transect_id AND g56.date = m56.date_k
LEFT JOIN z_back84 m84 ON m84.date = g.date LEFT JOIN z_robust g84 ON g84.transect_id = g.transect_id AND g84.date = m84.date_k
LEFT JOIN z_back365 m365 ON m365.date = g.date LEFT JOIN z_robust g365 ON g365.transect_id = g.transect_id AND g365.date = m365.date_k
LEFT JOIN z_prev mp ON mp.date = g.date LEFT JOIN z_robust gp ON gp.transect_id = g.transect_id AND gp.date = mp.prev
WHERE g.b0 IS NOT NULL""")


def nb(col: str, k: int) -> str:
    w = f"(PARTITION BY bank, date ORDER BY chainage_m, transect_id ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)"
    return (f"(coalesce(sum({col}) OVER {w}, 0) - coalesce({col}, 0)) / "
            f"nullif(count({col}) OVER {w} - CASE WHEN {col} IS NULL THEN 0 ELSE 1 END, 0)")


fragment("z_features", f"""
SELECT f.* EXCLUDE (date), f.date AS forecast_date, {nb('ret_84_m', 3)} AS nb_ret_84_m, {nb('ret_365_m', 3)} AS nb_ret_365_m,
  bank_pos_m - {nb('bank_pos_m', 5)} AS embayment_m, s.stage_km2, s.stage_change_12d, s.stage_change_24d, s.stage_anom_km2,
  sin(dayofyear(f.date) * (2 * pi() / 365.25::DOUBLE)) AS doy_sin, cos(dayofyear(f.date) * (2 * pi() / 365.25::DOUBLE)) AS doy_cos,
  year(f.date)::INTEGER AS year
FROM z_feat_base f LEFT JOIN z_stagef s USING (date)""")
fragment("z_lab_win", """
SELECT *, quantile_cont(bank_pos_m, 0.5::DOUBLE) OVER (PARTITION BY transect_id ORDER BY dn RANGE BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS b1w,
  CASE WHEN count(bank_pos_m) OVER w >= 4 THEN quantile_cont(bank_pos_m, 0.25::DOUBLE) OVER w END AS bpw
FROM z_robust WINDOW w AS (PARTITION BY transect_id ORDER BY dn RANGE BETWEEN CURRENT ROW AND 180 FOLLOWING)""")
fragment("z_comp", """
SELECT g.transect_id, g.date, m.target_date, g.b0, k.b1w AS b1, k.bpw AS bp FROM z_robust g JOIN z_target m USING (date)
JOIN z_lab_win k ON k.transect_id = g.transect_id AND k.date = m.target_date WHERE g.bank_pos_m IS NOT NULL""")
fragment("z_labels", """
SELECT transect_id, date AS forecast_date, target_date, least(b1 - b0, bp - b0) AS retreat_m, b1 - b0 AS window_retreat_m,
  bp - b0 AS permanent_retreat_m, CASE WHEN b1 - b0 >= 20 AND bp - b0 >= 20 THEN 1 ELSE 0 END AS y,
  CASE WHEN b1 - b0 >= 50 AND bp - b0 >= 50 THEN 1 ELSE 0 END AS major, year(date)::INTEGER AS year
FROM z_comp WHERE b1 IS NOT NULL AND bp IS NOT NULL""")
fragment("z_model", """
SELECT f.*, l.target_date, l.retreat_m, l.y, l.major FROM z_features f JOIN z_labels l USING (transect_id, forecast_date)""")
fragment("z_scores", """
SELECT *, ret_84_m AS B0_persistence, ret_365_m AS B1_history,
  1 / (1 + exp(-(0.01::DOUBLE * coalesce(ret_84_m, 0) - 0.5::DOUBLE))) AS p FROM z_model""")
