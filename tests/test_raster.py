import numpy as np
import pytest
from pyspark.sql import functions as F

from scarp.functions import columns as K
from scarp.operators import bankpos as B
from scarp.operators import components as CC
from scarp.operators import raster as R


def pixels(spark, a, img="i", name="mask"):
    kind = "int" if a.dtype.kind in "iub" else "double"
    rows = [(img, r, c, None if (kind == "double" and np.isnan(v)) or (kind == "int" and v == 255) else (int(v) if kind == "int" else float(v)))
            for (r, c), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, f"img string, row int, col int, {name} {kind}")


def image(df, col, shape):
    out = np.full(shape, np.nan)
    for r in df.select("row", "col", col).collect():
        if r[2] is not None:
            out[r[0], r[1]] = r[2]
    return out


def label(binary):
    """Plain flood fill, 4 neighbours."""
    lab, n = np.zeros(binary.shape, int), 0
    for s in zip(*np.nonzero(binary)):
        if lab[s]:
            continue
        n += 1
        stack = [s]
        lab[s] = n
        while stack:
            r, c = stack.pop()
            for q in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                if 0 <= q[0] < binary.shape[0] and 0 <= q[1] < binary.shape[1] and binary[q] and not lab[q]:
                    lab[q] = n
                    stack.append(q)
    return lab, n


def distance(target):
    pts = np.argwhere(target)
    out = np.full(target.shape, np.inf)
    if len(pts):
        for i in np.ndindex(target.shape):
            out[i] = np.sqrt(((pts - i) ** 2).sum(1).min())
    return out


def large(binary, min_px, bridge=0):
    lab, n = label(distance(binary) <= bridge if bridge else binary)
    out = np.zeros_like(binary)
    for k in range(1, n + 1):
        own = (lab == k) & binary
        if own.sum() >= min_px:
            out |= own
    return out


def filled(binary):
    lab, n = label(~binary)
    out = binary.copy()
    for k in range(1, n + 1):
        cols = np.nonzero(lab == k)[1]
        if cols.min() > 0 and cols.max() < binary.shape[1] - 1:
            out |= lab == k
    return out


def spiral(n):
    a = np.zeros((n, n), int)
    r, c, dr, dc, steps = 0, 0, 0, 1, n
    a[0, :] = 1
    c = n - 1
    length = n - 1
    dirs = [(1, 0), (0, -1), (-1, 0), (0, 1)]
    k = 0
    while length > 0:
        for _ in range(2 if k else 1):
            dr, dc = dirs[k % 4]
            for _ in range(length):
                r, c = r + dr, c + dc
                a[r, c] = 1
            k += 1
        length -= 2
    return a


def test_quantise_round_trip(spark):
    d = spark.createDataFrame([(-30.0,), (-12.3,), (0.0,), (5.0,), (None,)], "db double")
    r = d.withColumn("q", K.quantise(F.col("db"))).withColumn("x", K.dequantise(F.col("q"))).collect()
    assert all(abs(x["db"] - x["x"]) <= 0.08 for x in r[:4]) and r[4]["q"] == 255 and r[4]["x"] is None


def test_lee_keeps_a_flat_field_across_tiles(spark):
    a = np.full((40, 40), 0.05)
    a[20, 20] = np.nan
    out = image(R.lee_filter(pixels(spark, a, name="v"), "v", tile=16), "filtered", a.shape)
    assert np.isnan(out[20, 20]) and np.nanmax(np.abs(out - 0.05)) < 1e-9


def test_focal_sums_do_not_depend_on_the_tile(spark):
    a = np.random.default_rng(0).integers(0, 2, (37, 29))
    px = pixels(spark, a)
    one = image(R.opening(px, "mask", tile=256), "opened", a.shape)
    many = image(R.opening(px, "mask", tile=8), "opened", a.shape)
    pad = np.pad(a, 1)
    er = np.min([pad[i:i + 37, j:j + 29] for i in range(3) for j in range(3)], axis=0)
    pe = np.pad(er, 1)
    op = np.max([pe[i:i + 37, j:j + 29] for i in range(3) for j in range(3)], axis=0)
    assert (one == many).all() and (one == op).all()


def test_two_class_scene(spark):
    rng = np.random.default_rng(5)
    truth = np.zeros((120, 120), bool)
    truth[:, 40:80] = True
    vv = np.where(truth, -20.0, -9.0) + rng.normal(0, 1.2, truth.shape)
    vh = np.where(truth, -25.0, -15.0) + rng.normal(0, 1.2, truth.shape)
    vv[:5, :5] = np.nan
    px = pixels(spark, vv, name="vv").join(pixels(spark, vh, name="vh"), ["img", "row", "col"])
    th = R.plausible_thresholds(R.otsu(px, "vv", -30, 0, 1, out="t_vv").join(R.otsu(px, "vh", -35, -5, 1, out="t_vh"), "img"))
    t = th.first()
    assert t["otsu_ok"] and -18 < t["t_vv"] < -11
    w = image(CC.sieve(R.classify_water(px, th), "water", 50), "sieved", truth.shape)
    ok = ~np.isnan(w)
    assert np.isnan(w[:5, :5]).all() and (w[ok] == truth[ok]).mean() > 0.97


def test_too_few_pixels_give_no_threshold(spark):
    px = pixels(spark, np.random.default_rng(1).normal(-15, 3, (50, 50)), name="vv")
    assert R.otsu(px, "vv", -30, 0, sample=4).first()["threshold"] is None


def test_threshold_of_one_value_is_that_value(spark):
    px = pixels(spark, np.full((20, 20), -12.5), name="vv")
    assert R.otsu(px, "vv", -30, 0, min_pixels=100).first()["threshold"] == -12.5
    assert R.otsu(px, "vv", -30, 0, min_pixels=1000).first()["threshold"] is None


def test_distance_is_exact_within_the_radius(spark):
    a = (np.random.default_rng(2).random((40, 33)) < 0.03).astype(int)
    got = image(R.distance_within(pixels(spark, a), F.col("mask") == 1, 6, tile=16), "dist", a.shape)
    want = distance(a == 1)
    near = want <= 6
    assert np.allclose(got[near], want[near]) and np.isnan(got[~near]).all()


def test_distance_has_no_bound(spark):
    a = np.zeros((50, 70), int)
    a[3, 2] = a[45, 6] = a[30, 69] = 1
    got = image(R.distance_to(pixels(spark, a), F.col("mask") == 1), "dist", a.shape)
    assert np.allclose(got, distance(a == 1)) and got.max() > 25
    assert np.isnan(image(R.distance_to(pixels(spark, a), F.col("mask") == 5), "dist", a.shape)).all()


@pytest.mark.parametrize("band", [1, 7, 1024])
def test_vertical_distance_does_not_depend_on_the_bands(spark, band):
    a = (np.random.default_rng(6).random((60, 12)) < 0.05).astype(int)
    a[:, 3] = 0
    a[10:45, 4] = 0
    got = image(R.column_distances(pixels(spark, a), F.col("mask") == 1, "g", band), "g", a.shape)
    for c in range(12):
        rows = np.flatnonzero(a[:, c])
        want = [np.abs(rows - r).min() if len(rows) else np.nan for r in range(60)]
        assert np.array_equal(got[:, c], want, equal_nan=True)


def test_nearest_squares_equal_all_pairs():
    rng = np.random.default_rng(8)
    for n, m in ((1, 1), (1, 5), (7, 1), (64, 64), (301, 90), (500, 499)):
        at, src = (np.sort(rng.choice(1200, k, replace=False)).astype(np.int64) for k in (n, m))
        g = rng.integers(0, 400, m) ** 2
        want = ((at[:, None] - src) ** 2 + g).min(axis=1)
        assert (R.nearest_squares(at, src, g) == want).all()


def test_smoothing_does_not_depend_on_the_stretches(spark):
    rng = np.random.default_rng(9)
    rows = [(img, int(r), float(x)) for img, n in (("a", 330), ("b", 60), ("c", 4)) for r, x in zip(
        np.sort(rng.choice(600, n, replace=False)), rng.normal(100, 20, n))]
    e = spark.createDataFrame([*rows, ("a", 700, None)], "img string, row int, west double")
    got = {(r["img"], r["row"]): r["west"] for r in R.smooth_edge(e, ["img"], "west", 3.0, 5, 4, stretch=50).collect()}
    k = np.exp(-np.arange(-12, 13) ** 2 / 18.0)
    want = {}
    for img in "abc":
        v = [r for r in rows if r[0] == img]
        x = np.pad([r[2] for r in v], 12, mode="edge")
        want.update({v[i][:2]: x[i:i + 25] @ k / k.sum() for i in range(5, len(v) - 5, 4)})
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_width_of_a_wide_channel(spark):
    """Banks of a channel of 50 columns: 100 m from the bank the land is 11 pixels away."""
    from scarp.plans import q_bankpos as Q
    a = np.zeros((60, 64), int)
    a[5:55, :50] = 1
    masks = type("Inputs", (), {"masks": lambda self: pixels(spark, a)})()
    got = {r.transect_id: r.near_channel_width_m for r in Q.banks(masks, True).collect()}
    assert got[30] == 220 and got[5] == 20 and got[0] is None


def test_spiral_is_one_component_over_many_tiles(spark):
    a = spiral(41)
    lab, n = label(a == 1)
    runs = CC.label_components(pixels(spark, a).where("mask = 1"), tile=3)
    assert n == 1 and runs.select("label").distinct().count() == 1
    assert runs.agg(F.sum("n")).first()[0] == a.sum()


@pytest.mark.parametrize("tile", [4, 256])
def test_components_match_flood_fill(spark, tile):
    a = (np.random.default_rng(4).random((48, 40)) < 0.58).astype(int)
    lab, n = label(a == 1)
    px = CC.run_pixels(CC.label_components(pixels(spark, a).where("mask = 1"), tile)).collect()
    pairs = {(lab[r["row"], r["col"]], r["label"]) for r in px}
    assert len(px) == a.sum() and len(pairs) == n == len({p[1] for p in pairs})


def test_tile_labels_match_flood_fill():
    rng = np.random.default_rng(12)
    for share in (0.1, 0.55, 0.62, 0.9, 1.0):
        a = rng.random((60, 70)) < share
        lab, n = label(a)
        r, c = np.nonzero(a)
        again = rng.integers(0, len(r), 50)   # repeated pixels
        row, c0, c1 = CC.tile_runs(np.concatenate([r, r[again]]).astype(np.int32), np.concatenate([c, c[again]]).astype(np.int32))
        got = CC.tile_labels(row, c0, c1)
        assert (c1 - c0 + 1).sum() == a.sum()
        assert len({(lab[i, j], k) for i, j, k in zip(row, c0, got)}) == n == len(set(got))


def test_bridged_components_count_own_pixels(spark):
    a = (np.random.default_rng(8).random((40, 36)) < 0.25).astype(int)
    got = image(CC.large_components(pixels(spark, a), "mask", 12, bridge_px=1, tile=7), "large", a.shape)
    assert (got == large(a == 1, 12, 1)).all()


def test_belt_steps_match_plain_arrays(spark):
    a = (np.random.default_rng(9).random((44, 40)) < 0.62).astype(int)
    got = image(CC.braid_belt(pixels(spark, a), "mask", None, 30, 1, 1, tile=11), "belt", a.shape)
    f = filled(large(a == 1, 30, 1))
    eroded = distance(~f) > 1
    want = large(distance(eroded) <= 1, 30)
    assert (got == want).all()


def test_components_without_pixels_or_with_repeats(spark):
    px = pixels(spark, np.ones((5, 9), int))
    assert CC.label_components(px.where("mask = 5")).count() == 0
    twice = CC.label_components(px.unionByName(px), tile=4).agg(F.sum("n"), F.count_distinct("label")).first()
    assert tuple(twice) == (45, 1)


def burned_by_hand(shape, line, half, pixel=10.0):
    """Union of boxes around the parts and discs around inner vertices, pixel by pixel."""
    out = np.zeros(shape, bool)
    pts = [p for i, p in enumerate(line) if i == 0 or p != line[i - 1]]
    for r in range(shape[0]):
        for c in range(shape[1]):
            x, y = (c + 0.5) * pixel, (r + 0.5) * pixel
            for (ax, ay), (bx, by) in zip(pts, pts[1:]):
                n = np.hypot(bx - ax, by - ay)
                along, side = ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / n, ((x - ax) * (by - ay) - (y - ay) * (bx - ax)) / n
                out[r, c] |= 0 <= along <= n and abs(side) <= half
            out[r, c] |= any(np.hypot(x - px, y - py) <= half for px, py in pts[1:-1])
    return out


def test_each_image_burns_its_own_lines(spark):
    a = np.zeros((60, 50), int)
    px = pixels(spark, a, "a").unionByName(pixels(spark, a, "b")).unionByName(pixels(spark, a, "c"))
    px = px.withColumn("mask", F.when((F.col("row") == 30) & (F.col("col") == 25), None).otherwise(F.col("mask")))
    lines = {("a", 1): [(-300.0, 33.0), (253.0, 307.0), (253.0, 307.0), (480.0, 90.0)], ("a", 2): [(20.0, 580.0), (20.0, 500.0)],
             ("b", 1): [(10.0, 7.0), (490.0, 595.0)], ("b", 2): [(5.0, 5.0)]}
    rows = [(img, no, i, x, y) for (img, no), pts in lines.items() for i, (x, y) in enumerate(pts)] + [("b", 1, 7, None, 3.0)]
    table = spark.createDataFrame(rows, "img string, line int, seq int, x double, y double")
    burned = R.burn_lines(px, "mask", table, 41.0, tile=8)
    for img in "abc":
        got = image(burned.where(F.col("img") == img), "burned", a.shape)
        want = np.zeros(a.shape)
        for (i, _), pts in lines.items():
            if i == img:
                want[burned_by_hand(a.shape, pts, 41.0)] = 1
        want[30, 25] = np.nan
        assert np.array_equal(got, want, equal_nan=True)
    assert burned.count() == px.count() and burned.columns == [*px.columns, "burned"]
    none = R.burn_lines(px, "mask", table.where("false"), 41.0)
    assert none.agg(F.sum("burned")).first()[0] == 0


def test_belt_raster(spark):
    """River with a char, a pond outside: the char is filled, the pond dropped, the mainland stays out."""
    a = np.zeros((80, 60), int)
    a[:, 20:44] = 1
    a[30:50, 28:36] = 0
    a[10:12, 2:4] = 1
    got = image(CC.braid_belt(pixels(spark, a), "mask", None, 200, 2, 3, tile=32), "belt", a.shape)
    assert got[40, 32] == 1 and got[11, 3] == 0 and got[40, 5] == 0 and got[0, 30] == 1


def test_first_run_from_land(spark):
    rows = [("i", "a", s, v) for s, v in enumerate([1, 1, 1, 1, 1, 0, 0, 1, 0, 0, 0, 0])] + [("i", "b", s, 0) for s in range(12)]
    got = {r["transect_id"]: r["idx"] for r in B.first_run_from_land(spark.createDataFrame(rows, "img string, transect_id string, sample int, belt int")).collect()}
    assert got == {"a": 4, "b": -1}


def test_position_rules(spark):
    def tr(name, belt, nod=()):
        return [("i", name, s, b, b, int(s in nod)) for s, b in enumerate(belt)]
    river = [1] * 6 + [0] * 6
    rows = tr("ok", river) + tr("end", river[:6] + [0, 0, 0, 1, 1, 1]) + tr("blind", river, nod=(9,)) + tr("far", river, nod=(0,)) + tr("none", [0] * 12)
    s = spark.createDataFrame(rows, "img string, transect_id string, sample int, belt int, water int, nodata int")
    got = {r["transect_id"]: r for r in B.measure_banks(s, -60.0, 10.0, near_m=30, shield_m=50, guard_m=20).collect()}
    assert got["ok"]["bank_pos_m"] == -10.0 and got["ok"]["nearbank_water_frac"] == 1.0 and got["ok"]["char_shield_frac"] == 0.0
    assert got["far"]["valid"] == 1 and not any(got[n]["valid"] for n in ("end", "blind", "none"))


def test_distance_to_core_is_unbounded(spark):
    a = np.zeros((30, 50), int)
    a[3, 2] = 1
    pts = spark.createDataFrame([("i", "p", 28, 45)], "img string, transect_id string, row int, col int")
    d = B.distance_to_core(pts, pixels(spark, a), "mask").first()["dist_main_channel_m"]
    assert abs(d - 10 * np.hypot(25, 43)) < 1e-9
    assert B.distance_to_core(pts, pixels(spark, a), "mask", cap_px=20).first()["dist_main_channel_m"] is None


def test_points_of_one_row_are_solved_together(spark):
    a = (np.random.default_rng(3).random((25, 40)) < 0.02).astype(int)
    rows = [("i", f"p{r}-{c}", r, c) for r in (0, 7, 24) for c in (39, 0, 13, 13)] + [("other", "q", 3, 3), ("i", "out", 99, 3)]
    pts = spark.createDataFrame(rows, "img string, transect_id string, row int, col int")
    got = B.distance_to_core(pts, pixels(spark, a), "mask").collect()
    want = distance(a == 1)
    assert len(got) == len(rows)
    for r in got:
        d = r["dist_main_channel_m"]
        assert d is None if r["img"] == "other" or r["row"] == 99 else abs(d - 10 * want[r["row"], r["col"]]) < 1e-9
