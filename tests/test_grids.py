"""Tiles as arrays: what is written, repeated and unplaced pixels, distances of many rows at once."""
import numpy as np
from pyspark.sql import functions as F

from scarp import session
from scarp.operators import bankpos as B
from scarp.operators import components as CC
from scarp.operators import grids as G
from scarp.operators import raster as R
from tests.test_raster import image, pixels


def river(seed: int = 3, shape=(70, 90)) -> np.ndarray:
    a = (np.random.default_rng(seed).random(shape) < 0.45).astype(int)
    a[:, 30:55] = 1
    a[20:40, 38:44] = 0
    return a


def test_belt_writes_no_row_per_pixel(spark, monkeypatch):
    written, plain = [], CC.settle

    def settle(df):
        done = plain(df)
        written.append(done.count())
        return done

    monkeypatch.setattr(CC, "settle", settle)
    a = river()
    got = CC.braid_belt(pixels(spark, a), "mask", None, 30, 1, 1, tile=32).localCheckpoint()
    assert got.count() == a.size and max(written) < a.size / 4


def test_belt_is_the_same_for_any_tile(spark):
    a = river(5)
    one, many, small = (image(CC.braid_belt(pixels(spark, a), "mask", None, 40, 1, 2, tile=t), "belt", a.shape) for t in (128, 13, 3))
    assert np.array_equal(one, many) and np.array_equal(one, small) and 0 < one.sum() < a.size


def test_pixels_without_a_place_and_repeated_ones(spark):
    a = river(7)
    px = pixels(spark, a)
    want = image(CC.braid_belt(px, "mask", None, 30, 0, 1, tile=32), "belt", a.shape)
    lost = spark.createDataFrame([("i", None, 4, 1), ("i", 4, None, 1), (None, 4, 4, 1)], px.select("img", "row", "col", "mask").schema)
    twice = px.select("img", "row", "col", "mask").unionByName(px.select("img", "row", "col", "mask").where("row < 10")).unionByName(lost)
    got = CC.braid_belt(twice, "mask", None, 30, 0, 1, tile=32)
    assert got.count() == a.size + 10 * a.shape[1] + 3
    placed = got.where("img IS NOT NULL AND row IS NOT NULL AND col IS NOT NULL").distinct()
    assert np.array_equal(image(placed, "belt", a.shape), want)
    assert got.where("img IS NULL OR row IS NULL OR col IS NULL").agg(F.sum("belt")).first()[0] == 0


def test_pack_counts_repeats(spark):
    px = spark.createDataFrame([("i", 300, 5, 1), ("i", 300, 5, 1), ("i", 301, 6, 0), ("i", 301, 6, 0)], "img string, row int, col int, mask int")
    r = G.pack(px, F.col("mask") == 1, 256).first().asDict()
    t = G.tile_of(r)
    assert (t.tr, t.tc, t.r0, t.c0) == (1, 0, 300, 5) and t.extra.tolist() == [0]
    assert t.has(G.MARK).tolist() == [[True, False], [False, False]] and t.has(G.PRESENT).tolist() == [[True, False], [False, True]]


def test_squares_within():
    hit = np.random.default_rng(1).random((9, 40)) < 0.04
    r, c = np.nonzero(hit)
    i, j = np.indices(hit.shape)
    want = ((i[..., None] - r) ** 2 + (j[..., None] - c) ** 2).min(axis=-1)
    for radius in (1, 3, 12):
        got = R.squares_within(hit, radius)
        near = want <= radius ** 2
        assert np.array_equal(got[near], want[near]) and (got[~near] > radius ** 2).all()


def test_rows_of_a_strip_do_not_mix(spark):
    """Rows with far, near and no sources, solved together; a point without a column has no distance."""
    rng = np.random.default_rng(2)
    row, src_row = rng.integers(0, 40, 300), rng.integers(0, 40, 60)
    col, src_col, g = rng.integers(0, 500, 300), rng.integers(0, 500, 60), rng.integers(0, 2000, 60)
    got, none = R.row_squares(row, col, src_row, src_col, g)
    for k in range(300):
        same = src_row == row[k]
        assert none[k] == (not same.any())
        assert none[k] or got[k] == ((col[k] - src_col[same]) ** 2 + g[same] ** 2).min()

    a = np.zeros((50, 60), int)
    a[45, 2] = 1
    points = spark.createDataFrame([(r, "i", r, c) for r in (3, 31, 32, 45) for c in (0, 59, None)], "id int, img string, row int, col int")
    for r in B.distance_to_core(points, pixels(spark, a), "mask", 1.0).collect():
        d = r["dist_main_channel_m"]
        assert d is None if r["col"] is None else abs(d - np.hypot(r["row"] - 45, r["col"] - 2)) < 1e-9


def test_samples_are_not_broadcast(spark, monkeypatch):
    plans, plain = [], session.settle

    def settle(df):
        done = plain(df)
        if "bank_pos_m" in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return done

    monkeypatch.setattr(session, "settle", settle)
    a = river()
    rows = spark.range(a.shape[0]).select(F.col("id").cast("int").alias("row")).distinct()
    at = rows.select(F.col("row").alias("transect_id"), F.explode(F.sequence(F.lit(0), F.lit(a.shape[1] - 1))).alias("sample"), "row")
    got = B.bank_positions(pixels(spark, a), at.withColumn("col", F.col("sample")), 0.0, 10.0, 30, bridge_px=1, radius=1)
    assert got.count() == a.shape[0] and len(plans) == 1 and "BroadcastHashJoin" not in plans[0]
