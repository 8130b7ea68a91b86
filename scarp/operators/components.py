"""Connected components (4-neighbour) of pixel tables.

Images are cut into square tiles. A tile is labelled in one array pass; what is left is a small graph between tiles, made
from the pixels on both sides of a border and solved by alternating star contractions with a reliable checkpoint per round.
A wider or higher image adds tiles; no task grows with it. Steps that keep or fill components work on tiles as arrays
(``grids.py``): a tile labels itself, and only components that reach its border take part in the graph.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scarp import config as C
from scarp.operators import grids as G
from scarp.operators import raster as R
from scarp.session import settle

TILE = 256
SPAN = 1 << 24   # node number = row * SPAN + first column


def tile_runs(row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, c0, c1) of the runs of neighbouring pixels of a tile, by row and column; repeated pixels count once."""
    at = np.unique(row.astype(np.int64) * SPAN + col)
    first = np.flatnonzero(np.diff(at, prepend=at[:1] - 2) != 1)
    start, end = at[first], at[np.append(first, len(at))[1:] - 1]
    return start // SPAN, start % SPAN, end % SPAN


def tile_labels(row: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> np.ndarray:
    """Number of the first run of each run's component, by array steps over all touching pairs at once."""
    # runs of the next row that end at or after the start of this one and start at or before its end
    lo = np.searchsorted(row * SPAN + c1, (row + 1) * SPAN + c0, "left")
    hi = np.searchsorted(row * SPAN + c0, (row + 1) * SPAN + c1, "right")
    n = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(row)), n)
    b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    label = np.arange(len(row))
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            above = label[label]
            if (above == label).all():
                break
            label = above
    return label


def label_components(px: DataFrame, tile: int = TILE) -> DataFrame:
    """(img, row, c0, c1, n, label) for the runs of the given pixels; runs end at the border of a tile.

    The label is the smallest ``row * SPAN + col`` of the component. Repeated pixels count once.
    """
    def measure(tab: pa.Table) -> pa.Table:
        row, c0, c1 = tile_runs(tab["row"].to_numpy(), tab["col"].to_numpy())
        node = row * SPAN + c0
        flat = lambda x, t: pa.array(x, t)
        return pa.table({"img": pa.array([tab["img"][0].as_py()] * len(row), pa.string()), "row": flat(row, pa.int32()),
                         "c0": flat(c0, pa.int32()), "c1": flat(c1, pa.int32()), "n": flat(c1 - c0 + 1, pa.int64()),
                         "local": flat(node[tile_labels(row, c0, c1)], pa.int64())})

    at = lambda c: F.floor(F.col(c) / tile)
    runs = settle(px.select("img", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))
                  .groupBy("img", at("row"), at("col")).applyInArrow(measure, "img string, row int, c0 int, c1 int, n long, local long"))
    comps = connected(_touching(runs, tile)).select(F.col("g").alias("img"), F.col("node").alias("local"), F.col("label").alias("_label"))
    return runs.join(comps, ["img", "local"], "left").select(
        "img", "row", "c0", "c1", "n", F.coalesce("_label", "local").alias("label"))


def _touching(runs: DataFrame, tile: int) -> DataFrame:
    """Edges (g, u, v) between the tiles: pixels that face each other across a border meet on their place."""
    def meet(a: DataFrame, b: DataFrame) -> DataFrame:
        keys = ["img", "row", "col"]
        return a.withColumnRenamed("local", "u").join(b.withColumnRenamed("local", "v"), keys).select(F.col("img").alias("g"), "u", "v")

    def row_pixels(d: DataFrame, row: Column) -> DataFrame:
        return d.select("img", row.alias("row"), F.explode(F.sequence("c0", "c1")).alias("col"), "local")

    upper, lower = runs.where(F.pmod("row", F.lit(tile)) == tile - 1), runs.where(F.pmod("row", F.lit(tile)) == 0)
    left, right = runs.where(F.pmod("c1", F.lit(tile)) == tile - 1), runs.where(F.pmod("c0", F.lit(tile)) == 0)
    down = meet(row_pixels(upper, F.col("row") + 1), row_pixels(lower, F.col("row")))
    across = meet(left.select("img", "row", (F.col("c1") + 1).alias("col"), "local"),
                  right.select("img", "row", F.col("c0").alias("col"), "local"))
    return down.unionByName(across).distinct()


def _stars(e: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges (g, u, v) with u > v."""
    sym = e.unionByName(e.select("g", F.col("v").alias("u"), F.col("u").alias("v")))
    low = sym.groupBy("g", "u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    large = sym.join(low, ["g", "u"]).where(F.col("v") > F.col("u")).select("g", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("g", "u").agg(F.min("v").alias("m"))
    moved = large.join(least, ["g", "u"]).where(F.col("v") > F.col("m")).select("g", F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("g", "u", F.col("m").alias("v"))).distinct()


def connected(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(g, node, label): the smallest node of each component of a graph given as (g, u, v)."""
    cur = settle(edges.where("u <> v").select("g", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def mark(d: DataFrame):
        return tuple(d.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("g", "u", "v"))).first())

    seen = mark(cur)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        cur = settle(_stars(cur))
        now = mark(cur)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return cur.select("g", F.col("u").alias("node"), F.col("v").alias("label"))


def run_pixels(runs: DataFrame) -> DataFrame:
    return runs.select("img", "row", F.explode(F.sequence("c0", "c1")).alias("col"), "label")


def component_sizes(runs: DataFrame) -> DataFrame:
    return runs.groupBy("img", "label").agg(F.sum("n").alias("size"))


def _with_flag(px: DataFrame, chosen: DataFrame, out: str) -> DataFrame:
    """Mark the pixels covered by the chosen runs."""
    hit = run_pixels(chosen).select("img", "row", "col", F.lit(1).alias(out))
    return px.join(hit, ["img", "row", "col"], "left").withColumn(out, F.coalesce(out, F.lit(0)))


def _kept(runs: DataFrame, sizes: DataFrame, keep: Column) -> DataFrame:
    return runs.join(sizes.where(keep).select("img", "label"), ["img", "label"], "left_semi")


# --- components of tiles -------------------------------------------------------------------------------------------
class Parts(NamedTuple):
    """The components of a tile and their pixels in row-major order."""
    row: np.ndarray      # of a pixel, in the grid
    col: np.ndarray
    label: np.ndarray    # of a pixel: number of its component
    node: np.ndarray     # of a component: as in ``label_components``
    weight: np.ndarray   # of a component
    faces: list[tuple[int, int, np.ndarray]]   # (axis, side, pixels on that border of the tile)


def tile_parts(t: G.Tile, on: np.ndarray, weight: np.ndarray, tile: int) -> Parts:
    row, col = np.nonzero(on)
    first, c0, c1 = tile_runs(row, col)
    label = np.repeat(tile_labels(first, c0, c1), c1 - c0 + 1)
    node = (first + t.r0) * SPAN + c0 + t.c0
    top, left = row + t.r0 - t.tr * tile, col + t.c0 - t.tc * tile
    faces = [(0, 0, top == tile - 1), (0, 1, top == 0), (1, 0, left == tile - 1), (1, 1, left == 0)]
    return Parts(row, col, label, node, np.bincount(label, weight[row, col], len(first)).astype(np.int64),
                 [(axis, side, np.flatnonzero(x)) for axis, side, x in faces])


def keep_components(tiles: DataFrame, on: Callable[[G.Tile], np.ndarray], weight: Callable[[G.Tile, dict], np.ndarray], keep: Callable,
                    then: Callable[[G.Tile, np.ndarray], np.ndarray], tile: int) -> DataFrame:
    """Tiles with the flags ``then(tile, kept)``, where ``kept`` are the pixels of the components of ``on`` (4-neighbour, of the
    whole image) for which ``keep`` holds of their summed ``weight``; ``keep`` works on arrays and columns.

    Components inside one tile are judged there. Those that reach its border are the nodes of the graph between tiles: pixels
    that face each other across a border meet on their place.
    """
    def listed(**cols: np.ndarray) -> pa.Array:
        values = [pa.array(v, pa.int64() if n in ("node", "n") else pa.int32()) for n, v in cols.items()]
        return pa.ListArray.from_arrays(pa.array([0, len(values[0])], pa.int32()), pa.StructArray.from_arrays(values, list(cols)))

    def count(t: G.Tile, row: dict) -> dict[str, pa.Array]:
        p = tile_parts(t, on(t), weight(t, row), tile)
        reach = np.unique(p.label[np.concatenate([at for _, _, at in p.faces])])
        # the pixel below or to the right of a border pixel is the one it faces
        r, c = (np.concatenate([x[at] + first + (side == 0 and axis == way) for axis, side, at in p.faces])
                for way, x, first in ((0, p.row, t.r0), (1, p.col, t.c0)))
        name = lambda k: np.concatenate([np.full(len(f[2]), f[k]) for f in p.faces])
        node = np.concatenate([p.node[p.label[at]] for _, _, at in p.faces])
        return {"open": listed(node=p.node[reach], n=p.weight[reach]), "faces": listed(axis=name(0), side=name(1), row=r, col=c, node=node)}

    def judge(t: G.Tile, row: dict) -> dict[str, pa.Array]:
        p = tile_parts(t, on(t), weight(t, row), tile)
        ok = np.asarray(keep(p.weight))
        reach = np.unique(p.label[np.concatenate([at for _, _, at in p.faces])])
        ok[reach] = np.isin(p.node[reach], np.array(row["_nodes"] or [], np.int64))
        kept = np.zeros(t.grid.shape, bool)
        kept[p.row, p.col] = ok[p.label]
        return {"grid": G.binary(then(t, kept), np.uint8)}

    more = [c for c in tiles.columns if c not in G.ARROW.names]
    own = ", ".join([G.TILES, *(f"{c} int" for c in more)])
    counted = settle(G.each(tiles, count, f"{own}, open array<struct<node:bigint,n:bigint>>, "
                            "faces array<struct<axis:int,side:int,row:int,col:int,node:bigint>>"))
    f = counted.select("img", F.inline("faces"))
    u, v = (f.where(F.col("side") == k).select("img", "axis", "row", "col", F.col("node").alias(c)) for k, c in enumerate("uv"))
    comps = connected(u.join(v, ["img", "axis", "row", "col"]).select(F.col("img").alias("g"), "u", "v").distinct())
    parts = counted.select(*G.KEYS, F.inline("open")).join(comps.select(F.col("g").alias("img"), "node", "label"), ["img", "node"], "left")
    parts = parts.withColumn("label", F.coalesce("label", "node"))
    large = parts.groupBy("img", "label").agg(F.sum("n").alias("n")).where(keep(F.col("n"))).select("img", "label")
    nodes = parts.join(large, ["img", "label"], "left_semi").groupBy(*G.KEYS).agg(F.collect_list("node").alias("_nodes"))
    return G.each(counted.drop("open", "faces").join(nodes, G.KEYS, "left"), judge)


def large_parts(tiles: DataFrame, min_px: int, bridge_px: int, tile: int) -> DataFrame:
    """Tiles with the marks of components of at least ``min_px`` marked pixels; gaps up to ``bridge_px`` join components first."""
    def probe(wide: np.ndarray) -> np.ndarray:
        present, mark = (wide & G.PRESENT) > 0, (wide & G.MARK) > 0
        return G.flags(present, mark, present & (R.squares_within(mark, bridge_px) <= bridge_px * bridge_px))

    def size(t: G.Tile, row: dict) -> np.ndarray:
        n = t.has(G.MARK).astype(np.int64)
        if bridge_px:
            np.add.at(n.reshape(-1), t.extra, 1)   # where gaps are bridged, a pixel that is listed twice counts twice
        return n

    if bridge_px:
        tiles = G.with_halo(tiles, bridge_px, probe, tile)
    return keep_components(tiles, lambda t: t.has(G.NEAR if bridge_px else G.MARK), size, lambda n: n >= min_px,
                           lambda t, kept: G.flags(t.has(G.PRESENT), kept & t.has(G.MARK)), tile)


def enclosed_parts(tiles: DataFrame, on: Callable[[G.Tile], np.ndarray], then: Callable[[G.Tile, np.ndarray], np.ndarray], tile: int) -> DataFrame:
    """Tiles with the flags ``then(tile, enclosed)``: components of ``on`` that reach neither the left nor the right border of the image."""
    def reach(t: G.Tile, row: dict) -> np.ndarray:
        col = np.arange(t.grid.shape[1]) + t.c0
        return np.broadcast_to(((col == row["_left"]) | (col == row["_right"])).astype(np.int64), t.grid.shape)

    tiles = settle(tiles)
    span = tiles.groupBy("img").agg(F.min("c0").alias("_left"), F.max(F.col("c0") + F.col("w") - 1).alias("_right"))
    return keep_components(tiles.join(span, "img").select(*G.ARROW.names, "_left", "_right"), on, reach, lambda n: n == 0, then, tile)


def large_components(px: DataFrame, mask: str, min_px: int, bridge_px: int = 0, out: str = "large",
                     tile: int = TILE) -> DataFrame:
    """Keep components of at least ``min_px`` own pixels; gaps up to ``bridge_px`` join components first."""
    own = F.col(mask) == 1
    p = G.with_flag(px, large_parts(G.pack(px, own, tile), min_px, bridge_px, tile), out, tile)
    return p.withColumn(out, F.when(own, F.col(out)).otherwise(0)) if bridge_px else p


def sieve(px: DataFrame, mask: str, max_px: int = C.SPECK_PX, out: str = "sieved", tile: int = TILE) -> DataFrame:
    """Drop water blobs, then land specks, of at most ``max_px`` pixels; no data stays NULL."""
    water = label_components(px.where(F.col(mask) == 1), tile)
    p = settle(_with_flag(px, _kept(water, component_sizes(water), F.col("size") > max_px), "_w"))
    land = label_components(p.where(F.col(mask).isNotNull() & (F.col("_w") == 0)), tile)
    p = _with_flag(p, _kept(land, component_sizes(land), F.col("size") > max_px), "_l")
    return p.withColumn(out, F.when(F.col(mask).isNotNull(), 1 - F.col("_l"))).drop("_w", "_l")


def fill_holes(px: DataFrame, mask: str, out: str = "filled", tile: int = TILE) -> DataFrame:
    """Fill background that cannot reach the left or right border; top and bottom count as closed."""
    back = G.pack(px, F.coalesce(F.col(mask), F.lit(0)) != 1, tile)
    holes = enclosed_parts(back, lambda t: t.has(G.MARK), lambda t, kept: G.flags(t.has(G.PRESENT), kept), tile)
    p = G.with_flag(px, holes, "_h", tile)
    return p.withColumn(out, F.when((F.col(mask) == 1) | (F.col("_h") == 1), 1).otherwise(0)).drop("_h")


def disk_open(px: DataFrame, mask: str, radius: int, out: str = "opened") -> DataFrame:
    """Opening by distance: keep what is within ``radius`` of pixels farther than ``radius`` from background."""
    core = R.distance_within(px, F.col(mask) != 1, radius, "_d1").withColumn("_core", (F.col("_d1").isNull() & (F.col(mask) == 1)).cast("int"))
    near = R.distance_within(core, F.col("_core") == 1, radius, "_d2")
    return near.withColumn(out, F.col("_d2").isNotNull().cast("int")).drop("_d1", "_d2", "_core")


def braid_belt(px: DataFrame, mask: str, line: Sequence[tuple[float, float]] | DataFrame | None, min_px: int,
               bridge_px: int = C.BRIDGE_GAP_PX, radius: int = C.OPEN_RADIUS_PX, half_width: float = C.LINE_BUFFER_M,
               out: str = "belt", tile: int = TILE) -> DataFrame:
    """Burn the line, keep river-sized water, fill enclosed land, cut narrow side channels, keep large parts.

    ``line``: one polyline for every image, a table (img, line, seq, x, y) of the lines of each image, or none.
    """
    if isinstance(line, DataFrame):
        p = R.burn_lines(px, mask, line, half_width, out="_b")
    else:
        p = R.burn_line(px, mask, line, half_width, out="_b") if line else px.withColumn("_b", F.col(mask))

    def opened(wide: np.ndarray) -> np.ndarray:
        present, water = (wide & G.PRESENT) > 0, (wide & G.MARK) > 0
        far = radius * radius
        core = water & (R.squares_within(present & ~water, radius) > far)
        return G.flags(present, present & (R.squares_within(core, radius) <= far))

    tiles = large_parts(G.pack(p, F.col("_b") == 1, tile), min_px, bridge_px, tile)
    tiles = enclosed_parts(tiles, lambda t: t.has(G.PRESENT) & ~t.has(G.MARK),
                           lambda t, kept: G.flags(t.has(G.PRESENT), kept | t.has(G.MARK)), tile)
    tiles = large_parts(G.with_halo(tiles, 2 * radius, opened, tile), min_px, 0, tile)
    return G.with_flag(px, tiles, out, tile)
