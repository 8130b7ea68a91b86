"""Tiles of images as small arrays: one row per tile in place of one per pixel.

A tile (img, _tr, _tc, r0, c0, w, grid, extra) holds the box of its pixels, a byte of flags each. ``pack`` makes tiles from
a pixel table, ``each`` and ``with_halo`` change them, ``with_flag`` brings the marked places back to the pixels. No task
holds more than a tile and its surroundings, or the pixels it reads.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRESENT, MARK, NEAR = 1, 2, 4
KEYS = ["img", "_tr", "_tc"]
TILES = "img string, _tr int, _tc int, r0 int, c0 int, w int, grid binary, extra binary"
ARROW = pa.schema([("img", pa.string()), *((n, pa.int32()) for n in ("_tr", "_tc", "r0", "c0", "w")), ("grid", pa.binary()), ("extra", pa.binary())])
PACKED_ROWS = 1 << 20   # pixels a task holds before it passes on their tiles


class Tile(NamedTuple):
    tr: int
    tc: int
    r0: int
    c0: int
    grid: np.ndarray
    extra: np.ndarray   # places in the grid of marked pixels that are listed again, once per repeat

    def has(self, flag: int) -> np.ndarray:
        return (self.grid & flag) > 0


def tile_of(row: dict[str, Any]) -> Tile:
    grid = np.frombuffer(row["grid"], np.uint8).reshape(-1, row["w"])
    return Tile(row["_tr"], row["_tc"], row["r0"], row["c0"], grid, np.frombuffer(row["extra"], np.int32))


def binary(a: np.ndarray, dtype: type) -> pa.Array:
    return pa.array([np.ascontiguousarray(a, dtype).tobytes()], pa.binary())


def flags(present: np.ndarray, mark: np.ndarray, near: np.ndarray | None = None) -> np.ndarray:
    """The bytes of a grid."""
    grid = present * np.uint8(PRESENT) + mark * np.uint8(MARK)
    return grid if near is None else grid + near * np.uint8(NEAR)


def each(tiles: DataFrame, change: Callable[[Tile, dict[str, Any]], dict[str, pa.Array]], schema: str = TILES) -> DataFrame:
    """Tiles with the columns that ``change(tile, row)`` returns, arrays of one value; other columns of ``schema`` stay."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, row in enumerate(b.to_pylist()):
                new = change(tile_of(row), row)
                yield pa.RecordBatch.from_arrays([new[n] if n in new else b.column(n).slice(k, 1) for n in names], names=names)

    return tiles.mapInArrow(run, schema)


# --- between pixels and tiles --------------------------------------------------------------------------------------
def pack(px: DataFrame, mark: Column, tile: int) -> DataFrame:
    """Tiles of a pixel table; a place is marked if any of its rows is. Rows without image, row or column have no place.

    Each task gathers the pixels it reads by tile, so what is shuffled is a few bytes per pixel.
    """
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= PACKED_ROWS:
                yield parts(pa.Table.from_batches(held).combine_chunks())
                held, n = [], 0
        if n:
            yield parts(pa.Table.from_batches(held).combine_chunks())

    def parts(tab: pa.Table) -> pa.RecordBatch:
        names = tab["img"].combine_chunks().dictionary_encode()
        img = names.indices.to_numpy()
        row, col = tab["row"].to_numpy(), tab["col"].to_numpy()
        tr, tc = row // tile, col // tile
        places = ((row - tr * tile) * tile + col - tc * tile) * 2 + tab["mark"].to_numpy(zero_copy_only=False)
        order = np.lexsort((tc, tr, img))
        img, tr, tc, places = img[order], tr[order], tc[order], places[order].astype(np.int32)
        first = np.flatnonzero(np.r_[True, (np.diff(img) != 0) | (np.diff(tr) != 0) | (np.diff(tc) != 0)])
        ends = pa.py_buffer(np.append(first, len(places)).astype(np.int32) * 4)
        packed = pa.Array.from_buffers(pa.binary(), len(first), [None, ends, pa.py_buffer(places)])
        return pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(img[first])), pa.array(tr[first], pa.int32()),
                                           pa.array(tc[first], pa.int32()), packed], names=[*KEYS, "places"])

    def build(tab: pa.Table) -> pa.Table:
        places = np.frombuffer(b"".join(tab["places"].to_pylist()), np.int32)
        at, on = places >> 1, (places & 1) > 0
        r, c = at // tile, at % tile
        r0, c0 = r.min(), c.min()
        r, c = r - r0, c - c0
        grid = np.zeros((r.max() + 1, c.max() + 1), np.uint8)
        grid[r, c] = PRESENT
        grid[r[on], c[on]] |= MARK
        own = np.sort(r[on] * grid.shape[1] + c[on])
        tr, tc = tab["_tr"][0].as_py(), tab["_tc"][0].as_py()
        whole = lambda x: pa.array([int(x)], pa.int32())
        return pa.table({"img": tab["img"].combine_chunks().slice(0, 1), "_tr": whole(tr), "_tc": whole(tc), "r0": whole(tr * tile + r0),
                         "c0": whole(tc * tile + c0), "w": whole(grid.shape[1]), "grid": binary(grid, np.uint8),
                         "extra": binary(own[1:][np.diff(own) == 0], np.int32)})

    place = px.select(F.col("img").cast("string").alias("img"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"),
                      F.coalesce(mark, F.lit(False)).alias("mark")).where("img IS NOT NULL AND row IS NOT NULL AND col IS NOT NULL")
    return place.mapInArrow(gather, "img string, _tr int, _tc int, places binary").groupBy(*KEYS).applyInArrow(build, TILES)


def with_flag(px: DataFrame, tiles: DataFrame, out: str, tile: int) -> DataFrame:
    """Add 1 to the pixels on marked places, 0 to others; the rows of a tile meet the pixels as short arrays."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                t = tile_of(row)
                mark = t.has(MARK)
                at = np.flatnonzero(mark.any(axis=1))
                if len(at):
                    same = lambda x, k: pa.array([x] * k)
                    on = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * row["w"], pa.int32()), pa.array(mark[at].reshape(-1)))
                    yield pa.RecordBatch.from_arrays([same(row["img"], len(at)), pa.array(at + t.r0, pa.int32()), same(t.tc, len(at)).cast(pa.int32()),
                                                      same(t.c0, len(at)).cast(pa.int32()), on], names=["_img", "_row", "_tc", "_c0", "_on"])

    strips = tiles.mapInArrow(rows, "_img string, _row int, _tc int, _c0 int, _on array<boolean>")
    col = F.col("col").cast("int")
    p = px.withColumns({"_img": F.col("img").cast("string"), "_row": F.col("row").cast("int"), "_tc": F.floor(col / tile).cast("int")})
    p = p.join(strips.hint("shuffle_hash"), ["_img", "_row", "_tc"], "left")
    return p.withColumn(out, F.coalesce(F.get("_on", col - F.col("_c0")).cast("int"), F.lit(0))).drop("_img", "_row", "_tc", "_c0", "_on")


# --- what lies in the tiles around ---------------------------------------------------------------------------------
def with_halo(tiles: DataFrame, reach: int, change: Callable[[np.ndarray], np.ndarray], tile: int) -> DataFrame:
    """Tiles with the flags ``change(wide grid)`` returns in the same shape; it sees ``reach`` pixels of the tiles around."""
    near = range(-(-(-reach // tile)), -(-reach // tile) + 1)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                t = tile_of(row)
                out = [{**row, "own": True}]
                for tr, tc in ((t.tr + i, t.tc + j) for i in near for j in near if i or j):
                    r, c = (max(k * tile - reach - at, 0) for k, at in ((tr, t.r0), (tc, t.c0)))
                    r1, c1 = (max((k + 1) * tile + reach - at, 0) for k, at in ((tr, t.r0), (tc, t.c0)))
                    cut = t.grid[r:r1, c:c1]
                    if cut.any():
                        out.append({"img": row["img"], "_tr": tr, "_tc": tc, "r0": t.r0 + r, "c0": t.c0 + c, "w": cut.shape[1],
                                    "grid": cut.tobytes(), "extra": b"", "own": False})
                yield pa.RecordBatch.from_pylist(out, schema=ARROW.append(pa.field("own", pa.bool_())))

    def meet(tab: pa.Table) -> pa.Table:
        pieces = [tile_of(p) for p in tab.to_pylist()]
        one = tab.filter(tab["own"]).drop_columns(["own"]).combine_chunks()
        if not len(one):
            return one
        t = pieces[tab["own"].to_pylist().index(True)]
        r0, c0 = min(p.r0 for p in pieces), min(p.c0 for p in pieces)
        box = lambda p: np.s_[p.r0 - r0:p.r0 - r0 + p.grid.shape[0], p.c0 - c0:p.c0 - c0 + p.grid.shape[1]]
        wide = np.zeros((max(box(p)[0].stop for p in pieces), max(box(p)[1].stop for p in pieces)), np.uint8)
        for p in pieces:
            wide[box(p)] = p.grid
        return one.set_column(one.schema.get_field_index("grid"), "grid", binary(change(wide)[box(t)], np.uint8))

    return tiles.select(*ARROW.names).mapInArrow(spread, f"{TILES}, own boolean").groupBy(*KEYS).applyInArrow(meet, TILES)
