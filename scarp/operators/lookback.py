"""Look-backs and look-aheads of a segment's own rows, by array steps over many segments at once.

A segment has at most one row per day, so its rows fit one array. The arrays of some hundred segments are laid behind one
another; a frame of days is then a stretch between two binary searches, and all frames of a kind are sorted together. Results
equal those of day-range windows over the completed panel, which need a list or a hash map per row.
"""
from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = 1 << 16          # rows handled at once
_SEGMENT = 1 << 34      # distance between the days of two segments
_ZERO = 1 << 32         # place of day 0; rows without a day stand at 0, far from all others


@dataclass(frozen=True)
class Look:
    """What to look up for a row: a percentile ``p`` of ``col`` over the days [lo, hi] around a day; without ``p`` the number of
    its values there, or with ``here`` its value on that very day.

    The day is the row's own, or the one held in column ``at``, which counts only ``within`` (first, last) days of the row's own.
    ``least``: values that a percentile needs. ``seen``: only on days on which ``col`` has a value.
    """
    col: str
    lo: int = 0
    hi: int = 0
    p: float | None = None
    least: int = 1
    at: str | None = None
    within: tuple[int, int] | None = None
    seen: bool = False
    here: bool = False


def _percentiles(values: np.ndarray, first: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """Linear interpolation among the ``n`` values from ``first`` on; NaN counts as the largest value."""
    out = np.full(len(n), np.nan)
    some = np.flatnonzero(n > 0)
    if not len(some):
        return out
    first, n = first[some], n[some]
    step = np.arange(n.max())
    x = np.where(step < n[:, None], values[np.minimum(first[:, None] + step, len(values) - 1)], np.nan)
    x.sort(axis=1)      # NaN comes last
    pos = (n - 1) * p
    lo, hi = np.floor(pos).astype(np.int64), np.ceil(pos).astype(np.int64)
    row = np.arange(len(n))
    a, b = x[row, lo], x[row, hi]
    with np.errstate(invalid="ignore"):
        out[some] = np.where(a == b, a, (hi - pos) * a + (pos - lo) * b)
    return out


def _found(cols: Mapping[str, pa.Array], segment: np.ndarray, looks: Mapping[str, Look]) -> list[pa.Array]:
    day, known = _numbers(cols["day"])
    base = segment * _SEGMENT
    own = base + np.where(known, day + _ZERO, 0)
    order = np.argsort(own, kind="stable")
    placed = own[order]
    kept: dict[str, tuple] = {}
    for c in {k.col for k in looks.values()}:
        v = cols[c].cast(pa.float64())
        has = np.asarray(v.is_valid())
        at = order[has[order]]
        kept[c] = own[at], v.fill_null(0.0).to_numpy(zero_copy_only=False)[at], has
    out = []
    for k in looks.values():
        ok, goal = np.ones(len(own), bool), own
        if k.at:
            to, ok = _numbers(cols[k.at])
            ok = ok & known
            if k.within:
                ok &= (to >= day + k.within[0]) & (to <= day + k.within[1])
            goal = np.where(ok, base + to + _ZERO, -1)
        days, values, has = kept[k.col]
        if k.here or k.seen:
            place = np.minimum(np.searchsorted(placed, goal), len(placed) - 1)
            row = order[place]
            ok = ok & (placed[place] == goal) & has[row]
            if k.here:
                out.append(cols[k.col].take(pa.array(row, mask=~ok)))
                continue
        first = np.searchsorted(days, goal + k.lo, "left")
        n = np.where(ok, np.searchsorted(days, goal + k.hi, "right") - first, 0)
        if k.p is None:
            out.append(pa.array(n.astype(np.int64)))
        else:
            n = np.where(n >= k.least, n, 0)
            out.append(pa.array(_percentiles(values, first, n, k.p), mask=n == 0))
    return out


def _numbers(v: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    v = v.cast(pa.int64())
    return v.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(v.is_valid())


def look_around(rows: DataFrame, looks: Mapping[str, Look], scope: Sequence[str] = (), where: str | None = None) -> DataFrame:
    """``rows`` (scope.., transect_id, day and others; one row per segment and day) with a column per look. Days that no row of the
    segment has may be asked for, too. ``where``: return only rows in which this column has a value."""
    keys = [*scope, "transect_id"]
    fields = [c for c in rows.columns if c not in keys]
    kind = {f.name: f.dataType for f in rows.schema.fields}
    found = [T.StructField(n, kind[k.col] if k.here else T.LongType() if k.p is None else T.DoubleType()) for n, k in looks.items()]
    schema = T.StructType([*[T.StructField(c, kind[c]) for c in [*keys, *fields]], *found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(len(keys))
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(lists):
                # as many whole segments as fit, one at least
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ROWS, "right")))
                part = lists.slice(at, to - at)
                segment = pc.list_parent_indices(part).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = part.flatten()
                cols = dict(zip(fields, flat.flatten()))
                if len(flat):
                    got = [*(b.column(i).slice(at, to - at).take(pa.array(segment)) for i in range(len(keys))), *cols.values(),
                           *_found(cols, segment, looks)]
                    out = pa.record_batch(got, [*keys, *fields, *looks])
                    yield out.filter(cols[where].is_valid()) if where else out
                at = to

    grouped = rows.groupBy(*keys).agg(F.collect_list(F.struct(*fields)).alias("_rows"))
    return grouped.mapInArrow(run, schema)
