"""Gradient-boosted trees by histograms, for many trials at once.

Features are cut into bins once; bin 0 stands for a missing value, whose side every split learns. Training rows lie in blocks of some
ten thousand rows, as bytes. A round grows one tree of every trial (a grid point, or a variant with fewer features) level by level. A
level is one job: each block adds up gradients, curvatures and rows by (trial, node, feature, bin). Of two sisters only the one with
fewer rows is added up; the other is what is left of their parent. The driver holds the histograms of the open nodes, whose size
follows trials, nodes and bins and not the rows, and finds the splits; where those of all tasks would be too many for it,
they are added up by (trial, node) on the executors first.

Gradients are whole multiples of 2**-20, so sums are exact and the trees do not depend on how rows are dealt out. Row and feature
samples come from hashes of the row's key, the round and the seed. The margins of a block are those written at the last
checkpoint plus the few trees grown since, so lineage stays short and a lost executor costs one level. Blocks are written to the
shared folder; executors keep a copy in memory or on disk, which is read again from there when it is lost.

``max_rows`` bounds the labelled rows that a fit uses; the rows are picked by key hash. By default there is no bound.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from scarp.functions.ordering import key_hash
from scarp.session import scratch

ONE = float(1 << 20)        # gradients and curvatures count in units of 2**-20
RIDGE = 1.0
BINS, MAX_BINS = 32, 255
ROWS_PER_TASK, MOST_ROWS_PER_TASK, KEEP_TREES = 20_000, 500_000, 10
BLOCK_ROWS, COUNT = 1 << 16, float(1 << 35)     # curvatures of a block sum up to less than COUNT, so COUNT can tally rows in the same float
DRIVER_BYTES = 64 << 20     # of histograms that a level may bring to the driver
MOST_CELLS = 1 << 15        # of a pair of features: what stays in a core's cache
KEYS = ("forecast_date", "transect_id")


@dataclass(frozen=True)
class Trial:
    """One ensemble to grow: its shape and the features it may use (None: all)."""
    depth: int = 4
    min_rows: int = 50
    rate: float = 0.1
    features: tuple[str, ...] | None = None


@dataclass
class Tree:
    """Node arrays; node 0 is the root, feature -1 marks a leaf. ``value`` is set at every node, in log-odds."""
    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    cut: list[float] = field(default_factory=lambda: [0.0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin_: int, cut: float, missing_left: bool, values: tuple[float, float]) -> tuple[int, int]:
        at = len(self.feature)
        self.feature[node], self.bin[node], self.cut[node], self.missing_left[node] = feature, bin_, cut, missing_left
        self.left[node], self.right[node] = at, at + 1
        for v in values:
            for col, x in ((self.feature, -1), (self.bin, 0), (self.cut, 0.0), (self.missing_left, False), (self.left, 0), (self.right, 0),
                           (self.value, v)):
                col.append(x)
        return at, at + 1

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(c) for c in (self.feature, self.bin, self.cut, self.missing_left, self.left, self.right, self.value))


class _Walk:
    """A tree as a table: where each node sends each bin (0: missing). A leaf sends all of them to itself."""

    def __init__(self, arrays: tuple[np.ndarray, ...], limit: np.ndarray, width: int):
        feature, _, _, missing_left, left, right, self.value = arrays
        nodes, bins = np.arange(len(feature))[:, None], np.arange(width)
        to_left = np.where(bins == 0, missing_left[:, None], bins <= limit[:, None])
        go = np.where(feature[:, None] < 0, nodes, np.where(to_left, left[:, None], right[:, None]))
        self.feature, self.go, self.width = np.maximum(feature, 0), go.ravel(), width
        depth = np.zeros(len(feature), np.int64)
        for i in np.flatnonzero(feature >= 0):      # children stand behind their parents
            depth[[left[i], right[i]]] = depth[i] + 1
        self.depth = int(depth.max())

        # a right child follows its left one, see Tree.split
        self.splits = [(int(i), int(feature[i]), int(limit[i]), bool(missing_left[i]), int(left[i] - i)) for i in np.flatnonzero(feature >= 0)]

    def places(self, bins: np.ndarray) -> np.ndarray:
        """As ``leaves``, for bins of a byte: split by split over all columns, as comparisons of bytes are much faster than look-ups."""
        at = np.zeros(bins.shape[1], np.min_scalar_type(len(self.value)))
        for node, f, limit, missing_left, step in self.splits:
            # without one, a missing value's 0 becomes 255
            right = bins[f] > limit if missing_left else bins[f] - np.uint8(1) >= limit
            if node:
                here = at == node
                right &= here
                at += here * at.dtype.type(step)
                at += right
            else:
                at = right.astype(at.dtype) + at.dtype.type(step)
        return at

    def leaves(self, bins: np.ndarray, visit=None) -> np.ndarray:
        """The leaf of every column of ``bins`` (features, rows)."""
        n = bins.shape[1]
        flat, rows, at = bins.ravel(), np.arange(n), np.zeros(n, np.int64)
        for level in range(self.depth):
            if level:
                to = self.go.take(at * self.width + flat.take(self.feature.take(at) * n + rows))
            else:
                to = self.go.take(bins[self.feature[0]])
            if visit:
                visit(rows, self.feature[at], self.value[to] - self.value[at])
            at = to
        return at


@dataclass
class BoostedModel:
    features: list[str]
    trees: list[Tree]
    base: float
    params: dict = field(default_factory=dict)

    def __post_init__(self):
        arrays = [t.arrays() for t in self.trees]
        feature, cut = (np.concatenate([a[i] for a in arrays] or [np.zeros(0)]) for i in (0, 2))
        self.cuts = [np.unique(cut[feature == f]) for f in range(len(self.features))]
        width = max((len(c) for c in self.cuts), default=0) + 2
        self.walks = []
        for a in arrays:
            limit = np.zeros(len(a[0]), np.int64)
            for i in np.flatnonzero(a[0] >= 0):
                limit[i] = 1 + np.searchsorted(self.cuts[a[0][i]], a[2][i])
            self.walks.append(_Walk(a, limit, width))

    def _bins(self, x: np.ndarray) -> np.ndarray:
        """Places among the model's own cuts: a value is in the bin of a cut or below just if it is the cut or below."""
        return np.stack([np.where(np.isnan(v), 0, 1 + np.searchsorted(c, v, side="left")) for v, c in zip(x, self.cuts)])

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the columns of ``x`` (features, rows)."""
        out = np.full(x.shape[1], self.base)
        bins = self._bins(x)
        for w in self.walks:
            out += w.value[w.leaves(bins)]
        return out

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """(rows, features): every split hands the change of the node's value to its feature. With ``bias`` they add up to the margin."""
        out = np.zeros((x.shape[1], len(self.features)))
        bins = self._bins(x)

        def add(rows: np.ndarray, feature: np.ndarray, change: np.ndarray) -> None:
            out[rows, feature] += change        # a row once a step

        for w in self.walks:
            w.leaves(bins, add)
        return out

    @property
    def bias(self) -> float:
        return self.base + sum(t.value[0] for t in self.trees)

    def vector(self) -> Column:
        return F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in self.features])

    def score(self, df: DataFrame, out: str = "raw") -> DataFrame:
        """Add the uncalibrated probability."""
        return df.withColumn(out, score_udf([self])(self.vector())[0])


def _matrix(v: pa.Array, n: int) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), n).T


def _lists(values: np.ndarray) -> pa.ListArray:
    n = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(values) + 1, n, dtype=np.int32)), pa.array(values.ravel()))


def _sigmoid(m: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-m))


def score_udf(models: Sequence[BoostedModel]):
    """Probabilities of several models over the same features, in one Arrow pass: array<double>."""
    n = len(models[0].features)

    @F.arrow_udf("array<double>")
    def run(v: pa.Array) -> pa.Array:
        x = _matrix(v, n)
        return _lists(np.column_stack([_sigmoid(m.margins(x)) for m in models]))
    return run


# --- bins and blocks -----------------------------------------------------------------------------------------------
def bin_edges(train: DataFrame, features: Sequence[str], bins: int = BINS) -> dict[str, list[float]]:
    """Distinct quantiles per feature, from one mergeable sketch each: at most ``bins`` - 1 numbers per feature on the driver."""
    probs = [i / bins for i in range(1, bins)]
    row = train.agg(*[F.percentile_approx(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")), probs, 20 * bins).alias(f"q{i}")
                      for i, f in enumerate(features)]).first()
    return {f: sorted(set(row[i] or [])) for i, f in enumerate(features)}


def _to_block(edges: list[np.ndarray], n_trials: int, base: float):
    def block(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        parts = [np.concatenate(x, axis=-1) for x in zip(*held)]
        parts.append(np.full((n_trials, len(parts[1])), base))
        return pa.record_batch([pa.array([p.tobytes()], pa.binary()) for p in parts], ["bins", "y", "val", "key", "margin"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in (b.slice(i, BLOCK_ROWS) for b in batches for i in range(0, b.num_rows, BLOCK_ROWS)):
            if n + b.num_rows > BLOCK_ROWS:
                yield block(held)
                held, n = [], 0
            x = _matrix(b.column(0), len(edges))
            bins = np.stack([np.where(np.isnan(v), 0, 1 + np.searchsorted(e, v, side="left")) for v, e in zip(x, edges)]).astype(np.uint8)
            y, val, key = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            held.append((bins, y.astype("<f8"), val.astype(np.uint8), key.astype("<u8")))
            n += b.num_rows
        if held:
            yield block(held)
    return run


_BLOCK = "bins binary, y binary, val binary, key binary, margin binary"


class _Block:
    def __init__(self, cols: list[pa.Buffer], n_features: int, n_trials: int):
        self.y = np.frombuffer(cols[1], "<f8")
        n = len(self.y)
        self.bins = np.frombuffer(cols[0], np.uint8).reshape(n_features, n)
        self.val = np.frombuffer(cols[2], np.uint8).astype(bool)
        self.key = np.frombuffer(cols[3], "<u8")
        self.margin = np.frombuffer(cols[4], "<f8").reshape(n_trials, n)


def _batch(row: Row) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x], pa.binary()) for x in row], list(row.__fields__))


def _blocks(batches: Iterator[pa.RecordBatch], n_features: int, n_trials: int) -> Iterator[_Block]:
    for b in batches:
        for i in range(b.num_rows):
            yield _Block([c[i].as_buffer() for c in b.columns], n_features, n_trials)


def _chosen(key: np.ndarray, share: float, seed: int) -> np.ndarray:
    """A hash of key and seed below ``share``."""
    if share >= 1:
        return np.ones(len(key), bool)
    z = (key + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)).astype(np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z >> np.uint64(33)).astype(np.float64) < share * (1 << 31)


def _together(features: list[int], cells: int) -> list[list[int]]:
    """Features in pairs, which are summed over pairs of bins at once, as long as the ``cells`` of a pair are few."""
    step = 2 if cells <= MOST_CELLS else 1
    return [features[i:i + step] for i in range(0, len(features), step)]


def _sums(codes: np.ndarray, at: np.ndarray, nodes: int, g: np.ndarray, h: np.ndarray, features: list[int], bins: int) -> np.ndarray:
    """(node, 3, feature, bin): gradients, curvatures and rows of the columns of ``codes``, whose nodes are ``at``."""
    out = np.zeros((2, nodes, len(codes), bins))
    start: dict[int, np.ndarray] = {}
    for fs in _together(features, nodes * bins * bins):
        size = bins ** len(fs)
        if size not in start:
            start[size] = at.astype(np.intp) * size
        inner = codes[fs[0]] if len(fs) == 1 else codes[fs[0]].astype(np.uint16) * np.uint16(bins) + codes[fs[1]]
        cell = start[size] + inner
        shape = (nodes, *[bins] * len(fs))
        for k, x in enumerate((g, h)):
            table = np.bincount(cell, x, nodes * size).reshape(shape)
            for i, f in enumerate(fs):
                out[k, :, f] = table.sum(axis=2 - i) if len(fs) > 1 else table
    n = np.floor(out[1] / COUNT)
    return np.stack([out[0], out[1] - n * COUNT, n], axis=1).astype(np.int64)


def _histograms(trials: dict, own: dict[int, list[int]], n_features: int, n_trials: int, bins: int, share: float, seed: int):
    """Per task: sums by (feature, bin) of some nodes of each trial, and the validation loss where a round begins.

    ``trials``: number -> (trees since the last checkpoint, tree in growth, nodes to add up). ``own``: the features summed for each.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = {t: ([_Walk(a, a[1], bins) for a in since], _Walk(tree, tree[1], bins), nodes) for t, (since, tree, nodes) in trials.items()}
        sums: dict[int, np.ndarray] = {}
        losses: dict[int, np.ndarray] = {}
        for block in _blocks(batches, n_features, n_trials):
            used = np.flatnonzero(~block.val & _chosen(block.key, share, seed))
            codes, y = block.bins.take(used, axis=1), block.y[used]
            held = np.flatnonzero(block.val)
            if len(held):
                held_codes, v = block.bins.take(held, axis=1), block.y[held]
            for t, (since, tree, nodes) in walks.items():
                if nodes == [0] and len(held):
                    m = block.margin[t][held]
                    for w in since:
                        m += w.value[w.places(held_codes)]
                    loss = np.rint((np.logaddexp(0, m) - v * m) * ONE).astype(np.int64)
                    losses[t] = losses.get(t, np.zeros(2, np.int64)) + [loss.sum(), len(loss)]
                mine, my, rows = codes, y, used
                at = np.zeros(len(used), np.uint8)
                if nodes != [0]:        # rows in other nodes take no part
                    slot = np.full(len(tree.value), len(nodes), np.min_scalar_type(len(nodes)))
                    slot[nodes] = np.arange(len(nodes))
                    at = slot[tree.places(codes)]
                    here = np.flatnonzero(at < len(nodes))
                    mine, my, rows, at = codes.take(here, axis=1), y[here], used[here], at[here]
                margin = block.margin[t][rows]
                for w in since:
                    margin += w.value[w.places(mine)]
                p = _sigmoid(margin)
                got = _sums(mine, at, len(nodes), np.rint((p - my) * ONE), np.rint(p * (1 - p) * ONE) + COUNT, own[t] or [0], bins)
                sums[t] = sums[t] + got if t in sums else got
        rows = [(t, -1, x) for t, x in losses.items()]
        rows += [(t, node, x[i]) for t, x in sums.items() for i, node in enumerate(trials[t][2])]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                               pa.array([r[2].astype("<i8").tobytes() for r in rows], pa.binary())], ["trial", "node", "sums"])
    return run


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    for b in batches:
        for trial, node, x in zip(*(c.to_pylist() for c in b.columns)):
            yield (trial, node), np.frombuffer(x, "<i8")


def _value(g: float, h: float) -> float:
    return -(g / ONE) / (h / ONE + RIDGE)


@dataclass
class _Split:
    """The best split of a node, feature -1 if there is none: sums of gradients, curvatures and rows of the node and of its left child."""
    feature: int
    bin: int
    missing_left: bool
    node: tuple[int, int, int]
    low: tuple[int, int, int]


def best_split(hist: np.ndarray, features: list[int], min_rows: int, n_edges: list[int]) -> _Split:
    """The split of (3, feature, bin) sums with the largest gain (to nine decimals); ties go to the first feature, then the lowest cut, then
    missing right."""
    total = tuple(int(x) for x in hist[:, (features or [0])[0]].sum(axis=1))
    if features:
        g, h, n = total
        own = hist[:, features]
        low = np.cumsum(own[:, :, 1:-1], axis=2)[..., None] + own[:, :, :1, None] * np.array([0, 1])     # feature, cut, missing left
        gl, hl, nl = low
        cut = np.arange(low.shape[2])[:, None] < np.array([n_edges[f] for f in features])[:, None, None]
        ok = (nl >= min_rows) & (n - nl >= min_rows) & cut
        term = lambda a, b: (a / ONE) ** 2 / (b / ONE + RIDGE)
        gain = np.where(ok, np.round(term(gl, hl) + term(g - gl, h - hl) - term(g, h), 9), 0.0)
        f, c, missing_left = np.unravel_index(int(np.argmax(gain)), gain.shape) if gain.size else (0, 0, 0)
        if gain.size and gain[f, c, missing_left] > 0:
            return _Split(features[f], int(c) + 1, bool(missing_left), total, tuple(int(x) for x in low[:, f, c, missing_left]))
    return _Split(-1, 0, False, total, (0, 0, 0))


def _with_trees(since: dict[int, list], n_features: int, n_trials: int, bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = {t: [_Walk(a, a[1], bins) for a in trees] for t, trees in since.items()}
        for b in batches:
            out = []
            for block in _blocks(iter([b]), n_features, n_trials):
                margin, codes = block.margin.copy(), block.bins
                for t, trees in walks.items():
                    for w in trees:
                        margin[t] += w.value[w.places(codes)]
                out.append(margin.tobytes())
            yield pa.record_batch([*(b.column(i) for i in range(4)), pa.array(out, pa.binary())], ["bins", "y", "val", "key", "margin"])
    return run


@dataclass
class _Growth:
    """A tree, the open nodes to add up, and the others: node -> (its parent's sums, the sister that is added up)."""
    tree: Tree
    added: list[int]
    left_over: dict[int, tuple[np.ndarray, int]] = field(default_factory=dict)


# --- fitting -------------------------------------------------------------------------------------------------------
def fit_trials(train: DataFrame, features: Sequence[str], trials: Sequence[Trial], rounds: int = 100, valid: DataFrame | None = None,
               patience: int = 10, edges: Mapping[str, Sequence[float]] | None = None, bins: int = BINS, subsample: float = 0.8,
               colsample: float = 0.8, seed: int = 7411, keys: Sequence[str] = KEYS, max_rows: int | None = None) -> list[BoostedModel]:
    """One model per trial. With ``valid`` a trial ends when its log-loss there has not fallen for ``patience`` rounds, and keeps the
    trees of its best round. Rows without y take no part; with no rows at all the models have no trees."""
    features, trials = list(features), list(trials)
    spark = train.sparkSession
    train = train.where("y IS NOT NULL")
    totals = train.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("y").cast("double")).alias("mean")).first()
    rows, mean = totals["n"], totals["mean"]
    if not rows:
        return [BoostedModel(features, [], 0.0) for _ in trials]
    if max_rows and rows > max_rows:
        train = train.where(key_hash(*keys) < F.lit(int(max_rows / rows * (1 << 32))))
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    base = float(np.log(mean / (1 - mean)))
    cuts = dict(edges) if edges is not None else bin_edges(train, features, bins)
    grid = [np.array(sorted(cuts[f])[:MAX_BINS - 1], np.float64) for f in features]
    width = max(map(len, grid)) + 2
    vector = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features]).alias("x")
    one = lambda d, val: d.select(vector, F.col("y").cast("double").alias("y"), F.lit(val).alias("val"), key_hash(*keys).alias("key"))
    data = one(train, False)
    if valid is not None:
        data = data.unionByName(one(valid.where("y IS NOT NULL"), True))
    # a task's histograms travel, so tasks are few: two a core, unless their blocks become too many for one
    tasks = max(min(-(-rows // ROWS_PER_TASK), 2 * spark.sparkContext.defaultParallelism), -(-rows // MOST_ROWS_PER_TASK))

    def written(d: DataFrame) -> DataFrame:
        path = scratch(spark, "boosting")
        d.write.parquet(path)
        return spark.read.schema(_BLOCK).parquet(path).coalesce(tasks)

    n_f, n_t = len(features), len(trials)
    def held(d: DataFrame) -> RDD:
        """A level is a short job; blocks that executors hold spare it the reading and planning."""
        return d.rdd.map(_batch).persist(StorageLevel.MEMORY_AND_DISK)

    blocks = written(data.repartition(tasks, "key").mapInArrow(_to_block(grid, n_t, base), _BLOCK))
    near = held(blocks)
    own = {t: [i for i, f in enumerate(features) if trial.features is None or f in trial.features] for t, trial in enumerate(trials)}
    grown: list[list[Tree]] = [[] for _ in trials]
    since: dict[int, list] = {t: [] for t in range(n_t)}
    losses: list[list[float]] = [[] for _ in trials]
    live = set(range(n_t))

    n_edges = list(map(len, grid))

    def level(state: dict, allowed: dict, r: int) -> dict:
        """One job: (trial, node) -> sums of the nodes to add up, and at node -1 the validation loss where a round begins."""
        found = near.mapPartitions(_histograms({t: (since[t], s.tree.arrays(), s.added) for t, s in state.items()}, allowed, n_f, n_t, width,
                                               subsample, seed + r)).mapPartitions(_named)
        if tasks * 24 * n_f * width * sum(len(s.added) for s in state.values()) > DRIVER_BYTES:
            found = found.reduceByKey(np.add, tasks)
        sums: dict[tuple[int, int], np.ndarray] = {}
        for key, x in found.collect():     # one of each task, trial and node, or of each trial and node
            sums[key] = sums[key] + x if key in sums else x
        return {k: x if k[1] < 0 else x.reshape(3, n_f, width) for k, x in sums.items()}

    for r in range(rounds + (valid is not None)):
        state = {t: _Growth(Tree(), [0]) for t in sorted(live)}
        allowed = {t: [i for i in own[t] if _chosen(np.array([i], np.uint64), colsample, seed + 1_000_003 * r + 7919 * t)[0]] or own[t] for t in state}
        depth = 0
        while state:
            sums = level(state, allowed, r)
            if depth == 0:
                for t in sorted(live):
                    if (t, -1) in sums:
                        loss, n = (int(x) for x in sums[t, -1])
                        losses[t].append(loss / ONE / max(n, 1))
                    best = int(np.argmin(losses[t])) if losses[t] else r
                    if r - best >= patience or r == rounds:
                        live.discard(t)
                state = {t: s for t, s in state.items() if t in live}
                for t, s in state.items():
                    grown[t].append(s.tree)
            nxt = {}
            for t, s in state.items():
                tree, rate = s.tree, trials[t].rate
                hists = {node: sums[t, node] for node in s.added if (t, node) in sums}
                hists |= {node: parent - hists[sister] for node, (parent, sister) in s.left_over.items() if sister in hists}
                grow = _Growth(tree, [])
                for node in sorted(hists):
                    hist = hists[node]
                    split = best_split(hist, allowed[t], trials[t].min_rows, n_edges)
                    g, h, n = split.node
                    if node == 0:
                        tree.value[0] = rate * _value(g, h)
                    if split.feature < 0:
                        continue
                    gl, hl, nl = split.low
                    left, right = tree.split(node, split.feature, split.bin, float(grid[split.feature][split.bin - 1]), split.missing_left,
                                             (rate * _value(gl, hl), rate * _value(g - gl, h - hl)))
                    if depth + 1 < trials[t].depth:
                        few, many = (left, right) if 2 * nl <= n else (right, left)
                        grow.added.append(few)
                        grow.left_over[many] = (hist, few)
                if grow.added:
                    nxt[t] = grow
            state, depth = nxt, depth + 1
        for t in live:
            since[t].append(grown[t][-1].arrays())
        if not live:
            break
        if max(len(since[t]) for t in live) >= KEEP_TREES:
            blocks = written(blocks.mapInArrow(_with_trees(since, n_f, n_t, width), _BLOCK))
            near.unpersist()
            near = held(blocks)
            since = {t: [] for t in range(n_t)}
    near.unpersist()
    out = []
    for t, trial in enumerate(trials):
        keep = int(np.argmin(losses[t])) if losses[t] else len(grown[t])
        out.append(BoostedModel(features, grown[t][:keep], base, {"depth": trial.depth, "min_rows": trial.min_rows, "rate": trial.rate,
                                                                  "trees": keep}))
    return out
