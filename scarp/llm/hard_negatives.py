"""Hard-negative mining by a secondary-sort shuffle.

A component x becomes floor(scale * x); a score is the integer inner product of a row with an anchor. An anchor's positives are its
``positives`` best other rows of the same label; for each of them the ``negatives`` best rows of other labels are wanted whose score is
at most the positive's and at least ``low`` / 100 of it.

Anchors and rows meet in blocks, ``BLOCK_ANCHORS`` by ``BLOCK_ROWS``, each scored by one matrix product. A block sends on what can still
count: first its best rows of the anchor's label; then, once an anchor's positives are known, the best rows of other labels inside
each positive's window. So an anchor gets a bounded number of rows from each block and no pair is lost. The scores go into
(anchor, descending score, id) keys, hashed by anchor and sorted within partitions; an iterator reads each partition once,
opens a window at every positive and hands negatives to the open windows until they are full or the scores have left them.
It holds the open windows only, never an anchor's rows.

A row takes no part if its label or vector is null or empty, a component is null or not finite, its length differs from that of most
rows, or a component is so large after scaling that 100 scores would not fit a long. vec_id names a row: of rows that repeat it
the one with the smallest label, then the smallest components, counts; rows without vec_id take no part. Ties go to the smaller
vec_id. Equal vectors and one label for all rows change nothing in the plan. An empty table gives an empty result; other
columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scarp.llm.texts import stored

POSITIVES, NEGATIVES, LOW, SCALE = 5, 5, 80, 256
BLOCK_ROWS, BLOCK_ANCHORS = 4096, 8192
AT_ONCE = 256                           # anchors of a block that are scored together
_PAIR = "anchor long, id long, score long"


def integer_rows(vectors: DataFrame, label: Column, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v) of the rows that take part; v holds the components as little-endian 32-bit integers."""
    x = F.col("embedding").cast("array<double>")
    fine = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(x) > 0)
            & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    rows = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"),
                                      F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("x"))
    most = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    n = most["n"] if most else 1
    limit = int(((1 << 62) / (100 * n)) ** 0.5)
    rows = rows.where((F.size("x") == n) & F.forall("x", lambda c: F.abs(c) <= min(limit, (1 << 31) - 1)))
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r")).select("vec_id", "r.label", "r.x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(2).flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(b.num_rows, n)
            yield pa.record_batch([b.column(0), b.column(1), pa.array([v.tobytes() for v in flat], pa.binary())], ["vec_id", "label", "v"])

    return one.mapInArrow(run, "vec_id long, label long, v binary")


def _matrix(col) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "<i4").reshape(len(col), -1)


def _scores(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles while every sum stays below 2**53, else in integers."""
    if int(np.abs(a).max()) * int(np.abs(v).max()) * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ v.T.astype(np.int64)


def _best(score: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The n of ``at`` with the highest scores; ``at`` ascends, and so do ids, so ties go to the smaller id."""
    if len(at) > n:
        s = score[at]
        at = at[s >= np.partition(s, len(s) - n)[len(s) - n]]
        at = at[np.argsort(-score[at], kind="stable")[:n]]
    return at


def _block(pick):
    """Score one block; ``pick`` gives for an anchor the places of the rows that it sends on."""
    def run(_, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and anchors.num_rows:
            rows = rows.sort_by("vec_id")
            ids, label, v = rows["vec_id"].to_numpy(), rows["label"].to_numpy(), _matrix(rows["v"])
            own = anchors.to_pydict()
            for i in range(0, anchors.num_rows, AT_ONCE):
                scores = _scores(_matrix(anchors["v"].slice(i, AT_ONCE)), v)
                for j, s in enumerate(scores, i):
                    at = pick(s, label == own["label"][j], ids != own["anchor"][j], own["windows"][j])
                    out += zip([own["anchor"][j]] * len(at), ids[at].tolist(), s[at].tolist())
        cols = list(zip(*out)) or [()] * 3
        return pa.table([pa.array(c, pa.int64()) for c in cols], ["anchor", "id", "score"])
    return run


def _same_label(n: int):
    return lambda s, same, other, _: _best(s, np.flatnonzero(same & other), n)


def _in_windows(n: int, low: int):
    def pick(s, same, other, tops):
        found = [np.zeros(0, np.int64)]
        for top in set(tops or ()):
            found.append(_best(s, np.flatnonzero(~same & other & (s <= top) & (100 * s >= low * top)), n))
        return np.unique(np.concatenate(found))
    return pick


def _stream(n: int, low: int):
    """Rows come by anchor, then descending score, positives first, then id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, windows = None, []
        for b in batches:
            out: list[tuple] = []
            for a, score, negative, i in zip(*(c.to_pylist() for c in b.columns)):
                if a != anchor:
                    anchor, windows = a, []
                if not negative:
                    windows.append([i, score, 0])
                    continue
                windows = [w for w in windows if w[2] < n and low * w[1] <= 100 * score]
                for w in windows:
                    w[2] += 1
                    out.append((a, w[0], w[2], i, w[1], score))
            cols = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)],
                                  ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])
    return run


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``is_anchor`` reads vec_id, ``label`` any column."""
    rows = stored(integer_rows(vectors, label, scale), "scored")
    anchors = stored(rows.where(is_anchor).withColumnRenamed("vec_id", "anchor"), "anchors")
    n_rows, n_anchors = -(-rows.count() // BLOCK_ROWS) or 1, -(-anchors.count() // BLOCK_ANCHORS) or 1

    def spread(name: str, n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    r = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(n_rows)).cast("int").alias("r"), spread("a", n_anchors), "vec_id", "label", "v")

    def meet(asked: DataFrame, pick) -> DataFrame:
        q = asked.select(F.pmod(F.xxhash64("anchor"), F.lit(n_anchors)).cast("int").alias("a"), spread("r", n_rows),
                         "anchor", "label", "v", "windows")
        return r.groupBy("r", "a").cogroup(q.groupBy("r", "a")).applyInArrow(_block(pick), _PAIR)

    near = meet(anchors.withColumn("windows", F.lit(None).cast("array<long>")), _same_label(positives))
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    best = stored(near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= positives).drop("k"), "positives")
    tops = best.groupBy("anchor").agg(F.collect_set("score").alias("windows"))       # as many as there are positives
    far = meet(anchors.join(tops, "anchor"), _in_windows(negatives, low))
    keyed = (best.withColumn("negative", F.lit(0)).unionByName(far.withColumn("negative", F.lit(1)))
             .select("anchor", "score", "negative", "id"))
    return (keyed.repartition("anchor").sortWithinPartitions("anchor", F.desc("score"), "negative", "id")
            .mapInArrow(_stream(negatives, low), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"))
