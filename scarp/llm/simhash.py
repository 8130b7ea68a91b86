"""SimHash near-duplicates by an inverted index over byte positions with count filtering.

Fingerprints that differ in at most two bits differ in at most two of their eight bytes, so they agree in six positions:
that is the guaranteed count. A posting of the index is keyed by six positions and their bytes; a pair that reaches the
count meets in at least one of the 28 postings of either side, and only such pairs meet. A posting holds at most 65,536
different fingerprints (two bytes are free), so its group is bounded whatever the data. Inside a posting short lists tally
the shared bytes of each pair, keep six or more and verify the bits; long lists look up, for each fingerprint, the values
that keep the count and differ in one or two bits, which costs the same per fingerprint at any length. Either way a posting
returns one edge per linked fingerprint, never all pairs. Copies share a fingerprint and enter the index once.

Null text counts as empty; a text without words has fingerprint zero and is linked like any other. Repeated rows stay
rows. A null doc_id never names a component unless it is alone. An empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scarp.llm.texts import apart, id_and_text, rows_with_text, stored, words
from scarp.operators.components import connected

SHINGLE, SEED, MAX_BITS, BYTES = 3, 42, 2, 8
MIN_SHARED = BYTES - MAX_BITS           # each differing bit spoils one byte at most
PAIRWISE = 24                           # longest list whose pairs are tallied one by one
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANE = np.arange(BYTES, dtype=np.int64) * 256


def fingerprint(raw: bytes, size: int = SHINGLE) -> int:
    """Majority bits over the XXH64 of all word shingles, repeats included."""
    w = words(raw.lower())              # bytes.lower() changes A-Z only
    if not w:
        return 0
    h, join = xxhash.xxh64_intdigest, b" ".join
    if len(w) <= size:
        hashes = [h(join(w), SEED)]
    else:
        hashes = [h(join(t), SEED) for t in zip(*(w[i:] for i in range(size)))]
    counts = np.zeros((BYTES, 256), np.int64)
    for i in range(0, len(hashes), 1 << 17):
        b = np.array(hashes[i:i + (1 << 17)], "<u8").view(np.uint8).reshape(-1, BYTES)
        counts += np.bincount((b + _LANE).ravel(), minlength=256 * BYTES).reshape(BYTES, 256)
    bits = (2 * (counts @ _BITS) > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, axis=1, bitorder="little").tobytes()[::-1].hex(), 16)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, fps = [], []
        for doc, raw in rows_with_text(iter([b])):
            ids.append(doc)
            fps.append(_signed(fingerprint(raw)))
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(fps, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""
    return id_and_text(docs).mapInArrow(_fingerprints, "doc_id long, fp long")


def _free_masks() -> list[tuple[int, int, int]]:
    """For each choice of six agreeing positions: the mask of their bits and the two free positions."""
    out = []
    for free in combinations(range(BYTES), MAX_BITS):
        mask = sum(0xFF << (8 * p) for p in range(BYTES) if p not in free)
        out.append((_signed(mask), *free))
    return out


def _postings(fps: DataFrame) -> DataFrame:
    keys: list[Column] = [F.struct(F.lit(i).cast("tinyint").alias("at"), F.col("fp").bitwiseAND(F.lit(m)).alias("same"))
                          for i, (m, _, _) in enumerate(_free_masks())]
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.at", "k.same", "fp")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _short_lists(group: np.ndarray, fp: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Tally and verify all pairs of lists of up to ``longest``; both arrays are sorted by group."""
    us, vs = [], []
    for step in range(1, longest):
        a = np.flatnonzero(group[step:] == group[:-step])
        if not len(a):
            break
        x = fp[a] ^ fp[a + step]
        shared = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
        ok = shared >= MIN_SHARED
        a, x = a[ok], x[ok]
        ok = _popcount(x) <= MAX_BITS
        us.append(fp[a[ok]])
        vs.append(fp[a[ok] + step])
    return (np.concatenate(us), np.concatenate(vs)) if us else (fp[:0], fp[:0])


def _long_list(fp: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Components of one posting: (fingerprint, smallest fingerprint it reaches inside the posting)."""
    b = fp.view(np.uint8).reshape(-1, BYTES)
    tail = b[:, p].astype(np.int64) | (b[:, q].astype(np.int64) << 8)
    ones = [1 << i for i in range(16)]
    steps = ones + [x | y for x, y in combinations(ones, 2)]
    at = np.full(1 << 16, -1, np.int64)
    at[tail] = np.arange(len(tail))
    links = []
    for s in steps:
        other = at[tail ^ s]
        here = np.flatnonzero(other >= 0)
        links.append((here, other[here]))
    label = np.arange(len(fp))
    while True:
        new = label.copy()
        for u, v in links:
            new[u] = np.minimum(new[u], new[v])
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return fp, fp[label]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of sorted postings (at, same, fp). A posting may span batches; at most one is held over."""
    free = _free_masks()
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def solve(at, same, fp):
        if len(fp) < 2:
            return None
        new = np.r_[True, (at[1:] != at[:-1]) | (same[1:] != same[:-1])]
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        us, vs = [], []
        short = (size[group] > 1) & (size[group] <= PAIRWISE)
        if short.any():
            u, v = _short_lists(group[short], fp[short], PAIRWISE)
            us.append(u)
            vs.append(v)
        starts = np.flatnonzero(new)
        for g in np.flatnonzero(size > PAIRWISE):
            i = starts[g]
            u, v = _long_list(fp[i:i + size[g]], *free[at[i]][1:])
            us.append(u)
            vs.append(v)
        if not us:
            return None
        u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
        keep = u != v
        e = np.unique(np.stack([np.maximum(u, v)[keep], np.minimum(u, v)[keep]], 1), axis=0)
        return pa.record_batch([pa.array(e[:, 0]), pa.array(e[:, 1])], ["u", "v"]) if len(e) else None

    for b in batches:
        if not b.num_rows:
            continue
        at, same, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        fp = fp.view(np.uint64)
        change = np.flatnonzero((at[1:] != at[:-1]) | (same[1:] != same[:-1]))
        fresh = not held or held[-1][0][-1] != at[0] or held[-1][1][-1] != same[0]
        if not len(change) and not fresh:
            held.append((at, same, fp))
            continue
        cut = int(change[-1]) + 1 if len(change) else 0
        parts = held + [(at[:cut], same[:cut], fp[:cut])]
        out = solve(*(np.concatenate([x[i] for x in parts]) for i in range(3)))
        if out is not None:
            yield out
        held = [(at[cut:], same[cut:], fp[cut:])]
    if held:
        out = solve(*(np.concatenate([x[i] for x in held]) for i in range(3)))
        if out is not None:
            yield out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``."""
    prints = stored(fingerprints(docs), "fingerprints")
    different = prints.select("fp").distinct()
    edges = (_postings(different).repartition("at", "same").sortWithinPartitions("at", "same")
             .mapInArrow(_links, "u long, v long"))
    comps = connected(edges.select(F.lit(0).alias("g"), "u", "v"))
    label = F.coalesce("label", "fp")
    first = (prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
             .join(comps.select(F.col("node").alias("fp"), "label"), "fp", "left").select("fp", label.alias("label"), "first"))
    component = first.groupBy("label").agg(F.min("first").alias("component_id"))
    named = first.select("fp", "label").join(component, "label").select("fp", "component_id")
    return (prints.join(named, "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame, groups: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """One row of ``docs`` for each near-duplicate group: the smallest doc_id stays, and none only where no row of the group has one.

    ``groups`` gives (doc_id, component_id) of every row; it is asked about texts, each under its 64-bit hash, as doc_id may repeat or be
    missing. Different texts under one doc_id are judged each on its own; of those in one group, the text of the smallest hash stays.
    An empty table stays empty; other columns, whatever their names, are passed through, those of repeated rows from the row
    that compares smallest.
    """
    rows, names = apart(docs, ("doc_id", "text"))
    t1, t2 = F.xxhash64("text"), F.xxhash64(F.lit(1), "text")
    keyed = rows.withColumns({"_t1": t1, "_t2": t2})
    named = groups(docs.select(F.xxhash64(F.col("text")).alias("doc_id"), "text")).select(F.col("doc_id").alias("_t1"), "component_id").distinct()
    # a row per text before the join, so that copies don't meet in one task
    texts = keyed.groupBy("_t1", "_t2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id")).alias("_id"))
    first = texts.join(named, "_t1").groupBy("component_id").agg(F.min(F.struct("_id", "_t1", "_t2")).alias("_first"))
    found = first.select(F.col("_first._id.doc_id").alias("_keep"), F.col("_first._t1").alias("_k1"), F.col("_first._t2").alias("_k2"))
    others = [F.col(f"`{c}`") for c in names if c != "doc_id"]
    kept = keyed.join(found, F.col("doc_id").eqNullSafe(F.col("_keep")) & (F.col("_t1") == F.col("_k1")) & (F.col("_t2") == F.col("_k2")), "left_semi")
    return (kept.groupBy("doc_id", "_t1", "_t2").agg(F.min(F.struct(*others)).alias("_row"))
            .select(*[F.col("doc_id") if c == "doc_id" else F.col(f"_row.`{c}`") for c in names]).toDF(*docs.columns))
