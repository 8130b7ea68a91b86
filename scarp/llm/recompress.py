"""Substring dedup by recompression: every repeat of ``WINDOW`` words is found, all but its first occurrence goes.

Words are named by hashes, and rounds of recompression name adjacent pairs: in a round each symbol is a left or a right
one by a bit of its name, and a left symbol followed by a right one becomes a symbol named by the two. Names and bits are
functions of the words alone, so they are the same in every task without any exchange, and equal substrings get the same
interior symbols wherever they stand. A symbol that would span more words than the round's cap stays unmerged. Thus
whether a symbol starts at a word after the last round depends on ``CONTEXT`` words to either side at most, and every
window of 20 words has such a start among those that its own words decide: equal windows share it. (Let m be a round's cap
and d the words that decide the symbol ending at a place: d grows by the previous m each round, 1, 2, 4, 7; starts after
round four are decided by 7 words on either side, 20 words have 7 places that are, and no symbol spans over 7 words.)
The symbols serve as anchors only: they fix places, and their own names are not looked up; the words around a place are.
No round exchanges rows. Runs of one word have no pairs and get no name; windows deep inside a run are repeats of the one
before, so that nothing about them needs to be looked up.

Spark's work: (1) a start's name, the 14 words around it, is dealt to buckets; a name seen twice or more is a repeat, the
rest is dropped, which is nearly all. (2) Only around repeated starts windows are named by 96 bits and dealt to buckets,
which keep the first occurrence of each by document and place: this verifies the repeat and settles its order.
(3) Each document loses the words under its other windows. Every task sends a name once however often it holds it, so no
group is larger than the number of tasks; what it knows to be repeats from its own rows passes by.

Null text has no words. doc_id names a document: rows with equal doc_id and text are one document and get equal results,
those with equal doc_id and other texts are ordered by the text's hash. A null doc_id counts as smaller than any. Documents of under
20 words lose nothing. An empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain, islice
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scarp.llm.texts import apart, lean, pieces, raw_texts, remembers, words

WINDOW = 20
CAPS = (2, 3, 6, 7)         # most words of a symbol after each round
CONTEXT = 7                 # words on either side that decide a start after the last round
BUCKET_BYTES = 16 << 20     # of text per bucket
NO_ID = -(1 << 63)
_VOCABULARY = 1 << 18
_PIECE = 2 << 20            # of text handled at once
_SLICE = 1 << 16            # words whose names of several words are held at once
_OWN = "words"
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A + b * _B
    x ^= x >> np.uint64(29)
    x *= _C
    x ^= x >> np.uint64(32)
    return x


class _Vocabulary(dict):
    """Word -> place in arrays of its two 64-bit names."""

    def __init__(self):
        super().__init__()
        self.names = array("Q"), array("Q")

    def __missing__(self, w: bytes) -> int:
        self[w] = n = len(self)
        for seed, names in enumerate(self.names, 1):
            names.append(xxhash.xxh64_intdigest(w, seed))
        return n

    def forget(self) -> None:
        self.clear()
        self.names = array("Q"), array("Q")

    def of(self, docs: list[list[bytes]], lanes: int) -> list[np.ndarray]:
        if len(self) > _VOCABULARY:
            self.forget()
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(docs)), np.int64, sum(map(len, docs)))
        return [np.frombuffer(self.names[i], np.uint64)[at] for i in range(lanes)]


_VOCAB = _Vocabulary()
remembers(_OWN, _VOCAB.forget)


def symbol_starts(name: np.ndarray, doc_starts: np.ndarray, caps: tuple[int, ...] = CAPS) -> np.ndarray:
    """Places of the words at which a symbol starts after the last round."""
    at = np.arange(len(name))
    fixed = np.zeros(len(name), bool)
    fixed[doc_starts] = True
    length = np.ones(len(name), np.int64)
    for r, cap in enumerate(caps):
        left = (name * (_A + np.uint64(2 * r)) >> np.uint64(63)).astype(bool)
        joined = left[:-1] & ~left[1:] & ~fixed[1:] & (length[:-1] + length[1:] <= cap)
        i = np.flatnonzero(joined)
        name, length = name.copy(), length.copy()
        name[i], length[i] = _mix(name[i], name[i + 1]), length[i] + length[i + 1]
        keep = np.ones(len(name), bool)
        keep[i + 1] = False
        name, length, at, fixed = name[keep], length[keep], at[keep], fixed[keep]
    return at


def _names(name: np.ndarray) -> dict[int, np.ndarray]:
    """Names of 2, 4, 8 and 16 words from each place on (as far as there are so many)."""
    out = {1: name}
    n = 1
    while n < 16 and len(out[n]) > n:
        out[2 * n] = _mix(out[n][:-n], out[n][n:])
        n *= 2
    return out


def _around(n: dict[int, np.ndarray], j: np.ndarray) -> np.ndarray:
    """Name of the 14 words about each place."""
    i = j - CONTEXT
    return _mix(_mix(n[8][i], n[4][i + 8]), n[2][i + 12])


def _windows(n: dict[int, np.ndarray], s: np.ndarray) -> np.ndarray:
    return _mix(n[16][s], n[4][s + 16])


def _runs(name: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the first place of its run and the place after its last; ``lo`` is its document's first place."""
    new = np.r_[True, (name[1:] != name[:-1]) | (lo[1:] != lo[:-1])]
    starts = np.flatnonzero(new)
    which = np.cumsum(new) - 1
    return starts[which], np.r_[starts[1:], len(name)][which]


class _Text:
    """The words of several documents in one line, in their order."""

    def __init__(self, docs: list[tuple[int, int, list[bytes]]], lanes: int):
        self.ids = np.array([d[:2] for d in docs], np.int64).reshape(-1, 2)
        sizes = np.array([len(d[2]) for d in docs], np.int64)
        self.lo = np.cumsum(sizes) - sizes
        self.hi = self.lo + sizes
        self.doc = np.repeat(np.arange(len(docs)), sizes)
        self.names = _VOCAB.of([d[2] for d in docs], lanes)
        self.run, self.run_end = _runs(self.names[0], self.lo[self.doc])

    def deep(self) -> np.ndarray:
        """Whether a window of one word repeated starts here that repeats the window before it."""
        at = np.arange(len(self.doc))
        return (self.run < at) & (self.run_end - at >= WINDOW)


def _slices(text: _Text) -> Iterator[tuple[int, int]]:
    """(first word, end) of stretches of whole documents, about _SLICE words each unless one document is longer."""
    first = text.lo[np.flatnonzero(np.diff(text.lo // _SLICE, prepend=-1))]
    return ((int(a), int(z)) for a, z in zip(first, np.r_[first[1:], len(text.doc)]) if a < z)


def _named(text: _Text, name: np.ndarray, at: np.ndarray, of: Callable[[dict, np.ndarray], np.ndarray]) -> np.ndarray:
    """``of`` the places ``at``, which are in order and name words of their own document only."""
    out = np.empty(len(at), np.uint64)
    for a, z in _slices(text):
        i, k = np.searchsorted(at, (a, z))
        if i < k:
            out[i:k] = of(_names(name[a:z]), at[i:k] - a)
    return out


# Blobs: entries of several documents, sorted by document: each document once with its number of entries.

def _blob(text: _Text, at: np.ndarray, extra: tuple[np.ndarray, ...] = ()) -> bytes:
    doc = text.doc[at]
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    counts = np.diff(np.r_[first, len(doc)])
    return _packed(text.ids[doc[first]], counts, at - text.lo[doc], extra)


def _packed(ids: np.ndarray, counts: np.ndarray, place: np.ndarray, extra: tuple[np.ndarray, ...] = ()) -> bytes:
    parts = [np.array([len(ids), len(place)], "<u4"), ids.astype("<i8"), counts.astype("<u4"), place.astype("<u4"), *extra]
    return b"".join(p.tobytes() for p in parts)


def _unblob(raw: pa.Buffer, extra: tuple[str, ...] = ()) -> list[np.ndarray]:
    """Views: ids (m, 2) and number of entries of each document, place and extras of each entry."""
    m, n = (int(x) for x in np.frombuffer(raw, "<u4", 2))
    at, out = 8, []
    for count, kind in ((2 * m, "<i8"), (m, "<u4"), (n, "<u4"), *((n, k) for k in extra)):
        out.append(np.frombuffer(raw, kind, count, at))
        at += out[-1].nbytes
    return [out[0].reshape(-1, 2), *out[1:]]


def _ranked(blobs: list[list[np.ndarray]]) -> list[np.ndarray]:
    """[different ids in order, row of each entry there, place, extra..]: ids are held once per document, not per entry."""
    ids, counts = (np.concatenate([x[i] for x in blobs]) for i in range(2))
    order = np.lexsort((ids[:, 1], ids[:, 0]))
    ids = ids[order]
    new = np.r_[True, (ids[1:] != ids[:-1]).any(axis=1)]
    rank = np.empty(len(ids), np.int32)
    rank[order] = np.cumsum(new) - 1
    return [ids[new], np.repeat(rank, counts), *(np.concatenate([x[i] for x in blobs]) for i in range(2, len(blobs[0])))]


_DEALT = "bucket long, known boolean, blob binary"


def _deal(text: _Text, at: np.ndarray, name: np.ndarray, extra: tuple[np.ndarray, ...], known: np.ndarray,
          buckets: int) -> Iterator[tuple]:
    """Rows for the buckets: the entries ``at`` by name, and those known to be repeats by document."""
    bucket = (name % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for i in np.split(order, cuts) if len(order) else []:
        yield int(bucket[i[0]]), False, _blob(text, at[i], tuple(e[i] for e in extra))
    if len(known):
        yield int(text.ids[text.doc[known[0]], 1] % buckets), True, _blob(text, known)


def _to_batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(kinds)
    return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def _dealt(rows: list[tuple]) -> pa.RecordBatch:
    return _to_batch(rows, [pa.int64(), pa.bool_(), pa.binary()], ["bucket", "known", "blob"])


def _documents(b: pa.RecordBatch) -> Iterator[tuple]:
    col = {n: i for i, n in enumerate(b.schema.names)}
    yield from zip(b.column(col["_doc"]).to_pylist(), b.column(col["_hash"]).to_pylist(), raw_texts(b.column(col["text"])))


def _start_entries(buckets: int):
    """(1) The symbol starts of all documents, each name once per piece of text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in pieces((r for b in batches for r in _documents(b)), _PIECE):
            docs = [(d, h, w) for d, h, raw in some if len(w := words(raw)) >= WINDOW]
            some.clear()
            if not docs:
                continue
            text = _Text(docs, 1)
            del docs        # the words themselves
            j = np.concatenate([a + symbol_starts(text.names[0][a:z], text.lo[(text.lo >= a) & (text.lo < z)] - a) for a, z in _slices(text)])
            inside = (j - text.lo[text.doc[j]] >= CONTEXT) & (text.hi[text.doc[j]] - j >= CONTEXT)
            deep = (j - text.run[j] > WINDOW - CONTEXT) & (text.run_end[j] - j >= WINDOW - CONTEXT)
            j = j[inside & ~deep]
            if not len(j):
                continue
            name = _named(text, text.names[0], j, _around)
            _, first, which, count = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
            again = np.ones(len(j), bool)
            again[first] = False
            first.sort()
            n = name[first]
            short = n >> np.uint64(24)      # 40 bits; with the bucket's they tell names apart, and windows are verified
            extra = (short >> np.uint64(8)).astype("<u4"), short.astype("u1"), (count[which[first]] > 1).astype("u1")
            yield _dealt(list(_deal(text, j[first], n, extra, j[again], buckets)))
    return run


def _to_shards(ids: np.ndarray, doc: np.ndarray, place: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Entries (row of ``ids``, place) for the documents' shards, a blob each."""
    shard = ids[:, 1] % buckets
    by = np.argsort(shard, kind="stable")
    at = np.empty(len(by), np.int32)
    at[by] = np.arange(len(by))
    doc = at[doc]
    counts = np.bincount(doc, minlength=len(by))
    place = place[np.lexsort((place, doc))]
    ends = np.r_[0, np.cumsum(counts)]
    rows = []
    for d in np.split(np.arange(len(by)), np.flatnonzero(np.diff(shard[by])) + 1):
        a, z = ends[d[0]], ends[d[-1] + 1]
        if a < z:
            some = d[counts[d] > 0]
            rows.append((int(shard[by[d[0]]]), True, _packed(ids[by[some]], counts[some], place[a:z])))
    return _dealt(rows)


def _per_document(ranges: bool):
    """One row per document of this task's shards with its places, or with the ranges [a, b) of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [_unblob(x.as_buffer()) for b in batches for x in b.column(2)]
        if not found:
            return
        ids, doc, place = _ranked(found)
        del found
        ends = np.cumsum(np.bincount(doc, minlength=len(ids)))
        place = place[np.lexsort((place, doc))]
        places = []
        for a, z in zip(np.r_[0, ends[:-1]], ends):
            p = place[a:z]
            if ranges:
                cut = np.flatnonzero(np.diff(p.astype(np.int64)) > 1)
                p = np.stack([p[np.r_[0, cut + 1]], p[np.r_[cut, len(p) - 1]] + 1], 1).ravel()
            places.append(p.astype("<u4").tobytes())
        yield pa.record_batch([pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(places, pa.binary())],
                              ["_doc", "_hash", "places"])
    return run


def _gather(batches: Iterator[pa.RecordBatch], extra: tuple[str, ...]):
    """All entries of this task's buckets as of ``_ranked``: those known to be repeats, the others, and the bucket of these."""
    known, rest, bucket = [], [], []
    for b in batches:
        for k, is_known, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            if is_known:
                known.append(_unblob(x.as_buffer()))
            else:
                rest.append(_unblob(x.as_buffer(), extra))
                bucket.append((k, len(rest[-1][2])))
    return (_ranked(known) if known else None, _ranked(rest) if rest else None,
            np.repeat(*np.array(bucket, np.int64).T) if bucket else None)


def _repeated_starts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rest, bucket = _gather(batches, ("<u4", "u1", "u1"))
        if known:
            yield _to_shards(*known, buckets)
        del known
        if rest is None:
            return
        ids, doc, place, high, low, flag = rest
        name = bucket.view(np.uint64)       # in place
        name <<= np.uint64(32)
        name |= high
        name <<= np.uint64(8)
        name |= low
        order = np.argsort(name, kind="stable")
        name = name[order]
        same = name[1:] == name[:-1]
        hit = order[np.r_[False, same] | np.r_[same, False] | (flag[order] > 0)]
        if len(hit):
            yield _to_shards(ids, doc[hit], place[hit], buckets)
    return run


def _places(raw: bytes | None) -> np.ndarray:
    return np.frombuffer(raw or b"", "<u4").astype(np.int64)


def _window_entries(buckets: int):
    """(2) The windows about repeated starts, each name once per piece of text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((d, h, p, raw) for b in batches
                for (d, h, raw), p in zip(_documents(b), b.column(b.schema.names.index("places")).to_pylist()))
        for some in pieces(rows, _PIECE):
            # Rows that repeat a document are one document here.
            docs = {(d, h): (p, raw) for d, h, p, raw in some}
            keys = sorted(docs)
            some.clear()
            text = _Text([(*k, words(docs[k][1])) for k in keys], 2)
            wanted = np.zeros(len(text.doc) + 1, np.int64)
            for k, lo, hi in zip(keys, text.lo, text.hi):
                j = _places(docs[k][0])
                # A window has the start among its places CONTEXT..WINDOW-CONTEXT.
                a = np.clip(j - (WINDOW - CONTEXT), 0, None)
                b = np.clip(j - CONTEXT + 1, 0, hi - lo - WINDOW + 1)
                ok = a < b
                np.add.at(wanted, lo + a[ok], 1)
                np.add.at(wanted, lo + b[ok], -1)
            s = np.flatnonzero((np.cumsum(wanted)[:-1] > 0) & ~text.deep())
            if not len(s):
                continue
            a, b = (_named(text, n, s, _windows) for n in text.names)
            order = np.lexsort((b, a))      # stable: the first of a group is the first by document and place
            x, y = a[order], b[order]
            new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
            first, again = np.sort(order[new]), np.sort(order[~new])
            x, y = a[first], b[first]
            yield _dealt(list(_deal(text, s[first], x, (x.astype("<u8"), y.astype("<u4")), s[again], buckets)))
    return run


def _later_windows(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rest, _ = _gather(batches, ("<u8", "<u4"))
        if known:
            yield _to_shards(*known, buckets)
        del known
        if rest is None:
            return
        ids, doc, place, a, b = rest
        order = np.lexsort((place, doc, b, a))
        x, y = a[order], b[order]
        new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
        head = np.flatnonzero(new)
        first = order[np.repeat(head, np.diff(np.r_[head, len(order)]))]
        # The same window of the same document from two pieces (its rows are repeated) is one occurrence.
        same = (doc[first] == doc[order]) & (place[first] == place[order])
        later = order[~new & ~same]
        if len(later):
            yield _to_shards(ids, doc[later], place[later], buckets)
    return run


def covered(raw: bytes, ranges: bytes | None) -> tuple[list[bytes], np.ndarray]:
    """The words of a text and whether each is under a window that starts in one of the ranges, or deep in a run."""
    w = words(raw)
    if len(w) < WINDOW:
        return w, np.zeros(len(w), bool)
    r = _places(ranges).reshape(-1, 2)
    same = np.fromiter(map(eq, w, islice(w, 1, None)), bool, len(w) - 1)
    if same.any():
        change = np.r_[0, np.flatnonzero(~same) + 1, len(w)]
        long = np.diff(change) > WINDOW
        r = np.concatenate([r, np.stack([change[:-1][long] + 1, change[1:][long] - WINDOW + 1], 1)])
    cover = np.zeros(len(w) + 1, np.int64)
    np.add.at(cover, r[:, 0], 1)
    np.add.at(cover, r[:, 1] - 1 + WINDOW, -1)
    return w, np.cumsum(cover)[:-1] > 0


def _without(raw: bytes, gone: np.ndarray) -> bytes:
    """The text less the words that go and the white space after each."""
    if not gone.any():
        return raw
    spans = np.array([m.start() for m in _WORD.finditer(raw)] + [len(raw)])
    edges = np.flatnonzero(np.diff(np.r_[0, gone.view(np.int8), 0]))
    out, at = [], 0
    for a, b in zip(spans[edges[::2]], spans[edges[1::2]]):
        out.append(raw[at:a])
        at = b
    return b"".join(out) + raw[at:]


def _marked(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text string, ..) with ``places``, the ranges of starts of each document's later windows."""
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    buckets = int(total // BUCKET_BYTES) + 1
    keyed = docs.withColumns({"_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)),
                              "_hash": F.xxhash64(F.coalesce("text", F.lit("")))})
    dealt = keyed.repartition(buckets, "_doc", "_hash")
    bucket = F.col("bucket").cast("int")      # a task per bucket: dealing them by hash would give some tasks several

    def joined(shards: DataFrame, ranges: bool, how: str) -> DataFrame:
        found = shards.repartitionById(buckets, bucket).mapInArrow(lean(_per_document(ranges), _OWN), "_doc long, _hash long, places binary")
        return dealt.join(found.hint("shuffle_hash"), ["_doc", "_hash"], how)

    entries = keyed.select("_doc", "_hash", "text").mapInArrow(lean(_start_entries(buckets), _OWN), _DEALT)
    starts = entries.repartitionById(buckets, bucket).mapInArrow(lean(_repeated_starts(buckets), _OWN), _DEALT)
    windows = joined(starts, False, "inner").mapInArrow(lean(_window_entries(buckets), _OWN), _DEALT)
    later = windows.repartitionById(buckets, bucket).mapInArrow(lean(_later_windows(buckets), _OWN), _DEALT)
    return joined(later, True, "left")


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per row; the kept words are joined by one space."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for doc, raw, lists in zip(col["doc_id"].to_pylist(), raw_texts(col["text"]), col["places"].to_pylist()):
                w, gone = covered(raw, lists)
                n = int(gone.sum())
                kept = [x for x, g in zip(w, gone) if not g] if n else w
                rows.append((doc, len(w), n, hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield _to_batch(rows, [*[pa.int64()] * 3, pa.string()], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _marked(slim).mapInArrow(lean(run, _OWN), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with their other columns; text loses its repeats, n_chars (if there) follows it."""
    rows, names = apart(docs.withColumn("text", F.col("text").cast("string")), ("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            new = []
            for keep, raw, lists in zip(col["text"], raw_texts(col["text"]), col["places"].to_pylist()):
                text = _without(raw, covered(raw, lists)[1])
                new.append(None if not keep.is_valid else text)
            col["text"] = pa.array(new, pa.binary()).cast(pa.string())
            yield pa.record_batch([col[n] for n in names], names)

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema.fields])
    out = _marked(rows).mapInArrow(lean(run, _OWN), schema).toDF(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
