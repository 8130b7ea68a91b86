"""Incremental line dedup that can be undone: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased; it is named by 128 bits of its hash. Keys of at
least ``LEAST`` code points count. A ``LineStore`` is a folder of tables and takes batches of documents and deletions:

* ``keys-<v>``: the references, a row per key and document, appended per batch. ``gone-<v>`` lists documents taken out.
* ``filters-<v>``: per shard of the key space a cuckoo filter (``cuckoo.py``) of all keys with a live reference. A batch
  streams through it once: a key without an entry is new and needs nothing else. Only keys that meet an entry, which most
  lines of a corpus never do, go on to exact counting.
* ``counts-<v>``: the exact counts of keys with two or more live documents: (key, documents, smallest doc_id).
* ``versions``: a row per finished step, written last. A step that fails leaves no row and is done again as if never begun.

Deleting documents takes their references away, recounts the keys they held and clears the filter entries of keys that are
left without any. Live keys that shared such an entry are found in the exact table and inserted again, so the filter has no
false negatives, and its false positives only cost an exact count. ``deduplicated`` drops lines by the counts at hand.

Hot keys: a chunk sends one row per key to the filters, however many documents hold it. Keys with more than 1 in ``COLD``
of all references, of which there are at most ``COLD`` by counting, meet their references by broadcast; for all others a
shuffle by key is even enough. A shard holds about ``SHARD_KEYS`` keys of the first batch; later ones let its filter grow by
further tables at 2 to 3 bytes a key.

Null or empty text is one empty line. Rows that repeat a doc_id are one document and each is cut; rows without doc_id are
one document that follows all others. Very long texts are handled line by line. A document that is put in twice counts once.
An empty table is a batch without keys. Columns other than doc_id and text are passed through under their own names.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scarp.llm.cuckoo import Cuckoo
from scarp.llm.texts import PIECE_BYTES, apart, id_and_text, pieces, raw_texts, rows_with_text

LEAST, SHARD_KEYS, COLD, CHUNK = 10, 1 << 18, 10_000, 1 << 16
NO_ID = (1 << 63) - 1                   # stands for a null doc_id: after all others
_SPACE = b" \t\n\x0b\x0c\r"
_KEY = ["h1", "h2"]


def line_key(line: bytes) -> bytes | None:
    """The key of a line, or None if it is too short to count."""
    k = line.strip(_SPACE).lower()      # bytes.lower() changes A-Z only
    if len(k) < LEAST or (not k.isascii() and len(k.decode("utf-8", "replace")) < LEAST):
        return None
    return k


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    h = xxhash.xxh3_128_digest
    for rows in pieces(rows_with_text(batches)):
        ids, found = [], []
        for doc, raw in rows:
            own = {h(k) for line in raw.split(b"\n") if (k := line_key(line)) is not None}
            found += own
            ids += [NO_ID if doc is None else doc] * len(own)
        k = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
        yield pa.record_batch([pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), pa.array(ids, pa.int64())], ["h1", "h2", "doc"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per key of a batch of references: how many it has there, and whether of several documents."""
    for b in batches:
        if not b.num_rows:
            continue
        h1, h2, doc = (c.to_numpy() for c in b.columns)
        order = np.lexsort((h2, h1))
        h1, h2, doc = h1[order], h2[order], doc[order]
        start = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        many = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
        yield pa.record_batch([pa.array(h1[start]), pa.array(h2[start]), pa.array(np.diff(np.r_[start, len(h1)])), pa.array(many)],
                              ["h1", "h2", "n", "many"])


def _entry(h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, base) of keys; ``_fp`` is the same as a column."""
    fp = (h2 & 0xFFFF).astype(np.uint16)
    return np.where(fp == 0, np.uint16(1), fp), h2 >> 32 & 0xFFFFFFFF


def _fp():
    low = F.col("h2").bitwiseAND(F.lit(0xFFFF))
    return F.when(low == 0, 1).otherwise(low)


def _shard(shards: int):
    return F.pmod("h1", F.lit(shards)).cast("int")


def _filter_of(t: pa.Table) -> Cuckoo:
    blobs = sorted(zip(t["level"].to_pylist(), t["slots"].to_pylist()))
    return Cuckoo.read([b for _, b in blobs])


_STEP = "shard int, level int, slots binary, h1 long, h2 long, n long"


def _result(shard: int, kept: Cuckoo, h1=(), h2=(), n=()) -> pa.Table:
    """The tables of a filter and the keys that met an entry, in one layout."""
    blobs, m = kept.blobs(), len(h1)
    none = [None] * len(blobs)
    return pa.table([pa.array([shard] * (len(blobs) + m), pa.int32()), pa.array([*range(len(blobs)), *[None] * m], pa.int32()),
                     pa.array([*blobs, *[None] * m], pa.binary()), *(pa.array([*none, *x], pa.int64()) for x in (h1, h2, n))],
                    ["shard", "level", "slots", "h1", "h2", "n"])


def _insert(key, rows: pa.Table, held: pa.Table) -> pa.Table:
    """Stream a shard's keys through its filter; out come the filter and the keys that met an entry."""
    kept = _filter_of(held)
    h1, h2, n, many = (rows[c].to_numpy() for c in ("h1", "h2", "n", "many"))
    met = many.astype(bool).copy()
    for i in range(0, len(h2), CHUNK):
        met[i:i + CHUNK] |= kept.insert(*_entry(h2[i:i + CHUNK]))
    return _result(key[0].as_py(), kept, h1[met], h2[met], n[met])


def _delete(key, rows: pa.Table, held: pa.Table) -> pa.Table:
    """Clear the entries of a shard's keys without references, then put live keys back that lost theirs."""
    kept = _filter_of(held)
    h2, live = rows["h2"].to_numpy(), rows["live"].to_numpy().astype(bool)
    kept.remove(*_entry(h2[~live]))
    kept.insert(*_entry(h2[live]))
    return _result(key[0].as_py(), kept)


def _meet(refs: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """References of ``keys`` (unique; ``n`` tells how many each has) with the columns asked for."""
    hot_from = refs.agg(F.greatest(F.floor(F.count(F.lit(1)) / COLD), F.lit(1000))).scalar()
    hot = F.broadcast(keys.where(F.col("n") > hot_from).select(*_KEY, *columns, F.lit(True).alias("hot")))
    split = refs.join(hot, _KEY, "left")
    out = [*refs.columns, *columns]
    cold = split.where("hot IS NULL").select(*refs.columns).join(keys.where(F.col("n") <= hot_from).select(*_KEY, *columns), _KEY)
    return split.where("hot").select(*out).unionByName(cold.select(*out))


def _counts(refs: DataFrame) -> DataFrame:
    """(key, n, first): exact number of documents and the smallest of them, of keys with two or more."""
    one = refs.groupBy(*_KEY, "doc").agg(F.lit(1).alias("one"))      # a hot key is spread over its documents here
    return one.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first")).where("n > 1")


class LineStore:
    """A line-dedup store below ``path``, a folder that all executors reach. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, new: bool = True):
        self.spark, self.path, self.steps, self.shards = spark, path.rstrip("/"), [], None
        if not new:
            rows = spark.read.parquet(f"{self.path}/versions").orderBy("version").collect()     # a row per step
            self.steps, self.shards = [r["kind"] for r in rows], rows[-1]["shards"]

    # --- tables ----------------------------------------------------------------------------------------------
    def _write(self, df: DataFrame, name: str, version: int) -> DataFrame:
        path = f"{self.path}/{name}-{version}"
        df.write.mode("overwrite").parquet(path)        # what a failed attempt left is replaced
        return self.spark.read.schema(df.schema).parquet(path)

    def _read(self, name: str, schema: str) -> DataFrame:
        """The newest table of that name; an empty one before the first step."""
        if not self.steps:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}-{len(self.steps)}")

    def filters(self) -> DataFrame:
        return self._read("filters", "shard int, level int, slots binary")

    def counts(self) -> DataFrame:
        """(h1, h2, n, first): keys with at least two live documents."""
        return self._read("counts", "h1 long, h2 long, n long, first long")

    def _references(self, gone: DataFrame | None = None, more: DataFrame | None = None) -> DataFrame:
        """(h1, h2, doc) of all batches less what later deletions took; ``gone`` and ``more`` belong to the step at hand."""
        batches = [i + 1 for i, kind in enumerate(self.steps) if kind == "insert"]
        deletions = [i + 1 for i, kind in enumerate(self.steps) if kind == "delete"]
        kind = "h1 long, h2 long, doc long, version int"
        refs = (self.spark.read.schema(kind).parquet(*[f"{self.path}/keys-{v}" for v in batches]) if batches
                else self.spark.createDataFrame([], kind))
        out = [self.spark.read.schema("doc long, until int").parquet(f"{self.path}/gone-{v}") for v in deletions]
        out += [gone] if gone is not None else []
        for d in out:
            d = d.withColumnRenamed("doc", "_gone")
            refs = refs.join(d, (F.col("doc") == F.col("_gone")) & (F.col("version") < F.col("until")), "left_anti")
        refs = refs.select(*_KEY, "doc")
        return refs.unionByName(more.select(*_KEY, "doc")) if more is not None else refs

    def _finish(self, kind: str) -> None:
        row = [(len(self.steps) + 1, kind, self.shards)]
        self.spark.createDataFrame(row, "version int, kind string, shards int").coalesce(1).write.mode("append").parquet(f"{self.path}/versions")
        self.steps.append(kind)

    def _recount(self, keys: DataFrame, refs: DataFrame, version: int) -> None:
        """New counts: those of ``keys`` (key, n) from their references, all others as they were."""
        old = self.counts().join(keys.select(*_KEY), _KEY, "left_anti")
        self._write(old.unionByName(_counts(_meet(refs, keys, []))), "counts", version)

    # --- steps -----------------------------------------------------------------------------------------------
    def insert(self, docs: DataFrame) -> None:
        v = len(self.steps) + 1
        found = id_and_text(docs).mapInArrow(_keys, "h1 long, h2 long, doc long")
        added = self._write(found.withColumn("version", F.lit(v)), "keys", v)
        if self.shards is None:
            self.shards = max(16, -(-added.count() // SHARD_KEYS))
        rows = (added.select(*_KEY, "doc").mapInArrow(_chunks, "h1 long, h2 long, n long, many boolean")
                .withColumn("shard", _shard(self.shards)))
        step = self._write(rows.groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInArrow(_insert, _STEP), "step", v)
        self._write(step.where("level IS NOT NULL").select("shard", "level", "slots"), "filters", v)
        # An old count tells how hot a key is that was met before this batch.
        met = (step.where("level IS NULL").groupBy(*_KEY).agg(F.sum("n").alias("n"))
               .join(self.counts().select(*_KEY, F.col("n").alias("held")), _KEY, "left")
               .select(*_KEY, (F.col("n") + F.coalesce("held", F.lit(0))).alias("n")))
        self._recount(self._write(met, "met", v), self._references(more=added), v)
        self._finish("insert")

    def delete(self, ids: DataFrame) -> None:
        """Take the documents out whose doc_id is in ``ids``; a null there stands for the rows without doc_id."""
        v = len(self.steps) + 1
        named = ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc")).distinct()
        gone = self._write(named.withColumn("until", F.lit(v)), "gone", v)
        lost = self._references().join(gone.select("doc"), "doc", "left_semi")
        touched = self._write(lost.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("lost"))
                              .join(self.counts().select(*_KEY, F.col("n").alias("held")), _KEY, "left")
                              .select(*_KEY, F.greatest("lost", F.coalesce("held", F.lit(0))).alias("n")), "touched", v)
        left = self._references(gone)
        self._recount(touched, left, v)
        held = _meet(left, touched, []).select(*_KEY).distinct()
        empty = self._write(touched.select(*_KEY).join(held, _KEY, "left_anti"), "empty", v)
        marks = empty.select(_shard(self.shards or 1).alias("shard"), _fp().alias("fp")).distinct()
        again = (left.select(*_KEY).withColumns({"shard": _shard(self.shards or 1), "fp": _fp()})
                 .join(marks, ["shard", "fp"], "left_semi").select(*_KEY).distinct())
        rows = (empty.withColumn("live", F.lit(False)).unionByName(again.withColumn("live", F.lit(True)))
                .withColumn("shard", _shard(self.shards or 1)))
        step = rows.groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInArrow(_delete, _STEP)
        self._write(step.select("shard", "level", "slots"), "filters", v)
        self._finish("delete")

    def deduplicated(self, docs: DataFrame) -> DataFrame:
        """``docs``, which were put in before, with ``text`` less its repeated lines, and n_lines and n_dropped at the end."""
        drops = (_meet(self._references(), self.counts(), ["first"]).where("doc <> first")
                 .groupBy("doc").agg(F.collect_set(F.struct(*_KEY)).alias("keys")))
        rows, names = apart(docs, ("doc_id", "text"))
        joined = (rows.withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
                  .join(drops.withColumnRenamed("doc", "_doc"), "_doc", "left")
                  .withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit(""))).drop("_doc", "text"))
        others = [c for c in names if c != "text"]
        kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others)
        cut = joined.select(*[F.col(f"`{c}`") for c in others], F.col("keys.h1").alias("_h1"), F.col("keys.h2").alias("_h2"), "_text")
        out = cut.mapInArrow(_cut, f"{kinds}, text string, n_lines long, n_dropped long")
        return out.select(*[F.col(f"`{c}`") for c in names], "n_lines", "n_dropped").toDF(*docs.columns, "n_lines", "n_dropped")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    h = xxhash.xxh3_128_digest
    for b in batches:
        own = b.num_columns - 3
        h1, h2 = b.column(own), b.column(own + 1)
        kept, lines, dropped, size, first = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            part = b.slice(first, len(kept))
            return pa.record_batch([*(part.column(c) for c in range(own)), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()),
                                    pa.array(dropped, pa.int64())], [*b.schema.names[:own], "text", "n_lines", "n_dropped"])

        for i, raw in enumerate(raw_texts(b.column(own + 2))):
            n = left = raw.count(b"\n") + 1
            if h1[i].is_valid:
                k = np.column_stack([h1[i].values.to_numpy(), h2[i].values.to_numpy()]).astype("<i8").tobytes()
                gone = {k[j:j + 16] for j in range(0, len(k), 16)}
                parts = [p for p in raw.split(b"\n") if (x := line_key(p)) is None or h(x) not in gone]
                raw, left = b"\n".join(parts), len(parts)
            kept.append(raw)
            lines.append(n)
            dropped.append(n - left)
            size += len(raw)
            if size >= PIECE_BYTES:
                yield flush()
                first, size = i + 1, 0
                kept, lines, dropped = [], [], []
        if kept:
            yield flush()


def digests(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row, through a new store below ``path``."""
    plain = docs.select("doc_id", "text")
    store = LineStore(spark, path)
    store.insert(plain)
    return store.deduplicated(plain).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
