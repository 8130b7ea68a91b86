"""Shared helpers: Arrow columns as bytes, words, batches of bounded size, memory of worker processes, shared tables."""
from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scarp.session import scratch

PIECE_BYTES = 3 << 20   # text handled at once inside a task
_REMEMBERED: dict[str, Callable[[], object]] = {}
try:
    _TRIM = ctypes.CDLL(None).malloc_trim       # glibc only
except (AttributeError, OSError, TypeError):
    _TRIM = None


def raw_texts(col: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column, one by one; null counts as empty."""
    wide = pa.types.is_large_string(col.type)
    for x in col.cast(pa.large_binary() if wide else pa.binary()):
        yield x.as_py() or b""


def words(raw: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``; splitting bytes knows no other white space."""
    return raw.split()


def pieces(rows: Iterator[tuple], size: int = PIECE_BYTES) -> Iterator[list[tuple]]:
    """Rows (.., raw) in lists of about ``size`` bytes of raw text, so that memory does not follow the batch size."""
    out, n = [], 0
    for r in rows:
        out.append(r)
        n += len(r[-1]) + 64
        if n >= size:
            yield out
            out, n = [], 0
    if out:
        yield out


def remembers(owner: str, forget: Callable[[], object]) -> None:
    """Worker processes keep something for the steps of ``owner`` from task to task, and ``forget`` drops it."""
    _REMEMBERED[owner] = forget


def tidy(keep: str = "") -> None:
    """Drops what this process remembers for others than ``keep`` and gives free memory back to the system."""
    for owner, forget in _REMEMBERED.items():
        if owner != keep:
            forget()
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def lean(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: str = ""):
    """``step`` of mapInArrow in a process that remembers only what is ``keep``'s.

    Python workers outlive their tasks, and what they hold counts against the executor while other stages run.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy(keep)
        try:
            yield from step(batches)
        finally:
            tidy(keep)
    return run


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the two columns that text operators read, whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def apart(docs: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """``docs`` with all columns but ``keep`` renamed, so that no operator's own column meets one of them; and the new names."""
    names = [c if c in keep else f"column {i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), names


def rows_with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc_id, raw text) of every row of the batches of ``id_and_text``."""
    for b in batches:
        yield from zip(b.column(0).to_pylist(), raw_texts(b.column(1)))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written below the shared folder and read back: short lineage that survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
