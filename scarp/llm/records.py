"""Token ids in files of length-delimited binary records, with an offset index beside them.

A record is: length (unsigned 64 bits), masked CRC-32 of the length's bytes, payload, masked CRC-32 of the payload, and a
line feed. The payload is a flag byte, the document id, the number of ids, and the ids in 16 bits where all fit, else 32;
all little-endian. Masking turns a checksum by 15 bits and adds a constant, so that a checksum over data that hold
checksums stays useful. Records end in a line feed because Spark's text writer puts one there: the files are written by
Spark's own committer, which any store and a lost executor allow for, and read back by its binary reader.

Files follow the order of doc_id (null first, ties by text); their number follows the partitions of the input. Null text counts as
empty and has the end id only; repeated rows are records of their own; an empty table gives no rows. Very long texts are
one record each; columns other than doc_id and text are not read.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scarp.llm.texts import id_and_text, stored
from scarp.llm.tokens import BYTE_BPE, coded, encoder, tokenizer_file

END_ID = 0
FILES_PER_SPLIT = 3     # files for each partition of the input: what bounds a partition bounds them
_LENGTH, _SUM, _HEAD = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<BqI")
_OVERHEAD = _LENGTH.size + 2 * _SUM.size + 1
_WIDE, _NO_ID = 1, 2


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes) -> bytes:
    """One record without its line feed; ids are little-endian unsigned 32-bit integers."""
    a = np.frombuffer(ids, "<u4")
    wide = bool(len(a)) and int(a.max()) > 0xFFFF
    flags = _WIDE * wide | _NO_ID * (doc_id is None)
    payload = _HEAD.pack(flags, doc_id or 0, len(a)) + (ids if wide else a.astype("<u2").tobytes())
    size = _LENGTH.pack(len(payload))
    return b"".join((size, _SUM.pack(masked(size)), payload, _SUM.pack(masked(payload))))


def parse(data: memoryview, at: int) -> tuple[int | None, np.ndarray, int]:
    """(doc_id, ids, position of the next record) of the record at a position; a wrong checksum raises."""
    size = bytes(data[at:at + _LENGTH.size])
    at += _LENGTH.size
    if _SUM.unpack_from(data, at)[0] != masked(size):
        raise ValueError("a record's length is damaged")
    n, at = _LENGTH.unpack(size)[0], at + _SUM.size
    payload = bytes(data[at:at + n])
    if _SUM.unpack_from(data, at + n)[0] != masked(payload):
        raise ValueError("a record is damaged")
    flags, doc, count = _HEAD.unpack_from(payload)
    ids = np.frombuffer(payload, "<u4" if flags & _WIDE else "<u2", count, _HEAD.size)
    return None if flags & _NO_ID else doc, ids, at + n + _SUM.size + 1


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content); the name's number is the file's place in the order."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records")
            .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content"))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of the index, from the records' own bytes."""
    for b in batches:
        for name, content in zip(b.column(0), b.column(1)):
            data = memoryview(content.as_buffer())
            at, tokens, name = 0, 0, name.as_py()
            while at < len(data):
                doc, ids, nxt = parse(data, at)
                yield name, doc, at, nxt - at, tokens, len(ids), zlib.crc32(ids.astype("<u4").tobytes())
                tokens, at = tokens + len(ids), nxt


def _batches(rows: Iterator[tuple], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out)) or [()] * len(kinds)
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], [f"c{i}" for i in range(len(kinds))])

    for r in rows:
        out.append(r)
        if len(out) >= 2000:
            yield batch()
            out.clear()
    yield batch()


_INDEX = "file string, doc_id long, offset long, bytes long, before long, n_tokens long, ids_crc32 long"
_KINDS = [pa.string(), *[pa.int64()] * 6]


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _batches(_scan(batches), _KINDS)


def write_records(docs: DataFrame, path: str, tokenizer: str = BYTE_BPE, end_id: int = END_ID,
                  file_bytes: int | None = None) -> None:
    """Write ``path``/records and, from reading them, ``path``/index: where each record lies and what it holds.

    There are ``FILES_PER_SPLIT`` files per input partition, or as many as texts fill at ``file_bytes`` each.
    The index has file, doc_id, offset, bytes, before (ids of the file before it), n_tokens and ids_crc32.
    """
    file, end = tokenizer_file(tokenizer), np.array([end_id], "<u4").tobytes()

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[bytes] = []
        size = 0
        for doc, ids in coded(encoder(file).ids, batches):
            some.append(frame(doc, ids + end))
            size += len(some[-1])
            if size >= 4 << 20:
                yield pa.record_batch([pa.array(some, pa.binary())], ["frame"])
                some, size = [], 0
        yield pa.record_batch([pa.array(some, pa.binary())], ["frame"])

    spark, texts = docs.sparkSession, id_and_text(docs)
    if file_bytes:
        total = texts.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
        files = int(total // file_bytes) + 1
    else:
        files = FILES_PER_SPLIT * max(1, texts.rdd.getNumPartitions())
    (texts.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(frames, "frame binary").select(F.col("frame").cast("string")).write.text(f"{path}/records"))
    _files(spark, path).mapInArrow(_index_rows, _INDEX).write.parquet(f"{path}/index")


def _index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_INDEX).parquet(f"{path}/index")


def _prints(rows: DataFrame) -> DataFrame:
    """Per file: number of records, ids, and a fingerprint of what its records are and where they lie."""
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("n_tokens"),
                                    F.bit_xor(F.xxhash64("offset", "doc_id", "n_tokens", "ids_crc32")).alias("h"))


def _starts(sizes: DataFrame) -> DataFrame:
    """(file, first) from (file, n_tokens): ids of all earlier files, which the number in a file's name orders.

    One row per file meets in one window: three for each partition of the input, a few million for a table of 100 TB.
    """
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    w = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("file", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)).alias("first"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, read from the files.

    ``start`` counts the ids of all records before: those of the file, and those of earlier files. A damaged record raises, and
    so do files that do not hold the records of the index: missing, cut short, grown or replaced. The files are parsed once;
    what they hold is held against the index by one fingerprint per file.
    """
    found = stored(_files(spark, path).mapInArrow(_index_rows, _INDEX), "records-read")
    known = _prints(_index(spark, path))
    both = _prints(found).join(known.toDF("file", "n_", "t_", "h_"), "file", "full")
    wrong = both.where(~(F.col("n").eqNullSafe(F.col("n_")) & F.col("h").eqNullSafe(F.col("h_")))).select("file").first()
    if wrong:
        raise ValueError(f"a file differs from the index: {wrong['file']}")
    return (found.join(_starts(known), "file")
            .select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"))


def read_shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """(place, doc_id, ids): records in a random order that the seed fixes, cut out of the files by the offset index."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for content, wanted in zip(b.column(0), b.column(1)):
                    data = memoryview(content.as_buffer())
                    for x in wanted.as_py():
                        doc, ids, _ = parse(data, x["offset"])
                        yield x["place"], doc, ids.tolist()
        return _batches(rows(), [pa.int64(), pa.int64(), pa.list_(pa.int64())])

    place = F.xxhash64(F.lit(seed), "file", "offset")
    wanted = _index(spark, path).groupBy("file").agg(F.collect_list(F.struct(place.alias("place"), "offset")).alias("wanted"))
    return (_files(spark, path).join(wanted, "file").select("content", "wanted")
            .mapInArrow(cut, "place long, doc_id long, ids array<long>").orderBy("place"))
