"""Bounded-space online packing of token sequences.

A task keeps ``open_windows`` windows. A document is cut at full windows; its rest goes to the open window that it fits
best. When none fits, the fullest is emitted, topped up with a cut of the rest if the gap is worth a piece (``min_cut``),
else padded. At its end a task merges what is open into full windows and has one leftover of under a window; leftovers of
``FAN_IN`` tasks at a time are merged in the same way until one is left, so no task ever sees more than ``FAN_IN`` of them.

Each id lies in exactly one piece. Null text counts as empty and has the end id only. Repeated rows are packed as rows.
Sequence ids are unique, and gapless offsets start at zero in each; an empty table gives an empty result.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarp.llm.texts import id_and_text, lean, stored
from scarp.llm.tokens import WORD_BPE, coded, encoder, tokenizer_file

WINDOW, OPEN_WINDOWS, MIN_CUT, END_ID = 4096, 16, 16, 2
FAN_IN = 64
_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
           "ids binary, task long, leftover boolean")
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
                   + [("ids", pa.binary()), ("task", pa.int64()), ("leftover", pa.bool_())])


@dataclass
class Piece:
    doc_id: int | None
    start: int
    doc_tokens: int
    ids: bytes

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (Piece(self.doc_id, self.start, self.doc_tokens, self.ids[:4 * n]),
                Piece(self.doc_id, self.start + n, self.doc_tokens, self.ids[4 * n:]))


@dataclass
class Window:
    fill: int = 0
    pieces: list[Piece] = field(default_factory=list)

    def add(self, p: Piece) -> None:
        self.pieces.append(p)
        self.fill += p.length


class Packer:
    """Rows of packed pieces; ``first`` is the first sequence id of this task."""

    def __init__(self, window: int, most: int, min_cut: int, task: int, first: int, keep_ids: bool):
        self.window, self.most, self.min_cut = window, most, min_cut
        self.task, self.sequence, self.keep_ids = task, first, keep_ids
        self.open: list[Window] = []
        self.rows: list[tuple] = []

    def emit(self, w: Window, leftover: bool = False) -> None:
        at = 0
        for p in w.pieces:
            self.rows.append((p.doc_id, p.start, p.length, zlib.crc32(p.ids), p.doc_tokens, self.sequence, at,
                              p.ids if leftover or self.keep_ids else None, self.task, leftover))
            at += p.length
        self.sequence += 1

    def place(self, p: Piece) -> None:
        """Best fit among the open windows."""
        while p.length >= self.window:
            head, p = p.cut(self.window)
            self.emit(Window(self.window, [head]))
        if not p.length:
            return
        room = self.window - p.length
        fits = [w for w in self.open if w.fill <= room]
        if fits:
            best = max(fits, key=lambda w: w.fill)
            best.add(p)
            if best.fill == self.window:
                self.emit(best)
                self.open.remove(best)
            return
        if len(self.open) >= self.most:
            fullest = max(self.open, key=lambda w: w.fill)
            self.open.remove(fullest)
            if self.window - fullest.fill >= self.min_cut:
                head, p = p.cut(self.window - fullest.fill)
                fullest.add(head)
            self.emit(fullest)
        self.open.append(Window(p.length, [p]))

    def merge(self) -> None:
        """Fill up the open windows in turn; under one window is left, and goes out as the leftover."""
        last = Window()
        for w in sorted(self.open, key=lambda w: -w.fill):
            for p in w.pieces:
                while last.fill + p.length >= self.window:
                    head, p = p.cut(self.window - last.fill)
                    last.add(head)
                    self.emit(last)
                    last = Window()
                if p.length:
                    last.add(p)
        self.open = []
        if last.pieces:
            self.emit(last, leftover=True)

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows)) or [()] * len(_ARROW)
        self.rows = []
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)


def _first(level: int, task: int) -> int:
    return level << 57 | task << 32


def _merged(left: DataFrame, level: int, window: int, keep_ids: bool) -> DataFrame:
    """Leftovers of FAN_IN tasks at a time, in the order of tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = None
        for b in batches:
            for r in b.to_pylist():
                if packer is None or packer.task != r["grp"]:
                    if packer:
                        packer.merge()
                        yield packer.batch()
                    packer = Packer(window, 1, 0, r["grp"], _first(level, r["grp"]), keep_ids)
                    packer.open.append(Window())
                packer.open[0].add(Piece(r["doc_id"], r["start"], r["doc_tokens"], r["ids"]))
        if packer:
            packer.merge()
            yield packer.batch()

    cols = ["doc_id", "start", "doc_tokens", "ids", "task", "offset"]
    grouped = left.select(*cols, F.floor(F.col("task") / FAN_IN).alias("grp"))
    return grouped.repartition("grp").sortWithinPartitions("grp", "task", "offset").mapInArrow(run, _SCHEMA)


def pack(docs: DataFrame, tokenizer: str = WORD_BPE, window: int = WINDOW, open_windows: int = OPEN_WINDOWS,
         min_cut: int = MIN_CUT, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    ``keep_ids`` False leaves ids null and keeps their checksum only.
    """
    path, end = tokenizer_file(tokenizer), np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(path), TaskContext.get().partitionId()
        packer = Packer(window, open_windows, min_cut, task, _first(0, task), keep_ids)
        for doc, ids in coded(enc.ids, batches):
            ids += end
            packer.place(Piece(doc, 0, len(ids) // 4, ids))
            if len(packer.rows) >= 2000:
                yield packer.batch()
        packer.merge()
        yield packer.batch()

    done, level = [], 0
    part = stored(id_and_text(docs).mapInArrow(lean(run, "tokens"), _SCHEMA), "packed-0")
    while True:
        done.append(part.where(~F.col("leftover")))
        left = part.where("leftover")
        tasks = left.agg(F.countDistinct("task"), F.max("task")).first()
        if tasks[0] <= 1:
            done.append(left)
            break
        level += 1
        part = stored(_merged(left, level, window, keep_ids), f"packed-{level}")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    ids = F.col("ids") if keep_ids else F.lit(None).cast("binary").alias("ids")
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", ids)
