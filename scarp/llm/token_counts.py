"""Token counts of the sections of documents by offset-mapped attribution.

Whole documents are encoded once. Byte-level tokens stand for known numbers of bytes, so running sums give each token's
span in the text; spans are joined to the sections' intervals, both in order. A token that crosses a boundary counts for the
section that holds most of its bytes, at a tie for the earlier one. A section is a line with its line feed.

Null text counts as empty: one empty section without tokens. Repeated rows stay rows; an empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scarp.llm.texts import id_and_text, pieces, rows_with_text
from scarp.llm.tokens import BYTE_BPE, encoder, tokenizer_file


@lru_cache(maxsize=2)
def token_bytes(path: str) -> np.ndarray:
    """Bytes that each token id stands for: its characters in the byte alphabet, or those of a special token's string."""
    tok = encoder(path).tok
    if encoder(path).kind != "byte":
        raise ValueError("token spans need a byte-level tokenizer")
    added = {i: len(t.content.encode()) for i, t in tok.get_added_tokens_decoder().items()}
    sizes = np.zeros(tok.get_vocab_size(), np.int64)
    for t, i in tok.get_vocab().items():
        sizes[i] = added.get(i, len(t))
    return sizes


def sections(raw: bytes, ids: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """[start, end (code points), n_tokens, n_crossing] of each section of one text."""
    data = np.frombuffer(raw, np.uint8)
    breaks = np.flatnonzero(data == 10) + 1
    edges = np.unique(np.r_[0, breaks, len(data)])      # bytes
    if len(edges) == 1:
        edges = np.array([0, 0])
    n = len(edges) - 1
    ends = np.cumsum(sizes[ids])
    starts = ends - sizes[ids]
    first = np.searchsorted(edges[1:], starts, "right").clip(0, n - 1)
    last = np.searchsorted(edges[1:], ends, "left").clip(0, n - 1)
    own = first.copy()
    for i in np.flatnonzero(first < last):
        span = np.clip(edges[first[i] + 1:last[i] + 2], None, ends[i]) - np.clip(edges[first[i]:last[i] + 1], starts[i], None)
        own[i] = first[i] + int(np.argmax(span))        # the first of equals
    chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][edges]
    return [chars[:-1], chars[1:], np.bincount(own, minlength=n), np.bincount(own[first < last], minlength=n)]


def count_sections(docs: DataFrame, tokenizer: str = BYTE_BPE) -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing) per line of each row's text."""
    path = tokenizer_file(tokenizer)
    names = ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sizes = encoder(path), token_bytes(path)
        for some in pieces(rows_with_text(batches)):
            raws = [r[1] for r in some]
            got = [sections(raw, np.frombuffer(ids, "<u4"), sizes) for raw, ids in zip(raws, enc.ids(raws))]
            counts = [len(g[0]) for g in got]
            docs_ = pa.array([r[0] for r in some], pa.int64()).take(pa.array(np.repeat(np.arange(len(some)), counts)))
            cols = [docs_, pa.array(np.concatenate([np.arange(c) for c in counts]), pa.int64())]
            yield pa.record_batch(cols + [pa.array(np.concatenate([g[i] for g in got]), pa.int64()) for i in range(4)], names)

    return id_and_text(docs).mapInArrow(run, ", ".join(f"`{n}` long" for n in names))
