"""Byte-pair encoding and decoding with a contiguous rank array per word.

A word holds its symbols (the parts between its boundaries) and, beside them, the merge rank of each adjacent pair in one
contiguous list. The smallest rank is looked for by a scan, its boundary is deleted, and the two ranks beside it are
refreshed, until no pair can merge. A word of more than ``SHORT`` symbols keeps its boundaries in linked arrays and its
ranks in a heap instead, in the same order of merges, so that a text of one endless word costs n log n.

The tokenizer file gives vocabulary, merges, normalizer and pre-tokenizer; the merging and the decoding are done here.
Null text counts as empty; an empty text has no ids and decodes to the empty text. Repeated rows stay rows.
"""
from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from scarp.llm.texts import id_and_text
from scarp.llm.tokens import GENERATION, WORD_BPE, Remembered, TextEncoder, coded, tokenizer_file

SHORT = 128
_NONE = 1 << 60


class Bpe:
    """Encoder and decoder of a tokenizers BPE file."""

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        model = j["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("a plain BPE file is needed")
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {self.vocab[a] << 32 | self.vocab[b]: r for r, (a, b) in enumerate(merges)}
        self.merged = [self.vocab[a + b] for a, b in merges]
        self.special = {t["content"]: t["id"] for t in j.get("added_tokens", [])}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.text_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.spaced = j.get("decoder") is None          # without a decoder tokens are joined by spaces
        self.cut = TextEncoder(path)
        self.seen, self.words = Remembered(self._learn), {}

    def merge(self, ids: list[int]) -> list[int]:
        if len(ids) > SHORT:
            return self._merge_long(ids)
        find, merged = self.rank.get, self.merged
        ids = list(ids)
        ranks = [find(a << 32 | b, _NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            i = ranks.index(best)
            ids[i] = merged[best]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = find(ids[i] << 32 | ids[i + 1], _NONE)
            if i:
                ranks[i - 1] = find(ids[i - 1] << 32 | ids[i], _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        find, merged, n = self.rank.get, self.merged, len(ids)
        ids, nxt, prev = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := find(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            k = nxt[i]
            if ids[i] != a or k >= n or ids[k] != b:
                continue                                # one of its symbols has gone
            ids[i], ids[k] = merged[r], -1
            nxt[i] = nxt[k]
            if nxt[i] < n:
                prev[nxt[i]] = i
            for left, right in ((prev[i], i), (i, nxt[i])):
                if left >= 0 and right < n and (q := find(ids[left] << 32 | ids[right])) is not None:
                    heapq.heappush(heap, (q, left, ids[left], ids[right]))
        return [x for x in ids if x >= 0]

    def word(self, piece: str) -> tuple[bytes, bytes]:
        """(ids, their decoded form) of one pre-tokenized piece in the file's byte alphabet."""
        if (known := self.words.get(piece)) is None:
            ids = self.merge([self.vocab[s] for s in (*piece[:-1], piece[-1] + self.end)])
            if len(self.words) >= GENERATION:
                self.words.clear()
            known = self.words[piece] = self._pair(ids)
        return known

    def _pair(self, ids: list[int]) -> tuple[bytes, bytes]:
        return np.array(ids, "<u4").tobytes(), self.decode(ids).encode() if self.spaced else b""

    def _joined(self, parts: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
        if len(parts) == 1:
            return parts[0]
        return b"".join(p[0] for p in parts), b" ".join(p[1] for p in parts)

    def pieces(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        norm = self.tok.normalizer.normalize_str(text) if self.tok.normalizer else text
        return self.tok.pre_tokenizer.pre_tokenize_str(norm)

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """(ids, their decoded form) of a text with its special tokens' strings."""
        out = []
        for part in self.split.split(text) if self.split else [text]:
            if part in self.special:
                out.append(self._pair([self.special[part]]))
            elif part:
                out += [self.word(piece) for piece, _ in self.pieces(part)]
        return self._joined(out)

    def decode(self, ids) -> str:
        """As the library does without skipping special tokens."""
        if self.spaced:
            return " ".join(self.text_of[i] for i in ids)
        return self.tok.decode(list(ids), skip_special_tokens=False)

    def _learn(self, new: list) -> list[tuple[bytes, bytes]]:
        """(ids, decoded form with a space after it) of new stretches."""
        out: list = [None] * len(new)
        # ASCII stretches are pre-tokenized in one call: normalizing keeps their lengths and the spaces between them.
        plain = [i for i, x in enumerate(new) if x and x.isascii() and b"<|" not in x] if self.cut.kind == "word" else []
        ends, at = [], 0
        for i in plain:
            at += len(new[i]) + 1
            ends.append(at)
        found: list[list] = [[] for _ in plain]
        k = 0
        for piece, (start, _) in self.pieces(b" ".join(new[i] for i in plain).decode()) if plain else []:
            while start >= ends[k]:
                k += 1
            found[k].append(self.word(piece))
        for i, parts in zip(plain, found):
            out[i] = self._joined(parts)
        both = [self.encode(self.cut.text_of(x)) if v is None else v for x, v in zip(new, out)]
        return [(ids, text + b" " if ids else b"") for ids, text in both]

    def both_ways(self, raws: list[bytes]) -> list[tuple[bytes, bytes]]:
        """For each text (ids as little-endian unsigned 32-bit integers, text decoded from them in UTF-8)."""
        out = []
        for raw, v in zip(raws, self.cut.look_up(raws, self.seen, 2)):
            ids, text = v or self.encode(raw.decode("utf-8", "replace"))
            if not self.spaced:
                text = self.decode(np.frombuffer(ids, "<u4").tolist()).encode()
            elif v:
                text = text[:-1]        # each stretch ends in the space that parts it from the next
            out.append((ids, text))
        return out


@lru_cache(maxsize=2)
def coder(path: str) -> Bpe:
    return Bpe(path)


def encode_decode(docs: DataFrame, tokenizer: str = WORD_BPE, texts: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row; ``texts`` adds the ids and the decoded text."""
    path = tokenizer_file(tokenizer)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for b in batches:
            cols: list[list] = [[] for _ in range(6 if texts else 4)]
            for doc, (ids, text) in coded(bpe.both_ways, iter([b])):
                row = [doc, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()]
                for c, v in zip(cols, row + ([np.frombuffer(ids, "<u4").tolist(), text.decode()] if texts else [])):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.string()]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names[:len(cols)])

    return id_and_text(docs).mapInArrow(run, schema + (", ids array<long>, decoded string" if texts else ""))
