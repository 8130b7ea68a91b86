"""Whole-text token ids of a tokenizers file, one stretch of text at a time.

A tokenizer of these files never looks across white space (word kind) or across the start of a space-led word (byte kind),
so the ids of a text are those of its stretches in order. Stretches repeat, so each is encoded once and kept in two
generations of bounded size. A file of another kind, or a text with a special token's string where that matters, is
encoded whole.
"""
from __future__ import annotations

import gc
import json
import os
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")   # Spark deals out the work

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
import pyarrow.compute as pc  # noqa: E402
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from scarp.llm.texts import pieces, remembers, rows_with_text  # noqa: E402

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"
GENERATION = 400_000    # stretches kept per generation
JOINED = 300            # stretches encoded as one text
_MARKS, _MARK = b".,", {b".", b","}
# White space as Unicode has it; Python's \s adds \x1c-\x1f.
_SPACE, _INK = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
# White space of other kinds, or next to other white space (these bytes may also begin characters that are none).
_ODD = [b"\1", b"  ", b" \n", b"\n ", b"\n\n", b"\t", b"\r", b"\x0b", b"\x0c", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80",
        b"\xe2\x81\x9f", b"\xe3\x80\x80"]
_STRETCH = re.compile(rf" ?{_INK}+|{_SPACE}+(?!{_INK})|{_SPACE}+")


def tokenizer_file(name: str) -> str:
    return name if os.path.isabs(name) else public_tokenizers.path(name)


if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are laid out as little-endian 32-bit integers")


class Remembered(dict):
    """Two generations of what was learnt about stretches; the older one goes when the younger is full."""

    def __init__(self, learn):
        super().__init__()
        self.learn, self.old, self.new = learn, {}, []

    def __missing__(self, key):
        if (v := self.old.get(key)) is None:
            self.new.append(key)
        else:
            self[key] = v
        return v

    def look_up(self, keys: list) -> list:
        found = list(map(self.__getitem__, keys))
        if self.new:
            if len(self) >= GENERATION:
                self.old = dict(self)
                self.clear()
            new, self.new = list(dict.fromkeys(self.new)), []
            self.update(zip(new, self.learn(new)))
            found = [self[k] if v is None else v for k, v in zip(keys, found)]
        return found


class TextEncoder:
    """ids(texts) are what the tokenizers library returns for each text with add_special_tokens=False."""

    def __init__(self, path: str, offsets: bool = False):
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        pre, norm = j.get("pre_tokenizer") or {}, j.get("normalizer")
        steps = [x.get("type") for x in (norm or {}).get("normalizers", [])]
        self.specials = [t["content"] for t in j.get("added_tokens", [])]
        self.special_bytes = [s.encode() for s in self.specials]
        simple = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in j.get("added_tokens", []))
        first = (pre.get("pretokenizers") or [{}])[0]
        self.kind = "whole"
        if simple and steps == ["NFC", "Replace", "Lowercase"] and first.get("type") == "Split" and first.get("behavior") == "Removed":
            self.kind = "word"
        elif simple and norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.kind = "byte"
        self.seen, self.marks = Remembered(self._learn_joined if self.kind == "byte" else self._learn), {}
        vocab = self.tok.get_vocab(with_added_tokens=False) if self.kind == "byte" else {}
        self.token_bytes = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        self.token_bytes[list(vocab.values())] = list(map(len, vocab))      # a byte is a character there

    def _learn(self, new: list) -> list[bytes]:
        """Ids of new stretches. A comma or full stop after a letter is always apart, and words come with and without.

        Plain ASCII words are one pre-tokenized piece and go straight to the library's model.
        """
        if not self.marks:
            self.marks = {m: self._encode([chr(m)])[0] for m in _MARKS}
        bare = [k[:-1] if k[-1:] in _MARK and k[-2:-1].isalpha() else k for k in new]
        known = {k: self.seen.get(k) or self.seen.old.get(k) for k in bare}
        want, lead, tokenize = [], "" if self.kind == "word" else "\u0120", self.tok.model.tokenize
        for k, v in known.items():
            if v is None:
                if k.isalpha():
                    known[k] = array("I", [t.id for t in tokenize(lead + (k.lower() if self.kind == "word" else k).decode())]).tobytes()
                else:
                    want.append(k)
        known.update(zip(want, self._encode(list(map(self.text_of, want)))))
        self.seen.update(known)
        return [known[b] if b is k else known[b] + self.marks[k[-1]] for k, b in zip(new, bare)]

    def _learn_joined(self, new: list[bytes]) -> list[bytes]:
        """Ids of new stretches of the byte kind. Joined they are a text, and a token's length tells whose it is."""
        out: dict[bytes, bytes] = {}
        lead = [k for k in new if k[0] != 1]
        for i in range(0, len(lead), JOINED):
            keys = lead[i:i + JOINED]
            parts = [k if k[0] == 10 else b" " + k for k in keys]
            ids = np.frombuffer(self._encode([b"".join(parts).decode("utf-8", "replace")])[0], "<u4")
            at = np.r_[0, np.cumsum(self.token_bytes[ids])]
            ends = np.r_[0, np.cumsum(list(map(len, parts)))]
            cuts = np.searchsorted(at, ends)
            if at[-1] != ends[-1] or not np.array_equal(at[cuts], ends):    # bytes that are no UTF-8
                out.update(zip(keys, self._encode(list(map(self.text_of, keys)))))
                continue
            data = ids.tobytes()
            cuts = (4 * cuts).tolist()
            out.update(zip(keys, [data[a:b] for a, b in zip(cuts, cuts[1:])]))
        rest = [k for k in new if k[0] == 1]
        out.update(zip(rest, self._encode(list(map(self.text_of, rest)))))
        return [out[k] for k in new]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def text_of(self, key: bytes) -> str:
        """The stretch that a key stands for: in the byte kind a word takes the space before it."""
        text = key.decode("utf-8", "replace")
        if self.kind == "word" or text[:1] == "\n":
            return text
        return text[1:] if text[:1] == "\1" else " " + text

    def _ready(self, raw: bytes) -> bytes | None:
        """The text with its keys between white space (word kind) or single spaces (byte kind); None if it has no such form."""
        if self.kind == "word":
            # Lower case is what these files ask for. It is left to the library where it could meet a special token's
            # string, or a combining mark that composes with one case only.
            return raw if b"<|" in raw or b"\xcc" in raw or b"\xcd" in raw else raw.lower()
        if self.kind == "whole" or any(s in raw for s in self.special_bytes):
            return None
        if not raw:
            return b"\1"
        if raw[0] not in b" \n" and raw[-1] not in b" \n" and not any(s in raw for s in _ODD):
            # White space is single spaces and line feeds between words: a word takes the space before it, a line its feed.
            return b"\1" + raw.replace(b"\n", b" \n")
        return None

    def look_up(self, raws: list[bytes], seen: Remembered, each: int) -> list[tuple[bytes, ...] | None]:
        """For each text what ``seen`` has for its stretches, joined; ``seen`` gives tuples of ``each`` byte strings.

        The distinct stretches of all the texts are looked up once. None stands for a text to be handled whole.
        """
        ready = list(map(self._ready, raws))
        use = [i for i, r in enumerate(ready) if r is not None]
        out: list = [None] * len(raws)
        if use:
            texts = pa.array([ready[i] for i in use], pa.binary())
            split = pc.ascii_split_whitespace(texts.cast(pa.string())) if self.kind == "word" else pc.split_pattern(texts, b" ")
            coded = split.flatten().dictionary_encode()
            known = seen.look_up(coded.dictionary.cast(pa.binary()).to_pylist())
            joined = []
            for part in zip(*known) if each > 1 else [known]:
                taken = pa.array(part, pa.binary()).take(coded.indices)
                ends = np.frombuffer(taken.buffers()[1], np.int32)[split.offsets.to_numpy()]
                data = memoryview(taken.buffers()[2] or b"")
                joined.append([bytes(data[a:b]) for a, b in zip(ends, ends[1:])])
            for i, v in zip(use, zip(*joined)):
                out[i] = v
        for i, raw in enumerate(raws):
            if out[i] is None and self.kind == "byte" and not any(s in raw for s in self.special_bytes):
                keys = [b"\1" + x.encode() for x in _STRETCH.findall(raw.decode("utf-8", "replace"))]
                found = seen.look_up(keys)
                out[i] = tuple(map(b"".join, zip(*found))) if each > 1 else (b"".join(found),)
        return out

    def ids(self, raws: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        found = self.look_up(raws, self.seen, 1)
        return [self._encode([r.decode("utf-8", "replace")])[0] if v is None else v[0] for r, v in zip(raws, found)]


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """One encoder per worker and file; what it has learnt outlives the task."""
    return TextEncoder(path)


def _forget() -> None:
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        gc.collect()        # an encoder and what it has learnt hold each other


remembers("tokens", _forget)


def coded(encode, batches) -> Iterator[tuple]:
    """(doc_id, what ``encode`` gives for its text) of every row, some megabytes of text at a time."""
    for some in pieces(rows_with_text(batches)):
        yield from zip([r[0] for r in some], encode([r[1] for r in some]))
        del some
    pa.default_memory_pool().release_unused()
