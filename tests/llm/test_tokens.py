import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from scarp.llm import bpe, packing, records, token_counts
from scarp.llm.tokens import BYTE_BPE, WORD_BPE, Remembered, TextEncoder, tokenizer_file
from tests.llm.conftest import HARD


def library(name):
    return Tokenizer.from_file(tokenizer_file(name))


def texts(seed=1, n=1500):
    rnd = random.Random(seed)
    odd = list("abAB'stΣİ \t\n\r\x0b\x0c\x1c\x1f\x85\xa0　 éﬁÅ1९!?.,<|>日本😀̱̈́\x01") + [", ", ". ", "word,", "Été. ", "<|endoftext|>"]
    even = list("abAB'sétΣ1!?.,<|>日😀̈") + ["the", "ing"]
    out = ["".join(rnd.choice(odd) for _ in range(rnd.randint(0, 60))) for _ in range(n)]
    out += [" ".join("".join(rnd.choice(even) for _ in range(rnd.randint(1, 6))) + ("\n" + rnd.choice(even) if rnd.random() < .2 else "")
                     for _ in range(rnd.randint(1, 20))) for _ in range(n)]
    return out + [t for _, t in HARD if t is not None] + [" a b", "a b ", "\na b", "a b\n", "\n", "a\n b", "a  b", "don't\n'll"]


@pytest.mark.parametrize("name", [WORD_BPE, BYTE_BPE])
def test_ids_are_the_library_s(name):
    lib, enc = library(name), TextEncoder(tokenizer_file(name))
    some = texts()
    expect = [lib.encode(t, add_special_tokens=False).ids for t in some]
    assert enc.kind in ("word", "byte")
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.ids([t.encode() for t in some])] == expect
    assert [np.frombuffer(enc.ids([t.encode()])[0], "<u4").tolist() for t in some[:400]] == expect[:400]


@pytest.mark.parametrize("name", [WORD_BPE, BYTE_BPE])
def test_own_merging_encodes_and_decodes_like_the_library(name):
    lib, own = library(name), bpe.Bpe(tokenizer_file(name))
    for t, (ids, text) in zip(texts(2), own.both_ways([t.encode() for t in texts(2)])):
        expect = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expect
        assert text.decode() == lib.decode(expect, skip_special_tokens=False)


def test_short_and_long_words_merge_alike():
    own, rnd = bpe.Bpe(tokenizer_file(BYTE_BPE)), random.Random(4)
    for _ in range(200):
        word = "".join(rnd.choice("abcdeinthr") for _ in range(rnd.randint(2, 120)))
        ids = [own.vocab[c] for c in word]
        assert own.merge(ids) == own._merge_long(ids)


def test_memory_of_stretches_is_bounded(monkeypatch):
    monkeypatch.setattr("scarp.llm.tokens.GENERATION", 50)
    seen = Remembered(lambda new: [k * 2 for k in new])
    for i in range(0, 2000, 20):
        keys = list(range(i, i + 30))
        assert seen.look_up(keys) == [k * 2 for k in keys]
        assert len(seen) < 120 and len(seen.old) < 120


def test_encode_decode_rows(make_docs):
    lib = library(WORD_BPE)
    got = sorted(map(tuple, bpe.encode_decode(make_docs(HARD, extra=True)).collect()), key=str)
    expect = []
    for i, t in HARD:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        expect.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(expect, key=str)
    assert bpe.encode_decode(make_docs([])).count() == 0
    some = bpe.encode_decode(make_docs([(1, "Hello world")]), texts=True).first()
    assert some.decoded == lib.decode(some.ids, skip_special_tokens=False)


def check_packing(rows, pieces, window):
    lib = library(WORD_BPE)
    wanted = {}
    for i, t in rows:
        wanted.setdefault(i, []).append(np.array(lib.encode(t or "", add_special_tokens=False).ids + [packing.END_ID], "<u4"))
    got = {}
    for p in pieces:
        got.setdefault(p.doc_id, []).append(p)
    assert got.keys() == wanted.keys()
    for i, ps in got.items():
        copies = len(wanted[i])
        ids = wanted[i][0]
        assert sum(p.length for p in ps) == copies * len(ids)
        assert all(zlib.crc32(ids[p.start:p.start + p.length].tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids) for p in ps)
        if copies == 1:
            at = 0
            for p in sorted(ps, key=lambda p: p.start):
                assert p.start == at
                at += p.length
    windows = {}
    for p in pieces:
        windows.setdefault(p.sequence_id, []).append(p)
    fill = []
    for ps in windows.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= window
        fill.append(at)
    return fill


@pytest.mark.parametrize("parts", [1, 3, 70])
def test_packing_keeps_every_id_once(make_docs, parts):
    rnd = random.Random(parts)
    rows = HARD + [(100 + i, " ".join(rnd.choice(["alpha", "be", "gamma"]) for _ in range(rnd.randint(0, 300)))) for i in range(200)]
    pieces = packing.pack(make_docs(rows, parts, extra=True), window=512, open_windows=4).collect()
    fill = check_packing(rows, pieces, 512)
    assert sum(1 for f in fill if f < 512 - packing.MIN_CUT) <= 1         # all but one leftover are full but for a small gap
    assert all(len(p.ids) == 4 * p.length for p in pieces)


def test_packing_of_little(make_docs):
    assert packing.pack(make_docs([])).count() == 0
    only = packing.pack(make_docs([(1, None)]), keep_ids=False).collect()
    assert [(p.doc_id, p.start, p.length, p.doc_tokens, p.offset, p.ids) for p in only] == [(1, 0, 1, 1, 0, None)]


def test_record_files(spark, make_docs, tmp_path):
    lib, path = library(BYTE_BPE), str(tmp_path / "r")
    records.write_records(make_docs(HARD, 4, extra=True), path, file_bytes=20000)
    got = sorted(records.read_records(spark, path).collect(), key=lambda r: r.start)
    order = sorted(HARD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for r, (i, t) in zip(got, order):
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == len(HARD) and len(list((tmp_path / "r/records").glob("part-*"))) > 1
    a, b = (records.read_shuffled(spark, path, s).collect() for s in (1, 2))
    assert [r.doc_id for r in a] != [r.doc_id for r in b]
    assert sorted(map(str, a and [r.ids for r in a])) == sorted(map(str, [r.ids for r in b]))
    records.write_records(make_docs([]), str(tmp_path / "e"))
    assert records.read_records(spark, str(tmp_path / "e")).count() == 0


def test_damaged_record_raises():
    good = records.frame(7, np.array([1, 70000, 3], "<u4").tobytes())
    doc, ids, end = records.parse(memoryview(good + b"\n"), 0)
    assert (doc, ids.tolist(), end) == (7, [1, 70000, 3], len(good) + 1)
    assert records.parse(memoryview(records.frame(None, b"") + b"\n"), 0)[0] is None
    for i in range(len(good)):
        bad = bytearray(good + b"\n")
        bad[i] ^= 1
        with pytest.raises(ValueError):
            records.parse(memoryview(bytes(bad)), 0)


def test_token_counts_of_sections(make_docs):
    """Against the library's own offsets, character by character."""
    lib = library(BYTE_BPE)
    got = {}
    for r in token_counts.count_sections(make_docs(HARD, extra=True)).collect():
        got.setdefault(r.doc_id, []).append((r.section, r.start, r.end, r.n_tokens, r.n_crossing))
    for i, t in HARD:
        if i in (6, None):
            continue
        t = t or ""
        edges = [0] + [k + 1 for k, c in enumerate(t) if c == "\n"] + [len(t)]
        edges = sorted(set(edges)) if t else [0, 0]
        spans = list(zip(edges, edges[1:]))
        ids = lib.encode(t, add_special_tokens=False).ids
        sizes = [len(lib.id_to_token(x)) for x in ids]
        line_of = [n for n, (a, b) in enumerate(spans) for _ in range(len(t[a:b].encode()))]
        counts, crossing, at = [0] * len(spans), [0] * len(spans), 0
        for s in sizes:
            held = line_of[at:at + s]
            own = max(sorted(set(held)), key=held.count)
            counts[own] += 1
            crossing[own] += len(set(held)) > 1
            at += s
        assert sorted(got[i]) == [(n, a, b, counts[n], crossing[n]) for n, (a, b) in enumerate(spans)]
    assert token_counts.count_sections(make_docs([])).count() == 0
