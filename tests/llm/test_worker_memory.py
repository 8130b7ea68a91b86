"""What Python workers hold: an entry of a bucket costs a few dozen bytes, and no step keeps what other operators remembered."""
import random
import tracemalloc

import pyarrow as pa

from scarp.llm import recompress as R
from scarp.llm.texts import lean
from scarp.llm.tokens import WORD_BPE, encoder, tokenizer_file


def batch(n=120, size=1000, seed=0):
    rnd = random.Random(seed)
    texts = [" ".join(f"w{rnd.randrange(50000)}" for _ in range(size)) for _ in range(n)]
    texts += texts[:10]         # copies, so that some starts are repeated
    ids = list(range(len(texts)))
    return pa.record_batch([pa.array(ids, pa.int64()), pa.array(ids, pa.int64()), pa.array(texts)], ["_doc", "_hash", "text"])


def test_an_entry_of_a_bucket_is_a_few_dozen_bytes(monkeypatch):
    monkeypatch.setattr(R, "_PIECE", 100_000)
    dealt = list(R._start_entries(1)(iter([batch()])))
    entries = sum(len(R._unblob(x.as_buffer(), ("<u4", "u1", "u1"))[-1]) for b in dealt for x in b.column(2))
    step = R._repeated_starts(1)
    assert sum(b.num_rows for b in step(iter(dealt))) > 0      # imports done
    tracemalloc.start()
    for _ in step(iter(dealt)):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert entries > 30_000 and peak < 50 * entries


def test_names_by_slices_are_those_of_the_whole(monkeypatch):
    whole = list(R._start_entries(3)(iter([batch()])))
    monkeypatch.setattr(R, "_SLICE", 100)
    assert whole == list(R._start_entries(3)(iter([batch()])))


def test_a_step_forgets_what_others_remember():
    path = tokenizer_file(WORD_BPE)
    encoder(path).ids([b"some words"])
    assert list(lean(R._start_entries(3), R._OWN)(iter([batch(30)])))
    assert encoder.cache_info().currsize == 0 and len(R._VOCAB) > 1000
    encoder(path).ids([b"some words"])
    assert not list(lean(lambda batches: batches, "tokens")(iter([])))
    assert encoder.cache_info().currsize == 1 and len(R._VOCAB) == 0
    assert list(lean(lambda batches: batches)(iter([1, 2]))) == [1, 2] and encoder.cache_info().currsize == 0
