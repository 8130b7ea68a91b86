import hashlib
import random

import numpy as np
import pytest

from scarp.llm import recompress as R
from tests.llm.conftest import HARD


def plain(rows):
    """doc_id -> (n_words, n_removed, sha256 of the kept words), windows compared as lists of words."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k:k + 20])
            if key in seen:
                gone[k:k + 20] = [True] * 20
            seen.add(key)
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def corpus(seed, n=250):
    rnd = random.Random(seed)
    base = [[rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 200))] for _ in range(50)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rnd.randint(0, 5)):
            q = rnd.choice(base)
            a = rnd.randint(0, len(q))
            w += q[a:a + rnd.randint(0, 60)]
            if rnd.random() < .3:
                w += [rnd.choice("xy")] * rnd.randint(1, 70)
            if rnd.random() < .2:
                w += ["p", "q"] * rnd.randint(1, 40)
        rows.append((i, "\n".join(w) if rnd.random() < .5 else " ".join(w)))
    return rows


@pytest.mark.parametrize("seed,bucket", [(1, 1 << 24), (2, 4000)])
def test_rows_match_plain_python(make_docs, monkeypatch, seed, bucket):
    monkeypatch.setattr(R, "BUCKET_BYTES", bucket)
    hard = [(1000 + i, t) for i, t in {i: t for i, t in HARD if i is not None}.items()]
    rows = corpus(seed) + hard
    got = {r.doc_id: tuple(r)[1:] for r in R.repeats(make_docs(rows, 5, extra=True)).collect()}
    assert got == plain(rows)


def test_starts_are_decided_by_their_surroundings():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 62, 20000).astype(np.uint64) * np.uint64(3)
    x = x[rng.integers(0, 40, 20000)]                       # few words, so pairs and runs recur
    all_of = set(R.symbol_starts(x, np.array([0])).tolist())
    for b in rng.integers(0, 19980, 400):
        inside = set(R.symbol_starts(x[b:b + 14], np.array([0])).tolist())
        assert (7 in inside) == (int(b) + 7 in all_of)
    gaps = np.diff(sorted(all_of))
    assert gaps.max() <= R.CAPS[-1] and 20 - 2 * R.CONTEXT + 1 >= R.CAPS[-1]


def test_repeated_rows_and_missing_ids(make_docs):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (2, text), (None, text)]
    got = sorted((str(r.doc_id), r.n_removed) for r in R.repeats(make_docs(rows, extra=True)).collect())
    assert got == [("1", 30), ("1", 30), ("2", 30), ("None", 0)]        # a missing id comes first


def test_texts_lose_their_repeats(make_docs):
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(1, "first\n" + passage + "\nend"), (2, "  start  here\n" + passage + "\n tail "), (3, None), (4, passage)]
    out = {r.doc_id: r for r in R.without_repeats(make_docs(rows, extra=True)).collect()}
    assert out[1].text == rows[0][1]
    assert out[2].text == "  start  here\ntail " and out[2].n_chars == len(out[2].text)
    assert out[3].text is None and out[4].text == "" and out[4].places == "y"


def test_empty(make_docs):
    assert R.repeats(make_docs([])).count() == 0 and R.without_repeats(make_docs([])).count() == 0
