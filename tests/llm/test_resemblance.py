"""Near-duplicates on five-word shingles against all pairs in plain Python."""
import random

import corpus_pipeline
import numpy as np
from scarp.llm import resemblance as R
from scarp.llm.simhash import keep_one
from tests.llm.conftest import HARD


def plain_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_groups(rows):
    """The smallest doc_id of each row's group, comparing all with all."""
    sets, label = [plain_set(t) for _, t in rows], list(range(len(rows)))
    near = [[j for j, b in enumerate(sets) if a == b or 5 * len(a & b) >= 4 * len(a | b)] for a in sets]
    while (new := [min(label[j] for j in n) for n in near]) != label:
        label = new
    out = {}
    for (doc, _), c in zip(rows, label):
        if doc is not None:
            out[c] = min(out.get(c, doc), doc)
    return [out.get(c) for c in label]


def edited(base, rnd, k):
    w = list(base)
    for _ in range(k):
        w[rnd.randrange(len(w))] = f"new{rnd.randrange(10 ** 6)}"
    return " ".join(w)


def test_groups_match_plain_python(make_docs, monkeypatch):
    monkeypatch.setattr(R, "TILE", 8)       # blocks of several tiles
    rnd = random.Random(4)
    common = "one line that stands in very many documents of this table".split()
    rows = list(HARD)
    for g in range(25):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([6, 12, 30, 60, 200]))]
        rows += [(100 + 10 * g + k, edited(base + common, rnd, k // 2)) for k in range(8)]
        rows.append((1000 + g, edited(base * 2, rnd, 0)))
    base = [f"v{i}" for i in range(150)]
    rows += [(2000 + k, edited(base, rnd, k % 5)) for k in range(70)]
    expect = sorted(zip([str(i) for i, _ in rows], map(str, plain_groups(rows))))
    got = R.near_duplicates(make_docs(rows, 5, extra=True)).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == expect
    assert len({c for _, c in expect}) < len(rows) * 2 / 3


def test_similarity_at_its_limit():
    sets = [np.arange(9), np.arange(1, 10), np.arange(8), np.arange(2, 11)]
    assert R.similar(sets, np.zeros(4), False) == [(1, 0), (2, 0), (3, 1)]         # 8 of 10 reach it, 7 of 11 do not
    assert R.similar(sets, np.array([0, 0, 1, 1]), True) == [(2, 0), (3, 1)]


def test_stage_finds_near_copies_beyond_two_bits(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    near = dict(corpus_pipeline.STAGES)["near-dedup"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    left = {r.doc_id for r in near(spark, docs, "").collect()}
    assert left == set(plain_groups(rows))
    assert left < {r.doc_id for r in keep_one(docs).collect()}


def test_one_row_of_each_group_stays_whatever_its_id(make_docs):
    text = lambda c, n=100, **at: " ".join(at.get(f"_{i}", f"{c}{i}") for i in range(n))
    w, z, k = text("w"), text("z"), text("k")
    rows = [(1, w), (None, text("w", _50="x")), (None, w), (2, text("w", _50="x")), (2, z), (3, text("z", _50="x")), (4, "q " * 60), (4, "q " * 60),
            (None, z + " a"), (None, "u v w"), (None, "u V w"), (None, None), (None, ""), (5, k), (5, text("k", _99="x")), (6, text("m")), (6, text("n"))]
    for shuffled in (rows, rows[::-1]):
        kept = keep_one(make_docs(shuffled, extra=True), R.near_duplicates)
        got = sorted((str(r.doc_id), (r.text or "")[:2].lower()) for r in kept.collect())
        assert got == [("1", "w0"), ("2", "z0"), ("4", "q "), ("5", "k0"), ("6", "m0"), ("6", "n0"), ("None", ""), ("None", "u ")]
        assert kept.columns == make_docs(rows, extra=True).columns


def test_empty(make_docs):
    assert R.near_duplicates(make_docs([])).count() == 0 and keep_one(make_docs([]), R.near_duplicates).count() == 0
