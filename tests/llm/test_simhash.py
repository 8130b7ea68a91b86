import numpy as np
import xxhash

from scarp.llm import simhash as S
from tests.llm.conftest import HARD


def plain_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """component of each row by comparing all with all."""
    label = list(range(len(prints)))
    near = [[j for j, q in enumerate(prints) if (p[1] ^ q[1]).bit_count() <= 2] for p in prints]
    while True:
        new = [min(label[j] for j in n) for n in near]
        if new == label:
            break
        label = new
    out = {}
    for (doc, _), c in zip(prints, label):
        if doc is not None:
            out[c] = min(out.get(c, doc), doc)
    return [out.get(c) for c in label]


def test_rows_match_plain_python(spark, make_docs):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    rows = list(HARD)
    for g in range(25):
        base = list(rng.choice(words, 60))
        for k in range(6):
            t = list(base)
            for _ in range(k):
                t[rng.integers(60)] = "changed"
            rows.append((100 + 10 * g + k, " ".join(t)))
    prints = [(i, plain_print(t)) for i, t in rows]
    expect = sorted(zip([str(i) for i, _ in prints], [f"{p:016x}" for _, p in prints], [str(c) for c in plain_components(prints)]))
    got = S.near_duplicates(make_docs(rows, 5, extra=True)).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == expect


def test_fingerprints_built_to_be_near(spark):
    """Chains of one and two bits and a dense cloud, whose postings are long, against all pairs."""
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 62, 6)]
    prints = {b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 62, (12, 2))} | set(base)
    prints |= {base[0] ^ int(x) for x in rng.integers(0, 1 << 11, 150)}
    prints = sorted(prints)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    edges = (S._postings(df).repartition(4, "at", "same").sortWithinPartitions("at", "same").mapInArrow(S._links, "u long, v long"))
    from scarp.operators.components import connected
    found = {r.node: r.label for r in connected(edges.selectExpr("0 AS g", "u", "v")).collect()}
    expect = plain_components([(p, p) for p in prints])
    assert [found.get(p, p) for p in prints] == expect


def test_postings_that_span_batches():
    import pyarrow as pa
    fp = np.arange(200, dtype=np.int64)                     # same six high bytes: one posting
    at, same = np.zeros(200, np.int8), np.zeros(200, np.int64)
    index = next(i for i, (_, p, q) in enumerate(S._free_masks()) if (p, q) == (0, 1))
    batch = lambda a, b: pa.record_batch([pa.array(at[a:b] + index, pa.int8()), pa.array(same[a:b]), pa.array(fp[a:b])], ["at", "same", "fp"])
    out = [r for b in S._links(iter([batch(0, 70), batch(70, 71), batch(71, 71), batch(71, 200)])) for r in b.to_pylist()]
    assert {r["u"] for r in out} == set(range(1, 200)) and {r["v"] for r in out} == {0}


def test_one_of_each_group_stays(make_docs):
    long = " ".join(f"word{i}" for i in range(200))
    rows = [(5, long), (3, long), (9, long.upper()), (1, "something else entirely here"), (4, None), (2, ""), (None, "no id")]
    kept = S.keep_one(make_docs(rows, extra=True))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "None"]
    assert kept.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_empty(make_docs):
    assert S.near_duplicates(make_docs([])).count() == 0 and S.keep_one(make_docs([])).count() == 0


def test_rows_that_share_an_id_but_not_a_text_stay(make_docs):
    rows = [(1, "one text of its own here"), (1, "another text of its own there"), (1, "one text of its own here"), (2, None), (3, None)]
    for parts in (1, 3):
        got = sorted((r.doc_id, r.text or "") for r in S.keep_one(make_docs(rows[::parts] if parts == 1 else rows[::-1], parts, extra=True)).collect())
        assert got == [(1, "another text of its own there"), (1, "one text of its own here"), (2, "")]
