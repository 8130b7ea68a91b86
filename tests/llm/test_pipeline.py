"""The pipeline stage by stage on the smallest table against the same rules in plain Python."""
import corpus_pipeline
from scarp.llm.queries import oracle_sql, queries
from tests.llm.test_recompress import plain
from tests.llm.test_resemblance import plain_groups
from tests.llm.test_tokens import check_packing

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    quality, near, substring, packing = (f for _, f in corpus_pipeline.STAGES)
    good = quality(spark, docs, SF)
    assert good.columns == columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id: r.text for r in good.collect()}
    assert not any(labels.get(i) == 0 for i in kept) and len(kept) > 100
    assert all(i in kept for i, t in ((r.doc_id, r.text) for r in docs.collect()) if labels.get(i) == 1 and len(t.split()) >= 60)
    one = near(spark, good, SF)
    assert one.columns == columns
    left = {r.doc_id: r.text for r in one.collect()}
    assert set(left) == set(plain_groups(list(kept.items())))
    cut = substring(spark, one, SF)
    expect = plain(list(left.items()))
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert cut.columns == columns
    assert {i: len(t.encode().split()) for i, t in texts.items()} == {i: n - gone for i, (n, gone, _) in expect.items()}
    check_packing(list(texts.items()), packing(spark, cut, SF).collect(), 4096)


def test_run_is_its_stages(spark):
    pieces = corpus_pipeline.run(spark, SF)
    docs = pieces.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert docs and all(r["sum(length)"] == r["max(doc_tokens)"] for r in docs)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14))
    assert set(oracle_sql()) <= set(queries())
