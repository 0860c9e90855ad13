"""The pipeline: stages in order, each stage's rows, and planted cases."""
import corpus_pipeline as cp
from greenscan.llm import minhash, quality, toxicity

SF = "/root/testdata/sf0.01"


def test_stages_and_run(spark):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "quality_rules", "near_duplicates", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    civil = cp.drop_toxic(spark, docs, SF)
    assert civil.columns == docs.columns
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r["doc_id"] for r in toxicity.score(docs, model).where("score >= 0.5").collect()}
    a = {r["doc_id"] for r in civil.select("doc_id").collect()}
    assert a == {r["doc_id"] for r in docs.select("doc_id").collect()} - bad
    civil = civil.checkpoint()
    good = cp.keep_quality(spark, civil, SF).checkpoint()
    b = {r["doc_id"] for r in good.select("doc_id").collect()}
    assert b == {r["doc_id"] for r in quality.quality_report(civil).where("kept").select("doc_id").collect()}
    c = {r["doc_id"] for r in cp.drop_near_duplicates(spark, good, SF).select("doc_id").collect()}
    assert c == {r["doc_id"] for r in minhash.near_duplicates(good).where("kept").select("doc_id").collect()}
    out = cp.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} == c
    assert len(out) == sum(1 for r in out if 0 < r["length"] <= 4096)


def test_odd_rows_pass_through(spark, odd_docs):
    docs = odd_docs
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, SF).checkpoint()
        if name != "packing":
            assert docs.columns == odd_docs.columns
    ids = [r["doc_id"] for r in docs.collect()]
    assert 5 in ids and 6 not in ids and 8 not in ids and 0 not in ids


def test_empty(spark, no_docs):
    docs = no_docs
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
