"""The pipeline's stages one by one, on the smallest tables."""

import corpus_pipeline
from tidemark.llm import suffixes

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert seen["toxicity"].keys() >= seen["near_duplicates"].keys() >= seen["benchmark"].keys() == seen["private"].keys()
    clean = suffixes.contamination(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    hit = {r.doc_id for r in clean.where("contamination.contaminated").collect()}
    assert seen["benchmark"].keys() == seen["near_duplicates"].keys() - hit
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in mixed} == seen["private"].keys() and sum(r.taken for r in mixed) > 0
