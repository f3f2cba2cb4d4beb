"""The pipeline on the smallest tables."""

import os

import pytest

import corpus_pipeline

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_each_stage_keeps_columns_and_its_decisions_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    names = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toArrow())
        assert docs.columns == corpus_pipeline.COLUMNS
        names.append((name, docs.count()))
    counts = dict(names)
    assert before > counts["quality_rules"] > counts["near_dedup"] == counts["pii"]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.filter("NOT exact").isEmpty()
    assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
