"""The pipeline's stages against their rules, on the smallest tables."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from runledger.llm import decontaminate, jaccard

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "12 34", "en", "src1", 5)], docs.schema)
    docs, columns = docs.union(odd), docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF_DIR)
        assert docs.columns == columns
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept[name] <= {r.doc_id for r in before.select("doc_id").collect()}
    raw = {r.doc_id for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id").collect()}
    assert kept["language_id"] == raw
    classes = jaccard.jaccard_join(spark.read.parquet(f"{SF_DIR}/documents.parquet"))
    assert kept["near_duplicates"] == {r.class_id for r in classes.select("class_id").distinct().collect()}
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    bad = decontaminate.decontaminate(spark.read.parquet(f"{SF_DIR}/documents.parquet"), items).filter(F.col("contaminated"))
    assert kept["decontamination"] == kept["near_duplicates"] - {r.doc_id for r in bad.select("doc_id").collect()}
    assert 0 < len(kept["mixing"]) <= len(kept["decontamination"])


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF_DIR).orderBy("doc_id").collect()
    start = 0
    for row in rows:
        assert row.start == start
        start += row.n_tokens
