"""The pipeline's stage ``simhash`` on what its predecessors keep, against all pairs of five-word shingle sets."""

import os
from collections import Counter

import corpus_pipeline
from test_near_copies import plain_components

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stage_keeps_one_of_each_group_of_similarity_0_8(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:2]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), f"rule-{name}")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    groups = plain_components([t for _, t in rows])
    kept = Counter(r["doc_id"] for r in corpus_pipeline.drop_copies(spark, docs, SF).select("doc_id").collect())
    assert kept == Counter(rows[k][0] for k, g in enumerate(groups) if k == g)
