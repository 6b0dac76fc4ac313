"""The pipeline's mixing stage gives what the budgets take, second epochs too."""

from collections import Counter

import corpus_pipeline
from gleanbin.llm import mixing


def test_stage_returns_a_row_for_each_epoch(spark, smallest):
    rows = [(k, "w " * 5, "en", "src0" if k < 30 else "src1") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = Counter(r["doc_id"] for r in mixing.op4(docs).collect())
    assert max(want.values()) == 2
    got = corpus_pipeline.mix_sources(spark, docs, smallest)
    assert got.columns == docs.columns and Counter(r["doc_id"] for r in got.collect()) == want
