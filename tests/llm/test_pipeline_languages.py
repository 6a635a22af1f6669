"""The language stage over tables without languages."""

from __future__ import annotations

import corpus_pipeline as P


def test_pipeline_keeps_texts_of_a_table_without_languages(spark):
    made = [(1, "Some words to read", None), (2, "日本語", None), (3, "12 34 ...", None), (4, "", None), (5, None, None)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")
    assert {r.doc_id for r in P.language_id(spark, docs, "").collect()} == {1, 2}
    some = spark.createDataFrame([(6, None, "en"), (7, "...", "de"), *made], "doc_id long, text string, lang string")
    assert {r.doc_id for r in P.language_id(spark, some, "").collect()} == {1, 2}
    assert P.language_id(spark, docs.limit(0), "").count() == 0
