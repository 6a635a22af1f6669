"""What lies behind the first characters of a text counts too."""

from __future__ import annotations

import re

from plumbline.plans.registry import QUERIES


def test_shingles_of_whole_pages(spark, tmp_path):
    pages = [(1, "http://a.b/c", " ".join(f"w{k}" for k in range(300))), (2, None, "one"), (3, "", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    cut = lambda w: {" ".join(w[k : k + 3]) for k in range(len(w) - 2)} or {" ".join(w)} - {""}
    want = {i: "|".join(sorted(set().union(*(cut(re.findall(r"\w+", (f or "").lower())) for f in fields)))) for i, *fields in pages}
    assert {r.page_id: r.value for r in QUERIES["str_06_whole_field_shingles"](spark, str(tmp_path)).collect()} == want


def test_first_words_of_whole_texts(spark, tmp_path):
    docs = [(3, "-" * 90 + " Late word", "en", "s"), (6, "x" * 100 + " y", "en", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.word for r in QUERIES["smp_08_bucketed_targets"](spark, str(tmp_path)).collect()} == {"late", "x" * 100}
