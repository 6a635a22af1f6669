"""The two hashes of a line key are independent, and a very common line is dropped everywhere but once."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.llm.line_dedup import line_dedup, line_hashes


def test_second_hash_is_no_function_of_the_first(spark):
    """Spark's hash of (x, seed) with the column first is the hash of the seed, begun with x's hash: equal first hashes
    would give equal second ones. The pair used here must not be reproducible from h alone."""
    rows = spark.range(2000).select(F.concat(F.lit("line number "), F.col("id").cast("string")).alias("key"))
    h, g = line_hashes(F.col("key"))
    made = rows.select("key", h, g)
    assert made.select("g").distinct().count() == 2000
    from_h = F.expr("xxhash64(key, 1)")
    assert made.where(F.col("g") == from_h).count() == 0
    assert made.where(F.col("g") == F.xxhash64(F.lit(1), F.col("key"))).count() == 2000


def test_common_line_stays_in_the_last_document(spark):
    line = "this very line is in every one of the documents"
    docs = spark.createDataFrame([(k, f"{line}\nown words of document {k}, which are long enough") for k in range(300)] + [(None, line)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in line_dedup(docs).collect()}
    assert [k for k, t in out.items() if t.startswith(line)] == [299]
    assert out[None] == "" and out[0] == "own words of document 0, which are long enough"
