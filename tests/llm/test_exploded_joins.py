"""Joins of rows that an explode has multiplied: Spark sizes them as before the explode, and must not broadcast them."""

import pytest
from pyspark.sql import functions as F

from plumbline.llm.common import block_pairs
from plumbline.llm.simhash import edges_of, variants


@pytest.fixture
def broadcasting(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "10m")
    yield spark
    spark.conf.set(key, old)


def test_deletion_variants_are_never_broadcast(broadcasting):
    # A few KB of fingerprints are 64 variants each; after a shuffle adaptive execution knows their size before the explode.
    prints = broadcasting.range(2000).select(F.xxhash64("id").alias("fp"), F.col("id").alias("rep")).groupBy("fp").agg(F.min("rep").alias("rep"))
    edges = edges_of(prints.union(prints.select(F.col("fp").bitwiseXOR(F.lit(5)).alias("fp"), (F.col("rep") + 10_000).alias("rep"))))
    assert {(r.a, r.b) for r in edges.collect()} >= {(k, k + 10_000) for k in range(2000)}
    assert "BroadcastExchange" not in edges._jdf.queryExecution().executedPlan().toString()


def test_blocks_are_the_same_with_either_join(broadcasting):
    prints = broadcasting.range(300).select(F.xxhash64(F.col("id") % 50).alias("fp"), F.col("id").alias("rep"))
    rows = [sorted(map(tuple, block_pairs(variants(prints), "key", "rep", 4, exploded=x).collect())) for x in (False, True)]
    assert rows[0] == rows[1] and rows[0]
