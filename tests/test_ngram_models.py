"""The n-gram models keep little in memory: no cached folds, small splits of the vectors' file; strengths as by cross-validation."""

from __future__ import annotations

import random

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from plumbline.operators import shortcuts as S


@pytest.fixture
def rows(spark):
    r = random.Random(2)
    made = [(k, k % 2, k % 3, (k // 6) % 2, [r.choice(["ab", "cd", "ef"] if k % 2 and r.random() < 0.4 else ["xy", "zw", "ab", "uv"]) for _ in range(8)]) for k in range(240)]
    return S.hashed(spark.createDataFrame(made, "id long, y int, fold int, inner int, words array<string>").repartition(4), ["word"], 256)


def test_strength_is_that_of_cross_validation_and_nothing_is_cached(spark, rows, monkeypatch):
    made = S.IDF(inputCol="tf_word", outputCol="features", minDocFreq=2).fit(rows).transform(rows).select("y", "features", "inner")
    lr = LogisticRegression(labelCol="y", featuresCol="features", elasticNetParam=0.0, regParam=0.01, maxIter=15)
    strengths = (0.01, 10.0, 1.0)
    grid = ParamGridBuilder().addGrid(lr.regParam, list(strengths)).build()
    want = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol="y"), numFolds=2, foldCol="inner", seed=7).fit(made).bestModel
    for name in ("cache", "persist"):
        monkeypatch.setattr(type(rows), name, lambda *x, **y: pytest.fail("rows are cached"))
    got = S.chosen_model(rows, "word", strengths, 256).stages[-1]
    assert got.getRegParam() == want.getRegParam() and abs(got.coefficients.toArray() - want.coefficients.toArray()).max() < 1e-6


def test_vectors_are_read_in_small_splits(spark, rows, monkeypatch):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    monkeypatch.setattr(S, "SPLIT", "2k")
    some = S.hashed(spark.range(400).select("id", F.array_repeat(F.col("id").cast("string"), 3).alias("words")).coalesce(1), ["word"], 64)
    assert max(r["count"] for r in some.groupBy(F.spark_partition_id()).count().collect()) <= 200 and some.count() == 400
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert some.sparkSession.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
    assert [S.in_bytes(x) for x in ("16m", "128MB", "134217728b", "7", "2k", "1g")] == [16 << 20, 128 << 20, 134217728, 7, 2048, 1 << 30]
