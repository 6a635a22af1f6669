"""Percentiles by sketch and second pass against sorting."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import joins, metrics
from plumbline.operators.percentiles import exact_percentiles

SHARES = [0.0, 0.025, 0.5, 0.95, 0.999, 1.0]


def tables():
    rng = np.random.default_rng(2)
    return {"skewed": rng.lognormal(0, 3, 40_000), "ties": rng.integers(0, 3, 5_000).astype(float), "two": np.array([1.0, 2.0]), "one": np.array([7.0]), "signs": np.concatenate([-rng.random(999), rng.random(1000)])}


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_percentiles_equal_sorted_ones(spark, accuracy):
    made = tables()
    rows = [(k, float(x)) for k, v in made.items() for x in v] + [("skewed", None), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(6)
    got = {(r.k, r.share): (r.n, r.percentile) for r in exact_percentiles(df, ["k"], F.col("x"), SHARES, accuracy).collect()}
    assert set(got) == {(k, s) for k in made for s in SHARES}
    for (k, s), (n, p) in got.items():
        assert n == len(made[k]) and p == pytest.approx(np.percentile(made[k], 100 * s), rel=1e-12, abs=1e-12)
    assert exact_percentiles(df.limit(0), ["k"], F.col("x"), [0.5]).count() == 0


def test_large_sides_are_salted(spark, monkeypatch):
    df = spark.createDataFrame([(k % 5, float(k)) for k in range(500)], "k int, x double")
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    got = {r.k: r.percentile for r in exact_percentiles(df, ["k"], F.col("x"), [0.5]).collect()}
    assert got == {k: float(np.median([x for x in range(500) if x % 5 == k])) for k in range(5)}


def test_only_a_range_is_grouped(spark):
    """With errors of at most n / 1,000 the second pass groups about 4 n / 1,000 values, not all."""
    df = spark.range(200_000).select(F.lit("a").alias("k"), F.rand(1).alias("x"))
    out = exact_percentiles(df, ["k"], F.col("x"), [0.5], 1000)
    assert out.first().n == 200_000
    plan = out._jdf.queryExecution().toString()
    assert "percentile(" not in plan


def test_weighted_percentile(spark):
    rng = np.random.default_rng(4)
    rows = [("a", float(v), float(w)) for v, w in zip(rng.random(3000), rng.random(3000), strict=True)] + [("b", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "k string, v double, w double").repartition(5)

    def plain(k, q):
        pairs = sorted((v, w) for x, v, w in rows if x == k)
        w = np.array([x for _, x in pairs])
        return float(np.interp(q, (np.cumsum(w) - w / 2) / w.sum(), [v for v, _ in pairs]))

    for q in (0.0001, 0.3, 0.5, 0.9999):
        got = {r.k: r.percentile for r in metrics.weighted_percentile(df, ["k"], "v", "w", q).collect()}
        assert got == {k: pytest.approx(plain(k, q)) for k in ("a", "b")}
