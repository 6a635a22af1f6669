"""Replicate vectors against draws made one by one, and against the multinomial bootstrap that they stand for."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import resampling as R
from plumbline.plans.catalog import proxy
from plumbline.plans.registry import QUERIES

M32 = 0xFFFFFFFF


def drawn(unit: int, rep: int) -> int:
    """A unit's multiplicity in a replicate, by whole numbers alone."""

    def mix(x):
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            x = ((x ^ (x >> shift)) * factor) & M32
        return x ^ (x >> 16)

    z = mix((unit & M32) ^ mix(((unit >> 32) + rep * 0x9E3779B9) & M32))
    return sum(z >= c for c in R.POISSON)


def number(*parts) -> int:
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def test_multiplicities_are_poisson_and_independent():
    units = np.array([number("u", k) for k in range(400)])
    m = R.multiplicities(units, 2000)
    assert (m[:, 0] == 1).all()
    assert all(m[k, r] == drawn(int(units[k]), r) for k in (0, 7, 399) for r in (1, 2, 999, 2000))
    m = m[:, 1:]
    assert abs(m.mean() - 1) < 0.01 and abs(m.var() - 1) < 0.01
    for k in range(4):
        assert abs((m == k).mean() - math.exp(-1) / math.factorial(k)) < 0.003
    assert abs(np.corrcoef(m)[np.triu_indices(400, 1)]).max() < 0.13  # units
    assert abs(np.corrcoef(m.T[:400])[np.triu_indices(400, 1)]).max() < 0.30  # replicates


def test_sums_equal_plain_ones(spark):
    rows = [(f"k{i % 3}" if i % 10 else None, i // 4, i % 5, 1 if i % 7 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, g int, v int, w int").repartition(7)
    want = defaultdict(lambda: [0, 0])
    for k, g, v, w in rows:
        for rep in range(41):
            n = 1 if rep == 0 else drawn(number("s", g), rep)
            want[k, rep][0] += n * v
            want[k, rep][1] += n * (w or 0)
    got = R.replicate_sums(df, ["k"], R.unit_number(F.lit("s"), F.col("g")), ["v", "w"], 40)
    assert {(r.k, r.rep): [r.v, r.w] for r in got.collect()} == dict(want)
    assert R.replicate_sums(df.limit(0), ["k"], R.unit_number(F.col("g")), ["v"], 5).count() == 0
    one = {r.g: r.mult for r in R.draw_vectors(df.select("g").distinct(), R.unit_number(F.lit("s"), F.col("g")), 40).collect()}
    assert all(one[g] == [1] + [drawn(number("s", g), r) for r in range(1, 41)] for g in one)


@pytest.mark.parametrize("partitions", [1, 6])
def test_auroc_of_every_replicate(spark, partitions):
    rng = np.random.default_rng(3)
    rows = [("a" if i % 2 else "b", i // 3, float(rng.integers(0, 9)) / 8 if i % 11 else None, bool(rng.random() < 0.4)) for i in range(240)]
    rows += [("one class", 1, 0.5, True), ("one class", 2, 0.7, True)]
    df = spark.createDataFrame(rows, "k string, g int, s double, p boolean").repartition(partitions)
    got = {(r.k, r.rep): r.auroc for r in R.replicate_auroc(df, ["k"], "s", "p", R.unit_number(F.lit("s"), F.col("g")), 30).collect()}
    for k in ("a", "b"):
        for rep in range(31):
            w = [(1 if rep == 0 else drawn(number("s", g), rep), s, p) for kk, g, s, p in rows if kk == k and s is not None]
            pairs = [(m * n, (s > t) + (s == t) / 2) for m, s, p in w if p for n, t, q in w if not q]
            assert got[k, rep] == pytest.approx(sum(a * b for a, b in pairs) / sum(a for a, _ in pairs))
    assert got["one class", 0] is None
    assert R.replicate_auroc(df.limit(0), ["k"], "s", "p", R.unit_number(F.col("g")), 5).count() == 0


def test_intervals_match_the_multinomial_bootstrap(spark):
    """The spread of a mean over 300 groups, drawn 2,000 times here and by picking groups with replacement."""
    rng = np.random.default_rng(1)
    pos = rng.integers(1, 4, 300)
    hit = rng.binomial(pos, 0.7)
    df = spark.createDataFrame([(1, k, int(p), int(h)) for k, (p, h) in enumerate(zip(pos, hit, strict=True))], "k int, g int, p int, h int")
    reps = R.replicate_sums(df, ["k"], R.unit_number(F.lit("x"), F.col("g")), ["p", "h"]).select("k", "rep", (100 * F.col("h") / F.col("p")).alias("v"))
    s = R.summary(reps, ["k"], "v").first()
    picks = rng.integers(0, 300, (2000, 300))
    plain = 100 * hit[picks].sum(axis=1) / pos[picks].sum(axis=1)
    assert s.point == pytest.approx(100 * hit.sum() / pos.sum()) and s.n_valid == 2000
    assert s.se == pytest.approx(plain.std(ddof=1), rel=0.08)
    assert s.ci_low == pytest.approx(np.percentile(plain, 2.5), abs=0.5) and s.ci_high == pytest.approx(np.percentile(plain, 97.5), abs=0.5)


def test_p_values(spark):
    z = [0.0, 0.001, 0.3, 1.0, 1.96, 3.0, 6.0, 20.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select("z", R.wald_p(F.col("z"), F.lit(1.0)).alias("p")).collect()
    assert all(abs(r.p - math.erfc(r.z / math.sqrt(2))) < 1.2e-7 for r in got)
    edge = spark.range(1).select(R.wald_p(F.lit(0.0), F.lit(0.0)).alias("same"), R.wald_p(F.lit(2.0), F.lit(0.0)).alias("apart"), R.wald_p(F.lit(2.0), F.lit(None).cast("double")).alias("none")).first()
    assert (edge.same, edge.apart, edge.none) == (1.0, 0.0, None)


def test_board_of_the_ledger(spark, sf_dir):
    tiers = {r.system: r.tier for r in QUERIES["sta_09_tiers"](spark, sf_dir).collect()}
    rows = sorted(QUERIES["sta_10_board"](spark, sf_dir).collect(), key=lambda r: r["rank"])
    assert {r.system: r.tier for r in rows} == tiers and set(tiers) == {"alpha", "beta", "gamma", "delta"}
    assert [r.ba for r in rows] == sorted((r.ba for r in rows), reverse=True) and rows[0].tier == 1
    assert all(a.tier <= b.tier <= a.tier + 1 for a, b in zip(rows, rows[1:], strict=False))
    assert all(r.ci_low <= r.ba <= r.ci_high and r.rank_low <= r["rank"] <= r.rank_high + 0.5 for r in rows)


def test_planted_contamination_is_flagged(spark, monkeypatch):
    """A system that knows one source's labels is flagged there and nowhere else."""
    from plumbline.plans import views

    rng = np.random.default_rng(5)
    rows = []
    for i in range(6000):
        for s, skill in (("a", 0.75), ("b", 0.7), ("c", 0.72), ("d", 0.71)):
            source = f"s{i % 4}"
            rows.append(("job", source, s, i, bool(i // 4 % 2), bool(rng.random() < (0.99 if (s, source) == ("b", "s2") else skill))))
    df = spark.createDataFrame(rows, "subtask string, source string, system string, row_id int, positive boolean, correct boolean")
    monkeypatch.setattr(views, "proxy", lambda *_: df)
    got = {(r.source, r.system): r for r in views.contamination_signal(spark, "").collect()}
    assert len(got) == 16 and {k for k, r in got.items() if r.flag} == {("s2", "b")}
    assert all(r.ci_low <= r.excess <= r.ci_high and r.n == 1500 for r in got.values())


def test_no_table_of_draws(spark, sf_dir):
    """Replicates need no window over groups and no join with draws."""
    from plumbline.plans.statistics import replicates

    plan = replicates(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert "Window" not in above and "Join" not in above
    assert proxy(spark, sf_dir, "judgments").count() > 0
