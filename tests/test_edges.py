"""Operators on nulls, ties, single classes and empty tables; similarity joins against brute force; the ledger as a stream."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import boards, metrics, sampling, similarity
from plumbline.operators.joins import salted_join
from plumbline.streaming import ledger as L

SCORED = "name string, positive boolean, score double"


def frame(spark, rows, schema=SCORED):
    return spark.createDataFrame(rows, schema)


def test_auroc_of_ties_one_class_and_nothing(spark):
    rows = [("tie", k % 2 == 0, 0.5) for k in range(6)] + [("best", True, 0.9), ("best", False, 0.1), ("worst", True, 0.1), ("worst", False, 0.9), ("one", True, 0.3)]
    rows += [("half", True, 0.5), ("half", True, 0.9), ("half", False, 0.5), ("half", False, 0.1)]
    got = {r["name"]: r.auroc for r in metrics.auroc(frame(spark, rows), ["name"]).collect()}
    assert got == {"tie": 0.5, "best": 1.0, "worst": 0.0, "one": None, "half": 0.875}
    assert metrics.auroc(frame(spark, []), ["name"]).count() == 0


def test_confusion_counts_failures_and_missing_scores(spark):
    rows = [("a", True, 0.5, "decided"), ("a", True, 0.4, "decided"), ("a", False, 0.5, "decided"), ("a", False, None, "no_decision"), ("a", True, None, "failed"), ("b", False, 0.0, "decided")]
    c = metrics.confusion(frame(spark, rows, "name string, positive boolean, score double, outcome string"), ["name"])
    got = {r["name"]: (r.n_pos, r.n_neg, r.tp, r.tn, r.fp, r.fn, r.n_failed) for r in c.collect()}
    assert got == {"a": (3, 2, 1, 0, 1, 1, 2), "b": (0, 1, 0, 1, 0, 0, 0)}
    u = {r["name"]: r.balanced_accuracy for r in metrics.unit_metrics(c).collect()}
    assert u["b"] is None and abs(u["a"] - 50 * (1 / 3 + 0)) < 1e-9


def test_holm_and_ranks_with_ties_and_nulls(spark):
    t = frame(spark, [("x", "a", 0.01), ("x", "b", 0.01), ("x", "c", None), ("x", "d", 0.5), ("y", "a", None)], "k string, who string, p double")
    got = {(r.k, r.who): r.p_holm for r in boards.holm(t, ["k"], "p", "who").collect()}
    assert got == {("x", "a"): 0.03, ("x", "b"): 0.03, ("x", "c"): None, ("x", "d"): 0.5, ("y", "a"): None}
    r = frame(spark, [("a", 1.001), ("b", 1.004), ("c", 0.5), ("d", None)], "system string, ba double")
    assert {x.system: x["rank"] for x in boards.competition_rank(r, [], "ba", 2).collect()} == {"a": 1, "b": 1, "c": 3, "d": None}
    assert boards.holm(t.limit(0), ["k"], "p", "who").count() == boards.competition_rank(r.limit(0), [], "ba").count() == 0


@pytest.mark.parametrize("k,n,want", [(0, 0, 1.0), (0, 1, 1.0), (0, 5, 0.0625), (5, 5, 0.0625), (2, 5, 1.0), (1, 10, 0.021484375)])
def test_exact_sign_test(spark, k, n, want):
    got = spark.range(1).select(boards.binomial_two_sided(F.lit(k), F.lit(n)).alias("p")).first().p
    assert abs(got - want) < 1e-9


def test_allocation_splits_and_matches(spark):
    sizes = frame(spark, [("a", 100), ("b", 3), ("c", 0), ("d", 47)], "s string, n long")
    got = {r.s: r.take for r in sampling.allocate(sizes, 60, 10).collect()}
    assert got["b"] == 3 and got["c"] == 0 and got["a"] >= 10 and got["d"] >= 10 and 58 <= sum(got.values()) <= 60
    rows = frame(spark, [(k, None if k % 5 == 0 else "ab"[k % 2], "yes" if k % 3 else "no") for k in range(60)], "id long, s string, label string")
    split = sampling.rank_split(rows, ["s"], [("test", 0.5), ("dev", 0.5)], F.col("id")).groupBy("s", "new_split").count().collect()
    assert {(r.s, r.new_split): r["count"] for r in split} == {(None, "test"): 6, (None, "dev"): 6, ("a", "test"): 12, ("a", "dev"): 12, ("b", "test"): 12, ("b", "dev"): 12}
    m = sampling.matched(rows.where("s is not null"), ["s"], "label", 1.25, F.col("id")).groupBy("s", "label").count().collect()
    counts = {(r.s, r.label): r["count"] for r in m}
    assert all(counts[s, "yes"] <= 1.25 * counts[s, "no"] for s in "ab")
    g = sampling.group_split(rows.withColumn("grp", F.col("id") % 7), "grp", 0.3, "x").collect()
    dev = sum(r.n for r in g if r.new_split == "dev")
    assert 0.3 * 60 <= dev < 0.3 * 60 + 9 and len(g) == 7
    assert sampling.group_split(rows.limit(0), "id", 0.3, "x").count() == sampling.rank_split(rows.limit(0), ["s"], [("t", 1.0)], F.col("id")).count() == 0


@pytest.mark.parametrize("itself", [True, False])
def test_similarity_join_equals_brute_force(spark, itself):
    r = random.Random(8)
    base = [[r.randrange(60) for _ in range(r.randrange(1, 40))] for _ in range(25)]
    sets = [set(b) for b in base] + [set(b[: max(1, len(b) - 2)]) | {r.randrange(60)} for b in base] + [set(b) | {100 + k} for k, b in enumerate(base)] + [set()]
    left = {k: s for k, s in enumerate(sets) if itself or k % 2}
    right = left if itself else {k: s for k, s in enumerate(sets) if not k % 2}

    def alike(s, t):
        both = len(s & t)
        return both and (5 * both >= 4 * len(s | t) or (min(len(s), len(t)) >= 10 and 5 * both >= 4 * min(len(s), len(t))))

    want = {(a, b) for a, s in left.items() for b, t in right.items() if (a < b if itself else True) and alike(s, t)}
    df = lambda d: frame(spark, [(k, sorted(s)) for k, s in d.items()], "id long, tokens array<long>")
    got = similarity.similarity_join(df(left), df(right), itself=itself).collect()
    assert {(x.left_id, x.right_id) for x in got} == want and len(got) == len(want) > 20
    assert all(x.overlap == len(sets[x.left_id] & sets[x.right_id]) for x in got)
    assert similarity.similarity_join(df({}), df(right), itself=False).count() == 0


def test_salted_join_is_a_join(spark):
    left = frame(spark, [(k, k % 3 if k % 10 else None) for k in range(100)], "id long, k long")
    right = frame(spark, [(0, "zero"), (1, "one")], "k long, name string")
    for how in ("inner", "left"):
        plain = left.join(right, "k", how).select("id", "k", "name").collect()
        assert sorted(map(str, salted_join(left, right, ["k"], "id", how).select("id", "k", "name").collect())) == sorted(map(str, plain))


def test_ledger_streams_once_and_resumes(spark, tmp_path):
    source = str(tmp_path / "in")
    frame(spark, [(1, 0), (1, 0), (2, 0)], "row_id long, seq long").write.parquet(source)
    stream = lambda: L.deduplicate(spark.readStream.schema("row_id long, seq long").parquet(source), ["row_id", "seq"])
    out = L.run_stream(stream(), lambda b: b, str(tmp_path / "led"), "run")
    frame(spark, [(2, 0), (3, 0)], "row_id long, seq long").write.mode("append").parquet(source)
    assert out == L.run_stream(stream(), lambda b: b, str(tmp_path / "led"), "run")
    assert sorted((r.row_id, r.seq) for r in spark.read.parquet(out).collect()) == [(1, 0), (2, 0), (3, 0)]
    calls, led = frame(spark, [(1,), (2,), (3,)], "row_id long"), frame(spark, [(1, True), (2, False)], "row_id long, ok boolean")
    assert sorted(r.row_id for r in L.undone(calls, led, ["row_id"]).collect()) == [2, 3]
    a = frame(spark, [(1, 0, 0, False), (1, 0, 1, True), (1, 1, 0, True), (2, 0, 0, True), (2, 0, 1, False)], "row_id long, chunk int, attempt int, ok boolean")
    assert {r.row_id: r.exhausted for r in L.exhausted(a, ["row_id"]).collect()} == {1: False, 2: True}
