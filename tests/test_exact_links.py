"""Links at the threshold itself, and joins whose first pass knows tokens by four bytes."""

from __future__ import annotations

import random
from itertools import combinations

import pytest

from plumbline.operators import similarity as S
from plumbline.plans.registry import QUERIES


def test_near_groups_lose_no_link_at_the_threshold(spark, tmp_path):
    """2,000 pairs that share six of ten shingles; 24 bands of three min-hashes miss about six of them."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**12)}"
    rows = []
    for k in range(2000):
        common = [word() for _ in range(10)]
        rows += [(6 * k + 3 * j, " ".join([*common, word(), word()]), "en", "s", 1) for j in (0, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    found = {r.grp: r.root for r in QUERIES["ded_07_near_duplicate_groups"](spark, str(tmp_path)).collect()}
    assert found == {g: 6 * k for k in range(2000) for g in (6 * k, 6 * k + 3)}


def pairs(sets, other, alike):
    return {(a, b) for a in sets for b in other if alike(sets[a], other[b])}


def alike(x, y):
    both, small = len(x & y), min(len(x), len(y))
    return both >= 0.8 * len(x | y) - 1e-9 or (small >= 10 and both >= 0.8 * small - 1e-9)


@pytest.fixture
def small_slices(monkeypatch):
    monkeypatch.setattr(S, "SLICE_TOKENS", 50)
    monkeypatch.setattr(S, "SLICE_WORDS", 64)
    monkeypatch.setattr(S, "HOT", 20)
    monkeypatch.setattr(S, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(S, "FILTER_BITS", 1 << 10)


def made(seed, n, first=0):
    rng = random.Random(seed)
    sets = {}
    for k in range(first, first + n):
        base = set(rng.choice([range(40), range(100, 112), range(200, 205)]))
        if len(base) > 10:
            base -= set(rng.sample(sorted(base), rng.randrange(3)))
        sets[k] = base | {rng.randrange(10**9) for _ in range(rng.choice([0, 0, 1, 3, 60]))}
    return sets


def frame(spark, sets):
    return spark.createDataFrame([(k, sorted(x)) for k, x in sets.items()], "id long, tokens array<bigint>").repartition(5)


def test_two_sides_and_one_equal_all_pairs(spark, small_slices):
    left, right = made(1, 60), made(2, 50, 1000)
    got = {(r.left_id, r.right_id): r for r in S.similarity_join(frame(spark, left), frame(spark, right)).collect()}
    assert set(got) == pairs(left, right, alike) and got
    assert all(r.overlap == len(left[a] & right[b]) and (r.left_size, r.right_size) == (len(left[a]), len(right[b])) for (a, b), r in got.items())
    one = {(r.left_id, r.right_id) for r in S.similarity_join(frame(spark, left), frame(spark, left), itself=True).collect()}
    assert one == {(a, b) for a, b in combinations(sorted(left), 2) if alike(left[a], left[b])}


def test_equal_sets_once_and_known_components(spark, small_slices):
    sets = made(3, 60)
    distinct = {}
    for k in sorted(sets):
        distinct.setdefault(frozenset(sets[k]), k)
    firsts = {k: set(x) for x, k in distinct.items()}
    want = {(a, b) for a, b in combinations(sorted(firsts), 2) if alike(firsts[a], firsts[b])}
    assert len(firsts) < len(sets)
    assert {(r.left_id, r.right_id) for r in S.similarity_join(frame(spark, sets), frame(spark, sets), itself=True, once=True).collect()} == want
    near = {(a, b) for a, b in combinations(sorted(firsts), 2) if len(firsts[a] & firsts[b]) >= 0.6 * len(firsts[a] | firsts[b])}
    known = spark.createDataFrame([(k, k % 2) for k in firsts], "node long, root long")
    f = frame(spark, firsts)
    got = {(r.left_id, r.right_id) for r in S.similarity_join(f, f, 0.6, 1.0, S.NO_CONTAINMENT, itself=True, known=known).collect()}
    assert got == {(a, b) for a, b in near if a % 2 != b % 2} and got


def test_shingles_of_short_texts(spark):
    rows = [(1, "a b c d e f"), (2, "A, b! c d e"), (3, "b"), (4, "B."), (5, ""), (6, None), (7, "x y x y x y x y x y")]
    got = {r.id: r.tokens for r in S.token_sets(spark.createDataFrame(rows, "id long, text string").repartition(2), "id").collect()}
    assert [len(got[k]) for k in range(1, 8)] == [2, 1, 1, 1, 0, 0, 2]
    assert got[2][0] in got[1] and got[3] == got[4] and all(x == sorted(set(x)) for x in got.values())
