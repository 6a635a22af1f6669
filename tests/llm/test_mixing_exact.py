"""Mixing: copies are what the plan says in cells of any size, targets are met, and reruns agree under any partitioning."""

from __future__ import annotations

import math

from plumbline.llm.mixing import mix


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "size", "target", "copies", "taken").collect()))


def water_level(sizes: dict[str, int]) -> dict[str, float]:
    """Targets by the contract's words: share by weight, stop at three times, share the excess again."""
    weight = {s: 1 + k % 3 for k, s in enumerate(sorted(sizes))}
    full: set[str] = set()
    while True:
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        more = {s for s in sizes if s not in full and 3 * sizes[s] <= level * weight[s]}
        if not more:
            return {s: 3 * sizes[s] if s in full else level * weight[s] for s in sizes}
        full |= more


def test_one_rule_for_cells_of_every_size(spark):
    """One cell of 12,000 equal documents, and sources of a few: the copies handed out are the copies planned."""
    docs = [(k, "w " * 7, "hot") for k in range(12000)] + [(20000 + k, "w " * (1 + k % 40), "b") for k in range(900)] + [(30000 + k, "w " * 30, "c") for k in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mix(df).collect()
    sizes: dict[str, int] = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = water_level(sizes)
    taken = {s: 0 for s in want}
    for r in got:
        s = "hot" if r.doc_id < 20000 else "b" if r.doc_id < 30000 else "c"
        taken[s] += r.taken
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size and math.isclose(r.target, want[s], rel_tol=1e-12)
        assert abs(r.copies - r.rate) <= 1 + 1e-9 or r.size < 41
    assert abs(taken["hot"] - want["hot"]) <= 7 and abs(taken["b"] - want["b"]) <= 1 and abs(taken["c"] - want["c"]) <= 30


def test_rates_minimise_relative_entropy(spark):
    """Exponential tilting: within a source the logarithm of the rate is linear in the size, up to the full rate."""
    df = spark.createDataFrame([(k, "w " * (1 + k % 60), "ab"[k % 2]) for k in range(4000)], "doc_id long, text string, source string")
    slopes: dict[float, list[float]] = {}
    for r in mix(df).collect():
        if r.rate < 3:
            slopes.setdefault(r.target, []).append(math.log(r.rate) / r.size)
    assert len(slopes) == 2 and all(max(x) - min(x) < 1e-12 for x in slopes.values())


def test_reruns_agree_under_another_partitioning(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert rows_of(mix(d)) == rows_of(mix(d.repartition(23))) == rows_of(mix(d.coalesce(1)))


def test_repeated_ids_are_decided_alike(spark):
    df = spark.createDataFrame([(k // 2, "w " * 5, None if k % 3 else "s") for k in range(60)] + [(99, "w " * 5, "s")] * 4, "doc_id long, text string, source string")
    by: dict[tuple, set] = {}
    for r in mix(df).collect():
        by.setdefault((r.doc_id, r.source_size), set()).add(r.copies)
    assert len(by) > 30 and all(len(c) == 1 for c in by.values())
