"""Sequential choices in bounded memory against the plain loops; the plans no longer hold a whole group."""

from __future__ import annotations

from pyspark.sql import functions as F

import random

from plumbline.operators import sampling as S
from plumbline.plans.records import dataset_hash


def test_balanced_folds_equal_the_plain_loop(spark):
    r = random.Random(2)
    sizes = {g: r.choice([1, 1, 2, 3, 3, 7, 40]) for g in range(500)} | {1000: 300, 1001: 90}
    sums, want = [0] * 5, {}
    for g, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        want[g] = sums.index(min(sums))
        sums[want[g]] += n
    made = S.balanced_folds(spark.createDataFrame(list(sizes.items()), "grp long, n long").repartition(7), "grp", "n", 5)
    assert {x.grp: x.fold for x in made.collect()} == want
    assert "collect_list" not in made._jdf.queryExecution().toString()
    assert S.balanced_folds(spark.createDataFrame([], "grp long, n long"), "grp", "n", 5).count() == 0


def test_greedy_buckets_equal_the_plain_loop(spark):
    r, targets = random.Random(4), {"a": 2, "b": 3, "c": 2}
    rows = [(k, f"s{r.randrange(6)}", r.randrange(9), r.choice("abc"), f"w{min(r.randrange(5), r.randrange(5))}", f"{r.randrange(10**6):06}") for k in range(3000)]
    want = set()
    for s in {x[1] for x in rows}:
        room, words, groups = dict(targets), {}, set()
        for i, _, g, b, w, _ in sorted((x for x in rows if x[1] == s), key=lambda x: (x[5], x[0])):
            if room[b] and words.get(w, 0) < 2 and g not in groups:
                room[b] -= 1
                words[w] = words.get(w, 0) + 1
                groups.add(g)
                want.add(i)
    made = S.greedy_buckets(spark.createDataFrame(rows, "id long, source string, grp long, bucket string, word string, ord string"), "source", "id long, source string, grp long, bucket string, word string", targets, 2)
    assert {x.id for x in made.collect()} == want
    assert "Window" in made._jdf.queryExecution().toString()


def test_dataset_hash_holds_no_split(spark, sf_dir):
    assert "collect_list" not in dataset_hash(spark, sf_dir)._jdf.queryExecution().toString()


def test_similarity_join_carries_on_only_tokens_that_can_meet(spark):
    """Tokens that one set alone has are written nowhere but in their set; pairs and overlaps are those of brute force."""
    import random

    from plumbline.operators import similarity as S

    r = random.Random(3)
    sets = {k: set(r.sample(range(10**9), 40)) for k in range(0, 60, 2)}
    sets |= {k + 1: set(list(s)[: r.choice([34, 37, 40])]) | set(r.sample(range(10**9), r.choice([0, 3, 30]))) for k, s in list(sets.items())}
    df = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "id long, tokens array<long>")
    written, cut = [], S.cut_lineage
    S.cut_lineage = lambda d: (written.append(d), cut(d))[1]
    try:
        for mode, least in (((0.8, 0.8), 10), ((0.8, 1.0), S.NO_CONTAINMENT)):
            got = {(x.left_id, x.right_id, x.overlap) for x in S.similarity_join(df, df, *mode, least, itself=True).collect()}
            want = set()
            for a in sets:
                for b in (b for b in sets if a < b):
                    o, n = len(sets[a] & sets[b]), min(len(sets[a]), len(sets[b]))
                    if o >= 0.8 * len(sets[a] | sets[b]) - 1e-9 or (n >= least and o >= mode[1] * n - 1e-9):
                        want.add((a, b, o))
            assert got == want and want
    finally:
        S.cut_lineage = cut
    lonely = {t for s in sets.values() for t in s if sum(t in x for x in sets.values()) == 1}
    kept = [t for d in written if d.columns == ["side", "id", "size", "tokens"] for x in d.collect() for t in x.tokens]
    assert kept and not lonely & set(kept)


def test_pairs_of_one_host_are_dealt_over_tasks(spark, tmp_path):
    """All pages are of one host: no task makes most of the pairs."""
    from plumbline.plans.registry import QUERIES

    spark.createDataFrame([(k, f"http://one.org/a{k}/b") for k in range(120)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        n = [r["count"] for r in QUERIES["set_06_set_similarity"](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert sum(n) == 120 * 119 // 2 and max(n) < 0.6 * sum(n)
