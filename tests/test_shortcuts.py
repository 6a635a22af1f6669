"""Shortcut models find planted signals, find none in noise, and never score a row by its own group."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import metrics
from plumbline.operators import shortcuts as S


def auroc(rows):
    return metrics.auroc(rows.withColumns({"positive": F.col("y") == 1, "name": F.lit("x")}), ["name"]).first().auroc


def texts(spark, planted: bool):
    r = random.Random(4)
    rows = []
    for k in range(240):
        y = k % 2
        words = [r.choice(["sun", "sea", "tree", "house", "road", "cloud", "river", "stone"]) for _ in range(20)]
        if planted and r.random() < 0.9:
            words[r.randrange(20)] = "wondrous" if y else "ordinary"
        rows.append((k, k // 4, y if planted else r.randrange(2), " ".join(words), f"s{k % 5}"))
    df = spark.createDataFrame(rows, "id long, grp long, y int, text string, source string")
    return df.withColumns({"fold": S.fold_of(F.col("grp")), "inner": F.pmod(F.xxhash64("grp"), F.lit(2)).cast("int"), "words": X.words(F.col("text")), "chars": S.char_ngrams(F.col("text"))}).cache()


def test_planted_words_are_found_and_noise_is_not(spark):
    for planted, low, high in ((True, 0.9, 1.0), (False, 0.25, 0.75)):
        rows = texts(spark, planted)
        for build in (S.ngram_model, lambda t: S.chosen_model(t, "word"))[: 2 if planted else 1]:
            assert low <= auroc(S.out_of_fold(rows, build)) <= high
        assert low - 0.1 <= auroc(S.token_rule(rows, S.top_gap_tokens(rows))) <= high
    top = S.top_features(texts(spark, True)).collect()
    weight = {r.token: r.weight for r in top}  # a sparse model may do with one of the two
    assert top[0].token in ("wondrous", "ordinary") and weight.get("wondrous", 0) >= 0 >= weight.get("ordinary", 0)


def test_folds_keep_groups_and_rates_leave_a_fold_out(spark):
    rows = texts(spark, False)
    assert rows.groupBy("grp").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    data = [(r.id, r.y, r.fold, r.source) for r in rows.collect()]
    for r in S.left_out_rate(rows, "source").collect():
        own = [y for _, y, f, s in data if s == r.source and f != r.fold]
        assert abs(r.score - sum(own) / len(own)) < 1e-12
    lonely = spark.createDataFrame([(1, 1, 0, "a"), (2, 0, 1, "b"), (3, 1, 1, None)], "id long, y int, fold int, source string")
    assert {r.id: r.score for r in S.left_out_rate(lonely, "source").collect()} == {1: 0.5, 2: 1.0, 3: 1.0}


def test_character_runs_equal_plain_ones(spark):
    t = "Ab c\nüd"
    got = spark.createDataFrame([(t,), ("",), ("a",)], "t string").select(S.char_ngrams(F.col("t"), (3, 4)).alias("g")).collect()
    plain = lambda x: [f" {x} "[k : k + n] for n in (3, 4) for k in range(len(f" {x} ") - n + 1)]
    assert got[0].g == plain("ab c üd") and got[2].g == [" a "]


def test_probe_and_nuisance_models(spark):
    r = random.Random(6)
    rows = spark.createDataFrame([(k, k % 2, [r.gauss(2 * (k % 2), 1) for _ in range(4)] + [r.gauss(0, 5) for _ in range(12)], k % 5 == 0, "ab"[(k % 2) ^ (r.random() < 0.1)]) for k in range(400)], "id long, y int, e array<double>, held boolean, source string")
    v = S.as_vectors(rows.union(spark.createDataFrame([(-1, 0, None, True, "a"), (-2, 0, [1.0, float("nan")], True, "a")], rows.schema)), "e")
    assert v.count() == 400
    scored = S.probe(v.where("not held")).transform(v.where("held")).select("y", F.element_at(S.vector_to_array("probability"), 2).alias("score"))
    assert auroc(scored) > 0.95
    for trees in (False, True):
        out = S.out_of_fold(rows.withColumn("fold", F.col("id").cast("int") % 3), lambda t, trees=trees: S.nuisance_model(t, ["source"], trees))
        assert auroc(out) > 0.8


def test_hashed_rows_hold_no_strings_and_score_the_same(spark):
    rows = texts(spark, True)
    made = S.hashed(rows.select("id", "y", "fold", "inner", "words", "chars"), ["char", "word"], 1 << 14)
    assert set(made.columns) == {"id", "y", "fold", "inner", "tf_char", "tf_word"}
    assert not any(f.dataType.simpleString() in ("array<string>", "string") for f in made.schema.fields)
    plain, quick = (S.chosen_model(x, "word").transform(x).select("id", S.vector_to_array("probability")[1].alias("p")) for x in (rows, made))
    apart = plain.join(quick.withColumnRenamed("p", "q"), "id").agg(F.count("id"), F.max(F.abs(F.col("p") - F.col("q")))).first()
    assert apart[0] == 240 and apart[1] < 1e-6
