"""Nulls, empty tables and texts, repeated rows and clashing names for every numbered operator."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline.llm import queries as Q
from plumbline.llm.embed_dedup import embedding_near_dedup
from plumbline.llm.langid import identify, train_profiles
from plumbline.llm.line_dedup import line_dedup
from plumbline.llm.mixing import mix, resample
from plumbline.llm.pieces import encode_texts, load_pieces
from plumbline.llm.pii import find_pii
from plumbline.llm.secrets import find_secrets
from plumbline.llm.simhash import near_dedup, simhash_components
from plumbline.llm.topk_product import top_products
from plumbline.llm.urls import judge_urls

LONG = "ein langer Satz mit Wörtern \n" * 20_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_lines long, score double, pii string, key string, copies int, fp string"
TEXTS = [(1, "one two three four five six", "en"), (1, "one two three four five six", "en"), (2, None, None), (3, "", "de"), (4, " \t\n", None), (5, LONG, "de"), (None, "no id here at all", "en"), (6, "😀 é ▁ \ud7ff", "fr")]
VECTORS = "vec_id long, embedding array<float>, label int, n_links string, id string, rank string"


def docs(spark, empty=False):
    made = [] if empty else [(i, t, g, None if g is None else "s1", None, 9, 0.5, "x", "k", 1, "f") for i, t, g in TEXTS]
    return spark.createDataFrame(made, DOCS)


def vectors(spark, empty=False):
    nan, inf = float("nan"), float("inf")
    made = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (100, [2.0, 0.01]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [-1.0, 0.0]), (10, [-1.0, 0.0])]
    return spark.createDataFrame([] if empty else [(i, v, 0, "x", "y", "z") for i, v in made], VECTORS)


RUNS = {
    "op2": lambda s, d: line_dedup(d),
    "op3": lambda s, d: encode_texts(d, load_pieces(Q.PIECES), ["doc_id", "score"]),
    "op5": lambda s, d: simhash_components(d),
    "op6": lambda s, d: find_pii(d),
    "op7": lambda s, d: find_secrets(d, ["doc_id", "pii"]),
    "op9": lambda s, d: identify(d, train_profiles(d, F.lit(True)), ["doc_id", "score"]),
    "op10": lambda s, d: mix(d),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_each_row_is_answered(spark, name):
    assert RUNS[name](spark, docs(spark)).count() == len(TEXTS)
    assert RUNS[name](spark, docs(spark, empty=True)).count() == 0


def test_filters_keep_columns(spark):
    kept = near_dedup(docs(spark))
    assert kept.columns == docs(spark).columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, 5, None, 6}
    assert near_dedup(docs(spark, empty=True)).count() == 0
    mixed = resample(docs(spark))
    assert mixed.columns == docs(spark).columns and mixed.count() > 0
    assert resample(docs(spark, empty=True)).count() == 0


def test_null_and_empty_texts_have_defined_results(spark):
    lines = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup(docs(spark)).collect()}
    assert lines[2] == ("", 1, 0) and lines[3] == ("", 1, 0) and lines[5][:2] == (LONG, 20_001)
    same = {r.doc_id: (r.fp, r.component_id) for r in simhash_components(docs(spark)).collect()}
    assert same[2] == same[3] == same[4] == (0, 2)
    said = {r.doc_id: (r.lang_pred, r.score_) for r in RUNS["op9"](spark, docs(spark)).collect()}
    assert said[2] == said[3] == said[4] == ("und", 0.0) and said[5][0] == "de"
    pieces = {r.doc_id: (r.ids, r.round_trip) for r in RUNS["op3"](spark, docs(spark)).collect()}
    assert pieces[2] == ([], None) and pieces[3] == ([], True) and pieces[5][1] and pieces[6][1]


def test_vectors(spark):
    found = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_near_dedup(vectors(spark)).collect()]
    assert len(found) == 12 and (0, 2, 0, True) in found and (50, 2, 0, False) in found and (100, 2, 0, False) in found
    assert found.count((10, 1, 10, True)) == 2 and all((i, 0, i, True) in found for i in (3, 4, 5, 6, 7, 8, 9))
    assert embedding_near_dedup(vectors(spark, empty=True)).count() == 0
    best = {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_products(vectors(spark), F.col("vec_id") % 50 == 0).collect()}
    assert best[0, 1] == (100, 256 * 512) and best[0, 2] == (50, 65536) and best[0, 3] == (5, 0) and best[0, 5] == (10, -65536)
    assert top_products(vectors(spark, empty=True), F.col("vec_id") % 50 == 0).count() == 0


def test_urls(spark):
    made = [(1, None), (1, None), (2, ""), (3, "no scheme"), (4, "HTTP://EXAMPLE.NET/en/x?y#z"), (5, "a://b.net"), (6, "x://" + "a/" * 5000), (None, "http://c.org/fr/"), (7, "http://é.com/%20/日本")]
    pages = spark.createDataFrame([(i, u, "h", "p", "v") for i, u in made], "page_id long, url string, host string, path string, verdict string")
    found = judge_urls(pages).collect()
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found}
    assert len(found) == len(made) and by[1][:3] == ("", "", None) and by[4] == ("example.net", "/en/x", "example.net/en/", "allow")
    assert by[5][:3] == ("b.net", "", None) and by[None][2:] == ("org/fr/", "allow")
    assert judge_urls(pages.limit(0)).count() == 0
