"""Exact top-k: both prunings fire and lose nothing; blocks and batches of any size give the same rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import topk_product
from plumbline.llm.topk_product import best, products, top_products


def brute(ids, x, queries, k):
    s = products(x[queries], x)
    out = {}
    for r, q in enumerate(queries):
        order = sorted((-int(s[r, j]), int(ids[j])) for j in range(len(ids)) if ids[j] != ids[q])[:k]
        out[int(ids[q])] = [(i, -v) for v, i in order]
    return out


@pytest.mark.parametrize("near,kind", [(0.15, "coordinate"), (3.0, "length")])
def test_pruning_fires_and_is_exact(near, kind):
    """Queries with close neighbours make high local thresholds, which coordinates prune; others go by length."""
    r = np.random.default_rng(1)
    centres = 400 * r.standard_normal((30, 16))
    x = np.floor(centres[np.arange(900) % 30] + near * 400 * r.standard_normal((900, 16)) / 4)
    ids, lengths, queries = np.arange(900), np.sqrt((x * x).sum(axis=1)), np.arange(0, 900, 9)
    s = products(x[queries], x).astype(float)
    s[queries[:, None] == ids[None, :]] = -np.inf
    floor = np.partition(s, -5, axis=1)[:, -5]
    tell: dict = {}
    got: dict[int, list] = {}
    for lo in range(0, 900, 150):  # blocks
        c = slice(lo, lo + 150)
        for a, b, v in best(ids[queries], x[queries], lengths[queries], floor, ids[c], x[c], lengths[c], 5, tell=tell):
            for q, i, w in zip(a.tolist(), b.tolist(), v.tolist(), strict=True):
                got.setdefault(q, []).append((-w, i))
    want = brute(ids, x, queries, 5)
    assert {q: [(i, -w) for w, i in sorted(f)[:5]] for q, f in got.items()} == want
    assert tell.get(kind, 0) > 0, tell


@pytest.mark.parametrize("least,block", [(16, 1 << 12), (1024, 1 << 26)])
def test_any_blocks_give_the_same_rows(spark, monkeypatch, least, block):
    monkeypatch.setattr(topk_product, "BLOCK_BYTES", block)
    r = np.random.default_rng(2)
    v = [(k, (r.standard_normal(8) * r.choice([0.01, 1, 5])).tolist()) for k in range(400)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    x = np.floor(256 * np.array([a for _, a in v]))
    got: dict[int, list] = {}
    for row in top_products(df, F.col("vec_id") % 50 == 0, least=least).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.vec_id, row.score))
    assert got == brute(np.arange(400), x, np.arange(0, 400, 50), 5)


def test_more_dimensions_than_first_looks(spark, monkeypatch):
    monkeypatch.setattr(topk_product, "SEED_DIMS", 1)
    v = [(k, [float(k % 7 + 1)] * (1 + k % 4)) for k in range(200)]
    got = top_products(spark.createDataFrame(v, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    assert len(got) == 20 and all((r.vec_id - r.query_id) % 4 == 0 for r in got)
