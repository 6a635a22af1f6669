"""Codes of embeddings: estimates are unbiased, the bound settles most pairs, and recall holds at every cosine step."""

from __future__ import annotations

import math

import numpy as np

from plumbline.llm.embed_dedup import Codes, _encode, embedding_near_dedup, plan_bands, units

BITS, WIDTH, BANDS = 128, 6, 8


def table_of(x: np.ndarray, bits=BITS, seed=42) -> dict:
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(x))), pa.array(x.tolist())], names=["id", "v"])
    made = next(_encode(bits, WIDTH, BANDS, seed, "f8")(iter([batch])))
    return {c: made.column(c).to_numpy(zero_copy_only=False) for c in made.schema.names}


def test_estimates_are_unbiased_and_bounded():
    r = np.random.default_rng(3)
    x = units(r.standard_normal((60, 64)))
    y = units(0.9 * x + 0.436 * units(r.standard_normal((60, 64))))
    both = np.concatenate([x, y])
    true, errors, outside = both @ both.T, [], 0
    for seed in range(12):
        codes = Codes(table_of(both, seed=seed), slice(0, 120), BITS, WIDTH, BANDS, 0.9, 3.0)
        a, b = (x.ravel() for x in np.meshgrid(np.arange(120), np.arange(120), indexing="ij"))
        guess, slack = (x.reshape(120, 120) for x in codes.estimates(a, b))
        off = ~np.eye(120, dtype=bool)
        errors.append((guess - true)[off])
        outside += (np.abs(guess - true) > slack)[off].sum()
    errors = np.stack(errors)
    assert abs(errors.mean()) < 0.002, "unbiased over rotations"
    assert outside / errors.size < 0.01, "three standard errors hold nearly always"
    assert 0.02 < errors.std() < 0.1


def test_the_bound_settles_most_pairs_and_loses_no_link():
    r = np.random.default_rng(4)
    x = units(r.standard_normal((400, 64)))
    x[200:] = units(x[:200] + 0.05 * r.standard_normal((200, 64)))
    count: dict = {}
    codes = Codes(table_of(x), slice(0, 400), BITS, WIDTH, BANDS, 0.9, 3.0)
    rows = np.arange(400)
    kept = set()
    for band in range(BANDS):
        for i, j in codes.open_pairs(rows, rows, False, band, count):
            same = (codes.keys[i] == codes.keys[j]).argmax(axis=1) == band
            kept |= set(zip(i[same].tolist(), j[same].tolist(), strict=True))
    true = np.argwhere(np.triu(x @ x.T >= 0.9, 1))
    assert all((i, j) in kept for i, j in true.tolist() if (codes.keys[i] == codes.keys[j]).any())
    assert count["exact"] < 0.05 * count["pairs"], "few pairs need an exact product"


def test_recall_by_cosine_step(spark):
    """Hundreds of pairs at each of several cosines from the threshold on: at least 95 % of each step are linked."""
    r = np.random.default_rng(5)
    rows, steps = [], [0.9005, 0.92, 0.95, 0.98]
    base = units(r.standard_normal((1200, 64)))
    for k, a in enumerate(base):
        c = steps[k % 4]
        b = r.standard_normal(64)
        b -= (b @ a) * a
        rows += [(2 * k, a.tolist()), (2 * k + 1, (c * a + math.sqrt(1 - c * c) * b / np.linalg.norm(b)).tolist())]
    got = {x.vec_id: x.component_id for x in embedding_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), bucket=64).collect()}
    for k, c in enumerate(steps):
        found = [got[2 * i] == got[2 * i + 1] for i in range(1200) if i % 4 == k]
        assert np.mean(found) >= 0.95, (c, np.mean(found))


def test_rows_that_share_an_id_keep_their_own_links(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    df = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b), (4, [0.0, 0.99, 0.1]), (None, a), (5, None), (6, [])], "vec_id long, embedding array<double>")
    got = sorted((str(r.vec_id), r.n_links) for r in embedding_near_dedup(df).collect())
    assert got == sorted([("1", 2), ("1", 2), ("2", 2), ("3", 2), ("4", 2), ("None", 2), ("5", 0), ("6", 0)])
    assert plan_bands(10, 0.9, 0.98, 256)[0] == 4
