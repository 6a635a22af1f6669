"""Near copies of every shape against brute force."""

from __future__ import annotations

import random

from test_llm_brute import components

from plumbline.llm.simhash import near_copies, near_dedup


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} or {" ".join(w)}


def test_near_dedup_finds_appended_cut_and_inserted_copies(spark):
    """Copies with a block more or less, from a similarity of 0.8 on, and some just under it."""
    r = random.Random(7)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    texts = []
    for size, more in ((10, 1), (20, 4), (100, 20), (100, 24), (200, 48), (400, 44), (400, 98), (400, 105)):
        for _ in range(12):
            w, block = fresh(size), fresh(more)
            at = r.randrange(1, size)
            texts += [w, w + block]
            v = fresh(size)
            texts += [v, v[:at] + block + v[at:]]
            x = fresh(size + more)
            texts += [x, x[more:]]
    r.shuffle(texts)
    docs = {k: " ".join(w) for k, w in enumerate(texts)}
    holders, sets = {}, {k: shingles(t) for k, t in docs.items()}
    for k, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(k)
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    edges = [(a, b) for a, b in pairs if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    root = components(docs, edges)
    kept = {row.doc_id for row in near_dedup(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert len(edges) > 150 and kept == {k for k in docs if root[k] == k}


def test_recall_by_similarity_step(spark):
    """Three hundred pairs at each step, changed by scattered words or by a block at the end: nearly all are found."""
    r = random.Random(11)
    docs, steps, at = {}, {}, 0
    for step in (0.80, 0.85, 0.90):
        while sum(s == step for s in steps.values()) < 300:
            w = [f"w{r.randrange(10**9)}" for _ in range(r.choice([30, 80, 200]))]
            v = list(w)
            if r.random() < 0.5:
                v += [f"v{r.randrange(10**9)}" for _ in range(round(len(w) * (1 / step - 1) * 0.97))]
            else:
                for k in r.sample(range(len(w)), max(1, round(len(w) * (1 - step) / 9))):
                    v[k] = f"v{r.randrange(10**9)}"
            a, b = shingles(" ".join(w)), shingles(" ".join(v))
            j = len(a & b) / len(a | b)
            if step <= j < step + 0.05:
                docs[at], docs[at + 1], steps[at] = " ".join(w), " ".join(v), step
                at += 2
    kept = {row.doc_id for row in near_dedup(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    for step in set(steps.values()):
        pairs = [k for k, s in steps.items() if s == step]
        assert all(k in kept for k in pairs)
        assert sum(k + 1 not in kept for k in pairs) >= 0.99 * len(pairs), step


def test_simhash_variants_are_an_index_of_their_own(spark):
    """Long texts with one word changed meet by their SimHash alone, without any band of min-hashes; the exact
    similarity still decides."""
    r = random.Random(5)
    docs = {}
    for k in range(0, 80, 2):
        w = [f"w{r.randrange(10**9)}" for _ in range(800)]
        docs[k], docs[k + 1] = " ".join(w), " ".join([*w[:400], "other", *w[401:]])
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    found = {row.id: row.component_id for row in near_copies(table, bands=0).collect()}
    assert sum(found.get(k + 1) == k for k in range(0, 80, 2)) >= 36
    assert all(root == k - k % 2 for k, root in found.items())
    assert near_copies(table, bands=0, similarity=0.999).count() == 0
