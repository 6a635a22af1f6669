"""Queries that SQL can't express against plain Python over whole small tables."""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections import defaultdict

from test_operators import union_find

from plumbline.functions import text as X
from plumbline.operators import boards
from plumbline.operators.ranges import row_numbers, running_sums, running_sums_within
from plumbline.plans.registry import QUERIES


def shingles(t):
    w = re.findall(r"\w+", (t or "").lower())
    return frozenset(" ".join(w[k : k + 5]) for k in range(len(w) - 4)) or (frozenset([" ".join(w)]) if w else frozenset())


def near_components(docs):
    """{first id of a distinct shingle set: smallest first id it reaches by Jaccard >= 0.6}."""
    first = {}
    for i, t in sorted(docs.items()):
        if shingles(t):
            first.setdefault(shingles(t), i)
    holders = defaultdict(list)
    for s, i in first.items():
        for x in s:
            holders[x].append((i, s))
    edges = {(a, b) for h in holders.values() for a, s in h for b, t in h if a < b and 5 * len(s & t) >= 3 * len(s | t)}
    return first, union_find(edges)


def test_minhash_components_and_near_groups(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    first, root = near_components(docs)
    got = {r.id: r.component_id for r in QUERIES["join_03_minhash_components"](spark, sf_dir).collect()}
    assert set(got) == set(first.values())
    assert {i: c for i, c in got.items() if i in root} == root and all(got[i] == i for i in got if i not in root)
    groups = union_find({(a - a % 3, b - b % 3) for a, b in root.items() if a - a % 3 != b - b % 3})
    found = {r.grp: r.root for r in QUERIES["ded_07_near_duplicate_groups"](spark, sf_dir).collect()}
    assert {g: r for g, r in found.items() if g != r or g in groups} == groups or found == groups


def test_tiers_walk_down_the_board(spark):
    pos = {s: k for k, s in enumerate("abcdefg", 1)}
    worse = {("a", "c"), ("a", "d"), ("c", "f"), ("c", "g"), ("b", "d"), ("f", "g")}
    tier, leader, want = 0, None, {}
    for s in sorted(pos, key=pos.get):
        if leader is None or (leader, s) in worse:
            tier, leader = tier + 1, s
        want[s] = tier
    got = boards.tiers(spark.createDataFrame(list(pos.items()), "system string, pos int"), spark.createDataFrame(list(worse), "leader string, system string"))
    assert {r.system: r.tier for r in got.collect()} == want == {"a": 1, "b": 1, "c": 2, "d": 2, "e": 2, "f": 3, "g": 4}


def test_compatible_words_and_salted_keys(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}

    def words(x):
        x = unicodedata.normalize("NFKC", x).lower().replace("'", "").replace("’", "")
        return "".join(c if c.isalnum() or c == "_" else " " for c in x).split()

    got = {r.doc_id: r.n_words for r in QUERIES["str_04_compatible_words"](spark, sf_dir).collect()}
    assert all(got[i] == len(words(t)) for i, t in docs.items() if t is not None)
    keys = {r.doc_id: r.key for r in QUERIES["mth_01_salted_order"](spark, sf_dir).collect()}
    assert keys == {i: hmac.new(b"plumbline", str(i).encode(), hashlib.sha256).hexdigest() for i in docs}


def test_running_sums_equal_plain_ones(spark):
    rows = [(k, "abc"[k % 7 % 3] if k % 11 else None, (k * 37) % 101) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, part string, n long").repartition(9)
    order = [df.n.asc(), df.id.asc()]
    total, want, place = 0, {}, {}
    for k, (i, _, n) in enumerate(sorted(rows, key=lambda r: (r[2], r[0])), 1):
        total += n
        want[i], place[i] = total, k
    assert {r.id: r.upto for r in running_sums(df, order, upto=df.n).collect()} == want
    assert {r.id: r["at"] for r in row_numbers(df, order).collect()} == place
    inner, sums = {}, defaultdict(int)
    for i, p, n in sorted(rows, key=lambda r: (r[2], r[0])):
        sums[p] += n
        inner[i] = sums[p]
    assert {r.id: r.upto for r in running_sums_within(df, ["part"], order, upto=df.n).collect()} == inner
    assert running_sums(df.limit(0), order, upto=df.n).count() == 0 and X.WORD


def test_words_are_made_in_slices_of_bytes():
    """However long the texts of a batch, few of them are Python objects at once, and all rows come out."""
    import numpy as np

    from plumbline.functions.text import _parts

    sizes = np.array([5, 0, 3, 40, 1, 1, 10, 9, 2])
    parts = list(_parts(sizes, 10))
    assert [k for lo, hi in parts for k in range(lo, hi)] == list(range(len(sizes)))
    assert all(sizes[lo:hi].sum() <= 10 or hi == lo + 1 for lo, hi in parts) and not list(_parts(sizes[:0], 10))
