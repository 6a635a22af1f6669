"""Operators whose results SQL can't express, against plain versions; and edge cases."""

from __future__ import annotations

import random

from plumbline.operators.components import connected_components


def union_find(edges):
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return {x: find(x) for x in list(top)}


def test_components_agree_with_union_find(spark):
    r = random.Random(3)
    edges = [(r.randrange(150), r.randrange(150)) for _ in range(90)] + [(k, k + 1) for k in range(200, 240)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"))
    names = found.columns
    got = {row[names[0]]: row[names[1]] for row in found.collect()}
    want = union_find([e for e in edges if e[0] != e[1]])
    assert {x: y for x, y in got.items() if x in want} == want
