"""The PII operator's own kinds, scores and validators, near misses, and texts with very many matches."""

from __future__ import annotations

import time

import pytest

from plumbline.llm.pii import find_pii

CASES = [
    ("pay to IBAN DE89 3704 0044 0532 0130 00 today", [("iban", 12, 39, 1.0)]),
    ("GB82WEST12345698765432", [("iban", 0, 22, 0.7)]),
    ("GB82WEST12345698765433 fails mod 97", []),
    ("ssn 123-45-6789", [("ssn", 4, 15, 0.6)]),
    ("the code 123-45-6789 alone scores too little", []),
    ("ssn 000-45-6789, ssn 666-45-6789, ssn 900-45-6789, ssn 123-00-6789, ssn 123-45-0000", []),
    ("card 4111 1111 1111 1111", [("card", 5, 24, 1.0)]),
    ("number 4111 1111 1111 1112", []),
    ("a4111111111111111b", [("card", 1, 17, 0.7)]),
    ("call +49 (30) 1234-5678 now", [("phone", 5, 23, 0.8)]),
    ("+1 23", []),
    ("server 10.0.0.255 or 10.0.0.256", [("ip", 7, 17, 0.8)]),
    ("1.2.3.4.5.6.7.8", [("ip", 0, 7, 0.5), ("ip", 8, 15, 0.5)]),
    ("00000000000255.0.0.1", [("ip", 0, 20, 0.5)]),
    ("write to a.b@c.de, x@y", [("email", 9, 17, 0.9)]),
    ("\U0001f600 a@b.co", [("email", 2, 8, 0.6)]),
    ("", []),
    (None, []),
]


def test_spans_kinds_and_scores(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)], "doc_id long, text string")
    for r in find_pii(df).collect():
        text, want = CASES[r.doc_id]
        assert [(x.kind, x.start, x.stop, x.score) for x in r.pii] == want, text
        assert all(x.hit == text[x.start : x.stop] for x in r.pii)


def test_context_counts_within_forty_characters_of_either_side(spark):
    """Windows that cross the blocks from which they are cut, and words just inside and just outside of them."""
    texts = ["x" * n + "visa" + " " * gap + "4111111111111111" for n in (0, 1000, 1010, 1020, 2040) for gap in (1, 36, 37)]
    texts += ["4111111111111111" + " " * gap + "visa" for gap in (1, 36, 37)]
    texts = [t.replace("xvisa", " visa") for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in find_pii(df).collect():
        x = r.pii[0]
        around = texts[r.doc_id][max(0, x.start - 40) : x.start] + " " + texts[r.doc_id][x.stop : x.stop + 40]
        assert x.score == (1.0 if "visa" in around else 0.7), texts[r.doc_id][-70:]


@pytest.mark.parametrize("n", [127, 128, 129, 20_000])
def test_very_many_matches_in_one_text(spark, n):
    text = " ".join(f"a{k}@b.com" for k in range(n))
    began = time.perf_counter()
    found = find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().pii
    assert len(found) == n and all(text[x.start : x.stop] == x.hit for x in found)
    assert time.perf_counter() - began < 30
