"""The search for many words at once against the search for one, and against every segmentation; decoding as a query."""

from __future__ import annotations

import random

import numpy as np

from plumbline.llm import queries as Q
from plumbline.llm.pieces import SPACE, Segmenter, decode_ids, encode_texts, load_pieces


def every(w, score):
    if not w:
        yield 0.0
    for k in range(1, len(w) + 1):
        if w[:k] in score:
            for v in every(w[k:], score):
                yield score[w[:k]] + v


def test_many_words_of_a_length_equal_enumeration():
    """Random vocabularies, and more words of each length than the search for single words is used for."""
    r = random.Random(2)
    for _ in range(6):
        score = {SPACE: -3.0} | {c: -r.uniform(1, 4) for c in "abcd"}
        for _ in range(40):
            score.setdefault((SPACE if r.random() < 0.3 else "") + "".join(r.choice("abcd") for _ in range(r.randrange(1, 5))), -r.uniform(1, 6))
        pieces = [(p, v, "piece") for p, v in score.items()] + [(f"<0x{b:02X}>", -30.0, "byte") for b in range(256)]
        s = Segmenter(pieces)
        words = {SPACE + "".join(r.choice("abcd") for _ in range(n)) for n in range(2, 9) for _ in range(30)}
        for n in range(3, 10):
            group = sorted(w for w in words if len(w) == n)
            odd, _, _, best, gap = s._many(group, n)
            assert len(group) >= 8 and not odd.any()
            for k, w in enumerate(group):
                totals = sorted(every(w, score), reverse=True)
                _, one, behind = s._one(w)
                assert np.isclose(best[k], totals[0]) and np.isclose(one, totals[0])
                if len(totals) > 1:
                    assert np.isclose(gap[k], totals[0] - totals[1]) and np.isclose(behind, gap[k])
                assert np.allclose([v for v, _ in s.nbest(w, 5)], totals[:5])


def test_many_and_one_agree_on_real_words(spark):
    s = Segmenter(load_pieces(Q.PIECES))
    texts = [x.text for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(300).collect()]
    by: dict[int, list] = {}
    for w in sorted({w for t in texts for w in s.words(t)}):
        by.setdefault(len(w), []).append(w)
    seen = 0
    for n, group in by.items():
        if len(group) < 8 or n > 48:
            continue
        odd, flat, size, best, gap = s._many(group, n)
        at = np.cumsum(size) - size
        for k in range(0, len(group), 7):
            if not odd[k]:
                ids, score, behind = s._one(group[k])
                assert flat[at[k] : at[k] + size[k]].tolist() == ids.tolist() and np.isclose(score, best[k]) and np.isclose(behind, gap[k])
                seen += 1
    assert seen > 200


def test_ties_keep_one_order():
    score = {SPACE: -1.0, "a": -1.0, "aa": -2.0, SPACE + "a": -2.0}
    s = Segmenter([(p, v, "piece") for p, v in score.items()] + [(f"<0x{b:02X}>", -30.0, "byte") for b in range(256)])
    first = s.nbest(SPACE + "aaa", 4)
    assert first == Segmenter([(p, v, "piece") for p, v in score.items()] + [(f"<0x{b:02X}>", -30.0, "byte") for b in range(256)]).nbest(SPACE + "aaa", 4)
    assert all(v == first[0][0] for v, _ in first)


def test_decoding_gives_the_texts_back(spark):
    texts = ["plain words", "", None, "  two  spaces ", "tab\tand\nline", SPACE + "literal", "日本語 emoji \U0001f600", "x" * 5000, "\x00 zero"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = load_pieces(Q.PIECES)
    found = {r.doc_id: r.decoded for r in decode_ids(encode_texts(df, pieces, ["doc_id"], n=2), pieces, ["doc_id"]).collect()}
    assert [found[k] for k, t in enumerate(texts) if t is not None] == [t for t in texts if t is not None]
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in decode_ids(none, pieces, ["doc_id"]).collect()} == {1: None, 2: ""}
