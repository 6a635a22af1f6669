"""Token alignment against whole texts encoded at once and all pairs of byte ranges compared."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm import queries as Q
from plumbline.llm.alignment import Aligner, align_texts, alignment_report, byte_level, decimals, labels, spans

A = Tokenizer.from_file(Q.BYTES)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=Q.PIECES)
BYTE_OF = byte_level()
ALIGNER = Aligner(open(Q.BYTES, encoding="utf-8").read(), open(Q.PIECES, "rb").read())


def plain(text):
    """(n_a, n_b, groups, links) of a text, or None."""
    if not text:
        return None
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    raw_a = [bytes(BYTE_OF[c] for c in A.id_to_token(k)) for k in a]
    raw_b = [bytes([int(B.id_to_piece(k)[3:5], 16)]) if B.is_byte(k) else B.id_to_piece(k).replace("▁", " ").encode() for k in b]
    if b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
        return None

    def bounds(ids, raw):
        at, out = 0, []
        for k, x in zip(ids, raw, strict=True):
            out.append((at, at + len(x), k))
            at += len(x)
        return out

    x, y = bounds(a, raw_a), bounds(b, raw_b)
    both = sorted({e for _, e, _ in x} & {e for _, e, _ in y})
    groups, low = [], 0
    for e in both:
        groups.append("|".join(",".join(str(k) for s, t, k in side if low <= s and t <= e) for side in (x, y)))
        low = e
    return len(a), len(b), groups, [(k, m) for s, t, k in x for u, v, m in y if s < v and u < t]


def expected(rows):
    made = [(i, plain(t)) for i, t in rows]
    held = Counter(p for _, m in made if m for p in set(m[3]))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    for i, m in made:
        if m is None:
            yield i, 0, 0, 0, 0, 0, 0, ""
        else:
            yield i, m[0], m[1], len(m[2]), len(m[3]), sum(held[p] == most[p[0]] for p in m[3]), sum(held[p] for p in m[3]), hashlib.sha256(";".join(m[2]).encode()).hexdigest()


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query_against_plain(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text[:4000] if r.text else r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")  # whole texts: test_whole_texts
    found = sorted((tuple(r) for r in alignment_report(df, Q.BYTES, Q.PIECES).select(*COLUMNS).collect()), key=str)
    assert found == sorted(expected(rows), key=str)


def test_whole_texts(spark):
    sf = "/root/testdata/sf0.001"
    whole = {r.doc_id: r for r in Q.op13_token_alignment(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        if r.text:
            a, b = A.encode(" " + r.text, add_special_tokens=False).ids, B.encode(r.text)
            assert whole[r.doc_id].n_a in (0, len(a)) and whole[r.doc_id].n_b in (0, len(b))
            assert whole[r.doc_id].n_groups <= min(len(a), len(b)) and whole[r.doc_id].n_links >= whole[r.doc_id].n_groups
    assert len(whole) == 200


def aligned(aligner, texts):
    """What an aligner says, by text."""
    counts, groups, begin, pairs, times = aligner.texts(pa.array(["x y", *texts], pa.string()).slice(1))
    return [(*counts[k].tolist(), g, dict(zip(pairs[x:y].tolist(), times[x:y].tolist(), strict=True))) for k, (g, x, y) in enumerate(zip(groups, begin, begin[1:], strict=False))]


ODD = st.text(alphabet=st.one_of(st.sampled_from(" \t\n\r\x0b\x1c\x85  　▁'s<|>.0aéß日😀́\x00"), st.characters(codec="utf-8")), max_size=40)


@settings(max_examples=400, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=4))
def test_odd_texts(texts):
    for t, found in zip(texts, aligned(ALIGNER, texts), strict=True):
        want = plain(t)
        if want is None:
            assert found == (0, 0, 0, 0, "", {})
        else:
            assert found[:5] == (want[0], want[1], len(want[2]), len(want[3]), ";".join(want[2]))
            assert found[5] == Counter((a << 32) | b for a, b in want[3])


def test_labels_and_spans():
    text = labels([1, 3, 6], [2, 3, 5, 6], 6)
    assert text == b"ab|-b|" and spans(text) == [3, 6]
    assert [bytes(r[r != 0]) for r in decimals(1001)[[0, 7, 10, 999, 1000]]] == [b"0", b"7", b"10", b"999", b"1000"]


def test_rows_of_every_kind(spark):
    rows = [(1, "<|endoftext|> </s> plain"), (1, "<|endoftext|> </s> plain"), (2, None), (3, ""), (4, " "), (5, "a▁b"), (None, "no id"), (6, "\n\n x  y "), (7, "x" * 20_000), (8, "word " * 30_000), (9, "a b▁ c"), (9, "the the the")]
    df = spark.createDataFrame([(*r, 1, "g", 2) for r in rows], "doc_id long, text string, n_a int, groups string, row int").repartition(3)
    small = [(i, t if t is None or len(t) < 2000 else None) for i, t in rows]
    keep_long = {7, 8}
    found = [tuple(r) for r in alignment_report(df.where("length(text) < 2000 or text is null"), Q.BYTES, Q.PIECES).select(*COLUMNS).collect()]
    assert sorted(found, key=str) == sorted(expected([r for r, (i, _) in zip(small, rows, strict=True) if i not in keep_long]), key=str)
    whole = alignment_report(df, Q.BYTES, Q.PIECES)
    assert whole.count() == len(rows) and whole.where("doc_id = 8").first().n_a >= 30_000
    assert alignment_report(df.limit(0), Q.BYTES, Q.PIECES).count() == 0
    kept = align_texts(df, Q.BYTES, Q.PIECES, ["doc_id", "groups", "n_a"])
    assert kept.columns == ["doc_id", "groups", "n_a", "n_a_", "n_b", "n_groups", "n_links", "groups_", "pairs", "times"]
    assert kept.where("doc_id = 5").first().groups_ == ""


def test_salted_join_gives_the_same(spark, monkeypatch):
    from plumbline.llm import common

    df = spark.createDataFrame([(k, f"the quick brown fox {k} the") for k in range(40)], "doc_id long, text string")
    one = sorted(map(tuple, alignment_report(df, Q.BYTES, Q.PIECES).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, alignment_report(df, Q.BYTES, Q.PIECES).collect())) == one


def test_forgetting_changes_nothing():
    small = Aligner(open(Q.BYTES, encoding="utf-8").read(), open(Q.PIECES, "rb").read(), hold=5, block=2)
    for text in ("a b c d e f g a b", "h i j a b c", "a▁ b c"):
        assert aligned(small, [text, text])[1] == aligned(ALIGNER, [text])[0]
