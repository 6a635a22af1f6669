"""The corpus pipeline against plain versions of its stages, and every stage on odd tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_llm_brute import components
from test_near_copies import shingles

import corpus_pipeline as P
from plumbline.llm import queries as Q
from plumbline.llm.pieces import decode_ids, load_pieces

SF = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\f\r"


def plain_lines(docs: dict[int, str]) -> dict[int, str]:
    lower = lambda s: re.sub("[A-Z]", lambda c: c[0].lower(), s)
    lines = {d: (t or "").split("\n") for d, t in docs.items()}
    holders = defaultdict(set)
    for d, ls in lines.items():
        for x in ls:
            holders[lower(x.strip(SPACES))].add(d)
    gone = {k: max(ds) for k, ds in holders.items() if len(k) >= 20 and len(ds) >= 3}
    return {d: "\n".join(x for x in ls if gone.get(lower(x.strip(SPACES)), d) == d) for d, ls in lines.items()}


def plain_near(docs: dict[int, str]) -> set[int]:
    sets, holders = {}, defaultdict(list)
    for d, t in docs.items():
        w = re.sub("[A-Z]", lambda c: c[0].lower(), t or "").split()
        sets[d] = shingles(" ".join(w)) if w else set()
        for x in sets[d]:
            holders[x].append(d)
    empty = [d for d, s in sets.items() if not s]
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    edges = [(a, b) for a, b in pairs if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])] + [(empty[0], d) for d in empty[1:]]
    root = components(docs, edges)
    return {d for d in docs if root[d] == d}


def test_run_equals_plain_stages(spark):
    """Each stage over what the one before kept: lines and near copies by plain Python, the mix by its totals, pieces by
    decoding. Language ID, which has random vectors, is held to the labels: text in a language stays."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    kept = [docs]
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, kept[-1], SF).cache()
        assert out.columns == docs.columns, name
        kept.append(out)
    texts = [{r.doc_id: r.text for r in k.select("doc_id", "text").collect()} for k in kept]
    lettered = {d for d, t in texts[0].items() if any(map(str.isalpha, t or ""))}
    assert set(texts[1]) <= lettered and len(texts[1]) >= 0.98 * len(lettered)
    assert texts[2] == plain_lines(texts[1])
    assert set(texts[3]) == plain_near(texts[2])
    took = Counter(r.doc_id for r in kept[4].select("doc_id").collect())
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in texts[3].items()}
    source = {r.doc_id: r.source for r in kept[3].select("doc_id", "source").collect()}
    whole, taken = Counter(), Counter()
    for d, n in size.items():
        whole[source[d]] += n
        taken[source[d]] += took[d] * n
    assert max(took.values()) <= 3 and abs(sum(taken.values()) - sum(whole.values())) <= 0.02 * sum(whole.values())
    pieces = load_pieces(Q.PIECES)
    final = stages["SentencePiece encoding and decoding"](spark, kept[4], SF)
    assert Counter((r.doc_id, r.decoded) for r in decode_ids(final, pieces, ["doc_id"]).collect()) == Counter({(d, texts[3][d]): n for d, n in took.items()})
    pick = lambda df: Counter(map(str, df.select("doc_id", "ids", "score").collect()))
    assert pick(P.run(spark, SF)) == pick(final)


ODD = [
    (1, "Some ordinary words in a row here", "en", "a"),
    (1, "Some ordinary words in a row here", "en", "a"),
    (2, None, "en", None),
    (3, "", None, "b"),
    (4, " \t\n ", "de", "b"),
    (5, "Einige gewöhnliche Wörter in einer Reihe", "de", None),
    (None, "Words of a row that has no id at all", "en", "a"),
    (None, None, None, None),
    (6, "long " * 60_000, "en", "a"),
]


@pytest.mark.parametrize("name,stage", P.STAGES, ids=[n for n, _ in P.STAGES])
def test_stages_on_odd_tables(spark, name, stage):
    """Nulls in every column, empty and very long texts, repeated rows, no rows, and columns with clashing names."""
    clash = ["_gone", "_key", "_size", "_copies", "_times", "n_lines", "lang_pred", "score", "has_letter", "text_", "_d", "_row", "ids", "root", "node"]
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").withColumns({c: F.col("doc_id") for c in clash})
    out = stage(spark, docs, "")
    rows = out.collect()
    assert rows
    if stage is not P.STAGES[-1][1]:
        assert out.columns == docs.columns
        assert all(r._gone == r.doc_id and r.score == r.doc_id for r in rows)
    assert {r.doc_id for r in rows} <= {r[0] for r in ODD}
    assert stage(spark, docs.limit(0), "").count() == 0
