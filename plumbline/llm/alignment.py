"""Cross-tokenizer alignment: where two tokenizations of a text end tokens together, and which tokens overlap."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import shared_folder, slices, small_batches, spread_join
from plumbline.session import cut_lineage, delete_folder

SPACE = "▁"
#: Both tokenizers end a token here, whatever stands around: before a single space between two characters that are no
#: white space (a byte-level word takes one space before it, and no piece has a space sign after another character).
CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space in a wider sense than either tokenizer's, for RE2.
BLANK = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
#: The byte-level vocabulary's split into words.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Labels of bytes: no token ends, one of A ends, one of B ends, both end.
NONE, A_END, B_END, BOTH = b"-ab|"
GROUP = re.compile(rb"[^|]*\|")


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes for themselves, the others
    in order for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def labels(ends_a: np.ndarray, ends_b: np.ndarray, n: int) -> bytes:
    """A label for each of ``n`` bytes, from the offsets after which tokens end."""
    out = np.zeros(n, np.uint8)
    out[np.asarray(ends_a) - 1] = 1
    out[np.asarray(ends_b) - 1] += 2
    return np.array([NONE, A_END, B_END, BOTH], np.uint8)[out].tobytes()


def decimals(n: int) -> np.ndarray:
    """The decimal digits of 0 to n - 1 as rows of characters, filled with zero bytes in front."""
    width = len(str(max(n - 1, 0)))
    ids = np.arange(n)[:, None]
    power = 10 ** np.arange(width - 1, -1, -1)
    return np.where((ids >= power) | (power == 1), ids // power % 10 + ord("0"), 0).astype(np.uint8)


def spans(text: bytes) -> list[int]:
    """The offsets after which the groups of a label string end: a group goes up to a label for both."""
    return [m.end() for m in GROUP.finditer(text)]


class Aligner:
    """Two tokenizers, and the alignments of the stretches between cuts that were met last.

    Stretches repeat, so each is encoded and aligned once while it is held; a text's alignment is that of its stretches
    one after another. New stretches are encoded many at a time, as one text: cuts lie between them too. Where a
    stretch doesn't decode to itself, the text is encoded whole to decide.
    """

    def __init__(self, tokenizer: str, model: bytes, hold: int = 250_000, block: int = 4096):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(tokenizer)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        byte_of, known = byte_level(), self.a.get_vocab(with_added_tokens=False)
        size = max([*known.values(), *self.a.get_vocab().values()], default=-1) + 1
        self.a_bytes = [b""] * size
        for entry, k in known.items():
            self.a_bytes[k] = bytes(byte_of[c] for c in entry)
        # The same vocabulary in a faster encoder, for short stretches; an entry's rank is its id.
        self.quick = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks={self.a_bytes[k]: k for k in known.values()}, special_tokens={})
        piece = self.b.id_to_piece
        self.b_bytes = [bytes([int(piece(k)[3:5], 16)]) if self.b.is_byte(k) else piece(k).replace(SPACE, " ").encode() for k in range(self.b.get_piece_size())]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.digits = decimals(max(len(self.a_bytes), len(self.b_bytes)))
        self.hold, self.block = hold, block
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        #: Of each stretch: its groups as text, null where it doesn't decode to itself; tokens of A and B, groups, links;
        #: and the pairs of all, one after another.
        self.groups = pa.array([], pa.string())
        self.counts, self.pairs = np.zeros((0, 4), np.int64), np.zeros(0, np.int64)

    def align(self, words: list[str], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray] | None:
        """(counts by stretch, groups by stretch, pairs of all) of stretches that stand one after another, a space before
        each, where both tokenizers end a token after each; None where either side's bytes aren't theirs."""
        raw = [w.encode() for w in words]
        data = b" " + b" ".join(raw)
        if b"".join([self.a_bytes[k] for k in a.tolist()]) != data or b"".join([self.b_bytes[k] for k in b.tolist()]) != data:
            return None
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        text = labels(ends_a, ends_b, len(data))
        ends = np.array(spans(text), np.int64)
        # A label ends a token of A, of B or both: the pair of tokens that hold its byte overlap, and the next pair begins.
        label = np.frombuffer(text, np.uint8)
        marks = np.flatnonzero(label != NONE)
        of_a, of_b = (label[marks] != B_END).astype(np.int64), (label[marks] != A_END).astype(np.int64)
        pairs = (a[np.cumsum(of_a) - of_a] << 32) | b[np.cumsum(of_b) - of_b]
        bounds, n = np.cumsum(np.array([len(x) for x in raw]) + 1), len(words)
        word_at = np.repeat(np.arange(n), np.diff(bounds, prepend=0))  # the stretch of each byte
        word_a, word_b = word_at[ends_a - 1], word_at[ends_b - 1]
        count = lambda x: np.bincount(x, minlength=n)
        counts = np.stack([count(word_a), count(word_b), count(word_at[ends - 1]), count(word_at[marks])], axis=1)
        # Groups as text: A's tokens of a group, then B's; the last of each side ends in a sign of its own.
        m = len(ends)
        group_at = np.cumsum(label == BOTH)
        group_a, group_b = (group_at[e - 1] - (label[e - 1] == BOTH) for e in (ends_a, ends_b))
        in_a, in_b = np.bincount(group_a, minlength=m), np.bincount(group_b, minlength=m)
        at_a, at_b = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a], np.arange(len(b)) + np.cumsum(in_a)[group_b]
        out = np.empty((len(a) + len(b), self.digits.shape[1] + 1), np.uint8)
        word_of = np.empty(len(out), np.int64)
        for at, ids, group, word, stop in ((at_a, a, group_a, word_a, "|"), (at_b, b, group_b, word_b, ";")):
            out[at, :-1] = self.digits[ids]
            out[at, -1] = np.where(np.append(group[1:] != group[:-1], True), ord(stop), ord(","))
            word_of[at] = word
        out[at_b[np.append(word_b[1:] != word_b[:-1], True)], -1] = 0
        written = out != 0
        chars = np.append(0, np.cumsum(np.bincount(word_of, written.sum(axis=1), minlength=n))).astype(np.int32)
        groups = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(chars), pa.py_buffer(out[written])])
        return counts, groups, pairs

    def alone(self, text: str):
        """The alignment of one stretch or text by itself."""
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        return self.align([text], np.array(a, np.int64), np.array(self.b.encode(text), np.int64))

    def learn(self, words: pa.Array) -> None:
        """Aligns stretches that aren't held."""
        by_itself = pc.or_(pc.greater(pc.binary_length(words), 100), pc.match_substring_regex(words, f"^$|{SPACE}|^{BLANK}|{BLANK}$"))
        block, rest = words.filter(pc.invert(by_itself)).to_pylist(), words.filter(by_itself).to_pylist()
        found = []
        for k in range(0, len(block), self.block):
            mine = block[k : k + self.block]
            text = " ".join(mine)
            one = self.align(mine, np.array(self.quick.encode_ordinary(" " + text), np.int64), np.array(self.b.encode(text), np.int64))
            if one is None:
                rest += mine
            else:
                found.append((mine, *one))
        found += [([w], *(self.alone(w) or (np.zeros((1, 4), np.int64), pa.array([None], pa.string()), np.zeros(0, np.int64)))) for w in rest]
        for mine, *_ in found:
            self.index.update(zip(mine, range(len(self.index), len(self.index) + len(mine)), strict=True))
        self.groups = pa.concat_arrays([self.groups, *(x[2] for x in found)])
        self.counts, self.pairs = np.concatenate([self.counts, *(x[1] for x in found)]), np.concatenate([self.pairs, *(x[3] for x in found)])

    def texts(self, column: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of a column of texts: counts (n_a, n_b, n_groups, n_links) by row, groups as text by row, and each row's
        different pairs and how often they are: where a row's begin, pairs, times."""
        cut = [CUT.split(t) if t else [] for t in column.to_pylist()]
        rows = len(column)
        sizes = np.array([len(x) for x in cut], np.int64)
        coded = pa.array(chain.from_iterable(cut), pa.string()).dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        strings = words.to_pylist()
        new = [w not in self.index for w in strings]
        if len(self.index) + sum(new) > self.hold:
            self._forget()
            new = [True] * len(strings)
        if any(new):
            self.learn(words.filter(pa.array(new)))
        at = np.array([self.index[w] for w in strings], np.int64)[codes] if strings else np.zeros(0, np.int64)
        row = np.repeat(np.arange(rows), sizes)
        begin = np.append(0, np.cumsum(sizes))
        upto = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.counts[at], axis=0)])
        counts = upto[begin[1:]] - upto[begin[:-1]]
        parts = self.groups.take(pa.array(at))
        groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(begin, pa.int32()), parts), ";").to_pylist()  # null where a part is
        whole = {r: self.alone(column[r].as_py()) for r, g in enumerate(groups) if g is None}
        for r, found in whole.items():
            counts[r], groups[r] = (0, "") if found is None else (found[0][0], found[1][0].as_py())
        # A row's different stretches, then its different pairs.
        own = ~np.isin(row, list(whole))
        keys, times = np.unique(row[own] * (len(self.index) + 1) + at[own], return_counts=True)
        row, at = np.divmod(keys, len(self.index) + 1)
        n = self.counts[:, 3][at]
        starts = np.cumsum(self.counts[:, 3]) - self.counts[:, 3]
        pairs = self.pairs[np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        row, times = np.repeat(row, n), np.repeat(times, n)
        for r, found in whole.items():
            if found is not None:
                pairs, row, times = np.append(pairs, found[2]), np.append(row, np.full(len(found[2]), r)), np.append(times, np.ones(len(found[2]), np.int64))
        different, where = np.unique(pairs, return_inverse=True)
        keys, where = np.unique(row * (len(different) + 1) + where, return_inverse=True)
        row, pair = np.divmod(keys, len(different) + 1)
        return counts, groups, np.append(0, np.cumsum(np.bincount(row, minlength=rows))), different[pair], np.bincount(where, times, len(keys)).astype(np.int64)


ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<bigint>, times array<bigint>"


def align_texts(docs: DataFrame, tokenizer: str, model: str, keep: list[str], text_col: str = "text", digest: bool = False) -> DataFrame:
    """``keep`` plus the alignment of each text under two tokenizers, A (a byte-level vocabulary's file) and B (a piece
    model's file; it adds a space before the text, and A gets that space too).

    n_a, n_b: tokens; n_groups: groups between offsets where both end; n_links: pairs of tokens that overlap; groups:
    ``a1,a2|b1;a3|b2,b3`` by ids (``digest``: the SHA-256 of that instead, '' where there is none); pairs, times: each
    pair of ids that is linked, as A's id * 2^32 + B's, and how often.

    Both files are read on the driver and shipped (their size is that of the vocabularies). A label string over a
    stretch's bytes says where tokens of A, B or both end; a regular expression takes it apart after each label for both,
    and the labels in a part count its tokens.

    Defined cases: null and empty texts, and texts that either tokenizer doesn't decode to (a literal U+2581), have
    no tokens: zeros, '' and empty arrays; strings of special tokens are plain text; equal texts align alike; a text
    without spaces is one stretch; rows that repeat are answered each; an empty table gives an empty table; columns not
    in ``keep`` are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((Path(tokenizer).read_text(encoding="utf-8"), Path(model).read_bytes()))
    small_batches(spark)
    source = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").alias("text"))
    made_names = [x.split()[0] for x in ALIGNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = held_aligner(*shared.value)
        for batch in slices(batches, len(keep), rows=512, size=1 << 20):
            counts, groups, begin, pairs, times = aligner.texts(batch.column(len(keep)))
            if digest:
                groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            begin = pa.array(begin, pa.int32())
            made = [*(pa.array(counts[:, k]) for k in range(4)), pa.array(groups, pa.string()), pa.ListArray.from_arrays(begin, pairs), pa.ListArray.from_arrays(begin, times)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=[*batch.schema.names[: len(keep)], *made_names])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)]), ALIGNED])
    names = keep + [unused(n, keep) for n in made_names]
    return source.mapInArrow(run, schema).toDF(*names)


def unused(name: str, taken: list[str]) -> str:
    while name.lower() in {x.lower() for x in taken}:
        name += "_"
    return name


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best) over all rows: how many rows have the pair linked, and whether no pair of its A id has more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")).withColumn("a", F.shiftright("pair", 32))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment_report(docs: DataFrame, tokenizer: str, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A pair's count is the number of documents (rows) in the corpus that hold it linked; count_sum adds it over a
    document's links, and n_best counts the links whose pair has the greatest count of its A id. Alignments are written
    once to the shared folder. Pairs are counted with map-side combining, so a pair of every document is no hot key;
    their counts come back to the documents by broadcast where they are few (counted first) and salted otherwise, and add up
    within a task before a row a document is shuffled. The written alignments are deleted at the end.
    Defined cases: those of ``align_texts``; a null id stays null.
    """
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession, "alignment")
    own = ["n_a", "n_b", "n_groups", "n_links", "groups"]
    given = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    aligned = align_texts(given, tokenizer, model, ["id"], digest=True)
    aligned.withColumn("row", F.monotonically_increasing_id()).write.parquet(folder)  # a row's number is fixed from here
    aligned = spark.read.parquet(folder)
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    met = spread_join(links, pair_counts(aligned), ["pair"], "row")
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    out = aligned.select("row", "id", *own).join(sums, "row", "left").select("id", *own[:4], *zero, F.col("groups").alias("groups_sha256"))
    out = cut_lineage(out.withColumnRenamed("id", id_col))
    delete_folder(spark, folder)
    return out


_held: dict = {}


def held_aligner(tokenizer: str, model: bytes) -> Aligner:
    key = (hash(tokenizer), hash(model))
    if key not in _held:
        _held.clear()
        _held[key] = Aligner(tokenizer, model)
    return _held[key]
