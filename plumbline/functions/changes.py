"""What changed between two texts, word by word, in time that grows with their length."""

from __future__ import annotations

import difflib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stretches without a word of their own are compared word by word up to this many pairs of words, and replaced beyond.
PAIRS = 40_000


def unique_anchors(x: list[str], y: list[str], lo: int, hi: int, low: int, high: int) -> list[tuple[int, int]]:
    """Words that stand once in both stretches, as the longest run that keeps its order in both."""
    once: dict[str, int] = {}
    for i in range(lo, hi):
        once[x[i]] = -1 if x[i] in once else i
    there: dict[str, int] = {}
    for j in range(low, high):
        if once.get(y[j], -1) >= 0:
            there[y[j]] = -1 if y[j] in there else j
    pairs = sorted((once[w], j) for w, j in there.items() if j >= 0)
    ends: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):  # patience: piles of increasing ends
        p = bisect_left(ends, j)
        back[k] = at[p - 1] if p else -1
        if p == len(ends):
            ends.append(j)
            at.append(k)
        else:
            ends[p], at[p] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def changed(x: list[str], y: list[str]) -> list[tuple[int, int, int, int]]:
    """(i, j, k, m): the words x[i:j] became y[k:m], in order; everything between is equal.

    Equal ends are taken off; words that stand once on both sides then anchor the rest, and what lies between anchors is
    compared in the same way. A stretch without anchors is compared word by word if it is short, else it is replaced whole.
    """
    out = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        lo, hi, low, high = todo.pop()
        while lo < hi and low < high and x[lo] == y[low]:
            lo, low = lo + 1, low + 1
        while lo < hi and low < high and x[hi - 1] == y[high - 1]:
            hi, high = hi - 1, high - 1
        if lo == hi and low == high:
            continue
        if lo == hi or low == high:
            out.append((lo, hi, low, high))
        elif anchors := unique_anchors(x, y, lo, hi, low, high):
            for i, j in [*anchors, (hi, high)]:
                todo.append((lo, i, low, j))
                lo, low = i + 1, j + 1
        elif (hi - lo) * (high - low) <= PAIRS:
            codes = difflib.SequenceMatcher(a=x[lo:hi], b=y[low:high], autojunk=False).get_opcodes()
            out += [(lo + i, lo + j, low + k, low + m) for op, i, j, k, m in codes if op != "equal"]
        else:
            out.append((lo, hi, low, high))
    out.sort()
    merged: list[tuple[int, int, int, int]] = []
    for c in out:
        if merged and merged[-1][1] == c[0] and merged[-1][3] == c[2]:
            merged[-1] = (merged[-1][0], c[1], merged[-1][2], c[3])
        else:
            merged.append(c)
    return merged


def described_changes(rows: DataFrame, keep: list[str], old: str, new: str, most: int = 4, name: str = "change") -> DataFrame:
    """``keep`` plus the first ``most`` changes of each row in words: ``'old words' -> 'new words'``, joined by semicolons;
    "none" where all words are equal, null where either text is. Texts go to Python some at a time."""
    source = rows.select(*keep, F.col(old).alias("_old"), F.col(new).alias("_new"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)])

    def one(a: str | None, b: str | None) -> str | None:
        if a is None or b is None:
            return None
        x, y = a.split(), b.split()
        return "; ".join(f"'{' '.join(x[i:j])}' -> '{' '.join(y[k:m])}'" for i, j, k, m in changed(x, y)[:most]) or "none"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                some = batch.slice(lo, 64)
                said = [one(a.as_py(), b.as_py()) for a, b in zip(some.column(len(keep)), some.column(len(keep) + 1), strict=True)]
                yield pa.RecordBatch.from_arrays([*some.columns[: len(keep)], pa.array(said, pa.string())], names=[*keep, name])

    return source.mapInArrow(run, f"{head}, {name} string")
