"""Language ID with hyperdimensional profiles of letter n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import map_texts, small_batches

#: Unit document vectors are rounded to this many steps before they are bundled, so that sums don't depend on order.
STEPS = 1_000_000
_tables: dict = {}


def _letters() -> np.ndarray:
    """Which code points are letters; built once a process."""
    if "letters" not in _tables:
        _tables["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _tables["letters"]


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, (text or "").lower()))


class Encoder:
    """Binds permuted random letter vectors into n-gram vectors and bundles these into document vectors.

    Every symbol (a letter in lower case, or a gap between words) has a random vector of +1 and -1 that follows from
    the seed and its code point alone. An n-gram's vector is the product of its symbols' vectors, each rotated by its
    distance to the end. Vectors of n-grams seen lately are held, in bounded number.
    """

    def __init__(self, size: int, n: int, seed: int, hold: int = 40_000):
        self.size, self.n, self.seed, self.hold = size, n, seed, hold
        self.symbols: dict[int, np.ndarray] = {}
        self.keys, self.rows, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        self.held = np.zeros((1024, size), np.float32)

    def symbol(self, code: int) -> np.ndarray:
        if code not in self.symbols:
            if len(self.symbols) > 20_000:
                self.symbols.clear()
            self.symbols[code] = np.random.default_rng([self.seed, code]).choice(np.array([-1, 1], np.int8), self.size)
        return self.symbols[code]

    def _add(self, fresh: np.ndarray) -> None:
        if self.used + len(fresh) > self.hold:
            self.keys, self.rows, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        if self.used + len(fresh) > len(self.held):
            grown = np.zeros((max(2 * len(self.held), self.used + len(fresh)), self.size), np.float32)
            grown[: self.used] = self.held[: self.used]
            self.held = grown
        for j, key in enumerate(fresh.tolist()):
            v = np.ones(self.size, np.int8)
            for k in range(self.n):
                v = v * np.roll(self.symbol((key >> (21 * k)) & 0x1FFFFF), k)
            self.held[self.used + j] = v
        keys, rows = np.concatenate([self.keys, fresh]), np.concatenate([self.rows, np.arange(self.used, self.used + len(fresh))])
        order = np.argsort(keys)
        self.keys, self.rows, self.used = keys[order], rows[order], self.used + len(fresh)

    def __call__(self, text: str | None) -> np.ndarray | None:
        """The unit vector of a whole text, None if it has no letter."""
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        letter = _letters()[codes] if len(codes) else np.zeros(0, bool)
        if not letter.any():
            return None
        # One gap before, between and after the words.
        symbols = np.where(letter, codes, 0)
        symbols = np.concatenate([[0], symbols[letter | np.concatenate([[False], letter[:-1]])], [0]])
        if symbols[-2] == 0:
            symbols = symbols[:-1]
        if len(symbols) < self.n:
            symbols = np.concatenate([symbols, np.zeros(self.n - len(symbols), np.int64)])
        m = len(symbols) - self.n + 1
        grams = sum(symbols[k : k + m] << (21 * (self.n - 1 - k)) for k in range(self.n))
        found, counts = np.unique(grams, return_counts=True)
        total = np.zeros(self.size, np.float32)
        for at in range(0, len(found), 8192):  # bounded memory
            part = found[at : at + 8192]
            where = np.searchsorted(self.keys, part)
            known = where < len(self.keys)
            known[known] = self.keys[where[known]] == part[known]
            if not known.all():
                if self.used + (~known).sum() > self.hold:
                    known[:] = False
                    self.used = self.hold  # empties what is held
                self._add(part[~known])
                where = np.searchsorted(self.keys, part)
            total += counts[at : at + 8192].astype(np.float32) @ self.held[self.rows[where]]
        length = np.linalg.norm(total)
        return total / length if length else total


def encoder(size: int, n: int, seed: int) -> Encoder:
    key = (size, n, seed)
    if key not in _tables:
        _tables[key] = Encoder(size, n, seed)
    return _tables[key]


class Profiles:
    """Language prototypes, their common part taken out."""

    def __init__(self, names: list[str], sums: np.ndarray, size: int, n: int, seed: int):
        self.names, self.size, self.n, self.seed = names, size, n, seed
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        unit = sums / np.where(length == 0, 1, length)
        self.common = unit.mean(axis=0) if len(names) > 1 else np.zeros(size)
        centred = unit - self.common
        length = np.linalg.norm(centred, axis=1, keepdims=True)
        self.prototypes = (centred / np.where(length == 0, 1, length)).astype(np.float32)
        self.common = self.common.astype(np.float32)

    def __call__(self, text: str | None) -> tuple[str, float]:
        v = encoder(self.size, self.n, self.seed)(text) if self.names else None
        if v is None:
            return "und", 0.0
        v = v - self.common
        cosines = self.prototypes @ v / (np.linalg.norm(v) or 1)
        k = int(cosines.argmax())
        return self.names[k], float(min(1.0, max(0.0, cosines[k])))


def train_profiles(docs: DataFrame, usable: Column, size: int = 512, n: int = 3, seed: int = 42, train_docs: int = 4000,
                   id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Prototypes from at most about ``train_docs`` rows of each language, chosen by a hash of their ids.

    Each task bundles its documents into one vector a language; what is summed over tasks and reaches the driver is
    one vector for each language, whatever the number of documents.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.col(text_col).alias("t"))
    counts = rows.groupBy("l").count().collect()
    if not counts:
        return Profiles([], np.zeros((0, size)), size, n, seed)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["l"], min(1.0, train_docs / r["count"]))])
    chosen = rows.where(F.pmod(F.xxhash64("i", F.lit(seed)), F.lit(1_000_000)) < share[F.col("l")] * 1_000_000).select("l", "t")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sums = encoder(size, n, seed), {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = encode(text)
                if v is not None:
                    sums[lang] = sums.get(lang, 0) + np.rint(v.astype(np.float64) * STEPS).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["l", "v"])

    sums = chosen.mapInArrow(bundle, "l string, v array<long>").select("l", F.posexplode("v").alias("at", "x")).groupBy("l", "at").agg(F.sum("x").alias("x")).collect()
    names = sorted({r["l"] for r in sums})
    total = np.zeros((len(names), size))
    at = {x: k for k, x in enumerate(names)}
    for r in sums:
        total[at[r["l"]], r["at"]] = r["x"]
    return Profiles(names, total, size, n, seed)


def identify(docs: DataFrame, profiles: Profiles, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` plus lang_pred and score, the cosine with the nearest prototype, from 0 to 1.

    Defined cases: a null text or one without a letter is ``und`` with score 0, as is everything if no row could be
    learned from; ties go to the smaller name; an empty table gives an empty table; rows that repeat are answered
    each; columns not in ``keep`` are ignored.
    """
    return map_texts(docs, lambda: profiles, "lang_pred string, score double", keep, text_col)


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % 4 == 2
