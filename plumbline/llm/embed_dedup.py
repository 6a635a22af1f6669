"""Embedding near-dedup with randomised-rotation binary codes and stored correction factors."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import block_pairs, forest, sorted_groups, spread_join, stream_groups
from plumbline.operators.components import connected_components
from plumbline.session import cut_lineage


@lru_cache(maxsize=4)
def rotation(dim: int, bits: int, seed: int) -> np.ndarray:
    """bits x dim with orthonormal columns: zero-padding to ``bits`` dimensions, then a random rotation."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim, bits]).standard_normal((bits, dim)))
    return q * np.sign(np.diag(r))


def plan_bands(n: int, threshold: float, recall: float, bucket: int) -> tuple[int, int]:
    """(width, bands) so that a pair at the threshold meets with probability ``recall`` and a bucket of spread-out
    vectors holds about ``bucket`` of them."""
    width = min(30, max(4, math.ceil(math.log2(max(2, n) / bucket))))
    same = (1 - math.acos(threshold) / math.pi) ** width
    return width, math.ceil(math.log(1 - recall) / math.log(1 - same))


def to_vectors(batch: pa.RecordBatch, column: str) -> list[np.ndarray | None]:
    """Vectors as doubles; None where the vector is null, empty or holds a null or non-finite component."""
    out: list[np.ndarray | None] = []
    for x in batch.column(column).to_pylist():
        v = None if not x or None in x else np.array(x, np.float64)
        out.append(v if v is not None and np.isfinite(v).all() else None)
    return out


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, scaled first, since squares of very large or small components leave the doubles."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


#: Bits of a code at least: with fewer, estimates leave more pairs open than their bytes save.
LEAST_BITS = 128
#: Bits of a component where a vector is the query of an estimate.
LEVELS = 4


def quantise(turned: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bit planes, lowest, step) of rotated vectors (a row each) in ``LEVELS`` bits a component, rounded at random, so
    that the estimates made with them stay unbiased."""
    bits = turned.shape[1]
    low = turned.min(axis=1)
    step = (turned.max(axis=1) - low) / (2**LEVELS - 1)
    step[step == 0] = 1.0
    dither = np.random.default_rng([seed, bits]).random(bits)
    u = np.clip(np.floor((turned - low[:, None]) / step[:, None] + dither), 0, 2**LEVELS - 1).astype(np.uint8)
    planes = np.packbits((u[:, None, :] >> np.arange(LEVELS, dtype=np.uint8)[None, :, None]) & 1, axis=2)
    return planes.reshape(len(turned), -1), low, step


def _encode(bits: int, width: int, bands: int, seed: int, kind: str):
    """(id, vector as bytes, dim, code, factor, planes, lowest, step, band keys) per row; null but for the id where it
    takes no part."""
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.float32(), pa.binary(), pa.float32(), pa.float32(), pa.list_(pa.int64())]

    def run(batches):
        for batch in batches:
            ids, vectors = batch.column(0).to_pylist(), to_vectors(batch, batch.schema.names[1])
            rows: list = [(i, *[None] * 8) for i in ids]
            by_dim: dict[int, list[int]] = {}
            for k, v in enumerate(vectors):
                if v is not None and v.any():
                    by_dim.setdefault(len(v), []).append(k)
            for dim, at in by_dim.items():
                x = np.stack([vectors[k] for k in at])
                turned = units(x) @ rotation(dim, bits, seed).T
                code = turned > 0
                factor = np.abs(turned).sum(axis=1) / math.sqrt(bits)  # <code, vector>
                planes, low, step = quantise(turned, seed)
                keys = (code[:, : width * bands].reshape(len(at), bands, width) @ (1 << np.arange(width, dtype=np.int64))).tolist()
                packed, raw = np.packbits(code, axis=1), (x + 0.0).astype(kind)
                for n, k in enumerate(at):
                    rows[k] = (ids[k], raw[n].tobytes(), dim, packed[n].tobytes(), factor[n], planes[n].tobytes(), low[n], step[n], keys[n])
            cols = list(zip(*rows, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=["id", "raw", "dim", "code", "factor", "planes", "low", "step", "keys"])

    return run


class Codes:
    """The codes of a group's rows, and which of its pairs their estimates leave open."""

    def __init__(self, t: dict, s: slice, bits: int, width: int, bands: int, threshold: float, epsilon: float):
        n = s.stop - s.start
        self.bits, self.threshold, self.epsilon = bits, threshold, epsilon
        packed = np.frombuffer(b"".join(t["code"][s]), np.uint8).reshape(n, -1)
        self.code = packed.view(np.uint64)
        self.planes = np.frombuffer(b"".join(t["planes"][s]), np.uint64).reshape(n, LEVELS, -1)
        self.factor, self.low, self.step = (t[c][s].astype(np.float64) for c in ("factor", "low", "step"))
        self.ones = np.bitwise_count(self.code).sum(axis=1, dtype=np.int64)
        self.total = np.bitwise_count(self.planes).sum(axis=2, dtype=np.int64) @ (1 << np.arange(LEVELS))
        key_bits = np.unpackbits(packed, axis=1)[:, : width * bands].reshape(n, bands, width)
        self.keys = key_bits @ (1 << np.arange(width, dtype=np.int64))

        # Bits differ with the angle's share of a half turn: at the threshold this many, with more slack than estimates get.
        share = math.acos(min(1.0, threshold)) / math.pi
        self.most = math.floor(bits * share + (epsilon + 1.5) * math.sqrt(bits * share * (1 - share))) + 1

    def estimates(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimate, slack) of the inner product of each row of ``a`` (as a code) with that of ``b`` (as a query).

        <code, query> / factor is unbiased; its standard error is about sqrt(1 - f^2) / f / sqrt(bits - 1), and that of
        the query's rounding at most half a step. Products are counts of common bits: no vector is touched.
        """
        common = np.zeros(len(a), np.int64)
        for w in range(self.code.shape[1]):
            code = self.code[a, w]
            for level in range(LEVELS):
                common += np.bitwise_count(code & self.planes[b, level, w]).astype(np.int64) << level
        f = self.factor[a]
        signs = self.low[b] * (2 * self.ones[a] - self.bits) + self.step[b] * (2 * common - self.total[b])
        error = np.sqrt(np.maximum(0, 1 - f**2) / max(1, self.bits - 1) + (self.step[b] / 2) ** 2) / f
        return signs / math.sqrt(self.bits) / f, self.epsilon * error + 1e-5

    def open_pairs(self, a: np.ndarray, b: np.ndarray, cross: bool, band: int, count: dict | None):
        """Pairs (one of ``a``, one of ``b``; each once where they are the same rows) that the bounds can't rule out and
        whose first common band is ``band``, so that no pair counts in two; a part of ``a`` at a time.

        Differing bits are counted for all pairs, inner products estimated for those that this leaves."""
        rows = max(1, 2**20 // max(1, len(b)))
        for k in range(0, len(a), rows):
            differ = np.zeros((len(a[k : k + rows]), len(b)), np.uint16)
            for w in range(self.code.shape[1]):
                differ += np.bitwise_count(self.code[a[k : k + rows], w][:, None] ^ self.code[b, w][None, :])
            may = differ <= self.most
            if not cross:
                may &= np.arange(k, k + len(may))[:, None] < np.arange(len(b))[None, :]
            i, j = np.nonzero(may)
            i, j = a[k + i], b[j]
            guess, slack = self.estimates(i, j)
            stay = guess + slack >= self.threshold
            i, j = i[stay], j[stay]
            if count is not None:
                count["pairs"] = count.get("pairs", 0) + (may.size if cross else int((np.arange(k, k + len(may))[:, None] < np.arange(len(b))[None, :]).sum()))
                count["exact"] = count.get("exact", 0) + len(i)
            for c in range(0, len(i), 65536):  # bounded memory
                p, q = i[c : c + 65536], j[c : c + 65536]
                first = (self.keys[p] == self.keys[q]).argmax(axis=1) == band
                yield p[first], q[first]


GROUP = ["bucket", "bi", "bj"]


def _sides(t: dict, s: slice) -> tuple[np.ndarray, np.ndarray, bool, int]:
    """(rows of one side, of the other, whether these differ, number of the band) of a group."""
    cross = bool(t["bi"][s.start] != t["bj"][s.start])
    mine = np.flatnonzero(t["side"][s] == 0) if cross else np.arange(s.stop - s.start)
    return mine, np.flatnonzero(t["side"][s] == 1) if cross else mine, cross, int(t["bucket"][s.start] >> 30) & 0x3FFF


def _screen(make, count: dict | None = None):
    """The rows of each group that have an open pair in it: only these fetch their vectors."""
    names = [*GROUP, "side", "row"]

    def run(batches):
        for t, at in stream_groups(batches, GROUP):
            stay = np.zeros(len(t["row"]), bool)
            for lo, hi in zip(at, np.append(at[1:], len(stay)), strict=True):
                mine, other, cross, band = _sides(t, slice(lo, hi))
                for i, j in make(t, slice(lo, hi)).open_pairs(mine, other, cross, band, count):
                    stay[lo + i] = stay[lo + j] = True
            yield pa.RecordBatch.from_arrays([pa.array(t[c][stay]) for c in names], names=names)

    return run


def _verify(make, threshold: float, kind: str, count: dict | None = None):
    """Exact cosines of each group's open pairs.

    Emits (row, id, peer, links): peer is the id of the first vector of the row's component in this group, links the
    copies linked by its pairs.
    """

    def run(batches):
        for t, at in stream_groups(batches, GROUP):
            out = []
            for lo, hi in zip(at, np.append(at[1:], len(t["row"])), strict=True):
                out += group(t, slice(lo, hi))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["row", "id", "peer", "links"])

    def group(t, s):
        n = s.stop - s.start
        x = units(np.frombuffer(b"".join(t["raw"][s]), kind).reshape(n, -1).astype(np.float64))
        mine, other, cross, band = _sides(t, s)
        links, copies, local = np.zeros(n, np.int64), t["copies"][s], np.zeros((n, n), bool)
        for i, j in make(t, s).open_pairs(mine, other, cross, band, count):
            ok = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
            p, q = i[ok], j[ok]
            np.add.at(links, p, copies[q])
            np.add.at(links, q, copies[p])
            local[p, q] = local[q, p] = True
        touched = np.flatnonzero(links)
        if not len(touched):
            return []
        ids = t["id"][s]
        return [(t["row"][s][touched], ids[touched], ids[touched][forest(local[np.ix_(touched, touched)])], links[touched])]

    return run


def embedding_near_dedup(
    vectors: DataFrame, threshold: float = 0.9, recall: float = 0.98, bucket: int = 1024, cap: int = 2048, epsilon: float = 3.0, seed: int = 42,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Each unit vector is padded and rotated at random; the signs are its code, and the inner product of code and
    vector its stored correction factor. Bands of the code's bits propose pairs: their width grows with the logarithm
    of the number of vectors (so buckets of spread-out vectors keep their size), and their number is what brings a
    pair at the threshold together with probability ``recall``; closer pairs meet more surely. In a bucket only codes,
    factors and four bits a component meet: the estimate <code, other> / factor, counted from common bits, is
    unbiased, and pairs whose estimate plus ``epsilon`` standard errors stays below the threshold are passed over. The
    vectors of rows that have an open pair are fetched, once for the pair's first common band, and decide it exactly
    in double precision. A link found is therefore never false.

    Equal vectors collapse to one row with a number of copies before anything is compared; buckets over ``cap``
    rows are cut into blocks that meet pairwise. A pair counts in the first band that its codes share, and a group
    emits a spanning forest, so nothing grows with the square of a group but arithmetic.

    Defined cases: null, empty, zero and non-finite vectors and those with a null component have no links and are
    their own component; vectors of different length never link; rows that repeat an id count as rows of their own
    and the id gets a row for each; a null id counts as a link of others but never names a component unless alone;
    an empty table gives an empty table; other columns are ignored.
    """
    n, dim = vectors.agg(F.count(F.lit(1)), F.max(F.size(vector_col))).first()
    width, bands = plan_bands(n, threshold, recall, bucket)
    dim = max(1, dim or 1)
    kind = "f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "f8"
    bits = 64 * math.ceil(max(dim, width * bands, LEAST_BITS) / 64)
    coded = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(
        _encode(bits, width, bands, seed, kind), "id long, raw binary, dim int, code binary, factor float, planes binary, low float, step float, keys array<long>"
    )
    coded = cut_lineage(coded.withColumns({"same": F.md5("raw"), "row": F.monotonically_increasing_id()}))
    # Of equal vectors the row with the smallest id stands for all; rows are told apart by a number of their own.
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "row")))
    heads = cut_lineage(coded.where("same is not null").groupBy("same").agg(first.alias("head"), F.count(F.lit(1)).alias("copies")))
    heads = heads.select("same", F.col("head.id").alias("id"), F.col("head.row").alias("row"), "copies")
    reps = spread_join(coded.drop("same", "id"), heads.where("row is not null").select("row", "id", "copies"), ["row"], "row")
    codes = ["code", "factor", "planes", "low", "step"]
    banded = reps.select("row", *codes, "dim", F.posexplode("keys").alias("band", "value"))
    # Length of the vectors, number of the band and its bits in one long.
    key = F.shiftleft(F.col("dim").cast("long"), 44).bitwiseOR(F.shiftleft(F.col("band").cast("long"), 30)).bitwiseOR(F.col("value"))
    grouped = block_pairs(banded.select(key.alias("bucket"), "row", *codes), "bucket", "row", cap)

    def make(t, s):
        return Codes(t, s, bits, width, bands, threshold, epsilon)

    open_ = sorted_groups(grouped.select(*GROUP, "side", "row", *codes), GROUP).mapInArrow(_screen(make), "bucket long, bi int, bj int, side int, row long")
    open_ = open_.join(reps.select("row", "id", "copies", "raw", *codes), "row")
    found = cut_lineage(sorted_groups(open_.select(*GROUP, "side", "row", "id", "copies", "raw", *codes), GROUP).mapInArrow(_verify(make, threshold, kind), "row long, id long, peer long, links long"))
    links = found.groupBy("row").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("id").alias("a"), F.col("peer").alias("b")))
    known = heads.join(links, "row", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    known = known.where("copies > 1 or links is not null").select("same", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    out = spread_join(coded.select("id", "same", "row"), known, ["same"], "row", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )
