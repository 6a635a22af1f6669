"""SimHash near-dedup with deletion-variant signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import block_pairs, forest, fresh, map_texts, sorted_groups, spread_join, stream_groups
from plumbline.operators.components import connected_components
from plumbline.session import cut_lineage

#: Row b: the eight bits of byte b, highest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_COLUMN = np.arange(8, dtype=np.int64) * 256


def _fingerprinter(words: int):
    from xxhash import xxh64_digest

    def one(text: str | None):
        # bytes.split() splits at exactly [\x20\x09-\x0D], and bytes.lower() changes A-Z only.
        w = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not w:
            return (0,)
        counts, n = np.zeros(2048, np.int64), max(1, len(w) - words + 1)
        for at in range(0, n, 16384):
            part = w[at : at + 16384 + words - 1]
            runs = zip(*(part[k:] for k in range(words)), strict=False) if len(w) >= words else [part]
            h = np.frombuffer(b"".join([xxh64_digest(b" ".join(s), 42) for s in runs]), np.uint8)
            counts += np.bincount((h.reshape(-1, 8) + _COLUMN).ravel(), minlength=2048)
        ones = np.einsum("kb,bj->kj", counts.reshape(8, 256), _BITS).ravel()
        return (int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True),)

    return one


def fingerprints(docs: DataFrame, keep: list[str], words: int = 3, text_col: str = "text") -> DataFrame:
    """``keep`` plus ``fp``: per bit, whether over half of the shingles' XXH64 (seed 42) have it set."""
    return map_texts(docs, lambda: _fingerprinter(words), "fp bigint", keep, text_col)


def _edges(distance: int):
    def run(batches):
        for t, at in stream_groups(batches, ["key", "bi", "bj"]):
            fp, rep, side = t["fp"].view(np.uint64), t["rep"], t["side"]
            ends = np.append(at[1:], len(fp))
            sizes, (a, b) = ends - at, ([], [])
            # Small groups: all rows against the row d places further on, for all groups at once.
            small = np.repeat(sizes <= 16, sizes)
            group = np.repeat(np.arange(len(at)), sizes)
            pair_side = np.repeat(t["bi"][at] == t["bj"][at], sizes)
            for d in range(1, min(16, int(sizes.max()))):
                ok = small[:-d] & (group[:-d] == group[d:]) & (pair_side[:-d] | (side[:-d] != side[d:])) & (np.bitwise_count(fp[:-d] ^ fp[d:]) <= distance)
                a.append(rep[:-d][ok])
                b.append(rep[d:][ok])
            for g in np.flatnonzero(sizes > 16):
                s = slice(at[g], ends[g])
                f, r, o = fp[s], rep[s], side[s]
                near = np.bitwise_count(f[:, None] ^ f[None, :]) <= distance
                if t["bi"][at[g]] != t["bj"][at[g]]:
                    near &= o[:, None] != o[None, :]
                root = forest(near)
                a.append(r[root])
                b.append(r)
            a, b = np.concatenate(a or [rep[:0]]), np.concatenate(b or [rep[:0]])
            ok = a != b
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[ok]), pa.array(np.maximum(a, b)[ok])], names=["a", "b"])

    return run


def variants(prints: DataFrame, distance: int = 3) -> DataFrame:
    """A row per fingerprint, segment and bit of the segment: the segment with that bit deleted.

    ``distance // 2 + 1`` segments: bits that differ, dealt over them, leave one with at most one, and there the
    variants without that bit agree. ``key`` packs the number of the variant and the bits that stay.
    """
    parts = distance // 2 + 1
    cuts = [64 * k // parts for k in range(parts + 1)]
    masks = [((1 << hi) - (1 << lo), 1 << bit) for lo, hi in zip(cuts, cuts[1:], strict=False) for bit in range(lo, hi)]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    made = F.array(*[F.lit(signed(seg & ~bit)) for seg, bit in masks])
    out = prints.select("fp", "rep", F.posexplode(made).alias("variant", "mask"))
    bits = F.col("fp").bitwiseAND(F.col("mask"))
    if parts == 2:  # 32 bits and the number of the variant fit a long
        half = F.when(F.col("variant") < 32, bits.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(bits, 32))
        key = F.shiftleft(F.col("variant").cast("long"), 32).bitwiseOR(half)
    else:
        key = F.xxhash64("variant", bits)  # a clash only adds rows to a comparison
    return out.select(key.alias("key"), "fp", "rep")


def edges_of(prints: DataFrame, distance: int = 3, cap: int = 2048) -> DataFrame:
    """(a, b): links of distinct fingerprints (fp, rep) within ``distance`` bits, enough to join all that are."""
    grouped = block_pairs(variants(prints, distance), "key", "fp", cap, exploded=True)
    return sorted_groups(grouped, ["key", "bi", "bj"]).select("key", "bi", "bj", "side", "fp", "rep").mapInArrow(_edges(distance), "a long, b long")


def components(prints: DataFrame, distance: int = 3, cap: int = 2048) -> DataFrame:
    """(rep, component_id) of distinct fingerprints (fp, rep) that link with another one."""
    return connected_components(edges_of(prints, distance, cap)).select(F.col("node").alias("rep"), F.col("root").alias("component_id"))


def simhash_components(docs: DataFrame, words: int = 3, distance: int = 3, cap: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, fp (long), fingerprint (hex), component_id.

    Exact copies collapse to one fingerprint before any comparison. Distinct fingerprints are cut into segments,
    each segment is indexed without one of its bits, variants meet in an equality join, and the full fingerprints
    are verified. A variant that many fingerprints share is cut into blocks of about ``cap`` rows that meet pairwise,
    so that a large group spreads over tasks; a task emits a spanning forest of what it found, not all pairs.
    component_id is the smallest id reachable by links of at most ``distance`` differing bits.

    Defined cases: null and empty texts and texts of white space have fingerprint zero and link like any other;
    fewer words than a shingle count as one shingle; rows with equal ids are answered each by its own text; null
    ids are left out of the links: their component is that of their fingerprint, null if no other id has it; an
    empty table gives an empty table; other columns are ignored.
    """
    own = cut_lineage(fingerprints(docs, [id_col], words, text_col))
    prints = own.groupBy("fp").agg(F.min(id_col).alias("rep"), F.count(F.lit(1)).alias("n"))
    linked = components(prints.where("rep is not null"), distance, cap)
    # Only prints that several rows have or that link need a component; any other row is its own.
    roots = prints.join(linked, "rep", "left").where("n > 1 or component_id is not null").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return spread_join(own, roots, ["fp"], id_col, "left").select(id_col, "fp", hexed.alias("fingerprint"), F.coalesce("component_id", id_col).alias("component_id"))


#: Ids up to this number are broadcast (16 MB), more go through a shuffle.
BROADCAST_IDS = 1_000_000


def bounded(ids: DataFrame) -> DataFrame:
    """``ids`` (materialised) with a broadcast hint if they are few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; fewer words than that are one shingle, none are none."""
    from xxhash import xxh3_64_digest

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    runs = zip(*(w[k:] for k in range(words)), strict=False) if len(w) >= words else [w] if w else []
    return np.unique(np.frombuffer(b"".join([xxh3_64_digest(b" ".join(s)) for s in runs]), np.uint64))


def _min_hasher(words: int, bands: int, rows: int):
    """(hash of the word sequence, its SimHash, a key for each band of ``rows`` min-hashes of the shingles, one bit of
    each of the first 128 min-hashes in two halves)."""
    from xxhash import xxh3_128_hexdigest

    fingerprint = _fingerprinter(3)

    salt, odd, weight, mix = np.random.default_rng(42).integers(0, 2**64, (4, bands * rows), np.uint64)
    odd, mix = odd | np.uint64(1), mix | np.uint64(1)

    def one(text: str | None):
        w = (text or "").encode("utf-8", "surrogatepass").lower().split()
        content, found = xxh3_128_hexdigest(b" ".join(w)), shingle_set(text, words)
        if not len(found):
            return content, 0, [], 0, 0
        if not bands:
            return content, *fingerprint(text), [], 0, 0
        low = np.full(bands * rows, 2**64 - 1, np.uint64)
        for k in range(0, len(found), 256):  # stays in the cache
            np.minimum(low, ((found[k : k + 256, None] ^ salt) * odd).min(axis=0), out=low)
        keys = (low * weight).reshape(bands, rows).sum(axis=1, dtype=np.uint64)
        data = np.packbits(((low * mix)[:128] >> np.uint64(63)).astype(np.uint8)).tobytes()
        return content, *fingerprint(text), keys.view(np.int64).tolist(), int.from_bytes(data[:8], "big", signed=True), int.from_bytes(data[8:16], "big", signed=True)

    return one


def _close(distance: int):
    """A forest of the pairs in a group within ``distance`` of 128 bits."""

    def run(batches):
        for t, at in stream_groups(batches, ["key", "bi", "bj"]):
            hi, lo, rep, side = t["hi"].view(np.uint64), t["lo"].view(np.uint64), t["rep"], t["side"]
            ends, a, b = np.append(at[1:], len(rep)), [rep[:0]], [rep[:0]]
            pairs = ends - at == 2
            p = at[pairs]
            cross = t["bi"][p] != t["bj"][p]
            near = np.bitwise_count(hi[p] ^ hi[p + 1]).astype(int) + np.bitwise_count(lo[p] ^ lo[p + 1]) <= distance
            near &= ~cross | (side[p] != side[p + 1])
            a.append(rep[p[near]])
            b.append(rep[p[near] + 1])
            for g in np.flatnonzero(ends - at > 2):
                s = slice(at[g], ends[g])
                link = np.bitwise_count(hi[s, None] ^ hi[None, s]).astype(np.int16) + np.bitwise_count(lo[s, None] ^ lo[None, s]) <= distance
                if t["bi"][at[g]] != t["bj"][at[g]]:
                    link &= side[s, None] != side[None, s]
                a.append(rep[s][forest(link)])
                b.append(rep[s])
            a, b = np.concatenate(a), np.concatenate(b)
            ok = a != b
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[ok]), pa.array(np.maximum(a, b)[ok])], names=["a", "b"])

    return run


def _alike(similarity: float):
    """A forest of the pairs of a group whose shingle sets have at least that Jaccard similarity, computed exactly.

    A row is compared with rows of other components only: in a group of copies that is a few each.
    """

    def run(batches):
        for t, at in stream_groups(batches, ["root", "bi", "bj"], flush=2048):
            ends, a, b = np.append(at[1:], len(t["rep"])), [], []
            for lo, hi in zip(at, ends, strict=True):
                cross = t["bi"][lo] != t["bj"][lo]
                sets = [np.frombuffer(x, np.uint64) for x in t["shingles"][lo:hi]]
                rep, side = t["rep"][lo:hi], t["side"][lo:hi]
                order = np.argsort([len(x) for x in sets], kind="stable")
                top = list(range(hi - lo))

                def find(x, top=top):
                    while top[x] != x:
                        top[x] = top[top[x]]
                        x = top[x]
                    return x

                for n, i in enumerate(order.tolist()):
                    x = sets[i]
                    for j in reversed(order[:n].tolist()):  # nearest sizes first
                        y = sets[j]
                        if len(y) < similarity * len(x) - 1e-9:
                            break
                        if (cross and side[i] == side[j]) or find(i) == find(j):
                            continue
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        if both >= similarity * (len(x) + len(y) - both) - 1e-9:
                            top[max(find(i), find(j))] = min(find(i), find(j))
                            a.append(rep[i])
                            b.append(rep[j])
            a, b = np.array(a, np.int64), np.array(b, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, bands: int = 32, rows: int = 4, distance: int = 32, cap: int = 1024, simhash_distance: int = 3,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) of every document whose shingle set has a Jaccard similarity of ``similarity`` or more with
    another's; of equal word sequences those that aren't the one with the smallest id.

    Equal word sequences collapse first. SimHash fingerprints then meet by deletion variants, as in
    ``simhash_components``: those within ``simhash_distance`` bits join loose components, as do equal ones. A copy with a block more or less is farther
    away than that, so min-hashes find what SimHash leaves: two shingle sets share each of their min-hashes with a
    probability equal to their similarity J, wherever the copy was changed and however long it is. ``bands`` of
    ``rows`` min-hashes are a second index (none with 0 bands): a pair meets in none with probability
    (1 - J^rows)^bands, 5 in 10^8 at 0.8. One bit of each of 128 min-hashes is a sketch, of which a pair differs in
    (1 - J) / 2 of the bits, 12.8 at 0.8, and in more than ``distance`` less than once in 10^6. Pairs within
    ``distance`` bits join loose components too, and inside all these, in blocks of about ``cap`` rows that meet
    pairwise, exact similarities decide.

    Defined cases: texts without words are copies of one another; fewer words than a shingle count as one shingle;
    null ids take no part; an empty table gives an empty table; other columns are ignored.
    """
    texts = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    own = cut_lineage(map_texts(texts, lambda: _min_hasher(words, bands, rows), "content string, fp bigint, keys array<bigint>, hi bigint, lo bigint", ["id"]))
    prints = own.groupBy("content").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("hi").alias("hi"), F.first("lo").alias("lo"))
    # Texts of one fingerprint are a star; the fingerprints themselves meet by their variants.
    heads = prints.groupBy("fp").agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("several"))
    near = edges_of(heads.select("fp", F.col("head").alias("rep")), simhash_distance)
    near = near.union(spread_join(prints.select("fp", "rep"), heads.where("several > 1").select("fp", "head"), ["fp"], "rep").select("head", "rep").where("head <> rep"))
    if bands:
        grouped = block_pairs(prints.select(F.explode("keys").alias("key"), "hi", "lo", "rep"), "key", "rep", 2 * cap, exploded=True)
        near = near.union(sorted_groups(grouped, ["key", "bi", "bj"]).select("key", "bi", "bj", "side", "hi", "lo", "rep").mapInArrow(_close(distance), "a long, b long"))
    loose = connected_components(near)
    wanted = bounded(loose)
    sets = map_texts(texts.join(wanted, texts["id"] == wanted["node"]).select("id", "root", "text"), lambda: lambda t: (shingle_set(t, words).tobytes(),), "shingles binary", ["id", "root"])
    # A repeated id with several texts is compared by each of them.
    blocks = block_pairs(sets.select(F.col("id").alias("rep"), "root", "shingles").dropDuplicates(["rep", "shingles"]), "root", "rep", cap)
    edges = sorted_groups(blocks, ["root", "bi", "bj"]).select("root", "bi", "bj", "side", "rep", "shingles").mapInArrow(_alike(similarity), "a long, b long")
    found = connected_components(edges)
    groups = prints.select("content", "rep", "n").join(found, F.col("rep") == F.col("node"), "left").where("n > 1 or root is not null").select("content", "rep", "root")
    copies = spread_join(own.select("id", "content"), groups, ["content"], "id")
    return copies.where("root is not null or id <> rep").select("id", F.coalesce("root", "rep").alias("component_id"))


def near_dedup(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without near copies: of each component the document with the smallest id stays.

    Texts meet the ids that leave in a broadcast join while these are few, in one shuffle otherwise. Rows with a null
    id stay; rows that repeat an id stay or leave together. See ``near_copies``.
    """
    found = near_copies(docs, words, similarity, id_col=id_col, text_col=text_col)
    gone = fresh(docs, "_gone")
    leave = cut_lineage(found.where("id <> component_id").select(F.col("id").alias(gone)).distinct())
    return docs.join(bounded(leave), F.col(f"`{id_col}`") == F.col(gone), "left_anti")
