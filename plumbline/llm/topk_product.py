"""Exact top-k inner product search by norm buckets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.embed_dedup import to_vectors
from plumbline.session import cut_lineage

#: Products of doubles are exact sums of integers below this bound.
EXACT = 2.0**53
LONG = 2**63 - 1


#: Bytes of vectors that a block of candidates, and a batch of queries, may have: what a task holds of either side.
BLOCK_BYTES = 1 << 26
#: For the first look: rows of one dimension, their bytes, and dimensions. Queries of other dimensions go without.
SEED_ROWS, SEED_BYTES, SEED_DIMS = 1024, 1 << 23, 8


def _scaled(scale: float, ratio: float):
    """(vec_id, asked, dim, integer vector as doubles, length, number of the length bucket); rows that take no part go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, asked, v in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), to_vectors(batch, batch.schema.names[1]), strict=True):
                if v is None:
                    continue
                x = np.floor(scale * v)
                if not np.isfinite(x).all():
                    x = np.clip(x, -np.finfo(float).max, np.finfo(float).max)
                most = np.abs(x).max()
                length = float(most * math.sqrt(((x / most) ** 2).sum())) if most else 0.0
                length = min(length, np.finfo(float).max)
                rows.append((i, bool(asked), len(x), x.tobytes(), length, math.floor(math.log(length) / math.log(ratio)) if length else -(2**31)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=["vec_id", "asked", "dim", "ints", "length", "bucket"])

    return run


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors as longs: one matrix product while doubles are exact, Python integers
    beyond, held at the ends of the long range."""
    if q.size == 0 or c.size == 0 or np.abs(q).max() * np.abs(c).max() * q.shape[1] < EXACT:
        return (q @ c.T).astype(np.int64)
    a, b = ([[int(x) for x in row] for row in m] for m in (q, c))
    return np.array([[max(-LONG - 1, min(LONG, sum(x * y for x, y in zip(r, s, strict=True)))) for s in b] for r in a], np.int64)


def _unpack(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, dim)


def best(q_ids, q, q_len, floor, c_ids, c, c_len, k: int, high: float = 0.6, tell: dict | None = None):
    """Per query the candidates of one block that can still be among its k best: (query, candidate, score).

    floor: a score that the query's k-th best surely reaches (-inf: none known). A candidate can reach it only if
    cosine >= floor / (|q| |c|), so the block's longest vector gives the block's local threshold for each query.
    Where thresholds are high, the coordinate in which the unit query is largest bounds the same coordinate of the
    unit candidate, and of the query's few largest coordinates the one with the fewest candidates in range is taken;
    else only candidates of sufficient length stay. Products of what stays are computed exactly.
    """
    top = c_len.max()
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        local = np.where(q_len * top > 0, floor / q_len / top, np.where(floor > 0, np.inf, -np.inf))
    live = np.flatnonzero(local <= 1 + 1e-9)
    out = []
    if not len(live):
        return out
    by_coordinate = float(np.median(local[live])) >= high
    if tell is not None:
        tell["coordinate" if by_coordinate else "length"] = tell.get("coordinate" if by_coordinate else "length", 0) + 1
    order = np.argsort(-c_len, kind="stable")
    c_ids, c, c_len = c_ids[order], c[order], c_len[order]
    if by_coordinate:
        unit = c / np.maximum(c_len, 1e-300)[:, None]
        ranked = np.argsort(unit, axis=0, kind="stable")
        columns = np.take_along_axis(unit, ranked, axis=0)
    blocks = []
    for i in live:
        t = local[i]
        if by_coordinate and t > 0:
            u = q[i] / q_len[i]
            chosen = None
            for f in np.argsort(-np.abs(u))[:4]:
                half = math.sqrt(max(0.0, (1 - min(t, 1.0) ** 2) * (1 - min(1.0, u[f] ** 2)))) + 1e-7
                low = -1.0 if u[f] <= -t else t * u[f] - half
                high_end = 1.0 if u[f] >= t else t * u[f] + half
                lo, hi = np.searchsorted(columns[:, f], [low - 1e-7, high_end + 1e-7])
                if chosen is None or hi - lo < chosen[1] - chosen[0]:
                    chosen = (lo, hi, f)
            keep = ranked[chosen[0] : chosen[1], chosen[2]]
        elif t > 0:
            keep = np.arange(np.searchsorted(-c_len, -floor[i] / q_len[i] * (1 - 1e-9), side="right"))
        else:
            keep = None  # all
        blocks.append((i, keep))
    whole = [i for i, keep in blocks if keep is None or len(keep) > len(c) // 4]
    scored = dict(zip(whole, products(q[whole], c), strict=True)) if whole else {}
    for i, keep in blocks:
        s = scored.get(i)
        if s is None:
            s, ids = products(q[i : i + 1], c[keep])[0], c_ids[keep]
        else:
            ids = c_ids
        ok = (s >= floor[i]) & (ids != q_ids[i])
        s, ids = s[ok], ids[ok]
        if len(s) > k:
            at = np.lexsort((ids, -s.astype(object)) if len(s) and s.min() == -LONG - 1 else (ids, -s))[:k]
            s, ids = s[at], ids[at]
        out.append((np.full(len(s), q_ids[i]), ids, s))
    return out


def block_rows(n: int, dim: int, least: int, tasks: int) -> int:
    """Rows of a block: enough blocks for the tasks there are, none of more than ``BLOCK_BYTES``."""
    return max(1, min(max(least, n // tasks), BLOCK_BYTES // (8 * dim)))


def top_products(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, ratio: float = 1.1, least: int = 1024,
                 id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest integer inner products of floor(scale * x) per query.

    Vectors are grouped by length (buckets whose lengths differ by a factor of at most ``ratio``; how many there can
    be is bounded by the range of a double) and buckets are cut into blocks by their bytes (see ``block_rows``). A
    first look at one bounded block of the longest vectors gives a query a score that its k-th best surely reaches.
    From it and a bucket's largest length follows whether the bucket can matter to the query at all. Queries go, in
    batches bounded by their bytes, to the blocks of buckets that can, and a block goes to the batches that have a
    query for it and to no other: what either side is copied is the table's bytes over a block's. There see ``best``.
    Each block hands on at most k rows a query, and a rank over these, limited before its shuffle, gives the answer.
    Exact: no pair is lost.

    Defined cases: vectors that are null, empty or hold null or non-finite components take no part, as query or
    candidate; vectors of different length are not compared; a query with fewer candidates than k gets them all;
    a zero vector takes part (score 0); rows with the query's own id are not its candidates, and rows that repeat
    another id each count; rows that repeat a query's id and vector ask once; equal scores go by the smaller id; scores
    beyond the long range stay at its end; a null id takes no part; an empty table gives an empty table; other columns
    are ignored.
    """
    schema = "vec_id long, dim int, ints binary, length double, bucket int"
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"), is_query.alias("q"))
    made = cut_lineage(rows.mapInArrow(_scaled(scale, ratio), schema.replace("dim", "asked boolean, dim", 1)))
    asked = made.where("asked").drop("asked").dropDuplicates(["vec_id", "ints"])
    made = made.drop("asked")
    # Bounded: at most one row for each length bucket and dimension.
    stats = made.groupBy("dim", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("top")).orderBy(F.desc("top")).collect()
    if not stats:
        return made.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    tasks = 2 * vectors.sparkSession.sparkContext.defaultParallelism
    n, n_queries = sum(s["n"] for s in stats), asked.count()
    held = {d: sum(s["n"] for s in stats if s["dim"] == d) for d in {s["dim"] for s in stats}}
    seeds: dict[int, tuple] = {}
    for d in sorted(held, key=lambda d: -held[d])[:SEED_DIMS]:
        longest = next(s for s in stats if s["dim"] == d)
        found = made.where((F.col("dim") == d) & (F.col("bucket") == longest["bucket"])).select("vec_id", "ints").limit(max(k + 1, min(SEED_ROWS, SEED_BYTES // (8 * d)))).collect()
        seeds[d] = (np.array([r[0] for r in found]), b"".join(r[1] for r in found))

    def floors(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = {d: (ids, np.frombuffer(x, np.float64).reshape(-1, d)) for d, (ids, x) in seeds.items()}
        for pdf in pdfs:
            got = np.full(len(pdf), -np.inf)
            for d, at in pdf.groupby("dim").indices.items():
                if d not in ready:
                    continue
                ids, x = ready[d]
                s = products(_unpack(pdf["ints"].iloc[at], d), x).astype(float)
                s[pdf["vec_id"].to_numpy()[at][:, None] == ids[None, :]] = -np.inf
                if s.shape[1] >= k:
                    # Scores past 2**53 lose their last bits as doubles: step below to stay a lower bound.
                    f = np.partition(s, -k, axis=1)[:, -k]
                    got[at] = np.where(np.abs(f) < EXACT, f, f - np.abs(f) * 1e-9)
            yield pdf.assign(floor=got)

    asked = cut_lineage(asked.mapInPandas(floors, schema + ", floor double"))
    # Which buckets a query must see, by their largest length: a bounded table turned into an expression.
    blocks = {(s["dim"], s["bucket"]): math.ceil(s["n"] / block_rows(n, s["dim"], least, tasks)) for s in stats}
    options = F.array(*[F.struct(F.lit(s["dim"]).alias("dim"), F.lit(s["bucket"]).alias("bucket"), F.lit(blocks[s["dim"], s["bucket"]]).alias("blocks"), F.lit(s["top"]).alias("top")) for s in stats])
    can = lambda o: (o["dim"] == F.col("dim")) & ((F.col("floor") <= 0) | (F.col("length") * o["top"] * (1 + 1e-9) >= F.col("floor")))
    batches = F.create_map(*[F.lit(x) for d in held for x in (d, math.ceil(n_queries / block_rows(n_queries, d, least, 1)))])
    q = asked.withColumn("o", F.explode(F.filter(options, can))).select("vec_id", "dim", "ints", "length", "floor", F.col("o.bucket").alias("bucket"), F.explode(F.sequence(F.lit(0), F.col("o.blocks") - 1)).alias("block"))
    q = q.withColumn("part", F.pmod(F.xxhash64("vec_id"), batches[F.col("dim")]).cast("int"))
    of = F.create_map(*[F.lit(x) for (d, b), m in blocks.items() for x in (f"{d}/{b}", m)])
    c = made.withColumn("block", F.pmod(F.xxhash64("vec_id", "length"), of[F.concat_ws("/", "dim", "bucket")]).cast("int"))
    keys = ["dim", "bucket", "block", "part"]
    wanted = q.select(*[F.col(k).alias(f"w_{k}") for k in keys]).distinct()
    own = (F.col("dim") == F.col("w_dim")) & (F.col("bucket") == F.col("w_bucket")) & (F.col("block") == F.col("w_block"))
    c = c.join(wanted, own).select("vec_id", "dim", "ints", "length", "bucket", "block", F.col("w_part").alias("part"))  # blocks by batches that ask for them, and no others

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            d = int(left["dim"].iloc[0])
            x, lengths, ids = _unpack(right["ints"], d), right["length"].to_numpy(), right["vec_id"].to_numpy()
            for at in range(0, len(left), least):  # bounds the matrix of scores
                some = left.iloc[at : at + least]
                out += best(some["vec_id"].to_numpy(), _unpack(some["ints"], d), some["length"].to_numpy(), some["floor"].to_numpy(), ids, x, lengths, k)
        a, b, s = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        return pd.DataFrame({"query_id": a.astype(np.int64), "vec_id": b.astype(np.int64), "score": s.astype(np.int64)})

    near = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
