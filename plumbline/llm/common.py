"""Pieces that several of the operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from plumbline.operators.joins import salted_join
from plumbline.session import cut_lineage, ensure_checkpoint_dir

#: The white space that the contracts name: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. ``lower`` is exact where every character is ASCII, and much faster there."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Bounds the rows that go to Python at once, since texts may be very long; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows or int(spark.conf.get(key, "10000")) <= 0:
        spark.conf.set(key, str(rows))


def slices(batches: Iterator[pa.RecordBatch], at: int, rows: int = 256, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut where ``rows`` rows or about ``size`` bytes of the texts in column ``at`` are full; a longer text is
    a slice of its own. Bounds what becomes Python objects at once."""
    for batch in batches:
        column = batch.column(at)
        length = pa.compute.list_value_length if pa.types.is_list(column.type) else pa.compute.binary_length
        ends = np.cumsum(pa.compute.fill_null(length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < batch.num_rows:
            before = ends[lo - 1] if lo else 0
            hi = min(lo + rows, max(lo + 1, int(np.searchsorted(ends, before + size, side="right"))))
            yield batch.slice(lo, hi - lo)
            lo = hi


def map_texts(df: DataFrame, one, schema: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns plus what ``one()(text)`` gives per row, as a tuple in the order of ``schema``.

    ``one`` is called once a task and returns the function for a text (None stays None). A name of ``schema`` that
    ``keep`` has gets an underscore.
    """
    small_batches(df.sparkSession)
    # A text that is kept crosses to Python once.
    at = [c.lower() for c in keep].index(text.lower()) if text.lower() in [c.lower() for c in keep] else len(keep)
    source = df.select(*[F.col(f"`{c}`") for c in keep], *([F.col(f"`{text}`")] if at == len(keep) else []))
    made_fields = _parse_datatype_string(schema).fields
    columns = [fresh(source.select(*[F.col(f"`{c}`") for c in keep]), f.name) for f in made_fields]
    out = StructType([*source.schema.fields[: len(keep)], *(StructField(c, f.dataType) for c, f in zip(columns, made_fields, strict=True))])
    kinds = [to_arrow_type(f.dataType) for f in made_fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = one()
        for batch in slices(batches, at):
            found = [f(x) for x in batch.column(at).to_pylist()]
            made = [pa.array([x[i] for x in found], type=kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=[*keep, *columns])

    return source.mapInArrow(run, out)


#: Right sides of up to this many rows of a few numbers each are broadcast; larger ones are salted.
BROADCAST_ROWS = 250_000


def spread_join(left: DataFrame, right: DataFrame, on: list[str], spread: str, how: str = "inner") -> DataFrame:
    """``left`` joined to a narrow ``right`` with one row for each value of ``on``, without the rows of one value
    meeting in one task: broadcast if ``right`` (written first) is counted small, salted by ``spread`` otherwise."""
    right = cut_lineage(right)
    return left.join(F.broadcast(right), on, how) if right.count() <= BROADCAST_ROWS else salted_join(left, right, on, spread, how)


def block_pairs(df: DataFrame, key: str, spread: str, cap: int, exploded: bool = False) -> DataFrame:
    """Rows of every ``key`` that has two rows or more, dealt into groups of bounded size that still meet pairwise.

    A key of ``n`` rows is cut into ``ceil(n / cap)`` blocks by a hash of ``spread``, and each row goes to every
    pair of blocks that its own takes part in: group (key, bi, bj) holds the rows to compare with one another where
    bi = bj, or the rows of ``bi`` to compare with those of ``bj``. So no task holds more than about ``2 * cap`` rows
    of a key, and every pair of rows of a key meets exactly once. Added columns: bi, bj, side (which block it is of).
    ``exploded``: an explode has multiplied the rows of ``df`` (see ``salted_join``).
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")  # the keys that meet, dealt salted
    blocks = F.ceil(F.col("_n") / F.lit(cap)).cast("int")
    mine = F.pmod(F.xxhash64(spread), blocks).cast("int")
    return (
        salted_join(df, counts, [key], spread, exploded=exploded)
        .withColumn("_b", F.when(blocks == 1, F.lit(0)).otherwise(mine))
        .withColumn("_o", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("bi", F.least("_b", "_o"))
        .withColumn("bj", F.greatest("_b", "_o"))
        .withColumn("side", (F.col("_b") > F.col("_o")).cast("int"))
        .drop("_n", "_b", "_o")
    )


def sorted_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a group next to one another in one partition, for the functions that read groups as a stream."""
    return df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)


def stream_groups(batches: Iterator[pa.RecordBatch], keys: list[str], flush: int = 65536) -> Iterator[tuple[dict, np.ndarray]]:
    """Whole groups out of sorted batches: columns as numpy arrays, and the offset of each group's first row.

    Binary columns come as object arrays. Many small groups come at once; a group is never cut.
    """
    held: list[pa.RecordBatch] = []
    rows = 0

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    def columns(t: pa.Table) -> dict:
        return {c: t.column(c).to_numpy() for c in t.column_names}

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= flush:
            t = pa.Table.from_batches(held)
            at = starts(t)
            if at[-1] > 0:
                done = t.slice(0, int(at[-1]))
                yield columns(done), at[:-1]
                t = t.slice(int(at[-1])).combine_chunks()
            held, rows = t.to_batches(), t.num_rows
            flush = max(65536, 2 * rows)
    if held:
        t = pa.Table.from_batches(held)
        yield columns(t), starts(t)


def forest(linked: np.ndarray) -> np.ndarray:
    """For each node of a symmetric boolean matrix, the first node of its component."""
    n = len(linked)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] >= 0:
            continue
        seen = np.zeros(n, bool)
        seen[i] = True
        front = seen.copy()
        while front.any():
            reach = linked[front].any(axis=0) & ~seen
            seen |= reach
            front = reach
        root[seen] = i
    return root


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own, for files of one job, in the folder that the driver and all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
