"""Bootstrap without a table of draws: replicate vectors that add up inside tasks.

A unit (a row or a group of rows) has a multiplicity in every replicate, a Poisson(1) number that follows from a hash of
the unit and the replicate. So draws are shared by whatever is scored on them, don't depend on partitioning or on
other units, and need no pass of their own. What a replicate sums is a vector with one entry a replicate: tasks add
multiplicities times values into one vector a key, and vectors of tasks add up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

REPLICATES = 2000
#: Cumulative probabilities of Poisson(1) over 2^32: a 32-bit number under the k-th is a multiplicity of at most k.
POISSON = [int(math.fsum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 2**32) for k in range(12)]
#: The finalizer of a 32-bit mixing hash, and the step from one replicate to the next.
MIX, STEP, LOW = ((16, 0x85EBCA6B), (13, 0xC2B2AE35)), 0x9E3779B9, 0xFFFFFFFF


def unit_number(*parts: Column) -> Column:
    """A 60-bit number of a unit: the first 15 hex digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def mixed(x: np.ndarray) -> np.ndarray:
    """32-bit numbers (in 64 bits) well mixed."""
    for shift, factor in MIX:
        x = ((x ^ (x >> np.uint64(shift))) * np.uint64(factor)) & np.uint64(LOW)
    return x ^ (x >> np.uint64(16))


def multiplicities(units: np.ndarray, replicates: int) -> np.ndarray:
    """(units x (1 + replicates)): how often each unit is drawn in each replicate. Replicate 0 is the sample itself."""
    u = units.astype(np.uint64)[:, None]
    step = (np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(STEP)) & np.uint64(LOW)
    z = mixed((u & np.uint64(LOW)) ^ mixed(((u >> np.uint64(32)) + step) & np.uint64(LOW)))
    drawn = np.searchsorted(np.array(POISSON, np.uint64), z, side="right").astype(np.float64)
    return np.concatenate([np.ones((len(units), 1)), drawn], axis=1)


def drawn_sql(source: str, replicates: int = REPLICATES) -> str:
    """The same as SQL text of another engine: the rows of ``source`` (its column h is the unit's number) with rep and mult."""
    big = "::ubigint"
    one = lambda x, s, f: f"((xor({x}, {x} >> {s}) * {f}{big}) & {LOW}{big})"
    out = f"select *, ((h::ubigint >> 32) + ((rep::ubigint * {STEP}{big}) & {LOW}{big})) & {LOW}{big} as z from ({source}) s, range({replicates + 1}) r(rep)"
    for again in range(2):
        for shift, factor in MIX:
            out = f"select * replace ({one('z', shift, factor)} as z) from ({out})"
        last = "xor(z, z >> 16)" if again else f"xor(h::ubigint & {LOW}{big}, xor(z, z >> 16))"
        out = f"select * replace ({last} as z) from ({out})"
    mult = " + ".join(f"(z >= {c})::int" for c in POISSON)
    return f"(select * exclude (z), case when rep = 0 then 1 else {mult} end as mult from ({out}))"


def draw_vectors(units: DataFrame, unit: Column, replicates: int = REPLICATES, name: str = "mult") -> DataFrame:
    """``units`` plus the array of its multiplicities: a projection, no shuffle."""
    source, width = units.withColumn("_u", unit), replicates + 1
    out = StructType([*units.schema.fields, StructField(name, ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                m = multiplicities(some.column(some.num_columns - 1).to_numpy(), replicates).astype(np.int32)
                offsets = np.arange(0, m.size + 1, width, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.ListArray.from_arrays(offsets, m.ravel())], names=[*some.schema.names[:-1], name])

    return source.mapInArrow(run, out)


def replicate_sums(stats: DataFrame, keys: list[str], unit: Column, values: list[str], replicates: int = REPLICATES) -> DataFrame:
    """(keys, rep, values): the sums of every replicate; replicate 0 is the sample itself.

    A task holds one vector a key and value, whatever the number of rows and units, so a key with most rows is no hot
    spot; what is shuffled is a vector a task and key. Null values count as 0; null keys are keys.
    """
    source = stats.select(*keys, *[F.coalesce(F.col(v), F.lit(0)).cast("double").alias(v) for v in values], unit.alias("_u"))
    n = len(keys)
    head = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:n]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        kinds = None
        for batch in batches:
            kinds = [c.type for c in batch.columns[:n]]
            for lo in range(0, batch.num_rows, 1024):
                some = batch.slice(lo, 1024)
                units, where = np.unique(some.column(n + len(values)).to_numpy(), return_inverse=True)
                m = multiplicities(units, replicates)
                v = np.stack([some.column(n + k).to_numpy() for k in range(len(values))])
                rows: dict[tuple, list[int]] = {}
                for r, key in enumerate(zip(*(c.to_pylist() for c in some.columns[:n]), strict=True)):
                    rows.setdefault(key, []).append(r)
                for key, at in rows.items():
                    sums = v[:, at] @ m[where[at]]
                    if key in held:
                        held[key] += sums
                    else:
                        held[key] = sums
        for key, sums in held.items():
            vectors = [pa.ListArray.from_arrays(np.array([0, replicates + 1], np.int32), sums[k]) for k in range(len(values))]
            yield pa.RecordBatch.from_arrays([*(pa.array([x], kinds[i]) for i, x in enumerate(key)), *vectors], names=[*keys, *values])

    parts = source.mapInArrow(run, ", ".join([*head, *(f"{v} array<double>" for v in values)]))
    rows = parts.select(*keys, F.posexplode(F.arrays_zip(*values)).alias("rep", "x")).select(*keys, "rep", "x.*")
    return rows.groupBy(*keys, "rep").agg(*[F.sum(v).alias(v) for v in values])


def replicate_auroc(rows: DataFrame, keys: list[str], score: str, positive: str, unit: Column, replicates: int = REPLICATES) -> DataFrame:
    """(keys, rep, auroc): the area under the curve of every replicate (0: of the sample itself), ties half.

    Rows are dealt by ranges of (keys, score), so a key of any size is spread. A task goes through its range in order and
    gives, for each key, what the range adds: positives, negatives, and pairs that it orders right; ranges of one
    key join in order, as P + P', Q + Q', U + U' + P' Q. Rows without a score don't count.
    """
    source = rows.where(F.col(score).isNotNull() & F.col(positive).isNotNull()).select(*keys, F.col(score).cast("double").alias("_s"), F.col(positive).cast("boolean").alias("_p"), unit.alias("_u"))
    dealt = source.repartitionByRange(*keys, "_s").sortWithinPartitions(*keys, "_s").withColumn("_at", F.spark_partition_id())
    n, head = len(keys), [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keys)]]
    arrays = ", ".join(f"{x} array<double>" for x in "PQU")

    def row_of(key: tuple, kinds: list, at: int | None, p: np.ndarray, q: np.ndarray, u: np.ndarray) -> pa.RecordBatch:
        vectors = [pa.ListArray.from_arrays(np.array([0, replicates + 1], np.int32), x) for x in (p, q, u)]
        where = [] if at is None else [pa.array([at], pa.int32())]
        return pa.RecordBatch.from_arrays([*(pa.array([x], kinds[i]) for i, x in enumerate(key)), *where, *vectors], names=[*keys, *(["_at"] if where else []), "P", "Q", "U"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = at = None
        p = q = u = ties_p = ties_q = None
        last, kinds = None, None
        for batch in batches:
            kinds = [c.type for c in batch.columns[:n]]
            for lo in range(0, batch.num_rows, 1024):
                some = batch.slice(lo, 1024)
                scores, classes = some.column(n).to_numpy(), some.column(n + 1).to_pylist()
                m = multiplicities(some.column(n + 2).to_numpy(), replicates)
                for r, key in enumerate(zip(*(c.to_pylist() for c in some.columns[:n]), strict=True)):
                    if key != now:
                        if now is not None:
                            yield row_of(now, kinds, at, p + ties_p, q + ties_q, u + ties_p * (q + ties_q / 2))
                        now, at, last = key, some.column(n + 3)[r].as_py(), None
                        p, q, u, ties_p, ties_q = (np.zeros(replicates + 1) for _ in range(5))
                    if scores[r] != last:  # the rows of one score are over
                        u += ties_p * (q + ties_q / 2)
                        p, q = p + ties_p, q + ties_q
                        ties_p, ties_q, last = np.zeros(replicates + 1), np.zeros(replicates + 1), scores[r]
                    if classes[r]:
                        ties_p = ties_p + m[r]
                    else:
                        ties_q = ties_q + m[r]
        if now is not None:
            yield row_of(now, kinds, at, p + ties_p, q + ties_q, u + ties_p * (q + ties_q / 2))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kinds = None, None
        p = q = u = None
        for batch in batches:
            kinds = [c.type for c in batch.columns[:n]]
            for r, key in enumerate(zip(*(c.to_pylist() for c in batch.columns[:n]), strict=True)):
                x, y, z = (batch.column(n + 1 + k)[r].values.to_numpy() for k in range(3))
                if key != now:
                    if now is not None:
                        yield row_of(now, kinds, None, p, q, u)
                    now, p, q, u = key, x.copy(), y.copy(), z.copy()
                else:
                    u = u + z + x * q
                    p, q = p + x, q + y
        if now is not None:
            yield row_of(now, kinds, None, p, q, u)

    parts = dealt.mapInArrow(ranges, ", ".join([*head, "_at int", arrays]))
    whole = parts.repartition(*keys).sortWithinPartitions(*keys, "_at").mapInArrow(joined, ", ".join([*head, arrays]))
    long = whole.select(*keys, F.posexplode(F.arrays_zip("P", "Q", "U")).alias("rep", "x")).select(*keys, "rep", "x.*")
    return long.select(*keys, "rep", F.try_divide("U", F.col("P") * F.col("Q")).alias("auroc"))


def balanced_accuracy(pos: str = "pos", pos_credit: str = "pos_credit", neg: str = "neg", neg_credit: str = "neg_credit") -> Column:
    """Percent; null where a replicate lacks a class."""
    return 50 * (F.try_divide(F.col(pos_credit), F.col(pos)) + F.try_divide(F.col(neg_credit), F.col(neg)))


def summary(reps: DataFrame, keys: list[str], value: str, level: float = 0.95) -> DataFrame:
    """(keys, point, ci_low, ci_high, se, n_valid): the sample's value, and the percentile interval and spread of the
    replicates that have one. One buffer of at most a value a replicate."""
    drawn = F.when(F.col("rep") > 0, F.col(value))
    low = (1 - level) / 2
    return reps.groupBy(*keys).agg(
        F.max(F.when(F.col("rep") == 0, F.col(value))).alias("point"), F.percentile(drawn, F.lit(low)).alias("ci_low"), F.percentile(drawn, F.lit(1 - low)).alias("ci_high"),
        F.stddev_samp(drawn).alias("se"), F.count(drawn).alias("n_valid"),
    )


def summary_sql(reps: str, keys: str, value: str) -> str:
    return f"""select {keys}, max({value}) filter (rep = 0) as point, quantile_cont({value}, 0.025) filter (rep > 0) as ci_low, quantile_cont({value}, 0.975) filter (rep > 0) as ci_high,
      stddev_samp({value}) filter (rep > 0) as se, count({value}) filter (rep > 0) as n_valid from ({reps}) group by {keys}"""


def pairs(reps: DataFrame, keys: list[str], who: str, value: str) -> DataFrame:
    """(keys, rep, a, b, d): a's value less b's, for every two of ``who`` (a before b) in one replicate. The members of a
    replicate meet as one array, a few numbers a member, so replicates are computed once."""
    met = reps.groupBy(*keys, "rep").agg(F.array_sort(F.collect_list(F.struct(F.col(who).alias("w"), F.col(value).alias("v")))).alias("_all"))
    one = met.select(*keys, "rep", "_all", F.posexplode("_all").alias("i", "x"))
    return one.select(*keys, "rep", "x", F.explode(F.slice("_all", F.col("i") + 2, F.size("_all"))).alias("y")).select(
        *keys, "rep", F.col("x.w").alias("a"), F.col("y.w").alias("b"), (F.col("x.v") - F.col("y.v")).alias("d")
    )


#: erfc(x) for x >= 0 as t exp(-x^2 + polynomial of t), t = 1 / (1 + x / 2): within 1.2e-7 of its value everywhere.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    """The complementary error function of a number from 0 on; Spark has none."""
    t = 1 / (1 + x / 2)
    total = F.lit(ERFC[-1])
    for c in ERFC[-2::-1]:
        total = total * t + F.lit(c)
    return t * F.exp(-x * x + total)


def erfc_sql(x: str) -> str:
    t = f"(1 / (1 + ({x}) / 2))"
    total = f"{ERFC[-1]}::double"
    for c in ERFC[-2::-1]:
        total = f"({total} * {t} + {c}::double)"
    return f"({t} * exp(-({x}) * ({x}) + {total}))"


def wald_p(point: Column, se: Column) -> Column:
    """Two-sided p of a point difference over the spread of its replicates; no spread: 1 if there is no difference, else 0."""
    return F.when(se == 0, F.when(point == 0, 1.0).otherwise(0.0)).otherwise(erfc(F.abs(point) / se / math.sqrt(2)))


def wald_p_sql(point: str, se: str) -> str:
    return f"case when {se} = 0 then case when {point} = 0 then 1.0::double else 0.0::double end else {erfc_sql(f'abs({point}) / ({se}) / {math.sqrt(2)}::double')} end"
