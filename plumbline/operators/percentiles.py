"""Exact percentiles without a buffer of all values: a mergeable sketch finds where a rank lies, a second pass settles it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.joins import counted_join
from plumbline.session import cut_lineage


def exact_percentiles(rows: DataFrame, keys: list[str], value: Column, shares: list[float], accuracy: int = 10_000) -> DataFrame:
    """(keys, n, share, percentile): percentiles by linear interpolation between neighbours, as plain sorting gives them.

    The first pass merges sketches, whose ranks err by less than n / ``accuracy``: the values two such errors below and
    above a rank enclose it. The second pass counts what lies under that range and groups the values inside it, about
    4 n / ``accuracy`` of them at most (a value that repeats is one; of less than 3 ``accuracy`` rows all), and takes the least value above it, which is
    the neighbour if the rank is the range's last. So no buffer grows with a key's rows. Nulls and NaN don't count; a
    key without a value, or a null one, has no row.
    """
    v = rows.select(*keys, value.cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    margin = 2 / accuracy
    ends = [e for s in shares for e in (max(0.0, s - margin), min(1.0, s + margin))]
    sketch = v.groupBy(*keys).agg(F.percentile_approx("_v", ends, F.lit(accuracy)).alias("_b"), F.count(F.lit(1)).alias("n"))
    # A rank counts from 0 or 1 and rounds up or down: with few rows that outweighs the margin, and all of them are grouped.
    at = lambda k: F.when(F.col("n") >= 3 * accuracy, F.get("_b", F.lit(k))).otherwise(F.lit(float("inf" if k % 2 else "-inf")))
    spots = F.array(*[F.struct(F.lit(k).alias("i"), F.lit(s).alias("share"), ((F.col("n") - 1) * F.lit(s)).alias("rank"), at(2 * k).alias("lo"), at(2 * k + 1).alias("hi")) for k, s in enumerate(shares)])
    spots = cut_lineage(sketch.select(*keys, "n", F.explode(spots).alias("_r")).select(*keys, "n", "_r.*"))
    # A row a value of the range; what lies beside it adds up before it is shuffled.
    met = counted_join(v, spots.groupBy(*keys).agg(F.collect_list(F.struct("i", "lo", "hi")).alias("_s")), keys, "_v").select(*keys, "_v", F.explode("_s").alias("_s")).select(*keys, "_v", "_s.*")
    beside = met.groupBy(*keys, "i").agg(F.count_if(F.col("_v") < F.col("lo")).alias("below"), F.min(F.when(F.col("_v") > F.col("hi"), F.col("_v"))).alias("above"))
    inside = met.where((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi"))).groupBy(*keys, "i", "_v").agg(F.count(F.lit(1)).alias("m"))
    up = Window.partitionBy(*keys, "i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = inside.withColumn("upto", F.sum("m").over(up)).join(beside, [*keys, "i"]).join(spots.select(*keys, "i", "n", "share", "rank"), [*keys, "i"])
    first = lambda rank: F.min(F.when(F.col("below") + F.col("upto") > rank, F.col("_v")))
    low = F.floor("rank")
    found = placed.groupBy(*keys, "i", "n", "share", "rank").agg(first(low).alias("x"), F.coalesce(first(low + 1), F.first("above")).alias("y"))
    part = F.col("rank") - low
    return found.select(*keys, "n", "share", F.when(part == 0, F.col("x")).otherwise(F.col("x") + (F.col("y") - F.col("x")) * part).alias("percentile"))
