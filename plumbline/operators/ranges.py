"""Ranks and running sums over a whole table without a window that holds it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import cut_lineage


def running_sums(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """``df`` plus, for each name, the sum of its value over the rows up to this one in ``order``, itself included.

    Rows are dealt by ranges of the order; sums inside a range need a window over that range alone, and what the
    ranges before it hold is a table of one row a range. Rows that tie in the order get an order of their own kind,
    so the order should name every row. Added names must not be columns of ``df``; an empty table gives none.
    """
    dealt = df.withColumns({f"_{n}": v for n, v in sums.items()}).repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt = cut_lineage(dealt)  # the number of a range must not change after this
    whole = dealt.groupBy("_range").agg(*[F.sum(f"_{n}").alias(f"_all_{n}") for n in sums])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = whole.select("_range", *[F.coalesce(F.sum(f"_all_{n}").over(before), F.lit(0)).alias(f"_all_{n}") for n in sums])
    here = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(starts), "_range")
    return out.select(*df.columns, *[(F.col(f"_all_{n}") + F.sum(f"_{n}").over(here)).alias(n) for n in sums])


def row_numbers(df: DataFrame, order: list[Column], name: str = "at") -> DataFrame:
    """``df`` plus the place of each row in ``order``, from 1."""
    return running_sums(df, order, **{name: F.lit(1).cast("long")})


def running_sums_within(df: DataFrame, part: list[str], order: list[Column], **sums: Column) -> DataFrame:
    """The same inside each value of ``part``: sums over the whole order, less what the part's first row began with.

    A part that holds most rows is spread over the ranges like any other. Added names must not be columns of ``df``."""
    whole = running_sums(df, [*[F.col(c).asc() for c in part], *order], **sums)
    begin = whole.groupBy(*part).agg(*[F.min(F.col(n) - v).alias(f"_begin_{n}") for n, v in sums.items()])
    keys = {c: f"_part_{c}" for c in part}
    joined = whole.join(begin.withColumnsRenamed(keys), [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()])
    return joined.select(*df.columns, *[(F.col(n) - F.col(f"_begin_{n}")).alias(n) for n in sums])
