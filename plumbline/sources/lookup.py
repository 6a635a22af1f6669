"""Rows by id out of large Parquet tables: sorted files whose row groups and pages say which ids they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids up to this many are sent into the scan as a list; more are joined.
LISTED = 10_000


def write_indexed(rows: DataFrame, path: str, key: str, group_bytes: int = 16 << 20, page_rows: int = 1000) -> None:
    """Writes ``rows`` dealt and sorted by ranges of ``key``, so that a row group has a narrow range of it, with a Bloom filter
    of the key in every row group and pages of ``page_rows`` rows, whose ranges stand in the file's page index."""
    dealt = rows.repartitionByRange(F.col(key)).sortWithinPartitions(key)
    writer = dealt.write.option("parquet.block.size", str(group_bytes)).option("parquet.page.row.count.limit", str(page_rows))
    writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path)


def lookup(spark: SparkSession, path: str, ids: DataFrame, key: str, listed: int = LISTED) -> DataFrame:
    """The rows of an indexed table whose ``key`` is one of ``ids`` (a column of that name).

    Up to ``listed`` different ids (counted first) go to the scan as a list: row groups outside of their range, or whose
    Bloom filter has none of them, are not read, nor pages outside of their range. A list longer than Spark's
    ``inFilterThreshold`` reaches Parquet as one set, not as a chain of comparisons that would overflow a task's
    stack; that setting stays as it is. More ids are joined. Null ids find nothing.
    """
    ids = ids.select(key).where(F.col(key).isNotNull()).distinct()
    some = ids.limit(listed + 1).collect()
    table = spark.read.parquet(path)
    if len(some) > listed:
        return table.join(ids, key, "left_semi")
    return table.where(F.col(key).isin([r[0] for r in some]))
