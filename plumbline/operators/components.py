"""Connected components as rounds of joins: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut_lineage

#: Edges that one task of a round holds at most, about; few edges so go to few tasks, which write few files.
EDGES_A_TASK = 50_000


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); root is the smallest node reachable.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest node it knows, which
    ends in stars after a number of rounds that is logarithmic in practice. Hot nodes: the minimum of a node is
    pre-aggregated before its shuffle, and the join that hands it back is a plain equi-join that adaptive execution
    may split. Each round is checkpointed in the shared folder. The number of tasks follows the number of edges, so
    that small graphs don't pay for the partitions of large tables. Self-links and nulls are ignored; no edge: no row.
    """
    e = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    spark, n = edges.sparkSession, e.count()

    def dealt(df: DataFrame) -> DataFrame:
        """At most as many tasks as the edges need, and never more than there are."""
        need = 1 + n // EDGES_A_TASK
        return df.coalesce(need) if need < int(spark.conf.get("spark.sql.shuffle.partitions")) else df

    e, seen = dealt(e), None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = dealt(both.where("v > u").join(low, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        other = large.join(least.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"), F.lit(1).alias("more"))
        # A row of ``other`` never equals one of ``least``: its node has a smaller neighbour yet.
        e = cut_lineage(dealt(dealt(least.select("u", F.col("m").alias("v"), F.lit(0).alias("more")).union(other)).distinct()))
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum("more")).first()
        e, n = e.select("u", "v"), now[0]
        if now[:2] == seen and not now[2]:
            break
        seen = now[:2]
    else:
        raise RuntimeError("the components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())


def groups_by_shared(rows: DataFrame, node: str, *shared: str) -> DataFrame:
    """(node, root) where rows that share the value of any of the columns ``shared`` are in one group.

    A value links its rows to the smallest of them: a star for each value, not all its pairs. Null values link none.
    """
    edges = None
    for column in shared:
        low = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(node).alias("b"))
        star = rows.join(low, column).select(F.col(node).alias("a"), "b")
        edges = star if edges is None else edges.union(star)
    found = connected_components(edges)
    return rows.select(node).distinct().join(found, node if node == "node" else F.col(node) == F.col("node"), "left").select(F.col(node), F.coalesce("root", node).alias("root"))
