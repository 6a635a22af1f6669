"""Sufficient statistics, adjusted tests, ranks and tiers of boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_stats(judgments: DataFrame, keys: list[str], group: str = "grp", threshold: float = 0.5) -> DataFrame:
    """Sufficient statistics per key and group: positives, their credit, negatives, their credit."""
    pos, decided = F.col("positive"), F.col("outcome") == "decided"
    hit = decided & (F.col("score") >= threshold)
    passed = decided & (F.col("score") < threshold)
    one = lambda c: F.sum(c.cast("long"))
    return judgments.groupBy(*keys, group).agg(one(pos).alias("pos"), one(pos & hit).alias("pos_credit"), one(~pos).alias("neg"), one(~pos & passed).alias("neg_credit"))


def unit_hash(*parts: Column, modulus: int = 2**31 - 1) -> Column:
    """A number in [0, 1) that follows from its parts: the first 8 hex digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long") / F.lit(float(2**32))


def holm(tests: DataFrame, keys: list[str], p: str, *tie: str) -> DataFrame:
    """Holm's step-down adjustment within ``keys``; tests without a p-value keep none and don't count."""
    by = Window.partitionBy(*keys, F.col(p).isNull()) if keys else Window.partitionBy(F.col(p).isNull())
    order = by.orderBy(p, *tie)
    factor = F.count(p).over(by) - F.row_number().over(order) + 1
    t = tests.withColumn("_step", F.least(F.lit(1.0), factor * F.col(p)))
    running = F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return t.withColumn("p_holm", F.when(F.col(p).isNotNull(), running)).drop("_step")


def competition_rank(df: DataFrame, keys: list[str], value: str, digits: int = 2, alias: str = "rank") -> DataFrame:
    """Rank on rounded values, the best first; equal values share the better rank; no value, no rank."""
    r = F.round(value, digits)
    w = Window.partitionBy(*keys, F.col(value).isNull()) if keys else Window.partitionBy(F.col(value).isNull())
    return df.withColumn(alias, F.when(F.col(value).isNotNull(), F.rank().over(w.orderBy(F.desc(r)))))


def rank_intervals(reps: DataFrame, keys: list[str], who: str = "system", value: str = "ba", level: float = 0.95) -> DataFrame:
    """The range of a system's average rank over replicates."""
    per = Window.partitionBy(*keys, "rep")
    tied = Window.partitionBy(*keys, "rep", value)
    r = reps.where(F.col(value).isNotNull()).withColumn("r", F.rank().over(per.orderBy(F.desc(value))) + (F.count(F.lit(1)).over(tied) - 1) / 2)
    lo, hi = (1 - level) / 2, (1 + level) / 2
    ranks = r.groupBy(*keys, who).agg(F.sort_array(F.collect_list("r")).alias("rs"))  # one entry a replicate: bounded
    n = F.size("rs") - 1
    return ranks.select(
        *keys, who, F.element_at("rs", (F.floor(n * F.lit(lo)) + 1).cast("int")).alias("rank_low"), F.element_at("rs", (F.ceil(n * F.lit(hi)) + 1).cast("int")).alias("rank_high")
    )


def tiers(ranked: DataFrame, worse: DataFrame) -> DataFrame:
    """Tier of each system: walking down the board, a system that is clearly worse than the leader of the current tier
    leads the next one. ``ranked``: (system, pos); ``worse``: (leader, system) pairs with a clear difference.

    The walk depends on the current leader, so it is a fold over the board: one row a system, the size of the board.
    """
    board = ranked.agg(F.array_sort(F.collect_list(F.struct("pos", "system"))).alias("board"))
    pairs = worse.agg(F.collect_set(F.concat_ws("\u0001", "leader", "system")).alias("pairs"))
    joined = board.withColumn("one", F.lit(1)).join(pairs.withColumn("one", F.lit(1)), "one")
    empty = F.array().cast("array<struct<system:string,tier:int>>")

    def walk(s: Column, x: Column) -> Column:
        drops = s["leader"].isNull() | F.array_contains(F.col("pairs"), F.concat_ws("\u0001", s["leader"], x["system"]))
        tier = s["tier"] + drops.cast("int")
        return F.struct(F.when(drops, x["system"]).otherwise(s["leader"]).alias("leader"), tier.alias("tier"), F.concat(s["out"], F.array(F.struct(x["system"].alias("system"), tier.alias("tier")))).alias("out"))

    start = F.struct(F.lit(None).cast("string").alias("leader"), F.lit(0).alias("tier"), empty.alias("out"))
    return joined.select(F.explode(F.aggregate("board", start, walk, lambda s: s["out"])).alias("x")).select("x.system", "x.tier")


def verdict(point: Column, p_adjusted: Column, alpha: float = 0.05) -> Column:
    """What a difference says after the adjustment for all tests of its family."""
    return F.when(p_adjusted.isNull(), "not tested").when(p_adjusted >= alpha, "within noise").when(point > 0, "better").otherwise("worse")


def log_factorial(n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))


def binomial_two_sided(k: Column, n: Column) -> Column:
    """Exact two-sided sign test: the probability of a count as far from n / 2 as k, at one half."""
    low = F.least(k, n - k).cast("int")
    ln = log_factorial(n)
    tail = F.aggregate(F.sequence(F.lit(0), low), F.lit(0.0), lambda s, i: s + F.exp(ln - log_factorial(i) - log_factorial(n - i) - n * F.log(F.lit(2.0))))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))
