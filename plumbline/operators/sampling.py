"""Sampling, stratified selection and splits. Randomness is a hash of stable keys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.ranges import running_sums, running_sums_within
from plumbline.session import cut_lineage


def order_key(seed: str, *parts: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(p).cast("string") for p in parts]))


def cap_per_cell(df: DataFrame, cell: list[str], cap: int, *order: Column) -> DataFrame:
    """At most ``cap`` rows of each cell, first in ``order``; the rank is limited before its shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*cell).orderBy(*order))).where(F.col("_rn") <= cap).drop("_rn")


def round_robin(df: DataFrame, strata: list[str], n: int, *order: Column) -> DataFrame:
    """``n`` rows, taken in turns from the strata."""
    w = Window.partitionBy(*strata).orderBy(*order)
    return df.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n).orderBy("turn", *strata).limit(n)


def allocate(sizes: DataFrame, total: int, floor: int, size: str = "n") -> DataFrame:
    """``take`` for each stratum: a floor each, the rest in proportion, largest remainders first.

    ``sizes`` has one row a stratum; what is ranked is bounded by their number.
    """
    one = Window.partitionBy(F.lit(1))
    base = F.least(F.col(size), F.lit(floor))
    s = sizes.withColumn("base", base).withColumn("left", F.lit(total) - F.sum("base").over(one))
    exact = F.greatest(F.col("left"), F.lit(0)) * (F.col(size) - F.col("base")) / F.greatest(F.sum(F.col(size) - F.col("base")).over(one), F.lit(1))
    s = s.withColumn("exact", exact).withColumn("whole", F.floor("exact")).withColumn("rest", F.greatest(F.col("left"), F.lit(0)) - F.sum("whole").over(one))
    names = [c for c in sizes.columns if c != size]
    s = s.withColumn("k", F.row_number().over(Window.orderBy(F.desc(F.round(F.col("exact") - F.col("whole"), 9)), *names)))
    take = F.col("base") + F.col("whole") + (F.col("k") <= F.col("rest")).cast("int")
    return s.select(*names, size, F.least(F.col(size), take).cast("long").alias("take"))


def stratified(df: DataFrame, strata: list[str], allocation: DataFrame, most: int, *order: Column) -> DataFrame:
    """As many rows of each stratum as its allocation says; none says more than ``most``, so ranks beyond it never
    reach the shuffle."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*strata).orderBy(*order))).where(F.col("_rn") <= most)
    return ranked.join(allocation.select(*strata, "take"), strata).where(F.col("_rn") <= F.col("take")).drop("_rn", "take")


def hash_split(unit: Column, shares: list[tuple[str, float]]) -> Column:
    """The split whose share of [0, 1) holds a number; the last takes the rest."""
    out, at = F.lit(shares[-1][0]), 0.0
    edges = []
    for name, share in shares[:-1]:
        at += share
        edges.append((name, at))
    for name, edge in reversed(edges):
        out = F.when(unit < edge, name).otherwise(out)
    return out


def rank_split(df: DataFrame, strata: list[str], shares: list[tuple[str, float]], *order: Column) -> DataFrame:
    """Splits by the place of a row in its stratum; places are running sums, so a large stratum is spread."""
    keys = {c: f"_{c}" for c in strata}
    n = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n")).withColumnsRenamed(keys)
    placed = running_sums_within(df, strata, list(order), _at=F.lit(1).cast("long")).join(n, [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()])
    return placed.select(*df.columns, hash_split((F.col("_at") - 1) / F.col("_n"), shares).alias("new_split"))


def group_split(df: DataFrame, group: str, share: float, seed: str) -> DataFrame:
    """Whole groups to dev until it has ``share`` of the rows, in a hashed order; the rest is test.

    The running total is over groups, not rows, and over ranges of their order.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn("_h", order_key(seed, group))
    placed = running_sums(sizes, [F.col("_h").asc(), F.col(group).asc()], upto=F.col("n"))
    placed = placed.crossJoin(F.broadcast(sizes.agg(F.sum("n").alias("total"))))  # one row
    return placed.select(group, "n", F.when(F.col("upto") - F.col("n") < share * F.col("total"), "dev").otherwise("test").alias("new_split"))


def matched(df: DataFrame, cell: list[str], label: str, ratio: float, *order: Column) -> DataFrame:
    """Rows of both classes in each cell, no class with more than ``ratio`` times the other."""
    n = df.groupBy(*cell).agg(F.count_if(F.col(label) == "yes").alias("y"), F.count_if(F.col(label) == "no").alias("z"))
    n = n.withColumn("most", F.floor(F.least("y", "z") * ratio))
    ranked = running_sums_within(df, [*cell, label], list(order), _rn=F.lit(1).cast("long"))
    return ranked.join(n.select(*cell, "most"), cell).where(F.col("_rn") <= F.col("most")).drop("_rn", "most")


def greedy_buckets(df: DataFrame, key: str, columns: str, targets: dict[str, int], word_cap: int) -> DataFrame:
    """A sequential choice in each ``key``: rows in order, while their bucket has room, their word isn't used up and
    their group isn't taken. Keys are independent, so the loop runs in each apart; it sees ids and labels, no texts."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        room, words, groups, keep = dict(targets), {}, set(), []
        for row in pdf.sort_values(["ord", "id"]).itertuples():
            if room.get(row.bucket, 0) > 0 and words.get(row.word, 0) < word_cap and row.grp not in groups:
                room[row.bucket] -= 1
                words[row.word] = words.get(row.word, 0) + 1
                groups.add(row.grp)
                keep.append(row.Index)
        return pdf.loc[keep].drop(columns="ord")

    # What is chosen can't lie further back: fewer than ``most`` rows are chosen before it, and each row passed over has
    # the group of one of them or a word that they used up.
    most = sum(targets.values())
    for cell, n in ((["bucket", "word", "grp"], 1), (["bucket", "word"], most), (["bucket", "grp"], most), (["bucket"], 2 * most * most)):
        df = cap_per_cell(df, [key, *cell], n, F.col("ord"), F.col("id"))
    return df.groupBy(key).applyInPandas(choose, columns)


def balanced_folds(groups: DataFrame, group: str, size: str, folds: int) -> DataFrame:
    """Groups to folds, largest first to the smallest fold, groups of a size by their ids.

    The groups are sorted over many tasks and numbered by their partitions' counts. The driver sees how many groups
    there are of each size and partition, no group: once the folds differ by less than a size, groups of that size go
    to them in turns.
    """
    ranked = groups.select(F.col(group), F.col(size).cast("long").alias(size)).orderBy(F.desc(size), F.asc(group))
    ranked = cut_lineage(ranked.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    cells = sorted(((r["_p"], -r[size], r["_n"], r["_m"]) for r in ranked.groupBy("_p", size).agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_m")).collect()), key=lambda c: (c[1], c[0]))
    sums, seen, plan = [0] * folds, {}, []
    for _, minus, n, _ in cells:
        seen[-minus] = seen.get(-minus, 0) + n
    lead, ring = {}, {}
    for value in sorted(seen, reverse=True):
        left, lead[value] = seen[value], []
        while left and max(sums) - min(sums) >= value:
            lead[value].append(sums.index(min(sums)))
            sums[lead[value][-1]] += value
            left -= 1
        ring[value] = sorted(range(folds), key=lambda k: (sums[k], k))
        sums = [v + value * (left // folds + (ring[value].index(k) < left % folds)) for k, v in enumerate(sums)]
    before = dict.fromkeys(seen, 0)
    for part, minus, n, first in cells:
        plan.append((part, -minus, before[-minus] - first, lead[-minus], ring[-minus]))
        before[-minus] += n
    known = groups.sparkSession.createDataFrame(plan, "_p int, _s long, _off long, _lead array<int>, _ring array<int>")
    at = F.col("_i") + F.col("_off")
    fold = F.when(at < F.size("_lead"), F.get("_lead", at.cast("int"))).otherwise(F.get("_ring", ((at - F.size("_lead")) % folds).cast("int")))
    placed = ranked.join(F.broadcast(known.withColumnRenamed("_p", "_q")), (F.col("_p") == F.col("_q")) & (F.col(size) == F.col("_s")))
    return placed.select(group, fold.alias("fold"))
