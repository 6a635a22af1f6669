"""Metrics over judgments: (system, subtask, ..., positive, score, outcome) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.joins import counted_join
from plumbline.operators.ranges import running_sums_within


def ratio(a, b) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def mean_or_null(value: Column) -> Column:
    """A mean that is null as soon as one part is missing."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.avg(value))


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in ``order``; a window limited before its shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def confusion(judgments: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Counts per key at a threshold: failures stay in the totals and earn nothing, on either class."""
    decided = F.col("outcome") == "decided"
    said_yes = decided & (F.col("score") >= threshold)
    said_no = decided & (F.col("score") < threshold)
    pos = F.col("positive")
    return judgments.groupBy(*keys).agg(
        F.count_if(pos).alias("n_pos"),
        F.count_if(~pos).alias("n_neg"),
        F.count_if(pos & said_yes).alias("tp"),
        F.count_if(~pos & said_no).alias("tn"),
        F.count_if(~pos & said_yes).alias("fp"),
        F.count_if(pos & said_no).alias("fn"),
        F.count_if(~decided).alias("n_failed"),
    )


def unit_metrics(counts: DataFrame) -> DataFrame:
    """Balanced accuracy, catch and false-block rate, precision and F1 of confusion counts, in percent."""
    catch, passed = ratio("tp", "n_pos"), ratio("tn", "n_neg")
    return counts.select(
        "*",
        (100 * (catch + passed) / 2).alias("balanced_accuracy"),
        (100 * catch).alias("catch_rate"),
        (100 * ratio("fp", "n_neg")).alias("false_block_rate"),
        (100 * ratio("tp", F.col("tp") + F.col("fp"))).alias("precision"),
        (100 * ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + (F.col("n_pos") - F.col("tp")))).alias("f1"),
    )


def auroc(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Mann-Whitney AUROC per key, ties counting half; null with one class only.

    Works on the counts per distinct score, so the window sees distinct scores and not rows.
    """
    by_score = scored.where(F.col("score").isNotNull()).groupBy(*keys, "score").agg(
        F.sum(F.col("positive").cast("long")).alias("p"), F.sum((~F.col("positive")).cast("long")).alias("n")
    )
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    credit = by_score.withColumn("won", F.col("p") * (below + F.col("n") / 2))
    out = credit.groupBy(*keys).agg(F.sum("won").alias("won"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return out.select(*keys, F.try_divide("won", F.col("p") * F.col("n")).alias("auroc"))


def cumulative(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Per distinct score, from the highest down: how many of each class are at or above it, and the totals."""
    by_score = scored.groupBy(*keys, "score").agg(
        F.sum(F.col("positive").cast("long")).alias("p"), F.sum((~F.col("positive")).cast("long")).alias("n")
    )
    down = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("score")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    return by_score.select(
        *keys, "score", F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("fp"), F.sum("p").over(whole).alias("n_pos"), F.sum("n").over(whole).alias("n_neg")
    ).where(F.col("score").isNotNull())


def recall_at_budget(scored: DataFrame, keys: list[str], budget: float) -> DataFrame:
    """The largest recall of a threshold whose false-block rate stays within ``budget``, and the highest such threshold."""
    points = cumulative(scored, keys).where(F.col("fp") <= budget * F.col("n_neg"))
    best = points.groupBy(*keys).agg(F.max(F.struct(F.try_divide("tp", "n_pos").alias("recall"), F.col("score").alias("threshold"))).alias("b"))
    return best.select(*keys, F.col("b.recall").alias("recall"), F.col("b.threshold").alias("threshold"))


def thresholds(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Candidate thresholds: midpoints between neighbouring distinct scores, with the counts of each choice."""
    c = cumulative(scored, keys)
    lower = F.lead("score").over(Window.partitionBy(*keys).orderBy(F.desc("score")))
    return c.withColumn("threshold", F.when(lower.isNull(), F.col("score")).otherwise((F.col("score") + lower) / 2))


def select_threshold(scored: DataFrame, keys: list[str]) -> DataFrame:
    """The threshold with the best balanced accuracy; ties go to the lower false-positive rate, then the higher one."""
    fpr = F.try_divide("fp", "n_neg")
    ba = (F.try_divide("tp", "n_pos") + 1 - fpr) / 2
    t = thresholds(scored, keys).where((F.col("n_pos") > 0) & (F.col("n_neg") > 0)).withColumn("ba", F.round(100 * ba, 6)).withColumn("fpr", F.round(fpr, 8))
    return latest_per_key(t, keys, F.desc("ba"), F.asc("fpr"), F.desc("threshold")).select(*keys, "threshold", "ba", "fpr")


def calibration(scored: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Brier score and expected calibration error over equal-width bins."""
    y = F.col("positive").cast("double")
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    by_bin = scored.where(F.col("score").isNotNull()).groupBy(*keys, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("conf"), F.sum(y).alias("hits"), F.sum((F.col("score") - y) ** 2).alias("sq")
    )
    return by_bin.groupBy(*keys).agg(
        (F.sum("sq") / F.sum("n")).alias("brier"), (F.sum(F.abs(F.col("conf") - F.col("hits"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n")
    )


def reliability(scored: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Mean score against the share of positives in each bin."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return scored.where(F.col("score").isNotNull()).groupBy(*keys, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("positive").cast("double")).alias("share_positive")
    )


def kappa(pairs: DataFrame, keys: list[str], a: str, b: str, weight: str | None = None) -> DataFrame:
    """Cohen's kappa of two yes / no labels, weighted; null where chance agreement is complete."""
    w = F.col(weight) if weight else F.lit(1.0)
    x, y = F.col(a) == "yes", F.col(b) == "yes"
    t = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    sums = {"w": w, "agree": F.when(x == y, w).otherwise(0.0), "x": F.when(x, w).otherwise(0.0), "y": F.when(y, w).otherwise(0.0)}
    aggs = [F.sum(c).alias(k) for k, c in sums.items()]
    t = t.groupBy(*keys).agg(*aggs) if keys else t.agg(*aggs)
    po, px, py = ratio("agree", "w"), ratio("x", "w"), ratio("y", "w")
    pe = px * py + (1 - px) * (1 - py)
    return t.select(*keys, F.col("w").alias("weight"), po.alias("agreement"), F.when(F.abs(1 - pe) > 1e-12, F.try_divide(po - pe, 1 - pe)).alias("kappa"))


def weighted_percentile(df: DataFrame, keys: list[str], value: str, weight: str, q: float) -> DataFrame:
    """Percentile by linear interpolation between the midpoints of cumulated weights.

    Weights are cumulated over ranges of the values of all keys, so that a key with most values is spread. The two
    neighbours of the percentile are the greatest place up to ``q`` and the least one above it.
    """
    d = running_sums_within(df.groupBy(*keys, value).agg(F.sum(weight).alias("w")), keys, [F.col(value).asc()], upto=F.col("w"))
    total = d.groupBy(*keys).agg(F.sum("w").alias("total"))
    at = ((F.col("upto") - F.col("w") / 2) / F.col("total")).alias("at")
    spot = F.struct("at", F.col(value).alias("v"))
    met = counted_join(d, total, keys, value).select(*keys, value, at)
    ends = met.groupBy(*keys).agg(F.max(F.when(F.col("at") <= q, spot)).alias("lo"), F.min(F.when(F.col("at") > q, spot)).alias("hi"))
    between = F.col("lo.v") + (F.col("hi.v") - F.col("lo.v")) * F.try_divide(q - F.col("lo.at"), F.col("hi.at") - F.col("lo.at"))
    return ends.select(*keys, F.coalesce(between, F.col("hi.v"), F.col("lo.v")).cast("double").alias("percentile"))
