"""Ledger to metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import boards, metrics
from plumbline.operators.percentiles import exact_percentiles
from plumbline.plans.catalog import proxy, query
from plumbline.session import cut_lineage

KEYS = ["system", "subtask"]


def rounded(df, *keep, digits=6):
    """Everything but ``keep`` rounded, so that the order of floating sums doesn't show."""
    return df.select(*keep, *[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keep])


@query("src_17_latest_record", "select row_id, system, seq, ok, score from latest")
def latest_record(spark, sf):
    led = proxy(spark, sf, "ledger")
    return metrics.latest_per_key(led, ["row_id", "system"], F.desc("seq")).select("row_id", "system", "seq", "ok", "score")


@query("map_04_judgments", "select system, subtask, row_id, positive, score, outcome, correct from judgments")
def judgments(spark, sf):
    led = metrics.latest_per_key(proxy(spark, sf, "ledger"), ["row_id", "system"], F.desc("seq"))
    outcome = F.when(~F.col("ok"), "failed").when(F.col("score").isNull(), "no_decision").otherwise("decided")
    positive = F.col("expected") == "yes"
    right = F.col("ok") & F.col("score").isNotNull() & ((F.col("score") >= 0.5) == positive)
    return led.select("system", "subtask", "row_id", positive.alias("positive"), "score", outcome.alias("outcome"), right.alias("correct"))


CONFUSION = """
  select {k}, count(*) filter (positive) as n_pos, count(*) filter (not positive) as n_neg,
    count(*) filter (positive and outcome = 'decided' and score >= 0.5) as tp,
    count(*) filter (not positive and outcome = 'decided' and score < 0.5) as tn,
    count(*) filter (not positive and outcome = 'decided' and score >= 0.5) as fp,
    count(*) filter (positive and outcome = 'decided' and score < 0.5) as fn,
    count(*) filter (outcome <> 'decided') as n_failed
  from judgments group by {k}
"""
BY_UNIT = CONFUSION.format(k="system, subtask")


@query("agg_01_confusion_counts", BY_UNIT)
def confusion_counts(spark, sf):
    return metrics.confusion(proxy(spark, sf, "judgments"), KEYS)


@query(
    "agg_02_task_score",
    f"""with c as ({BY_UNIT}) select system, subtask, round(50 * (tp::double / nullif(n_pos, 0) + tn::double / nullif(n_neg, 0)), 6) as score,
    round(tp::double / nullif(n_pos, 0), 6) as recall, round(fp::double / nullif(n_neg, 0), 6) as fpr,
    round(50 * (tp::double / nullif(tp + fn, 0) + tn::double / nullif(tn + fp, 0)), 6) as conditional_score from c""",
)
def task_score(spark, sf):
    c = metrics.confusion(proxy(spark, sf, "judgments"), KEYS)
    recall, passed = metrics.ratio("tp", "n_pos"), metrics.ratio("tn", "n_neg")
    answered = metrics.ratio("tp", F.col("tp") + F.col("fn")) + metrics.ratio("tn", F.col("tn") + F.col("fp"))
    out = c.select("system", "subtask", (50 * (recall + passed)).alias("score"), recall.alias("recall"), metrics.ratio("fp", "n_neg").alias("fpr"), (50 * answered).alias("conditional_score"))
    return rounded(out, "system", "subtask")


@query(
    "agg_03_subtask_mean",
    f"""with c as ({CONFUSION.format(k='system, subtask, source')}), u as (select system, subtask, 50 * (tp::double / nullif(n_pos, 0) + tn::double / nullif(n_neg, 0)) as ba from c)
    select system, subtask, round(avg(ba), 6) as mean_ba, count(ba) as n_units from u group by system, subtask""",
)
def subtask_mean(spark, sf):
    u = metrics.unit_metrics(metrics.confusion(proxy(spark, sf, "judgments"), [*KEYS, "source"]))
    return u.groupBy(*KEYS).agg(F.round(F.avg("balanced_accuracy"), 6).alias("mean_ba"), F.count("balanced_accuracy").alias("n_units"))


@query(
    "agg_04_unit_metrics",
    f"""with c as ({BY_UNIT}) select system, subtask, n_pos, n_neg, tp, tn, fp, fn, n_failed,
    round(50 * (tp::double / nullif(n_pos, 0) + tn::double / nullif(n_neg, 0)), 6) as balanced_accuracy, round(100 * tp::double / nullif(n_pos, 0), 6) as catch_rate,
    round(100 * fp::double / nullif(n_neg, 0), 6) as false_block_rate, round(100 * tp::double / nullif(tp + fp, 0), 6) as "precision",
    round(100 * (2 * tp)::double / nullif(2 * tp + fp + n_pos - tp, 0), 6) as f1 from c""",
)
def unit_metrics(spark, sf):
    return rounded(metrics.unit_metrics(metrics.confusion(proxy(spark, sf, "judgments"), KEYS)), *KEYS)


@query(
    "agg_05_subtask_metrics",
    f"""with c as ({CONFUSION.format(k='system, subtask, source')}), u as (select *, 50 * (tp::double / nullif(n_pos, 0) + tn::double / nullif(n_neg, 0)) as ba from c)
    select system, subtask, round(case when count(ba) = count(*) then avg(ba) end, 6) as strict_ba, round(sum(n_failed)::double / sum(n_pos + n_neg), 6) as failure_rate from u group by system, subtask""",
)
def subtask_metrics(spark, sf):
    u = metrics.unit_metrics(metrics.confusion(proxy(spark, sf, "judgments"), [*KEYS, "source"]))
    return u.groupBy(*KEYS).agg(
        F.round(metrics.mean_or_null(F.col("balanced_accuracy")), 6).alias("strict_ba"), F.round(F.sum("n_failed") / F.sum(F.col("n_pos") + F.col("n_neg")), 6).alias("failure_rate")
    )


@query(
    "agg_06_auroc",
    """with d as (select * from judgments where score is not null),
    r as (select system, subtask, positive, rank() over (partition by system, subtask order by score) + (count(*) over (partition by system, subtask, score) - 1) / 2.0 as rk from d)
    select system, subtask, round((sum(rk::double) filter (positive) - count(*) filter (positive) * (count(*) filter (positive) + 1) / 2.0)
      / nullif(count(*) filter (positive) * count(*) filter (not positive), 0), 6) as auroc from r group by system, subtask""",
)
def auroc(spark, sf):
    return rounded(metrics.auroc(proxy(spark, sf, "judgments"), KEYS), *KEYS)


CUMULATIVE = """
  select system, subtask, score, sum(sum(positive::bigint)) over w as tp, sum(sum((not positive)::bigint)) over w as fp,
    sum(sum(positive::bigint)) over (partition by system, subtask) as n_pos, sum(sum((not positive)::bigint)) over (partition by system, subtask) as n_neg
  from judgments where score is not null group by system, subtask, score window w as (partition by system, subtask order by score desc rows unbounded preceding)
"""


@query(
    "agg_07_recall_at_budget",
    f"""with c as ({CUMULATIVE}), ok as (select *, tp::double / nullif(n_pos, 0) as recall from c where fp <= 0.1 * n_neg)
    select system, subtask, round(recall, 6) as recall, score as threshold from (select *, row_number() over (partition by system, subtask order by recall desc, score desc) as rn from ok) where rn = 1""",
)
def recall_at_budget(spark, sf):
    return rounded(metrics.recall_at_budget(proxy(spark, sf, "judgments").where("score is not null"), KEYS, 0.1), *KEYS)


BINS = """
  select system, subtask, least(floor(score * 10), 9)::int as bin, count(*) as n, sum(score) as conf, sum(positive::int)::double as hits, sum((score - positive::int) * (score - positive::int)) as sq
  from judgments where score is not null group by 1, 2, 3
"""


@query("agg_08_calibration", f"with b as ({BINS}) select system, subtask, round(sum(sq) / sum(n), 6) as brier, round(sum(abs(conf - hits)) / sum(n), 6) as ece, sum(n)::bigint as n from b group by 1, 2")
def calibration(spark, sf):
    return rounded(metrics.calibration(proxy(spark, sf, "judgments"), KEYS), *KEYS)


@query("sta_14_reliability_bins", f"with b as ({BINS}) select system, subtask, bin, n, round(conf / n, 6) as mean_score, round(hits / n, 6) as share_positive from b")
def reliability_bins(spark, sf):
    return rounded(metrics.reliability(proxy(spark, sf, "judgments"), KEYS), *KEYS, "bin")


@query(
    "agg_10_ledger_summary",
    """select system, config_hash, count(*) as n, count(*) filter (outcome = 'failed') as n_failed,
    round(100 * avg(correct::int), 6) as flagged_accuracy, round(100 * (sum(correct::int) filter (outcome = 'decided'))::double / nullif(count(*) filter (outcome = 'decided'), 0), 6) as excluded_accuracy,
    round(100 * avg((correct or outcome = 'failed')::int), 6) as passed_accuracy from judgments group by 1, 2""",
)
def ledger_summary(spark, sf):
    """Accuracy under three policies for failures: count as wrong, leave out, count as right."""
    j = proxy(spark, sf, "judgments")
    right, decided = F.col("correct").cast("int"), F.col("outcome") == "decided"
    return rounded(
        j.groupBy("system", "config_hash").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "failed").alias("n_failed"), (100 * F.avg(right)).alias("flagged_accuracy"),
            (100 * F.avg(F.when(decided, right))).alias("excluded_accuracy"), (100 * F.avg((F.col("correct") | (F.col("outcome") == "failed")).cast("int"))).alias("passed_accuracy"),
        ), "system", "config_hash",
    )


@query(
    "agg_11_breakdown",
    "select system, config_hash, subtask, source, split, positive, outcome, count(*) as n, round(avg(correct::int), 6) as share_correct from judgments group by 1, 2, 3, 4, 5, 6, 7",
)
def breakdown(spark, sf):
    return proxy(spark, sf, "judgments").groupBy("system", "config_hash", "subtask", "source", "split", "positive", "outcome").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("share_correct")
    )


@query(
    "agg_13_primary_summary",
    "select system, split, count(*) as n, sum(correct::int)::bigint as n_correct, count(distinct grp) as n_groups, round(avg(score), 6) as mean_score from judgments group by 1, 2",
)
def primary_summary(spark, sf):
    return proxy(spark, sf, "judgments").groupBy("system", "split").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("n_correct"), F.count_distinct("grp").alias("n_groups"), F.round(F.avg("score"), 6).alias("mean_score")
    )


THRESHOLDS = f"""
  select *, case when lead(score) over w is null then score else (score + lead(score) over w) / 2 end as threshold
  from ({CUMULATIVE}) c window w as (partition by system, subtask order by score desc)
"""


@query(
    "agg_14_select_threshold",
    f"""with t as ({THRESHOLDS}), s as (select system, subtask, threshold, round(100 * ((tp::double / nullif(n_pos, 0) + 1 - fp::double / nullif(n_neg, 0)) / 2), 6) as ba, round(fp::double / nullif(n_neg, 0), 8) as fpr
      from t where n_pos > 0 and n_neg > 0)
    select system, subtask, round(threshold, 6) as threshold, ba, fpr from (select *, row_number() over (partition by system, subtask order by ba desc, fpr, threshold desc) as rn from s) where rn = 1""",
)
def select_threshold(spark, sf):
    return metrics.select_threshold(proxy(spark, sf, "judgments").where("score is not null"), KEYS).withColumn("threshold", F.round("threshold", 6))


@query(
    "agg_15_budget_threshold",
    f"""with t as ({THRESHOLDS}), s as (select system, subtask, threshold, tp::double / nullif(n_pos, 0) as recall, fp::double / nullif(n_neg, 0) as fpr from t where fp <= 0.2 * n_neg)
    select system, subtask, round(threshold, 6) as threshold, round(recall, 6) as recall from (select *, row_number() over (partition by system, subtask order by recall desc, fpr, threshold desc) as rn from s) where rn = 1""",
)
def budget_threshold(spark, sf):
    t = metrics.thresholds(proxy(spark, sf, "judgments").where("score is not null"), KEYS).where(F.col("fp") <= 0.2 * F.col("n_neg"))
    t = t.withColumn("recall", F.try_divide("tp", "n_pos"))
    best = metrics.latest_per_key(t, KEYS, F.desc_nulls_last("recall"), F.try_divide("fp", "n_neg"), F.desc("threshold"))
    return rounded(best.select(*KEYS, "threshold", "recall"), *KEYS)


@query(
    "agg_16_length_threshold",
    """with d as (select length(text) as n, (expected = 'yes') as y from records where expected is not null),
    v as (select n, sum(y::int) as p, sum((not y)::int) as q from d group by n),
    c as (select n, sum(p) over (order by n) as cp, sum(q) over (order by n) as cq, sum(p) over () as tp, sum(q) over () as tq from v),
    s as (select n, 'short is yes' as direction, round(50 * (cp::double / tp + 1 - cq::double / tq), 6) as ba from c union all select n, 'long is yes', round(50 * (1 - cp::double / tp + cq::double / tq), 6) from c)
    select direction, ba, n::bigint as threshold from (select *, row_number() over (partition by direction order by ba desc, n) as rn from s) where rn = 1""",
)
def length_threshold(spark, sf):
    """The best rule by length alone, both ways round; the window runs over distinct lengths."""
    from pyspark.sql import Window

    d = proxy(spark, sf, "records").where("expected is not null").select(F.length("text").cast("long").alias("n"), (F.col("expected") == "yes").cast("int").alias("y"))
    v = d.groupBy("n").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    up, all_ = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(F.lit(1))
    c = v.select("n", F.sum("p").over(up).alias("cp"), F.sum("q").over(up).alias("cq"), F.sum("p").over(all_).alias("tp"), F.sum("q").over(all_).alias("tq"))
    short = 50 * (F.try_divide("cp", "tp") + 1 - F.try_divide("cq", "tq"))
    both = F.array(F.struct(F.lit("short is yes").alias("direction"), F.round(short, 6).alias("ba")), F.struct(F.lit("long is yes").alias("direction"), F.round(50 * (1 - F.try_divide("cp", "tp") + F.try_divide("cq", "tq")), 6).alias("ba")))
    s = c.select("n", F.explode(both).alias("x")).select("n", "x.*")
    return metrics.latest_per_key(s, ["direction"], F.desc("ba"), F.asc("n")).select("direction", "ba", F.col("n").alias("threshold"))


@query(
    "agg_17_overall_block",
    f"""with c as ({BY_UNIT}), u as (select system, subtask, 50 * (tp::double / nullif(n_pos, 0) + tn::double / nullif(n_neg, 0)) as ba, tp, tn, n_pos, n_neg from c),
    o as (select system, avg(ba) as overall, 50 * (sum(tp)::double / nullif(sum(n_pos), 0) + sum(tn)::double / nullif(sum(n_neg), 0)) as pooled from u group by system)
    select u.system, u.subtask as left_out, round((select avg(x.ba) from u x where x.system = u.system and x.subtask <> u.subtask), 6) as mean_without, round(o.overall, 6) as overall, round(o.pooled, 6) as pooled
    from u join o on u.system = o.system""",
)
def overall_block(spark, sf):
    """Mean over subtasks, the same with each left out, and the pooled score."""
    from pyspark.sql import Window

    u = metrics.unit_metrics(metrics.confusion(proxy(spark, sf, "judgments"), KEYS))
    w = Window.partitionBy("system")
    total, n = F.sum("balanced_accuracy").over(w), F.count("balanced_accuracy").over(w)
    pooled = 50 * (F.try_divide(F.sum("tp").over(w), F.sum("n_pos").over(w)) + F.try_divide(F.sum("tn").over(w), F.sum("n_neg").over(w)))
    rest = F.try_divide(total - F.coalesce("balanced_accuracy", F.lit(0.0)), n - F.col("balanced_accuracy").isNotNull().cast("int"))
    return rounded(u.select("system", F.col("subtask").alias("left_out"), rest.alias("mean_without"), F.try_divide(total, n).alias("overall"), pooled.alias("pooled")), "system", "left_out")


@query(
    "agg_21_latency",
    """with r as (select row_id, system, sum(latency_s) as latency, arg_max(ok, seq) as ok from ledger group by 1, 2),
    f as (select system, count(*) as n_rows, round(count(*) filter (not ok) / count(*)::double, 6) as failure_rate from r group by 1)
    select system, count(*) as n, round(quantile_cont(latency, 0.5), 6) as p50, round(quantile_cont(latency, 0.95), 6) as p95, round(sum(latency), 4) as total, n_rows, failure_rate
    from r join f using (system) where ok group by system, n_rows, failure_rate""",
)
def latency(spark, sf):
    """Latency of a row is the sum over its attempts; percentiles are over the rows that succeeded, and failures are a rate."""
    r = proxy(spark, sf, "ledger").groupBy("row_id", "system").agg(F.sum("latency_s").alias("latency"), F.max_by("ok", "seq").alias("ok"))
    r = cut_lineage(r)  # two passes
    share = F.count_if(~F.col("ok")) / F.count(F.lit(1))
    facts = r.groupBy("system").agg(F.count(F.lit(1)).alias("n_rows"), F.round(share, 6).alias("failure_rate"), F.round(F.sum(F.when(F.col("ok"), F.col("latency"))), 4).alias("total"))
    p = exact_percentiles(r.where("ok"), ["system"], F.col("latency"), [0.5, 0.95]).groupBy("system", "n").agg(
        *[F.round(F.max(F.when(F.col("share") == s, F.col("percentile"))), 6).alias(a) for s, a in ((0.5, "p50"), (0.95, "p95"))]
    )
    return p.join(facts, "system").select("system", "n", "p50", "p95", "total", "n_rows", "failure_rate")


@query(
    "agg_22_weighted_percentile",
    """with v as (select system, tokens_out, sum(tokens_in) as w from judgments group by 1, 2),
    a as (select *, (sum(w) over (partition by system order by tokens_out) - w / 2.0) / sum(w) over (partition by system) as pos from v),
    n as (select *, lead(pos) over (partition by system order by tokens_out) as npos, lead(tokens_out) over (partition by system order by tokens_out) as nval from a)
    select system, round(coalesce(max(case when pos <= 0.5 and npos > 0.5 then tokens_out + (nval - tokens_out) * (0.5 - pos) / (npos - pos) end), case when min(pos) > 0.5 then min(tokens_out) end, max(tokens_out))::double, 6) as percentile
    from n group by system""",
)
def weighted_percentile(spark, sf):
    return rounded(metrics.weighted_percentile(proxy(spark, sf, "judgments"), ["system"], "tokens_out", "tokens_in", 0.5), "system")


@query("win_02_competition_rank", f"with c as ({BY_UNIT}), u as (select system, subtask, 50 * (tp::double / nullif(n_pos, 0) + tn::double / nullif(n_neg, 0)) as ba from c) select system, subtask, round(ba, 6) as ba, case when ba is not null then rank() over (partition by subtask, ba is null order by round(ba, 1) desc) end as rank from u")
def rank_on_board(spark, sf):
    u = metrics.unit_metrics(metrics.confusion(proxy(spark, sf, "judgments"), KEYS)).select("system", "subtask", F.round("balanced_accuracy", 6).alias("ba"))
    return boards.competition_rank(u, ["subtask"], "ba", 1).withColumn("rank", F.col("rank").cast("long"))


@query(
    "flagship_leaderboard",
    f"""with c as ({BY_UNIT}), u as (select system, subtask, 50 * (tp::double / nullif(n_pos, 0) + tn::double / nullif(n_neg, 0)) as ba, tp::double / nullif(n_pos, 0) as catch, fp::double / nullif(n_neg, 0) as fbr, n_failed, n_pos + n_neg as n from c),
    b as (select system, case when count(ba) = count(*) then avg(ba) end as ba, avg(catch) as catch, avg(fbr) as fbr, sum(n_failed)::double / sum(n) as failed, sum(n)::bigint as n from u group by system)
    select system, round(ba, 6) as balanced_accuracy, round(100 * catch, 6) as catch_rate, round(100 * fbr, 6) as false_block_rate, round(failed, 6) as failure_rate, n,
      case when ba is not null then rank() over (partition by ba is null order by round(ba, 2) desc) end as rank from b""",
)
def leaderboard(spark, sf):
    """Ledger to board: latest record of each row, judgments, counts, mean over subtasks, rank. One lazy plan."""
    j = proxy(spark, sf, "judgments")
    u = metrics.unit_metrics(metrics.confusion(j, KEYS))
    b = u.groupBy("system").agg(
        metrics.mean_or_null(F.col("balanced_accuracy")).alias("balanced_accuracy"), F.avg("catch_rate").alias("catch_rate"), F.avg("false_block_rate").alias("false_block_rate"),
        (F.sum("n_failed") / F.sum(F.col("n_pos") + F.col("n_neg"))).alias("failure_rate"), F.sum(F.col("n_pos") + F.col("n_neg")).alias("n"),
    )
    return rounded(boards.competition_rank(b, [], "balanced_accuracy").withColumn("rank", F.col("rank").cast("long")), "system")
