"""Resampling and tests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import boards, metrics, resampling
from plumbline.operators.ranges import row_numbers
from plumbline.plans.catalog import proxy, query
from plumbline.plans.scoring import KEYS, rounded
from plumbline.session import cut_lineage

#: A unit of the draws: a group inside its subtask, drawn for all systems alike.
UNIT = "('0x' || substr(md5('draw:' || subtask || ':' || grp), 1, 15))::bigint as h"

STATS = """
  select system, subtask, grp, sum(positive::bigint)::bigint as pos, sum((positive and outcome = 'decided' and score >= 0.5)::bigint)::bigint as pos_credit,
    sum((not positive)::bigint)::bigint as neg, sum((not positive and outcome = 'decided' and score < 0.5)::bigint)::bigint as neg_credit
  from judgments group by 1, 2, 3
"""
DRAWS = resampling.drawn_sql(f"select distinct subtask, grp, {UNIT} from judgments")
SUMMED_BA = "50 * (sum(mult * pos_credit)::double / nullif(sum(mult * pos), 0) + sum(mult * neg_credit)::double / nullif(sum(mult * neg), 0))"
#: Balanced accuracy of every system, subtask and replicate; replicate 0 is the sample itself.
REPLICATES = f"select s.system, s.subtask, d.rep, {SUMMED_BA} as ba from ({STATS}) s join {DRAWS} d on s.subtask = d.subtask and s.grp = d.grp group by 1, 2, 3"
#: The same of the mean over subtasks.
OVERALL = f"select system, rep, avg(ba) as ba from ({REPLICATES}) group by 1, 2"


def unit():
    return resampling.unit_number(F.lit("draw"), F.col("subtask"), F.col("grp"))


def replicates(spark, sf, judgments=None):
    j = proxy(spark, sf, "judgments") if judgments is None else judgments
    sums = resampling.replicate_sums(boards.group_stats(j, KEYS), KEYS, unit(), ["pos", "pos_credit", "neg", "neg_credit"])
    return sums.select(*KEYS, "rep", resampling.balanced_accuracy().alias("ba"))


def overall(reps):
    return reps.groupBy("system", "rep").agg(F.avg("ba").alias("ba"))


@query("sta_01_group_draws", f"select subtask, grp, sum(mult)::bigint as drawn, sum(mult * rep)::bigint as weighted, max(mult)::bigint as most, (count(*) filter (mult = 0))::bigint as left_out from {DRAWS} where rep > 0 group by 1, 2")
def group_draws(spark, sf):
    """How often each group is drawn over 2,000 replicates: a vector a group, made where the group is."""
    groups = proxy(spark, sf, "judgments").select("subtask", "grp").distinct()
    v = F.slice("mult", 2, resampling.REPLICATES)
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s + y)
    return resampling.draw_vectors(groups, unit()).select(
        "subtask", "grp", total(v).alias("drawn"), total(F.transform(v, lambda x, k: x.cast("long") * (k + 1))).alias("weighted"), F.array_max(v).cast("long").alias("most"),
        F.size(F.filter(v, lambda x: x == 0)).cast("long").alias("left_out"),
    )


@query("sta_02_group_statistics", STATS)
def group_statistics(spark, sf):
    return boards.group_stats(proxy(spark, sf, "judgments"), KEYS)


@query("sta_03_replicate_scores", f"select system, subtask, rep, round(ba, 6) as ba from ({REPLICATES})")
def replicate_scores(spark, sf):
    return rounded(replicates(spark, sf), "system", "subtask", "rep")


@query("sta_04_percentile_interval", f"select system, subtask, round(point, 6) as point, round(ci_low, 6) as ci_low, round(ci_high, 6) as ci_high, n_valid from ({resampling.summary_sql(REPLICATES, 'system, subtask', 'ba')})")
def percentile_interval(spark, sf):
    return rounded(resampling.summary(replicates(spark, sf), KEYS, "ba").drop("se"), *KEYS)


DIFFERENCES = f"select a.subtask, a.rep, a.system as a, b.system as b, a.ba - b.ba as d from ({REPLICATES}) a join ({REPLICATES}) b on a.subtask = b.subtask and a.rep = b.rep and a.system < b.system"
PAIRS = resampling.summary_sql(DIFFERENCES, "subtask, a, b", "d")
TESTED = f"select *, {resampling.wald_p_sql('point', 'se')} as p from ({PAIRS})"


def tested(reps, keys, who="system"):
    """Point difference, interval, spread and p of every two systems on shared draws."""
    s = resampling.summary(resampling.pairs(reps, keys, who, "ba"), [*keys, "a", "b"], "d")
    return s.withColumn("p", resampling.wald_p(F.col("point"), F.col("se")))


@query("sta_05_paired_difference", f"select subtask, a, b, round(point, 6) as difference, round(ci_low, 6) as ci_low, round(ci_high, 6) as ci_high, round(se, 6) as se, n_valid from ({PAIRS})")
def paired_difference(spark, sf):
    d = tested(replicates(spark, sf), ["subtask"])
    return d.select("subtask", "a", "b", *[F.round(c, 6).alias(n) for c, n in (("point", "difference"), ("ci_low", "ci_low"), ("ci_high", "ci_high"), ("se", "se"))], "n_valid")


@query("sta_06_wald_p_value", f"select subtask, a, b, round(point, 6) as difference, round(p, 8) as p from ({TESTED})")
def wald_p_value(spark, sf):
    """The point difference over the spread of its replicates."""
    return tested(replicates(spark, sf), ["subtask"]).select("subtask", "a", "b", F.round("point", 6).alias("difference"), F.round("p", 8).alias("p"))


HASH_P = """
  select subtask, system, case when count(*) % 7 = 0 then null else round(exp(-0.01 * (sum(tokens_out) % 500)), 6) end as p from judgments group by subtask, system
"""


@query(
    "sta_07_holm",
    f"""with t as ({HASH_P}), r as (select *, count(p) over (partition by subtask) as m, row_number() over (partition by subtask, p is null order by p, system) as k from t)
    select subtask, system, p, case when p is not null then round(max(least(1.0, (m - k + 1) * p)) over (partition by subtask, p is null order by p, system rows unbounded preceding), 8) end as p_holm from r""",
)
def holm(spark, sf):
    """Holm's adjustment of made-up p-values, some missing."""
    j = proxy(spark, sf, "judgments").groupBy("subtask", "system").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens_out").alias("t"))
    tests = j.select("subtask", "system", F.when(F.col("n") % 7 == 0, None).otherwise(F.round(F.exp(-0.01 * (F.col("t") % 500)), 6)).alias("p"))
    return boards.holm(tests, ["subtask"], "p", "system").withColumn("p_holm", F.round("p_holm", 8))


@query(
    "sta_08_rank_intervals",
    f"""with r as (select *, rank() over (partition by subtask, rep order by ba desc) + (count(*) over (partition by subtask, rep, ba) - 1) / 2.0 as rk from (select system, subtask, rep, round(ba, 6) as ba from ({REPLICATES}) where rep > 0) where ba is not null),
    l as (select subtask, system, list(rk::double order by rk) as rs from r group by 1, 2)
    select subtask, system, rs[(floor((len(rs) - 1) * 0.025) + 1)::int] as rank_low, rs[(ceil((len(rs) - 1) * 0.975) + 1)::int] as rank_high from l""",
)
def rank_intervals(spark, sf):
    reps = replicates(spark, sf).where("rep > 0").withColumn("ba", F.round("ba", 6))
    return boards.rank_intervals(reps, ["subtask"])


#: The board's entries, their paired tests with Holm's adjustment over all pairs, and the walk that makes tiers.
ENTRIES = f"""select e.system, e.ba, f.fbr, row_number() over (order by round(e.ba, 9) desc, round(f.fbr, 9), e.system) as pos, rank() over (order by round(e.ba, 9) desc, round(f.fbr, 9)) as rank
  from (select system, ba from ({OVERALL}) where rep = 0) e join (select system, 100 * avg(fbr) as fbr from (select system, subtask, (count(*) filter (not positive and outcome = 'decided' and score >= 0.5))::double / nullif(count(*) filter (not positive), 0) as fbr from judgments group by 1, 2) group by 1) f using (system)"""
BOARD_TESTS = f"""select *, max(least(1.0, (m - k + 1) * p)) over (order by p, a, b rows unbounded preceding) as p_holm
  from (select *, count(p) over () as m, row_number() over (order by p, a, b) as k from (select *, {resampling.wald_p_sql('point', 'se')} as p from ({resampling.summary_sql(f"select x.system as a, y.system as b, x.rep, x.ba - y.ba as d from ({OVERALL}) x join ({OVERALL}) y on x.rep = y.rep and x.system < y.system", "a, b", "d")})))"""
WALK = f"""entries as materialized ({ENTRIES}), tests as materialized ({BOARD_TESTS}),
  worse as (select case when point > 0 then a else b end as leader, case when point > 0 then b else a end as system from tests where p_holm < 0.05),
  walk as (select pos, system, system as leader, 1 as tier from entries where pos = 1
    union all select e.pos, e.system, case when w.system is null then s.leader else e.system end, s.tier + (w.system is not null)::int from walk s join entries e on e.pos = s.pos + 1 left join worse w on w.leader = s.leader and w.system = e.system)"""


def board_tests(reps):
    """Every two systems' overall scores: point difference, interval, p, and p adjusted over all pairs."""
    tests = tested(reps.withColumn("all", F.lit("all")), ["all"])
    return boards.holm(tests, ["all"], "p", "a", "b")


def walked(entries, tests, alpha=0.05):
    gain = F.col("point") > 0
    worse = tests.where(F.col("p_holm") < alpha).select(F.when(gain, F.col("a")).otherwise(F.col("b")).alias("leader"), F.when(gain, F.col("b")).otherwise(F.col("a")).alias("system"))
    return boards.tiers(entries.select("system", "pos"), worse)


def entries(spark, sf, reps):
    """(system, ba, fbr, pos, rank): higher balanced accuracy first, ties to the lower false-block rate."""
    u = metrics.unit_metrics(metrics.confusion(proxy(spark, sf, "judgments"), KEYS)).groupBy("system").agg(F.avg("false_block_rate").alias("fbr"))
    e = reps.where("rep = 0").select("system", "ba").join(u, "system")
    order = [F.desc(F.round("ba", 9)), F.asc(F.round("fbr", 9))]
    one = Window.partitionBy(F.lit(1))  # a row a system
    return e.withColumns({"pos": F.row_number().over(one.orderBy(*order, "system")), "rank": F.rank().over(one.orderBy(*order)).cast("long")})


@query("sta_09_tiers", f"with recursive {WALK} select system, tier from walk")
def tiers(spark, sf):
    """Tiers of the overall board: a system leads the next tier if it is worse than the leader of this one by a test that
    holds after Holm's adjustment over all pairs."""
    reps = cut_lineage(overall(replicates(spark, sf)))
    return walked(entries(spark, sf, reps), board_tests(reps))


@query(
    "sta_12_verdict",
    f"""with t as (select *, count(p) over (partition by subtask) as m, row_number() over (partition by subtask, p is null order by p, a, b) as k from ({TESTED})),
    h as (select *, case when p is not null then max(least(1.0, (m - k + 1) * p)) over (partition by subtask, p is null order by p, a, b rows unbounded preceding) end as p_holm from t)
    select subtask, a, b, round(point, 6) as difference, round(p_holm, 8) as p_holm, case when p_holm is null then 'not tested' when p_holm >= 0.05 then 'within noise' when point > 0 then 'better' else 'worse' end as verdict from h""",
)
def verdict(spark, sf):
    """Better, worse or within noise by the p adjusted over the pairs of a subtask; not tested where there is none."""
    h = boards.holm(tested(replicates(spark, sf), ["subtask"]), ["subtask"], "p", "a", "b")
    return h.select("subtask", "a", "b", F.round("point", 6).alias("difference"), F.round("p_holm", 8).alias("p_holm"), boards.verdict(F.col("point"), F.col("p_holm")).alias("verdict"))


PAIRED = """
  select a.subtask, count(*) filter (a.correct and not b.correct) as only_a, count(*) filter (b.correct and not a.correct) as only_b
  from judgments a join judgments b on a.row_id = b.row_id and a.system = 'alpha' and b.system = 'beta' group by 1
"""


@query(
    "sta_13_mcnemar",
    f"""with c as ({PAIRED}), t as (select *, only_a + only_b as n, least(only_a, only_b) as k from c)
    select subtask, only_a, only_b, round(case when n = 0 then 1.0 else least(1.0, 2 * (select sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) - n * ln(2.0))) from range(0, k + 1) r(i))) end, 8) as p from t""",
)
def mcnemar(spark, sf):
    j = proxy(spark, sf, "judgments")
    a, b = (j.where(F.col("system") == s).select("subtask", "row_id", F.col("correct").alias(c)) for s, c in (("alpha", "a"), ("beta", "b")))
    c = a.join(b, ["subtask", "row_id"]).groupBy("subtask").agg(F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(F.col("b") & ~F.col("a")).alias("only_b"))
    return c.select("subtask", "only_a", "only_b", F.round(boards.binomial_two_sided(F.col("only_a"), F.col("only_a") + F.col("only_b")), 8).alias("p"))


@query("sta_18_subset_rescore", f"with j2 as (select * from judgments where tokens_in % 2 = 0) select s.system, s.subtask, d.rep, round({SUMMED_BA}, 6) as ba from ({STATS.replace('from judgments', 'from j2')}) s join {DRAWS} d on s.subtask = d.subtask and s.grp = d.grp group by 1, 2, 3")
def subset_rescore(spark, sf):
    """A subset scored on the draws of the whole: a group's draws don't depend on which rows are scored."""
    return rounded(replicates(spark, sf, proxy(spark, sf, "judgments").where("tokens_in % 2 = 0")), "system", "subtask", "rep")


@query(
    "sta_20_planted_signal",
    """select id, expected, expected = 'yes' and ('0x' || substr(md5('plant:' || id), 1, 8))::bigint / 4294967296.0 < 0.3 as planted from records where expected is not null""",
)
def planted_signal(spark, sf):
    """A known signal put into a hashed share of the positive rows, to show that a check would find it."""
    r = proxy(spark, sf, "records").where("expected is not null")
    return r.select("id", "expected", ((F.col("expected") == "yes") & (boards.unit_hash(F.lit("plant"), F.col("id")) < 0.3)).alias("planted"))


@query(
    "sta_19_permuted_labels",
    """with g as (select grp, max(expected) as label, row_number() over (order by grp) as at, row_number() over (order by md5('perm:' || grp), grp) as to_ from records where expected is not null group by grp)
    select a.grp, a.label, b.label as permuted from g a join g b on a.at = b.to_""",
)
def permuted_labels(spark, sf):
    """Labels handed to other groups in a hashed order. Both orders are numbered by ranges, not in one task."""
    g = proxy(spark, sf, "records").where("expected is not null").groupBy("grp").agg(F.max("expected").alias("label"))
    h = F.md5(F.concat(F.lit("perm:"), F.col("grp").cast("string")))
    b = row_numbers(g.withColumn("h", h), [F.col("h").asc(), F.col("grp").asc()], "bt").select(F.col("label").alias("permuted"), "bt")
    g = row_numbers(g, [F.col("grp").asc()])
    return g.join(b, F.col("at") == F.col("bt")).select("grp", "label", "permuted")


@query(
    "sta_10_board",
    f"""with recursive {WALK}, o as ({OVERALL}), i as ({resampling.summary_sql('select * from o', 'system', 'ba')}),
    r as (select system, list(rk::double order by rk) as rs from (select system, rank() over (partition by rep order by ba desc) + (count(*) over (partition by rep, ba) - 1) / 2.0 as rk from (select system, rep, round(ba, 6) as ba from o where rep > 0)) group by 1)
    select e.system, e.rank, round(e.ba, 6) as ba, round(e.fbr, 6) as false_block_rate, round(i.ci_low, 6) as ci_low, round(i.ci_high, 6) as ci_high, i.n_valid, rs[(floor((len(rs) - 1) * 0.025) + 1)::int] as rank_low, rs[(ceil((len(rs) - 1) * 0.975) + 1)::int] as rank_high, w.tier
    from entries e join i using (system) join r using (system) join walk w using (system)""",
)
def board(spark, sf):
    """Overall board: rank (ties to the lower false-block rate), interval, rank interval, and tier by adjusted tests."""
    reps = cut_lineage(overall(replicates(spark, sf)))
    e = entries(spark, sf, reps)
    i = resampling.summary(reps, ["system"], "ba").select("system", "ci_low", "ci_high", "n_valid")
    k = boards.rank_intervals(reps.where("rep > 0").withColumns({"ba": F.round("ba", 6), "one": F.lit(1)}), ["one"]).select("system", "rank_low", "rank_high")
    out = e.join(i, "system").join(k, "system").join(walked(e, board_tests(reps)), "system")
    return out.select("system", "rank", F.round("ba", 6).alias("ba"), F.round("fbr", 6).alias("false_block_rate"), F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"), "n_valid", "rank_low", "rank_high", "tier")


@query(
    "agg_23_kappa",
    """with p as (select a.subtask, case when a.score >= 0.5 then 'yes' else 'no' end as x, case when b.score >= 0.5 then 'yes' else 'no' end as y, a.tokens_in::double as w
      from judgments a join judgments b on a.row_id = b.row_id and a.system = 'alpha' and b.system = 'gamma' where a.outcome = 'decided' and b.outcome = 'decided'),
    s as (select subtask, sum(w) as w, sum(w) filter (x = y) / sum(w) as po, coalesce(sum(w) filter (x = 'yes'), 0) / sum(w) as px, coalesce(sum(w) filter (y = 'yes'), 0) / sum(w) as py from p group by subtask)
    select subtask, w as weight, round(po, 6) as agreement, round(case when abs(1 - (px * py + (1 - px) * (1 - py))) > 1e-12 then (po - (px * py + (1 - px) * (1 - py))) / (1 - (px * py + (1 - px) * (1 - py))) end, 6) as kappa from s""",
)
def kappa(spark, sf):
    j = proxy(spark, sf, "judgments").where("outcome = 'decided'")
    said = F.when(F.col("score") >= 0.5, "yes").otherwise("no")
    a = j.where("system = 'alpha'").select("subtask", "row_id", said.alias("x"), F.col("tokens_in").cast("double").alias("w"))
    b = j.where("system = 'gamma'").select("row_id", said.alias("y"))
    return rounded(metrics.kappa(a.join(b, "row_id"), ["subtask"], "x", "y", "w"), "subtask")


@query(
    "agg_24_agreement_multi_grain",
    """with p as (select r.split, r.source, a.subtask, (a.score >= 0.5) = (b.score >= 0.5) as same from judgments a join judgments b on a.row_id = b.row_id and a.system = 'alpha' and b.system = 'beta' join records r on r.id = a.row_id where a.outcome = 'decided' and b.outcome = 'decided')
    select case when grouping(split) = 0 then 'split' when grouping(source) = 0 then 'source' when grouping(subtask) = 0 then 'subtask' else 'all' end as grain, coalesce(split, source, subtask, 'all') as value, count(*) as n, round(avg(same::int), 6) as agreement
    from p group by grouping sets ((), (split), (source), (subtask))""",
)
def agreement_multi_grain(spark, sf):
    """Agreement of two systems overall and by split, source and subtask, in one pass."""
    j = proxy(spark, sf, "judgments").where("outcome = 'decided'")
    a = j.where("system = 'alpha'").select("split", "source", "subtask", "row_id", (F.col("score") >= 0.5).alias("x"))
    b = j.where("system = 'beta'").select("row_id", (F.col("score") >= 0.5).alias("y"))
    g = a.join(b, "row_id").groupingSets([[], ["split"], ["source"], ["subtask"]], "split", "source", "subtask").agg(
        F.grouping("split").alias("gs"), F.grouping("source").alias("go"), F.grouping("subtask").alias("gt"), F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("x") == F.col("y")).cast("int")), 6).alias("agreement")
    )
    grain = F.when(F.col("gs") == 0, "split").when(F.col("go") == 0, "source").when(F.col("gt") == 0, "subtask").otherwise("all")
    return g.select(grain.alias("grain"), F.coalesce("split", "source", "subtask", F.lit("all")).alias("value"), "n", "agreement")


