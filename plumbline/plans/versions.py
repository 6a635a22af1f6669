"""Versions of a system side by side, amended labels, bootstraps of rows and groups, and tables kept by version."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import boards, metrics, resampling
from plumbline.plans.catalog import proxy, query, table
from plumbline.plans.scoring import KEYS, rounded
from plumbline.plans.statistics import DRAWS, REPLICATES, replicates, unit
from plumbline.plans.views import BA, balanced
from plumbline.sources.lookup import lookup, write_indexed
from plumbline.streaming.ledger import shared_folder

#: A lineage of versions: each pair of neighbours is a step, and the first and the last are compared too.
VERSIONS = ("alpha", "beta", "gamma")


def aligned(spark, sf, old="alpha", new="beta"):
    """Judgments of two versions on the same rows."""
    j = proxy(spark, sf, "judgments").select("subtask", "row_id", "grp", "split", "positive", "system", "correct", "score")
    b = j.where(F.col("system") == new).select("row_id", F.col("correct").alias("new_correct"), F.col("score").alias("new_score"))
    return j.where(F.col("system") == old).drop("system").withColumnsRenamed({"correct": "old_correct", "score": "old_score"}).join(b, "row_id")


ALIGNED = "select a.subtask, a.row_id, a.grp, a.split, a.positive, a.correct as old_correct, b.correct as new_correct, a.score as old_score, b.score as new_score from judgments a join judgments b on a.row_id = b.row_id and a.system = 'alpha' and b.system = 'beta'"


@query(
    "agg_45_flips",
    f"""select subtask, count(*) filter (old_correct and new_correct) as both_right, count(*) filter (not old_correct and not new_correct) as both_wrong, count(*) filter (positive and new_correct and not old_correct) as catches_gained,
    count(*) filter (positive and old_correct and not new_correct) as catches_lost, count(*) filter (not positive and new_correct and not old_correct) as false_blocks_cleared, count(*) filter (not positive and old_correct and not new_correct) as false_blocks_added, count(*) as judgments
    from ({ALIGNED}) group by 1""",
)
def flips(spark, sf):
    """What a new version fixed and broke, by class."""
    p, a, b = (F.col(c) for c in ("positive", "old_correct", "new_correct"))
    kinds = {"both_right": a & b, "both_wrong": ~a & ~b, "catches_gained": p & b & ~a, "catches_lost": p & a & ~b, "false_blocks_cleared": ~p & b & ~a, "false_blocks_added": ~p & a & ~b}
    return aligned(spark, sf).groupBy("subtask").agg(*[F.count_if(c).alias(n) for n, c in kinds.items()], F.count(F.lit(1)).alias("judgments"))


CHANGE = "abs(coalesce(new_score, case when positive then 0.0 else 1.0 end) - coalesce(old_score, case when positive then 0.0 else 1.0 end))"


@query(
    "top_01_largest_changes",
    f"""select subtask, kind, row_id, round(change, 6) as change from (select *, row_number() over (partition by subtask, kind order by change desc, row_id) as rn
    from (select subtask, row_id, case when new_correct then 'fixed' else 'broke' end as kind, {CHANGE} as change from ({ALIGNED}) where old_correct <> new_correct and split <> 'private')) where rn <= 3""",
)
def largest_changes(spark, sf):
    """The public rows that a version fixed or broke with the largest change of score, three of each a job."""
    unknown = F.when(F.col("positive"), 0.0).otherwise(1.0)
    change = F.abs(F.coalesce("new_score", unknown) - F.coalesce("old_score", unknown))
    d = aligned(spark, sf).where("old_correct <> new_correct and split <> 'private'")
    d = d.select("subtask", F.when(F.col("new_correct"), "fixed").otherwise("broke").alias("kind"), "row_id", change.alias("change"))
    rn = F.row_number().over(Window.partitionBy("subtask", "kind").orderBy(F.desc("change"), "row_id"))
    return d.withColumn("rn", rn).where("rn <= 3").select("subtask", "kind", "row_id", F.round("change", 6).alias("change"))


#: Versions are the systems of the ledger that answered, but for the last by name, in the order of their names.
STEPS = """select old, new, kind from (
    select system as old, lead(system) over (order by system) as new, 'step' as kind from (select distinct system from ledger where system <> 'delta')
    union all select min(system), max(system), 'first to last' from (select distinct system from ledger where system <> 'delta') having count(*) > 2) where new is not null"""


@query("win_09_version_steps", f"select s.old as old_version, s.new as new_version, s.kind, s.old || '>' || s.new as name from ({STEPS}) s")
def version_steps(spark, sf):
    """Consecutive versions of the ledger, and the first with the last where there are three or more."""
    return steps(spark, sf).select(F.col("old").alias("old_version"), F.col("new").alias("new_version"), "kind", F.concat_ws(">", "old", "new").alias("name"))


def steps(spark, sf):
    v = proxy(spark, sf, "ledger").where("system <> 'delta'").select("system").distinct()
    order = Window.partitionBy(F.lit(1)).orderBy("system")  # a row a version
    pairs = v.select(F.col("system").alias("old"), F.lead("system").over(order).alias("new"), F.lit("step").alias("kind")).where("new is not null")
    ends = v.agg(F.min("system").alias("old"), F.max("system").alias("new"), F.count(F.lit(1)).alias("n")).where("n > 2").select("old", "new", F.lit("first to last"))
    return pairs.union(ends)


DELTAS = resampling.summary_sql(
    f"select a.subtask, s.old, s.new, s.kind, a.rep, b.ba - a.ba as d from ({STEPS}) s join ({REPLICATES}) a on a.system = s.old join ({REPLICATES}) b on b.system = s.new and a.subtask = b.subtask and a.rep = b.rep",
    "subtask, old, new, kind", "d",
)


@query(
    "sta_11_version_delta",
    f"""with t as (select *, {resampling.wald_p_sql('point', 'se')} as p from ({DELTAS})), k as (select *, count(p) over (partition by kind, old, new) as m, row_number() over (partition by kind, old, new, p is null order by p, subtask) as k from t),
    h as (select *, case when p is not null then max(least(1.0, (m - k + 1) * p)) over (partition by kind, old, new, p is null order by p, subtask rows unbounded preceding) end as p_holm from k)
    select subtask, old as old_version, new as new_version, kind, round(point, 6) as delta, round(ci_low, 6) as ci_low, round(ci_high, 6) as ci_high, round(p, 8) as p, round(p_holm, 8) as p_holm,
      case when p_holm is null then 'not tested' when p_holm >= 0.05 then 'within noise' when point > 0 then 'better' else 'worse' end as verdict from h""",
)
def version_delta(spark, sf):
    """New minus old on common draws: point, percentile interval, Wald p, and the verdict after Holm over a step's subtasks."""
    r = replicates(spark, sf)
    s = F.broadcast(steps(spark, sf))  # a row a step
    a = r.join(s, F.col("system") == F.col("old")).select("subtask", "rep", "old", "new", "kind", F.col("ba").alias("va"))
    b = r.select(F.col("system").alias("new"), "subtask", "rep", F.col("ba").alias("vb"))
    d = a.join(b, ["new", "subtask", "rep"]).select("subtask", "rep", F.col("old").alias("old_version"), F.col("new").alias("new_version"), "kind", (F.col("vb") - F.col("va")).alias("d"))
    step = ["kind", "old_version", "new_version"]
    t = resampling.summary(d, ["subtask", *step], "d").withColumn("p", resampling.wald_p(F.col("point"), F.col("se")))
    h = boards.holm(t, step, "p", "subtask")
    return h.select("subtask", *step, F.round("point", 6).alias("delta"), *[F.round(c, 6).alias(c) for c in ("ci_low", "ci_high")], F.round("p", 8).alias("p"), F.round("p_holm", 8).alias("p_holm"), boards.verdict(F.col("point"), F.col("p_holm")).alias("verdict"))


@query("xtr_47_version_stats", f"select system, rep, round(avg(ba), 6) as overall, count(ba) as n_subtasks from ({REPLICATES}) where system in ('alpha', 'beta', 'gamma') group by 1, 2")
def version_stats(spark, sf):
    """Replicates of the overall mean of each version: the mean over subtasks, draw by draw."""
    return replicates(spark, sf).where(F.col("system").isin(*VERSIONS)).groupBy("system", "rep").agg(F.round(F.avg("ba"), 6).alias("overall"), F.count("ba").alias("n_subtasks"))


@query("xtr_48_board_parity", f"with b as (select system, subtask, {BA} as ba from judgments group by 1, 2), p as (select system, subtask, case when system = 'delta' then ba + 0.5 else ba end as published from b) select system, count(*) as cells, count(*) filter (abs(b.ba - p.published) >= 0.006) as off from b join p using (system, subtask) group by 1")
def board_parity(spark, sf):
    """Recomputed scores against the published ones: how many cells are off by more than rounding."""
    b = proxy(spark, sf, "judgments").groupBy(*KEYS).agg(balanced().alias("ba"))
    published = b.select(*KEYS, F.when(F.col("system") == "delta", F.col("ba") + 0.5).otherwise(F.col("ba")).alias("published"))
    return b.join(published, KEYS).groupBy("system").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.abs(F.col("ba") - F.col("published")) >= 0.006).alias("off"))


AMENDED = "case when row_id % 41 = 0 then not positive else positive end"


@query("xtr_57_amended_scores", f"select system, subtask, round({BA}, 6) as before, round(50 * (avg((case when outcome = 'decided' then (score >= 0.5) = ({AMENDED}) else false end)::int) filter ({AMENDED}) + avg((case when outcome = 'decided' then (score >= 0.5) = ({AMENDED}) else false end)::int) filter (not ({AMENDED}))), 6) as after from judgments group by 1, 2")
def amended_scores(spark, sf):
    """Scores before and after some labels were amended."""
    j = proxy(spark, sf, "judgments")
    label = F.when(F.col("row_id") % 41 == 0, ~F.col("positive")).otherwise(F.col("positive"))
    right = F.coalesce((F.col("outcome") == "decided") & ((F.col("score") >= 0.5) == label), F.lit(False))
    return j.withColumns({"label": label, "right": right}).groupBy(*KEYS).agg(F.round(balanced(), 6).alias("before"), F.round(balanced("right", "label"), 6).alias("after"))


@query("xtr_43_rescored", f"select system, subtask, round({BA}, 6) as old_rule, round(50 * (avg((coalesce(score >= 0.35, false) and outcome = 'decided')::int) filter (positive) + avg((coalesce(score < 0.35, false) and outcome = 'decided')::int) filter (not positive)), 6) as new_rule from judgments group by 1, 2")
def rescored(spark, sf):
    """An old ledger under a new contract: another operating point, everything else the same plan."""
    j = proxy(spark, sf, "judgments")
    right = F.coalesce((F.col("outcome") == "decided") & ((F.col("score") >= 0.35) == F.col("positive")), F.lit(False))
    return j.withColumn("right", right).groupBy(*KEYS).agg(F.round(balanced(), 6).alias("old_rule"), F.round(balanced("right"), 6).alias("new_rule"))


@query("xtr_49_reported_tokens", "select row_id, system, arg_min(tokens_in, seq) as tokens, count(*) > 1 as repeated from ledger where ok group by 1, 2")
def reported_tokens(spark, sf):
    """Tokens of a check as first reported, and whether it was run again."""
    return proxy(spark, sf, "ledger").where("ok").groupBy("row_id", "system").agg(F.min_by("tokens_in", "seq").alias("tokens"), (F.count(F.lit(1)) > 1).alias("repeated"))


SESSIONS = "select user_id as session, count(*) as rows, max(epoch(date_trunc('second', ts)))::bigint - min(epoch(date_trunc('second', ts)))::bigint as seconds, bool_or(event_type = 'purchase') as started from events group by 1"


@query("xtr_50_started_sessions", f"select session, rows, round(rows::double / sum(rows) over (), 9) as share from ({SESSIONS}) where started")
def started_sessions(spark, sf):
    """Sessions that began, each with its share of the rows that all of them served."""
    s = table(spark, sf, "events").groupBy(F.col("user_id").alias("session")).agg(F.count(F.lit(1)).alias("rows"), F.bool_or(F.col("event_type") == "purchase").alias("started")).where("started")
    return s.crossJoin(F.broadcast(s.agg(F.sum("rows").alias("total")))).select("session", "rows", F.round(F.col("rows") / F.col("total"), 9).alias("share"))  # one row


# --- bootstraps --------------------------------------------------------------------------------------------------------

#: A row of the draws, inside its stratum.
ROW = "('0x' || substr(md5('draw:' || {0} || ':' || row_id), 1, 15))::bigint as h"
PAIRED_LABELS = "select a.subtask, a.row_id, (a.score >= 0.5)::int as x, (b.score >= 0.5)::int as y from judgments a join judgments b on a.row_id = b.row_id and a.system = 'alpha' and b.system = 'beta' where a.outcome = 'decided' and b.outcome = 'decided'"


@query(
    "sta_15_agreement_bootstrap",
    f"""with l as (select *, {ROW.format('subtask')} from ({PAIRED_LABELS})), s as (select rep, sum(mult)::double as n, sum(mult * (x = y)::int) / sum(mult)::double as po, sum(mult * x) / sum(mult)::double as px, sum(mult * y) / sum(mult)::double as py from {resampling.drawn_sql('select * from l')} group by 1),
    k as (select rep, po, px * py + (1 - px) * (1 - py) as pe from s where n > 0), v as (select rep, po, case when abs(1 - pe) > 1e-12 then (po - pe) / (1 - pe) end as kappa from k),
    o as (select list(po order by po) filter (rep > 0) as a, list(kappa order by kappa) filter (rep > 0 and kappa is not null) as k, max(po) filter (rep = 0) as agreement, max(kappa) filter (rep = 0) as kappa from v)
    select round(agreement, 6) as agreement, round(a[floor(0.025 * (len(a) - 1))::int + 1], 6) as agreement_low, round(a[floor(0.975 * (len(a) - 1))::int + 1], 6) as agreement_high,
      round(kappa, 6) as kappa, round(k[floor(0.025 * (len(k) - 1))::int + 1], 6) as kappa_low, round(k[floor(0.975 * (len(k) - 1))::int + 1], 6) as kappa_high, len(a)::bigint as reps from o""",
)
def agreement_bootstrap(spark, sf):
    """Agreement and kappa of two labellers with intervals: rows are drawn inside their strata, each a unit of its own."""
    j = proxy(spark, sf, "judgments").where("outcome = 'decided'")
    said = (F.col("score") >= 0.5).cast("int")
    pairs = j.where("system = 'alpha'").select("subtask", "row_id", said.alias("x")).join(j.where("system = 'beta'").select("row_id", said.alias("y")), "row_id")
    p = pairs.withColumns({"all": F.lit(1), "n": F.lit(1), "same": (F.col("x") == F.col("y")).cast("int")})
    sums = resampling.replicate_sums(p, ["all"], resampling.unit_number(F.lit("draw"), F.col("subtask"), F.col("row_id")), ["n", "same", "x", "y"]).where("n > 0")
    share = sums.select("rep", *[(F.col(c) / F.col("n")).alias(c) for c in ("same", "x", "y")])
    chance = F.col("x") * F.col("y") + (1 - F.col("x")) * (1 - F.col("y"))
    v = share.select("rep", F.col("same").alias("agreement"), F.when(F.abs(1 - chance) > 1e-12, (F.col("same") - chance) / (1 - chance)).alias("kappa"))
    drawn = lambda c: F.sort_array(F.collect_list(F.when(F.col("rep") > 0, F.col(c))))  # noqa: E731  a value a replicate
    o = v.agg(*[f for c in ("agreement", "kappa") for f in (F.max(F.when(F.col("rep") == 0, F.col(c))).alias(c), drawn(c).alias(f"{c}s"))])
    end = lambda c, q: F.round(F.get(F.col(f"{c}s"), F.floor(q * (F.size(f"{c}s") - 1)).cast("int")), 6)
    return o.select(*[x for c in ("agreement", "kappa") for x in (F.round(c, 6).alias(c), end(c, 0.025).alias(f"{c}_low"), end(c, 0.975).alias(f"{c}_high"))], F.size("agreements").cast("long").alias("reps"))


@query(
    "sta_16_cluster_bootstrap",
    f"""with d as materialized (select * from {DRAWS}), x as (select j.system, j.subtask, d.rep, j.score, j.positive, d.mult from judgments j join d on d.subtask = j.subtask and d.grp = j.grp where j.score is not null),
    v as (select system, subtask, rep, score, coalesce(sum(mult) filter (positive), 0)::double as p, coalesce(sum(mult) filter (not positive), 0)::double as q from x group by 1, 2, 3, 4),
    c as (select *, sum(q) over (partition by system, subtask, rep order by score) - q / 2 as below from v),
    a as (select system, subtask, rep, sum(p * below) / nullif(sum(p) * sum(q), 0) as auroc, (sum(p) filter (score >= 0.5) / nullif(sum(p), 0) + sum(q) filter (score < 0.5) / nullif(sum(q), 0)) / 2 as ba from c group by 1, 2, 3),
    f as (select system, subtask, rep, greatest(auroc, 1 - auroc) as auroc, greatest(ba, 1 - ba) as ba from a)
    select a.system, a.subtask, round(a.point, 6) as auroc, round(a.ci_low, 6) as auroc_low, round(a.ci_high, 6) as auroc_high, round(b.point, 6) as ba, round(b.ci_low, 6) as ba_low, round(b.ci_high, 6) as ba_high, a.n_valid
    from ({resampling.summary_sql('select * from f', 'system, subtask', 'auroc')}) a join ({resampling.summary_sql('select * from f', 'system, subtask', 'ba')}) b using (system, subtask)""",
)
def cluster_bootstrap(spark, sf):
    """Direction-free AUROC and balanced accuracy with 95 % intervals, whole groups drawn 2,000 times. A replicate without
    one class has no value."""
    j = proxy(spark, sf, "judgments").where("score is not null")
    free = lambda c: F.greatest(F.col(c), 1 - F.col(c)).alias(c)
    a = resampling.replicate_auroc(j, KEYS, "score", "positive", unit()).select(*KEYS, "rep", free("auroc"))
    p, hit = F.col("positive"), F.col("score") >= 0.5
    cells = j.groupBy(*KEYS, "grp").agg(F.count_if(p).alias("pos"), F.count_if(p & hit).alias("pos_credit"), F.count_if(~p).alias("neg"), F.count_if(~p & ~hit).alias("neg_credit"))
    b = resampling.replicate_sums(cells, KEYS, unit(), ["pos", "pos_credit", "neg", "neg_credit"])
    b = b.select(*KEYS, "rep", (resampling.balanced_accuracy() / 100).alias("ba")).select(*KEYS, "rep", free("ba"))
    ends = lambda d, c: resampling.summary(d, KEYS, c).select(*KEYS, F.round("point", 6).alias(c), F.round("ci_low", 6).alias(f"{c}_low"), F.round("ci_high", 6).alias(f"{c}_high"), "n_valid")
    return ends(a, "auroc").join(ends(b, "ba").drop("n_valid"), KEYS)


#: Every system, subtask and replicate of rows drawn inside their subtask and class.
ROW_REPLICATES = f"""select system, subtask, rep, 50 * ((sum(mult * correct::int) filter (positive))::double / nullif(sum(mult) filter (positive), 0) + (sum(mult * correct::int) filter (not positive))::double / nullif(sum(mult) filter (not positive), 0)) as ba
  from judgments join {resampling.drawn_sql(f"select distinct row_id as id, {ROW.format("subtask || ':' || positive::varchar")} from judgments")} d on d.id = row_id group by 1, 2, 3"""


@query("xtr_56_row_replicates", f"select system, subtask, rep, round(ba, 6) as ba from ({ROW_REPLICATES})")
def row_replicates(spark, sf):
    """Rows drawn inside each class, and the balanced accuracy of every draw."""
    return rounded(class_replicates(spark, sf), "system", "subtask", "rep")


def class_replicates(spark, sf):
    j = proxy(spark, sf, "judgments")
    p, c = F.col("positive"), F.col("correct")
    rows = j.withColumns({"pos": p.cast("int"), "pos_credit": (p & c).cast("int"), "neg": (~p).cast("int"), "neg_credit": (~p & c).cast("int")})
    unit_of_row = resampling.unit_number(F.lit("draw"), F.col("subtask"), p.cast("string"), F.col("row_id"))
    return resampling.replicate_sums(rows, KEYS, unit_of_row, ["pos", "pos_credit", "neg", "neg_credit"]).select(*KEYS, "rep", resampling.balanced_accuracy().alias("ba"))


@query(
    "sta_17_gap_of_deltas",
    f"""with r as materialized ({ROW_REPLICATES}),
    g as (select a.subtask, a.rep, (a.ba - b.ba) - (c.ba - e.ba) as gap from r a join r b on b.system = 'beta' and a.subtask = b.subtask and a.rep = b.rep join r c on c.system = 'gamma' and a.subtask = c.subtask and a.rep = c.rep join r e on e.system = 'delta' and a.subtask = e.subtask and a.rep = e.rep where a.system = 'alpha'),
    i as ({resampling.summary_sql('select * from g', 'subtask', 'gap')})
    select subtask, round(point, 6) as gap, round(ci_low, 6) as ci_low, round(ci_high, 6) as ci_high, case when ci_low >= -5 and ci_high <= 5 then 'PASS' when ci_low > 5 or ci_high < -5 then 'FAIL' else 'INCONCLUSIVE' end as verdict from i""",
)
def gap_of_deltas(spark, sf):
    """Whether two leads differ: the gap of two differences over shared draws, inside a margin, outside it or neither."""
    r = class_replicates(spark, sf).groupBy("subtask", "rep").pivot("system", ["alpha", "beta", "gamma", "delta"]).agg(F.max("ba"))
    g = r.select("subtask", "rep", ((F.col("alpha") - F.col("beta")) - (F.col("gamma") - F.col("delta"))).alias("gap"))
    low, high = F.col("ci_low"), F.col("ci_high")
    verdict = F.when((low >= -5) & (high <= 5), "PASS").when((low > 5) | (high < -5), "FAIL").otherwise("INCONCLUSIVE")
    return resampling.summary(g, ["subtask"], "gap").select("subtask", F.round("point", 6).alias("gap"), *[F.round(c, 6).alias(c) for c in ("ci_low", "ci_high")], verdict.alias("verdict"))


# --- labels and tables by version ---------------------------------------------------------------------------------------

OLD = "select doc_id as id, toxic, quality from labels where doc_id % 43 <> 0"
NEW = "select doc_id as id, case when doc_id % 37 = 0 then 1 - toxic else toxic end as toxic, quality from labels where doc_id % 47 <> 0"


def editions(spark, sf):
    d = F.col("doc_id")
    t = table(spark, sf, "labels")
    old = t.where(d % 43 != 0).select(d.alias("id"), F.col("toxic").alias("old_toxic"), F.lit(True).alias("in_old"))
    new = t.where(d % 47 != 0).select(d.alias("id"), F.when(d % 37 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("new_toxic"), F.lit(True).alias("in_new"))
    return old, new


@query("join_24_label_amendment", f"select coalesce(a.id, b.id) as id, case when a.id is null then 'added' when b.id is null then 'removed' when a.toxic <> b.toxic then 'changed' else 'same' end as change, a.toxic as old_toxic, b.toxic as new_toxic from ({OLD}) a full join ({NEW}) b on a.id = b.id where a.id is null or b.id is null or a.toxic <> b.toxic")
def label_amendment(spark, sf):
    """Two editions of a label table: rows added, removed and changed."""
    old, new = editions(spark, sf)
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("old_toxic") != F.col("new_toxic"), "changed").otherwise("same")
    return old.join(new, "id", "full").withColumn("change", change).where("change <> 'same'").select("id", "change", "old_toxic", "new_toxic")


@query("join_25_second_labels", f"select a.id, case when b.id is null then 'missing' when a.toxic = b.toxic then 'agree' else 'disagree' end as outcome from ({OLD}) a left join ({NEW}) b on a.id = b.id")
def second_labels(spark, sf):
    old, new = editions(spark, sf)
    outcome = F.when(F.col("in_new").isNull(), "missing").when(F.col("old_toxic") == F.col("new_toxic"), "agree").otherwise("disagree")
    return old.join(new, "id", "left").select("id", outcome.alias("outcome"))


@query("xtr_05_agreement_summary", f"with x as (select a.quality, a.toxic as first, case when b.id % 9 = 0 then null else b.toxic end as second from ({OLD}) a join ({NEW}) b on a.id = b.id), c as (select quality, count(*) as n, count(*) filter (second is null) as unsure, count(*) filter (first = 1 and second = 1) as yy, count(*) filter (first = 1 and second = 0) as yn, count(*) filter (first = 0 and second = 1) as ny, count(*) filter (first = 0 and second = 0) as nn from x group by 1), s as (select *, (yy + nn)::double / nullif(yy + yn + ny + nn, 0) as po, (yy + yn)::double / nullif(yy + yn + ny + nn, 0) as px, (yy + ny)::double / nullif(yy + yn + ny + nn, 0) as py from c) select quality, n, unsure, yy, yn, ny, nn, round(po, 6) as agreement, round(case when abs(1 - (px * py + (1 - px) * (1 - py))) > 1e-12 then (po - (px * py + (1 - px) * (1 - py))) / (1 - (px * py + (1 - px) * (1 - py))) end, 6) as kappa from s")
def agreement_summary(spark, sf):
    """Counts of two labels, unsure ones apart; no kappa where both labellers used one class alone."""
    old, new = editions(spark, sf)
    x = old.join(new, "id").join(table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality"), "id")
    x = x.select("quality", F.col("old_toxic").alias("a"), F.when(F.col("id") % 9 != 0, F.col("new_toxic")).alias("b"))
    cell = lambda a, b: F.count_if((F.col("a") == a) & (F.col("b") == b))
    c = x.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("b").isNull()).alias("unsure"), cell(1, 1).alias("yy"), cell(1, 0).alias("yn"), cell(0, 1).alias("ny"), cell(0, 0).alias("nn"))
    known = F.col("yy") + F.col("yn") + F.col("ny") + F.col("nn")
    po, px, py = (F.try_divide(F.col(a) + F.col(b), known) for a, b in (("yy", "nn"), ("yy", "yn"), ("yy", "ny")))
    pe = px * py + (1 - px) * (1 - py)
    return rounded(c.select("quality", "n", "unsure", "yy", "yn", "ny", "nn", po.alias("agreement"), F.when(F.abs(1 - pe) > 1e-12, (po - pe) / (1 - pe)).alias("kappa")), "quality")


VERSIONED = "select doc_id as id, v.version, sha256(case when v.version = 2 and doc_id % 10 = 0 then text || '!' else text end) as row_hash, case when doc_id % 10 < 7 then 'public' else 'private' end as origin from documents cross join (select 1 as version union all select 2) v where text is not null and not (v.version = 1 and doc_id % 25 = 0)"


def versioned(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text").withColumn("version", F.explode(F.array(F.lit(1), F.lit(2))))
    d = d.where(~((F.col("version") == 1) & (F.col("id") % 25 == 0)))
    text = F.when((F.col("version") == 2) & (F.col("id") % 10 == 0), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return d.select("id", "version", F.sha2(text, 256).alias("row_hash"), F.when(F.col("id") % 10 < 7, "public").otherwise("private").alias("origin"))


@query("src_22_versions_of_a_table", f"select version, count(*) as n, count(distinct row_hash) as n_texts, min(id) as first_id from ({VERSIONED}) group by 1")
def versions_of_a_table(spark, sf):
    """All versions of a table as one table with a version column."""
    return versioned(spark, sf).groupBy("version").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_hash").alias("n_texts"), F.min("id").alias("first_id"))


@query("join_22_origin_of_rows", f"select l.id, coalesce(v.origin, 'not in history') as status from (select id, row_hash from ({VERSIONED}) where version = 2 union all select -1, 'x') l left join (select distinct id, row_hash, origin from ({VERSIONED}) where version = 1) v on v.id = l.id and v.row_hash = l.row_hash")
def origin_of_rows(spark, sf):
    """Where a logged row came from: the version of the history that has its id with its very hash."""
    v = versioned(spark, sf)
    logged = v.where("version = 2").select("id", "row_hash").union(spark.createDataFrame([(-1, "x")], "id long, row_hash string"))
    history = v.where("version = 1").select("id", "row_hash", "origin").dropDuplicates(["id", "row_hash"])
    return logged.join(history, ["id", "row_hash"], "left").select("id", F.coalesce("origin", F.lit("not in history")).alias("status"))


@query("xtr_46_origin_report", f"with s as (select l.id, coalesce(v.origin, 'not in history') as status from (select id, row_hash from ({VERSIONED}) where version = 2) l left join (select distinct id, row_hash, origin from ({VERSIONED}) where version = 1) v on v.id = l.id and v.row_hash = l.row_hash) select status, count(*) as n from s group by 1")
def origin_report(spark, sf):
    v = versioned(spark, sf)
    j = v.where("version = 2").select("id", "row_hash").join(v.where("version = 1").select("id", "row_hash", "origin").distinct(), ["id", "row_hash"], "left")
    return j.groupBy(F.coalesce("origin", F.lit("not in history")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("join_23_rehash", f"select a.id, a.row_hash = b.row_hash as unchanged from (select * from ({VERSIONED}) where version = 1) a join (select * from ({VERSIONED}) where version = 2) b on a.id = b.id")
def rehash(spark, sf):
    """Whether a ledger may carry a new version's hash: only where the row itself is the same."""
    v = versioned(spark, sf)
    b = v.where("version = 2").select("id", F.col("row_hash").alias("new_hash"))
    return v.where("version = 1").join(b, "id").select("id", (F.col("row_hash") == F.col("new_hash")).alias("unchanged"))


@query("src_20_frozen_rows", "select split, count(*) as n, bit_xor(('0x' || substr(sha256(id || ':' || coalesce(expected, '')), 1, 15))::bigint) as list_key from records where expected is not null group by 1")
def frozen_rows(spark, sf):
    """A frozen row list, keyed by an order-free hash of what it holds."""
    r = proxy(spark, sf, "records").where("expected is not null")
    h = F.conv(F.substring(F.sha2(F.concat(F.col("id").cast("string"), F.lit(":"), "expected"), 256), 1, 15), 16, 10).cast("long")
    return r.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("list_key"))


@query("src_19_index_lookup", "select l.row_id, l.system, r.grp as found_group, r.split as found_split, case when r.id is not null then 'index' else 'id itself' end as basis from latest l left join (select * from records where id % 6 <> 0) r on r.id = l.row_id")
def index_lookup(spark, sf):
    """Group and split of ledger rows from a dataset's index; a row that the index lacks is its own group."""
    index = proxy(spark, sf, "records").where("id % 6 <> 0").select(F.col("id").alias("row_id"), F.col("grp").alias("found_group"), F.col("split").alias("found_split"), F.lit("index").alias("basis"))
    return proxy(spark, sf, "latest").select("row_id", "system").join(index, "row_id", "left").select("row_id", "system", "found_group", "found_split", F.coalesce("basis", F.lit("id itself")).alias("basis"))


@query("src_19_indexed_lookup", "select id, grp, split from records where id in (select row_id from latest where row_id % 9 = 0)")
def indexed_lookup(spark, sf):
    """Group and split of some ids, out of a table that is sorted by id with a Bloom filter in every row group."""
    folder = shared_folder(spark, "indexed")
    write_indexed(proxy(spark, sf, "records").select("id", "grp", "split"), folder, "id")
    return lookup(spark, folder, proxy(spark, sf, "latest").where("row_id % 9 = 0").select(F.col("row_id").alias("id")), "id")


@query("src_18_ledgers_with_sidecars", "select l.system, l.seq as ledger, s.config, count(*) as n from ledger l left join (select 'alpha' as system, 'api v1' as config union all select 'gamma', 'two cards') s on s.system = l.system group by 1, 2, 3")
def ledgers_with_sidecars(spark, sf):
    """Several ledgers as one table that knows which it came from, with the sidecar of each arm."""
    led = proxy(spark, sf, "ledger").select("system", "seq")
    parts = led.where("seq = 0").withColumn("ledger", F.lit(0)).unionByName(led.where("seq = 1").withColumn("ledger", F.lit(1)))
    sidecars = spark.createDataFrame([("alpha", "api v1"), ("gamma", "two cards")], "system string, config string")
    return parts.join(F.broadcast(sidecars), "system", "left").groupBy("system", "ledger", "config").agg(F.count(F.lit(1)).alias("n"))


@query("ded_15_latest_run", "select row_id, system, seq from (select *, row_number() over (partition by row_id, system order by seq desc) as rn from ledger where not (seq = 1 and row_id % 3 = 0)) where rn = 1")
def latest_run(spark, sf):
    """The last record of each check that isn't a rerun."""
    led = proxy(spark, sf, "ledger").select("row_id", "system", "seq").where("not (seq = 1 and row_id % 3 = 0)")
    return metrics.latest_per_key(led, ["row_id", "system"], F.desc("seq"))


@query("join_27_latest_decided", "select row_id, system, seq, ok from (select *, row_number() over (partition by row_id, system order by (ok and score is not null) desc, seq desc) as rn from ledger) where rn = 1")
def latest_decided(spark, sf):
    """The latest record that has a decision, else the latest."""
    led = proxy(spark, sf, "ledger").select("row_id", "system", "seq", "ok", (F.col("ok") & F.col("score").isNotNull()).alias("decided"))
    return metrics.latest_per_key(led, ["row_id", "system"], F.desc("decided"), F.desc("seq")).select("row_id", "system", "seq", "ok")


TARIFFS = "select unnest(['alpha', 'beta']) as model, 0.5::double as price, 1 as place union all select unnest(['beta', 'gamma']), 0.7::double, 2"


@query("join_16_tariff_match", f"with t as ({TARIFFS}), f as (select model, arg_min(price, place) as price from t group by model), n as (select system, count(*) as n from latest group by 1) select n.system, n.n, f.price from n left join f on f.model = n.system")
def tariff_match(spark, sf):
    """The first tariff whose list of models has the system; none is null."""
    entries = spark.createDataFrame([(1, ["alpha", "beta"], 0.5), (2, ["beta", "gamma"], 0.7)], "at int, models array<string>, price double")
    first = entries.select(F.explode("models").alias("system"), "at", "price").groupBy("system").agg(F.min_by("price", "at").alias("price"))
    n = proxy(spark, sf, "latest").groupBy("system").agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(first), "system", "left")
