"""Secondary views of a board: saturation, contamination, slices, costs, podiums, and the windows they are made of."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from plumbline.operators import metrics, resampling
from plumbline.plans.catalog import proxy, query
from plumbline.plans.scoring import BY_UNIT, CUMULATIVE, KEYS, rounded

BA = "50 * (avg(correct::int) filter (positive) + avg(correct::int) filter (not positive))"
BOARD = f"select system, subtask, round({BA}, 6) as ba from judgments group by 1, 2"
#: Tiers of a job, as a plain rule: within three points of the best is the first tier, within nine the second.
TIERS = f"select *, case when ba >= max(ba) over (partition by subtask) - 3 then 1 when ba >= max(ba) over (partition by subtask) - 9 then 2 else 3 end as tier from ({BOARD})"


def balanced(right: str = "correct", positive: str = "positive") -> Column:
    """Balanced accuracy times 100 of a group: null where a class is missing."""
    c = F.col(right).cast("int")
    return 50 * (F.avg(F.when(F.col(positive), c)) + F.avg(F.when(~F.col(positive), c)))


def board(j):
    return j.groupBy("system", "subtask").agg(F.round(balanced(), 6).alias("ba"))


def tiered(b):
    best = F.max("ba").over(Window.partitionBy("subtask"))  # a row a system
    return b.withColumn("tier", F.when(F.col("ba") >= best - 3, 1).when(F.col("ba") >= best - 9, 2).otherwise(3))


@query(
    "agg_09_secondary_block",
    """with d as (select * from judgments where outcome = 'decided'),
    r as (select system, subtask, source, positive, rank() over (partition by system, subtask, source order by score) + (count(*) over (partition by system, subtask, source, score) - 1) / 2.0 as rk from d),
    u as (select system, subtask, source, (sum(rk::double) filter (positive) - count(*) filter (positive) * (count(*) filter (positive) + 1) / 2.0) / nullif(count(*) filter (positive) * count(*) filter (not positive), 0) as auroc from r group by 1, 2, 3),
    c as (select system, subtask, source, avg((score - positive::int) * (score - positive::int)) as brier from d group by 1, 2, 3)
    select system, subtask, round(avg(auroc), 6) as auroc, count(*) as n_units, count(auroc) as n_scored, round(avg(brier) filter (auroc is not null), 6) as brier
    from u join c using (system, subtask, source) group by 1, 2""",
)
def secondary_block(spark, sf):
    """AUROC and Brier score of each unit (a source), then their means over the units that have both classes."""
    d = proxy(spark, sf, "judgments").where("outcome = 'decided'")
    unit = [*KEYS, "source"]
    off = F.col("score") - F.col("positive").cast("int")
    u = metrics.auroc(d, unit).join(d.groupBy(*unit).agg(F.avg(off * off).alias("brier")), unit)
    scored = F.when(F.col("auroc").isNotNull(), F.col("brier"))
    return u.groupBy(*KEYS).agg(F.round(F.avg("auroc"), 6).alias("auroc"), F.count(F.lit(1)).alias("n_units"), F.count("auroc").alias("n_scored"), F.round(F.avg(scored), 6).alias("brier"))


@query(
    "agg_33_system_costs",
    """with r as (select system, kind, row_id, sum(latency_s) as seconds, sum(tokens_in) as tin, sum(tokens_out) as tout from ledger group by 1, 2, 3)
    select system, count(*) as checks, case when kind = 'self' then 'allocated machine time' else 'measured usage' end as basis,
      round(case when kind = 'self' then sum(seconds) / 3600 * 1.8 else sum(tin * 0.5 + tout * 1.5) / 1000000 end, 8) as usd_total,
      round(1000 * case when kind = 'self' then sum(seconds) / 3600 * 1.8 else sum(tin * 0.5 + tout * 1.5) / 1000000 end / count(*), 8) as usd_per_1000
    from r group by system, kind""",
)
def system_costs(spark, sf):
    """Cost of a thousand checks: usage times tariff for a hosted system, time times the machine's rate for one's own."""
    r = proxy(spark, sf, "ledger").groupBy("system", "kind", "row_id").agg(F.sum("latency_s").alias("seconds"), F.sum("tokens_in").alias("tin"), F.sum("tokens_out").alias("tout"))
    usage = F.sum(F.col("tin") * 0.5 + F.col("tout") * 1.5) / 1000000
    usd = F.when(F.col("kind") == "self", F.sum("seconds") / 3600 * 1.8).otherwise(usage)
    out = r.groupBy("system", "kind").agg(F.count(F.lit(1)).alias("checks"), usd.alias("usd"))
    basis = F.when(F.col("kind") == "self", "allocated machine time").otherwise("measured usage")
    return out.select("system", "checks", basis.alias("basis"), F.round("usd", 8).alias("usd_total"), F.round(1000 * F.col("usd") / F.col("checks"), 8).alias("usd_per_1000"))


@query(
    "agg_34_pilot_score",
    f"""with p as (select system, source, positive, correct, subtask || ':' || (row_id // 2) as pair, count(*) over (partition by system, subtask || ':' || (row_id // 2)) as size from judgments),
    c as (select system, source, {BA} as ba from p group by 1, 2), k as (select system, pair, bool_and(correct) as whole from p where size = 2 group by 1, 2)
    select a.system, round(a.ba, 6) as all_rows, round((select avg(ba) from c where c.system = a.system), 6) as category_mean, round((select avg(whole::int) from k where k.system = a.system), 6) as pair_accuracy
    from (select system, {BA} as ba from p group by 1) a""",
)
def pilot_score(spark, sf):
    """All rows, the mean over categories (sources), and the share of whole pairs with both members right."""
    j = proxy(spark, sf, "judgments").withColumn("pair", F.concat_ws(":", "subtask", F.floor(F.col("row_id") / 2).cast("string")))
    by_cat = j.groupBy("system", "source").agg(balanced().alias("ba")).groupBy("system").agg(F.avg("ba").alias("category_mean"))
    pairs = j.groupBy("system", "pair").agg(F.count(F.lit(1)).alias("size"), F.bool_and("correct").alias("whole")).where("size = 2")
    pairs = pairs.groupBy("system").agg(F.avg(F.col("whole").cast("int")).alias("pair_accuracy"))
    return rounded(j.groupBy("system").agg(balanced().alias("all_rows")).join(by_cat, "system", "left").join(pairs, "system", "left"), "system")


ROWS = """select subtask, row_id, any_value(source) as source, any_value(split) as split, bool_or(positive) as positive, count(*) as seen, count(*) filter (correct) as k_right,
  count(*) filter (not correct) as k_wrong from judgments group by 1, 2"""


def row_counts(spark, sf):
    """One row a judged row: how many systems saw it and got it right."""
    return proxy(spark, sf, "judgments").groupBy("subtask", "row_id").agg(
        F.any_value("source").alias("source"), F.any_value("split").alias("split"), F.bool_or("positive").alias("positive"), F.count(F.lit(1)).alias("seen"),
        F.count_if("correct").alias("k_right"), F.count_if(~F.col("correct")).alias("k_wrong"),
    )


@query(
    "agg_35_unanimous_miss",
    f"""select subtask, source, count(*) filter (positive) as harmful, count(*) filter (not positive) as benign, count(*) filter (positive and seen = 4 and k_wrong >= 3) as harmful_missed,
    count(*) filter (not positive and seen = 4 and k_wrong >= 3) as benign_missed from ({ROWS}) group by 1, 2""",
)
def unanimous_miss(spark, sf):
    """Rows that at least three of the four systems got wrong, by source and class; a failure counts as wrong."""
    missed = (F.col("seen") == 4) & (F.col("k_wrong") >= 3)
    return row_counts(spark, sf).groupBy("subtask", "source").agg(
        F.count_if("positive").alias("harmful"), F.count_if(~F.col("positive")).alias("benign"), F.count_if(F.col("positive") & missed).alias("harmful_missed"), F.count_if(~F.col("positive") & missed).alias("benign_missed")
    )


@query(
    "agg_36_saturation",
    f"""with t as ({TIERS}), x as (select j.*, t.tier from judgments j join t using (system, subtask)),
    r as (select subtask, row_id, bool_or(positive) as positive, count(*) as n, count(*) filter (correct) as k, bool_and(correct) filter (tier = 1) as top_right, bool_or(correct) filter (tier = 1) as top_any from x group by 1, 2)
    select subtask, count(*) as judgments, round(avg((k = n)::int), 6) as share_all_right, round(avg((k = 0)::int), 6) as share_none_right, round(avg(top_right::int), 6) as share_top_right,
      round(avg((not top_any)::int), 6) as share_top_wrong, round(avg((top_any and not top_right)::int), 6) as share_top_disagree, round(avg((k > 0 and k < n)::int), 6) as share_informative,
      round(50 * (avg(top_any::int) filter (positive) + avg(top_any::int) filter (not positive)), 6) as oracle_score, round(avg(k::double / n), 6) as mean_share_right,
      count(*) filter (k = 0) as bin_none, count(*) filter (k between 1 and n - 1) as bin_some, count(*) filter (k = n) as bin_all from r group by 1""",
)
def saturation(spark, sf):
    """How many rows still tell systems apart: all right, none right, first tier split, and the first tier's ceiling."""
    j = proxy(spark, sf, "judgments")
    x = j.join(tiered(board(j)).select("system", "subtask", "tier"), ["system", "subtask"])
    top = F.col("tier") == 1
    r = x.groupBy("subtask", "row_id").agg(
        F.bool_or("positive").alias("positive"), F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("k"), F.bool_and(F.when(top, F.col("correct"))).alias("top_right"), F.bool_or(F.when(top, F.col("correct"))).alias("top_any")
    )
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    k, n = F.col("k"), F.col("n")
    return r.groupBy("subtask").agg(
        F.count(F.lit(1)).alias("judgments"), share(k == n).alias("share_all_right"), share(k == 0).alias("share_none_right"), share(F.col("top_right")).alias("share_top_right"), share(~F.col("top_any")).alias("share_top_wrong"),
        share(F.col("top_any") & ~F.col("top_right")).alias("share_top_disagree"), share((k > 0) & (k < n)).alias("share_informative"), F.round(balanced("top_any"), 6).alias("oracle_score"),
        F.round(F.avg(k / n), 6).alias("mean_share_right"), F.count_if(k == 0).alias("bin_none"), F.count_if((k > 0) & (k < n)).alias("bin_some"), F.count_if(k == n).alias("bin_all"),
    )


R = "case when stddev_pop(c) > 0 and stddev_pop(ba) > 0 then round(covar_pop(c, ba) / (stddev_pop(c) * stddev_pop(ba)), 9) end"


@query(
    "agg_37_discrimination",
    f"""with x as (select j.subtask, j.row_id, j.correct::int as c, b.ba from judgments j join ({BOARD}) b using (system, subtask)), r as (select subtask, row_id, {R} as r from x group by 1, 2)
    select subtask, round(median(r), 6) as median_r, round((count(*) filter (r >= 0.3))::double / count(*), 6) as share_strong, round((count(*) filter (r < 0))::double / count(*), 6) as share_negative from r group by 1""",
)
def discrimination(spark, sf):
    """Correlation of a row's being right with the systems' scores, population form; rows where all agree have none."""
    j = proxy(spark, sf, "judgments")
    x = j.join(board(j), ["system", "subtask"]).select("subtask", "row_id", F.col("correct").cast("double").alias("c"), "ba")
    sd = F.stddev_pop("c") * F.stddev_pop("ba")
    r = x.groupBy("subtask", "row_id").agg(F.when(sd > 0, F.round(F.covar_pop("c", "ba") / sd, 9)).alias("r"))
    n = F.count(F.lit(1))
    return r.groupBy("subtask").agg(F.round(F.percentile("r", F.lit(0.5)), 6).alias("median_r"), F.round(F.count_if(F.col("r") >= 0.3) / n, 6).alias("share_strong"), F.round(F.count_if(F.col("r") < 0) / n, 6).alias("share_negative"))


#: Resamples of the contamination signal, rows of each class that a cell and its complement need, and the flag's excess.
RESAMPLES, LEAST_ROWS, LEAST_EXCESS = 1000, 5, 5


@query(
    "agg_38_contamination_signal",
    f"""with d as materialized (select * from {resampling.drawn_sql("select distinct subtask, row_id, ('0x' || substr(md5('draw:' || subtask || ':' || row_id), 1, 15))::bigint as h from judgments", RESAMPLES)}),
    c as (select j.subtask, j.source, j.system, d.rep, sum(mult) filter (positive) as p, sum(mult) filter (not positive) as q, sum(mult) filter (positive and correct) as cp, sum(mult) filter (not positive and correct) as cq from judgments j join d on d.row_id = j.row_id and d.subtask = j.subtask group by 1, 2, 3, 4),
    z as (select subtask, source, system, rep, coalesce(p, 0) as p, coalesce(q, 0) as q, coalesce(cp, 0) as cp, coalesce(cq, 0) as cq from c),
    t as (select *, sum(p) over w - p as op, sum(q) over w - q as oq, sum(cp) over w - cp as ocp, sum(cq) over w - cq as ocq from z window w as (partition by subtask, system, rep)),
    k as (select subtask, source, p + q as n from t where rep = 0 and p >= {LEAST_ROWS} and q >= {LEAST_ROWS} and op >= {LEAST_ROWS} and oq >= {LEAST_ROWS} group by 1, 2, 3),
    a as (select t.subtask, t.source, system, rep, k.n, 50 * (cp::double / nullif(p, 0) + cq::double / nullif(q, 0)) - 50 * (ocp::double / nullif(op, 0) + ocq::double / nullif(oq, 0)) as adv from t join k on t.subtask = k.subtask and t.source is not distinct from k.source),
    e as (select *, adv - median(adv) over (partition by subtask, source, rep) as excess from a),
    s as ({resampling.summary_sql('select * from e', 'subtask, source, system', 'excess')})
    select s.subtask, s.source, s.system, e.n::bigint as n, round(e.adv, 6) as advantage, round(s.point, 6) as excess, round(s.ci_low, 6) as ci_low, round(s.ci_high, 6) as ci_high, coalesce(s.ci_low > 0 and s.point >= {LEAST_EXCESS}, false) as flag
    from s join e on e.rep = 0 and s.subtask = e.subtask and s.source is not distinct from e.source and s.system = e.system""",
)
def contamination_signal(spark, sf):
    """How much better a system does on a source than elsewhere, beyond the median of all systems there, with its interval
    over resampled rows; flagged where the interval is above 0 and the excess is 5 points or more.

    One pass gives every cell's replicate sums; what is outside a source is the subtask's sums less the source's.
    """
    p, c = F.col("positive"), F.col("correct")
    j = proxy(spark, sf, "judgments").withColumns({"p": p.cast("int"), "q": (~p).cast("int"), "cp": (p & c).cast("int"), "cq": (~p & c).cast("int")})
    values, cell = ["p", "q", "cp", "cq"], ["subtask", "source"]
    z = resampling.replicate_sums(j, [*cell, "system"], resampling.unit_number(F.lit("draw"), F.col("subtask"), F.col("row_id")), values, RESAMPLES)
    w = Window.partitionBy("subtask", "system", "rep")  # a row a source
    t = z.select("*", *[(F.sum(x).over(w) - F.col(x)).alias(f"o{x}") for x in values])
    ba = lambda o: 50 * (F.try_divide(F.col(f"{o}cp"), F.col(f"{o}p")) + F.try_divide(F.col(f"{o}cq"), F.col(f"{o}q")))
    enough = F.least("p", "q", "op", "oq") >= LEAST_ROWS
    of_cell = Window.partitionBy(*cell, "system")  # a row a replicate
    a = t.withColumns({"adv": ba("") - ba("o"), "stays": F.max(F.when(F.col("rep") == 0, enough)).over(of_cell)}).where("stays")
    e = a.withColumn("excess", F.col("adv") - F.percentile("adv", F.lit(0.5)).over(Window.partitionBy(*cell, "rep")))  # a row a system
    point = F.when(F.col("rep") == 0, F.col("adv"))
    facts = e.groupBy(*cell, "system").agg(F.max(F.when(F.col("rep") == 0, F.col("p") + F.col("q"))).cast("long").alias("n"), F.max(point).alias("adv"))
    s = resampling.summary(e, [*cell, "system"], "excess").withColumnsRenamed({"subtask": "_t", "source": "_s", "system": "_y"})
    met = facts.join(s, (F.col("subtask") == F.col("_t")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("system") == F.col("_y")))
    flag = F.coalesce((F.col("ci_low") > 0) & (F.col("point") >= LEAST_EXCESS), F.lit(False))
    return met.select(*cell, "system", "n", F.round("adv", 6).alias("advantage"), F.round("point", 6).alias("excess"), F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"), flag.alias("flag"))


#: A row's tags for the content views: in the five categories (unknown for some), owned by a vendor (unknown for some).
TAGS = "case when row_id % 11 = 0 then null else row_id % 3 <> 0 end as in_five, case when row_id % 13 = 0 then null else source in ('src0', 'src1') end as vendor"


def tagged(spark, sf):
    r = F.col("row_id")
    return proxy(spark, sf, "judgments").withColumns({"in_five": F.when(r % 11 != 0, r % 3 != 0), "vendor": F.when(r % 13 != 0, F.col("source").isin("src0", "src1"))})


@query(
    "agg_39_content_views",
    f"""with t as (select *, {TAGS} from judgments),
    v as (select *, 'all_rows' as view, true as known, true as stays from t union all
      select *, 'five', in_five is not null or not positive, coalesce(in_five, false) or not positive from t union all
      select *, 'without_vendor', vendor is not null, coalesce(not vendor, false) from t)
    select system, subtask, view, round({BA.replace('filter (positive)', 'filter (positive and known and stays)').replace('filter (not positive)', 'filter (not positive and known and stays)')}, 6) as ba,
      count(*) filter (known and stays) as n, count(*) filter (not known) as untagged from v group by 1, 2, 3""",
)
def content_views(spark, sf):
    """Scores over subsets of rows; a row without the tag that a view needs is left out of it and counted."""
    p, five, vendor = F.col("positive"), F.col("in_five"), F.col("vendor")
    views = [("all_rows", F.lit(True), F.lit(True)), ("five", five.isNotNull() | ~p, F.coalesce(five, F.lit(False)) | ~p), ("without_vendor", vendor.isNotNull(), F.coalesce(~vendor, F.lit(False)))]
    v = tagged(spark, sf).withColumn("v", F.explode(F.array(*[F.struct(F.lit(n).alias("view"), k.alias("known"), (k & s).alias("stays")) for n, k, s in views]))).select("system", "subtask", "correct", "positive", "v.*")
    stays, right = F.col("stays"), F.col("correct").cast("int")
    ba = 50 * (F.avg(F.when(stays & F.col("positive"), right)) + F.avg(F.when(stays & ~F.col("positive"), right)))
    return v.groupBy("system", "subtask", "view").agg(F.round(ba, 6).alias("ba"), F.count_if("stays").alias("n"), F.count_if(~F.col("known")).alias("untagged"))


CONTESTED = ("src0", "src1", "src2", "src3")


@query(
    "agg_40_contested_slices",
    "with v as (select j.*, x.view, x.gone from judgments j cross join (select 'all_rows' as view, [''] as gone union all "
    + " union all ".join(f"select 'without_{s}', ['{s}']" for s in CONTESTED)
    + f" union all select 'without_all', {list(CONTESTED)}) x where not list_contains(x.gone, j.source)) select system, subtask, view, round({BA}, 6) as ba, count(*) as n from v group by 1, 2, 3",
)
def contested_slices(spark, sf):
    """Scores with each contested source left out, and with all of them."""
    views = [("all_rows", ()), *[(f"without_{s}", (s,)) for s in CONTESTED], ("without_all", CONTESTED)]
    kept = F.array_compact(F.array(*[F.when(~F.col("source").isin(*gone) if gone else F.lit(True), F.lit(name)) for name, gone in views]))
    v = proxy(spark, sf, "judgments").withColumn("view", F.explode(kept))
    return v.groupBy("system", "subtask", "view").agg(F.round(balanced(), 6).alias("ba"), F.count(F.lit(1)).alias("n"))


@query(
    "agg_41_taxonomy_views",
    f"""with t as (select *, {TAGS} from judgments), v as (select *, 'in_taxonomy' as view from t where not (positive and coalesce(not in_five, false)) union all select *, 'without_tagged' from t where not (positive and row_id % 5 = 0)
      union all select *, 'both' from t where not (positive and (coalesce(not in_five, false) or row_id % 5 = 0)))
    select system, view, round({BA}, 6) as ba, count(*) filter (positive) as positives, count(*) filter (not positive) as negatives from v group by 1, 2""",
)
def taxonomy_views(spark, sf):
    """Positives outside the taxonomy left out, positives with a tag left out, both; every benign row stays."""
    out = F.col("positive") & F.coalesce(~F.col("in_five"), F.lit(False))
    tag = F.col("positive") & (F.col("row_id") % 5 == 0)
    kept = F.array_compact(F.array(F.when(~out, "in_taxonomy"), F.when(~tag, "without_tagged"), F.when(~(out | tag), "both")))
    v = tagged(spark, sf).withColumn("view", F.explode(kept))
    return v.groupBy("system", "view").agg(F.round(balanced(), 6).alias("ba"), F.count_if("positive").alias("positives"), F.count_if(~F.col("positive")).alias("negatives"))


@query(
    "agg_42_practitioner",
    f"""with u as (select system, subtask, round({BA}, 6) as ba, round(avg((not correct)::int) filter (not positive), 6) as fbr, round({BA.replace('(positive)', "(positive and split <> 'private')").replace('(not positive)', "(not positive and split <> 'private')")}, 6) as public_ba,
      round({BA.replace('(positive)', "(positive and split = 'private')").replace('(not positive)', "(not positive and split = 'private')")}, 6) as held_ba from judgments group by 1, 2)
    select subtask, system, ba, fbr, public_ba, held_ba, round(held_ba - public_ba, 6) as gap, row_number() over (partition by subtask order by ba desc nulls last, system) = 1 as routed from u""",
)
def practitioner(spark, sf):
    """False blocks, public rows against held-back ones, and which system a router would take for each job."""
    held, c, p = F.col("split") == "private", F.col("correct").cast("int"), F.col("positive")
    part = lambda k: 50 * (F.avg(F.when(p & k, c)) + F.avg(F.when(~p & k, c)))
    u = proxy(spark, sf, "judgments").groupBy("subtask", "system").agg(F.round(balanced(), 6).alias("ba"), F.round(F.avg(F.when(~p, 1 - c)), 6).alias("fbr"), F.round(part(~held), 6).alias("public_ba"), F.round(part(held), 6).alias("held_ba"))
    first = F.row_number().over(Window.partitionBy("subtask").orderBy(F.desc_nulls_last("ba"), "system")) == 1
    return u.withColumn("gap", F.round(F.col("held_ba") - F.col("public_ba"), 6)).withColumn("routed", first)


@query(
    "agg_48_build_baselines",
    """with d as (select subtask, expected = 'yes' as positive, length(text)::double as s, 'length' as name from records where expected is not null and text is not null union all
      select subtask, expected = 'yes', (length(text) - length(replace(text, ' ', '')))::double, 'spaces' from records where expected is not null and text is not null),
    r as (select *, rank() over (partition by name, subtask order by s) + (count(*) over (partition by name, subtask, s) - 1) / 2.0 as rk from d)
    select name, subtask, round((sum(rk::double) filter (positive) - count(*) filter (positive) * (count(*) filter (positive) + 1) / 2.0) / nullif(count(*) filter (positive) * count(*) filter (not positive), 0), 6) as auroc from r group by 1, 2""",
)
def build_baselines(spark, sf):
    """AUROC of scores that read nothing but the text's form."""
    r = proxy(spark, sf, "records").where("expected is not null and text is not null")
    n = F.length("text").cast("double")
    scores = F.array(F.struct(F.lit("length").alias("name"), n.alias("score")), F.struct(F.lit("spaces").alias("name"), F.regexp_count("text", F.lit(" ")).cast("double").alias("score")))
    d = r.select("subtask", (F.col("expected") == "yes").alias("positive"), F.explode(scores).alias("x")).select("subtask", "positive", "x.*")
    return rounded(metrics.auroc(d, ["name", "subtask"]), "name", "subtask")


@query(
    "agg_49_board_facts",
    f"""with u as (select system, subtask, {BA.replace('(positive)', "(positive and split <> 'private')").replace('(not positive)', "(not positive and split <> 'private')")} - {BA.replace('(positive)', "(positive and split = 'private')").replace('(not positive)', "(not positive and split = 'private')")} as gap from judgments group by 1, 2)
    select (select count(distinct system) from judgments) as n_systems, (select count(distinct row_id) from judgments) as n_rows, round(max(abs(gap)), 6) as largest_gap, (select count(*) from ({TIERS}) where tier = 1) as first_tier_places from u""",
)
def board_facts(spark, sf):
    """The numbers that a board's page opens with."""
    j = proxy(spark, sf, "judgments")
    held, c, p = F.col("split") == "private", F.col("correct").cast("int"), F.col("positive")
    part = lambda k: 50 * (F.avg(F.when(p & k, c)) + F.avg(F.when(~p & k, c)))
    gap = j.groupBy("system", "subtask").agg((part(~held) - part(held)).alias("gap")).agg(F.round(F.max(F.abs("gap")), 6).alias("largest_gap"))
    counts = j.agg(F.count_distinct("system").alias("n_systems"), F.count_distinct("row_id").alias("n_rows"))
    return counts.crossJoin(gap).crossJoin(tiered(board(j)).agg(F.count_if(F.col("tier") == 1).alias("first_tier_places")))  # three rows of one


@query("agg_50_refusal_totals", "select system, kind, count(*) filter (error like 'refused%') as refusals, round((count(*) filter (error like 'refused%'))::double / count(*), 6) as share from ledger group by 1, 2")
def refusal_totals(spark, sf):
    refused = F.startswith("error", F.lit("refused"))
    return proxy(spark, sf, "ledger").groupBy("system", "kind").agg(F.count_if(refused).alias("refusals"), F.round(F.count_if(refused) / F.count(F.lit(1)), 6).alias("share"))


ATTEMPTS = """select row_id, system, case when row_id % 17 = 0 then null when row_id % 19 = 0 then 'other' else 'frozen' end as sha, case when row_id % 23 = 0 then null else epoch(timestamp '2026-01-01 00:00:00')::bigint + row_id * 7 + seq end as t from ledger"""


@query(
    "agg_51_freeze_records",
    f"""with r as (select row_id, system, min(sha) as sha, min(t) as first_at, count(*) filter (t is null) as untimed from ({ATTEMPTS}) group by 1, 2)
    select system, count(*) as records, count(*) filter (sha is null) as without_identity, count(*) filter (sha <> 'frozen') as with_other, count(*) filter (untimed > 0) as without_times, min(first_at) as earliest,
    coalesce(min(first_at) > 1767225600, false) and count(*) filter (sha is null or sha <> 'frozen' or untimed > 0) = 0 as passed from r group by 1""",
)
def freeze_records(spark, sf):
    """Whether test records carry the frozen identity and began after it: what is missing, other or untimed."""
    r = F.col("row_id")
    a = proxy(spark, sf, "ledger").select(
        "row_id", "system", F.when(r % 17 == 0, None).when(r % 19 == 0, "other").otherwise("frozen").alias("sha"), F.when(r % 23 != 0, F.unix_timestamp(F.lit("2026-01-01 00:00:00").cast("timestamp_ntz").cast("timestamp")) + r * 7 + F.col("seq")).alias("at")
    )
    g = a.groupBy("row_id", "system").agg(F.min("sha").alias("sha"), F.min("at").alias("first_at"), F.count_if(F.col("at").isNull()).alias("untimed"))
    missing, other, late = F.col("sha").isNull(), F.col("sha") != "frozen", F.col("untimed") > 0
    bad = F.count_if(missing | F.coalesce(other, F.lit(False)) | late)
    return g.groupBy("system").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(missing).alias("without_identity"), F.count_if(other).alias("with_other"), F.count_if(late).alias("without_times"), F.min("first_at").alias("earliest"),
        (F.coalesce(F.min("first_at") > 1767225600, F.lit(False)) & (bad == 0)).alias("passed"),
    )


@query(
    "agg_52_sanity_result",
    f"""with c as ({BY_UNIT}), u as (select system, subtask, 100 * tp::double / nullif(n_pos, 0) as catch, 100 * fp::double / nullif(n_neg, 0) as fbr from c)
    select system, subtask, coalesce(catch >= 60 - 1e-12, false) and coalesce(fbr <= 40 + 1e-12, false) as passed, array_to_string(list_filter([case when not coalesce(catch >= 60 - 1e-12, false) then 'catch' end, case when not coalesce(fbr <= 40 + 1e-12, false) then 'false blocks' end], lambda x: x is not null), ',') as failed from u""",
)
def sanity_result(spark, sf):
    """Pass or fail against a criterion, with the conditions that failed; a missing value fails."""
    u = metrics.unit_metrics(metrics.confusion(proxy(spark, sf, "judgments"), KEYS))
    ok = {"catch": F.coalesce(F.col("catch_rate") >= 60 - 1e-12, F.lit(False)), "false blocks": F.coalesce(F.col("false_block_rate") <= 40 + 1e-12, F.lit(False))}
    failed = F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in ok.items()]))
    return u.select(*KEYS, (F.size(failed) == 0).alias("passed"), F.array_join(failed, ",").alias("failed"))


@query("win_01_latest_per_key", "select system, row_id, seq from (select *, row_number() over (partition by system, row_id order by ok desc, seq desc) as rn from ledger) where rn = 1")
def latest_window(spark, sf):
    return metrics.latest_per_key(proxy(spark, sf, "ledger").select("system", "row_id", "seq", "ok"), ["system", "row_id"], F.desc("ok"), F.desc("seq")).select("system", "row_id", "seq")


@query("win_03_average_rank", f"with b as ({BOARD}) select system, subtask, ba, rank() over (partition by subtask order by ba desc) + (count(*) over (partition by subtask, ba) - 1) / 2.0::double as rank from b where ba is not null")
def average_rank(spark, sf):
    b = board(proxy(spark, sf, "judgments")).where("ba is not null")
    ties = F.count(F.lit(1)).over(Window.partitionBy("subtask", "ba"))
    return b.withColumn("rank", F.rank().over(Window.partitionBy("subtask").orderBy(F.desc("ba"))) + (ties - 1) / 2.0)


@query("win_04_midpoints", "select system, subtask, round((score + lead(score) over (partition by system, subtask order by score)) / 2, 6) as midpoint, score from (select distinct system, subtask, score from judgments where score is not null)")
def midpoints(spark, sf):
    """Cuts between adjacent distinct scores: the candidates for a threshold."""
    d = proxy(spark, sf, "judgments").where("score is not null").select("system", "subtask", "score").distinct()
    return d.withColumn("midpoint", F.round((F.col("score") + F.lead("score").over(Window.partitionBy("system", "subtask").orderBy("score"))) / 2, 6))


@query("win_05_cumulative_counts", f"select system, subtask, score, tp::bigint as tp, fp::bigint as fp from ({CUMULATIVE})")
def cumulative_counts(spark, sf):
    return metrics.cumulative(proxy(spark, sf, "judgments").where("score is not null"), KEYS).select(*KEYS, "score", "tp", "fp")


@query("win_06_running_maximum", "select user_id, event_id, max(value) over (partition by user_id order by ts, event_id rows unbounded preceding) as best from events")
def running_maximum(spark, sf):
    from plumbline.plans.catalog import table

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "events").select("user_id", "event_id", F.max("value").over(w).alias("best"))


@query("win_07_cumulative_weights", "with v as (select system, tokens_out, sum(tokens_in) as w from judgments group by 1, 2) select system, tokens_out, (sum(w) over (partition by system order by tokens_out))::bigint as upto from v")
def cumulative_weights(spark, sf):
    """Weights up to each distinct value: aggregated first, so that the window sees values, not rows."""
    v = proxy(spark, sf, "judgments").groupBy("system", "tokens_out").agg(F.sum("tokens_in").alias("w"))
    return v.select("system", "tokens_out", F.sum("w").over(Window.partitionBy("system").orderBy("tokens_out").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))


@query("win_08_rank_fraction", "select id, subtask, round((row_number() over (partition by subtask order by md5('part:' || id), id) - 1)::double / count(*) over (partition by subtask), 6) as fraction from records")
def rank_fraction(spark, sf):
    """Where a row stands in the hashed order of its stratum, as a share."""
    r = proxy(spark, sf, "records").select("id", "subtask")
    place = F.row_number().over(Window.partitionBy("subtask").orderBy(F.md5(F.concat(F.lit("part:"), F.col("id").cast("string"))), "id"))
    n = r.groupBy("subtask").agg(F.count(F.lit(1)).alias("n"))
    return r.withColumn("place", place).join(F.broadcast(n), "subtask").select("id", "subtask", F.round((F.col("place") - 1) / F.col("n"), 6).alias("fraction"))


@query(
    "win_10_tier_runs",
    f"""with t as ({TIERS}), o as (select *, row_number() over (partition by subtask order by ba desc nulls last, system) as pos from t), e as (select *, (tier <> lag(tier, 1, tier) over (partition by subtask order by pos))::int as new from o),
    g as (select *, sum(new) over (partition by subtask order by pos) as run from e) select subtask, tier, min(pos) as first_place, max(pos) as last_place, string_agg(system, ',' order by pos) as systems from g group by subtask, run, tier""",
)
def tier_runs(spark, sf):
    """Runs of equal tiers down a board: gaps and islands."""
    w = Window.partitionBy("subtask")
    o = tiered(board(proxy(spark, sf, "judgments"))).withColumn("pos", F.row_number().over(w.orderBy(F.desc_nulls_last("ba"), "system")).cast("long"))
    e = o.withColumn("new", (F.col("tier") != F.lag("tier", 1).over(w.orderBy("pos"))).cast("int"))
    g = e.withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    out = g.groupBy("subtask", "run", "tier").agg(F.min("pos").alias("first_place"), F.max("pos").alias("last_place"), F.array_sort(F.collect_list(F.struct("pos", "system"))).alias("s"))
    return out.select("subtask", "tier", "first_place", "last_place", F.array_join(F.transform("s", lambda x: x["system"]), ",").alias("systems"))


@query("top_02_podium", f"select subtask, system, place from (select *, row_number() over (partition by subtask order by ba desc nulls last, system) as place from ({BOARD})) where place <= 3")
def podium(spark, sf):
    place = F.row_number().over(Window.partitionBy("subtask").orderBy(F.desc_nulls_last("ba"), "system"))
    return board(proxy(spark, sf, "judgments")).withColumn("place", place.cast("long")).where("place <= 3").select("subtask", "system", "place")


@query(
    "top_03_best_in_top_tier",
    f"""with t as ({TIERS}), l as (select system, subtask, round(avg(latency_s), 6) as latency from judgments group by 1, 2), x as (select t.*, l.latency, min(tier) over (partition by subtask) as top from t join l using (system, subtask))
    select subtask, arg_min(system, latency) as fastest, round(min(latency), 6) as latency, count(*) as n_top from x where tier = top group by 1""",
)
def best_in_top_tier(spark, sf):
    """Of a job's first tier, the system that is best by another measure: here the fastest."""
    j = proxy(spark, sf, "judgments")
    x = tiered(board(j)).join(j.groupBy("system", "subtask").agg(F.round(F.avg("latency_s"), 6).alias("latency")), ["system", "subtask"])
    x = x.withColumn("top", F.min("tier").over(Window.partitionBy("subtask"))).where("tier = top")
    return x.groupBy("subtask").agg(F.min_by("system", "latency").alias("fastest"), F.min("latency").alias("latency"), F.count(F.lit(1)).alias("n_top"))


@query("top_04_rows_on_show", "select subtask, id from (select subtask, id, row_number() over (partition by subtask order by md5('show:' || id), id) as rn from records where split <> 'private') where rn <= 5 or id % 97 = 0")
def rows_on_show(spark, sf):
    """The first few public rows of each job in a hashed order, and those that are pinned."""
    r = proxy(spark, sf, "records").where("split <> 'private'").select("subtask", "id")
    rn = F.row_number().over(Window.partitionBy("subtask").orderBy(F.md5(F.concat(F.lit("show:"), F.col("id").cast("string"))), "id"))
    first = r.withColumn("rn", rn).where("rn <= 5").select("subtask", "id")
    return first.union(r.where("id % 97 = 0")).distinct()


@query("top_05_common_errors", "select error, count(*) as n from ledger where error is not null group by error order by n desc, error limit 3")
def common_errors(spark, sf):
    return proxy(spark, sf, "ledger").where("error is not null").groupBy("error").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "error").limit(3)


@query("top_06_places", f"with p as (select subtask, system, rank() over (partition by subtask order by ba desc nulls last) as place from ({BOARD})) select system, count(*) filter (place = 1) as led, count(*) filter (place <= 2) as in_top, count(*) as jobs from p group by 1")
def places(spark, sf):
    b = board(proxy(spark, sf, "judgments")).withColumn("place", F.rank().over(Window.partitionBy("subtask").orderBy(F.desc_nulls_last("ba"))))
    return b.groupBy("system").agg(F.count_if(F.col("place") == 1).alias("led"), F.count_if(F.col("place") <= 2).alias("in_top"), F.count(F.lit(1)).alias("jobs"))


@query("xtr_51_tag_views", f"select system, source as tag, round({BA}, 6) as ba, count(*) filter (positive) as n_pos, count(*) filter (not positive) as n_neg from judgments where split <> 'private' group by 1, 2")
def tag_views(spark, sf):
    p = F.col("positive")
    return proxy(spark, sf, "judgments").where("split <> 'private'").groupBy("system", F.col("source").alias("tag")).agg(F.round(balanced(), 6).alias("ba"), F.count_if(p).alias("n_pos"), F.count_if(~p).alias("n_neg"))


@query("xtr_52_best_per_tag", f"with b as (select system, source as tag, round({BA}, 6) as ba from judgments group by 1, 2) select tag, system as best, ba from (select *, row_number() over (partition by tag order by ba desc, system) as rn from b where ba is not null) where rn = 1")
def best_per_tag(spark, sf):
    b = proxy(spark, sf, "judgments").groupBy(F.col("source").alias("tag"), "system").agg(F.round(balanced(), 6).alias("ba")).where("ba is not null")
    return metrics.latest_per_key(b, ["tag"], F.desc("ba"), F.asc("system")).select("tag", F.col("system").alias("best"), "ba")


SYSTEMS = ("alpha", "beta", "gamma", "delta")


@query("xtr_53_correctness_matrix", "select row_id, subtask, bool_or(positive) as positive, " + ", ".join(f"bool_or(correct) filter (system = '{s}') as {s}" for s in SYSTEMS) + " from judgments group by 1, 2")
def correctness_matrix(spark, sf):
    """One row a judged row, one column a system."""
    return proxy(spark, sf, "judgments").groupBy("row_id", "subtask").agg(F.bool_or("positive").alias("positive"), *[F.bool_or(F.when(F.col("system") == s, F.col("correct"))).alias(s) for s in SYSTEMS])


@query("xtr_55_correctness_vector", "select r.id as row_id, s.system, coalesce(l.correct, false) as correct, l.row_id is null as missing from records r cross join systems s left join (select * from judgments where row_id % 29 <> 0) l on l.row_id = r.id and l.system = s.system where r.expected is not null")
def correctness_vector(spark, sf):
    """Whether each system got each row right; a missing record is wrong."""
    rows = proxy(spark, sf, "records").where("expected is not null").select(F.col("id").alias("row_id")).withColumn("system", F.explode(F.array(*map(F.lit, SYSTEMS))))
    j = proxy(spark, sf, "judgments").where("row_id % 29 <> 0").select("row_id", "system", "correct")
    return rows.join(j, ["row_id", "system"], "left").select("row_id", "system", F.coalesce("correct", F.lit(False)).alias("correct"), F.col("correct").isNull().alias("missing"))


@query("xtr_58_cost_split", "select kind, count(distinct system) as systems, count(distinct (row_id, system)) as checks, round(sum(case when kind = 'self' then latency_s / 3600 * 1.8 else (tokens_in * 0.5 + tokens_out * 1.5) / 1000000 end), 8) as usd from ledger group by 1")
def cost_split(spark, sf):
    """Hosted systems by usage, one's own by machine time."""
    usd = F.when(F.col("kind") == "self", F.col("latency_s") / 3600 * 1.8).otherwise((F.col("tokens_in") * 0.5 + F.col("tokens_out") * 1.5) / 1000000)
    calls = proxy(spark, sf, "ledger").groupBy("kind", "system", "row_id").agg(F.sum(usd).alias("usd"))
    by = calls.groupBy("kind", "system").agg(F.count(F.lit(1)).alias("checks"), F.sum("usd").alias("usd"))
    return by.groupBy("kind").agg(F.count(F.lit(1)).alias("systems"), F.sum("checks").alias("checks"), F.round(F.sum("usd"), 8).alias("usd"))


@query("xtr_60_compact_table", f"with b as ({BOARD}) select system, " + ", ".join(f"max(ba) filter (subtask = '{x}') as {x}" for x in ("de", "en", "es", "fr")) + " from b group by 1")
def compact_table(spark, sf):
    """A row a system, a column a job; the jobs are named, so that no pass is spent on finding them."""
    return board(proxy(spark, sf, "judgments")).groupBy("system").pivot("subtask", ["de", "en", "es", "fr"]).agg(F.max("ba"))


@query("xtr_61_cap_flags", "select row_id, system, tokens_in >= 900 as near_limit, tokens_out >= 39 as truncated from latest where tokens_in >= 900 or tokens_out >= 39")
def cap_flags(spark, sf):
    return proxy(spark, sf, "latest").where("tokens_in >= 900 or tokens_out >= 39").select("row_id", "system", (F.col("tokens_in") >= 900).alias("near_limit"), (F.col("tokens_out") >= 39).alias("truncated"))


@query("xtr_54_wording_sanity", f"select system, case when grp % 2 = 0 then 'new' else 'unchanged' end as wording, round({BA}, 6) as ba, round(avg(correct::int) filter (positive), 6) as catch from judgments group by 1, 2")
def wording_sanity(spark, sf):
    """Scores on groups whose wording is new against those where it is unchanged."""
    new = F.when(F.col("grp") % 2 == 0, "new").otherwise("unchanged")
    return proxy(spark, sf, "judgments").groupBy("system", new.alias("wording")).agg(F.round(balanced(), 6).alias("ba"), F.round(F.avg(F.when(F.col("positive"), F.col("correct").cast("int"))), 6).alias("catch"))


@query("join_26_ranked_pairs", f"with p as (select subtask, system, ba, row_number() over (partition by subtask order by ba desc nulls last, system) as pos from ({BOARD})) select a.subtask, a.system as better, b.system as worse, round(a.ba - b.ba, 6) as lead from p a join p b on a.subtask = b.subtask and a.pos < b.pos")
def ranked_pairs(spark, sf):
    """Every pair of systems of a board, the better first: an array a job, exploded, since a board is a few dozen rows."""
    b = board(proxy(spark, sf, "judgments")).withColumn("pos", F.row_number().over(Window.partitionBy("subtask").orderBy(F.desc_nulls_last("ba"), "system")))
    g = b.join(b.groupBy("subtask").agg(F.collect_list(F.struct("pos", "system", "ba")).alias("others")), "subtask")
    g = g.withColumn("o", F.explode(F.filter("others", lambda o: o["pos"] > F.col("pos"))))
    return g.select("subtask", F.col("system").alias("better"), F.col("o.system").alias("worse"), F.round(F.col("ba") - F.col("o.ba"), 6).alias("lead"))

