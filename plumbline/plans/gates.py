"""Gates over tables and results: each gives its violations, none of them decides by itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import metrics
from plumbline.operators.ranges import row_numbers
from plumbline.plans.catalog import proxy, query, table
from plumbline.plans.records import NORM
from plumbline.plans.scoring import BY_UNIT, KEYS
from plumbline.plans.views import balanced
from plumbline.streaming.ledger import shared_folder

NATURAL = "case when source = 'src0' then concat('doc-', id % 50) when source in ('src1', 'src2') then concat(source, '-', grp) else concat('row-', id) end"
EXAMINED = "select doc_id as id from labels where quality = 0 except select doc_id from labels where doc_id % 10 = 3"

AUDIT = f"""
  select 'manifest_integrity' as gate, (select count(*) from (select split, count(*) as n, count(*) filter (id % 100 <> 99) as claimed from records group by 1) where n <> claimed) as violations
  union all select 'orphan_split_files', (select count(distinct split) from records where split not in ('test', 'dev'))
  union all select 'schema', (select count(*) from records where coalesce(text, '') = '' or subtask is null)
  union all select 'recorded_group_leakage', (select count(*) from (select grp from records group by 1 having count(distinct split) > 1))
  union all select 'derived_group_leakage', (select count(*) from (select {NATURAL} as g from records group by 1 having count(distinct split) > 1))
  union all select 'examined_not_in_test', (select count(*) from ({EXAMINED}) e join records r on r.id = e.id where r.split = 'test')
  union all select 'duplicate_text_across_splits', (select count(*) from (select {NORM} as t from records where text is not null group by 1 having count(distinct split) > 1))
  union all select 'entity_mapping', (select count(*) from (select unnest(['@', '+1 (', 'token']) as e) x where not exists (select 1 from records where split = 'test' and contains(text, x.e)))
"""


def natural(r):
    s = lambda c: F.col(c).cast("string")
    return F.when(F.col("source") == "src0", F.concat(F.lit("doc-"), (F.col("id") % 50).cast("string"))).when(F.col("source").isin("src1", "src2"), F.concat_ws("-", "source", s("grp"))).otherwise(F.concat(F.lit("row-"), s("id")))


def examined(spark, sf):
    t = table(spark, sf, "labels")
    return t.where("quality = 0").select(F.col("doc_id").alias("id")).subtract(t.where("doc_id % 10 = 3").select("doc_id"))


def gate_rows(gates: dict[str, DataFrame]) -> DataFrame:
    """(gate, violations): a row for each table of violations, counted."""
    return reduce(DataFrame.union, [v.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(g).alias("gate"), "violations") for g, v in gates.items()])


def audit_gates(spark, sf) -> dict[str, DataFrame]:
    """Every gate's violations as rows of their own: what a reviewer reads."""
    r = proxy(spark, sf, "records")
    straddling = lambda key: r.select(key.alias("k"), "split").groupBy("k").agg(F.count_distinct("split").alias("n")).where("n > 1")
    manifest = r.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") % 100 != 99).alias("claimed"))
    found = r.where("split = 'test'").agg(*[F.bool_or(F.col("text").contains(e)).alias(f"e{k}") for k, e in enumerate(("@", "+1 (", "token"))])
    texts = r.where("text is not null").select(F.sha2(X.normalise(F.col("text")), 256).alias("t"), "split").groupBy("t").agg(F.count_distinct("split").alias("n"))
    return {
        "manifest_integrity": manifest.where("n <> claimed"),
        "orphan_split_files": r.where(~F.col("split").isin("test", "dev")).select("split").distinct(),
        "schema": r.where((F.coalesce("text", F.lit("")) == "") | F.col("subtask").isNull()),
        "recorded_group_leakage": straddling(F.col("grp")),
        "derived_group_leakage": straddling(natural(r)),
        "examined_not_in_test": r.where("split = 'test'").join(examined(spark, sf), "id", "left_semi"),
        "duplicate_text_across_splits": texts.where("n > 1"),
        "entity_mapping": found.select(F.explode(F.array("e0", "e1", "e2")).alias("e")).where("not coalesce(e, false)"),
    }


@query("gov_01_audit_gates", f"select gate, violations, violations = 0 as passed from ({AUDIT})")
def audit(spark, sf):
    return gate_rows(audit_gates(spark, sf)).withColumn("passed", F.col("violations") == 0)


@query("gov_02_build_status", f"select count(*) as gates, count(*) filter (violations = 0) as passed, case when bool_and(violations = 0) then 'ready' else 'blocked' end as status from ({AUDIT})")
def build_status(spark, sf):
    g = gate_rows(audit_gates(spark, sf))
    ok = F.col("violations") == 0
    return g.agg(F.count(F.lit(1)).alias("gates"), F.count_if(ok).alias("passed"), F.when(F.bool_and(ok), "ready").otherwise("blocked").alias("status"))


FLOORS = "select subtask, count(*) filter (expected = 'yes') as pos, count(*) filter (expected = 'no') as neg, count(distinct source) as sources from records group by 1"


@query("gov_03_publication_blockers", f"select subtask, array_to_string(list_filter([case when pos < 40 then 'positives' end, case when neg < 60 then 'negatives' end, case when sources < 5 then 'sources' end], lambda x: x is not null), ',') as blockers from ({FLOORS}) where pos < 40 or neg < 60 or sources < 5")
def publication_blockers(spark, sf):
    """What keeps a job from being published; a job without blockers isn't listed."""
    c = proxy(spark, sf, "records").groupBy("subtask").agg(F.count_if(F.col("expected") == "yes").alias("pos"), F.count_if(F.col("expected") == "no").alias("neg"), F.count_distinct("source").alias("sources"))
    why = F.array_compact(F.array(F.when(F.col("pos") < 40, "positives"), F.when(F.col("neg") < 60, "negatives"), F.when(F.col("sources") < 5, "sources")))
    return c.where(F.size(why) > 0).select("subtask", F.array_join(why, ",").alias("blockers"))


RELEASE = "select id, case when id % 53 = 0 then concat(text, ' ') else text end as text, licence, split from records where split <> 'private' and id % 59 <> 0 union all select id, text, licence, split from records where id % 101 = 18"


@query(
    "gov_04_publish_gates",
    f"""with rel as ({RELEASE}) select 'private ids' as gate, (select count(*) from rel join records r on r.id = rel.id where r.split = 'private') as violations
    union all select 'missing ids', (select count(*) from records where split <> 'private' and id not in (select id from rel))
    union all select 'ids twice', (select count(*) from (select id from rel group by 1 having count(*) > 1))
    union all select 'changed texts', (select count(*) from rel join records r on r.id = rel.id where sha256(coalesce(r.text, '')) <> sha256(coalesce(rel.text, '')))
    union all select 'licence unknown', (select count(*) from rel where licence = 'unknown')""",
)
def publish_gates(spark, sf):
    """A release against the records that it was made from."""
    r = proxy(spark, sf, "records").select("id", "text", "licence", "split")
    rel = r.where("split <> 'private' and id % 59 <> 0").withColumn("text", F.when(F.col("id") % 53 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))).union(r.where("id % 101 = 18"))
    digest = lambda c: F.sha2(F.coalesce(c, F.lit("")), 256)
    both = rel.select("id", digest(F.col("text")).alias("a")).join(r.select("id", digest(F.col("text")).alias("b")), "id")
    return gate_rows({
        "private ids": rel.select("id").join(r.where("split = 'private'").select("id"), "id"),
        "missing ids": r.where("split <> 'private'").select("id").join(rel.select("id"), "id", "left_anti"),
        "ids twice": rel.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
        "changed texts": both.where("a <> b"),
        "licence unknown": rel.where("licence = 'unknown'"),
    })


FROZEN = "select subtask, split, count(*) as n, bit_xor(('0x' || substr(sha256(id || '|' || coalesce(expected, '') || '|' || {text}), 1, 15))::bigint) as digest from records where subtask is not null group by 1, 2"


@query("gov_05_freeze_manifest", f"select a.subtask, a.split, a.n, a.digest, a.digest = b.digest as still_true from ({FROZEN.format(text=chr(39) * 2 + ' || sha256(coalesce(text, ' + chr(39) * 2 + '))')}) a join ({FROZEN.format(text='sha256(case when id % 211 = 0 then ' + chr(39) + 'edited' + chr(39) + ' else coalesce(text, ' + chr(39) * 2 + ') end)')}) b on a.subtask = b.subtask and a.split = b.split")
def freeze_manifest(spark, sf):
    """A manifest of counts and order-free hashes is written; later the same is computed again and compared with it."""
    r, folder = proxy(spark, sf, "records").where("subtask is not null"), shared_folder(spark, "freeze")

    def manifest(text):
        h = F.sha2(F.concat_ws("|", F.col("id").cast("string"), F.coalesce("expected", F.lit("")), F.sha2(text, 256)), 256)
        return r.groupBy("subtask", "split").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.conv(F.substring(h, 1, 15), 16, 10).cast("long")).alias("digest"))

    text = F.coalesce("text", F.lit(""))
    manifest(text).write.parquet(folder)
    now = manifest(F.when(F.col("id") % 211 == 0, "edited").otherwise(text)).select("subtask", "split", F.col("digest").alias("now"))
    return spark.read.parquet(folder).join(now, ["subtask", "split"]).select("subtask", "split", "n", "digest", (F.col("digest") == F.col("now")).alias("still_true"))


OVERLAPS = f"""with r as (select id, split, grp, {NORM} as norm from records where text is not null), t as (select * from r where split = 'test'), o as (select * from r where split <> 'test')
  select 'text' as kind, count(*) as n from t where norm in (select norm from o) union all select 'group', count(*) from t where grp in (select grp from o)"""


@query("gov_06_integrity_check", OVERLAPS)
def integrity_check(spark, sf):
    """Test rows that share a text or a group with any other split: semi-joins on distinct keys, no pairs."""
    r = proxy(spark, sf, "records").where("text is not null").select("id", "split", "grp", F.sha2(X.normalise(F.col("text")), 256).alias("norm"))
    test, other = r.where("split = 'test'"), r.where("split <> 'test'")
    shared = {k: test.join(other.select(c).distinct(), c, "left_semi") for k, c in (("text", "norm"), ("group", "grp"))}
    return gate_rows(shared).select(F.col("gate").alias("kind"), F.col("violations").alias("n"))


@query("xtr_45_integrity_problems", f"select kind, n, case when kind = 'text' then 0 else 1 end as recorded, n <> case when kind = 'text' then 0 else 1 end as changed from ({OVERLAPS})")
def integrity_problems(spark, sf):
    """The check made anew against what a manifest has recorded of it."""
    recorded = F.when(F.col("kind") == "text", 0).otherwise(1)
    return integrity_check(spark, sf).withColumn("recorded", recorded).withColumn("changed", F.col("n") != F.col("recorded"))


@query("gov_07_contract_diff", "with a as (select n_name as path, n_regionkey as value from nation where n_nationkey % 9 <> 0), b as (select n_name as path, case when n_nationkey % 5 = 0 then n_regionkey + 10 else n_regionkey end as value from nation where n_nationkey % 7 <> 0) select coalesce(a.path, b.path) as path, a.value as old_value, b.value as new_value, case when a.path is null then 'added' when b.path is null then 'removed' else 'changed' end as change from a full join b on a.path = b.path where a.value is distinct from b.value")
def contract_diff(spark, sf):
    """Two settings as JSON objects, compared path by path."""
    n = table(spark, sf, "nation")
    as_json = lambda rows, value: rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", value.alias("v"))))).alias("j"))  # noqa: E731  a setting a nation
    old = as_json(n.where("n_nationkey % 9 <> 0"), F.col("n_regionkey"))
    new = as_json(n.where("n_nationkey % 7 <> 0"), F.when(F.col("n_nationkey") % 5 == 0, F.col("n_regionkey") + 10).otherwise(F.col("n_regionkey")))
    flat = lambda j, name: j.select(F.explode(F.from_json("j", "map<string,int>")).alias("path", name))
    j = flat(old, "old_value").join(flat(new, "new_value"), "path", "full")
    change = F.when(F.col("old_value").isNull(), "added").when(F.col("new_value").isNull(), "removed").otherwise("changed")
    return j.where(~F.col("old_value").eqNullSafe(F.col("new_value"))).withColumn("change", change)


@query(
    "gov_08_privacy_check",
    f"""with pub as (select id, {NORM} as norm from records where split <> 'private' and text is not null), priv as (select id, {NORM} as norm from records where split = 'private' and text is not null)
    select 'text in public rows' as gate, (select count(*) from priv where norm in (select norm from pub)) as violations
    union all select 'id in public ledger', (select count(distinct row_id) from ledger where split = 'private' and row_id % 2 = 0)""",
)
def privacy_check(spark, sf):
    """Private rows whose text or id stands in something public."""
    r = proxy(spark, sf, "records").where("text is not null").select("id", "split", F.sha2(X.normalise(F.col("text")), 256).alias("norm"))
    led = proxy(spark, sf, "ledger").where("split = 'private' and row_id % 2 = 0").select("row_id").distinct()
    return gate_rows({"text in public rows": r.where("split = 'private'").join(r.where("split <> 'private'").select("norm").distinct(), "norm", "left_semi"), "id in public ledger": led})


ANSWERS = "select system, case system when 'alpha' then round(score) when 'delta' then score * 10 else score end as s, case when system = 'gamma' and row_id % 2 = 0 then 'logit' when system = 'delta' then 'points' else 'share' end as basis from latest where score is not null"


@query(
    "gov_09_decision_rule",
    f"""with b as (select system, bool_and(s in (0, 1)) as binary_, bool_and(s between 0 and 1) as share_, string_agg(distinct basis, ',' order by basis) as bases, count(distinct basis) as n from ({ANSWERS}) group by 1)
    select system, bases, case when binary_ then 'binary' when share_ then 'probability' else 'other' end as scale, case when binary_ or share_ then 0.5::double when n = 1 then 4.0::double end as threshold,
    case when binary_ then 'verdict' when share_ then 'fixed_probability_rule' when n = 1 then 'frozen_documented_setting' else 'conflicting_frozen_settings' end as rule from b""",
)
def decision_rule(spark, sf):
    """The rule for a system's scores, from what they are: verdicts, probabilities, or another scale with a setting."""
    led = proxy(spark, sf, "latest").where("score is not null")
    s = F.when(F.col("system") == "alpha", F.round("score")).when(F.col("system") == "delta", F.col("score") * 10).otherwise(F.col("score"))
    basis = F.when((F.col("system") == "gamma") & (F.col("row_id") % 2 == 0), "logit").when(F.col("system") == "delta", "points").otherwise("share")
    b = led.select("system", s.alias("s"), basis.alias("basis")).groupBy("system").agg(F.bool_and(F.col("s").isin(0.0, 1.0)).alias("verdict"), F.bool_and(F.col("s").between(0, 1)).alias("share"), F.array_sort(F.collect_set("basis")).alias("bases"))
    one = F.size("bases") == 1
    return b.select(
        "system", F.array_join("bases", ",").alias("bases"), F.when(F.col("verdict"), "binary").when(F.col("share"), "probability").otherwise("other").alias("scale"),
        F.when(F.col("verdict") | F.col("share"), 0.5).when(one, 4.0).alias("threshold"),
        F.when(F.col("verdict"), "verdict").when(F.col("share"), "fixed_probability_rule").when(one, "frozen_documented_setting").otherwise("conflicting_frozen_settings").alias("rule"),
    )


@query(
    "gov_10_credit_cross_check",
    f"with a as ({BY_UNIT}), b as (select system, subtask, 50 * (avg(correct::int) filter (positive) + avg(correct::int) filter (not positive)) as ba from judgments group by 1, 2) select a.system, a.subtask, abs(50 * (tp::double / nullif(n_pos, 0) + tn::double / nullif(n_neg, 0)) - b.ba) <= 1e-9 as agree from a join b on a.system = b.system and a.subtask = b.subtask",
)
def credit_cross_check(spark, sf):
    """Two ways to the same score: by confusion counts and by the mean credit of each class."""
    j = proxy(spark, sf, "judgments")
    a = metrics.unit_metrics(metrics.confusion(j, KEYS)).select(*KEYS, "balanced_accuracy")
    return a.join(j.groupBy(*KEYS).agg(balanced().alias("ba")), KEYS).select(*KEYS, (F.abs(F.col("balanced_accuracy") - F.col("ba")) <= 1e-9).alias("agree"))


@query(
    "gov_11_owner_decisions",
    """select id, case when id % 6 = 0 then case when expected = 'yes' then 'no' when expected = 'no' then 'yes' end else expected end as label, case when id % 6 = 1 then 'moved' else subtask end as subtask,
    array_to_string(list_filter([case when contains(text, '@') then 'email' end, case when contains(text, '+1 (') then 'phone' end, case when contains(text, 'token') then 'token' end], lambda x: x is not null and not (id % 6 = 2 and x = 'email')), ',') as kinds from records where id % 12 <> 11""",
)
def owner_decisions(spark, sf):
    """Decisions about rows: a label turned, a job changed, spans of a kind dropped, a row excluded."""
    r = proxy(spark, sf, "records").select("id", "expected", "subtask", F.array_compact(F.array(F.when(F.col("text").contains("@"), "email"), F.when(F.col("text").contains("+1 ("), "phone"), F.when(F.col("text").contains("token"), "token"))).alias("kinds"))
    decisions = r.select("id", F.when(F.col("id") % 12 == 11, "exclude").when(F.col("id") % 6 == 0, "turn").when(F.col("id") % 6 == 1, "move").when(F.col("id") % 6 == 2, "drop email").alias("decision")).where("decision is not null")
    j = r.join(decisions, "id", "left").where("decision is distinct from 'exclude'")
    turned = F.when(F.col("expected") == "yes", "no").when(F.col("expected") == "no", "yes")
    kinds = F.when(F.col("decision") == "drop email", F.array_remove("kinds", "email")).otherwise(F.col("kinds"))
    return j.select("id", F.when(F.col("decision") == "turn", turned).otherwise(F.col("expected")).alias("label"), F.when(F.col("decision") == "move", "moved").otherwise(F.col("subtask")).alias("subtask"), F.array_join(kinds, ",").alias("kinds"))


@query("gov_12_review_packets", "with o as (select id, subtask, sha256(coalesce(text, '')) as digest, row_number() over (order by md5('packet:' || id), id) as place from records where split = 'test') select id, subtask, digest, (place - 1) // 50 as packet from o")
def review_packets(spark, sf):
    """Rows for reviewers: no label, no source, in a hashed order, fifty a packet. Places come from ranges of the order."""
    r = proxy(spark, sf, "records").where("split = 'test'").select("id", "subtask", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.md5(F.concat(F.lit("packet:"), F.col("id").cast("string"))).alias("h"))
    return row_numbers(r, [F.col("h").asc(), F.col("id").asc()]).select("id", "subtask", "digest", F.floor((F.col("at") - 1) / 50).alias("packet"))


@query("gov_13_pair_integrity", "select id // 2 as pair, count(*) as n, count(*) filter (expected = 'yes') as yes_, count(*) filter (expected = 'no') as no_, count(distinct subtask) as subtasks from records where expected is not null group by 1 having not (count(*) = 2 and count(*) filter (expected = 'yes') = 1 and count(*) filter (expected = 'no') = 1 and count(distinct subtask) = 1)")
def pair_integrity(spark, sf):
    """Pairs that aren't one yes and one no of the same job."""
    p = proxy(spark, sf, "records").where("expected is not null").groupBy(F.floor(F.col("id") / 2).alias("pair")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("expected") == "yes").alias("yes_"), F.count_if(F.col("expected") == "no").alias("no_"), F.count_distinct("subtask").alias("subtasks")
    )
    return p.where("not (n = 2 and yes_ = 1 and no_ = 1 and subtasks = 1)")


@query("gov_14_failure_cap", "select system, subtask, count(*) as n, count(*) filter (not ok) as failed, count(*) filter (error like 'refused%') as refused, case when (count(*) filter (not ok) - count(*) filter (error like 'refused%'))::double / count(*) > 0.02 + 1e-12 then 'invalid run' else 'evaluated' end as status from latest group by 1, 2")
def failure_cap(spark, sf):
    """Runs with failures above two in a hundred; a provider's refusal counts as wrong but not towards the cap."""
    g = proxy(spark, sf, "latest").groupBy("system", "subtask").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.startswith("error", F.lit("refused"))).alias("refused"))
    return g.withColumn("status", F.when((F.col("failed") - F.col("refused")) / F.col("n") > 0.02 + 1e-12, "invalid run").otherwise("evaluated"))


@query(
    "agg_29_entity_section",
    """with e as (select id, split, expected, unnest(list_filter([case when contains(text, '@') then 'email' end, case when contains(text, '+1 (') then 'phone' end, case when contains(text, 'token') then 'token' end], lambda x: x is not null)) as entity from records)
    select entity, split, count(*) as n, count(*) filter (expected = 'yes') as positives, count(*) filter (expected is null) as unmapped from e group by 1, 2""",
)
def entity_section(spark, sf):
    """Rows of each entity by split, with those whose label is unknown."""
    kinds = F.array_compact(F.array(F.when(F.col("text").contains("@"), "email"), F.when(F.col("text").contains("+1 ("), "phone"), F.when(F.col("text").contains("token"), "token")))
    e = proxy(spark, sf, "records").select("split", "expected", F.explode(kinds).alias("entity"))
    return e.groupBy("entity", "split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("expected") == "yes").alias("positives"), F.count_if(F.col("expected").isNull()).alias("unmapped"))


@query("xtr_13_worst_cells", "with c as (select system, subtask, grp % 2 as half, 50 * (avg(correct::int) filter (positive) + avg(correct::int) filter (not positive)) as ba from judgments group by 1, 2, 3) select subtask, half, system as worst, round(ba, 6) as ba from (select *, row_number() over (partition by subtask, half order by round(ba, 9) desc, system) as rn from c where ba is not null) where rn = 1")
def worst_cells(spark, sf):
    """The cell of each job and half that a gate would fail first: the one with the largest score."""
    c = proxy(spark, sf, "judgments").groupBy("system", "subtask", (F.col("grp") % 2).alias("half")).agg(balanced().alias("ba")).where("ba is not null")
    best = metrics.latest_per_key(c.withColumn("r", F.round("ba", 9)), ["subtask", "half"], F.desc("r"), F.asc("system"))
    return best.select("subtask", "half", F.col("system").alias("worst"), F.round("ba", 6).alias("ba"))


@query("xtr_42_unscored_units", "select u.suite, u.unit, case when s.unit is null then 'unscored' when u.sanity then 'sanity check' else 'scored' end as status from (select 'de' as suite, 'src0' as unit, true as sanity union all select 'de', 'src1', false union all select 'en', 'none', false) u left join (select distinct subtask as suite, source as unit from judgments) s on s.suite = u.suite and s.unit = u.unit")
def unscored_units(spark, sf):
    """Declared units without a judgment, and those that are checks outside the score."""
    declared = spark.createDataFrame([("de", "src0", True), ("de", "src1", False), ("en", "none", False)], "suite string, unit string, sanity boolean")
    seen = proxy(spark, sf, "judgments").select(F.col("subtask").alias("suite"), F.col("source").alias("unit")).distinct().withColumn("seen", F.lit(True))
    status = F.when(F.col("seen").isNull(), "unscored").when(F.col("sanity"), "sanity check").otherwise("scored")
    return F.broadcast(declared).join(seen, ["suite", "unit"], "left").select("suite", "unit", status.alias("status"))


@query(
    "xtr_44_threshold_map",
    """with f as (select system, kind, round(count(*) filter (not ok) / count(*)::double, 9) as failed, round(avg(score) filter (split = 'dev' and expected = 'no'), 2) as low from ledger group by 1, 2),
    t as (select system, 0 as place, 0.5::double as t from f union all select system, 1, low from f where kind = 'self' and low is not null union all select system, 2, 0.3 from f where failed = (select max(failed) from f))
    select system, arg_max(t, place) as threshold, count(*) as entries from t group by 1""",
)
def threshold_map(spark, sf):
    """Thresholds by arm out of the ledger: the manifest's for all, an extension's (the mean dev score of negatives) for
    self-hosted ones, a correction for the arm that fails most. A correction goes before an extension, that before the manifest."""
    low = F.round(F.avg(F.when((F.col("split") == "dev") & (F.col("expected") == "no"), F.col("score"))), 2)
    f = proxy(spark, sf, "ledger").groupBy("system", "kind").agg(F.round(F.count_if(~F.col("ok")) / F.count(F.lit(1)), 9).alias("failed"), low.alias("low"))
    entry = lambda place, t: F.struct(F.lit(place).alias("place"), t.cast("double").alias("t"))
    worst = F.max("failed").over(Window.partitionBy(F.lit(1)))  # a row a system
    f = f.withColumn("worst", worst)
    kept = F.array(entry(0, F.lit(0.5)), F.when((F.col("kind") == "self") & F.col("low").isNotNull(), entry(1, F.col("low"))), F.when(F.col("failed") == F.col("worst"), entry(2, F.lit(0.3))))
    t = f.select("system", F.explode(F.array_compact(kept)).alias("x"))
    return t.groupBy("system").agg(F.max(F.col("x")).alias("best"), F.count(F.lit(1)).alias("entries")).select("system", F.col("best.t").alias("threshold"), "entries")


@query(
    "xtr_40_freeze_proof",
    "select system, array_to_string(list_filter([case when bool_or(row_id % 997 = 0) then 'record without identity' end, case when count(*) < (select count(*) from records where expected is not null) then 'rows missing' end, case when avg((not ok)::int) > 0.02 then 'failures' end], lambda x: x is not null), ',') as blockers from latest where not (system = 'gamma' and row_id % 10 = 0) group by 1",
)
def freeze_proof(spark, sf):
    """What stands against a frozen run's being published, by system."""
    want = proxy(spark, sf, "records").where("expected is not null").agg(F.count(F.lit(1)).alias("want"))
    g = proxy(spark, sf, "latest").where("not (system = 'gamma' and row_id % 10 = 0)").groupBy("system").agg(F.bool_or(F.col("row_id") % 997 == 0).alias("unknown"), F.count(F.lit(1)).alias("n"), F.avg((~F.col("ok")).cast("int")).alias("failed"))
    why = F.array_compact(F.array(F.when(F.col("unknown"), "record without identity"), F.when(F.col("n") < F.col("want"), "rows missing"), F.when(F.col("failed") > 0.02, "failures")))
    return g.crossJoin(F.broadcast(want)).select("system", F.array_join(why, ",").alias("blockers"))  # one row


@query(
    "xtr_39_tuned_then_reported",
    """with d as (select * from judgments where score is not null), v as (select system, subtask, score, sum(positive::int) as p, sum((not positive)::int) as q from d where split = 'dev' group by 1, 2, 3),
    c as (select *, sum(p) over w as tp, sum(q) over w as fp, sum(p) over a as n_pos, sum(q) over a as n_neg from v window w as (partition by system, subtask order by score desc), a as (partition by system, subtask)),
    t as (select system, subtask, score as threshold from (select *, row_number() over (partition by system, subtask order by round(100 * (tp::double / n_pos + 1 - fp::double / n_neg) / 2, 6) desc, score desc) as rn from c where n_pos > 0 and n_neg > 0) where rn = 1)
    select d.system, d.subtask, t.threshold, count(*) as n, round(50 * (avg((score >= threshold)::int) filter (positive) + avg((score < threshold)::int) filter (not positive)), 6) as ba from d join t on t.system = d.system and t.subtask = d.subtask where d.split = 'test' group by 1, 2, 3""",
)
def tuned_then_reported(spark, sf):
    """Thresholds chosen on one split and the score that they give on another."""
    d = proxy(spark, sf, "judgments").where("score is not null")
    c = metrics.cumulative(d.where("split = 'dev'"), KEYS).where("n_pos > 0 and n_neg > 0")
    ba = F.round(100 * (F.col("tp") / F.col("n_pos") + 1 - F.col("fp") / F.col("n_neg")) / 2, 6)
    t = metrics.latest_per_key(c.withColumn("b", ba), KEYS, F.desc("b"), F.desc("score")).select(*KEYS, F.col("score").alias("threshold"))
    x = d.where("split = 'test'").join(t, KEYS).withColumn("right", (F.col("score") >= F.col("threshold")) == F.col("positive"))
    return x.groupBy(*KEYS, "threshold").agg(F.count(F.lit(1)).alias("n"), F.round(balanced("right"), 6).alias("ba"))
