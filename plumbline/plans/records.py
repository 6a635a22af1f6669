"""Sources, filters, exact dedup, groups and audits of the records."""

from __future__ import annotations

import hashlib
import itertools
import re

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import components
from plumbline.operators.metrics import latest_per_key
from plumbline.plans.catalog import proxy, query, table
from plumbline.sources.versioned import VersionedTable
from plumbline.streaming.ledger import shared_folder

NORM = r"trim(regexp_replace(lower(text), '[ \t\n\x0b\f\r]+', ' ', 'g'))"


@query("src_04_projected_scan", "select doc_id, n_chars from documents where n_chars > 2000")
def projected_scan(spark, sf):
    """Two columns and a predicate: both reach the scan."""
    return table(spark, sf, "documents").where("n_chars > 2000").select("doc_id", "n_chars")


@query("src_05_pruned_scan", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey between 1000 and 2000")
def pruned_scan(spark, sf):
    """A key range: row groups whose statistics exclude it are skipped."""
    return table(spark, sf, "lineitem").where(F.col("l_orderkey").between(1000, 2000)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("src_06_nested_literals", "select event_id, (props ->> '$.k')::bigint as k from events where props is not null")
def nested_literals(spark, sf):
    return table(spark, sf, "events").where("props is not null").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("src_08_filtered_limit", "select doc_id, lang from documents where lang = 'de' order by doc_id limit 20")
def filtered_limit(spark, sf):
    """The first rows that pass a filter: a top-k report."""
    return table(spark, sf, "documents").where("lang = 'de'").select("doc_id", "lang").orderBy("doc_id").limit(20)


@query(
    "src_09_row_to_two_records",
    "select page_id, part, length(value) as n from (select page_id, unnest(['url', 'html']) as part, unnest([url, html]) as value from pages) where value is not null",
)
def row_to_two_records(spark, sf):
    both = F.array(F.struct(F.lit("url").alias("part"), F.col("url").alias("value")), F.struct(F.lit("html").alias("part"), F.col("html").alias("value")))
    return table(spark, sf, "pages").select("page_id", F.explode(both).alias("x")).select("page_id", "x.part", F.length("x.value").cast("long").alias("n")).where("n is not null")


@query("src_10_metadata_join", "select n_name, count(*) as n, round(sum(c_acctbal), 2) as balance from customer left join nation on c_nationkey = n_nationkey group by 1")
def metadata_join(spark, sf):
    """A fact table with the metadata that a small table has for its key."""
    j = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("src_11_two_file_join", "select d.doc_id, l.toxic, d.lang from documents d join labels l on d.doc_id = l.doc_id where l.quality = 1")
def two_file_join(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels").where("quality = 1"), "doc_id").select("doc_id", "toxic", "lang")


@query(
    "src_12_first_per_text_capped",
    f"""with f as (select id, source, toxic from (select id, source, toxic, row_number() over (partition by {NORM} order by id) as rn from records where toxic is not null) where rn = 1)
    select id, source from (select *, row_number() over (partition by source order by id) as rn from f) where rn <= 5""",
)
def first_per_text_capped(spark, sf):
    """Labelled rows, the first of each text, at most five a source."""
    r = proxy(spark, sf, "records").where("toxic is not null").withColumn("norm", F.sha2(X.normalise(F.col("text")), 256))
    f = latest_per_key(r.select("id", "source", "norm"), ["norm"], F.asc("id"))
    return f.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy("id"))).where("rn <= 5").select("id", "source")


@query(
    "src_13_generated_phrases",
    r"with p as (select distinct array_to_string(regexp_extract_all(text, '[\p{L}\p{N}_]+')[1:3], ' ') as phrase from benchmark), f as (select distinct event_type as frame from events) select concat(phrase, ' ', frame, ' ', v) as text, phrase, frame, v as variant from p cross join f cross join (select unnest(range(1, 6)) as v)",
)
def generated_phrases(spark, sf):
    """Every phrase (the first words of the benchmark's texts) in every frame (the kinds of events) and variant. A frame is
    one of a few kinds, so they meet the phrases as one array."""
    p = table(spark, sf, "benchmark").select(F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), 1, 3), " ").alias("phrase")).distinct()
    f = table(spark, sf, "events").agg(F.collect_set("event_type").alias("frames"))
    base = p.crossJoin(f).withColumn("frame", F.explode("frames")).withColumn("variant", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))))
    return base.select(F.concat_ws(" ", "phrase", "frame", "variant").alias("text"), "phrase", "frame", "variant")


@query(
    "flt_01_validity",
    "select id, case when text is null or text = '' then 'empty text' when expected is null then 'no label' when split not in ('test', 'dev') then 'split' when exclude_reason is not null then 'excluded' end as problem from records",
)
def validity(spark, sf):
    """The first rule that a record breaks."""
    r = proxy(spark, sf, "records")
    rules = [(F.col("text").isNull() | (F.col("text") == ""), "empty text"), (F.col("expected").isNull(), "no label"), (~F.col("split").isin("test", "dev"), "split"), (F.col("exclude_reason").isNotNull(), "excluded")]
    return r.select("id", F.coalesce(*[F.when(c, m) for c, m in rules]).alias("problem"))


@query("flt_02_usable", "select id from records where expected in ('yes', 'no') and exclude_reason is null")
def usable(spark, sf):
    return proxy(spark, sf, "records").where("expected in ('yes', 'no') and exclude_reason is null").select("id")


@query("flt_03_keep_per_source", "select id, case when source in ('src0', 'src1') then quality = 1 when source = 'src2' then length(text) > 500 else true end as keep from records")
def keep_per_source(spark, sf):
    keep = F.when(F.col("source").isin("src0", "src1"), F.col("quality") == 1).when(F.col("source") == "src2", F.length("text") > 500).otherwise(True)
    return proxy(spark, sf, "records").select("id", keep.alias("keep"))


@query("flt_04_dead_band", "select row_id, system, case when score >= 0.7 then 'yes' when score <= 0.3 then 'no' end as label from latest")
def dead_band(spark, sf):
    """Yes above one cutoff, no below another, nothing between."""
    return proxy(spark, sf, "latest").select("row_id", "system", F.when(F.col("score") >= 0.7, "yes").when(F.col("score") <= 0.3, "no").alias("label"))


@query("flt_06_screen_reasons", "select id, array_to_string(list_filter([case when length(text) < 40 then 'short' end, case when contains(text, '@') then 'mail' end, case when licence = 'unknown' then 'licence' end, case when quality = 0 then 'quality' end], lambda x: x is not null), ',') as reasons from records")
def screen_reasons(spark, sf):
    """All reasons against a record."""
    rules = [(F.length("text") < 40, "short"), (F.col("text").contains("@"), "mail"), (F.col("licence") == "unknown", "licence"), (F.col("quality") == 0, "quality")]
    return proxy(spark, sf, "records").select("id", F.array_join(F.array_compact(F.array(*[F.when(c, m) for c, m in rules])), ",").alias("reasons"))


@query("flt_09_text_cleared", "select r.id, coalesce(p.mode = 'text' and p.reviewed, false) as cleared from records r left join (select 'cc-by' as licence, 'text' as mode, true as reviewed union all select 'mit', 'text', false union all select 'apache-2.0', 'ids', true) p on r.licence = p.licence")
def text_cleared(spark, sf):
    """Whether a licence's policy lets the text out; no policy, no text."""
    policy = spark.createDataFrame([("cc-by", "text", True), ("mit", "text", False), ("apache-2.0", "ids", True)], "licence string, mode string, reviewed boolean")
    return proxy(spark, sf, "records").join(F.broadcast(policy), "licence", "left").select("id", F.coalesce((F.col("mode") == "text") & F.col("reviewed"), F.lit(False)).alias("cleared"))


@query("flt_10_exclusion_list", "select doc_id from documents where doc_id not in (select doc_id from labels where quality = 0)")
def exclusion_list(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").where("quality = 0").select("doc_id"), "doc_id", "left_anti")


REVIEWS = "select doc_id as id, case when doc_id % 5 = 0 then 'exclude' when doc_id % 5 = 1 then 'no' else 'yes' end as ruling, doc_id % 2 = 0 as final from labels where doc_id % 3 = 0"


@query("flt_11_review_override", f"select r.id, case when v.final and v.ruling in ('yes', 'no') then v.ruling else r.expected end as label, case when v.final then 'reviewed' when v.id is not null then 'draft' else 'source' end as basis from records r left join ({REVIEWS}) v on r.id = v.id where not coalesce(v.final and v.ruling = 'exclude', false)")
def review_override(spark, sf):
    """A final human label replaces the source's, a final exclusion drops the row, drafts change nothing."""
    d = table(spark, sf, "labels").where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 == 0, "exclude").when(F.col("doc_id") % 5 == 1, "no").otherwise("yes").alias("ruling"), (F.col("doc_id") % 2 == 0).alias("final"))
    j = proxy(spark, sf, "records").select("id", "expected").join(d, "id", "left")
    final = F.coalesce("final", F.lit(False))
    basis = F.when(final, "reviewed").when(F.col("ruling").isNotNull(), "draft").otherwise("source")
    return j.where(~(final & (F.col("ruling") == "exclude"))).select("id", F.when(final & F.col("ruling").isin("yes", "no"), F.col("ruling")).otherwise(F.col("expected")).alias("label"), basis.alias("basis"))


@query("flt_14_judged_texts", "select conv_id, array_to_string(list(text order by turn), '|') as texts, count(*) as n_turns from conversations where text <> '' group by conv_id")
def judged_texts(spark, sf):
    """Every text of a conversation in order."""
    c = table(spark, sf, "conversations").where("text <> ''").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return c.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), "|").alias("texts"), F.size("t").cast("long").alias("n_turns"))


#: Categories of adult content, and how a source's own label names it. "sexuality" is no such label.
ADULT_CATEGORIES = ["sexual_content", "sex_related_crimes", "child_sexual_exploitation"]
ADULT_LABEL = r"(?i)\bsexual\b|sexually_explicit|adult_content|child_abuse"
#: Category labels of a row: a main one, a finer one, and the label of its source; some of each kind.
LABELS = """case id % 9 when 0 then 'SEXUAL' when 1 then 'VIOLENCE' when 2 then 'HATE' end as main, case id % 11 when 0 then 'sex_related_crimes' when 1 then 'sexual_content' when 2 then 'weapons' when 3 then 'child_sexual_exploitation' end as fine,
  case id % 13 when 0 then 'Sexual harassment' when 1 then 'sexuality' when 2 then 'sexually_explicit_2' when 3 then 'homosexual' when 4 then 'ADULT_CONTENT' when 5 then 'bisexual rights' when 6 then 'child_abuse' else source end as source_label"""


@query(
    "flt_16_predicate",
    f"""with l as (select id, {LABELS} from records) select id, coalesce(main = 'SEXUAL', false) or coalesce(fine in ({", ".join(f"'{x}'" for x in ADULT_CATEGORIES)}), false) or regexp_matches(coalesce(source_label, ''), '{ADULT_LABEL}') as flagged from l""",
)
def adult_content(spark, sf):
    """Rows whose text is never shown: adult content by a row's own category labels, not by words of its text."""
    main, fine, label = (F.expr(x.rsplit(" as ", 1)[0]) for x in re.split(r",\s+(?=case)", LABELS))
    flagged = F.coalesce(main == "SEXUAL", F.lit(False)) | F.coalesce(fine.isin(ADULT_CATEGORIES), F.lit(False)) | F.coalesce(label, F.lit("")).rlike(ADULT_LABEL)
    return proxy(spark, sf, "records").select("id", flagged.alias("flagged"))


@query("flt_17_refusals", "select system, count(*) as n from ledger where error is not null and regexp_matches(error, '^refused') group by system")
def refusals(spark, sf):
    """Errors that are a provider's refusal, by a pattern of its own for each system."""
    patterns = spark.createDataFrame([(s, "^refused") for s in ("alpha", "beta", "gamma", "delta")], "system string, pattern string")
    led = proxy(spark, sf, "ledger").where("error is not null").join(F.broadcast(patterns), "system")
    return led.where(F.expr("error rlike pattern")).groupBy("system").agg(F.count(F.lit(1)).alias("n"))


@query("ded_01_exact_dedup", f"select id from (select id, row_number() over (partition by {NORM} order by id) as rn from records where text is not null) where rn = 1")
def exact_dedup(spark, sf):
    """The first record of each normal text. Texts are hashed before the shuffle; the minimum is pre-aggregated."""
    r = proxy(spark, sf, "records").where("text is not null").select("id", F.sha2(X.normalise(F.col("text")), 256).alias("norm"))
    return r.groupBy("norm").agg(F.min("id").alias("id")).select("id")


@query("ded_02_split_priority", f"with r as (select id, split, {NORM} as norm, case split when 'test' then 0 when 'dev' then 1 else 2 end as p from records where text is not null) select id, split, p = min(p) over (partition by norm) as stays from r")
def split_priority(spark, sf):
    """A text stays in the first of test, dev and private that has it."""
    p = F.when(F.col("split") == "test", 0).when(F.col("split") == "dev", 1).otherwise(2)
    r = proxy(spark, sf, "records").where("text is not null").select("id", "split", F.sha2(X.normalise(F.col("text")), 256).alias("norm"), p.alias("p"))
    best = r.groupBy("norm").agg(F.min("p").alias("best"))  # pre-aggregated: a common text is no window partition
    return r.join(best, "norm").select("id", "split", (F.col("p") == F.col("best")).alias("stays"))


SHARED = f"with recursive r as (select id, grp, {NORM} as norm from records where text is not null), e as (select distinct a.id as a, b.id as b from r a join r b on (a.norm = b.norm or a.grp = b.grp)), c(id, root) as (select id, id from r union select e.b, c.root from c join e on e.a = c.id where c.root < e.b) "


@query("ded_05_merged_groups", SHARED + "select id, min(root) as root from c group by id")
def merged_groups(spark, sf):
    """Groups merged where rows share a text or a group: stars to the smallest row of each value, then components."""
    r = proxy(spark, sf, "records").where("text is not null").select("id", "grp", F.sha2(X.normalise(F.col("text")), 256).alias("norm"))
    return components.groups_by_shared(r, "id", "norm", "grp")


@query(
    "ded_03_straddling_clusters",
    SHARED + ", g as (select id, min(root) as root from c group by id), s as (select root, count(distinct split) as n, bool_or(split = 'test') as has_test from g join records using (id) group by root) select g.id, case when s.n > 1 and s.has_test then 'test' else r.split end as split from g join s using (root) join records r on r.id = g.id",
)
def straddling_clusters(spark, sf):
    """Clusters that lie in several splits, test among them, move to test as a whole."""
    r = proxy(spark, sf, "records").where("text is not null").select("id", "grp", "split", F.sha2(X.normalise(F.col("text")), 256).alias("norm"))
    g = r.select("id", "split").join(components.groups_by_shared(r, "id", "norm", "grp"), "id")
    s = g.groupBy("root").agg(F.count_distinct("split").alias("n"), F.bool_or(F.col("split") == "test").alias("has_test"))
    return g.join(s, "root").select("id", F.when((F.col("n") > 1) & F.col("has_test"), "test").otherwise(F.col("split")).alias("split"))


@query(
    "ded_04_straddler_drop",
    SHARED + ", g as (select id, min(root) as root from c group by id), n as (select root, split, count(*) as n from g join records using (id) group by 1, 2), k as (select root, split from (select *, row_number() over (partition by root order by n desc, split desc) as rn from n) where rn = 1) select r.id from g join records r using (id) join k on k.root = g.root and k.split = r.split",
)
def straddler_drop(spark, sf):
    """Of each cluster the rows of its largest split stay."""
    r = proxy(spark, sf, "records").where("text is not null").select("id", "grp", "split", F.sha2(X.normalise(F.col("text")), 256).alias("norm"))
    g = r.select("id", "split").join(components.groups_by_shared(r, "id", "norm", "grp"), "id")
    n = g.groupBy("root", "split").agg(F.count(F.lit(1)).alias("n"))
    keep = n.groupBy("root").agg(F.max(F.struct("n", "split"))["split"].alias("split"))
    return g.join(keep, ["root", "split"]).select("id")


@query(
    "ded_08_group_names",
    SHARED + ", g as (select id, min(root) as root from c group by id) select root, 'g-' || substr(sha256(string_agg(distinct grp::varchar, ',' order by grp::varchar)), 1, 10) as name, count(*) as n from g join records using (id) group by root",
)
def group_names(spark, sf):
    """A stable name for each merged group, out of the names that it merges."""
    r = proxy(spark, sf, "records").where("text is not null").select("id", "grp", F.sha2(X.normalise(F.col("text")), 256).alias("norm"))
    g = r.select("id", "grp").join(components.groups_by_shared(r, "id", "norm", "grp"), "id")
    names = g.groupBy("root").agg(F.array_sort(F.collect_set(F.col("grp").cast("string"))).alias("names"), F.count(F.lit(1)).alias("n"))
    return names.select("root", F.concat(F.lit("g-"), F.substring(F.sha2(F.array_join("names", ","), 256), 1, 10)).alias("name"), "n")


@query(
    "ded_10_value_components",
    r"""with recursive v as (select distinct doc_id as id, unnest(regexp_extract_all(text, '[a-z0-9.]+@mail[0-9]+\.example\.com|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')) as value from documents), e as (select distinct a.id as a, b.id as b from v a join v b on a.value = b.value), c(id, root) as (select distinct id, id from v union select e.b, c.root from c join e on e.a = c.id where c.root < e.b) select id, min(root) as root from c group by id""",
)
def value_components(spark, sf):
    """Documents that share a mail or network address, directly or by others."""
    found = F.regexp_extract_all("text", F.lit(r"[a-z0-9.]+@mail[0-9]+\.example\.com|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), F.lit(0))
    v = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(found)).alias("value"))
    return components.groups_by_shared(v, "id", "value")


@query("ded_12_natural_group", "select id, case when source = 'src0' then concat('doc-', id % 50) when source in ('src1', 'src2') then concat(source, '-', grp) else concat('row-', id) end as natural_group from records")
def natural_group(spark, sf):
    s = lambda c: c.cast("string")
    g = F.when(F.col("source") == "src0", F.concat(F.lit("doc-"), s(F.col("id") % 50))).when(F.col("source").isin("src1", "src2"), F.concat_ws("-", "source", s(F.col("grp")))).otherwise(F.concat(F.lit("row-"), s(F.col("id"))))
    return proxy(spark, sf, "records").select("id", g.alias("natural_group"))


@query("ded_13_parent_group", "select page_id, regexp_extract(url, '^https?://([^/]+)', 1) as parent from pages")
def parent_group(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("parent"))


@query(
    "ded_14_one_per_group",
    "with t as (select event_type, count(*) as n from events group by 1) select user_id, event_id, event_type from (select e.user_id, e.event_id, e.event_type, row_number() over (partition by e.user_id order by t.n, md5(e.event_id::varchar)) as rn from events e join t using (event_type)) where rn = 1",
)
def one_per_group(spark, sf):
    """One event a user, of the rarest type it has, ties by a hash."""
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    t = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return latest_per_key(e.join(t, "event_type"), ["user_id"], F.asc("n"), F.md5(F.col("event_id").cast("string"))).select("user_id", "event_id", "event_type")


@query("ded_16_latest_label", "select row_id, arg_max(case when score >= 0.5 then 'yes' else 'no' end, seq) as label, count(distinct seq) as rounds, count(distinct config_hash) = 1 as one_labeller from ledger where system = 'alpha' and ok group by row_id")
def latest_label(spark, sf):
    led = proxy(spark, sf, "ledger").where("system = 'alpha' and ok")
    return led.groupBy("row_id").agg(
        F.max_by(F.when(F.col("score") >= 0.5, "yes").otherwise("no"), "seq").alias("label"), F.count_distinct("seq").alias("rounds"), (F.count_distinct("config_hash") == 1).alias("one_labeller")
    )


@query("agg_25_coverage_floors", "select subtask, expected, count(*) as n, count(distinct source) as n_sources, count(*) >= 30 and count(distinct source) >= 5 as covered from records where expected is not null group by 1, 2")
def coverage_floors(spark, sf):
    return proxy(spark, sf, "records").where("expected is not null").groupBy("subtask", "expected").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("n_sources"), ((F.count(F.lit(1)) >= 30) & (F.count_distinct("source") >= 5)).alias("covered")
    )


@query("agg_26_entity_floors", "select entity, count(*) filter (split = 'test') as test, count(*) filter (split = 'dev') as dev, count(*) filter (split = 'private') as private from (select split, unnest(list_filter([case when contains(text, '@') then 'email' end, case when regexp_matches(text, '[0-9]{3}\\.[0-9]') then 'ip' end, case when contains(text, '+1 (') then 'phone' end], lambda x: x is not null)) as entity from records) group by entity".replace("\\\\", "\\"))
def entity_floors(spark, sf):
    kinds = F.array_compact(F.array(F.when(F.col("text").contains("@"), "email"), F.when(F.col("text").rlike(r"[0-9]{3}\.[0-9]"), "ip"), F.when(F.col("text").contains("+1 ("), "phone")))
    e = proxy(spark, sf, "records").select("split", F.explode(kinds).alias("entity"))
    return e.groupBy("entity").agg(*[F.count_if(F.col("split") == s).alias(s) for s in ("test", "dev", "private")])


@query("agg_27_second_label_coverage", "select split, count(*) as n, round(avg((quality is not null)::int), 6) as share from records group by split")
def second_label_coverage(spark, sf):
    return proxy(spark, sf, "records").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("quality").isNotNull().cast("int")), 6).alias("share"))


@query(
    "agg_28_audit_counts",
    "select coalesce(split, '*') as split, coalesce(source, '*') as source, coalesce(licence, '*') as licence, count(*) as n, count(expected) as n_labelled from records group by grouping sets ((split), (source), (licence), (split, licence), ())",
)
def audit_counts(spark, sf):
    """All audit counts in one pass over the records."""
    g = proxy(spark, sf, "records").groupingSets([["split"], ["source"], ["licence"], ["split", "licence"], []], "split", "source", "licence").agg(F.count(F.lit(1)).alias("n"), F.count("expected").alias("n_labelled"))
    return g.select(*[F.coalesce(c, F.lit("*")).alias(c) for c in ("split", "source", "licence")], "n", "n_labelled")


@query("agg_30_release_counts", "select subtask, split, source, licence, expected, count(*) as n from records group by 1, 2, 3, 4, 5")
def release_counts(spark, sf):
    return proxy(spark, sf, "records").groupBy("subtask", "split", "source", "licence", "expected").agg(F.count(F.lit(1)).alias("n"))


@query("idn_01_row_ids", "select id, concat(lower('F1'), '-', source, '-', substr(sha1(concat(source, ':', id)), 1, 10)) as row_key from records")
def row_ids(spark, sf):
    return proxy(spark, sf, "records").select("id", F.concat_ws("-", F.lower(F.lit("F1")), "source", F.substring(F.sha1(F.concat("source", F.lit(":"), F.col("id").cast("string"))), 1, 10)).alias("row_key"))


@query("idn_02_dataset_hash", "select split, count(*) as n, sha256(string_agg(d, chr(10) order by d)) as digest from (select split, substr(sha256(concat_ws('|', id, subtask, source, coalesce(expected, ''), sha256(coalesce(text, '')))), 1, 16) as d from records) group by split")
def dataset_hash(spark, sf):
    """A hash of each split that doesn't depend on the order of its rows.

    Its definition hashes the sorted row digests one after the other, so one task reads the 16-digit digests of a
    split; these are sorted on disk and streamed, never held. See ``dataset_fingerprint`` for one that aggregates in parts.
    """
    d = F.substring(F.sha2(F.concat_ws("|", F.col("id").cast("string"), "subtask", "source", F.coalesce("expected", F.lit("")), F.sha2(F.coalesce("text", F.lit("")), 256)), 256), 1, 16)
    return joined_digest(proxy(spark, sf, "records").select("split", d.alias("d")), "split")


def joined_digest(rows, key):
    """(key, n, digest): SHA-256 of each key's sorted ``d``, joined by line ends, in bounded memory."""

    def run(batches):
        now, h, n = None, None, 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([n], pa.int64()), pa.array([h.hexdigest()], pa.string())], names=[key, "n", "digest"])
        for batch in batches:
            for k, part in itertools.groupby(zip(*(c.to_pylist() for c in batch.columns), strict=True), lambda x: x[0]):
                if h is None or k != now:
                    if h is not None:
                        yield made()
                    now, h, n = k, hashlib.sha256(), 0
                ds = [x[1] for x in part]
                h.update(("\n" * (n > 0) + "\n".join(ds)).encode())
                n += len(ds)
        if h is not None:
            yield made()

    return rows.select(key, "d").repartition(key).sortWithinPartitions(key, "d").mapInArrow(run, f"{key} string, n long, digest string")


@query("idn_03_dataset_fingerprint", "select split, count(*) as n, bit_xor(('0x' || substr(d, 1, 15))::bigint) as fingerprint, sum(('0x' || substr(d, 16, 8))::bigint)::bigint as checksum from (select split, sha256(concat_ws('|', id, source, coalesce(expected, ''), sha256(coalesce(text, '')))) as d from records) group by split")
def dataset_fingerprint(spark, sf):
    """An order-free fingerprint that aggregates in parts: the form for any size."""
    d = F.sha2(F.concat_ws("|", F.col("id").cast("string"), "source", F.coalesce("expected", F.lit("")), F.sha2(F.coalesce("text", F.lit("")), 256)), 256)
    r = proxy(spark, sf, "records").select("split", d.alias("d"))
    return r.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.conv(F.substring("d", 1, 15), 16, 10).cast("long")).alias("fingerprint"), F.sum(F.conv(F.substring("d", 16, 8), 16, 10).cast("long")).alias("checksum"))


@query("snk_02_manifest", "select subtask, split, count(*) as n, min(id) as first_id, max(id) as last_id from records where expected is not null group by 1, 2")
def manifest(spark, sf):
    """A partitioned write, and what each of its parts holds when it is read again."""
    folder = shared_folder(spark, "parts")
    proxy(spark, sf, "records").where("expected is not null").select("id", "subtask", "split").write.partitionBy("subtask", "split").parquet(folder)
    return spark.read.parquet(folder).groupBy("subtask", "split").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("snk_03_routing", "select case when exclude_reason is not null then 'dropped' when expected is null then 'review' when split = 'private' then 'private' else 'public' end as route, count(*) as n from records group by 1")
def routing(spark, sf):
    """One write routes every row to its folder; the counts are of what is read from them."""
    route = F.when(F.col("exclude_reason").isNotNull(), "dropped").when(F.col("expected").isNull(), "review").when(F.col("split") == "private", "private").otherwise("public")
    folder = shared_folder(spark, "routes")
    proxy(spark, sf, "records").select("id", "text", route.alias("route")).write.partitionBy("route").parquet(folder)
    return spark.read.parquet(folder).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query("snk_04_release_package", "select id, case when licence in ('cc-by', 'mit') then text end as text, sha256(text) as digest from records where split <> 'private'")
def release_package(spark, sf):
    """Text where the licence lets it out, ids and digests otherwise: written, and read as a reader would."""
    folder = shared_folder(spark, "package")
    out = proxy(spark, sf, "records").where("split <> 'private'").select("id", F.when(F.col("licence").isin("cc-by", "mit"), F.col("text")).alias("text"), F.sha2("text", 256).alias("digest"))
    out.write.parquet(folder)
    return spark.read.parquet(folder)


@query("snk_07_public_ledger", "select l.row_id, l.system, l.seq from ledger l where l.row_id in (select id from records where split <> 'private')")
def public_ledger(spark, sf):
    public = proxy(spark, sf, "records").where("split <> 'private'").select(F.col("id").alias("row_id"))
    folder = shared_folder(spark, "public-ledger")
    proxy(spark, sf, "ledger").select("row_id", "system", "seq").join(public, "row_id", "left_semi").write.parquet(folder)
    return spark.read.parquet(folder)


@query("snk_08_examined_append", "select distinct row_id from ledger where system = 'beta' and row_id not in (select row_id from ledger where system = 'alpha' and row_id % 2 = 0)")
def examined_append(spark, sf):
    """Ids appended to a list that has some of them: what the list then has more."""
    led, folder = proxy(spark, sf, "ledger").select("row_id", "system"), shared_folder(spark, "examined")
    before = led.where("system = 'alpha' and row_id % 2 = 0").select("row_id").distinct()
    examined = VersionedTable(spark, folder)
    examined.append(before, ["row_id"])
    examined.append(led.where("system = 'beta'").select("row_id"), ["row_id"])
    return examined.read().exceptAll(before)


@query("set_01_union_of_ids", "select id, string_agg(role, ',' order by role) as roles from (select distinct doc_id as id, 'label' as role from labels union select distinct item_id, 'benchmark' from benchmark union select distinct conv_id, 'conversation' from conversations) group by id")
def union_of_ids(spark, sf):
    u = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.lit("label").alias("role")).union(table(spark, sf, "benchmark").select("item_id", F.lit("benchmark"))).union(table(spark, sf, "conversations").select("conv_id", F.lit("conversation")))
    return u.distinct().groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("role")), ",").alias("roles"))


@query("set_02_minus", "select doc_id from labels where quality = 1 except select doc_id from labels where toxic = 1")
def minus(spark, sf):
    t = table(spark, sf, "labels")
    return t.where("quality = 1").select("doc_id").subtract(t.where("toxic = 1").select("doc_id"))


@query("set_03_missing", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def missing(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("set_04_symmetric_difference", "(select row_id, 'only alpha' as side from latest where system = 'alpha' and ok except all select row_id, 'only alpha' from latest where system = 'beta' and ok) union all (select row_id, 'only beta' from latest where system = 'beta' and ok except all select row_id, 'only beta' from latest where system = 'alpha' and ok)")
def symmetric_difference(spark, sf):
    led = proxy(spark, sf, "latest").where("ok")
    a, b = led.where("system = 'alpha'").select("row_id"), led.where("system = 'beta'").select("row_id")
    return a.exceptAll(b).withColumn("side", F.lit("only alpha")).union(b.exceptAll(a).withColumn("side", F.lit("only beta")))


@query("set_05_private_ids", "select id from records where split = 'private' union (select id from records where exclude_reason is not null except select id from records where split = 'test')")
def private_ids(spark, sf):
    r = proxy(spark, sf, "records").select("id", "split", "exclude_reason")
    return r.where("split = 'private'").select("id").union(r.where("exclude_reason is not null").select("id").subtract(r.where("split = 'test'").select("id"))).distinct()
