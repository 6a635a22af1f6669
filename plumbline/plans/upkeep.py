"""Upkeep of a data set between editions: decisions, purges, leaks, rehydration, keys that follow their rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import similarity
from plumbline.operators.matching import found_in
from plumbline.plans.catalog import proxy, query, table
from plumbline.plans.curation import KINDS_SQL, WORDS_SQL, kinds
from plumbline.plans.records import NORM
from plumbline.session import cut_lineage, written
from plumbline.streaming.ledger import shared_folder

def digest(c):
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def either(*parts: DataFrame) -> DataFrame:
    """The distinct ids of several one-column tables."""
    return reduce(lambda a, b: a.union(b), parts).distinct()


def normal(r: DataFrame) -> DataFrame:
    return r.withColumn("norm", F.sha2(X.normalise(F.col("text")), 256))


# --- decisions and reviews ------------------------------------------------------------------------------------------------

@query("xtr_01_examined_minus_cleared", "select doc_id from labels where quality = 0 except select doc_id from labels where doc_id % 10 = 3 and toxic = 0")
def examined_minus_cleared(spark, sf):
    t = table(spark, sf, "labels")
    return t.where("quality = 0").select("doc_id").subtract(t.where("doc_id % 10 = 3 and toxic = 0").select("doc_id"))


@query("xtr_02_reference_override", "select r.id, coalesce(a.label, r.expected) as label, coalesce(a.subtask, r.subtask) as subtask, a.id is not null as overridden from records r left join (select doc_id as id, case when toxic = 1 then 'no' else 'yes' end as label, case when doc_id % 2 = 0 then 'moved' end as subtask from labels where doc_id % 8 = 0) a on a.id = r.id")
def reference_override(spark, sf):
    """A reference's label replaces the source's, and moves the row to another job where it says so."""
    a = table(spark, sf, "labels").where("doc_id % 8 = 0").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "no").otherwise("yes").alias("label"), F.when(F.col("doc_id") % 2 == 0, "moved").alias("to"), F.lit(True).alias("hit"))
    r = proxy(spark, sf, "records").select("id", "expected", "subtask").join(a, "id", "left")
    return r.select("id", F.coalesce("label", "expected").alias("label"), F.coalesce("to", "subtask").alias("subtask"), F.col("hit").isNotNull().alias("overridden"))


@query("xtr_03_review_status", "select id, case when quality is null then 'unreviewed' when exclude_reason is not null then 'disputed' when id % 3 = 0 then 'human' else 'reference' end as status from records")
def review_status(spark, sf):
    status = F.when(F.col("quality").isNull(), "unreviewed").when(F.col("exclude_reason").isNotNull(), "disputed").when(F.col("id") % 3 == 0, "human").otherwise("reference")
    return proxy(spark, sf, "records").select("id", status.alias("status"))


@query("xtr_04_public_population", "select subtask, count(*) as n from records where split <> 'private' and id in (select doc_id from labels where quality = 1) group by 1")
def public_population(spark, sf):
    """Built public rows that are among the candidates."""
    c = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return proxy(spark, sf, "records").where("split <> 'private'").join(c, "id", "left_semi").groupBy("subtask").agg(F.count(F.lit(1)).alias("n"))


@query("xtr_06_label_rounds", "select row_id, arg_max(score >= 0.5, seq) as latest, count(*) as rounds, string_agg(case when score >= 0.5 then 'yes' else 'no' end, ',' order by seq) as history, count(*) > count(distinct seq) as twice_in_a_round from ledger where system = 'gamma' and score is not null group by 1")
def label_rounds(spark, sf):
    """The label of the latest round with the earlier ones kept; two labels in one round are an error to report."""
    led = proxy(spark, sf, "ledger").where("system = 'gamma' and score is not null").select("row_id", "seq", (F.col("score") >= 0.5).alias("y"))
    g = led.groupBy("row_id").agg(F.max_by("y", "seq").alias("latest"), F.count(F.lit(1)).alias("rounds"), F.array_sort(F.collect_list(F.struct("seq", "y"))).alias("h"), F.count_distinct("seq").alias("d"))
    said = F.array_join(F.transform("h", lambda x: F.when(x["y"], "yes").otherwise("no")), ",")
    return g.select("row_id", "latest", "rounds", said.alias("history"), (F.col("rounds") > F.col("d")).alias("twice_in_a_round"))


@query("xtr_07_bare_places", f"select id, array_to_string(list_filter({KINDS_SQL}, lambda x: not (x = 'phone' and not regexp_matches(text, '\\+1 \\([0-9]{{3}}\\) [0-9]'))), ',') as kinds from records where len({KINDS_SQL}) > 0")
def bare_places(spark, sf):
    """A kind is taken off a row where none of its spans is the whole thing."""
    r = proxy(spark, sf, "records").select("id", "text", kinds(F.col("text")).alias("kinds")).where(F.size("kinds") > 0)
    whole = F.col("text").rlike(r"\+1 \([0-9]{3}\) [0-9]")
    return r.select("id", F.array_join(F.filter("kinds", lambda x: ~((x == "phone") & ~whole)), ",").alias("kinds"))


DECIDED = "select doc_id as id, case doc_id % 4 when 0 then 'flip' when 1 then 'drop' else 'keep' end as decision from labels"


@query("xtr_08_decision_import", f"select r.subtask, r.split, d.decision, count(*) as n, count(*) filter (d.decision = 'flip') as corrections, count(*) filter (d.decision = 'drop') as exclusions from ({DECIDED}) d join records r on r.id = d.id group by 1, 2, 3")
def decision_import(spark, sf):
    """Decisions sorted into corrections and exclusions, counted by job and split."""
    d = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 == 0, "flip").when(F.col("doc_id") % 4 == 1, "drop").otherwise("keep").alias("decision"))
    return d.join(proxy(spark, sf, "records").select("id", "subtask", "split"), "id").groupBy("subtask", "split", "decision").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("decision") == "flip").alias("corrections"), F.count_if(F.col("decision") == "drop").alias("exclusions")
    )


@query("xtr_14_review_queue", f"select d.decision as question, count(*) as n, min(d.id) as first_id from ({DECIDED}) d where d.id not in (select doc_id from labels where toxic = 1) group by 1")
def review_queue(spark, sf):
    """Open questions: those that no resolution answers, by kind."""
    d = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "toxic", F.when(F.col("doc_id") % 4 == 0, "flip").when(F.col("doc_id") % 4 == 1, "drop").otherwise("keep").alias("question"))
    return d.select("id", "question").join(d.where("toxic = 1").select("id"), "id", "left_anti").groupBy("question").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("xtr_15_validated_import", "with d as (select doc_id as id, case when doc_id % 17 = 0 then 'maybe' when toxic = 1 then 'yes' else 'no' end as label from labels union all select -5, 'yes') select coalesce(case when r.id is null then 'unknown row' end, case when d.label not in ('yes', 'no') then 'bad label' end, case when r.split = 'private' then 'private row' end, 'accepted') as outcome, count(*) as n from d left join records r on r.id = d.id group by 1")
def validated_import(spark, sf):
    """Every decision is checked before any is written: what is wrong with each, and how many could be taken."""
    t = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 17 == 0, "maybe").when(F.col("toxic") == 1, "yes").otherwise("no").alias("label"))
    d = t.union(spark.createDataFrame([(-5, "yes")], "id long, label string"))
    j = d.join(proxy(spark, sf, "records").select("id", "split", F.lit(True).alias("known")), "id", "left")
    outcome = F.coalesce(F.when(F.col("known").isNull(), "unknown row"), F.when(~F.col("label").isin("yes", "no"), "bad label"), F.when(F.col("split") == "private", "private row"), F.lit("accepted"))
    return j.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("xtr_11_sample_freshness", "with s as (select id, sha256(case when id % 71 = 0 then 'older' else coalesce(text, '') end) as h from records where id % 5 = 0) select count(*) as sampled, count(*) filter (s.h <> sha256(coalesce(r.text, ''))) as changed, bool_and(s.h = sha256(coalesce(r.text, ''))) as fresh from s join records r on r.id = s.id")
def sample_freshness(spark, sf):
    """Whether every sampled row is still what it was when it was sampled."""
    r = proxy(spark, sf, "records").select("id", F.coalesce("text", F.lit("")).alias("text"))
    s = r.where("id % 5 = 0").select("id", F.sha2(F.when(F.col("id") % 71 == 0, "older").otherwise(F.col("text")), 256).alias("h"))
    j = s.join(r.select("id", F.sha2("text", 256).alias("now")), "id")
    return j.agg(F.count(F.lit(1)).alias("sampled"), F.count_if(F.col("h") != F.col("now")).alias("changed"), F.bool_and(F.col("h") == F.col("now")).alias("fresh"))


# --- public and private ----------------------------------------------------------------------------------------------------

@query("xtr_09_published_ids", "select id from records where split <> 'private' and licence <> 'unknown' union select row_id from ledger where split <> 'private' union select doc_id from labels where quality = 1 and doc_id % 2 = 0")
def published_ids(spark, sf):
    """Every id that was ever published, wherever."""
    a = proxy(spark, sf, "records").where("split <> 'private' and licence <> 'unknown'").select("id")
    return either(a, proxy(spark, sf, "ledger").where("split <> 'private'").select("row_id"), table(spark, sf, "labels").where("quality = 1 and doc_id % 2 = 0").select("doc_id"))


@query("xtr_10_moves_by_split", "select split as from_split, case when id % 6 = 0 then 'test' else split end as to_split, count(*) as n from records where id % 3 = 0 group by 1, 2")
def moves_by_split(spark, sf):
    """Annotated moves of near copies, counted by where from and where to."""
    r = proxy(spark, sf, "records").where("id % 3 = 0")
    return r.groupBy(F.col("split").alias("from_split"), F.when(F.col("id") % 6 == 0, "test").otherwise(F.col("split")).alias("to_split")).agg(F.count(F.lit(1)).alias("n"))


@query("xtr_12_parts_overlap", f"with r as (select id, grp, split = 'private' as priv, {NORM} as norm from records where text is not null) select 'text' as kind, count(*) as n from r where priv and norm in (select norm from r where not priv) union all select 'group', count(*) from r where priv and grp in (select grp from r where not priv) union all select 'text inside', count(*) from (select norm from r where priv group by 1 having count(*) > 1)")
def parts_overlap(spark, sf):
    """What the private part shares with the public one, and texts that it holds twice."""
    r = normal(proxy(spark, sf, "records").where("text is not null")).select("id", "grp", "norm", (F.col("split") == "private").alias("priv"))
    priv, pub = r.where("priv"), r.where("not priv")
    counts = [(k, priv.join(pub.select(c).distinct(), c, "left_semi")) for k, c in (("text", "norm"), ("group", "grp"))] + [("text inside", priv.groupBy("norm").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))]
    return reduce(DataFrame.union, [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, d in counts])


@query("xtr_16_physical_split", "select case when split = 'private' then 'private' else 'public' end as part, count(*) as n, 0::bigint as misplaced from records group by 1")
def physical_split(spark, sf):
    """Two folders, one of which may leave: what each holds when it is read by itself."""
    r, folder = proxy(spark, sf, "records").select("id", "text", "split"), shared_folder(spark, "parts")
    parts = {"private": F.col("split") == "private", "public": F.col("split") != "private"}
    out = []
    for name, keep in parts.items():
        r.where(keep).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}").agg(F.count(F.lit(1)).alias("n"), F.count_if(~keep).alias("misplaced")).select(F.lit(name).alias("part"), "n", "misplaced"))
    return out[0].union(out[1])


PURGED = "select doc_id from labels where quality = 0 and toxic = 1"


@query("xtr_17_purge", f"select 'records' as place, count(*) as rows, count(*) filter (id in ({PURGED})) as purged from records union all select 'ledger', count(*), count(*) filter (row_id in ({PURGED})) from ledger union all select 'labels', count(*), count(*) filter (doc_id in ({PURGED})) from labels")
def purge(spark, sf):
    """Ids that must go, taken out of every table that has them, and how many rows each lost."""
    t = table(spark, sf, "labels")
    gone = t.where("quality = 0 and toxic = 1").select(F.col("doc_id").alias("key"))
    out = []
    for name, rows in (("records", proxy(spark, sf, "records").select(F.col("id").alias("key"))), ("ledger", proxy(spark, sf, "ledger").select(F.col("row_id").alias("key"))), ("labels", t.select(F.col("doc_id").alias("key")))):
        left = rows.join(gone, "key", "left_anti").agg(F.count(F.lit(1)).alias("left"))
        out.append(rows.agg(F.count(F.lit(1)).alias("rows")).crossJoin(left).select(F.lit(name).alias("place"), "rows", (F.col("rows") - F.col("left")).alias("purged")))  # one row
    return reduce(DataFrame.union, out)


@query(
    "xtr_18_public_notes",
    """with l as (select doc_id, i as pos, string_split(text, chr(10))[i] as line from (select doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents where doc_id % 10 < 8 and text is not null)),
    p as (select distinct string_split(text, chr(10))[i] as line from (select text, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents where doc_id % 10 >= 8 and text is not null)), q as (select line from p where length(line) >= 20)
    select doc_id, count(*) filter (line in (select line from q)) as redacted, md5(string_agg(case when line in (select line from q) then '<private>' else line end, chr(10) order by pos)) as public_text from l group by 1""",
)
def public_notes(spark, sf):
    """Public texts with the lines that private ones hold too struck out, the rest in its order."""
    d = table(spark, sf, "documents").where("text is not null")
    lines = lambda x: x.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    quoted = lines(d.where("doc_id % 10 >= 8")).where(F.length("line") >= 20).select("line").distinct()
    pub = d.where("doc_id % 10 < 8")
    hit = lines(pub).join(quoted, "line", "left_semi").groupBy("doc_id").agg(F.collect_set("pos").alias("hit"))  # positions in one text
    new = F.transform(F.split("text", "\n", -1), lambda x, k: F.when(F.array_contains(F.coalesce("hit", F.array().cast("array<int>")), k), "<private>").otherwise(x))
    return pub.join(hit, "doc_id", "left").select("doc_id", F.coalesce(F.size("hit"), F.lit(0)).cast("long").alias("redacted"), F.md5(F.array_join(new, "\n")).alias("public_text"))


@query("xtr_19_private_slice", "select id from records where split = 'private' union select doc_id from labels where doc_id % 11 = 0 union select row_id from ledger where split = 'private'")
def private_slice(spark, sf):
    return either(proxy(spark, sf, "records").where("split = 'private'").select("id"), table(spark, sf, "labels").where("doc_id % 11 = 0").select("doc_id"), proxy(spark, sf, "ledger").where("split = 'private'").select("row_id"))


#: A field value: a line of a row's text, white space collapsed, in lower case. Values that this many rows share name none,
#: and a value under this many characters is looked for as a whole value only.
BOILERPLATE_ROWS, SHORT_NEEDLE = 25, 40
VALUES = r"select distinct id, split, licence, value from (select id, split, licence, lower(trim(regexp_replace(unnest(string_split(text, chr(10))), '[ \t\n\x0b\f\r]+', ' ', 'g'))) as value from records where text is not null) where value <> ''"
NEEDLES = f"""v as materialized ({VALUES}), shared as (select value from v group by 1 having count(*) >= {BOILERPLATE_ROWS}), cleared as (select distinct value from v where split <> 'private' and licence <> 'unknown'),
  needles as materialized (select 'private_id' as kind, id as key, 'row-' || id as value from records where split = 'private'
    union all select 'private_text', id, value from v where split = 'private' and value not in (select value from shared)
    union all select 'withheld_text', id, value from v where split <> 'private' and licence = 'unknown' and value not in (select value from shared) and value not in (select value from cleared))"""
#: The files that are looked through: public rows of cleared licences; some name a private row.
FILES = r"select id as file, coalesce(text, '') || case when id % 50 = 1 then chr(10) || 'See row-' || (id - id % 10 + 9) || '.' else '' end as body from records where split <> 'private' and licence <> 'unknown'"


def field_values(rows, *keep):
    """``keep`` and each different value of a row's text."""
    line = F.trim(F.regexp_replace(F.col("line"), X.SPACES, " "))
    return rows.select(*keep, F.explode(F.split("text", "\n", -1)).alias("line")).select(*keep, F.lower(line).alias("value")).where("value <> ''").distinct()


def needles_of(spark, sf):
    """(kind, key, value) of all that no public file may hold: ids and values of private rows, and values of rows whose
    licence isn't cleared, unless a cleared row has the value too; values that many rows share are boilerplate."""
    r = proxy(spark, sf, "records")
    v = cut_lineage(field_values(r.where("text is not null"), "id", "split", "licence"))
    shared = v.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("split") != "private") & (F.col("licence") != "unknown")).alias("cleared"))
    private = F.col("split") == "private"
    kept = v.where(private | (F.col("licence") == "unknown")).join(shared, "value").where((F.col("n") < BOILERPLATE_ROWS) & (private | ~F.col("cleared")))
    ids = r.where("split = 'private'").select(F.lit("private_id").alias("kind"), F.col("id").alias("key"), F.concat(F.lit("row-"), F.col("id").cast("string")).alias("value"))
    return ids.union(kept.select(F.when(private, "private_text").otherwise("withheld_text"), "id", "value"))


@query("xtr_20_leak_needles", f"with {NEEDLES} select kind, key, count(*) as needles, sum(length(value))::bigint as chars from needles group by 1, 2")
def leak_needles(spark, sf):
    """What must never be in a public file, by kind and row."""
    return needles_of(spark, sf).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("needles"), F.sum(F.length("value")).alias("chars"))


@query(
    "xtr_20_leak_scan",
    f"""with {NEEDLES}, f as ({FILES}), h as (select file, lower(trim(regexp_replace(body, '[ \t\n\x0b\f\r]+', ' ', 'g'))) as hay, body from f),
    l as (select distinct file, lower(trim(regexp_replace(unnest(string_split(body, chr(10))), '[ \t\n\x0b\f\r]+', ' ', 'g'))) as value from f),
    big as (select distinct value from needles where kind <> 'private_id' and length(value) >= {SHORT_NEEDLE}),
    m as (select h.file, big.value from h join big on contains(h.hay, big.value) union select l.file, l.value from l where length(value) < {SHORT_NEEDLE} and value <> ''
      union select file, unnest(regexp_extract_all(body, 'row-[0-9]+')) from f)
    select m.file, n.kind, count(distinct n.key) as rows_leaked, min(n.key) as first_row from m join needles n on n.value = m.value and (n.kind = 'private_id') = regexp_full_match(m.value, 'row-[0-9]+') group by 1, 2""",
)
def leak_scan(spark, sf):
    """Public files that hold a needle: ids as whole words, short values as whole lines, longer ones anywhere in the text, in
    one pass of an automaton over the files."""
    needles = cut_lineage(needles_of(spark, sf))
    f = proxy(spark, sf, "records").where("split <> 'private' and licence <> 'unknown'")
    named = F.when(F.col("id") % 50 == 1, F.concat(F.lit("\nSee row-"), (F.col("id") - F.col("id") % 10 + 9).cast("string"), F.lit("."))).otherwise("")
    f = f.select("id", F.concat(F.coalesce("text", F.lit("")), named).alias("text"))
    texts = needles.where("kind <> 'private_id'")
    big = texts.where(F.length("value") >= SHORT_NEEDLE).select(F.col("value").alias("needle")).distinct().withColumn("needle_id", F.lit(0))
    hay = f.select("id", F.lower(F.trim(F.regexp_replace("text", X.SPACES, " "))).alias("text"))
    held = found_in(hay, big, SHORT_NEEDLE).select("id", F.col("needle").alias("value"), F.lit(False).alias("by_id"))
    lines = field_values(f, "id").where(F.length("value") < SHORT_NEEDLE).select("id", "value", F.lit(False))
    ids = f.select("id", F.explode(F.regexp_extract_all("text", F.lit("row-[0-9]+"), F.lit(0))), F.lit(True))
    met = held.union(lines).union(ids).join(needles.withColumn("by_id", F.col("kind") == "private_id"), ["value", "by_id"])
    return met.groupBy(F.col("id").alias("file"), "kind").agg(F.count_distinct("key").alias("rows_leaked"), F.min("key").alias("first_row"))


@query("xtr_23_private_handles", "select value from (select distinct unnest(regexp_extract_all(text, '[a-z0-9.]+@[a-z0-9]+\\.[a-z.]+')) as value from records where split = 'private') except select unnest(regexp_extract_all(text, '[a-z0-9.]+@[a-z0-9]+\\.[a-z.]+')) from records where split <> 'private'")
def private_handles(spark, sf):
    """Addresses that only private rows have."""
    v = proxy(spark, sf, "records").select("split", F.explode(F.regexp_extract_all("text", F.lit(r"[a-z0-9.]+@[a-z0-9]+\.[a-z.]+"), F.lit(0))).alias("value"))
    return v.where("split = 'private'").select("value").subtract(v.where("split <> 'private'").select("value"))


# --- rehydration and keys --------------------------------------------------------------------------------------------------

@query("xtr_21_rehydrated", "select case when s.doc_id is null then 'no source' when sha256(coalesce(s.text, '')) = sha256(coalesce(r.text, '')) then 'restored' else 'digest differs' end as outcome, count(*) as n from records r left join (select doc_id, case when doc_id % 13 = 0 then 'edited upstream' else text end as text from documents where doc_id % 17 <> 0) s on s.doc_id = r.id group by 1")
def rehydrated(spark, sf):
    """Texts fetched again for rows that have a digest only: accepted only where the digest is right."""
    rows = proxy(spark, sf, "records").select("id", digest(F.col("text")).alias("want"))
    upstream = table(spark, sf, "documents").where("doc_id % 17 <> 0").select(F.col("doc_id").alias("id"), F.coalesce(F.when(F.col("doc_id") % 13 == 0, "edited upstream").otherwise(F.col("text")), F.lit("")).alias("got"), F.lit(True).alias("there"))
    j = rows.join(upstream, "id", "left")
    outcome = F.when(F.col("there").isNull(), "no source").when(X.restore(F.col("want"), F.col("got")).isNotNull(), "restored").otherwise("digest differs")
    return j.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("xtr_27_published_restored", "select r.id, sha256(coalesce(d.text, '')) = sha256(coalesce(r.text, '')) as verified from records r join (select doc_id, case when doc_id % 61 = 0 then '' else text end as text from documents) d on d.doc_id = r.id where r.split <> 'private'")
def published_restored(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), digest(F.when(F.col("doc_id") % 61 == 0, "").otherwise(F.col("text"))).alias("got"))
    r = proxy(spark, sf, "records").where("split <> 'private'").select("id", digest(F.col("text")).alias("want"))
    return r.join(d, "id").select("id", (F.col("got") == F.col("want")).alias("verified"))


@query("xtr_28_parity", "select side, count(*) as n from ((select id, 'only build' as side from (select id, coalesce(text, '') as t from records except all select doc_id, case when doc_id % 67 = 0 then 'x' else coalesce(text, '') end from documents) union all select id, 'only canonical' from (select doc_id as id, case when doc_id % 67 = 0 then 'x' else coalesce(text, '') end as t from documents except all select id, coalesce(text, '') from records))) group by 1")
def parity(spark, sf):
    """Canonical files against the build that made them, row for row both ways: written, read, compared."""
    folder = shared_folder(spark, "canonical")
    table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 67 == 0, "x").otherwise(F.coalesce("text", F.lit(""))).alias("t")).write.parquet(folder)
    a, b = proxy(spark, sf, "records").select("id", F.coalesce("text", F.lit("")).alias("t")), spark.read.parquet(folder)
    both = a.exceptAll(b).select(F.lit("only build").alias("side")).union(b.exceptAll(a).select(F.lit("only canonical")))
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("xtr_29_load_check", "select split, count(*) as want, count(*) - count(*) filter (id % 83 = 0) as got, count(*) filter (id % 83 = 0) = 0 as matches from records group by 1")
def load_check(spark, sf):
    """Sizes of loaded splits against those that were promised."""
    r = proxy(spark, sf, "records").select("id", "split")
    got = r.where("id % 83 <> 0").groupBy("split").agg(F.count(F.lit(1)).alias("got"))
    return r.groupBy("split").agg(F.count(F.lit(1)).alias("want")).join(got, "split", "left").select("split", "want", F.coalesce("got", F.lit(0)).alias("got"), (F.col("want") == F.coalesce("got", F.lit(0))).alias("matches"))


@query("xtr_22_pinned_rows", "with m as (select page_id as file, unnest(regexp_extract_all(url, '[0-9]+'))::hugeint as id from pages where url is not null) select r.id, min(m.file) as named_in, count(distinct m.file) as places from records r join m on m.id = r.id where r.split <> 'private' group by 1")
def pinned_rows(spark, sf):
    """Public rows that are named somewhere else, here by a number in a url: the first place and how many there are."""
    named = F.explode(F.regexp_extract_all("url", F.lit("[0-9]+"), F.lit(0))).alias("x")
    m = table(spark, sf, "pages").where("url is not null").select(F.col("page_id").alias("file"), named).select("file", F.expr("try_cast(x as long)").alias("id")).where("id is not null")
    first = m.groupBy("id").agg(F.min("file").alias("named_in"), F.count_distinct("file").alias("places"))
    return proxy(spark, sf, "records").where("split <> 'private'").select("id").join(first, "id")


@query("xtr_24_rekeyed", f"with o as (select id + 1000000 as old_id, {NORM} as norm from records where text is not null and id % 3 = 0), n as (select {NORM} as norm, min(id) as new_id from records where text is not null group by 1) select old_id, new_id from o join n on n.norm = o.norm")
def rekeyed(spark, sf):
    """Held-out rows under old ids get the id that their text has now."""
    r = normal(proxy(spark, sf, "records").where("text is not null")).select("id", "norm")
    now = r.groupBy("norm").agg(F.min("id").alias("new_id"))
    return r.where("id % 3 = 0").select((F.col("id") + 1000000).alias("old_id"), "norm").join(now, "norm").select("old_id", "new_id")


@query("xtr_32_seen_ids", "select id, string_agg(distinct place, ',' order by place) as places from (select row_id as id, 'ledger' as place from ledger where seq = 1 union all select doc_id, 'labels' from labels where quality = 0 union all select i::bigint, 'conversations' from (select unnest(regexp_extract_all(text, '\\b[0-9]{2,6}\\b')) as i from conversations where text is not null)) group by 1")
def seen_ids(spark, sf):
    """Ids that ledgers hold or that texts name, with every place that has them."""
    named = F.explode(F.regexp_extract_all("text", F.lit(r"\b[0-9]{2,6}\b"), F.lit(0)))
    c = table(spark, sf, "conversations").where("text is not null").select(named.alias("x")).select(F.col("x").cast("long").alias("id"), F.lit("conversations").alias("place"))
    u = proxy(spark, sf, "ledger").where("seq = 1").select(F.col("row_id").alias("id"), F.lit("ledger").alias("place")).union(table(spark, sf, "labels").where("quality = 0").select("doc_id", F.lit("labels"))).union(c)
    return u.distinct().groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("place")), ",").alias("places"))


@query("xtr_31_row_group", "select id, case when source = 'src0' then concat('parent-', id // 10) when coalesce(text, '') <> '' and source = 'src1' then concat('text-', substr(sha1(lower(text)), 1, 8)) else concat('g-', grp) end as row_group from records")
def row_group(spark, sf):
    """A row's group by the rule of its source: its parent, its text, or the group that it came with."""
    g = F.when(F.col("source") == "src0", F.concat(F.lit("parent-"), F.floor(F.col("id") / 10).cast("string")))
    g = g.when((F.coalesce("text", F.lit("")) != "") & (F.col("source") == "src1"), F.concat(F.lit("text-"), F.substring(F.sha1(F.lower("text")), 1, 8)))
    return proxy(spark, sf, "records").select("id", g.otherwise(F.concat(F.lit("g-"), F.col("grp").cast("string"))).alias("row_group"))


# --- overlaps with training data -------------------------------------------------------------------------------------------

@query("xtr_25_training_overlap", f"with c as (select id, {NORM} as norm from records where text is not null and split = 'test'), t as (select {NORM} as norm from records where text is not null and split = 'dev'), m as (select id from c where norm in (select norm from t)) select id, id in (select doc_id from labels where quality = 0) as known from m")
def training_overlap(spark, sf):
    """Candidates whose text is in a training set, and whether they are excluded already."""
    r = normal(proxy(spark, sf, "records").where("text is not null")).select("id", "split", "norm")
    m = r.where("split = 'test'").join(r.where("split = 'dev'").select("norm").distinct(), "norm", "left_semi").select("id")
    return m.join(table(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("id"), F.lit(True).alias("k")), "id", "left").select("id", F.col("k").isNotNull().alias("known"))


def grams(t: str, key: str, n: int, where: str = "true") -> str:
    return f"select distinct id, total, array_to_string(w[i:i + {n - 1}], ' ') as gram from (select id, w, len(w) - {n - 1} as total, unnest(range(1, len(w) - {n - 1} + 1)) as i from (select {key} as id, {WORDS_SQL.format(t='text')} as w from {t} where {where}) where len(w) >= {n})"


#: Words of a vendor's run, and the fewest words of a short text that counts if it equals a vendor's text.
WINDOW, MIN_EXACT = 10, 4
#: A vendor's file is a fifth of the benchmark.
VENDOR_FILE = "'file' || (item_id % 5)"


@query(
    "xtr_26_vendor_scan",
    f"""with w as (select id, split, {WORDS_SQL.format(t='text')} as w from records where text is not null), d as ({grams('documents', 'doc_id', WINDOW)}), t as (select id, count(distinct gram) as total from d group by 1),
    b as (select distinct {VENDOR_FILE.replace('item_id', 'id')} as file, gram from ({grams('benchmark', 'item_id', WINDOW)})), m as (select d.id, b.file, count(distinct d.gram) as windows from d join b using (gram) group by 1, 2),
    u as (select distinct {VENDOR_FILE} as file, {WORDS_SQL.format(t='text')} as w from benchmark), x as (select w.id, u.file from w join u on w.w = u.w where len(w.w) between {MIN_EXACT} and {WINDOW - 1}),
    a as (select id, file, 'window' as kind, windows, round(windows / total::double, 3) as coverage from m join t using (id) union all select id, file, 'exact', 0, 1.0 from x)
    select a.id, r.split, a.file, a.kind, a.windows, a.coverage, case when r.split = 'dev' then 'stays, flagged' when r.split = 'private' then 'excluded, private list' else 'excluded, public list' end as route from a join records r on r.id = a.id""",
)
def vendor_scan(spark, sf):
    """Rows that hold runs of words of a vendor's file, with the share of their own runs, or that are one of its short
    texts. What a match means follows from the row: dev rows stay, others are excluded in the list that may name them."""
    file = lambda c: F.concat(F.lit("file"), (F.col(c) % 5).cast("string"))
    r = proxy(spark, sf, "records")
    d, b = similarity.ngram_rows(r.where("text is not null"), "id", WINDOW), similarity.ngram_rows(table(spark, sf, "benchmark"), "item_id", WINDOW)
    m = d.join(b.select(file("id").alias("file"), "gram").distinct(), "gram").groupBy("id", "file", "total").agg(F.count(F.lit(1)).alias("windows"))
    m = m.select("id", "file", F.lit("window").alias("kind"), "windows", F.round(F.col("windows") / F.col("total"), 3).alias("coverage"))
    units = table(spark, sf, "benchmark").select(file("item_id").alias("file"), X.words(F.col("text")).alias("w")).distinct()
    short = r.where("text is not null").select("id", X.words(F.col("text")).alias("w")).where(F.size("w").between(MIN_EXACT, WINDOW - 1))
    x = short.join(units, "w").select("id", "file", F.lit("exact"), F.lit(0).cast("long"), F.lit(1.0))
    route = F.when(F.col("split") == "dev", "stays, flagged").when(F.col("split") == "private", "excluded, private list").otherwise("excluded, public list")
    return m.union(x).join(r.select("id", "split"), "id").select("id", "split", "file", "kind", "windows", "coverage", route.alias("route"))


#: Words of a run by which a text is found out, and the fewest words of a shorter text that is looked for whole.
RUN, LEAST_RUN = 8, 4


@query(
    "xtr_59_fast_leak_check",
    f"""with w as (select doc_id as id, doc_id % 10 >= 8 as private, {WORDS_SQL.format(t='text')} as w from documents where text is not null), p as ({grams('documents', 'doc_id', RUN, 'doc_id % 10 < 8')}), s as ({grams('documents', 'doc_id', RUN, 'doc_id % 10 >= 8')}),
    blobs as (select array_to_string(w, ' ') as blob from w where not private), short as (select id, array_to_string(w, ' ') as needle from w where private and len(w) between {LEAST_RUN} and {RUN - 1})
    select distinct id from s where gram in (select gram from p) union select id from short where exists (select 1 from blobs where contains(blob, needle))""",
)
def fast_leak_check(spark, sf):
    """Private rows that a public text gives away: by a run of eight words, or, for texts of four to seven words, whole."""
    t = table(spark, sf, "documents").where("text is not null")
    public, private = t.where("doc_id % 10 < 8"), t.where("doc_id % 10 >= 8")
    runs = similarity.shared_runs(private.select(F.col("doc_id").alias("id"), "text"), public, RUN)
    w = X.words(F.col("text"))
    short = private.select(F.col("doc_id").alias("needle_id"), w.alias("w")).where(F.size("w").between(LEAST_RUN, RUN - 1)).select("needle_id", F.array_join("w", " ").alias("needle"))
    short = written(short)  # few rows of few words; private texts are read for them once
    blobs = public.select(F.col("doc_id").alias("id"), F.array_join(w, " ").alias("text"))
    return runs.union(found_in(blobs, short).select("needle_id")).distinct()


@query("xtr_69_candidate_overlap", f"with r as (select id, grp, split, {NORM} as norm from records where text is not null), c as (select * from r where split = 'dev'), t as (select * from r where split = 'test') select (select count(*) from c) as candidates, (select count(*) from c where norm in (select norm from t)) as same_text, (select count(*) from c where grp in (select grp from t)) as same_group, (select count(*) from c where norm in (select norm from t) or grp in (select grp from t)) as any_overlap")
def candidate_overlap(spark, sf):
    """How many candidates overlap with a split, by kind."""
    r = normal(proxy(spark, sf, "records").where("text is not null")).select("id", "grp", "split", "norm")
    t = r.where("split = 'test'")
    j = r.where("split = 'dev'").join(t.select("norm", F.lit(1).alias("a")).distinct(), "norm", "left").join(t.select("grp", F.lit(1).alias("b")).distinct(), "grp", "left")
    a, b = F.col("a").isNotNull(), F.col("b").isNotNull()
    return j.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(a).alias("same_text"), F.count_if(b).alias("same_group"), F.count_if(a | b).alias("any_overlap"))


# --- arms and answers ------------------------------------------------------------------------------------------------------

@query("xtr_33_arm_labels", "with a as (select distinct system, config_hash, seq from ledger) select system, config_hash, seq, case when count(*) over (partition by system) > 1 then system || ' (' || config_hash || ', ' || seq || ')' else system end as label from a")
def arm_labels(spark, sf):
    """A name for each arm, longer only where the short one isn't enough."""
    a = proxy(spark, sf, "ledger").select("system", "config_hash", "seq").distinct()
    many = F.count(F.lit(1)).over(Window.partitionBy("system")) > 1  # a row an arm
    return a.withColumn("label", F.when(many, F.concat("system", F.lit(" ("), "config_hash", F.lit(", "), F.col("seq").cast("string"), F.lit(")"))).otherwise(F.col("system")))


@query("xtr_34_decision_keys", "select row_id, system, case when seq = 1 then 'own' when system in ('alpha', 'beta') then 'set' else 'all' end as keys_from from ledger")
def decision_keys(spark, sf):
    """Which keys decide: the record's own, those of its question set, else all."""
    sets = spark.createDataFrame([("alpha", "set"), ("beta", "set")], "system string, from_set string")
    led = proxy(spark, sf, "ledger").select("row_id", "system", F.when(F.col("seq") == 1, "own").alias("own")).join(F.broadcast(sets), "system", "left")
    return led.select("row_id", "system", F.coalesce("own", "from_set", F.lit("all")).alias("keys_from"))


TAGS_SQL = "select 'de' as tag, 'german' as scored, true as required union all select 'en', 'english', true union all select 'fr', 'romance', false union all select 'es', 'romance', false"


@query("xtr_35_scored_subtask", f"select r.id, t.scored, coalesce(t.required, false) as required from records r left join ({TAGS_SQL}) t on t.tag = r.subtask")
def scored_subtask(spark, sf):
    tags = spark.createDataFrame([("de", "german", True), ("en", "english", True), ("fr", "romance", False), ("es", "romance", False)], "subtask string, scored string, required boolean")
    return proxy(spark, sf, "records").select("id", "subtask").join(F.broadcast(tags), "subtask", "left").select("id", "scored", F.coalesce("required", F.lit(False)).alias("required"))


@query("xtr_36_group_basis", "select l.row_id, l.system, coalesce(case when l.row_id % 4 = 0 then l.grp end, x.grp, l.row_id) as found, case when l.row_id % 4 = 0 then 'record' when x.grp is not null then 'lookup' else 'fallback' end as basis from latest l left join (select id, grp from records where id % 3 <> 0) x on x.id = l.row_id")
def group_basis(spark, sf):
    """A row's group from its record, else from an index, else itself, and which of these it was."""
    led = proxy(spark, sf, "latest").select("row_id", "system", F.when(F.col("row_id") % 4 == 0, F.col("grp")).alias("own"))
    index = proxy(spark, sf, "records").where("id % 3 <> 0").select(F.col("id").alias("row_id"), F.col("grp").alias("looked"))
    basis = F.when(F.col("own").isNotNull(), "record").when(F.col("looked").isNotNull(), "lookup").otherwise("fallback")
    return led.join(index, "row_id", "left").select("row_id", "system", F.coalesce("own", "looked", "row_id").alias("found"), basis.alias("basis"))


@query("xtr_37_implementation_type", "select system, case when kind = 'self' and min(latency_s) < 0.06 then 'local model' when kind = 'self' then 'self-hosted' when max(tokens_out) > 30 then 'hosted model' else 'verdict service' end as type from ledger group by system, kind")
def implementation_type(spark, sf):
    g = proxy(spark, sf, "ledger").groupBy("system", "kind").agg(F.min("latency_s").alias("l"), F.max("tokens_out").alias("t"))
    own = F.col("kind") == "self"
    return g.select("system", F.when(own & (F.col("l") < 0.06), "local model").when(own, "self-hosted").when(F.col("t") > 30, "hosted model").otherwise("verdict service").alias("type"))


@query("xtr_38_usage_blocks", "select row_id, system, case when count(*) filter (not ok) = 0 then sum(tokens_in)::bigint end as tokens_in, case when count(*) filter (not ok) = 0 then sum(tokens_out)::bigint end as tokens_out from ledger group by 1, 2")
def usage_blocks(spark, sf):
    """Usage of all of a row's calls; unknown as soon as one of them is."""
    whole = F.count_if(~F.col("ok")) == 0
    return proxy(spark, sf, "ledger").groupBy("row_id", "system").agg(F.when(whole, F.sum("tokens_in")).alias("tokens_in"), F.when(whole, F.sum("tokens_out")).alias("tokens_out"))


@query("xtr_41_declared", "select d.system, d.type, coalesce(n.n, 0) as n from (select 'alpha' as system, 'api' as type union all select 'gamma', 'model' union all select 'omega', 'api') d left join (select system, count(*) as n from latest group by 1) n on n.system = d.system")
def declared(spark, sf):
    """Declared implementations and what was run of each, none included."""
    d = spark.createDataFrame([("alpha", "api"), ("gamma", "model"), ("omega", "api")], "system string, type string")
    n = proxy(spark, sf, "latest").groupBy("system").agg(F.count(F.lit(1)).alias("n"))
    return d.join(n, "system", "left").select("system", "type", F.coalesce("n", F.lit(0)).alias("n"))


@query("xtr_83_size_checks", "select id, case when length(text) > 10000 then 'too long' when strlen(text) > 9000 then 'too many bytes' when coalesce(text, '') = '' then 'empty' end as refused from records")
def size_checks(spark, sf):
    """What a service would refuse, told before it is called."""
    refused = F.when(F.length("text") > 10000, "too long").when(F.octet_length("text") > 9000, "too many bytes").when(F.coalesce("text", F.lit("")) == "", "empty")
    return proxy(spark, sf, "records").select("id", refused.alias("refused"))


@query("xtr_84_detection_answers", f"with a as (select id, unnest(['email', 'phone', 'token']) as kind from records), h as (select id, unnest({KINDS_SQL}) as kind, length(text)::double / 1000 as score from records) select a.id, a.kind, round(max(case when h.score is null then 0 else least(1, h.score) end)::double, 6) as answer from a left join h on h.id = a.id and h.kind = a.kind group by 1, 2")
def detection_answers(spark, sf):
    """Detections as answers: what was asked and not found is 0."""
    r = proxy(spark, sf, "records").select("id", kinds(F.col("text")).alias("found"), (F.length("text") / 1000).alias("score"))
    a = r.withColumn("kind", F.explode(F.array(*map(F.lit, ("email", "phone", "token")))))
    hit = F.coalesce(F.array_contains("found", F.col("kind")), F.lit(False))
    return a.select("id", "kind", F.round(F.when(hit, F.least(F.lit(1.0), F.col("score"))).otherwise(0.0), 6).alias("answer"))

