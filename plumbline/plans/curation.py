"""Splits and selections of records, screens, mapped values: what a build does to rows before they are records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.functions.changes import described_changes
from plumbline.operators import components, metrics, similarity
from plumbline.operators.ranges import running_sums_within
from plumbline.plans.catalog import proxy, query, table
from plumbline.plans.records import NORM
from plumbline.session import written

WORDS_SQL = r"regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}_]+')"


def hashed(salt: str, key: Column) -> Column:
    """A hex digest to order by: the same in every run and in every engine."""
    return F.md5(F.concat(F.lit(f"{salt}:"), key.cast("string")))


GROUPS = "select grp, min(subtask || '/' || coalesce(expected, '')) as stratum, count(*) as n, md5('{salt}:' || grp) as h from records group by grp"


def groups_of(r, salt: str):
    """Groups with their stratum (the first of their rows'), size and place in a hashed order."""
    stratum = F.concat_ws("/", F.coalesce("subtask", F.lit("")), F.coalesce("expected", F.lit("")))
    return r.groupBy("grp").agg(F.min(stratum).alias("stratum"), F.count(F.lit(1)).alias("n")).withColumn("h", hashed(salt, F.col("grp")))


@query(
    "smp_17_deficit_split",
    f"""with g as ({GROUPS.format(salt='deficit')}), c as (select *, sum(n) over (partition by stratum order by h, grp) as upto, sum(n) over (partition by stratum) as total from g)
    select grp, case when (upto - n / 2.0) / total < 0.2 then 'dev' when (upto - n / 2.0) / total < 0.35 then 'private' else 'test' end as split from c""",
)
def deficit_split(spark, sf):
    """Groups in a hashed order to the split whose share of their stratum isn't full yet: the middle of a group decides,
    so no split is off by more than half a group a stratum. Running sums over ranges; nothing is sequential."""
    g = groups_of(proxy(spark, sf, "records"), "deficit")
    c = running_sums_within(g, ["stratum"], [F.col("h").asc(), F.col("grp").asc()], upto=F.col("n"))
    total = g.groupBy("stratum").agg(F.sum("n").alias("total"))
    at = (F.col("upto") - F.col("n") / 2) / F.col("total")
    return c.join(total, "stratum").select("grp", F.when(at < 0.2, "dev").when(at < 0.35, "private").otherwise("test").alias("split"))


@query(
    "smp_19_cell_fill",
    f"""with g as ({GROUPS.format(salt='fill')}), c as (select *, sum(n) over (partition by stratum order by h, grp) - n as before from g)
    select grp, case when before < 12 then 'dev' when before < 30 then 'private' else 'test' end as split from c""",
)
def cell_fill(spark, sf):
    """Cells filled in a hashed order: so many rows for one split, so many for the next, the rest for the last."""
    g = groups_of(proxy(spark, sf, "records"), "fill")
    c = running_sums_within(g, ["stratum"], [F.col("h").asc(), F.col("grp").asc()], upto=F.col("n"))
    before = F.col("upto") - F.col("n")
    return c.select("grp", F.when(before < 12, "dev").when(before < 30, "private").otherwise("test").alias("split"))


@query(
    "smp_20_redraw",
    """with t as (select subtask, expected, count(*) as target from records where split = 'private' group by 1, 2),
    p as (select id, subtask, expected, row_number() over (partition by subtask, expected order by md5('redraw:' || id), id) as rn from records where split = 'test' and id % 7 <> 0)
    select p.id, p.subtask, p.expected from p join t on t.subtask is not distinct from p.subtask and t.expected is not distinct from p.expected where rn <= target""",
)
def redraw(spark, sf):
    """A new private slice from the movable test rows, as large in each stratum as the old one, in a salted order."""
    r = proxy(spark, sf, "records").select("id", "subtask", F.coalesce("expected", F.lit("")).alias("label"), "expected", "split")
    target = r.where("split = 'private'").groupBy("subtask", "label").agg(F.count(F.lit(1)).alias("target"))
    pool = r.where("split = 'test' and id % 7 <> 0").withColumn("h", hashed("redraw", F.col("id")))
    ranked = running_sums_within(pool, ["subtask", "label"], [F.col("h").asc(), F.col("id").asc()], rn=F.lit(1).cast("long"))
    return ranked.join(target, ["subtask", "label"]).where("rn <= target").select("id", "subtask", "expected")


BIN = "case when length(text) < 200 then 0 when length(text) < 1000 then 1 when length(text) < 4000 then 2 else 3 end"


@query(
    "smp_10_cell_matched",
    f"""with r as (select id, subtask, {BIN} as bin, expected, md5('match:' || id) as h from records where expected is not null and text is not null),
    c as (select subtask, bin, least(count(*) filter (expected = 'yes'), count(*) filter (expected = 'no')) as take from r group by 1, 2),
    k as (select *, row_number() over (partition by subtask, bin, expected order by h, id) as rn from r) select k.id, k.subtask, k.bin, k.expected from k join c on c.subtask = k.subtask and c.bin = k.bin where rn <= take""",
)
def cell_matched(spark, sf):
    """As many of one class as of the other in each cell of job and length, so that length tells nothing."""
    n = F.length("text")
    size = F.when(n < 200, 0).when(n < 1000, 1).when(n < 4000, 2).otherwise(3)
    r = proxy(spark, sf, "records").where("expected is not null and text is not null").select("id", "subtask", size.alias("bin"), "expected", hashed("match", F.col("id")).alias("h"))
    take = r.groupBy("subtask", "bin").agg(F.least(F.count_if(F.col("expected") == "yes"), F.count_if(F.col("expected") == "no")).alias("take"))
    k = running_sums_within(r, ["subtask", "bin", "expected"], [F.col("h").asc(), F.col("id").asc()], rn=F.lit(1).cast("long"))
    return k.join(take, ["subtask", "bin"]).where("rn <= take").select("id", "subtask", "bin", "expected")


KINDS_SQL = "list_filter([case when contains(text, '@') then 'email' end, case when contains(text, '+1 (') then 'phone' end, case when contains(text, 'token') then 'token' end], lambda x: x is not null)"


def kinds(t: Column) -> Column:
    return F.array_compact(F.array(F.when(t.contains("@"), "email"), F.when(t.contains("+1 ("), "phone"), F.when(t.contains("token"), "token")))


@query(
    "smp_13_rare_type_first",
    f"""with e as (select id, source, grp, unnest({KINDS_SQL}) as kind from records), f as (select kind, count(*) as n from e group by 1),
    r as (select e.id, e.source, e.grp, arg_min(e.kind, (f.n, e.kind)) as kind from e join f using (kind) group by 1, 2, 3),
    o as (select * from (select *, row_number() over (partition by grp order by md5('one:' || id), id) as g from r) where g = 1),
    k as (select *, row_number() over (partition by kind, source order by md5('rare:' || id), id) as turn from o),
    p as (select *, row_number() over (partition by kind order by turn, source, id) as place from k) select id, kind, source from p where place <= 15""",
)
def rare_type_first(spark, sf):
    """Rows for their rarest type, one a group, taken from the sources in turn up to each type's target."""
    e = proxy(spark, sf, "records").select("id", "source", "grp", F.explode(kinds(F.col("text"))).alias("kind"))
    n = e.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    r = e.join(F.broadcast(n), "kind").groupBy("id", "source", "grp").agg(F.min_by("kind", F.struct("n", "kind")).alias("kind"))  # a row a type
    o = metrics.latest_per_key(r.withColumn("h", hashed("one", F.col("id"))), ["grp"], F.asc("h"), F.asc("id"))
    turn = F.row_number().over(Window.partitionBy("kind", "source").orderBy(hashed("rare", F.col("id")), "id"))
    first = o.select("id", "kind", "source", turn.alias("turn")).where("turn <= 15")  # no source gives more than the target
    place = F.row_number().over(Window.partitionBy("kind").orderBy("turn", "source", "id"))
    return first.withColumn("place", place).where("place <= 15").select("id", "kind", "source")


@query("ded_06_same_source_text", f"with recursive r as (select id, grp, {NORM} as norm from records where text is not null and source in ('src0', 'src1', 'src2')), e as (select distinct a.id as a, b.id as b from r a join r b on a.norm = b.norm), c(id, root) as (select id, id from r union select e.b, c.root from c join e on e.a = c.id where c.root < e.b) select id, min(root) as root from c group by id")
def same_source_text(spark, sf):
    """Rows of a few sources grouped by an equal source text."""
    r = proxy(spark, sf, "records").where("text is not null and source in ('src0', 'src1', 'src2')").select("id", F.sha2(X.normalise(F.col("text")), 256).alias("norm"))
    return components.groups_by_shared(r, "id", "norm")


@query("ded_07_near_duplicate_groups")
def near_duplicate_groups(spark, sf):
    """Groups joined where a text of one is nearly a text of another: (grp, root), for groups that have such a text. Of copies
    the one with the smallest id stands for all. Min-hashes find most links; of those they leave out, an exact join finds the ones
    between texts that are not joined yet."""
    r = proxy(spark, sf, "records").where("text is not null").select("id", "grp", "text")
    sets = written(similarity.distinct_sets(similarity.token_sets(r, "id")))  # shingles are made once
    links = similarity.minhash_links(sets)
    more = similarity.similarity_join(sets, sets, 0.6, 1.0, similarity.NO_CONTAINMENT, itself=True, known=components.connected_components(links))
    pairs = links.union(more.select("left_id", "right_id"))
    own = r.select(F.col("id").alias("a"), F.col("grp").alias("ga")), r.select(F.col("id").alias("b"), F.col("grp").alias("gb"))
    edges = pairs.select("a", "b").join(own[0], "a").join(own[1], "b").select(F.col("ga").alias("a"), F.col("gb").alias("b"))
    return components.connected_components(edges).select(F.col("node").alias("grp"), "root")


@query("ded_09_union_of_values", "with recursive e as (select distinct a.user_id as a, b.user_id as b from (select user_id, event_id % 977 as v from events) a join (select user_id, event_id % 977 as v from events) b on a.v = b.v), n as (select distinct user_id as id from events), c(id, root) as (select id, id from n union select e.b, c.root from c join e on e.a = c.id where c.root < e.b) select id as user_id, min(root) as root from c group by 1")
def union_of_values(spark, sf):
    """Users joined by a shared value, directly or over others."""
    v = table(spark, sf, "events").select("user_id", (F.col("event_id") % 977).alias("v"))
    return components.groups_by_shared(v, "user_id", "v")


TEMPLATE_SQL = r"""trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), 'project [\p{L}\p{N}_]+', 'project x', 'g'), '\b(january|february|march|april|may|june|july|august|september|october|november|december)\b', 'month', 'g'), '[0-9]+(st|nd|rd|th)?', 'n', 'g'), '\b(dear|hi|hello)[ \t\n\x0b\f\r]+[\p{L}\p{N}_]+', '\1 name', 'g'), ' '), '(regards|best|thanks|sincerely|cheers),?[ \t\n\x0b\f\r]+[\p{L}\p{N}_]+\.?[ \t\n\x0b\f\r]*$', '\1 name'), '[^\p{L}\p{N}_]+', ' ', 'g'))"""


@query("ded_11_template_of_letters", f"select conv_id, turn, substr(sha1({TEMPLATE_SQL}), 1, 12) as template from conversations where text is not null")
def template_of_letters(spark, sf):
    """One key for the letters of a template: projects, months, numbers, greetings and sign-offs masked, as whole words."""
    word, space = r"[\p{L}\p{N}_]+", r"[ \t\n\x0b\f\r]+"
    t = F.regexp_replace(F.lower("text"), rf"project {word}", "project x")
    t = F.regexp_replace(t, r"\b(january|february|march|april|may|june|july|august|september|october|november|december)\b", "month")
    t = F.regexp_replace(F.regexp_replace(t, "[0-9]+(st|nd|rd|th)?", "n"), rf"\b(dear|hi|hello){space}{word}", "$1 name")
    t = F.regexp_replace(F.trim(t), rf"(regards|best|thanks|sincerely|cheers),?{space}{word}\.?[ \t\n\x0b\f\r]*\z", "$1 name")
    key = F.substring(F.sha1(F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}_]+", " "))), 1, 12)
    return table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", key.alias("template"))


# --- screens and projections --------------------------------------------------------------------------------------------

@query("flt_05_identity_attribute", "select event_id, case when props is null then 'unknown' when (props ->> '$.k')::bigint is null then 'absent' when (props ->> '$.k')::bigint % 2 = 0 then 'even' else 'odd' end as attribute from events")
def identity_attribute(spark, sf):
    """An attribute that may be unknown (never asked), absent (asked, none) or a value."""
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf, "events").select("event_id", F.when(F.col("props").isNull(), "unknown").when(k.isNull(), "absent").when(k % 2 == 0, "even").otherwise("odd").alias("attribute"))


@query(
    "flt_07_new_text_screens",
    f"""with n as (select id, text, {NORM} as norm, split from records where text is not null), old as (select distinct norm from n where split = 'test'), bench as (select distinct trim(regexp_replace(lower(text), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) as norm from benchmark)
    select n.id, case when o.norm is not null then 'already a test text' when b.norm is not null then 'benchmark text' when length(n.text) > 8000 then 'too long' when length(n.text) < 30 then 'too short' end as reason from n left join old o on o.norm = n.norm left join bench b on b.norm = n.norm where n.split <> 'test'""",
)
def new_text_screens(spark, sf):
    """The first reason against a new text: known already, in the benchmark, too long, too short."""
    n = proxy(spark, sf, "records").where("text is not null").select("id", "split", F.length("text").alias("len"), F.sha2(X.normalise(F.col("text")), 256).alias("norm"))
    old = n.where("split = 'test'").select("norm", F.lit("already a test text").alias("a")).distinct()
    bench = table(spark, sf, "benchmark").select(F.sha2(X.normalise(F.col("text")), 256).alias("norm"), F.lit("benchmark text").alias("b")).distinct()
    size = F.when(F.col("len") > 8000, "too long").when(F.col("len") < 30, "too short")
    return n.where("split <> 'test'").join(old, "norm", "left").join(bench, "norm", "left").select("id", F.coalesce("a", "b", size).alias("reason"))


@query("flt_08_new_row_screen", "select id, case when coalesce(text, '') = '' then 'empty' when expected is null then 'no label' when lower(text) like '%lorem%' then 'filler' when length(text) > 20000 then 'too long' when licence = 'unknown' then 'licence' end as reason from records")
def new_row_screen(spark, sf):
    reason = F.coalesce(
        F.when(F.coalesce("text", F.lit("")) == "", "empty"), F.when(F.col("expected").isNull(), "no label"), F.when(F.lower("text").contains("lorem"), "filler"),
        F.when(F.length("text") > 20000, "too long"), F.when(F.col("licence") == "unknown", "licence"),
    )
    return proxy(spark, sf, "records").select("id", reason.alias("reason"))


@query("flt_12_row_guard", "select l.row_id, case when f.id is null then 'not frozen' when f.split <> l.split then 'split' when sha1(coalesce(r.text, '')) <> f.h then 'text' end as problem from (select distinct row_id, split from ledger) l join records r on r.id = l.row_id left join (select id, case when id % 19 = 0 then 'dev' else split end as split, sha1(case when id % 23 = 0 then 'old' else coalesce(text, '') end) as h from records where id % 29 <> 0) f on f.id = l.row_id where f.id is null or f.split <> l.split or sha1(coalesce(r.text, '')) <> f.h")
def row_guard(spark, sf):
    """Rows that ran though the frozen list doesn't have them, has them in another split, or has another text."""
    r = proxy(spark, sf, "records").select("id", "split", F.coalesce("text", F.lit("")).alias("text"))
    frozen = r.where("id % 29 <> 0").select("id", F.when(F.col("id") % 19 == 0, "dev").otherwise(F.col("split")).alias("fsplit"), F.sha1(F.when(F.col("id") % 23 == 0, "old").otherwise(F.col("text"))).alias("h"))
    ran = proxy(spark, sf, "ledger").select(F.col("row_id").alias("id"), F.col("split").alias("rsplit")).distinct()
    j = ran.join(r.select("id", F.sha1("text").alias("now")), "id").join(frozen, "id", "left")
    problem = F.when(F.col("h").isNull(), "not frozen").when(F.col("fsplit") != F.col("rsplit"), "split").when(F.col("now") != F.col("h"), "text")
    return j.select(F.col("id").alias("row_id"), problem.alias("problem")).where("problem is not null")


@query("flt_13_state_projection", "select id, text, coalesce(source, '') as src from records")
def state_projection(spark, sf):
    """What a system may see of a row: its state; labels never pass."""
    state = proxy(spark, sf, "records").select("id", F.struct("text", F.coalesce("source", F.lit("")).alias("src")).alias("state"))
    return state.select("id", "state.*")


@query("flt_15_row_summary", f"select id, subtask, expected, grp, split, array_to_string(list_sort({KINDS_SQL}), ',') as kinds, source from records")
def row_summary(spark, sf):
    """What scoring needs of a row: no text."""
    return proxy(spark, sf, "records").select("id", "subtask", "expected", "grp", "split", F.array_join(F.array_sort(F.array_distinct(kinds(F.col("text")))), ",").alias("kinds"), "source")


#: Identifiers: addresses, and runs of digits as phone numbers, cards and accounts have them.
IDENTIFIERS = r"[a-z0-9.]+@[a-z0-9]+\.[a-z.]+|\+?[0-9][0-9 ().-]{8,}[0-9]"
VALUES_SQL = f"select distinct doc_id as id, unnest(regexp_extract_all(text, '{IDENTIFIERS}')) as value from documents"


@query("join_18_shared_values", f"with v as ({VALUES_SQL}), m as (select value, min(id) as first_id, count(*) as n from v group by 1) select v.id, m.first_id, m.value from v join m on m.value = v.value where m.n > 1 and v.id <> m.first_id")
def shared_values(spark, sf):
    """Rows that share a value, each linked to the first that has it: a star a value, not all its pairs."""
    v = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(IDENTIFIERS), F.lit(0)))).alias("value"))
    first = v.groupBy("value").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return v.join(first, "value").where("id <> first_id").select("id", "first_id", "value")


@query("join_28_held_back_containment", f"with n as (select doc_id as needle_id, ' ' || array_to_string({WORDS_SQL.format(t='text')}, ' ') || ' ' as needle from documents where doc_id % 10 >= 8), d as (select doc_id as id, ' ' || array_to_string({WORDS_SQL.format(t='text')}, ' ') || ' ' as hay from documents where doc_id % 10 < 6) select d.id, n.needle_id from d join n on contains(hay, needle) where len(string_split(needle, ' ')) >= 8")
def held_back_containment(spark, sf):
    """Public texts that hold a held-back text whole: candidates by a run of words, then the whole text."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return similarity.contained(d.where("id % 10 < 6"), d.where("id % 10 >= 8"))


@query("set_07_local_only", "select id from records where split = 'private' union select doc_id from labels where quality = 0 union select row_id from ledger where not ok and seq = 1")
def local_only(spark, sf):
    """Ids that must not leave: of private rows, of excluded ones, of failed reruns."""
    a = proxy(spark, sf, "records").where("split = 'private'").select("id")
    b, c = table(spark, sf, "labels").where("quality = 0").select("doc_id"), proxy(spark, sf, "ledger").where("not ok and seq = 1").select("row_id")
    return a.union(b).union(c).distinct()


# --- text ------------------------------------------------------------------------------------------------------------------

#: Fields that name no person, and whom letters address in general.
NO_PERSON_FIELD = (
    "company product test bank business brand plan program project file event course policy account service device vendor organisation organization institution "
    "facility hospital school store trade domain app application model campaign fund team department vessel plan's"
).split()
GENERIC_ADDRESSEE = (
    "customer owner department team support sir madam valued hiring manager colleague colleagues member members client partner patient applicant user users employee "
    "employees parent parents guardian policyholder shareholder shareholders resident residents friend friends officer committee board admissions human resources account "
    "holder investor investors student students tenant vendor supplier recipient"
).split()
NAME_HINT = r"(?:\b(\w+)\s+)?\b(?:[Nn]ame|[Rr]eviewer|[Aa]uthor|[Ss]igned(?: by)?|[Aa]ttn|[Dd]ear|Mr|Mrs|Ms|Dr|Prof)\b[ \t*:_.,]*([A-Z][a-z]+(?:[ \t-][A-Z][a-z]+)+)"
#: Some turns get a field in front, so that every rule meets a row: (turn's remainder by 7, what stands before the text).
FIELDS = ((1, "Name: Anna Maria Weber. "), (2, "Dear Valued Customer, "), (3, "Company Name: Velox Motors. "), (4, "Signed by Jean-Luc Moreau "), (5, "Author: unknown. "))
FIELD_SQL = "case (conv_id + turn) % 7 " + " ".join(f"when {k} then '{t}'" for k, t in FIELDS) + " else '' end"


def name_hints(text):
    """Whether a text names a person after a name field, a salutation or a title: capitalised words that address nobody in
    general, after a field that is a person's."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(NAME_HINT), F.lit(1)).alias("field"), F.regexp_extract_all(text, F.lit(NAME_HINT), F.lit(2)).alias("name"))
    generic = lambda x: F.arrays_overlap(F.split(F.lower(x["name"]), "[ \t-]"), F.array(*map(F.lit, GENERIC_ADDRESSEE)))
    return F.exists(pairs, lambda x: ~F.coalesce(F.lower(x["field"]), F.lit("")).isin(NO_PERSON_FIELD) & ~generic(x))


@query(
    "str_15_name_hint",
    rf"""with t as (select conv_id, turn, {FIELD_SQL} || text as text from conversations where text is not null),
    p as (select conv_id, turn, list_zip(regexp_extract_all(text, '{NAME_HINT}', 1), regexp_extract_all(text, '{NAME_HINT}', 2)) as pairs from t)
    select conv_id, turn, len(list_filter(pairs, lambda x: lower(coalesce(x[1], '')) not in ({', '.join("'" + w.replace("'", "''") + "'" for w in NO_PERSON_FIELD)})
      and len(list_intersect(string_split_regex(lower(x[2]), '[ \t-]'), [{', '.join(f"'{w}'" for w in GENERIC_ADDRESSEE)}])) = 0)) > 0 as hint from p""",
)
def name_hint(spark, sf):
    """Turns that name a person, by ``name_hints``."""
    before = reduce(lambda c, x: c.when((F.col("conv_id") + F.col("turn")) % 7 == x[0], x[1]), FIELDS, F).otherwise("")
    return table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", name_hints(F.concat(before, F.col("text"))).alias("hint"))


@query(
    "str_20_rendered_documents",
    """with b as (select doc_id, text as body, case doc_id % 3 when 0 then 0 when 1 then length(text) else coalesce(nullif(instr(text, '. '), 0) + 1, length(text)) end as place from documents where text <> ''),
    r as (select doc_id, place, case when place >= length(body) then body || ' ' || 'INSERTED SPAN' else substr(body, 1, place) || 'INSERTED SPAN' || ' ' || substr(body, place + 1) end as t, length(body) as n from b)
    select doc_id, md5(t) as rendered, case when place >= n then n + 1 else place end as span_start, case when place >= n then n + 1 else place end + 13 as span_end from r""",
)
def rendered_documents(spark, sf):
    """A span put into a text at its start, its end or after its first sentence, and where it then lies."""
    d = table(spark, sf, "documents").where("text <> ''").select("doc_id", F.col("text").alias("body"), F.length("text").alias("n"))
    inner = F.coalesce(F.nullif(F.instr("body", F.lit(". ")), F.lit(0)) + 1, F.col("n"))
    d = d.withColumn("place", F.when(F.col("doc_id") % 3 == 0, 0).when(F.col("doc_id") % 3 == 1, F.col("n")).otherwise(inner))
    end, span = F.col("place") >= F.col("n"), F.lit("INSERTED SPAN")
    t = F.when(end, F.concat("body", F.lit(" "), span)).otherwise(F.concat(F.substring("body", F.lit(1), F.col("place")), span, F.lit(" "), F.substring("body", F.col("place") + 1, F.col("n"))))
    start = F.when(end, F.col("n") + 1).otherwise(F.col("place"))
    return d.select("doc_id", F.md5(t).alias("rendered"), start.alias("span_start"), (start + 13).alias("span_end"))


@query("str_26_scrubbed_errors", "select row_id, system, seq, case when row_id % 2 = 0 then '<scrubbed>' else error end as error from ledger l join records r on r.id = l.row_id where error is not null and len(string_split(trim(regexp_replace(lower(r.text), '[^\\p{L}\\p{N}_]+', ' ', 'g')), ' ')) >= 8")
def scrubbed_errors(spark, sf):
    """Errors that repeat a row's text are replaced; here every second message quotes its row."""
    r = proxy(spark, sf, "records").select(F.col("id").alias("row_id"), "text").where(F.size(X.words(F.col("text"))) >= 8)
    led = proxy(spark, sf, "ledger").where("error is not null").select("row_id", "system", "seq", "error").join(r, "row_id")
    said = F.when(F.col("row_id") % 2 == 0, F.concat("error", F.lit(" "), X.probe(F.col("text"), 8))).otherwise(F.col("error"))
    return led.withColumn("said", said).select("row_id", "system", "seq", X.scrub(F.col("said"), F.col("text"), 8).alias("error"))


@query("str_27_described_changes", r"select item_id, case when length(text) = 0 then 'none' else '''' || regexp_extract(text, '^(\S+)', 1) || ''' -> ''changed''' end as change from benchmark where text is not null and len(string_split(text, ' ')) > 1")
def described(spark, sf):
    """What differs between two versions of a text, in words: the first word of each was changed here."""
    b = table(spark, sf, "benchmark").where("text is not null").where(F.size(F.split("text", " ")) > 1)
    return described_changes(b.withColumn("now", F.regexp_replace("text", r"\A\S+", "changed")), ["item_id"], "text", "now")


@query("jsn_02_quoting_paths", "select id, path from (select id, unnest(['state.text', 'provenance.source', 'split']) as path, unnest([text, source, split]) as value from records) where value is not null and (contains(value, 'src') or contains(value, 'te'))")
def quoting_paths(spark, sf):
    """The paths of a record's fields whose value holds one of some needles: (path, value) pairs, exploded."""
    pairs = F.array(*[F.struct(F.lit(p).alias("path"), F.col(c).alias("value")) for p, c in (("state.text", "text"), ("provenance.source", "source"), ("split", "split"))])
    p = proxy(spark, sf, "records").select("id", F.explode(pairs).alias("p")).select("id", "p.*")
    return p.where(F.col("value").contains("src") | F.col("value").contains("te")).select("id", "path")


@query("map_03_exploded_calls", "select row_id, system, question_set, answer from (select row_id, system, unnest(case when seq = 1 then ['safety'] else ['safety', 'quality'] end) as question_set, unnest(case when seq = 1 then [score] else [score, 1 - score] end) as answer from ledger where score is not null)")
def exploded_calls(spark, sf):
    """A call that asked several question sets as one record a set, each with its own answers."""
    sets = F.when(F.col("seq") == 1, F.array(F.lit("safety"))).otherwise(F.array(F.lit("safety"), F.lit("quality")))
    answers = F.create_map(F.lit("safety"), F.col("score"), F.lit("quality"), 1 - F.col("score"))
    led = proxy(spark, sf, "ledger").where("score is not null").select("row_id", "system", answers.alias("a"), F.explode(sets).alias("question_set"))
    return led.select("row_id", "system", "question_set", F.col("a")[F.col("question_set")].alias("answer"))


@query("map_07_harm_tags", "select id, tag, tag in ('hate', 'violence') as in_five from (select id, unnest(list_distinct(flatten([case when id % 2 = 0 then ['hate', 'insult'] else [] end, case when id % 3 = 0 then ['violence'] else [] end, case when id % 5 = 0 then ['insult', 'spam'] else [] end]))) as tag from records where toxic = 1)")
def harm_tags(spark, sf):
    """Source categories as harm tags, several a row, with whether a tag is one of those asked about."""
    none = F.array().cast("array<string>")
    given = F.array(*[F.when(F.col("id") % k == 0, F.array(*map(F.lit, tags))).otherwise(none) for k, tags in ((2, ("hate", "insult")), (3, ("violence",)), (5, ("insult", "spam")))])
    r = proxy(spark, sf, "records").where("toxic = 1").select("id", F.explode(F.array_distinct(F.flatten(given))).alias("tag"))
    return r.select("id", "tag", F.col("tag").isin("hate", "violence").alias("in_five"))


@query("map_08_value_spans", r"select doc_id, value, instr(text, value) - 1 as span_start, instr(text, value) - 1 + length(value) as span_end from (select doc_id, text, unnest(list_distinct(regexp_extract_all(text, '[a-z0-9.]+@[a-z0-9]+\.[a-z.]+'))) as value from documents)")
def value_spans(spark, sf):
    """Where in its text each listed value stands first."""
    v = table(spark, sf, "documents").select("doc_id", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[a-z0-9.]+@[a-z0-9]+\.[a-z.]+"), F.lit(0)))).alias("value"))
    at = F.instr("text", F.col("value")) - 1
    return v.select("doc_id", "value", at.alias("span_start"), (at + F.length("value")).alias("span_end"))


@query("mth_02_half_up", "select event_id, case when value is null or isnan(value) then null else floor(value * 10 + 0.5) / 10 end as rounded from events")
def half_up(spark, sf):
    """Rounded half up to one place; no number stays no number."""
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", F.when(v.isNotNull() & ~F.isnan(v), F.floor(v * 10 + 0.5) / 10).alias("rounded"))


@query("dat_03_suite_of", "select id, case when source = 'src0' then 'named' else coalesce(nullif(regexp_extract(concat('F', id % 4, '-', source), '^(F[0-9])-', 1), ''), 'none') end as suite from records")
def suite_of(spark, sf):
    """A row's suite: by its set's name where that says it, by its id's beginning otherwise."""
    ident = F.concat(F.lit("F"), (F.col("id") % 4).cast("string"), F.lit("-"), F.col("source"))
    by_id = F.coalesce(F.nullif(F.regexp_extract(ident, "^(F[0-9])-", 1), F.lit("")), F.lit("none"))
    return proxy(spark, sf, "records").select("id", F.when(F.col("source") == "src0", "named").otherwise(by_id).alias("suite"))


# --- literals, insertions and lexicons as tables ---------------------------------------------------------------------------

@query("src_06_python_literals", "select event_id, (props ->> '$.k')::bigint as k, case when event_id % 3 = 0 then 'python' else 'json' end as written from events where props is not null")
def python_literals(spark, sf):
    """Nested values that some rows have as JSON and others as Python literals: single quotes, True, False and None."""
    e = table(spark, sf, "events").where("props is not null")
    raw = F.when(F.col("event_id") % 3 == 0, F.regexp_replace(F.replace("props", F.lit('"'), F.lit("'")), r"\}$", ", 'seen': True, 'note': None}")).otherwise(F.col("props"))
    as_json = F.regexp_replace(F.regexp_replace(F.regexp_replace("raw", r"\bTrue\b", "true"), r"\bFalse\b", "false"), r"\bNone\b", "null")
    plain = F.from_json("raw", "k bigint, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"})
    literal = F.from_json(as_json, "k bigint", {"allowSingleQuotes": "true"})
    p = e.select("event_id", raw.alias("raw")).withColumns({"plain": plain, "literal": literal})
    is_json = F.col("plain._bad").isNull()
    return p.select("event_id", F.when(is_json, F.col("plain.k")).otherwise(F.col("literal.k")).alias("k"), F.when(is_json, "json").otherwise("python").alias("written"))


LISTED = ("ignore", "password", "token", "please")


@query("str_28_zero_width_words", "select conv_id, turn, md5(" + "".join("replace(" for _ in LISTED) + "text" + "".join(f", '{w}', '{w[: len(w) // 2]}' || chr(8203) || '{w[len(w) // 2 :]}')" for w in LISTED) + ") as changed from conversations where text is not null")
def zero_width_words(spark, sf):
    """A zero-width space inside each of some listed words."""
    t = F.col("text")
    for w in LISTED:
        t = F.replace(t, F.lit(w), F.lit(f"{w[: len(w) // 2]}​{w[len(w) // 2 :]}"))
    return table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", F.md5(t).alias("changed"))


TERMS = f"select word, case when length(word) % 2 = 0 then 'even' else 'odd' end as kind from (select distinct unnest({WORDS_SQL.format(t='text')}) as word from benchmark) where length(word) >= 8"


@query("str_10_terms_by_class", f"with l as ({TERMS}), d as (select distinct doc_id, unnest({WORDS_SQL.format(t='text')}) as word from documents) select d.doc_id, l.kind, count(*) as n, min(l.word) as first_term from d join l on l.word = d.word group by 1, 2")
def terms_by_class(spark, sf):
    """The terms of a lexicon that a text has, by class; the lexicon is a table of any size."""
    words = lambda df, *keep: df.select(*keep, F.explode(F.array_distinct(X.words(F.col("text")))).alias("word"))
    lex = words(table(spark, sf, "benchmark").where("text is not null")).where(F.length("word") >= 8).distinct()
    lex = lex.withColumn("kind", F.when(F.length("word") % 2 == 0, "even").otherwise("odd"))
    d = words(table(spark, sf, "documents").where("text is not null"), "doc_id")
    return d.join(lex, "word").groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("word").alias("first_term"))
