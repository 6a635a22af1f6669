"""Pools of candidates and pairs: references, lexicons, selections with reasons, twins, spans and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators.matching import longest_runs
from plumbline.operators.ranges import running_sums_within
from plumbline.plans.catalog import proxy, query, table
from plumbline.plans.curation import KINDS_SQL, hashed, kinds
from plumbline.plans.records import NORM
from plumbline.session import cut_lineage


def normal(r: DataFrame) -> DataFrame:
    return r.withColumn("norm", F.sha2(X.normalise(F.col("text")), 256))


@query(
    "xtr_62_content_candidates",
    f"""with r as (select id, subtask, split, {NORM} as norm, text, expected, row_number() over (partition by {NORM} order by case split when 'test' then 0 when 'dev' then 1 else 2 end, id) as dup from records where text is not null),
    s as (select *, case when expected is null then 'no label' when length(text) < 40 then 'short' when dup > 1 then 'duplicate' end as reason from r)
    select id, reason, case when reason is null then case when (('0x' || substr(sha256('split:' || id), 1, 13))::bigint / 4503599627370496.0::double) < 0.2 then 'dev' else 'test' end end as proposed from s""",
)
def content_candidates(spark, sf):
    """Candidates with the reason against each: screens, then duplicates with the better split first, then a split."""
    place = F.when(F.col("split") == "test", 0).when(F.col("split") == "dev", 1).otherwise(2)
    r = normal(proxy(spark, sf, "records").where("text is not null")).select("id", "split", "norm", F.length("text").alias("n"), "expected")
    first = r.groupBy("norm").agg(F.min(F.struct(place.alias("p"), "id"))["id"].alias("first"))  # pre-aggregated: a common text is one row
    j = r.join(first, "norm")
    reason = F.coalesce(F.when(F.col("expected").isNull(), "no label"), F.when(F.col("n") < 40, "short"), F.when(F.col("id") != F.col("first"), "duplicate"))
    unit = X.unit_interval(F.sha2(F.concat(F.lit("split:"), F.col("id").cast("string")), 256))
    return j.withColumn("reason", reason).select("id", "reason", F.when(F.col("reason").isNull(), F.when(unit < 0.2, "dev").otherwise("test")).alias("proposed"))


@query("xtr_63_reference_index", f"select kind, count(*) as n from (select distinct 'record text' as kind, {NORM} as v from records where text is not null union all select distinct 'benchmark text', {NORM} from benchmark where text is not null union all select distinct 'group', grp::varchar from records) group by 1")
def reference_index(spark, sf):
    """What new rows are compared with: the distinct texts and groups of all that is known."""
    texts = [normal(t.where("text is not null")).select(F.lit(k).alias("kind"), F.col("norm").alias("v")) for k, t in (("record text", proxy(spark, sf, "records")), ("benchmark text", table(spark, sf, "benchmark")))]
    groups = proxy(spark, sf, "records").select(F.lit("group").alias("kind"), F.col("grp").cast("string").alias("v"))
    return reduce(DataFrame.union, [*texts, groups]).distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


#: Capitalised words that are no names.
NOT_NAMES = (
    "may june july april august march january february september october november december monday tuesday wednesday thursday friday saturday sunday "
    "the and for you your our new all not see note total date name will can page item unit plan type code data user home main north south east west "
    "united states city state bank card trust national"
).split()
NO_NAME = ", ".join(f"'{w}'" for w in NOT_NAMES)
#: Labelled spans: a word that begins a line is a first name of some documents, the first words of others are a place.
SPANS = """select doc_id as id, 'first_name' as label, unnest(regexp_extract_all(text, '\\n([A-Z][a-z]+(?:-[A-Z][a-z]+)?)', 1)) as value from documents where doc_id % 5 = 0
  union all select doc_id, 'city', regexp_extract(text, '^([A-Z][a-z]+(?: [a-z]+)?(?: [a-z]+)?)', 1) from documents where doc_id % 5 = 1"""
#: Words written small, outside of handles, hosts and addresses.
SMALL = r"""select word from (select unnest(string_split_regex(text, '[^\p{L}\p{N}_.@/-]+')) as word from documents) where regexp_full_match(word, '[a-z]{3,}') group by 1 having count(*) >= 3"""
LEXICON = f"""small as ({SMALL}), spans as ({SPANS}),
  lexicon as (select distinct 'first name' as kind, value from (select unnest(string_split_regex(trim(value), '[ \t\n-]+')) as value from spans where label = 'first_name') where regexp_full_match(value, '[A-Z][a-z]{{2,}}') and lower(value) not in ({NO_NAME}) and lower(value) not in (select word from small)
    union select distinct 'place', trim(value) from spans where label = 'city' and regexp_full_match(trim(value), '[A-Z][A-Za-z .''-]{{3,}}') and lower(trim(value)) not in ({NO_NAME}) and (contains(trim(value), ' ') or lower(trim(value)) not in (select word from small)))"""


def labelled_spans(spark, sf):
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    names = d.where(k % 5 == 0).select(k.alias("id"), F.lit("first_name").alias("label"), F.explode(F.regexp_extract_all("text", F.lit(r"\n([A-Z][a-z]+(?:-[A-Z][a-z]+)?)"), F.lit(1))).alias("value"))
    return names.union(d.where(k % 5 == 1).select(k, F.lit("city"), F.regexp_extract("text", r"^([A-Z][a-z]+(?: [a-z]+)?(?: [a-z]+)?)", 1)))


def build_lexicon(spans, texts):
    """(kind, value): first names and places that spans (label, value) of sources label, less common words: those that
    the texts (text) write small three times or more, and a fixed list. Places of several words stay."""
    token = F.explode(F.split("text", r"[^\p{L}\p{N}_.@/-]+")).alias("word")
    small = texts.select(token).where(F.col("word").rlike("^[a-z]{3,}$")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select(F.col("word").alias("low"))
    v = F.trim("value")
    names = spans.where("label = 'first_name'").select(F.lit("first name").alias("kind"), F.explode(F.split(v, "[ \t\n-]+")).alias("value")).where(F.col("value").rlike("^[A-Z][a-z]{2,}$"))
    places = spans.where("label in ('city', 'state')").select(F.lit("place").alias("kind"), v.alias("value")).where(F.col("value").rlike("^[A-Z][A-Za-z .'-]{3,}$"))
    found = names.union(places).distinct().where(~F.lower("value").isin(NOT_NAMES))
    common = found.join(small, F.lower("value") == F.col("low"), "left").where(F.col("low").isNull() | (F.col("kind") == "place") & F.contains(F.col("value"), F.lit(" ")))
    return common.select("kind", "value")


@query("xtr_64_lexicon", f"with {LEXICON} select kind, value from lexicon")
def lexicon(spark, sf):
    """First names and places that the sources label, as a table of any size."""
    return build_lexicon(labelled_spans(spark, sf), table(spark, sf, "documents").select("text"))


WORDS_OF_PLACES = "[A-Za-z][A-Za-z''.-]*[A-Za-z]|[A-Za-z]"


@query(
    "str_16_lexicon_runs",
    rf"""with {LEXICON}, w as (select doc_id, regexp_extract_all(text, '{WORDS_OF_PLACES}') as w, string_split_regex(text, '[^\p{{L}}\p{{N}}_]+') as t from documents where text is not null),
    p as (select distinct array_to_string(regexp_extract_all(value, '{WORDS_OF_PLACES}'), ' ') as run from lexicon where kind = 'place'),
    n as (select doc_id, count(distinct word) as names from (select doc_id, unnest(t) as word from w where doc_id % 3 <> 0) where word in (select value from lexicon where kind = 'first name') group by 1),
    r as (select distinct doc_id from (select doc_id, array_to_string(w[i:i + k - 1], ' ') as run from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from w where doc_id % 4 <> 0), range(1, 5) q(k) where i + k - 1 <= len(w)) where run in (select run from p))
    select w.doc_id, coalesce(n.names, 0) as names, r.doc_id is not null as has_place, case when n.names > 0 then 'a first name the sources label elsewhere' when r.doc_id is not null then 'a city or state the sources label elsewhere' end as reason
    from w left join n using (doc_id) left join r on r.doc_id = w.doc_id""",
)
def lexicon_runs(spark, sf):
    """Rows that mention a name where NAME is not among their types, or a place where ADDRESS is not: names as whole words,
    places as runs of one to four words, case-sensitive, out of a trie of the lexicon."""
    lex = cut_lineage(lexicon(spark, sf))
    d, k = table(spark, sf, "documents").where("text is not null").select("doc_id", "text"), F.col("doc_id")
    names = longest_runs(d.where(k % 3 != 0), lex.where("kind = 'first name'").select(F.col("value").alias("phrase"), F.col("kind").alias("label")), ["doc_id"], word=r"[\p{L}\p{N}_]+", most=1)
    places = longest_runs(d.where(k % 4 != 0), lex.where("kind = 'place'").select(F.col("value").alias("phrase"), F.col("kind").alias("label")), ["doc_id"])
    n = names.groupBy("doc_id").agg(F.count_distinct("phrase").alias("names"))
    r = places.select("doc_id", F.lit(True).alias("place")).distinct()
    out = d.select("doc_id").join(n, "doc_id", "left").join(r, "doc_id", "left").select("doc_id", F.coalesce("names", F.lit(0)).alias("names"), F.col("place").isNotNull().alias("has_place"))
    reason = F.when(F.col("names") > 0, "a first name the sources label elsewhere").when(F.col("has_place"), "a city or state the sources label elsewhere")
    return out.withColumn("reason", reason)


#: What names a driver's licence, what may not stand between it and the number, and what makes a value's type doubtful.
LICENCE = "driv(?:er|ing)?[’']?s?[\\s_-]*(?:licen[cs]e|lic\\b|permit)|driverlicen|\\bD\\.?L\\.?\\s*(?:#|no\\b|number)|\\bdriver[\\s_-]*(?:id\\b|no\\b|number|#)"
BETWEEN = "plate|passport|national|vehicle|,|;"
DOUBTFUL = {"PASSWORD": "hash|token|salt|digest|encrypt|cipher|example|e\\.g\\.|such as|like '", "USERNAME": "ssid|network name|wi-?fi|example|e\\.g\\.|password", "DRIVER_ID": "example|e\\.g\\.|such as"}
#: Values with what stands before them, by a row's id: the end of its text follows a field of some kind.
BEFORE = ("Driver's license: ", "driver license, passport or national id ", "DL # ", "Password hash = ", "password: ", "Wi-Fi login ", "user name ", "Driver ID such as ", "driving permit of the named holder of this card ", "")
BEFORE_SQL = "case id % 10 " + " ".join("when {} then '{}'".format(k, t.replace("'", "''")) for k, t in enumerate(BEFORE)) + " end"
QUOTED = {k: v.replace("'", "''") for k, v in {"LICENCE": LICENCE, **DOUBTFUL}.items()}


def licence_context(before: Column) -> Column:
    """Whether a number is a driver's licence's by the 80 characters before it: they name one, and after the last name
    stand at most 30 characters, none of another document or the next item of a list."""
    context = F.substring(before, -80, 80)
    gap = F.regexp_extract(context, f"(?is)^.*(?:{LICENCE})(.*)$", 1)
    return context.rlike(f"(?i){LICENCE}") & (F.length(gap) <= 30) & ~gap.rlike(f"(?i){BETWEEN}")


def doubtful_context(label: str, before: Column) -> Column:
    """Whether the 40 characters before a value make its type doubtful."""
    return F.substring(before, -40, 40).rlike(f"(?i){DOUBTFUL[label]}")


@query(
    "xtr_65_context_checks",
    f"""with b as (select id, right(text, 60) || ' ' || {BEFORE_SQL} as before from records where text is not null), c as (select id, right(before, 80) as wide, right(before, 40) as near from b)
    select id, regexp_matches(wide, '(?i){QUOTED['LICENCE']}') and length(regexp_extract(wide, '(?is)^.*(?:{QUOTED['LICENCE']})(.*)$', 1)) <= 30 and not regexp_matches(regexp_extract(wide, '(?is)^.*(?:{QUOTED['LICENCE']})(.*)$', 1), '(?i){BETWEEN}') as licence,
      {", ".join(f"regexp_matches(near, '(?i){QUOTED[k]}') as doubtful_{k.lower()}" for k in DOUBTFUL)} from c""",
)
def context_checks(spark, sf):
    """Whether what stands right before a value names it, and whether it makes the value doubtful."""
    field = reduce(lambda c, x: c.when(F.col("id") % 10 == x[0], x[1]), enumerate(BEFORE), F)
    before = F.concat(F.substring("text", -60, 60), F.lit(" "), field)
    r = proxy(spark, sf, "records").where("text is not null").select("id", before.alias("before"))
    return r.select("id", licence_context(F.col("before")).alias("licence"), *[doubtful_context(k, F.col("before")).alias(f"doubtful_{k.lower()}") for k in DOUBTFUL])


@query("xtr_66_reference_invariants", f"select 'ids twice' as invariant, (select count(*) from (select id from records group by 1 having count(*) > 1)) as violations union all select 'kinds without text', (select count(*) from records where text is null and len({KINDS_SQL}) > 0) union all select 'group in two splits', (select count(*) from (select grp from records group by 1 having count(distinct split) > 1)) union all select 'label of excluded', (select count(*) from records where exclude_reason is not null and expected is not null)")
def reference_invariants(spark, sf):
    r = proxy(spark, sf, "records")
    bad = {
        "ids twice": r.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
        "kinds without text": r.where(F.col("text").isNull() & (F.size(kinds(F.col("text"))) > 0)),
        "group in two splits": r.groupBy("grp").agg(F.count_distinct("split").alias("n")).where("n > 1"),
        "label of excluded": r.where("exclude_reason is not null and expected is not null"),
    }
    return reduce(DataFrame.union, [v.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(k).alias("invariant"), "violations") for k, v in bad.items()])


@query("xtr_67_count_reports", f"with e as (select split, source, expected, unnest(case when len({KINDS_SQL}) = 0 then ['none'] else {KINDS_SQL} end) as kind from records) select case when grouping(split) = 0 then 'split' when grouping(source) = 0 then 'source' else 'kind' end as by_what, coalesce(split, source, kind) as value, count(*) as n, count(*) filter (expected = 'yes') as positives from e group by grouping sets ((split), (source), (kind))")
def count_reports(spark, sf):
    """The counts of a build report in one pass: by split, by source, by kind."""
    k = kinds(F.col("text"))
    e = proxy(spark, sf, "records").select("split", "source", "expected", F.explode(F.when(F.coalesce(F.size(k), F.lit(0)) <= 0, F.array(F.lit("none"))).otherwise(k)).alias("kind"))
    g = e.groupingSets([["split"], ["source"], ["kind"]], "split", "source", "kind").agg(F.grouping("split").alias("a"), F.grouping("source").alias("b"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("expected") == "yes").alias("positives"))
    return g.select(F.when(F.col("a") == 0, "split").when(F.col("b") == 0, "source").otherwise("kind").alias("by_what"), F.coalesce("split", "source", "kind").alias("value"), "n", "positives")


@query(
    "xtr_68_selection_with_exclusions",
    """with r as (select id, source, expected, case when expected is null then 'no label' when exclude_reason is not null then exclude_reason when length(text) > 6000 then 'long' end as reason, md5('pick:' || id) as h from records),
    k as (select *, row_number() over (partition by source, expected order by h, id) as rn from r where reason is null) select r.id, coalesce(r.reason, case when k.rn > 8 then 'over quota' end) as reason, coalesce(k.rn <= 8, false) as selected from r left join k on k.id = r.id""",
)
def selection_with_exclusions(spark, sf):
    """Rows taken up to a quota a source and class, and for every other row the first reason why not."""
    reason = F.coalesce(F.when(F.col("expected").isNull(), "no label"), F.col("exclude_reason"), F.when(F.length("text") > 6000, "long"))
    r = proxy(spark, sf, "records").select("id", "source", "expected", reason.alias("reason"), hashed("pick", F.col("id")).alias("h"))
    rn = F.row_number().over(Window.partitionBy("source", "expected").orderBy("h", "id"))
    first = r.where("reason is null").withColumn("rn", rn).where("rn <= 8").select("id", F.lit(True).alias("hit"))  # limited before its shuffle
    j = r.join(first, "id", "left")
    return j.select("id", F.coalesce("reason", F.when(F.col("hit").isNull(), "over quota")).alias("reason"), F.coalesce("hit", F.lit(False)).alias("selected"))


@query("xtr_70_share_capped_pool", "with p as (select id, source, 'direct' as kind from records where expected = 'yes' union all select id, source, 'hard benign' from records where expected = 'no' and length(text) > 500), k as (select *, row_number() over (partition by kind, source order by md5('pool:' || id), id) as rn, count(*) over (partition by kind) as n from p) select id, kind, source from k where rn <= floor(0.1 * n)")
def share_capped_pool(spark, sf):
    """Two pools in which no source has more than a tenth; caps by running counts, so a large source is spread."""
    r = proxy(spark, sf, "records")
    p = r.where("expected = 'yes'").select("id", "source", F.lit("direct").alias("kind")).union(r.where((F.col("expected") == "no") & (F.length("text") > 500)).select("id", "source", F.lit("hard benign")))
    n = p.groupBy("kind").agg(F.floor(0.1 * F.count(F.lit(1))).alias("most"))
    k = running_sums_within(p.withColumn("h", hashed("pool", F.col("id"))), ["kind", "source"], [F.col("h").asc(), F.col("id").asc()], rn=F.lit(1).cast("long"))
    return k.join(F.broadcast(n), "kind").where("rn <= most").select("id", "kind", "source")


PAYLOADS = "select item_id as payload, text from benchmark where text <> ''"


@query(
    "xtr_71_paired_rows",
    f"""with c as (select doc_id as carrier, text as body, row_number() over (order by md5('carrier:' || doc_id), doc_id) - 1 as k from documents where length(text) > 300), p as (select payload, text, row_number() over (order by md5('payload:' || payload), payload) - 1 as k, count(*) over () as n from ({PAYLOADS})),
    j as (select c.carrier, p.payload, c.body, p.text as span, c.k from c join p on p.k = c.k % p.n)
    select carrier, payload, kind, md5(case kind when 'attack' then body || ' ' || span when 'quoted' then body || ' "' || span || '"' else body end) as rendered from j cross join (select unnest(['attack', 'clean twin', 'quoted']) as kind) x where kind <> 'quoted' or k % 5 = 0""",
)
def paired_rows(spark, sf):
    """Carriers and payloads paired in turn in hashed orders; each carrier gives an attack, its clean twin, some a quote."""
    from plumbline.operators.ranges import row_numbers

    d = table(spark, sf, "documents").where(F.length("text") > 300).select(F.col("doc_id").alias("carrier"), hashed("carrier", F.col("doc_id")).alias("h"))
    c = row_numbers(d, [F.col("h").asc(), F.col("carrier").asc()], "k").withColumn("k", F.col("k") - 1).join(table(spark, sf, "documents").select(F.col("doc_id").alias("carrier"), F.col("text").alias("body")), "carrier")
    b = table(spark, sf, "benchmark").where("text <> ''").select(F.col("item_id").alias("payload"), F.col("text").alias("span"), hashed("payload", F.col("item_id")).alias("ph"))
    p = row_numbers(b, [F.col("ph").asc(), F.col("payload").asc()], "pk").select("payload", "span", (F.col("pk") - 1).alias("pk"))
    n = p.agg(F.count(F.lit(1)).alias("n"))
    j = c.crossJoin(F.broadcast(n)).withColumn("pk", F.col("k") % F.col("n")).join(p, "pk")  # one row
    kind = F.when(F.col("k") % 5 == 0, F.array(*map(F.lit, ("attack", "clean twin", "quoted")))).otherwise(F.array(F.lit("attack"), F.lit("clean twin")))
    t = F.when(F.col("kind") == "attack", F.concat("body", F.lit(" "), "span")).when(F.col("kind") == "quoted", F.concat("body", F.lit(' "'), "span", F.lit('"'))).otherwise(F.col("body"))
    return j.withColumn("kind", F.explode(kind)).select("carrier", "payload", "kind", F.md5(t).alias("rendered"))


@query("xtr_72_extracted_payloads", "select event_id, 'k' as kind, props ->> '$.k' as payload from events where props is not null and (props ->> '$.k') is not null")
def extracted_payloads(spark, sf):
    """The entries of a map of payloads, one row each."""
    m = F.explode(F.from_json("props", "map<string,string>")).alias("kind", "payload")
    return table(spark, sf, "events").where("props is not null").select("event_id", m).where("kind = 'k' and payload is not null")


@query("xtr_73_pairwise_drop", "select id from (select id, max((coalesce(text, '') = '' or expected is null or length(text) > 8000)::int) over (partition by id // 2) as bad from records) where bad = 0")
def pairwise_drop(spark, sf):
    """A row that fails takes its twin with it."""
    bad = (F.coalesce("text", F.lit("")) == "") | F.col("expected").isNull() | (F.length("text") > 8000)
    r = proxy(spark, sf, "records").select("id", F.floor(F.col("id") / 2).alias("pair"), bad.cast("int").alias("bad"))
    return r.withColumn("worst", F.max("bad").over(Window.partitionBy("pair"))).where("worst = 0").select("id")  # two rows a pair


@query("xtr_74_held_back_shared", f"with r as (select id, id // 2 as pair, split, {NORM} as norm from records where text is not null), s as (select pair from r where split <> 'private' and norm in (select norm from r where split = 'private')) select id from r where split <> 'private' and pair in (select pair from s)")
def held_back_shared(spark, sf):
    """Public rows whose text the private slice has, and their twins."""
    r = normal(proxy(spark, sf, "records").where("text is not null")).select("id", F.floor(F.col("id") / 2).alias("pair"), "split", "norm")
    pub = r.where("split <> 'private'")
    shared = pub.join(r.where("split = 'private'").select("norm").distinct(), "norm", "left_semi").select("pair").distinct()
    return pub.join(shared, "pair", "left_semi").select("id")


@query("xtr_75_projected_build", "select subtask, split, expected, count(*) as n from records where exclude_reason is null and id not in (select doc_id from labels where quality = 0 and doc_id % 2 = 0) group by 1, 2, 3")
def projected_build(spark, sf):
    """What a build would hold without its disputed rows."""
    disputed = table(spark, sf, "labels").where("quality = 0 and doc_id % 2 = 0").select(F.col("doc_id").alias("id"))
    r = proxy(spark, sf, "records").where("exclude_reason is null").join(disputed, "id", "left_anti")
    return r.groupBy("subtask", "split", "expected").agg(F.count(F.lit(1)).alias("n"))


@query(
    "xtr_77_nuisance_features",
    r"select id, coalesce(source, 'unknown') as source, floor(log2(greatest(1, length(text))))::int as length_bin, contains(text, '```') as code_fence, regexp_matches(text, 'https?://') as url, case when length(text) - length(replace(text, chr(10), '')) + 1 < 2 then 0 when length(text) - length(replace(text, chr(10), '')) + 1 < 8 then 1 else 2 end as lines from records where text is not null",
)
def nuisance_features(spark, sf):
    """What describes a row's form and not its wording, as one struct."""
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    x = F.struct(
        F.coalesce("source", F.lit("unknown")).alias("source"), X.log2_bin(F.length("text")).alias("length_bin"), F.col("text").contains("```").alias("code_fence"),
        F.col("text").rlike("https?://").alias("url"), F.when(n_lines < 2, 0).when(n_lines < 8, 1).otherwise(2).alias("lines"),
    )
    return proxy(spark, sf, "records").where("text is not null").select("id", x.alias("x")).select("id", "x.*")


#: What talks about prompts, what is a template's gap and not such talk, and what names a secret or a persona. Boundaries take
#: a character each, so characters that are no word's are doubled before they are matched.
PROMPTISH = r"(?i)(?:^|[^\[{\w])(?:prompts?|system\s+messages?|prompt\s+engineer\w*|midjourney|stable\s+diffusion)(?:$|[^\]}\w])"
PLACEHOLDER, SECRETISH = r"(?i)\[+(?:PROMPT|TARGETLANGUAGE|KEYWORD)\]", "(?i)password|secret|pwd|passphrase|passcode"
PERSONA = r"(?i)\b(?:act as|acting as|you are|you're|role ?play|pretend|persona|character|i want you to)\b"
#: Talk of these kinds in front of some rows' texts.
TALK = ("Write a prompt that improves prompts. ", "[PROMPT] prompt prompt ", "My password is ", "You are a pirate. ", "One prompt. ", "Pretend, with system messages and a prompt engineer: ")
TALK_SQL = "case id % 11 " + " ".join(f"when {k} then '{t}'" for k, t in enumerate(TALK)) + " else '' end"


def benign_route(text: Column) -> Column:
    """A harmless row's job: talk about prompts (two mentions, none of them a template's gap) or secrets beside leaks, a
    persona beside jailbreaks, and the others by the parity of their text's hash, so that no word gives the class away."""
    doubled = F.regexp_replace(text, r"(\W)", "$1$1")
    mentions = F.size(F.regexp_extract_all(doubled, F.lit(PROMPTISH), F.lit(0)))
    odd = F.conv(F.substring(F.sha1(text), 10, 1), 16, 10).cast("int") % 2 == 1
    leak = ((mentions >= 2) & ~text.rlike(PLACEHOLDER)) | text.rlike(SECRETISH)
    return F.when(leak, "leakage").when(text.rlike(PERSONA), "jailbreak").when(odd, "leakage").otherwise("injection")


@query(
    "xtr_78_subtask_routing",
    rf"""with t as (select id, {TALK_SQL} || text as text from records where text is not null)
    select id, case when len(regexp_extract_all(regexp_replace(text, '(\W)', '\1\1', 'g'), '{PROMPTISH}')) >= 2 and not regexp_matches(text, '{PLACEHOLDER}') or regexp_matches(text, '{SECRETISH}') then 'leakage'
      when regexp_matches(text, '{PERSONA.replace("'", "''")}') then 'jailbreak' when ('0x' || substr(sha1(text), 10, 1))::int % 2 = 1 then 'leakage' else 'injection' end as route from t""",
)
def subtask_routing(spark, sf):
    """A harmless row's job by ``benign_route``."""
    talk = reduce(lambda c, x: c.when(F.col("id") % 11 == x[0], x[1]), enumerate(TALK), F).otherwise("")
    return proxy(spark, sf, "records").where("text is not null").select("id", benign_route(F.concat(talk, F.col("text"))).alias("route"))


@query("xtr_79_label_of_tags", "with g as (select conv_id, list_sort(list(distinct role)) as tags from conversations where role is not null group by 1) select conv_id, array_to_string(tags, ',') as tags, case when tags = ['assistant', 'user'] then 'yes' when tags = ['user'] then 'no' end as label from g")
def label_of_tags(spark, sf):
    """A label only where the set of tags is exactly one of those that decide."""
    g = table(spark, sf, "conversations").where("role is not null").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("tags"))  # few roles
    label = F.when(F.col("tags") == F.array(F.lit("assistant"), F.lit("user")), "yes").when(F.col("tags") == F.array(F.lit("user")), "no")
    return g.select("conv_id", F.array_join("tags", ",").alias("tags"), label.alias("label"))


@query(
    "xtr_80_spans_in_order",
    r"""with d as (select doc_id, text, string_split(text, ' ')[1] as a, string_split(text, ' ')[3] as b from documents where len(string_split(text, ' ')) >= 3 and string_split(text, ' ')[1] <> '' and string_split(text, ' ')[3] <> ''),
    s as (select *, instr(text, a) - 1 as s1 from d), e as (select *, s1 + length(a) as e1, instr(substr(text, s1 + length(a) + 1), b) as nxt from s) select doc_id, s1 as first_start, e1 as first_end, case when nxt > 0 then e1 + nxt - 1 else instr(text, b) - 1 end as second_start from e""",
)
def spans_in_order(spark, sf):
    """Pieces located one after the other: each is looked for behind the last one found, else from the start."""
    w = F.split("text", " ")
    d = table(spark, sf, "documents").where(F.size(w) >= 3).select("doc_id", "text", F.array(w[0], w[2]).alias("parts")).where("parts[0] <> '' and parts[1] <> ''")
    none = F.struct(F.lit(0).alias("cursor"), F.array().cast("array<struct<begin:int,end:int>>").alias("out"))

    def locate(s: Column, x: Column) -> Column:
        behind = F.call_function("locate", x, F.col("text"), s["cursor"] + 1)
        begin = F.when(behind > 0, behind - 1).otherwise(F.call_function("locate", x, F.col("text"), F.lit(1)) - 1)
        end = (begin + F.length(x)).cast("int")
        return F.struct(end.alias("cursor"), F.concat(s["out"], F.array(F.struct(begin.cast("int").alias("begin"), end.alias("end")))).alias("out"))

    found = d.select("doc_id", F.aggregate("parts", none, locate, lambda s: s["out"]).alias("s"))
    return found.select("doc_id", F.col("s")[0]["begin"].alias("first_start"), F.col("s")[0]["end"].alias("first_end"), F.col("s")[1]["begin"].alias("second_start"))


@query("xtr_81_union_of_corpora", "select 'events' as corpus, event_id as id, greatest(value, value / 2) as worst from events where value > 1 union all select 'ledger', row_id, greatest(max(score) filter (seq = 0), max(score) filter (seq = 1)) from ledger where score is not null group by row_id")
def union_of_corpora(spark, sf):
    """Two corpora with a score each for prompt and continuation, under the worse of the two."""
    a = table(spark, sf, "events").where("value > 1").select(F.lit("events").alias("corpus"), F.col("event_id").alias("id"), F.greatest("value", F.col("value") / 2).alias("worst"))
    led = proxy(spark, sf, "ledger").where("score is not null")
    part = lambda k: F.max(F.when(F.col("seq") == k, F.col("score")))
    b = led.groupBy("row_id").agg(F.greatest(part(0), part(1)).alias("worst"))
    return a.union(b.select(F.lit("ledger"), "row_id", "worst"))


@query("xtr_82_descriptors", "select r.r_name as region, n.n_name as nation, c.segment from nation n join region r on r.r_regionkey = n.n_regionkey join (select distinct c_nationkey, c_mktsegment as segment from customer) c on c.c_nationkey = n.n_nationkey")
def descriptors(spark, sf):
    """Nested descriptors (region, its nations, their segments) laid flat."""
    c = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("segments"))  # a few segments
    n = table(spark, sf, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_regionkey").agg(F.collect_list(F.struct("n_name", "segments")).alias("nations"))
    nested = table(spark, sf, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("region"), F.explode("nations").alias("x"))
    return nested.select("region", F.col("x.n_name").alias("nation"), F.explode("x.segments").alias("segment"))

