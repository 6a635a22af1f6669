"""Overlap, contamination and near-duplicate joins over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import components, similarity
from plumbline.operators.joins import salted_join
from plumbline.operators.matching import quotes_of_several
from plumbline.plans.catalog import proxy, query, table
from plumbline.session import written

WORDS = r"regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}_]+')"


def grams_sql(source: str, id_: str, n: int, text: str = "text") -> str:
    """(id, gram) of a table: distinct word n-grams; shorter texts have none."""
    return f"""select distinct id, array_to_string(w[i:i + {n - 1}], ' ') as gram from (select id, w, unnest(range(1, len(w) - {n - 1} + 1)) as i from (select {id_} as id, {WORDS.format(t=text)} as w from {source}) where len(w) >= {n})"""


def shingle_rows_sql(source: str, id_: str, n: int = 5) -> str:
    """(id, token): distinct shingles, short texts one."""
    return f"""{grams_sql(source, id_, n)} union select id, array_to_string(w, ' ') from (select {id_} as id, {WORDS.format(t='text')} as w from {source}) where len(w) between 1 and {n - 1}"""


PAIRS = """
  select a.id as left_id, b.id as right_id, count(*) as overlap, any_value(sa.n) as left_size, any_value(sb.n) as right_size
  from {a} a join {b} b on a.gram = b.gram join (select id, count(*) as n from {a} group by id) sa on sa.id = a.id join (select id, count(*) as n from {b} group by id) sb on sb.id = b.id
  where {on} group by 1, 2 having count(*) >= 0.8 * (any_value(sa.n) + any_value(sb.n) - count(*)) - 1e-9 or (least(any_value(sa.n), any_value(sb.n)) >= 10 and count(*) >= 0.8 * least(any_value(sa.n), any_value(sb.n)) - 1e-9)
"""


@query("join_02_similarity_join", f"with d as ({shingle_rows_sql('documents', 'doc_id')}), b as ({shingle_rows_sql('benchmark', 'item_id')}) " + PAIRS.format(a="d", b="b", on="true"))
def similarity_to_benchmark(spark, sf):
    d, b = similarity.token_sets(table(spark, sf, "documents"), "doc_id"), similarity.token_sets(table(spark, sf, "benchmark"), "item_id")
    return similarity.similarity_join(d, b).select("left_id", "right_id", F.col("overlap").cast("long").alias("overlap"), F.col("left_size").cast("long").alias("left_size"), F.col("right_size").cast("long").alias("right_size"))


@query(
    "join_02_near_duplicates",
    f"""with s as ({shingle_rows_sql('documents', 'doc_id')}), k as (select id, sha256(string_agg(gram, chr(10) order by gram)) as key from s group by id), r as (select min(id) as id from k group by key), d as (select s.* from s join r using (id)) """
    + PAIRS.format(a="d", b="d", on="a.id < b.id"),
)
def near_duplicates(spark, sf):
    """Pairs of distinct shingle sets among the documents; exact copies are one set."""
    s = similarity.token_sets(table(spark, sf, "documents"), "doc_id")
    return similarity.similarity_join(s, s, itself=True, once=True).select("left_id", "right_id", F.col("overlap").cast("long").alias("overlap"), F.col("left_size").cast("long").alias("left_size"), F.col("right_size").cast("long").alias("right_size"))


@query("join_03_minhash_components")
def minhash_components(spark, sf):
    """Components of distinct texts that share a band of min-hashes and have a Jaccard similarity of 0.6, copies put back."""
    d = written(similarity.distinct_sets(similarity.token_sets(table(spark, sf, "documents"), "doc_id")))  # shingles are made once
    found = components.connected_components(similarity.minhash_links(d))
    return d.select("id", "copies").join(found, F.col("id") == F.col("node"), "left").select("id", "copies", F.coalesce("root", "id").alias("component_id"))


@query(
    "join_04_best_reference",
    f"""with d as ({shingle_rows_sql('documents', 'doc_id', 3)}), b as ({shingle_rows_sql('benchmark', 'item_id', 3)}), sa as (select id, count(*) as n from d group by id), sb as (select id, count(*) as n from b group by id),
    p as (select a.id, b.id as ref, count(*)::double / (any_value(sa.n) + any_value(sb.n) - count(*)) as j from d a join b on a.gram = b.gram join sa on sa.id = a.id join sb on sb.id = b.id group by 1, 2)
    select id, ref, round(j, 6) as jaccard from (select *, row_number() over (partition by id order by j desc, ref) as rn from p) where rn = 1""",
)
def best_reference(spark, sf):
    """The most similar reference text of every document that shares anything with one."""
    from plumbline.operators.metrics import latest_per_key

    d = similarity.token_sets(table(spark, sf, "documents"), "doc_id", n=3).select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("t"))
    b = similarity.token_sets(table(spark, sf, "benchmark"), "item_id", n=3).select(F.col("id").alias("ref"), F.size("tokens").alias("m"), F.explode("tokens").alias("t"))
    p = d.join(b, "t").groupBy("id", "ref").agg(F.count(F.lit(1)).alias("o"), F.first("n").alias("n"), F.first("m").alias("m"))
    p = p.withColumn("j", F.col("o") / (F.col("n") + F.col("m") - F.col("o")))
    return latest_per_key(p, ["id"], F.desc("j"), F.asc("ref")).select("id", "ref", F.round("j", 6).alias("jaccard"))


@query(
    "join_05_rare_token_join",
    r"""with b as (select item_id as id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as w from benchmark), d as (select doc_id as id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as w from documents),
    f as (select t, count(*) as n from (select unnest(w) as t from b) group by t), r as (select id, t, row_number() over (partition by id order by n, t) as rn from (select id, unnest(w) as t from b) join f using (t)),
    c as (select distinct d.id, r.id as ref from (select id, unnest(w) as t from d) d join r on r.t = d.t and r.rn <= 3)
    select c.id, c.ref, round(len(list_intersect(d.w, b.w))::double / (len(d.w) + len(b.w) - len(list_intersect(d.w, b.w))), 6) as jaccard from c join d on d.id = c.id join b on b.id = c.ref where len(list_intersect(d.w, b.w)) >= 0.3 * (len(d.w) + len(b.w) - len(list_intersect(d.w, b.w)))""",
)
def rare_token_join(spark, sf):
    """Documents that share one of a reference's three rarest words, kept if their words are alike enough."""
    from pyspark.sql import Window

    w = F.array_distinct(X.words(F.col("text")))
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("ref"), w.alias("bw"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), w.alias("dw"))
    t = b.select("ref", F.explode("bw").alias("t"))
    rare = t.join(t.groupBy("t").agg(F.count(F.lit(1)).alias("n")), "t").withColumn("rn", F.row_number().over(Window.partitionBy("ref").orderBy("n", "t"))).where("rn <= 3")
    c = d.select("id", F.explode("dw").alias("t")).join(rare, "t").select("id", "ref").distinct()
    both = F.size(F.array_intersect("dw", "bw"))
    j = both / (F.size("dw") + F.size("bw") - both)
    return c.join(d, "id").join(b, "ref").where(both >= 0.3 * (F.size("dw") + F.size("bw") - both)).select("id", "ref", F.round(j, 6).alias("jaccard"))


@query(
    "join_07_ngram_coverage",
    f"""with d as ({grams_sql('documents', 'doc_id', 8)}), b as ({grams_sql('benchmark', 'item_id', 8)})
    select id, count(*) filter (gram in (select gram from b)) as matched, count(*) as total, round((count(*) filter (gram in (select gram from b)))::double / count(*), 6) as coverage from d group by id having matched > 0""",
)
def ngram_coverage(spark, sf):
    """How much of each document the benchmark's 8-word runs cover."""
    d, b = similarity.ngram_rows(table(spark, sf, "documents"), "doc_id", 8), similarity.ngram_rows(table(spark, sf, "benchmark"), "item_id", 8)
    return similarity.ngram_coverage(d, b).select("id", "matched", F.col("total").cast("long").alias("total"), F.round("coverage", 6).alias("coverage"))


@query("join_08_ngram_index", f"select id, count(*) as n_grams from ({grams_sql('benchmark', 'item_id', 8)}) group by id")
def ngram_index(spark, sf):
    return similarity.ngram_rows(table(spark, sf, "benchmark"), "item_id", 8).groupBy("id").agg(F.count(F.lit(1)).alias("n_grams"))


DIGEST = r"sha256(trim(regexp_replace(lower(text), '[ \t\n\x0b\f\r]+', ' ', 'g')))"


@query("src_16_digest_set", f"select distinct substr({DIGEST}, 1, 16) as digest from documents where text is not null")
def digest_set(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select(F.substring(F.sha2(X.normalise(F.col("text")), 256), 1, 16).alias("digest")).distinct()


@query("join_09_digest_semi_join", f"select doc_id from documents where {DIGEST} in (select {DIGEST} from documents where source = 'src0')")
def digest_semi_join(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.sha2(X.normalise(F.col("text")), 256).alias("digest"))
    return d.join(d.where("source = 'src0'").select("digest"), "digest", "left_semi").select("doc_id")


@query(
    "join_10_training_overlap",
    f"""with r as (select id, split, source, {DIGEST} as digest from records) select a.split, a.source, b.source as seen_in, count(distinct a.id) as n from r a join r b on a.digest = b.digest and a.split <> b.split group by 1, 2, 3""",
)
def training_overlap(spark, sf):
    """Rows whose text another split has, by split, source and where it was seen."""
    r = proxy(spark, sf, "records").select("id", "split", "source", F.sha2(X.normalise(F.col("text")), 256).alias("digest"))
    places = r.select("digest", F.col("split").alias("other"), F.col("source").alias("seen_in")).distinct()  # pre-aggregated: copies don't multiply
    return r.join(places, "digest").where("split <> other").groupBy("split", "source", "seen_in").agg(F.count_distinct("id").alias("n"))


@query("join_11_group_straddle", "select grp, count(distinct split) as n_splits, count(*) as n_rows from records group by grp having count(distinct split) > 1")
def group_straddle(spark, sf):
    return proxy(spark, sf, "records").groupBy("grp").agg(F.count_distinct("split").alias("n_splits"), F.count(F.lit(1)).alias("n_rows")).where("n_splits > 1")


@query(
    "join_01_overlap_check",
    f"""with r as (select id, grp, split, {DIGEST} as digest from records), t as (select * from r where split = 'test'), f as (select * from r where split <> 'test'),
    s as ({shingle_rows_sql('(select id, text from records)', 'id')}), k as (select id, count(*) as n from s group by id),
    near as (select a.id as test_id, b.id as ref_id from s a join s b on a.gram = b.gram join k ka on ka.id = a.id join k kb on kb.id = b.id where a.id in (select id from t) and b.id in (select id from f) group by 1, 2
      having count(*) >= 0.8 * (any_value(ka.n) + any_value(kb.n) - count(*)) - 1e-9 or (least(any_value(ka.n), any_value(kb.n)) >= 10 and count(*) >= 0.8 * least(any_value(ka.n), any_value(kb.n)) - 1e-9))
    select t.id as test_id, 'group' as kind, f.id as ref_id from t join f on t.grp = f.grp union select t.id, 'text', f.id from t join f on t.digest = f.digest union select test_id, 'near', ref_id from near""",
)
def overlap_check(spark, sf):
    """Test rows against all others: same group, same text, or near duplicate."""
    r = proxy(spark, sf, "records").select("id", "grp", "split", "text")
    keyed = r.select("id", "grp", "split", F.sha2(X.normalise(F.col("text")), 256).alias("digest"))
    t, f = keyed.where("split = 'test'"), keyed.where("split <> 'test'").select(F.col("id").alias("ref_id"), "grp", "digest")
    same_group = t.join(f.drop("digest"), "grp").select(F.col("id").alias("test_id"), F.lit("group").alias("kind"), "ref_id")
    same_text = t.join(f.drop("grp"), "digest").select(F.col("id").alias("test_id"), F.lit("text").alias("kind"), "ref_id")
    near = similarity.similarity_join(similarity.token_sets(r.where("split = 'test'"), "id"), similarity.token_sets(r.where("split <> 'test'"), "id"))
    return same_group.union(same_text).union(near.select("left_id", F.lit("near"), "right_id")).distinct()


@query(
    "join_01_overlap_classes",
    f"""with r as (select id, grp, split, {DIGEST} as digest from records), c as (select 'group' as kind, grp::varchar as class, id, split from r union all select 'text', digest, id, split from r)
    select kind, class, count(*) filter (split = 'test') as n_test, count(*) filter (split <> 'test') as n_other, min(id) filter (split = 'test') as first_test, min(id) filter (split <> 'test') as first_other from c
    where class is not null group by 1, 2 having count(*) filter (split = 'test') > 0 and count(*) filter (split <> 'test') > 0""",
)
def overlap_classes(spark, sf):
    """The overlaps by group and text as one row a class with its counts: the form for classes of any size, where
    ``join_01_overlap_check`` has a row a pair."""
    r = proxy(spark, sf, "records").select("id", "split", F.col("grp").cast("string").alias("grp"), F.sha2(X.normalise(F.col("text")), 256).alias("digest"))
    kinds = F.array(F.struct(F.lit("group").alias("kind"), F.col("grp").alias("class")), F.struct(F.lit("text").alias("kind"), F.col("digest").alias("class")))
    c = r.select("id", (F.col("split") == "test").alias("test"), F.explode(kinds).alias("k")).select("id", "test", "k.*").where("class is not null")
    test, other = F.when(F.col("test"), F.col("id")), F.when(~F.col("test"), F.col("id"))
    g = c.groupBy("kind", "class").agg(F.count(test).alias("n_test"), F.count(other).alias("n_other"), F.min(test).alias("first_test"), F.min(other).alias("first_other"))
    return g.where("n_test > 0 and n_other > 0")


@query(
    "join_06_overlap_reason",
    f"""with r as (select id, grp, split, {DIGEST} as digest from records) select id, case when exists (select 1 from r b where b.split = 'test' and b.digest = r.digest) then 'text' when exists (select 1 from r b where b.split = 'test' and b.grp = r.grp) then 'group' end as reason from r where split <> 'test'""",
)
def overlap_reason(spark, sf):
    """The first reason for which a row may not be used beside the test split."""
    r = proxy(spark, sf, "records").select("id", "grp", "split", F.sha2(X.normalise(F.col("text")), 256).alias("digest"))
    t = r.where("split = 'test'")
    by_text, by_group = t.select("digest", F.lit("text").alias("a")).distinct(), t.select("grp", F.lit("group").alias("b")).distinct()
    return r.where("split <> 'test'").join(by_text, "digest", "left").join(by_group, "grp", "left").select("id", similarity.first_reason(F.col("a"), F.col("b")).alias("reason"))


@query("join_19_quote_join", "with q as (select distinct conv_id, substr(text, i, 50) as quote from (select conv_id, text, unnest(range(1, greatest(1, length(text) - 49) + 1, 25)) as i from conversations where length(text) > 0)) select quote, count(distinct conv_id) as n_conversations from q group by 1 having count(distinct conv_id) > 1")
def quote_join(spark, sf):
    """Windows of 50 characters that several conversations share, counted before they are grouped."""
    c = table(spark, sf, "conversations").where(F.length("text") > 0)
    last = F.greatest(F.lit(1), F.length("text") - 49)
    q = c.select("conv_id", F.explode(F.transform(F.sequence(F.lit(1), last, F.lit(25)), lambda i: F.substring(F.col("text"), i, F.lit(50)))).alias("quote")).distinct()
    return q.groupBy("quote").agg(F.count(F.lit(1)).alias("n_conversations")).where("n_conversations > 1")


@query(
    "join_19_quotes_anywhere",
    r"""with t as (select distinct conv_id, trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g')) as t from conversations where text is not null), w as (select conv_id, t from t where t <> ''),
    q as (select distinct substr(t, i, 50) as quote from (select t, unnest(list_append(range(1, greatest(1, length(t) - 49) + 1, 25), greatest(1, length(t) - 49))) as i from w)),
    o as (select conv_id, substr(t, i, 50) as quote from (select conv_id, t, unnest(range(1, length(t) - 49 + 1)) as i from w where length(t) >= 50)),
    h as (select q.quote, o.conv_id from q join o on q.quote = o.quote union select q.quote, w.conv_id from q join w on w.t = q.quote union select q.quote, w.conv_id from (select quote from q where length(quote) between 16 and 49) q join w on contains(w.t, q.quote))
    select quote, count(distinct conv_id) as n_conversations from h group by 1 having count(distinct conv_id) > 1""",
)
def quotes_anywhere(spark, sf):
    """Windows of conversations that others hold too, at whatever offset."""
    return quotes_of_several(table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "text")).withColumnRenamed("n", "n_conversations")


@query(
    "join_20_leak_scan",
    r"""with n as (select item_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ') || ' ' as needle from benchmark), d as (select doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ') || ' ' as hay from documents)
    select d.doc_id as id, n.item_id as needle_id from d join n on contains(hay, needle) where len(string_split(needle, ' ')) >= 8""",
)
def leak_scan(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return similarity.contained(d, table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"))


@query("join_21_leak_by_runs", f"with d as ({grams_sql('documents', 'doc_id', 8)}), b as ({grams_sql('benchmark', 'item_id', 8)}) select d.id, b.id as item_id, count(*) as n_runs from d join b on d.gram = b.gram group by 1, 2")
def leak_by_runs(spark, sf):
    d, b = similarity.ngram_rows(table(spark, sf, "documents"), "doc_id", 8), similarity.ngram_rows(table(spark, sf, "benchmark"), "item_id", 8)
    return d.join(b.select(F.col("id").alias("item_id"), "gram"), "gram").groupBy("id", "item_id").agg(F.count(F.lit(1)).alias("n_runs"))


@query("set_06_set_similarity", r"select a.page_id as a, b.page_id as b, round(len(list_intersect(a.w, b.w))::double / len(list_distinct(list_concat(a.w, b.w))), 6) as jaccard, round(len(list_intersect(a.w, b.w))::double / least(len(a.w), len(b.w)), 6) as containment from (select page_id, list_distinct(regexp_extract_all(lower(url), '[\p{L}\p{N}_]+')) as w, url from pages) a join (select page_id, list_distinct(regexp_extract_all(lower(url), '[\p{L}\p{N}_]+')) as w, url from pages) b on a.page_id < b.page_id and split_part(a.url, '/', 3) = split_part(b.url, '/', 3)")
def set_similarity(spark, sf):
    """Jaccard and containment of the words of urls, within a host: a row a pair. The pages of one host are dealt over 32
    tasks, each of which meets all pages of the host."""
    p = table(spark, sf, "pages").select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), F.array_distinct(X.words(F.col("url"))).alias("w"))
    q = salted_join(p, p.select(F.col("page_id").alias("b"), "host", F.col("w").alias("v")), ["host"], "page_id", salts=32).where("page_id < b")
    both = F.size(F.array_intersect("w", "v"))
    return q.select(F.col("page_id").alias("a"), "b", F.round(both / F.size(F.array_union("w", "v")), 6).alias("jaccard"), F.round(both / F.least(F.size("w"), F.size("v")), 6).alias("containment"))


HOST_WORDS = r"select page_id as id, split_part(url, '/', 3) as host, list_distinct(regexp_extract_all(lower(url), '[\p{L}\p{N}_]+')) as w from pages where url is not null"


@query(
    "set_06_alike_sets",
    f"""with s as ({HOST_WORDS}), k as (select min(id) as id, host, list_sort(w) as w from s group by host, list_sort(w)) select a.id as a, b.id as b, round(len(list_intersect(a.w, b.w))::double / len(list_distinct(list_concat(a.w, b.w))), 6) as jaccard from k a join k b on a.host = b.host and a.id < b.id
    where len(a.w) > 0 and len(b.w) > 0 and len(list_intersect(a.w, b.w)) >= 0.8 * len(list_distinct(list_concat(a.w, b.w))) - 1e-9""",
)
def alike_sets(spark, sf):
    """Distinct sets of words of urls that are alike, within a host: the rarest words of each set meet, not all sets of
    a host, so a host with most of the pages is no group of its own."""
    p = table(spark, sf, "pages").where("url is not null").select(F.col("page_id").alias("id"), F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), F.array_distinct(X.words(F.col("url"))).alias("w"))
    sets = p.select("id", F.transform("w", lambda x: F.xxhash64(F.col("host"), x)).alias("tokens"))
    found = similarity.similarity_join(similarity.distinct_sets(sets), similarity.distinct_sets(sets), 0.8, 1.0, 1 << 30, itself=True)
    return found.select(F.col("left_id").alias("a"), F.col("right_id").alias("b"), F.round(F.col("overlap") / (F.col("left_size") + F.col("right_size") - F.col("overlap")), 6).alias("jaccard"))
