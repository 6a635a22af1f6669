"""Scalar functions over the documents, each against its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.plans.catalog import query, table

W = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
COUNTS = {c: f"len(list_filter(v, lambda x: x in ({', '.join(chr(39) + w + chr(39) for w in known)})))" for c, known in [("en", X.COMMON_ENGLISH), *X.COMMON_OTHER.items()]}
ENGLISH_SQL = rf"""(select case when letters = 0 then false else not ({' or '.join(f"(({c} >= 2 and {c} > en) or ({c} >= 1 and en = 0))" for c in X.COMMON_OTHER)}) and not (en = 0 and n >= 4 and share < 0.98) and (share >= 0.9 or (share >= 0.6 and en >= 2)) end
  from (select letters, ascii / letters::double as share, len(v) as n, {', '.join(f"{q} as {c}" for c, q in COUNTS.items())} from (select length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) as letters, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as ascii,
    list_transform(list_filter(string_split_regex(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> ''), lambda x: lower(trim(x, '{X.EDGES.replace("'", "''")}'))) as v)))"""
GER = "(" + ", ".join(f"'{w}'" for w in X.GERMAN) + ")"
LOOSE = r"trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g'))"
NORM = r"trim(regexp_replace(lower(text), '[ \t\n\x0b\f\r]+', ' ', 'g'))"
ASCII = r"length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::double / nullif(length(regexp_replace(text, '[ \t\n\x0b\f\r]', '', 'g')), 0)"


def shingles_sql(w: str, n: int) -> str:
    return f"case when len({w}) = 0 then [] when len({w}) <= {n} then [array_to_string({w}, ' ')] else list_sort(list_distinct(list_transform(range(1, len({w}) - {n - 1} + 1), lambda i: array_to_string({w}[i:i + {n - 1}], ' ')))) end"


def at_most(x):
    return F.array_sort(x)


#: name: (column expression of text, SQL)
SCALARS = {
    "str_01_normalise": (X.normalise, NORM),
    "str_02_normalise_loose": (X.normalise_loose, LOOSE),
    "str_03_normalise_long": (X.normalise_long, f"case when length({NORM}) >= 20 then {NORM} end"),
    "str_05_shingles": (lambda t: F.array_join(at_most(X.shingles(X.words(t))), "|"), f"(select array_to_string({shingles_sql('w', 5)}, '|') from (select {W} as w))"),
    "str_07_is_english": (X.is_english, ENGLISH_SQL),
    "str_08_ascii_letter_share": (lambda t: F.round(X.ascii_letter_share(t), 6), f"round({ASCII}, 6)"),
    "str_09_german_suspect": (lambda t: X.hits(t, X.GERMAN) >= 3, f"len(list_filter({W}, lambda x: x in {GER})) >= 3"),
    "str_10_lexicon_terms": (lambda t: F.array_join(X.lexicon_terms(t, ("the", "von", "que", "les", "und")), ","), f"array_to_string(list_sort(list_distinct(list_filter({W}, lambda x: x in ('the', 'von', 'que', 'les', 'und')))), ',')"),
    "str_11_bucket": (lambda t: X.bucket_of(t, ("and", "und"), ("worthless", "shut")), f"case when len(list_filter({W}, lambda x: x in ('worthless', 'shut'))) > 0 then 'strong' when len(list_filter({W}, lambda x: x in ('and', 'und'))) > 0 then 'mild' else 'clean' end"),
    "str_12_phrase": (lambda t: X.contains_phrase(t, "the and"), f"contains(concat(' ', {LOOSE}, ' '), ' the and ')"),
    "str_13_entity_flags": (
        lambda t: F.array_join(X.entity_flags(t), ","),
        r"""array_to_string(list_filter([case when regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+') then 'email' end, case when regexp_matches(text, '\+?[0-9][0-9 ().-]{7,}[0-9]') then 'phone' end,
        case when regexp_matches(text, '[0-9]{3}-[0-9]{2}-[0-9]{4}') then 'ssn' end, case when regexp_matches(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}') then 'ip' end, case when regexp_matches(text, '[0-9]+ [A-Z][a-z]+ (Street|Road|Avenue|Lane)') then 'street' end], lambda x: x is not null), ',')""",
    ),
    "str_14_ip_values": (
        lambda t: F.array_join(X.ip_values(t), ","),
        r"array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}'), lambda x: list_max(list_transform(string_split(x, '.'), lambda p: p::int)) <= 255))), ',')",
    ),
    "str_17_format_flags": (
        lambda t: F.to_json(X.format_flags(t)),
        r"""concat('{"multiline":', contains(text, chr(10)), ',"question":', regexp_matches(text, '[?]'), ',"url":', regexp_matches(text, 'https?://'), ',"markup":', regexp_matches(text, '```|<[a-z]+>'),
        ',"shouting":', len(regexp_extract_all(text, '[A-Z]')) * 2 > len(regexp_extract_all(text, '[A-Za-z]')), '}')""",
    ),
    "str_18_log2_bin": (lambda t: X.log2_bin(F.length(t)), "floor(log2(greatest(1, length(text))))::int"),
    "str_19_edge_bin": (lambda t: X.edge_bin(F.length(t), (50, 200, 1000, 5000)), "(length(text) >= 50)::int + (length(text) >= 200)::int + (length(text) >= 1000)::int + (length(text) >= 5000)::int"),
    "str_21_sentences": (lambda t: F.size(X.sentences(t)), r"len(list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), lambda s: trim(s)), lambda s: s <> ''))::int"),
    "str_22_probe": (X.probe, f"(select array_to_string(w[greatest(1, floor((len(w) - 6) / 2.0)::int + 1):greatest(1, floor((len(w) - 6) / 2.0)::int + 1) + 5], ' ') from (select {W} as w))"),
    "str_23_quote_windows": (
        lambda t: F.array_join(F.transform(X.quote_windows(t), F.md5), ","),
        "case when length(text) > 0 then array_to_string(list_transform(list_concat(range(1, greatest(1, length(text) - 49) + 1, 25), case when (greatest(1, length(text) - 49) - 1) % 25 = 0 then [] else [greatest(1, length(text) - 49)] end), lambda i: md5(substr(text, i, 50))), ',') else '' end",
    ),
    "str_24_redact": (lambda t: F.coalesce(X.redact(t, F.length(t) % 2 == 0)["text"], X.redact(t, F.lit(False))["digest"]), "case when length(text) % 2 = 0 then text else sha256(text) end"),
    "str_25_ids_only": (lambda t: F.sha2(t, 256), "sha256(text)"),
    "str_28_obfuscations": (lambda t: F.concat_ws("|", F.md5(X.leet(t)), F.md5(X.zero_width(t)), F.md5(F.regexp_replace(X.base64_text(t), "[\r\n]", ""))), "concat_ws('|', md5(translate(text, 'aeiost', '431057')), md5(replace(text, 'a', 'a' || chr(8203))), md5(base64(encode(text))))"),
    "str_29_mask_email": (lambda t: F.md5(X.mask_email(t)), r"md5(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+', '<email>', 'g'))"),
    "str_30_token_estimate": (X.token_estimate, "ceil(length(text) / 3.5)::int"),
    "ded_11_template_key": (
        X.template_key,
        r"sha1(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+', '<email>', 'g'), '(january|february|march|april|may|june|july|august|september|october|november|december)', '<month>', 'g'), '[0-9]+', '<n>', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g'))",
    ),
    "mth_01_unit_interval": (lambda t: F.round(X.unit_interval(F.sha2(t, 256)), 9), "round(('0x' || substr(sha256(text), 1, 13))::bigint / 4503599627370496.0::double, 9)"),
}


def _register(name, column, sql):
    @query(name, f"select doc_id, {sql} as value from documents")
    def scalar(spark, sf):
        return table(spark, sf, "documents").select("doc_id", column(F.col("text")).alias("value"))

    scalar.__name__ = name


for _name, (_column, _sql) in SCALARS.items():
    _register(_name, _column, _sql)


@query("str_04_compatible_words")
def compatible_words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(X.compatible_words(F.col("text"))).alias("n_words"))


@query(
    "str_06_field_shingles",
    f"select page_id, (select array_to_string(list_sort(list_distinct(list_concat({shingles_sql('u', 3)}, {shingles_sql('h', 3)}))), '|') from (select regexp_extract_all(lower(url), '[\\p{{L}}\\p{{N}}_]+') as u, regexp_extract_all(lower(html), '[\\p{{L}}\\p{{N}}_]+') as h)) as value from pages",
)
def field_shingles(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(F.array_sort(X.field_shingles([F.col("url"), F.col("html")], 3)), "|").alias("value"))


@query("str_06_whole_field_shingles")
def whole_field_shingles(spark, sf):
    """Shingles of whole fields, held against plain Python by a test."""
    return table(spark, sf, "pages").select("page_id", F.array_join(F.array_sort(X.field_shingles([F.col("url"), F.col("html")], 3)), "|").alias("value"))


@query("mth_01_salted_order")
def salted_order(spark, sf):
    """HMAC order keys; SQL has no HMAC, tests hold them against the standard library."""
    return table(spark, sf, "documents").select("doc_id", X.salted(F.col("doc_id").cast("string"), "plumbline").alias("key"))


@query(
    "snk_10_shards",
    """with recursive h(conv_id, k, i, x) as (select conv_id, conv_id::varchar, 0, 2166136261::bigint from (select distinct conv_id from conversations)
      union all select conv_id, k, i + 1, (xor(x, ascii(substr(k, i + 1, 1))::bigint) * 16777619) % 4294967296 from h where i < length(k))
    select x % 64 as shard, count(*) as n from h where i = length(k) group by 1""",
)
def shards(spark, sf):
    ids = table(spark, sf, "conversations").select("conv_id").distinct()
    return ids.groupBy((X.fnv1a(F.col("conv_id").cast("string")) % 64).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "dat_01_iso_times",
    "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as iso, epoch(date_trunc('second', ts))::bigint as seconds from events",
)
def iso_times(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))
    return e.select("event_id", "iso", F.unix_timestamp(F.to_timestamp("iso", "yyyy-MM-dd'T'HH:mm:ss")).alias("seconds"))


@query("jsn_01_strings_of_json", "select event_id, string_agg(v, '|' order by k) as strings from (select event_id, k, json_extract_string(props, '$.' || k) as v from (select event_id, props, unnest(json_keys(props)) as k from events)) where v is not null group by event_id")
def strings_of_json(spark, sf):
    m = F.from_json("props", "map<string,string>")
    e = table(spark, sf, "events").select("event_id", F.explode(m).alias("k", "v")).where("v is not null")
    return e.groupBy("event_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]), "|").alias("strings"))


@query(
    "jsn_03_notes_with_fallback",
    "select doc_id, coalesce(try_cast(case when doc_id % 3 = 0 then '{\"n\": ' || n_chars || '}' when doc_id % 3 = 1 then 'not json' end as json) ->> '$.n', 'none') as note from documents",
)
def notes_with_fallback(spark, sf):
    note = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"n": '), F.col("n_chars").cast("string"), F.lit("}"))).when(F.col("doc_id") % 3 == 1, "not json")
    return table(spark, sf, "documents").select("doc_id", F.coalesce(F.get_json_object(note, "$.n"), F.lit("none")).alias("note"))
