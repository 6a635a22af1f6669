"""Answers read into verdicts, and the word rule as a scorer."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import verdicts as V
from plumbline.plans.catalog import query, table
from plumbline.plans.scoring import rounded

KNOWN, CATEGORIES = ["NAME", "EMAIL", "PHONE", "ADDRESS"], [f"S{k}" for k in range(1, 15)]
#: Answers of every kind, by the document's id; other documents answer with the head of their own text.
ANSWERS = {
    0: "0", 1: ' "**1**". ', 2: "", 4: "yes", 5: 'I found ["name", " EMAIL ", "NAME"].', 6: "none: []", 7: '["NAME", 3]', 8: '["NAME"', 9: "unsafe\nS1, s2\n\nS1", 10: " SAFE ", 11: "unsafe", 12: "unsafe\nS99",
    13: "[NAME]", 14: '["CAR"]', 15: "1.", 16: "safe\nS1", 17: "`0`\n",
}
ANSWER_SQL = "case doc_id % 20 " + " ".join(f"when {k} then {' || chr(10) || '.join(chr(39) + p + chr(39) for p in t.split(chr(10)))}" for k, t in ANSWERS.items()) + " when 3 then null else substr(text, 1, 60) end"
TRIM = r"regexp_replace(coalesce(c, ''), '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g')"
KNOWN_SQL, CATEGORIES_SQL = (", ".join(f"'{x}'" for x in xs) for xs in (KNOWN, CATEGORIES))


@query(
    "udf_05_verdicts",
    rf"""with a as (select doc_id, {ANSWER_SQL} as c from documents), t as (select doc_id, c, {TRIM} as t from a), j as (select *, regexp_extract(t, '(?s)\[.*?\]') as j from t),
    n as (select *, list_sort(list_distinct(list_transform(regexp_extract_all(j, '{V.STRING}', 1), lambda x: upper(trim(x))))) as names, list_filter(list_transform(string_split(coalesce(c, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') as lines from j),
    g as (select *, lower(coalesce(lines[1], '')) as head, list_sort(list_distinct(list_filter(list_transform(flatten(list_transform(lines[2:], lambda x: string_split(x, ','))), lambda x: upper(trim(x))), lambda x: x <> ''))) as named from n),
    e as (select *, case when t = '' then 'empty answer' when j = '' then 'expected a JSON array' when not json_valid(j) then 'unreadable JSON array' when not regexp_matches(j, '{V.STRINGS}') then 'the array must hold type names' when len(list_filter(names, lambda x: x not in ({KNOWN_SQL}))) > 0 then 'unknown entity types' end as types_error,
      case when head = '' then 'empty answer' when head not in ('safe', 'unsafe') then 'expected safe or unsafe' when head = 'unsafe' and (len(named) = 0 or len(list_filter(named, lambda x: x not in ({CATEGORIES_SQL}))) > 0) then 'unsafe with unreadable categories' end as safety_error from g)
    select doc_id, case when regexp_matches(t, '{V.BINARY.replace(chr(39), chr(39) * 2)}') then regexp_extract(t, '{V.BINARY.replace(chr(39), chr(39) * 2)}', 1)::int end as verdict,
      case when not regexp_matches(t, '{V.BINARY.replace(chr(39), chr(39) * 2)}') then case when t = '' then 'empty answer' else 'expected 0 or 1' end end as verdict_error,
      case when types_error is null then array_to_string(names, ',') end as types, types_error, case when safety_error is null then (head = 'unsafe')::int end as unsafe, case when safety_error is null then case when head = 'unsafe' then array_to_string(named, ',') else '' end end as categories, safety_error from e""",
)
def verdicts(spark, sf):
    """Every answer read by each of the three readers: a value, or the reason why there is none."""
    k = F.col("doc_id") % 20
    c = F.when(k == 3, F.lit(None).cast("string"))
    for n, t in ANSWERS.items():
        c = c.when(k == n, t)
    a = table(spark, sf, "documents").select("doc_id", c.otherwise(F.substring("text", 1, 60)).alias("c"))
    r = a.select("doc_id", V.parse_binary(F.col("c")).alias("b"), V.parse_types(F.col("c"), KNOWN).alias("t"), V.parse_safety(F.col("c"), CATEGORIES).alias("s"))
    return r.select(
        "doc_id", F.col("b.value").alias("verdict"), F.col("b.error").alias("verdict_error"), F.array_join("t.types", ",").alias("types"), F.col("t.error").alias("types_error"),
        F.col("s.unsafe").alias("unsafe"), F.array_join("s.categories", ",").alias("categories"), F.col("s.error").alias("safety_error"),
    )


PHRASES = ["worthless", "shut up", "this is", "C++"]


@query(
    "udf_09_word_rule",
    "with s as (select doc_id, "
    + ", ".join(f"regexp_matches(text, '{V.phrase_pattern(p)}')::int as {V.answer_name(p)}" for p in PHRASES)
    + f" from documents where text is not null) select l.toxic, count(*) as n, {', '.join(f'round(avg({V.answer_name(p)}), 6) as {V.answer_name(p)}' for p in PHRASES)}, round(avg(greatest({', '.join(map(V.answer_name, PHRASES))})), 6) as any_word from s join labels l using (doc_id) group by 1",
)
def word_rule(spark, sf):
    """The word rule as a system: its scores by label, so that what a plain list of words achieves stands beside judges."""
    s = table(spark, sf, "documents").where("text is not null").select("doc_id", V.word_scores(F.col("text"), PHRASES).alias("scores"))
    names = [*map(V.answer_name, PHRASES), "any_word"]
    g = s.join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id").groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col("scores")[x]).alias(x) for x in names])
    return rounded(g, "toxic", "n")
