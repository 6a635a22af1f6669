"""Answers of judges as columns: a value where the answer is readable, else why it isn't. And the rule that needs no judge."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
BINARY = r"""^[\s"'`*]*([01])[\s"'`*.]*$"""
#: A JSON array of strings, and one of its strings.
STRINGS, STRING = r'^\[\s*("([^"\\]|\\.)*"\s*(,\s*"([^"\\]|\\.)*"\s*)*)?\]$', r'"((?:[^"\\]|\\.)*)"'


def bare(content: Column) -> Column:
    return F.btrim(F.coalesce(content, F.lit("")), F.lit(BLANKS))


def parse_binary(content: Column) -> Column:
    """(value, error): 0 or 1, whatever quotes, asterisks and full stop stand around it."""
    t = bare(content)
    value = F.when(t.rlike(BINARY), F.regexp_extract(t, BINARY, 1).cast("int"))
    return F.struct(value.alias("value"), F.when(value.isNull(), F.when(t == "", "empty answer").otherwise("expected 0 or 1")).alias("error"))


def parse_types(content: Column, known: list[str]) -> Column:
    """(types, error): the names of a JSON array that may stand in other text, in upper case and order; only ``known`` ones."""
    t = bare(content)
    found = F.regexp_extract(t, r"(?s)\[.*?\]", 0)
    names = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(found, F.lit(STRING), F.lit(1)), lambda x: F.upper(F.btrim(x, F.lit(BLANKS))))))
    error = (
        F.when(t == "", "empty answer").when(found == "", "expected a JSON array").when(F.try_parse_json(found).isNull(), "unreadable JSON array")
        .when(~found.rlike(STRINGS), "the array must hold type names").when(F.exists(names, lambda x: ~x.isin(*known)), "unknown entity types")
    )
    return F.struct(F.when(error.isNull(), names).alias("types"), error.alias("error"))


def parse_safety(content: Column, categories: list[str]) -> Column:
    """(unsafe, categories, error): a first line that says safe or unsafe, and then, if unsafe, one or more known categories."""
    lines = F.filter(F.transform(F.split(F.coalesce(content, F.lit("")), "\r?\n"), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")
    first = F.lower(F.coalesce(F.get(lines, F.lit(0)), F.lit("")))
    rest = F.flatten(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.split(x, ",")))
    named = F.array_sort(F.array_distinct(F.filter(F.transform(rest, lambda x: F.upper(F.btrim(x, F.lit(BLANKS)))), lambda x: x != "")))
    unsafe = first == "unsafe"
    error = F.when(first == "", "empty answer").when(~first.isin("safe", "unsafe"), "expected safe or unsafe").when(unsafe & ((F.size(named) == 0) | F.exists(named, lambda x: ~x.isin(*categories))), "unsafe with unreadable categories")
    value = F.when(error.isNull(), unsafe.cast("int"))
    return F.struct(value.alias("unsafe"), F.when(value == 1, named).when(value == 0, F.array().cast("array<string>")).alias("categories"), error.alias("error"))


def phrase_pattern(phrase: str) -> str:
    """A phrase as whole words, whatever its case and the white space inside it."""
    return r"(?i)(^|[^A-Za-z0-9])" + r"\s+".join(re.escape(w) for w in phrase.split()) + r"($|[^A-Za-z0-9])"


def answer_name(phrase: str) -> str:
    return re.sub(r"[^0-9a-z]", "_", phrase.lower()).strip("_")


def word_scores(text: Column, phrases: list[str]) -> Column:
    """A map of scores, 1 where a text has the phrase and 0 elsewhere, and ``any_word``: the word rule as a system of its own."""
    scores = {answer_name(p): text.rlike(phrase_pattern(p)).cast("double") for p in phrases}
    pairs = [x for k, v in scores.items() for x in (F.lit(k), v)]
    return F.create_map(*pairs, F.lit("any_word"), F.greatest(*scores.values(), F.lit(0.0)))
