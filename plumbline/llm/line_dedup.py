"""Line dedup, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SPACES, ascii_lower, fresh, salted_join


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def line_hashes(key: Column) -> tuple[Column, Column]:
    """Two hashes of a key, h and g. Spark seeds a hash of several columns with the hash of those before it: the
    constant must come first, or g would be a function of h and tell no more than it."""
    return F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("g")


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated lines taken out of the text, plus n_lines and n_dropped.

    Lines are split at newline. A key of ``min_chars`` code points or more that ``min_docs`` different documents
    hold loses all its lines except in the document with the largest id that holds it. Nothing is collected or
    broadcast: lines are exploded, their keys hashed (128 bits, two independent 64-bit hashes), counted with a
    pre-aggregated distinct count, and what must go comes back to its document as the set of positions. The lines of
    one very common key are dealt over several tasks when they meet that key's count.

    Defined cases: a null text counts as one empty line and becomes ""; an empty text is one empty line; rows
    with one id count as one document; a null id is a document of its own kind and never the one that keeps a line
    if another holds it; an empty table gives an empty table; other columns pass untouched, whatever their names.
    """
    doc, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    n_lines, n_dropped = "n_lines", "n_dropped"

    # One projection computes each key once.
    lines = docs.select(doc.alias("d"), F.xxhash64(text).alias("row"), F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))
    keys = lines.where(F.length("line") >= min_chars).select("d", "row", "at", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    tags = keys.select("d", "row", "at", *line_hashes(F.col("key")))
    held = tags.groupBy("h", "g").agg(F.count_distinct(F.coalesce(F.col("d"), F.lit(-(2**63)))).alias("n"), F.max("d").alias("last")).where(F.col("n") >= min_docs)
    gone = salted_join(tags, held, ["h", "g"], "d").where(~F.col("d").eqNullSafe(F.col("last"))).groupBy("d", "row").agg(F.collect_set("at").alias("gone"))

    d, r, mark, lines = (fresh(docs, x) for x in ("_d", "_row", "_gone", "_lines"))
    # Equality that also joins null ids: the hash of the text is never null, and a null id hashes to its seed.
    joined = docs.join(gone.select(F.col("d").alias(d), F.col("row").alias(r), F.col("gone").alias(mark)), (F.xxhash64(text) == F.col(r)) & doc.eqNullSafe(F.col(d)), "left")
    joined = joined.withColumn(lines, F.split(text, "\n", -1))
    # array_except works on a hash set and keeps the order of the positions.
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(mark))
    out = joined.withColumn(d, F.when(F.col(mark).isNull(), text).otherwise(F.array_join(F.transform(left, lambda p: F.element_at(F.col(lines), p + 1)), "\n")))
    same = [F.col(f"`{c}`") if c != text_col else F.col(d).alias(text_col) for c in docs.columns if c.lower() not in (n_lines, n_dropped)]
    return out.select(*same, F.size(lines).cast("long").alias(n_lines), F.coalesce(F.size(F.col(mark)), F.lit(0)).cast("long").alias(n_dropped))
