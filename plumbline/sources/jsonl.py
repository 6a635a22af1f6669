"""JSON Lines: strict and tolerant scans of records, raw lines, and a validated writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of a record that scans and writers know; in the order in which a line has them.
RECORD = (
    "expected string, expected_distribution map<string,double>, feature string, `group` string, id string, labels array<string>, "
    "provenance struct<exclude_reason:string,label_basis:string,licence:string,source:string>, spans array<struct<end:int,label:string,start:int>>, "
    "split string, state struct<text:string>, subtask string, visibility string"
)
SPLITS, VISIBILITIES = ("test", "dev", "private", "tune"), ("public", "private")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, file) of every line that isn't blank. Lines end at \\n alone: other line ends may stand inside texts.

    Files of any number and size are read in splits; gzip files by their ending, each in one task."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file")).where(F.trim("line") != "")


def first_problem(r: Column | None = None) -> Column:
    """The first rule that a record breaks, null if none: rules in a fixed order, the cheap ones first."""
    at = (lambda name: F.col(f"`{name}`")) if r is None else (lambda name: r[name])
    labels, expected, text, spread = at("labels"), at("expected"), at("state")["text"], at("expected_distribution")
    n = F.length(text)
    bad_span = lambda s: ~F.coalesce((s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= n) & (s["label"] != ""), F.lit(False))
    total = F.aggregate(F.map_values(spread), F.lit(0.0), lambda a, x: a + x)
    rules = [
        (at("id").isNull() | (at("id") == ""), "no id"),
        (F.coalesce(at("feature"), F.lit("")) == "", "no feature"),
        (F.coalesce(at("subtask"), F.lit("")) == "", "no subtask"),
        (~F.coalesce(at("split").isin(*SPLITS), F.lit(False)), "bad split"),
        (~F.coalesce(at("visibility").isin(*VISIBILITIES), F.lit(False)), "bad visibility"),
        (F.coalesce(F.size(labels), F.lit(0)) <= 0, "empty labels"),
        (expected.isNotNull() & ~F.coalesce(F.array_contains(labels, expected), F.lit(False)), "expected not in labels"),
        (F.coalesce(text, F.lit("")) == "", "empty text"),
        (F.coalesce(F.exists(at("spans"), bad_span), F.lit(False)), "bad span"),
        (spread.isNotNull() & (F.array_sort(F.map_keys(spread)) != F.array_sort(labels)), "distribution keys"),
        (F.coalesce(F.abs(total - 1) > 1e-6, F.lit(False)), "distribution sum"),
    ]
    return F.coalesce(*[F.when(c, F.lit(name)) for c, name in rules])


def read_tolerant(spark: SparkSession, path: str) -> DataFrame:
    """Every line as a record, with ``problem`` (null for a good one), the ``line`` itself and its ``file``.

    Nothing is dropped: a line that is no JSON object keeps null fields and the problem "not json"."""
    parsed = F.from_json("line", f"{RECORD}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = lines(spark, path).withColumn("r", parsed)
    problem = F.when(F.col("r").isNull() | F.col("r._corrupt").isNotNull(), "not json").otherwise(first_problem(F.col("r")))
    return rows.select("r.*", problem.alias("problem"), "line", "file").drop("_corrupt")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a file in which every line is good; the first bad line that a task meets fails the job by name."""
    rows = read_tolerant(spark, path)
    refused = F.raise_error(F.concat(F.coalesce("id", F.lit("?")), F.lit(": "), "problem"))
    checked = F.when(F.col("problem").isNotNull(), refused.cast("string")).otherwise(F.col("id"))
    return rows.withColumn("id", checked).drop("problem", "line", "file")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Every line as a variant value, whatever its fields; null where it is no JSON."""
    return lines(spark, path).select(F.try_parse_json("line").alias("value"), "file")


def write_lines(rows: DataFrame, path: str, compression: str = "none") -> None:
    """Rows as JSON Lines, null fields left out, every task its own file."""
    rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("value")).write.option("lineSep", "\n").option("compression", compression).text(path)


def write_records(records: DataFrame, path: str, compression: str = "none") -> None:
    """Records with fields in the order of ``RECORD``; a record that breaks a rule fails the write."""
    from pyspark.sql.types import _parse_datatype_string

    names = [f.name for f in _parse_datatype_string(RECORD).fields]
    refused = F.raise_error(F.concat(F.coalesce("id", F.lit("?")), F.lit(": "), first_problem())).cast("string")
    checked = records.withColumn("id", F.when(first_problem().isNotNull(), refused).otherwise(F.col("id")))
    write_lines(checked.select(*[F.col(f"`{n}`") for n in names]), path, compression)
