"""Folders that are published whole, ledgers that only grow, and sources by name."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A source by its name: what gives its rows.
REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def source(name: str):
    """Registers a loader under a name; a name is given once."""

    def keep(f):
        if name in REGISTRY:
            raise ValueError(f"source {name} is taken")
        REGISTRY[name] = f
        return f

    return keep


def load(spark: SparkSession, name: str, folder: str) -> DataFrame:
    if name not in REGISTRY:
        raise KeyError(f"no source {name}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](spark, folder)


def _listed(spark: SparkSession, path: str):
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    return [(s.getPath().getName(), fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))) for s in fs.listStatus(at)] if fs.exists(at) else []


def published_folder(spark: SparkSession, path: str) -> str:
    """The newest snapshot below ``path`` (folders vN) that was written to its end: only these have a _SUCCESS file."""
    found = [(int(m[1]), name) for name, whole in _listed(spark, path) if whole and (m := re.fullmatch(r"v(\d+)", name))]
    if not found:
        raise FileNotFoundError(f"no published snapshot in {path}")
    return f"{path}/{max(found)[1]}"


def markdown(table: DataFrame, order: list[str], most: int = 1000) -> DataFrame:
    """(at, line) of a small table as Markdown, in ``order``; of a larger one the first ``most`` rows: a report."""
    cells = lambda names: F.concat(F.lit("| "), F.concat_ws(" | ", *names), F.lit(" |"))
    head = table.sparkSession.createDataFrame([(-2, f"| {' | '.join(table.columns)} |"), (-1, "|" + "---|" * len(table.columns))], "at long, line string")
    rows = table.orderBy(*order).limit(most).select(F.monotonically_increasing_id().alias("n"), cells([F.coalesce(F.col(c).cast("string"), F.lit("")) for c in table.columns]).alias("line"))
    return head.union(rows.select("n", "line"))
