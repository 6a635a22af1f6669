"""Lookups by id read a part of the table that the ids bound."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumbline.sources.lookup import lookup, write_indexed

N = 400_000


def read_of(spark, job) -> tuple[int, int]:
    """(records, bytes) that a job's scans read."""
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, none, None)
    known = {stages().apply(k).stageId() for k in range(stages().size())}
    job()
    now = [stages().apply(k) for k in range(stages().size())]
    new = [s for s in now if s.stageId() not in known]
    return sum(s.inputRecords() for s in new), sum(s.inputBytes() for s in new)


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lookup") / "t")
    rows = spark.range(N).select((F.col("id") * 3).alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("v")).orderBy(F.rand(1))
    write_indexed(rows, path, "id", group_bytes=1 << 20)
    return path


def test_ids_are_found(spark, indexed):
    ids = spark.createDataFrame([(0,), (3,), (4,), (None,), (3 * N - 3,), (3 * N,), (3,)], "id long")
    assert sorted(r.id for r in lookup(spark, indexed, ids, "id").collect()) == [0, 3, 3 * N - 3]
    many = spark.range(0, 3 * N, 7).select("id")
    assert lookup(spark, indexed, many, "id", listed=100).count() == len([i for i in range(0, 3 * N, 7) if i % 3 == 0])
    assert lookup(spark, indexed, ids.limit(0), "id").count() == 0


def test_few_rows_are_read(spark, indexed):
    size = sum(f.stat().st_size for f in Path(indexed).glob("*.parquet"))
    assert read_of(spark, lambda: spark.read.parquet(indexed).select(F.max("v")).collect())[0] == N and size > 10 << 20
    found = lookup(spark, indexed, spark.range(300_000, 303_000, 3).select("id"), "id")
    records, read = read_of(spark, lambda: found.select(F.max("v"), F.count("id")).collect())
    assert records < N / 20 and read < size / 4
    absent = lookup(spark, indexed, spark.createDataFrame([(600_001,), (30_002,)], "id long"), "id")
    assert read_of(spark, lambda: absent.select(F.max("v")).collect())[0] < N / 50


def test_a_long_list_is_one_set(spark, indexed):
    """Thousands of listed ids: as a chain of comparisons they overflowed the stack of a task."""
    ids = spark.range(0, 3 * N, 3 * 41).select("id")
    assert 5_000 < ids.count() <= 10_000
    got = lookup(spark, indexed, ids, "id").agg(F.count("id"), F.sum("id"), F.count("v")).first()
    want = range(0, 3 * N, 3 * 41)
    assert tuple(got) == (len(want), sum(want), len(want))
