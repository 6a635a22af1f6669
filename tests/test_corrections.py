"""Corrections as a stream: restarts, records in any order, keys that are forgotten."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from plumbline.streaming.corrections import best_records, corrections, use_disk_state

BASE = datetime.datetime(2024, 1, 1)


def run(spark, folder, name, make, mode="update"):
    """Runs the stream over what its input folder has now; gives all changes so far."""
    out = f"{folder}/{name}-out"
    q = make().writeStream.outputMode(mode).foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/b{n:05}")).option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(out).drop("batch").collect()


def put(spark, folder, rows, number):
    spark.createDataFrame(rows, "k long, seq long, ok boolean, at timestamp").coalesce(1).write.parquet(f"{folder}/in/p{number}")


def stream(spark, folder):
    return spark.readStream.schema("k long, seq long, ok boolean, at timestamp").option("recursiveFileLookup", "true").parquet(f"{folder}/in")


def best(rows):
    out = {}
    for k, seq, ok, _ in rows:
        out[k] = max(out.get(k, (False, -1)), (ok, seq))
    return {k: (seq, ok) for k, (ok, seq) in out.items()}


def last_change(changes):
    out = {}
    for r in changes:
        if r.k not in out or r.change > out[r.k][0]:
            out[r.k] = (r.change, r.seq, r.ok)
    return {k: v[1:] for k, v in out.items()}


def test_two_restarts_give_the_batch_answer(spark, tmp_path):
    use_disk_state(spark)
    rng = random.Random(3)
    rows = [(rng.randrange(40), s, rng.random() < 0.4, BASE) for s in range(300)]
    rng.shuffle(rows)
    done = []
    for n in range(3):
        part = rows[n * 100 : (n + 1) * 100]
        done += part
        put(spark, tmp_path, part, n)
        changes = run(spark, tmp_path, "s", lambda: corrections(stream(spark, tmp_path).select("k", "seq", "ok"), ["k"]))
        assert last_change(changes) == best(done)
    seen = {}
    for r in sorted(changes, key=lambda r: (r.k, r.change)):
        assert (r.ok, r.seq) > seen.get(r.k, (False, -1))  # each change is a better record
        seen[r.k] = (r.ok, r.seq)


def test_keys_are_forgotten_and_opened_anew(spark, tmp_path):
    """A success supersedes a failure while the key is kept; after its timer a late record is change 0 again."""
    use_disk_state(spark)
    minute = datetime.timedelta(minutes=1)
    make = lambda: corrections(stream(spark, tmp_path).withWatermark("at", "1 minute"), ["k"], keep_ms=10 * 60_000)
    put(spark, tmp_path, [(1, 1, False, BASE), (2, 1, True, BASE)], 0)
    run(spark, tmp_path, "e", make)
    put(spark, tmp_path, [(1, 2, True, BASE + 5 * minute)], 1)
    changes = run(spark, tmp_path, "e", make)
    assert {(r.k, r.seq, r.ok, r.change) for r in changes} == {(1, 1, False, 0), (2, 1, True, 0), (1, 2, True, 1)}
    put(spark, tmp_path, [(3, 1, True, BASE + 60 * minute)], 2)  # the watermark passes
    run(spark, tmp_path, "e", make)
    put(spark, tmp_path, [(1, 3, False, BASE + 60 * minute), (3, 2, True, BASE + 60 * minute)], 3)
    changes = run(spark, tmp_path, "e", make)
    assert (1, 3, False, 0) in {(r.k, r.seq, r.ok, r.change) for r in changes}, "forgotten: opened anew"
    assert (3, 2, True, 1) in {(r.k, r.seq, r.ok, r.change) for r in changes}, "kept: a correction"


def test_best_records_over_restarts(spark, tmp_path):
    """Worse and later records in later batches: of a key's rows the last batch's stands, and no Python runs a key."""
    use_disk_state(spark)
    rng = random.Random(5)
    done = []
    make = lambda: best_records(stream(spark, tmp_path).select("k", "seq", "ok"), ["k"])
    for n in range(2):
        part = [(rng.randrange(40), rng.randrange(100), rng.random() < 0.4, BASE) for _ in range(100)]
        done += part
        put(spark, tmp_path, part, n)
        run(spark, tmp_path, "b", make)
        rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/b-out").collect()
        last = {}
        for r in sorted(rows, key=lambda r: r.batch):
            last[r.k] = (r.seq, r.ok)
        assert last == best(done)
    assert "InPandas" not in make()._jdf.queryExecution().analyzed().toString()
