"""A run ledger as a stream: what is done isn't done again, each key keeps its first good record, appends are exact."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def run_stream(stream: DataFrame, transform, folder: str, name: str, mode: str = "append") -> str:
    """Runs a stream over all that is there now, each micro-batch appended as parquet in a folder of its own number,
    so that a batch that runs again overwrites itself; gives the folder."""
    out = f"{folder}/{name}"

    def append(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(append).option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return out


def deduplicate(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first record of each key that arrives; state grows by a key. With a watermark on an event time use
    ``dropDuplicatesWithinWatermark`` instead, which forgets."""
    return stream.dropDuplicates(keys)


def undone(calls: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Calls that no successful record answers: a resume."""
    return calls.join(ledger.where("ok").select(*keys).distinct(), keys, "left_anti")


def exhausted(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Whether the last attempt of any chunk failed, for each key of (chunk, attempt, ok) rows."""
    last = attempts.groupBy(*keys, "chunk").agg(F.max_by("ok", "attempt").alias("ok"))
    return last.groupBy(*keys).agg(F.bool_or(~F.col("ok")).alias("exhausted"))
