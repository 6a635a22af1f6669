"""The best record of every key as a stream of changes, in typed state that forgets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State lives in a store on disk that is checkpointed to the shared folder, not in the memory of an executor.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Corrections(StatefulProcessor):
    """Keeps a key's best record (ok, seq): a success before a failure, then the later one. Each time the best changes,
    the change is emitted, with how many there were before it.

    With an event time, a key is forgotten by a timer once the watermark passes its last record by ``keep_ms``. A record
    that comes after that opens the key anew: it is emitted as change 0, and who keeps the changes settles it by ``seq``.
    """

    STATE = "ok boolean, seq long, changes long, last long"

    def __init__(self, keep_ms: int | None, columns: list[str]):
        self.keep_ms, self.columns = keep_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", self.STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ok, seq, changes, last = self.best.get() if self.best.exists() else (None, None, -1, 0)
        before = changes
        for frame in rows:
            for r in frame.sort_values(["seq", "ok"]).itertuples():
                if self.keep_ms is not None:
                    last = max(last, int(r.at.timestamp() * 1000))
                if ok is None or (bool(r.ok), int(r.seq)) > (ok, seq):
                    ok, seq, changes = bool(r.ok), int(r.seq), changes + 1
        if self.keep_ms is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last + self.keep_ms)
        self.best.update((ok, seq, changes, last))
        if changes > before:
            yield self.made(key, seq, ok, changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.best.clear()
        yield from ()

    def made(self, key, seq: int, ok: bool, changes: int) -> pd.DataFrame:
        return pd.DataFrame({**{c: [v] for c, v in zip(self.columns, key, strict=True)}, "seq": [seq], "ok": [ok], "change": [changes]})

    def close(self) -> None:
        pass


def corrections(stream: DataFrame, keys: list[str], keep_ms: int | None = None) -> DataFrame:
    """(keys, seq, ok, change): the changes of each key's best record in a stream of (keys, seq, ok), and of (at) too where
    ``keep_ms`` says how long after its last record a key is kept; then the stream needs a watermark on ``at``.

    A key with most records is one key's state: a few numbers, whatever arrives. Only records change it, in any order, so
    a restart or a batch that runs again gives the same."""
    kinds = ", ".join(f"{k} {stream.schema[k].dataType.simpleString()}" for k in keys)
    return stream.groupBy(*keys).transformWithStateInPandas(Corrections(keep_ms, keys), f"{kinds}, seq long, ok boolean, change long", "Update", "None" if keep_ms is None else "EventTime")


def best_records(stream: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq, ok): in each micro-batch the best record so far of every key that it has records of, from a stream of
    (keys, seq, ok), in update mode. For keys that are never forgotten and changes that need no number of their own: state is
    that of an aggregate, with no call of Python a key. Of a key's rows the one of the latest batch stands."""
    best = F.max(F.struct("ok", "seq")).alias("best")
    return stream.groupBy(*keys).agg(best).select(*keys, "best.seq", "best.ok")


def use_disk_state(spark: SparkSession) -> None:
    """Typed state needs the store on disk; a setting that is there stays."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(key, ""):
        spark.conf.set(key, STORE)
