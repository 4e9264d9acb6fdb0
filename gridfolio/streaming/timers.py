"""Streams that act when nothing comes: rebuilds after an idle time, and values with an age limit of their own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Changed rows after which a rebuild is due at once, and seconds without a further one after which it is due for any.
MOST_DIRTY, IDLE_SECONDS = 25, 30.0
DUE = "key string, dirty long, reason string"


def use_timers(spark: SparkSession) -> None:
    """Streams that are started from now on keep their state where timers and age limits are known."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Gate(StatefulProcessor):
    """Per key the number of changed rows that wait for a rebuild, and a timer that each change sets anew."""

    def __init__(self, most: int, idle_ms: int):
        self.most, self.idle_ms = most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "dirty long")

    def _fired(self, key, dirty: int, reason: str) -> pd.DataFrame:
        self.waiting.clear()
        return pd.DataFrame({"key": [key[0]], "dirty": [dirty], "reason": [reason]})

    def _no_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        dirty = (self.waiting.get()[0] if self.waiting.exists() else 0) + sum(len(r) for r in rows)
        self._no_timers()
        if dirty >= self.most:
            yield self._fired(key, dirty, "rows")
        else:
            self.waiting.update((dirty,))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.waiting.exists():
            yield self._fired(key, self.waiting.get()[0], "idle")

    def close(self) -> None:
        pass


def rebuilds_due(changes: DataFrame, key: str, most: int = MOST_DIRTY, idle_seconds: float = IDLE_SECONDS) -> DataFrame:
    """key, dirty, reason of every rebuild that falls due: ``most`` rows of a key have changed since its last, or none for ``idle_seconds`` after some have.

    The count and the clock live in the state of the stream, per key: a timer fires in a trigger without new rows, and what waits
    outlives the query and the driver. A null key is the key of an empty name.
    """
    keyed = changes.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"))
    return keyed.groupBy("key").transformWithStateInPandas(_Gate(most, int(idle_seconds * 1000)), DUE, "append", "processingTime")


def rebuild_when_due(changes: DataFrame, key: str, rebuild: Callable[[list[str]], None], checkpoint: str, most: int = MOST_DIRTY, idle_seconds: float = IDLE_SECONDS, every: str = "5 seconds"):
    """Start a query that calls ``rebuild`` with the keys that are due, once for all of a trigger; there is one at a time.

    A trigger that is repeated after a failure calls it again with the same keys: a rebuild must come to the same result twice.
    """

    def act(df: DataFrame, _: int) -> None:
        keys = sorted({r["key"] for r in df.collect()})
        if keys:
            rebuild(keys)

    due = rebuilds_due(changes, key, most, idle_seconds)
    return due.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(act).trigger(processingTime=every).start()


class _Aged(StatefulProcessor):
    """The last value of a key, which the state store forgets when it is older than its limit."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", "value string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # The rows of a trigger in their own order; a row without a value asks for the one there is.
        every = pd.concat(list(rows)).sort_values("at", kind="stable")
        out = []
        for value, at in zip(every["value"], every["at"], strict=True):
            if value is not None:
                self.value.update((value,))
            else:
                out.append((key[0], at, self.value.get()[0] if self.value.exists() else None))
        yield pd.DataFrame(out, columns=["key", "at", "value"])

    def close(self) -> None:
        pass


def answers_within(stream: DataFrame, key: str, value: str, at: str, ttl_seconds: float) -> DataFrame:
    """key, at, value for each row that asks: the last value that was put for its key, if that is not older than ``ttl_seconds``.

    A row with a value puts it, a row without one asks. The age counts from the put by the clock, for each key by itself.
    """
    keyed = stream.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(value).cast("string").alias("value"), F.col(at).cast("long").alias("at"))
    return keyed.groupBy("key").transformWithStateInPandas(_Aged(int(ttl_seconds * 1000)), "key string, at long, value string", "append", "processingTime")
