"""Job progress from an append-only log of events, in batch and as a stream."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfolio.functions.dates import seconds_between
from gridfolio.sources import stores


def current_state(log: DataFrame, key: str, stage: str, ts: str) -> DataFrame:
    """Per job: the latest stage, first and last time, seconds between them, number of events.

    A stream can keep this state as well: aggregates only, no order of arrival is needed. Ties in time go to
    the alphabetically last stage.
    """
    return log.groupBy(key).agg(
        F.max(F.struct(ts, stage))[stage].alias("stage"),
        F.min(ts).alias("started_at"),
        F.max(ts).alias("updated_at"),
        seconds_between(F.min(ts), F.max(ts)).alias("seconds"),
        F.count(F.lit(1)).alias("n_events"),
    )


def stuck(state: DataFrame, now, final: list[str], after_seconds: float, limit: int = 10) -> DataFrame:
    """The oldest unfinished jobs without an event for ``after_seconds``."""
    idle = seconds_between(F.col("updated_at"), F.lit(now))
    return state.where(~F.col("stage").isin(*final) & (idle > after_seconds)).orderBy("updated_at", state.columns[0]).limit(limit)


def windowed_counts(stream: DataFrame, ts: str, by: str, value: str, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Tumbling windows with a watermark: rows and sum per window and kind; rows later than ``late`` are left out."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, size), by)
    out = w.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), by, "n", "total")


def upsert_batches(stream: DataFrame, write: Callable[[DataFrame], None], checkpoint: str):
    """An idempotent sink: each micro-batch is written by ``write`` (a keyed upsert), so that a repeated batch changes nothing."""
    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: write(df)).trigger(availableNow=True).start()


#: Changed rows, and seconds since the last rebuild, after which a rebuild is due.
MOST_DIRTY, MOST_SECONDS = 25, 1800.0
GATE = "batch long, dirty long, at double, rebuilt boolean"


def due(dirty: int, elapsed: float, most_dirty: int = MOST_DIRTY, most_seconds: float = MOST_SECONDS) -> bool:
    return dirty >= most_dirty or (dirty > 0 and elapsed >= most_seconds)


def gated_rebuild(stream: DataFrame, rebuild: Callable[[], None], checkpoint: str, dirty: int = MOST_DIRTY, seconds: float = MOST_SECONDS, clock: Callable[[], float] = time.time):
    """Calls ``rebuild`` when ``dirty`` rows have changed since the last time, or any has and ``seconds`` are over.

    What waits is kept in a table beside the checkpoint, one row per micro-batch, so that it outlives the query and the
    driver; a repeated batch replaces its own row. Each trigger looks at the clock, also without new rows.
    """
    spark, path = stream.sparkSession, f"{checkpoint}/gate"

    def known() -> list:
        own = stores.read_latest(spark, path)
        return own.orderBy("batch").collect() if own is not None else []

    def seen(df: DataFrame, batch: int) -> None:
        rows = [r for r in known() if r["batch"] != batch]
        last = max((r["at"] for r in rows if r["rebuilt"]), default=min((r["at"] for r in rows), default=clock()))
        waiting = sum(r["dirty"] for r in rows if not r["rebuilt"] and r["at"] >= last) + (n := df.count())
        rebuilt = due(waiting, clock() - last, dirty, seconds)
        if rebuilt:
            rebuild()
        kept = [] if rebuilt else [tuple(r) for r in rows if r["rebuilt"] or r["at"] >= last]
        stores.write_version(spark.createDataFrame([*kept, (batch, n, float(clock()), rebuilt)], GATE), path)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(seen).trigger(availableNow=True).start()


def limited_source(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """A stream of Parquet files that takes at most ``files`` of them a trigger: the rate limit of a source."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def latest_within(stream: DataFrame, key: str, ts: str, value: str, ttl: str = "90 seconds", late: str = "10 minutes") -> DataFrame:
    """The last value of each key per period of ``ttl``; state that the watermark has passed is dropped: a cache with an age limit."""
    kept = stream.withWatermark(ts, late).groupBy(F.window(ts, ttl), key).agg(F.max_by(value, ts).alias(value), F.count(F.lit(1)).alias("n_seen"))
    return kept.select(key, F.col("window.start").alias("since"), F.col("window.end").alias("until"), value, "n_seen")
