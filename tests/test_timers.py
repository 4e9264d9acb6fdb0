"""Streams whose clocks run without new rows."""

import time

import pytest
from gridfolio.session import scratch_path
from gridfolio.streaming import timers

ROWS = "key string, value string, at long"


@pytest.fixture
def source(spark):
    """A folder that is streamed, and a function that adds rows to it."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    timers.use_timers(spark)
    path = scratch_path(spark, "stream")
    add = lambda *rows: spark.createDataFrame(list(rows), ROWS).coalesce(1).write.mode("append").parquet(path)
    add()
    yield spark.readStream.schema(ROWS).parquet(path), add
    if before is None:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    else:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def until(what, seconds=90):
    ends = time.monotonic() + seconds
    while not what() and time.monotonic() < ends:
        time.sleep(0.3)
    assert what()


def test_one_rebuild_after_an_idle_time(spark, source):
    stream, add = source
    calls = []
    query = timers.rebuild_when_due(stream, "key", calls.append, scratch_path(spark, "state"), most=5, idle_seconds=6, every="1 second")
    try:
        add(("a", None, 1), ("a", None, 2), ("b", None, 3))
        until(lambda: query.lastProgress and sum(p["numInputRows"] for p in query.recentProgress) >= 3)
        assert calls == []
        # Nothing comes any more: the timers of both keys fire, once each.
        until(lambda: sorted(k for c in calls for k in c) == ["a", "b"])
        time.sleep(8)
        assert sorted(k for c in calls for k in c) == ["a", "b"]
        # Many rows are due at once, and leave no timer behind.
        add(*[("c", None, i) for i in range(6)])
        until(lambda: any("c" in c for c in calls))
        time.sleep(8)
        assert sum("c" in c for c in calls) == 1
    finally:
        query.stop()


def test_waiting_rows_outlive_the_query(spark, source):
    stream, add = source
    calls, state = [], scratch_path(spark, "state")
    add(("a", None, 1))
    query = timers.rebuild_when_due(stream, "key", calls.append, state, most=5, idle_seconds=600, every="1 second")
    until(lambda: sum(p["numInputRows"] for p in query.recentProgress) >= 1)
    query.stop()
    add(*[("a", None, i) for i in range(4)])
    query = timers.rebuild_when_due(stream, "key", calls.append, state, most=5, idle_seconds=600, every="1 second")
    try:
        until(lambda: calls == [["a"]])
    finally:
        query.stop()


def test_values_are_gone_when_they_are_too_old(spark, source):
    stream, add = source
    out = timers.answers_within(stream, "key", "value", "at", 12).writeStream.outputMode("append").format("memory").queryName("answers").option("checkpointLocation", scratch_path(spark, "state"))
    query = out.trigger(processingTime="1 second").start()
    answers = lambda: {(r["key"], r["at"]): r["value"] for r in spark.sql("SELECT * FROM answers").collect()}
    try:
        add(("a", "old", 1), ("a", "new", 2), ("a", None, 3), ("b", None, 3))
        until(lambda: len(answers()) == 2)
        assert answers() == {("a", 3): "new", ("b", 3): None}
        time.sleep(13)
        add(("a", None, 4))
        until(lambda: len(answers()) == 3)
        assert answers()["a", 4] is None
    finally:
        query.stop()
