"""Parts that fail or hang while they run."""

import time

import pytest
from gridfolio.operators.text_index import TextIndex
from gridfolio.operators.vector_index import VectorIndex
from gridfolio.plans import engine, isolation
from gridfolio.session import scratch_path
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ROWS = [("c1", "d", "clause_store", "the apple clause", [1.0, 0.0]), ("c2", "d", "vector_store", "an apple a day", [0.9, 0.1]), ("c3", "e", "table_store", "apple: price = 5", [0.8, 0.3]), ("c4", "e", "vector_store", "nothing of it", [0.0, 1.0])]
COLUMNS = ["chunk_id", "document_id", "store", "text", "embedding"]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


def broken(spark, chunks, store, how):
    """The chunks, where reading the texts of one store goes wrong."""
    read = F.udf(how, StringType())
    good = chunks.where(F.col("store") != store)
    return good.unionByName(chunks.where(F.col("store") == store).withColumn("text", read("text")))


def fails(_):
    raise RuntimeError("this store can't be read")


def hangs(_):
    time.sleep(120)


def test_parts_are_independent(spark, chunks):
    parts = {
        "good": lambda: chunks.limit(2),
        "none": lambda: None,
        "unplanned": lambda: chunks.select("no such column"),
        "broken": lambda: broken(spark, chunks, "table_store", fails),
        "also good": lambda: chunks.where("store = 'table_store'"),
    }
    done, failed = isolation.run(spark, parts)
    assert list(done) == ["good", "also good"] and done["also good"].count() == 1
    assert set(failed) == {"unplanned", "broken"}


def test_a_part_that_hangs_is_cancelled(spark, chunks):
    began = time.monotonic()
    done, failed = isolation.run(spark, {"slow": lambda: broken(spark, chunks, "table_store", hangs), "good": lambda: chunks.limit(1)}, deadline=8)
    assert list(done) == ["good"] and "8 seconds" in failed["slow"] and time.monotonic() - began < 40
    # Its tasks end too.
    for _ in range(60):
        if not spark.sparkContext.statusTracker().getActiveStageIds():
            break
        time.sleep(0.5)
    assert not spark.sparkContext.statusTracker().getActiveStageIds()


def test_a_store_that_fails_leaves_the_others(spark, chunks):
    e = engine.Engine(chunks=broken(spark, chunks, "table_store", fails), embedder=lambda t: [1.0, 0.0])
    found = e.retrieve("where is the apple")
    assert {r["chunk_id"] for r in found.collect()} >= {"c1", "c2"} and not any(r["store"] == "table_store" for r in found.collect())
    assert any("table_store" in f for f in e.failures)
    assert e.answer("where is the apple")["citations"]


def test_a_reranker_that_throws_while_it_runs(spark, chunks):
    score = F.udf(lambda t: fails(t), "double")
    e = engine.Engine(chunks=chunks, reranker=lambda question, column: score(column))
    assert {r["chunk_id"] for r in e.retrieve("where is the apple").collect()} >= {"c1", "c2"}
    assert any(f.startswith("reranking") for f in e.failures)


def test_all_stores_fail(spark, chunks):
    e = engine.Engine(chunks=chunks.withColumn("text", F.udf(fails, StringType()).asNondeterministic()("text")))
    assert e.retrieve("where is the apple").count() == 0
    assert e.answer("where is the apple") == {"answer": "", "citations": [], "confidence": 0.0}


def test_repeated_questions_read_written_rows(spark, chunks):
    reads = spark.sparkContext.accumulator(0)

    def counted(t):
        reads.add(1)
        return t

    state = [1]
    e = engine.Engine(chunks=chunks.withColumn("text", F.udf(counted, StringType()).asNondeterministic()("text")), state=lambda: state[0])
    first = sorted(map(str, e.retrieve("where is the apple").collect()))
    n = reads.value
    assert sorted(map(str, e.retrieve("where is the apple").collect())) == first and reads.value == n > 0
    # Another state of the table is asked anew.
    state[0] = 2
    e.retrieve("where is the apple")
    assert reads.value > n


def test_indexes_serve_the_engine(spark, chunks):
    e = engine.Engine(chunks=chunks, embedder=lambda t: [1.0, 0.0])
    want = sorted((r["chunk_id"], round(r["relevance"], 4)) for r in e.retrieve("apple clauses of a day").collect())
    light = TextIndex.build(chunks, scratch_path(spark, "texts"), analyser="light")
    vectors = VectorIndex.build(chunks, scratch_path(spark, "vectors"), cells=2)
    vectors.probes = 2
    e = engine.Engine(chunks=chunks, embedder=lambda t: [1.0, 0.0], text_index=light, vector_index=vectors)
    assert sorted((r["chunk_id"], round(r["relevance"], 4)) for r in e.retrieve("apple clauses of a day").collect()) == want
    assert {r["document_id"] for r in e.retrieve("apple", document_id="d").collect()} == {"d"} and not e.failures
