"""Keyed tables: writers that meet, touched buckets, deletion and replacement, against plain dictionaries."""

import random
import threading

import pytest
from gridfolio.session import scratch_path
from gridfolio.sources import stores
from gridfolio.sources.tables import Conflict, KeyedTable
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])


@pytest.fixture
def table(spark):
    return KeyedTable.create(spark, scratch_path(spark, "table"), SCHEMA, ["k"], buckets=8)


def rows(spark, **values):
    return spark.createDataFrame([(int(k[1:]), v) for k, v in values.items()], SCHEMA)


def held(table, version=None):
    return {r["k"]: r["v"] for r in table.read(version).collect()}


def test_upsert_delete_and_versions(spark, table):
    assert held(table) == {} and table.version() == 0
    assert table.upsert(rows(spark, k1="a", k2="b")) == 1
    assert table.upsert(rows(spark, k2="c", k3="d")) == 2
    assert held(table) == {1: "a", 2: "c", 3: "d"} and held(table, 1) == {1: "a", 2: "b"}
    table.delete(spark.createDataFrame([(1,), (99,)], "k long"))
    assert held(table) == {2: "c", 3: "d"}
    # Of rows with one key that which sorts last stays, and nothing at all is a commit too.
    table.upsert(spark.createDataFrame([(5, "x"), (5, "z"), (5, "y")], SCHEMA))
    table.upsert(spark.createDataFrame([], SCHEMA))
    assert held(table) == {2: "c", 3: "d", 5: "z"} and table.version() == 5
    assert held(KeyedTable(spark, table.path)) == held(table)


def test_untouched_buckets_keep_their_files(spark, table):
    table.upsert(spark.range(200).select(F.col("id").alias("k"), F.lit("old").alias("v")))
    before = table._state(1)
    table.upsert(rows(spark, k7="new"))
    after = table._state(2)
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert table.read().where("v = 'new'").count() == 1 and table.read().count() == 200


def test_two_writers_both_stay(spark, table):
    """The second commits between the merge and the commit of the first, on the same bucket and on another."""
    table.upsert(rows(spark, k1="a", k2="b"))
    other = KeyedTable(spark, table.path)
    todo = [rows(spark, k1="theirs", k3="new"), rows(spark, k4="again")]
    table.before_commit = lambda: other.upsert(todo.pop(0)) if todo else None
    assert table.upsert(rows(spark, k2="mine", k9="mine")) == 4
    assert held(table) == {1: "theirs", 2: "mine", 3: "new", 4: "again", 9: "mine"}


def test_the_last_commit_of_one_key_wins(spark, table):
    other = KeyedTable(spark, table.path)
    todo = [rows(spark, k1="theirs")]
    table.before_commit = lambda: other.upsert(todo.pop(0)) if todo else None
    table.upsert(rows(spark, k1="mine"))
    assert held(table) == {1: "mine"} and held(table, 1) == {1: "theirs"}


def test_threads_that_write_at_once(spark, table):
    errors = []

    def work(n):
        try:
            own = KeyedTable(spark, table.path)
            for i in range(2):
                own.upsert(spark.createDataFrame([(100 * n + i, f"{n}"), (1, f"{n}")], SCHEMA))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=work, args=(n,)) for n in range(1, 5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = held(table)
    assert not errors and table.version() == 8
    assert {k for k in got if k >= 100} == {100 * n + i for n in range(1, 5) for i in range(2)} and got[1] in "1234"


def test_random_writes_equal_a_dictionary(spark, table):
    r, want = random.Random(1), {}
    for _ in range(6):
        new = {r.randint(0, 40): r.choice("abcdef") for _ in range(10)}
        table.upsert(spark.createDataFrame(list(new.items()), SCHEMA))
        want |= new
        gone = r.sample(range(41), 5)
        table.delete(spark.createDataFrame([(k,) for k in gone], "k long"))
        want = {k: v for k, v in want.items() if k not in gone}
    assert held(table) == want
    table.vacuum(keep=1)
    assert held(table) == want and len(table.versions()) == 1
    table.upsert(rows(spark, k50="more"))
    assert held(table) == want | {50: "more"}


def test_parents_are_replaced(spark):
    schema = T.StructType([T.StructField("doc", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("v", T.StringType())])
    t = KeyedTable.create(spark, scratch_path(spark, "table"), schema, ["doc", "n"], ["doc"], 4)
    make = lambda *x: spark.createDataFrame(list(x), schema)
    t.upsert(make(("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z"), ("c", 0, "w")))
    t.replace(make(("a", 5, "new")), spark.createDataFrame([("c",)], "doc string"))
    assert sorted(map(tuple, t.read().collect())) == [("a", 5, "new"), ("b", 0, "z")]
    t.replace(make(), spark.createDataFrame([("b",)], "doc string"))
    assert sorted(map(tuple, t.read().collect())) == [("a", 5, "new")]


def test_what_is_refused(spark, table):
    with pytest.raises(ValueError):
        table.upsert(spark.createDataFrame([(None, "x")], SCHEMA))
    with pytest.raises(Conflict):
        KeyedTable.create(spark, table.path, SCHEMA, ["k"])
    with pytest.raises(ValueError):
        KeyedTable.create(spark, scratch_path(spark, "table"), SCHEMA, ["k"], ["v"])
    assert table.version() == 0


def test_versions_of_a_store_are_never_overwritten(spark, tmp_path):
    """Two upserts that start from one version: the second is merged over the first."""
    path = str(tmp_path / "store")
    stores.upsert(rows(spark, k1="a"), path, ["k"])
    threads = [threading.Thread(target=stores.upsert, args=(rows(spark, **{f"k{n}": "x"}), path, ["k"])) for n in (2, 3, 4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert {r["k"] for r in stores.read_latest(spark, path).collect()} == {1, 2, 3, 4} and stores.latest_version(spark, path) == 4


def test_rows_are_computed_once_and_buckets_written_in_parts(spark):
    """What is written is staged once, nulls are looked for there, and a difference is one signed table."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    table = KeyedTable.create(spark, scratch_path(spark, "once"), SCHEMA, ["k"], buckets=1)
    table.upsert(spark.range(300).select(counted("id").alias("k"), F.lit("a").alias("v")))
    assert seen.value == 300
    table.upsert(spark.range(290, 310).select(F.col("id").alias("k"), F.lit("b").alias("v")))
    table.delete(spark.range(5).select(F.col("id").alias("k")))
    signs = {(r["k"], r["v"]): r["sign"] for r in table.signed(1, 3).collect()}
    assert signs == {(k, "b"): 1 for k in range(290, 310)} | {(k, "a"): -1 for k in [*range(5), *range(290, 300)]}
    assert table.signed(0, 3).where("sign = 1").count() == table.signed(3, 0).where("sign = -1").count() == 305
    with pytest.raises(ValueError):
        table.upsert(spark.createDataFrame([(None, "c")], SCHEMA))
    assert table.files.names(f"{table.path}/staged") == []
