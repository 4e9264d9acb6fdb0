"""The stored graph after changes against the graph of all that is left."""

import random

import pytest
from gridfolio.operators import graph
from gridfolio.operators.graph_store import MENTIONS, RELATIONS, GraphStore
from gridfolio.session import scratch_path
from pyspark.sql import functions as F


def frames(spark, docs):
    mentions = [(d, seq, e, name) for d, (ms, _) in docs.items() for seq, e, name in ms]
    relations = [(d, seq, s, t, r) for d, (_, rs) in docs.items() for seq, s, t, r in rs]
    return spark.createDataFrame(mentions, MENTIONS), spark.createDataFrame(relations, RELATIONS)


def recomputed(spark, docs):
    mentions, relations = frames(spark, docs)
    nodes = graph.entities(mentions).select("entity_key", "name", "n_docs", "n_mentions")
    log = relations.withColumns({"description": F.lit(""), "confidence": F.lit(1.0)})
    edges = graph.relations(log).select("src", "tgt", "rel_type", "weight", F.size("doc_ids").cast("long").alias("n_docs"))
    return sorted(map(tuple, nodes.collect())), sorted(map(tuple, edges.collect()))


def stored(store):
    return sorted(map(tuple, store.nodes().collect())), sorted(map(tuple, store.edges.read().collect()))


def made(r, n, start):
    """A document: mentions of few entities under various names with numbers of their own, and relations between them."""
    ms = [(start + i, f"e{min(r.randint(0, 9), r.randint(0, 9))}", f"Name {r.randint(0, 5)}") for i in range(n)]
    return ms, [(start + i, r.choice(ms)[1], r.choice(ms)[1], r.choice(["works for", "Owns", ""])) for i in range(n // 2)] if ms else []


def test_random_changes_equal_recomputation(spark):
    r = random.Random(3)
    store = GraphStore.create(spark, scratch_path(spark, "graph"), buckets=4)
    docs, at = {}, 0
    for step in range(4):
        new = {}
        for _ in range(r.randint(2, 5)):
            at += 1000
            new[f"d{r.randint(0, 9)}"] = made(r, r.randint(0, 8), at)
        store.put(*frames(spark, new), spark.createDataFrame([(d,) for d in new], "document_id string"))
        docs |= new
        gone = r.sample(sorted(docs), 2)
        store.remove(spark.createDataFrame([(d,) for d in gone], "document_id string"))
        docs = {d: x for d, x in docs.items() if d not in gone}
        if step % 2:
            assert stored(store) == recomputed(spark, docs)
    store.remove(spark.createDataFrame([(d,) for d in docs], "document_id string"))
    assert stored(store) == ([], [])


def test_names_come_back_from_the_log(spark):
    """All names that are kept of an entity go with their documents; the next ones are read again."""
    store = GraphStore.create(spark, scratch_path(spark, "graph"), buckets=2)
    docs = {f"d{i}": ([(i, "e", f"Name {i}")], []) for i in range(8)}
    store.put(*frames(spark, docs))
    assert stored(store)[0] == [("e", "Name 0", 8, 8)]
    store.remove(spark.createDataFrame([(f"d{i}",) for i in range(6)], "document_id string"))
    assert stored(store)[0] == [("e", "Name 6", 2, 2)]
    # Names that aren't kept lie before one that comes late, and are found when those before them go.
    docs = {f"f{i}": ([(i, "f", f"Name {i}")], []) for i in range(8)}
    store.put(*frames(spark, docs))
    store.remove(spark.createDataFrame([(f"f{i}",) for i in range(3)], "document_id string"))
    store.put(*frames(spark, {"late": ([(99, "f", "Late")], [])}))
    store.remove(spark.createDataFrame([("f3",)], "document_id string"))
    assert stored(store)[0][1] == ("f", "Name 4", 5, 5)
    store.remove(spark.createDataFrame([(f"f{i}",) for i in range(8)], "document_id string"))
    assert stored(store)[0][1] == ("f", "Late", 1, 1)
    store.remove(spark.createDataFrame([("late",)], "document_id string"))
    # A name with a smaller number comes in front, one with a larger doesn't.
    store.put(*frames(spark, {"x": ([(3, "e", "Name 3")], []), "y": ([(99, "e", "Late")], [])}))
    assert stored(store)[0] == [("e", "Name 3", 4, 4)]


def test_a_run_that_broke_off_goes_on(spark, monkeypatch):
    store = GraphStore.create(spark, scratch_path(spark, "graph"), buckets=2)
    docs = {"a": ([(0, "e", "E"), (1, "f", "F")], [(0, "e", "f", "r")]), "b": ([(5, "e", "E")], [])}
    monkeypatch.setattr(GraphStore, "refresh", lambda self: None)
    store.put(*frames(spark, docs))
    assert stored(store) == ([], [])
    monkeypatch.undo()
    again = GraphStore(spark, store.path)
    again.refresh()
    assert stored(again) == recomputed(spark, docs)
    version = again.entities.version()
    again.refresh()
    assert again.entities.version() == version and stored(again) == recomputed(spark, docs)


def test_only_touched_buckets_change(spark):
    store = GraphStore.create(spark, scratch_path(spark, "graph"), buckets=16)
    store.put(*frames(spark, {f"d{i}": ([(i, f"e{i}", "E")], []) for i in range(60)}))
    before = store.entities._state(store.entities.version())
    store.put(*frames(spark, {"d7": ([(7, "e7", "E"), (8, "e7", "E")], [])}))
    after = store.entities._state(store.entities.version())
    assert sum(before.get(b) != after.get(b) for b in {*before, *after}) == 1


@pytest.mark.parametrize("name", ["graph_store_deltas"])
def test_query(spark, name):
    from gridfolio import queries

    queries.load()
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
