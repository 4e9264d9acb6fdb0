"""Caches, retries, chats, runs, page batches, objects, gates, handlers, modularity and the engine's loops."""

import datetime
import json

import pyarrow as pa
import pytest
from gridfolio.functions import models
from gridfolio.operators import chats, graph, images, retrieval, runs
from gridfolio.plans import engine, grammar
from gridfolio.plans.cache import Cache
from gridfolio.sources import objects, pages, stores
from gridfolio.streaming import jobs
from pyspark.sql import functions as F


def test_cache_has_bounds_and_counts():
    now = [0.0]
    c = Cache(10, 2, lambda: now[0])
    made = []
    get = lambda k: c.get(k, lambda: made.append(k) or k.upper())
    assert [get("a"), get("a"), get("b"), get("c")] == ["A", "A", "B", "C"] and list(c.held) == ["b", "c"]
    now[0] = 11
    get("c")
    assert made == ["a", "b", "c", "c"] and c.stats() == {"entries": 2, "hits": 1, "misses": 4}
    with pytest.raises(ZeroDivisionError):
        c.get("x", lambda: 1 / 0)
    assert "x" not in c.held


def test_retries_wait_as_they_are_told():
    assert models.retry_delay(1, {"retry-after": "4"}) == 4.5 and models.retry_delay(1, {"x-ratelimit-reset-requests": "0.2s"}) == 1.5
    assert models.retry_delay(1, body="please try again in 7.5s") == 8.0 and models.retry_delay(3) == 6.0 and models.retry_delay(99) == 60.0
    waits, left = [], [2]

    def call(x):
        left[0] -= 1
        if left[0] >= 0:
            raise ValueError("try again in 3s")
        return x

    assert models.with_retries(call, 3, waits.append)(5) == 5 and waits == [3.5, 3.5]
    left[0] = 9
    with pytest.raises(ValueError):
        models.with_retries(call, 2, waits.append)(5)


def test_progress_is_observed(spark):
    seen = []
    df, report = models.observed(spark.range(10), "stage", lambda s, m: seen.append((s, m)), total=F.sum("id"))
    df.write.format("noop").mode("overwrite").save()
    report()
    assert seen == [("stage", {"rows": 10, "total": 45})]


def test_chats(spark):
    at = lambda n: datetime.datetime(2024, 1, 1, 0, n)
    steps = [("created", "a", None, None), ("message", "a", "user", "  What is it? "), ("message", "a", "assistant", "This."), ("created", "b", None, None), ("pinned", "b", None, None), ("renamed", "a", None, "Name"), ("created", "c", None, None), ("deleted", "c", None, None)]
    log = None
    for i, (kind, chat, role, body) in enumerate(steps):
        e = chats.event(spark, kind, chat, at(i), i, role, body)
        log = e if log is None else log.unionByName(e)
    rows = chats.listed(log).collect()
    assert [(r["chat_id"], r["title"], r["pinned"], r["n_messages"]) for r in rows] == [("b", "New chat", True, 0), ("a", "Name", False, 2)]
    assert chats.state(log.where("kind <> 'renamed'")).where("chat_id = 'a'").first()["title"] == "What is it?"
    assert [r["body"] for r in chats.messages(log, "a").collect()] == ["  What is it? ", "This."] and chats.messages(log, "c").count() == 0
    assert chats.purged(log).where("chat_id = 'c'").count() == 0


def test_runs(spark):
    run, items = runs.started(spark.createDataFrame([("x/a.pdf",), ("x/b.exe",)], ["path"]), "r1")
    assert {r["path"]: (r["status"], r["error"]) for r in items.collect()} == {"x/a.pdf": ("queued", None), "x/b.exe": ("failed", "unsupported type: .exe")}
    assert tuple(run.select("n_files", "n_rejected", "name").first()) == (2, 1, "run r1")
    assert runs.renamed(run, "r1", " New ").first()["name"] == "New" and runs.renamed(run, "r1", " ").first()["name"] == "run r1"
    left, kept = runs.cleared(run, items, "r1")
    assert left.count() == 0 and kept.where("run_id is null").count() == 2 and runs.cleared(run, items)[1].count() == 2
    assert runs.overview(run, items).first()["n_failed"] == 1


def test_page_batches_fail_alone(spark):
    files = spark.createDataFrame([("a.pdf", bytes([60])), ("b.pdf", bytes([3])), ("c.pdf", b"")], "path string, content binary")

    def reader(content, first, last):
        if first == 21:
            raise OSError("broken")
        return [("text", f"page {p}", p) for p in range(first, last + 1)], [[["h"], [str(first)]]]

    planned = pages.batches(files, lambda c: c[0])
    assert sorted(map(tuple, planned.collect())) == [("a.pdf", 1, 20), ("a.pdf", 21, 40), ("a.pdf", 41, 60), ("b.pdf", 1, 3), ("c.pdf", 0, 0)]
    got = {r["path"]: r for r in pages.in_batches(files, lambda c: c[0], reader).collect()}
    a = got["a.pdf"]
    assert a["error"] is None and a["failed_batches"] == 1 and len(a["blocks"]) == 40
    assert [b["position"] for b in a["blocks"]] == list(range(40)) and [t["table_index"] for t in a["tables"]] == [0, 1]
    assert got["b.pdf"]["failed_batches"] == 0 and "no pages" in got["c.pdf"]["error"]


def test_objects(spark, tmp_path):
    path = f"file://{tmp_path}/o/x.bin"
    objects.put(spark, path, b"one")
    objects.put(spark, path, b"two")
    assert objects.get(spark, path) == b"two" and objects.get(spark, path + "y") is None
    assert objects.delete(spark, [path, path]) == 1 and objects.get(spark, path) is None
    stores.append(spark.range(3), str(tmp_path / "t"))
    assert objects.wipe(spark, str(tmp_path / "t"), str(tmp_path / "none")) == [str(tmp_path / "t")]


def test_gate_outlives_the_query(spark, tmp_path):
    called, now = [], [0.0]
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")

    def add(n):
        spark.range(n).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.limited_source(spark, source, "id long", 5)
        jobs.gated_rebuild(stream, lambda: called.append(now[0]), checkpoint, 10, 100, lambda: now[0]).awaitTermination()

    add(4)
    assert not called
    now[0] = 1
    add(6)
    assert called == [1]
    now[0] = 50
    add(2)
    assert called == [1]
    now[0] = 120
    add(1)
    assert called == [1, 120]
    assert jobs.due(25, 0) and jobs.due(1, 1800) and not jobs.due(0, 9999)


def test_values_age_in_a_stream(spark, tmp_path):
    rows = [("k", datetime.datetime(2024, 1, 1, 0, 0, s), v) for s, v in ((1, "a"), (40, "b"))] + [("k", datetime.datetime(2024, 1, 1, 0, 2), "c")]
    spark.createDataFrame(rows, "key string, at timestamp, value string").write.parquet(str(tmp_path / "in"))
    stream = jobs.limited_source(spark, str(tmp_path / "in"), "key string, at timestamp, value string")
    jobs.latest_within(stream, "key", "at", "value").writeStream.format("memory").queryName("aged").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["value"], r["n_seen"]) for r in spark.table("aged").collect()) == [("b", 2), ("c", 1)]


def test_handlers(spark):
    grid = json.dumps({"title": "T", "headers": ["a", "b"], "rows": [["1", "2"], ["3", "4"]]})
    rows = [(1, grid, "", "table_store", True, 0.9), (2, "", "1. TERMINATION This agreement may be ended without cause by either party at any time.", "clause_store", True, 0.9), (3, "", "A long enough piece of plain text about apples and pears.", "vector_store", True, 0.9), (4, "", "", "vector_store", True, 0.9)]
    df = images.routed(spark.createDataFrame(rows, "id int, structured_content string, ocr_text string, store string, vlm_succeeded boolean, confidence double"))
    out = images.stored(df)
    assert {k: sorted(r["id"] for r in v.collect()) for k, v in out.items()} == {"table_store": [1], "clause_store": [2], "vector_store": [3], "rejected": [4]}
    assert out["clause_store"].first()["clause_type"] == "termination" and out["table_store"].first()["title"] == "T"
    more = images.stored(df, {"image_store": lambda x: x})
    assert more["image_store"].count() == 1 and more["rejected"].count() == 0
    read = images.read_text(spark.createDataFrame([(1, b"ab"), (2, None), (3, b"x")], "id int, content binary"), lambda b: b.decode().upper() if len(b) > 1 else 1 / 0)
    assert {r["id"]: (r["ocr_text"], bool(r["ocr_error"])) for r in read.collect()} == {1: ("AB", False), 2: (None, False), 3: (None, True)}


def test_modularity_finds_cliques(spark):
    rows = [(f"{c}{i}", f"{c}{j}", 1.0) for c in "abcd" for i in range(5) for j in range(i)] + [("a0", "b0", 1.0), ("b1", "c1", 1.0), ("c2", "d2", 1.0), ("d3", "a3", 1.0)]
    edges = spark.createDataFrame(rows, "src string, tgt string, weight double")
    got = {r["node"]: r["community"] for r in graph.communities(edges).collect()}
    assert got == {f"{c}{i}": f"{c}0" for c in "abcd" for i in range(5)}
    groups = spark.createDataFrame(list(got.items()), ["node", "community"])
    one = groups.withColumn("community", F.lit("x"))
    # By hand: 40 of 44 edges inside, and four communities of a quarter of the degrees each.
    assert graph.modularity(edges, groups) == pytest.approx(40 / 44 - 0.25) and graph.modularity(edges, one) == pytest.approx(0)
    assert graph.communities(edges.limit(0)).count() == 0


def test_engine_puts_tables_together_and_survives_failures(spark):
    make = lambda *rows: (spark.createDataFrame(rows, "city string, price double"), ["city"])
    e = engine.Engine({"north": make(("Oslo", 5.0), ("Umea", 9.0)), "south": make(("Rome", 8.0)), "other": (spark.createDataFrame([("x", 1)], "word string, n int"), ["word"])})
    found = e.query("list all rows with price above 6")
    assert sorted((r["table"], r["city"]) for r in found.rows.collect()) == [("north", "Umea"), ("south", "Rome")]
    assert e.query("list all rows with price above 6", table="north").rows.count() == 1

    def broken(text):
        raise RuntimeError("down")

    chunks = spark.createDataFrame([("c1", "d", "vector_store", "apples grow on trees", [1.0, 0.0])], "chunk_id string, document_id string, store string, text string, embedding array<double>")
    e = engine.Engine(chunks=chunks, embedder=broken, llm=broken, planner=broken, summarizer=lambda t, x: broken(t))
    assert e.answer("where apples grow")["citations"] == ["c1"] and len(e.failures) >= 2
    assert e.agentic("where apples grow").count() == 1
    assert e.results.stats()["hits"] >= 1
    kinds = [json.loads(x[6:])["type"] for x in e.events("where apples grow")]
    assert kinds[0] == "status" and kinds[-1] == "done" and kinds.count("token") == 4


def test_agentic_loop_follows_the_judge(spark):
    chunks = spark.createDataFrame([("c1", "d", "vector_store", "apples grow on trees"), ("c2", "d", "vector_store", "pears ripen in autumn"), ("c3", "d", "vector_store", "bolts and nuts")], ["chunk_id", "document_id", "store", "text"])
    asked = []

    def judge(question, evidence):
        asked.append(evidence.count())
        return engine.Verdict(len(asked) > 1, 0.2, ("pears",), "when pears ripen")

    e = engine.Engine(chunks=chunks, judge=judge)
    assert {r["chunk_id"] for r in e.agentic("where apples grow").collect()} == {"c1", "c2"} and asked == [1, 2]
    gaps = engine.judged_by_words("where do apples and pears grow", chunks.limit(1))
    assert not gaps.sufficient and gaps.gaps == ("pears",)


def test_centroids_route(spark):
    chunks = spark.createDataFrame([("t1", "d", "table_store", "x", [1.0, 0.0]), ("v1", "d", "vector_store", "y", [0.0, 1.0])], "chunk_id string, document_id string, store string, text string, embedding array<double>")
    e = engine.Engine(chunks=chunks, centroids=retrieval.centroids(chunks), embedder=lambda t: [0.99, 0.05])
    assert e.route("tell me something new") == ["table_store"]


def test_filters_of_chunks(spark):
    chunks = spark.createDataFrame([(f"c{i}", "d" if i < 4 else "e", "vector_store" if i % 2 else "table_store", i // 2, i) for i in range(6)], "chunk_id string, document_id string, store string, page int, chunk_index int")
    docs = spark.createDataFrame([("d", "completed"), ("e", "failed")], ["document_id", "status"])
    assert retrieval.of_completed(chunks, docs).count() == 4 and retrieval.of_documents(chunks, "e").count() == 2 and retrieval.of_documents(chunks, None, ["d", "e"]).count() == 6
    assert [r["chunk_id"] for r in retrieval.listed_chunks(chunks, "d", "vector_store").collect()] == ["c1", "c3"]
    assert [r["chunk_id"] for r in retrieval.listed_chunks(chunks, "d", page=1, number=2, size=1).collect()] == ["c3"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("price between 1 and 5 or region in East or West and price above 3", "OR(BETWEEN, AND(IN, GT))"),
        ("region in East or price above 9", "OR(IN, GT)"),
        ("region in East, West or North", "IN"),
        ("price not equal to 3 and status is open", "AND(NEQ, EQ)"),
        ("status is above 3", "GT"),
        ("what is the total", "None"),
    ],
)
def test_precedence(text, want):
    def shape(t):
        return str(t) if t is None else t.op if isinstance(t, grammar.Condition) else f"{t.op}({', '.join(map(shape, t.children))})"

    assert shape(grammar.conditions(text)[0]) == want


def test_items_of_batches_equal_one_pass(spark):
    """Headings are carried over the ends of batches; a batch that fails leaves no gap in the numbers."""
    from gridfolio.sources import pages

    def reader(content, first, last):
        if content == b"bad" and first == 21:
            raise ValueError("torn page")
        if content == b"worse":
            raise ValueError("no page")
        blocks = [("heading" if p % 30 == 1 and k == 0 else "text", f"{p}/{k}", p) for p in range(first, last + 1) for k in range(p % 3)]
        return blocks, [[["page"], [str(p)]] for p in range(first, last + 1) if p % 10 == 0]

    files = spark.createDataFrame([("a", b"good"), ("b", b"bad"), ("c", b"worse"), ("d", b"none")], "path string, content binary")
    read = pages.read_batches(files, pages.batches(files, lambda c: 0 if c == b"none" else 60), reader)

    def one_pass(lost):
        out, section = [], None
        for p in range(1, 61):
            for k in range(p % 3):
                if p in lost:
                    continue
                section = f"{p}/{k}" if p % 30 == 1 and k == 0 else section
                out.append((len(out), f"{p}/{k}", p, section))
        return out

    got = pages.items(read)
    of = lambda path: [(r["position"], r["text"], r["page"], r["section"]) for r in got.where(f"path = '{path}'").orderBy("position").collect()]
    lost = set(next(range(r["first"], r["last"] + 1) for r in read.where("path = 'b' and error is not null").collect()))
    assert of("a") == one_pass(set()) and of("b") == one_pass(lost) and 0 < len(lost) < 60 and of("c") == of("d") == []
    tables = sorted((r["path"], r["table_index"], r["rows"][0][0]) for r in pages.tables(read).collect())
    assert [t for t in tables if t[0] == "a"] == [("a", i, str(10 * i + 10)) for i in range(6)]
    assert [t[1:] for t in tables if t[0] == "b"] == list(enumerate(str(p) for p in range(10, 61, 10) if p not in lost))
    failed = {r["path"]: (r["failed_batches"], r["n_batches"]) for r in pages.failures(read).collect()}
    assert failed["b"][0] == 1 and failed["c"][0] == failed["c"][1] and set(failed) == {"b", "c", "d"}


def test_page_batches_leave_the_worker_in_slices():
    """What many files become isn't held at once: the worker hands on several batches, and no file is lost."""
    files = pa.RecordBatch.from_pydict({"path": [f"f{i}" for i in range(100)], "first": [1] * 100, "last": [1] * 100, "content": [b"x" * 50_000] * 99 + [None]})
    parts = list(pages.read_slices([files], lambda c, a, b: ([("text", c.decode(), a)], [[["n"], [str(len(c))]]])))
    assert len(parts) > 3 and max(p.num_rows for p in parts) < 30
    rows = [r for p in parts for r in p.to_pylist()]
    assert [r["path"] for r in rows] == [f"f{i}" for i in range(100)] and rows[99]["error"] and rows[0]["tables"][0]["rows"] == [["50000"]]
