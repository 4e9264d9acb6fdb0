"""Catalog, retrieval, keyword, graph, chunking, enrichment, images, sources and job states."""

import io
import re
import zipfile
from datetime import datetime

import numpy as np
import pytest
from gridfolio.functions import text
from gridfolio.operators import catalog, chunking, enrichment, graph, images, keyword, retrieval
from gridfolio.sources import documents, stores
from gridfolio.streaming import jobs
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def hits(spark):
    return spark.createDataFrame([("v1", "d", "vector", "a", 0.1), ("v2", "d", "vector", "b", 0.2), ("v3", "d", "vector", "c", 0.3), ("t1", "d", "table", "e", 0.5)], ["chunk_id", "document_id", "store", "text", "distance"])


def test_pool_and_rrf(hits):
    assert {r["chunk_id"] for r in retrieval.balanced_pool(hits, 2).collect()} == {"v1", "v2", "t1"}
    scores = {r["chunk_id"]: r["rrf_score"] for r in retrieval.rrf(hits).collect()}
    assert scores["v1"] == scores["t1"] > scores["v2"] > scores["v3"]


def test_fusion_sums_ranks(hits):
    fused = {r["chunk_id"]: r["fused_score"] for r in retrieval.fuse([hits, hits.where("chunk_id = 'v3'")]).collect()}
    assert fused["v3"] == pytest.approx(1 / 63 + 1 / 61) and fused["v1"] == pytest.approx(1 / 61)


def test_relevance_and_confidence(hits):
    got = {r["chunk_id"]: r["relevance"] for r in retrieval.minmax_relevance(hits).collect()}
    assert got == {"v1": 1.0, "v2": 0.75, "v3": 0.5, "t1": 0.0}
    assert retrieval.confidence(retrieval.minmax_relevance(hits)).first()["confidence"] == pytest.approx(0.6 + 0.4 * 0.75)


def test_compression_keeps_what_answers(spark):
    df = spark.createDataFrame([("c", "vector_store", "Apples are red. Cars drive. Boats float. Apples taste sweet."), ("s", "vector_store", "Short. One.")], ["chunk_id", "store", "text"])
    got = {r["chunk_id"]: r["compressed_text"] for r in retrieval.compress(df, "apples").collect()}
    assert got == {"c": "Apples are red. Apples taste sweet.", "s": None}


def test_context_budget(spark):
    df = spark.createDataFrame([("a", "x" * 10, 0.9), ("b", "y" * 10, 0.8), ("c", "z", 0.7)], ["chunk_id", "text", "relevance"])
    assert [r["block"] for r in retrieval.context(df, 15).orderBy("chunk_id").collect()] == ["x" * 10, "y" * 5]


def test_prefilter_quality(spark):
    df = spark.createDataFrame([("low",), ("medium",), ("high",)], ["extraction_quality"])
    assert retrieval.prefiltered(df, min_quality="medium").count() == 2
    assert retrieval.prefiltered(df, min_quality="bogus").count() == 3


def test_keyword_syntax(spark):
    df = spark.createDataFrame([("a", "s", "The quick brown foxes jumped"), ("b", "s", "brown quick"), ("c", "s", "foxes only"), ("d", "s", None)], ["chunk_id", "store", "text"])
    ids = lambda q: [r["chunk_id"] for r in keyword.search(df, q, 10).orderBy("distance", "chunk_id").collect()]
    assert ids('"quick brown"') == ["a"]
    assert set(ids("quick brown")) == {"a", "b"}
    assert set(ids("foxes or brown -jumped")) == {"b", "c"}
    assert ids("the") == []


def test_stem_is_the_same_on_both_sides(spark):
    words = ["policies", "classes", "running", "jumped", "foxes", "glass", "is", "apples", "ed", "sing"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], ["w"]).select(keyword.stem_column(F.col("w"))).collect()]
    assert got == [keyword.stem(w) for w in words]


def test_graph_hops(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "a")], ["src", "tgt"])
    seeds = spark.createDataFrame([("a",)], ["node"])
    assert {r["node"]: r["hop"] for r in graph.neighbourhood(edges, seeds, 2).collect()} == {"a": 0, "b": 1, "c": 2}
    log = spark.createDataFrame([("a", "k0"), ("b", "k1"), ("c", "k2"), ("b", "k0")], ["entity_key", "chunk_id"])
    got = graph.chunks_in_reach(graph.neighbourhood(edges, seeds, 2), log, 10).collect()
    assert [(r["chunk_id"], r["hop"]) for r in got] == [("k0", 0), ("k1", 1), ("k2", 2)]


def test_entities(spark):
    df = spark.createDataFrame([("A", "Acme Holdings met AT&T in Paris. The Company saw Acme Holdings."), ("B", None)], ["id", "text"])
    got = [(r["entity_key"], r["position"]) for r in graph.mentions(df, "id", "text").orderBy("position").collect()]
    assert got == [("acme holdings", 0), ("at&t", 1), ("paris. the company", 2)]
    log = spark.createDataFrame([("acme", "Acme", "A", 1), ("acme", "ACME", "B", 2), ("globex", "Globex", "B", 3)], ["entity_key", "name", "document_id", "seq"])
    first = graph.entities(log).where("entity_key = 'acme'").first()
    assert (first["name"], first["doc_ids"], first["n_mentions"]) == ("Acme", ["A", "B"], 2)
    keys = graph.seeds_by_name(graph.entities(log), ["Acme"])
    assert [r["document_id"] for r in graph.related_documents(log, keys, 5).collect()] == ["A", "B"]
    assert graph.without_document(log, "A").count() == 2


def test_entities_against_a_plain_reading(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    word = r"[A-Z][A-Za-z0-9&.\-']*"
    pattern = re.compile(rf"\b{word}(?:\s+{word}){{0,5}}\b")
    want = set()
    for r in docs.collect():
        keys = dict.fromkeys(" ".join(m.strip(" .").lower().split()) for m in pattern.findall(r["text"] or ""))
        keys = [k for k in keys if k and k not in graph.STOP_ENTITIES]
        want |= {(r["doc_id"], k, i) for i, k in enumerate(keys[: graph.MAX_ENTITIES])}
    assert {(r["id"], r["entity_key"], r["position"]) for r in graph.mentions(docs, "doc_id", "text").collect()} == want


def test_chunks_against_a_plain_reading(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = set()
    for r in docs.collect():
        s = [x for x in (p.strip(" ") for p in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+", r["text"] or "")) if x]
        want |= {(r["doc_id"], i, *c) for i, c in enumerate(chunking.pack_sentences(s))}
    assert {tuple(r) for r in chunking.chunks(docs, "doc_id", "text").collect()} == want


def test_relations_merge(spark):
    log = spark.createDataFrame([("a", "b", "works for", "", "d1", None, 1), ("a", "b", "WORKS_FOR", "boss", "d2", 0.5, 2), ("a", "a", "x", "", "d1", None, 3)], "src string, tgt string, rel_type string, description string, document_id string, confidence double, seq int")
    rows = graph.relations(log).collect()
    assert len(rows) == 1 and (rows[0]["rel_type"], rows[0]["weight"], rows[0]["description"], rows[0]["confidence"]) == ("WORKS_FOR", 2, "boss", 0.5)


def test_communities(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("x", "y", 2.0), ("y", "z", 2.0), ("x", "z", 2.0)], ["src", "tgt", "weight"])
    got = {r["node"]: r["community"] for r in graph.label_propagation(edges).collect()}
    assert got["a"] == got["b"] == got["c"] != got["x"] == got["y"] == got["z"]
    groups = spark.createDataFrame(list(got.items()), ["node", "community"])
    names = spark.createDataFrame([(k, k.upper()) for k in got], ["entity_key", "name"])
    assert graph.summaries(groups, names).first()["summary"] == "Contains 3 related entities: A, B, C"


def test_model_output_is_read_tolerantly(spark):
    raw = spark.createDataFrame([(1, '```json {"entities": [{"name": "Acme", "type": "org"}, {"name": "ACME"}, {"name": "Overview"}], "relations": [{"source": "Acme", "target": "Bob", "type": "hired by"}, {"source": "x", "target": "x"}]} ```'), (2, "nothing")], ["id", "response"])
    got = {r["id"]: r for r in graph.extracted(raw).collect()}
    assert [e["key"] for e in got[1]["entities"]] == ["acme"] and [tuple(x) for x in got[1]["relations"]] == [("acme", "bob", "HIRED_BY")]
    assert got[2]["entities"] == [] and got[2]["relations"] == []


@settings(max_examples=60, deadline=None)
@example([1, 100])
@example([19, 100, 19])
@given(st.lists(st.integers(1, 120), max_size=40))
def test_packed_sentences_keep_the_bounds(sizes):
    sentences = [" ".join(f"w{i}_{k}" for k in range(n)) for i, n in enumerate(sizes)]
    got = list(chunking.pack_sentences(sentences, 100, 20, 30))
    assert all(n < 100 + 20 for _, n, _ in got)
    # Only a first chunk may be short, where the one after it has no room for it.
    assert all(n >= 20 for _, n, _ in got[1:])
    assert len(got) < 2 or got[0][1] >= 20 or got[0][1] + got[1][1] >= 100 + 20
    # No word is lost, and words come in their order.
    kept = {w for _, _, t in got for w in t.split()}
    assert kept == {w for s in sentences for w in s.split()}


def test_chunks_of_blank_texts(spark):
    df = spark.createDataFrame([(1, "One two. Three four."), (2, None), (3, "")], ["doc_id", "text"])
    assert [(r["document_id"], r["text"]) for r in chunking.chunks(df, "doc_id", "text").collect()] == [(1, "One two. Three four.")]


def test_semantic_cut():
    vectors = {"a": [1, 0], "b": [0, 1]}
    embed = lambda s: np.array([vectors[x[0]] for x in s])
    assert chunking.cut_by_meaning(["a1", "a2", "b1", "b2"], embed, 100, 1) == ["a1 a2", "b1 b2"]


def test_continued_tables(spark):
    rows = [("d", 0, 1, ["N", "V"], [["r1", "1"], ["r2", "2"]]), ("d", 1, 2, ["N", "V"], [["r3", "3"]]), ("d", 2, 4, ["N", "V"], [["r4", "4"]])]
    df = spark.createDataFrame(rows, "document_id string, table_index int, page_number int, headers array<string>, rows array<array<string>>")
    got = chunking.merged_tables(df).orderBy("table_index").collect()
    assert [(r["fragment_count"], r["row_page_numbers"]) for r in got] == [(2, [1, 1, 2]), (1, [4])]


def test_clauses_sections_and_pages(spark):
    df = spark.createDataFrame([("d", 1, "Intro"), ("d", 2, "1. Termination"), ("d", 3, "They may terminate."), ("d", 4, "2. Liability cap")], ["document_id", "position", "text"])
    got = chunking.clauses(df).orderBy("clause_index").collect()
    assert [(r["clause_number"], r["clause_type"]) for r in got] == [("1", "termination"), ("2", "liability")]
    items = spark.createDataFrame([("d", 1, "heading", "H", False), ("d", 2, "text", "x", True), ("d", 3, "text", "y", False)], ["document_id", "position", "kind", "text", "is_break"])
    assert [r["section"] for r in chunking.carried_sections(items).orderBy("position").collect()] == ["H", "H", "H"]
    assert [r["page_number"] for r in chunking.pages_from_breaks(items).orderBy("position").collect()] == [1, 2, 2]


def test_captions_are_used_once():
    items = [{"kind": "caption", "text": "Table 1", "page": 1}, {"kind": "table", "page": 1}, {"kind": "table", "page": 1}]
    assert [t["caption"] for t in chunking.reassigned_captions(items)] == ["Table 1", None]


@pytest.mark.parametrize(("cell", "code"), [("$100", "USD"), ("€100", "EUR"), ("£100", "GBP"), ("₹100", "INR"), ("USD 5", "USD"), ("none", None)])
def test_currency(spark, cell, code):
    assert spark.createDataFrame([(cell,)], ["x"]).select(enrichment.currency(F.col("x"))).first()[0] == code


def test_table_metadata(spark):
    df = spark.createDataFrame([("Balance sheet FY2024", ["A", "B"], [["$1", "in millions"]])], "caption string, headers array<string>, rows array<array<string>>")
    r = enrichment.enriched_tables(df).first()
    assert (r["currency"], r["fiscal_year"], r["table_category"], r["units"]) == ("USD", "FY2024", "balance_sheet", ["in millions", "millions"])
    assert r["table_summary"] == "Balance sheet FY2024 — 1 rows × 2 columns. Columns: A, B"


def test_reconciliation(spark):
    kind = "grid_headers array<string>, grid_rows array<array<string>>, image_headers array<string>, image_rows array<array<string>>, ocr_text string, merged_cells boolean"
    rows = [(["A"], [["1"]], None, None, "", False), (["A"], [["1"]], ["A"], [["9"]], "", False), ([], [], ["A"], [["7"]], "7", False), (["A"], [["1"]], ["A"], [["1"]], "", False)]
    got = [(r["method"], r["quality"]) for r in enrichment.reconciled(spark.createDataFrame(rows, kind)).collect()]
    assert got == [("pdf_grid", "high"), ("pdf_grid", "low"), ("image_vlm", "high"), ("pdf_grid", "high")]


def test_document_types(spark):
    df = spark.createDataFrame([("revenue profit income",), ("nothing here",), (None,)], ["text"])
    assert [r["document_types"] for r in enrichment.document_types(df, "text").collect()] == [["financial"], ["policy"], ["policy"]]


def test_images(spark):
    df = spark.createDataFrame([("d", 0, 0b1111), ("d", 1, 0b1110), ("d", 2, (1 << 40) - 1), ("e", 0, 0b1111)], ["document_id", "image_index", "ahash"])
    assert [tuple(r) for r in images.duplicates(df).collect()] == [("d", 1, 0)]
    f = images.features(np.zeros((10, 20)))
    assert f["std"] == 0 and f["aspect"] == 2
    rows = [('{"headers": ["a"], "rows": [["1"], ["2"]]}', "", "table_store", True, 0.9), ("a clause about things here", "", "clause_store", True, 0.9), ("", "", "image_store", False, 0.0), ('{"rows": [["1"], ["2", "3"]]}', "", "table_store", True, 0.9)]
    got = images.routed(spark.createDataFrame(rows, ["structured_content", "ocr_text", "store", "vlm_succeeded", "confidence"])).collect()
    assert [(r["content_class"], r["destination_store"]) for r in got] == [("structured_table", "table_store"), ("legal", "clause_store"), ("decorative", "image_store"), ("structured_table", "vector_store")]


def test_file_readers(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>Hi <b>you</b></p><script>x</script><table><tr><th>A</th></tr><tr><td>1</td></tr></table>")
    (tmp_path / "b.md").write_text("# T\n\ntext\n\n| a | b |\n|---|---|\n| 1 | 2 |\n")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c></row><row><c r="B2"><v>5</v></c></row></sheetData></worksheet>')
    (tmp_path / "d.xlsx").write_bytes(book.getvalue())
    got = {r["path"].rpartition("/")[2]: r for r in documents.read(spark, str(tmp_path)).collect()}
    assert [b["text"] for b in got["a.html"]["blocks"]] == ["Hi you"] and got["a.html"]["tables"][0]["rows"] == [["1"]]
    assert [b["kind"] for b in got["b.md"]["blocks"]] == ["heading", "text"] and got["b.md"]["tables"][0]["headers"] == ["a", "b"]
    assert "no reader" in got["c.pdf"]["error"] and got["d.xlsx"]["tables"][0]["rows"] == [["", "5"]]


def test_versions_and_upserts(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    assert stores.read_latest(spark, path) is None
    stores.upsert(spark.createDataFrame([(1, "a"), (2, "b")], ["k", "v"]), path, ["k"])
    stores.upsert(spark.createDataFrame([(2, "c"), (3, "d")], ["k", "v"]), path, ["k"])
    assert sorted(map(tuple, stores.read_latest(spark, path).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert stores.latest_version(spark, path) == 2


def test_catalog(spark):
    parents = spark.createDataFrame([(1,), (2,)], ["k"])
    kids = spark.createDataFrame([(1, "F"), (1, "O")], ["k", "s"])
    assert sorted(map(tuple, catalog.with_counts(parents, "k", {"n": kids}).collect())) == [(1, 2), (2, 0)]
    assert {r["k"]: r["status"] for r in catalog.status_rollup(parents, kids, "k", "s", "F", "P", "O").collect()} == {1: "running", 2: "empty"}
    assert catalog.missing_columns(kids, ["k", "z"]) == ["z"]


def test_job_stream(spark, tmp_path):
    log = spark.createDataFrame([("j", "queued", datetime(2024, 1, 1)), ("j", "done", datetime(2024, 1, 1, 0, 1)), ("k", "queued", datetime(2024, 1, 2))], ["job", "stage", "ts"])
    log.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    seen = []
    jobs.upsert_batches(jobs.current_state(stream, "job", "stage", "ts"), lambda df: seen.extend(df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert {r["job"]: (r["stage"], r["seconds"]) for r in seen} == {"j": ("done", 60.0), "k": ("queued", 0.0)}
    called = []
    jobs.gated_rebuild(stream, lambda: called.append(1), str(tmp_path / "cp2"), 3).awaitTermination()
    assert called == [1]
    assert [r["job"] for r in jobs.stuck(jobs.current_state(log, "job", "stage", "ts"), datetime(2024, 1, 3), ["done"], 60).collect()] == ["k"]


def test_fingerprint(spark):
    df = spark.createDataFrame([("1.2", "x"), (None, "A  b")], ["n", "t"])
    assert [r[0] for r in df.select(text.fingerprint(F.col("n"), F.col("t"))).collect()] == ["n:1.2", "t:a b"]


def test_scratch_is_cleared(spark):
    from gridfolio.session import clear_scratch, scratch_dir, written

    df = written(spark.range(3), "probe")
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    assert df.count() == 3 and all("/probe-" in f for f in df.inputFiles()) and files.exists(path)
    clear_scratch(spark)
    assert not files.exists(path)


def test_chunks_of_all_documents(spark):
    """Over a whole table: chunks are runs of sentences in order, as long as they may be, and together they are the text."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id is not null")
    most, least, overlap = chunking.MAX_TOKENS, chunking.MIN_TOKENS, chunking.OVERLAP_TOKENS
    got = {}
    for r in chunking.chunks(docs, "doc_id", "text").orderBy("document_id", "chunk_index").collect():
        got.setdefault(r["document_id"], []).append(r)
    for r in docs.collect():
        pieces = []
        for s in re.split(r"(?<=[.!?])\s+", r["text"] or ""):
            w = s.split()
            pieces += [w[i : i + most] for i in range(0, len(w), most)]
        own, end = got.get(r["doc_id"], []), 0
        assert bool(own) == bool(pieces)
        for k, c in enumerate(own):
            a, b, n = c["first_sentence"], c["first_sentence"], 0
            while n < c["token_count"]:
                n += len(pieces[b])
                b += 1
            assert c["chunk_index"] == k and c["text"].split() == [w for p in pieces[a:b] for w in p]
            assert a <= end < b if k else a == 0
            # What is repeated is short, and the next sentence had no room.
            assert sum(len(p) for p in pieces[a:end]) <= overlap if k else True
            assert n < most + least and (b == len(pieces) or n + len(pieces[b]) > most)
            end = b
        assert end == len(pieces)
