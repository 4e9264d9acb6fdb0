"""The ingestion flow end to end on small files."""

import pytest
from gridfolio.functions import embedding
from gridfolio.operators import ingest
from gridfolio.sources import documents, stores
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def collection(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    (folder / "a.md").write_text("# Contract\n\n1. TERMINATION FOR CAUSE either party may terminate this agreement with Acme Holdings.\n\n| Item | Amount |\n|---|---|\n| A | $100 |\n| B | (5) |\n")
    (folder / "b.html").write_text("<p>Revenue and profit grew. Budget too.</p>")
    (folder / "c.pdf").write_bytes(b"x")
    return ingest.ingested(documents.read(spark, str(folder)))


def test_stores_are_filled(collection):
    assert {r["status"] for r in collection.documents.collect()} == {"completed", "failed"}
    assert {r["store"] for r in collection.chunks.collect()} == {"clause_store", "vector_store"}
    assert [r["row_numeric"] for r in collection.table_rows.orderBy("row_index").collect()] == [{"Amount": 100.0}, {"Amount": -5.0}]
    assert collection.tables.first()["currency"] == "USD" and collection.clauses.count() == 1
    assert "acme holdings" in {r["entity_key"].rstrip(".") for r in collection.mentions.collect()}


def test_delete_and_replace(collection, tmp_path, spark):
    gone = collection.documents.where(F.col("path").endswith("a.md")).select("document_id")
    less = collection.without(gone)
    assert less.table_rows.count() == 0 and less.documents.count() == 2
    assert collection.replaced_by(collection).chunks.count() == collection.chunks.count()
    less.write(str(tmp_path / "c"))
    assert stores.read_latest(spark, str(tmp_path / "c/documents")).count() == 2


def test_embedding(spark):
    df = spark.createDataFrame([("a b c",), ("c b a",), ("",), (None,)], ["t"])
    v = [r["embedding"] for r in embedding.embedded(df, "t").collect()]
    assert v[0] == v[1] and sum(x * x for x in v[0]) == pytest.approx(1) and not any(v[2]) and not any(v[3])
    own = embedding.embedded(df, "t", lambda s: [[3.0, 4.0]] * len(s)).first()["embedding"]
    assert own == pytest.approx([0.6, 0.8])


def test_helpers(spark):
    images = spark.createDataFrame([("d", 20_001, "i1", "completed", 1), ("d", 3, "i2", "skipped", 1)], ["document_id", "image_index", "id", "status", "page"])
    tables = spark.createDataFrame([("d", 1), ("d", 2)], ["document_id", "table_index"])
    assert {r["table_index"]: r["source_image_id"] for r in ingest.linked_crops(images, tables).collect()} == {1: "i1", 2: None}
    assert ingest.image_metrics(images).first()["avoided_pct"] == 50.0
    blocks = spark.createDataFrame([("d", 1, "a b"), ("d", 2, "c")], ["document_id", "page", "text"])
    assert {(r["page"], r["n_words"], r["n_images"]) for r in ingest.page_breakdown(blocks, images).collect()} == {(1, 2, 2), (2, 1, 0)}
    raw = spark.createDataFrame([('{"title": "T", "headers": ["a"], "rows": [["1"]]}',), ("no",)], ["response"])
    assert [(r["title"], r["rows"]) for r in ingest.vlm_tables(raw).collect()] == [("T", [["1"]]), (None, None)]
    made = ingest.backfill(tables.select("table_index"), spark.createDataFrame([(1,)], ["table_index"]), "table_index", lambda m: m)
    assert sorted(r[0] for r in made.collect()) == [1, 2]
    hits = spark.createDataFrame([("c", "d", 4, "text")], ["chunk_id", "document_id", "page", "text"])
    docs = spark.createDataFrame([("d", "/x/f.pdf")], ["document_id", "path"])
    assert ingest.citations(hits, docs).first()["link"] == "/x/f.pdf#page=4"
    assert ingest.facts(spark.createDataFrame([("A", 5.0), ("B", 2.5)], ["group_key", "value"]), "x").first()["text"] == "A: x = 5"
