"""Clause extraction with and without a reader, enrichment, section paths and units."""

from gridfolio.operators import clauses

ITEMS = [("d", 1, "heading", 1, "One"), ("d", 2, "text", None, "a"), ("d", 3, "heading", 2, "Sub"), ("d", 4, "list", None, "x"), ("d", 5, "list", None, "y"), ("d", 6, "heading", 1, "Two"), ("d", 7, "list", None, "z")]


def test_paths_and_units(spark):
    df = spark.createDataFrame(ITEMS, "document_id string, position int, kind string, level int, text string")
    paths = {r["position"]: r["section_path"] for r in clauses.section_paths(df).collect()}
    assert paths[2] == ["One"] and paths[5] == ["One", "Sub"] and paths[7] == ["Two"]
    got = [(r["kind"], r["text"]) for r in clauses.units(df).orderBy("unit").collect()]
    assert got == [("text", "a"), ("list", "x\ny"), ("list", "z")]
    assert clauses.without_captions(df).count() == 7


def blocks(spark):
    rows = [("d", i, t) for i, t in enumerate(["1. Termination", "They may end it.", "2. Liability", "Capped."])] + [("e", 0, "1. Warranty as is")]
    return spark.createDataFrame(rows, ["document_id", "position", "text"])


def test_segments_overlap(spark):
    got = {(r["document_id"], r["segment"]): r["text"] for r in clauses.segments(blocks(spark), most=25, overlap=1).collect()}
    assert got["d", 0] == "1. Termination\nThey may end it." and got["d", 1] == "They may end it.\n2. Liability\nCapped."


def test_reader_and_fallback(spark):
    def read(text):
        if "Warranty" in text:
            raise ValueError
        return [{"clause_number": "1", "clause_title": "T", "clause_text": "Termination. They may end it", "clause_type": "TERMINATION", "risk_level": "bogus"}, {"clause_text": "and so on. Capped."}]

    got = clauses.extracted(blocks(spark), read).orderBy("document_id", "clause_index").collect()
    assert [(r["document_id"], r["clause_type"], r["text"]) for r in got] == [("d", "termination", "Termination. They may end it and so on. Capped."), ("e", "warranty", "1. Warranty as is")]
    assert clauses.extracted(blocks(spark)).count() == 3


def test_enrichment_is_padded(spark):
    df = spark.createDataFrame([("a",), ("b",)], ["text"]).coalesce(1)
    got = clauses.enriched(df, lambda texts: [{"clause_type": "penalty", "risk_level": "high"}]).collect()
    assert [(r["clause_type"], r["risk_level"]) for r in got] == [("penalty", "high"), ("general", None)]
    assert [r["clause_type"] for r in clauses.enriched(df, lambda texts: 1 / 0).collect()] == ["general", "general"]


def test_chunk_types(spark):
    df = spark.createDataFrame([("plain text", None, ["list"]), ("1. Termination for cause", "Legal", [])], "text string, section string, block_types array<string>")
    assert [(r["semantic_type"], r["risk_level"]) for r in clauses.typed_chunks(df).collect()] == [("list", None), ("legal_clause", "medium")]


def test_blocks_of_a_document_are_put_in_order_once(spark):
    """Blocks in any order and null texts; only the last step, which drops repeated clauses, is a window."""
    from gridfolio.operators import chunking

    rows = [("a", 3, "2. LIABILITY"), ("a", 1, "1. TERMINATION"), ("a", 2, "Either party may terminate."), ("a", 0, "Preamble"), ("a", 4, None), ("a", 5, "No damages."), ("b", 0, "nothing"), (None, 0, "1. TERMINATION")]
    out = chunking.clauses(spark.createDataFrame(rows, "document_id string, position int, text string"))
    got = {(r["document_id"], r["clause_index"]): r["text"] for r in out.collect()}
    assert got == {("a", 1): "1. TERMINATION\nEither party may terminate.", ("a", 2): "2. LIABILITY\nNo damages.", (None, 1): "1. TERMINATION"}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
