"""Operators on small inputs, each with the rows that it must give."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfolio.functions import dates, models, nested, text
from gridfolio.operators import chunking, clauses, enrichment, graph, images, ingest, retrieval
from gridfolio.plans import binder, nl
from gridfolio.sources import documents


CASES: dict = {}
EXPECTED: dict[str, str] = {}


def query(sql: str):
    """A case under its name, with the SQL that states its rows."""

    def add(f):
        CASES[f.__name__] = f
        EXPECTED[f.__name__] = sql
        return f

    return add


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    return str(value) if isinstance(value, int | float) else "'" + value.replace("'", "''") + "'"


def stated(columns: str, rows: list[tuple], casts: dict[str, str] | None = None) -> str:
    """SQL that gives ``rows``; texts, and columns with a cast, are cast, so that a column of nulls has its type."""
    names = columns.split()
    kinds = {n: (casts or {}).get(n, "VARCHAR" if any(isinstance(r[i], str) for r in rows) else None) for i, n in enumerate(names)}
    shown = ", ".join(f"{n}::{kinds[n]} AS {n}" if kinds[n] else n for n in names)
    return f"SELECT {shown} FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) t({', '.join(names)})"


def _given(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


_INTENTS = [
    ("", "semantic_qa"), ("summarize all companies in Chemicals", "mixed"), ("what is the Actual USD for Month-05", "exact_lookup"), ("which sector does Acme belong to?", "exact_lookup"),
    ("HDFC Bank is what sector?", "exact_lookup"), ("top 10 orders by price", "ranking"), ("bottom 3 suppliers", "ranking"), ("list all orders in East", "filter"), ("show every row", "filter"),
    ("how many rows", "aggregation"), ("what is the total revenue", "aggregation"), ("average price", "aggregation"), ("tell me about the report", "semantic_qa"), ("compare all companies in Banking", "mixed"),
]


@query(stated("question intent", _INTENTS))
def question_intents(spark, sf_dir):
    return _given(spark, [(q, nl.intent(q)) for q, _ in _INTENTS], "question string, intent string")


_CONDITIONS = [
    ("price between 10 and 1,000", "price BETWEEN (10.0, 1000.0)"), ("list all companies with price above $10,000", "companies with price GT 10000.0"), ("price at least 5", "price GTE 5.0"),
    ("price at most 5", "price LTE 5.0"), ("price is under 5", "price LT 5.0"), ("name containing 'steel'", "name LIKE steel"), ("region in East or West", "region IN ('East', 'West')"),
    ("list all companies in the Chemicals sector", "sector IN ('Chemicals',)"), ("list all companies in Chemicals, Banking or Steel", "None IN ('Chemicals', 'Banking', 'Steel')"),
    ("status is open", "status EQ open"), ("status = open?", "status EQ open"), ("status is not open", "status NEQ open"), ("price above 9 and status is open", "AND[price GT 9.0; status EQ open]"),
    ("price between 1 and 5 and region is East or price above 9", "OR[AND[price BETWEEN (1.0, 5.0); region EQ East]; price GT 9.0]"), ("gibberish", "nothing"),
]


def _shown(tree) -> str:
    if tree is None:
        return "nothing"
    return f"{tree.column} {tree.op} {tree.value}" if isinstance(tree, nl.Condition) else f"{tree.op}[{'; '.join(map(_shown, tree.children))}]"


@query(stated("question tree", _CONDITIONS))
def question_conditions(spark, sf_dir):
    return _given(spark, [(q, _shown(nl.conditions(q)[0])) for q, _ in _CONDITIONS], "question string, tree string")


_RANKINGS = [
    ("top 5 companies by revenue", "revenue", True, 5, None, None), ("bottom 3 by price", "price", False, 3, None, None), ("largest revenue", "revenue", True, 10, None, "MAX"),
    ("smallest price", "price", False, 10, None, "MIN"), ("total revenue by region", None, None, None, "region", "SUM"), ("average price per country", None, None, None, "country", "AVG"),
    ("how many rows", None, None, None, None, "COUNT"), ("list all rows", None, None, None, None, None),
]


@query(stated("question column_name descending most group_by aggregate", _RANKINGS, {"most": "INTEGER"}))
def question_rankings(spark, sf_dir):
    asked = [(q, nl.parse(q)) for q, *_ in _RANKINGS]
    rows = [(q, p.ranking and p.ranking.column, p.ranking and p.ranking.descending, p.ranking and p.ranking.limit, p.group_by, p.aggregate) for q, p in asked]
    return _given(spark, rows, "question string, column_name string, descending boolean, most int, group_by string, aggregate string")


_LOOKUPS = [("what is the price for Acme?", "price", "Acme"), ("which sector does Acme belong to?", "sector", "Acme"), ("Acme belongs to which sector", "sector", "Acme"), ("HDFC Bank is what sector?", "sector", "HDFC Bank"), ("list all rows", None, None)]


@query(stated("question asked subject", _LOOKUPS))
def question_lookups(spark, sf_dir):
    """A question that begins with its subject is turned round first."""
    return _given(spark, [(q, *(nl.lookup(q) or (None, None))) for q, *_ in _LOOKUPS], "question string, asked string, subject string")


_STORES = [
    ("termination clause", "clause", "legal", 0.85), ("revenue of the quarter", "table,vector", "financial", 0.85), ("handbook", "vector", "policy", 0.85), ("row of the spreadsheet", "table", None, 0.85),
    ("revenue chart", "table,vector", "financial", 0.65), ("in this paragraph", "vector,clause,table", None, 0.4),
]


@query(stated("question stores types confidence", _STORES, {"confidence": "DOUBLE"}))
def question_stores(spark, sf_dir):
    found = [(q, nl.stores(q)) for q, *_ in _STORES]
    return _given(spark, [(q, ",".join(f["stores"]), f["doc_types"] and ",".join(f["doc_types"]), f["confidence"]) for q, f in found], "question string, stores string, types string, confidence double")


_CHOSEN = [("legal", 0.9, "clause", "clause,vector"), (None, 0.9, "clause", "clause"), (None, 0.4, "clause", "vector,clause,table"), ("financial,legal", 0.1, "table", "clause,table,vector")]


@query(stated("types confidence routed stores", _CHOSEN, {"confidence": "DOUBLE"}))
def selected_stores(spark, sf_dir):
    rows = [(t, c, s, ",".join(nl.select_stores(t.split(",") if t else None, {"stores": [s], "confidence": c}))) for t, c, s, _ in _CHOSEN]
    return _given(spark, rows, "types string, confidence double, routed string, stores string")


_DEPTHS = [("what is the price", 10, 8, False), ("compare A and B", 25, 20, False), (" ".join(["word"] * 14), 25, 20, False), ("hello", 10, 8, True), ("thanks!", 10, 8, True), ("list invoices", 10, 8, False), ("FY 2024", 10, 8, False), ("who are you?", 10, 8, True)]


@query(stated("question k cap small_talk", _DEPTHS, {"k": "INTEGER", "cap": "INTEGER"}))
def question_depths(spark, sf_dir):
    return _given(spark, [(q, *nl.depth(q), nl.is_conversational(q)) for q, *_ in _DEPTHS], "question string, k int, cap int, small_talk boolean")


_CENTROIDS = [(0.9, 0.5, "vector", 0.95), (0.50, 0.42, "vector", 0.76), (0.50, 0.48, "table,vector", 0.55), (0.1, 0.05, "vector,clause,table", 0.35)]


@query(stated("vector_similarity table_similarity stores confidence", _CENTROIDS, {"vector_similarity": "DOUBLE", "table_similarity": "DOUBLE", "confidence": "DOUBLE"}))
def routes_by_centroid(spark, sf_dir):
    found = [(a, b, nl.route_by_centroid({"vector": a, "table": b})) for a, b, *_ in _CENTROIDS]
    return _given(spark, [(a, b, ",".join(r["stores"]), round(r["confidence"], 4)) for a, b, r in found], "vector_similarity double, table_similarity double, stores string, confidence double")


_HEADERS = ["Actual USD ($)", "Budget %", "Region"]
_BOUND = [("actual usd", "Actual USD ($)", "Actual USD ($)"), ("BUDGET", "Budget %", "Budget %"), ("the region please", "Region", "Region"), ("unknown", None, None)]


@query(stated("phrase by_name by_mention", _BOUND))
def bound_columns(spark, sf_dir):
    return _given(spark, [(p, binder.by_name(p, _HEADERS), binder.by_mention(p, _HEADERS)) for p, *_ in _BOUND], "phrase string, by_name string, by_mention string")


_PERIODS = [
    ("Results FY24 Q3", "FY2024", "Q3"), ("fiscal year ended 2023", "FY2023", None), ("H1 2022 YTD", None, "H1 2022"), ("as of YTD", None, "YTD"), ("Month of march", None, "March"), ("annual report", None, "annual"),
    ("quarterly update FY 2021", "FY2021", "quarterly"), ("nothing here", None, None),
]


@query(stated("body fiscal_year period", _PERIODS))
def reporting_periods(spark, sf_dir):
    df = _given(spark, [(b,) for b, *_ in _PERIODS], "body string")
    return df.select("body", dates.fiscal_year(F.col("body")).alias("fiscal_year"), dates.reporting_period(F.col("body")).alias("period"))


_CAPTIONS = [("Table 4.2: Revenue", "4.2"), ("see Exhibit 7", "7"), ("Schedule 3 of the deed", "3"), ("Tables", None), ("Figure 2", None)]


@query(stated("caption number", _CAPTIONS))
def caption_numbers(spark, sf_dir):
    return _given(spark, [(c,) for c, _ in _CAPTIONS], "caption string").select("caption", text.caption_number(F.col("caption")).alias("number"))


_STORE_NAMES = [("Table Store", "table_store"), ("legal", "clause_store"), ("documents", "document_store"), ("policy text", "vector_store"), ("", "image_store"), (None, "image_store")]


@query(stated("said store", _STORE_NAMES))
def canonical_stores(spark, sf_dir):
    return _given(spark, [(s,) for s, _ in _STORE_NAMES], "said string").select("said", text.canonical_store(F.col("said")).alias("store"))


_MARKUP = [("<p>One<br>two</p><p>three</p>", "One\ntwo\n\nthree"), ("<ul><li>a</li><li>b</li></ul>", "- a\n\n- b"), ("<b>bold</b> <i>it</i>", "**bold** it"), ("plain", "plain")]


@query(stated("html markdown", _MARKUP))
def cleaned_markup(spark, sf_dir):
    return _given(spark, [(h,) for h, _ in _MARKUP], "html string").select("html", text.clean_markup(F.col("html")).alias("markdown"))


_JSON = [
    ('{"a": 1, "b": "x"}', "1", "x"), ('```json\n{"a": 2}\n```', "2", None), ('Sure: {"a": 3, "b": "y"} done', "3", "y"), ('{"a": 4, "b": "cut of', "4", "cut of"), ("no object", None, None), (None, None, None),
]


@query(stated("response a b", _JSON))
def tolerant_objects(spark, sf_dir):
    df = _given(spark, [(r,) for r, *_ in _JSON], "response string").withColumn("v", nested.tolerant_json(F.col("response")))
    return df.select("response", F.try_variant_get("v", "$.a", "string").alias("a"), F.try_variant_get("v", "$.b", "string").alias("b"))


_CHOICES = [("High", "high", "obligation"), (" medium ", "medium", "obligation"), ("none", None, "general"), (None, None, "general")]


@query(stated("risk clamped kind", _CHOICES))
def clamped_choices(spark, sf_dir):
    df = _given(spark, [(r,) for r, *_ in _CHOICES], "risk string")
    kind = F.when(F.lower(F.trim("risk")).isin("high", "medium"), "Obligation").otherwise("other")
    return df.select("risk", nested.from_choice(F.col("risk"), clauses.RISKS).alias("clamped"), nested.from_choice(kind, clauses.CLAUSE_TYPES, "general").alias("kind"))


_GRIDS = [
    ("even", ["a", "b"], [["1", "2"], ["3", "4"]], True, True, "a=3,b=4", "| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |", "a,b\r\n1,2\r\n3,4\r\n"),
    ("ragged", ["a", "b"], [["1"], ["x, y", "(2)"]], False, False, "a=x, y,b=(2)", '| a | b |\n| --- | --- |\n| 1 |\n| x, y | (2) |', 'a,b\r\n1\r\n"x, y",(2)\r\n'),
    ("twice", ["a", "a"], [["1", "2"], [" ", "5"]], True, True, "a=5", "| a | a |\n| --- | --- |\n| 1 | 2 |\n|   | 5 |", "a,a\r\n1,2\r\n ,5\r\n"),
    ("bare", [], [["1"]], True, False, "", "|  |\n|  |\n| 1 |", "\r\n1\r\n"),
]


@query(stated("name uniform formed last markdown csv", [(n, u, w, m, md, c) for n, _, _, u, w, m, md, c in _GRIDS]))
def grid_renderings(spark, sf_dir):
    """Checks, the last row as a map, and texts of grids."""
    df = _given(spark, [(n, h, r) for n, h, r, *_ in _GRIDS], "name string, headers array<string>, rows array<array<string>>")
    last = nested.row_map(F.col("headers"), F.element_at("rows", -1))
    entries = F.array_join(F.transform(F.array_sort(F.map_entries(last)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return df.select(
        "name", nested.uniform_width(F.col("rows")).alias("uniform"), nested.well_formed(F.col("headers"), F.col("rows")).alias("formed"), entries.alias("last"),
        nested.markdown_table(F.col("headers"), F.col("rows")).alias("markdown"), nested.csv_text(F.col("headers"), F.col("rows")).alias("csv"),
    )


@query(stated("name headers", [("two", "Year 2023|Year 2024|Total"), ("one", "a|b")]))
def joined_header_rows(spark, sf_dir):
    rows = [("two", [["Year", "Year", "Total"], ["2023", "2024", " "]]), ("one", [["a", "b"]])]
    df = _given(spark, rows, "name string, rows array<array<string>>")
    return df.select("name", F.array_join(nested.joined_headers(F.col("rows")), "|").alias("headers"))


@query(stated("table_index pages n_rows fragment_count", [(0, "1,2,2", 3, 2), (2, "3", 1, 1), (3, "5", 1, 1), (4, "6", 1, 1)], {"table_index": "INTEGER", "n_rows": "INTEGER", "fragment_count": "INTEGER"}))
def continued_tables(spark, sf_dir):
    """Fragments join on the next page under equal headers; a gap of pages, other headers or ragged rows end a table."""
    rows = [("d", 0, 1, ["a"], [["1"]]), ("d", 1, 2, ["a"], [["2"], ["3"]]), ("d", 2, 3, ["b"], [["4"]]), ("d", 3, 5, ["b"], [["5"]]), ("d", 4, 6, ["c"], [["6"]])]
    df = chunking.merged_tables(_given(spark, rows, "document_id string, table_index int, page_number int, headers array<string>, rows array<array<string>>"))
    return df.select("table_index", F.array_join("row_page_numbers", ",").alias("pages"), F.size("rows").alias("n_rows"), "fragment_count")


_CLAUSES = [
    (1, "1", "TERMINATION", "termination", "1. TERMINATION\nEither party may terminate for cause."),
    (2, "2", "LIABILITY", "liability", "2. LIABILITY\nNo consequential damages are due."),
    (3, "Section 9"[8:], "Section 9 Warranty", "warranty", "Section 9 Warranty\nAll goods are sold as is."),
]


@query(stated("clause_index clause_number clause_title clause_type body", _CLAUSES, {"clause_index": "BIGINT"}))
def clauses_of_blocks(spark, sf_dir):
    """Blocks before the first opening go, and so does a clause that comes again."""
    blocks = ["Preamble without a number", *[line for *_, body in _CLAUSES for line in body.split("\n")], "1. TERMINATION", "A copy that comes later."]
    df = _given(spark, [("d", i, b) for i, b in enumerate(blocks)], "document_id string, position int, text string")
    return chunking.clauses(df).select("clause_index", "clause_number", "clause_title", "clause_type", F.col("text").alias("body"))


@query(stated("position path", [(0, "A"), (1, "A"), (2, "A > B"), (3, "A > B"), (4, "C"), (5, "C"), (6, "C > D"), (7, "C > D")], {"position": "INTEGER"}))
def section_paths(spark, sf_dir):
    rows = [("heading", 1, "A"), ("text", None, "x"), ("heading", 2, "B"), ("text", None, "y"), ("heading", 1, "C"), ("text", None, "z"), ("heading", 3, "D"), ("list", None, "w")]
    df = _given(spark, [("d", i, *r) for i, r in enumerate(rows)], "document_id string, position int, kind string, level int, text string")
    return clauses.section_paths(df).select("position", F.array_join("section_path", " > ").alias("path"))


@query(stated("kind path body", [("text", "A", "x"), ("list", "A", "one\ntwo"), ("text", "A", "y"), ("list", "A > B", "three")]))
def logical_units(spark, sf_dir):
    """Neighbouring list items of a section are one unit."""
    rows = [("heading", 1, "A"), ("text", None, "x"), ("list", None, "one"), ("list", None, "two"), ("text", None, "y"), ("heading", 2, "B"), ("list", None, "three")]
    df = _given(spark, [("d", i, *r) for i, r in enumerate(rows)], "document_id string, position int, kind string, level int, text string")
    return clauses.units(df).select("kind", F.array_join("section_path", " > ").alias("path"), F.col("text").alias("body"))


@query(stated("table_id currency fiscal_year category units", [("t1", "USD", "FY2024", "income_statement", "usd millions,millions"), ("t2", "EUR", None, "other", None), ("t3", None, None, "balance_sheet", "%")]))
def enriched_tables(spark, sf_dir):
    rows = [("t1", "Revenue FY24 in USD millions ($)", ["Item"], [["Sales"]]), ("t2", "Costs", ["Item"], [["EUR 5"]]), ("t3", "Balance sheet", ["Share %"], [["10"]])]
    df = enrichment.enriched_tables(_given(spark, rows, "table_id string, caption string, headers array<string>, rows array<array<string>>"))
    return df.select("table_id", "currency", "fiscal_year", F.col("table_category").alias("category"), F.array_join("units", ",").alias("units"))


_RECONCILED = [("grid only", "pdf_grid", "high"), ("image wins", "image_vlm", "high"), ("unfaithful", "pdf_grid", "low"), ("both", "pdf_grid", "high"), ("nothing", "pdf_grid", "low")]


@query(stated("name method quality", _RECONCILED))
def reconciled_tables(spark, sf_dir):
    grid = (["a", "b"], [["1", "2"]])
    none = (None, None)
    rows = [("grid only", *grid, *none, ""), ("image wins", *none, *grid, "1 and 2"), ("unfaithful", *none, ["a"], [["77"], ["88"]], "1 and 2"), ("both", *grid, *grid, "1 2"), ("nothing", *none, *none, "")]
    shape = "name string, grid_headers array<string>, grid_rows array<array<string>>, image_headers array<string>, image_rows array<array<string>>, ocr_text string"
    df = _given(spark, rows, shape).withColumn("merged_cells", F.lit(False))
    return enrichment.reconciled(df).select("name", "method", "quality")


_TABLE = json.dumps({"headers": ["a", "b"], "rows": [["1", "2"], ["3", "4"]]})
_ROUTED = [
    ("table", "structured_table", True, "high", "table_store"), ("ragged", "structured_table", False, "low", "vector_store"), ("clause", "legal", True, "medium", "clause_store"), ("unsure clause", "legal", True, "medium", "vector_store"),
    ("prose", "document_text", True, "high", "vector_store"), ("blank", "decorative", False, "low", "image_store"),
]


@query(stated("name content_class is_valid quality store", _ROUTED))
def routed_images(spark, sf_dir):
    long = "A sentence about the terms of this agreement between both parties to it."
    rows = [("table", _TABLE, "", "table_store", 0.9), ("ragged", json.dumps({"headers": ["a"], "rows": [["1"], ["2", "3"]]}), "", "table_store", 0.9), ("clause", "", long, "clause_store", 0.9), ("unsure clause", "", long, "clause_store", 0.1), ("prose", "", long * 4, "document_store", 0.9), ("blank", "", " ", "vector_store", 0.9)]
    df = _given(spark, rows, "name string, structured_content string, ocr_text string, store string, confidence double").withColumn("vlm_succeeded", F.lit(True))
    return images.routed(df).select("name", "content_class", "is_valid", "quality", F.col("destination_store").alias("store"))


_TYPES = [("hired by", "HIRED_BY"), (" works-for ", "WORKS_FOR"), ("??", "RELATES_TO"), (None, "RELATES_TO"), ("x" * 70, "X" * 64)]


@query(stated("said type", _TYPES))
def relation_types(spark, sf_dir):
    return _given(spark, [(s,) for s, _ in _TYPES], "said string").select("said", graph.relation_type(F.col("said")).alias("type"))


@query(stated("id entities relations", [(1, "acme,bob", "acme-HIRED_BY-bob"), (2, "", ""), (3, "paris", "")], {"id": "INTEGER"}))
def extracted_graphs(spark, sf_dir):
    rows = [
        (1, '```json {"entities": [{"name": "Acme", "type": "org"}, {"name": "ACME"}, {"name": "Bob"}, {"name": "Overview"}], "relations": [{"source": "Acme", "target": "Bob", "type": "hired by"}, {"source": "x", "target": "x"}]} ```'),
        (2, "nothing"), (3, '{"entities": [{"name": " Paris "}]}'),
    ]
    got = graph.extracted(_given(spark, rows, "id int, response string"))
    links = F.transform("relations", lambda r: F.concat_ws("-", r["src"], r["rel_type"], r["tgt"]))
    return got.select("id", F.array_join(F.transform("entities", lambda e: e["key"]), ",").alias("entities"), F.array_join(links, ",").alias("relations"))


@query(stated("cue has_entities route", [(True, True, "global"), (False, True, "local"), (False, False, "none")]))
def graph_routes(spark, sf_dir):
    return _given(spark, [(c, h, graph.route(c, h)) for c, h in ((True, True), (False, True), (False, False))], "cue boolean, has_entities boolean, route string")


@query(stated("answer n", [("second\n\nfirst", 2)]))
def map_reduced_answers(spark, sf_dir):
    df = _given(spark, [(1, 2.0, "first"), (2, 5.0, "second"), (3, 0.0, "out")], "community int, score double, answer string")
    return graph.map_reduce(df, F.col("score"), F.col("answer"), 5)


@query(stated("chunk_id compressed", [("c1", "Bees make honey. Honey is sweet."), ("c2", None), ("c3", None)]))
def compressed_chunks(spark, sf_dir):
    """Of chunks with four sentences or more those that answer the question stay; tables and short chunks are left whole."""
    prose = "Bees make honey. Cars need fuel. Rain falls down. Honey is sweet. Trees are tall."
    df = _given(spark, [("c1", "vector_store", prose), ("c2", "vector_store", "Honey only."), ("c3", "table_store", prose)], "chunk_id string, store string, text string")
    return retrieval.compress(df, "honey").select("chunk_id", F.col("compressed_text").alias("compressed"))


@query(stated("chunk_id relevance", [("a", 0.9946), ("b", 0.5), ("c", 0.0554)], {"relevance": "DOUBLE"}))
def reranked_chunks(spark, sf_dir):
    """Logits 4, 0 and -4 by shared words; a matched row gets its bonus; the farthest chunk isn't in the pool."""
    rows = [("a", 0.1, "red apple", False), ("b", 0.2, "red pear", False), ("c", 0.3, "blue plum", True), ("d", 0.9, "red apple", False)]
    df = _given(spark, rows, "chunk_id string, distance double, text string, is_row_match boolean")
    return retrieval.rerank(df, "red apple", 10, pool=3).select("chunk_id", F.round("relevance", 4).alias("relevance"))


@query(stated("document_id file link excerpt", [("d1", "report.pdf", "/x/report.pdf#page=3", "some text"), ("d2", "notes.md", "/x/notes.md", "more")]))
def cited_hits(spark, sf_dir):
    hits = _given(spark, [("c1", "d1", 3, "some text"), ("c2", "d2", None, "more")], "chunk_id string, document_id string, page int, text string")
    docs = _given(spark, [("d1", "/x/report.pdf"), ("d2", "/x/notes.md")], "document_id string, path string")
    return ingest.citations(hits, docs).select("document_id", "file", "link", "excerpt")


@query(stated("body distance relevance", [("East: price = 5", 0.0, 1.0), ("West: price = 2.5", 0.0, 1.0)], {"distance": "DOUBLE", "relevance": "DOUBLE"}))
def facts_as_evidence(spark, sf_dir):
    return ingest.facts(_given(spark, [("East", 5.0), ("West", 2.5)], "group_key string, value double"), "price").withColumnRenamed("text", "body")


@query(stated("n_images n_completed n_failed n_skipped avoided_pct", [(8, 4, 1, 3, 37.5)], {"avoided_pct": "DOUBLE"}))
def image_counts(spark, sf_dir):
    return ingest.image_metrics(_given(spark, [(s,) for s in ["completed"] * 4 + ["failed"] + ["skipped"] * 3], "status string"))


@query(stated("table_index source_image_id", [(0, "i0"), (1, None)], {"table_index": "INTEGER"}))
def linked_table_crops(spark, sf_dir):
    shots = _given(spark, [("d", ingest.CROP_INDEX, "i0"), ("d", 1, "other")], "document_id string, image_index int, id string")
    return ingest.linked_crops(shots, _given(spark, [("d", 0), ("d", 1)], "document_id string, table_index int")).select("table_index", "source_image_id")


_FILES = [("a.PDF", "pdf", True), ("b.exe", "exe", False), ("c", "", False), ("d.tar.md", "md", True)]


@query(stated("path extension admitted", _FILES))
def admitted_files(spark, sf_dir):
    return documents.admitted(_given(spark, [(p,) for p, *_ in _FILES], "path string"))


@query(stated("path position kind body", [("a.md", 0, "heading", "Title"), ("a.md", 1, "text", "One line and more."), ("b.html", 0, "heading", "T"), ("b.html", 1, "text", "x y"), ("c.txt", 0, "text", "p one"), ("c.txt", 1, "text", "p two"), ("d.bin", -1, "error", "ValueError: no reader for .bin")], {"position": "INTEGER"}))
def parsed_files(spark, sf_dir):
    """Readers by extension; a file without one is an error of its own."""
    files = [("a.md", b"# Title\nOne line\nand more.\n"), ("b.html", b"<h1>T</h1><p>x  <b>y</b></p><script>z</script>"), ("c.txt", b"p\none\n\np two"), ("d.bin", b"x")]
    got = documents.parsed(_given(spark, files, "path string, content binary"))
    blocks = got.select("path", F.explode("blocks").alias("b")).select("path", "b.position", "b.kind", F.col("b.text").alias("body"))
    return blocks.unionByName(got.where("error IS NOT NULL").select("path", F.lit(-1).alias("position"), F.lit("error").alias("kind"), F.col("error").alias("body")))


@query(stated("attempt said seconds", [(1, "", 1.5), (2, "", 3.0), (3, "", 6.0), (9, "", 60.0), (1, "try again in 7.5s", 8.0), (1, "Try again in 0.1s", 1.5)], {"attempt": "INTEGER", "seconds": "DOUBLE"}))
def retry_delays(spark, sf_dir):
    asked = [(1, ""), (2, ""), (3, ""), (9, ""), (1, "try again in 7.5s"), (1, "Try again in 0.1s")]
    return _given(spark, [(a, s, models.retry_delay(a, body=s)) for a, s in asked], "attempt int, said string, seconds double")


@query(stated("image_index duplicate_of", [(2, 0), (3, 0), (5, 4)], {"image_index": "INTEGER", "duplicate_of": "INTEGER"}))
def repeated_images(spark, sf_dir):
    """Equal hashes, one within five bits, and one too far away; another document's images don't count."""
    rows = [("d", 0, 0), ("d", 1, 2**40 - 1), ("d", 2, 0), ("d", 3, 0b11111), ("d", 4, 2**62 - 1), ("d", 5, 2**62 - 2), ("e", 0, 0)]
    return images.duplicates(_given(spark, rows, "document_id string, image_index int, ahash long")).select("image_index", "duplicate_of")


@query(stated("sentence position", [("Dr. Smith came.", 0), ("He paid Acme Inc. in full.", 1), ("Why?", 2)], {"position": "INTEGER"}))
def prose_sentences(spark, sf_dir):
    """A full stop behind an abbreviation ends no sentence."""
    df = _given(spark, [("Dr. Smith came. He paid Acme Inc. in full. Why?",)], "text string")
    return df.select(F.posexplode(text.prose_sentences(F.col("text"))).alias("position", "sentence"))


@query(stated("segment body", [(0, "aaaa\nbbbb\ncccc"), (1, "bbbb\ncccc\ndddd\neeee")], {"segment": "INTEGER"}))
def clause_segments(spark, sf_dir):
    """Segments of about ten characters; each begins with the last blocks, two at most, of the one before."""
    df = _given(spark, [("d", i, c * 4) for i, c in enumerate("abcde")], "document_id string, position int, text string")
    return clauses.segments(df, most=10).select("segment", F.col("text").alias("body"))
