"""Parsing and answering of questions about tables."""

import pytest

from gridfolio.operators import rows, structured
from gridfolio.plans import binder, engine, nl
from pyspark.sql import functions as F

SALES = [("Month-01", "Marketing", "$12,842", "10000"), ("Month-02", "Marketing", "$9,300", "10000"), ("Month-03", "Marketing", "(542)", "10000"), ("Month-04", "Sales", "15000", "12000"), ("Month-05", "Marketing", "20000", "15000")]
HEADERS = ["Month", "Region", "Actual USD", "Budget USD"]


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(SALES, HEADERS)


@pytest.mark.parametrize(
    ("text", "column", "op", "value"),
    [
        ("price between 10 and 1,000", "price", "BETWEEN", (10.0, 1000.0)),
        ("list all companies with price above $10,000", "companies with price", "GT", 10000.0),
        ("price at least 5", "price", "GTE", 5.0),
        ("price at most 5", "price", "LTE", 5.0),
        ("price under 5", "price", "LT", 5.0),
        ("name containing steel", "name", "LIKE", "steel"),
        ("region in East or West", "region", "IN", ("East", "West")),
        ("list all companies in the Chemicals sector", "sector", "IN", ("Chemicals",)),
        ("list all companies in Chemicals, Banking or Steel", None, "IN", ("Chemicals", "Banking", "Steel")),
        ("status is open", "status", "EQ", "open"),
        ("status is not open", "status", "NEQ", "open"),
    ],
)
def test_leaf(text, column, op, value):
    assert nl.leaf(text) == nl.Condition(column, op, value)


def test_tree_splits_or_before_and():
    tree, lost = nl.conditions("price between 1 and 5 and region is East or price above 9")
    assert tree.op == "OR" and tree.children[0].op == "AND" and len(tree.children[0].children) == 2 and not lost


def test_unread_parts_are_reported():
    tree, lost = nl.conditions("price above 9 and gibberish")
    assert tree.op == "GT" and lost == ("gibberish",)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("top 5 companies by revenue", nl.Ranking("revenue", True, 5)),
        ("bottom 3 by price", nl.Ranking("price", False, 3)),
        ("largest revenue", nl.Ranking("revenue", True, 10)),
        ("smallest price", nl.Ranking("price", False, 10)),
        ("all rows", None),
    ],
)
def test_ranking(text, want):
    assert nl.ranking(text)[0] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", "semantic_qa"),
        ("summarize all companies in Chemicals", "mixed"),
        ("what is the Actual USD for Month-05", "exact_lookup"),
        ("which sector does Acme belong to?", "exact_lookup"),
        ("top 10 orders by price", "ranking"),
        ("list all orders in East", "filter"),
        ("how many rows", "aggregation"),
        ("what is the total revenue", "aggregation"),
        ("tell me about the report", "semantic_qa"),
    ],
)
def test_intent(text, want):
    assert nl.intent(text) == want


def test_group_by_is_not_claimed_twice():
    assert nl.parse("total revenue by region").group_by == "region"
    assert nl.parse("top 5 companies by revenue").group_by is None


def test_binding():
    headers = ["Actual USD ($)", "Budget %"]
    assert binder.by_name("actual usd", headers) == "Actual USD ($)"
    assert binder.by_name("BUDGET", headers) == "Budget %"
    assert binder.by_name("unknown", headers) is None
    assert binder.by_mention("sum the budget please", headers) == "Budget %"


def test_stores():
    assert nl.stores("termination clause") == {"stores": ["clause"], "doc_types": ["legal"], "confidence": 0.85}
    assert nl.stores("in this paragraph")["confidence"] == 0.4
    assert nl.stores("revenue chart")["confidence"] == 0.65
    assert nl.select_stores(None, {"stores": ["clause"], "confidence": 0.4}) == list(nl.ALL_STORES)
    assert nl.route_by_centroid({"vector": 0.9, "table": 0.5})["stores"] == ["vector"]
    assert nl.route_by_centroid({"vector": 0.1})["confidence"] == 0.35
    assert nl.is_conversational("hello") and not nl.is_conversational("list invoices") and not nl.is_conversational("please summarize") and not nl.is_conversational("what is revenue in 2024")


@pytest.mark.parametrize(("question", "want"), [("total Actual USD", 56600.0), ("average Actual USD", 11320.0), ("how many rows", 5.0), ("min Actual USD", -542.0), ("max Actual USD", 20000.0)])
def test_aggregates_over_decorated_cells(spark, sales, question, want):
    source = structured.Source(sales)
    q = nl.parse(question)
    assert structured.aggregated(source, q.aggregate, "Actual USD").first()["value"] == want


def test_unparsed_cells_are_counted(spark):
    df = spark.createDataFrame([("A", "100"), ("B", "N/A"), ("C", "200")], ["Item", "Amount"])
    row = structured.aggregated(structured.Source(df), "SUM", "Amount").first()
    assert (row["value"], row["n_rows"], row["n_unparsed"]) == (300.0, 3, 1)


def test_lookup(sales):
    found = engine.ask(sales, "what is the Actual USD for Month-05 in Marketing", ["Month"])
    assert found.intent == "exact_lookup" and found.rows.first()["value"] == "20000"
    assert engine.ask(sales, "what is the Budget USD for Month-04", ["Month"]).rows.first()["value"] == "12000"


def test_filters_and_groups(sales):
    got = engine.ask(sales, "list all rows in marketing", ["Month"]).rows
    assert got.count() == 4
    assert [tuple(r) for r in structured.grouped(structured.Source(sales), "SUM", "region", "actual usd").collect()] == [("Marketing", 41600.0), ("Sales", 15000.0)]


def test_and_with_an_unbound_part_skips_the_table(sales):
    tree = nl.Bool("AND", (nl.Condition("zzz", "GT", 1.0), nl.Condition("Region", "EQ", "Sales")))
    assert structured.matching(structured.Source(sales), tree) is None
    assert structured.matching(structured.Source(sales), nl.Bool("OR", tree.children)).count() == 1


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "id * 2 AS price").write.parquet(str(tmp_path / "t"))
    df = engine.ask(spark.read.parquet(str(tmp_path / "t")), "price between 2 and 6", ["id"]).rows
    assert "PushedFilters: [" in df._jdf.queryExecution().toString() and [r["price"] for r in df.collect()] == [2, 4, 6]


def test_row_relation(spark):
    grids = spark.createDataFrame([("d", "t", ["A", "B", "A"], [["1", " ", "3"], ["(4)", "x"], ["", ""]])], "document_id string, table_id string, headers array<string>, rows array<array<string>>")
    got = rows.from_grids(grids).orderBy("row_index").collect()
    assert [r["row_data"] for r in got] == [{"A": "3"}, {"A": "(4)", "B": "x"}]
    assert [r["row_numeric"] for r in got] == [{"A": 3.0}, {"A": -4.0}]


def test_windows_cover_each_row_once(spark):
    df = spark.range(60).selectExpr("'t' AS table_id", "CAST(id AS INT) AS row_index", "CAST(id AS STRING) AS row_text")
    got = rows.windows(df).orderBy("window_index").collect()
    assert [(r["row_start"], r["row_end"]) for r in got] == [(0, 24), (25, 49), (50, 59)]
    assert sum(len(r["text"].split("\n")) for r in got) == 60
    over = rows.windows(df, overlap=5).orderBy("window_index").collect()
    assert over[0]["row_end"] >= over[1]["row_start"]


def test_engine_answers_or_retrieves(spark, sales):
    chunks = spark.createDataFrame([("c1", "d", "vector_store", "apples grow on trees"), ("c2", "d", "vector_store", "cars drive"), ("c3", "e", "clause_store", "apples and law")], ["chunk_id", "document_id", "store", "text"])
    e = engine.Engine({"sales": (sales, ["Month"])}, chunks)
    assert e.query("top 2 rows by Actual USD").rows.count() == 2
    assert e.query("apples").kind == "conversation" and e.query("thanks!").rows is None
    found = e.query("apples that grow")
    assert found.kind == "evidence" and {r["chunk_id"] for r in found.rows.collect()} == {"c1"}
    assert e.answer("which apples")["confidence"] >= 0.5
    assert {r["chunk_id"] for r in e.agentic("what apples", lambda t: ["what cars"]).collect()} == {"c1", "c2", "c3"}


def test_window_source_binds_map_keys(spark):
    grids = spark.createDataFrame([("d", "t", ["Sector", "Price"], [["Steel", "5"], ["Banks", "7"]])], "document_id string, table_id string, headers array<string>, rows array<array<string>>")
    found = engine.ask(rows.from_grids(grids), "price above 6", ["row_index"], maps=True).rows.select(F.col("row_data")["Sector"]).collect()
    assert [r[0] for r in found] == ["Banks"]


def pushed(df):
    """The filters that the scan of a plan takes."""
    return " ".join(line for line in df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).splitlines() if "PushedFilters" in line)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A table with its labels, as it is stored at ingestion."""
    path = str(tmp_path_factory.mktemp("labels") / "part")
    structured.with_labels(spark.read.parquet("/root/testdata/sf0.001/part.parquet")).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize(
    ("question", "filters"),
    [
        ("list all rows with p_size above 45", ["GreaterThan(p_size,45)"]),
        ("list all rows with p_size at least 45", ["GreaterThanOrEqual(p_size,45)"]),
        ("list all rows with p_size under 4", ["LessThan(p_size,4)"]),
        ("list all rows with p_size at most 4", ["LessThanOrEqual(p_size,4)"]),
        ("p_retailprice between 905.5 and 950", ["GreaterThanOrEqual(p_retailprice,905.5)", "LessThanOrEqual(p_retailprice,950.0)"]),
        ("p_size between 3 and 4", ["GreaterThanOrEqual(p_size,3)", "LessThanOrEqual(p_size,4)"]),
        ("p_brand is Brand#13", ["EqualTo(p_brand__label,brand 13)"]),
        ("p_brand in Brand#13 or Brand#22", ["In(p_brand__label, [brand 13,brand 22])"]),
        ("p_brand is not Brand#13", ["Not(EqualTo(p_brand__label,brand 13))"]),
        ("p_name containing 'red'", ["StringContains(p_name__label,red)"]),
        ("p_size above 45 and p_brand is Brand#13", ["GreaterThan(p_size,45)", "EqualTo(p_brand__label,brand 13)"]),
        ("p_size above 45 or p_brand is Brand#13", ["Or(GreaterThan(p_size,45),And(IsNotNull(p_brand),EqualTo(p_brand__label,brand 13)))"]),
    ],
)
def test_conditions_reach_the_scan(stored, question, filters):
    tree, _ = nl.conditions(question)
    found = structured.matching(structured.Source(stored), tree)
    assert all(f in pushed(found) for f in filters), pushed(found)
    assert not any(c.endswith(structured.LABEL_SUFFIX) for c in found.columns)
    plain = stored.drop(*[c for c in stored.columns if c.endswith(structured.LABEL_SUFFIX)])
    assert sorted(map(str, found.collect())) == sorted(map(str, structured.matching(structured.Source(plain), tree).collect()))


def test_labels_serve_groups_and_values(stored):
    source = structured.Source(stored)
    assert source.column_of_values(["brand#13"]) == "p_brand"
    groups = structured.grouped(source, "COUNT", "p_brand", None, ignore_case=True)
    assert groups.agg({"value": "sum"}).first()[0] == stored.count()
