"""Sets of rows from the cell index against the filter over the rows."""

import pytest
from gridfolio.operators import rows, structured
from gridfolio.operators.cell_index import CellIndex
from gridfolio.plans import nl
from gridfolio.session import scratch_path
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

RAGGED = [
    ("t1", 0, {"Name": "Red Steel", "Price": "$1,200", "Size": "3"}), ("t1", 1, {"Name": "red  steel!", "Price": "(5)", "Size": "n/a"}), ("t1", 2, {"Name": "Blue", "Size": "7"}),
    ("t1", 3, {"Price": "8"}), ("t2", 0, {"Name": "Steel", "Price": "900", "Colour": "red"}), ("t2", 1, {"Name": "", "Price": "3"}), ("t2", 2, {}),
]


@pytest.fixture(scope="module")
def maps(spark):
    from gridfolio.functions import nested

    df = spark.createDataFrame(RAGGED, "table_id string, row_index int, row_data map<string,string>").withColumn("row_numeric", nested.numeric_map(F.col("row_data")))
    return df.withColumns({c: F.lit("clash") for c in ("key", "label", "number", "value")})


@pytest.fixture(scope="module")
def index(spark, maps):
    return CellIndex.build(maps, scratch_path(spark, "cells"))


def same(index, maps, tree):
    want = structured.matching(structured.Source(maps, maps=True), tree)
    got = index.matching(maps, tree)
    assert (got is None) == (want is None)
    if got is not None:
        place = lambda df: sorted((r["table_id"], r["row_index"]) for r in df.collect())
        assert place(got) == place(want)
        assert got.columns == want.columns


LEAF = st.one_of(
    st.builds(nl.Condition, st.sampled_from(["Name", "Colour", None, "nothing"]), st.sampled_from(["EQ", "NEQ", "LIKE"]), st.sampled_from(["red steel", "steel", "red", "nowhere"])),
    st.builds(nl.Condition, st.sampled_from(["Name", "Colour"]), st.just("IN"), st.just(("Steel", "Blue"))),
    st.builds(nl.Condition, st.sampled_from(["Price", "Size", "Name"]), st.sampled_from(["GT", "GTE", "LT", "LTE"]), st.sampled_from([3.0, 8.0, -5.0])),
    st.builds(nl.Condition, st.just("Price"), st.just("BETWEEN"), st.just((0.0, 1000.0))),
)
TREE = st.recursive(LEAF, lambda t: st.builds(nl.Bool, st.sampled_from(["AND", "OR"]), st.lists(t, min_size=2, max_size=3).map(tuple)), max_leaves=4)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(TREE)
def test_row_sets_equal_the_filter(index, maps, tree):
    same(index, maps, tree)


def test_numbers_from_cells(index, maps):
    assert tuple(index.aggregated("SUM", "Price").first()) == (1200 - 5 + 8 + 900 + 3, 5)
    tree = nl.Condition("Name", "LIKE", "steel")
    assert tuple(index.aggregated("MAX", "price", tree).first()) == (1200, 3)
    assert [(r["table_id"], r["row_index"]) for r in index.ranked(maps, "Price", True, 2).collect()] == [("t1", 0), ("t2", 0)]
    assert [r["rank_value"] for r in index.ranked(maps, "Price", False, 2, tree).collect()] == [-5, 900]
    assert index.aggregated("SUM", "nothing") is None and index.ranked(maps, "Price", True, 2, nl.Condition("nothing", "GT", 1.0)) is None


def test_added_rows(spark, maps):
    index = CellIndex.build(maps.where("table_id = 't1'"), scratch_path(spark, "cells"))
    assert "Colour" not in index.headers
    index = index.add(maps.where("table_id = 't2'"))
    assert "Colour" in index.headers and index.numeric == ["Price", "Size"]
    same(index, maps, nl.Condition("Colour", "EQ", "red"))


def test_no_rows(spark, maps):
    index = CellIndex.build(maps.limit(0), scratch_path(spark, "cells"))
    assert index.headers == [] and index.matching(maps.limit(0), nl.Condition("Name", "EQ", "x")) is None


def test_conditions_read_few_files(spark):
    """The cells of a column and value lie together: of many files few are read, and both conditions reach the scan."""
    part = spark.read.parquet("/root/testdata/sf0.01/part.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        maps = rows.from_frame(part, "part", ["p_partkey"])
        index = CellIndex.build(maps, scratch_path(spark, "cells"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for cells, condition in ((index.labels(), "key = 'p_brand' and label = 'brand 13'"), (index.numbers(), "key = 'p_size' and number between 3 and 4")):
        files = lambda df: df.select(F.input_file_name()).distinct().count()
        assert files(cells.where(condition)) < files(cells)
        plan = cells.where(condition)._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(key," in plan and ("EqualTo(label," in plan or "GreaterThanOrEqual(number," in plan)


def test_ties_of_a_ranking_go_by_the_key_as_a_text(spark, tmp_path):
    """As the SQL has it, whose key is a text as well: of forty rows of one number, 10 stands before 9."""
    from gridfolio import queries

    queries.load()
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").limit(1).drop("p_partkey")
    spark.range(1, 41).select(F.col("id").alias("p_partkey")).crossJoin(part.withColumns({"p_retailprice": F.lit(5.0), "p_type": F.lit("PROMO")})).write.parquet(str(tmp_path / "part.parquet"))
    got = [r["p_partkey"] for r in queries.QUERIES["cell_index_top"](spark, str(tmp_path)).collect()]
    assert got == sorted(map(str, range(1, 41)))[:30]
