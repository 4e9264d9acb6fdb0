"""Questions about tables, and row relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfolio.operators import cell_index, rows, structured
from gridfolio.plans import engine, nl
from gridfolio.queries import query
from gridfolio.session import read_table, scratch_path, written


def _ask(spark, sf_dir, table: str, question: str, tie: list[str]) -> DataFrame:
    return engine.ask(read_table(spark, sf_dir, table), question, tie).rows


def _grouped(spark, sf_dir, table: str, question: str) -> DataFrame:
    return _ask(spark, sf_dir, table, question, []).select("group_key", F.round("value", 2).alias("value"))


@query("SELECT l_returnflag AS group_key, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1")
def nl_group_by_sum(spark, sf_dir):
    return _grouped(spark, sf_dir, "lineitem", "total l_extendedprice by l_returnflag")


@query("SELECT o_orderpriority AS group_key, round(avg(o_totalprice), 2) AS value FROM orders GROUP BY 1")
def nl_group_by_avg(spark, sf_dir):
    return _grouped(spark, sf_dir, "orders", "average o_totalprice per o_orderpriority")


@query("SELECT event_type AS group_key, count(*)::DOUBLE AS value FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def nl_group_by_count(spark, sf_dir):
    return _grouped(spark, sf_dir, "events", "how many events grouped by event_type")


@query("SELECT p_brand AS group_key, round(min(p_retailprice), 2) AS value FROM part GROUP BY 1")
def nl_group_by_min(spark, sf_dir):
    return _grouped(spark, sf_dir, "part", "min p_retailprice per p_brand")


@query("SELECT c_mktsegment AS group_key, round(max(c_acctbal), 2) AS value FROM customer GROUP BY 1")
def nl_group_by_max(spark, sf_dir):
    return _grouped(spark, sf_dir, "customer", "max c_acctbal per c_mktsegment")


@query(
    """SELECT l_returnflag AS group_key, round(sum(l_quantity), 2) AS value FROM lineitem
       WHERE l_discount >= 0.05 AND lower(trim(l_linestatus)) = 'o' GROUP BY 1"""
)
def nl_group_by_filtered(spark, sf_dir):
    source = structured.Source(read_table(spark, sf_dir, "lineitem"))
    tree, _ = nl.conditions("l_discount at least 0.05 and l_linestatus is O")
    return structured.grouped(source, "SUM", "l_returnflag", "l_quantity", tree).select("group_key", F.round("value", 2).alias("value"))


@query(
    """SELECT 'SUM' AS op, round(sum(l_quantity), 4) AS value, count(*) AS n_rows FROM lineitem
       UNION ALL SELECT 'AVG', round(avg(l_discount), 4), count(*) FROM lineitem
       UNION ALL SELECT 'COUNT', count(*), count(*) FROM lineitem
       UNION ALL SELECT 'MIN', round(min(l_tax), 4) + 0, count(*) FROM lineitem
       UNION ALL SELECT 'MAX', round(max(l_extendedprice), 4), count(*) FROM lineitem"""
)
def nl_global_aggregates(spark, sf_dir):
    asked = {"SUM": "total l_quantity", "AVG": "average l_discount", "COUNT": "how many rows", "MIN": "min l_tax", "MAX": "max l_extendedprice"}
    parts = [_ask(spark, sf_dir, "lineitem", q, []).select(F.lit(op).alias("op"), F.round("value", 4).alias("value"), "n_rows") for op, q in asked.items()]
    return reduce(DataFrame.unionByName, parts)


@query(
    """SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders
       WHERE (o_totalprice BETWEEN 1000 AND 50000 AND lower(o_orderstatus) = 'f') OR o_totalprice > 450000"""
)
def nl_filter_and_or_between(spark, sf_dir):
    q = "list all orders o_totalprice between 1000 and 50000 and o_orderstatus is F or o_totalprice above 450000"
    return _ask(spark, sf_dir, "orders", q, ["o_orderkey"]).select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def nl_filter_by_values(spark, sf_dir):
    """No column is named: it is bound by the cells that hold the values."""
    return _ask(spark, sf_dir, "customer", "list all customers in Building or Machinery", ["c_custkey"]).select("c_custkey", "c_mktsegment")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def nl_filter_in_column(spark, sf_dir):
    source = structured.Source(read_table(spark, sf_dir, "orders"))
    return structured.matching(source, nl.Condition("o_orderpriority", "IN", ("1-urgent", "2-high"))).select("o_orderkey", "o_orderpriority")


@query("SELECT p_partkey, p_name FROM part WHERE trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) LIKE '%widget%'")
def nl_filter_like(spark, sf_dir):
    return _ask(spark, sf_dir, "part", "show all parts where p_name containing widget", ["p_partkey"]).select("p_partkey", "p_name")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'O'")
def nl_filter_not_equal(spark, sf_dir):
    source = structured.Source(read_table(spark, sf_dir, "orders"))
    return structured.matching(source, nl.leaf("o_orderstatus is not O")).select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def nl_ranking_top(spark, sf_dir):
    return _ask(spark, sf_dir, "orders", "top 10 orders by o_totalprice", ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 15")
def nl_ranking_bottom(spark, sf_dir):
    return _ask(spark, sf_dir, "part", "bottom 15 parts by p_retailprice", ["p_partkey"]).select("p_partkey", "p_retailprice")


@query("SELECT n_regionkey::VARCHAR AS value, 1 AS n_covered FROM nation WHERE n_nationkey = 7")
def nl_lookup_best_row(spark, sf_dir):
    nation = read_table(spark, sf_dir, "nation")
    name = nation.where("n_nationkey = 7").first()["n_name"]
    source = structured.Source(nation.select("n_name", "n_regionkey"))
    found = nl.lookup(f"what is the n_regionkey for {name.replace('_', ' ')}")
    out = structured.looked_up(source, found[0], found[1], ["n_name"])
    return out.select("value", F.lit(1).alias("n_covered"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = 'household'")
def list_by_value_words(spark, sf_dir):
    """The looser list reading: the column with the most cells that have all the words."""
    source = structured.Source(read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"))
    return structured.listed(source, "households").select("c_custkey", "c_mktsegment")


_SUPPLIER_ROWS = """
    WITH r AS (
        SELECT (row_number() OVER (ORDER BY s_suppkey) - 1)::INTEGER AS row_index, s_suppkey::VARCHAR AS a, s_name AS b, s_nationkey::VARCHAR AS c FROM supplier
    ), cells AS (
        SELECT row_index, 's_suppkey' AS key, a AS value FROM r UNION ALL SELECT row_index, 's_name', b FROM r UNION ALL SELECT row_index, 's_nationkey', c FROM r
    )
"""


def _supplier_rows(spark, sf_dir) -> DataFrame:
    return rows.from_frame(read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), "supplier", ["s_suppkey"])


@query(_SUPPLIER_ROWS + "SELECT 'supplier' AS table_id, row_index, key, value FROM cells WHERE value IS NOT NULL")
def rows_unpivot_cells(spark, sf_dir):
    return rows.cells(_supplier_rows(spark, sf_dir))


@query(
    _SUPPLIER_ROWS
    + """SELECT 'supplier' AS table_id, key, count(*) AS n_cells, count(DISTINCT value) AS n_distinct,
                count(*) FILTER (regexp_matches(value, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$')) AS n_numeric
         FROM cells WHERE value IS NOT NULL GROUP BY key"""
)
def column_profile(spark, sf_dir):
    return rows.profile(_supplier_rows(spark, sf_dir))


@query("SELECT 'customer' AS table_id, 'c_mktsegment' AS key, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE')")
def column_bound_by_values(spark, sf_dir):
    relation = rows.from_frame(read_table(spark, sf_dir, "customer"), "customer", ["c_custkey"])
    return rows.column_of_values(relation, ["building", "furniture"])


@query("SELECT 'nation' AS table_id, 'n_nationkey' AS key")
def single_numeric_column(spark, sf_dir):
    return rows.numeric_fallback(rows.from_frame(read_table(spark, sf_dir, "nation").select("n_name", "n_nationkey"), "nation", ["n_nationkey"]))


@query(
    """
    WITH r AS (
        SELECT (row_number() OVER (ORDER BY p_partkey) - 1) AS i, p_name || ' | ' || p_brand AS line FROM part
    ), n AS (SELECT count(*) AS n FROM part)
    SELECT 'part' AS table_id, (i // greatest(25, ceil(n / 200.0)::BIGINT))::INTEGER AS window_index, min(i)::INTEGER AS row_start, max(i)::INTEGER AS row_end,
           string_agg(line, chr(10) ORDER BY i) AS text
    FROM r, n GROUP BY 2
    """
)
def row_windows(spark, sf_dir):
    relation = rows.from_frame(read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), "part", ["p_partkey"])
    named = relation.withColumn("row_text", F.concat_ws(" | ", F.col("row_data")["p_name"], F.col("row_data")["p_brand"]))
    return rows.windows(named)


@query(
    """SELECT * FROM (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem)
       WHERE rank <= 2""".replace("SELECT *", "SELECT l_orderkey, l_linenumber, l_extendedprice")
)
def top_rows_per_table(spark, sf_dir):
    df = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return structured.top_per_group(df, ["l_orderkey"], [F.col("l_extendedprice").desc(), F.col("l_linenumber")], 2)


@query("SELECT (SELECT count(*) FROM orders WHERE o_totalprice > 100000) AS matched, (SELECT count(*) > 200 FROM orders WHERE o_totalprice > 100000) AS truncated")
def filter_truncation_flag(spark, sf_dir):
    source = structured.Source(read_table(spark, sf_dir, "orders"))
    return structured.capped(structured.matching(source, nl.leaf("o_totalprice above 100000")), [F.col("o_orderkey")])[1]


def _cells(spark, sf_dir) -> tuple[cell_index.CellIndex, DataFrame]:
    """The parts as maps, and an index of their cells. A map's cells are texts, and so rows are numbered by the key as a text."""
    maps = written(rows.from_frame(read_table(spark, sf_dir, "part"), "part", [F.col("p_partkey").cast("string")]), "maps")
    return cell_index.CellIndex.build(maps, scratch_path(spark, "cells")), maps


@query(
    """SELECT p_partkey::VARCHAR AS p_partkey, p_name FROM part
       WHERE (p_size BETWEEN 3 AND 10 AND lower(p_brand) = 'brand#13') OR (lower(p_name) LIKE '%red%' AND p_retailprice > 950)"""
)
def cell_index_filter(spark, sf_dir):
    """Sets of rows by cells: an AND of two columns, and an OR of such sets, before any row is read."""
    index, maps = _cells(spark, sf_dir)
    tree, _ = nl.conditions("p_size between 3 and 10 and p_brand is Brand#13 or p_name containing 'red' and p_retailprice above 950")
    found = index.matching(maps, tree)
    return found.select(F.try_element_at("row_data", F.lit("p_partkey")).alias("p_partkey"), F.try_element_at("row_data", F.lit("p_name")).alias("p_name"))


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_retailprice AS rank_value FROM part WHERE lower(p_type) <> 'economy' ORDER BY p_retailprice DESC, p_partkey LIMIT 30")
def cell_index_top(spark, sf_dir):
    index, maps = _cells(spark, sf_dir)
    found = index.ranked(maps, "p_retailprice", True, 30, nl.conditions("p_type is not economy")[0])
    return found.select(F.try_element_at("row_data", F.lit("p_partkey")).alias("p_partkey"), "rank_value")


@query("SELECT round(sum(p_retailprice), 2) AS value, count(*) AS n_rows FROM part WHERE p_brand IN ('Brand#13', 'Brand#22') AND p_size < 25")
def cell_index_total(spark, sf_dir):
    """An aggregate from cells alone."""
    index, _ = _cells(spark, sf_dir)
    tree, _ = nl.conditions("p_brand in Brand#13 or Brand#22 and p_size under 25")
    return index.aggregated("SUM", "p_retailprice", tree).select(F.round("value", 2).alias("value"), "n_rows")
