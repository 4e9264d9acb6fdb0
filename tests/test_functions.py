"""Scalar functions."""

import pytest
from gridfolio.functions import dates, nested, numeric, text
from pyspark.sql import functions as F


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("cell", "want"), [("$12,842", 12842.0), ("(542)", -542.0), ("12.5%", 12.5), ("n/a", None), (None, None), ("nan", None), ("inf", None), ("1234567.89", 1234567.89), ("-3", -3.0), ("", None)])
def test_parse_number(spark, cell, want):
    assert one(spark, cell, numeric.parse_number) == want


def test_numeric_tokens(spark):
    assert one(spark, "12.5% to €45,000 and 12.5", numeric.numeric_tokens) == [12.5, 45000.0]


@pytest.mark.parametrize(("value", "want"), [("FY24", "FY2024"), ("FY 2023", "FY2023"), ("fiscal year 2021", "FY2021"), ("page 1999", None), ("Revenue FY2024", "FY2024")])
def test_fiscal_year(spark, value, want):
    assert one(spark, value, dates.fiscal_year) == want


@pytest.mark.parametrize(("value", "want"), [("Q3 2024", "Q3 2024"), ("q1", "Q1"), ("H2 24", "H2 24"), ("YTD march", "YTD"), ("in march", "March"), ("annual", "annual"), ("quarterly", "quarterly"), ("x", None)])
def test_reporting_period(spark, value, want):
    assert one(spark, value, dates.reporting_period) == want


@pytest.mark.parametrize(("value", "want"), [("R&D Spend!", "r d spend"), ("É", ""), (None, ""), ("  A  b", "a b")])
def test_label(spark, value, want):
    assert one(spark, value, text.label) == want


def test_sentences(spark):
    assert one(spark, "One. Two!  Three? four", text.sentences) == ["One.", "Two!", "Three?", "four"]
    assert one(spark, "Dr. Smith came. He left.", text.prose_sentences) == ["Dr. Smith came.", "He left."]
    assert one(spark, None, text.sentences) == []


def test_sentences_keep_digits_that_equal_their_index(spark):
    assert one(spark, "A. B. C. D. 4191 is 4", text.sentences) == ["A.", "B.", "C.", "D.", "4191 is 4"]
    assert one(spark, "  0 first. Last  ", text.sentences) == ["0 first.", "Last"]


def test_rows_as_text(spark):
    df = spark.createDataFrame([(["A", "B"], ["1", "2", "x"])], "h array<string>, r array<string>")
    assert df.select(text.serialize_row(F.col("h"), F.col("r"))).first()[0] == "A: 1; B: 2; col_2: x"
    assert df.select(text.serialize_row(F.col("h"), F.array(F.lit(None).cast("string")))).first()[0] == "A: ; B: "
    assert df.select(nested.csv_text(F.col("h"), F.array(F.array(F.lit('a,"b'), F.lit("c"))))).first()[0] == 'A,B\r\n"a,""b",c\r\n'
    assert df.select(nested.markdown_table(F.col("h"), F.array(F.array(F.lit("1"), F.lit("2"))))).first()[0] == "| A | B |\n| --- | --- |\n| 1 | 2 |"


def test_clause(spark):
    found = one(spark, "1.2 TERMINATION FOR CAUSE\nEither party may terminate.", lambda c: text.clause(c, F.lit(None).cast("string")))
    assert found["is_clause"] and found["number"] == "1.2" and found["type"] == "termination"
    assert not one(spark, "Nothing here.", lambda c: text.clause(c, F.lit(None).cast("string")))["is_clause"]


def test_nested(spark):
    df = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3})], "x map<string,int>, y map<string,int>")
    assert df.select(nested.merged(F.col("x"), F.col("y"))).first()[0] == {"a": 1, "b": 3}
    for raw, want in [('```json\n{"a": 1}\n```', '{"a":1}'), ('noise {"a": 1} noise', '{"a":1}'), ('{"a": [1', None), ("none", None), (None, None)]:
        got = one(spark, raw, lambda c: nested.tolerant_json(c).cast("string"))
        assert got == want


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>, c array<double>, d array<double>, z array<double>")
    got = df.select(*[numeric.cosine_distance(F.col("a"), F.col(x)) for x in "bcdz"]).first()
    assert list(got) == [0.0, 1.0, 2.0, None]


def test_text_helpers(spark):
    assert one(spark, "<ul><li>a</li></ul><b>x</b>", text.clean_markup) == "- a\n\n**x**"
    assert one(spark, "abcdef", lambda c: text.bounded(c, 3, "!")) == "abc!"
    assert one(spark, "Table 4.2: Revenue", text.caption_number) == "4.2"
    assert one(spark, "Legal Clauses", text.canonical_store) == "clause_store"
    assert one(spark, "a  b c", lambda c: text.truncated_words(c, 2)) == "a b"
    assert one(spark, "", text.word_count) == 1
