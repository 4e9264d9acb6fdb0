"""Numeric functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: characters that are left out of a cell before it is read as a number.
DECORATION = r"[$€£₹%,\s]"


def parse_number(cell: Column) -> Column:
    """A cell as a double: parentheses negate, currency signs, percent signs, commas and blanks are left out; null if it is no number.

    A percent sign doesn't divide. ``nan`` and ``inf`` are no numbers. The value keeps all its digits.
    """
    text = F.trim(cell)
    bare = F.regexp_replace(F.regexp_replace(text, r"^\((.*)\)$", "$1"), DECORATION, "")
    value = F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare.try_cast("double"))
    return F.when(text.rlike(r"^\(.*\)$"), -value).otherwise(value)


def is_numeric(cell: Column) -> Column:
    """Whether a cell is a number without parentheses; null counts as no."""
    return F.coalesce(parse_number(cell).isNotNull() & ~F.contains(cell, F.lit("(")), F.lit(False))


def numeric_tokens(text: Column) -> Column:
    """The distinct numbers of a text, in order of first appearance, without their decoration."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d[\d,]*(?:\.\d+)?"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, ",", "").try_cast("double")))


def grid_numbers(rows: Column) -> Column:
    """The distinct numbers of the cells of array<array<string>>."""
    return F.array_distinct(F.filter(F.transform(F.flatten(rows), parse_number), lambda x: x.isNotNull()))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity; null where a vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, 1 - dot(a, b) / norms)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def quality_bucket(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0, default: float = 0.0) -> Column:
    value = x.try_cast("double")
    return F.greatest(F.lit(lo), F.least(F.lit(hi), F.coalesce(F.when(~F.isnan(value), value), F.lit(default))))
