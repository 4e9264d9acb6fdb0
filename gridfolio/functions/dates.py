"""Fiscal years, reporting periods and durations as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: month names and abbreviations.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    got = F.regexp_extract(text, pattern, group)
    return F.when(got != "", got)


def fiscal_year(text: Column) -> Column:
    """FY2024 from FY24, FY2024 or FY 2024, else from a year next to ``fiscal`` or ``year``; null without one."""
    digits = _found(text, r"(?i)\bFY\s?(\d{2,4})\b")
    near = F.coalesce(_found(text, r"(?i)(?:fiscal|year)\D{0,10}\b((?:19|20)\d{2})\b"), _found(text, r"(?i)\b((?:19|20)\d{2})\b\D{0,10}(?:fiscal|year)"))
    return F.coalesce(F.when(F.length(digits) == 2, F.concat(F.lit("FY20"), digits)), F.concat(F.lit("FY"), digits), F.concat(F.lit("FY"), near))


def reporting_period(text: Column) -> Column:
    """A quarter, half, YTD, month, ``annual`` or ``quarterly``, in this order of precedence; null without one."""

    def part(mark: str, digits: str) -> Column:
        number = _found(text, rf"(?i)\b{mark}([{digits}])\s?(\d{{2,4}})?\b")
        year = F.regexp_extract(text, rf"(?i)\b{mark}([{digits}])\s?(\d{{2,4}})?\b", 2)
        return F.when(number.isNotNull(), F.trim(F.concat(F.lit(mark), number, F.lit(" "), year)))

    month = _found(text, rf"(?i)\b({MONTHS})\b")
    return F.coalesce(
        part("Q", "1-4"),
        part("H", "12"),
        F.when(text.rlike(r"(?i)\bYTD\b"), "YTD"),
        F.initcap(month),
        F.when(text.rlike(r"(?i)\bannual\b"), "annual"),
        F.when(text.rlike(r"(?i)\bquarter(ly)?\b"), "quarterly"),
    )


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6
