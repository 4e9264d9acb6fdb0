"""Arrays, maps, grids and tolerant JSON as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridfolio.functions.numeric import parse_number


def row_map(headers: Column, row: Column) -> Column:
    """Header -> trimmed cell. Ragged rows are tolerated, blank cells are absent, of equal headers the last wins."""
    width = F.least(F.size(headers), F.size(row))
    entries = F.zip_with(F.slice(headers, 1, width), F.slice(row, 1, width), lambda h, v: F.struct(h.alias("key"), F.trim(v).alias("value")))
    entries = F.filter(entries, lambda e: e["key"].isNotNull() & F.coalesce(e["value"] != "", F.lit(False)))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def numeric_map(row_data: Column) -> Column:
    """The cells of a row that are numbers, as doubles."""
    return F.map_filter(F.transform_values(row_data, lambda k, v: parse_number(v)), lambda k, v: v.isNotNull())


def merged(old: Column, new: Column) -> Column:
    """Shallow merge of maps; the right side wins."""
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.map_concat(kept, new))


def append_absent(items: Column, value: Column) -> Column:
    return F.array_union(items, F.array(value))


def at_or(items: Column, index: Column, default: Column) -> Column:
    return F.coalesce(F.get(items, index), default)


def uniform_width(rows: Column) -> Column:
    """Whether there are rows, all of one width."""
    return (F.size(rows) > 0) & F.forall(rows, lambda r: F.size(r) == F.size(F.get(rows, F.lit(0))))


def well_formed(headers: Column, rows: Column) -> Column:
    """Whether there are headers and rows, and all rows are as wide as the headers."""
    return (F.size(headers) > 0) & (F.size(rows) > 0) & F.forall(rows, lambda r: F.size(r) == F.size(headers))


def markdown_table(headers: Column, rows: Column) -> Column:
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(headers, lambda h: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(headers), rule), F.transform(rows, line)), "\n")


def csv_text(headers: Column, rows: Column) -> Column:
    """RFC 4180 lines: cells with a comma, quote or line break are quoted."""

    def cell(c: Column) -> Column:
        v = F.coalesce(c, F.lit(""))
        return F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    line = lambda cells: F.array_join(F.transform(cells, cell), ",")
    return F.concat(F.array_join(F.concat(F.array(line(headers)), F.transform(rows, line)), "\r\n"), F.lit("\r\n"))


def joined_headers(rows: Column) -> Column:
    """Several header rows as one: the distinct non-blank cells of a column, joined by blanks."""
    return F.transform(
        F.get(rows, F.lit(0)),
        lambda _, i: F.array_join(F.array_distinct(F.filter(F.transform(rows, lambda r: F.trim(F.get(r, i))), lambda c: F.coalesce(c != "", F.lit(False)))), " "),
    )


def tolerant_json(text: Column) -> Column:
    """A VARIANT of the first JSON object in a text; fences are removed, a truncated object is closed; null if none can be read."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "```(?:json|JSON)?|~~~|`", "")
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    cut = F.regexp_extract(bare, r"(?s)\{.*", 0)
    candidates = [bare, inner, F.concat(inner, F.lit("]}")), F.concat(inner, F.lit("}")), F.concat(cut, F.lit('"}')), F.concat(cut, F.lit('"]}')), F.concat(cut, F.lit("}"))]
    return F.coalesce(*[F.when(c.startswith("{") | c.startswith(" ") | c.startswith("\n"), F.try_parse_json(F.trim(c))) for c in candidates])


def from_choice(value: Column, allowed: list[str], default: str | None = None) -> Column:
    """Enum clamp: the lower-case value if it is allowed, else the default."""
    v = F.lower(F.trim(value))
    return F.when(v.isin(allowed), v).otherwise(F.lit(default))
