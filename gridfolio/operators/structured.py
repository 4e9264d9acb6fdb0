"""Filters, aggregates, groupings, rankings, lists and lookups over tables, from bound questions to single plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridfolio.functions import numeric, text
from gridfolio.plans import binder, nl

MAX_ROWS = 200
#: Columns that a question can be bound to.
MAX_HEADERS = 10_000


#: What the name of a column of stored labels ends with.
LABEL_SUFFIX = "__label"


def with_labels(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``df`` with the label of each text column beside it, to be stored with the table.

    Conditions on texts then compare a column with a value, so that Parquet statistics skip what can't match. Sorting by
    such a column before writing makes them skip most of a table.
    """
    columns = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)] if columns is None else columns
    return df.withColumns({f"{c}{LABEL_SUFFIX}": text.label(F.col(c)) for c in columns})


class Source:
    """How a bound column is read: a native column of a DataFrame, or a key of the maps of a row relation."""

    def __init__(self, df: DataFrame, maps: bool = False):
        self.df, self.maps = df, maps
        self.labels = [f"{c}{LABEL_SUFFIX}" for c in df.columns if f"{c}{LABEL_SUFFIX}" in df.columns]
        if maps:
            self.headers = self._keys("row_data")
        else:
            self.headers = [c for c in df.columns if c not in self.labels]

    def _keys(self, column: str) -> list[str]:
        """The keys of a map column: names of columns, of which a table has few. More than MAX_HEADERS are no table's."""
        keys = [r[0] for r in self.df.select(F.explode(F.map_keys(column)).alias("k")).distinct().sort("k").limit(MAX_HEADERS + 1).collect()]
        if len(keys) > MAX_HEADERS:
            raise ValueError(f"{column} has more than {MAX_HEADERS} different keys: restrict the rows to fewer tables")
        return keys

    def as_text(self, column: str) -> Column:
        return F.try_element_at("row_data", F.lit(column)) if self.maps else F.col(column).cast("string")

    def as_label(self, column: str) -> Column:
        """The label of a cell: the one stored beside it by ``with_labels``, which a scan can be filtered by, else computed."""
        stored = f"{column}{LABEL_SUFFIX}"
        return F.col(stored) if stored in self.labels else text.label(self.as_text(column))

    def number_like(self, column: str, value: float) -> tuple[Column, bool]:
        """A literal to compare a column with, and whether the column itself can be compared with it, without a cast that no scan takes."""
        whole = not self.maps and isinstance(self.df.schema[column].dataType, T.IntegralType) and float(value).is_integer() and abs(value) < 2**31
        return (F.lit(int(value)), True) if whole else (F.lit(float(value)), False)

    def as_number(self, column: str, exact: bool = False) -> Column:
        """A cell as a double, or as it is with ``exact``."""
        if self.maps:
            return F.try_element_at("row_numeric", F.lit(column))
        if exact:
            return F.col(column)
        kind = self.df.schema[column].dataType
        return F.col(column).cast("double") if isinstance(kind, T.NumericType) else numeric.parse_number(F.col(column).cast("string"))

    def numeric_columns(self) -> list[str]:
        if self.maps:
            return self._keys("row_numeric")
        return [f.name for f in self.df.schema if isinstance(f.dataType, T.NumericType)]

    def column_of_values(self, values: list[str]) -> str | None:
        """The text column with the most cells among ``values``: one pass over the table for all columns."""
        wanted = [binder.label(v) for v in values]
        columns = self.headers if self.maps else [f.name for f in self.df.schema if isinstance(f.dataType, T.StringType) and f.name in self.headers]
        if not columns:
            return None
        counts = self.df.agg(*[F.count_if(self.as_label(c).isin(wanted)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
        best = max(range(len(columns)), key=lambda i: (counts[i], -i))
        return columns[best] if counts[best] else None


def bind(source: Source, hint: str | None, values: list[str] | None = None) -> str | None:
    """A column by its name; without a hint (or with one that no header fits) by the values of its cells."""
    found = binder.by_name(hint, source.headers) if hint else None
    return found or (source.column_of_values(values) if values else None)


def predicate(source: Source, tree) -> Column | None:
    """A Column for a condition tree; null cells match nothing. None if it can't be bound.

    Of an AND every part must be bound, else the table is skipped; of an OR those that can't be bound are left out.
    Texts are compared by label on both sides.
    """
    if isinstance(tree, nl.Bool):
        parts = [predicate(source, t) for t in tree.children]
        if tree.op == "AND":
            return None if any(p is None for p in parts) else reduce(lambda a, b: a & b, parts)
        bound = [p for p in parts if p is not None]
        return reduce(lambda a, b: a | b, bound) if bound else None
    values = list(tree.value) if tree.op == "IN" else [tree.value] if tree.op in ("EQ", "NEQ", "LIKE") else None
    column = bind(source, tree.column, values)
    if column is None:
        return None
    if tree.op in ("EQ", "NEQ", "IN", "LIKE"):
        cell, wanted = source.as_label(column), [binder.label(v) for v in values]
        has = source.as_text(column).isNotNull()
        return has & {"EQ": cell == wanted[0], "NEQ": cell != wanted[0], "IN": cell.isin(wanted), "LIKE": F.contains(cell, F.lit(wanted[0]))}[tree.op]
    low, high = (source.number_like(column, v) for v in (tree.value if tree.op == "BETWEEN" else (tree.value, tree.value)))
    cell = source.as_number(column, exact=low[1] and high[1])
    low, high = low[0], high[0]
    # A cell that is no number gives null, which a filter drops as it does false: nothing stands between the scan and the comparison.
    return {"BETWEEN": (cell >= low) & (cell <= high), "GT": cell > low, "GTE": cell >= low, "LT": cell < low, "LTE": cell <= low}[tree.op]


def _rows(source: Source, tree) -> DataFrame | None:
    if tree is None:
        return source.df
    found = predicate(source, tree)
    return None if found is None else source.df.where(found)


def matching(source: Source, tree) -> DataFrame | None:
    """All rows that satisfy the tree, as one filter; None if it can't be bound.

    Comparisons of numbers reach the scan; those of texts do where their labels are stored (``with_labels``).
    """
    rows = _rows(source, tree)
    return None if rows is None else rows.drop(*source.labels)


def capped(df: DataFrame, order: list[Column], most: int = MAX_ROWS) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` rows of an answer, and (matched, truncated) about all of them."""
    total = df.agg(F.count(F.lit(1)).alias("matched")).withColumn("truncated", F.col("matched") > most)
    return df.orderBy(*order).limit(most), total


def fold(op: str, value: Column) -> Column:
    """SUM, AVG, MIN or MAX of the cells that are numbers, or COUNT of rows."""
    return {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[op](value) if op != "COUNT" else F.count(F.lit(1)).cast("double")


def aggregated(source: Source, op: str, hint: str | None, tree=None) -> DataFrame | None:
    """value, n_rows, n_unparsed of the rows that satisfy ``tree``; value is null when no cell is a number."""
    rows = _rows(source, tree)
    column = bind(source, hint) if hint else None
    if column is None and op != "COUNT":
        candidates = source.numeric_columns()
        column = candidates[0] if len(candidates) == 1 else None
    if rows is None or (column is None and op != "COUNT"):
        return None
    cell = source.as_number(column) if column else F.lit(1.0)
    missing = source.as_text(column).isNotNull() & cell.isNull() if column else F.lit(False)
    return rows.agg(fold(op, cell).alias("value"), F.count(F.lit(1)).alias("n_rows"), F.count_if(missing).alias("n_unparsed"))


def grouped(source: Source, op: str, group_hint: str, hint: str | None, tree=None, ignore_case: bool = False) -> DataFrame | None:
    """group_key, value per group of the raw text (or its label), largest value first, then by key."""
    rows = _rows(source, tree)
    key = bind(source, group_hint)
    column = bind(source, hint) if hint else None
    if column is None and op != "COUNT":
        candidates = [c for c in source.numeric_columns() if c != key]
        column = candidates[0] if len(candidates) == 1 else None
    if rows is None or key is None or (column is None and op != "COUNT"):
        return None
    shown = source.as_label(key) if ignore_case else source.as_text(key)
    out = rows.where(shown.isNotNull()).groupBy(shown.alias("group_key")).agg(fold(op, source.as_number(column) if column else F.lit(1.0)).alias("value"))
    return out.where(F.col("value").isNotNull()).orderBy(F.col("value").desc(), "group_key")


def ranked(source: Source, rank: nl.Ranking, tie: list[str], tree=None) -> DataFrame | None:
    """The first rows by a numeric column; rows without a number are left out; ties by the columns ``tie``."""
    rows = _rows(source, tree)
    column = bind(source, rank.column)
    if column is None:
        candidates = source.numeric_columns()
        column = candidates[0] if len(candidates) == 1 else None
    if rows is None or column is None:
        return None
    number = source.as_number(column)
    order = number.desc() if rank.descending else number.asc()
    return rows.where(number.isNotNull()).withColumn("rank_value", number).orderBy(order, *tie).limit(rank.limit).drop(*source.labels)


def listed(source: Source, value: str) -> DataFrame | None:
    """Every row whose cell, in the column with the most matching cells, has all words of ``value``; a plural s or es is ignored."""
    wanted = binder.label(value).split()
    if not wanted:
        return None
    bare = lambda w: w[:-2] if len(w) > 4 and w.endswith("es") else w[:-1] if len(w) > 3 and w.endswith("s") else w

    def match(column: str) -> Column:
        have = F.split(source.as_label(column), " ")
        stems = F.transform(have, lambda w: F.when((F.length(w) > 4) & F.endswith(w, F.lit("es")), F.left(w, F.length(w) - 2)).when((F.length(w) > 3) & F.endswith(w, F.lit("s")), F.left(w, F.length(w) - 1)).otherwise(w))
        return F.size(F.array_except(F.array(*[F.lit(bare(w)) for w in wanted]), stems)) == 0

    columns = source.headers
    counts = source.df.agg(*[F.count_if(match(c)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    best = max(range(len(columns)), key=lambda i: (counts[i], -i), default=None)
    return source.df.where(match(columns[best])).drop(*source.labels) if best is not None and counts[best] else None


def looked_up(source: Source, asked: str, row_words: str, tie: list[str]) -> DataFrame | None:
    """The value of the asked column in the row that covers the most of ``row_words``: value, n_covered, cell_score.

    Rows that cover equally many are ordered by their best single cell (100 equal, 50 containing, else shared
    words), then by ``tie``.
    """
    column = binder.by_name(asked, source.headers) or binder.by_mention(asked, source.headers)
    wanted = sorted(set(binder.label(row_words).split()) - {"in", "for", "of", "the", "and", "where", "is"})
    if column is None or not wanted:
        return None
    labels = F.transform(F.array(*[source.as_text(c) for c in source.headers if c != column]), text.label)
    need = F.array(*[F.lit(w) for w in wanted])
    shared = lambda cell: F.size(F.array_intersect(F.split(cell, " "), need))
    phrase = F.lit(binder.label(row_words))
    score = lambda cell: F.when(cell == "", 0).when(cell == phrase, 100).when(F.contains(phrase, cell) | F.contains(cell, phrase), 50).otherwise(shared(cell))
    covered = F.size(F.array_intersect(F.split(F.array_join(labels, " "), " "), need))
    rows = source.df.withColumns({"value": source.as_text(column), "n_covered": covered, "cell_score": F.array_max(F.transform(labels, score))})
    rows = rows.where((F.col("n_covered") > 0) & F.col("value").isNotNull())
    return rows.orderBy(F.col("n_covered").desc(), F.col("cell_score").desc(), *tie).limit(1).drop(*source.labels)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__rank") <= n).drop("__rank")
