"""Row relations of extracted tables: (table_id, row_index, row_data, row_numeric, row_text), their columns and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridfolio.functions import nested, text
from gridfolio.session import written

ROWS_PER_WINDOW = 25
MAX_WINDOWS = 200


def from_grids(grids: DataFrame) -> DataFrame:
    """Rows of (document_id, table_id, headers array<string>, rows array<array<string>>); rows without any cell are left out."""
    cells = grids.select("document_id", "table_id", "headers", F.posexplode("rows").alias("row_index", "cells"))
    out = cells.select("document_id", "table_id", "row_index", nested.row_map(F.col("headers"), F.col("cells")).alias("row_data"))
    out = out.where(F.size("row_data") > 0)
    return out.withColumns({"row_numeric": nested.numeric_map(F.col("row_data")), "row_text": text.row_text(F.col("row_data"))})


def numbered(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """Adds row_index, from 0 in the order of the columns ``order``, without gathering all rows in one task.

    Rows are dealt by ranges of the order, numbered within each, and shifted by the sizes of the ranges before.
    The dealt rows are written, since the ranges come from a sample and must be the same for both readers.
    """
    dealt = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a partition: as small as the job's task list.
    bases = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.join(F.broadcast(bases), "__part").withColumn("row_index", (F.col("__base") + own - 1).cast("int")).drop("__part", "__base")


def from_frame(df: DataFrame, table_id: str, order: list[str | Column]) -> DataFrame:
    """The rows of an ordinary DataFrame as text maps, numbered by ``order``; nulls are absent keys."""
    entries = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in df.columns])
    kept = F.filter(entries, lambda e: e["value"].isNotNull())
    out = numbered(df, order).select(F.lit(table_id).alias("table_id"), "row_index", F.map_from_entries(kept).alias("row_data"))
    return out.withColumn("row_numeric", nested.numeric_map(F.col("row_data")))


def cells(rows: DataFrame) -> DataFrame:
    """One row per cell: table_id, row_index, key, value."""
    return rows.select("table_id", "row_index", F.explode("row_data").alias("key", "value"))


def profile(rows: DataFrame) -> DataFrame:
    """Per table and column: n_cells, n_distinct, n_numeric."""
    flat = rows.select("table_id", F.explode("row_data").alias("key", "value"), "row_numeric")
    return flat.groupBy("table_id", "key").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count_distinct("value").alias("n_distinct"),
        F.count_if(F.map_contains_key("row_numeric", F.col("key"))).alias("n_numeric"),
    )


def column_of_values(rows: DataFrame, values: list[str]) -> DataFrame:
    """Per table the column with the most cells among ``values`` (labels compared); ties: the first by name."""
    wanted = [text.label(F.lit(v)) for v in values]
    hits = cells(rows).where(text.label(F.col("value")).isin(wanted)).groupBy("table_id", "key").agg(F.count(F.lit(1)).alias("n"))
    return hits.groupBy("table_id").agg(F.max_by("key", F.struct(F.col("n"), _descending("key"))).alias("key"), F.max("n").alias("n"))


def _descending(name: str) -> Column:
    """Orders strings backwards inside max_by: code points are complemented."""
    return F.transform(F.split(F.col(name), ""), lambda c: -F.ascii(c))


def numeric_fallback(rows: DataFrame) -> DataFrame:
    """The numeric column of each table that has exactly one."""
    keys = rows.select("table_id", F.explode(F.map_keys("row_numeric")).alias("key")).distinct()
    return keys.groupBy("table_id").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


def windows(rows: DataFrame, size: int = ROWS_PER_WINDOW, most: int = MAX_WINDOWS, overlap: int = 0, value: str = "row_text") -> DataFrame:
    """Consecutive rows of a table as one text: table_id, window_index, row_start, row_end, text.

    A table of more than ``most`` windows gets wider ones. With ``overlap`` each window begins with the last rows
    of the one before.
    """
    sizes = rows.groupBy("table_id").agg((F.max("row_index") + 1).alias("n"))
    step = F.greatest(F.lit(size - overlap), F.ceil(F.col("n") / most).cast("int"))
    placed = rows.join(sizes, "table_id").withColumn("step", step)
    last = F.floor(F.col("row_index") / F.col("step")).cast("int")
    if overlap:
        first = F.greatest(F.lit(0), F.ceil((F.col("row_index") - F.col("step") - overlap + 1) / F.col("step")).cast("int"))
        placed = placed.withColumn("window_index", F.explode(F.sequence(F.least(first, last), last)))
    else:
        placed = placed.withColumn("window_index", last)
    item = F.struct("row_index", F.col(value).alias("text"))
    out = placed.groupBy("table_id", "window_index").agg(
        F.min("row_index").alias("row_start"), F.max("row_index").alias("row_end"), F.sort_array(F.collect_list(item)).alias("items")
    )
    return out.select("table_id", "window_index", "row_start", "row_end", F.array_join(F.col("items.text"), "\n").alias("text"))


def page_of_windows(windowed: DataFrame, row_pages: DataFrame) -> DataFrame:
    """Adds page_start and page_end from (table_id, row_index, page_number).

    Each window names its rows, so rows meet their windows by an equi-join and no row is compared with other windows.
    """
    named = windowed.select("table_id", "window_index", F.explode(F.sequence("row_start", "row_end")).alias("row_index"))
    pages = named.join(row_pages.select("table_id", "row_index", "page_number"), ["table_id", "row_index"])
    pages = pages.groupBy("table_id", "window_index").agg(F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"))
    return windowed.join(pages, ["table_id", "window_index"], "left")
