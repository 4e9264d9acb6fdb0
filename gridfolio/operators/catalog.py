"""Catalog views: overviews, latest per key, spines, paging, anti and semi joins, checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_counts(parents: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """Left join of a count per child table, 0 where there is none: each child is aggregated before it is joined."""

    def add(df: DataFrame, item: tuple[str, DataFrame]) -> DataFrame:
        name, child = item
        counts = child.groupBy(key).agg(F.count(F.lit(1)).alias(name))
        return df.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))

    return reduce(add, children.items(), parents)


def latest_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``: a window that keeps one row, which Spark limits before the shuffle."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__rank = 1").drop("__rank")


def with_latest(parents: DataFrame, df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Left join of the latest child per parent (a lateral top-1)."""
    return parents.join(latest_per_key(df, key, order), key, "left")


def status_rollup(parents: DataFrame, items: DataFrame, key: str, status: str, completed: str, failed: str, running: str) -> DataFrame:
    """Counts by status per parent and the derived status: empty, running, failed or completed."""
    joined = parents.join(items, key, "left")
    out = joined.groupBy(key).agg(
        F.count(status).alias("n_total"),
        F.count_if(F.col(status) == completed).alias("n_completed"),
        F.count_if(F.col(status) == failed).alias("n_failed"),
        F.count_if(F.col(status) == running).alias("n_running"),
    )
    derived = F.when(F.col("n_total") == 0, "empty").when(F.col("n_running") > 0, "running").when(F.col("n_failed") > 0, "failed").otherwise("completed")
    return out.withColumn("status", derived)


def missing_children(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    return parents.join(children.select(key), key, "left_anti")


def having_children(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    return parents.join(children.select(key), key, "left_semi")


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def page(df: DataFrame, number: int, size: int, order: list[Column]) -> DataFrame:
    """Rows of page ``number`` (from 1)."""
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    """total and pages, at least one page."""
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long"))


def dense_counts(parents: DataFrame, key: str, last: Column, children: dict[str, DataFrame], number: str = "page_number") -> DataFrame:
    """Counts per parent and page on a dense spine 1..last, 0 where a child has nothing."""
    spine = parents.select(key, F.explode(F.sequence(F.lit(1), last.cast("int"))).alias(number))

    def add(df: DataFrame, item: tuple[str, DataFrame]) -> DataFrame:
        name, child = item
        counts = child.groupBy(key, number).agg(F.count(F.lit(1)).alias(name))
        return df.join(counts, [key, number], "left").withColumn(name, F.coalesce(name, F.lit(0)))

    return reduce(add, children.items(), spine)


def histogram(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Counts of a column's values per group as a map sorted by value."""
    counts = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    entries = F.sort_array(F.collect_list(F.struct(F.col(column).alias("key"), F.col("n").alias("value"))))
    return counts.groupBy(*by).agg(F.map_from_entries(entries).alias("counts"))


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``new`` over ``old`` by key; of rows of ``new`` with one key that which sorts last by all columns stays."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in new.columns if c not in key]))
    last = new.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
    return old.join(new.select(*key), key, "left_anti").unionByName(last)


def deleted(tables: dict[str, DataFrame], key: str, ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the deleted parents."""
    return {name: df.join(ids.select(key), key, "left_anti") for name, df in tables.items()}


def detached(df: DataFrame, column: str, value) -> DataFrame:
    """SET NULL on the deletion of a parent."""
    return df.withColumn(column, F.when(F.col(column) != value, F.col(column)))


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Delete-then-insert: the parents that ``new`` brings lose all their old rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def count_mismatches(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys whose numbers of rows differ, with both numbers."""
    a, b = (df.groupBy(key).agg(F.count(F.lit(1)).alias(n)) for df, n in ((left, "n_left"), (right, "n_right")))
    both = a.join(b, key, "full").select(key, F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))
    return both.where("n_left <> n_right")


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def sessions(messages: DataFrame, key: str, order: str, role: str, body: str) -> DataFrame:
    """Per conversation: messages, user messages, last turn, and a title from the first user message (60 characters)."""
    first = F.min_by(F.when(F.col(role) == "user", F.left(F.trim(body), F.lit(60))), F.when(F.col(role) == "user", F.col(order)))
    return messages.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_messages"), F.count_if(F.col(role) == "user").alias("n_user"), F.max(order).alias("last_turn"), first.alias("title")
    )
