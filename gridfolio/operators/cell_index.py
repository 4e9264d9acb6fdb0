"""Conditions on map-shaped tables answered from a stored index of cells: sets of rows, put together before any row is read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfolio.functions import text
from gridfolio.operators import rows as row_relations
from gridfolio.operators.structured import MAX_HEADERS
from gridfolio.plans import binder, nl

#: Bytes of a row group: the smaller, the more of a table one condition skips.
ROW_GROUP = 4 << 20
ROW = ["table_id", "row_index"]


class CellIndex:
    """The cells of row relations (table_id, row_index, row_data, row_numeric), stored twice: by column and label, and by column and number.

    Both are sorted over all files, so that a condition on one column's values reads the row groups that hold them and no others. A
    cell inside a map can't be skipped: there every row would be read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        keys = spark.read.parquet(f"{path}/keys").groupBy("key").agg(F.max("numeric").alias("numeric")).orderBy("key").limit(MAX_HEADERS + 1).collect()
        if len(keys) > MAX_HEADERS:
            raise ValueError(f"more than {MAX_HEADERS} different columns: index fewer tables together")
        self.headers = [r["key"] for r in keys]
        self.numeric = [r["key"] for r in keys if r["numeric"]]

    @classmethod
    def build(cls, rows: DataFrame, path: str) -> CellIndex:
        cls._append(rows, path)
        return cls(rows.sparkSession, path)

    def add(self, rows: DataFrame) -> CellIndex:
        """The index with further rows; those there are aren't read again. Rows are told by table_id and row_index, which must be new."""
        self._append(rows, self.path)
        return CellIndex(self.spark, self.path)

    @staticmethod
    def _append(rows: DataFrame, path: str) -> None:
        cells = row_relations.cells(rows).withColumn("label", text.label(F.col("value"))).select(*ROW, "key", "label")
        numbers = rows.select(*ROW, F.explode("row_numeric").alias("key", "number"))
        for name, part, order in (("labels", cells, ["key", "label"]), ("numbers", numbers, ["key", "number"])):
            # Rows of one value are told apart by their numbers, so that a value that a third of all cells have is dealt to several files.
            dealt = part.repartitionByRange(*order, *ROW).sortWithinPartitions(*order, *ROW)
            dealt.write.mode("append").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/{name}")
        keys = rows.select(F.explode("row_data").alias("key", "value"), "row_numeric").select("key", F.map_contains_key("row_numeric", F.col("key")).alias("numeric"))
        keys.groupBy("key").agg(F.max("numeric").alias("numeric")).write.mode("append").parquet(f"{path}/keys")

    def labels(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/labels")

    def numbers(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/numbers")

    def column_of_values(self, values: list[str]) -> str | None:
        """The column with the most cells among ``values``; ties: the first by name."""
        found = self.labels().where(F.col("label").isin([binder.label(v) for v in values])).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        best = found.orderBy(F.col("n").desc(), "key").first()
        return best["key"] if best else None

    def row_set(self, tree: nl.Bool | nl.Condition) -> DataFrame | None:
        """table_id, row_index of the rows that a condition tree holds for, each once; None if it can't be bound.

        A condition reads its cells; AND keeps the rows of the first set that are in the others, OR puts sets together. As for a filter, an
        AND needs all its parts, and an OR those that can be bound.
        """
        if isinstance(tree, nl.Bool):
            sets = [self.row_set(t) for t in tree.children]
            if tree.op == "AND":
                return None if any(s is None for s in sets) else reduce(lambda a, b: a.join(b, ROW, "left_semi"), sets)
            bound = [s for s in sets if s is not None]
            return reduce(DataFrame.union, bound).distinct() if bound else None
        values = list(tree.value) if tree.op == "IN" else [tree.value] if tree.op in ("EQ", "NEQ", "LIKE") else None
        column = (binder.by_name(tree.column, self.headers) if tree.column else None) or (self.column_of_values(values) if values else None)
        if column is None:
            return None
        if values is not None:
            cell, wanted = F.col("label"), [binder.label(v) for v in values]
            holds = {"EQ": cell == wanted[0], "NEQ": cell != wanted[0], "IN": cell.isin(wanted), "LIKE": F.contains(cell, F.lit(wanted[0]))}[tree.op]
            return self.labels().where((F.col("key") == column) & holds).select(*ROW)
        low, high = (float(v) for v in (tree.value if tree.op == "BETWEEN" else (tree.value, tree.value)))
        cell = F.col("number")
        holds = {"BETWEEN": (cell >= low) & (cell <= high), "GT": cell > low, "GTE": cell >= low, "LT": cell < low, "LTE": cell <= low}[tree.op]
        return self.numbers().where((F.col("key") == column) & holds).select(*ROW)

    def matching(self, rows: DataFrame, tree: nl.Bool | nl.Condition) -> DataFrame | None:
        """The rows themselves, as ``structured.matching`` gives them."""
        found = self.row_set(tree)
        return None if found is None else rows.join(found, ROW, "left_semi")

    def ranked(self, rows: DataFrame, column: str, descending: bool, limit: int, tree=None) -> DataFrame | None:
        """The first rows by a number, ties by table and row: only the cells of that column are ranked, and ``limit`` rows are read."""
        name = binder.by_name(column, self.headers)
        found = self.row_set(tree) if tree is not None else None
        if name is None or (tree is not None and found is None):
            return None
        cells = self.numbers().where(F.col("key") == name)
        cells = cells if found is None else cells.join(found, ROW, "left_semi")
        order = F.col("number").desc() if descending else F.col("number").asc()
        best = cells.select(*ROW, F.col("number").alias("rank_value")).orderBy(order, *ROW).limit(limit)
        return rows.join(F.broadcast(best), ROW).orderBy(F.col("rank_value").desc() if descending else F.col("rank_value").asc(), *ROW)

    def aggregated(self, op: str, column: str, tree=None) -> DataFrame | None:
        """value, n_rows of the numbers of a column over the rows of a tree: no row is read, only cells."""
        name = binder.by_name(column, self.headers)
        found = self.row_set(tree) if tree is not None else None
        if name is None or (tree is not None and found is None):
            return None
        cells = self.numbers().where(F.col("key") == name)
        cells = cells if found is None else cells.join(found, ROW, "left_semi")
        fold = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max, "COUNT": F.count}[op]
        return cells.agg(fold("number").cast("double").alias("value"), F.count(F.lit(1)).alias("n_rows"))
