"""Approximate vector search from a stored index: cells of a k-means, vectors stored by cell, few cells read a question, exact distances."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridfolio.session import written

#: Vectors that the cells are fitted on, a cell, and rounds of the fit.
SAMPLE_PER_CELL, ROUNDS = 64, 10
#: Bytes of all centroids, which every task holds: so many cells are the most. They don't follow the number of vectors beyond it.
CENTROID_BYTES = 64 << 20
#: Vectors in one file of a cell: a cell of more is dealt to several.
ROWS_PER_FILE = 250_000
#: Questions whose vectors are sent to the tasks together.
GROUP = 4096
#: Distances that are worked out at once. They are rounded to 12 digits, so that equal vectors tie wherever they lie.
DISTANCES = 1_000_000
#: Recall that the number of probed cells is chosen for, and questions that it is measured on.
RECALL, MEASURED = 0.95, 200
#: Standard errors by which the measured recall must be above the wanted one.
SURE = 2.0


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _vectors(column: pa.Array) -> np.ndarray:
    """The vectors of a batch as rows of a matrix; all have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def searchable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector has a length and no null or infinite component: others have no distance to anything."""
    x = F.col(vector).cast("array<double>")
    fit = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    return df.where(F.coalesce(fit, F.lit(False)))


def cell_count(n: int, width: int) -> int:
    """About the square root of the number of vectors: reading a cell then costs as much as choosing it."""
    return max(1, min(math.isqrt(n), CENTROID_BYTES // (8 * max(1, width))))


def fitted(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Unit centroids of a spherical k-means. A cell that loses all vectors takes the one that is worst served."""
    v = _unit(sample)
    random = np.random.default_rng(seed)
    centres = v[random.choice(len(v), min(cells, len(v)), replace=False)]
    for _ in range(rounds):
        near = v @ centres.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, v)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        if len(empty):
            sums[empty] = v[np.argsort(near.max(axis=1), kind="stable")[: len(empty)]]
        centres = _unit(sums)
    return centres


def train(df: DataFrame, cells: int | None = None, id_col: str = "chunk_id", vector: str = "embedding", rounds: int = ROUNDS) -> np.ndarray:
    """Centroids fitted on SAMPLE_PER_CELL vectors a cell, those whose ids hash lowest: a bounded sample, the same on every run."""
    rows = searchable(df, vector).select(F.col(id_col).alias("i"), F.col(vector).cast("array<float>").alias("v"))
    about = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.min(F.size("v")).alias("least")).first()
    if not about["n"]:
        raise ValueError("no vector to build an index of")
    if about["width"] != about["least"]:
        raise ValueError(f"vectors of {about['least']} to {about['width']} components")
    cells = cells or cell_count(about["n"], about["width"])
    # The order of the hash alone would give a repeated id all places; the vector tells its rows apart.
    picked = rows.orderBy(F.xxhash64("i", "v")).limit(cells * SAMPLE_PER_CELL).select("v")
    sample = np.array([r["v"] for r in picked.toLocalIterator()], dtype=np.float64)
    return fitted(sample, cells, rounds)


def assigned(df: DataFrame, centres: np.ndarray, vector: str = "embedding") -> DataFrame:
    """``df`` with ``cell``, the centroid nearest to each vector; rows without a distance are left out."""
    rows = searchable(df, vector)
    sent = df.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            v = _vectors(batch.column(vector))
            step = max(1, DISTANCES // len(sent.value))
            cell = np.concatenate([(v[a : a + step] @ sent.value.T).argmax(axis=1) for a in range(0, len(v), step)] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=[*batch.schema.names, "cell"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())]))


def _stored(rows: DataFrame, path: str) -> None:
    """Append rows by cell. A cell of many rows is dealt to as many files as it needs, so that none is one task's work."""
    rows = written(rows, "cells")
    parts = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_FILE).cast("int").alias("__parts"))
    dealt = rows.join(F.broadcast(parts), "cell").withColumn("__part", F.floor(F.rand(1) * F.col("__parts")))
    dealt.repartition("cell", "__part").drop("__parts", "__part").write.mode("append").option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy("cell").parquet(f"{path}/vectors")


class VectorIndex:
    """A stored index: its centroids, and its rows by cell. ``probes`` cells are read for a question unless it says otherwise."""

    def __init__(self, spark: SparkSession, path: str):
        about = spark.read.parquet(f"{path}/about").first()
        self.spark, self.path = spark, path
        self.id_col, self.vector, self.probes = about["id_col"], about["vector"], about["probes"]
        self.centres = np.array([r["v"] for r in spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()])

    @classmethod
    def build(cls, df: DataFrame, path: str, id_col: str = "chunk_id", vector: str = "embedding", cells: int | None = None, k: int = 10, recall: float = RECALL) -> VectorIndex:
        """Fit the cells, store all rows of ``df`` by cell, and choose how many cells a question reads.

        Every row with a distance is stored, with all its columns. The number of probed cells is the smallest that finds
        ``recall`` of the ``k`` nearest of MEASURED rows, held against all cells.
        """
        spark = df.sparkSession
        centres = train(df, cells, id_col, vector)
        _stored(assigned(df, centres, vector), path)
        cells_table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, v array<double>")
        cells_table.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        cls._about(spark, path, id_col, vector, len(centres))
        own = cls(spark, path)
        own.probes = own.enough_probes(k, recall)
        cls._about(spark, path, id_col, vector, own.probes)
        return own

    @staticmethod
    def _about(spark: SparkSession, path: str, id_col: str, vector: str, probes: int) -> None:
        spark.createDataFrame([(id_col, vector, probes)], "id_col string, vector string, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")

    def add(self, df: DataFrame) -> None:
        """Store further rows in the cells there are; none is read again. Fit anew when the data has changed its shape."""
        _stored(assigned(df, self.centres, self.vector), self.path)

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """All stored rows, or those of some cells: folders of other cells aren't listed in the plan's scan."""
        rows = self.spark.read.parquet(f"{self.path}/vectors")
        return rows if cells is None else rows.where(F.col("cell").isin(cells))

    def nearest_cells(self, questions: np.ndarray, probes: int) -> np.ndarray:
        """The cells that each question reads, nearest first."""
        near = _unit(questions) @ self.centres.T
        return np.argsort(-near, axis=1, kind="stable")[:, :probes]

    def search(self, questions: DataFrame, k: int, probes: int | None = None, question_id: str = "question_id", vector: str = "embedding", where=None) -> DataFrame:
        """question_id, rank, id, distance: the ``k`` nearest rows of each question among the cells it reads, ties by id.

        Questions are taken in groups of GROUP: their vectors go to the tasks that read their cells, where each batch of rows
        keeps k a question. Distances are exact; with all cells probed so is the result. ``where`` is a condition on the stored
        columns, applied by the scan. Questions without a distance find nothing; rows
        that share an id are found each.
        """
        parts, group = [], []
        own = searchable(questions, vector).select(F.col(question_id).alias("question_id"), F.col(vector).cast("array<double>").alias("v"))
        for r in own.toLocalIterator():
            group.append(r)
            if len(group) == GROUP:
                parts.append(written(self._found(group, k, probes, where), "nearest"))
                group = []
        if group or not parts:
            parts.append(self._found(group, k, probes, where))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.withColumnRenamed("question_id", question_id)

    def nearest(self, question: list[float], k: int, probes: int | None = None, where=None) -> DataFrame:
        """The rows nearest to one vector with all their columns and ``distance``, as ``retrieval.nearest`` gives them."""
        asked = self.spark.createDataFrame([(0, [float(x) for x in question])], "question_id long, embedding array<double>")
        found = self.search(asked, k, probes, where=where).select(self.id_col, "distance")
        cells = self.nearest_cells(np.array([question], dtype=np.float64), probes or self.probes)[0].tolist()
        rows = self.rows(cells)
        rows = rows if where is None else rows.where(where)
        return rows.join(F.broadcast(found.dropDuplicates([self.id_col])), self.id_col).drop("cell").orderBy("distance", self.id_col)

    def _found(self, group: list, k: int, probes: int | None, where) -> DataFrame:
        spark, id_col, vector = self.spark, self.id_col, self.vector
        v = _unit(np.array([r["v"] for r in group], dtype=np.float64).reshape(len(group), -1)) if group else np.zeros((0, self.centres.shape[1]))
        read = self.nearest_cells(v, probes or self.probes) if group else np.zeros((0, 1), np.int64)
        # The questions of each cell, cell by cell.
        question, cell = np.repeat(np.arange(len(v)), read.shape[1]), read.ravel()
        order = np.argsort(cell, kind="stable")
        begin = np.searchsorted(cell[order], np.arange(len(self.centres) + 1))
        sent = spark.sparkContext.broadcast((v, question[order], begin))
        rows = self.rows(np.unique(cell).tolist())
        rows = (rows if where is None else rows.where(where)).select("cell", id_col, vector)
        id_type = rows.schema[id_col].dataType.simpleString()

        def run(batches):
            asked, of_cell, start = sent.value
            for batch in batches:
                cells, own = batch.column("cell").to_numpy(), _unit(_vectors(batch.column(vector)))
                # The order of ids in the batch stands for them: they may be texts.
                place = np.empty(len(own), dtype=np.int64)
                place[pa.compute.sort_indices(batch.column(id_col)).to_numpy()] = np.arange(len(own))
                for c in np.unique(cells).tolist():
                    here, questions = np.flatnonzero(cells == c), of_cell[start[c] : start[c + 1]]
                    step = max(1, DISTANCES // max(1, len(here)))
                    for a in range(0, len(questions), step):
                        q = questions[a : a + step]
                        distance = np.round(1 - asked[q] @ own[here].T, 12)
                        # All rows up to the kth distance of a question: ties at its end are told by id.
                        limit = np.partition(distance, min(k, len(here)) - 1, axis=1)[:, min(k, len(here)) - 1]
                        i, j = np.nonzero(distance <= limit[:, None])
                        best = np.lexsort((place[here[j]], distance[i, j], i))
                        i, j = i[best], j[best]
                        edge = np.searchsorted(i, np.arange(len(q)))
                        top = np.arange(len(i)) - edge[i] < k
                        i, j = i[top], j[top]
                        yield pa.RecordBatch.from_arrays([pa.array(q[i]), batch.column(id_col).take(pa.array(here[j])), pa.array(distance[i, j])], names=["place", id_col, "distance"])

        found = rows.mapInArrow(run, f"place long, `{id_col}` {id_type}, distance double")
        rank = F.row_number().over(Window.partitionBy("place").orderBy("distance", id_col))
        best = found.withColumn("rank", rank).where(F.col("rank") <= k)
        id_of = type(group[0]["question_id"]) if group else int
        names = spark.createDataFrame([(i, r["question_id"]) for i, r in enumerate(group)], f"place long, question_id {'string' if id_of is str else 'long'}")
        return best.join(F.broadcast(names), "place").select("question_id", "rank", id_col, "distance")

    def enough_probes(self, k: int, recall: float, measured: int = MEASURED) -> int:
        """The fewest cells by which ``recall`` of the k nearest of ``measured`` rows are found, with SURE standard errors to spare.

        One exact search tells all numbers: a neighbour is found by p probes if its cell is one of the p nearest to the question. A
        row doesn't count as its own neighbour.
        """
        picked = self.rows().orderBy(F.xxhash64(self.id_col)).limit(measured).select(F.col(self.id_col).alias("question_id"), self.vector)
        asked = written(picked.dropDuplicates(["question_id"]), "measured")
        exact = written(self.search(asked, k + 1, len(self.centres), vector=self.vector).where(F.col("question_id") != F.col(self.id_col)), "exact")
        cells = self.rows().select(self.id_col, "cell").join(F.broadcast(exact.select(self.id_col).distinct()), self.id_col, "left_semi").distinct()
        cell_of: dict = {}
        for r in cells.toLocalIterator():
            cell_of.setdefault(r[self.id_col], set()).add(r["cell"])
        told = asked.collect()
        near = self.nearest_cells(np.array([r[self.vector] for r in told], dtype=np.float64), len(self.centres))
        place = {r["question_id"]: {int(c): i for i, c in enumerate(n)} for r, n in zip(told, near, strict=True)}
        needed: dict = {}
        for r in exact.collect():
            needed.setdefault(r["question_id"], []).append(min(place[r["question_id"]][c] for c in cell_of[r[self.id_col]]) + 1)
        if not needed:
            return 1
        # The share of a question's neighbours that p probes find, for every p.
        found = np.array([[np.mean(np.array(n) <= p) for p in range(1, len(self.centres) + 1)] for n in needed.values()])
        sure = found.mean(axis=0) - SURE * found.std(axis=0) / math.sqrt(len(found))
        return int(np.argmax(sure >= recall)) + 1 if (sure >= recall).any() else len(self.centres)


def recall(found: DataFrame, exact: DataFrame, id_col: str, question_id: str = "question_id") -> float:
    """The share of the exact neighbours that are among those found."""
    both = exact.select(question_id, id_col).join(found.select(question_id, id_col).withColumn("hit", F.lit(1)), [question_id, id_col], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]
