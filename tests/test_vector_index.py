"""The stored vector index against an exact search over all rows."""

import numpy as np
import pytest
from gridfolio.operators import retrieval, vector_index
from gridfolio.operators.vector_index import VectorIndex
from gridfolio.session import scratch_path
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    return df.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("store"), "embedding")


@pytest.fixture(scope="module")
def index(spark, vectors):
    return VectorIndex.build(vectors, scratch_path(spark, "index"))


def asked(df, n=20):
    return df.where(F.col("chunk_id") % n == 0).select(F.col("chunk_id").alias("question_id"), "embedding")


def brute(rows, questions, k):
    """question, rank, id by comparing all."""
    out = []
    for q, v in questions:
        v = np.asarray(v, float)
        told = []
        for i, w in rows:
            w = np.asarray(w, float)
            told.append((round(1 - float(v @ w) / float(np.linalg.norm(v) * np.linalg.norm(w)), 9), i))
        out += [(q, r, i) for r, (_, i) in enumerate(sorted(told)[:k], 1)]
    return sorted(out)


def test_all_cells_give_the_exact_neighbours(index, vectors):
    rows = [(r["chunk_id"], r["embedding"]) for r in vectors.collect()]
    got = index.search(asked(vectors, 50), 7, len(index.centres))
    assert sorted((r["question_id"], r["rank"], r["chunk_id"]) for r in got.collect()) == brute(rows, [(i, v) for i, v in rows if i % 50 == 0], 7)


def test_recall_of_the_chosen_cells(index, vectors):
    exact = index.search(asked(vectors), 10, len(index.centres))
    assert index.probes < len(index.centres)
    assert vector_index.recall(index.search(asked(vectors), 10), exact, "chunk_id") >= 0.95


def test_few_files_are_read_for_clusters(spark):
    """Vectors in clusters are found by a few cells, and the files of the others aren't read."""
    r = np.random.default_rng(1)
    centres = r.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + 0.1 * r.normal(size=16)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    index = VectorIndex.build(df, scratch_path(spark, "index"), cells=60)
    questions = np.array([v for i, v in rows if i % 20 == 0])
    assert index.probes <= 12
    files = lambda rows: rows.select(F.input_file_name()).distinct().count()
    read = [files(index.rows(index.nearest_cells(q[None], index.probes)[0].tolist())) for q in questions[:5]]
    assert max(read) <= 0.25 * files(index.rows())
    exact = index.search(asked(df), 10, len(index.centres))
    assert vector_index.recall(index.search(asked(df), 10), exact, "chunk_id") >= 0.95


def test_other_cells_are_pruned_by_the_scan(index):
    plan = index.rows([1, 2])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_groups_of_questions_don_t_change_the_result(spark, index, vectors, monkeypatch):
    whole = sorted(map(tuple, index.search(asked(vectors), 5).collect()))
    monkeypatch.setattr(vector_index, "GROUP", 7)
    monkeypatch.setattr(vector_index, "DISTANCES", 50)
    assert sorted(map(tuple, index.search(asked(vectors), 5).collect())) == whole


def test_one_question_is_answered_as_by_a_scan(index, vectors):
    q = vectors.where("chunk_id = 40").first()["embedding"]
    shown = lambda df: [(r["chunk_id"], r["store"], round(r["distance"], 9)) for r in df.collect()]
    assert shown(index.nearest(q, 12, len(index.centres))) == shown(retrieval.nearest(vectors, q, 12))
    assert shown(index.nearest(q, 12, len(index.centres), F.col("store") >= 5)) == shown(retrieval.nearest(vectors.where("store >= 5"), q, 12))


def nasty(spark):
    v = [1.0, 0.0, 0.5]
    rows = [("a", v), ("b", v), ("b", v), ("c", [0.0, 0.0, 0.0]), ("d", None), ("e", [1.0, None, 0.0]), ("f", [float("nan"), 1.0, 0.0]), ("g", [-1.0, 0.0, 0.1]), ("h", [0.1, 1.0, 0.0]), ("i", [float("inf"), 0.0, 0.0])]
    clash = {c: F.lit("clash") for c in ("place", "distance", "rank", "__part")}
    return spark.createDataFrame(rows, "chunk_id string, embedding array<double>").withColumns(clash).drop("distance")


def test_rows_without_a_distance_are_left_out(spark):
    df = nasty(spark)
    index = VectorIndex.build(df.drop("__part"), scratch_path(spark, "index"), cells=2)
    assert sorted(r["chunk_id"] for r in index.rows().collect()) == ["a", "b", "b", "g", "h"]
    got = index.search(df.select(F.col("chunk_id").alias("question_id"), "embedding"), 3, 2)
    assert [(r["rank"], r["chunk_id"]) for r in got.where("question_id = 'a'").orderBy("rank").collect()] == [(1, "a"), (2, "b"), (3, "b")]
    assert {r["question_id"] for r in got.collect()} == {"a", "b", "g", "h"}
    assert index.search(df.limit(0).select(F.col("chunk_id").alias("question_id"), "embedding"), 3).count() == 0


def test_an_empty_table_has_no_index(spark):
    with pytest.raises(ValueError):
        VectorIndex.build(nasty(spark).where("chunk_id in ('c', 'd')"), scratch_path(spark, "index"))


def test_added_rows_are_found(spark, vectors):
    index = VectorIndex.build(vectors.where("chunk_id < 400"), scratch_path(spark, "index"), cells=10)
    index.add(vectors.where("chunk_id >= 400"))
    again = VectorIndex(spark, index.path)
    assert again.rows().count() == vectors.count()
    rows = [(r["chunk_id"], r["embedding"]) for r in vectors.collect()]
    got = again.search(asked(vectors, 100), 5, 10)
    assert sorted((r["question_id"], r["rank"], r["chunk_id"]) for r in got.collect()) == brute(rows, [(i, v) for i, v in rows if i % 100 == 0], 5)


def test_a_cell_of_many_rows_has_several_files(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "ROWS_PER_FILE", 100)
    df = spark.range(1000).select(F.col("id").alias("chunk_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    index = VectorIndex.build(df, scratch_path(spark, "index"), cells=3)
    assert index.rows().select(F.input_file_name()).distinct().count() >= 5 and index.rows().count() == 1000
    got = index.search(df.limit(1).select(F.col("chunk_id").alias("question_id"), "embedding"), 4, 3)
    assert [r["chunk_id"] for r in got.orderBy("rank").collect()] == [0, 1, 2, 3]
