"""Texts in bounded slices, and rows that share their keys."""

import pyarrow as pa
from gridfolio.operators import chunking, keyword, per_text


def test_slices_are_bounded_and_lose_nothing():
    texts = ["x" * 300, None, "", "é" * 2000, "y" * 10] * 20
    batch = pa.RecordBatch.from_pydict({"i": list(range(100)), "t": texts, "s": [[t, None, t] if t else None for t in texts]})
    for column, most in (("t", 1000), ("s", 1000)):
        parts = list(per_text.slices([batch, batch.slice(7, 50)], column, most))
        assert [i for p in parts for i in p.column("i").to_pylist()] == [*range(100), *range(7, 57)]
        size = lambda p, c=column: sum(len("".join(x or "" for x in ([t] if isinstance(t, str) else t or [])).encode()) for t in p.column(c).to_pylist())
        assert all(size(p) <= most or p.num_rows == 1 for p in parts)


def test_postings_come_in_small_batches():
    """What a batch of texts becomes isn't held at once: no batch that leaves the worker is larger than its slice allows."""
    n = 2000
    batch = pa.RecordBatch.from_pydict({"store": ["s"] * n, "id": list(range(n)), "text": [f"words word{i} licenses license " * 50 for i in range(n)]})
    parts = list(keyword.placed([batch], keyword.stem))
    assert sum(p.num_rows for p in parts) == 3 * n and len(parts) > 2 and max(p.nbytes for p in parts) < 3 * per_text.SLICE_BYTES
    first = {r["term"]: r for r in parts[0].to_pylist()[:3]}
    assert first["license"]["positions"][:3] == [2, 3, 6] and first["word0"]["ordinals"][:2] == [1, 5]


def test_no_text_is_shuffled(spark):
    """Where no id is repeated, keywords and postings move no rows but the counted keys."""
    df = spark.createDataFrame([(i, "s", f"word{i} and word") for i in range(50)], "chunk_id long, store string, text string")
    for out in (chunking.keywords(df, "chunk_id", "text"), keyword.inverted_index(df)):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_repeated_and_null_ids_count_together(spark):
    rows = [(1, "s", "beta alfa beta"), (1, "s", "alfa alfa, gamma"), (2, "s", "Beta the beta"), (None, "s", "one two"), (None, "s", "two"), (1, "t", "alfa"), (3, None, None), (3, None, "alfa of alfa")]
    df = spark.createDataFrame(rows, "chunk_id long, store string, text string")
    index = {(r["store"], r["term"], r["chunk_id"]): r["positions"] for r in keyword.inverted_index(df).collect()}
    assert index[("s", "alfa", 1)] == [0, 1, 1] and index[("s", "beta", 1)] == [0, 2] and index[("s", "beta", 2)] == [0, 2]
    assert index[("s", "two", None)] == [0, 1] and index[("t", "alfa", 1)] == [0] and index[(None, "alfa", 3)] == [0, 2]
    found = chunking.keywords(df, "chunk_id", "text", 2).orderBy("id", "rank").collect()
    assert [tuple(r) for r in found if r["id"] == 1] == [(1, "alfa", 4, 1), (1, "beta", 2, 2)]
    assert [r["term"] for r in found if r["id"] is None][0] == "two"
    assert [tuple(r) for r in found if r["id"] == 2] == [(2, "beta", 2, 1), (2, "beta the", 1, 2)]
