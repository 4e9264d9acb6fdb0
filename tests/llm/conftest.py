import pytest

#: Every case that operators over texts must take: nulls, blanks, very long texts, ties, repeats, clashing columns.
LONG = ("lorem ipsum dolor sit amet " * 40_000).strip()
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta", "en", "a", 1),
    (2, "Alpha  beta\tgamma delta epsilon\nzeta eta theta", "en", "a", 1),
    (3, None, "en", None, None),
    (4, "", None, "b", 0),
    (5, " \t\n", "fr", "b", 3),
    (6, LONG, "en", "b", len(LONG)),
    (7, LONG, "en", "b", len(LONG)),
    (8, "unique text number eight stands alone here", "en", "b", 10),
    (8, "unique text number eight stands alone here", "en", "b", 10),
    (None, "a row without an id that has a text", "de", "c", 4),
    (9, "x", "de", "c", 1),
    (10, "Ünïcödé 漢字 русский \U0001f600 text", "de", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as extra columns of the input.
CLASHING = ["content", "rank", "salt", "text_sha256", "digest", "second", "rep", "family", "band", "hit", "score", "hits", "kept", "length", "leaf", "form", "pos", "line", "doc", "n", "class_id", "piece", "host", "size", "first", "__own", "__id", "__key", "__best", "__name", "__hit", "__own_", "page", "keys", "wrapper"]


@pytest.fixture(scope="session")
def nasty(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
