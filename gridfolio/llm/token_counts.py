"""Token counts from a digest cache: only texts that no stored count answers are encoded, and each once."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfolio.llm.text import BROADCAST_ROWS, by_size, held, hot_join
from gridfolio.session import scratch_path, written

LIMIT = 1024
CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """SHA-256 of the tokenizer's file with the library's name and version: a new version never meets old counts."""
    import sentencepiece
    import tokenizers

    library = f"tokenizers {tokenizers.__version__}" if path.endswith(".json") else f"sentencepiece {sentencepiece.__version__}"
    with open(path, "rb") as f:
        return hashlib.sha256(library.encode() + b"\0" + f.read()).hexdigest()


def content_digest(text: Column) -> Column:
    """SHA-256 of the text as it is encoded. Null is normalised to the empty text; nothing else may change, since white space and case are tokens."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _load(path: str):
    """The function that counts the tokens of a list of texts."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        return lambda texts: [len(e) for e in own.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]


def encode_counts(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    """content_digest, n_tokens of rows (content_digest, text), whole texts in batches of bounded size."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = held(("counter", tokenizer_path), lambda: _load(tokenizer_path))
        for pdf in by_size(batches, "text", 1_000_000):
            yield pd.DataFrame({"content_digest": pdf["content_digest"], "n_tokens": count(pdf["text"].tolist())})

    return rows.mapInPandas(run, "content_digest binary, n_tokens long")


def read_cache(spark: SparkSession, cache_path: str) -> DataFrame:
    """The stored counts; an empty table where nothing has been stored yet."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    files = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(jvm_path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per row: doc_id, n_bytes, n_tokens, over_limit, content_digest.

    The digests of the texts are joined to the counts stored under ``cache_path`` for this tokenizer version.
    One text of each digest that is not there is encoded and its count appended to the cache, so a second run,
    or one over a table that shares texts, encodes nothing again. An appended count is the same whoever encodes
    it: if two jobs append one digest, the join reads it once. Only digests are compared with the cache; where it answers all of
    them, no text is read again.

    A null text counts as empty: 0 bytes, and the tokens of the empty text. Repeated rows are counted each;
    an empty table gives no rows; other columns are not read. Whole texts are encoded, without truncation.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("content_digest", content_digest(F.col("text")))
    sized = written(rows.select("doc_id", "content_digest", F.octet_length("text").cast("long").alias("n_bytes")), "sizes")
    uses = written(sized.groupBy("content_digest").agg(F.count(F.lit(1)).alias("n")), "uses")
    stored = read_cache(spark, cache_path).where(F.col("tokenizer_digest") == version).select("content_digest").distinct()
    misses = written(uses.select("content_digest").join(stored, "content_digest", "left_anti"), "misses")
    n = misses.count()
    if n:
        texts = rows.select("content_digest", "text")
        few = n <= BROADCAST_ROWS and 4 * n <= uses.count()
        texts = texts.join(F.broadcast(misses), "content_digest", "left_semi") if few else texts
        # Copies are combined where they are read, before any join, so a text with very many copies sends one row a task.
        distinct = texts.groupBy("content_digest").agg(F.first("text").alias("text"))
        # An inner join with a table of different digests: a semi-join would be moved below the aggregation, and copies with it.
        distinct = distinct if few or n == uses.count() else distinct.join(misses, "content_digest")
        new = encode_counts(distinct, tokenizer_path).select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens")
        new.write.mode("append").parquet(cache_path)
    counts = read_cache(spark, cache_path).where(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.min("n_tokens").alias("n_tokens"))
    # A text may have very many copies, so its count is joined as a hot key.
    answers = written(uses.join(counts, "content_digest"), "answers")
    return hot_join(sized, answers, "content_digest", "n", sized.count()).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.lower(F.hex("content_digest")).alias("content_digest")
    )


def default_cache(spark: SparkSession) -> str:
    return scratch_path(spark, "token-cache")
