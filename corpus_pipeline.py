"""The corpus pipeline: five stages over ``documents``, each written and reread by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridfolio.llm import decontamination, exact_dedup, ngram_join, packing, toxicity
from gridfolio.llm.text import crc_mod
from gridfolio.session import read_table, scratch_path, scratch_scope


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model doesn't reject (score below 0.5).

    It is fitted on the labelled rows of ``docs`` outside the held-out fold. Rows that repeat an id with the
    same text get the same score; a null id is scored like any other and never matches a rejected one.
    """
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), lambda i: crc_mod(i, 5) != 0)
    return toxicity.keep_clean(docs, model)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space aside: that with the most code points, then the smallest id.

    A document is told by id and text: those that share an id, or have none, with different texts all stay.
    """
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that with the smallest id, null last; told by id and text as well."""
    return ngram_join.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose text overlaps no benchmark item. The text decides; null and empty texts stay."""
    return decontamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; a null text is the end id alone, repeated rows are packed each."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def kept(docs: DataFrame, name: str) -> DataFrame:
    """Written outside the stage's scope."""
    path = scratch_path(docs.sparkSession, name)
    docs.write.parquet(path)
    return docs.sparkSession.read.schema(docs.schema).parquet(path)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact),
    ("n-gram Jaccard join", drop_near),
    ("benchmark decontamination", drop_benchmark),
    ("best-fit packing", pack),
]



def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        # What a stage wrote for itself goes once its result is written; the result itself is kept in the scope around it.
        with scratch_scope(spark):
            docs = kept(stage(spark, docs, sf_dir), f"stage-{i}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier, the similarity join and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None
