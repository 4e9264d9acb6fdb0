"""The registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from gridfolio.llm import decontamination, exact_dedup, fim, hard_negatives, html_extract, language, line_dedup, ngram_join, packing, piece_bpe, token_counts, toxicity, warc
from gridfolio.session import read_table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays of its text; null text: empty, null id: last choice, repeats: all in group_size."""
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its predicted language; ``und`` without a letter, held_out false without an id."""
    return language.identify(read_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity score; the base score without a hit (null and empty texts), held_out false without an id."""
    return toxicity.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place; null text: the end id alone, repeated rows: packed each."""
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its main text; null html: empty, null url: the host without a name, repeated rows: repeated results."""
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its lines of recurring templates; null text: one empty line, null id: all lines stay."""
    return line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size in tokens; null text: empty. The cache is new for each run, so that it encodes every distinct text once."""
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), token_counts.default_cache(spark))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every overlap of a document with a benchmark item; null texts have none, null ids are given as null, repeats each."""
    return decontamination.overlaps(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate class and number of links; null and empty texts are one class of copies."""
    return ngram_join.near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from its archive; null html: an empty payload, a null id is never referred to."""
    return warc.archive_round_trip(read_table(spark, sf_dir, "pages"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and put in another order; null text: empty and plain, null id: drawn as an id without digits, repeats each."""
    return fim.digests(fim.fill_in_middle(read_table(spark, sf_dir, "documents")))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as ids and back; null text: the end id alone, null ids and repeated rows each."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    return piece_bpe.digests(piece_bpe.encode(read_table(spark, sf_dir, "documents"), path), path)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three hardest negatives of every anchor and positive; null labels and vectors take no part, repeated ids are rows of their own."""
    return hard_negatives.mine(read_table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_language_id, op3_toxicity, op4_best_fit_packing, op5_html_extraction,
        op6_line_dedup, op7_token_counts, op8_decontamination, op9_ngram_jaccard_join, op10_warc,
        op11_fill_in_middle, op12_sentencepiece, op13_hard_negatives,
    )
}

ORACLE_SQL = {
    "op1_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents
        )
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id ASC NULLS LAST) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id ASC NULLS LAST) AS kept,
               sha256(norm) AS text_sha256
        FROM d
    """,
    "op6_line_dedup": line_dedup.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
    "op10_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest, coalesce(html, '') AS html FROM pages
        ), f AS (
            SELECT *, max(page_id) OVER (PARTITION BY html) AS first FROM p
        )
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> first THEN first END AS refers_to
        FROM f
    """,
}
