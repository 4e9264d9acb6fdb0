"""Exact duplicates by skew-safe combining, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfolio.llm.text import hot_join, without_rows
from gridfolio.session import written

#: Copies of one text are spread over so many salts before they are combined.
SALTS = 64


def _big(number: int) -> Column:
    return F.lit(str(number)).cast("decimal(38,0)")


_TOP, _SHIFT = 2**63 - 1, 10**20


def normalised(text: Column) -> Column:
    """The text (null: empty) without the characters [\\x20\\x09-\\x0D]."""
    out = F.coalesce(text, F.lit(""))
    for code in (32, 9, 10, 11, 12, 13):
        out = F.replace(out, F.lit(chr(code)), F.lit(""))
    return out


def _rank(text: Column, doc_id: Column) -> Column:
    """One number that orders rows: more code points first, then the smaller id; null ids come last.

    A decimal fits the fixed-width buffers of hash aggregation, which a struct does not.
    """
    size = F.length(F.coalesce(text, F.lit(""))).cast("decimal(38,0)")
    back = F.coalesce(_big(_TOP) - doc_id.cast("decimal(38,0)"), _big(-1))
    return (size * _big(_SHIFT) + back + _big(1)).cast("decimal(38,0)")


def _id_of(rank: Column) -> Column:
    back = rank % _big(_SHIFT) - _big(1)
    return F.when(back >= 0, _big(_TOP) - back).cast("long")


def text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct normalised text: text_sha256, content, keep_id, group_size.

    Three stages, each of which compares the content itself besides its digest:

    1. each map task combines its own rows of a text (Spark's partial aggregation);
    2. rows meet by (digest, salt, content), so that a text with very many copies is spread over ``salts`` keys;
    3. the winners of the salts, at most ``salts`` rows a text, are combined by (digest, content).
    """
    text, doc_id = F.col(text_col), F.col(id_col).cast("long")
    rows = docs.select(
        normalised(text).alias("content"),
        _rank(text, doc_id).alias("rank"),
        F.pmod(F.xxhash64(doc_id), F.lit(salts)).cast("int").alias("salt"),
    ).withColumn("text_sha256", F.sha2("content", 256))
    salted = rows.groupBy("text_sha256", "salt", "content").agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
    final = salted.groupBy("text_sha256", "content").agg(F.max("rank").alias("rank"), F.sum("n").alias("group_size"))
    return final.select("text_sha256", "content", _id_of(F.col("rank")).alias("keep_id"), "group_size")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """Label every row with the row that stays: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deletion of [\\x20\\x09-\\x0D]; null counts as empty, so null and blank
    texts are one group. Of equal texts the one with the most code points stays, then the smallest id; a null
    id stays only in a group of null ids (keep_id is then null, kept true). Rows that repeat id and text can't
    be told apart: all of them carry the same kept flag and all count in group_size. Other columns are not
    read; an empty table gives an empty result.

    Groups are told apart by content. Labels go back to the rows by digest alone only after it was checked that no
    digest stands for two contents; if one does, the rows of such digests are matched by content.
    """
    grouped = text_groups(docs, id_col, text_col, salts)
    groups = written(grouped.select("text_sha256", "keep_id", "group_size"), "exact-groups")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    shared = groups.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("text_sha256")
    content = normalised(F.col(text_col))
    rows = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(content, 256).alias("text_sha256")), "exact-rows")
    if shared.isEmpty():
        return _labelled(hot_join(rows, groups.withColumn("n", F.col("group_size")), "text_sha256", "n", total))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(content, 256).alias("text_sha256"), content.alias("content"))
    alone = groups.join(shared, "text_sha256", "left_anti").withColumn("n", F.col("group_size"))
    by_digest = hot_join(rows, alone, "text_sha256", "n", total)
    by_content = own.join(shared, "text_sha256", "left_semi").join(grouped, ["text_sha256", "content"])
    return _labelled(by_digest).unionByName(_labelled(by_content))


def _labelled(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one per distinct text, with all their columns.

    A row is told by its id and text together: repeated or null ids with different texts are different rows.
    Of rows that repeat the id of the row that stays and its text, one stays.
    """
    labels = written(exact_duplicates(docs, id_col, text_col), "exact-labels")
    name = [F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__key")]
    drop = written(labels.where("not kept").select(*name).distinct(), "exact-drop")
    repeated = written(labels.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").select(*name), "exact-repeated")
    return without_rows(docs, drop, repeated, id_col, text_col, F.sha2(normalised(F.col(text_col)), 256))
