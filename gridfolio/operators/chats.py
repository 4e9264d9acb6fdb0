"""Conversations as an append-only log of events; their state is derived by aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "chat_id string, at timestamp, seq long, kind string, role string, body string"
#: Letters of a title that is taken from the first question.
TITLE_LENGTH = 60


def event(spark: SparkSession, kind: str, chat_id: str, at, seq: int, role: str | None = None, body: str | None = None) -> DataFrame:
    """One event: ``created``, ``message`` (role, body), ``renamed`` (body), ``pinned``, ``unpinned`` or ``deleted``."""
    return spark.createDataFrame([(chat_id, at, seq, kind, role, body)], EVENTS)


def state(log: DataFrame) -> DataFrame:
    """chat_id, title, pinned, n_messages, created_at, updated_at of the chats that weren't deleted; order doesn't matter.

    The title is the last name given, else the beginning of the first question.
    """
    when = F.struct("at", "seq")
    is_ = lambda *kinds: F.col("kind").isin(*kinds)
    last = lambda value, holds: F.max_by(F.when(holds, value), F.when(holds, when))
    asked = is_("message") & (F.col("role") == "user")
    first = F.min_by(F.when(asked, F.left(F.trim("body"), F.lit(TITLE_LENGTH))), F.when(asked, when))
    out = log.groupBy("chat_id").agg(
        F.coalesce(last(F.col("body"), is_("renamed")), first, F.lit("New chat")).alias("title"),
        F.coalesce(last(F.col("kind"), is_("pinned", "unpinned")) == "pinned", F.lit(False)).alias("pinned"),
        F.count_if(is_("message")).alias("n_messages"),
        F.min("at").alias("created_at"),
        F.max("at").alias("updated_at"),
        F.bool_or(is_("deleted")).alias("gone"),
    )
    return out.where("not gone").drop("gone")


def listed(log: DataFrame, limit: int = 50) -> DataFrame:
    """Chats, pinned ones first, then the latest."""
    return state(log).orderBy(F.col("pinned").desc(), F.col("updated_at").desc(), "chat_id").limit(limit)


def messages(log: DataFrame, chat_id: str) -> DataFrame:
    """The messages of a chat in order; none of a deleted one."""
    own = log.where(F.col("chat_id") == chat_id)
    gone = own.where("kind = 'deleted'").select("chat_id").distinct()
    return own.where("kind = 'message'").join(gone, "chat_id", "left_anti").select("role", "body", "at", "seq").orderBy("at", "seq")


def purged(log: DataFrame) -> DataFrame:
    """The log without the events of deleted chats."""
    return log.join(log.where("kind = 'deleted'").select("chat_id"), "chat_id", "left_anti")
