"""Sinks and sources of stored tables: append, keyed upsert, partition replacement, staging, versions."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfolio.operators import catalog
from gridfolio.sources import tables


def with_id(df: DataFrame, *keys: str, name: str = "id") -> DataFrame:
    """A deterministic id of the natural key: the same on every attempt, unlike a random one."""
    return df.withColumn(name, F.sha2(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), 256))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_documents(df: DataFrame, path: str, key: str = "document_id") -> None:
    """Delete-then-insert of the documents that ``df`` holds: only their partitions are rewritten."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def version_path(path: str, version: int) -> str:
    return f"{path}/v={version:08d}"


def latest_version(spark: SparkSession, path: str) -> int:
    """The newest complete version, 0 without any: a version counts once Spark has marked it as written."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return 0
    found = [s.getPath() for s in files.listStatus(root) if s.getPath().getName().startswith("v=")]
    done = [int(p.getName()[2:]) for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max(done, default=0)


def read_latest(spark: SparkSession, path: str) -> DataFrame | None:
    n = latest_version(spark, path)
    return spark.read.parquet(version_path(path, n)) if n else None


def write_version(df: DataFrame, path: str, after: int | None = None) -> int:
    """A new version beside the old ones: readers see the old one until the new one is complete.

    A writer claims its number first, so that two never write one version. With ``after`` the version is that which follows it, and a
    Conflict if another writer has claimed it; without, the next number that is free.
    """
    spark = df.sparkSession
    files = tables.Files(spark, path)
    n = latest_version(spark, path) if after is None else after
    while True:
        n += 1
        try:
            files.create(f"{path}/_claims/{n:08d}", "")
            break
        except tables.Conflict:
            if after is not None:
                raise
    try:
        df.write.mode("overwrite").parquet(version_path(path, n))
    except BaseException:
        # A number that failed is free again.
        files.delete(version_path(path, n))
        files.delete(f"{path}/_claims/{n:08d}")
        raise
    return n


def upsert(df: DataFrame, path: str, key: list[str], seconds: float = 600.0) -> int:
    """Insert or replace by key, as a new version. Where another writer is at work the rows are merged over its version once that is complete.

    A writer that dies without a trace leaves its claim (``_claims``), which must be deleted before others can go on.
    """
    spark, ends = df.sparkSession, time.monotonic() + seconds
    while True:
        n = latest_version(spark, path)
        old = spark.read.parquet(version_path(path, n)) if n else None
        try:
            return write_version(df if old is None else catalog.upserted(old, df, key), path, n)
        except tables.Conflict:
            if time.monotonic() > ends:
                raise
            time.sleep(0.2)
