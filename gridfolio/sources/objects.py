"""Objects in any file system that Spark reaches: put, get, delete by name or prefix, and the removal of whole stores."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    """The path and its file system, by the session's configuration."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark._jsc.hadoopConfiguration())


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """Write an object, or replace it: readers see the old one or the new one, never a part."""
    target, files = _at(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    out = files.create(part, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    files.delete(target, False)
    if not files.rename(part, target):
        raise OSError(f"can't write {path}")


def get(spark: SparkSession, path: str) -> bytes | None:
    """The content of an object, None without one."""
    target, files = _at(spark, path)
    if not files.exists(target):
        return None
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])


def delete(spark: SparkSession, paths: list[str]) -> int:
    """Delete objects by name; how many there were."""
    return sum(bool(files.delete(target, False)) for target, files in (_at(spark, p) for p in paths) if files.exists(target))


def wipe(spark: SparkSession, *paths: str) -> list[str]:
    """Delete whole stores, those that exist: the ones that went."""
    found = [(p, *_at(spark, p)) for p in paths]
    return [p for p, target, files in found if files.exists(target) and files.delete(target, True)]
