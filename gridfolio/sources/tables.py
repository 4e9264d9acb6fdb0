"""Keyed tables with a log of commits: writers that meet try again, readers see whole versions, and only touched buckets are rewritten."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridfolio.operators import catalog

BUCKETS = 64
#: Parts of a bucket that may be written by tasks of their own.
PARTS = 16
#: Times that a commit is tried again after another writer came first.
RETRIES = 20


class Conflict(Exception):
    """Another writer has committed the version that this one wanted."""


class Files:
    """The few file operations of a log, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        root = self.jvm.org.apache.hadoop.fs.Path(path)
        self.system = root.getFileSystem(spark._jsc.hadoopConfiguration())
        self.local = self.system.getScheme() == "file"

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.system.listStatus(at)) if self.system.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.system.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Create a file with its whole content, or raise Conflict if there is one: of any number of writers one succeeds.

        The content is written beside it first. A local file is linked to its name, which fails if the name is taken; elsewhere it
        is renamed, which a distributed file system refuses as well.
        """
        target, own = self.path(name), self.path(f"{name}.{uuid.uuid4().hex}")
        stream = self.system.create(own, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            if self.local:
                file = lambda p: self.jvm.java.io.File(p.toUri().getPath()).toPath()
                self.jvm.java.nio.file.Files.createLink(file(target), file(own))
            elif not self.system.rename(own, target):
                raise Conflict(name)
        except Conflict:
            raise
        except Exception as e:
            if self.system.exists(target):
                raise Conflict(name) from e
            raise
        finally:
            if self.system.exists(own):
                self.system.delete(own, False)

    def delete(self, name: str) -> None:
        self.system.delete(self.path(name), True)


class KeyedTable:
    """A table of rows by ``key``, dealt to buckets by a hash of ``bucket_by`` (columns of the key; all of it by default).

    Each commit names the files of every bucket, so a version is one small file to read. A writer rewrites the buckets that its rows touch,
    beside the old ones, and commits by creating the next version's file. If another writer has created it first, what both touched
    is merged again over the other's rows; what the other left alone is kept as written.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)
        about = json.loads(self.files.read(f"{self.path}/about.json"))
        self.key, self.bucket_by, self.buckets = about["key"], about["bucket_by"], about["buckets"]
        self.schema = T.StructType.fromJson(about["schema"])
        #: Called between the merge and the commit of a write.
        self.before_commit: Callable[[], None] = lambda: None

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, key: list[str], bucket_by: list[str] | None = None, buckets: int = BUCKETS) -> KeyedTable:
        """A new empty table; one that is there already is a Conflict."""
        bucket_by = bucket_by or key
        if not set(bucket_by) <= set(key):
            raise ValueError("buckets are told by columns of the key")
        about = {"key": key, "bucket_by": bucket_by, "buckets": buckets, "schema": json.loads(schema.json())}
        Files(spark, path).create(f"{path.rstrip('/')}/about.json", json.dumps(about))
        return cls(spark, path)

    def _log(self, version: int) -> str:
        return f"{self.path}/log/{version:012d}.json"

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names(f"{self.path}/log") if n.endswith(".json") and n[:-5].isdigit()]

    def version(self) -> int:
        return max(self.versions(), default=0)

    def _state(self, version: int) -> dict[str, list[str]]:
        return json.loads(self.files.read(self._log(version)))["files"] if version else {}

    def note(self) -> str | None:
        """What the writer of the latest version has left with it."""
        version = self.version()
        return json.loads(self.files.read(self._log(version)))["note"] if version else None

    def difference(self, old: int, new: int) -> tuple[DataFrame, DataFrame]:
        """The rows that came and those that went between two versions."""
        rows = self.signed(old, new)
        return rows.where("sign > 0").drop("sign"), rows.where("sign < 0").drop("sign")

    def signed(self, old: int, new: int) -> DataFrame:
        """The rows that came (sign 1) and those that went (-1) between two versions, in one pass. Buckets with the same files in both aren't read."""
        a, b = self._state(old), self._state(new)
        changed = [k for k in {*a, *b} if a.get(k) != b.get(k)]
        before, after = ([f for k in changed for f in s.get(k, [])] for s in (a, b))
        # A version has each key once, so each row counts for one at most.
        if not before or not after:
            return self._rows(before + after).withColumn("sign", F.lit(1 if after else -1))
        both = self._rows(after).withColumn("sign", F.lit(1)).unionByName(self._rows(before).withColumn("sign", F.lit(-1)))
        return both.groupBy(*self.schema.names).agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default of the latest."""
        state = self._state(self.version() if version is None else version)
        return self._rows([f for own in state.values() for f in own])

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in sorted(folders)])

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")

    def upsert(self, rows: DataFrame) -> int:
        """Insert or replace rows by key; of rows with one key that which sorts last stays. The new version."""
        return self._write(rows, lambda old, new: catalog.upserted(old, new, self.key))

    def delete(self, keys: DataFrame) -> int:
        """Without the rows whose key ``keys`` has. The new version."""
        return self._write(keys.select(*self.key), lambda old, gone: old.join(gone, self.key, "left_anti"))

    def replace(self, rows: DataFrame, parents: DataFrame | None = None) -> int:
        """Delete-then-insert: all rows of the parents (``bucket_by``) that ``rows`` or ``parents`` name go, and ``rows`` come. The new version."""
        named = rows.select(*self.bucket_by)
        named = (named if parents is None else named.union(parents.select(*self.bucket_by))).distinct()
        own = rows.select(*self.schema.names).withColumn("__new", F.lit(True))
        marks = named.withColumn("__new", F.lit(False))
        given = own.unionByName(marks, allowMissingColumns=True)

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            kept = old.join(new.select(*self.bucket_by).distinct(), self.bucket_by, "left_anti")
            return catalog.upserted(kept, new.where("__new").drop("__new"), self.key)

        return self._write(given, merge)

    def apply(self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], note: str | None = None) -> int:
        """Rows with other columns than the table's, by the same key, merged by ``merge(old rows, changes)`` in the buckets that they touch. The new version.

        ``merge`` gives all rows of these buckets. A note is left with the version, and is what makes it a step of its own: changes that
        were meant to follow another note must not be applied again.
        """
        return self._write(changes, merge, note)

    def _write(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], note: str | None = None) -> int:
        """Merge ``rows`` into the buckets that they touch and commit them. A key of null is a key like no other: such rows are refused."""
        # Read once: a retry must merge the same rows, and buckets are looked at one by one.
        folder = f"staged/{uuid.uuid4().hex}"
        rows.withColumn("__bucket", self._bucket()).write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        staged = self.spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("__bucket", T.IntegerType())])).parquet(f"{self.path}/{folder}")
        written: dict[str, list[str]] = {}
        seen: dict[str, list[str]] = {}
        try:
            if staged.where(" or ".join(f"`{c}` is null" for c in self.key if c in rows.columns and (c in self.bucket_by or "__new" not in rows.columns)) or "false").limit(1).count():
                raise ValueError(f"a null in the key {self.key}")
            touched = sorted(r[0] for r in staged.select("__bucket").distinct().collect())
            for _ in range(RETRIES + 1):
                version = self.version()
                state = self._state(version)
                # Buckets that another writer has changed since they were merged are merged again.
                stale = [b for b in touched if str(b) not in written or seen.get(str(b)) != state.get(str(b))]
                if stale:
                    written |= self._merged(staged, stale, state, merge)
                    seen = {str(b): state.get(str(b)) for b in touched}
                self.before_commit()
                try:
                    self.files.create(self._log(version + 1), json.dumps({"files": {b: f for b, f in {**state, **written}.items() if f}, "note": note}, sort_keys=True))
                    return version + 1
                except Conflict:
                    continue
            raise Conflict(f"{self.path}: {RETRIES} other writers came first")
        finally:
            self.files.delete(f"{self.path}/{folder}")

    def _merged(self, staged: DataFrame, buckets: list[int], state: dict[str, list[str]], merge) -> dict[str, list[str]]:
        """The new files of some buckets: old and new rows merged in one job, whose output is dealt by bucket."""
        folder = f"data/{uuid.uuid4().hex}"
        old = self._rows([f for b in buckets for f in state.get(str(b), [])])
        new = staged.where(F.col("__bucket").isin(buckets)).drop("__bucket")
        out = merge(old, new).select(*self.schema.names).withColumn("__bucket", self._bucket())
        # Several tasks write a bucket, so that none has to hold and sort the whole of a large one.
        out.repartition("__bucket", F.pmod(F.xxhash64(F.lit("part"), *self.key), F.lit(PARTS))).write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        there = set(self.files.names(f"{self.path}/{folder}"))
        return {str(b): [f"{folder}/__bucket={b}"] if f"__bucket={b}" in there else [] for b in buckets}

    def vacuum(self, keep: int = 10) -> None:
        """Delete versions before the last ``keep``, and files that no kept version names. No writer may be at work meanwhile."""
        versions = sorted(self.versions())
        kept = versions[-keep:]
        used = {f.split("/")[1] + "/" + f.split("/")[2] for v in kept for own in self._state(v).values() for f in own}
        for version in versions[: -keep or None]:
            self.files.delete(self._log(version))
        for job in self.files.names(f"{self.path}/data"):
            own = [n for n in self.files.names(f"{self.path}/data/{job}") if n.startswith("__bucket=")]
            for n in own:
                if f"{job}/{n}" not in used:
                    self.files.delete(f"{self.path}/data/{job}/{n}")
            if not any(f"{job}/{n}" in used for n in own):
                self.files.delete(f"{self.path}/data/{job}")
