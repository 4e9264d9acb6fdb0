"""Pieces shared by the Python operators: words, hashes and bounded samples."""

from __future__ import annotations

import ctypes
import pickle
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfolio.session import written

WORD = re.compile(r"\w+")


class Memo(dict):
    """A bounded memo of ``make(key)``: cleared when full, so memory doesn't follow the vocabulary."""

    def __init__(self, make, limit: int = 200_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores; null has none."""
    return WORD.findall(text.lower()) if text else []


def hashes(tokens: list[str], memo: Memo) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def shingles(token_hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """The sorted distinct hashes of all runs of ``size`` words; a shorter text is one run."""
    n = len(token_hashes)
    if not n:
        return token_hashes
    width = min(size, n)
    out = np.zeros(n - width + 1, dtype=np.uint64)
    for k in range(width):
        out ^= token_hashes[k : n - width + 1 + k]
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def by_size(batches: Iterator, column: str, limit: int = 4_000_000) -> Iterator:
    """Cut pandas batches so that the texts of each hold about ``limit`` characters."""
    for pdf in batches:
        start = total = 0
        for i, size in enumerate(pdf[column].map(lambda t: len(t) if t is not None else 0).tolist()):
            total += size
            if total >= limit:
                yield pdf.iloc[start : i + 1]
                start, total = i + 1, 0
        if start < len(pdf):
            yield pdf.iloc[start:]


def crc_mod(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def hash_sample(rows: DataFrame, key: Column, size: int, total: int) -> DataFrame:
    """About ``size`` of ``total`` rows, chosen by a hash of ``key`` alone: the same rows on every run."""
    if total <= size:
        return rows
    cut = int(size / total * 2**31)
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(2**31)) < F.lit(cut))


#: Rows that the executor hands a Python worker at once where they carry texts or sets.
ARROW_ROWS = 1_000


@contextmanager
def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> Iterator[None]:
    """Jobs that run inside hand their Python workers so many rows at once, at most: both sides hold a batch in memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


_HELD: dict[object, object] = {}


def give_back() -> None:
    """Return freed memory to the system, where its C library can: workers live on, beside others and the executor."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def held(key: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps between tasks: the state of the operator that it last ran, and nothing of others.

    Workers are reused by stage after stage, so that without this each would come to hold every operator's
    models and memos at once.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    give_back()
    return _HELD[key]


def unpickled(shared):
    """The object pickled in a broadcast, loaded once a Python worker rather than once a task."""
    return held(hash(shared.value), lambda: pickle.loads(shared.value))


def word_memo() -> Memo:
    return held("words", lambda: Memo(word_hash))


#: A key is hot from so many rows, or from a ten-thousandth of all rows if that is more.
HOT_ROWS = 1_000


def hot_limit(total: int) -> int:
    """Rows of one key from which it is hot. At most 10,000 keys can have more, whatever the number of rows."""
    return max(HOT_ROWS, total // 10_000)


def hot_join(rows: DataFrame, table: DataFrame, key: str | list[str], weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has each ``key`` once, and how many rows share it in ``weight``.

    ``total`` is the sum of the weights. Rows of hot keys stay where they are and find theirs in a broadcast of at most
    10,000 rows; all other keys have few rows and are joined by a shuffle. Both sides are read twice: pass
    written tables, or what is cheap to compute. ``weight`` is not carried on. Keys of null match nothing.
    """
    keys = [key] if isinstance(key, str) else key
    limit = hot_limit(total)
    hot = F.broadcast(table.where(F.col(weight) > limit).drop(weight))
    cold = table.where(F.col(weight) <= limit).drop(weight)
    columns = [*rows.columns, *[c for c in table.columns if c not in (*keys, weight)]]
    found = rows.join(hot, keys).select(*columns)
    return found.unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys).select(*columns))


#: Parts that rows without a key are dealt to.
NULL_PARTS = 1024


def spread_left_join(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join of ``rows`` with ``table``, which has each ``key`` once and has null none, by one shuffle that no key can unbalance.

    Rows of a hot key are dealt to as many parts as it needs, each of which gets the key's row of ``table``; rows without a key are dealt
    to NULL_PARTS. There are at most 10,000 hot keys. ``rows`` is read twice, once for its keys alone.
    """
    limit = hot_limit(rows.count())
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hot = written(counts.where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("n")), "hot-keys")
    own, name, salt = free_names([*rows.columns, *table.columns], "n", "id", "salt")
    parts = F.when(F.col(key).isNull(), F.lit(NULL_PARTS)).otherwise(F.coalesce(F.col(own), F.lit(1)))
    dealt = rows.withColumn(name, F.monotonically_increasing_id()).join(F.broadcast(hot.withColumnRenamed("n", own)), key, "left")
    dealt = dealt.withColumn(salt, F.pmod(F.col(name), parts).cast("int"))
    copies = table.join(F.broadcast(hot.withColumnRenamed("n", own)), key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(own), F.lit(1)) - 1)))
    return dealt.drop(own, name).join(copies.drop(own), [key, salt], "left").drop(salt)


#: Rows whose keys may be broadcast as a filter, about 100 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def free_names(df: DataFrame | list[str], *names: str) -> list[str]:
    """Names for columns that ``df``, or a list of columns, doesn't have, whatever it has."""
    taken = {c.lower() for c in (df if isinstance(df, list) else df.columns)}
    out = []
    for name in names:
        name = f"__{name}"
        while name in taken:
            name += "_"
        out.append(name)
    return out


def without_rows(docs: DataFrame, drop: DataFrame, repeated: DataFrame, id_col: str, text_col: str, key: Column) -> DataFrame:
    """``docs`` without the rows that ``drop`` names, and with one of each that ``repeated`` names, with all columns.

    Both tables are written ones and name rows by __id and __key, which ``key`` computes from a row. Of rows with one name the
    longest text stays, then the last in the order of texts.
    """
    own, name = free_names(docs, "own", "name")
    # Names of the small tables may be columns of the documents as well: they get others for the join.
    ids, keys = free_names(docs, "id", "key")
    drop, repeated = (t.select(F.col("__id").alias(ids), F.col("__key").alias(keys)) for t in (drop, repeated))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(ids)) & (F.col(own) == F.col(keys))
    few = drop.count() <= BROADCAST_ROWS
    kept = docs.withColumn(own, key).join(F.broadcast(drop) if few else drop, same, "left_anti")
    n = repeated.count()
    if not n:
        return kept.drop(own)
    # Only the rows that are repeated meet each other, not the whole table.
    named = F.broadcast(repeated) if n <= BROADCAST_ROWS else repeated
    once, again = kept.join(named, same, "left_anti").drop(own), kept.join(named, same, "left_semi")
    # Combined where they are read: a row that a third of the table repeats sends one row a task.
    best = F.max_by(F.struct(*docs.columns), F.struct(F.length(text_col), F.col(text_col))).alias("best")
    return once.unionByName(again.groupBy(F.col(id_col).alias(name), F.col(own)).agg(best).select("best.*"))
