"""Texts worked on one by one inside tasks: slices of bounded size, and rows whose key others repeat set apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfolio.session import written

#: Bytes of the texts that are worked on at once: what they are turned into may be many times as large.
SLICE_BYTES = 1 << 20
#: Keys, about 100 bytes each, that are sent to the tasks as a filter; more are joined by a shuffle.
BROADCAST_KEYS = 500_000


def _bytes(column: pa.Array) -> np.ndarray:
    """Bytes of each text, or of each list of texts."""
    if pa.types.is_list(column.type):
        ends = np.concatenate([[0], np.cumsum(_bytes(column.flatten()))])
        counts = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))])
        return ends[counts[1:]] - ends[counts[:-1]]
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` of each holds ``limit`` bytes or so; a text above that is a slice of its own."""
    for batch in batches:
        ends = np.cumsum(_bytes(batch.column(column)) + 64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def apart(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose ``keys`` no other row has, and those that share theirs; None where there are none. Nulls are equal.

    Only the keys are counted; where none is repeated, the rows themselves aren't moved.
    """
    names = [f"__again_{i}" for i in range(len(keys))]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    again = written(counts.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]), "repeated-keys")
    n = again.count()
    if not n:
        return rows, None
    same = F.lit(True)
    for k, name in zip(keys, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(name))
    again = F.broadcast(again) if n <= BROADCAST_KEYS else again
    return rows.join(again, same, "left_anti"), rows.join(again, same, "left_semi")
