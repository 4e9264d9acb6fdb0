"""Page-batched reading of paged files: each batch of pages is a row of its own, and so is its failure."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridfolio.operators import per_text
from gridfolio.sources.documents import BLOCK, GRID

#: Pages of a batch for files of up to so many pages; longer files have the last number.
BATCHES = [(50, 25), (200, 20)]
LARGE_BATCH = 10
PAGES = f"path string, first int, last int, blocks array<{BLOCK}>, tables array<{GRID}>, error string"

_KEY = [("path", pa.string()), ("first", pa.int32()), ("last", pa.int32())]
_TEXTS = pa.list_(pa.string())
_BLOCK = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("page", pa.int32())])
_GRID = pa.struct([("table_index", pa.int32()), ("headers", _TEXTS), ("rows", pa.list_(_TEXTS)), ("oversized", pa.bool_())])
PLAN = pa.schema(_KEY)
READ = pa.schema([*_KEY, ("blocks", pa.list_(_BLOCK)), ("tables", pa.list_(_GRID)), ("error", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def batch_size(pages: int) -> int:
    """Pages read at once: fewer of a longer file, which tends to be heavier."""
    return next((size for most, size in BATCHES if pages <= most), LARGE_BATCH)


def batches(files: DataFrame, count: Callable[[bytes], int]) -> DataFrame:
    """path, first, last: the batches of pages of (path, content); ``count`` reads the number of pages. An unreadable file is one batch (0, 0)."""

    def run(parts):
        for part in per_text.slices(parts, "content"):
            out = []
            for path, content in zip(part.column("path").to_pylist(), part.column("content"), strict=True):
                try:
                    n = count(bytes(content.as_py()))
                except Exception:
                    n = 0
                size = batch_size(n)
                out += [(path, a, min(n, a + size - 1)) for a in range(1, n + 1, size)] or [(path, 0, 0)]
            yield _batch(out, PLAN)

    return files.select("path", "content").mapInArrow(run, "path string, first int, last int")


def read_slices(parts: Iterator[pa.RecordBatch], reader: Callable[[bytes, int, int], tuple[list, list]]) -> Iterator[pa.RecordBatch]:
    """The rows of ``read_batches``, a slice of contents at a time."""
    for part in per_text.slices(parts, "content"):
        out = []
        keys = (part.column(c).to_pylist() for c in ("path", "first", "last"))
        for path, first, last, content in zip(*keys, part.column("content"), strict=True):
            try:
                if not first:
                    raise ValueError("no pages")
                blocks, tables = reader(bytes(content.as_py()), first, last)
                found = [{"position": i, "kind": k, "text": t, "page": p} for i, (k, t, p) in enumerate(blocks)]
                grids = [{"table_index": i, "headers": c[0], "rows": c[1:], "oversized": False} for i, c in enumerate(tables) if c]
                out.append((path, first, last, found, grids, None))
            except Exception as e:
                out.append((path, first, last, [], [], f"{type(e).__name__}: {e}"))
        yield _batch(out, READ)


def read_batches(files: DataFrame, planned: DataFrame, reader: Callable[[bytes, int, int], tuple[list, list]]) -> DataFrame:
    """Blocks and tables of each batch by ``reader(content, first, last)``; a batch that fails has an error and costs no other.

    Batches of one file are read by different tasks. Blocks come as (kind, text, page). Contents are read in slices of about a megabyte,
    since their blocks and tables are many times as large.
    """
    rows = planned.repartition("path", "first").join(files.select("path", "content"), "path")
    return rows.select("path", "first", "last", "content").mapInArrow(partial(read_slices, reader=reader), PAGES)


def joined(read: DataFrame) -> DataFrame:
    """One row per file again: path, blocks, tables, error. Positions and table numbers run on over the batches.

    A file whose batches all failed has their first error; one that lost some has none, and a count in ``failed_batches``.
    """
    parts = F.sort_array(F.collect_list(F.struct("first", "blocks", "tables")))
    out = read.groupBy("path").agg(
        parts.alias("p"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("first"))).alias("e"), F.count("error").alias("failed_batches"), F.count(F.lit(1)).alias("n")
    )
    blocks, tables = F.flatten(F.col("p.blocks")), F.flatten(F.col("p.tables"))
    number = lambda items, name: F.transform(items, lambda x, i: x.withField(name, i.cast("int")))
    whole = F.when(F.col("failed_batches") == F.col("n"), F.col("e"))
    return out.select("path", number(blocks, "position").alias("blocks"), number(tables, "table_index").alias("tables"), whole.alias("error"), "failed_batches")


def _places(read: DataFrame) -> DataFrame:
    """path, first, blocks_before, tables_before, carried of each batch: what the batches before it hold, and the last heading among them.

    Only sizes and headings are summed up along a file, never its blocks.
    """
    headings = F.filter("blocks", lambda b: b["kind"] == "heading")
    sizes = read.select("path", "first", F.size("blocks").alias("n"), F.size("tables").alias("m"), F.try_element_at(headings, F.lit(-1))["text"].alias("heading"))
    before = Window.partitionBy("path").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    return sizes.select("path", "first", upto("n").alias("blocks_before"), upto("m").alias("tables_before"), F.last("heading", ignorenulls=True).over(before).alias("carried"))


def items(read: DataFrame) -> DataFrame:
    """path, position, kind, text, page, section: the blocks of all files as rows, in the order of their files.

    Positions run on over the batches of a file, and a block stands under the last heading before it, wherever that was read. No file
    becomes one row: what is put in order together is a batch. A batch that failed has no blocks and leaves no gap. ``read`` is
    read twice: pass a written table.
    """
    flat = read.select("path", "first", F.posexplode("blocks").alias("at", "b")).join(_places(read), ["path", "first"])
    own = F.last(F.when(F.col("b.kind") == "heading", F.col("b.text")), ignorenulls=True).over(Window.partitionBy("path", "first").orderBy("at"))
    section = F.coalesce(own, F.col("carried"))
    return flat.select("path", (F.col("blocks_before") + F.col("at")).cast("int").alias("position"), "b.kind", "b.text", "b.page", section.alias("section"))


def tables(read: DataFrame) -> DataFrame:
    """path, table_index, headers, rows: the tables of all files, numbered over the batches of each."""
    flat = read.select("path", "first", F.posexplode("tables").alias("at", "t")).join(_places(read), ["path", "first"])
    return flat.select("path", (F.col("tables_before") + F.col("at")).cast("int").alias("table_index"), "t.headers", "t.rows")


def failures(read: DataFrame) -> DataFrame:
    """path, failed_batches, n_batches, error: files that lost a batch, with the error of the first."""
    first = F.min_by("error", F.when(F.col("error").isNotNull(), F.col("first")))
    return read.groupBy("path").agg(F.count("error").alias("failed_batches"), F.count(F.lit(1)).alias("n_batches"), first.alias("error")).where("failed_batches > 0")


def in_batches(files: DataFrame, count: Callable[[bytes], int], reader: Callable[[bytes, int, int], tuple[list, list]]) -> DataFrame:
    return joined(read_batches(files, batches(files, count), reader))
