"""Full-text search from a stored index: posting blocks with their largest impact, and a top-k that skips blocks which can't enter it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import partial, reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridfolio.functions import stemming
from gridfolio.operators import keyword, per_text
from gridfolio.session import written

#: How the words of texts and questions become terms; an index names the one it was built with.
ANALYSERS: dict[str, Callable[[str], str]] = {"english": stemming.english, "light": keyword.stem}
#: Documents that share a block, at most: they are read one after the other.
BLOCK_DOCUMENTS = 512
#: Bytes of postings that a task holds and sorts by term at once.
SEGMENT_BYTES = 32 << 20
#: Blocks of each store that are read first.
FIRST_BLOCKS = 16
#: How postings are stored, bytes of a row group and rows of a page: groups and pages that lack the terms are skipped.
STORED = {"compression": "zstd", "parquet.block.size": 4 << 20, "parquet.page.row.count.limit": 4096}
#: Blocks that are sent to the tasks as a filter; more are joined by a shuffle.
BROADCAST_BLOCKS = 500_000


def segments(batches: Iterator[pa.RecordBatch], stem: Callable[[str], str], first: int, documents: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Posting blocks of batches of store, id and lower-case text: term, store, block, top, docs, a segment of postings at a time, sorted by term.

    A block is a run of ``documents`` texts or fewer. Each document lies in one block; should two runs ever get one number, they are one block.
    """
    block = first + (TaskContext.get().partitionId() << 32)
    held, size, inside = [], 0, 0
    for part in per_text.slices(batches, "text"):
        for start in range(0, part.num_rows, documents):
            run = part.slice(start, documents)
            if inside + run.num_rows > documents:
                block, inside = block + 1, 0
            inside += run.num_rows
            for found in keyword.placed([run], stem):
                held.append(found.append_column("block", pa.array(np.full(found.num_rows, block))))
                size += found.nbytes
            if size >= limit:
                yield from _segment(held)
                held, size, block, inside = [], 0, block + 1, 0
    if held:
        yield from _segment(held)


def _segment(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each term, store and block of some postings, in batches of bounded size."""
    rows = pa.Table.from_batches(held).combine_chunks()
    if not rows.num_rows:
        return
    terms, store = (pc.dictionary_encode(rows[c].chunk(0), null_encoding="encode") for c in ("term", "store"))
    place = np.empty(len(terms.dictionary), np.int64)
    place[pc.sort_indices(terms.dictionary).to_numpy()] = np.arange(len(place))
    keys = [place[terms.indices.to_numpy()], store.indices.to_numpy(), rows["block"].to_numpy()]
    order = np.lexsort(keys[::-1])
    new = reduce(np.logical_or, [np.diff(k[order], prepend=-1) != 0 for k in keys])
    starts = np.flatnonzero(new)
    rows = rows.take(pa.array(order)).combine_chunks()
    column = lambda c: rows[c].chunk(0)
    tops = np.maximum.reduceat(pc.list_value_length(column("positions")).to_numpy(), starts)
    ends = pa.array(np.append(starts, len(order)).astype(np.int32))
    docs = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([column(c) for c in ("id", "positions", "ordinals")], ["id", "positions", "ordinals"]))
    firsts = pa.array(starts)
    out = pa.RecordBatch.from_arrays([*[column(c).take(firsts) for c in ("term", "store", "block")], pa.array(tops, pa.int32()), docs], names=["term", "store", "block", "top", "docs"])
    step = max(1, out.num_rows * per_text.SLICE_BYTES // max(1, out.nbytes))
    for start in range(0, out.num_rows, step):
        yield out.slice(start, step)


class TextIndex:
    """A stored index over the texts of a table."""

    def __init__(self, spark: SparkSession, path: str):
        about = spark.read.parquet(f"{path}/about").first()
        self.spark, self.path = spark, path
        self.analyser, self.store_col, self.id_col = about["analyser"], about["store"], about["id"]

    @classmethod
    def build(cls, df: DataFrame, path: str, store: str = "store", id_col: str = "chunk_id", text_col: str = "text", analyser: str = "english") -> TextIndex:
        """Index all texts of ``df``. An id names one row of a store: a table in which it doesn't is refused.

        Each task stores the postings of the texts that it reads, as segments sorted by term: no posting is shuffled, and a
        frequent term is gathered in no one place.
        """
        spark = df.sparkSession
        if df.groupBy(store, id_col).count().where("count > 1").limit(1).count():
            raise ValueError(f"{id_col} doesn't name one row of a {store}")
        about = [(analyser, store, id_col)]
        spark.createDataFrame(about, "analyser string, store string, id string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
        own = cls(spark, path)
        own.add(df, text_col)
        return own

    def add(self, df: DataFrame, text_col: str = "text") -> None:
        """Append the texts of further rows; their ids must be new. The rows there are stay as they are."""
        rows = df.select(F.col(self.store_col).alias("store"), F.col(self.id_col).alias("id"), F.lower(text_col).alias("text")).where("text is not null")
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        # Numbers of blocks begin anywhere, so that those of one addition aren't those of another.
        cut = partial(segments, stem=ANALYSERS[self.analyser], first=uuid.uuid4().int >> 66, documents=BLOCK_DOCUMENTS, limit=SEGMENT_BYTES)
        blocks = rows.mapInArrow(cut, f"term string, store {kinds['store']}, block bigint, top int, docs array<struct<id: {kinds['id']}, positions: array<int>, ordinals: array<int>>>")
        blocks.write.mode("append").options(**STORED).parquet(f"{self.path}/postings")

    def parse(self, text: str) -> keyword.Query:
        return keyword.parse(text, ANALYSERS[self.analyser])

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """store, term, id, positions of all stored terms, or of some: the form that repeated searches read."""
        return self._read(terms).select("store", "term", F.explode("docs").alias("d")).select("store", "term", "d.id", "d.positions")

    def _read(self, terms: list[str] | None = None) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/postings")
        return rows if terms is None else rows.where(F.col("term").isin(terms))

    def bounds(self, query: keyword.Query) -> DataFrame:
        """store, block, bound of the blocks in which a document may match: it has all terms of a branch. No document of it ranks above ``bound``.

        Of a stored block only its term and its largest count are read for that.
        """
        words = query.words()
        tops = self._read(words).groupBy("store", "block", "term").agg(F.max("top").alias("top"))
        known = tops.groupBy("store", "block").agg(F.sum("top").alias("bound"), F.collect_set("term").alias("terms"))
        branches = [reduce(and_, [F.array_contains("terms", t) for p in branch for t in p]) for branch in query.any_of]
        return known.where(reduce(or_, branches, F.lit(False))).select("store", "block", "bound")

    def search(self, text: str, k: int) -> DataFrame:
        """store, id, rank, distance: the best ``k`` rows of each store, as ``keyword.search`` gives them with the index's analyser.

        The FIRST_BLOCKS blocks of each store with the largest bounds are ranked first. Their kth rank is a threshold: of
        all other blocks only those whose bound reaches it are read. Ties at the threshold are read as well, so the result is exact.
        """
        query = self.parse(text)
        if not query.any_of:
            return self._found(query, self._read([]).select("store", "block"), k)
        bounds = written(self.bounds(query), "bounds")
        first, rest = self._waves(query, bounds, k)
        return self._best(first.unionByName(self._found(query, rest, k)), k)

    def _waves(self, query: keyword.Query, bounds: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """What the first blocks give, and the other blocks that must be read."""
        place = F.row_number().over(Window.partitionBy("store").orderBy(F.col("bound").desc(), "block"))
        ranked = bounds.withColumn("place", place)
        first = written(self._found(query, ranked.where(F.col("place") <= FIRST_BLOCKS), k), "first")
        threshold = first.groupBy("store").agg(F.min("rank").alias("threshold"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).drop("n")
        # A null store is one like any other.
        named = threshold.select(F.col("store").alias("of"), "threshold")
        others = ranked.where(F.col("place") > FIRST_BLOCKS).join(F.broadcast(named), F.col("store").eqNullSafe(F.col("of")), "left")
        return first, others.where(F.col("threshold").isNull() | (F.col("bound") >= F.col("threshold"))).select("store", "block")

    def read_for(self, text: str, k: int) -> dict[str, int]:
        """Blocks with a term of the question, those in which a document may match, and those that a search reads."""
        query = self.parse(text)
        bounds = written(self.bounds(query), "bounds")
        _, rest = self._waves(query, bounds, k)
        place = F.row_number().over(Window.partitionBy("store").orderBy(F.col("bound").desc(), "block"))
        first = bounds.withColumn("place", place).where(F.col("place") <= FIRST_BLOCKS).count()
        return {"with a term": self._read(query.words()).select("store", "block").distinct().count(), "may match": bounds.count(), "read": first + rest.count()}

    def _found(self, query: keyword.Query, blocks: DataFrame, k: int) -> DataFrame:
        """The best rows of some blocks: store, id, rank."""
        words = query.words()
        excluded = sorted({w for p in query.none_of for w in p} - set(words))
        named = blocks.select(F.col("store").alias("of"), F.col("block").alias("in"))
        few = blocks.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS
        rows = self._read([*words, *excluded])
        here = F.col("store").eqNullSafe(F.col("of")) & (F.col("block") == F.col("in"))
        rows = rows.join(F.broadcast(named) if few else named, here, "left_semi")
        docs = rows.select("store", "term", F.explode("docs").alias("d")).select("store", "d.id", F.struct("term", F.struct("d.positions", "d.ordinals").alias("at")).alias("e"))
        whole = docs.groupBy("store", "id").agg(F.map_from_entries(F.collect_list("e")).alias("m"))
        matched = reduce(or_, [reduce(and_, [self._has(p) for p in branch]) for branch in query.any_of], F.lit(False))
        for p in query.none_of:
            matched = matched & ~self._has(p)
        places = F.sort_array(F.flatten(F.array(*[F.coalesce(F.try_element_at("m", F.lit(w))["positions"], F.array().cast("array<int>")) for w in words]))) if words else F.array().cast("array<int>")
        return self._best(whole.where(matched).select("store", "id", keyword.density(places).alias("rank")), k, distances=False)

    @staticmethod
    def _has(phrase: tuple[str, ...]) -> Column:
        """Whether a document has a word, or all words of a phrase one after the other."""
        there = reduce(and_, [F.map_contains_key("m", w) for w in phrase])
        if len(phrase) == 1:
            return there
        ordinals = [F.try_element_at("m", F.lit(w))["ordinals"] for w in phrase]
        begins = [F.transform(o, lambda x, i=i: x - i) for i, o in enumerate(ordinals)]
        return there & F.coalesce(F.size(reduce(F.array_intersect, begins)) > 0, F.lit(False))

    @staticmethod
    def _best(rows: DataFrame, k: int, distances: bool = True) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("store").orderBy(F.col("rank").desc(), "id"))
        top = rows.select("store", "id", "rank").withColumn("place", place).where(F.col("place") <= k).drop("place")
        return top.withColumn("distance", 1 - F.col("rank") / F.max("rank").over(Window.partitionBy("store"))) if distances else top
