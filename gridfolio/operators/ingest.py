"""The ingestion flow as lazy DataFrames, its stores, back-fills, and changes of what was ingested."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfolio.functions import embedding, nested, text
from gridfolio.operators import catalog, chunking, enrichment, graph, rows
from gridfolio.sources import stores

#: First index of table crops among images, and of rows in other stores that come from images.
CROP_INDEX, IMAGE_ROW_INDEX = 20_000, 50_000


@dataclass
class Collection:
    """The relations that parsing fills. All are keyed by document_id."""

    documents: DataFrame
    chunks: DataFrame
    clauses: DataFrame
    tables: DataFrame
    table_rows: DataFrame
    mentions: DataFrame

    def without(self, ids: DataFrame) -> Collection:
        """Cascade delete: every relation without the documents of ``ids`` (document_id)."""
        kept = catalog.deleted({f.name: getattr(self, f.name) for f in fields(self)}, "document_id", ids)
        return Collection(**kept)

    def replaced_by(self, other: Collection) -> Collection:
        """Reprocessing: the documents of ``other`` lose all their old rows and get the new ones."""
        base = self.without(other.documents)
        return Collection(**{f.name: getattr(base, f.name).unionByName(getattr(other, f.name), allowMissingColumns=True) for f in fields(self)})

    def write(self, path: str) -> None:
        for f in fields(self):
            stores.write_version(getattr(self, f.name), f"{path}/{f.name}")


def ingested(parsed: DataFrame, embed: Callable[[list[str]], list] | None = None) -> Collection:
    """All stores of parsed files (path, blocks, tables, error), from one plan per store.

    The document id is the hash of the path. A file that failed is a document with status ``failed`` and no rows
    elsewhere. Every chunk is tested for being a clause, and every table gets rows, whatever it was read from.
    """
    docs = stores.with_id(parsed, "path", name="document_id")
    lines = F.transform("blocks", lambda b: b["text"])
    typed = enrichment.document_types(docs.withColumn("__text", F.array_join(lines, "\n")), "__text", F.size("tables"), F.regexp_extract("path", r"([^/]+)$", 1))
    documents = typed.select(
        "document_id", "path", F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("status"), "error",
        "document_types", F.size("blocks").alias("n_blocks"), F.size("tables").alias("n_tables"),
    )
    whole = docs.select("document_id", F.array_join(lines, "\n").alias("text")).where("text <> ''")
    chunks = chunking.chunks(whole, "document_id", "text")
    clause = text.clause(F.col("text"), F.lit(None).cast("string"))
    chunks = chunks.withColumn("c", clause).withColumn("store", F.when(F.col("c.is_clause"), "clause_store").otherwise("vector_store"))
    chunks = stores.with_id(chunks, "document_id", "chunk_index", name="chunk_id").select("chunk_id", "document_id", "chunk_index", "store", F.col("c.type").alias("clause_type"), "text")
    blocks = docs.select("document_id", F.explode("blocks").alias("b")).select("document_id", "b.*")
    grids = docs.select("document_id", F.explode("tables").alias("t")).select("document_id", "t.*")
    grids = stores.with_id(grids, "document_id", "table_index", name="table_id").withColumn("caption", F.lit(None).cast("string"))
    log = graph.mentions(chunks, "chunk_id", "text").join(chunks.select(F.col("chunk_id").alias("id"), "document_id"), "id")
    return Collection(
        documents,
        embedding.embedded(chunks, "text", embed),
        chunking.clauses(blocks),
        enrichment.enriched_tables(grids),
        rows.from_grids(grids),
        log.withColumnRenamed("id", "chunk_id"),
    )


def backfill(parents: DataFrame, children: DataFrame, key: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The children with those of parents that had none: made for the missing parents only."""
    return children.unionByName(make(catalog.missing_children(parents, children, key)))


def linked_crops(images: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables with the id of their crop, which is the image of index CROP_INDEX + table_index of the document."""
    crops = images.select("document_id", (F.col("image_index") - CROP_INDEX).alias("table_index"), F.col("id").alias("source_image_id"))
    return tables.join(crops, ["document_id", "table_index"], "left")


def page_breakdown(blocks: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Per document and page: blocks, words, characters and images."""
    out = blocks.groupBy("document_id", "page").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.size(text.words(F.col("text")))).alias("n_words"), F.sum(F.length("text")).alias("n_chars"))
    if images is None:
        return out
    counts = images.groupBy("document_id", "page").agg(F.count(F.lit(1)).alias("n_images"))
    return out.join(counts, ["document_id", "page"], "full").fillna(0, ["n_blocks", "n_words", "n_chars", "n_images"])


def image_metrics(images: DataFrame) -> DataFrame:
    """Counts of images by status, and the share that needed no model call, as a percentage with one digit."""
    n = F.count(F.lit(1))
    skipped = F.count_if(F.col("status") == "skipped")
    return images.agg(n.alias("n_images"), F.count_if(F.col("status") == "completed").alias("n_completed"), F.count_if(F.col("status") == "failed").alias("n_failed"), skipped.alias("n_skipped"), F.round(100.0 * skipped / F.greatest(n, F.lit(1)), 1).alias("avoided_pct"))


def vlm_tables(df: DataFrame, column: str = "response") -> DataFrame:
    """Adds title, headers and rows of a model's JSON answer about a table; null where it holds none."""
    data = nested.tolerant_json(F.col(column))
    found = F.try_variant_get(data, "$.rows", "array<array<string>>")
    has = F.size(found) > 0
    return df.withColumns(
        {
            "title": F.when(has, F.try_variant_get(data, "$.title", "string")),
            "headers": F.when(has, F.try_variant_get(data, "$.headers", "array<string>")),
            "rows": F.when(has, found),
        }
    )


def citations(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """One citation per hit: file, page and a link that ends in the page."""
    joined = hits.join(documents.select("document_id", "path"), "document_id", "left")
    page = F.when(F.col("page").isNotNull(), F.concat(F.lit("#page="), F.col("page").cast("string"))).otherwise("")
    return joined.select("chunk_id", "document_id", F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "page", F.concat("path", page).alias("link"), F.left("text", F.lit(300)).alias("excerpt"))


def facts(values: DataFrame, column: str) -> DataFrame:
    """Rows of (group_key, value) as sentences with distance 0 and relevance 1, to stand among retrieved evidence."""
    shown = F.when(F.col("value") == F.floor("value"), F.col("value").cast("decimal(38,0)").cast("string")).otherwise(F.col("value").cast("string"))
    return values.select(F.concat("group_key", F.lit(f": {column} = "), shown).alias("text"), F.lit(0.0).alias("distance"), F.lit(1.0).alias("relevance"))
