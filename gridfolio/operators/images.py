"""Image features, pre-filtering, duplicates, and routing of what was read from images."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfolio.functions.text import strip_fences
from gridfolio.session import written

MIN_SIDE, MAX_ASPECT, MIN_STD, MAX_HAMMING, SEARCHABLE = 32, 12.0, 4.0, 5, 12
#: Varying bits up to which the first image of a hash is spread over all hashes within reach.
SPREAD_BITS = 20
#: Least confidence for a specialised store.
MIN_CONFIDENCE = 0.35
#: Keys of a chart's data.
CHART_KEYS = ["categories", "series", "slices", "segments", "percentages", "data_points", "values", "labels"]


def features(pixels: np.ndarray) -> dict:
    """Spread, share of edges, different values, average hash, row/column line score and aspect of a grey image."""
    g = np.asarray(pixels, dtype=float)
    h, w = g.shape
    small = g[np.linspace(0, h - 1, 8).astype(int)][:, np.linspace(0, w - 1, 8).astype(int)]
    bits = (small > small.mean()).ravel()
    edges = (np.abs(np.diff(g, axis=0)) > 30).mean() if h > 1 else 0.0
    dark = g < 128
    lines = float(((dark.mean(1) > 0.6).sum() + (dark.mean(0) > 0.6).sum()) / (h + w))
    return {"width": w, "height": h, "std": float(g.std()), "edges": float(edges), "colours": int(len(np.unique(g))), "ahash": int(sum(1 << i for i, b in enumerate(bits) if b)) - (1 << 63), "lines": lines, "aspect": max(w / h, h / w)}


def with_features(df: DataFrame) -> DataFrame:
    """Adds the features of a column ``pixels`` (array<array<int>>), in Arrow batches."""
    kind = "struct<width:int,height:int,std:double,edges:double,colours:int,ahash:long,lines:double,aspect:double>"

    @F.pandas_udf(kind)
    def run(pixels: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([features(np.array([list(r) for r in p])) for p in pixels])

    return df.withColumn("f", run("pixels")).select(*df.columns, "f.*")


def duplicates(df: DataFrame, by: str = "document_id", order: str = "image_index") -> DataFrame:
    """Images with an earlier one of their document within MAX_HAMMING bits.

    Images of one hash are one row by their first number, so that a hash that very many images share (that of a blank one, say)
    makes no pairs of its own. Where only few bits of the hashes vary at all, the earliest image spreads from hash to hash, one bit a
    round; else hashes that share a part are compared.
    """
    first = written(df.where("ahash is not null").groupBy(by, "ahash").agg(F.min(order).alias("__first")), "first-images")
    places, spreads = _varying(first, by)
    least = _spread(first, by, places) if spreads else _near(first, by, places).groupBy(by, "ahash").agg(F.min("__other").alias("__near"))
    found = first.join(least, [by, "ahash"], "left").select(by, "ahash", F.least("__first", F.coalesce("__near", "__first")).alias("duplicate_of"))
    rows = df.select(by, order, "ahash").join(found, [by, "ahash"])
    return rows.where(F.col("duplicate_of") < F.col(order)).select(by, order, "duplicate_of")


def _varying(hashes: DataFrame, by: str) -> tuple[list[int], bool]:
    """The places of the bits that aren't the same in all hashes, and whether spreading over those makes fewer rows than pairs would be compared."""
    every, some, n, documents = hashes.agg(F.bit_and("ahash"), F.bit_or("ahash"), F.count(F.lit(1)), F.count_distinct(by)).first()
    differ = 0 if every is None else (every ^ some) % 2**64
    places = [i for i in range(64) if differ >> i & 1]
    width = len(places)
    pairs = n * n / max(1, documents) * (MAX_HAMMING + 1) / 2 ** (width / (MAX_HAMMING + 1))
    return places, width <= SPREAD_BITS and documents * 2**width * (width + 1) * MAX_HAMMING <= pairs


def _bit(place: int) -> Column:
    return F.shiftleft(F.lit(1).cast("long"), place)


def _spread(hashes: DataFrame, by: str, places: list[int]) -> DataFrame:
    """Per hash (by, ahash) the first image __near of all hashes within MAX_HAMMING bits, itself as well.

    Of each round all hashes one bit away know the least number that is known so far, whether or not an image has them. A document
    has at most two to the power of the varying bits of them, so that no round grows beyond that, however many images share them.
    """
    steps = F.array(F.lit(0).cast("long"), *[_bit(i) for i in places])
    known = hashes.select(by, "ahash", F.col("__first").alias("__near"))
    for _ in range(MAX_HAMMING):
        reached = known.select(by, F.explode(steps).alias("__step"), "ahash", "__near").select(by, F.col("ahash").bitwiseXOR(F.col("__step")).alias("ahash"), "__near")
        known = written(reached.groupBy(by, "ahash").agg(F.min("__near").alias("__near")), "spread-images")
    return known


def _near(hashes: DataFrame, by: str, places: list[int]) -> DataFrame:
    """Per hash of a document (by, ahash, __first) the first image of every other hash within MAX_HAMMING bits.

    Two hashes that differ in at most MAX_HAMMING bits share one of as many and one more parts of the varying bits, so only those that
    share a part are compared: an equi-join that finds every pair.
    """
    masks = [sum(1 << int(i) for i in part) for part in np.array_split(places, MAX_HAMMING + 1)]
    parts = F.array(*[F.col("ahash").bitwiseAND(F.lit(m - 2**64 if m >= 2**63 else m).cast("long")) for m in masks])
    cut = hashes.select(by, "__first", "ahash", F.posexplode(parts).alias("part", "bits"))
    a, b = cut.alias("a"), cut.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (by, "part", "bits")]
    close = (F.col("a.ahash") != F.col("b.ahash")) & (F.bit_count(F.col("a.ahash").bitwiseXOR(F.col("b.ahash"))) <= MAX_HAMMING)
    return a.join(b, [*same, close]).select(F.col(f"b.{by}").alias(by), F.col("b.ahash").alias("ahash"), F.col("a.__first").alias("__other"))


def decided(df: DataFrame) -> DataFrame:
    """keep, reason for images with features: too small, too long, blank and repeated ones go, in this order."""
    found = df.join(duplicates(df), ["document_id", "image_index"], "left")
    reason = (
        F.when(F.least("width", "height") < MIN_SIDE, "too_small")
        .when(F.col("aspect") > MAX_ASPECT, "separator")
        .when(F.col("std") < MIN_STD, "blank")
        .when(F.col("duplicate_of").isNotNull(), "duplicate")
    )
    return found.withColumns({"reason": F.coalesce(reason, F.lit("content")), "keep": reason.isNull()})


def searchable(text: Column) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) >= SEARCHABLE


def content_class(structured: Column, ocr: Column, store: Column, read: Column) -> Column:
    """decorative, structured_table, structured_chart, legal, document_text, mixed or unknown."""
    data = F.try_parse_json(strip_fences(F.coalesce(structured, F.lit(""))))
    rows = F.try_variant_get(data, "$.rows", "array<variant>")
    chart = F.lit(False)
    for k in CHART_KEYS:
        chart = chart | F.try_variant_get(data, f"$.{k}", "variant").isNotNull()
    prose = F.when(store == "clause_store", "legal").when(store.isin("document_store", "vector_store"), "document_text").when(store == "table_store", "mixed").otherwise("unknown")
    return (
        F.when(~(searchable(structured) | searchable(ocr)), "decorative")
        .when(F.size(rows) > 0, "structured_table")
        .when(chart, "structured_chart")
        .when(read, prose)
        .otherwise("unknown")
    )


def destination(kind: Column, confidence: Column) -> Column:
    sure = F.coalesce(confidence, F.lit(0.0)) >= MIN_CONFIDENCE
    table = kind.isin("structured_table", "structured_chart")
    return F.when(table & sure, "table_store").when((kind == "legal") & sure, "clause_store").when(kind == "decorative", "image_store").otherwise("vector_store")


def routed(df: DataFrame) -> DataFrame:
    """Adds content_class, is_valid, quality and destination_store to (structured_content, ocr_text, store, vlm_succeeded, confidence).

    A table whose rows have different widths isn't valid and goes to the vector store.
    """
    data = F.try_parse_json(strip_fences(F.coalesce("structured_content", F.lit(""))))
    rows = F.coalesce(F.try_variant_get(data, "$.rows", "array<array<string>>"), F.array().cast("array<array<string>>"))
    headers = F.coalesce(F.try_variant_get(data, "$.headers", "array<string>"), F.array().cast("array<string>"))
    out = df.withColumn("content_class", content_class(F.col("structured_content"), F.col("ocr_text"), F.col("store"), F.col("vlm_succeeded")))
    table = F.col("content_class").isin("structured_table", "structured_chart")
    widths = F.array_distinct(F.transform(rows, F.size))
    valid = F.when(table, (F.size(rows) > 0) & (F.size(widths) == 1)).otherwise(F.col("content_class") != "decorative")
    clean = (F.size(headers) > 0) & (F.size(rows) >= 2) & (F.get(widths, F.lit(0)) == F.size(headers)) & (F.size(F.array_distinct(F.transform(headers, lambda h: F.lower(F.trim(h))))) == F.size(headers))
    n = F.length(F.coalesce(F.when(F.trim("structured_content") != "", F.trim("structured_content")), F.trim("ocr_text"), F.lit("")))
    quality = F.when(table, F.when(valid & clean, "high").when(valid, "medium").otherwise("low")).when(F.col("content_class") == "decorative", "low").otherwise(F.when(n >= 200, "high").when(n >= 60, "medium").otherwise("low"))
    to = F.when(table & ~valid, "vector_store").otherwise(destination(F.col("content_class"), F.col("confidence")))
    return out.withColumns({"is_valid": valid, "quality": quality, "destination_store": to})


def _checked(df: DataFrame, valid: Column, to: str) -> DataFrame:
    return df.where(valid).withColumn("store", F.lit(to))


def table_rows(df: DataFrame) -> DataFrame:
    """Tables: title, headers and rows of the structured content; only grids with uniform rows are valid."""
    from gridfolio.functions import nested
    from gridfolio.operators.ingest import vlm_tables

    found = vlm_tables(df, "structured_content")
    return _checked(found, (F.size("rows") > 0) & nested.uniform_width(F.col("rows")), "table_store")


def clause_rows(df: DataFrame) -> DataFrame:
    """Clauses: number, title and type of the text that was read."""
    from gridfolio.functions import text

    found = df.withColumn("c", text.clause(F.col("ocr_text"), F.lit(None).cast("string")))
    found = found.withColumns({"clause_number": F.col("c.number"), "clause_title": F.col("c.title"), "clause_type": F.col("c.type"), "text": F.trim("ocr_text")}).drop("c")
    return _checked(found, searchable(F.col("text")), "clause_store")


def text_rows(df: DataFrame) -> DataFrame:
    """Plain text: the structured content, else what was read."""
    said = F.when(F.trim(F.coalesce("structured_content", F.lit(""))) != "", F.trim("structured_content")).otherwise(F.trim("ocr_text"))
    found = df.withColumn("text", said)
    return _checked(found, searchable(F.col("text")), "vector_store")


#: What turns routed content into the rows of a store. Further stores are added by name.
HANDLERS: dict[str, Callable[[DataFrame], DataFrame]] = {"table_store": table_rows, "clause_store": clause_rows, "vector_store": text_rows}


def stored(routed_rows: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> dict[str, DataFrame]:
    """The rows of each store by its handler, and under ``rejected`` those that have no handler. One plan per store."""
    known = HANDLERS | (handlers or {})
    out = {name: handle(routed_rows.where(F.col("destination_store") == name)) for name, handle in known.items()}
    return out | {"rejected": routed_rows.where(~F.coalesce("destination_store", F.lit("")).isin(*known))}


def read_text(df: DataFrame, ocr: Callable[[bytes], str], content: str = "content") -> DataFrame:
    """Adds ocr_text and ocr_error by an injected reader of image bytes, in Arrow batches; an image that fails costs no other."""

    @F.pandas_udf("struct<ocr_text:string,ocr_error:string>")
    def run(images: pd.Series) -> pd.DataFrame:
        def one(data):
            try:
                return (ocr(bytes(data)), None) if data is not None else (None, None)
            except Exception as e:
                return None, f"{type(e).__name__}: {e}"

        return pd.DataFrame([one(x) for x in images], columns=["ocr_text", "ocr_error"])

    return df.withColumn("__o", run(content)).select(*df.columns, "__o.*")
