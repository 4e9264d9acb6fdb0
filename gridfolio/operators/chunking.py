"""Chunks, clauses, keywords, semantic breakpoints and continuation of tables."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridfolio.functions import numeric, text
from gridfolio.functions.nested import uniform_width
from gridfolio.operators import per_text

MAX_TOKENS, MIN_TOKENS, OVERLAP_TOKENS = 512, 50, 64
SEMANTIC_MAX_TOKENS, PERCENTILE = 1024, 0.95


def word_count(text: str) -> int:
    return len(text.split())


def pack_sentences(sentences: list[str], most: int = MAX_TOKENS, least: int = MIN_TOKENS, overlap: int = OVERLAP_TOKENS, count: Callable[[str], int] = word_count) -> Iterator[tuple[int, int, str]]:
    """(first sentence, words, text) of chunks of whole sentences; each begins with the last sentences of the one before.

    A sentence above the limit is a chunk of its own, cut by words. A chunk below ``least`` words joins the one before it, the first one
    the one after it, so that no text is lost; that chunk may then exceed the limit by as much. A first chunk stays short only
    where the one after it has taken a short one already and has no room left. Words are counted by ``count``.
    """
    pieces = []
    for s in sentences:
        words = s.split()
        pieces += [" ".join(words[i : i + most]) for i in range(0, len(words), most)]
    sizes = [count(p) for p in pieces]
    runs, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            runs.append((start, i))
            start, total = i, 0
            while start and total + sizes[start - 1] + n <= most and total + sizes[start - 1] <= overlap:
                start -= 1
                total += sizes[start]
        total += n
    if pieces:
        runs.append((start, len(pieces)))
    kept: list[tuple[int, int]] = []
    for a, b in runs:
        if kept and sum(sizes[a:b]) < least:
            kept[-1] = (kept[-1][0], b)
        else:
            kept.append((a, b))
    if len(kept) > 1 and sum(sizes[kept[0][0] : kept[0][1]]) < least and sum(sizes[kept[0][0] : kept[1][1]]) < most + least:
        kept[:2] = [(kept[0][0], kept[1][1])]
    for a, b in kept:
        yield a, sum(sizes[a:b]), " ".join(pieces[a:b])


def chunks(docs: DataFrame, id_col: str, text_col: str, most: int = MAX_TOKENS, least: int = MIN_TOKENS, overlap: int = OVERLAP_TOKENS, count: Callable[[str], int] = word_count) -> DataFrame:
    """document_id, chunk_index, first_sentence, token_count, text. Packing is sequential, so each text is cut by itself, in Arrow batches.

    ``count`` counts the tokens of a sentence: words, or those of an injected tokenizer.
    """
    rows = docs.select(F.col(id_col).alias("document_id"), text.sentences(F.col(text_col)).alias("s"))
    schema = pa.schema([("chunk_index", pa.int32()), ("first_sentence", pa.int32()), ("token_count", pa.int32()), ("text", pa.string())])

    def run(batches):
        for part in per_text.slices(batches, "s"):
            found = [(row, i, *c) for row, s in enumerate(part.column("s")) for i, c in enumerate(pack_sentences(s.as_py(), most, least, overlap, count))]
            at, *columns = zip(*found, strict=True) if found else [()] * 5
            own = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            yield own.add_column(0, "document_id", part.column("document_id").take(pa.array(at, pa.int64())))

    kind = rows.schema["document_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"document_id {kind}, chunk_index int, first_sentence int, token_count int, text string")


def sentence_distances(df: DataFrame, by: str, order: str, vector: str = "embedding") -> DataFrame:
    """Cosine distance of each row to the one before it in its document; null for the first."""
    before = F.lag(vector).over(Window.partitionBy(by).orderBy(order))
    return df.withColumn("distance", F.when(before.isNotNull(), numeric.cosine_distance(F.col(vector), before)))


def breakpoints(df: DataFrame, by: str, order: str, percentile: float = PERCENTILE) -> DataFrame:
    """Adds segment: a new one begins where the distance is above the percentile of its document."""
    limits = df.groupBy(by).agg(F.percentile("distance", percentile).alias("limit"))
    cut = F.coalesce(F.col("distance") > F.col("limit"), F.lit(False)).cast("int")
    running = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(limits, by).withColumn("segment", F.sum(cut).over(running)).drop("limit")


def semantic_chunks(docs: DataFrame, id_col: str, text_col: str, embed: Callable[[list[str]], np.ndarray], most: int = SEMANTIC_MAX_TOKENS, least: int = MIN_TOKENS) -> DataFrame:
    """Chunks cut at the largest jumps between neighbouring sentences; too long ones are cut again, too short ones merged."""
    rows = docs.select(F.col(id_col).alias("document_id"), text.sentences(F.col(text_col)).alias("s"))

    def run(batches):
        for pdf in batches:
            out = []
            for d, s in zip(pdf["document_id"], pdf["s"], strict=True):
                out += [(d, i, t) for i, t in enumerate(cut_by_meaning(list(s), embed, most, least))]
            yield pd.DataFrame(out, columns=["document_id", "chunk_index", "text"])

    kind = rows.schema["document_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"document_id {kind}, chunk_index int, text string")


def cut_by_meaning(sentences: list[str], embed: Callable, most: int, least: int) -> list[str]:
    if len(sentences) < 3:
        return [" ".join(sentences)] if sentences else []
    v = np.asarray(embed(sentences), dtype=float)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    jump = 1 - np.clip((v[1:] * v[:-1]).sum(1), -1, 1)
    sizes = [len(s.split()) for s in sentences]
    limit = np.quantile(jump, PERCENTILE)
    groups = np.split(np.arange(len(sentences)), np.flatnonzero(jump > limit) + 1)
    fitting: list[np.ndarray] = []
    while groups:
        g = groups.pop(0)
        if sum(sizes[i] for i in g) > most and len(g) > 1:
            at = int(np.argmax(jump[g[0] : g[-1]])) + 1
            groups[:0] = [g[:at], g[at:]]
        else:
            fitting.append(g)
    merged: list[list[int]] = []
    for g in fitting:
        n = sum(sizes[i] for i in g)
        if merged and (n < least or sum(sizes[i] for i in merged[-1]) < least) and n + sum(sizes[i] for i in merged[-1]) <= most:
            merged[-1] += g.tolist()
        else:
            merged.append(g.tolist())
    return [" ".join(sentences[i] for i in g) for g in merged]


def keywords(docs: DataFrame, id_col: str, text_col: str, n: int = 10) -> DataFrame:
    """The n most frequent words (of three letters or more) and word pairs of each text, by count, then first appearance.

    They are counted where a text is read. Texts of one id count together: only such rows are grouped.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    once, again = per_text.apart(rows, ["id"])
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for part in per_text.slices(batches, "text"):
            found = [(row, *best) for row, t in enumerate(part.column("text").to_pylist()) for best in _frequent(t, n)]
            at, terms, counts, ranks = zip(*found, strict=True) if found else [()] * 4
            ids = part.column("id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(terms, pa.string()), pa.array(counts, pa.int64()), pa.array(ranks, pa.int32())], names=["id", "term", "n", "rank"])

    out = once.mapInArrow(run, f"id {kind}, term string, n long, rank int")
    return out if again is None else out.unionByName(_frequent_of_ids(again, n))


def _frequent(low: str, n: int) -> list[tuple[str, int, int]]:
    """(term, count, rank) of the n most frequent words and pairs of a lower-case text; a pair stands between its words."""
    words = re.findall("[a-z]{3,}", low)
    pairs = list(map(" ".join, pairwise(words)))
    # Of equal counts a Counter gives the one that came first; the n best of all are among those of both kinds.
    best = [(-k, 2 * words.index(w), w) for w, k in Counter(words).most_common(n)] + [(-k, 2 * pairs.index(p) + 1, p) for p, k in Counter(pairs).most_common(n)]
    return [(term, -k, i + 1) for i, (k, _, term) in enumerate(sorted(best)[:n])]


def _frequent_of_ids(rows: DataFrame, n: int) -> DataFrame:
    """The same of the texts of each id together, by grouping all their words."""
    words = F.regexp_extract_all("text", F.lit("[a-z]{3,}"), F.lit(0))
    cut = rows.select("id", F.filter(words, lambda w: w != "").alias("w"))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 2, F.lit(0))), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)))).otherwise(F.array())
    tagged = F.concat(F.transform("w", lambda x, i: F.struct(x.alias("term"), (2 * i).alias("at"))), F.transform(pairs, lambda x, i: F.struct(x.alias("term"), (2 * i + 1).alias("at"))))
    counts = cut.select("id", F.explode(tagged).alias("t")).groupBy("id", "t.term").agg(F.count(F.lit(1)).alias("n"), F.min("t.at").alias("first"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.col("n").desc(), "first"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n).select("id", "term", "n", "rank")


def clauses(blocks: DataFrame, by: str = "document_id", order: str = "position", text_col: str = "text") -> DataFrame:
    """Clauses of ordered text blocks: a block that begins like a clause opens one, the blocks after it belong to it.

    clause_index, clause_number, clause_title, clause_type, text; blocks before the first opening are left out,
    and of clauses with one fingerprint the first stays.
    """
    # The blocks of a document are put in order once; its clauses are slices of that array.
    block = F.struct(F.col(order).alias("order"), F.col(text_col).alias("text"))
    rows = blocks.groupBy(by).agg(F.sort_array(F.collect_list(block)).alias("__b"))
    opening = F.filter(F.transform("__b", lambda b, i: F.when(b["text"].rlike(text.CLAUSE_START), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("__s", opening)
    cut = rows.select(by, "__b", "__s", F.posexplode("__s").alias("__k", "__at"))
    end = F.coalesce(F.get("__s", F.col("__k") + 1), F.size("__b"))
    body = F.array_join(F.transform(F.slice("__b", F.col("__at") + 1, end - F.col("__at")), lambda b: b["text"]), "\n")
    joined = cut.select(by, (F.col("__k") + 1).cast("long").alias("clause_index"), body.alias("text"))
    out = joined.withColumn("c", text.clause(F.col("text"), F.lit(None).cast("string")))
    out = out.select(by, "clause_index", F.col("c.number").alias("clause_number"), F.col("c.title").alias("clause_title"), F.col("c.type").alias("clause_type"), "text")
    mark = text.fingerprint(F.col("clause_number"), F.col("text"))
    return out.withColumn("__r", F.row_number().over(Window.partitionBy(by, mark).orderBy("clause_index"))).where("__r = 1").drop("__r")


def merged_tables(fragments: DataFrame) -> DataFrame:
    """Tables that go on over pages as one: consecutive pages, equal headers and uniform rows.

    Fragments: document_id, table_index, page_number, headers, rows. Result: headers, rows, pages, fragment_count.
    """
    w = Window.partitionBy("document_id").orderBy("table_index")
    follows = (
        (F.col("page_number") == F.lag("page_number").over(w) + 1)
        & F.col("headers").eqNullSafe(F.lag("headers").over(w))
        & uniform_width(F.col("rows"))
        & F.coalesce(uniform_width(F.lag("rows").over(w)), F.lit(False))
    )
    island = F.sum((~F.coalesce(follows, F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    parts = F.sort_array(F.collect_list(F.struct("table_index", "page_number", "headers", "rows")))
    out = fragments.withColumn("island", island).groupBy("document_id", "island").agg(parts.alias("p"))
    page_numbers = F.flatten(F.transform("p", lambda x: F.transform(x["rows"], lambda r: x["page_number"])))
    return out.select(
        "document_id",
        F.element_at("p", 1)["table_index"].alias("table_index"),
        F.element_at("p", 1)["headers"].alias("headers"),
        F.flatten(F.transform("p", lambda x: x["rows"])).alias("rows"),
        page_numbers.alias("row_page_numbers"),
        F.size("p").alias("fragment_count"),
    )


def carried_sections(items: DataFrame, by: str = "document_id", order: str = "position") -> DataFrame:
    """Adds section: the last heading at or before each item."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("section", F.last(F.when(F.col("kind") == "heading", F.col("text")), ignorenulls=True).over(w))


def pages_from_breaks(paragraphs: DataFrame, by: str = "document_id", order: str = "position") -> DataFrame:
    """Adds page_number from markers of page breaks: 1 + the breaks up to a paragraph."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return paragraphs.withColumn("page_number", (1 + F.sum(F.col("is_break").cast("int")).over(w)).cast("int"))


def reassigned_captions(items: list[dict]) -> list[dict]:
    """Each table takes the nearest caption above it on its page that no table took before; a caption with the table's number wins."""
    used: set[int] = set()
    out = []
    for i, item in enumerate(items):
        if item["kind"] != "table":
            continue
        above = [j for j in range(i - 1, -1, -1) if items[j]["kind"] == "caption" and j not in used and items[j]["page"] == item["page"]]
        own = [j for j in above if item.get("number") and item["number"] in items[j]["text"]]
        best = (own or above or [None])[0]
        if best is not None:
            used.add(best)
        out.append({**item, "caption": items[best]["text"] if best is not None else item.get("caption")})
    return out
