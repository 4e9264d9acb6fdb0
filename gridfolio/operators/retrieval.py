"""Vector search, rank fusion, pooling, reranking, compression and confidence."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridfolio.functions import numeric, text

RRF_K = 60
#: Quality grades from low to high.
QUALITY = ["low", "medium", "high"]
RERANK_POOL = 40
#: Rows of one ranked list that are fused.
LIST_ROWS = 1_000
ROW_MATCH_BONUS = 0.05
SENTENCE_BUDGET, KEEP_SCORE, MIN_SENTENCES, MAX_SENTENCES, MIN_KEEP = 120, 0.30, 4, 6, 1
_CHUNK = ["chunk_id", "document_id", "store", "text"]


def prefiltered(df: DataFrame, currency: str | None = None, fiscal_year: str | None = None, table_category: str | None = None, numeric_only: bool = False, min_quality: str | None = None) -> DataFrame:
    """Rows by metadata before the search; an unknown quality is ignored."""
    for column, value in (("currency", currency), ("fiscal_year", fiscal_year), ("table_category", table_category)):
        if value is not None:
            df = df.where(F.col(column) == value)
    if numeric_only:
        df = df.where("has_numeric_data")
    if min_quality in QUALITY:
        df = df.where(F.col("extraction_quality").isin(QUALITY[QUALITY.index(min_quality) :]))
    return df


def of_documents(df: DataFrame, document_id: str | None = None, document_ids: list[str] | None = None) -> DataFrame:
    """Rows of one document, or of a list of them; of all without either."""
    df = df if document_id is None else df.where(F.col("document_id") == document_id)
    return df if document_ids is None else df.where(F.col("document_id").isin(*document_ids))


def of_completed(df: DataFrame, documents: DataFrame, status: str = "completed") -> DataFrame:
    """Rows of documents in a state: only what is completely ingested is searched."""
    return df.join(documents.where(F.col("status") == status).select("document_id"), "document_id", "left_semi")


def hybrid_tables(rows: DataFrame, tables: DataFrame, query: list[float], k: int) -> DataFrame:
    """Tables by their nearest row and by their own summary: both searches as one, each chunk at its smaller distance, cut to k."""
    return merged_hits(nearest(rows, query, k), nearest(tables, query, k), k)


def listed_chunks(chunks: DataFrame, document_id: str, store: str | None = None, page: int | None = None, number: int = 1, size: int = 50) -> DataFrame:
    """A page of a document's chunks in their order, of one store and one of its pages if asked for."""
    rows = of_documents(chunks, document_id)
    rows = rows if store is None else rows.where(F.col("store") == store)
    rows = rows if page is None else rows.where(F.col("page") == page)
    order = [c for c in ("store", "page", "chunk_index", "chunk_id") if c in rows.columns]
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def typed(df: DataFrame, document_types: list[str], column: str = "document_types") -> DataFrame:
    """Rows whose array of types has one of ``document_types``."""
    return df.where(F.arrays_overlap(F.col(column), F.array(*[F.lit(t) for t in document_types])))


def nearest(df: DataFrame, query: list[float], k: int, id_col: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """Exact top-k by cosine distance: one pass, each task keeps k rows. Vectors without length are left out; ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = df.withColumn("distance", numeric.cosine_distance(F.col(vector), q)).where("distance is not null")
    return scored.orderBy("distance", id_col).limit(k)


def nearest_per_store(df: DataFrame, query: list[float], k: int) -> DataFrame:
    """The nearest k of each store; the fan-out over stores is one window, after which all are ordered together."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = df.withColumn("distance", numeric.cosine_distance(F.col("embedding"), q)).where("distance is not null")
    rank = F.row_number().over(Window.partitionBy("store").orderBy("distance", "chunk_id"))
    return scored.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")


def merged_hits(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """Two searches of one store as one: each chunk at its smaller distance, cut to k."""
    return best_per_chunk(left.unionByName(right, allowMissingColumns=True), F.col("distance").asc()).orderBy("distance", "chunk_id").limit(k)


def best_per_chunk(df: DataFrame, order: Column | None = None) -> DataFrame:
    order = F.col("relevance").desc() if order is None else order
    rank = F.row_number().over(Window.partitionBy("chunk_id").orderBy(order, "document_id"))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def rrf(df: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank of each row within its store: rrf_score = 1 / (k + rank)."""
    rank = F.row_number().over(Window.partitionBy("store").orderBy("distance", "chunk_id"))
    return df.withColumn("rrf_score", 1 / (F.lit(k) + rank))


def fuse(lists: list[DataFrame], k: int = RRF_K, most: int = LIST_ROWS) -> DataFrame:
    """Ranked lists (chunk_id, document_id, store, text, distance) fused by summed reciprocal ranks.

    The best ``most`` rows of each list take part: a list is the top of a search, and its ranks are numbered in one task.
    A chunk in several lists keeps the longest of its texts and the smallest of its distances.
    """
    rank = F.row_number().over(Window.orderBy("distance", "chunk_id"))
    cut = [df.select(*_CHUNK, "distance").orderBy("distance", "chunk_id").limit(most) for df in lists]
    ranked = [df.withColumns({"part": 1 / (F.lit(k) + rank), "list": F.lit(i)}) for i, df in enumerate(cut)]
    rows = reduce(DataFrame.unionByName, ranked)
    richest = F.max_by(F.struct("document_id", "store", "text"), F.struct(F.length("text"), -F.col("list")))
    out = rows.groupBy("chunk_id").agg(F.sum("part").alias("fused_score"), F.min("distance").alias("distance"), richest.alias("r"))
    return out.select("chunk_id", "r.document_id", "r.store", "r.text", "distance", "fused_score")


def balanced_pool(df: DataFrame, cap: int, order: Column | None = None) -> DataFrame:
    """At most ``cap`` rows per store, best first; rows from the graph are exempt where the column says so; each chunk once."""
    once = best_per_chunk(df, F.col("distance").asc())
    rank = F.row_number().over(Window.partitionBy("store").orderBy(F.col("distance").asc() if order is None else order, "chunk_id"))
    exempt = F.coalesce(F.col("from_graph"), F.lit(False)) if "from_graph" in df.columns else F.lit(False)
    return once.withColumn("__rank", rank).where((F.col("__rank") <= cap) | exempt).drop("__rank")


def _with_range(df: DataFrame, column: str, by: list[str] | None) -> DataFrame:
    """Adds __lo and __hi of a column within its batch: aggregated per task and broadcast, so that no batch is gathered."""
    known = df.groupBy(*(by or [])).agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    if not by:
        return df.crossJoin(F.broadcast(known))
    keys = known.select(*[F.col(c).alias(f"__{c}") for c in by], "__lo", "__hi")
    return df.join(keys, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]).drop(*[f"__{c}" for c in by])


def minmax_relevance(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """relevance = 1 - (distance - min) / (max - min) within a batch, rounded to 4; equal distances give 1."""
    lo, hi = F.col("__lo"), F.col("__hi")
    shown = F.round(1 - (F.col("distance") - lo) / F.when(hi == lo, 1.0).otherwise(hi - lo), 4)
    return _with_range(df, "distance", by).withColumn("relevance", shown).drop("__lo", "__hi")


def blended_logits(df: DataFrame, logit: str = "logit", by: list[str] | None = None) -> DataFrame:
    """relevance = 0.3 sigmoid + 0.7 min-max of the logits of a batch, clamped to [0, 1] and rounded to 4."""
    lo, hi = F.col("__lo"), F.col("__hi")
    mixed = 0.3 * numeric.sigmoid(F.col(logit)) + 0.7 * (F.col(logit) - lo) / F.when(hi == lo, 1.0).otherwise(hi - lo)
    shown = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mixed)), 4)
    return _with_range(df, logit, by).withColumn("relevance", shown).drop("__lo", "__hi")


def lexical_logit(question: str, column: Column) -> Column:
    """The default scorer: the share of the question's words that a text has, as a logit in [-4, 4]."""
    from gridfolio.plans import binder

    wanted = F.array(*[F.lit(w) for w in sorted(set(binder.label(question).split()))])
    found = F.size(F.array_intersect(F.split(text.label(column), " "), wanted))
    return 8.0 * found / F.greatest(F.size(wanted), F.lit(1)) - 4.0


def rerank(df: DataFrame, question: str, k: int, scorer: Callable[[str, Column], Column] | None = None, pool: int = RERANK_POOL) -> DataFrame:
    """The best k of the ``pool`` nearest rows by a scorer of (question, text); matched table rows get a small bonus, up to 1."""
    nearest_rows = df.orderBy("distance", "chunk_id").limit(pool)
    scored = blended_logits(nearest_rows.withColumn("logit", (scorer or lexical_logit)(question, F.col("text"))))
    if "is_row_match" in df.columns:
        bonus = F.when(F.coalesce(F.col("is_row_match"), F.lit(False)), ROW_MATCH_BONUS).otherwise(0.0)
        scored = scored.withColumn("relevance", F.least(F.lit(1.0), F.col("relevance") + bonus))
    return scored.orderBy(F.col("relevance").desc(), "chunk_id").limit(k).drop("logit")


def compress(df: DataFrame, question: str, scorer: Callable[[str, Column], Column] | None = None) -> DataFrame:
    """compressed_text of prose chunks with at least MIN_SENTENCES sentences; null where a chunk stays whole.

    The first SENTENCE_BUDGET sentences, chunks in order, are scored; of a chunk those of at least KEEP_SCORE
    stay, MAX_SENTENCES at most and MIN_KEEP at least, in their own order.
    """
    prose = df.where(F.col("store").isin("vector_store", "clause_store")).select("chunk_id", text.prose_sentences(F.col("text")).alias("s"))
    flat = prose.where(F.size("s") >= MIN_SENTENCES).select("chunk_id", F.posexplode("s").alias("at", "sentence"))
    flat = flat.orderBy("chunk_id", "at").limit(SENTENCE_BUDGET)
    scored = flat.withColumn("score", numeric.sigmoid((scorer or lexical_logit)(question, F.col("sentence"))))
    rank = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.col("score").desc(), "at"))
    kept = scored.withColumn("rank", rank).where((F.col("rank") <= MAX_SENTENCES) & ((F.col("score") >= KEEP_SCORE) | (F.col("rank") <= MIN_KEEP)))
    joined = kept.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("at", "sentence"))).alias("k"))
    return df.join(joined.select("chunk_id", F.array_join(F.col("k.sentence"), " ").alias("compressed_text")), "chunk_id", "left")


def confidence(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """0.6 of the best relevance and 0.4 of the mean of the best three, clamped and rounded to 4."""
    keys = by or []
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("relevance").desc()))
    top = df.withColumn("__rank", rank).where("__rank <= 3").groupBy(*keys).agg(F.max("relevance").alias("best"), F.avg("relevance").alias("mean"))
    return top.withColumn("confidence", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 * F.col("best") + 0.4 * F.col("mean"))), 4))


def context(df: DataFrame, budget: int = 12_000) -> DataFrame:
    """Blocks in order of relevance within a budget of characters; the block that crosses it is cut: adds block.

    Every block has a character at least, so the budget bounds the rows that are summed in one task; blank ones are left out.
    """
    df = df.where(F.length("text") > 0).orderBy(F.col("relevance").desc(), "chunk_id").limit(budget)
    w = Window.orderBy(F.col("relevance").desc(), "chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length("text")).over(w), F.lit(0))
    return df.withColumn("used", used).where(F.col("used") < budget).withColumn("block", F.left("text", (F.lit(budget) - F.col("used")).cast("int"))).drop("used")


def rendered(df: DataFrame) -> DataFrame:
    """What a chunk shows in an answer: 2000 characters of a table, 1000 of an image, 600 of prose (its compressed text first)."""
    prose = F.coalesce(F.col("compressed_text"), F.col("text")) if "compressed_text" in df.columns else F.col("text")
    shown = F.when(F.col("store") == "table_store", F.left("text", F.lit(2000))).when(F.col("store") == "image_store", F.left("text", F.lit(1000)))
    return df.withColumn("shown", shown.otherwise(F.left(prose, F.lit(600))))


def centroids(df: DataFrame, by: str = "store", vector: str = "embedding") -> DataFrame:
    """The normalised mean vector of each store, one partial sum per dimension and task."""
    means = df.select(by, F.posexplode(vector).alias("dim", "x")).groupBy(by, "dim").agg(F.avg("x").alias("x"))
    v = F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"])
    out = means.groupBy(by).agg(v.alias("v"))
    return out.select(by, F.transform("v", lambda x: x / F.sqrt(numeric.dot(F.col("v"), F.col("v")))).alias("centroid"))


def multi_hop(retrieve: Callable[[list[str]], DataFrame], seeds: list[str], expand: Callable[[DataFrame], list[str]], hops: int = 2) -> DataFrame:
    """Retrieve for the seeds, mine the frontier from what was found and go on, at most ``hops`` times."""
    found, frontier, seen = retrieve(seeds), seeds, set(seeds)
    for _ in range(hops):
        frontier = [x for x in expand(found) if x not in seen]
        if not frontier:
            break
        seen.update(frontier)
        found = best_per_chunk(found.unionByName(retrieve(frontier)), F.col("distance").asc())
    return found
