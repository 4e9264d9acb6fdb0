"""Vector and keyword search, fusion, pooling, reranking and confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfolio.operators import keyword, retrieval, text_index, vector_index
from gridfolio.queries import query
from gridfolio.session import read_table, scratch_path

#: The question that the registered searches ask: the vector of this row.
ASKED = 0
_SCORED = f"""
    WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = {ASKED}), s AS (
        SELECT vec_id, label, 1 - list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS d FROM embeddings, q
    )
"""
_PER_STORE = _SCORED + ", r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(d, 9), vec_id) AS rank FROM s), k AS (SELECT * FROM r WHERE rank <= 20)"


def _chunks(spark, sf_dir) -> DataFrame:
    df = read_table(spark, sf_dir, "embeddings")
    return df.select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("document_id"), F.col("label").alias("store"), F.lit("").alias("text"), "embedding")


def _asked(spark, sf_dir) -> list[float]:
    return list(read_table(spark, sf_dir, "embeddings").where(F.col("vec_id") == ASKED).first()["embedding"])


def _per_store(spark, sf_dir) -> DataFrame:
    found = retrieval.nearest_per_store(_chunks(spark, sf_dir), _asked(spark, sf_dir), 20)
    return found.drop("embedding")


@query(_SCORED + "SELECT vec_id, round(d, 6) AS distance FROM s ORDER BY round(d, 9), vec_id LIMIT 25")
def ann_topk(spark, sf_dir):
    found = retrieval.nearest(_chunks(spark, sf_dir), _asked(spark, sf_dir), 25)
    return found.select(F.col("chunk_id").alias("vec_id"), F.round("distance", 6).alias("distance"))


@query(_SCORED + "SELECT vec_id, label, round(d, 6) AS distance FROM s WHERE label >= 5 ORDER BY round(d, 9), vec_id LIMIT 25")
def ann_prefiltered(spark, sf_dir):
    found = retrieval.nearest(_chunks(spark, sf_dir).where("store >= 5"), _asked(spark, sf_dir), 25)
    return found.select(F.col("chunk_id").alias("vec_id"), F.col("store").alias("label"), F.round("distance", 6).alias("distance"))


@query(_PER_STORE + "SELECT vec_id, label, round(d, 6) AS distance FROM k")
def ann_topk_per_store(spark, sf_dir):
    return _per_store(spark, sf_dir).select(F.col("chunk_id").alias("vec_id"), F.col("store").alias("label"), F.round("distance", 6).alias("distance"))


@query(_PER_STORE + "SELECT vec_id, round(1.0 / (60 + rank), 8) AS rrf_score FROM r")
def rrf_within_store(spark, sf_dir):
    found = retrieval.nearest_per_store(_chunks(spark, sf_dir), _asked(spark, sf_dir), 2**31 - 1)
    return retrieval.rrf(found).select(F.col("chunk_id").alias("vec_id"), F.round("rrf_score", 8).alias("rrf_score"))


@query(
    _PER_STORE
    + """, a AS (SELECT vec_id, 1.0 / (60 + row_number() OVER (ORDER BY round(d, 9), vec_id)) AS p FROM k), b AS (
           SELECT vec_id, 1.0 / (60 + row_number() OVER (ORDER BY label, vec_id)) AS p FROM s ORDER BY label, vec_id LIMIT 50
       ) SELECT coalesce(a.vec_id, b.vec_id) AS vec_id, round(coalesce(a.p, 0) + coalesce(b.p, 0), 8) AS fused_score FROM a FULL JOIN b ON a.vec_id = b.vec_id"""
)
def hybrid_rrf(spark, sf_dir):
    """Two ranked lists of a top-k each; the second stands for a keyword ranking."""
    other = _chunks(spark, sf_dir).withColumn("distance", F.col("store").cast("double")).orderBy("distance", "chunk_id").limit(50)
    fused = retrieval.fuse([_per_store(spark, sf_dir), other])
    return fused.select(F.col("chunk_id").alias("vec_id"), F.round("fused_score", 8).alias("fused_score"))


@query(_PER_STORE + "SELECT vec_id, label FROM k WHERE rank <= 8")
def balanced_pool(spark, sf_dir):
    return retrieval.balanced_pool(_per_store(spark, sf_dir), 8).select(F.col("chunk_id").alias("vec_id"), F.col("store").alias("label"))


@query(_PER_STORE + "SELECT vec_id, round(1 - (d - min(d) OVER ()) / (max(d) OVER () - min(d) OVER ()), 4) AS relevance FROM k")
def minmax_relevance(spark, sf_dir):
    found = retrieval.minmax_relevance(_per_store(spark, sf_dir))
    return found.select(F.col("chunk_id").alias("vec_id"), "relevance")


@query(
    _PER_STORE
    + """, l AS (SELECT vec_id, label, 4 - 8 * d AS x FROM k)
         SELECT vec_id, round(0.3 / (1 + exp(-x)) + 0.7 * (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w), 4) AS relevance FROM l WINDOW w AS (PARTITION BY label)"""
)
def blended_rerank_scores(spark, sf_dir):
    scored = _per_store(spark, sf_dir).withColumn("logit", 4 - 8 * F.col("distance"))
    return retrieval.blended_logits(scored, by=["store"]).select(F.col("chunk_id").alias("vec_id"), "relevance")


@query(
    _PER_STORE
    + """, t AS (SELECT label, 1 - d AS r, row_number() OVER (PARTITION BY label ORDER BY d) AS i FROM k)
         SELECT label, round(least(1, greatest(0, 0.6 * max(r) + 0.4 * avg(r))), 3) AS confidence FROM t WHERE i <= 3 GROUP BY label"""
)
def retrieval_confidence(spark, sf_dir):
    scored = _per_store(spark, sf_dir).withColumn("relevance", 1 - F.col("distance"))
    return retrieval.confidence(scored, ["store"]).select(F.col("store").alias("label"), F.round("confidence", 3).alias("confidence"))


@query(
    """WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings), m AS (SELECT label, dim, avg(x) AS x FROM e GROUP BY 1, 2),
            n AS (SELECT label, sqrt(sum(x * x)) AS norm FROM m GROUP BY 1)
       SELECT m.label, m.dim::INTEGER AS dim, round(m.x / n.norm, 5) AS x FROM m JOIN n ON m.label = n.label"""
)
def store_centroids(spark, sf_dir):
    df = read_table(spark, sf_dir, "embeddings")
    flat = retrieval.centroids(df, "label").select("label", F.posexplode("centroid").alias("dim", "x"))
    return flat.select("label", (F.col("dim") + 1).cast("int").alias("dim"), F.round("x", 5).alias("x"))


_STEM = """CASE WHEN {w} LIKE '%ies' AND length({w}) >= 6 THEN left({w}, length({w}) - 3) || 'y'
                WHEN {w} LIKE '%ing' AND length({w}) >= 6 THEN left({w}, length({w}) - 3)
                WHEN {w} LIKE '%ed' AND length({w}) >= 5 THEN left({w}, length({w}) - 2)
                WHEN {w} LIKE '%ss' THEN {w}
                WHEN {w} LIKE '%es' AND length({w}) >= 5 THEN left({w}, length({w}) - 2) || 'e'
                WHEN {w} LIKE '%s' AND length({w}) >= 4 THEN left({w}, length({w}) - 1) ELSE {w} END"""
_STOPS = ", ".join(f"'{w}'" for w in sorted(keyword.STOP_WORDS))
_TOKENS = f"""
    WITH w AS (
        SELECT doc_id, lang, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS w,
               generate_subscripts(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), 1) - 1 AS pos FROM documents
    ), t AS (SELECT doc_id, lang, pos, {_STEM.format(w="w")} AS term FROM w WHERE w NOT IN ({_STOPS}))
"""


@query(
    _TOKENS
    + """, h AS (SELECT doc_id, lang, pos, pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS gap, term FROM t WHERE term IN ('license', 'apache')),
         m AS (SELECT doc_id, lang, sum(CASE WHEN gap IS NULL THEN 1.0 ELSE 1.0 / (1.0 + gap) END) AS rank FROM h GROUP BY 1, 2 HAVING count(DISTINCT term) = 2),
         k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(rank, 9) DESC, doc_id) AS i FROM m)
       SELECT doc_id, lang, round(rank, 6) AS rank, round(1 - rank / max(rank) OVER (PARTITION BY lang), 6) AS distance FROM k WHERE i <= 20"""
)
def keyword_topk(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    found = keyword.search(docs, "apache licenses", 20, by="lang", id_col="doc_id")
    return found.select("doc_id", "lang", F.round("rank", 6).alias("rank"), F.round("distance", 6).alias("distance"))


@query(
    _TOKENS
    + """SELECT DISTINCT d.doc_id FROM documents d WHERE
         ((d.doc_id IN (SELECT doc_id FROM t WHERE term = 'license') AND d.doc_id IN (SELECT doc_id FROM t WHERE term = 'version')) OR d.doc_id IN (SELECT doc_id FROM t WHERE term = 'idiot'))
         AND d.doc_id NOT IN (SELECT doc_id FROM t WHERE term = 'moron')"""
)
def keyword_boolean(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    asked = keyword.parse("license version or idiot -moron")
    return docs.where(keyword.may_match(F.col("text"), asked)).where(keyword.matches(keyword.tokens(F.col("text")), asked)).select("doc_id")


@query(_TOKENS + "SELECT lang AS store, term, doc_id AS chunk_id, count(*) AS n, min(pos) AS first FROM t GROUP BY 1, 2, 3")
def inverted_index(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("store"), "text")
    index = keyword.inverted_index(docs)
    return index.select("store", "term", "chunk_id", F.size("positions").cast("long").alias("n"), F.element_at("positions", 1).cast("long").alias("first"))


@query(
    """WITH o AS (SELECT item_id, text, coalesce(sum(length(text)) OVER (ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM benchmark)
       SELECT item_id, left(text, (3000 - used)::BIGINT) AS block FROM o WHERE used < 3000"""
)
def context_within_budget(spark, sf_dir):
    rows = read_table(spark, sf_dir, "benchmark").select("item_id", F.col("item_id").alias("chunk_id"), "text", (-F.col("item_id")).alias("relevance"))
    return retrieval.context(rows, 3000).select("item_id", "block")


def _texts(spark, sf_dir, analyser: str) -> text_index.TextIndex:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("store"), "text")
    return text_index.TextIndex.build(docs, scratch_path(spark, "texts"), analyser=analyser)


@query(_TOKENS + "SELECT lang AS store, term, doc_id AS id, count(*) AS n, min(pos) AS first, max(pos) AS last FROM t GROUP BY 1, 2, 3")
def text_index_postings(spark, sf_dir):
    """What is stored, read back."""
    found = _texts(spark, sf_dir, "light").postings()
    return found.select("store", "term", "id", F.size("positions").cast("long").alias("n"), F.element_at("positions", 1).cast("long").alias("first"), F.element_at("positions", -1).cast("long").alias("last"))


#: The English stems of the words of these texts that begin so.
_ENGLISH = _TOKENS.replace(_STEM.format(w="w"), "CASE WHEN w IN ('license', 'licenses', 'licensed', 'licensing') THEN 'licens' WHEN w = 'apache' THEN 'apach' ELSE w END")


@query(
    _ENGLISH
    + """, h AS (SELECT doc_id, lang, pos, pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS gap, term FROM t WHERE term IN ('licens', 'apach')),
         m AS (SELECT doc_id, lang, sum(CASE WHEN gap IS NULL THEN 1.0 ELSE 1.0 / (1.0 + gap) END) AS rank FROM h GROUP BY 1, 2 HAVING count(DISTINCT term) = 2),
         k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(rank, 9) DESC, doc_id) AS i FROM m)
       SELECT doc_id, lang, round(rank, 6) AS rank, round(1 - rank / max(rank) OVER (PARTITION BY lang), 6) AS distance FROM k WHERE i <= 20"""
)
def text_index_topk(spark, sf_dir):
    """All forms of a word by its English stem, ranked from stored postings."""
    found = _texts(spark, sf_dir, "english").search("apache licensing", 20)
    return found.select(F.col("id").alias("doc_id"), F.col("store").alias("lang"), F.round("rank", 6).alias("rank"), F.round("distance", 6).alias("distance"))


_NEIGHBOURS = """
    WITH s AS (
        SELECT q.vec_id AS question_id, e.vec_id, 1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS d
        FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0
    ), r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(d, 9), vec_id) AS rank FROM s)
"""


def _indexed(spark, sf_dir) -> tuple[vector_index.VectorIndex, DataFrame]:
    """An index of all embeddings, and the questions: every vector whose id is divisible by 20."""
    df = read_table(spark, sf_dir, "embeddings")
    asked = df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), "embedding")
    return vector_index.VectorIndex.build(df, scratch_path(spark, "vectors"), id_col="vec_id"), asked


@query(_NEIGHBOURS + "SELECT question_id, rank::INTEGER AS rank, vec_id, round(d, 6) AS distance FROM r WHERE rank <= 10")
def vector_index_all_cells(spark, sf_dir):
    """With all cells probed the index gives the exact neighbours."""
    index, asked = _indexed(spark, sf_dir)
    return index.search(asked, 10, len(index.centres)).select("question_id", "rank", "vec_id", F.round("distance", 6).alias("distance"))


@query(_NEIGHBOURS + "SELECT count(DISTINCT question_id) AS n_questions, true AS recalled, true AS pruned FROM r")
def vector_index_recall(spark, sf_dir):
    """With the cells that the index chose itself: whether 95 % of all neighbours are found, and not all rows were read for it."""
    index, asked = _indexed(spark, sf_dir)
    exact, found = index.search(asked, 10, len(index.centres)), index.search(asked, 10)
    hit = exact.join(found.select("question_id", "vec_id", F.lit(1).alias("hit")), ["question_id", "vec_id"], "left")
    return hit.agg(
        F.count_distinct("question_id").alias("n_questions"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.95).alias("recalled"), F.lit(index.probes < len(index.centres)).alias("pruned")
    )
