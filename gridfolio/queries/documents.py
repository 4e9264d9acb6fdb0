"""Document dataflow: blocks, sentences, chunks, keywords, clauses, enrichment, reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridfolio.functions import dates, numeric, text
from gridfolio.operators import chunking, enrichment, images
from gridfolio.queries import query
from gridfolio.session import read_table
from gridfolio.sources import documents as sources


@query(
    r"""WITH b AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<(script|style)\b[^>]*>.*?</(script|style)>', ' ', 'g') AS h FROM pages),
             l AS (SELECT page_id, string_split(regexp_replace(regexp_replace(h, '(?i)</?(p|div|li|h[1-6]|tr|ul|ol|table|section|article|nav|footer|header|title|body|head|html)\b[^>]*>|<br\s*/?>', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)) AS parts FROM b),
             f AS (SELECT page_id, list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, '[ \t\r\f]+', ' ', 'g'))), lambda x: x <> '') AS parts FROM l)
        SELECT page_id, (generate_subscripts(parts, 1) - 1)::INTEGER AS position, unnest(parts) AS text FROM f"""
)
def html_text_blocks(spark, sf_dir):
    return sources.html_blocks(read_table(spark, sf_dir, "pages"))


_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


@query(f"SELECT doc_id, len({_SENTENCES})::BIGINT AS n_sentences, coalesce(list_max(list_transform({_SENTENCES}, lambda s: length(s))), 0)::BIGINT AS longest FROM documents")
def sentence_split(spark, sf_dir):
    s = text.sentences(F.col("text"))
    rows = read_table(spark, sf_dir, "documents").select("doc_id", s.alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).cast("long").alias("longest"))


@query()
def text_chunks(spark, sf_dir):
    return chunking.chunks(read_table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    """WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]{3,}') AS w FROM documents),
            t AS (SELECT doc_id, unnest(w) AS term, (generate_subscripts(w, 1) - 1) * 2 AS place FROM w
                  UNION ALL SELECT doc_id, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])), (generate_subscripts(w[2:], 1) - 1) * 2 + 1 FROM w WHERE len(w) > 1),
            c AS (SELECT doc_id, term, count(*) AS n, min(place) AS first FROM t GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM c)
       SELECT doc_id AS id, term, n, rank::INTEGER AS rank FROM r WHERE rank <= 10"""
)
def chunk_keywords(spark, sf_dir):
    return chunking.keywords(read_table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings),
            d AS (SELECT vec_id, label, CASE WHEN p IS NOT NULL THEN 1 - list_cosine_similarity(v, p) END AS d FROM e), q AS (SELECT label, quantile_cont(d, 0.95) AS q FROM d GROUP BY 1)
       SELECT vec_id, d.label, round(d, 5) AS distance, (sum(CASE WHEN d > q THEN 1 ELSE 0 END) OVER (PARTITION BY d.label ORDER BY vec_id))::BIGINT AS segment FROM d JOIN q ON d.label = q.label"""
)
def semantic_breakpoints(spark, sf_dir):
    df = chunking.sentence_distances(read_table(spark, sf_dir, "embeddings"), "label", "vec_id")
    return chunking.breakpoints(df, "label", "vec_id").select("vec_id", "label", F.round("distance", 5).alias("distance"), "segment")


@query(
    r"""SELECT doc_id, CASE regexp_extract(text, '[$€£₹]') WHEN '$' THEN 'USD' WHEN '€' THEN 'EUR' WHEN '£' THEN 'GBP' WHEN '₹' THEN 'INR'
                      ELSE nullif(regexp_extract(text, '\b(USD|EUR|GBP|INR)\b', 1), '') END AS currency,
               CASE WHEN length(regexp_extract(text, '(?i)\bFY\s?(\d{2,4})\b', 1)) = 2 THEN 'FY20' || regexp_extract(text, '(?i)\bFY\s?(\d{2,4})\b', 1)
                    WHEN regexp_extract(text, '(?i)\bFY\s?(\d{2,4})\b', 1) <> '' THEN 'FY' || regexp_extract(text, '(?i)\bFY\s?(\d{2,4})\b', 1)
                    WHEN regexp_extract(text, '(?i)(?:fiscal|year)\D{0,10}\b((?:19|20)\d{2})\b', 1) <> '' THEN 'FY' || regexp_extract(text, '(?i)(?:fiscal|year)\D{0,10}\b((?:19|20)\d{2})\b', 1)
                    WHEN regexp_extract(text, '(?i)\b((?:19|20)\d{2})\b\D{0,10}(?:fiscal|year)', 1) <> '' THEN 'FY' || regexp_extract(text, '(?i)\b((?:19|20)\d{2})\b\D{0,10}(?:fiscal|year)', 1) END AS fiscal_year
        FROM documents"""
)
def enrich_currency_fiscal_year(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", enrichment.currency(F.col("text")).alias("currency"), dates.fiscal_year(F.col("text")).alias("fiscal_year"))


@query(
    r"""SELECT doc_id, len(n)::BIGINT AS n_numbers, round(coalesce(list_sum(list_transform(n, lambda x: log10(1 + x))), 0), 3) AS log_sum FROM
        (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[0-9][0-9,]*(?:\.[0-9]+)?'), lambda x: replace(x, ',', '')::DOUBLE)) AS n FROM documents)"""
)
def numeric_token_sets(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents").select("doc_id", numeric.numeric_tokens(F.col("text")).alias("n"))
    total = F.aggregate("n", F.lit(0.0), lambda a, x: a + F.log10(1 + x))
    return rows.select("doc_id", F.size("n").cast("long").alias("n_numbers"), F.round(total, 3).alias("log_sum"))


def _type_sql() -> str:
    parts = [
        f"SELECT doc_id, '{t}' AS type, {i} AS ord, " + " + ".join("(contains(lower(coalesce(text, '')), '" + w + "'))::INTEGER" for w in words) + " AS n FROM documents"
        for i, (t, words) in enumerate(enrichment.TYPE_WORDS.items())
    ]
    return f"""WITH s AS ({" UNION ALL ".join(parts)}), m AS (SELECT doc_id, max(n) AS m FROM s GROUP BY 1)
        SELECT s.doc_id, CASE WHEN any_value(m) = 0 THEN 'policy' WHEN max(CASE WHEN n >= greatest(2, floor(m * 0.5)) THEN 1 ELSE 0 END) = 1
               THEN string_agg(CASE WHEN n >= greatest(2, floor(m * 0.5)) THEN type END, ',' ORDER BY ord) ELSE arg_min(type, ord) FILTER (n = m) END AS types,
               round(least(0.9, 0.4 + 0.05 * any_value(m)), 4)::DOUBLE AS confidence FROM s JOIN m ON s.doc_id = m.doc_id GROUP BY s.doc_id"""


@query(_type_sql())
def document_type_rules(spark, sf_dir):
    out = enrichment.document_types(read_table(spark, sf_dir, "documents"), "text")
    return out.select("doc_id", F.array_join("document_types", ",").alias("types"), F.round("type_confidence", 4).alias("confidence"))


@query(
    r"""WITH n AS (SELECT doc_id, lang, list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[0-9][0-9,]*(?:\.[0-9]+)?'), lambda x: replace(x, ',', '')::DOUBLE)) AS n FROM documents)
        SELECT a.doc_id, b.item_id, len(list_filter(a.n, lambda x: NOT list_contains(b.n, x)))::BIGINT AS n_unseen
        FROM n a JOIN (SELECT item_id, list_distinct(list_transform(regexp_extract_all(text, '[0-9][0-9,]*(?:\.[0-9]+)?'), lambda x: replace(x, ',', '')::DOUBLE)) AS n FROM benchmark) b ON a.doc_id = b.item_id"""
)
def unseen_numbers(spark, sf_dir):
    a = read_table(spark, sf_dir, "documents").select("doc_id", numeric.numeric_tokens(F.col("text")).alias("a"))
    b = read_table(spark, sf_dir, "benchmark").select("item_id", numeric.numeric_tokens(F.col("text")).alias("b"))
    return a.join(b, a["doc_id"] == b["item_id"]).select("doc_id", "item_id", F.size(F.array_except("a", "b")).cast("long").alias("n_unseen"))


_HASH = "list_sum(list_transform(range(1, 17), lambda i: CASE WHEN embedding[i] > 0 THEN (2::HUGEINT ** (i - 1))::BIGINT ELSE 0 END))::BIGINT"


@query(
    f"""WITH h AS (SELECT label, vec_id, {_HASH} AS h FROM embeddings)
        SELECT b.label, b.vec_id, min(a.vec_id) AS duplicate_of FROM h a JOIN h b ON a.label = b.label AND a.vec_id < b.vec_id AND bit_count(xor(a.h, b.h)) <= 5 GROUP BY 1, 2"""
)
def near_duplicate_hamming(spark, sf_dir):
    bits = F.transform(F.slice("embedding", 1, 16), lambda x, i: F.when(x > 0, F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long")))
    hashed = read_table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("document_id"), F.col("vec_id").alias("image_index"), F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a + x).alias("ahash")
    )
    return images.duplicates(hashed).select(F.col("document_id").alias("label"), F.col("image_index").alias("vec_id"), "duplicate_of")


@query("SELECT doc_id, greatest(1, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0b]+'), lambda w: w <> '')))::INTEGER AS n_words FROM documents")
def approximate_word_count(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("n_words"))
