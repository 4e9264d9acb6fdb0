"""Functions and row-wise operators over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridfolio.functions import nested, numeric, text
from gridfolio.operators import chunking, graph, ingest, keyword, retrieval, rows
from gridfolio.queries import query
from gridfolio.session import read_table

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\f\x0b]+'), lambda x: x <> '')"


@query(r"SELECT doc_id, lower(trim(regexp_replace(coalesce(source, ''), '\s+', ' ', 'g'))) AS source_key, md5(lower(trim(regexp_replace(left(text, 40), '\s+', ' ', 'g')))) AS text_key FROM documents")
def canonical_keys(spark, sf_dir):
    head = text.canonical_key(F.left("text", F.lit(40)))
    return read_table(spark, sf_dir, "documents").select("doc_id", text.canonical_key(F.col("source")).alias("source_key"), F.when(F.col("text").isNotNull(), F.md5(head)).alias("text_key"))


@query("SELECT p_partkey, 'Context: ' || p_brand || ' > ' || p_name || chr(10) || chr(10) AS prefix FROM part")
def context_prefixes(spark, sf_dir):
    return read_table(spark, sf_dir, "part").select("p_partkey", text.context_prefix(F.array("p_brand", "p_name")).alias("prefix"))


@query("SELECT s_suppkey, 'key: ' || s_suppkey || '; name: ' || s_name || '; col_2: ' || s_nationkey AS line FROM supplier")
def serialized_rows(spark, sf_dir):
    """Two headers over three cells: the last is named by its place."""
    s = read_table(spark, sf_dir, "supplier")
    cells = F.array(F.col("s_suppkey").cast("string"), "s_name", F.col("s_nationkey").cast("string"))
    return s.select("s_suppkey", text.serialize_row(F.array(F.lit("key"), F.lit("name")), cells).alias("line"))


@query("SELECT s_suppkey, 'name: ' || s_name || ' | nation: ' || s_nationkey AS line FROM supplier")
def row_texts(spark, sf_dir):
    s = read_table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", text.row_text(F.create_map(F.lit("name"), F.col("s_name"), F.lit("nation"), F.col("s_nationkey").cast("string"))).alias("line"))


@query("SELECT doc_id, md5(CASE WHEN length(text) > 500 THEN left(text, 500) || chr(10) || '[truncated]' ELSE text END) AS bounded FROM documents")
def bounded_texts(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", F.md5(text.bounded(F.col("text"), 500)).alias("bounded"))


@query(
    r"""SELECT doc_id, md5(CASE WHEN length(text) <= 600 THEN text
               ELSE concat_ws(chr(10) || '...' || chr(10), left(text, 200), substr(text, length(text) // 2 - 99, 200), right(text, 200)) END) AS sample FROM documents"""
)
def sampled_texts(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", F.md5(text.sampled(F.col("text"), 200)).alias("sample"))


@query(f"SELECT doc_id, array_to_string({_WORDS}[1:20], ' ') AS head FROM documents")
def truncated_texts(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", text.truncated_words(F.col("text"), 20).alias("head"))


@query(r"SELECT item_id, 't:' || left(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 120) AS by_text, 'n:' || item_id AS by_number FROM benchmark")
def clause_fingerprints(spark, sf_dir):
    b = read_table(spark, sf_dir, "benchmark")
    return b.select("item_id", text.fingerprint(F.lit(None).cast("string"), F.col("text")).alias("by_text"), text.fingerprint(F.col("item_id").cast("string"), F.col("text")).alias("by_number"))


def _has(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_OPEN = r"^(\d+(?:\.\d+)*\.?|[IVXLCDM]+[.)]|\([a-zA-Z0-9]+\))\s+(.*)"
_TOPIC = "CASE " + " ".join(f"WHEN {_has('low', words)} THEN '{name}'" for name, words in text.CLAUSE_KEYWORDS.items()) + " END"


@query(
    rf"""WITH a AS (SELECT doc_id, trim(coalesce(text, '')) AS body FROM documents), b AS (
            SELECT doc_id, body, lower(body) AS low, trim(split_part(body, chr(10), 1)) AS line FROM a
        ), c AS (
            SELECT *, regexp_extract(line, '{_OPEN}', 1) AS label, regexp_extract(line, '{_OPEN}', 2) AS rest,
                   regexp_extract(line, '(?i)^(?:Article|Section|Clause|Schedule|Annexure|Exhibit|Provision)\s+(\S*[\w.]\S*)', 1) AS named, {_TOPIC} AS topic FROM b
        ), d AS (
            SELECT *, CASE WHEN label <> '' THEN regexp_replace(label, '\.+$', '') WHEN named <> '' THEN named END AS nr,
                   CASE WHEN label <> '' THEN CASE WHEN length(rest) > 80 THEN regexp_replace(left(rest, 80), '\s+\S*$', '') ELSE rest END WHEN named <> '' THEN left(line, 80) END AS heading
            FROM c
        ), e AS (
            SELECT *, (topic IS NOT NULL AND (nr IS NOT NULL OR regexp_matches(line, '{text.CLAUSE_START}'))) OR {_has("low", text.STRONG_PHRASES)} AS is_clause FROM d
        )
        SELECT doc_id, is_clause, CASE WHEN is_clause THEN nr END AS number, CASE WHEN is_clause THEN heading END AS title,
               CASE WHEN is_clause THEN coalesce(topic, 'general') ELSE 'general' END AS type FROM e"""
)
def clause_detection(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.clause(F.col("text"), F.lit(None).cast("string")).alias("c")).select("doc_id", "c.*")


#: Letters beyond ASCII are word characters and no part of an entity: an underscore stands for each.
_LETTERS = r"regexp_replace(coalesce(text, ''), '[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2FF}\x{370}-\x{1FFF}\x{2C00}-\x{2DFF}\x{3040}-\x{D7FF}]', '_', 'g')"
_STOPS = "(" + ", ".join(f"'{w}'" for w in graph.STOP_ENTITIES) + ")"
_NAME = graph.CAPITALISED.replace("'", "''")


@query(
    rf"""WITH m AS (SELECT doc_id, list_transform(regexp_extract_all({_LETTERS}, '\b{_NAME}(?:\s+{_NAME}){{0,5}}\b'), lambda x: trim(x, ' .')) AS names FROM documents),
             k AS (SELECT doc_id, list_transform(names, lambda x: lower(trim(regexp_replace(x, '\s+', ' ', 'g')))) AS keys, names FROM m),
             f AS (SELECT doc_id, keys[i] AS entity_key, names[i] AS name, i FROM (SELECT *, unnest(range(1, len(keys) + 1)) AS i FROM k)),
             o AS (SELECT doc_id, entity_key, min(i) AS first, arg_min(name, i) AS name FROM f WHERE entity_key NOT IN {_STOPS} AND entity_key <> '' GROUP BY 1, 2),
             r AS (SELECT doc_id AS id, entity_key, name, (row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1)::INTEGER AS position FROM o)
        SELECT * FROM r WHERE position < {graph.MAX_ENTITIES}"""
)
def entity_mentions(spark, sf_dir):
    return graph.mentions(read_table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 >= 0.8 THEN 'high' WHEN l_discount * 10 >= 0.5 THEN 'medium' ELSE 'low' END AS quality,
              round(greatest(0.0, least(1.0, l_quantity / 40 - 0.1)), 6) AS clamped FROM lineitem"""
)
def quality_buckets(spark, sf_dir):
    lines = read_table(spark, sf_dir, "lineitem")
    shown = F.round(numeric.clamp(F.col("l_quantity") / 40 - 0.1), 6)
    return lines.select("l_orderkey", "l_linenumber", numeric.quality_bucket(F.col("l_discount") * 10).alias("quality"), shown.alias("clamped"))


@query(
    r"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS cell FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, count(*) AS n_cells,
               count(*) FILTER (regexp_matches(regexp_replace(cell, '[$€£₹%,\s]', '', 'g'), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$')) AS n_numeric FROM w GROUP BY 1"""
)
def numeric_cells(spark, sf_dir):
    cells = read_table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.explode(F.split("text", r"\s+")).alias("cell"))
    return cells.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(numeric.is_numeric(F.col("cell"))).alias("n_numeric"))


@query(
    """WITH g AS (SELECT l_orderkey, list(DISTINCT l_returnflag ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1)
       SELECT l_orderkey, array_to_string(CASE WHEN list_contains(flags, 'N') THEN flags ELSE flags || ['N'] END, ',') AS flags, coalesce(flags[2], 'none') AS second FROM g"""
)
def list_append_and_default(spark, sf_dir):
    flags = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_returnflag")).alias("f"))
    return flags.select("l_orderkey", F.array_join(nested.append_absent(F.col("f"), F.lit("N")), ",").alias("flags"), nested.at_or(F.col("f"), F.lit(1), F.lit("none")).alias("second"))


@query(
    """WITH r AS (SELECT (row_number() OVER (ORDER BY p_partkey) - 1) AS i, p_size AS page FROM part), n AS (SELECT count(*) AS n FROM part)
       SELECT (i // greatest(25, ceil(n / 200.0)::BIGINT))::INTEGER AS window_index, min(page) AS page_start, max(page) AS page_end FROM r, n GROUP BY 1"""
)
def window_page_ranges(spark, sf_dir):
    """The pages that the rows of each window come from."""
    part = read_table(spark, sf_dir, "part")
    relation = rows.from_frame(part.select("p_partkey", "p_name", "p_size"), "part", ["p_partkey"]).withColumn("row_text", F.col("row_data")["p_name"])
    row_pages = relation.select("table_id", "row_index", F.col("row_data")["p_size"].cast("int").alias("page_number"))
    return rows.page_of_windows(rows.windows(relation), row_pages).select("window_index", "page_start", "page_end")


_LINES = r"SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL"


@query(
    rf"""WITH l AS ({_LINES}), p AS (SELECT doc_id, (pos - 1) // 10 + 1 AS page, line FROM l)
        SELECT doc_id AS document_id, page, count(*) AS n_blocks, sum(len(list_filter(regexp_split_to_array(line, '[ \t\n\r\f\x0b]+'), lambda x: x <> '')))::BIGINT AS n_words, sum(length(line))::BIGINT AS n_chars
        FROM p GROUP BY 1, 2"""
)
def page_breakdowns(spark, sf_dir):
    """Lines as blocks, ten a page."""
    docs = read_table(spark, sf_dir, "documents").where("text IS NOT NULL")
    blocks = docs.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("at", "text"))
    return ingest.page_breakdown(blocks.withColumn("page", F.expr("at div 10 + 1")))


@query(
    """WITH s AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN text END AS heading FROM conversations)
       SELECT conv_id, turn, last_value(heading IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, text) AS section FROM (SELECT s.*, c.text FROM s JOIN conversations c USING (conv_id, turn))"""
)
def carried_sections(spark, sf_dir):
    """The last question at or before each turn."""
    items = read_table(spark, sf_dir, "conversations").withColumn("kind", F.when(F.col("role") == "user", "heading").otherwise("text"))
    return chunking.carried_sections(items, "conv_id", "turn").select("conv_id", "turn", "section")


@query("SELECT conv_id, turn, (1 + sum((role = 'user')::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn))::INTEGER AS page_number FROM conversations")
def pages_by_breaks(spark, sf_dir):
    items = read_table(spark, sf_dir, "conversations").withColumn("is_break", F.col("role") == "user")
    return chunking.pages_from_breaks(items, "conv_id", "turn").select("conv_id", "turn", "page_number")


@query("SELECT vec_id AS chunk_id, label::VARCHAR AS store, left('x' || label || ' ' || vec_id, 2000) AS shown FROM embeddings")
def rendered_chunks(spark, sf_dir):
    df = read_table(spark, sf_dir, "embeddings")
    chunks = df.select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("store"), F.concat(F.lit("x"), "label", F.lit(" "), "vec_id").alias("text"))
    return retrieval.rendered(chunks).select("chunk_id", "store", "shown")


@query(
    """SELECT doc_id, source, (SELECT count(*) FROM documents) AS n FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source HAVING count(*) >= 20)"""
)
def of_large_sources(spark, sf_dir):
    """Documents of sources in a state: those with twenty documents or more."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("document_id"))
    state = docs.groupBy("document_id").agg(F.when(F.count(F.lit(1)) >= 20, "completed").otherwise("failed").alias("status"))
    kept = retrieval.of_completed(docs, state)
    return kept.crossJoin(F.broadcast(docs.agg(F.count(F.lit(1)).alias("n")))).select("doc_id", F.col("document_id").alias("source"), "n")


@query("SELECT doc_id, lang FROM documents WHERE source = 'web' ORDER BY lang, doc_id LIMIT 50 OFFSET 50")
def second_page_of_a_source(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("source").alias("document_id"))
    return retrieval.listed_chunks(docs.withColumnsRenamed({"lang": "store", "doc_id": "chunk_id"}), "web", number=2).select(F.col("chunk_id").alias("doc_id"), F.col("store").alias("lang"))


@query(
    """WITH e AS (SELECT l_suppkey AS s, l_partkey AS p, count(*) AS w FROM lineitem GROUP BY 1, 2), x AS (SELECT 's' || s AS k, count(DISTINCT p) AS n FROM e GROUP BY 1)
       SELECT k AS entity_key, n AS doc_count FROM x UNION ALL SELECT 'none', 0"""
)
def entities_without_documents(spark, sf_dir):
    lines = read_table(spark, sf_dir, "lineitem")
    log = lines.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("entity_key"), F.col("l_partkey").alias("document_id"))
    nodes = log.select("entity_key").distinct().unionByName(spark.createDataFrame([("none",)], ["entity_key"]))
    return graph.listing(nodes, log)


@query(
    """WITH c AS (SELECT c_nationkey AS community, c_name AS name FROM customer), s AS (SELECT community, count(*) AS size, list_sort(list(name))[1:10] AS m FROM c GROUP BY 1 HAVING count(*) >= 3)
       SELECT community, size, 'Contains ' || size || ' related entities: ' || array_to_string(m, ', ') AS summary FROM s ORDER BY size DESC, community LIMIT 40"""
)
def community_summaries(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    groups = c.select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("community"))
    return graph.summaries(groups, c.select(F.col("c_custkey").alias("entity_key"), F.col("c_name").alias("name")))


@query(
    """WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)
       SELECT vec_id AS community, round(1 - list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS distance FROM embeddings, q ORDER BY round(distance, 6), vec_id LIMIT 12"""
)
def communities_by_vector(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    asked = list(e.where("vec_id = 0").first()["embedding"])
    found = graph.communities_by_vector(e.select(F.col("vec_id").alias("community"), "embedding"), asked, 12)
    return found.select("community", F.round("distance", 6).alias("distance"))


@query(
    """WITH a AS (SELECT DISTINCT l_orderkey AS o, 's' || l_suppkey AS k FROM lineitem WHERE l_suppkey <= 3), h AS (SELECT o, min(CASE k WHEN 's1' THEN 0 WHEN 's2' THEN 1 ELSE 2 END) AS hop FROM a GROUP BY 1)
       SELECT o AS chunk_id, hop::INTEGER AS hop, round(1.0 / (1 + hop), 6) AS score FROM h ORDER BY hop, o LIMIT 40"""
)
def chunks_in_reach(spark, sf_dir):
    lines = read_table(spark, sf_dir, "lineitem")
    log = lines.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("entity_key"), F.col("l_orderkey").alias("chunk_id"))
    reached = spark.createDataFrame([("s1", 0), ("s2", 1), ("s3", 2)], "node string, hop int")
    return graph.chunks_in_reach(reached, log, 40).select("chunk_id", "hop", F.round("score", 6).alias("score"))


@query(
    """SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN o_custkey END AS o_custkey FROM orders WHERE o_custkey % 5 <> 0
       UNION ALL SELECT o_orderkey + 10000000, o_custkey FROM orders WHERE o_custkey % 5 = 0"""
)
def replaced_parents(spark, sf_dir):
    """Delete-then-insert: customers that come again lose their old orders; a second change sets some parents to null."""
    from gridfolio.operators import catalog

    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    new = orders.where("o_custkey % 5 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000)
    old = catalog.replaced(orders, new, "o_custkey")
    return old.withColumn("o_custkey", F.when((F.col("o_custkey") % 2 == 0) | (F.col("o_custkey") % 5 == 0), F.col("o_custkey")))


@query(
    """WITH w AS (SELECT vec_id, label, 1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]) AS d FROM embeddings),
            t AS (SELECT * FROM w WHERE label < 3 ORDER BY round(d, 9), vec_id LIMIT 15), p AS (SELECT * FROM w WHERE label < 6 ORDER BY round(d, 9), vec_id LIMIT 15)
       SELECT vec_id AS chunk_id, round(min(d), 6) AS distance FROM (SELECT * FROM t UNION ALL SELECT * FROM p) GROUP BY 1 ORDER BY min(round(d, 9)), 1 LIMIT 15"""
)
def hybrid_table_search(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    chunks = e.select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("document_id"), F.col("label"), "embedding")
    asked = list(e.where("vec_id = 0").first()["embedding"])
    found = retrieval.hybrid_tables(chunks.where("label < 3"), chunks.where("label < 6"), asked, 15)
    return found.select("chunk_id", F.round("distance", 6).alias("distance"))


@query(
    """WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
            f AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM t)
       SELECT doc_id, count(*) AS n_tokens, max(pos)::INTEGER AS last FROM f WHERE word NOT IN """
    + "(" + ", ".join(f"'{w}'" for w in sorted(keyword.STOP_WORDS)) + ") GROUP BY 1"
)
def indexed_positions(spark, sf_dir):
    """Totals of the stored index: every word that isn't a stop word has its place."""
    index = keyword.inverted_index(read_table(spark, sf_dir, "documents"), "source", "doc_id", "text")
    return index.groupBy("doc_id").agg(F.sum(F.size("positions")).alias("n_tokens"), F.max(F.array_max("positions")).alias("last"))


@query(
    """WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
       SELECT conv_id, turn, n::INTEGER AS ordinal FROM c WHERE n <= 3"""
)
def joined_by_ordinal(spark, sf_dir):
    """Two lists joined by key and ordinal, never by their order."""
    turns = read_table(spark, sf_dir, "conversations")
    numbered = turns.select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("ordinal"))
    ordinals = turns.select("conv_id").distinct().select("conv_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("ordinal"))
    return numbered.join(ordinals, ["conv_id", "ordinal"]).select("conv_id", "turn", "ordinal")
