"""Operators over texts, grids and fragments that Spark derives from the given tables, each beside SQL that doesn't take its way."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridfolio.functions import dates, nested, text
from gridfolio.operators import chunking, clauses, enrichment, graph, ingest, retrieval
from gridfolio.queries import query
from gridfolio.session import read_table, written
from gridfolio.sources import documents, pages


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, l_linenumber + (l_orderkey + l_linenumber) // 4 AS page FROM lineitem
                  WHERE (l_orderkey, l_linenumber) IN (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1)),
             s AS (SELECT *, CASE WHEN page = lag(page) OVER w + 1 AND l_returnflag = lag(l_returnflag) OVER w THEN 0 ELSE 1 END AS begins FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
             i AS (SELECT *, sum(begins) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS island FROM s)
        SELECT l_orderkey AS document_id, min(l_linenumber)::INTEGER AS table_index, string_agg(page::VARCHAR, ',' ORDER BY l_linenumber) AS pages,
               string_agg(l_quantity::INTEGER::VARCHAR, ',' ORDER BY l_linenumber) AS cells, count(*)::INTEGER AS fragment_count FROM i GROUP BY l_orderkey, island"""
)
def continued_tables(spark, sf_dir):
    """The lines of an order as one-row tables on pages: those on the next page under the same header go on."""
    lines = read_table(spark, sf_dir, "lineitem")
    once = lines.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.first("l_returnflag").alias("flag"), F.first("l_quantity").alias("quantity")).where("n = 1")
    fragments = once.select(
        F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("table_index"), (F.col("l_linenumber") + F.floor((F.col("l_orderkey") + F.col("l_linenumber")) / 4)).cast("int").alias("page_number"),
        F.array("flag").alias("headers"), F.array(F.array(F.col("quantity").cast("int").cast("string"))).alias("rows"),
    )
    out = chunking.merged_tables(fragments)
    return out.select("document_id", F.col("table_index").cast("int").alias("table_index"), F.array_join("row_page_numbers", ",").alias("pages"), F.array_join(F.flatten("rows"), ",").alias("cells"), "fragment_count")


#: Grids of regions and of orders; the shape of an order's grid is told by its key: even, ragged with commas and quotes, blank cells under equal headers, or bare.
_GRIDS = """
    WITH n AS (SELECT 'region ' || n_regionkey AS grid, ['key', 'name'] AS headers, list([n_nationkey::VARCHAR, n_name] ORDER BY n_nationkey NULLS FIRST, n_name NULLS FIRST) AS rows FROM nation GROUP BY n_regionkey),
         c AS (SELECT *, l_linenumber::VARCHAR AS n, l_partkey::VARCHAR AS p FROM lineitem),
         l AS (SELECT l_orderkey, list(CASE l_orderkey % 4 WHEN 0 THEN [n, p, l_returnflag]
                                            WHEN 1 THEN CASE l_linenumber % 2 WHEN 0 THEN ['x, ' || p, '"' || l_returnflag || '"'] ELSE [n] END
                                            WHEN 2 THEN [CASE WHEN l_linenumber % 2 = 0 THEN ' ' ELSE n END, CASE WHEN l_partkey % 2 = 0 THEN ' ' ELSE p || ' ' END]
                                            ELSE [n] END ORDER BY l_linenumber NULLS FIRST, l_partkey NULLS FIRST, l_returnflag NULLS FIRST) AS rows FROM c GROUP BY l_orderkey),
         g AS (SELECT * FROM n UNION ALL
               SELECT 'order ' || l_orderkey, CASE l_orderkey % 4 WHEN 0 THEN ['line', 'part', 'flag'] WHEN 1 THEN ['a', 'b'] WHEN 2 THEN ['a', 'a'] ELSE []::VARCHAR[] END, rows FROM l)
"""


@query(
    _GRIDS
    + """SELECT grid, len(list_distinct([len(r) FOR r IN rows])) = 1 AS uniform, len(headers) > 0 AND len([r FOR r IN rows IF len(r) <> len(headers)]) = 0 AS formed,
                array_to_string([('| ' || coalesce(array_to_string([coalesce(v, '') FOR v IN r], ' | '), '') || ' |') FOR r IN list_concat([headers], [['---' FOR h IN headers]], rows)], chr(10)) AS markdown,
                array_to_string([(coalesce(array_to_string([CASE WHEN regexp_matches(coalesce(v, ''), '[",\r\n]') THEN '"' || replace(v, '"', '""') || '"' ELSE coalesce(v, '') END FOR v IN r], ','), '') || chr(13) || chr(10)) FOR r IN list_concat([headers], rows)], '') AS csv,
                coalesce(array_to_string(list_sort(list_transform(list_filter(range(1, least(len(headers), len(rows[-1])) + 1),
                    lambda i: coalesce(trim(rows[-1][i]) <> '', false) AND len(list_filter(range(i + 1, least(len(headers), len(rows[-1])) + 1), lambda j: headers[j] = headers[i] AND coalesce(trim(rows[-1][j]) <> '', false))) = 0),
                    lambda i: headers[i] || '=' || trim(rows[-1][i]))), ','), '') AS last FROM g"""
)
def grid_renderings(spark, sf_dir):
    """The nations of each region and the lines of each order as grids of all shapes: their checks, their texts, and their last rows as maps."""
    nation, lines = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "lineitem")
    in_order = lambda *by: F.transform(F.sort_array(F.collect_list(F.struct(*by))), lambda x: x["r"])
    texts = lambda *c: F.array(*map(F.lit, c)).cast("array<string>")
    regions = nation.groupBy("n_regionkey").agg(in_order("n_nationkey", "n_name", F.array(F.col("n_nationkey").cast("string"), "n_name").alias("r")).alias("rows"))
    regions = regions.select(F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("grid"), texts("key", "name").alias("headers"), "rows")
    shape, n, p = F.col("l_orderkey") % 4, F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")
    quoted = F.array(F.concat(F.lit("x, "), p), F.concat(F.lit('"'), "l_returnflag", F.lit('"')))
    blank = F.array(F.when(F.col("l_linenumber") % 2 == 0, " ").otherwise(n), F.when(F.col("l_partkey") % 2 == 0, " ").otherwise(F.concat(p, F.lit(" "))))
    cells = F.when(shape == 0, F.array(n, p, "l_returnflag")).when((shape == 1) & (F.col("l_linenumber") % 2 == 0), quoted).when(shape == 2, blank).otherwise(F.array(n))
    orders = lines.groupBy("l_orderkey").agg(in_order("l_linenumber", "l_partkey", "l_returnflag", cells.alias("r")).alias("rows"))
    headers = F.when(shape == 0, texts("line", "part", "flag")).when(shape == 1, texts("a", "b")).when(shape == 2, texts("a", "a")).otherwise(texts())
    grids = regions.unionByName(orders.select(F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("grid"), headers.alias("headers"), "rows"))
    last = nested.row_map(F.col("headers"), F.element_at("rows", -1))
    return grids.select(
        "grid", nested.uniform_width(F.col("rows")).alias("uniform"), nested.well_formed(F.col("headers"), F.col("rows")).alias("formed"),
        nested.markdown_table(F.col("headers"), F.col("rows")).alias("markdown"), nested.csv_text(F.col("headers"), F.col("rows")).alias("csv"),
        F.array_join(F.transform(F.array_sort(F.map_entries(last)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("last"),
    )


@query("SELECT o_orderkey, 'FY' || year(o_orderdate) AS fiscal_year, CASE o_orderkey % 3 WHEN 0 THEN 'Q' || quarter(o_orderdate) WHEN 1 THEN monthname(o_orderdate) ELSE 'YTD' END AS period FROM orders")
def reporting_periods(spark, sf_dir):
    """Titles with the fiscal year and the quarter, the month or the year to date of every order."""
    when = F.col("o_orderdate")
    title = F.concat(
        F.lit("Results FY"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(" ")).otherwise(""), F.year(when).cast("string"), F.lit(", "),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Q"), F.quarter(when).cast("string"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("month of "), F.lower(F.date_format(when, "MMMM")))).otherwise("as of ytd"),
    )
    df = read_table(spark, sf_dir, "orders").withColumn("title", title)
    return df.select("o_orderkey", dates.fiscal_year(F.col("title")).alias("fiscal_year"), dates.reporting_period(F.col("title")).alias("period"))


@query("SELECT p_partkey, p_size || '.' || p_partkey AS number FROM part WHERE p_partkey % 3 <> 2 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_partkey % 3 = 2")
def caption_numbers(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("Table"), F.lit("see exhibit"), F.lit("Figure")), (F.col("p_partkey") % 3 + 1).cast("int"))
    caption = F.concat(kind, F.lit(" "), F.col("p_size").cast("string"), F.lit("."), F.col("p_partkey").cast("string"), F.lit(": "), F.col("p_name"))
    return read_table(spark, sf_dir, "part").select("p_partkey", text.caption_number(caption).alias("number"))


@query("SELECT c_custkey, 0 AS position, 'Dr. ' || c_name || ' paid Acme Inc. in full, vs. half of it.' AS sentence FROM customer UNION ALL SELECT c_custkey, 1, 'Segment ' || c_mktsegment || ' knows!' FROM customer")
def prose_sentences(spark, sf_dir):
    """A full stop behind an abbreviation ends no sentence."""
    prose = F.concat(F.lit("Dr. "), F.col("c_name"), F.lit(" paid Acme Inc. in full, vs. half of it.  Segment "), F.col("c_mktsegment"), F.lit(" knows! "))
    return read_table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(text.prose_sentences(prose)).alias("position", "sentence"))


@query(
    r"""WITH a AS (SELECT page_id, regexp_replace(coalesce(html, ''), '<br\s*/?>', chr(10), 'gi') AS h FROM pages),
             b AS (SELECT page_id, regexp_replace(h, '<li[^>]*>', chr(10) || '- ', 'gi') AS h FROM a),
             c AS (SELECT page_id, regexp_replace(h, '</?(p|ul|ol|div|li)[^>]*>', chr(10), 'gi') AS h FROM b),
             d AS (SELECT page_id, regexp_replace(regexp_replace(h, '</?(b|strong)[^>]*>', '**', 'gi'), '<[^>]+>', '', 'g') AS h FROM c)
        SELECT page_id, md5(regexp_replace(regexp_replace(h, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM d"""
)
def cleaned_markup(spark, sf_dir):
    """Every page as Markdown, told by a digest."""
    return read_table(spark, sf_dir, "pages").select("page_id", F.md5(text.clean_markup(F.coalesce("html", F.lit("")))).alias("digest"))


@query("SELECT event_id, event_id::VARCHAR AS a, event_type AS b FROM events")
def tolerant_objects(spark, sf_dir):
    """Answers of a model that hold an object in a fence, in prose, or cut off before its end."""
    body = F.concat(F.lit('{"a": '), F.col("event_id").cast("string"), F.lit(', "b": "'), F.col("event_type"))
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit('"}\n```'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Sure: "), body, F.lit('"} done'))).otherwise(body)
    df = read_table(spark, sf_dir, "events").select("event_id", nested.tolerant_json(said).alias("v"))
    return df.select("event_id", F.try_variant_get("v", "$.a", "string").alias("a"), F.try_variant_get("v", "$.b", "string").alias("b"))


@query(
    """SELECT o_orderkey AS document_id, n AS clause_index, n::VARCHAR AS clause_number,
              CASE n WHEN 1 THEN 'TERMINATION' ELSE 'LIABILITY' END AS clause_title, CASE n WHEN 1 THEN 'termination' ELSE 'liability' END AS clause_type,
              n || CASE n WHEN 1 THEN '. TERMINATION' || chr(10) || 'Either party may terminate order ' || o_orderkey ELSE '. LIABILITY' || chr(10) || 'No indirect damages above ' || floor(o_totalprice)::BIGINT END AS body
       FROM orders, (VALUES (1), (2)) t(n)"""
)
def clauses_of_blocks(spark, sf_dir):
    """Two clauses of each order, behind a preamble, and the first of them once more."""
    key, price = F.col("o_orderkey").cast("string"), F.floor("o_totalprice").cast("long").cast("string")
    first = [F.lit("1. TERMINATION"), F.concat(F.lit("Either party may terminate order "), key)]
    blocks = F.array(F.lit("Preamble without a number"), *first, F.lit("2. LIABILITY"), F.concat(F.lit("No indirect damages above "), price), *first)
    rows = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.posexplode(blocks).alias("position", "text"))
    out = chunking.clauses(rows)
    return out.select("document_id", "clause_index", "clause_number", "clause_title", "clause_type", F.col("text").alias("body"))


@query(
    """SELECT s_suppkey, CASE s_suppkey % 2 WHEN 0 THEN 'USD' ELSE 'EUR' END AS currency, 'FY' || (2000 + s_nationkey) AS fiscal_year,
              CASE s_suppkey % 3 WHEN 0 THEN 'balance_sheet' ELSE 'income_statement' END AS category, s_name || ' FY' || (2000 + s_nationkey) || CASE s_suppkey % 3 WHEN 0 THEN ' balance sheet' ELSE ' revenue' END || ' — 1 rows × 2 columns. Columns: Item, Value' AS summary
       FROM supplier"""
)
def enriched_tables(spark, sf_dir):
    """A table of each supplier: what its caption, headers and cells tell."""
    caption = F.concat(F.col("s_name"), F.lit(" FY"), (2000 + F.col("s_nationkey")).cast("string"), F.when(F.col("s_suppkey") % 3 == 0, " balance sheet").otherwise(" revenue"))
    cell = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "$ ").otherwise("EUR "), F.col("s_suppkey").cast("string"))
    df = read_table(spark, sf_dir, "supplier").select("s_suppkey", caption.alias("caption"), F.array(F.lit("Item"), F.lit("Value")).alias("headers"), F.array(F.array(F.lit("Sales"), cell)).alias("rows"))
    return enrichment.enriched_tables(df).select("s_suppkey", "currency", "fiscal_year", F.col("table_category").alias("category"), F.col("table_summary").alias("summary"))


@query(
    r"""WITH c AS (SELECT doc_id, ((doc_id * 37) % 1009)::DOUBLE AS distance, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents WHERE doc_id IS NOT NULL),
             p AS (SELECT * FROM c ORDER BY distance, doc_id LIMIT 40), l AS (SELECT doc_id, 8.0 * (list_contains(w, 'the')::INT + list_contains(w, 'license')::INT + list_contains(w, 'der')::INT + list_contains(w, 'les')::INT) / 4 - 4 AS x FROM p)
        SELECT doc_id, round(0.3 / (1 + exp(-x)) + 0.7 * CASE WHEN max(x) OVER () = min(x) OVER () THEN 0 ELSE (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) END, 4) AS relevance FROM l ORDER BY relevance DESC, doc_id LIMIT 15"""
)
def reranked_chunks(spark, sf_dir):
    """The best 15 of the 40 nearest texts by the words that they share with a question."""
    docs = read_table(spark, sf_dir, "documents").where("doc_id is not null")
    rows = docs.select(F.col("doc_id").alias("chunk_id"), "text", ((F.col("doc_id") * 37) % 1009).cast("double").alias("distance"))
    return retrieval.rerank(rows, "the license der les", 15).select(F.col("chunk_id").alias("doc_id"), "relevance")


@query(
    """WITH s AS (SELECT c_custkey, i, CASE WHEN i % 3 = c_custkey % 3 THEN 'Customer ' || c_custkey || ' buys ' || lower(c_mktsegment) || ' number ' || i || '.' ELSE 'Nothing of note happens in part ' || i || '.' END AS sentence,
                         (i % 3 = c_custkey % 3)::INT AS hit FROM customer, (VALUES (0), (1), (2), (3), (4)) t(i) WHERE c_custkey < 24),
            r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY hit DESC, i) AS rank FROM s)
       SELECT c_custkey, string_agg(sentence, ' ' ORDER BY i) AS compressed FROM r WHERE hit = 1 GROUP BY 1 UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey >= 24"""
)
def compressed_chunks(spark, sf_dir):
    """Of the first 120 sentences, five a chunk, those that share words with a question stay; chunks beyond stay whole."""
    sentence = lambda i: F.when(F.lit(i % 3) == F.col("c_custkey") % 3, F.concat(F.lit("Customer "), F.col("c_custkey").cast("string"), F.lit(" buys "), F.lower("c_mktsegment"), F.lit(f" number {i}."))).otherwise(F.lit(f"Nothing of note happens in part {i}."))
    rows = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chunk_id"), F.lit("vector_store").alias("store"), F.concat_ws(" ", *[sentence(i) for i in range(5)]).alias("text"))
    return retrieval.compress(rows, "customer buys").select(F.col("chunk_id").alias("c_custkey"), F.col("compressed_text").alias("compressed"))


@query("SELECT p_partkey, upper(replace(p_name, ' ', '_')) || '_' || p_type || '_X' AS type FROM part")
def relation_types(spark, sf_dir):
    said = F.concat(F.lit(" "), F.col("p_name"), F.lit("--"), F.lower("p_type"), F.lit(" \tx?! "))
    return read_table(spark, sf_dir, "part").select("p_partkey", graph.relation_type(said).alias("type"))


@query("SELECT count(*) AS n_images, count(*) FILTER (o_orderstatus = 'F') AS n_completed, count(*) FILTER (o_orderstatus = 'P') AS n_failed, count(*) FILTER (o_orderstatus = 'O') AS n_skipped, round(100.0 * count(*) FILTER (o_orderstatus = 'O') / count(*), 1) AS avoided_pct FROM orders")
def image_counts(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").when(F.col("o_orderstatus") == "O", "skipped")
    return ingest.image_metrics(read_table(spark, sf_dir, "orders").select(status.alias("status")))


@query(
    """SELECT DISTINCT l_orderkey AS document_id, l_linenumber AS table_index, CASE WHEN (l_orderkey + l_linenumber) % 2 = 0 THEN 'crop ' || l_orderkey || '/' || l_linenumber END AS source_image_id FROM lineitem"""
)
def linked_table_crops(spark, sf_dir):
    """Every second line of an order, as a table, has a crop among the images."""
    lines = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("table_index")).distinct()
    name = F.concat(F.lit("crop "), F.col("document_id").cast("string"), F.lit("/"), F.col("table_index").cast("string"))
    crops = lines.where("(document_id + table_index) % 2 = 0").select("document_id", (F.col("table_index") + ingest.CROP_INDEX).alias("image_index"), name.alias("id"))
    others = lines.select("document_id", F.col("table_index").alias("image_index"), F.lit("no crop").alias("id"))
    return ingest.linked_crops(crops.unionByName(others), lines).select("document_id", "table_index", "source_image_id")


@query("SELECT o_orderstatus || ': orders = ' || count(*) AS body, 0.0::DOUBLE AS distance, 1.0::DOUBLE AS relevance FROM orders GROUP BY o_orderstatus")
def facts_as_evidence(spark, sf_dir):
    counts = read_table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("group_key")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return ingest.facts(counts, "orders").withColumnRenamed("text", "body")


@query(
    """SELECT o_orderkey AS chunk_id, 'c' || o_custkey || '.pdf' AS file, '/files/c' || o_custkey || '.pdf' || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '#page=' || (o_orderkey % 4) END AS link FROM orders"""
)
def cited_hits(spark, sf_dir):
    """Each order cites a page of its customer's file; some name no page."""
    orders, customers = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    hits = orders.select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("document_id"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 4).alias("page"), F.lit("text").alias("text"))
    # Orders of customers that aren't in the table have a file as well.
    files = customers.select("c_custkey").union(orders.select("o_custkey")).distinct().select(F.col("c_custkey").alias("document_id"), F.concat(F.lit("/files/c"), F.col("c_custkey").cast("string"), F.lit(".pdf")).alias("path"))
    return ingest.citations(hits, files).select("chunk_id", "file", "link")


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'exe' WHEN 2 THEN 'md' ELSE '' END AS extension, s_suppkey % 2 = 0 AS admitted FROM supplier")
def admitted_files(spark, sf_dir):
    name = F.concat(F.lit("/in.box/"), F.col("s_name"), F.element_at(F.array(F.lit(".PDF"), F.lit(".exe"), F.lit(".tar.md"), F.lit("")), (F.col("s_suppkey") % 4 + 1).cast("int")))
    df = documents.admitted(read_table(spark, sf_dir, "supplier").select("s_suppkey", F.regexp_replace(name, "/in.box/", "/inbox/").alias("path")))
    return df.select("s_suppkey", "extension", "admitted")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM', '5-LOW') THEN lower(split_part(o_orderpriority, '-', 2)) END AS risk FROM orders"""
)
def clamped_choices(spark, sf_dir):
    said = F.concat(F.lit(" "), F.split_part("o_orderpriority", F.lit("-"), F.lit(2)), F.lit(" "))
    return read_table(spark, sf_dir, "orders").select("o_orderkey", nested.from_choice(said, clauses.RISKS).alias("risk"))


@query(
    """WITH t AS (SELECT user_id, sum(event_id)::DOUBLE AS score FROM events WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)
       SELECT string_agg('user ' || user_id, chr(10) || chr(10) ORDER BY score DESC, user_id) AS answer, count(*) AS n FROM t"""
)
def map_reduced_answers(spark, sf_dir):
    users = read_table(spark, sf_dir, "events").where("user_id is not null").groupBy(F.col("user_id").alias("community")).agg(F.sum("event_id").cast("double").alias("score"))
    return graph.map_reduce(users, F.col("score"), F.concat(F.lit("user "), F.col("community").cast("string")), 5)


#: Lines of a page of the files that texts are taken for.
_PAGE = 3


def _read_lines(content: bytes, first: int, last: int) -> tuple[list, list]:
    """Blocks and tables of some pages: a line is a heading where its length is divisible by seven, and a table of one cell by five."""
    lines = content.decode().split("\n")[_PAGE * (first - 1) : _PAGE * last]
    blocks = [("heading" if len(x) % 7 == 0 else "text", x, first + i // _PAGE) for i, x in enumerate(lines)]
    return blocks, [[["length"], [str(len(x))]] for x in lines if len(x) % 5 == 0]


def _count_pages(content: bytes) -> int:
    return -(-len(content.decode().split("\n")) // _PAGE)


def _batches(spark, sf_dir):
    """Every text as a paged file, read in batches of pages."""
    docs = read_table(spark, sf_dir, "documents").where("doc_id is not null and text is not null")
    files = docs.select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "utf-8").alias("content"))
    return written(pages.read_batches(files, pages.batches(files, _count_pages), _read_lines), "batches")


_ITEMS = """
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
"""


@query(
    _ITEMS
    + """SELECT doc_id::VARCHAR AS path, i::INTEGER AS position, CASE WHEN length(line) % 7 = 0 THEN 'heading' ELSE 'text' END AS kind, (1 + i // 3)::INTEGER AS page, md5(line) AS line,
                md5(last_value(CASE WHEN length(line) % 7 = 0 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS section FROM l"""
)
def item_stream(spark, sf_dir):
    """The blocks of all files in their order, numbered and under their headings over the ends of batches."""
    items = pages.items(_batches(spark, sf_dir))
    return items.select("path", "position", "kind", F.col("page").cast("int").alias("page"), F.md5("text").alias("line"), F.md5("section").alias("section"))


@query(_ITEMS + "SELECT doc_id::VARCHAR AS path, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS table_index, length(line)::VARCHAR AS cell FROM l WHERE length(line) % 5 = 0")
def table_stream(spark, sf_dir):
    """The tables of all files, numbered over their batches."""
    return pages.tables(_batches(spark, sf_dir)).select("path", "table_index", F.element_at(F.element_at("rows", 1), 1).alias("cell"))
