"""Graph operators over the key graph of the tables and over entities of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfolio.operators import containment, graph, graph_store, hops
from gridfolio.queries import ORACLE_SQL, query, scalars  # noqa: F401
from gridfolio.session import read_table, scratch_path, written


def _key_edges(spark, sf_dir) -> DataFrame:
    """region - nation - customer and nation - supplier, as one edge table."""
    nation = read_table(spark, sf_dir, "nation")
    customer, supplier = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "supplier")
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    out = nation.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("tgt"))
    out = out.union(customer.select(name("n", "c_nationkey"), name("c", "c_custkey")))
    return out.union(supplier.select(name("n", "s_nationkey"), name("s", "s_suppkey")))


_EDGES = """
    WITH RECURSIVE e AS (
        SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
        UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier
    ), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e)
"""
_MENTIONS = "SELECT DISTINCT l_partkey AS entity_key, l_orderkey AS document_id FROM lineitem"


def _log(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity_key"), F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("seq"))


@query(
    _EDGES
    + """, walk AS (SELECT 'r1' AS node, 0 AS hop UNION SELECT u.b, w.hop + 1 FROM walk w JOIN u ON u.a = w.node WHERE w.hop < 2)
       SELECT node, min(hop)::INTEGER AS hop FROM walk GROUP BY 1"""
)
def k_hop_neighbourhood(spark, sf_dir):
    seeds = spark.createDataFrame([("r1",)], "node string")
    return graph.neighbourhood(_key_edges(spark, sf_dir), seeds, 2)


@query("SELECT p_name AS node FROM part WHERE contains(p_name, 'red') OR contains('red', p_name) GROUP BY 1")
def seeds_by_name(spark, sf_dir):
    nodes = read_table(spark, sf_dir, "part").select(F.col("p_name").alias("entity_key")).distinct()
    return graph.seeds_by_name(nodes, ["Red"])


@query(
    f"""WITH m AS ({_MENTIONS}) SELECT document_id, count(DISTINCT entity_key) AS n_entities FROM m
        WHERE entity_key IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#2') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""
)
def related_documents(spark, sf_dir):
    keys = read_table(spark, sf_dir, "part").where("p_brand = 'Brand#2'").select(F.col("p_partkey").alias("node"))
    return graph.related_documents(_log(spark, sf_dir), keys, 20)


@query(f"WITH m AS ({_MENTIONS}) SELECT p_partkey AS entity_key, count(document_id) AS doc_count FROM part LEFT JOIN m ON p_partkey = entity_key GROUP BY 1")
def entity_listing(spark, sf_dir):
    nodes = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_key"))
    return graph.listing(nodes, _log(spark, sf_dir))


@query(
    """SELECT least(s, p) AS a, greatest(s, p) AS b, round(sum(w), 2) AS weight FROM
       (SELECT 's' || l_suppkey AS s, 'p' || l_partkey AS p, l_quantity AS w FROM lineitem) GROUP BY 1, 2 HAVING sum(w) > 0"""
)
def weighted_edges(spark, sf_dir):
    lines = read_table(spark, sf_dir, "lineitem")
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    edges = lines.select(name("s", "l_suppkey").alias("src"), name("p", "l_partkey").alias("tgt"), F.col("l_quantity").alias("weight"))
    return graph.undirected(edges).select("a", "b", F.round("weight", 2).alias("weight"))


@query(
    """SELECT l_partkey AS entity_key, min(l_orderkey) AS first_doc, count(DISTINCT l_orderkey) AS n_docs, count(*) AS n_mentions FROM lineitem GROUP BY 1"""
)
def entity_upsert(spark, sf_dir):
    log = _log(spark, sf_dir).withColumn("name", F.col("entity_key").cast("string"))
    return graph.entities(log).select("entity_key", F.element_at("doc_ids", 1).alias("first_doc"), "n_docs", "n_mentions")


@query(
    """SELECT user_id::VARCHAR AS src, event_type AS tgt, 'DID_' || upper(event_type) AS rel_type, count(*) AS weight, count(DISTINCT event_id % 7) AS n_docs FROM events GROUP BY 1, 2"""
)
def relation_upsert(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    log = events.select(
        F.col("user_id").cast("string").alias("src"),
        F.col("event_type").alias("tgt"),
        F.concat(F.lit("did "), F.col("event_type")).alias("rel_type"),
        F.lit("").alias("description"),
        F.lit(None).cast("double").alias("confidence"),
        (F.col("event_id") % 7).alias("document_id"),
        F.col("event_id").alias("seq"),
    )
    return graph.relations(log).select("src", "tgt", "rel_type", "weight", F.size("doc_ids").cast("long").alias("n_docs"))


@query(f"WITH m AS ({_MENTIONS}) SELECT entity_key, count(document_id) AS n_docs FROM m WHERE document_id <> 1 GROUP BY 1")
def graph_without_document(spark, sf_dir):
    return graph.entities(graph.without_document(_log(spark, sf_dir).withColumn("name", F.lit("")), 1)).select("entity_key", "n_docs")


@query(
    """SELECT 'entities' AS item, count(*) AS n FROM part UNION ALL SELECT 'relations', count(*) FROM nation UNION ALL SELECT 'mentions', count(*) FROM lineitem
       UNION ALL SELECT 'documents', count(DISTINCT l_orderkey) FROM lineitem UNION ALL SELECT 'communities', count(DISTINCT n_regionkey) FROM nation"""
)
def graph_stats(spark, sf_dir):
    nation = read_table(spark, sf_dir, "nation")
    nodes = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_key"))
    return graph.stats(nodes, nation, _log(spark, sf_dir), nation.select(F.col("n_regionkey").alias("community")))


@query()
def communities_label_propagation(spark, sf_dir):
    lines = read_table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    edges = lines.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("tgt"), F.lit(1.0).alias("weight"))
    return graph.label_propagation(edges, 4)


@query()
def communities_by_modularity(spark, sf_dir):
    """Nations that share customers' suppliers: weights are the lines between a customer's and a supplier's nation."""
    orders, lines = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem")
    customer, supplier = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "supplier")
    pairs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    pairs = pairs.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("c_nationkey", "s_nationkey").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return graph.communities(pairs.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("tgt"), "weight"), rounds=3, levels=2)


@query(
    """WITH a AS (SELECT DISTINCT p_partkey::VARCHAR AS l FROM part), b AS (SELECT DISTINCT lower(c_name) AS r FROM customer)
       SELECT l AS "left", r AS "right" FROM a, b WHERE l = r OR (length(l) >= 3 AND contains(r, l)) OR (length(r) >= 3 AND contains(l, r))"""
)
def names_contained(spark, sf_dir):
    """The numbers of all parts inside the names of all customers."""
    return containment.contained_pairs(read_table(spark, sf_dir, "part"), read_table(spark, sf_dir, "customer"), "p_partkey", "c_name")


@query(
    f"""WITH m AS MATERIALIZED (SELECT DISTINCT id, entity_key FROM ({ORACLE_SQL["entity_mentions"]})),
             f0 AS (SELECT DISTINCT entity_key FROM m WHERE contains(entity_key, 'licen') OR contains(entity_key, 'apache') OR (length(entity_key) >= 3 AND (contains('licen', entity_key) OR contains('apache', entity_key)))),
             h0 AS MATERIALIZED (SELECT id, count(*) AS n FROM m JOIN f0 USING (entity_key) GROUP BY 1 ORDER BY n DESC, id LIMIT 20),
             f1 AS MATERIALIZED (SELECT DISTINCT entity_key FROM m WHERE id IN (SELECT id FROM h0) EXCEPT SELECT entity_key FROM f0),
             h1 AS MATERIALIZED (SELECT id, count(*) AS n FROM m JOIN f1 USING (entity_key) WHERE id NOT IN (SELECT id FROM h0) GROUP BY 1 ORDER BY n DESC, id LIMIT 20),
             f2 AS (SELECT DISTINCT entity_key FROM m WHERE id IN (SELECT id FROM h1) EXCEPT SELECT entity_key FROM f1 EXCEPT SELECT entity_key FROM f0),
             h2 AS (SELECT id, count(*) AS n FROM m JOIN f2 USING (entity_key) WHERE id NOT IN (SELECT id FROM h0) AND id NOT IN (SELECT id FROM h1) GROUP BY 1 ORDER BY n DESC, id LIMIT 20)
        SELECT id, 0 AS hop, n AS n_shared FROM h0 UNION ALL SELECT id, 1, n FROM h1 UNION ALL SELECT id, 2, n FROM h2"""
)
def multi_hop_documents(spark, sf_dir):
    """From the entities that a question names to documents, and over what they mention to others, three hops."""
    log = written(graph.mentions(read_table(spark, sf_dir, "documents"), "doc_id", "text").select("id", "entity_key"), "mentions")
    names = spark.createDataFrame([("Licen",), ("Apache",)], "name string")
    return hops.expanded(log, containment.seeds(log.select("entity_key").distinct(), names), 3, 20, "id")


@query(
    f"""WITH m AS ({ORACLE_SQL["entity_mentions"]}), k AS (SELECT * FROM m WHERE id % 3 <> 0)
        SELECT entity_key, arg_min(name, id * 100 + position) AS name, count(DISTINCT id) AS n_docs, count(*) AS n_mentions FROM k GROUP BY 1"""
)
def graph_store_deltas(spark, sf_dir):
    """A stored graph that all documents came into in two steps and a third of them left: what is left, without recomputation."""
    found = graph.mentions(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    log = written(found.select(F.col("id").cast("string").alias("document_id"), (F.col("id") * 100 + F.col("position")).cast("long").alias("seq"), "entity_key", "name", "id"), "log")
    store = graph_store.GraphStore.create(spark, scratch_path(spark, "graph"), 8)
    store.put(log.where("id % 2 = 0"))
    store.put(log.where("id % 2 = 1"))
    store.remove(log.where("id % 3 = 0").select("document_id").distinct())
    return store.nodes()
