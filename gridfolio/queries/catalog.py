"""Catalog views, checks, keyed changes and job states."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridfolio.operators import catalog
from gridfolio.queries import query
from gridfolio.session import read_table, scratch_path
from gridfolio.sources import tables
from gridfolio.streaming import jobs


@query(
    """SELECT c_custkey, c_name, coalesce(o.n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c_custkey = o_custkey"""
)
def parent_overview(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return catalog.with_counts(read_table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", {"n_orders": orders})


@query(
    """SELECT d.doc_id, d.source, coalesce(l.n, 0) AS n_labels, coalesce(c.n, 0) AS n_turns FROM documents d
       LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id
       LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) c ON d.doc_id = c.conv_id"""
)
def document_overview(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "doc_id")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    return catalog.with_counts(docs, "doc_id", {"n_labels": read_table(spark, sf_dir, "labels"), "n_turns": turns})


@query(
    """SELECT c_custkey, o_orderkey, o_orderdate FROM customer LEFT JOIN
       (SELECT * FROM (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS r FROM orders) WHERE r = 1)
       ON c_custkey = o_custkey"""
)
def latest_per_key(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    order = [F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey")]
    return catalog.with_latest(read_table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", order)


@query(
    """SELECT c_custkey, count(o_orderstatus) AS n_total, count(*) FILTER (o_orderstatus = 'F') AS n_completed, count(*) FILTER (o_orderstatus = 'P') AS n_failed,
              count(*) FILTER (o_orderstatus = 'O') AS n_running,
              CASE WHEN count(o_orderstatus) = 0 THEN 'empty' WHEN count(*) FILTER (o_orderstatus = 'O') > 0 THEN 'running'
                   WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'failed' ELSE 'completed' END AS status
       FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey"""
)
def run_status_rollup(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return catalog.status_rollup(read_table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", "o_orderstatus", "F", "P", "O")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_children_anti(spark, sf_dir):
    return catalog.missing_children(read_table(spark, sf_dir, "documents").select("doc_id", "lang"), read_table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, lang FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels)")
def having_children_semi(spark, sf_dir):
    return catalog.having_children(read_table(spark, sf_dir, "documents").select("doc_id", "lang"), read_table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def having_duplicates(spark, sf_dir):
    return catalog.duplicates(read_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])


@query("SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 100")
def page_of_documents(spark, sf_dir):
    df = read_table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return catalog.page(df, 3, 50, [F.col("n_chars").desc(), F.col("doc_id")])


@query("SELECT count(*) AS total, greatest(1, ceil(count(*) / 50.0))::BIGINT AS pages FROM documents")
def page_count(spark, sf_dir):
    return catalog.page_count(read_table(spark, sf_dir, "documents"), 50)


@query(
    """WITH p AS (SELECT conv_id, max(turn) AS m FROM conversations GROUP BY 1 HAVING max(turn) >= 1), s AS (SELECT conv_id, unnest(generate_series(1, m))::INTEGER AS turn FROM p)
       SELECT s.conv_id, s.turn, count(c.role) FILTER (c.role = 'user') AS n_user, count(c.role) FILTER (c.role = 'assistant') AS n_assistant
       FROM s LEFT JOIN conversations c ON s.conv_id = c.conv_id AND s.turn = c.turn GROUP BY 1, 2"""
)
def dense_page_counts(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations")
    parents = turns.groupBy("conv_id").agg(F.max("turn").alias("last")).where("last >= 1")
    children = {f"n_{r}": turns.where(F.col("role") == r) for r in ("user", "assistant")}
    return catalog.dense_counts(parents, "conv_id", F.col("last"), children, "turn")


@query(
    """SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts FROM
       (SELECT user_id, event_type, count(*)::VARCHAR AS n FROM events GROUP BY 1, 2) GROUP BY 1"""
)
def status_histogram(spark, sf_dir):
    out = catalog.histogram(read_table(spark, sf_dir, "events"), ["user_id"], "event_type")
    shown = F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("user_id", shown.alias("counts"))


@query(
    """SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer"""
)
def keyed_upsert(spark, sf_dir):
    old = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return catalog.upserted(old, old.where("c_acctbal < 0").withColumn("c_acctbal", F.lit(0.0)), ["c_custkey"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def cascade_delete(spark, sf_dir):
    gone = read_table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return catalog.deleted({"lineitem": lines}, "l_orderkey", gone)["lineitem"]


@query("SELECT o_orderkey, nullif(o_custkey, 7) AS o_custkey FROM orders")
def set_null_on_delete(spark, sf_dir):
    return catalog.detached(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 7)


@query(
    """WITH a AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1)
       SELECT coalesce(a.k, b.k) AS nationkey, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right FROM a FULL JOIN b ON a.k = b.k WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)"""
)
def count_mismatches(spark, sf_dir):
    left = read_table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey"))
    return catalog.count_mismatches(left, read_table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey")), "nationkey")


@query(
    """SELECT conv_id, count(*) AS n_messages, count(*) FILTER (role = 'user') AS n_user, max(turn) AS last_turn,
              arg_min(left(trim(text), 60), turn) FILTER (role = 'user') AS title FROM conversations GROUP BY 1"""
)
def chat_session_stats(spark, sf_dir):
    return catalog.sessions(read_table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query(
    """SELECT user_id, arg_max(event_type, (ts, event_type)) AS stage, min(ts) AS started_at, max(ts) AS updated_at,
              (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds, count(*) AS n_events FROM events GROUP BY 1"""
)
def job_state(spark, sf_dir):
    return jobs.current_state(read_table(spark, sf_dir, "events"), "user_id", "event_type", "ts")


@query(
    """WITH s AS (SELECT user_id, arg_max(event_type, (ts, event_type)) AS stage, max(ts) AS updated_at FROM events GROUP BY 1), n AS (SELECT max(ts) AS now FROM events)
       SELECT user_id, stage FROM s, n WHERE stage NOT IN ('purchase', 'error') AND epoch_us(now) - epoch_us(updated_at) > 3600e6 ORDER BY updated_at, user_id LIMIT 10"""
)
def stuck_jobs(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    now = events.agg(F.max("ts")).first()[0]
    return jobs.stuck(jobs.current_state(events, "user_id", "event_type", "ts"), now, ["purchase", "error"], 3600).select("user_id", "stage")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_event_counts(spark, sf_dir):
    out = jobs.windowed_counts(read_table(spark, sf_dir, "events"), "ts", "event_type", "value")
    return out.withColumn("total", F.round("total", 4))


@query(
    """SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 INTERSECT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'"""
)
def row_sets_intersect(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders")
    return orders.where("o_totalprice > 200000").select("o_orderkey").intersect(orders.where("o_orderstatus = 'F'").select("o_orderkey"))


@query("SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def row_sets_union(spark, sf_dir):
    left = read_table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey"))
    return left.union(read_table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("SELECT doc_id FROM documents WHERE doc_id IS NOT NULL EXCEPT SELECT doc_id FROM labels")
def lineage_gap(spark, sf_dir):
    """Documents that never got a label."""
    docs = read_table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id")
    return catalog.missing_children(docs, read_table(spark, sf_dir, "labels"), "doc_id").distinct()


@query("SELECT n_name, r_name, count(s_suppkey) AS n_suppliers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2")
def three_way_join(spark, sf_dir):
    nation, region = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    joined = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).join(read_table(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return joined.groupBy("n_name", "r_name").agg(F.count("s_suppkey").alias("n_suppliers"))


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('fr', 'de') AND source <> 'src0'")
def typed_documents(spark, sf_dir):
    from gridfolio.operators import retrieval

    docs = read_table(spark, sf_dir, "documents").where("source <> 'src0'").withColumn("document_types", F.array("lang"))
    return retrieval.typed(docs, ["fr", "de"]).select("doc_id", "lang")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'seen' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 7 <> 0
       UNION ALL SELECT -1 - o_orderkey, 'new' FROM orders WHERE o_orderkey % 11 = 0"""
)
def keyed_table_commits(spark, sf_dir):
    """A table written by four commits: all orders, an upsert, a deletion by key, and an upsert by a writer that was overtaken by the deletion."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    table = tables.KeyedTable.create(spark, scratch_path(spark, "orders"), orders.schema, ["o_orderkey"], buckets=8)
    table.upsert(orders)
    table.upsert(orders.where("o_orderkey % 5 = 0").withColumn("status", F.lit("seen")))
    other = tables.KeyedTable(spark, table.path)
    todo = [orders.where("o_orderkey % 7 = 0")]
    table.before_commit = lambda: other.delete(todo.pop()) if todo else None
    table.upsert(orders.where("o_orderkey % 11 = 0").select((-1 - F.col("o_orderkey")).alias("o_orderkey"), F.lit("new").alias("status")))
    return table.read()
