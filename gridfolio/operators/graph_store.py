"""The entity graph as stored tables that follow a mention log by signed changes, without recomputing what didn't change."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridfolio.operators import graph
from gridfolio.sources.tables import KeyedTable

#: First names that are kept of an entity: when all of them are removed, its names are read from the log again.
NAMES = 4
BUCKETS = 64

_TEXT, _LONG = T.StringType(), T.LongType()
_NAME = T.StructType([T.StructField("seq", _LONG), T.StructField("name", _TEXT), T.StructField("document_id", _TEXT)])
MENTIONS = T.StructType([T.StructField(c, k) for c, k in (("document_id", _TEXT), ("seq", _LONG), ("entity_key", _TEXT), ("name", _TEXT))])
RELATIONS = T.StructType([T.StructField(c, k) for c, k in (("document_id", _TEXT), ("seq", _LONG), ("src", _TEXT), ("tgt", _TEXT), ("rel_type", _TEXT))])
ENTITIES = T.StructType([T.StructField("entity_key", _TEXT), T.StructField("n_docs", _LONG), T.StructField("n_mentions", _LONG), T.StructField("names", T.ArrayType(_NAME))])
EDGES = T.StructType([T.StructField(c, k) for c, k in (("src", _TEXT), ("tgt", _TEXT), ("rel_type", _TEXT), ("weight", _LONG), ("n_docs", _LONG))])


class GraphStore:
    """Two logs by document (mentions, relations) and two aggregates (entities, edges), each a keyed table.

    Documents are put and removed in the logs. The aggregates are brought up to date from the difference between the log's version
    that they stand at and its latest one: signed counts of what came and went, summed per key and added to what is stored. What is left
    without a mention goes. The version is kept with each commit of an aggregate, so that a run that broke off goes on where it was,
    and no change is added twice.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.mentions, self.relations, self.entities, self.edges = (KeyedTable(spark, f"{path}/{n}") for n in ("mentions", "relations", "entities", "edges"))

    @classmethod
    def create(cls, spark: SparkSession, path: str, buckets: int = BUCKETS) -> GraphStore:
        for name, schema, key, by in (
            ("mentions", MENTIONS, ["document_id", "seq"], ["document_id"]), ("relations", RELATIONS, ["document_id", "seq"], ["document_id"]),
            ("entities", ENTITIES, ["entity_key"], None), ("edges", EDGES, ["src", "tgt", "rel_type"], None),
        ):
            KeyedTable.create(spark, f"{path}/{name}", schema, key, by, buckets)
        return cls(spark, path)

    def put(self, mentions: DataFrame, relations: DataFrame | None = None, documents: DataFrame | None = None) -> None:
        """Documents with their mentions and relations, in place of what the logs had of them; ``documents`` names those that have none (any more)."""
        relations = self.spark.createDataFrame([], RELATIONS) if relations is None else relations
        named = [df.select("document_id") for df in (mentions, relations, documents) if df is not None]
        every = named[0]
        for df in named[1:]:
            every = every.union(df)
        every = every.distinct()
        clean = relations.where("src <> tgt").withColumn("rel_type", graph.relation_type(F.col("rel_type")))
        self.mentions.replace(mentions.select(*MENTIONS.names), every)
        self.relations.replace(clean.select(*RELATIONS.names), every)
        self.refresh()

    def remove(self, documents: DataFrame) -> None:
        """Documents (document_id) leave the graph, and with them the entities and edges that only they had."""
        self.put(self.spark.createDataFrame([], MENTIONS), None, documents)

    def refresh(self) -> None:
        """Bring both aggregates to the latest versions of their logs."""
        self._follow(self.mentions, self.entities, self._entity_changes)
        self._follow(self.relations, self.edges, self._edge_changes)

    def _follow(self, log: KeyedTable, aggregate: KeyedTable, changes) -> None:
        at = int(json.loads(aggregate.note() or "0"))
        latest = log.version()
        if at == latest:
            return
        aggregate.apply(changes(log.signed(at, latest)), self._merge_entities if aggregate is self.entities else self._merge_edges, note=json.dumps(latest))

    @staticmethod
    def _entity_changes(signed: DataFrame) -> DataFrame:
        """entity_key, d_docs, d_mentions, came (the first names of what came), gone (documents that went)."""
        per_doc = signed.groupBy("entity_key", "document_id", "sign").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("seq", "name", "document_id")).alias("first"))
        return per_doc.groupBy("entity_key").agg(
            F.sum("sign").alias("d_docs"), F.sum(F.col("sign") * F.col("n")).alias("d_mentions"),
            F.slice(F.sort_array(F.collect_list(F.when(F.col("sign") > 0, F.col("first")))), 1, NAMES).alias("came"),
            F.collect_set(F.when(F.col("sign") < 0, F.col("document_id"))).alias("gone"),
        )

    def _merge_entities(self, old: DataFrame, changes: DataFrame) -> DataFrame:
        both = old.join(changes, "entity_key", "full")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        none = F.array().cast(ENTITIES["names"].dataType)
        kept = F.filter(F.coalesce("names", none), lambda n: ~F.array_contains(F.coalesce("gone", F.array().cast("array<string>")), n["document_id"]))
        # Where not every document's first name is kept, one that came may stand behind one that isn't: only what lies before the last
        # kept one is known to be in order.
        last = F.when(F.size(F.coalesce("names", none)) < zero("n_docs"), F.try_element_at("names", F.lit(-1)))
        came = F.filter(F.coalesce("came", none), lambda n: last.isNull() | (n < last))
        out = both.select(
            "entity_key", (zero("n_docs") + zero("d_docs")).alias("n_docs"), (zero("n_mentions") + zero("d_mentions")).alias("n_mentions"),
            F.slice(F.sort_array(F.concat(kept, came)), 1, NAMES).alias("names"),
        ).where("n_mentions > 0")
        # All known names went, but not all mentions: these entities are looked up in the log.
        lost = out.where(F.size("names") == 0).select("entity_key")
        firsts = self.mentions.read().join(lost, "entity_key", "left_semi").groupBy("entity_key", "document_id").agg(F.min(F.struct("seq", "name", "document_id")).alias("first"))
        found = firsts.groupBy("entity_key").agg(F.slice(F.sort_array(F.collect_list("first")), 1, NAMES).alias("found"))
        return out.join(found, "entity_key", "left").withColumn("names", F.coalesce("found", "names")).drop("found")

    @staticmethod
    def _edge_changes(signed: DataFrame) -> DataFrame:
        per_doc = signed.groupBy("src", "tgt", "rel_type", "document_id", "sign").agg(F.count(F.lit(1)).alias("n"))
        return per_doc.groupBy("src", "tgt", "rel_type").agg(F.sum(F.col("sign") * F.col("n")).alias("d_weight"), F.sum("sign").alias("d_docs"))

    @staticmethod
    def _merge_edges(old: DataFrame, changes: DataFrame) -> DataFrame:
        both = old.join(changes, ["src", "tgt", "rel_type"], "full")
        plus = lambda c, d: F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(d), F.lit(0))
        return both.select("src", "tgt", "rel_type", plus("weight", "d_weight").alias("weight"), plus("n_docs", "d_docs").alias("n_docs")).where("weight > 0")

    def nodes(self) -> DataFrame:
        """entity_key, name (the first by its number), n_docs, n_mentions."""
        return self.entities.read().select("entity_key", F.element_at("names", 1)["name"].alias("name"), "n_docs", "n_mentions")
