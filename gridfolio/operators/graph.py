"""Entity graph: extraction, upsert by aggregation, neighbourhoods, related documents and communities, as edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridfolio.functions import numeric, text
from gridfolio.session import written

#: Capitalised words that are no entities.
STOP_ENTITIES = [
    "the", "this", "that", "these", "those", "a", "an", "and", "or", "but",
    "section", "page", "figure", "table", "chapter", "article", "clause",
    "appendix", "exhibit", "schedule", "annex", "introduction", "scope",
    "overview", "summary", "conclusion", "abstract", "note", "notes",
    "january", "february", "march", "april", "may", "june", "july", "august",
    "september", "october", "november", "december",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
    "company", "agreement", "policy", "document", "report", "we", "i", "it",
    "he", "she", "they", "you", "however", "therefore", "moreover", "furthermore",
]
#: Names that an extraction model makes up from the layout of a document.
JUNK_ENTITIES = [
    "table of contents", "table of content", "table of co", "table of", "prepared", "strategic review", "overview", "introduction", "conclusion",
    "annexure", "appendix", "section", "chapter", "schedule", "page", "note", "notes",
]
#: Fixed value: a capitalised word.
CAPITALISED = r"[A-Z][A-Za-z0-9&.\-']*"
#: One to six of them. The flag gives boundaries and white space their Unicode sense.
ENTITY = rf"(?U)\b{CAPITALISED}(?:\s+{CAPITALISED}){{0,5}}\b"
MAX_ENTITIES = 20


def mentions(df: DataFrame, id_col: str, text_col: str, most: int = MAX_ENTITIES) -> DataFrame:
    """id, entity_key, name, position of the first ``most`` different entities of each text, in order of appearance.

    A single word from the stop list is no entity. All per-row: arrays are cut before they are exploded.
    """
    names = F.transform(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(ENTITY), F.lit(0)), lambda x: F.btrim(x, F.lit(" .")))
    found = F.transform(names, lambda x: F.struct(text.canonical_key(x).alias("key"), x.alias("name")))
    kept = F.filter(found, lambda e: ~e["key"].isin(*STOP_ENTITIES) & (e["key"] != ""))
    # A projection of its own: inside the next one the text would be searched twice.
    rows = df.select(F.col(id_col).alias("id"), kept.alias("kept"))
    rows = rows.select("id", "kept", F.slice(F.array_distinct(F.transform("kept", lambda e: e["key"])), 1, most).alias("keys"))
    rows = rows.select("id", "kept", F.posexplode("keys").alias("position", "entity_key"))
    name = F.element_at(F.filter("kept", lambda e: e["key"] == F.col("entity_key")), 1)["name"]
    return rows.select("id", "entity_key", name.alias("name"), "position")


def relation_type(name: Column) -> Column:
    """Upper case, [A-Z0-9_] only, 64 characters at most; RELATES_TO if nothing is left."""
    safe = F.left(F.regexp_replace(F.regexp_replace(F.upper(F.trim(F.coalesce(name, F.lit("")))), r"[\s\-]+", "_"), "[^A-Z0-9_]", ""), F.lit(64))
    return F.when(safe == "", "RELATES_TO").otherwise(safe)


def entities(log: DataFrame) -> DataFrame:
    """Entity nodes from a mention log (entity_key, name, document_id, seq): first name by seq, documents, mentions."""
    return log.groupBy("entity_key").agg(
        F.min_by("name", "seq").alias("name"),
        F.sort_array(F.collect_set("document_id")).alias("doc_ids"),
        F.count_distinct("document_id").alias("n_docs"),
        F.count(F.lit(1)).alias("n_mentions"),
    )


def relations(log: DataFrame) -> DataFrame:
    """Relation edges from a log (src, tgt, rel_type, description, document_id, confidence, seq).

    One edge per pair and type: weight counts its rows, the description is the first that isn't blank, the
    confidence the first that is known. Self-loops are left out.
    """
    rows = log.where("src <> tgt").withColumn("rel_type", relation_type(F.col("rel_type")))
    described = F.when(F.trim(F.coalesce("description", F.lit(""))) != "", F.col("description"))
    return rows.groupBy("src", "tgt", "rel_type").agg(
        F.count(F.lit(1)).alias("weight"),
        F.min_by(described, F.when(described.isNotNull(), F.col("seq"))).alias("description"),
        F.min_by("confidence", F.when(F.col("confidence").isNotNull(), F.col("seq"))).alias("confidence"),
        F.sort_array(F.collect_set("document_id")).alias("doc_ids"),
    )


def undirected(edges: DataFrame) -> DataFrame:
    """Parallel edges in either direction as one (a < b) with the sum of their weights; those not above 0 are left out."""
    a, b = F.least("src", "tgt"), F.greatest("src", "tgt")
    return edges.where("src <> tgt").groupBy(a.alias("a"), b.alias("b")).agg(F.sum("weight").alias("weight")).where("weight > 0")


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """node, hop of all nodes within ``hops`` undirected edges of the seeds (node); hop is the fewest edges.

    The frontier of a hop is deduplicated and written before the next join, so work follows the nodes reached and not the
    walks, and no hop is computed twice.
    """
    both = edges.select(F.col("src").alias("from"), F.col("tgt").alias("to")).union(edges.select("tgt", "src")).distinct()
    frontier = written(seeds.select("node").distinct().withColumn("hop", F.lit(0)), "frontier")
    reached = frontier
    for hop in range(1, hops + 1):
        step = both.join(frontier, both["from"] == frontier["node"], "left_semi").select(F.col("to").alias("node")).distinct()
        frontier = written(step.join(reached.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)), "frontier")
        reached = reached.unionByName(frontier)
    return reached


def seeds_by_name(nodes: DataFrame, names: list[str], column: str = "entity_key", shortest: int = 3) -> DataFrame:
    """Nodes whose key contains one of the names or is contained in it; names below ``shortest`` letters must be equal."""
    key = F.col(column)
    hit = F.lit(False)
    for n in sorted({" ".join(x.lower().split()) for x in names} - {""}):
        hit = hit | (key == n)
        if len(n) >= shortest:
            hit = hit | F.contains(key, F.lit(n)) | (F.contains(F.lit(n), key) & (F.length(key) >= shortest))
    return nodes.where(hit).select(key.alias("node"))


def chunks_in_reach(reached: DataFrame, log: DataFrame, limit: int) -> DataFrame:
    """Chunks that mention reached nodes: smallest hop, score 1 / (1 + hop), best first (mention log: entity_key, chunk_id)."""
    hops = log.join(reached, log["entity_key"] == reached["node"]).groupBy("chunk_id").agg(F.min("hop").alias("hop"))
    return hops.withColumn("score", 1 / (1 + F.col("hop"))).orderBy(F.col("score").desc(), "chunk_id").limit(limit)


def related_documents(log: DataFrame, keys: DataFrame, limit: int) -> DataFrame:
    """Documents by the number of different matched entities (log: entity_key, document_id; keys: node)."""
    hits = log.join(keys, log["entity_key"] == keys["node"], "left_semi").groupBy("document_id").agg(F.count_distinct("entity_key").alias("n_entities"))
    return hits.orderBy(F.col("n_entities").desc(), "document_id").limit(limit)


def listing(nodes: DataFrame, log: DataFrame) -> DataFrame:
    """All entities with the number of their documents, 0 without any."""
    counts = log.groupBy("entity_key").agg(F.count_distinct("document_id").alias("doc_count"))
    return nodes.join(counts, "entity_key", "left").withColumn("doc_count", F.coalesce("doc_count", F.lit(0)))


def without_document(log: DataFrame, document_id) -> DataFrame:
    """The log without a document; nodes, edges and communities follow by recomputation."""
    return log.where(~F.col("document_id").eqNullSafe(F.lit(document_id)))


def stats(nodes: DataFrame, edges: DataFrame, log: DataFrame, groups: DataFrame) -> DataFrame:
    parts = [("entities", nodes.select("entity_key")), ("relations", edges), ("mentions", log), ("documents", log.select("document_id").distinct()), ("communities", groups.select("community").distinct())]
    out = None
    for name, df in parts:
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("item"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """node, community by weighted label propagation over (src, tgt, weight); ties go to the smaller label.

    Deterministic: all nodes take the label with the most weight among their neighbours and themselves at once,
    every second round only where it is smaller, which ends the swapping of pairs. Each round is written, so the
    plan stays short; it ends early when no label changes.
    """
    pairs = undirected(edges)
    both = written(pairs.select("a", "b", "weight").union(pairs.select("b", "a", "weight")), "lpa-edges")
    labels = written(both.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node")), "lpa-labels")
    for r in range(rounds):
        votes = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "community", "weight")
        votes = votes.unionByName(labels.select("node", "community", F.lit(0).cast("double").alias("weight")))
        totals = votes.groupBy("node", "community").agg(F.sum("weight").alias("weight"))
        rank = F.row_number().over(Window.partitionBy("node").orderBy(F.col("weight").desc(), "community"))
        best = totals.withColumn("r", rank).where("r = 1").select("node", F.col("community").alias("new"))
        joined = labels.join(best, "node")
        take = F.least("community", "new") if r % 2 else F.col("new")
        after = written(joined.select("node", take.alias("community")), "lpa-labels")
        changed = after.join(labels.withColumnRenamed("community", "old"), "node").where("community <> old").limit(1).count()
        labels = after
        if not changed and r:
            break
    return labels


def modularity(edges: DataFrame, groups: DataFrame) -> float:
    """The share of weight inside communities less what chance would put there; edges (src, tgt, weight), groups (node, community)."""
    pairs = undirected(edges)
    total = pairs.agg(F.sum("weight")).first()[0] or 0.0
    if not total:
        return 0.0
    own = groups.select("node", "community")
    ends = pairs.join(own.toDF("a", "ca"), "a").join(own.toDF("b", "cb"), "b")
    inside = ends.where("ca = cb").agg(F.sum("weight")).first()[0] or 0.0
    degrees = ends.select(F.explode(F.array("ca", "cb")).alias("community"), "weight").groupBy("community").agg(F.sum("weight").alias("d"))
    return inside / total - (degrees.agg(F.sum(F.pow(F.col("d") / (2 * total), 2))).first()[0] or 0.0)


def communities(edges: DataFrame, rounds: int = 8, levels: int = 5) -> DataFrame:
    """node, community by modularity: nodes move to the neighbouring community that gains most, then communities become nodes.

    Deterministic: all nodes decide at once; one that gains equally by several takes the smaller label. In each round only nodes of one
    half, by hash, may move, so that neighbours don't swap places for ever. Each round and level is written; it ends
    when no node moves. A community is named by its smallest node.
    """
    pairs = written(undirected(edges), "louvain-edges")
    total = pairs.agg(F.sum("weight")).first()[0] or 0.0
    links = written(pairs.select("a", "b", "weight").union(pairs.select("b", "a", "weight")), "louvain-links")
    members = written(links.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node")), "louvain-members")
    for _ in range(levels if total else 0):
        labels = _moved(links, total, rounds)
        if labels is None:
            break
        members = written(members.join(labels.toDF("community", "__to"), "community").select("node", F.col("__to").alias("community")), "louvain-members")
        to = labels.select(F.col("node").alias("b"), F.col("community").alias("cb"))
        joined = links.join(labels.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(to, "b")
        # Weight inside a community stays as a loop of its node.
        links = written(joined.groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("weight").alias("weight")), "louvain-links")
    names = members.groupBy("community").agg(F.min("node").alias("name"))
    return members.join(names, "community").select("node", F.col("name").alias("community"))


def _moved(links: DataFrame, total: float, rounds: int) -> DataFrame | None:
    """node, community after moving single nodes; None if none gains. ``links`` holds both directions, and loops once with both halves."""
    degrees = written(links.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("degree")), "louvain-degrees")
    labels = written(degrees.select("node", F.col("node").alias("community")), "louvain-labels")
    moved, still = False, 0
    for r in range(2 * rounds):
        placed = labels.join(degrees, "node")
        sums = placed.groupBy("community").agg(F.sum("degree").alias("sum"))
        near = links.where("a <> b").join(labels.toDF("b", "to"), "b").groupBy(F.col("a").alias("node"), "to").agg(F.sum("weight").alias("w"))
        own = placed.select("node", F.col("community").alias("now"), "degree")
        options = near.unionByName(labels.select("node", F.col("community").alias("to"), F.lit(0.0).alias("w"))).groupBy("node", "to").agg(F.sum("w").alias("w"))
        scored = options.join(own, "node").join(sums.toDF("to", "sum"), "to")
        rest = F.col("sum") - F.when(F.col("to") == F.col("now"), F.col("degree")).otherwise(0.0)
        gain = F.round(F.col("w") - F.col("degree") * rest / F.lit(2.0 * total), 9)
        rank = F.row_number().over(Window.partitionBy("node").orderBy(F.col("gain").desc(), (F.col("to") != F.col("now")).cast("int"), "to"))
        best = scored.withColumn("gain", gain).withColumn("r", rank).where("r = 1")
        turn = F.pmod(F.xxhash64("node"), F.lit(2)) == r % 2
        after = written(best.select("node", F.when(turn, F.col("to")).otherwise(F.col("now")).alias("community"), (turn & (F.col("to") != F.col("now"))).alias("changed")), "louvain-labels")
        changes = after.where("changed").limit(1).count()
        labels = after.select("node", "community")
        moved, still = moved or bool(changes), 0 if changes else still + 1
        if still == 2:
            break
    return labels if moved else None


def summaries(groups: DataFrame, names: DataFrame, shown: int = 10, least: int = 3, most: int = 40) -> DataFrame:
    """The largest communities of at least ``least`` members with a summary that names the first ``shown`` of them."""
    rows = groups.join(names, groups["node"] == names["entity_key"])
    sizes = rows.groupBy("community").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    largest = sizes.orderBy(F.col("size").desc(), "community").limit(most)
    # Only the names that are shown are gathered: a window over few rows a community, cut before its shuffle.
    rank = F.row_number().over(Window.partitionBy("community").orderBy("name"))
    first = rows.join(F.broadcast(largest), "community", "left_semi").withColumn("rank", rank).where(F.col("rank") <= shown)
    members = first.groupBy("community").agg(F.sort_array(F.collect_list("name")).alias("members"))
    summary = F.concat(F.lit("Contains "), F.col("size").cast("string"), F.lit(" related entities: "), F.array_join("members", ", "))
    return largest.join(members, "community").select("community", "size", summary.alias("summary")).orderBy(F.col("size").desc(), "community")


def communities_by_vector(groups: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k communities whose embedding is nearest, over all of them."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return groups.withColumn("distance", numeric.cosine_distance(F.col("embedding"), q)).where("distance is not null").orderBy("distance", "community").limit(k)


def extracted(raw: DataFrame, column: str = "response") -> DataFrame:
    """Entities and relations of a model's JSON responses: id, entities, relations; junk names and repeats are left out."""
    from gridfolio.functions.nested import tolerant_json

    shape = "struct<entities: array<struct<name: string, type: string>>, relations: array<struct<source: string, target: string, type: string>>>"
    parsed = raw.select("id", F.from_json(tolerant_json(F.col(column)).cast("string"), shape).alias("g"))
    names = F.filter(F.coalesce("g.entities", F.array().cast("array<struct<name:string,type:string>>")), lambda e: F.trim(F.coalesce(e["name"], F.lit(""))) != "")
    keyed = F.transform(names, lambda e: F.struct(text.canonical_key(e["name"]).alias("key"), e["name"].alias("name"), e["type"].alias("type")))
    good = F.filter(keyed, lambda e: ~e["key"].isin(*JUNK_ENTITIES) & (F.length(e["key"]) > 1))
    once = F.filter(good, lambda e, i: (i == 0) | ~F.exists(F.slice(good, 1, F.greatest(i, F.lit(1))), lambda x: x["key"] == e["key"]))
    links = F.transform(
        F.coalesce("g.relations", F.array().cast("array<struct<source:string,target:string,type:string>>")),
        lambda r: F.struct(text.canonical_key(r["source"]).alias("src"), text.canonical_key(r["target"]).alias("tgt"), relation_type(r["type"]).alias("rel_type")),
    )
    links = F.array_distinct(F.filter(links, lambda r: (r["src"] != "") & (r["tgt"] != "") & (r["src"] != r["tgt"])))
    return parsed.select("id", once.alias("entities"), links.alias("relations"))


def sentence_relations(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """An offline stand-in for a model's relations: entities of one sentence, each with the one after it, as CO_OCCURS."""
    parts = df.select(F.col(id_col).alias("document_id"), F.posexplode(text.sentences(F.col(text_col))).alias("seq", "sentence"))
    found = F.filter(F.transform(F.regexp_extract_all("sentence", F.lit(ENTITY), F.lit(0)), text.canonical_key), lambda k: ~k.isin(*STOP_ENTITIES, *JUNK_ENTITIES))
    pairs = F.transform(F.sequence(F.lit(1), F.size("e") - 1), lambda i: F.struct(F.get("e", i - 1).alias("src"), F.get("e", i).alias("tgt")))
    rows = parts.select("document_id", "seq", F.array_distinct(found).alias("e")).where(F.size("e") > 1).select("document_id", "seq", F.explode(pairs).alias("p"))
    return rows.select("p.src", "p.tgt", F.lit("CO_OCCURS").alias("rel_type"), F.lit(None).cast("string").alias("description"), "document_id", F.lit(None).cast("double").alias("confidence"), "seq")


def route(cue_global: bool, has_entities: bool) -> str:
    """local where the question names known entities, global where it asks about all of the collection, else none."""
    return "global" if cue_global else "local" if has_entities else "none"


def map_reduce(groups: DataFrame, score: Column, answer: Column, k: int) -> DataFrame:
    """Partial answers of communities by score as one ordered text."""
    top = groups.select("community", score.alias("score"), answer.alias("answer")).where("score > 0").orderBy(F.col("score").desc(), "community").limit(k)
    parts = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "community", "answer")))
    return top.agg(F.array_join(F.transform(parts, lambda p: p["answer"]), "\n\n").alias("answer"), F.count(F.lit(1)).alias("n"))
