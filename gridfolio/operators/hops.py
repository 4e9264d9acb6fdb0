"""Multi-hop expansion over a mention log: from entities to texts, from these to further entities, hop by hop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfolio.session import written

HOPS, PER_HOP = 2, 20


def expanded(log: DataFrame, seeds: DataFrame, hops: int = HOPS, per_hop: int = PER_HOP, id_col: str = "chunk_id") -> DataFrame:
    """id, hop, n_shared: the texts that a question reaches. ``log`` has a row (id, entity_key) a mention, ``seeds`` the question's entities (node).

    The first hop takes the ``per_hop`` texts that mention most of the seeds, ties by id. What else these mention is the frontier of
    the next hop, which takes texts not taken before. An entity is followed once. Each hop's texts and frontier are
    written, and both are bounded by ``per_hop``: the log is read once a hop, and only counts of reached texts are shuffled. A log
    to be read often should be a stored table.
    """
    pairs = log.select(F.col(id_col).alias("id"), "entity_key")
    seen = frontier = written(seeds.select(F.col("node").alias("entity_key")).distinct(), "frontier")
    found: DataFrame | None = None
    for hop in range(hops):
        # Seeds may be many; what a hop reaches is few.
        near = pairs.join(frontier if hop == 0 else F.broadcast(frontier), "entity_key")
        near = near if found is None else near.join(F.broadcast(found.select("id")), "id", "left_anti")
        counts = near.groupBy("id").agg(F.count_distinct("entity_key").alias("n_shared"))
        own = written(counts.orderBy(F.col("n_shared").desc(), "id").limit(per_hop).withColumn("hop", F.lit(hop)).select("id", "hop", "n_shared"), "hop")
        found = own if found is None else found.unionByName(own)
        if hop + 1 < hops:
            reached = pairs.join(F.broadcast(own.select("id")), "id", "left_semi").select("entity_key").distinct()
            frontier = written(reached.join(seen, "entity_key", "left_anti"), "frontier")
            seen = seen.unionByName(frontier)
    return found
