"""Connected components of an edge table, by alternating star operations on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfolio.llm.text import hot_limit
from gridfolio.session import discard, written


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that is connected to it) for every node of ``edges`` (a, b).

    Large-star links the larger neighbours of a node to its smallest neighbour, small-star the smaller ones;
    the edges turn into stars in a number of rounds that grows with the logarithm of the longest chain. Each
    round is written to the shared folder, so that neither the plan nor lost work accumulates. Nothing but the
    number of edges and a checksum reaches the driver. Self-edges make single nodes; an empty table gives no rows.
    """
    # Written first: what makes the edges may be dear, and they are read twice.
    edges = written(edges.select("a", "b").distinct(), "links")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node"))
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        # A round reads only what the one before wrote, so that may go.
        before, seen, stars = now, mark, written(_large_star(now, mark[0]), "stars")
        now = written(_small_star(stars, mark[0]), "edges")
        discard(before)
        discard(stars)
        mark = _mark(now)
        if mark == seen or _are_stars(now):
            break
    roots = now.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return nodes.distinct().join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge and no root has any: nothing would change any more."""
    ends = edges.select("v", F.lit(1).alias("n")).unionAll(edges.select(F.col("u").alias("v"), F.lit(0).alias("n")).distinct())
    return not ends.groupBy("v").agg(F.count(F.lit(1)).alias("k")).where("k > 1").limit(1).count()


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``edges`` (v, u) with the number ``m`` of their node v, where ``least`` has v, m and how many edges v has.

    The edges of a node with very many stay where they are: such nodes are few, at most 20,000 for any number of
    edges, so they are broadcast. Only the edges of all others are shuffled by their node.
    """
    least = written(least, "least")
    limit = hot_limit(total)
    if least.where(F.col("n") > limit).limit(1).count() == 0:
        return edges.join(least.select("v", "m"), "v").select("v", "u", "m")
    hot = F.broadcast(least.where(F.col("n") > limit).select("v", "m"))
    found = edges.join(hot, "v").select("v", "u", "m")
    rest = edges.join(hot.select("v"), "v", "left_anti").join(least.where(F.col("n") <= limit).select("v", "m"), "v").select("v", "u", "m")
    return found.union(rest)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Each neighbour larger than the node is linked to the smallest of the node and its neighbours. Links may repeat."""
    both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
    least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    # Larger neighbours of v are the edges (u > v), so v is the smaller end of an edge.
    up = edges.select(F.col("u").alias("v"), F.col("v").alias("u"))
    return _with_least(up, least, total).select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u")


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n"))
    joined = _with_least(edges, least, total)
    # The node's own link comes with its smallest neighbour's row, which would be a link to itself.
    links = joined.select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u"))
    return links.where("v <> u").distinct()
