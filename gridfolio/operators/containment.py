"""Which names of two tables contain each other, without comparing each with each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfolio.session import written

#: Letters of a gram: a shorter name must be equal to count.
GRAM = 3


def _grams(key: Column) -> Column:
    """The different runs of GRAM letters of a name."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(key) - GRAM + 1), lambda i: F.substring(key, i, F.lit(GRAM))))


def _inside(short: DataFrame, long: DataFrame) -> DataFrame:
    """short, long: pairs of keys of which the second contains the first.

    Every gram of a contained name is in the name that contains it, so one of them is enough to find it: the one that the fewest
    names of the other side have. Names with a gram that none of them has are left out by that alone.
    """
    holders = written(long.where(F.length("key") >= GRAM).select(F.col("key").alias("long"), F.explode(_grams(F.col("key"))).alias("gram")), "grams")
    counts = holders.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    asked = short.where(F.length("key") >= GRAM).select(F.col("key").alias("short"), F.explode(_grams(F.col("key"))).alias("gram"))
    rarest = asked.join(counts, "gram", "left").groupBy("short").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"), F.min(F.coalesce("n", F.lit(0))).alias("n"))
    found = rarest.where("n > 0").join(holders, "gram")
    return found.where((F.length("long") >= F.length("short")) & F.contains("long", F.col("short"))).select("short", "long")


def contained_pairs(left: DataFrame, right: DataFrame, left_col: str, right_col: str) -> DataFrame:
    """left, right: each pair of different names of two tables of which one contains the other, or that are equal, once.

    Names are compared in lower case with single blanks; of names below GRAM letters only equal ones count, and blank ones not at all.
    The work follows the candidates that share their rarest gram, and not the product of the tables.
    """
    def clean(c: str) -> Column:
        return F.trim(F.regexp_replace(F.lower(F.col(c)), r"\s+", " "))

    a, b = (written(df.select(clean(c).alias("key")).where("key <> ''").distinct(), "names") for df, c in ((left, left_col), (right, right_col)))
    in_right = _inside(a, b).select(F.col("short").alias("left"), F.col("long").alias("right"))
    in_left = _inside(b, a).where("short <> long").select(F.col("long").alias("left"), F.col("short").alias("right"))
    short = a.where(F.length("key") < GRAM).join(b, "key").select(F.col("key").alias("left"), F.col("key").alias("right"))
    return in_right.unionByName(in_left).unionByName(short)


def seeds(nodes: DataFrame, names: DataFrame, column: str = "entity_key", name: str = "name") -> DataFrame:
    """node: the nodes whose key contains one of the names or is contained in one."""
    keyed = nodes.select(F.col(column).alias("node"), F.trim(F.regexp_replace(F.lower(F.col(column)), r"\s+", " ")).alias("left"))
    return keyed.join(contained_pairs(nodes, names, column, name), "left", "left_semi").select("node").distinct()
