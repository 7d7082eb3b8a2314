"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); a component is named by its smallest node.

    Alternating large and small star steps (Kiveris et al. 2014) hang every node
    below smaller and smaller neighbours until the graph is a forest of stars.
    Every step is a grouped minimum, which is partly summed before its shuffle,
    and a join on the node; no neighbourhood is gathered. Each round is written
    to the shared folder, so a lost executor repeats one round at most.
    """
    down = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                  "edges")
    before = None
    while (now := down.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) != before:
        before = now
        both = down.unionAll(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = stored(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return (down.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionAll(down.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
