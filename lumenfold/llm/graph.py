"""Connected components of an edge table, in the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.store import Tables


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; the root is the least node of its component.

    Each round hooks every larger end to its least smaller neighbour and then jumps to that one's own
    parent, so stars settle in one round and chains halve. Every round's edges are a written table;
    a hot root sits on a plain side of its join, where adaptive execution splits it.
    """
    big, small = F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")
    link = tables.keep(edges.select(big, small).where("v <> u").distinct())
    while True:
        parent = tables.keep(link.groupBy("v").agg(F.min("u").alias("p")))
        up = parent.select(F.col("v").alias("u"), F.col("p").alias("pp"))
        joined = link.join(parent, "v").join(up, "u", "left")
        # Each link (v, u) becomes: u to v's parent, and v to the parent's parent.
        other = joined.where("u <> p").select(F.greatest("u", "p").alias("v"), F.least("u", "p").alias("u"))
        own = joined.where("u = p").select("v", F.coalesce("pp", "p").alias("u"))
        after = tables.keep(other.union(own).distinct())
        moved = joined.where("u <> p OR pp IS NOT NULL").limit(1).count()
        tables.drop(link, parent)
        link = after
        if not moved:
            break
    return link.select(F.col("v").alias("node"), F.col("u").alias("root")).union(link.select(F.col("u"), F.col("u")).distinct())
