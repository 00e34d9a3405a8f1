"""Connected components by alternating large-star and small-star joins.

Both steps replace edges by edges towards the smallest known neighbour and keep
the components.  Each node's minimum is aggregated map-side and written before
it is joined back, so both join sides come from their own exchange and a hub's
partition can be split.  Nothing is collected but whether the work is done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkassay.llm._store import Scratch


def _settled(edges: DataFrame) -> bool:
    """Every larger node has one edge and no smaller node has an edge to a still smaller one."""
    ends = edges.select(F.col("hi").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("lo", F.lit(0), F.lit(1)))
    found = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return found.where("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def _large(edges: DataFrame, scratch: Scratch) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
    least = scratch.cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    out = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
    out = scratch.cut(out, "large")
    scratch.drop([least])
    return out


def _small(edges: DataFrame, scratch: Scratch) -> DataFrame:
    least = scratch.cut(edges.groupBy("hi").agg(F.min("lo").alias("m")), "least")
    moved = edges.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    out = scratch.cut(moved.union(least.select("hi", F.col("m").alias("lo"))).distinct(), "small")
    scratch.drop([least])
    return out


def components(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable), for nodes in a pair (a, b), a <> b."""
    edges = scratch.cut(
        pairs.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct(), "edges"
    )
    while not _settled(edges):
        grown = _large(edges, scratch)
        after = _small(grown, scratch)
        scratch.drop([edges, grown])
        edges = after
    # at the end every edge points to its component's smallest node
    return scratch.cut(
        edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(edges.select("lo", "lo").distinct()), "components"
    )
