"""Connected components of a graph given as pairs of longs, by alternating stars.

Each round links every node to its smallest neighbour (large star), then the smaller
neighbours of a node to the smallest of them (small star), until the edges are a star around
the smallest node of each component. That is looked up before each round, in one aggregation,
so edges that come as such stars take no round. Rounds are stored in the shared folder.
Nothing but a row a round reaches the driver, and a node with many edges is aggregated before
the shuffle and may be split by an adaptive join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import cut_lineage


def _settled(edges: DataFrame) -> bool:
    """Whether distinct edges, from larger to smaller nodes, are stars: one edge from a node, none from the middle."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("out")))
    return ends.groupBy("node").agg(F.sum("out").alias("n"), F.count("*").alias("all")).where("n > 1 OR (n = 1 AND all > 1)").isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) for each node of ``edges`` (columns a, b); the label is the component's smallest node."""
    now = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        if _settled(now):
            break
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        now = cut_lineage(small.where("a <> b").distinct())
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
