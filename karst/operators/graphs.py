"""Connected components of small and middling graphs, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.operators.lineage import table


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root for every node (column id): the smallest id that edges (a, b) reach.

    Each round takes the least root over a node's neighbours, then the root of its
    root, so rounds are about the logarithm of the longest way; minima are
    pre-aggregated, so a hub's edges are never gathered.
    """
    both = table(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    own, last = table(nodes.select(F.col("id").alias("node"), F.col("id").alias("root"))), None
    while True:  # each round makes some root smaller, or is the last
        near = both.join(own, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("least"))
        new = own.join(near, "node", "left").select("node", F.least("root", F.coalesce("least", "root")).alias("root"))
        named = new.select(F.col("node").alias("root"), F.col("root").alias("over"))
        own = table(new.join(named, "root").select("node", F.col("over").alias("root")))
        mark = own.agg(F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if mark == last:
            return own
        last = mark
