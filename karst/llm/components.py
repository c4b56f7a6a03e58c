"""Connected components of a graph of links, in rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.llm.common import stored

MOST_ROUNDS = 60


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a long, b long); root: the smallest node that links reach.

    Each round hangs every node's larger neighbours, then its smaller ones, on its
    smallest; minima are pre-aggregated before a shuffle, and no node's neighbours
    are gathered in one place.  The links of a round are a table in the shared
    folder, so nothing goes to the driver but a count and a checksum.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    mark = _mark(edges)
    for turn in range(MOST_ROUNDS + 1 if mark[0] else 0):
        if turn == MOST_ROUNDS:
            raise RuntimeError(f"components are not settled after {MOST_ROUNDS} rounds")
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(low.select("a", F.col("m").alias("b")))
        edges = stored(small.distinct(), "links")
        last, mark = mark, _mark(edges)
        if mark == last:
            break
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
