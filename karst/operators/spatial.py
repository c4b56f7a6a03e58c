"""Distance joins as equi-joins on grid cells; counts and nearest neighbours through a k-d split.

A cell is as wide as the radius, so what is near lies in a point's own or a
neighbouring cell.  One side's rows are repeated for the neighbours (27 times in
space, 9 in the plane) and joined on the cell, and the distance decides.  Catalyst
picks the join; adaptive execution splits cells that are crowded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karst.functions import columns as C
from karst.operators import kd
from karst.operators.kd import knn, radius_count


#: Up to so many neighbours are looked for, more are counted.
MOST_NEAREST = 32


def squared(a: str, b: str, axes: str) -> Column:
    return reduce(lambda p, q: p + q, [(F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) * (F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) for c in axes])


def near_pairs(left: DataFrame, right: DataFrame, radius: float, axes: str = "xyz", prune: Column | None = None) -> DataFrame:
    """Structs a and b of all pairs at most radius apart, and d2. The side with fewer rows should be left: it is repeated."""
    lhs = left.select(F.struct(*left.columns).alias("a"), *[C.voxel(c, radius).alias(f"k{c}") for c in axes])
    for c in axes:
        own = F.col(f"k{c}")
        lhs = lhs.withColumn(f"k{c}", F.explode(F.array(own - 1, own, own + 1)))
    rhs = right.select(F.struct(*right.columns).alias("b"), *[C.voxel(c, radius).alias(f"k{c}") for c in axes])
    d2 = squared("a", "b", axes)
    found = lhs.join(rhs, [f"k{c}" for c in axes]).where(d2 <= radius * radius)
    return (found if prune is None else found.where(prune)).select("a", "b", d2.alias("d2"))


def radius_outliers(points: DataFrame, radius: float, least: int, axes: str = "xyz") -> DataFrame:
    """Points with at least so many within radius, themselves included; the rest go.

    The last of so many nearest tells; many (over MOST_NEAREST) are counted instead.
    """
    if radius <= 0 or least < 1:
        raise ValueError("radius and least number are above zero")
    if least <= MOST_NEAREST:
        enough = knn(points, least, axes, itself=True, within=radius).where(F.col("place") == least - 1)
    else:
        enough = radius_count(points, radius, axes).where(F.col("n") >= least)
    return points.join(enough.select("pid"), "pid", "left_semi")


def statistical_outliers(points: DataFrame, k: int, ratio: float, axes: str = "xyz") -> DataFrame:
    """Points whose mean distance to their k nearest is at most the mean of those means plus ratio population deviations."""
    mean = knn(points, k, axes).groupBy("pid").agg(F.avg(F.sqrt("d2")).alias("d"))
    limit = mean.agg((F.avg("d") + F.lit(ratio) * F.stddev_pop("d")).alias("limit"))
    kept = mean.crossJoin(F.broadcast(limit)).where("d <= limit").select("pid")  # limit is one row
    return points.join(kept, "pid", "left_semi")


def ball_query(stations: DataFrame, points: DataFrame, radius: float, axes: str = "xy") -> DataFrame:
    """Structs a (station) and b (point) of all points at most radius from a station."""
    return near_pairs(stations, points, radius, axes)


def nearest(points: DataFrame, anchors: DataFrame, axes: str = "xyz", within: float | None = None) -> DataFrame:
    """Each point's pid with its nearest anchor's pid and d2, ties by the anchor's pid; points without one within the distance go.

    Through the leaves of a k-d split, for any number of points and anchors: a point
    asks for its nearest anchor only, however many lie within the distance.
    """
    return kd.nearest(points, anchors, axes, within=within)
