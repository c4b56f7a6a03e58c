"""Joins and filters along a key or around points that Catalyst has no operator for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karst.functions import columns as C
from karst.operators.scans import Line
from karst.operators.spatial import near_pairs

#: Up to so many ranges or marks are sent to every task.
MOST_SENT = 10_000


def range_join(rows: DataFrame, ranges: DataFrame, key: str, low: str, high: str, width: float | None = None) -> DataFrame:
    """rows with the columns of every range that holds key (low <= key < high).

    A checked small number of ranges is sent to all tasks; more are dealt into bins
    of `width` (by default as wide as the widest range), which makes an equi-join.
    """
    inside = (F.col(key) >= F.col(low)) & (F.col(key) < F.col(high))
    if ranges.limit(MOST_SENT + 1).count() <= MOST_SENT:
        return rows.join(F.broadcast(ranges), inside)
    size = F.lit(float(width or ranges.agg(F.max(F.col(high) - F.col(low))).first()[0] or 1.0))
    dealt = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size))))
    return rows.withColumn("_bin", F.floor(F.col(key) / size)).join(dealt, "_bin").where(inside).drop("_bin")


def nearest_key(rows: DataFrame, known: DataFrame, key: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """rows with the value of the known row whose key is nearest (the smaller key on a tie), and its distance; one window, no join of all with all."""
    named = known.select(*by, key, F.lit(0).alias("_asked"), F.struct(F.col(key).alias("k"), F.col(value).alias("v")).alias("_p"))
    both = rows.withColumn("_row", F.struct(*rows.columns)).select(*by, key, F.lit(1).alias("_asked"), F.lit(None).cast(named.schema["_p"].dataType).alias("_p"), "_row").unionByName(named.withColumn("_row", F.lit(None).cast(rows.withColumn("_row", F.struct(*rows.columns)).schema["_row"].dataType)))
    w = Window.partitionBy(*by).orderBy(key, "_asked")
    a = F.last("_p", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first("_p", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    placed = both.withColumn("_a", a).withColumn("_b", b).where("_asked = 1")
    left, right = F.col(key) - F.col("_a.k"), F.col("_b.k") - F.col(key)
    first = F.col("_b").isNull() | (left <= right)
    return placed.select("_row.*", F.when(F.col("_a").isNotNull() & first, F.col("_a.v")).otherwise(F.col("_b.v")).alias(f"near_{value}"), F.when(F.col("_a").isNotNull() & first, left).otherwise(right).alias("gap"))


def nearest_rows(stations: DataFrame, points: DataFrame, n: int, reach: float, axes: str = "xy") -> DataFrame:
    """station, pid, d2, place (from 1): the n nearest points within reach of each station; the rank's limit goes before the shuffle."""
    pairs = near_pairs(stations, points, reach, axes).select(F.col("a.pid").alias("station"), F.col("b.pid").alias("pid"), "d2")
    rank = F.row_number().over(Window.partitionBy("station").orderBy("d2", "pid"))
    return pairs.withColumn("place", rank).where(F.col("place") <= n)


def disc(points: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    """Points less than radius away in the plane."""
    return points.where(F.hypot(F.col("x") - F.lit(float(x)), F.col("y") - F.lit(float(y))) < F.lit(float(radius)))


def strip(points: DataFrame, x: float, y: float, direction: Sequence[float], ahead: tuple[float, float], half: float) -> DataFrame:
    """Points of an oriented strip: so far ahead of (x, y) along a direction, and at most half to its sides; along and across are added."""
    n = (direction[0] ** 2 + direction[1] ** 2) ** 0.5
    if not n:
        raise ValueError("a direction is not zero")
    u, v = direction[0] / n, direction[1] / n
    dx, dy = F.col("x") - F.lit(float(x)), F.col("y") - F.lit(float(y))
    along, across = dx * F.lit(u) + dy * F.lit(v), dy * F.lit(u) - dx * F.lit(v)
    return points.withColumns({"along": along, "across": across}).where(F.col("along").between(*ahead) & (F.abs("across") <= half))


def aperture_screen(points: DataFrame, holes: DataFrame, factor: float) -> DataFrame:
    """points with screened: whether one lies within factor times a hole's semi_major of its centre. A checked small number of holes is sent to all tasks, more meet points through cells."""
    h = holes.select(F.col("x").alias("hx"), F.col("y").alias("hy"), (F.lit(float(factor)) * F.col("semi_major")).alias("hr"))
    near = F.hypot(F.col("x") - F.col("hx"), F.col("y") - F.col("hy")) <= F.col("hr")
    if h.limit(MOST_SENT + 1).count() <= MOST_SENT:
        hit = points.join(F.broadcast(h), near, "left_semi")
    else:
        widest = h.agg(F.max("hr")).first()[0] or 1.0
        pairs = near_pairs(h.select(F.col("hx").alias("x"), F.col("hy").alias("y"), "hr"), points.select("pid", "x", "y"), widest, "xy")
        hit = pairs.where(F.sqrt("d2") <= F.col("a.hr")).select(F.col("b.pid").alias("pid")).distinct()
    return points.join(hit.select("pid", F.lit(True).alias("screened")), "pid", "left").withColumn("screened", F.coalesce("screened", F.lit(False)))


def trimmed(rows: DataFrame, order: str, n: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """rows without the first and last n of each key."""
    if not by:
        line = Line.of(rows, [order])
        return line.rows.where((F.col("_pos") >= n) & (F.col("_pos") < line.total - n)).drop("_pos")
    up, down = (Window.partitionBy(*by).orderBy(o) for o in (F.asc(order), F.desc(order)))
    return rows.withColumns({"_a": F.row_number().over(up), "_b": F.row_number().over(down)}).where(f"_a > {n} and _b > {n}").drop("_a", "_b")


def without_empty_end(rows: DataFrame, order: str, count: str, by: Sequence[str] = ()) -> DataFrame:
    """rows up to the last one of each key whose count is above zero."""
    last = F.max(F.when(F.col(count) > 0, F.col(order)))
    if not by:  # one row
        return rows.crossJoin(F.broadcast(rows.agg(last.alias("_last")))).where(F.col(order) <= F.col("_last")).drop("_last")
    last = last.over(Window.partitionBy(*by))
    return rows.withColumn("_last", last).where(F.col(order) <= F.col("_last")).drop("_last")


def first_dark(stations: DataFrame, image: DataFrame, reach: int, below: float) -> DataFrame:
    """s, side, r: the first pixel below a brightness along the perpendicular of each station, on both sides (1: left), within reach steps.

    stations: s, x, y, tx, ty (unit tangent); image: ix, iy, v.  Every step of every
    station asks its pixel in one equi-join; the least step is kept.
    """
    steps = F.array(*[F.struct(F.lit(side).alias("side"), F.lit(r).alias("r")) for side in (1, -1) for r in range(1, reach + 1)])
    asked = stations.select("s", "x", "y", "tx", "ty", F.explode(steps).alias("o"))
    at = [F.floor(F.col(c) + F.col("o.side") * F.col("o.r") * d + 0.5).cast("long").alias(f"i{c}") for c, d in (("x", -F.col("ty")), ("y", F.col("tx")))]
    met = asked.select("s", "o.side", "o.r", *at).join(image.select("ix", "iy", "v").where(F.col("v") < below), ["ix", "iy"])
    return met.groupBy("s", "side").agg(F.min("r").alias("r"))


def up_frame(points: DataFrame, up: Sequence[float]) -> DataFrame:
    """x, y, z turned so that `up` points along +z."""
    from karst.operators.geometry import align, motion

    x, y, z = C.rigid(F.col("x"), F.col("y"), F.col("z"), motion(align(up, (0, 0, 1)), (0, 0, 0)))
    return points.withColumns({"x": x, "y": y, "z": z})


def domed(z: Column, x: Column, y: Column, centre: Sequence[float], height: float, radius: float) -> Column:
    """Elevation with a paraboloid of so much height at the centre that falls to nothing at the radius."""
    r2 = ((x - F.lit(float(centre[0]))) ** 2 + (y - F.lit(float(centre[1]))) ** 2) / F.lit(float(radius) ** 2)
    return z + F.lit(float(height)) * F.greatest(F.lit(1.0) - r2, F.lit(0.0))


def depth_ramp(z: Column, ground: Column, deepest: float) -> Column:
    """Depth below the ground as a share of the deepest, held within 0 and 1."""
    return C.clip((ground - z) / F.lit(float(deepest)), 0.0, 1.0)
