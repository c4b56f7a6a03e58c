"""Stations along a curve: cross-sections, roof thickness, classes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karst.functions import columns as C
from karst.operators import curves, spatial

BINS = 72


def sections(stations: DataFrame, points: DataFrame, reach: float = 30.0, slab: float = 0.75, least: int = 30) -> DataFrame:
    """s, n_pts, area, coverage, width, height, z_ceil of the cross-section at each station (pid = s, x, y, z, tx, ty, tz).

    Points of a slab across the tangent are taken in the plane (u across, v up)
    about their median; in each of 72 directions the innermost cluster of three or
    more (parted by gaps over 1.5 m) is the wall.
    """
    near = spatial.ball_query(stations, points, reach, "xyz")
    d = {c: F.col(f"b.{c}") - F.col(f"a.{c}") for c in "xyz"}
    flat = F.greatest(F.hypot(F.col("a.tx"), F.col("a.ty")), F.lit(1e-12))
    along = d["x"] * F.col("a.tx") + d["y"] * F.col("a.ty") + d["z"] * F.col("a.tz")
    u = (d["y"] * F.col("a.tx") - d["x"] * F.col("a.ty")) / flat
    cut = near.where(F.abs(along) <= slab).select(F.col("a.pid").alias("s"), u.alias("u"), d["z"].alias("v"), F.col("a.z").alias("z0"))
    middle = cut.groupBy("s").agg(F.count("*").alias("n_pts"), F.median("u").alias("mu"), F.median("v").alias("mv")).where(F.col("n_pts") >= least)
    placed = cut.join(middle, "s").select("s", "n_pts", "z0", "v", (F.col("u") - F.col("mu")).alias("du"), (F.col("v") - F.col("mv")).alias("dv"))
    placed = placed.withColumn("bin", C.angle_bin(F.col("du"), F.col("dv"), BINS)).withColumn("r", F.hypot("du", "dv"))
    walls = curves.innermost_cluster(placed, "r", 1.5, 3, ["s", "bin"], [F.median("r").alias("rw"), F.max(F.col("v") + F.col("z0")).alias("top")])
    step = 2 * math.pi / BINS
    up = F.sin((F.col("bin") + 0.5) * F.lit(step) - F.lit(math.pi)) > 0.7
    shape = walls.groupBy("s").agg(F.sum(F.col("rw") * F.col("rw") * F.lit(step / 2)).alias("area"), (F.count("*") / BINS).alias("coverage"), F.max(F.when(up, F.col("top"))).alias("roof"))
    size = placed.groupBy("s").agg(F.first("n_pts").alias("n_pts"), (F.percentile("du", 0.99) - F.percentile("du", 0.01)).alias("width"), (F.percentile("dv", 0.99) - F.percentile("dv", 0.01)).alias("height"), F.max(F.col("v") + F.col("z0")).alias("highest"))
    return size.join(shape, "s", "left").select("s", "n_pts", "area", "coverage", "width", "height", F.coalesce("roof", "highest").alias("z_ceil"))


def station_class(tau: Column, in_void: Column, coverage: Column, ghost: Column) -> Column:
    """First rule that holds: skylight, no_dem, low_coverage, multipass, inconsistent, else intact. A missing coverage counts as none."""
    return (
        F.when(in_void, "skylight")
        .when(tau.isNull(), "no_dem")
        .when(F.coalesce(coverage, F.lit(0.0)) < 0.5, "low_coverage")
        .when(F.coalesce(ghost, F.lit(0.0)) > 0.05, "multipass")
        .when(tau <= 0, "inconsistent")
        .otherwise("intact")
    )
