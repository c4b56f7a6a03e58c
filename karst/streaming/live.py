"""Grids and counters over arriving tiles: the batch aggregates as streaming ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.functions import columns as C


def live_voxels(points: DataFrame, size: float) -> DataFrame:
    """Voxel means so far; run with output mode complete or update. State is a row for each occupied voxel."""
    key = [C.voxel(c, size).alias(f"v{c}") for c in "xyz"]
    return points.groupBy(*key).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in "xyz"])


def live_grid(points: DataFrame, res: float, low: tuple[float, float]) -> DataFrame:
    """Occupancy so far: n, zsum, zmax for each cell."""
    cell = [C.cell(c, a, res).alias(f"i{c}") for c, a in zip("xy", low, strict=True)]
    return points.groupBy(*cell).agg(F.count("*").alias("n"), F.sum("z").alias("zsum"), F.max("z").alias("zmax"))


def topic_counts(log: DataFrame, time: str, topic: str, width: str, late: str) -> DataFrame:
    """Messages of each topic in each time window; windows close once later than the watermark."""
    return log.withWatermark(time, late).groupBy(F.window(time, width), topic).agg(F.count("*").alias("n"), F.min(time).alias("first")).select("window.start", topic, "n", "first")
