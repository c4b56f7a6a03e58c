"""Operators over point tables: crop, bounds, voxel means, grids, merge."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from karst.functions import columns as C

MOST_CELLS = 50_000_000


def crop(points: DataFrame, bounds: Sequence[float], axes: str = "xy") -> DataFrame:
    """Points inside a rectangle on two axes, edges included; its corners may come in any order, the third axis is free."""
    if len(axes) != 2 or len({*axes}) != 2 or {*axes} - {*"xyz"}:
        raise ValueError("axes names two of x, y, z")
    a0, b0, a1, b1 = map(float, bounds)
    return points.where(F.col(axes[0]).between(min(a0, a1), max(a0, a1)) & F.col(axes[1]).between(min(b0, b1), max(b0, b1)))


def within_bounds(low: Sequence[float], high: Sequence[float], slack: float = 1e-3) -> Column:
    """Whether a point lies in a header's box, a little widened; false for missing coordinates."""
    inside = [F.col(c).between(a - slack, b + slack) for c, a, b in zip("xyz", low, high, strict=True)]
    return F.coalesce(reduce(lambda p, q: p & q, inside), F.lit(False))


def route(points: DataFrame, boxes: dict[str, Sequence[float]]) -> dict[str, DataFrame]:
    """Several half-open boxes (x0, y0, x1, y1) over one scan; persist points first if more than one is used."""
    return {k: points.where((F.col("x") >= b[0]) & (F.col("x") < b[2]) & (F.col("y") >= b[1]) & (F.col("y") < b[3])) for k, b in boxes.items()}


def write_routed(points: DataFrame, boxes: dict[str, Sequence[float]], path: str, keep: Column | None = None) -> dict[str, int]:
    """One scan into a folder box=<name> for each half-open box (x0, y0, x1, y1): a point is written to every box it lies in.

    keep: rows for which it is not true are dropped first.  Returns what was counted
    in the same pass: read, dropped, unrouted (in no box), and each box's points.
    """
    if {"read", "dropped", "unrouted"} & {*boxes}:
        raise ValueError("a box is not named read, dropped or unrouted")
    told = Observation()
    kept = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    inside = {k: kept & F.coalesce((F.col("x") >= b[0]) & (F.col("x") < b[2]) & (F.col("y") >= b[1]) & (F.col("y") < b[3]), F.lit(False)) for k, b in boxes.items()}
    names = F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in inside.items()]), lambda n: n.isNotNull())
    unrouted = kept & ~reduce(lambda p, q: p | q, inside.values(), F.lit(False))
    counts = [F.count("*").alias("read"), F.count_if(~kept).alias("dropped"), F.count_if(unrouted).alias("unrouted"), *[F.count_if(v).alias(k) for k, v in inside.items()]]
    routed = points.observe(told, *counts).withColumn("box", F.explode(names))
    routed.write.partitionBy("box").parquet(path)
    return {k: int(v or 0) for k, v in told.get.items()}


def finite(points: DataFrame, *names: str) -> DataFrame:
    return points.where(reduce(lambda p, q: p & q, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf")) for c in names]))


def bernoulli(points: DataFrame, share: float, key: str = "pid", seed: int = 0) -> DataFrame:
    """Each row with a chance of share, by a hash of its key: the same at every run and for every partitioning."""
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return points.where(draw < share)


def voxel_downsample(points: DataFrame, size: float | dict[str, float], means: dict[str, Column] | None = None) -> DataFrame:
    """One row for each occupied voxel: vx, vy, vz, n and the mean of every column.

    Aggregation is partial before the shuffle, which carries a row for each task
    and voxel.  `means` maps names to integer columns whose sums shall be exact.
    """
    sizes = size if isinstance(size, dict) else dict.fromkeys("xyz", size)
    if min(sizes.values()) <= 0:
        raise ValueError("a voxel needs a size above zero")
    key = [C.voxel(c, v).alias(f"v{c}") for c, v in sizes.items()]
    if means is None:
        aggs = [F.avg(c).alias(c) for c, t in points.dtypes if t in ("double", "float", "int", "bigint", "smallint") and c not in ("pid", "source")]
    else:
        aggs = [F.sum(c).alias(k) for k, c in means.items()]
    return points.groupBy(*key).agg(F.count("*").alias("n"), *aggs)


def extent(points: DataFrame, *axes: str) -> list[tuple[float, float]]:
    """Least and greatest value on each axis, as one small row."""
    row = points.agg(*[f(c).alias(f"{c}{k}") for c in axes for k, f in enumerate((F.min, F.max))]).first()
    return [(row[2 * k], row[2 * k + 1]) for k in range(len(axes))]


def check_grid(nx: int, ny: int) -> None:
    if nx * ny > MOST_CELLS:
        raise ValueError(f"a grid of {nx} x {ny} cells is over {MOST_CELLS}; take a coarser resolution")


def grid(points: DataFrame, res: float, low: Sequence[float], shape: Sequence[int] | None = None, z: str = "z") -> DataFrame:
    """Occupied cells ix, iy with n, zsum, zmax, zmin; nothing is kept for empty ones."""
    ix, iy = (C.cell(c, a, res, None if shape is None else shape[k] - 1).alias(f"i{c}") for k, (c, a) in enumerate(zip("xy", low, strict=True)))
    return points.groupBy(ix, iy).agg(F.count("*").alias("n"), F.sum(z).alias("zsum"), F.max(z).alias("zmax"), F.min(z).alias("zmin"))


def raster_max(points: DataFrame, res: float, low: Sequence[float], shape: Sequence[int], z: str = "z") -> DataFrame:
    """ix, iy, zmax on a given lattice; points outside it are left out, not moved to its edge."""
    placed = points.select(*[C.cell(c, a, res).alias(f"i{c}") for c, a in zip("xy", low, strict=True)], F.col(z).alias("_z"))
    inside = F.col("ix").between(0, shape[0] - 1) & F.col("iy").between(0, shape[1] - 1)
    return placed.where(inside).groupBy("ix", "iy").agg(F.max("_z").alias("zmax"))


def occupancy(points: DataFrame, res: float) -> DataFrame:
    """The grid over the points' own extent; refuses one of more than MOST_CELLS cells."""
    (x0, x1), (y0, y1) = extent(points, "x", "y")
    if x0 is None:
        return grid(points, res, (0.0, 0.0))
    shape = [int(-(-(b - a) // res)) + 1 for a, b in ((x0, x1), (y0, y1))]
    check_grid(*shape)
    return grid(points, res, (x0, y0), shape)


def merge(clouds: Sequence[DataFrame], tags: Sequence[int] | None = None, defaults: dict[str, Column] | None = None) -> DataFrame:
    """UNION ALL by name with aligned columns; missing ones take a default or null, `source` tells the cloud."""
    names = list(dict.fromkeys(c for d in clouds for c in d.columns))
    filled = []
    for k, d in enumerate(clouds):
        missing = {c: (defaults or {}).get(c, F.lit(None)) for c in names if c not in d.columns}
        d = d.withColumns(missing).select(*names)
        filled.append(d if tags is None else d.withColumn("source", F.lit(tags[k])))
    return reduce(DataFrame.unionByName, filled)


def transform(points: DataFrame, matrix: Sequence[Sequence[float]], lift: float = 0.0) -> DataFrame:
    """A rigid motion of x, y, z, then a lift along z."""
    x, y, z = C.rigid(F.col("x"), F.col("y"), F.col("z"), matrix)
    return points.withColumns({"x": x, "y": y, "z": z + F.lit(float(lift))})
