"""Raster operators over sparse cells (ix, iy, value): neighbours are joins or regrouped offsets."""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karst.operators.points import check_grid
from karst.operators.tiles import enclosed, label, median_filter  # noqa: F401  rasters' windows and components

CROSS = ((-1, 0), (0, -1), (0, 1), (1, 0))


def dense(cells: DataFrame, value: str, fill: Column | None = None) -> DataFrame:
    """All cells of the bounding box with the value, null (or fill) where there is none; refuses a box of more than MOST_CELLS."""
    row = cells.agg(F.min("ix"), F.max("ix"), F.min("iy"), F.max("iy")).first()
    if row[0] is None:
        return cells.select("ix", "iy", (F.col(value) if fill is None else F.coalesce(value, fill)).alias(value))
    x0, x1, y0, y1 = map(int, row)
    check_grid(x1 - x0 + 1, y1 - y0 + 1)
    every = cells.sparkSession.range(x0, x1 + 1).select(F.col("id").alias("ix"), F.explode(F.sequence(F.lit(y0).cast("long"), F.lit(y1).cast("long"))).alias("iy"))
    return every.join(cells.select("ix", "iy", value), ["ix", "iy"], "left").select("ix", "iy", (F.col(value) if fill is None else F.coalesce(value, fill)).alias(value))


def _scattered(cells: DataFrame, offsets: list[tuple[int, int, float]], value: str) -> DataFrame:
    """Each cell's value sent to its neighbours, with a weight: one explode and one shuffle, no join."""
    listed = F.array(*[F.struct(F.lit(a).cast("long").alias("dx"), F.lit(b).cast("long").alias("dy"), F.lit(float(w)).alias("w")) for a, b, w in offsets])
    return cells.select("ix", "iy", value, F.explode(listed).alias("o")).select((F.col("ix") + F.col("o.dx")).alias("ix"), (F.col("iy") + F.col("o.dy")).alias("iy"), F.col("o.w").alias("w"), value)


def gaussian(cells: DataFrame, sigma: float, value: str) -> DataFrame:
    """smooth of every cell of the box: a Gaussian cut off at 4 sigma, empty cells as zero, mirrored beyond the edges (the edge cell stands twice). Two passes, one for each axis."""
    reach = int(4 * sigma + 0.5)
    weights = [exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    listed = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(w / sum(weights)).alias("w")) for k, w in zip(range(-reach, reach + 1), weights, strict=True)])
    row = cells.agg(F.min("ix"), F.max("ix"), F.min("iy"), F.max("iy")).first()
    rows = cells.where(F.col(value) != 0).select("ix", "iy", F.col(value).cast("double").alias("smooth"))
    if row[0] is None:
        return rows
    for c, low, high in (("ix", row[0], row[1]), ("iy", row[2], row[3])):
        n = int(high - low + 1)
        # a cell's mirror images within reach of the box, by periods of twice its length
        turns = range(-(reach // (2 * n)) - 1, reach // (2 * n) + 2)
        images = F.array(*[x for t in turns for x in (F.col(c) + 2 * n * t, F.lit(2 * int(low) - 1 + 2 * n * t) - F.col(c))])
        near = rows.withColumn("_at", F.explode(images)).where(F.col("_at").between(low - reach, high + reach))
        sent = near.withColumn("_o", F.explode(listed)).withColumn("_to", F.col("_at") + F.col("_o.k")).where(F.col("_to").between(low, high))
        key = [F.col("_to").alias(c) if x == c else F.col(x) for x in ("ix", "iy")]
        rows = sent.groupBy(*key).agg(F.sum(F.col("smooth") * F.col("_o.w")).alias("smooth"))
    return dense(cells.select("ix", "iy").withColumn("_1", F.lit(1)), "_1").join(rows, ["ix", "iy"], "left").select("ix", "iy", F.coalesce("smooth", F.lit(0.0)).alias("smooth"))


def dilate(mask: DataFrame) -> DataFrame:
    """Cells of the mask and their four neighbours."""
    return _scattered(mask.withColumn("_1", F.lit(1)), [(0, 0, 1), *((a, b, 1) for a, b in CROSS)], "_1").select("ix", "iy").distinct()


def erode(mask: DataFrame) -> DataFrame:
    """Cells of the mask whose four neighbours are also in it."""
    sent = _scattered(mask.select("ix", "iy").distinct().withColumn("_1", F.lit(1)), [(0, 0, 1), *((a, b, 1) for a, b in CROSS)], "_1")
    return sent.groupBy("ix", "iy").agg(F.count("*").alias("n")).where("n = 5").select("ix", "iy")


def block_mean(cells: DataFrame, factor: int, value: str) -> DataFrame:
    """Each cell with the mean of its factor x factor block."""
    key = [F.floor(F.col(c) / factor).cast("long").alias(f"b{c}") for c in ("ix", "iy")]
    keyed = cells.select("*", *key)
    return keyed.join(keyed.groupBy("bix", "biy").agg(F.avg(value).alias("block")), ["bix", "biy"]).select("ix", "iy", "block")


def slope(cells: DataFrame, value: str, res: float) -> DataFrame:
    """Gradient magnitude: half the step between a cell's neighbours on each axis, at the box's edges the one step there is; none where a cell it needs is empty."""
    sent = _scattered(cells, [(a, b, 2 * a + b) for a, b in CROSS], value)
    w = lambda k: F.max(F.when(F.col("w") == k, F.col(value)))
    both = sent.groupBy("ix", "iy").agg(w(2).alias("left"), w(-2).alias("right"), w(1).alias("below"), w(-1).alias("above"))
    box = cells.agg(F.min("ix").alias("x0"), F.max("ix").alias("x1"), F.min("iy").alias("y0"), F.max("iy").alias("y1"))
    own = cells.select("ix", "iy", F.col(value).alias("_v")).join(both, ["ix", "iy"], "left").crossJoin(F.broadcast(box))  # box is one row

    def step(i: str, low: str, high: str, before: str, after: str) -> Column:
        return F.when(F.col(i) == F.col(low), F.col(after) - F.col("_v")).when(F.col(i) == F.col(high), F.col("_v") - F.col(before)).otherwise((F.col(after) - F.col(before)) / 2) / F.lit(float(res))

    gx, gy = step("ix", "x0", "x1", "left", "right"), step("iy", "y0", "y1", "below", "above")
    return own.where((gx + gy).isNotNull()).select("ix", "iy", F.sqrt(gx * gx + gy * gy).alias("slope"))


def dem(cells: DataFrame, value: str = "zmax", size: int = 3) -> DataFrame:
    """Elevations: each cell's value after a median over size x size cells, empty ones filled from the nearest for that, and left out again."""
    from karst.operators.geometry import nearest_fill

    filled = nearest_fill(cells.select("ix", "iy", F.col(value).cast("double").alias(value)), value)
    return median_filter(filled, size, value).join(cells.select("ix", "iy"), ["ix", "iy"], "left_semi").select("ix", "iy", F.col("median").alias(value))


def lookup(points: DataFrame, cells: DataFrame, ix: Column, iy: Column) -> DataFrame:
    """points with the columns of their cell, null where it is empty."""
    return points.withColumn("ix", ix).withColumn("iy", iy).join(cells, ["ix", "iy"], "left")


def noise(cells: DataFrame, sigma: float, amplitude: float, seed: int = 0) -> DataFrame:
    """ix, iy, noise over the box of cells: normal draws by a hash of the cell, smoothed over sigma cells and scaled to a deviation of amplitude about zero."""
    full = dense(cells.select("ix", "iy").withColumn("_1", F.lit(1.0)), "_1")
    draw = lambda k: (F.pmod(F.xxhash64("ix", "iy", F.lit(seed), F.lit(k)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    raw = full.select("ix", "iy", (F.sqrt(-2 * F.log(draw(1))) * F.cos(2 * F.pi() * draw(2))).alias("n"))
    soft = gaussian(raw, sigma, "n")
    spread = soft.agg(F.avg("smooth").alias("_m"), F.stddev_pop("smooth").alias("_s"))
    scaled = (F.col("smooth") - F.col("_m")) / F.nullif("_s", F.lit(0.0)) * F.lit(float(amplitude))
    return soft.crossJoin(F.broadcast(spread)).select("ix", "iy", F.coalesce(scaled, F.lit(0.0)).alias("noise"))  # spread is one row
