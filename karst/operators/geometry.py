"""Small linear algebra, similarity and camera expressions, raster sampling, and searches over few parameters."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit(v: Sequence[float]) -> np.ndarray:
    v = np.asarray(v, float)
    n = np.linalg.norm(v)
    if n == 0:
        raise ValueError("a direction is not zero")
    return v / n


def about(axis: Sequence[float], angle: float) -> np.ndarray:
    """Rotation about an axis."""
    x, y, z = unit(axis)
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + math.sin(angle) * k + (1 - math.cos(angle)) * k @ k


def align(a: Sequence[float], b: Sequence[float]) -> np.ndarray:
    """The shortest rotation that carries a's direction to b's; half a turn about any normal if they are opposite."""
    a, b = unit(a), unit(b)
    axis, cosine = np.cross(a, b), float(np.clip(a @ b, -1, 1))
    if np.linalg.norm(axis) < 1e-12:
        if cosine > 0:
            return np.eye(3)
        axis = np.cross(a, np.eye(3)[np.argmin(np.abs(a))])
    return about(axis, math.acos(cosine))


def motion(rotation: np.ndarray, shift: Sequence[float]) -> np.ndarray:
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = rotation, shift
    return out


def compose(*motions: Sequence[Sequence[float]]) -> np.ndarray:
    """One motion for several, the last of them applied first."""
    out = np.eye(4)
    for m in motions:
        out = out @ np.asarray(m, float)
    return out


def invert(m: Sequence[Sequence[float]]) -> np.ndarray:
    """The motion back; of rigid ones exactly the transposed turn."""
    m = np.asarray(m, float)
    r = m[:3, :3]
    if not np.allclose(r @ r.T, np.eye(3), atol=1e-6):
        raise ValueError("not a rigid motion")
    return motion(r.T, -r.T @ m[:3, 3])


def shift_search(points: DataFrame, cells: DataFrame, value: str, res: float, low: Sequence[float], reach: int, scale: float = 1.0) -> DataFrame:
    """dx, dy, n, cost: summed distance of points (times scale) from the cells they meet when moved by whole cells, up to reach each way.

    The cells, few against the points, are sent for each shift; points meet theirs once.
    """
    both = [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)]
    shifts = F.array(*[F.struct(F.lit(a).cast("long").alias("dx"), F.lit(b).cast("long").alias("dy")) for a, b in both])
    sent = cells.select("ix", "iy", F.col(value).alias("_v"), F.explode(shifts).alias("o")).select((F.col("ix") - F.col("o.dx")).alias("ix"), (F.col("iy") - F.col("o.dy")).alias("iy"), "o.dx", "o.dy", "_v")
    own = points.select("z", *[F.floor((F.col(c) - F.lit(float(a))) / F.lit(float(res))).cast("long").alias(f"i{c}") for c, a in zip("xy", low, strict=True)])
    return own.join(sent, ["ix", "iy"]).groupBy("dx", "dy").agg(F.count("*").alias("n"), F.sum(F.abs(F.col("z") * F.lit(scale) - F.col("_v"))).alias("cost"))


def principal_frame(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """cx, cy, angle of the longest axis of each group in the plane, from one pass of sums."""
    g = points.groupBy(*by) if by else points.groupBy()
    turn = F.atan2(2 * F.covar_pop("x", "y"), F.var_pop("x") - F.var_pop("y")) / 2
    return g.agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), turn.alias("angle"))


def similarity(x: Column, y: Column, scale: float, angle: float, shift: Sequence[float]) -> tuple[Column, Column]:
    """Image coordinates (y downward) to the ground."""
    c, s = scale * math.cos(angle), scale * math.sin(angle)
    return F.lit(c) * x + F.lit(s) * y + F.lit(float(shift[0])), F.lit(s) * x - F.lit(c) * y + F.lit(float(shift[1]))


def pinhole(x: Column, y: Column, z: Column, matrix: Sequence[Sequence[float]], focal: float, cx: float, cy: float) -> tuple[Column, Column, Column]:
    """Pixel columns u, v and depth; null behind the camera."""
    a, b, d = (F.lit(float(m[0])) * x + F.lit(float(m[1])) * y + F.lit(float(m[2])) * z + F.lit(float(m[3])) for m in matrix[:3])
    seen = d > 1e-9
    return F.when(seen, F.lit(focal) * a / d + F.lit(cx)), F.when(seen, F.lit(focal) * b / d + F.lit(cy)), d


def bilinear(points: DataFrame, cells: DataFrame, value: str, low: Sequence[float], res: float) -> DataFrame:
    """pid, value: between the four cell centres around a point; null unless all four exist. Four rows a point, one join."""
    fx, fy = ((F.col(c) - F.lit(float(a))) / F.lit(res) - 0.5 for c, a in zip("xy", low, strict=True))
    placed = points.select("pid", fx.alias("fx"), fy.alias("fy")).withColumns({"i": F.floor("fx").cast("long"), "j": F.floor("fy").cast("long")})
    corner = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a in (0, 1) for b in (0, 1)])
    sent = placed.withColumn("o", F.explode(corner))
    u, v = F.col("fx") - F.col("i"), F.col("fy") - F.col("j")
    w = F.when(F.col("o.a") == 1, u).otherwise(1 - u) * F.when(F.col("o.b") == 1, v).otherwise(1 - v)
    at = sent.select("pid", w.alias("w"), (F.col("i") + F.col("o.a")).alias("ix"), (F.col("j") + F.col("o.b")).alias("iy"))
    met = at.join(cells.select("ix", "iy", F.col(value).alias("_v")), ["ix", "iy"], "left")
    return met.groupBy("pid").agg(F.when(F.count("_v") == 4, F.sum(F.col("w") * F.col("_v"))).alias(value))


def nearest_fill(cells: DataFrame, value: str, reach: float | None = None) -> DataFrame:
    """Empty cells of the box with the value of the nearest cell (of those at most reach away, if given); ties by (ix, iy). Filled ones keep theirs.

    Exact in two passes: the nearest filled cell of each column by windows, then
    along each row the best of the columns, further ones only while they can win.
    """
    from karst.operators import rasters

    full = rasters.dense(cells.select("ix", "iy", F.col(value).cast("double").alias(value)), value)
    kind = dict(cells.dtypes)[value]
    w = Window.partitionBy("ix").orderBy("iy")
    at = F.when(F.col(value).isNotNull(), F.struct("iy", F.col(value).alias("v")))
    below, above = F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(at, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = full.withColumn("_a", below).withColumn("_b", above)
    take_a = F.col("_b").isNull() | (F.col("iy") - F.col("_a.iy") <= F.col("_b.iy") - F.col("iy"))
    columns = both.select("ix", "iy", *[F.when(F.col("_a").isNotNull() & take_a, F.col(f"_a.{c}")).otherwise(F.col(f"_b.{c}")).alias(n) for c, n in (("iy", "_y"), ("v", "_v"))])
    most = math.inf if reach is None else reach * reach

    def row(table: pa.Table) -> pa.Table:
        table = table.sort_by("ix")
        ix, iy = table.column("ix").to_numpy(), table.column("iy").to_numpy()
        y, v = table.column("_y").to_numpy(), table.column("_v").to_numpy()
        dy = np.where(np.isnan(y), np.inf, (y - iy) ** 2)
        best, out, n = dy.copy(), v.copy(), len(ix)
        for k in range(1, n):
            if k * k > best.max():
                break
            # on a tie the smaller ix: the left one first, over what was found nearer only if it is less
            for a, b in ((slice(k, n), slice(0, n - k)), (slice(0, n - k), slice(k, n))):
                d = dy[b] + k * k
                win = d < best[a] if a.start == 0 else d <= best[a]
                best[a] = np.where(win, d, best[a])
                out[a] = np.where(win, v[b], out[a])
        return pa.table({"ix": ix, "iy": iy, "_near": np.where(best <= most, out, np.nan)})

    near = columns.groupBy("iy").applyInArrow(row, "ix long, iy long, _near double")
    kept = full.join(near, ["ix", "iy"], "left")
    return kept.select("ix", "iy", F.coalesce(value, F.when(~F.isnan("_near"), F.col("_near"))).cast(kind).alias(value))


def phase_shift(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Shift of b against a by phase correlation, to parts of a cell by parabolas; for one raster that fits on the driver."""
    a, b = (np.nan_to_num(v - np.nanmean(v)) for v in (np.asarray(a, float), np.asarray(b, float)))
    cross = np.fft.fft2(a).conj() * np.fft.fft2(b)
    r = np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)).real
    peak = np.unravel_index(int(r.argmax()), r.shape)

    def sub(axis: int) -> float:
        n = r.shape[axis]
        p = [list(peak) for _ in range(3)]
        for k, q in zip((-1, 0, 1), p, strict=True):
            q[axis] = (peak[axis] + k) % n
        lo, mid, hi = (float(r[tuple(q)]) for q in p)
        bend = lo - 2 * mid + hi
        at = peak[axis] + (0.5 * (lo - hi) / bend if abs(bend) > 1e-12 else 0.0)
        return at - n if at > n / 2 else at

    return sub(0), sub(1)


def angle_search(points: DataFrame, cells: DataFrame, value: str, axis: Sequence[float], angles: Sequence[float], res: float, low: Sequence[float]) -> DataFrame:
    """angle, n, cost: mean distance of points, turned by each angle about an axis through zero, from their cells. A row a point and angle, pre-aggregated."""
    turned = F.array(*[F.struct(F.lit(float(t)).alias("angle"), F.array(*[F.array(*map(F.lit, map(float, row))) for row in about(axis, t)]).alias("m")) for t in angles])
    sent = points.select("x", "y", "z", F.explode(turned).alias("t"))
    x, y, z = (F.col("t.m")[k][0] * F.col("x") + F.col("t.m")[k][1] * F.col("y") + F.col("t.m")[k][2] * F.col("z") for k in range(3))
    placed = sent.select("t.angle", z.alias("z"), F.floor((x - low[0]) / res).cast("long").alias("ix"), F.floor((y - low[1]) / res).cast("long").alias("iy"))
    met = placed.join(cells.select("ix", "iy", F.col(value).alias("_v")), ["ix", "iy"])
    return met.groupBy("angle").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("z") - F.col("_v"))).alias("cost"))
