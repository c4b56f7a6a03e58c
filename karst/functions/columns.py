"""Column expressions of points: origins, grids, colours, rigid motions. All stay in generated JVM code."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def local(c: str | Column, origin: float) -> Column:
    """Global to local coordinate, in double precision; cast to float only at a sink."""
    return (F.col(c) if isinstance(c, str) else c) - F.lit(float(origin))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def rounded(c: str | Column, digits: int) -> Column:
    """Rounded as SQL engines do, by the product in binary; Spark's round takes the shortest decimal, and so another side of some halves (34.68975)."""
    shift = F.lit(10.0**digits)
    return F.round((F.col(c) if isinstance(c, str) else c) * shift) / shift


def voxel(c: str | Column, size: float) -> Column:
    """Index of the voxel along one axis: a true floor, also below zero."""
    return F.floor((F.col(c) if isinstance(c, str) else c) / F.lit(float(size))).cast("long")


def cell(c: str | Column, low: float, size: float, last: int | None = None) -> Column:
    """Grid index from a lower bound on; held within 0 and last if last is given."""
    i = F.floor(((F.col(c) if isinstance(c, str) else c) - F.lit(float(low))) / F.lit(float(size))).cast("long")
    return i if last is None else F.least(F.greatest(i, F.lit(0).cast("long")), F.lit(last).cast("long"))


def cell_truncated(c: str | Column, low: float, size: float) -> Column:
    """Grid index cut toward zero, as look-ups of a stored raster take it: (-1, 0) gives 0."""
    return ((F.col(c) if isinstance(c, str) else c) - F.lit(float(low))).__truediv__(F.lit(float(size))).cast("long")


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    """0x00RRGGBB of channels 0..255: clipped, then cut to whole numbers."""
    whole = [clip(c, 0, 255).cast("int") for c in (r, g, b)]
    return F.shiftleft(whole[0], 16).bitwiseOR(F.shiftleft(whole[1], 8)).bitwiseOR(whole[2])


def unpack_rgb(rgb: Column) -> tuple[Column, Column, Column]:
    return tuple(F.shiftright(rgb, k).bitwiseAND(F.lit(255)) for k in (16, 8, 0))


def from_16bit(c: Column) -> Column:
    """16-bit channel to 0..255: over 257, so that 65535 is 255."""
    return c / F.lit(257.0)


def to_16bit(c: Column) -> Column:
    """0..255 to 16 bits, half to even, clipped."""
    return clip(F.bround(c * F.lit(257.0), 0), 0, 65535).cast("int")


def ramp(z: Column, low: float, high: float, steps: int = 256) -> Column:
    """Step of a colour ramp for an elevation; a flat range gives step 0."""
    if high - low < 1e-9:
        return F.lit(0).cast("long")
    t = clip((z - F.lit(low)) / F.lit(high - low), 0.0, 1.0)
    return F.least(F.floor(t * steps), F.lit(steps - 1)).cast("long")


def rigid(x: Column, y: Column, z: Column, matrix: Sequence[Sequence[float]]) -> tuple[Column, Column, Column]:
    """A 4x4 motion of a point: three linear expressions."""
    return tuple(F.lit(m[0]) * x + F.lit(m[1]) * y + F.lit(m[2]) * z + F.lit(m[3]) for m in ([float(v) for v in row] for row in matrix[:3]))


def angle_bin(du: Column, dv: Column, bins: int) -> Column:
    """Bin of a direction, from -pi on; the closing angle falls in the last bin."""
    t = (F.atan2(dv, du) + F.lit(math.pi)) / F.lit(2 * math.pi) * F.lit(bins)
    return F.least(F.floor(t), F.lit(bins - 1)).cast("long")


def ellipse_radius(major: Column, minor: Column, orientation: Column, toward: Column) -> Column:
    """Radius of an ellipse in a direction."""
    c, s = F.cos(toward - orientation), F.sin(toward - orientation)
    return major * minor / F.sqrt((minor * c) ** 2 + (major * s) ** 2)


def strength(span: Column, thickness: Column, beta: float = 0.5, density: float = 2600.0, gravity: float = 9.81) -> Column:
    """Bending stress of a roof, in MPa."""
    return F.lit(beta * density * gravity) * span * span / thickness / F.lit(1e6)


def number_or_null(c: Column) -> Column:
    """A text column as a number; blank and nan become null."""
    v = F.expr("try_cast(null as double)") if c is None else c.try_cast("double")
    return F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)
