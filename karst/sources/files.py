"""What the point-cloud sources share: several files in one load, a box and filters inside the scan."""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.datasource import EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, LessThanOrEqual, Not

COMPARED = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


def listed(path: str, ending: str) -> list[str]:
    """The files of a path: one file, several with commas between, patterns, or all of a folder that end so."""
    out: list[str] = []
    for p in path.split(","):
        found = sorted(glob.glob(os.path.join(p, f"*{ending}"))) if os.path.isdir(p) else sorted(glob.glob(p)) if glob.has_magic(p) else [p]
        if not found:
            raise FileNotFoundError(p)
        out += found
    return out


def parse_box(text: str | None) -> list[tuple[float, float]] | None:
    """x0,y0,z0,x1,y1,z1: least and greatest of each axis; empty parts are open."""
    if not text:
        return None
    v = [float(x) if x.strip() else None for x in text.split(",")]
    if len(v) != 6:
        raise ValueError("a box is x0,y0,z0,x1,y1,z1")
    return [(-np.inf if a is None else a, np.inf if b is None else b) for a, b in zip(v[:3], v[3:], strict=True)]


_COMPARISON = re.compile(r"\s*(\w+)\s*(<=|>=|=|<|>)\s*([-+.\deE]+)\s*")
_SIGNS = {"<": LessThan, "<=": LessThanOrEqual, "=": EqualTo, ">": GreaterThan, ">=": GreaterThanOrEqual}


def parse_where(text: str | None, columns: Iterable[str]) -> list[Filter]:
    """Comparisons of columns with numbers, with `and` or commas between: "z > 2 and intensity <= 100".

    An option, and not Spark's own push-down: a loaded table keeps the filters that one
    query pushed, and gives them to later queries that have none.
    """
    out = []
    for part in re.split(r"(?i)\band\b|,", text) if text and text.strip() else ():
        found = _COMPARISON.fullmatch(part)
        if not found:
            raise ValueError(f"{part.strip()!r} compares no column with a number")
        f = _SIGNS[found[2]]((found[1],), float(found[3]))
        if not known(f, columns):
            raise ValueError(f"there is no column {found[1]}")
        out.append(f)
    return out


def known(f: Filter, columns: Iterable[str]) -> bool:
    """Whether keep() can decide a filter."""
    if isinstance(f, Not):
        return known(f.child, columns)
    return type(f) in (*COMPARED, In, IsNotNull) and len(f.attribute) == 1 and f.attribute[0] in columns


def _holds(batch: pa.RecordBatch, f: Filter) -> pa.Array:
    if isinstance(f, Not):
        return pc.invert(_holds(batch, f.child))
    column = batch.column(f.attribute[0])
    if isinstance(f, IsNotNull):
        return pc.is_valid(column)
    if isinstance(f, In):
        return pc.is_in(column, value_set=pa.array(list(f.value), column.type))
    return COMPARED[type(f)](column, pa.scalar(f.value, pa.float64()))


def keep(batch: pa.RecordBatch, box: list[tuple[float, float]] | None, filters: list[Filter]) -> pa.RecordBatch:
    """The rows inside the box for which all filters hold."""
    masks = [pc.and_(pc.greater_equal(batch.column(c), float(a)), pc.less_equal(batch.column(c), float(b))) for c, (a, b) in zip("xyz", box or (), strict=False)]
    masks += [_holds(batch, f) for f in filters]
    for m in masks:
        batch = batch.append_column(f"_{batch.num_columns}", m)
    if not masks:
        return batch
    whole = batch.column(batch.num_columns - len(masks))
    for k in range(1, len(masks)):
        whole = pc.and_(whole, batch.column(batch.num_columns - len(masks) + k))
    return batch.select(list(range(batch.num_columns - len(masks)))).filter(whole)


def misses(low: tuple[float, ...], high: tuple[float, ...], box: list[tuple[float, float]] | None, filters: list[Filter]) -> bool:
    """Whether a file's box proves that it holds no row of interest."""
    reach = dict(zip("xyz", zip(low, high, strict=True), strict=True))
    slack = 1e-3
    if box and any(reach[c][1] < a - slack or reach[c][0] > b + slack for c, (a, b) in zip("xyz", box, strict=True)):
        return True
    for f in filters:
        if type(f) in COMPARED and f.attribute[0] in reach:
            a, b = reach[f.attribute[0]]
            if type(f) in (GreaterThan, GreaterThanOrEqual, EqualTo) and b < f.value - slack or type(f) in (LessThan, LessThanOrEqual, EqualTo) and a > f.value + slack:
                return True
    return False
