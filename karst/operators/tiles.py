"""Rasters in tiles: windows of any size, and components, as work on bounded blocks of cells.

A tile is a square of cells in one task.  Windows get the cells within reach from the
neighbouring tiles as well (a halo), so a cell is sent to as many tiles as a window
touches, not to each cell of it.  Components are found inside each tile; only names
of parts that meet across borders of tiles make a graph, whose components give all
parts their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karst.operators.graphs import components
from karst.operators.lineage import table

#: Cells on a tile's side.
SIDE = 256
#: Classes of values, by count, that a window's median is looked for in first.
CLASSES = 256


def box_of(cells: DataFrame) -> tuple[int, int, int, int] | None:
    """Least and greatest ix, and iy; None without cells."""
    row = cells.agg(F.min("ix"), F.max("ix"), F.min("iy"), F.max("iy")).first()
    return None if row[0] is None else tuple(map(int, row))


def _tile(i: Column, side: int) -> Column:
    return F.floor(i / side)


def with_halo(cells: DataFrame, reach: int, side: int) -> DataFrame:
    """cells with tx, ty, once for each tile whose cells are at most reach away."""
    for i, t in (("ix", "tx"), ("iy", "ty")):
        cells = cells.withColumn(t, F.explode(F.sequence(_tile(F.col(i) - reach, side), _tile(F.col(i) + reach, side))))
    return cells


def _sums(inside: np.ndarray, size: int) -> np.ndarray:
    """Of how many cells of each size x size window hold."""
    total = np.zeros((inside.shape[0] + 1, inside.shape[1] + 1), np.int32)
    np.cumsum(np.cumsum(inside, axis=0, dtype=np.int32), axis=1, out=total[1:, 1:])
    return total[size:, size:] - total[:-size, size:] - total[size:, :-size] + total[:-size, :-size]


def window_medians(values: np.ndarray, size: int) -> np.ndarray:
    """Median of each size x size window of values, NaN left out; NaN where a window holds none.

    Values are ranked and cut into classes of like size; the number of a window's
    cells up to each class, from summed areas, tells the classes of its two middle
    values.  The values of one class are then counted, in their order, for the windows
    that look for one there.
    """
    rows, columns = (n - size + 1 for n in values.shape)
    real = ~np.isnan(values)
    distinct, code, many = np.unique(values[real], return_inverse=True, return_counts=True)
    if not len(distinct):
        return np.full((rows, columns), np.nan)
    classes = np.minimum((many.cumsum() - many) * CLASSES // many.sum(), CLASSES - 1)
    classes = np.unique(classes, return_inverse=True)[1]
    place = np.full(values.shape, -1)
    place[real] = classes[code]
    total = _sums(real, size)
    wanted = np.stack([(total - 1) // 2, total // 2]).reshape(2, -1)  # the middle values' places among a window's
    found, before = np.full(wanted.shape, -1), np.zeros(wanted.shape, np.int32)
    upto = np.zeros(wanted.shape[1], np.int32)
    for c in range(int(classes.max()) + 1):
        last, upto = upto, upto + _sums(place == c, size).ravel()
        here = (wanted >= last) & (wanted < upto)
        found[here] = c
        before[here] = np.broadcast_to(last, wanted.shape)[here]
    out = np.full(wanted.shape, np.nan)
    x, y = (i[real.nonzero()] for i in np.indices(values.shape))
    by_class = np.argsort(classes[code], kind="stable")
    cuts = np.searchsorted(classes[code][by_class], np.arange(int(classes.max()) + 2))
    cells = np.argsort(found, axis=None, kind="stable")
    ends = np.searchsorted(found.ravel()[cells], np.arange(int(classes.max()) + 2))
    for c in range(int(classes.max()) + 1):
        own, asked = by_class[cuts[c] : cuts[c + 1]], cells[ends[c] : ends[c + 1]]
        low, high = code[own].min(), code[own].max()
        if low == high:
            out.ravel()[asked] = distinct[low]
            continue
        own = own[np.argsort(code[own], kind="stable")]
        for k in range(0, len(asked), step := max(1, 4_000_000 // len(own))):
            some = asked[k : k + step]
            i, j = np.divmod(some % wanted.shape[1], columns)
            inside = (x[own] >= i[:, None]) & (x[own] < i[:, None] + size) & (y[own] >= j[:, None]) & (y[own] < j[:, None] + size)
            nth = (wanted.ravel()[some] - before.ravel()[some])[:, None]
            at = (inside.cumsum(axis=1, dtype=np.int32) > nth).argmax(axis=1)
            out.ravel()[some] = distinct[code[own[at]]]
    out[:, total.ravel() == 0] = np.nan
    return out.mean(axis=0).reshape(rows, columns)


def median_filter(cells: DataFrame, size: int, value: str, side: int = SIDE) -> DataFrame:
    """ix, iy, median over windows of size x size (the next odd size) in the cells' box; edge cells stand again beyond the edge, empty cells are left out, windows without cells have no row."""
    half = size // 2
    slim = cells.select(F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), F.col(value).cast("double").alias("v")).where("v is not null")
    box = box_of(cells)
    kind = "ix long, iy long, median double"
    if box is None:
        return cells.sparkSession.createDataFrame([], kind)

    def medians(key: tuple, rows: pa.Table) -> pa.Table:
        tx, ty = (int(k.as_py()) for k in key)
        x0, x1, y0, y1 = max(tx * side, box[0]), min(tx * side + side - 1, box[1]), max(ty * side, box[2]), min(ty * side + side - 1, box[3])
        none = pa.table({"ix": pa.array([], pa.int64()), "iy": pa.array([], pa.int64()), "median": pa.array([], pa.float64())})
        if x0 > x1 or y0 > y1:  # a halo beyond the box
            return none
        full = np.full((x1 - x0 + 1 + 2 * half, y1 - y0 + 1 + 2 * half), np.nan)
        ix, iy, v = (rows.column(c).to_numpy() for c in ("ix", "iy", "v"))
        full[ix - x0 + half, iy - y0 + half] = v
        # beyond the box stands its edge
        at = [np.clip(np.arange(a - half, b + half + 1), low, high) - a + half for a, b, low, high in ((x0, x1, box[0], box[1]), (y0, y1, box[2], box[3]))]
        got = window_medians(full[np.ix_(*at)], 2 * half + 1)
        i, j = (~np.isnan(got)).nonzero()
        return pa.table({"ix": pa.array(i + x0), "iy": pa.array(j + y0), "median": pa.array(got[i, j])})

    return with_halo(slim, half, side).groupBy("tx", "ty").applyInArrow(medians, kind)


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of each row's runs of true cells, and the first run of its 4-connected component."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = (edge == 1).nonzero()
    end = (edge == -1).nonzero()[1]
    wide = mask.shape[1] + 1
    # runs of the next row that share a column
    low = np.searchsorted(row * wide + end, (row + 1) * wide + start, "right")
    high = np.searchsorted(row * wide + start, (row + 1) * wide + end, "left")
    many = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(row)), many)
    b = np.repeat(low - (many.cumsum() - many), many) + np.arange(len(a))
    root = np.arange(len(row))
    while len(a):
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return row, start, end, root


def _parts(mask: DataFrame, box: tuple[int, int, int, int], void: bool, side: int) -> DataFrame:
    """ix, iy, name, edge of cells: the part of a component inside a tile by its smallest cell; of the void, whether it meets the box's edge, where only cells at a tile's border are told."""
    placed = mask.select(F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"))
    placed = placed.withColumns({"tx": _tile(F.col("ix"), side), "ty": _tile(F.col("iy"), side)})
    kind = "ix long, iy long, name long, edge boolean"

    def name(key: tuple, rows: pa.Table) -> pa.Table:
        tx, ty = (int(k.as_py()) for k in key)
        x0, x1, y0, y1 = max(tx * side, box[0]), min(tx * side + side - 1, box[1]), max(ty * side, box[2]), min(ty * side + side - 1, box[3])
        full = np.zeros((x1 - x0 + 1, y1 - y0 + 1), bool)
        full[rows.column("ix").to_numpy() - x0, rows.column("iy").to_numpy() - y0] = True
        row, start, end, root = runs_of(~full if void else full)
        names = ((row + x0) << 32) + start + y0
        outer = np.zeros(len(row), bool)
        if void:
            meets = (row + x0 == box[0]) | (row + x0 == box[1]) | (start + y0 == box[2]) | (end - 1 + y0 == box[3])
            np.logical_or.at(outer, root, meets)
        run = np.repeat(np.arange(len(row)), end - start)
        i = row[run] + x0
        j = np.arange(len(run)) - np.repeat((end - start).cumsum() - end, end - start) + y0
        run = root[run]
        if void:
            told = ~outer[run] | (i % side == 0) | (i % side == side - 1) | (j % side == 0) | (j % side == side - 1)
            i, j, run = i[told], j[told], run[told]
        return pa.table({"ix": pa.array(i), "iy": pa.array(j), "name": pa.array(names[run]), "edge": pa.array(outer[run])})

    if not void:
        return placed.groupBy("tx", "ty").applyInArrow(name, kind)
    tx, ty = ((box[k] // side, box[k + 1] // side) for k in (0, 2))
    every = mask.sparkSession.range(tx[0], tx[1] + 1).select(F.col("id").alias("tx"), F.explode(F.sequence(F.lit(ty[0]).cast("long"), F.lit(ty[1]).cast("long"))).alias("ty"))
    return every.groupBy("tx", "ty").cogroup(placed.groupBy("tx", "ty")).applyInArrow(lambda key, _, rows: name(key, rows), kind)


def _meeting(parts: DataFrame, side: int) -> DataFrame:
    """a, b: names of parts on both sides of a tile's border."""
    border = parts.select("ix", "iy", "name")
    over = [border.where(F.pmod(F.col(i), F.lit(side)) == side - 1).select(*[(F.col(c) + int(c == i)).alias(c) for c in ("ix", "iy")], F.col("name").alias("a")) for i in ("ix", "iy")]
    first = border.where((F.pmod(F.col("ix"), F.lit(side)) == 0) | (F.pmod(F.col("iy"), F.lit(side)) == 0))
    return over[0].unionAll(over[1]).join(first.withColumnRenamed("name", "b"), ["ix", "iy"]).select("a", "b").distinct()


def _roots(edges: DataFrame) -> DataFrame:
    """node, root of the parts that meet another."""
    edges = table(edges)
    nodes = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return components(nodes, edges)


def _alone(box: tuple[int, int, int, int], side: int) -> bool:
    """Whether one tile holds the box, so that its parts are the components."""
    return box[0] // side == box[1] // side and box[2] // side == box[3] // side


def label(mask: DataFrame, side: int = SIDE) -> DataFrame:
    """ix, iy, component: the smallest (ix, iy) of the 4-connected component, as ix * 2^32 + iy."""
    box = box_of(mask)
    if box is None:
        return mask.sparkSession.createDataFrame([], "ix long, iy long, component long")
    parts = _parts(mask, box, False, side).drop("edge")
    if _alone(box, side):
        return parts.withColumnRenamed("name", "component")
    parts = table(parts)
    # a part's cells are those of one tile, so no name is frequent
    return parts.join(_roots(_meeting(parts, side)), F.col("name") == F.col("node"), "left").select("ix", "iy", F.coalesce("root", "name").alias("component"))


def enclosed(mask: DataFrame, side: int = SIDE) -> DataFrame:
    """ix, iy, component of empty cells of the box that no 4-connected way of empty cells leads out from: what hole filling adds."""
    box = box_of(mask)
    if box is None:
        return mask.sparkSession.createDataFrame([], "ix long, iy long, component long")
    parts = _parts(mask, box, True, side)
    if _alone(box, side):
        return parts.where("not edge").select("ix", "iy", F.col("name").alias("component"))
    parts = table(parts)
    names = parts.where("edge").select("name").distinct()
    rooted = table(_roots(_meeting(parts, side)))
    out = rooted.join(names, F.col("node") == F.col("name"), "left_semi").select("root").distinct()
    open_names = rooted.join(out, "root", "left_semi").select(F.col("node").alias("name")).unionAll(names).distinct()
    inner = parts.where("not edge").join(open_names, "name", "left_anti")
    return inner.join(rooted, F.col("name") == F.col("node"), "left").select("ix", "iy", F.coalesce("root", "name").alias("component"))
