"""Centrelines: L1-medial contraction, ordering along a tree's longest way, even resampling.

The contraction joins samples with points through grid cells each round; samples
are a bounded number (MOST_SAMPLES) and points any number.  What is ordered and
resampled is the samples alone, on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.operators.lineage import cut
from karst.operators.spatial import near_pairs

MOST_SAMPLES = 5000


def samples(points: DataFrame, n: int) -> DataFrame:
    """Exactly n rows (or all), chosen by a hash of pid: the same at every run; the n least of each task meet, nothing is sorted whole."""
    return points.orderBy(F.md5(F.col("pid").cast("string")), "pid").limit(n)


def l1_skeleton(points: DataFrame, n: int = 1000, radii: tuple[float, ...] = (2.0, 4.0, 8.0), rounds: int = 5, repel: float = 0.1) -> DataFrame:
    """pid, x, y, z of samples drawn to the local medians of points and pushed apart along the curve."""
    if n > MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} samples")
    own = points.select("pid", "x", "y", "z")
    now = cut(samples(own, n))
    for h in radii:
        # the tenth of a radius keeps a sample from clinging to the point it came from
        weight = F.exp(-F.col("d2") * 4 / (h * h)) / (F.sqrt("d2") + h / 10)
        for _ in range(rounds):
            drawn = near_pairs(now, own, h).withColumn("w", weight).groupBy(F.col("a.pid").alias("pid")).agg(*[(F.sum(F.col("w") * F.col(f"b.{c}")) / F.sum("w")).alias(f"m{c}") for c in "xyz"])
            apart = near_pairs(now, now, h).where("a.pid <> b.pid").withColumn("w", F.exp(-F.col("d2") * 4 / (h * h)) / (F.col("d2") + h * h / 100))
            push = apart.groupBy(F.col("a.pid").alias("pid")).agg(*[(F.sum(F.col("w") * (F.col(f"a.{c}") - F.col(f"b.{c}"))) / F.sum("w")).alias(f"p{c}") for c in "xyz"])
            moved = now.join(drawn, "pid", "left").join(push, "pid", "left")
            now = cut(moved.select("pid", *[(F.coalesce(f"m{c}", c) + repel * F.coalesce(f"p{c}", F.lit(0.0))).alias(c) for c in "xyz"]))
    return now


def order_polyline(p: np.ndarray, reach: float = 8.0, step: float = 1.0) -> np.ndarray:
    """The longest way through the minimum spanning tree of the largest group of points within reach."""
    p = np.asarray(p, float)
    if len(p) > MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} points")
    _, first = np.unique(np.floor(p / step).astype(np.int64), axis=0, return_index=True)
    p = p[np.sort(first)]
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    left, best = set(range(len(p))), []
    while left:
        # Prim's tree of one group
        start = min(left)
        near, link, tree, edges = {start: 0.0}, {}, [], []
        while near:
            i = min(near, key=near.get)
            del near[i]
            left.discard(i)
            tree.append(i)
            if i in link:
                edges.append((i, link[i], d[i, link[i]]))
            for j in left:
                if d[i, j] <= reach and d[i, j] < near.get(j, np.inf):
                    near[j], link[j] = d[i, j], i
        if len(tree) > len(best):
            best, kept = tree, edges
    if len(best) < 2:
        return p[best]
    next_to: dict[int, list[tuple[int, float]]] = {i: [] for i in best}
    for i, j, w in kept:
        next_to[i].append((j, w))
        next_to[j].append((i, w))

    def sweep(a: int) -> tuple[int, dict[int, int]]:
        far, back, todo = {a: 0.0}, {}, [a]
        while todo:
            i = todo.pop()
            for j, w in next_to[i]:
                if j not in far:
                    far[j], back[j] = far[i] + w, i
                    todo.append(j)
        return max(far, key=far.get), back

    a, _ = sweep(best[0])
    b, back = sweep(a)
    way = [b]
    while way[-1] != a:
        way.append(back[way[-1]])
    return p[way]


def resample(line: np.ndarray, step: float = 1.0, smooth: int = 5) -> np.ndarray:
    """s, x, y, z, tx, ty, tz each step along a moving average of the line; ends stay."""
    line = np.asarray(line, float)
    if len(line) < 2:
        raise ValueError("a line needs two points")
    half = smooth // 2
    padded = np.concatenate([np.repeat(line[:1], half, axis=0), line, np.repeat(line[-1:], half, axis=0)])
    soft = np.column_stack([np.convolve(padded[:, k], np.ones(2 * half + 1) / (2 * half + 1), "valid") for k in range(3)])
    soft[0], soft[-1] = line[0], line[-1]
    arc = np.concatenate([[0], np.linalg.norm(np.diff(soft, axis=0), axis=1).cumsum()])
    s = np.arange(0, arc[-1] + 1e-9, step)
    at = np.column_stack([np.interp(s, arc, soft[:, k]) for k in range(3)])
    t = np.gradient(at, axis=0) if len(at) > 1 else np.tile((soft[-1] - soft[0]), (len(at), 1))
    return np.column_stack([s, at, t / np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-12)])
