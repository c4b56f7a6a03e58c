"""Whole-file actions: convert, downsample, export, crop, filter, detect, register, merge, transform.

Each reads with a data source, declares one plan, and writes with a data source;
only counts, headers and landmarks come to the driver.
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.functions import columns as C
from karst.functions import geodesy
from karst.operators import geometry, landmarks, points, relations, spatial
from karst.sources import las, pcd


@dataclass
class Result:
    """What an action wrote; as a number, its points."""

    path: str
    source_count: int
    point_count: int
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)
    fields: list[str] = field(default_factory=list)

    def __int__(self) -> int:
        return self.point_count


def register_sources(spark: SparkSession) -> None:
    spark.dataSource.register(pcd.PcdSource)
    spark.dataSource.register(las.LasSource)


def _check(source: str, target: str, ends: Sequence[str]) -> None:
    if not os.path.exists(source):
        raise FileNotFoundError(source)
    if os.path.abspath(source) == os.path.abspath(target):
        raise ValueError("input and output are the same file")
    if not target.lower().endswith(tuple(ends)):
        raise ValueError(f"the output ends in {' or '.join(ends)}")


def read_pcd(spark: SparkSession, path: str) -> tuple[DataFrame, pcd.Header]:
    register_sources(spark)
    return spark.read.format("pcd").option("path", path).load(), pcd.read_header(path)


def write_pcd(df: DataFrame, path: str, origin: Sequence[float]) -> int:
    register_sources(df.sparkSession)
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    df.write.format("pcd").option("path", path).option("origin", ",".join(map(repr, map(float, origin)))).mode("overwrite").save()
    return pcd.read_header(path).count


def _place(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("float").alias(c) for c in names])


def convert(spark: SparkSession, source: str, target: str, origin: str | Sequence[float] = "header", voxel_size: float | None = None, fields: str = "auto", utm_zone: int | None = None, filter_bounds: bool = True, sidecar: bool = True, systems: tuple[int, int] | None = None) -> Result:
    """LAS to PCD: bounds, projection (utm_zone: from degrees; systems: from one code to another), shift to a local origin, voxel means, and a sidecar that tells the origin."""
    _check(source, target, [".pcd"])
    if voxel_size is not None and voxel_size <= 0:
        raise ValueError("a voxel needs a size above zero")
    register_sources(spark)
    head = las.read_header(source)
    df = spark.read.format("las").option("path", source).option("fields", fields).option("bounds", str(filter_bounds).lower()).load()
    names = df.columns
    if utm_zone is not None:
        x, y = geodesy.utm(F.col("x"), F.col("y"), utm_zone)
        df = df.withColumns({"x": x, "y": y})
    if systems is not None:
        x, y = geodesy.reproject(F.col("x"), F.col("y"), *systems)
        df = df.withColumns({"x": x, "y": y})
    if origin == "header":
        if utm_zone is None and systems is None:
            at = las.suggested_origin(head)
        else:
            (x0, _), (y0, _) = points.extent(df, "x", "y")
            at = (float(np.floor(x0 or 0)), float(np.floor(y0 or 0)), 0.0)
    elif origin == "none":
        at = (0.0, 0.0, 0.0)
    else:
        at = tuple(map(float, origin))
    df = df.withColumns({c: C.local(c, at[k]) for k, c in enumerate("xyz")})
    if voxel_size is not None:
        df = points.voxel_downsample(df, voxel_size).orderBy("vx", "vy", "vz")
    n = write_pcd(_place(df, names), target, at)
    if sidecar:
        with open(f"{target}.origin.json", "w") as f:
            json.dump({"source": source, "source_point_count": head.count, "point_count": n, "voxel_size": voxel_size, "fields": list(names), "origin_xyz": list(at), "note": "global = local + origin"}, f, indent=1)
    return Result(target, head.count, n, at, list(names))


def _rewrite(spark: SparkSession, source: str, target: str, change) -> Result:
    _check(source, target, [".pcd"])
    df, head = read_pcd(spark, source)
    n = write_pcd(_place(change(df), head.columns), target, head.origin)
    return Result(target, head.count, n, head.origin, head.columns)


def downsample(spark: SparkSession, source: str, target: str, voxel_size: float) -> Result:
    if voxel_size <= 0:
        raise ValueError("a voxel needs a size above zero")
    return _rewrite(spark, source, target, lambda df: points.voxel_downsample(df, voxel_size).orderBy("vx", "vy", "vz"))


def crop(spark: SparkSession, source: str, target: str, bounds: Sequence[float], axes: str = "xy", in_global: bool = False) -> Result:
    if in_global:
        at = pcd.read_header(source).origin
        bounds = [b - at["xyz".index(axes[k % 2])] for k, b in enumerate(bounds)]
    return _rewrite(spark, source, target, lambda df: points.crop(df, bounds, axes))


def outliers(spark: SparkSession, source: str, target: str, method: str = "radius", radius: float = 1.0, least: int = 2, k: int = 8, ratio: float = 2.0) -> Result:
    if method not in ("radius", "statistical"):
        raise ValueError("method is radius or statistical")

    def change(df: DataFrame) -> DataFrame:
        numbered = df.withColumn("pid", F.monotonically_increasing_id()).persist()
        return spatial.radius_outliers(numbered, radius, least) if method == "radius" else spatial.statistical_outliers(numbered, k, ratio)

    return _rewrite(spark, source, target, change)


def export(spark: SparkSession, source: str, target: str, scale: float = 0.001, epsg: int = 0) -> Result:
    """PCD to LAS in global coordinates; epsg: the code of their system, written into the file."""
    _check(source, target, [".las"])
    df, head = read_pcd(spark, source)
    df.write.format("las").option("path", target).option("scale", str(scale)).option("epsg", str(epsg)).option("origin", ",".join(map(repr, head.origin))).mode("overwrite").save()
    return Result(target, head.count, las.read_header(target).count, head.origin, head.columns)


def detect(spark: SparkSession, source: str, target: str | None = None, resolution: float = 1.0, least: float = 1, relative: float | None = None, min_area: float = 0.0, max_area: float = float("inf"), edge: int = 0, mode: str = "aerial", up: Sequence[float] | None = None, jump: float = 1.5, smooth: float = 0.0, merge: float | None = None) -> dict:
    """Openings as a document: origin, up, resolution, holes.

    aerial: enclosed voids seen from above; ceiling: voids and jumps of the highest
    points, seen along up, which is estimated where it is not given.
    """
    if mode not in ("aerial", "ceiling"):
        raise ValueError("mode is aerial or ceiling")
    df, head = read_pcd(spark, source)
    if up is None:
        up = (0.0, 0.0, 1.0) if mode == "aerial" else landmarks.up_axis(df.withColumn("pid", F.monotonically_increasing_id()))
    up = tuple(map(float, geometry.unit(up)))
    turned = relations.up_frame(df, up)
    (x0, x1), (y0, y1) = points.extent(turned, "x", "y")
    if x0 is None:
        raise ValueError("the cloud is empty")
    points.check_grid(int(-(-(x1 - x0) // resolution)) + 1, int(-(-(y1 - y0) // resolution)) + 1)
    cells = points.grid(turned, resolution, (x0, y0)).persist()
    if mode == "aerial":
        found = landmarks.voids(cells, resolution, (x0, y0), least, min_area, max_area, relative, edge=edge, smooth=smooth, merge=merge)
    else:
        found = landmarks.ceiling_holes(cells, resolution, (x0, y0), jump, least, min_area, max_area, relative, edge=edge, smooth=smooth, merge=merge)
    rows = found.orderBy("component").limit(landmarks.MOST_LANDMARKS + 1).collect()
    if len(rows) > landmarks.MOST_LANDMARKS:
        raise ValueError(f"more than {landmarks.MOST_LANDMARKS} voids; raise min_area")
    back = geometry.align(up, (0, 0, 1)).T
    holes = [{"id": i, "centroid": [float(v) for v in back @ [r["x"], r["y"], r["z"]]], "radius": r["radius"], "area": r["area"], "n_cells": r["n"], "semi_major": r["semi_major"], "semi_minor": r["semi_minor"], "orientation": r["orientation"]} for i, r in enumerate(rows)]
    out = {"origin": list(head.origin), "up": list(up), "mode": mode, "resolution": resolution, "source_path": source, "holes": holes}
    if target:
        os.makedirs(os.path.dirname(os.path.abspath(target)), exist_ok=True)
        with open(target, "w") as f:
            json.dump(out, f, indent=1)
    return out


def _table(holes: dict) -> np.ndarray:
    return np.array([[*h["centroid"], h["area"], h.get("semi_major", h["radius"]), h.get("semi_minor", h["radius"]), h.get("orientation", 0.0)] for h in holes["holes"]], float).reshape(-1, 7)


def register(a: dict, b: dict, target: str | None = None, mode: str = "auto", tolerance: float = 2.0, least: int = 3) -> dict:
    """The motion of b's landmarks onto a's, as a document."""
    ups = [h.get("up", [0.0, 0.0, 1.0]) for h in (a, b)]
    ta, tb = _table(a), _table(b)
    m = landmarks.match(ta, tb, mode, tolerance, least, *ups)
    major = lambda h: (geometry.align(ups[0], (0, 0, 1)).T @ [np.cos(h.get("orientation", 0.0)), np.sin(h.get("orientation", 0.0)), 0.0]).tolist()
    used = [a["holes"][j] for _, j in m.inliers]
    found = asdict(m) | {"matrix": m.matrix.tolist(), "n_inliers": len(m.inliers), "aerial_origin": a["origin"], "tube_origin": b["origin"], "aerial_up": list(ups[0]), "tube_up": list(ups[1]), "anchors": [h["centroid"] for h in used], "anchor_axes": [[h.get("semi_major", h["radius"]), h.get("semi_minor", h["radius"]), *major(h)] for h in used], "vertical_residuals": landmarks.vertical_residuals(ta, tb, m, ups[0])}
    if target:
        with open(target, "w") as f:
            json.dump(found, f, indent=1)
    return found


def transform(spark: SparkSession, source: str, target: str, motion: dict) -> Result:
    """Apply a motion; the output's origin is the frame it is moved to."""
    _check(source, target, [".pcd"])
    df, head = read_pcd(spark, source)
    at = tuple(motion.get("aerial_origin", head.origin))
    n = write_pcd(_place(points.transform(df, motion["matrix"]), head.columns), target, at)
    return Result(target, head.count, n, at, head.columns)


def merge(spark: SparkSession, aerial: str, tube: str, target: str, motion: dict, z_offset: float = 0.0, tag: bool = True, refine: bool = False, rim: float = 3.0, color: str | None = None, height: float = 3.0, inflate: float = 1.5) -> Result:
    """Both clouds in the first one's frame, the second moved (and refined on the rims of the anchors)."""
    _check(aerial, target, [".pcd"])
    _check(tube, target, [".pcd"])
    (a, ha), (b, _) = read_pcd(spark, aerial), read_pcd(spark, tube)
    matrix = np.array(motion["matrix"], float)
    if refine and motion.get("anchors"):
        matrix = _refined(spark, a, b, matrix, motion, rim, height, inflate)
    moved = points.transform(b, matrix.tolist(), z_offset)
    both = [a, moved]
    if color == "elevation":
        (low, high), (low2, high2) = points.extent(a, "z")[0], points.extent(moved, "z")[0]
        step = C.ramp(F.col("z"), min(low, low2), max(high, high2))
        both = [d.withColumns({"r": step, "g": 255 - step, "b": F.lit(128)}) for d in both]
    colour = {c: F.lit(200.0) for c in "rgb"}
    out = points.merge(both, [0, 1] if tag else None, colour | {"intensity": F.lit(0.0)})
    n = write_pcd(_place(out, out.columns), target, ha.origin)
    return Result(target, ha.count, n, ha.origin, out.columns)


def _refined(spark: SparkSession, a: DataFrame, b: DataFrame, matrix: np.ndarray, motion: dict, rim: float, height: float, inflate: float, most: int = 20_000) -> np.ndarray:
    """ICP on the points around the anchors' openings: a bounded sample of them, by a hash."""
    axes = motion.get("anchor_axes") or [[None] * 5] * len(motion["anchors"])
    at = spark.createDataFrame([(i, *map(float, p), *(None if v is None else float(v) for v in x)) for i, (p, x) in enumerate(zip(motion["anchors"], axes, strict=True))], "pid long, x double, y double, z double, semi_major double, semi_minor double, mx double, my double, mz double")

    def near(d: DataFrame) -> np.ndarray:
        own = d.select(F.monotonically_increasing_id().alias("pid"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
        found = landmarks.rim(own, at, height, rim, inflate, motion.get("aerial_up", (0, 0, 1))).orderBy(F.xxhash64("x", "y", "z"), "pid").limit(most)
        return np.array([[r["x"], r["y"], r["z"]] for r in found.collect()], float).reshape(-1, 3)

    target, moved = near(a), near(points.transform(b, matrix.tolist()))
    step, _ = landmarks.refine(moved, target, np.eye(4))
    return step @ matrix
