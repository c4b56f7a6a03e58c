"""Command line: python -m karst.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

import karst


def _numbers(text: str) -> list[float]:
    return [float(v) for v in text.split(",")]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="karst", description="Point clouds on Spark")
    p.add_argument("--version", action="version", version=karst.__version__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *paths: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for path in paths:
            c.add_argument(path)
        return c

    c = command("convert", "source", "target")
    c.add_argument("--origin", default="header", help="header, none or x,y,z")
    c.add_argument("-v", "--voxel", type=float)
    c.add_argument("--fields", default="auto")
    c.add_argument("--utm-zone", type=int, help="project longitude and latitude")
    c.add_argument("--reproject", help="from:to codes, as 8088:32627")
    c.add_argument("--keep-out-of-bounds", action="store_true")
    c = command("downsample", "source", "target")
    c.add_argument("-v", "--voxel", type=float, required=True)
    c = command("to-las", "source", "target")
    c.add_argument("--scale", type=float, default=0.001)
    c.add_argument("--epsg", type=int, default=0)
    c = command("crop", "source", "target")
    c.add_argument("bounds", type=_numbers, help="a0,b0,a1,b1")
    c.add_argument("--axes", default="xy")
    c.add_argument("--global", dest="in_global", action="store_true")
    c = command("filter", "source", "target")
    c.add_argument("--method", default="radius", choices=["radius", "statistical"])
    for name, kind, value in (("radius", float, 1.0), ("min-neighbors", int, 2), ("k", int, 8), ("std-ratio", float, 2.0)):
        c.add_argument(f"--{name}", type=kind, default=value)
    c = command("holes", "source", "target")
    for name, kind, value in (("resolution", float, 1.0), ("min-density", float, 1), ("relative", float, None), ("min-area", float, 0.0), ("max-area", float, float("inf")), ("edge-margin", int, 0), ("jump", float, 1.5), ("smooth", float, 0.0)):
        c.add_argument(f"--{name}", type=kind, default=value)
    c.add_argument("--mode", default="aerial", choices=["aerial", "ceiling"])
    c.add_argument("--up", type=_numbers, help="x,y,z; estimated for a ceiling where it is not given")
    c.add_argument("--merge", type=float, help="widen ellipses by this and make one of those that reach each other")
    c = command("occupancy", "source")
    c.add_argument("--resolution", type=float, default=1.0)
    c = command("register", "aerial", "tube", "target")
    c.add_argument("--mode", default="auto", choices=["auto", "4dof", "6dof"])
    c.add_argument("--tolerance", type=float, default=2.0)
    c.add_argument("--min-inliers", type=int, default=3)
    c = command("merge", "aerial", "tube", "motion", "target")
    c.add_argument("--z-offset", type=float, default=0.0)
    c.add_argument("--refine", action="store_true")
    for name, value in (("rim", 3.0), ("rim-height", 3.0), ("inflate", 1.5)):
        c.add_argument(f"--{name}", type=float, default=value)
    c.add_argument("--no-source", action="store_true")
    c.add_argument("--color", choices=["elevation"])
    command("transform", "source", "motion", "target")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        print(run(a))
    except (FileNotFoundError, ValueError, RuntimeError) as e:
        print(f"\033[31m{e}\033[0m", file=sys.stderr)
        return 1
    return 0


def _json(path: str) -> dict:
    with open(path) as f:
        return json.load(f)


def run(a: argparse.Namespace) -> str:
    from pyspark.sql import SparkSession

    from karst.operators import points
    from karst.sources import clouds

    if a.command == "register":
        found = clouds.register(_json(a.aerial), _json(a.tube), a.target, a.mode, a.tolerance, a.min_inliers)
        return f"{found['n_inliers']} landmarks agree, rms {found['rms']:.3f}" + "".join(f"\nwarning: {w}" for w in found["warnings"])
    spark = SparkSession.builder.getOrCreate()
    if a.command == "holes":
        found = clouds.detect(spark, a.source, a.target, a.resolution, a.min_density, a.relative, a.min_area, a.max_area, a.edge_margin, a.mode, a.up, a.jump, a.smooth, a.merge)
        return f"{len(found['holes'])} voids"
    if a.command == "occupancy":
        cells = points.occupancy(clouds.read_pcd(spark, a.source)[0], a.resolution)
        return f"{cells.count()} occupied cells"
    if a.command == "convert":
        origin = a.origin if a.origin in ("header", "none") else _numbers(a.origin)
        r = clouds.convert(spark, a.source, a.target, origin, a.voxel, a.fields, a.utm_zone, not a.keep_out_of_bounds, systems=tuple(map(int, a.reproject.split(":"))) if a.reproject else None)
    elif a.command == "downsample":
        r = clouds.downsample(spark, a.source, a.target, a.voxel)
    elif a.command == "to-las":
        r = clouds.export(spark, a.source, a.target, a.scale, a.epsg)
    elif a.command == "crop":
        r = clouds.crop(spark, a.source, a.target, a.bounds, a.axes, a.in_global)
    elif a.command == "filter":
        r = clouds.outliers(spark, a.source, a.target, a.method, a.radius, a.min_neighbors, a.k, a.std_ratio)
    elif a.command == "merge":
        r = clouds.merge(spark, a.aerial, a.tube, a.target, _json(a.motion), a.z_offset, not a.no_source, a.refine, a.rim, a.color, a.rim_height, a.inflate)
    else:
        r = clouds.transform(spark, a.source, a.target, _json(a.motion))
    return f"{r.path}: {int(r)} points"


if __name__ == "__main__":
    sys.exit(main())
