import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from karst.operators import curves, geometry, rasters, skeletons, stats
from karst.sources import logs
from karst.streaming import live


def test_rotations():
    r = geometry.align((1, 0, 0), (0, 1, 0))
    assert np.allclose(r @ [1, 0, 0], [0, 1, 0])
    half = geometry.align((0, 0, 1), (0, 0, -1))
    assert np.allclose(half @ [0, 0, 1], [0, 0, -1]) and abs(np.linalg.det(half) - 1) < 1e-9
    assert np.allclose(geometry.about((0, 0, 1), np.pi / 2) @ [1, 0, 0], [0, 1, 0])
    with pytest.raises(ValueError):
        geometry.unit((0, 0, 0))


def test_phase_shift_of_a_moved_raster():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(40, 50))
    dx, dy = geometry.phase_shift(a, np.roll(a, (3, -4), (0, 1)))
    assert round(dx) == 3 and round(dy) == -4


def test_polyline_and_resampling():
    t = np.linspace(0, 60, 121)
    curve = np.column_stack([t, 5 * np.sin(t / 15), 0 * t])
    line = skeletons.order_polyline(np.random.default_rng(1).permutation(curve), 3.0)
    assert min(line[0][0], line[-1][0]) < 1.5 and max(line[0][0], line[-1][0]) > 58
    rows = skeletons.resample(line)
    assert np.allclose(np.diff(rows[:, 0]), 1) and np.allclose(np.linalg.norm(rows[:, 4:], axis=1), 1)


def test_skeleton_of_a_tube_lies_in_its_middle(spark):
    rng = np.random.default_rng(2)
    x, a = rng.uniform(0, 40, 1500), rng.uniform(-np.pi, np.pi, 1500)
    rows = [(i, float(u), float(2 * np.cos(v)), float(2 * np.sin(v))) for i, (u, v) in enumerate(zip(x, a, strict=True))]
    got = skeletons.l1_skeleton(spark.createDataFrame(rows, "pid long, x double, y double, z double"), 60, (4.0, 6.0), 3).collect()
    assert len(got) == 60 and np.median([np.hypot(r["y"], r["z"]) for r in got]) < 1.2


def test_kept_path_skips_small_steps_and_jumps(spark):
    rows = [(1, float(i), x) for i, x in enumerate([0.0, 0.05, 0.2, 0.25, 1.0, 9.0, 9.5])]
    r = curves.kept_path(spark.createDataFrame(rows, "bag long, t double, x double"), "t", ["x"], 0.1, 2.0, ["bag"]).first()
    assert r["kept"] == 5 and abs(r["length"] - (0.2 + 0.8 + 0.5)) < 1e-9


def test_fits(spark):
    rng = np.random.default_rng(3)
    rows = [(float(x), float(y), float(2 * x - 3 * y + 5)) for x, y in rng.uniform(0, 10, (50, 2))]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    f = stats.plane(df)
    assert abs(f["x"] - 2) < 1e-6 and abs(f["y"] + 3) < 1e-6 and abs(f["constant"] - 5) < 1e-5 and f["residual_std"] < 1e-4
    assert abs(stats.quadratic(df)["xx"]) < 1e-6
    assert stats.plane(df.limit(0))["x"] is None


def test_rasters_of_nothing(spark):
    none = spark.createDataFrame([], "ix long, iy long, v double")
    assert rasters.label(none).count() == rasters.enclosed(none).count() == rasters.dilate(none).count() == rasters.median_filter(none, 3, "v").count() == 0


def test_holes_document(spark, tmp_path):
    p = tmp_path / "h.json"
    p.write_text(json.dumps({"origin": [0, 0, 0], "up": [0, 0, 1], "mode": "aerial", "resolution": 0.5, "source_path": "x", "holes": [{"id": 1, "centroid": [1, 2, 3], "radius": 4, "area": 50, "n_cells": 200}]}))
    r = logs.holes(spark, str(p)).first()
    assert (r["x"], r["semi_major"], r["orientation"]) == (1.0, 4.0, 0.0)


def test_broken_records_are_null(spark):
    df = spark.createDataFrame([(1, bytearray(b"\0\1\0\0" + struct.pack("<i", 7))), (2, bytearray(b"\0")), (3, None)], "id long, data binary")
    assert [r["n"] for r in logs.decode(df, "data", "i", ["n"]).orderBy("id").collect()] == [7, None, None]


def test_numbers_and_tables(spark):
    df = spark.createDataFrame([("1.5",), ("",), ("nan",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(logs.number("v")).collect()] == [1.5, None, None, None, None]
    assert logs.markdown(df.limit(1)).splitlines()[2] == "| 1.5 |"


def test_live_voxels(spark, tmp_path):
    rows = spark.createDataFrame([(0.1, 0.1, 0.1), (0.3, 0.1, 0.1), (5.0, 5.0, 5.0)], "x double, y double, z double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = live.live_voxels(stream, 1.0).writeStream.outputMode("complete").format("memory").queryName("voxels").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["vx"], r["n"], r["x"]) for r in spark.table("voxels").collect()}
    assert got == {(0, 2, 0.2), (5, 1, 5.0)}


def test_late_messages(spark, tmp_path):
    def arrive(name, *rows):
        spark.sql(" UNION ALL ".join(f"SELECT timestamp'2026-01-01 {t}' AS ts, '{topic}' AS topic" for t, topic in rows)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    arrive("first", ("00:00:10", "a"), ("00:00:50", "a"), ("00:01:10", "b"))
    stream = spark.readStream.schema("ts timestamp, topic string").parquet(str(tmp_path / "in"))
    q = live.topic_counts(stream, "ts", "topic", "1 minute", "2 minutes").writeStream.outputMode("append").format("memory").queryName("topics").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    assert spark.table("topics").count() == 0  # no window is closed yet
    arrive("second", ("00:10:00", "b"))
    q.processAllAvailable()
    arrive("late", ("00:00:20", "a"), ("00:10:30", "b"), ("00:20:00", "c"))  # the first comes after its window closed
    q.processAllAvailable()
    q.stop()
    got = sorted((str(r["start"])[14:19], r["topic"], r["n"], str(r["first"])[14:19]) for r in spark.table("topics").collect())
    assert got == [("00:00", "a", 2, "00:10"), ("01:00", "b", 1, "01:10"), ("10:00", "b", 2, "10:00")]


def test_up_axis_of_a_tilted_plane(spark):
    from karst.operators import landmarks

    rng = np.random.default_rng(5)
    p = np.column_stack([rng.uniform(0, 10, (300, 2)), np.zeros(300)]) @ geometry.align((0.3, 0.1, 0.9), (0, 0, 1))
    up = landmarks.up_axis(spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "pid long, x double, y double, z double"), 8)
    assert abs(abs(up @ geometry.unit((0.3, 0.1, 0.9))) - 1) < 1e-6 and up[2] > 0
    assert landmarks.up_axis(spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "pid long, x double, y double, z double"), 8).tolist() == [0, 0, 1]


def test_quadratic_fit_against_least_squares(spark):
    rng = np.random.default_rng(6)
    p = rng.uniform(-3, 3, (400, 3))
    f = stats.quadratic(spark.createDataFrame([tuple(map(float, r)) for r in p], "x double, y double, z double"))
    x, y, z = p.T
    want = np.linalg.lstsq(np.column_stack([x, y, x * x, x * y, y * y, np.ones(400)]), z, rcond=None)[0]
    assert np.allclose([f[k] for k in ("x", "y", "xx", "xy", "yy", "constant")], want, atol=1e-8)
