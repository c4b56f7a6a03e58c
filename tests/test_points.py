import numpy as np
import pytest
from pyspark.sql import functions as F

from karst.functions import columns as C
from karst.functions import geodesy
from karst.operators import landmarks, points, profiles, rasters, reports, spatial


def cloud(spark, rows):
    rows = [(i, *map(float, r)) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, "pid long, x double, y double, z double")


def lattice(n):
    return [(x, y, z) for x in range(n) for y in range(n) for z in range(n)]


def test_crop_of_a_lattice_keeps_edges(spark):
    assert points.crop(cloud(spark, lattice(10)), (2, 5, 4, 7)).count() == 90
    assert points.crop(cloud(spark, [(x, y, 0) for x in range(6) for y in range(6)]), (3, 4, 1, 2)).count() == 9
    with pytest.raises(ValueError):
        points.crop(cloud(spark, lattice(2)), (0, 0, 1, 1), "xx")


def test_voxels_of_two_clusters(spark):
    rng = np.random.default_rng(1)
    rows = np.concatenate([1.5 + rng.uniform(-0.05, 0.05, (500, 3)), 20.5 + rng.uniform(-0.05, 0.05, (500, 3))])
    got = sorted((r["x"], r["n"]) for r in points.voxel_downsample(cloud(spark, rows), 1.0).collect())
    assert [n for _, n in got] == [500, 500]
    assert abs(got[0][0] - rows[:500, 0].mean()) < 1e-9
    with pytest.raises(ValueError):
        points.voxel_downsample(cloud(spark, rows), 0)


def test_outliers_of_a_lattice(spark):
    c = cloud(spark, [*lattice(8), (100, 100, 100)])
    assert spatial.radius_outliers(c, 1.5, 2).count() == 512
    kept = {r["pid"] for r in spatial.statistical_outliers(c, 8, 2.0).collect()}
    assert 512 not in kept and len(kept) > 500


def test_knn_takes_all_when_there_are_too_few(spark):
    got = spatial.knn(cloud(spark, [(0, 0, 0), (1, 0, 0), (50, 0, 0)]), 8).collect()
    assert len(got) == 6
    assert spatial.knn(cloud(spark, [(0, 0, 0)]), 3).count() == 0


def test_bounds_drop_sentinels(spark):
    c = cloud(spark, [(1, 1, 1)] * 100 + [(2147483, 1, 1)] * 5)
    keep = points.within_bounds((0, 0, 0), (2, 2, 2))
    assert c.where(keep).count() == 100


def test_colours_round_trip(spark):
    df = spark.createDataFrame([(0, 0, 0), (255, 128, 3), (300, -4, 255)], "r int, g int, b int")
    packed = df.select(C.pack_rgb(F.col("r"), F.col("g"), F.col("b")).alias("rgb"))
    got = packed.select(*C.unpack_rgb(F.col("rgb"))).collect()
    assert [tuple(r) for r in got] == [(0, 0, 0), (255, 128, 3), (255, 0, 255)]


def test_utm_of_known_points(spark):
    # the central meridian at the equator, and a symmetric pair
    df = spark.createDataFrame([(-21.0, 0.0), (-20.0, 63.9), (-22.0, 63.9)], "lon double, lat double")
    got = df.select(*geodesy.utm(F.col("lon"), F.col("lat"), 27)).collect()
    assert abs(got[0][0] - 500000) < 1e-6 and abs(got[0][1]) < 1e-6
    assert abs(got[1][0] + got[2][0] - 1_000_000) < 1e-6 and abs(got[1][1] - got[2][1]) < 1e-6
    # the arc of meridian to 63.9 degrees is 7,087 km on this ellipsoid, less the scale
    assert 7.08e6 < got[1][1] < 7.095e6


def test_voids_of_a_ground(spark):
    holes = [(25, 30), (62, 35), (40, 72), (78, 76)]
    rows = [(x + 0.5, y + 0.5, 0) for x in range(100) for y in range(100) if all(np.hypot(x + 0.5 - a, y + 0.5 - b) > 4 for a, b in holes)]
    got = landmarks.voids(points.grid(cloud(spark, rows), 1.0, (0, 0)), 1.0, (0.0, 0.0), min_area=10).collect()
    assert len(got) == 4
    for a, b in holes:
        assert min(np.hypot(r["x"] - a, r["y"] - b) for r in got) < 1.5
    assert points.occupancy(cloud(spark, []), 1.0).count() == 0


def test_grid_guard(spark):
    with pytest.raises(ValueError):
        points.check_grid(10_000, 10_000)


def turned(angle, shift):
    c, s = np.cos(angle), np.sin(angle)
    m = np.eye(4)
    m[:2, :2], m[:3, 3] = [[c, -s], [s, c]], shift
    return m


def test_matching_with_spurious_landmarks():
    rng = np.random.default_rng(5)
    b = rng.uniform(0, 100, (6, 3))
    m = turned(0.9, (10, -4, 3))
    a = np.concatenate([b @ m[:3, :3].T + m[:3, 3] + rng.normal(0, 0.05, (6, 3)), rng.uniform(200, 300, (2, 3))])
    got = landmarks.match(a, np.concatenate([b, rng.uniform(-300, -200, (2, 3))]), "4dof")
    assert len(got.inliers) == 6 and np.abs(got.matrix - m).max() < 0.5 and got.margin >= 1


def test_matching_of_a_triangle_is_ambiguous():
    t = np.array([[0, 0, 0], [10, 0, 0], [5, 10 * np.sqrt(3) / 2, 0]])
    got = landmarks.match(t, t, "4dof")
    assert got.margin <= 0 and any("ambiguous" in w for w in got.warnings)


def test_full_motion():
    rng = np.random.default_rng(2)
    b = rng.uniform(0, 50, (7, 3))
    u = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    u *= np.sign(np.linalg.det(u))
    got = landmarks.match(b @ u.T + [1, 2, 3], b, "6dof", tolerance=0.5)
    assert np.abs(got.matrix[:3, :3] - u).max() < 1e-2


def test_refinement_and_its_refusal():
    t = np.linspace(0, 2 * np.pi, 240, endpoint=False)
    ring = np.column_stack([5 * np.cos(t), 5 * np.sin(t), 0 * t])
    moved = ring + [0.4, 0, 0]
    m, changed = landmarks.refine(moved, ring, np.eye(4))
    assert changed and abs(m[0, 3] + 0.4) < 0.1
    _, changed = landmarks.refine(ring + [1.5, 0, 0], ring, np.eye(4), most_shift=0.2)
    assert not changed


def test_up_axis_of_a_plane(spark):
    rng = np.random.default_rng(4)
    n = np.array([0.2, -0.3, 0.93]) / np.linalg.norm([0.2, -0.3, 0.93])
    xy = rng.uniform(0, 12, (600, 2))
    rows = np.column_stack([xy, -(xy @ n[:2]) / n[2]])
    assert landmarks.up_axis(cloud(spark, rows), 10) @ n > 0.9
    assert landmarks.up_axis(cloud(spark, rows[:3]), 10).tolist() == [0, 0, 1]


def test_labels_across_a_long_snake(spark):
    snake = [(x, 0) for x in range(30)] + [(29, y) for y in range(30)] + [(50, 50)]
    mask = spark.createDataFrame(snake, "ix long, iy long")
    got = rasters.label(mask).groupBy("component").count().collect()
    assert sorted(r["count"] for r in got) == [1, 59]


def test_section_of_a_round_tunnel(spark):
    t = np.linspace(-np.pi, np.pi, 720, endpoint=False)
    rows = [(x, 4 * np.cos(a), 4 * np.sin(a)) for x in (-0.5, 0.0, 0.5) for a in t]
    stations = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0)], "pid long, x double, y double, z double, tx double, ty double, tz double")
    r = profiles.sections(stations, cloud(spark, rows)).first()
    assert abs(r["area"] - np.pi * 16) < 0.5 and r["coverage"] == 1.0 and abs(r["width"] - 8) < 0.1 and abs(r["z_ceil"] - 4) < 0.1


def test_reports(spark):
    old, new = ({"a": {"b": [1.0, 2.0]}, "gone": 1.0}, {"a": {"b": [1.0, 2.05]}, "fresh": 3})
    got = {r["key"]: r["verdict"] for r in reports.compare(reports.leaves(spark, old), reports.leaves(spark, new), 0.01, 0.05).collect()}
    assert got == {"a.b[0]": "identical", "a.b[1]": "within relative", "gone": "removed", "fresh": "added"}
