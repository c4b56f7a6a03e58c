"""Relations, openings, surveys, projections and files against brute force and fixtures."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from karst import cli
from karst.functions import geodesy
from karst.operators import curves, geometry, graphs, landmarks, points, rasters, relations, spatial, stats, surveys
from karst.sources import clouds, las, tables


def frame(spark, rows, schema):
    return spark.createDataFrame([tuple(v.item() if isinstance(v, np.generic) else v for v in r) for r in rows], schema)


def scene(spark, shift=0.0, deep=0.0):
    """A ground of 60 x 60 points with three holes."""
    holes = [(15, 18), (40, 22), (28, 45)]
    rows = [(x + 0.5 + shift, y + 0.5, 0.1 * (x % 3) - deep) for x in range(60) for y in range(60) if all(np.hypot(x + 0.5 - a, y + 0.5 - b) > 4 for a, b in holes)]
    return frame(spark, rows, "x double, y double, z double")


@pytest.mark.parametrize(("code", "lon", "lat"), [(32627, -22.0, 64.0), (32727, -20.0, -33.0), (3057, -18.2, 64.9), (8088, -21.5, 63.9), (3413, -30.0, 80.0)])
def test_projections_there_and_back(spark, code, lon, lat):
    rng = np.random.default_rng(0)
    rows = [(lon + a, lat + b) for a, b in rng.uniform(-1.5, 1.5, (50, 2))]
    df = frame(spark, rows, "a double, b double")
    x, y = geodesy.reproject(F.col("a"), F.col("b"), 4326, code)
    there = df.select("a", "b", x.alias("x"), y.alias("y"))
    p, q = geodesy.reproject(F.col("x"), F.col("y"), code, 4326)
    got = there.select("a", "b", "x", "y", p.alias("p"), q.alias("q")).toPandas()
    assert np.abs(got.a - got.p).max() < 1e-9 and np.abs(got.b - got.q).max() < 1e-9
    # conformal: a small step north and one east of the same length turn into steps of equal length, at right angles
    e = 1e-6
    steps = frame(spark, [(lon, lat), (lon + e / np.cos(np.radians(lat)), lat), (lon, lat + e)], "a double, b double").select(x.alias("x"), y.alias("y")).toPandas().to_numpy()
    u, v = steps[1] - steps[0], steps[2] - steps[0]
    assert abs(u @ v) / (np.linalg.norm(u) * np.linalg.norm(v)) < 1e-2 and abs(np.linalg.norm(u) / np.linalg.norm(v) - 1) < 1e-2


def test_projections_at_their_origins(spark):
    df = frame(spark, [(-19.0, 65.0)], "a double, b double")
    for code, want in ((3057, (500000, 500000)), (8088, (2700000, 300000))):
        x, y = geodesy.reproject(F.col("a"), F.col("b"), 4326, code)
        assert np.allclose(df.select(x, y).first(), want, atol=1e-6)
    with pytest.raises(ValueError):
        geodesy.reproject(F.col("a"), F.col("b"), 4326, 2154)


def test_several_files_a_box_and_filters_in_one_load(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(3):
        own = rng.uniform(0, 10, (40, 3))
        rows += (own + [100 * k, 0, 0]).tolist()
        clouds.write_pcd(frame(spark, own, "x double, y double, z double"), str(tmp_path / f"t{k}.pcd"), (100.0 * k, 0, 0))
        clouds.export(spark, str(tmp_path / f"t{k}.pcd"), str(tmp_path / f"t{k}.las"), epsg=3057)
    clouds.register_sources(spark)
    rows = np.array(rows)
    for kind in ("pcd", "las"):
        every = spark.read.format(kind).option("path", str(tmp_path) if kind == "pcd" else str(tmp_path / "*.las")).load()
        assert every.count() == 120 and np.allclose(np.sort([r["x"] for r in every.collect()]), np.sort(rows[:, 0]), atol=1e-2)
        boxed = spark.read.format(kind).option("path", str(tmp_path)).option("box", "95,,2,205,8,").option("bounds", "true").load()
        want = ((rows[:, 0] >= 95) & (rows[:, 0] <= 205) & (rows[:, 1] <= 8) & (rows[:, 2] >= 2)).sum()
        assert abs(boxed.count() - want) <= 1
        want = ((rows[:, 0] > 100) & (rows[:, 1] <= 5)).sum()
        few = spark.read.format(kind).option("path", str(tmp_path)).option("where", "x > 100 and y<=5,z >= -1e3").load()
        # one query's filter is not another's
        assert few.count() == every.where("x > 100 and y <= 5 and z is not null and x not in (1.5)").count() == want and every.count() == 120
        for bad, said in (("x > y", "with a number"), ("w > 1", "no column w")):
            with pytest.raises(Exception, match=said):
                spark.read.format(kind).option("path", str(tmp_path)).option("where", bad).load().count()
    assert las.read_epsg(str(tmp_path / "t0.las")) == 3057
    with pytest.raises(Exception, match="larger"):
        frame(spark, [(3e6, 0.0, 0.0)], "x double, y double, z double").write.format("las").option("path", str(tmp_path / "big.las")).option("scale", "0.001").mode("overwrite").save()


def test_ceiling_openings_and_their_levels(spark):
    # a ceiling at 5 with a chimney (jump) and a gap, seen in a tilted frame
    rows = [(x + 0.5, y + 0.5, 9.0 if 10 <= x < 14 and 10 <= y < 13 else 5.0) for x in range(30) for y in range(30) if not (20 <= x < 24 and 18 <= y < 22)]
    cells = points.grid(frame(spark, rows, "x double, y double, z double"), 1.0, (0.0, 0.0))
    got = landmarks.ceiling_holes(cells, 1.0, (0.0, 0.0), jump=1.5, min_area=4).orderBy("component").collect()
    assert [(r["n"], round(r["x"], 3), round(r["y"], 3)) for r in got] == [(12, 12.0, 11.5), (16, 22.0, 20.0)]
    assert got[0]["z"] == got[1]["z"] == 5.0  # of the cells in and beside the chimney 12 are up and 14 are not
    assert landmarks.ceiling_holes(cells, 1.0, (0.0, 0.0), jump=1.5, min_area=13).count() == 1
    assert landmarks.ceiling_holes(cells, 1.0, (0.0, 0.0), jump=1.5, edge=9).count() == 1


def test_openings_that_reach_each_other_become_one(spark):
    rows = [(x + 0.5, y + 0.5, 1.0) for x in range(40) for y in range(40) if not (5 <= y < 9 and (5 <= x < 9 or 10 <= x < 14 or 15 <= x < 19)) and not (30 <= x < 33 and 30 <= y < 33)]
    cells = points.grid(frame(spark, rows, "x double, y double, z double"), 1.0, (0.0, 0.0))
    apart, one = (landmarks.voids(cells, 1.0, (0.0, 0.0), merge=m).orderBy("component").collect() for m in (None, 1.2))
    assert [r["n"] for r in apart] == [16, 16, 16, 9] and [r["n"] for r in one] == [48, 9]
    cells_of = np.array([(x + 0.5, y + 0.5) for x in (*range(5, 9), *range(10, 14), *range(15, 19)) for y in range(5, 9)])
    w = np.linalg.eigvalsh(np.cov(cells_of.T))
    assert np.allclose([one[0]["x"], one[0]["y"], one[0]["semi_major"], one[0]["semi_minor"]], [*cells_of.mean(axis=0), 2 * np.sqrt(w[1]), 2 * np.sqrt(w[0])])
    assert one[0]["merged"] == 3 and abs(one[0]["area"] - 48) < 1e-9


def test_components_of_a_chain(spark):
    nodes = spark.range(200).select("id")
    edges = [(i, i + 1) for i in range(99)] + [(150, 199)]
    got = {r["node"]: r["root"] for r in graphs.components(nodes, frame(spark, edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(100)) and got[199] == 150 and got[120] == 120 and len(got) == 200


def test_matching_with_tilted_up(spark):
    rng = np.random.default_rng(4)
    a = np.column_stack([rng.uniform(0, 60, (6, 2)), rng.normal(0, 1, 6), rng.uniform(5, 30, 6), rng.uniform(2, 4, 6), rng.uniform(1, 2, 6), rng.uniform(0, np.pi, 6)])
    up_b = geometry.unit((0.3, -0.2, 0.9))
    turn = geometry.about((0, 0, 1), 0.7)
    flat = (a[:, :3] - [5, 6, 7]) @ turn  # in an upright frame
    b = a.copy()
    b[:, :3] = flat @ geometry.align(up_b, (0, 0, 1))
    m = landmarks.match(a, b, "4dof", 1.0, 3, (0, 0, 1), up_b)
    assert len(m.inliers) == 6 and m.rms < 1e-6
    assert np.abs(landmarks.vertical_residuals(a, b, m)).max() < 1e-6
    assert np.allclose(m.matrix[:3, :3] @ up_b, (0, 0, 1), atol=1e-9)
    wrong = landmarks.match(a, b, "6dof", 1.0, 3)
    assert len(wrong.inliers) == 6 and wrong.rms < 1e-6
    # the shapes' directions tell twins apart
    turned = a.copy()
    turned[:, 6] += np.pi / 2
    still = landmarks.match(a, a, "4dof").shape
    assert still < 1e-9 < landmarks.match(turned, a, "4dof").shape


def test_rim_gate(spark):
    rng = np.random.default_rng(5)
    p = np.column_stack([rng.uniform(-10, 10, (4000, 2)), rng.uniform(-5, 5, 4000)])
    df = frame(spark, [(i, *map(float, r)) for i, r in enumerate(p)], "pid long, x double, y double, z double")
    at = frame(spark, [(0, -4.0, 0.0, 0.0, 3.0, 1.0, 0.6, 0.8, 0.0), (1, 5.0, 1.0, 1.0, None, None, None, None, None)], "pid long, x double, y double, z double, semi_major double, semi_minor double, mx double, my double, mz double")
    got = {r["pid"] for r in landmarks.rim(df, at, 1.5, 2.0, 1.3).collect()}
    a, b = np.array([-4.0, 0, 0]), np.array([5.0, 1, 1])
    first = np.linalg.norm(p - a, axis=1) <= np.linalg.norm(p - b, axis=1)
    u, v = (p - a)[:, :2] @ [0.6, 0.8], (p - a)[:, :2] @ [-0.8, 0.6]
    one = first & ((u / 3.9) ** 2 + (v / 1.3) ** 2 <= 1) & (np.abs(p[:, 2]) <= 1.5)
    two = ~first & (np.hypot(*(p - b)[:, :2].T) <= 2) & (np.abs(p[:, 2] - 1) <= 1.5)
    assert got == set(np.flatnonzero(one | two).tolist()) and one.sum() > 5 and two.sum() > 5


def test_tube_half_end_to_end(spark, tmp_path, capsys):
    a, b, ha, hb, motion, out = (str(tmp_path / n) for n in ("a.pcd", "b.pcd", "ha.json", "hb.json", "m.json", "o.pcd"))
    clouds.write_pcd(scene(spark), a, (0, 0, 0))
    clouds.write_pcd(scene(spark, 7.0, 3.0), b, (0, 0, 0))
    assert cli.main(["holes", a, ha, "--min-area", "20"]) == 0
    assert cli.main(["holes", b, hb, "--mode", "ceiling", "--up", "0,0,1", "--min-area", "20", "--merge", "1"]) == 0
    assert json.load(open(hb))["mode"] == "ceiling" and len(json.load(open(hb))["holes"]) == 3
    assert cli.main(["register", ha, hb, motion, "--mode", "4dof"]) == 0
    found = json.load(open(motion))
    assert found["n_inliers"] == 3 and np.allclose(np.array(found["matrix"])[:3, 3], [-7, 0, 3], atol=0.2) and len(found["anchor_axes"]) == 3
    assert max(map(abs, found["vertical_residuals"])) < 0.2
    assert cli.main(["merge", a, b, motion, out, "--refine"]) == 0
    assert cli.main(["transform", b, motion, str(tmp_path / "t.pcd")]) == 0
    assert "points" in capsys.readouterr().out


def test_gaussian_mirrors_as_numpy_does(spark):
    rng = np.random.default_rng(6)
    v = rng.integers(0, 9, (5, 3)).astype(float)
    v[0, 0], v[4, 2], v[2, 1] = 3, 2, 0
    rows = [(i - 2, j + 7, v[i, j]) for i in range(5) for j in range(3) if v[i, j]]
    k = np.exp(-0.5 * (np.arange(-6, 7) / 1.5) ** 2)
    want = v
    for axis in (0, 1):
        padded = np.pad(want, [(6, 6) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        want = np.apply_along_axis(lambda x: np.convolve(x, k / k.sum(), "valid"), axis, padded)
    got = rasters.gaussian(frame(spark, rows, "ix long, iy long, n double"), 1.5, "n").toPandas()
    assert len(got) == 15 and all(abs(r.smooth - want[r.ix + 2, r.iy - 7]) < 1e-9 for r in got.itertuples())


def test_nearest_fill_of_any_reach(spark):
    rng = np.random.default_rng(7)
    for n in (2, 9, 40):
        at = np.unique(rng.integers(0, 23, (n, 2)), axis=0)
        v = rng.integers(0, 99, len(at)).astype(float)
        got = geometry.nearest_fill(frame(spark, [(x, y, z) for (x, y), z in zip(at.tolist(), v, strict=True)], "ix long, iy long, v double"), "v").toPandas()
        for r in got.itertuples():
            d = (at[:, 0] - r.ix) ** 2 + (at[:, 1] - r.iy) ** 2
            best = min(range(len(at)), key=lambda i: (d[i], at[i][0], at[i][1]))
            assert r.v == v[best]
        near = geometry.nearest_fill(frame(spark, [(x, y, z) for (x, y), z in zip(at.tolist(), v, strict=True)], "ix long, iy long, v double"), "v", 3).toPandas()
        for r in near.itertuples():
            assert np.isnan(r.v) == (((at[:, 0] - r.ix) ** 2 + (at[:, 1] - r.iy) ** 2).min() > 9)


def test_percentiles_of_crowded_groups(spark):
    rng = np.random.default_rng(8)
    rows = [("a", float(x)) for x in rng.normal(size=700)] + [("b", 5.0)] * 300 + [("c", float(x)) for x in rng.integers(0, 4, 50)] + [("d", None), ("e", 1.0)]
    shares = (0.0, 0.01, 0.5, 0.77, 1.0)
    got = stats.grouped_percentiles(frame(spark, rows, "k string, v double"), ["k"], "v", shares, bins=16).toPandas().set_index("k")
    for k in "abce":
        v = [x for g, x in rows if g == k]
        assert np.allclose(got.loc[k].to_numpy(float), np.percentile(v, [100 * q for q in shares]))
    assert "d" not in got.index


def test_radius_counts_against_brute_force(spark):
    rng = np.random.default_rng(9)
    p = rng.uniform(-4, 4, (400, 3)).round(1)
    df = frame(spark, [(i, *map(float, r)) for i, r in enumerate(p)], "pid long, x double, y double, z double")
    d2 = ((p[:, None] - p[None]) ** 2).sum(axis=2)
    for axes, use in (("xyz", d2), ("xy", ((p[:, None, :2] - p[None, :, :2]) ** 2).sum(axis=2))):
        got = spatial.radius_count(df, 1.05, axes).toPandas().set_index("pid").n.sort_index()
        assert got.tolist() == (use <= 1.05**2).sum(axis=1).tolist()
    near = spatial.knn(df, 3).toPandas().sort_values(["pid", "place"])
    np.fill_diagonal(d2, np.inf)
    want = [sorted(range(400), key=lambda j: (d2[i, j], j))[:3] for i in range(400)]
    assert near.groupby("pid").other.apply(list).tolist() == want


def test_grids_over_the_limit_are_refused(spark):
    with pytest.raises(ValueError):
        rasters.dense(frame(spark, [(0, 0, 1), (10**6, 10**6, 1)], "ix long, iy long, n long"), "n")


def test_range_joins_agree(spark, monkeypatch):
    rng = np.random.default_rng(10)
    rows = frame(spark, [(i, float(x)) for i, x in enumerate(rng.uniform(0, 100, 300))], "pid long, s double")
    parts = [(k, float(a), float(a + w)) for k, (a, w) in enumerate(zip(rng.uniform(0, 90, 30), rng.uniform(0, 12, 30), strict=True))]
    ranges = frame(spark, parts, "k long, lo double, hi double")
    want = sorted((r["pid"], k) for r in rows.collect() for k, a, b in parts if a <= r["s"] < b)
    for most in (relations.MOST_SENT, 3):
        monkeypatch.setattr(relations, "MOST_SENT", most)
        assert sorted((r["pid"], r["k"]) for r in relations.range_join(rows, ranges, "s", "lo", "hi").collect()) == want


def test_tables_round_trip(spark, tmp_path):
    df = frame(spark, [(1.0, 2.34567, "a"), (2.0, None, "b"), (3.0, -0.00004, None)], "s double, tau double, class string")
    tables.write_csv(df, str(tmp_path / "t"), {"s": 1, "tau": 3})
    back = tables.read_csv(spark, str(tmp_path / "t"), "s double, tau double, class string").orderBy("s").collect()
    assert [(r["s"], r["tau"], r["class"]) for r in back] == [(1.0, 2.346, "a"), (2.0, None, "b"), (3.0, -0.0, None)]
    made = []
    for _ in range(2):
        dem = tables.cached_dem(spark, str(tmp_path / "dem"), lambda: made.append(1) or frame(spark, [(0, 0, 1.5)], "ix long, iy long, z double"))
        assert dem.collect()[0]["z"] == 1.5
    assert made == [1]
    tables.write_summary(df.agg(F.max("tau").alias("most"), F.count("*").alias("n")), str(tmp_path / "sum"), {"most": 2})
    assert spark.read.json(str(tmp_path / "sum")).collect()[0].asDict() == {"most": 2.35, "n": 3}


def test_floor_seen_through_an_opening(spark):
    rng = np.random.default_rng(11)
    ring = [(i, x, y, 10.0) for i, (x, y) in enumerate(rng.uniform(-4, 4, (300, 2)))]
    below = [(1000 + i, x, y, 2.0) for i, (x, y) in enumerate(rng.uniform(-1, 1, (30, 2)))]
    floor = np.column_stack([rng.uniform(-4, 4, (2000, 2)), rng.uniform(1, 3, 2000)])
    got = surveys.floor_residuals(frame(spark, ring + below, "pid long, x double, y double, z double"), frame(spark, floor, "x double, y double, z double"), 0, 0).toPandas().set_index("pid")
    assert set(got.index) == set(range(1000, 1030))
    for pid, x, y, z in below:
        tz = floor[np.hypot(floor[:, 0] - x, floor[:, 1] - y) <= 0.5, 2]
        assert abs(got.dz[pid] - (z - np.median(tz[tz < np.percentile(tz, 30)]))) < 1e-9 and abs(got.r[pid] - np.hypot(x, y)) < 1e-9


def test_curves_helpers(spark):
    rows = frame(spark, [(0, i, float(np.sin(i / 3))) for i in range(60)], "k long, s long, v double")
    got = curves.effective_size(rows, "s", "v", 20, ["k"]).first()
    v = np.sin(np.arange(60) / 3)
    v = v - v.mean()
    rho = [float(v[: 60 - k] @ v[k:] / (v @ v)) for k in range(21)]
    neg = next(k for k, r in enumerate(rho) if r < 0)
    assert got["negative"] == neg and got["decay"] == next(k for k, r in enumerate(rho) if r < np.exp(-1))
    assert abs(got["n_eff"] - 60 / (1 + 2 * sum(rho[1:neg]))) < 1e-9
    named = frame(spark, [("skyLightArea",), ("z_dem-MAX2Min",)], "n string").select(surveys.words_of_name("n").alias("w"))
    assert [r["w"] for r in named.collect()] == ["sky light area", "z dem max2 min"]
    assert pd.notna(got["n"])


def test_motions_compose_and_invert():
    a, b = (geometry.motion(geometry.about(axis, t), shift) for axis, t, shift in (((1, 2, 3), 0.4, (1, 2, 3)), ((0, 1, 1), -1.1, (-4, 0, 2))))
    p = np.array([0.5, -2, 7, 1])
    assert np.allclose(geometry.compose(a, b) @ p, a @ (b @ p)) and np.allclose(geometry.compose(geometry.invert(a), a), np.eye(4))
    with pytest.raises(ValueError):
        geometry.invert(2 * np.eye(4))


def test_peaks_keep_their_distance(spark):
    v = [0, 0, 5, 0, 0, 8, 0, 9, 0, 0, 0, 0, 0, 7, 0, 0, 0.1, 0]
    got = curves.peaks(frame(spark, [(1, i, float(x)) for i, x in enumerate(v)], "k long, s long, v double"), "s", "v", 1.0, 4.0, ["k"]).orderBy("s").collect()
    assert [(r["s"], r["v"]) for r in got] == [(2.0, 2.5), (7.0, 4.5), (13.0, 3.5)]


def test_running_median_mirrored(spark):
    rng = np.random.default_rng(12)
    v = rng.uniform(size=11)
    got = curves.median_filter(frame(spark, [(0, i, float(x)) for i, x in enumerate(v)], "k long, s long, v double"), "s", "v", 2, ["k"], "reflect").orderBy("s").collect()
    padded = np.pad(v, 2, mode="symmetric")
    assert np.allclose([r["median"] for r in got], [np.median(padded[i : i + 5]) for i in range(11)])


def test_lattices_noise_and_reports(spark):
    df = frame(spark, [(0.5, 0.5, 1.0), (0.6, 0.4, 3.0), (-0.1, 0.5, 9.0), (5.0, 0.5, 9.0)], "x double, y double, z double")
    assert [tuple(r) for r in points.raster_max(df, 1.0, (0.0, 0.0), (3, 3)).collect()] == [(0, 0, 3.0)]
    box = frame(spark, [(0, 0), (29, 19)], "ix long, iy long")
    a, b = (rasters.noise(box, 2.0, 0.7, 3).orderBy("ix", "iy").toPandas().noise.to_numpy() for _ in range(2))
    assert len(a) == 600 and np.allclose(a, b) and abs(a.std() - 0.7) < 1e-9 and abs(a.mean()) < 1e-9
    grid = a.reshape(30, 20)
    assert np.corrcoef(grid[1:].ravel(), grid[:-1].ravel())[0, 1] > 0.7  # neighbours go together
    from karst.operators import reports
    from karst.sources import logs

    got = reports.collected(spark, {"roof": df.agg(F.max("z").alias("most")), "n": df.agg(F.count("*").alias("rows"))}).collect()
    assert [(r["key"], r["value"]) for r in got] == [("roof.most", 9.0), ("n.rows", 4.0)]
    with pytest.raises(ValueError):
        reports.collected(spark, {"x": df})
    table = logs.latex(frame(spark, [("50 %", "a_b"), (None, "c&d")], "share string, name string"))
    assert table.splitlines()[4:6] == [r"50 \% & a\_b \\", r" & c\&d \\"]
