import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from karst import cli
from karst.sources import clouds, las, pcd


@pytest.fixture
def uniform(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = np.column_stack([rng.uniform(-50, 50, (1234, 3)), rng.integers(0, 65536, 1234)])
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "x double, y double, z double, intensity double").repartition(3)
    path = str(tmp_path / "in.pcd")
    clouds.write_pcd(df, path, (479157.0, 7089825.0, 100.0))
    return path, rows


def ordered(df):
    a = np.array([tuple(r) for r in df.collect()], float)
    return a[np.lexsort(a.T)]


def test_pcd_round_trip(spark, uniform):
    path, rows = uniform
    df, head = clouds.read_pcd(spark, path)
    assert head.origin == (479157.0, 7089825.0, 100.0) and head.count == 1234
    assert np.allclose(ordered(df), rows[np.lexsort(rows.T)], atol=1e-2)
    parts = spark.read.format("pcd").option("path", path).option("chunk", "100").load()
    assert parts.count() == 1234 and parts.rdd.getNumPartitions() == 13


def test_pcd_colours_and_truncation(spark, tmp_path):
    path = str(tmp_path / "c.pcd")
    clouds.write_pcd(spark.createDataFrame([(1.0, 2.0, 3.0, 255, 128, 1)] * 4, "x double, y double, z double, r int, g int, b int"), path, (0, 0, 0))
    assert pcd.read_header(path).fields == ["x", "y", "z", "rgb"]
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-10])
    rows = clouds.read_pcd(spark, path)[0].collect()
    assert len(rows) == 3 and tuple(rows[0]) == (1, 2, 3, 255, 128, 1)


def test_las_round_trip(spark, uniform, tmp_path):
    path, rows = uniform
    out = str(tmp_path / "o.las")
    assert int(clouds.export(spark, path, out)) == 1234
    head = las.read_header(out)
    assert head.version == (1, 4) and head.shift == (479157.0, 7089825.0, 100.0)
    back = str(tmp_path / "b.pcd")
    r = clouds.convert(spark, out, back)
    assert r.origin == (479157.0, 7089825.0, 100.0)
    assert np.allclose(ordered(clouds.read_pcd(spark, back)[0]), rows[np.lexsort(rows.T)], atol=1e-2)
    assert json.load(open(back + ".origin.json"))["origin_xyz"] == list(r.origin)


def test_old_las_with_sentinels(spark, tmp_path):
    n = 105
    xyz = np.full((n, 3), 1000, "<i4")
    xyz[100:] = 2147483000
    head = bytearray(227)
    head[:4], head[24], head[25] = b"LASF", 1, 2
    struct.pack_into("<HII", head, 94, 227, 227, 0)
    struct.pack_into("<BHI", head, 104, 0, 20, n)
    struct.pack_into("<12d", head, 131, 0.001, 0.001, 0.001, 0, 0, 0, 1, 1, 1, 1, 1, 1)
    raw = np.zeros((n, 20), np.uint8)
    raw[:, :12] = xyz.view(np.uint8).reshape(n, 12)
    path = tmp_path / "s.las"
    path.write_bytes(bytes(head) + raw.tobytes())
    assert int(clouds.convert(spark, str(path), str(tmp_path / "s.pcd"))) == 100
    with pytest.raises(Exception, match="no colours"):
        spark.read.format("las").option("path", str(path)).option("fields", "rgb").load().count()


def test_files_through_the_command_line(spark, uniform, tmp_path, capsys):
    path, rows = uniform
    out = str(tmp_path / "x.pcd")
    assert cli.main(["crop", path, out, "0,0,50,50"]) == 0
    want = ((rows[:, 0] >= 0) & (rows[:, 1] >= 0)).sum()
    assert abs(pcd.read_header(out).count - want) <= 1
    assert cli.main(["downsample", path, str(tmp_path / "d.pcd"), "-v", "10"]) == 0
    assert cli.main(["filter", path, str(tmp_path / "f.pcd"), "--radius", "10"]) == 0
    assert cli.main(["crop", path, path, "0,0,1,1"]) == 1
    assert cli.main(["crop", "absent.pcd", out, "0,0,1,1"]) == 1
    assert "absent.pcd" in capsys.readouterr().err


def test_scene_end_to_end(spark, tmp_path):
    holes = [(25, 30), (62, 35), (40, 72), (78, 76)]
    rows = [(x + 0.5, y + 0.5, 0.0) for x in range(100) for y in range(100) if all(np.hypot(x + 0.5 - a, y + 0.5 - b) > 4 for a, b in holes)]
    ground = spark.createDataFrame(rows, "x double, y double, z double")
    c, s = np.cos(0.3), np.sin(0.3)
    tube = ground.select((F.col("x") * c + F.col("y") * s).alias("x"), (F.col("y") * c - F.col("x") * s).alias("y"), (F.col("z") - 2).alias("z"))
    a, b, motion, out = (str(tmp_path / n) for n in ("a.pcd", "b.pcd", "m.json", "o.pcd"))
    clouds.write_pcd(ground, a, (0, 0, 0))
    clouds.write_pcd(tube, b, (0, 0, 0))
    ha, hb = clouds.detect(spark, a, str(tmp_path / "ha.json"), min_area=20), clouds.detect(spark, b, str(tmp_path / "hb.json"), min_area=20)
    assert len(ha["holes"]) == 4 and len(hb["holes"]) >= 4
    found = clouds.register(ha, hb, motion, "4dof")
    assert found["n_inliers"] >= 3 and abs(found["matrix"][0][0] - c) < 0.05 and abs(found["matrix"][2][3] - 2) < 0.5
    assert int(clouds.merge(spark, a, b, out, found)) == 2 * len(rows)
    assert pcd.read_header(out).columns[-1] == "source"
