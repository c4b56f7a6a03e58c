"""Rasters of several layouts, read whole, by windows and by boxes."""

import struct
import zlib

import numpy as np
import pytest

from karst.sources import geotiff


def tiff(path, cells, order="<", packed=False, predictor=1, rows=None, tile=None, nodata="-1"):
    """A file of strips of so many rows, or of tiles."""
    kind, size = cells.dtype.kind, cells.dtype.itemsize
    high, wide = tile or (rows or len(cells), cells.shape[1])
    bodies = []
    for r in range(0, cells.shape[0], high):
        for c in range(0, cells.shape[1], wide):
            block = cells[r : r + high, c : c + wide]
            if tile:
                block = np.pad(block, ((0, high - block.shape[0]), (0, wide - block.shape[1])))
            if predictor == 2:
                block = np.diff(block.view(f"u{size}"), axis=1, prepend=np.zeros((len(block), 1), f"u{size}"))
            raw = block.astype(block.dtype.newbyteorder(order)).tobytes()
            if predictor == 3:
                planes = np.ascontiguousarray(block.astype(f">f{size}")).view(np.uint8).reshape(*block.shape, size).transpose(0, 2, 1).reshape(len(block), -1)
                raw = np.diff(planes, axis=1, prepend=np.zeros((len(block), 1), np.uint8)).tobytes()
            bodies.append(zlib.compress(raw) if packed else raw)
    n, body_at = len(bodies), 8
    places = [body_at + sum(map(len, bodies[:k])) for k in range(n)]
    extra_at = body_at + sum(map(len, bodies))
    text = nodata.encode() + b"\0"
    long = {273 if not tile else 324: (4, n, struct.pack(f"{order}{n}I", *places)), 279 if not tile else 325: (4, n, struct.pack(f"{order}{n}I", *map(len, bodies)))}
    long |= {33550: (12, 3, struct.pack(f"{order}3d", 2, 2, 0)), 33922: (12, 6, struct.pack(f"{order}6d", 0, 0, 0, 100, 50, 0)), 42113: (2, len(text), text)}
    short = {256: cells.shape[1], 257: cells.shape[0], 258: 8 * size, 259: 8 if packed else 1, 277: 1, 317: predictor, 339: {"u": 1, "i": 2, "f": 3}[kind]}
    short |= {322: wide, 323: high} if tile else {278: high}
    entries, extra = [], b""
    for tag in sorted({*long, *short}):
        if tag in short:
            entries.append(struct.pack(f"{order}HHII", tag, 4, 1, short[tag]))
        else:
            kind_, count, raw = long[tag]
            if len(raw) <= 4:
                entries.append(struct.pack(f"{order}HHI", tag, kind_, count) + raw.ljust(4, b"\0"))
            else:
                entries.append(struct.pack(f"{order}HHII", tag, kind_, count, extra_at + len(extra)))
                extra += raw
    ifd = extra_at + len(extra)
    head = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, ifd)
    path.write_bytes(head + b"".join(bodies) + extra + struct.pack(f"{order}H", len(entries)) + b"".join(entries) + bytes(4))


LAYOUTS = {
    "strips": (np.float32, {"rows": 5}),
    "deflate": (np.int16, {"rows": 7, "packed": True, "predictor": 2}),
    "tiles": (np.float64, {"tile": (8, 16), "packed": True, "predictor": 3}),
    "swapped": (np.uint16, {"order": ">", "tile": (16, 16)}),
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_cells_of_a_layout(spark, tmp_path, layout):
    geotiff.register(spark)
    kind, how = LAYOUTS[layout]
    cells = np.random.default_rng(3).integers(0, 300, (23, 37)).astype(kind)
    cells[2, 3] = 20_000
    tiff(tmp_path / "a.tif", cells, nodata="7", **how)
    load = lambda **o: spark.read.format("geotiff").options(path=str(tmp_path), **o).load()
    got = load().toPandas()
    v = np.where((cells == 7) | (cells == 20_000), np.nan, cells.astype(float))
    assert len(got) == cells.size
    assert np.array_equal(got.sort_values(["row", "col"]).v.to_numpy().reshape(cells.shape), v, equal_nan=True)
    assert np.allclose(got.x, 101 + 2 * got.col) and np.allclose(got.y, 49 - 2 * got.row)
    part = load(window="4,10,9,30").toPandas().sort_values(["row", "col"])
    assert np.array_equal(part.v.to_numpy().reshape(5, 20), v[4:9, 10:30], equal_nan=True)
    box = load(box="110,20,131.5,31", most="1e9").toPandas()
    assert sorted(zip(box.row, box.col, strict=True)) == [(r, c) for r in range(9, 15) for c in range(5, 16)]
    assert load(box="0,0,1,1").count() == 0


def test_what_is_not_opened_and_not_read(tmp_path):
    tiff(tmp_path / "a.tif", np.zeros((40, 10), np.float32), rows=5)
    assert len(geotiff.RasterReader(str(tmp_path), None, None, 1e4).partitions()) == 8
    (one,) = geotiff.RasterReader(str(tmp_path), "11,0,14,3", None, 1e4).partitions()
    assert one.row == 10
    (tmp_path / "b.tif").write_bytes(b"not one of them")
    with pytest.raises(ValueError, match="no TIFF"):
        geotiff.read_header(str(tmp_path / "b.tif"))


def test_a_mosaic_is_written_by_squares(spark, tmp_path):
    geotiff.register(spark)
    rows = [(x + 0.25, y + 0.25, float(x * y)) for x in range(-6, 20) for y in range(-9, 9) if (x + y) % 3]
    df = spark.createDataFrame(rows, "x double, y double, v double")
    df = df.selectExpr("*", "floor(x / 4) a", "floor(-y / 4) b").repartition("a", "b").drop("a", "b")
    path = str(tmp_path / "m")
    df.selectExpr("x / 2 x", "y / 2 y", "v").write.format("geotiff").options(path=path, scale=0.5, side=4).mode("append").save()
    got = spark.read.format("geotiff").option("path", path).load().where("v is not null").collect()
    assert sorted((2 * r["x"] - 0.25, 2 * r["y"] - 0.25, r["v"]) for r in got) == sorted(rows)
