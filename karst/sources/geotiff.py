"""Rasters in GeoTIFF files as a Spark data source: format("geotiff").

Reading: a partition is a strip or tile of a file (plain or deflate, with or without a
predictor, one sample a cell, either byte order), a row is a cell.  Strips and tiles
outside the asked window or box make no partition.  The file's nodata value, what is
not finite and what is beyond `most` in size become null.  Writing: each task writes a
file for each square of cells it holds, so that a folder is a mosaic; a square in
several tasks gives several files, so rows should be dealt by squares.  Paths must be
the same for all tasks, such as a mount.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from karst.sources.files import listed

#: A cell: its place in its file, the middle of it on the map, and its value.
SCHEMA = "file string, row long, col long, x double, y double, v double"
#: Cells of a written square's side, and the value that stands for none in it.
SIDE, NODATA = 256, -9999.0
#: Fixed values of the file format: sizes of field types, and the tags that are read.
_SIZES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 12: ("d", 8), 16: ("Q", 8)}
_WIDTH, _HEIGHT, _BITS, _PACKED, _SAMPLES, _ROWS, _KIND, _PREDICTOR = 256, 257, 258, 259, 277, 278, 339, 317
_STRIPS, _STRIP_BYTES, _TILE_WIDTH, _TILE_HEIGHT, _TILES, _TILE_BYTES = 273, 279, 322, 323, 324, 325
_SCALE, _TIE, _NODATA = 33550, 33922, 42113
_DEFLATE = (8, 32946)


@dataclass
class Header:
    """What a file tells of its first raster; blocks: row, col, place and bytes of each strip or tile of block_rows x block_cols."""

    order: str
    rows: int
    cols: int
    kind: str
    packed: bool
    predictor: int
    block_rows: int
    block_cols: int
    blocks: list[tuple[int, int, int, int]]
    scale: tuple[float, float]
    corner: tuple[float, float]
    nodata: float | None

    def x(self, col):
        return self.corner[0] + (col + 0.5) * self.scale[0]

    def y(self, row):
        return self.corner[1] - (row + 0.5) * self.scale[1]


def read_header(path: str) -> Header:
    with open(path, "rb") as f:
        start = f.read(8)
        order = {b"II": "<", b"MM": ">"}.get(start[:2])
        if order is None or struct.unpack(f"{order}H", start[2:4])[0] != 42:
            raise ValueError(f"{path} is no TIFF file")
        f.seek(struct.unpack(f"{order}I", start[4:])[0])
        tags = {}
        raw = f.read(12 * struct.unpack(f"{order}H", f.read(2))[0])
        for at in range(0, len(raw), 12):
            tag, kind, n = struct.unpack(f"{order}HHI", raw[at : at + 8])
            if kind not in _SIZES:
                continue
            code, size = _SIZES[kind]
            value = raw[at + 8 : at + 8 + n * size]
            if n * size > 4:
                f.seek(struct.unpack(f"{order}I", raw[at + 8 : at + 12])[0])
                value = f.read(n * size)
            tags[tag] = value if code == "s" else struct.unpack(f"{order}{n}{code}", value)
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    packed, predictor, kind = one(_PACKED, 1), one(_PREDICTOR, 1), {1: "u", 2: "i", 3: "f"}.get(one(_KIND, 1))
    bits = one(_BITS, 1)
    if packed not in (1, *_DEFLATE) or one(_SAMPLES, 1) != 1 or kind is None or bits not in (8, 16, 32, 64) or predictor not in (1, 2, 3) or (kind == "f" and bits < 32):
        raise ValueError(f"{path}: only plain or deflate rasters of one sample of whole bytes are read")
    rows, cols = one(_HEIGHT), one(_WIDTH)
    tiled = _TILES in tags
    high, wide = (one(_TILE_HEIGHT), one(_TILE_WIDTH)) if tiled else (min(one(_ROWS, rows), rows), cols)
    across = -(-cols // wide)
    places = zip(tags[_TILES if tiled else _STRIPS], tags[_TILE_BYTES if tiled else _STRIP_BYTES], strict=True)
    blocks = [(k // across * high, k % across * wide, at, size) for k, (at, size) in enumerate(places)]
    scale, tie = tags.get(_SCALE, (1.0, 1.0, 0.0)), tags.get(_TIE, (0.0,) * 6)
    corner = (tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1])
    text = tags.get(_NODATA, b"").split(b"\0")[0].strip()
    return Header(order, rows, cols, f"{kind}{bits // 8}", packed != 1, predictor, high, wide, blocks, (scale[0], scale[1]), corner, float(text) if text else None)


@dataclass
class Block(InputPartition):
    path: str
    row: int
    col: int
    place: int
    size: int


def _values(raw: bytes, h: Header, rows: int) -> np.ndarray:
    """A block's cells, rows of block_cols."""
    if h.packed:
        raw = zlib.decompress(raw)
    size = int(h.kind[1])
    n = h.block_cols
    if h.predictor == 3:  # bytes of a row, greatest first, each told by its step from the one before
        steps = np.frombuffer(raw, np.uint8)[: rows * n * size].reshape(rows, n * size)
        planes = np.cumsum(steps, axis=1, dtype=np.uint8).reshape(rows, size, n)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">{h.kind}")[:, :, 0]
    cells = np.frombuffer(raw, f"{h.order}{h.kind}")[: rows * n].reshape(rows, n)
    if h.predictor == 2:
        whole = cells.view(f"{h.order}u{size}").astype(f"u{size}")
        return np.cumsum(whole, axis=1, dtype=whole.dtype).view(h.kind)
    return cells


class RasterReader(DataSourceReader):
    def __init__(self, path: str, window: str | None, box: str | None, most: float):
        self.paths, self.most = listed(path, ".tif"), most
        four = lambda text: None if text is None else tuple(map(float, text.split(",")))
        self.window, self.box = four(window), four(box)
        if any(w is not None and len(w) != 4 for w in (self.window, self.box)):
            raise ValueError("a window is row0,col0,row1,col1 and a box x0,y0,x1,y1")
        self.headers = {p: read_header(p) for p in self.paths}

    def _reach(self, h: Header) -> tuple[int, int, int, int]:
        """First and end row, first and end column that are asked for."""
        r0, c0, r1, c1 = self.window or (0, 0, h.rows, h.cols)
        if self.box:  # cells whose middle lies in it
            x0, y0, x1, y1 = self.box
            c0, c1 = max(c0, np.ceil((x0 - h.corner[0]) / h.scale[0] - 0.5)), min(c1, np.floor((x1 - h.corner[0]) / h.scale[0] - 0.5) + 1)
            r0, r1 = max(r0, np.ceil((h.corner[1] - y1) / h.scale[1] - 0.5)), min(r1, np.floor((h.corner[1] - y0) / h.scale[1] - 0.5) + 1)
        return max(int(r0), 0), min(int(r1), h.rows), max(int(c0), 0), min(int(c1), h.cols)

    def partitions(self) -> list[Block]:
        out = []
        for p, h in self.headers.items():
            r0, r1, c0, c1 = self._reach(h)
            out += [Block(p, r, c, at, size) for r, c, at, size in h.blocks if size and r < r1 and r + h.block_rows > r0 and c < c1 and c + h.block_cols > c0]
        return out or [Block(self.paths[0], 0, 0, 0, 0)]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        if not partition.size:
            return
        h = self.headers[partition.path]
        r0, r1, c0, c1 = self._reach(h)
        with open(partition.path, "rb") as f:
            f.seek(partition.place)
            raw = f.read(partition.size)
        striped = h.block_cols == h.cols
        cells = _values(raw, h, min(h.block_rows, h.rows - partition.row) if striped else h.block_rows)
        rows = np.arange(max(r0, partition.row), min(r1, partition.row + h.block_rows))
        cols = np.arange(max(c0, partition.col), min(c1, partition.col + h.block_cols))
        for some in np.array_split(rows, max(1, len(rows) * len(cols) // 100_000)):
            v = cells[some[0] - partition.row : some[-1] - partition.row + 1, cols[0] - partition.col : cols[-1] - partition.col + 1].astype(np.float64).ravel() if len(some) else np.zeros(0)
            gone = ~np.isfinite(v) | (np.abs(v) > self.most)
            if h.nodata is not None:
                gone |= v == h.nodata
            i, j = np.repeat(some, len(cols)), np.tile(cols, len(some))
            columns = [pa.array([os.path.basename(partition.path)] * len(v), pa.string()), pa.array(i), pa.array(j), pa.array(h.x(j)), pa.array(h.y(i)), pa.array(v, mask=gone)]
            yield pa.RecordBatch.from_arrays(columns, ["file", "row", "col", "x", "y", "v"])


def write_tiff(path: str, cells: np.ndarray, corner: tuple[float, float], scale: float, packed: bool = True) -> None:
    """Cells (NaN: none) as one strip of 32-bit numbers, a file of its own."""
    body = np.where(np.isnan(cells), NODATA, cells).astype("<f4").tobytes()
    body = zlib.compress(body, 6) if packed else body
    none = f"{NODATA:g}\0".encode()
    long = [struct.pack("<3d", scale, scale, 0.0), struct.pack("<6d", 0, 0, 0, *corner, 0), none]
    tags = [(_WIDTH, 4, cells.shape[1]), (_HEIGHT, 4, cells.shape[0]), (_BITS, 3, 32), (_PACKED, 3, _DEFLATE[0] if packed else 1), (262, 3, 1), (_STRIPS, 4, 0), (_SAMPLES, 3, 1), (_ROWS, 4, cells.shape[0]), (_STRIP_BYTES, 4, len(body)), (_KIND, 3, 3)]
    end = 8 + 2 + 12 * (len(tags) + 3) + 4
    at = [end, end + len(long[0]), end + len(long[0]) + len(long[1])]
    first = at[2] + len(none)
    entries = [struct.pack("<HHII", t, k, 1, first if t == _STRIPS else v) for t, k, v in tags]
    entries += [struct.pack("<HHII", _SCALE, 12, 3, at[0]), struct.pack("<HHII", _TIE, 12, 6, at[1]), struct.pack("<HHII", _NODATA, 2, len(none), at[2])]
    with open(path, "wb") as f:
        f.write(b"II*\0" + struct.pack("<IH", 8, len(entries)) + b"".join(entries) + struct.pack("<I", 0) + b"".join(long) + body)


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class RasterWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, scale: float, side: int):
        if missing := {"x", "y", "v"} - {*schema.fieldNames()}:
            raise ValueError(f"a raster needs {', '.join(sorted(missing))}")
        self.path, self.scale, self.side, self.token = path, scale, side, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task, squares = TaskContext.get(), {}
        os.makedirs(self.path, exist_ok=True)
        for batch in batches:
            x, y, v = (batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("x", "y", "v"))
            col, row = np.floor(x / self.scale).astype(np.int64), np.floor(-y / self.scale).astype(np.int64)
            for square in {*zip((row // self.side).tolist(), (col // self.side).tolist(), strict=True)}:
                own = (row // self.side == square[0]) & (col // self.side == square[1])
                cells = squares.setdefault(square, np.full((self.side, self.side), np.nan, np.float32))
                cells[row[own] % self.side, col[own] % self.side] = v[own]
        paths = []
        for (i, j), cells in squares.items():
            paths.append(os.path.join(self.path, f"r{i}c{j}-{task.partitionId()}.{self.token}.{task.taskAttemptId()}.tmp"))
            write_tiff(paths[-1], cells, (j * self.side * self.scale, -i * self.side * self.scale), self.scale)
        return Written(paths)

    def commit(self, messages: list[Written]) -> None:
        for p in (p for m in messages if m is not None for p in m.paths):
            folder, name = os.path.split(p)
            os.replace(p, os.path.join(folder, f"{name.split('.')[0]}-{self.token[:8]}.tif"))
        self._sweep()

    def abort(self, messages: list[Written]) -> None:
        self._sweep()

    def _sweep(self) -> None:
        for f in os.listdir(self.path) if os.path.isdir(self.path) else ():
            if f".{self.token}." in f and f.endswith(".tmp"):
                os.remove(os.path.join(self.path, f))


class RasterSource(DataSource):
    """spark.read.format("geotiff").option("path", files or folders).

    Options: window "row0,col0,row1,col1" (ends not included), box "x0,y0,x1,y1" on the
    map, most (greatest size of a value, 10000); for writing scale and side.
    """

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RasterReader:
        return RasterReader(self.options["path"], self.options.get("window"), self.options.get("box"), float(self.options.get("most", 1e4)))

    def writer(self, schema: StructType, overwrite: bool) -> RasterWriter:
        return RasterWriter(self.options["path"], schema, float(self.options.get("scale", 1.0)), int(self.options.get("side", SIDE)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RasterSource)
