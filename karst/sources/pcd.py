"""Binary PCD files as a Spark data source: format("pcd").

Reading: a partition for each byte range of whole rows, Arrow batches, schema from
the header (packed rgb becomes r, g, b).  Writing: each task leaves a part file of
raw rows; the commit joins them in partition order behind a header whose count is
then known.  Paths are local or on a mount that driver and executors share.

Options: path (when reading also several with commas between, a pattern or a folder:
all with the first one's fields, moved to its origin); origin "x,y,z" (written as a
comment); chunk, rows in a partition; box "x0,y0,z0,x1,y1,z1" (rows outside are
dropped in the scan); where "z > 2 and r <= 100" (the same for comparisons).
Only float32 fields and `DATA binary` are taken; a truncated file ends where whole
rows end; coordinates are local to the origin the header tells.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import FloatType, StructField, StructType

from karst.sources.files import keep, listed, parse_box, parse_where

ORIGIN = "# ORIGIN"
ROWS = 1_000_000


@dataclass
class Header:
    fields: list[str]
    count: int
    origin: tuple[float, float, float]
    size: int

    @property
    def columns(self) -> list[str]:
        """Columns a reader sees: packed rgb as three."""
        return [c for f in self.fields for c in (("r", "g", "b") if f == "rgb" else (f,))]


def read_header(path: str) -> Header:
    found: dict[str, list[str]] = {}
    origin = (0.0, 0.0, 0.0)
    with open(path, "rb") as f:
        while True:
            line = f.readline()
            if not line:
                raise ValueError(f"{path}: no DATA line")
            words = line.decode("ascii", "replace").split()
            if words[:1] == ["#"] and len(words) > 1 and words[1].endswith("ORIGIN"):
                try:
                    x, y, z = map(float, " ".join(words[2:]).replace(",", " ").split())
                    origin = (x, y, z)
                except ValueError:
                    pass
            elif words and not words[0].startswith("#"):
                found[words[0].upper()] = words[1:]
                if words[0].upper() == "DATA":
                    break
        size = f.tell()
    fields = found.get("FIELDS", [])
    n = len(fields)
    if found["DATA"] != ["binary"]:
        raise ValueError(f"{path}: only DATA binary can be read")
    if not n or found.get("SIZE") != ["4"] * n or found.get("TYPE") != ["F"] * n or found.get("COUNT", ["1"] * n) != ["1"] * n:
        raise ValueError(f"{path}: only single float32 fields can be read")
    count = int((found.get("POINTS") or found.get("WIDTH") or ["0"])[0])
    return Header(fields, count, origin, size)


def header_text(fields: list[str], count: int, origin: tuple[float, float, float]) -> bytes:
    n = len(fields)
    lines = ["# .PCD v0.7 - Point Cloud Data file format", f"{ORIGIN} {origin[0]!r} {origin[1]!r} {origin[2]!r}", "VERSION 0.7", f"FIELDS {' '.join(fields)}", f"SIZE {' '.join(['4'] * n)}", f"TYPE {' '.join('F' * n)}", f"COUNT {' '.join('1' * n)}", f"WIDTH {count}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {count}", "DATA binary"]
    return ("\n".join(lines) + "\n").encode()


def unpack(rows: np.ndarray, fields: list[str]) -> list[pa.Array]:
    out = []
    for k, f in enumerate(fields):
        if f == "rgb":
            bits = rows[:, k].copy().view(np.uint32)
            out += [pa.array(((bits >> s) & 255).astype(np.float32)) for s in (16, 8, 0)]
        else:
            out.append(pa.array(rows[:, k].copy()))
    return out


def pack(batch: pa.RecordBatch, fields: list[str]) -> np.ndarray:
    get = lambda c: batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
    out = np.zeros((batch.num_rows, len(fields)), np.float32)
    for k, f in enumerate(fields):
        if f == "rgb":
            r, g, b = (np.clip(get(c), 0, 255).astype(np.uint32) for c in "rgb")
            out[:, k] = ((r << 16) | (g << 8) | b).view(np.float32)
        else:
            out[:, k] = get(f)
    return out


@dataclass
class Range(InputPartition):
    path: str
    first: int
    rows: int


class PcdReader(DataSourceReader):
    def __init__(self, path: str, chunk: int, box: str | None = None, where: str | None = None):
        self.paths, self.chunk, self.box = listed(path, ".pcd"), chunk, parse_box(box)
        self.headers = {p: read_header(p) for p in self.paths}
        self.header = self.headers[self.paths[0]]
        for p, h in self.headers.items():
            if h.fields != self.header.fields:
                raise ValueError(f"{p}: other fields than {self.paths[0]}")
        self.filters = parse_where(where, self.header.columns)

    def partitions(self) -> list[Range]:
        out = []
        for p, h in self.headers.items():
            n = min(h.count, (os.path.getsize(p) - h.size) // (4 * len(h.fields)))
            out += [Range(p, i, min(self.chunk, n - i)) for i in range(0, n, self.chunk)]
        return out or [Range(self.paths[0], 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        h = self.headers[partition.path]
        k, shift = len(h.fields), np.array(h.origin) - np.array(self.header.origin)
        with open(partition.path, "rb") as f:
            f.seek(h.size + 4 * k * partition.first)
            left = partition.rows
            while left:
                rows = np.frombuffer(f.read(4 * k * min(left, 65536)), "<f4").reshape(-1, k)
                if not len(rows):
                    return
                left -= len(rows)
                if shift.any():
                    rows = rows.copy()
                    for i, c in enumerate("xyz"):
                        rows[:, h.fields.index(c)] = rows[:, h.fields.index(c)].astype(np.float64) + shift[i]
                yield keep(pa.RecordBatch.from_arrays(unpack(rows, h.fields), h.columns), self.box, self.filters)


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str
    rows: int


class PcdWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, origin: tuple[float, float, float]):
        names = schema.fieldNames()
        if not {"x", "y", "z"} <= {*names}:
            raise ValueError("a point cloud has x, y and z")
        colour = {"r", "g", "b"} <= {*names}
        rest = [c for c in names if c not in ("x", "y", "z", "pid") and not (colour and c in "rgb")]
        self.path, self.origin, self.fields = path, origin, ["x", "y", "z", *(["rgb"] if colour else []), *rest]
        self.token = uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        task = TaskContext.get()
        number, attempt = task.partitionId(), task.taskAttemptId()
        part, rows = f"{self.path}.{self.token}.{number}.{attempt}", 0
        with open(part, "wb") as f:
            for batch in batches:
                f.write(pack(batch, self.fields).tobytes())
                rows += batch.num_rows
        return Part(number, part, rows)

    def commit(self, messages: list[Part]) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        with open(f"{self.path}.{self.token}", "wb") as out:
            out.write(header_text(self.fields, sum(p.rows for p in parts), self.origin))
            for p in parts:
                with open(p.path, "rb") as f:
                    while block := f.read(1 << 22):
                        out.write(block)
        os.replace(f"{self.path}.{self.token}", self.path)
        self._sweep()

    def abort(self, messages: list[Part]) -> None:
        self._sweep()

    def _sweep(self) -> None:
        """Also what tasks left that ran twice."""
        folder, name = os.path.split(os.path.abspath(self.path))
        for f in os.listdir(folder):
            if f.startswith(f"{name}.{self.token}"):
                os.remove(os.path.join(folder, f))


def parse_origin(text: str | None) -> tuple[float, float, float]:
    if not text:
        return (0.0, 0.0, 0.0)
    x, y, z = map(float, text.split(","))
    return (x, y, z)


class PcdSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcd"

    def schema(self) -> StructType:
        return StructType([StructField(c, FloatType()) for c in read_header(listed(self.options["path"], ".pcd")[0]).columns])

    def reader(self, schema: StructType) -> PcdReader:
        return PcdReader(self.options["path"], int(self.options.get("chunk", ROWS)), self.options.get("box"), self.options.get("where"))

    def writer(self, schema: StructType, overwrite: bool) -> PcdWriter:
        return PcdWriter(self.options["path"], schema, parse_origin(self.options.get("origin")))
