"""Recorded message logs ("bags"): a folder of SQLite files with the tables topics and messages.

Reading: a partition is a range of message numbers of one file; topics and times that
a query asks for are looked up in the file, so other payloads are not read, and a
file without the topics makes no partition.  Writing: each task writes a file of its
own, so nothing goes through the driver; files of tasks that failed are taken away.
Paths must be the same for all tasks, such as a mount.  A message without topic or
payload is written with an empty one.
"""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from karst.sources.files import listed

#: Columns of a bag; ts in nanoseconds, id: the message's number in its file.
SCHEMA = "file string, id long, topic string, type string, ts long, data binary"
#: Message numbers in a partition, and messages in a batch.
ROWS, BATCH = 100_000, 2_000
#: Tables of the file format.
_TABLES = (
    "CREATE TABLE topics (id INTEGER PRIMARY KEY, name TEXT NOT NULL, type TEXT NOT NULL, serialization_format TEXT NOT NULL, offered_qos_profiles TEXT NOT NULL)",
    "CREATE TABLE messages (id INTEGER PRIMARY KEY, topic_id INTEGER NOT NULL, timestamp INTEGER NOT NULL, data BLOB NOT NULL)",
    "CREATE INDEX timestamp_idx ON messages (timestamp ASC)",
)


@dataclass
class Range(InputPartition):
    path: str
    first: int
    last: int


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int


def _opened(path: str) -> sqlite3.Connection:
    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    return sqlite3.connect(f"file:{os.path.abspath(path)}?mode=ro", uri=True)


class BagReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, rows: int, topics: str | None = None, first: str | None = None, last: str | None = None):
        self.paths, self.names, self.rows = listed(path, ".db3"), schema.fieldNames(), rows
        self.topics = None if topics is None else {t.strip() for t in topics.split(",")}
        self.times = [(sign, int(v)) for sign, v in ((">=", first), ("<=", last)) if v is not None]

    def _topics(self, bag: sqlite3.Connection) -> dict[int, tuple[str, str]]:
        every = {i: (name, kind) for i, name, kind in bag.execute("SELECT id, name, type FROM topics")}
        return every if self.topics is None else {i: t for i, t in every.items() if t[0] in self.topics}

    def partitions(self) -> list[Range]:
        out = []
        for path in self.paths:
            with closing(_opened(path)) as bag:
                low, high = bag.execute("SELECT min(id), max(id) FROM messages").fetchone()
                if low is not None and self._topics(bag):
                    out += [Range(path, i, min(i + self.rows - 1, high)) for i in range(low, high + 1, self.rows)]
        return out or [Range(self.paths[0], 0, -1)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with closing(_opened(partition.path)) as bag:
            topics = self._topics(bag)
            if not topics or partition.last < partition.first:
                return
            text = "SELECT id, topic_id, timestamp, data FROM messages WHERE id BETWEEN ? AND ?"
            if self.topics is not None:
                text += f" AND topic_id IN ({', '.join(map(str, topics))})"
            text += "".join(f" AND timestamp {sign} ?" for sign, _ in self.times)
            rows = bag.execute(f"{text} ORDER BY id", [partition.first, partition.last, *(v for _, v in self.times)])
            while some := rows.fetchmany(BATCH):
                number, topic, ts, data = zip(*some, strict=True)
                columns = {
                    "file": pa.array([os.path.basename(partition.path)] * len(some)),
                    "id": pa.array(number, pa.int64()),
                    "topic": pa.array([topics[t][0] for t in topic]),
                    "type": pa.array([topics[t][1] for t in topic]),
                    "ts": pa.array(ts, pa.int64()),
                    "data": pa.array(data, pa.binary()),
                }
                yield pa.RecordBatch.from_arrays([columns[c] for c in self.names], list(self.names))


class BagWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        missing = {"topic", "ts", "data"} - {*schema.fieldNames()}
        if missing:
            raise ValueError(f"a bag needs {', '.join(sorted(missing))}")
        self.path, self.kinds, self.overwrite, self.token = path, "type" in schema.fieldNames(), overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        os.makedirs(self.path, exist_ok=True)
        part, topics, n = os.path.join(self.path, f"part-{task.partitionId():05}.{self.token}.{task.taskAttemptId()}.tmp"), {}, 0
        with closing(sqlite3.connect(part)) as bag:
            for text in _TABLES:
                bag.execute(text)
            for batch in batches:
                names, ts, data = (batch.column(c).to_pylist() for c in ("topic", "ts", "data"))
                kinds = batch.column("type").to_pylist() if self.kinds else [None] * len(names)
                for t in zip((t or "" for t in names), (k or "" for k in kinds), strict=True):
                    if t not in topics:
                        topics[t] = len(topics) + 1
                        bag.execute("INSERT INTO topics VALUES (?, ?, ?, 'cdr', '')", (topics[t], *t))
                rows = ((topics[t or "", k or ""], int(when or 0), bytes(x or b"")) for t, k, when, x in zip(names, kinds, ts, data, strict=True))
                bag.executemany("INSERT INTO messages (topic_id, timestamp, data) VALUES (?, ?, ?)", rows)
                n += len(names)
            bag.commit()
        return Written(part, n)

    def commit(self, messages: list[Written]) -> None:
        os.makedirs(self.path, exist_ok=True)
        if self.overwrite:
            for f in listed(self.path, ".db3"):
                if os.path.isfile(f):
                    os.remove(f)
        for m in messages:
            if m is not None:
                folder, name = os.path.split(m.path)
                os.replace(m.path, os.path.join(folder, f"{name.split('.')[0]}-{self.token[:8]}.db3"))
        self._sweep()

    def abort(self, messages: list[Written]) -> None:
        self._sweep()

    def _sweep(self) -> None:
        for f in os.listdir(self.path) if os.path.isdir(self.path) else ():
            if f".{self.token}." in f and f.endswith(".tmp"):
                os.remove(os.path.join(self.path, f))


class BagSource(DataSource):
    """spark.read.format("bag").option("path", folder).

    Options: topics, with commas between; first and last, times; rows, message numbers
    in a partition.  They are options, and not Spark's own push-down: a loaded table
    keeps the filters that one query pushed, and gives them to later queries.
    """

    @classmethod
    def name(cls) -> str:
        return "bag"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> BagReader:
        return BagReader(self.options["path"], schema, int(self.options.get("rows", ROWS)), *(self.options.get(k) for k in ("topics", "first", "last")))

    def writer(self, schema: StructType, overwrite: bool) -> BagWriter:
        return BagWriter(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BagSource)
