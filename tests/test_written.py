"""Bags and routed writes, read back."""

import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from karst.operators import points
from karst.sources import bags


def bag(path, messages, first=1):
    con = sqlite3.connect(path)
    for text in bags._TABLES:
        con.execute(text)
    topics = {t: k + 1 for k, t in enumerate(dict.fromkeys(t for t, _, _ in messages))}
    con.executemany("INSERT INTO topics VALUES (?, ?, 'kind', 'cdr', '')", [(k, t) for t, k in topics.items()])
    con.executemany("INSERT INTO messages VALUES (?, ?, ?, ?)", [(first + i, topics[t], ts, x) for i, (t, ts, x) in enumerate(messages)])
    con.commit()
    con.close()


MESSAGES = [("/pose" if i % 3 else "/log", 1000 + i, bytes([i % 256]) * (i % 5)) for i in range(500)]


def test_a_bag_is_read_by_ranges_with_topics_looked_up(spark, tmp_path):
    bags.register(spark)
    bag(tmp_path / "a.db3", MESSAGES, 11)
    bag(tmp_path / "b.db3", [("/other", 5, b"x")])
    bag(tmp_path / "c.db3", [])
    df = spark.read.format("bag").option("path", str(tmp_path)).option("rows", 64).load()
    assert sorted((r["topic"], r["ts"], bytes(r["data"])) for r in df.collect()) == sorted([*MESSAGES, ("/other", 5, b"x")])
    asked = spark.read.format("bag").option("path", str(tmp_path)).option("rows", 64)
    some = asked.option("topics", "/log, /none").option("first", 1101).option("last", 1400).load()
    assert sorted((r["id"], r["ts"], bytes(r["data"])) for r in some.select("id", "ts", "data").collect()) == [(11 + i, ts, x) for i, (t, ts, x) in enumerate(MESSAGES) if t == "/log" and 1100 < ts <= 1400]
    assert df.where("topic = '/none'").count() == 0 and df.select("topic").distinct().count() == 3 and df.count() == 501
    assert asked.option("topics", "/none").load().count() == 0


def test_files_without_the_topics_make_no_partition(tmp_path):
    bag(tmp_path / "a.db3", MESSAGES)
    bag(tmp_path / "b.db3", [("/other", 5, b"x")])
    schema = StructType.fromDDL(bags.SCHEMA)
    assert len(bags.BagReader(str(tmp_path), schema, 100).partitions()) == 6
    (only,) = bags.BagReader(str(tmp_path), schema, 100, "/other").partitions()
    assert only.path.endswith("b.db3")
    with pytest.raises(FileNotFoundError):
        bags.BagReader(str(tmp_path / "none.db3"), schema, 100).partitions()


def test_a_bag_is_written_by_tasks(spark, tmp_path):
    bags.register(spark)
    path = str(tmp_path / "out")
    df = spark.createDataFrame([*MESSAGES, (None, None, None)], "topic string, ts long, data binary").repartition(4)
    for mode, times in (("append", 1), ("append", 2), ("overwrite", 1)):
        df.write.format("bag").option("path", path).mode(mode).save()
        got = spark.read.format("bag").option("path", path).load()
        assert sorted((r["topic"], r["ts"], bytes(r["data"])) for r in got.collect()) == sorted([*MESSAGES, ("", 0, b"")] * times)
    assert len(list((tmp_path / "out").iterdir())) == 4
    with pytest.raises(Exception, match="needs data"):
        df.drop("data").write.format("bag").option("path", path).mode("append").save()


def test_points_are_routed_in_one_pass(spark, tmp_path):
    rows = [(float(x), float(y), float(x * y)) for x in range(20) for y in range(20)] + [(None, 1.0, 0.0), (3.0, 3.0, None)]
    df = spark.createDataFrame(rows, "x double, y double, z double").repartition(3)
    told = points.write_routed(df, {"a": (0, 0, 10, 10), "b": (5, 5, 30, 8), "none": (90, 90, 91, 91)}, str(tmp_path / "r"), F.col("z") < 200)
    kept = [r for r in rows if r[2] is not None and r[2] < 200]
    a = [r for r in kept if r[0] is not None and r[0] < 10 and r[1] < 10]
    b = [r for r in kept if r[0] is not None and r[0] >= 5 and 5 <= r[1] < 8]
    assert told == {"read": len(rows), "dropped": len(rows) - len(kept), "unrouted": len(kept) - len({*a, *b}), "a": len(a), "b": len(b), "none": 0}
    back = spark.read.parquet(str(tmp_path / "r"))
    for k, want in (("a", a), ("b", b)):
        assert sorted(tuple(r) for r in back.where(F.col("box") == k).select("x", "y", "z").collect()) == sorted(want)
    with pytest.raises(ValueError):
        points.write_routed(df, {"read": (0, 0, 1, 1)}, str(tmp_path / "q"))
