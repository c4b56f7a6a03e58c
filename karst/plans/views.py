"""Points, stations and logs derived from the driver's tables; the same text serves Spark and the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PTS = """SELECT l_extendedprice / 1000 AS x, l_quantity * 2 AS y, (round(l_discount * 100) * 100 + round(l_tax * 100) * 10) / 100 AS z,
 l_partkey % 65536 AS intensity, l_suppkey % 256 AS r, l_partkey % 256 AS g, (l_linenumber * 36) % 256 AS b,
 cast(round(l_extendedprice * 100) AS bigint) AS mx, cast(round(l_quantity) AS bigint) AS my, cast(round(l_discount * 100) * 10 + round(l_tax * 100) AS bigint) AS mz,
 l_orderkey, l_returnflag, l_linestatus FROM lineitem"""
UPTS = """SELECT o_orderkey AS pid, (cast(round(o_totalprice * 100) AS bigint) * 7 % 10000) / 100 AS x, (o_custkey * 137 % 10000) / 100 AS y,
 cast(o_orderkey % 17 AS double) AS z, o_orderstatus AS kind FROM orders"""
#: event_id follows ts without gaps, so it numbers the stations; a window over all rows would be one task.
STN = "SELECT event_id AS s, event_id, user_id, event_type AS class, value, ts FROM events"
SOURCES = {"pts": (PTS, "lineitem"), "upts": (UPTS, "orders"), "stn": (STN, "events")}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text, table = SOURCES[name]
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(text.replace(f"FROM {table}", "FROM {t}"), t=df)


def with_views(sql: str) -> str:
    """The oracle's text with the views it names in front."""
    used = [f"{k} AS ({t})" for k, (t, _) in SOURCES.items() if f" {k}" in sql]
    body = sql.strip()
    if not used:
        return body
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(used)}, {body[15:]}"
    return f"WITH {', '.join(used)}, {body[5:]}" if body.startswith("WITH ") else f"WITH {', '.join(used)} {body}"
