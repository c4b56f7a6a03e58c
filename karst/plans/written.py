"""Named queries that write what they derive from the tables, and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from karst.operators import points
from karst.operators.lineage import shared_dir
from karst.plans.queries import query
from karst.plans.tiled import FINE, fine
from karst.plans.views import view
from karst.sources import bags, geotiff


def folder(spark, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


ROUTED = "k AS (SELECT * FROM pts WHERE z <= 9)"
BOXES = {"crop": (10.0, 20.0, 40.0, 60.0), "dem": (30.0, 10.0, 90.0, 50.0)}
WITHIN = {k: f"x >= {b[0]} AND x < {b[2]} AND y >= {b[1]} AND y < {b[3]}" for k, b in BOXES.items()}


@query(
    f"""WITH {ROUTED} SELECT 'crop' AS box, count(*) AS n, cast(sum(mz) AS bigint) AS mz FROM k WHERE {WITHIN["crop"]} UNION ALL SELECT 'dem', count(*), cast(sum(mz) AS bigint) FROM k WHERE {WITHIN["dem"]}
 UNION ALL SELECT 'dropped', count(*), NULL FROM pts WHERE NOT z <= 9 UNION ALL SELECT 'read', count(*), NULL FROM pts
 UNION ALL SELECT 'unrouted', count(*), NULL FROM k WHERE NOT ({WITHIN["crop"]}) AND NOT ({WITHIN["dem"]})"""
)
def box_routing_written(spark, d):
    """Two boxes written in one scan: their rows as read back, and the counts of the pass itself."""
    path = folder(spark, "routed")
    told = points.write_routed(view(spark, d, "pts").select("x", "y", "z", "mz"), BOXES, path, F.col("z") <= 9)
    back = spark.read.schema("x double, y double, z double, mz long, box string").parquet(path).groupBy("box").agg(F.count("*").alias("n"), F.sum("mz").alias("mz"))
    rest = [(k, told[k], None) for k in ("dropped", "read", "unrouted")]
    return back.unionAll(spark.createDataFrame(rest, "box string, n long, mz long"))


@query("SELECT event_type AS topic, count(*) AS n, cast(sum(strlen(cast(user_id AS varchar))) AS bigint) AS bytes, min(event_id) AS first, max(event_id) AS last FROM events WHERE event_type IN ('view', 'purchase') AND event_id >= 200 GROUP BY 1")
def bag_scan(spark, d):
    """Events written as a bag, a file a task, and read with topics and times looked up inside the files."""
    bags.register(spark)
    path = folder(spark, "bag").removeprefix("file://")
    log = spark.read.parquet(f"{d}/events.parquet")
    log.select(F.col("event_type").alias("topic"), F.lit("std_msgs/msg/String").alias("type"), F.col("event_id").alias("ts"), F.col("user_id").cast("string").cast("binary").alias("data")).write.format("bag").option("path", path).mode("append").save()
    found = spark.read.format("bag").option("path", path).option("topics", "view,purchase").option("first", 200).load()
    return found.groupBy("topic").agg(F.count("*").alias("n"), F.sum(F.octet_length("data")).cast("long").alias("bytes"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query(f"WITH {FINE} SELECT ix, iy, zmax::DOUBLE AS zmax FROM c WHERE ix BETWEEN 20 AND 90 AND iy BETWEEN 10 AND 33")
def raster_window(spark, d):
    """Cells written as a mosaic of rasters, a box of which is read: other squares are not opened."""
    geotiff.register(spark)
    path = folder(spark, "raster").removeprefix("file://")
    cells = fine(spark, d).select((F.col("ix") + 0.5).alias("x"), (F.col("iy") + 0.5).alias("y"), F.col("zmax").cast("double").alias("v"))
    dealt = cells.repartition(F.floor(F.col("x") / 32), F.floor(-F.col("y") / 32))
    dealt.write.format("geotiff").option("path", path).option("side", 32).mode("append").save()
    found = spark.read.format("geotiff").option("path", path).option("box", "20,10,91,34").load().where("v is not null")
    return found.select(F.floor("x").alias("ix"), F.floor("y").alias("iy"), F.col("v").alias("zmax"))
