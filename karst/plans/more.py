"""Further named queries: cameras, searches, samplings, profiles of two maps, logs and catalogues."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from karst.functions import columns as C
from karst.operators import geometry, landmarks, points, rasters, skeletons, spatial, stats
from karst.plans.queries import ANCHOR_SQL, CELLS, anchors, cells, mask, query
from karst.plans.views import view
from karst.sources import logs


@query("SELECT pid, x, y, z FROM upts WHERE x IS NOT NULL AND NOT isnan(z)")
def finite_load(spark, d):
    return points.finite(view(spark, d, "upts"), "x", "y", "z").select("pid", "x", "y", "z")


@query("SELECT pid, x, y, z FROM upts ORDER BY md5(pid::VARCHAR), pid LIMIT 500")
def sample_exact(spark, d):
    return skeletons.samples(view(spark, d, "upts").select("pid", "x", "y", "z"), 500)


@query("SELECT pid, x, y, z FROM upts WHERE cast('0x' || substr(md5('0:' || pid), 1, 8) AS BIGINT) / 4294967296.0 < 0.1")
def sample_bernoulli(spark, d):
    return points.bernoulli(view(spark, d, "upts"), 0.1).select("pid", "x", "y", "z")


@query(f"WITH a AS (SELECT * FROM {ANCHOR_SQL}) SELECT u.pid, a.pid AS anchor FROM upts u, a WHERE pow((u.x - a.x) / 12.0, 2) + pow((u.y - a.y) / 8.0, 2) <= 1 AND abs(u.z - a.z) <= 4")
def collar_all(spark, d):
    # every anchor's collar: a point may lie in several; anchors are joined through cells as wide as the collar
    near = spatial.near_pairs(anchors(spark), view(spark, d, "upts").select("pid", "x", "y", "z"), 12.0, "xy")
    inside = ((F.col("b.x") - F.col("a.x")) / 12.0) ** 2 + ((F.col("b.y") - F.col("a.y")) / 8.0) ** 2 <= 1
    return near.where(inside & (F.abs(F.col("b.z") - F.col("a.z")) <= 4)).select(F.col("b.pid").alias("pid"), F.col("a.pid").cast("int").alias("anchor"))


@query(f"WITH a AS (SELECT * FROM {ANCHOR_SQL}), q AS (SELECT b.pid, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d2 FROM a, upts b GROUP BY 1) SELECT u.pid, u.x, u.y FROM upts u JOIN q USING (pid) WHERE d2 > 400")
def cutaway(spark, d):
    p = view(spark, d, "upts").select("pid", "x", "y")
    return p.join(spatial.nearest(p, anchors(spark), "xy").where("d2 > 400").select("pid"), "pid", "left_semi")


@query("SELECT l_orderkey, CASE WHEN b > 200 AND r < 100 THEN 'blue' WHEN r > 200 AND g < 100 THEN 'red' ELSE 'other' END AS kind FROM pts")
def pixel_class(spark, d):
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return view(spark, d, "pts").select("l_orderkey", F.when((b > 200) & (r < 100), "blue").when((r > 200) & (g < 100), "red").otherwise("other").alias("kind"))


@query("SELECT pid, CASE WHEN z - 2 > 1e-9 THEN round(800 * (x - 50) / (z - 2) + 640, 6) END AS u, CASE WHEN z - 2 > 1e-9 THEN round(800 * (y - 50) / (z - 2) + 360, 6) END AS v FROM upts")
def pinhole_projection(spark, d):
    u, v, _ = geometry.pinhole(F.col("x"), F.col("y"), F.col("z"), ((1, 0, 0, -50), (0, 1, 0, -50), (0, 0, 1, -2)), 800.0, 640.0, 360.0)
    return view(spark, d, "upts").select("pid", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


@query("SELECT pid, round(0.25 * cos(0.3) * x + 0.25 * sin(0.3) * y + 7, 6) AS x, round(0.25 * sin(0.3) * x - 0.25 * cos(0.3) * y - 2, 6) AS y FROM upts")
def similarity_transform(spark, d):
    x, y = geometry.similarity(F.col("x"), F.col("y"), 0.25, 0.3, (7, -2))
    return view(spark, d, "upts").select("pid", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("SELECT kind, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) / 2, 6) AS angle FROM upts GROUP BY 1")
def principal_frame(spark, d):
    g = geometry.principal_frame(view(spark, d, "upts"), ["kind"])
    return g.select("kind", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "angle")])


@query("WITH q AS (SELECT class, value, quantile_cont(value, 0.3) OVER (PARTITION BY class) AS p FROM stn) SELECT class, round(median(value), 4) AS floor FROM q WHERE value < p GROUP BY 1")
def floor_band(spark, d):
    s = view(spark, d, "stn").select("class", "value")
    p = s.groupBy("class").agg(F.percentile("value", 0.3).alias("p"))
    return s.join(p, "class").where("value < p").groupBy("class").agg(F.round(F.median("value"), 4).alias("floor"))


@query("WITH q AS (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.5) AS b, quantile_cont(x, 0.75) AS c FROM upts), k AS (SELECT CASE WHEN x < a THEN 1 WHEN x < b THEN 2 WHEN x < c THEN 3 ELSE 4 END AS quarter, y FROM upts, q) SELECT quarter, count(*) AS n, round(median(y), 4) AS median FROM k GROUP BY 1")
def quartile_bias(spark, d):
    u = view(spark, d, "upts")
    a, b, c = u.agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).first()[0] or [0.0] * 3
    x = F.col("x")
    k = F.when(x < a, 1).when(x < b, 2).when(x < c, 3).otherwise(4)
    return u.groupBy(k.alias("quarter")).agg(F.count("*").alias("n"), F.round(F.median("y"), 4).alias("median"))


@query("WITH w AS (SELECT user_id, s, lag(value) OVER o AS a, value AS b, lead(value) OVER o AS c FROM stn WINDOW o AS (PARTITION BY user_id ORDER BY s)), t AS (SELECT user_id, s, (coalesce(a, b) + 2 * b + coalesce(c, b)) / 4 AS v FROM w), p AS (SELECT *, lag(v) OVER o AS l, lead(v) OVER o AS r FROM t WINDOW o AS (PARTITION BY user_id ORDER BY s)) SELECT user_id, s, round(v, 6) AS v FROM p WHERE v > 40 AND v > l AND v >= r")
def smoothed_peaks(spark, d):
    w = Window.partitionBy("user_id").orderBy("s")
    a, b, c = F.lag("value").over(w), F.col("value"), F.lead("value").over(w)
    t = view(spark, d, "stn").select("user_id", "s", ((F.coalesce(a, b) + 2 * b + F.coalesce(c, b)) / 4).alias("v"))
    t = t.withColumn("l", F.lag("v").over(w)).withColumn("r", F.lead("v").over(w))
    return t.where("v > 40 and v > l and v >= r").select("user_id", "s", F.round("v", 6).alias("v"))


FILL = f"{CELLS}, m AS (SELECT ix, iy, zmax FROM c WHERE n >= 120), x AS (SELECT min(ix) x0, max(ix) x1, min(iy) y0, max(iy) y1 FROM m), ax AS (SELECT unnest(range(x0, x1 + 1)) AS ix FROM x), ay AS (SELECT unnest(range(y0, y1 + 1)) AS iy FROM x), q AS (SELECT ax.ix, ay.iy, m.zmax, row_number() OVER (PARTITION BY ax.ix, ay.iy ORDER BY (m.ix - ax.ix) * (m.ix - ax.ix) + (m.iy - ay.iy) * (m.iy - ay.iy), m.ix, m.iy) AS k, (m.ix - ax.ix) * (m.ix - ax.ix) + (m.iy - ay.iy) * (m.iy - ay.iy) AS d FROM ax, ay, m)"


@query(f"WITH {FILL} SELECT ix, iy, zmax FROM q WHERE k = 1")
def nearest_fill(spark, d):
    return geometry.nearest_fill(cells(spark, d).where("n >= 120").select("ix", "iy", "zmax"), "zmax")


BILINEAR = "f AS (SELECT pid, x / 5 - 0.5 AS fx, y / 5 - 0.5 AS fy FROM upts), g AS (SELECT pid, fx, fy, cast(floor(fx) AS bigint) AS i, cast(floor(fy) AS bigint) AS j FROM f)"


@query(f"WITH {CELLS}, {BILINEAR} SELECT g.pid, round((1 - (fx - i)) * (1 - (fy - j)) * p.zmax + (fx - i) * (1 - (fy - j)) * q.zmax + (1 - (fx - i)) * (fy - j) * r.zmax + (fx - i) * (fy - j) * s.zmax, 6) AS zmax FROM g LEFT JOIN c p ON p.ix = i AND p.iy = j LEFT JOIN c q ON q.ix = i + 1 AND q.iy = j LEFT JOIN c r ON r.ix = i AND r.iy = j + 1 LEFT JOIN c s ON s.ix = i + 1 AND s.iy = j + 1")
def bilinear_sample(spark, d):
    out = geometry.bilinear(view(spark, d, "upts"), cells(spark, d), "zmax", (0.0, 0.0), 5.0)
    return out.select("pid", F.round("zmax", 6).alias("zmax"))


@query("SELECT " + ", ".join(f"round(covar_pop({a}, {b}) * count(*), 4) AS c{a}{b}" for a in ("x", "y", "z") for b in ("x2", "y2", "z2")) + ", count(*) AS n FROM (SELECT x, y, z, 0.6 * x - 0.8 * y AS x2, 0.8 * x + 0.6 * y AS y2, z + 1 AS z2 FROM upts)")
def kabsch_sums(spark, d):
    p = view(spark, d, "upts").select("x", "y", "z", (0.6 * F.col("x") - 0.8 * F.col("y")).alias("x2"), (0.8 * F.col("x") + 0.6 * F.col("y")).alias("y2"), (F.col("z") + 1).alias("z2"))
    return p.agg(*[F.round(F.covar_pop(a, b) * F.count("*"), 4).alias(f"c{a}{b}") for a in ("x", "y", "z") for b in ("x2", "y2", "z2")], F.count("*").alias("n"))


@query(f"WITH a AS (SELECT * FROM {ANCHOR_SQL}) SELECT a.pid, round(avg(u.z - a.z), 6) AS mean, round(median(u.z - a.z), 4) AS residual FROM a JOIN upts u ON u.pid % 5 + 1 = a.pid GROUP BY 1")
def vertical_residual(spark, d):
    a = anchors(spark).select(F.col("pid").alias("anchor"), F.col("z").alias("az"))
    j = view(spark, d, "upts").withColumn("anchor", F.col("pid") % 5 + 1).join(F.broadcast(a), "anchor")  # five literal anchors
    return j.groupBy(F.col("anchor").cast("int").alias("pid")).agg(F.round(F.avg(F.col("z") - F.col("az")), 6).alias("mean"), F.round(F.median(F.col("z") - F.col("az")), 4).alias("residual"))


TWO = "a AS (SELECT user_id AS s, count(*) AS n, quantile_cont(value, 0.99) AS z FROM stn WHERE class <> 'click' GROUP BY 1 HAVING count(*) > 30), b AS (SELECT user_id AS s, count(*) AS n, quantile_cont(value, 0.99) AS z FROM stn WHERE class <> 'view' GROUP BY 1 HAVING count(*) > 30)"


def _two(spark, d):
    s = view(spark, d, "stn")
    a, b = (s.where(q).groupBy(F.col("user_id").alias("s")).agg(F.count("*").alias("n"), F.percentile("value", 0.99).alias(z)).where("n > 30").drop("n") for q, z in (("class <> 'click'", "z1"), ("class <> 'view'", "z2")))
    return a.join(b, "s")


@query(f"WITH {TWO} SELECT a.s, round(b.z - a.z, 4) AS dz FROM a JOIN b USING (s)")
def drift_profile(spark, d):
    return _two(spark, d).select("s", F.round(F.col("z2") - F.col("z1"), 4).alias("dz"))


@query(f"WITH {TWO} SELECT count(*) AS n, round(sqrt(avg(pow(b.z - a.z, 2))), 4) AS rms, round(median(b.z - a.z), 4) AS median FROM a JOIN b USING (s)")
def repeatability(spark, d):
    dz = F.col("z2") - F.col("z1")
    return _two(spark, d).agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(dz * dz)), 4).alias("rms"), F.round(F.median(dz), 4).alias("median"))


@query("SELECT p_brand, count(*) AS n, round(median(coalesce(try_cast(CASE WHEN p_size > 40 THEN '' ELSE p_size::VARCHAR END AS double), p_retailprice)), 4) AS aperture FROM part GROUP BY 1")
def catalogue_types(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    size = F.when(F.col("p_size") > 40, "").otherwise(F.col("p_size").cast("string"))
    return p.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.median(F.coalesce(logs.number(size), F.col("p_retailprice"))), 4).alias("aperture"))


@query("WITH w(word) AS (VALUES ('error'), ('view'), ('click')), k AS (SELECT word, event_id, row_number() OVER (PARTITION BY word ORDER BY event_id) AS k FROM events, w WHERE contains(lower(event_type), word)) SELECT word, event_id FROM k WHERE k <= 40")
def keyword_cap(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type")
    return logs.keyword_messages(e, "event_type", ["error", "view", "click"], 40, "event_id").select("word", "event_id")


@query("SELECT event_type AS topic, count(*) AS n, min(ts) AS first FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1")
def topic_scan(spark, d):
    log = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("topic"), "ts")
    return logs.messages(log, ["view", "purchase"]).groupBy("topic").agg(F.count("*").alias("n"), F.min("ts").alias("first"))


@query("SELECT doc_id, CASE WHEN regexp_matches(source, '^src1[0-9]$') THEN 'ignored' WHEN regexp_matches(source, '[02468]$') THEN 'even' ELSE 'odd' END AS verdict FROM documents")
def regex_rules(spark, d):
    s = F.col("source")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.when(s.rlike("^src1[0-9]$"), "ignored").when(s.rlike("[02468]$"), "even").otherwise("odd").alias("verdict"))


@query("WITH n AS (SELECT pid AS id, x AS lon, y AS lat FROM upts), w AS (SELECT pid // 100 AS way, row_number() OVER (PARTITION BY pid // 100 ORDER BY pid DESC) - 1 AS pos, pid AS node FROM upts) SELECT way, pos::INTEGER AS pos, lat, lon FROM w JOIN n ON n.id = w.node")
def map_ways(spark, d):
    u = view(spark, d, "upts")
    node = F.struct(F.lit("node").alias("type"), F.col("pid").alias("id"), F.col("y").alias("lat"), F.col("x").alias("lon"))
    n = u.groupBy(F.floor(F.col("pid") / 100).cast("long").alias("way")).agg(F.collect_list(node).alias("nodes"), F.sort_array(F.collect_list("pid"), False).alias("ids"))
    made = n.select(F.to_json(F.struct(F.concat(F.transform("nodes", lambda v: F.struct(v["type"].alias("type"), v["id"].alias("id"), v["lat"].alias("lat"), v["lon"].alias("lon"), F.lit(None).cast("array<long>").alias("nodes"))), F.array(F.struct(F.lit("way").alias("type"), F.col("way").alias("id"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.col("ids").alias("nodes")))).alias("elements"))).alias("json"))
    return logs.ways(made)


@query("SELECT event_id, user_id AS code, value AS amount, event_type AS name FROM events")
def binary_records(spark, d):
    import pyarrow as pa

    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "value", "event_type")

    def encode(batches):
        for b in batches:
            raw = []
            for u, v, t in zip(*(b.column(c).to_pylist() for c in ("user_id", "value", "event_type")), strict=True):
                t = (t or "").encode() + b"\0"
                raw.append(b"\0\1\0\0" + struct.pack("<I4xdI", u, v, len(t)) + t)
            yield pa.RecordBatch.from_arrays([b.column("event_id"), pa.array(raw, pa.binary())], ["event_id", "data"])

    return logs.decode(e.mapInArrow(encode, "event_id long, data binary"), "data", "Ids", ["code", "amount", "name"])


@query("SELECT s, round_even(value, 1) AS value FROM stn")
def fixed_precision(spark, d):
    return logs.fixed(view(spark, d, "stn").select("s", "value"), {"value": 1})


@query(f"WITH {CELLS}, t(angle) AS (VALUES (-0.1), (0.0), (0.1)), r AS (SELECT angle, x * cos(angle) - y * sin(angle) AS x, x * sin(angle) + y * cos(angle) AS y, z FROM upts, t) SELECT angle::DOUBLE AS angle, count(*) AS n, round(avg(abs(z - zmax)), 6) AS cost FROM r JOIN c ON c.ix = cast(floor(x / 5) AS bigint) AND c.iy = cast(floor(y / 5) AS bigint) GROUP BY 1")
def roll_search(spark, d):
    out = geometry.angle_search(view(spark, d, "upts"), cells(spark, d), "zmax", (0, 0, 1), (-0.1, 0.0, 0.1), 5.0, (0.0, 0.0))
    return out.select("angle", "n", F.round("cost", 6).alias("cost"))


@query(f"WITH {CELLS}, k AS (SELECT u.pid, u.x, u.y, u.z, coalesce(10 * z < zmax - 80, false) AS below FROM upts u LEFT JOIN c ON c.ix = cast(floor(u.x / 5) AS bigint) AND c.iy = cast(floor(u.y / 5) AS bigint)) SELECT below, cast(floor(x / 10) AS bigint) AS vx, cast(floor(y / 10) AS bigint) AS vy, cast(floor(z / 10) AS bigint) AS vz, count(*) AS n, cast(sum(pid) AS bigint) AS pids FROM k GROUP BY 1, 2, 3, 4")
def component_extraction(spark, d):
    found = rasters.lookup(view(spark, d, "upts"), cells(spark, d).select("ix", "iy", "zmax"), C.cell("x", 0, 5), C.cell("y", 0, 5))
    below = F.coalesce(10 * F.col("z") < F.col("zmax") - 80, F.lit(False))
    return found.groupBy(below.alias("below"), *[C.voxel(c, 10).alias(f"v{c}") for c in "xyz"]).agg(F.count("*").alias("n"), F.sum("pid").alias("pids"))


@query(f"WITH {CELLS}, f(f) AS (VALUES (1), (2), (4)), b AS (SELECT f, ix // f AS bx, iy // f AS b_y, sum(zmax)::DOUBLE / count(*) AS m FROM c, f GROUP BY 1, 2, 3) SELECT f.f::INTEGER AS factor, count(*) AS n, round(avg(abs(m - zmax)), 6) AS loss FROM c CROSS JOIN f JOIN b ON b.f = f.f AND bx = ix // f.f AND b_y = iy // f.f GROUP BY 1")
def degraded_dem(spark, d):
    c = cells(spark, d).select("ix", "iy", "zmax", F.explode(F.array(*map(F.lit, (1, 2, 4)))).alias("factor"))
    key = ["factor", "bx", "by"]
    c = c.withColumns({"bx": F.floor(F.col("ix") / F.col("factor")), "by": F.floor(F.col("iy") / F.col("factor"))})
    m = c.groupBy(*key).agg(F.avg("zmax").alias("m"))
    return c.join(m, key).groupBy("factor").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("m") - F.col("zmax"))), 6).alias("loss"))


@query("SELECT user_id, round(sum(step), 4) AS length, round(sum(step) / nullif(abs(last(value ORDER BY s) - first(value ORDER BY s)), 0), 4) AS tortuosity, round(sum(value), 4) AS volume FROM (SELECT user_id, s, value, coalesce(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY s)), 0) AS step FROM stn) GROUP BY 1")
def totals(spark, d):
    w = Window.partitionBy("user_id").orderBy("s")
    rows = view(spark, d, "stn").withColumn("step", F.coalesce(F.abs(F.col("value") - F.lag("value").over(w)), F.lit(0.0)))
    gap = F.abs(F.max_by("value", "s") - F.min_by("value", "s"))
    return rows.groupBy("user_id").agg(F.round(F.sum("step"), 4).alias("length"), F.round(F.sum("step") / F.nullif(gap, F.lit(0.0)), 4).alias("tortuosity"), F.round(F.sum("value"), 4).alias("volume"))


@query("SELECT round(sqrt(sum(v)), 6) AS sigma, count(*) AS terms FROM (SELECT class, var_pop(value) / count(*) AS v FROM stn GROUP BY 1)")
def error_budget(spark, d):
    parts = view(spark, d, "stn").groupBy("class").agg((F.stddev_pop("value") / F.sqrt(F.count("*"))).alias("sigma"))
    return stats.quadrature(parts, "sigma").select(F.round("sigma", 6).alias("sigma"), "terms")


@query()
def up_axis(spark, d):
    n = landmarks.up_axis(view(spark, d, "upts"), 10)
    return spark.createDataFrame([tuple(map(float, np.round(n, 6)))], "x double, y double, z double")


@query()
def l1_skeleton(spark, d):
    return skeletons.l1_skeleton(view(spark, d, "upts"), 60, (6.0, 12.0), 2)


@query()
def centreline(spark, d):
    rows = skeletons.samples(view(spark, d, "upts").select("pid", "x", "y", "z"), 400).collect()
    line = skeletons.resample(skeletons.order_polyline(np.array([[r["x"], r["y"], r["z"] / 10] for r in rows]), 8.0))
    return spark.createDataFrame([tuple(map(float, r)) for r in line], "s double, x double, y double, z double, tx double, ty double, tz double")


@query(f"WITH {CELLS} SELECT quantile_cont(ix, 0.25)::DOUBLE AS p25, quantile_cont(ix, 0.5)::DOUBLE AS p50, quantile_cont(ix, 0.75)::DOUBLE AS p75, count(*) AS n FROM c WHERE n >= 120")
def outline_percentiles(spark, d):
    return mask(spark, d).agg(*stats.percentiles("ix", (0.25, 0.5, 0.75)), F.count("*").alias("n"))


def queries():
    from karst.plans.queries import queries as all_queries

    return all_queries()


def oracle_sql():
    from karst.plans.queries import oracle_sql as all_oracles

    return all_oracles()
