"""Named queries over the derived views, each with the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from karst.functions import columns as C
from karst.operators import curves, geometry, landmarks, points, profiles, rasters, relations, reports, spatial, stats
from karst.plans.views import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = with_views(sql)
        return f

    return keep


ANCHORS = [(1, 10.0, 10.0, 4.0), (2, 30.0, 60.0, 8.0), (3, 55.0, 25.0, 2.0), (4, 80.0, 80.0, 12.0), (5, 95.0, 45.0, 6.0)]
ANCHOR_SQL = "(VALUES " + ", ".join(f"({i}, {x}, {y}, {z})" for i, x, y, z in ANCHORS) + ") AS t(pid, x, y, z)"
MOTION = ((0.6, -0.8, 0.0, 12.0), (0.8, 0.6, 0.0, -3.0), (0.0, 0.0, 1.0, 1.5), (0, 0, 0, 1))


def anchors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ANCHORS, "pid long, x double, y double, z double")


def cells(spark: SparkSession, d: str) -> DataFrame:
    """5 x 5 cells of pts: n, whole-number sums and extremes."""
    p = view(spark, d, "pts").select("x", "y", F.col("mz").alias("z"))
    return points.grid(p, 5.0, (0.0, 0.0))


CELLS = "c AS (SELECT cast(floor(x / 5) AS bigint) AS ix, cast(floor(y / 5) AS bigint) AS iy, count(*) AS n, cast(sum(mz) AS bigint) AS zsum, max(mz) AS zmax, min(mz) AS zmin FROM pts GROUP BY 1, 2)"

# points and columns


@query("SELECT cast(floor(x / 5) AS bigint) AS vx, cast(floor(y / 5) AS bigint) AS vy, cast(floor(z / 2) AS bigint) AS vz, count(*) AS n, cast(sum(mx) AS double) / (100000.0::DOUBLE * count(*)) AS mean_x, 2 * cast(sum(my) AS double) / count(*) AS mean_y, cast(sum(mz) AS double) / (10.0::DOUBLE * count(*)) AS mean_z FROM (SELECT *, z AS zz FROM pts WHERE x BETWEEN 2 AND 90 AND y BETWEEN 4 AND 96) GROUP BY 1, 2, 3")
def voxel_downsample(spark, d):
    size = {"x": 5.0, "y": 5.0, "z": 2.0}
    g = points.voxel_downsample(points.crop(view(spark, d, "pts"), (2, 4, 90, 96)), size, {"sx": F.col("mx"), "sy": F.col("my"), "sz": F.col("mz")})
    n = F.col("n")
    return g.select("vx", "vy", "vz", "n", (F.col("sx").cast("double") / (F.lit(100000.0) * n)).alias("mean_x"), (2 * F.col("sy").cast("double") / n).alias("mean_y"), (F.col("sz").cast("double") / (F.lit(10.0) * n)).alias("mean_z"))


@query("SELECT cast(floor(x / 10) AS bigint) AS vx, cast(floor(y / 10) AS bigint) AS vy, cast(floor(z / 10) AS bigint) AS vz, count(*) AS n, cast(sum(r) AS bigint) AS r, cast(sum(g) AS bigint) AS g, cast(sum(b) AS bigint) AS b, cast(sum(intensity) AS bigint) AS intensity FROM pts GROUP BY 1, 2, 3")
def voxel_rgb(spark, d):
    return points.voxel_downsample(view(spark, d, "pts"), 10.0, {c: F.col(c).cast("long") for c in ("r", "g", "b", "intensity")})


@query("SELECT l_orderkey, x, y, z FROM pts WHERE x BETWEEN 20 AND 40 AND z BETWEEN 1 AND 5")
def crop_rect(spark, d):
    return points.crop(view(spark, d, "pts"), (40, 5, 20, 1), "xz").select("l_orderkey", "x", "y", "z")


@query("SELECT count(*) FILTER (WHERE k) AS kept, count(*) FILTER (WHERE NOT k) AS dropped FROM (SELECT x BETWEEN 5 - 0.001 AND 95 + 0.001 AND y BETWEEN 10 - 0.001 AND 90 + 0.001 AND z BETWEEN 0 - 0.001 AND 9 + 0.001 AS k FROM pts)")
def bounds_filter(spark, d):
    keep = points.within_bounds((5, 10, 0), (95, 90, 9))
    return view(spark, d, "pts").agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped"))


@query("SELECT l_orderkey, cast((cast(r AS bigint) << 16) | (cast(g AS bigint) << 8) | cast(b AS bigint) AS bigint) AS rgb FROM pts")
def pack_rgb(spark, d):
    return view(spark, d, "pts").select("l_orderkey", C.pack_rgb(F.col("r"), F.col("g"), F.col("b")).cast("long").alias("rgb"))


@query("SELECT l_orderkey, cast(r AS bigint) AS r, cast(g AS bigint) AS g, cast(b AS bigint) AS b FROM pts")
def unpack_rgb(spark, d):
    p = pack_rgb(spark, d)
    return p.select("l_orderkey", *[c.cast("long").alias(n) for c, n in zip(C.unpack_rgb(F.col("rgb")), "rgb", strict=True)])


@query("SELECT l_orderkey, cast(least(greatest(round_even(r * 257.0::DOUBLE, 0), 0), 65535) AS bigint) AS r16, (r * 257) / 257.0::DOUBLE AS back FROM pts")
def colour_16bit(spark, d):
    return view(spark, d, "pts").select("l_orderkey", C.to_16bit(F.col("r")).cast("long").alias("r16"), C.from_16bit(F.col("r") * 257).alias("back"))


@query("WITH e AS (SELECT min(z) AS lo, max(z) AS hi FROM pts) SELECT l_orderkey, cast(least(floor(least(greatest((z - lo) / (hi - lo), 0), 1) * 256), 255) AS bigint) AS step FROM pts, e")
def elevation_lut(spark, d):
    p = view(spark, d, "pts")
    ((low, high),) = points.extent(p, "z")
    return p.select("l_orderkey", C.ramp(F.col("z"), low if low is not None else 0.0, high if high is not None else 0.0).alias("step"))


@query("SELECT l_orderkey, x - 479000.0::DOUBLE AS x, y - 7089000.0::DOUBLE AS y, z FROM (SELECT l_orderkey, x + 479157.0::DOUBLE AS x, y + 7089825.0::DOUBLE AS y, z FROM pts)")
def origin_shift(spark, d):
    p = view(spark, d, "pts").select("l_orderkey", (F.col("x") + 479157.0).alias("x"), (F.col("y") + 7089825.0).alias("y"), "z")
    return p.select("l_orderkey", C.local("x", 479000).alias("x"), C.local("y", 7089000).alias("y"), "z")


@query("SELECT pid, round(0.6 * x - 0.8 * y + 12, 6) AS x, round(0.8 * x + 0.6 * y - 3, 6) AS y, z + 1.5 + 0.25 AS z FROM upts")
def rigid_transform(spark, d):
    p = points.transform(view(spark, d, "upts").select("pid", "x", "y", "z"), MOTION, 0.25)
    return p.select("pid", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "z")


@query("SELECT pid, x, y, z, 0 AS source, kind FROM upts WHERE kind = 'O' UNION ALL SELECT pid, x, y, z, 1 AS source, NULL AS kind FROM upts WHERE kind = 'F'")
def union_tagged(spark, d):
    p = view(spark, d, "upts")
    return points.merge([p.where("kind = 'O'"), p.where("kind = 'F'").drop("kind")], [0, 1]).select("pid", "x", "y", "z", "source", "kind")


@query("SELECT count(*) FILTER (WHERE x >= 0 AND x < 50 AND y >= 0 AND y < 50) AS a, count(*) FILTER (WHERE x >= 25 AND x < 75 AND y >= 50 AND y < 100) AS b FROM upts")
def box_routing(spark, d):
    r = points.route(view(spark, d, "upts"), {"a": (0, 0, 50, 50), "b": (25, 50, 75, 100)})
    return r["a"].agg(F.count("*").alias("a")).crossJoin(r["b"].agg(F.count("*").alias("b")))  # two single rows


# grids


@query(f"WITH {CELLS} SELECT ix, iy, n, zsum, zmax, zmin FROM c")
def grid_occupancy(spark, d):
    return cells(spark, d)


@query(f"WITH {CELLS} SELECT ix, iy, zsum::DOUBLE / n AS mean_z FROM c")
def grid_meanz(spark, d):
    return cells(spark, d).select("ix", "iy", (F.col("zsum").cast("double") / F.col("n")).alias("mean_z"))


@query(f"WITH {CELLS} SELECT ix, iy, zmax - zmin AS span, n >= 60 AS dense FROM c")
def zspan_raster(spark, d):
    return cells(spark, d).select("ix", "iy", (F.col("zmax") - F.col("zmin")).alias("span"), (F.col("n") >= 60).alias("dense"))


@query("SELECT cast(floor(x / 5) AS bigint) AS ix, cast(floor(y / 5) AS bigint) AS iy, cast(floor(z / 1) AS bigint) AS iz, count(*) AS n FROM pts GROUP BY 1, 2, 3")
def column_histogram(spark, d):
    return view(spark, d, "pts").groupBy(C.voxel("x", 5).alias("ix"), C.voxel("y", 5).alias("iy"), C.voxel("z", 1).alias("iz")).agg(F.count("*").alias("n"))


@query(f"WITH {CELLS} SELECT u.pid, zmax, zmax - 10 * z AS above FROM upts u LEFT JOIN c ON c.ix = cast(floor(u.x / 5) AS bigint) AND c.iy = cast(floor(u.y / 5) AS bigint)")
def dem_lookup_join(spark, d):
    found = rasters.lookup(view(spark, d, "upts"), cells(spark, d).select("ix", "iy", "zmax"), C.cell("x", 0, 5), C.cell("y", 0, 5))
    return found.select("pid", "zmax", (F.col("zmax") - 10 * F.col("z")).alias("above"))


@query(f"WITH {CELLS}, k AS (SELECT u.pid, 10 * z < zmax - 80 AS below FROM upts u LEFT JOIN c ON c.ix = cast(floor(u.x / 5) AS bigint) AND c.iy = cast(floor(u.y / 5) AS bigint)) SELECT coalesce(below, false) AS below, count(*) AS n FROM k GROUP BY 1")
def surface_split(spark, d):
    found = rasters.lookup(view(spark, d, "upts"), cells(spark, d).select("ix", "iy", "zmax"), C.cell("x", 0, 5), C.cell("y", 0, 5))
    return found.groupBy(F.coalesce(10 * F.col("z") < F.col("zmax") - 80, F.lit(False)).alias("below")).agg(F.count("*").alias("n"))


BOX = "x AS (SELECT min(ix) x0, max(ix) x1, min(iy) y0, max(iy) y1 FROM c)"
DENSE = f"{CELLS}, {BOX}, ax AS (SELECT unnest(range(x0, x1 + 1)) AS ix FROM x), ay AS (SELECT unnest(range(y0, y1 + 1)) AS iy FROM x), g AS (SELECT ax.ix, ay.iy FROM ax, ay)"


@query(f"WITH {DENSE}, o AS (SELECT a.i AS dx, b.i AS dy FROM range(-1, 2) AS a(i), range(-1, 2) AS b(i)) SELECT g.ix, g.iy, quantile_cont(c.zmax, 0.5)::DOUBLE AS median FROM g CROSS JOIN o CROSS JOIN x JOIN c ON c.ix = least(greatest(g.ix + dx, x0), x1) AND c.iy = least(greatest(g.iy + dy, y0), y1) GROUP BY 1, 2")
def median_filter_2d(spark, d):
    return rasters.median_filter(cells(spark, d), 3, "zmax").select("ix", "iy", F.col("median").cast("double").alias("median"))


@query(f"WITH {DENSE}, h AS (SELECT g.ix, g.iy, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (ix, iy)), k AS (SELECT i AS o, exp(-0.5 * i * i) / (SELECT sum(exp(-0.5 * j * j)) FROM range(-4, 5) AS r(j)) AS w FROM range(-4, 5) AS r(i)), a AS (SELECT g.ix, g.iy, sum(w * h.n) AS v FROM g, k, x, h WHERE h.iy = g.iy AND h.ix = x0 + CASE WHEN (g.ix + o - x0) % (2 * (x1 - x0 + 1)) < 0 THEN least(-((g.ix + o - x0) % (2 * (x1 - x0 + 1))) - 1, 2 * (x1 - x0 + 1) + (g.ix + o - x0) % (2 * (x1 - x0 + 1))) ELSE least((g.ix + o - x0) % (2 * (x1 - x0 + 1)), 2 * (x1 - x0 + 1) - 1 - (g.ix + o - x0) % (2 * (x1 - x0 + 1))) END GROUP BY 1, 2) SELECT g.ix, g.iy, round(sum(w * a.v), 6) AS smooth FROM g, k, x, a WHERE a.ix = g.ix AND a.iy = y0 + CASE WHEN (g.iy + o - y0) % (2 * (y1 - y0 + 1)) < 0 THEN least(-((g.iy + o - y0) % (2 * (y1 - y0 + 1))) - 1, 2 * (y1 - y0 + 1) + (g.iy + o - y0) % (2 * (y1 - y0 + 1))) ELSE least((g.iy + o - y0) % (2 * (y1 - y0 + 1)), 2 * (y1 - y0 + 1) - 1 - (g.iy + o - y0) % (2 * (y1 - y0 + 1))) END GROUP BY 1, 2")
def gaussian_2d(spark, d):
    return rasters.gaussian(cells(spark, d), 1.0, "n").select("ix", "iy", F.round("smooth", 6).alias("smooth"))


MASK = f"{CELLS}, m AS (SELECT ix, iy FROM c WHERE n >= 120)"


def mask(spark, d):
    return cells(spark, d).where("n >= 120").select("ix", "iy")


@query(f"WITH {MASK}, o(dx, dy) AS (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) SELECT DISTINCT ix + dx AS ix, iy + dy AS iy FROM m, o")
def dilate(spark, d):
    return rasters.dilate(mask(spark, d))


@query(f"WITH {MASK}, o(dx, dy) AS (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) SELECT ix, iy FROM (SELECT ix + dx AS ix, iy + dy AS iy FROM m, o) GROUP BY 1, 2 HAVING count(*) = 5")
def erode(spark, d):
    return rasters.erode(mask(spark, d))


VOID = f"{MASK}, x AS (SELECT min(ix) x0, max(ix) x1, min(iy) y0, max(iy) y1 FROM m), ax AS (SELECT unnest(range(x0, x1 + 1)) AS ix FROM x), ay AS (SELECT unnest(range(y0, y1 + 1)) AS iy FROM x), v AS (SELECT ax.ix, ay.iy FROM ax, ay WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.ix = ax.ix AND m.iy = ay.iy))"


@query(f"WITH RECURSIVE {VOID}, f AS (SELECT v.ix, v.iy FROM v, x WHERE v.ix IN (x0, x1) OR v.iy IN (y0, y1) UNION SELECT v.ix, v.iy FROM f JOIN v ON abs(v.ix - f.ix) + abs(v.iy - f.iy) = 1) SELECT ix, iy FROM v WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.ix = v.ix AND f.iy = v.iy)")
def fill_holes(spark, d):
    return rasters.enclosed(mask(spark, d)).select("ix", "iy")


@query(f"WITH RECURSIVE {MASK}, f AS (SELECT ix, iy, ix * 4294967296 + iy AS component FROM m UNION SELECT m.ix, m.iy, f.component FROM f JOIN m ON abs(m.ix - f.ix) + abs(m.iy - f.iy) = 1 WHERE f.component < m.ix * 4294967296 + m.iy) SELECT ix, iy, min(component)::BIGINT AS component FROM f GROUP BY 1, 2")
def connected_components(spark, d):
    return rasters.label(mask(spark, d))


@query(f"WITH {CELLS}, b AS (SELECT ix // 3 AS bx, iy // 3 AS by_, sum(zmax)::DOUBLE / count(*) AS block FROM c GROUP BY 1, 2) SELECT ix, iy, block FROM c JOIN b ON bx = ix // 3 AND by_ = iy // 3")
def block_mean(spark, d):
    return rasters.block_mean(cells(spark, d), 3, "zmax")


@query(f"WITH {CELLS}, {BOX}, e AS (SELECT c.ix, c.iy, (CASE WHEN c.ix = x0 THEN r.zmax - c.zmax WHEN c.ix = x1 THEN c.zmax - l.zmax ELSE (r.zmax - l.zmax) / 2.0::DOUBLE END) / 5.0::DOUBLE AS gx, (CASE WHEN c.iy = y0 THEN a.zmax - c.zmax WHEN c.iy = y1 THEN c.zmax - b.zmax ELSE (a.zmax - b.zmax) / 2.0::DOUBLE END) / 5.0::DOUBLE AS gy FROM c CROSS JOIN x LEFT JOIN c l ON l.ix = c.ix - 1 AND l.iy = c.iy LEFT JOIN c r ON r.ix = c.ix + 1 AND r.iy = c.iy LEFT JOIN c b ON b.iy = c.iy - 1 AND b.ix = c.ix LEFT JOIN c a ON a.iy = c.iy + 1 AND a.ix = c.ix) SELECT ix, iy, round(sqrt(gx * gx + gy * gy), 9) AS slope FROM e WHERE gx + gy IS NOT NULL")
def gradient_slope(spark, d):
    return rasters.slope(cells(spark, d), "zmax", 5.0).select("ix", "iy", F.round("slope", 9).alias("slope"))


@query(f"WITH {DENSE}, h AS (SELECT g.ix, g.iy, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (ix, iy)), o AS (SELECT a.i AS dx, b.i AS dy FROM range(-2, 3) AS a(i), range(-2, 3) AS b(i)), w AS (SELECT h.ix, h.iy, any_value(h.n) AS n, quantile_cont(e.n, 0.5) AS q FROM h CROSS JOIN o CROSS JOIN x JOIN h e ON e.ix = least(greatest(h.ix + dx, x0), x1) AND e.iy = least(greatest(h.iy + dy, y0), y1) GROUP BY 1, 2) SELECT ix, iy FROM w WHERE n > 0 AND n >= 0.95 * q")
def relative_density(spark, d):
    return landmarks.occupied(cells(spark, d), relative=0.95, window=5)


@query(f"WITH RECURSIVE {VOID}, f AS (SELECT v.ix, v.iy FROM v, x WHERE v.ix IN (x0, x1) OR v.iy IN (y0, y1) UNION SELECT v.ix, v.iy FROM f JOIN v ON abs(v.ix - f.ix) + abs(v.iy - f.iy) = 1), h AS (SELECT ix, iy FROM v WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.ix = v.ix AND f.iy = v.iy)), k AS (SELECT ix, iy, ix * 4294967296 + iy AS component FROM h UNION SELECT h.ix, h.iy, k.component FROM k JOIN h ON abs(h.ix - k.ix) + abs(h.iy - k.iy) = 1 WHERE k.component < h.ix * 4294967296 + h.iy), n AS (SELECT ix, iy, min(component)::BIGINT AS component FROM k GROUP BY 1, 2) SELECT component, count(*) AS n, count(*) * 25.0::DOUBLE AS area, round(avg(ix * 5 + 2.5), 6) AS x, round(avg(iy * 5 + 2.5), 6) AS y FROM n GROUP BY 1 HAVING count(*) <= 40")
def skylight_detect(spark, d):
    out = landmarks.voids(cells(spark, d), 5.0, (0.0, 0.0), least=120, max_area=1000.0)
    return out.select("component", "n", "area", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


# statistics


QS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


@query("SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(x, {q}), 4) AS p{round(q * 100)}" for q in QS) + " FROM pts GROUP BY 1")
def percentile_suite(spark, d):
    g = stats.grouped_percentiles(view(spark, d, "pts"), ["l_returnflag"], "x", QS)
    return g.select("l_returnflag", *[F.round(c, 4).alias(c) for c in g.columns[1:]])


@query("SELECT class, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 4) AS median, round(stddev_pop(value), 6) AS std, round(sqrt(avg(value * value)), 6) AS rms, min(value) AS least, max(value) AS greatest, max(value) - min(value) AS spread FROM stn GROUP BY 1")
def robust_stats(spark, d):
    g = view(spark, d, "stn").groupBy("class").agg(*stats.moments("value"))
    return g.withColumns({c: F.round(c, 4 if c == "median" else 6) for c in ("mean", "median", "std", "rms")})


@query("SELECT kind, count(*) AS n, round(2 * sqrt((var_samp(x) + var_samp(y)) / 2 + sqrt(pow((var_samp(x) - var_samp(y)) / 2, 2) + pow(covar_samp(x, y), 2))), 6) AS semi_major, round(2 * sqrt((var_samp(x) + var_samp(y)) / 2 - sqrt(pow((var_samp(x) - var_samp(y)) / 2, 2) + pow(covar_samp(x, y), 2))), 6) AS semi_minor FROM upts GROUP BY 1")
def cov_ellipse(spark, d):
    g = view(spark, d, "upts").groupBy("kind").agg(*stats.ellipse("x", "y"))
    return g.select("kind", "n", F.round("semi_major", 6).alias("semi_major"), F.round("semi_minor", 6).alias("semi_minor"))


@query("SELECT class, round(regr_slope(value, s), 9) AS slope, round(regr_intercept(value, s), 6) AS intercept, round(corr(value, s), 6) AS r FROM stn GROUP BY 1")
def ols_slope(spark, d):
    s = F.col("s").cast("double")
    return view(spark, d, "stn").withColumn("s", s).groupBy("class").agg(F.round(F.regr_slope("value", "s"), 9).alias("slope"), F.round(F.regr_intercept("value", "s"), 6).alias("intercept"), F.round(F.corr("value", "s"), 6).alias("r"))


@query("SELECT round((sxz * syy - syz * sxy) / (sxx * syy - sxy * sxy), 6) AS x, round((syz * sxx - sxz * sxy) / (sxx * syy - sxy * sxy), 6) AS y, round(mz - (sxz * syy - syz * sxy) / (sxx * syy - sxy * sxy) * mx - (syz * sxx - sxz * sxy) / (sxx * syy - sxy * sxy) * my, 5) AS constant FROM (SELECT var_pop(x) sxx, var_pop(y) syy, covar_pop(x, y) sxy, covar_pop(x, z) sxz, covar_pop(y, z) syz, avg(x) mx, avg(y) my, avg(z) mz FROM upts)")
def plane_fit(spark, d):
    f = stats.plane(view(spark, d, "upts"))
    return spark.createDataFrame([(round(f["x"], 6), round(f["y"], 6), round(f["constant"], 5))], "x double, y double, constant double")


@query()
def quadratic_fit(spark, d):
    f = stats.quadratic(view(spark, d, "upts"))
    return spark.createDataFrame([(k, v) for k, v in f.items()], "term string, value double")


@query("SELECT class, count(*) AS n, count(*) FILTER (WHERE value > 100) AS over, avg((value > 50)::INT) AS share FROM stn GROUP BY 1")
def class_counts(spark, d):
    return view(spark, d, "stn").groupBy("class").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 100).alias("over"), F.avg((F.col("value") > 50).cast("int")).alias("share"))


@query("SELECT cast(floor(s / 50) AS bigint) AS reach, count(*) AS n, round(median(value), 4) AS median FROM stn WHERE class <> 'click' GROUP BY 1 HAVING count(*) > 5")
def reach_medians(spark, d):
    g = view(spark, d, "stn").where("class <> 'click'").groupBy(F.floor(F.col("s") / 50).cast("long").alias("reach")).agg(F.count("*").alias("n"), F.round(F.median("value"), 4).alias("median"))
    return g.where("n > 5")


@query("WITH z(zone, lo, hi) AS (VALUES ('a', 0, 100), ('b', 100, 1000), ('c', 1000, 100000)) SELECT zone, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM stn JOIN z ON s >= lo AND s < hi GROUP BY 1")
def range_join_zones(spark, d):
    zones = spark.createDataFrame([("a", 0, 100), ("b", 100, 1000), ("c", 1000, 100000)], "zone string, lo long, hi long")
    met = relations.range_join(view(spark, d, "stn"), zones, "s", "lo", "hi")
    return met.groupBy("zone").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"))


@query("SELECT cast(least(floor((x - 0) / 5), 20) AS bigint) AS bin, count(*) AS n FROM pts WHERE x BETWEEN 0 AND 105 GROUP BY 1")
def fixed_histogram(spark, d):
    return stats.histogram(view(spark, d, "pts"), "x", 0.0, 105.0, 21)


@query("SELECT cast(floor(x / 10) AS bigint) AS bin, cast(sum(my * intensity) AS double) / sum(intensity) AS weighted FROM pts GROUP BY 1 HAVING sum(intensity) > 0")
def weighted_axis(spark, d):
    g = view(spark, d, "pts").groupBy(C.voxel("x", 10).alias("bin")).agg(F.sum(F.col("my") * F.col("intensity")).alias("a"), F.sum("intensity").alias("w"))
    return g.where("w > 0").select("bin", (F.col("a").cast("double") / F.col("w")).alias("weighted"))


DRAW = "d AS (SELECT b, k, ((((b * 7919 + k * 104729 + 7) * 16807) % 2147483647) * 48271 % 2147483647) % (n - BLOCK + 1) AS s, n FROM range(0, 40) AS p(b), (SELECT count(*) AS n FROM r) q, range(0, 100000) AS t(k) WHERE k * BLOCK < n), e AS (SELECT b, s + o AS i FROM d, range(0, BLOCK) AS u(o) WHERE k * BLOCK + o < n), m AS (SELECT b, quantile_cont(value, 0.5) AS m FROM e JOIN r ON r.i = e.i GROUP BY b) SELECT round(quantile_cont(m, 0.025), 4) AS p2, round(quantile_cont(m, 0.975), 4) AS p98, count(*) AS rounds FROM m"
BOOT = "WITH r AS (SELECT s AS i, value FROM stn), "


def _boot(spark, d, block):
    # stations are numbered from 0 without gaps: no window over all rows is needed
    rows = view(spark, d, "stn").select("s", "value")
    out = stats.bootstrap(rows, "s", "value", rows.count(), 40, block)
    return out.select(C.rounded("p2", 4).alias("p2"), C.rounded("p98", 4).alias("p98"), "rounds")


@query(BOOT + DRAW.replace("BLOCK", "1"))
def bootstrap_ci(spark, d):
    return _boot(spark, d, 1)


@query(BOOT + DRAW.replace("BLOCK", "10"))
def moving_block_ci(spark, d):
    return _boot(spark, d, 10)


# distance joins


D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
NEAR = f"k AS (SELECT a.pid, count(*) AS n FROM upts a JOIN upts b ON b.x BETWEEN a.x - 2 AND a.x + 2 AND b.y BETWEEN a.y - 2 AND a.y + 2 AND {D2} <= 4 GROUP BY 1)"


@query(f"WITH {NEAR} SELECT pid, n FROM k")
def radius_count(spark, d):
    return spatial.radius_count(view(spark, d, "upts"), 2.0)


@query(f"WITH {NEAR} SELECT u.pid, x, y, z FROM upts u JOIN k USING (pid) WHERE n >= 2")
def radius_outlier(spark, d):
    return spatial.radius_outliers(view(spark, d, "upts").select("pid", "x", "y", "z"), 2.0, 2)


#: Nobody's fourth neighbour is as far as 12.5 on an axis, so the band loses none.
KNN = "p AS (SELECT pid, x, y, z FROM upts), q AS (SELECT a.pid, sqrt(D2) AS d, row_number() OVER (PARTITION BY a.pid ORDER BY D2, b.pid) AS k FROM p a JOIN p b ON a.pid <> b.pid AND b.x BETWEEN a.x - 12.5 AND a.x + 12.5 AND b.y BETWEEN a.y - 12.5 AND a.y + 12.5), k AS (SELECT pid, avg(d) AS d FROM q WHERE k <= 4 GROUP BY 1)".replace("D2", D2)


@query(f"WITH {KNN} SELECT pid, round(d, 6) AS d FROM k")
def knn_mean_dist(spark, d):
    return spatial.knn(view(spark, d, "upts"), 4).groupBy("pid").agg(F.round(F.avg(F.sqrt("d2")), 6).alias("d"))


@query(f"WITH {KNN} SELECT p.pid, x, y, z FROM p JOIN k USING (pid) WHERE d <= (SELECT avg(d) + 1.5 * stddev_pop(d) FROM k)")
def statistical_outlier(spark, d):
    return spatial.statistical_outliers(view(spark, d, "upts").select("pid", "x", "y", "z"), 4, 1.5)


@query(f"WITH a AS (SELECT * FROM {ANCHOR_SQL}) SELECT a.pid, count(*) AS n, round(quantile_cont(b.z, 0.99), 4) AS p99 FROM a JOIN upts b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 100 GROUP BY 1")
def ball_query_p99(spark, d):
    near = spatial.ball_query(anchors(spark), view(spark, d, "upts").select("pid", "x", "y", "z"), 10.0)
    return near.groupBy(F.col("a.pid").cast("int").alias("pid")).agg(F.count("*").alias("n"), F.round(F.percentile("b.z", 0.99), 4).alias("p99"))


@query(f"WITH a AS (SELECT * FROM {ANCHOR_SQL}), q AS (SELECT b.pid, a.pid AS anchor, {D2} AS d2, row_number() OVER (PARTITION BY b.pid ORDER BY {D2}, a.pid) AS k FROM a, upts b) SELECT pid, anchor, round(d2, 6) AS d2 FROM q WHERE k = 1")
def nearest_anchor(spark, d):
    return spatial.nearest(view(spark, d, "upts"), anchors(spark)).select("pid", F.col("anchor").cast("int").alias("anchor"), F.round("d2", 6).alias("d2"))


@query(f"WITH f AS (SELECT * FROM upts WHERE kind = 'F'), o AS (SELECT * FROM upts WHERE kind = 'O'), q AS (SELECT a.pid, b.pid AS anchor, {D2} AS d2, row_number() OVER (PARTITION BY a.pid ORDER BY {D2}, b.pid) AS k FROM f a JOIN o b ON {D2} <= 4) SELECT pid, anchor, round(d2, 6) AS d2 FROM q WHERE k = 1")
def nearest_with_tolerance(spark, d):
    p = view(spark, d, "upts")
    return spatial.nearest(p.where("kind = 'F'"), p.where("kind = 'O'"), within=2.0).select("pid", "anchor", F.round("d2", 6).alias("d2"))


#: Landmarks made of all points: a middle for each of some classes.
MIDDLES = "(SELECT pid % 12 AS id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM upts GROUP BY 1)"


def middles(spark, d, classes=12):
    g = view(spark, d, "upts").groupBy((F.col("pid") % classes).alias("id"))
    return g.agg(*[F.avg(c).alias(c) for c in "xyz"])


@query(f"WITH m AS (SELECT * FROM {MIDDLES} AS upts_m) SELECT a.id AS a, b.id AS b, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)), 6) AS dist FROM m a JOIN m b ON a.id < b.id")
def pairwise_distance(spark, d):
    return landmarks.distances(middles(spark, d)).select("a", "b", F.round("dist", 6).alias("dist"))


GATE = f"t AS (SELECT * FROM {MIDDLES.replace('12', '60')} AS upts_t), p AS (SELECT a.id AS p, b.id AS q, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS d FROM t a, t b WHERE a.id <> b.id)"


@query(f"WITH {GATE} SELECT l.p AS a1, l.q AS a2, r.p AS b1, r.q AS b2 FROM p l JOIN p r ON abs(l.d - r.d) <= 0.05 WHERE l.p < l.q")
def pair_gate_join(spark, d):
    t = middles(spark, d, 60)
    return landmarks.gated_pairs(t, t, 0.05).select("a1", "a2", "b1", "b2")


OVALS = "(SELECT cast(floor(x / 4) * 100 + floor(y / 4) AS bigint) AS pid, avg(x) AS x, avg(y) AS y FROM upts GROUP BY 1) AS upts_o"


def ovals(spark, d):
    """A middle for each 4 x 4 square of all points."""
    square = (F.floor(F.col("x") / 4) * 100 + F.floor(F.col("y") / 4)).cast("long").alias("pid")
    return view(spark, d, "upts").groupBy(square).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


@query("WITH o AS (SELECT pid AS id, x, y, 2.0 + pid % 3 AS a, 1.0 + pid % 2 AS b FROM " + OVALS + ") SELECT l.id AS a, r.id AS b FROM o l JOIN o r ON l.id < r.id WHERE sqrt(pow(l.x - r.x, 2) + pow(l.y - r.y, 2)) <= l.a * l.b / sqrt(pow(l.b * cos(atan2(r.y - l.y, r.x - l.x)), 2) + pow(l.a * sin(atan2(r.y - l.y, r.x - l.x)), 2)) + r.a * r.b / sqrt(pow(r.b * cos(atan2(r.y - l.y, r.x - l.x)), 2) + pow(r.a * sin(atan2(r.y - l.y, r.x - l.x)), 2))")
def ellipse_merge(spark, d):
    h = ovals(spark, d).select(F.col("pid").alias("id"), "x", "y", (F.lit(2.0) + F.col("pid") % 3).alias("semi_major"), (F.lit(1.0) + F.col("pid") % 2).alias("semi_minor"), F.lit(0.0).alias("orientation"))
    return landmarks.overlaps(h, 1.0)


@query("SELECT pid, x FROM upts WHERE kind = 'F' AND pid NOT IN (SELECT pid FROM upts WHERE x < 50)")
def anti_setdiff(spark, d):
    p = view(spark, d, "upts")
    return p.where("kind = 'F'").join(p.where("x < 50").select("pid"), "pid", "left_anti").select("pid", "x")


@query("SELECT pid, x FROM upts WHERE pid IN (SELECT pid FROM upts WHERE y < 20)")
def semi_isin(spark, d):
    p = view(spark, d, "upts")
    return p.join(p.where("y < 20").select("pid"), "pid", "left_semi").select("pid", "x")


# stations


@query("WITH w AS (SELECT user_id, s, coalesce(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY s)), 0) AS step FROM stn) SELECT user_id, s, round(sum(step) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING), 6) AS arc FROM w")
def arc_length(spark, d):
    return curves.arc_length(view(spark, d, "stn"), "s", ["value"], ["user_id"]).select("user_id", "s", F.round("arc", 6).alias("arc"))


@query("SELECT user_id, s, CASE WHEN lag(value) OVER w IS NULL THEN lead(value) OVER w - value WHEN lead(value) OVER w IS NULL THEN value - lag(value) OVER w ELSE (lead(value) OVER w - lag(value) OVER w) / 2 END AS slope FROM stn WINDOW w AS (PARTITION BY user_id ORDER BY s)")
def centred_gradient(spark, d):
    return view(spark, d, "stn").select("user_id", "s", curves.gradient("value", "s", ["user_id"]).alias("slope"))


@query("WITH w AS (SELECT user_id, s, class, row_number() OVER (PARTITION BY user_id ORDER BY s) - row_number() OVER (PARTITION BY user_id, class ORDER BY s) AS k FROM stn) SELECT user_id, class, min(s) AS first, max(s) AS last, count(*) AS n FROM w GROUP BY user_id, class, k")
def islands(spark, d):
    runs = curves.islands(view(spark, d, "stn"), "s", "class", ["user_id"])
    return runs.groupBy("user_id", "run", "class").agg(F.min("s").alias("first"), F.max("s").alias("last"), F.count("*").alias("n")).drop("run")


@query("WITH w AS (SELECT user_id, s, value, max(value) OVER (PARTITION BY user_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM stn) SELECT user_id, s, top, coalesce(value >= top - 3, true) AS near_top FROM w")
def running_max_flag(spark, d):
    return curves.running_max_flag(view(spark, d, "stn"), "s", "value", 3.0, ["user_id"]).select("user_id", "s", "top", "near_top")


@query("WITH w AS (SELECT user_id, s, value, coalesce(sqrt(1.0 + pow(value - lag(value) OVER (PARTITION BY user_id ORDER BY k), 2)), 0) AS step, k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s) AS k FROM stn)), a AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS arc FROM w) SELECT user_id, s, round(CASE WHEN count(*) OVER f >= 0.9 * 5 THEN (last(arc) OVER f - first(arc) OVER f) / sqrt(pow(last(k) OVER f - first(k) OVER f, 2) + pow(last(value) OVER f - first(value) OVER f, 2)) END, 6) AS sinuosity FROM a WINDOW f AS (PARTITION BY user_id ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def sinuosity_window(spark, d):
    rows = view(spark, d, "stn").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("s")))
    return curves.sinuosity(rows, "k", ["k", "value"], 2, ["user_id"]).select("user_id", "s", F.round("sinuosity", 6).alias("sinuosity"))


@query("WITH u AS (SELECT user_id, s, value - avg(value) OVER (PARTITION BY user_id) AS dv, row_number() OVER (PARTITION BY user_id ORDER BY s) AS k FROM stn), q AS (SELECT user_id, sum(dv * dv) AS v, count(*) AS n FROM u GROUP BY 1), l AS (SELECT unnest(range(0, 4)) AS lag) SELECT q.user_id, lag, round(coalesce((SELECT sum(a.dv * b.dv) FROM u a JOIN u b ON a.user_id = b.user_id AND b.k = a.k + lag WHERE a.user_id = q.user_id), 0) / v, 6) AS rho FROM q, l WHERE v > 0.001")
def autocorr(spark, d):
    rows = view(spark, d, "stn")
    out = curves.autocorrelation(rows, "s", "value", 3, ["user_id"])
    several = rows.groupBy("user_id").agg(F.count("*").alias("n"), F.var_pop("value").alias("v")).where("n * v > 0.001").select("user_id")
    return out.join(several, "user_id", "left_semi").select("user_id", "lag", F.round("rho", 6).alias("rho"))


GAPS = "w AS (SELECT user_id, value, coalesce((value - lag(value) OVER (PARTITION BY user_id ORDER BY value) > 5)::INT, 0) AS new FROM stn), k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY value ROWS UNBOUNDED PRECEDING) AS cluster FROM w), n AS (SELECT user_id, cluster, count(*) AS n, median(value) AS r, max(value) AS top FROM k GROUP BY 1, 2 HAVING count(*) >= 3)"


@query(f"WITH {GAPS} SELECT user_id, n, round(r, 4) AS r, top FROM n WHERE (user_id, cluster) IN (SELECT user_id, min(cluster) FROM n GROUP BY 1)")
def gap_cluster_innermost(spark, d):
    out = curves.innermost_cluster(view(spark, d, "stn").select("user_id", "value"), "value", 5.0, 3, ["user_id"], [F.median("value").alias("r"), F.max("value").alias("top")])
    return out.select("user_id", "n", F.round("r", 4).alias("r"), "top")


@query("WITH w AS (SELECT user_id, s, value, row_number() OVER (PARTITION BY user_id ORDER BY s) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM stn), o AS (SELECT unnest(range(-1, 2)) AS o) SELECT a.user_id, a.s, quantile_disc(b.value, 0.5) AS median FROM w a CROSS JOIN o JOIN w b ON b.user_id = a.user_id AND b.k = least(greatest(a.k + o, 1), a.n) GROUP BY 1, 2")
def median_filter_1d(spark, d):
    return curves.median_filter(view(spark, d, "stn"), "s", "value", 1, ["user_id"]).select("user_id", "s", "median")


@query("SELECT class, s, (row_number() OVER (PARTITION BY class ORDER BY value, s))::DOUBLE / count(*) OVER (PARTITION BY class) AS share FROM stn")
def ecdf(spark, d):
    rows = view(spark, d, "stn").withColumn("at", F.struct("value", "s"))
    return curves.ecdf(rows, "at", ["class"]).select("class", "s", "share")


@query("WITH k AS (SELECT s, value FROM stn WHERE s % 10 = 0), a AS (SELECT s FROM stn WHERE s % 10 <> 0), q AS (SELECT a.s, (SELECT max(k.s) FROM k WHERE k.s <= a.s) AS lo, (SELECT min(k.s) FROM k WHERE k.s >= a.s) AS hi FROM a) SELECT q.s, round(CASE WHEN hi IS NULL THEN l.value ELSE l.value + (h.value - l.value) * (q.s - lo) / (hi - lo) END, 6) AS value FROM q JOIN k l ON l.s = lo LEFT JOIN k h ON h.s = hi")
def interp_join(spark, d):
    # a row's neighbours lie within its stretch of ten, whose ends are known: stretches are independent
    rows = view(spark, d, "stn").select("s", "value", F.floor(F.col("s") / 10).cast("long").alias("part"))
    known = rows.where("s % 10 = 0")
    both = known.unionAll(known.select("s", "value", (F.col("part") - 1).alias("part")))
    out = curves.interpolate(rows.where("s % 10 <> 0"), both, "s", "value", ["part"])
    return out.select("s", F.round("value", 6).alias("value"))


@query("WITH RECURSIVE p AS (SELECT user_id, s::DOUBLE AS s, value FROM stn), r AS (SELECT p.user_id, p.s, p.value, 0.0::DOUBLE AS length, 1::BIGINT AS kept FROM p JOIN (SELECT user_id, min(s) AS s FROM p GROUP BY 1) f ON f.user_id = p.user_id AND f.s = p.s UNION ALL SELECT user_id, s, value, length + CASE WHEN dist <= 4000 THEN dist ELSE 0 END, kept + 1 FROM (SELECT r.user_id, p.s, p.value, r.length, r.kept, sqrt((p.s - r.s) * (p.s - r.s) + (p.value - r.value) * (p.value - r.value)) AS dist, row_number() OVER (PARTITION BY r.user_id ORDER BY p.s) AS k FROM r JOIN p ON p.user_id = r.user_id AND p.s > r.s AND sqrt((p.s - r.s) * (p.s - r.s) + (p.value - r.value) * (p.value - r.value)) >= 50) n WHERE k = 1) SELECT user_id, round(max(length), 6) AS length, max(kept) AS kept FROM r GROUP BY 1")
def path_length(spark, d):
    rows = view(spark, d, "stn").select("user_id", F.col("s").cast("double").alias("s"), "value")
    return curves.kept_path(rows, "s", ["s", "value"], 50.0, 4000.0, ["user_id"]).withColumn("length", F.round("length", 6))


@query("SELECT user_id, first(value ORDER BY s) AS first, last(value ORDER BY s) AS last, last(value ORDER BY s) - first(value ORDER BY s) AS closure, max(value) - min(value) AS extent, min(s) FILTER (WHERE value = m) AS top_at FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS m FROM stn) GROUP BY 1")
def closure_extent(spark, d):
    a, b = F.min_by("value", "s"), F.max_by("value", "s")
    return view(spark, d, "stn").groupBy("user_id").agg(a.alias("first"), b.alias("last"), (b - a).alias("closure"), (F.max("value") - F.min("value")).alias("extent"), F.max_by("s", F.struct(F.col("value"), -F.col("s"))).alias("top_at"))


@query("SELECT user_id, class, count(*) AS n, min(s) AS first FROM stn GROUP BY 1, 2 ORDER BY n DESC, user_id, class LIMIT 40")
def topk_common(spark, d):
    return view(spark, d, "stn").groupBy("user_id", "class").agg(F.count("*").alias("n"), F.min("s").alias("first")).orderBy(F.desc("n"), "user_id", "class").limit(40)


@query("SELECT class, s, value FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY s) AS k FROM stn) WHERE k <= 40")
def cap_per_key(spark, d):
    w = Window.partitionBy("class").orderBy("s")
    return view(spark, d, "stn").withColumn("k", F.row_number().over(w)).where("k <= 40").select("class", "s", "value")


@query("SELECT class, max(value) FILTER (WHERE k = 1) AS best, max(value) FILTER (WHERE k = 2) AS second FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY value DESC, s) AS k FROM stn) GROUP BY 1")
def second_best(spark, d):
    w = Window.partitionBy("class").orderBy(F.desc("value"), "s")
    ranked = view(spark, d, "stn").withColumn("k", F.row_number().over(w)).where("k <= 2")
    return ranked.groupBy("class").agg(F.max(F.when(F.col("k") == 1, F.col("value"))).alias("best"), F.max(F.when(F.col("k") == 2, F.col("value"))).alias("second"))


@query("SELECT user_id, s, class FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s) AS k FROM stn) WHERE (k - 1) % 3 = 0 AND k <= 12")
def stride_sample(spark, d):
    w = Window.partitionBy("user_id").orderBy("s")
    return view(spark, d, "stn").withColumn("k", F.row_number().over(w)).where("(k - 1) % 3 = 0 and k <= 12").select("user_id", "s", "class")


# profiles and reports


STATION = "t AS (SELECT s, CASE WHEN s % 11 = 0 THEN NULL ELSE value - 20 END AS tau, s % 13 = 0 AS void, (s % 10) / 10.0::DOUBLE AS coverage, (s % 7) / 100.0::DOUBLE AS ghost, 5 + (s % 9) AS span FROM stn), k AS (SELECT *, CASE WHEN void THEN 'skylight' WHEN tau IS NULL THEN 'no_dem' WHEN coverage < 0.5 THEN 'low_coverage' WHEN ghost > 0.05 THEN 'multipass' WHEN tau <= 0 THEN 'inconsistent' ELSE 'intact' END AS class FROM t)"


def stations(spark, d):
    s = F.col("s")
    t = view(spark, d, "stn").select("s", F.when(s % 11 != 0, F.col("value") - 20).alias("tau"), (s % 13 == 0).alias("void"), ((s % 10) / 10.0).alias("coverage"), ((s % 7) / 100.0).alias("ghost"), (5 + s % 9).alias("span"))
    return t.withColumn("class", profiles.station_class(F.col("tau"), F.col("void"), F.col("coverage"), F.col("ghost")))


@query(f"WITH {STATION} SELECT s, class FROM k")
def roof_class(spark, d):
    return stations(spark, d).select("s", "class")


@query(f"WITH {STATION} SELECT s, round(0.5 * 2600 * 9.81 * span * span / tau / 1e6, 9) AS sigma FROM k WHERE class = 'intact' AND tau > 1.48")
def strength(spark, d):
    rows = stations(spark, d).where("class = 'intact' and tau > 1.48")
    return rows.select("s", F.round(C.strength(F.col("span"), F.col("tau")), 9).alias("sigma"))


@query(f"WITH {STATION} SELECT class, count(*) AS n, round(avg(tau * 2.6 / 10), 6) AS shielding, count(*) FILTER (WHERE tau > 30) AS over FROM k GROUP BY 1")
def exceedance(spark, d):
    return stations(spark, d).groupBy("class").agg(F.count("*").alias("n"), F.round(F.avg(F.col("tau") * 2.6 / 10), 6).alias("shielding"), F.count_if(F.col("tau") > 30).alias("over"))


REPORT = "o AS (SELECT l_returnflag || '.' || l_linestatus || '.' || cast(my AS varchar) AS key, cast(sum(mx) AS double) AS value FROM pts WHERE l_orderkey % 3 <> 0 GROUP BY 1), n AS (SELECT l_returnflag || '.' || l_linestatus || '.' || cast(my AS varchar) AS key, cast(sum(mx) AS double) AS value FROM pts WHERE l_orderkey % 3 <> 1 AND my < 40 GROUP BY 1)"
VERDICT = f"{REPORT}, v AS (SELECT coalesce(o.key, n.key) AS key, o.value AS old, n.value AS new, CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'removed' WHEN o.value = n.value THEN 'identical' WHEN abs(n.value - o.value) <= 1000 THEN 'within absolute' WHEN abs(n.value - o.value) <= 0.05 * abs(o.value) THEN 'within relative' ELSE 'changed' END AS verdict FROM o FULL JOIN n ON o.key = n.key)"


def _compared(spark, d):
    p = view(spark, d, "pts").withColumn("key", F.concat_ws(".", "l_returnflag", "l_linestatus", F.col("my").cast("string")))
    part = lambda q: p.where(q).groupBy("key").agg(F.sum("mx").cast("double").alias("value"))
    return reports.compare(part("l_orderkey % 3 <> 0"), part("l_orderkey % 3 <> 1 and my < 40"), 1000.0, 0.05)


@query(f"WITH {VERDICT} SELECT key, old, new, verdict FROM v")
def full_outer_diff(spark, d):
    return _compared(spark, d)


@query(f"WITH {VERDICT} SELECT verdict, count(*) AS n FROM v GROUP BY 1")
def tolerance_verdict(spark, d):
    return _compared(spark, d).groupBy("verdict").agg(F.count("*").alias("n"))


@query("WITH g AS (SELECT dx, dy, u.pid, abs(u.z * 10 - c.zmax) AS e FROM upts u, (SELECT a.i AS dx, b.i AS dy FROM range(-1, 2) AS a(i), range(-1, 2) AS b(i)) o, (SELECT cast(floor(x / 5) AS bigint) AS ix, cast(floor(y / 5) AS bigint) AS iy, max(mz) AS zmax FROM pts GROUP BY 1, 2) c WHERE c.ix = cast(floor(u.x / 5) AS bigint) + dx AND c.iy = cast(floor(u.y / 5) AS bigint) + dy) SELECT dx, dy, count(*) AS n, cast(sum(e) AS double) AS cost FROM g GROUP BY 1, 2 ORDER BY cost / n, dx, dy LIMIT 1")
def shift_search(spark, d):
    cost = geometry.shift_search(view(spark, d, "upts"), cells(spark, d), "zmax", 5.0, (0.0, 0.0), 1, 10.0)
    return cost.orderBy(F.col("cost") / F.col("n"), "dx", "dy").limit(1)


@query("WITH k AS (SELECT pid % 50 AS key, pid AS item, round(x * 100) AS rms FROM upts) SELECT key, min(rms) AS rms, (min([rms, item]))[2]::BIGINT AS item FROM k GROUP BY 1")
def best_per_set(spark, d):
    k = view(spark, d, "upts").select((F.col("pid") % 50).alias("key"), F.col("pid").alias("item"), F.round(F.col("x") * 100).alias("rms"))
    return k.groupBy("key").agg(F.min("rms").alias("rms"), F.min_by("item", F.struct("rms", "item")).alias("item"))


@query("SELECT DISTINCT least(pid % 10, pid % 7) AS a, greatest(pid % 10, pid % 7) AS b FROM upts")
def dedupe_set(spark, d):
    s = F.array_sort(F.array(F.col("pid") % 10, F.col("pid") % 7))
    return view(spark, d, "upts").select(s.alias("s")).dropDuplicates(["s"]).select(F.col("s")[0].alias("a"), F.col("s")[1].alias("b"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
