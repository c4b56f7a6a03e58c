"""Named queries of relations, openings and whole surveys."""

from __future__ import annotations

from pyspark.sql import functions as F

from karst.operators import curves, landmarks, rasters, relations, surveys
from karst.plans import matched, more, neighbours, sequences, tiled, written  # noqa: F401  their queries are kept with the others
from karst.plans.queries import ANCHOR_SQL, CELLS, DENSE, MASK, MIDDLES, ORACLES, QUERIES, cells, middles, query
from karst.plans.views import view

# filters and joins


@query("SELECT pid, x, y FROM upts WHERE sqrt(pow(x - 50, 2) + pow(y - 40, 2)) < 12")
def disc_strict(spark, d):
    return relations.disc(view(spark, d, "upts"), 50, 40, 12).select("pid", "x", "y")


@query("WITH p AS (SELECT pid, (x - 20) * 0.6 + (y - 30) * 0.8 AS along, (y - 30) * 0.6 - (x - 20) * 0.8 AS across FROM upts) SELECT pid, round(along, 6) AS along, round(across, 6) AS across FROM p WHERE along BETWEEN -5 AND 40 AND abs(across) <= 3")
def oriented_strip(spark, d):
    out = relations.strip(view(spark, d, "upts"), 20, 30, (3, 4), (-5, 40), 3)
    return out.select("pid", F.round("along", 6).alias("along"), F.round("across", 6).alias("across"))


HOLES = "h AS (SELECT id, x, y, 1.0 + id % 3 AS semi_major FROM " + MIDDLES + " AS upts_h)"


def holes(spark, d):
    return middles(spark, d).select("id", "x", "y", (F.lit(1.0) + F.col("id") % 3).alias("semi_major"))


@query(f"WITH {HOLES} SELECT f.f::DOUBLE AS f, u.pid FROM upts u, (VALUES (1.2), (1.6), (2.0)) AS f(f) WHERE EXISTS (SELECT 1 FROM h WHERE sqrt(pow(u.x - h.x, 2) + pow(u.y - h.y, 2)) <= f.f * h.semi_major)")
def aperture_screen(spark, d):
    p, h = view(spark, d, "upts").select("pid", "x", "y"), holes(spark, d)
    parts = [relations.aperture_screen(p, h, k).where("screened").select(F.lit(k).alias("f"), "pid") for k in (1.2, 1.6, 2.0)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("SELECT user_id, s, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s) AS a, row_number() OVER (PARTITION BY user_id ORDER BY s DESC) AS b FROM stn) WHERE a > 3 AND b > 3")
def trimmed_ends(spark, d):
    return relations.trimmed(view(spark, d, "stn"), "s", 3, ["user_id"]).select("user_id", "s", "value")


@query("WITH n AS (SELECT user_id, s, (value > 30)::BIGINT AS n FROM stn) SELECT user_id, s, n FROM n WHERE s <= (SELECT max(m.s) FROM n m WHERE m.n > 0 AND m.user_id = n.user_id)")
def trailing_empty(spark, d):
    rows = view(spark, d, "stn").select("user_id", "s", (F.col("value") > 30).cast("long").alias("n"))
    return relations.without_empty_end(rows, "s", "n", ["user_id"])


@query("WITH k AS (SELECT user_id, s, value FROM stn WHERE s % 7 = 0), q AS (SELECT a.user_id, a.s, k.value, abs(a.s - k.s) AS gap, row_number() OVER (PARTITION BY a.s ORDER BY abs(a.s - k.s), k.s) AS r FROM stn a JOIN k USING (user_id) WHERE a.s % 7 <> 0) SELECT user_id, s, value AS near_value, gap FROM q WHERE r = 1")
def nearest_key(spark, d):
    s = view(spark, d, "stn").select("user_id", "s", "value")
    out = relations.nearest_key(s.where("s % 7 <> 0").select("user_id", "s"), s.where("s % 7 = 0"), "s", "value", ["user_id"])
    return out.where("near_value is not null")


@query(f"WITH a AS (SELECT * FROM {ANCHOR_SQL}), q AS (SELECT a.pid AS station, u.pid, pow(u.x - a.x, 2) + pow(u.y - a.y, 2) AS d2, row_number() OVER (PARTITION BY a.pid ORDER BY (a.x - u.x) * (a.x - u.x) + (a.y - u.y) * (a.y - u.y), u.pid) AS place FROM a JOIN upts u ON (a.x - u.x) * (a.x - u.x) + (a.y - u.y) * (a.y - u.y) <= 64) SELECT station, pid, round(d2, 6) AS d2, place FROM q WHERE place <= 3")
def nearest_rows(spark, d):
    from karst.plans.queries import anchors

    out = relations.nearest_rows(anchors(spark), view(spark, d, "upts").select("pid", "x", "y"), 3, 8.0)
    return out.select(F.col("station").cast("int").alias("station"), "pid", F.round("d2", 6).alias("d2"), F.col("place").cast("long").alias("place"))


@query("WITH t AS (SELECT s, (s * 37 % 100)::DOUBLE AS x, (s * 91 % 100)::DOUBLE AS y FROM stn), i AS (SELECT cast(floor(x) AS bigint) AS ix, cast(floor(y) AS bigint) AS iy, min(z) AS v FROM upts GROUP BY 1, 2), o AS (SELECT side, r FROM (VALUES (1), (-1)) AS a(side), range(1, 7) AS b(r)) SELECT s, side, min(r)::INTEGER AS r FROM t, o, i WHERE i.v < 6 AND i.ix = cast(floor(t.x - side * r * 0.8 + 0.5) AS bigint) AND i.iy = cast(floor(t.y + side * r * 0.6 + 0.5) AS bigint) GROUP BY 1, 2")
def first_dark(spark, d):
    t = view(spark, d, "stn").select("s", (F.col("s") * 37 % 100).cast("double").alias("x"), (F.col("s") * 91 % 100).cast("double").alias("y"), F.lit(0.6).alias("tx"), F.lit(0.8).alias("ty"))
    image = view(spark, d, "upts").groupBy(F.floor("x").cast("long").alias("ix"), F.floor("y").cast("long").alias("iy")).agg(F.min("z").alias("v"))
    return relations.first_dark(t, image, 6, 6.0)


@query("SELECT pid, round(x, 6) AS x, round(0.8 * y - 0.6 * z, 6) AS y, round(0.6 * y + 0.8 * z, 6) AS z FROM upts")
def up_frame(spark, d):
    out = relations.up_frame(view(spark, d, "upts").select("pid", "x", "y", "z"), (0, 0.6, 0.8))
    return out.select("pid", *[F.round(c, 6).alias(c) for c in "xyz"])


@query(f"WITH {CELLS} SELECT ix, iy, round(zmax + 2.5 * greatest(1 - (pow(ix - 10, 2) + pow(iy - 10, 2)) / 64.0, 0), 6) AS z FROM c")
def domed_dem(spark, d):
    z = relations.domed(F.col("zmax").cast("double"), F.col("ix"), F.col("iy"), (10, 10), 2.5, 8)
    return cells(spark, d).select("ix", "iy", F.round(z, 6).alias("z"))


@query(f"WITH {CELLS} SELECT u.pid, round(least(greatest((zmax / 10.0::DOUBLE - u.z) / 8, 0), 1), 6) AS share FROM upts u JOIN c ON c.ix = cast(floor(u.x / 5) AS bigint) AND c.iy = cast(floor(u.y / 5) AS bigint)")
def depth_ramp(spark, d):
    from karst.functions import columns as C

    met = rasters.lookup(view(spark, d, "upts"), cells(spark, d).select("ix", "iy", "zmax"), C.cell("x", 0, 5), C.cell("y", 0, 5)).where("zmax is not null")
    return met.select("pid", F.round(relations.depth_ramp(F.col("z"), F.col("zmax") / 10, 8.0), 6).alias("share"))


@query("SELECT event_id, round(epoch_us(ts) / 1e6 - min(epoch_us(ts)) OVER (PARTITION BY user_id) / 1e6, 3) AS seconds FROM events")
def relative_seconds(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "ts")
    return surveys.since_first(rows, "ts", ["user_id"]).select("event_id", F.round("seconds", 3).alias("seconds"))


@query("SELECT DISTINCT p_brand, lower(trim(regexp_replace(regexp_replace(replace(p_brand, '#', 'OfType'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_\\-]+', ' ', 'g'))) AS words FROM part")
def camel_words(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_brand", F.replace("p_brand", F.lit("#"), F.lit("OfType")).alias("name")).distinct()
    return p.select("p_brand", surveys.words_of_name("name").alias("words"))


@query("SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, cast(sum(n) AS bigint) AS n, count(*) AS cells, round(sum(n) / (count(*) * 4.0), 6) AS per_m2 FROM (SELECT floor(x / 2), floor(y / 2), min(x) AS x, count(*) AS n, min(y) AS y FROM upts GROUP BY 1, 2)".replace("max(x) AS x1", "(SELECT max(x) FROM upts) AS x1").replace("max(y) AS y1", "(SELECT max(y) FROM upts) AS y1"))
def extent_density(spark, d):
    return surveys.columns_of(view(spark, d, "upts"), 2.0).withColumn("per_m2", F.round("per_m2", 6))


@query("WITH u AS (SELECT user_id, value - avg(value) OVER (PARTITION BY user_id) AS dv, row_number() OVER (PARTITION BY user_id ORDER BY s) AS k FROM stn), q AS (SELECT user_id, sum(dv * dv) AS v, count(*) AS n FROM u GROUP BY 1), l AS (SELECT unnest(range(0, 4)) AS lag), r AS (SELECT q.user_id, lag, any_value(n) AS n, sum(a.dv * b.dv) / any_value(v) AS rho FROM q CROSS JOIN l JOIN u a ON a.user_id = q.user_id JOIN u b ON b.user_id = a.user_id AND b.k = a.k + lag WHERE v > 0 GROUP BY 1, 2), f AS (SELECT user_id, any_value(n) AS n, min(lag) FILTER (WHERE rho < exp(-1.0)) AS decay, min(lag) FILTER (WHERE rho < 0) AS negative FROM r GROUP BY 1) SELECT f.user_id, f.n, round(f.n / (1 + 2 * coalesce(sum(rho) FILTER (WHERE lag > 0 AND lag < coalesce(negative, 4)), 0)), 6) AS n_eff, decay::DOUBLE AS decay, negative::DOUBLE AS negative FROM f JOIN r USING (user_id) GROUP BY f.user_id, f.n, decay, negative")
def effective_size(spark, d):
    out = curves.effective_size(view(spark, d, "stn"), "s", "value", 3, ["user_id"])
    return out.select("user_id", "n", F.round("n_eff", 6).alias("n_eff"), F.col("decay").cast("double").alias("decay"), F.col("negative").cast("double").alias("negative"))


# elevations and openings


@query(f"WITH {DENSE}, f AS (SELECT ix, iy, z FROM (SELECT g.ix, g.iy, c.zmax AS z, row_number() OVER (PARTITION BY g.ix, g.iy ORDER BY pow(c.ix - g.ix, 2) + pow(c.iy - g.iy, 2), c.ix, c.iy) AS k FROM g, c) WHERE k = 1), o AS (SELECT a.i AS dx, b.i AS dy FROM range(-1, 2) AS a(i), range(-1, 2) AS b(i)) SELECT c.ix, c.iy, quantile_cont(f.z, 0.5)::DOUBLE AS z FROM c CROSS JOIN o CROSS JOIN x JOIN f ON f.ix = least(greatest(c.ix + dx, x0), x1) AND f.iy = least(greatest(c.iy + dy, y0), y1) GROUP BY 1, 2")
def dem_median(spark, d):
    return rasters.dem(cells(spark, d)).select("ix", "iy", F.col("zmax").alias("z"))


CEILING = f"{DENSE}, o AS (SELECT ix, iy, zmax::DOUBLE AS h FROM c WHERE n >= 100), hm AS (SELECT median(h) AS m FROM o), ox AS (SELECT min(ix) x0, max(ix) x1, min(iy) y0, max(iy) y1 FROM o), gx AS (SELECT unnest(range(x0, x1 + 1)) AS ix FROM ox), gy AS (SELECT unnest(range(y0, y1 + 1)) AS iy FROM ox), e AS (SELECT gx.ix, gy.iy, coalesce(o.h, hm.m) AS h FROM gx CROSS JOIN gy CROSS JOIN hm LEFT JOIN o ON o.ix = gx.ix AND o.iy = gy.iy), w AS (SELECT a.i AS dx, b.i AS dy FROM range(-3, 4) AS a(i), range(-3, 4) AS b(i)), l AS (SELECT o.ix, o.iy, any_value(o.h) AS h, quantile_cont(e.h, 0.5) AS q FROM o CROSS JOIN w CROSS JOIN ox JOIN e ON e.ix = least(greatest(o.ix + dx, x0), x1) AND e.iy = least(greatest(o.iy + dy, y0), y1) GROUP BY 1, 2), v AS (SELECT e.ix, e.iy FROM e WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.ix = e.ix AND o.iy = e.iy)), r AS (SELECT v.ix, v.iy FROM v, ox WHERE v.ix IN (x0, x1) OR v.iy IN (y0, y1) UNION SELECT v.ix, v.iy FROM r JOIN v ON abs(v.ix - r.ix) + abs(v.iy - r.iy) = 1)"


@query(f"WITH RECURSIVE {CEILING} SELECT ix, iy FROM l WHERE abs(h - q) > 2 UNION SELECT ix, iy FROM v WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.ix = v.ix AND r.iy = v.iy)")
def ceiling_detect(spark, d):
    return landmarks.ceiling_cells(cells(spark, d), 2.0, least=100)


#: Holes of the cells with few points, labelled; ellipses of a circle's radius reach each other within twice their sum here.
HOLE = f"{MASK}, i AS (SELECT ix, iy FROM c WHERE n < 120), f AS (SELECT ix, iy, ix * 4294967296 + iy AS component FROM i UNION SELECT i.ix, i.iy, f.component FROM f JOIN i ON abs(i.ix - f.ix) + abs(i.iy - f.iy) = 1 WHERE f.component < i.ix * 4294967296 + i.iy), k AS (SELECT ix, iy, min(component)::BIGINT AS component FROM f GROUP BY 1, 2), s AS (SELECT component, count(*) AS n, avg(ix * 5 + 2.5) AS x, avg(iy * 5 + 2.5) AS y FROM k GROUP BY 1)"


@query(f"WITH RECURSIVE {HOLE}, t AS (SELECT k.component, median(b.zsum::DOUBLE / b.n) AS z FROM (SELECT DISTINCT k.component, k.ix + o.a AS ix, k.iy + o.b AS iy FROM k, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) AS o(a, b)) k JOIN c b USING (ix, iy) GROUP BY 1) SELECT component, n, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM s LEFT JOIN t USING (component)")
def hole_levels(spark, d):
    c = cells(spark, d)
    found = rasters.label(c.where("n < 120").select("ix", "iy"))
    return landmarks.holes_of(found, c, 5.0, (0.0, 0.0)).select("component", "n", *[F.round(v, 6).alias(v) for v in "xyz"])


def _circles(spark, d):
    """Circles about the middles of 5 x 5 cells."""
    return cells(spark, d).where("n >= 60").select((F.col("ix") * 1000 + F.col("iy")).alias("id"), (F.col("ix") * 5 + 2.5).alias("x"), (F.col("iy") * 5 + 2.5).alias("y"), (F.lit(1.0) + F.col("n") % 3).alias("semi_major"), (F.lit(1.0) + F.col("n") % 3).alias("semi_minor"), F.lit(0.0).alias("orientation"))


@query(f"WITH RECURSIVE {CELLS}, h AS (SELECT ix * 1000 + iy AS id, ix * 5 + 2.5 AS x, iy * 5 + 2.5 AS y, 1.0 + n % 3 AS r FROM c WHERE n >= 60), l AS (SELECT a.id AS a, b.id AS b FROM h a JOIN h b ON a.id <> b.id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 1.1 * (a.r + b.r)), f AS (SELECT id, id AS root FROM h UNION SELECT l.b, f.root FROM f JOIN l ON l.a = f.id WHERE f.root < l.b) SELECT id AS node, min(root) AS root FROM f GROUP BY 1")
def hole_merge(spark, d):
    from karst.operators import graphs

    h = _circles(spark, d)
    return graphs.components(h, landmarks.overlaps(h, 1.1))


# surveys


ROOF = f"{CELLS}, {HOLES}, t AS (SELECT s, (s * 37 % 1000) / 10.0::DOUBLE AS x, (s * 91 % 1000) / 10.0::DOUBLE AS y, value / 10 AS z_ceil, 5 + s % 9 AS width, (s % 10) / 10.0::DOUBLE AS coverage FROM stn), e AS (SELECT t.*, c.zmax / 10.0::DOUBLE AS z_dem FROM t LEFT JOIN c ON c.ix = cast(trunc(t.x / 5) AS bigint) AND c.iy = cast(trunc(t.y / 5) AS bigint)), k AS (SELECT e.s, count(*) AS n, avg((u.z > e.z_dem + 1)::INT) AS share FROM e JOIN upts u ON u.x BETWEEN e.x - 4 AND e.x + 4 AND u.y BETWEEN e.y - 4 AND e.y + 4 AND (e.x - u.x) * (e.x - u.x) + (e.y - u.y) * (e.y - u.y) <= 16 WHERE z_dem IS NOT NULL GROUP BY 1), q AS (SELECT e.s, width, z_dem - z_ceil AS tau, coverage, CASE WHEN z_dem IS NULL THEN NULL WHEN n >= 50 THEN share ELSE 0 END AS ghost, EXISTS (SELECT 1 FROM h WHERE sqrt(pow(e.x - h.x, 2) + pow(e.y - h.y, 2)) <= 1.6 * greatest(h.semi_major, 1)) AS void FROM e LEFT JOIN k USING (s)), r AS (SELECT *, CASE WHEN void THEN 'skylight' WHEN tau IS NULL THEN 'no_dem' WHEN coverage < 0.5 THEN 'low_coverage' WHEN coalesce(ghost, 0) > 0.05 THEN 'multipass' WHEN tau <= 0 THEN 'inconsistent' ELSE 'intact' END AS class FROM q)"


def _roof(spark, d):
    s = F.col("s")
    t = view(spark, d, "stn").select("s", (s * 37 % 1000 / 10.0).alias("x"), (s * 91 % 1000 / 10.0).alias("y"), (F.col("value") / 10).alias("z_ceil"), (5 + s % 9).alias("width"), (s % 10 / 10.0).alias("coverage"))
    dem = cells(spark, d).select("ix", "iy", (F.col("zmax") / 10).alias("zmax"))
    return surveys.roof(t, dem, (0.0, 0.0), 5.0, view(spark, d, "upts"), holes(spark, d))


@query(f"WITH {ROOF} SELECT s, round(tau, 6) AS tau, round(ghost, 6) AS ghost_frac, class FROM r")
def roof_thickness(spark, d):
    return _roof(spark, d).select("s", F.round("tau", 6).alias("tau"), F.round("ghost_frac", 6).alias("ghost_frac"), "class")


@query(f"WITH {ROOF}, i AS (SELECT *, tau / width AS ratio FROM r WHERE class = 'intact') SELECT (SELECT count(*) FROM r) AS n_stations, " + ", ".join(f"(SELECT count(*) FROM r WHERE class = '{c}') AS n_{c}" for c in ("intact", "skylight", "no_dem", "low_coverage", "multipass", "inconsistent")) + ", round(min(tau), 6) AS tau_min, round(median(tau), 6) AS tau_median, round(max(tau), 6) AS tau_max, round(min(ratio), 6) AS kappa, (SELECT s FROM i ORDER BY ratio, s LIMIT 1) AS kappa_s, round(median(tau * 260), 4) AS shielding, round(median(tau * 260) / 1033, 6) AS atmospheres FROM i")
def roof_summary(spark, d):
    out = surveys.roof_summary(_roof(spark, d))
    return out.withColumns({c: F.round(c, 4 if c == "shielding" else 6) for c in ("tau_min", "tau_median", "tau_max", "kappa", "shielding", "atmospheres")})


@query("WITH t AS (SELECT user_id, s, value, (s % 10) / 10.0::DOUBLE AS coverage, row_number() OVER (PARTITION BY user_id ORDER BY s) AS a, row_number() OVER (PARTITION BY user_id ORDER BY s DESC) AS b FROM stn), w AS (SELECT user_id, count(*) AS n_sections FROM t GROUP BY 1), k AS (SELECT user_id, count(*) AS n_valid, min(value) AS value_least, round(quantile_cont(value, 0.05), 4) AS value_p5, round(quantile_cont(value, 0.25), 4) AS value_q25, round(quantile_cont(value, 0.5), 4) AS value_median, round(quantile_cont(value, 0.75), 4) AS value_q75, round(quantile_cont(value, 0.95), 4) AS value_p95, max(value) AS value_greatest FROM t WHERE a > 3 AND b > 3 AND coverage >= 0.5 GROUP BY 1) SELECT * FROM w LEFT JOIN k USING (user_id)")
def morphometry_summary(spark, d):
    rows = view(spark, d, "stn").select("user_id", "s", "value", (F.col("s") % 10 / 10.0).alias("coverage"))
    out = surveys.morphometry(rows, "s", ["value"], ["user_id"])
    return out.withColumns({f"value_{c}": F.round(f"value_{c}", 4) for c in ("p5", "q25", "median", "q75", "p95")})


@query("WITH m AS (SELECT l_returnflag AS f, cast(floor(x / 5) AS bigint) AS ix, cast(floor(y / 5) AS bigint) AS iy, max(mz) AS z FROM pts GROUP BY 1, 2, 3), b AS (SELECT n.z - o.z AS dz FROM m o JOIN m n ON n.ix = o.ix AND n.iy = o.iy WHERE o.f = 'A' AND n.f = 'N') SELECT count(*) AS n, median(dz)::DOUBLE AS median, round(stddev_pop(dz), 6) AS std, 0.2::DOUBLE AS worst, coalesce(stddev_pop(dz) < 0.05 AND 0.2 < 0.5, false) AS passed FROM b")
def datum_decision(spark, d):
    from karst.operators import points

    p = view(spark, d, "pts").select("l_returnflag", "x", "y", F.col("mz").alias("z"))
    old, new = (points.grid(p.where(F.col("l_returnflag") == f), 5.0, (0.0, 0.0)) for f in "AN")
    out = surveys.datum(old, new, "zmax", shifts=(0.1, -0.2))
    return out.withColumns({"std": F.round("std", 6), "median": F.col("median").cast("double")})


FLOOR = "a AS (SELECT pid, x, y, z FROM upts WHERE kind = 'F' AND sqrt(pow(x - 50, 2) + pow(y - 50, 2)) < 25), t AS (SELECT x, y, z FROM upts WHERE kind = 'O' AND sqrt(pow(x - 50, 2) + pow(y - 50, 2)) < 25), i AS (SELECT * FROM a WHERE z < (SELECT quantile_cont(z, 0.9) FROM a) - 3), n AS (SELECT i.pid, i.x, i.y, i.z, t.z AS tz, quantile_cont(t.z, 0.3) OVER (PARTITION BY i.pid) AS p, count(*) OVER (PARTITION BY i.pid) AS n FROM i JOIN t ON (i.x - t.x) * (i.x - t.x) + (i.y - t.y) * (i.y - t.y) <= 9)"


@query(f"WITH {FLOOR} SELECT pid, round(any_value(z) - median(tz), 6) AS dz, round(any_value(sqrt(pow(x - 50, 2) + pow(y - 50, 2))), 6) AS r FROM n WHERE n >= 5 AND tz < p GROUP BY 1")
def floor_through_opening(spark, d):
    u = view(spark, d, "upts")
    out = surveys.floor_residuals(u.where("kind = 'F'"), u.where("kind = 'O'"), 50, 50, 25.0, 3.0, 3.0)
    return out.select("pid", F.round("dz", 6).alias("dz"), F.round("r", 6).alias("r"))


@query(f"WITH {ROOF}, i AS (SELECT r.tau, e.z_dem, e.z_ceil FROM r JOIN e USING (s) WHERE class = 'intact'), lv AS (SELECT avg(z_ceil) AS c, avg(tau) AS t FROM i) SELECT count(*) AS n, round(var_pop(tau), 6) AS var_tau, round(var_pop(z_dem), 6) AS var_dem, round(var_pop(z_ceil), 6) AS var_ceil, round(var_pop(z_dem) / var_pop(tau), 6) AS dem_share, round(corr(tau, z_dem), 6) AS corr_dem, round(corr(tau, z_dem - c), 6) AS level_r, round(1 - sum(pow(tau - (z_dem - c), 2)) / sum(pow(tau - t, 2)), 6) AS level_r2, round(sqrt(avg(pow(tau - (z_dem - c), 2))), 6) AS level_rms FROM i, lv")
def terrain_shares(spark, d):
    out = surveys.terrain(_roof(spark, d).where("class = 'intact'"))
    return out.select("n", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("WITH w AS (SELECT user_id, s, cast(round(value * 100) AS bigint) AS value, class, row_number() OVER (PARTITION BY user_id ORDER BY s) - row_number() OVER (PARTITION BY user_id, class ORDER BY s) AS k FROM stn), r AS (SELECT user_id, min(s) AS first, max(s) AS last FROM w WHERE class = 'purchase' GROUP BY user_id, k) SELECT r.user_id, first, last, round(avg(w.value) FILTER (WHERE abs(w.s - (first + last) / 2.0::DOUBLE) < 250) - avg(w.value) FILTER (WHERE abs(w.s - (first + last) / 2.0::DOUBLE) > 600), 4) AS d_value FROM r JOIN w USING (user_id) GROUP BY 1, 2, 3")
def run_contrast(spark, d):
    rows = view(spark, d, "stn").select("user_id", "s", F.round(F.col("value") * 100).cast("long").alias("value"), "class")
    runs = surveys.runs_of(rows, "s", "class", "purchase", ["user_id"])
    return surveys.contrast(rows, runs, "s", ["value"], ["user_id"], 250, 600).withColumn("d_value", F.round("d_value", 4))


ROAD = "t AS (SELECT k AS s, 10 + 2.5::DOUBLE * k * 0.8 AS x, 5 + 2.5::DOUBLE * k * 0.6 AS y, 0.8::DOUBLE AS tx, 0.6::DOUBLE AS ty, 20 + k::DOUBLE AS z_dem FROM range(0, 60) AS r(k))"


@query(f"WITH {ROAD}, p AS (SELECT t.s, u.z FROM t JOIN upts u ON abs((u.x - t.x) * tx + (u.y - t.y) * ty) <= 1.25 AND abs((u.y - t.y) * tx - (u.x - t.x) * ty) <= 4), l AS (SELECT s, count(*) AS n, quantile_cont(z, 0.99) AS p99, max(z) AS highest, quantile_cont(z, 0.01) AS p1 FROM p GROUP BY 1), f AS (SELECT t.s, z_dem, coalesce(n, 0) AS n, CASE WHEN n >= 5 THEN p99 END AS p99, CASE WHEN n >= 5 THEN highest END AS highest, CASE WHEN n >= 5 THEN p1 END AS p1 FROM t LEFT JOIN l USING (s)) SELECT s, n, round(p99, 6) AS p99, highest, round(p1, 6) AS p1, round(z_dem - p99, 6) AS overburden, coalesce(p99 >= coalesce(max(p99) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-infinity'::DOUBLE) - 3, false) AS roof_sampled FROM f WHERE s <= (SELECT max(s) FROM f WHERE n > 0)")
def road_cells(spark, d):
    k = F.col("id")
    t = spark.range(60).select(k.alias("s"), (10 + F.lit(2.5) * k * 0.8).alias("x"), (5 + F.lit(2.5) * k * 0.6).alias("y"), F.lit(0.8).alias("tx"), F.lit(0.6).alias("ty"), (20 + k.cast("double")).alias("z_dem"))
    out = surveys.road_cells(t, view(spark, d, "upts"))
    return out.withColumns({c: F.round(c, 6) for c in ("p99", "p1", "overburden")})


@query(f"WITH m AS (SELECT id, x, y, 12.0::DOUBLE AS z_dem, 0.6::DOUBLE AS ux, 0.8::DOUBLE AS uy FROM {MIDDLES} AS upts_m), n AS (SELECT m.id, z_dem, u.z, (u.x - m.x) * ux + (u.y - m.y) * uy BETWEEN 0.5 AND 6 AND abs((u.y - m.y) * ux - (u.x - m.x) * uy) <= 3 AND u.z < z_dem - 0.2 AS strip, (m.x - u.x) * (m.x - u.x) + (m.y - u.y) * (m.y - u.y) <= 16 AS inside FROM m JOIN upts u ON (m.x - u.x) * (m.x - u.x) + (m.y - u.y) * (m.y - u.y) <= 81), a AS (SELECT id, any_value(z_dem) AS g, count(*) FILTER (WHERE strip) AS n, quantile_cont(z, 0.99) FILTER (WHERE strip) AS under, count(*) FILTER (WHERE inside) AS n_floor, quantile_cont(z, 0.02) FILTER (WHERE inside) AS f FROM n GROUP BY 1) SELECT id, n, CASE WHEN n >= 20 THEN round(under, 6) END AS under, CASE WHEN n >= 20 THEN round(g - under, 6) END AS tau, n_floor, CASE WHEN n_floor >= 20 THEN round(g - f, 6) END AS depth FROM a")
def rim_underside(spark, d):
    m = middles(spark, d).select("id", "x", "y", F.lit(12.0).alias("z_dem"), F.lit(0.6).alias("ux"), F.lit(0.8).alias("uy"))
    out = surveys.rim_underside(m, view(spark, d, "upts"), (0.5, 6.0), 3.0, floor=4.0)
    return out.withColumns({c: F.round(c, 6) for c in ("under", "tau", "depth")})


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
