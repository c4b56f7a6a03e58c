"""Named queries of two constellations of landmarks: gates, the sets that motions bring together, the best motion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.operators import constellations
from karst.plans.queries import query
from karst.plans.views import view

TOLERANCE = 0.5

#: The last point of each 20 x 20 square is a landmark; b sees them turned and shifted, a little off, every fourth somewhere else.
MARKS = """a AS (SELECT cast(floor(x / 20) * 5 + floor(y / 20) AS bigint) AS id, arg_max(x, pid) AS x, arg_max(y, pid) AS y, arg_max(z, pid) AS z, max(pid) AS pid FROM upts GROUP BY 1),
 o AS (SELECT id, x + CASE WHEN id % 4 = 0 THEN 7 + id ELSE 0 END - 12 AS x, y + 3 AS y, z, (pid * 37 % 100 - 50) / 500.0::DOUBLE AS e FROM a),
 b AS (SELECT id, 0.6::DOUBLE * x + 0.8::DOUBLE * y + e AS x, 0.6::DOUBLE * y - 0.8::DOUBLE * x AS y, z - 1.5::DOUBLE AS z FROM o),
 pa AS (SELECT p.id AS p, q.id AS q, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2)) AS d FROM a p JOIN a q ON p.id <> q.id),
 pb AS (SELECT p.id AS p, q.id AS q, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2)) AS d FROM b p JOIN b q ON p.id < q.id),
 g AS (SELECT row_number() OVER () AS m, pa.p AS a1, pa.q AS a2, pb.p AS b1, pb.q AS b2 FROM pb JOIN pa ON abs(pa.d - pb.d) <= 0.5)"""

SETS = f"""{MARKS},
 h AS (SELECT m, atan2((d.x - c.x) * (f.y - e.y) - (d.y - c.y) * (f.x - e.x), (d.x - c.x) * (f.x - e.x) + (d.y - c.y) * (f.y - e.y)) AS th, (c.x + d.x) / 2 AS cx, (c.y + d.y) / 2 AS cy, (e.x + f.x) / 2 AS ex, (e.y + f.y) / 2 AS ey, (e.z + f.z - c.z - d.z) / 2 AS tz
  FROM g JOIN a e ON e.id = a1 JOIN a f ON f.id = a2 JOIN b c ON c.id = b1 JOIN b d ON d.id = b2),
 w AS (SELECT m, b.id AS b, cos(th) * (b.x - cx) - sin(th) * (b.y - cy) + ex AS x, sin(th) * (b.x - cx) + cos(th) * (b.y - cy) + ey AS y, b.z + tz AS z FROM h CROSS JOIN b),
 k AS (SELECT m, b, min(struct_pack(d2 := pow(w.x - a.x, 2) + pow(w.y - a.y, 2) + pow(w.z - a.z, 2), a := a.id)) AS k FROM w JOIN a ON pow(w.x - a.x, 2) + pow(w.y - a.y, 2) + pow(w.z - a.z, 2) <= 0.25 GROUP BY 1, 2),
 i AS (SELECT m, k.a AS a, min(struct_pack(d2 := k.d2, b := b)).b AS b FROM k GROUP BY 1, 2),
 s AS (SELECT m, string_agg(b || ':' || a, ',' ORDER BY b) AS pairs, count(*) AS n FROM i GROUP BY 1 HAVING count(*) >= 2),
 u AS (SELECT pairs, n, min(m) AS m FROM s GROUP BY 1, 2),
 v AS (SELECT u.m, b.x AS b_x, b.y AS b_y, b.z AS b_z, a.x AS a_x, a.y AS a_y, a.z AS a_z FROM u JOIN i ON i.m = u.m JOIN a ON a.id = i.a JOIN b ON b.id = i.b),
 f AS (SELECT m, atan2(covar_pop(b_x, a_y) - covar_pop(b_y, a_x), covar_pop(b_x, a_x) + covar_pop(b_y, a_y)) AS th, avg(b_x) AS cx, avg(b_y) AS cy, avg(a_x) AS ex, avg(a_y) AS ey, median(a_z - b_z) AS tz FROM v GROUP BY 1),
 r AS (SELECT m, sqrt(avg(pow(cos(th) * (b_x - cx) - sin(th) * (b_y - cy) + ex - a_x, 2) + pow(sin(th) * (b_x - cx) + cos(th) * (b_y - cy) + ey - a_y, 2) + pow(b_z + tz - a_z, 2))) AS rms FROM v JOIN f USING (m) GROUP BY 1),
 t AS (SELECT pairs, n, rms, th, ex - cos(th) * cx + sin(th) * cy AS tx, ey - sin(th) * cx - cos(th) * cy AS ty, tz FROM u JOIN r USING (m) JOIN f USING (m))"""


def marks(spark, d) -> tuple[DataFrame, DataFrame]:
    square = (F.floor(F.col("x") / 20) * 5 + F.floor(F.col("y") / 20)).cast("long").alias("id")
    a = view(spark, d, "upts").groupBy(square).agg(F.max_by(F.struct("x", "y", "z"), "pid").alias("p"), F.max("pid").alias("pid")).select("id", "p.*", "pid")
    x = F.col("x") + F.when(F.col("id") % 4 == 0, 7 + F.col("id")).otherwise(0) - 12
    o = a.select("id", x.alias("x"), (F.col("y") + 3).alias("y"), "z", ((F.col("pid") * 37 % 100 - 50) / F.lit(500.0)).alias("e"))
    b = o.select("id", (0.6 * F.col("x") + 0.8 * F.col("y") + F.col("e")).alias("x"), (0.6 * F.col("y") - 0.8 * F.col("x")).alias("y"), (F.col("z") - 1.5).alias("z"))
    return a.select("id", "x", "y", "z"), b


def _named(pairs: str):
    return F.concat_ws(",", F.transform(pairs, lambda e: F.concat_ws(":", e["b"].cast("string"), e["a"].cast("string")))).alias("pairs")


@query(f"WITH {MARKS} SELECT l.a1, l.a2, r.a2 AS a3, l.b1, l.b2, r.b2 AS b3 FROM g l JOIN g r ON r.a1 = l.a1 AND r.b1 = l.b1 JOIN g q ON q.a1 = l.a2 AND q.b1 = l.b2 AND q.a2 = r.a2 AND q.b2 = r.b2 WHERE l.b2 < r.b2 AND l.a2 <> r.a2")
def triplet_gate(spark, d):
    return constellations.triplet_gate(*marks(spark, d), TOLERANCE)


@query(f"WITH {SETS} SELECT pairs, n, round(rms, 6) AS rms FROM t")
def motion_sets(spark, d):
    return constellations.motion_sets(*marks(spark, d), "4dof", TOLERANCE).select(_named("pairs"), F.col("n").cast("long").alias("n"), F.round("rms", 6).alias("rms"))


@query(
    f"""WITH {SETS}, p AS (SELECT *, row_number() OVER (ORDER BY n DESC, round(rms, 6), pairs) AS place, n - coalesce(lead(n) OVER (ORDER BY n DESC, round(rms, 6), pairs), 0) AS margin FROM t)
 SELECT pairs, n, margin, round(rms, 6) AS rms, round(cos(th), 6) AS r00, round(sin(th), 6) AS r10, round(tx, 5) AS tx, round(ty, 5) AS ty, round(tz, 5) AS tz FROM p WHERE place = 1 AND n >= 3"""
)
def landmark_match(spark, d):
    m = constellations.best_motion(*marks(spark, d), "4dof", TOLERANCE)
    turns, shifts = (F.round(c, 6).alias(c) for c in ("rms", "r00", "r10")), (F.round(c, 5).alias(c) for c in ("tx", "ty", "tz"))
    return m.select(_named("pairs"), F.col("n").cast("long").alias("n"), F.col("margin").cast("long").alias("margin"), *turns, *shifts)


@query()
def free_match(spark, d):
    """Six degrees of freedom: decompositions are no SQL; tests hold the plan against the search of a small table."""
    return constellations.best_motion(*marks(spark, d), "6dof", TOLERANCE).drop("pairs", "mode")
