"""Named queries over rasters of fine cells, with windows as large as surveys use."""

from __future__ import annotations

from pyspark.sql import functions as F

from karst.operators import landmarks, rasters
from karst.plans.queries import query
from karst.plans.views import view

FINE = "c AS (SELECT cast(floor(mx / 80000) AS bigint) AS ix, my AS iy, count(*) AS n, max(mz) AS zmax FROM pts GROUP BY 1, 2)"
BOX = "x AS (SELECT min(ix) x0, max(ix) x1, min(iy) y0, max(iy) y1 FROM c)"
FULL = f"{FINE}, {BOX}, g AS (SELECT a.ix, b.iy FROM (SELECT unnest(range(x0, x1 + 1)) AS ix FROM x) a, (SELECT unnest(range(y0, y1 + 1)) AS iy FROM x) b)"
WINDOW = "o AS (SELECT a.i AS dx, b.i AS dy FROM range(-{half}, {half} + 1) AS a(i), range(-{half}, {half} + 1) AS b(i))"
AT = "least(greatest(g.ix + dx, x0), x1) AND {t}.iy = least(greatest(g.iy + dy, y0), y1)"


def fine(spark, d):
    """Cells of 0.8 by 2: n and the greatest whole-number height."""
    p = view(spark, d, "pts").select(F.floor(F.col("mx") / 80000).alias("ix"), F.col("my").alias("iy"), "mz")
    return p.groupBy("ix", "iy").agg(F.count("*").alias("n"), F.max("mz").alias("zmax"))


@query(
    f"""WITH {FULL}, {WINDOW.format(half=20)}, h AS (SELECT g.ix, g.iy, zmax FROM g LEFT JOIN c USING (ix, iy))
 SELECT g.ix, g.iy, quantile_cont(h.zmax, 0.5)::DOUBLE AS median FROM g CROSS JOIN o CROSS JOIN x JOIN h ON h.ix = {AT.format(t='h')} GROUP BY 1, 2"""
)
def median_filter_41(spark, d):
    return rasters.median_filter(fine(spark, d), 41, "zmax", side=64)


@query(
    f"""WITH {FULL}, {WINDOW.format(half=10)}, h AS (SELECT g.ix, g.iy, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (ix, iy)),
 m AS (SELECT g.ix, g.iy, quantile_cont(h.n, 0.5) AS q FROM g CROSS JOIN o CROSS JOIN x JOIN h ON h.ix = {AT.format(t='h')} GROUP BY 1, 2)
 SELECT c.ix, c.iy FROM c JOIN m USING (ix, iy) WHERE n >= 0.9 * q"""
)
def relative_density_21(spark, d):
    return landmarks.occupied(fine(spark, d), relative=0.9, window=21)


FILLED = f"{FINE}, {BOX}, m AS (SELECT ix, iy FROM c WHERE (ix * 7 + iy * 13 + n) % 5 > 1)"
STEPS = "(VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) AS s(dx, dy)"


def filled(spark, d):
    return fine(spark, d).where("(ix * 7 + iy * 13 + n) % 5 > 1").select("ix", "iy")


@query(
    f"""WITH RECURSIVE {FILLED}, f AS (SELECT ix, iy, ix * 4294967296 + iy AS component FROM m
 UNION SELECT m.ix, m.iy, f.component FROM f CROSS JOIN {STEPS} JOIN m ON m.ix = f.ix + dx AND m.iy = f.iy + dy WHERE f.component < m.ix * 4294967296 + m.iy)
 SELECT ix, iy, min(component)::BIGINT AS component FROM f GROUP BY 1, 2"""
)
def components_of_tiles(spark, d):
    return rasters.label(filled(spark, d), side=16)


@query(
    f"""WITH RECURSIVE {FILLED}, b AS (SELECT min(ix) x0, max(ix) x1, min(iy) y0, max(iy) y1 FROM m),
 v AS (SELECT a.ix, b.iy, a.ix IN (x0, x1) OR b.iy IN (y0, y1) AS edge FROM (SELECT unnest(range(x0, x1 + 1)) AS ix, x0, x1 FROM b) a, (SELECT unnest(range(y0, y1 + 1)) AS iy, y0, y1 FROM b) b
 WHERE (a.ix, b.iy) NOT IN (SELECT (ix, iy) FROM m)),
 f AS (SELECT ix, iy FROM v WHERE edge UNION SELECT v.ix, v.iy FROM f CROSS JOIN {STEPS} JOIN v ON v.ix = f.ix + dx AND v.iy = f.iy + dy)
 SELECT ix, iy FROM v WHERE (ix, iy) NOT IN (SELECT (ix, iy) FROM f)"""
)
def fill_holes_of_tiles(spark, d):
    return rasters.enclosed(filled(spark, d), side=16).select("ix", "iy")
