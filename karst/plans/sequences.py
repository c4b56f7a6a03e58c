"""Named queries over one long sequence without a key: all stations of the table in their order."""

from __future__ import annotations

from pyspark.sql import functions as F

from karst.operators import curves, relations, scans
from karst.plans.queries import query
from karst.plans.views import view

#: Whole hundredths, so that sums are exact.
CENTS = "v AS (SELECT s, class, user_id, cast(round(value * 100) AS bigint) AS v FROM stn)"


def cents(spark, d):
    return view(spark, d, "stn").select("s", "class", "user_id", F.round(F.col("value") * 100).cast("long").alias("v"))


@query(f"WITH {CENTS}, w AS (SELECT s, coalesce(abs(v - lag(v) OVER (ORDER BY s)), 0)::DOUBLE AS step FROM v) SELECT s, step, sum(step) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) AS arc FROM w")
def line_arc_length(spark, d):
    return curves.arc_length(cents(spark, d), "s", ["v"]).select("s", "step", "arc")


@query(
    f"""WITH {CENTS} SELECT s, CASE WHEN lag(v) OVER w IS NULL THEN lead(v) OVER w - v WHEN lead(v) OVER w IS NULL THEN v - lag(v) OVER w
 ELSE (lead(v) OVER w - lag(v) OVER w) / 2.0::DOUBLE END::DOUBLE AS slope FROM v WINDOW w AS (ORDER BY s)"""
)
def line_gradient(spark, d):
    return scans.gradient(cents(spark, d), "s", "v", "slope").select("s", F.col("slope").cast("double").alias("slope"))


@query(
    f"""WITH {CENTS}, w AS (SELECT s, class, row_number() OVER (ORDER BY s) - row_number() OVER (PARTITION BY class ORDER BY s) AS k FROM v),
 r AS (SELECT class, min(s) AS first, max(s) AS last, count(*) AS n FROM w GROUP BY class, k)
 SELECT row_number() OVER (ORDER BY first) AS run, class, first, last, n FROM r"""
)
def line_islands(spark, d):
    runs = curves.islands(cents(spark, d), "s", "class")
    return runs.groupBy("run", "class").agg(F.min("s").alias("first"), F.max("s").alias("last"), F.count("*").alias("n"))


@query(f"WITH {CENTS}, w AS (SELECT s, v, max(v) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM v) SELECT s, top, coalesce(v >= top - 300, true) AS near_top FROM w")
def line_running_max(spark, d):
    return curves.running_max_flag(cents(spark, d), "s", "v", 300).select("s", "top", "near_top")


@query(
    f"""WITH {CENTS}, w AS (SELECT v, coalesce((v - lag(v) OVER (ORDER BY v) > 60)::INT, 0) AS new FROM v), k AS (SELECT v, sum(new) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS cluster FROM w)
 SELECT cluster::BIGINT AS cluster, count(*) AS n, min(v) AS low, max(v) AS high FROM k GROUP BY 1"""
)
def line_sessions(spark, d):
    return curves.sessions(cents(spark, d), "v", 60).groupBy("cluster").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))


MIRRORED = """WITH {cents}, w AS (SELECT s, v, row_number() OVER (ORDER BY s) - 1 AS k, count(*) OVER () AS n FROM v), o AS (SELECT unnest(range(-{half}, {half} + 1)) AS o),
 a AS (SELECT w.s, {at} AS k FROM w CROSS JOIN o) SELECT a.s, quantile_disc(w.v, 0.5) AS median FROM a JOIN w USING (k) GROUP BY 1"""


@query(MIRRORED.format(cents=CENTS, half=4, at="least(greatest(w.k + o, 0), n - 1)"))
def line_median_nearest(spark, d):
    return curves.median_filter(cents(spark, d), "s", "v", 4).select("s", "median")


@query(MIRRORED.format(cents=CENTS, half=7, at="CASE WHEN w.k + o < 0 THEN -1 - w.k - o WHEN w.k + o >= n THEN 2 * n - 1 - w.k - o ELSE w.k + o END"))
def line_median_reflect(spark, d):
    return curves.median_filter(cents(spark, d), "s", "v", 7, edge="reflect").select("s", "median")


@query(
    f"""WITH {CENTS}, p AS (SELECT s, coalesce(abs(v - lag(v) OVER (ORDER BY s)), 0)::DOUBLE AS step, v, row_number() OVER (ORDER BY s) AS k FROM v),
 f AS (SELECT s, count(*) OVER w AS n, sum(step) OVER w - first_value(step) OVER w AS path, abs(last_value(v) OVER w - first_value(v) OVER w) AS chord FROM p WINDOW w AS (ORDER BY s ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))
 SELECT s, CASE WHEN n >= 0.9 * 11 AND chord > 0 THEN round(path / chord, 6) END AS sinuosity FROM f"""
)
def line_sinuosity(spark, d):
    return curves.sinuosity(cents(spark, d), "s", ["v"], 5).select("s", F.round("sinuosity", 6).alias("sinuosity"))


@query(f"WITH {CENTS} SELECT s, v, row_number() OVER (ORDER BY v, s) / count(*) OVER ()::DOUBLE AS share FROM v")
def line_ecdf(spark, d):
    return curves.ecdf(cents(spark, d).withColumn("at", F.struct("v", "s")), "at").select("s", "v", "share")


@query(f"WITH {CENTS}, n AS (SELECT s, CASE WHEN v > 30000 AND s % 3 = 0 THEN v ELSE 0 END AS n FROM v) SELECT s, n FROM n WHERE s <= (SELECT max(s) FROM n WHERE n > 0)")
def line_trailing_empty(spark, d):
    rows = cents(spark, d).select("s", F.when((F.col("v") > 30000) & (F.col("s") % 3 == 0), F.col("v")).otherwise(0).alias("n"))
    return relations.without_empty_end(rows, "s", "n")


@query(
    f"""WITH {CENTS}, m AS (SELECT s, v - avg(v) OVER () AS dv, row_number() OVER (ORDER BY s) AS k FROM v), l AS (SELECT unnest(range(0, 6)) AS lag)
 SELECT lag, round(coalesce((SELECT sum(a.dv * b.dv) FROM m a JOIN m b ON b.k = a.k + lag), 0) / (SELECT sum(dv * dv) FROM m), 6) AS rho FROM l"""
)
def line_autocorrelation(spark, d):
    return curves.autocorrelation(cents(spark, d), "s", "v", 5).select("lag", F.round("rho", 6).alias("rho"))


@query(
    f"""WITH {CENTS}, w AS (SELECT class, s, v, coalesce(abs(v - lag(v) OVER (PARTITION BY class ORDER BY s)), 0)::DOUBLE AS step FROM v)
 SELECT class, s, sum(step) OVER (PARTITION BY class ORDER BY s ROWS UNBOUNDED PRECEDING) AS arc, max(v) OVER (PARTITION BY class ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM w"""
)
def line_of_hot_keys(spark, d):
    """Few keys, each with a large part of all rows, parted like one sequence."""
    line = scans.Line.of(cents(spark, d), ["s"], ["class"], 4096).near(1, 0, lambda w: {"step": F.coalesce(F.abs(F.col("v") - F.lag("v").over(w)), F.lit(0)).cast("double")})
    return line.running(arc=("sum", F.col("step"))).running(True, top=("max", F.col("v"))).done().select("class", "s", "arc", "top")
