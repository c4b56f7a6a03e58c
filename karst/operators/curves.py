"""Windows over ordered rows: stations of a curve, samples of a log.

Every function takes `by`, the partition keys: an ordered sequence is one task's
work for each key, so many curves run side by side.  Without keys, for one long
curve, the scans of karst.operators.scans part it; they also take keys, for those
that hold a large part of all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karst.operators import scans


def _window(by: Sequence[str], order: str):
    return Window.partitionBy(*by).orderBy(order)


def arc_length(rows: DataFrame, order: str, axes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """arc: summed steps from the first row, which has 0."""
    if not by:
        return scans.arc_length(rows, order, axes)
    w = _window(by, order)
    square = sum(((F.col(c) - F.lag(c).over(w)) ** 2 for c in axes), F.lit(0.0))
    stepped = rows.withColumn("step", F.coalesce(F.sqrt(square), F.lit(0.0)))
    return stepped.withColumn("arc", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def gradient(c: str, order: str, by: Sequence[str] = ()) -> Column:
    """Half the step from the row before to the row after; at the ends the one step there is."""
    w = _window(by, order)
    before, after = F.lag(c).over(w), F.lead(c).over(w)
    return F.when(before.isNull(), after - F.col(c)).when(after.isNull(), F.col(c) - before).otherwise((after - before) / 2)


def islands(rows: DataFrame, order: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """run: number of the run of equal values a row stands in, from 1, over each key's rows."""
    if not by:
        return scans.islands(rows, order, value)
    w = _window(by, order)
    new = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def sessions(rows: DataFrame, order: str, gap: float, by: Sequence[str] = ()) -> DataFrame:
    """cluster: a new one begins where a value is more than gap after the last, from 0."""
    if not by:
        return scans.sessions(rows, order, gap)
    w = _window(by, order)
    new = F.coalesce((F.col(order) - F.lag(order).over(w) > gap).cast("long"), F.lit(0))
    return rows.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def innermost_cluster(rows: DataFrame, r: str, gap: float, least: int, by: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """For each key, aggregates over the first gap-parted cluster of r that holds at least so many rows."""
    parted = sessions(rows, r, gap, by)
    size = parted.withColumn("_n", F.count("*").over(Window.partitionBy(*by, "cluster"))).where(F.col("_n") >= least)
    first = size.withColumn("_first", F.min("cluster").over(Window.partitionBy(*by))).where("cluster = _first")
    return first.groupBy(*by).agg(F.count("*").alias("n"), *aggregates)


def running_max_flag(rows: DataFrame, order: str, value: str, slack: float, by: Sequence[str] = ()) -> DataFrame:
    """top: the greatest value before a row; near_top: whether the row is at most slack below it."""
    if not by:
        return scans.running_max_flag(rows, order, value, slack)
    w = _window(by, order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("top", F.max(value).over(w)).withColumn("near_top", F.coalesce(F.col(value) >= F.col("top") - slack, F.lit(True)))


def sinuosity(rows: DataFrame, order: str, axes: Sequence[str], half: int, by: Sequence[str] = (), least: float = 0.9) -> DataFrame:
    """sinuosity: path over chord in a centred window of 2 half + 1 rows; null where less than `least` of the window's rows exist."""
    if not by:
        return scans.sinuosity(rows, order, axes, half, (), least)
    along = arc_length(rows, order, axes, by)
    w = _window(by, order).rowsBetween(-half, half)
    path = F.last("arc").over(w) - F.first("arc").over(w)
    chord = F.sqrt(sum(((F.last(c).over(w) - F.first(c).over(w)) ** 2 for c in axes), F.lit(0.0)))
    return along.withColumn("sinuosity", F.when((F.count("*").over(w) >= least * (2 * half + 1)) & (chord > 0), path / chord))


def median_filter(rows: DataFrame, order: str, value: str, half: int, by: Sequence[str] = (), edge: str = "nearest") -> DataFrame:
    """Running median of 2 half + 1 rows; beyond the ends the end value stands again (nearest), or the rows mirrored with the end one twice (reflect)."""
    if not by:
        return scans.median_filter(rows, order, value, half, edge)
    w = _window(by, order)
    near = F.collect_list(F.struct(F.col(value).alias("v"))).over(w.rowsBetween(-half, half))
    place, many = F.row_number().over(w).cast("long") - 1, F.count("*").over(Window.partitionBy(*by))
    framed = rows.withColumns({"_near": near, "_place": place, "_many": many})
    return framed.withColumn("median", scans.median_of_frame(F.col("_near"), F.col("_place"), F.col("_many"), half, edge)).drop("_near", "_place", "_many")


def ecdf(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """share: rank in ascending order over the number of rows."""
    if not by:
        line = scans.Line.of(rows, [value])
        return line.rows.withColumn("share", (F.col("_pos") + 1) / F.lit(line.total)).drop("_pos")
    return rows.withColumn("share", F.row_number().over(_window(by, value)) / F.count("*").over(Window.partitionBy(*by)))


def autocorrelation(rows: DataFrame, order: str, value: str, lags: int, by: Sequence[str] = ()) -> DataFrame:
    """lag, rho: sum of products of deviations `lag` rows apart over the sum of squares; lags without a pair of rows are left out. One pass of windows, no key's rows in one place."""
    lagged = lambda w: {f"_l{k}": F.lag("_d", k).over(w) for k in range(1, lags + 1)}
    if by:
        mean = rows.withColumn("_d", F.col(value) - F.avg(value).over(Window.partitionBy(*by)))
        apart = mean.withColumns(lagged(_window(by, order)))
    else:
        mean = rows.crossJoin(F.broadcast(rows.agg(F.avg(value).alias("_m")))).withColumn("_d", F.col(value) - F.col("_m"))  # one row
        apart = scans.Line.of(mean, [order]).near(lags, 0, lagged).rows
    square = F.sum(F.col("_d") * F.col("_d"))
    sums = apart.groupBy(*by).agg(*[((F.sum(F.col("_d") * F.col(f"_l{k}")) if k else square) / F.nullif(square, F.lit(0.0))).alias(f"_r{k}") for k in range(lags + 1)])
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), F.col(f"_r{k}").alias("rho")) for k in range(lags + 1)])).alias("v")
    return sums.select(*by, each).select(*by, "v.lag", "v.rho").where("rho is not null")


def effective_size(rows: DataFrame, order: str, value: str, lags: int, by: Sequence[str] = ()) -> DataFrame:
    """n, n_eff = n / (1 + 2 sum of rho before the first negative lag), decay: first lag below 1/e, negative: first lag below zero."""
    rho = autocorrelation(rows, order, value, lags, by)
    negative = F.min(F.when(F.col("rho") < 0, F.col("lag"))).over(Window.partitionBy(*by))  # a row for each lag
    told = rho.withColumn("negative", negative)
    kept = F.sum(F.when((F.col("lag") > 0) & (F.col("lag") < F.coalesce("negative", F.lit(lags + 1))), F.col("rho")).otherwise(0.0))
    shape = told.groupBy(*by).agg(F.min(F.when(F.col("rho") < F.exp(F.lit(-1.0)), F.col("lag"))).alias("decay"), F.first("negative").alias("negative"), kept.alias("_s"))
    n = rows.groupBy(*by).agg(F.count(value).alias("n"))
    return n.join(shape, list(by)).select(*by, "n", (F.col("n") / (1 + 2 * F.col("_s"))).alias("n_eff"), "decay", "negative") if by else n.crossJoin(shape).select("n", (F.col("n") / (1 + 2 * F.col("_s"))).alias("n_eff"), "decay", "negative")


def peaks(rows: DataFrame, order: str, value: str, height: float, distance: float, by: Sequence[str]) -> DataFrame:
    """by, order, v: local maxima of the three-row mean (ends weighted once, the row twice) over height, none nearer than distance to a higher one.

    What stays hangs on what is higher, so each key is one task's work, over its few peaks.
    """
    import numpy as np
    import pyarrow as pa

    w = _window(by, order)
    a, b, c = F.lag(value).over(w), F.col(value), F.lead(value).over(w)
    soft = rows.select(*by, F.col(order).cast("double").alias(order), ((F.coalesce(a, b) + 2 * b + F.coalesce(c, b)) / 4).alias("v"))
    soft = soft.withColumns({"_l": F.lag("v").over(w), "_r": F.lead("v").over(w)}).where((F.col("v") > height) & (F.col("v") > F.col("_l")) & (F.col("v") >= F.col("_r"))).drop("_l", "_r")

    def stay(table: pa.Table) -> pa.Table:
        at, v = table.column(order).to_numpy(), table.column("v").to_numpy()
        kept: list[int] = []
        for i in np.lexsort((at, -v)).tolist():
            if all(abs(at[i] - at[j]) >= distance for j in kept):
                kept.append(i)
        return table.take(pa.array(sorted(kept), pa.int64()))

    kinds = dict(rows.dtypes)
    return soft.groupBy(*by).applyInArrow(stay, ", ".join([*(f"{x} {kinds[x]}" for x in by), f"{order} double", "v double"]))


def interpolate(asked: DataFrame, known: DataFrame, key: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """asked and value, linear between the known rows around key; constant beyond them. Keys of known are unique."""
    both = asked.select(*by, key, F.lit(1).alias("_asked"), F.lit(None).cast("double").alias("_v")).unionAll(known.select(*by, key, F.lit(0), F.col(value).cast("double")))
    own = Window.partitionBy(*by).orderBy(key, "_asked")
    before, after = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(0, Window.unboundedFollowing)
    point = F.when(F.col("_asked") == 0, F.struct(F.col(key).cast("double").alias("k"), F.col("_v").alias("v")))
    a, b = F.last(point, ignorenulls=True).over(before), F.first(point, ignorenulls=True).over(after)
    placed = both.withColumn("_a", a).withColumn("_b", b).where("_asked = 1")
    k, va, vb = F.col(key).cast("double"), F.col("_a.v"), F.col("_b.v")
    share = (k - F.col("_a.k")) / (F.col("_b.k") - F.col("_a.k"))
    return placed.select(*by, key, F.when(va.isNull(), vb).when(vb.isNull() | (k == F.col("_a.k")), va).otherwise(va + (vb - va) * share).alias(value))


def kept_path(rows: DataFrame, order: str, axes: Sequence[str], step: float, jump: float, by: Sequence[str]) -> DataFrame:
    """length, kept: path over rows kept once at least step from the last kept one, without steps over jump.

    What is kept hangs on what was kept before, so each key is one pass over its
    ordered rows, a batch at a time.
    """
    import numpy as np
    import pyarrow as pa

    keys = [f"{b} {dict(rows.dtypes)[b]}" for b in by]

    def walk(key: tuple, batches):
        last, length, kept = None, 0.0, 0
        for batch in batches:
            for p in np.column_stack([batch.column(c).to_numpy() for c in axes]):
                if last is None or (d := float(np.linalg.norm(p - last))) >= step:
                    if last is not None and d <= jump:
                        length += d
                    last, kept = p, kept + 1
        yield pa.RecordBatch.from_pylist([{**{b: k.as_py() for b, k in zip(by, key, strict=True)}, "length": length, "kept": kept}])

    def group(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by(order)  # one key's ordered rows: a log or a flight
        return pa.Table.from_batches([*walk(key, table.to_batches())]).select([*by, "length", "kept"])

    return rows.select(*dict.fromkeys([*by, order, *axes])).groupBy(*by).applyInArrow(group, ", ".join([*keys, "length double", "kept long"]))
