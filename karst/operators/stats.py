"""Aggregates and fits: percentiles, robust moments, least squares, bootstrap."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from karst.operators.lineage import table

#: Bins of a bootstrap's histogram, and draws of a task's piece of a round.
BINS, DRAWN = 1024, 1 << 20


def percentiles(c: str, shares: Sequence[float]) -> list[Column]:
    """Exact percentiles with linear interpolation, named p<percent>; one aggregate gives them all."""
    every = F.percentile(c, F.array(*[F.lit(float(q)) for q in shares]))
    return [F.get(every, F.lit(k)).alias(f"p{round(q * 100)}") for k, q in enumerate(shares)]


def between(low: float, high: float, part: float) -> float:
    """low * (1 - part) + high * part, the first product not rounded, as SQL's engine has it; Spark's percentile rounds both, and so some halves to another side."""
    if not (math.isfinite(low) and math.isfinite(high)):
        return low if low == high else low * (1 - part) + high * part
    return float(Fraction(low) * Fraction(1 - part) + Fraction(high * part))


def grouped_percentiles(rows: DataFrame, by: Sequence[str], c: str, shares: Sequence[float], bins: int = 1024) -> DataFrame:
    """Exact percentiles with linear interpolation of each group, for groups of any size.

    A histogram tells in which bins the two values around each share lie; only those
    bins' distinct values are then counted in order, so no task holds a group.
    """
    v = F.col(c).cast("double")
    rows = rows.where(v.isNotNull()).select(*by, v.alias("_v"))
    span = rows.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    bin_of = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    placed = rows.join(span, list(by)).withColumn("_bin", bin_of)
    w = Window.partitionBy(*by).orderBy("_bin")
    hist = placed.groupBy(*by, "_bin").agg(F.count("*").alias("_k"), F.first("_n").alias("_n")).withColumn("_before", F.sum("_k").over(w) - F.col("_k"))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(F.lit(float(q)) * (F.col("_n") - 1)), F.ceil(F.lit(float(q)) * (F.col("_n") - 1))) for q in shares])))
    wanted = hist.withColumn("_ranks", F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_k")))).where(F.size("_ranks") > 0).select(*by, "_bin", "_before", "_ranks", "_n")
    each = placed.select(*by, "_bin", "_v").join(wanted.select(*by, "_bin"), [*by, "_bin"], "left_semi").groupBy(*by, "_bin", "_v").agg(F.count("*").alias("_k"))
    inner = Window.partitionBy(*by, "_bin").orderBy("_v")
    ordered = each.withColumn("_upto", F.sum("_k").over(inner)).join(wanted, [*by, "_bin"])
    found = ordered.select(*by, "_v", "_n", F.explode(F.filter("_ranks", lambda r: (r >= F.col("_before") + F.col("_upto") - F.col("_k")) & (r < F.col("_before") + F.col("_upto")))).alias("_r"))

    def at(q: float) -> Column:
        p = F.lit(float(q)) * (F.first("_n") - 1)
        low, high = (F.max(F.when(F.col("_r") == f(F.lit(float(q)) * (F.col("_n") - 1)), F.col("_v"))) for f in (F.floor, F.ceil))
        return low + (high - low) * (p - F.floor(p))

    return found.groupBy(*by).agg(*[at(q).alias(f"p{round(q * 100)}") for q in shares])


def moments(c: str) -> list[Column]:
    """n, mean, median, population deviation, rms, least, greatest, range."""
    return [F.count(c).alias("n"), F.avg(c).alias("mean"), F.median(c).alias("median"), F.stddev_pop(c).alias("std"), F.sqrt(F.avg(F.col(c) * F.col(c))).alias("rms"), F.min(c).alias("least"), F.max(c).alias("greatest"), (F.max(c) - F.min(c)).alias("spread")]


def ellipse(x: str, y: str) -> list[Column]:
    """Semi axes (two deviations) and orientation in [0, pi) of a point set's sample covariance."""
    a, b, c = F.var_samp(x), F.covar_samp(x, y), F.var_samp(y)
    mid, half = (a + c) / 2, F.sqrt(((a - c) / 2) ** 2 + b * b)
    turn = F.atan2(2 * b, a - c) / 2
    return [F.count("*").alias("n"), (2 * F.sqrt(mid + half)).alias("semi_major"), (2 * F.sqrt(F.greatest(mid - half, F.lit(0.0)))).alias("semi_minor"), F.pmod(turn, F.pi()).alias("orientation")]


def fit(rows: DataFrame, target: str, terms: dict[str, Column]) -> dict[str, float]:
    """Least squares of target on terms and a constant: sums in one pass, the small system on the driver."""
    names = [*terms, "constant"]
    t = [*terms.values(), F.lit(1.0)]
    k = len(t)
    y = F.col(target)
    row = rows.where(y.isNotNull()).agg(*[F.sum(t[i] * t[j]) for i in range(k) for j in range(i, k)], *[F.sum(c * y) for c in t], F.sum(y * y), F.count("*")).first()
    if not row[-1]:
        return dict.fromkeys([*names, "residual_std"])
    m, at = np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = row[at]
            at += 1
    v = np.array(row[at : at + k], float)
    x = np.linalg.lstsq(m, v, rcond=None)[0]
    left = max(float(row[at + k] - 2 * x @ v + x @ m @ x), 0.0)
    return {**dict(zip(names, map(float, x), strict=True)), "residual_std": (left / row[-1]) ** 0.5}


def plane(rows: DataFrame, x: str = "x", y: str = "y", z: str = "z") -> dict[str, float]:
    return fit(rows, z, {"x": F.col(x), "y": F.col(y)})


def quadratic(rows: DataFrame, x: str = "x", y: str = "y", z: str = "z") -> dict[str, float]:
    a, b = F.col(x), F.col(y)
    return fit(rows, z, {"x": a, "y": b, "xx": a * a, "xy": a * b, "yy": b * b})


def quadrature(parts: DataFrame, sigma: str) -> DataFrame:
    """sigma, terms: independent errors added as the root of the sum of squares."""
    return parts.agg(F.sqrt(F.sum(F.col(sigma) * F.col(sigma))).alias("sigma"), F.count(sigma).alias("terms"))


def draws(rounds: int, size: int, n: int, block: int, seed: int, width: int, spark: SparkSession) -> DataFrame:
    """slot, b, at: for each round, size numbers below n, in blocks of neighbours (1: each by itself), by a linear congruence.

    A number is slot * width + at; those of one slot stand packed (two bytes each) in a
    row, so that few bytes are shuffled.  A row of the plan is a piece of a round.
    """
    starts, room = -(-size // block), abs(n - block + 1)
    piece = max(1, DRAWN // block)
    pieces = -(-starts // piece) if room else 0

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.column("id").to_pylist():
                b, first = one // pieces, one % pieces * piece
                k = np.arange(first, min(first + piece, starts), dtype=np.int64)
                s = (b * 7919 + k * 104729 + seed) * 16807 % 2147483647 * 48271 % 2147483647 % room
                i = (s[:, None] + np.arange(block)).ravel()[: size - first * block]
                slot = i // width
                order = np.argsort(slot, kind="stable")
                i, slot = i[order], slot[order]
                cuts = np.flatnonzero(np.diff(slot, prepend=-1))
                at = [v.astype("<u2").tobytes() for v in np.split(i - slot * width, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(slot[cuts]), pa.array(np.full(len(cuts), b, np.int32)), pa.array(at, pa.binary())], ["slot", "b", "at"])

    return spark.range(0, rounds * pieces, 1, max(1, min(rounds * pieces, 4 * spark.sparkContext.defaultParallelism))).mapInArrow(make, "slot long, b int, at binary")


def bootstrap(rows: DataFrame, position: str, value: str, n: int, rounds: int, block: int = 1, seed: int = 7, shares: Sequence[float] = (0.025, 0.975)) -> DataFrame:
    """One row: percentiles over rounds of the median of n values drawn with replacement; position numbers rows from 0.

    Draws meet the rows by slots of positions, where each value gets the number of its
    draws by round.  A histogram of these numbers tells in which bins the middles of a
    round lie, and only those bins' values are then counted in order.  All n values are
    drawn in each round; no task holds a round.
    """
    width = max(1024, min(1 << 16, (1 << 22) // max(rounds, 1)))
    slim = rows.select(F.col(position).cast("long").alias("i"), F.col(value).cast("double").alias("v"))
    known = slim.where(F.col("i").between(0, max(n - 1, 0))).withColumn("slot", F.floor(F.col("i") / width))
    drawn = draws(rounds, n, n, block, seed, width, rows.sparkSession)

    def tally(key: tuple, own: pa.Table, asked: pa.Table) -> pa.Table:
        n_of = np.zeros((width, rounds), np.int64)
        for b, at in zip(asked.column("b").to_pylist(), asked.column("at").to_pylist(), strict=True):
            n_of[:, b] += np.bincount(np.frombuffer(at, "<u2"), minlength=width)
        v, missing = own.column("v").to_numpy(), np.asarray(own.column("v").is_null())
        kinds, which = np.unique(np.where(missing, 0.0, v), return_inverse=True)
        which = np.where(missing, len(kinds), which)  # missing values are drawn, too, and have no place in the order
        order = np.argsort(which, kind="stable")
        firsts = np.flatnonzero(np.diff(which[order], prepend=-1))
        total = np.add.reduceat(n_of[own.column("i").to_numpy()[order] % width], firsts, axis=0) if len(order) else np.zeros((0, rounds), np.int64)
        kept = total.any(axis=1)
        kind = which[order][firsts][kept]
        values = pa.array(np.append(kinds, 0.0)[kind], pa.float64(), mask=kind == len(kinds))
        return pa.table({"v": values, "n": pa.array([t.astype("<i8").tobytes() for t in total[kept]], pa.binary())})

    counted = table(known.groupBy("slot").cogroup(drawn.groupBy("slot")).applyInArrow(tally, "v double, n binary"))
    cuts = counted.agg(F.percentile_approx("v", F.array(*[F.lit(k / BINS) for k in range(1, BINS)]), 10 * BINS)).first()[0]
    edges = np.unique(np.array(cuts or [], float))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Values, their bins (-1: missing) and numbers of draws by round."""
        for batch in batches:
            if batch.num_rows:
                v, missing = batch.column("v").to_numpy(zero_copy_only=False), np.asarray(batch.column("v").is_null())
                yield v, np.where(missing, -1, np.searchsorted(edges, v, "right")), np.frombuffer(b"".join(batch.column("n").to_pylist()), "<i8").reshape(-1, rounds)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(edges) + 2, rounds), np.int64)
        for _, at, n_of in parts(batches):
            np.add.at(sums, at + 1, n_of)
        at, b = sums.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), pa.array((at - 1).astype(np.int32)), pa.array(sums[at, b])], ["b", "bin", "k"])

    bins = table(counted.mapInArrow(add, "b int, bin int, k long").groupBy("b", "bin").agg(F.sum("k").alias("k")))
    w = Window.partitionBy("b").orderBy("bin")
    hist = bins.where("bin >= 0").withColumns({"before": F.sum("k").over(w) - F.col("k"), "total": F.sum("k").over(Window.partitionBy("b"))})
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    middle = hist.where((low < F.col("before") + F.col("k")) & (high >= F.col("before")))
    wanted = middle.select("b", "bin", "before", low.alias("low"), high.alias("high")).collect()  # two rows for each round
    asking = np.zeros((len(edges) + 2, rounds), bool)
    for r in wanted:
        asking[r["bin"], r["b"]] = True

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v, at, n_of in parts(batches):
            r, b = (asking[at] & (n_of > 0)).nonzero()  # missing ones ask the last row, which is empty
            yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), pa.array(at[r].astype(np.int32)), pa.array(v[r]), pa.array(n_of[r, b])], ["b", "bin", "v", "k"])

    each = counted.mapInArrow(pick, "b int, bin int, v double, k long").groupBy("b", "bin", "v").agg(F.sum("k").alias("k"))
    places = rows.sparkSession.createDataFrame([tuple(r) for r in wanted], "b int, bin int, before long, low long, high long")
    ordered = each.join(F.broadcast(places), ["b", "bin"]).withColumn("upto", F.col("before") + F.sum("k").over(Window.partitionBy("b", "bin").orderBy("v")))
    at = lambda r: F.max(F.when((F.col(r) < F.col("upto")) & (F.col(r) >= F.col("upto") - F.col("k")), F.col("v")))
    medians = ordered.groupBy("b").agg((0.5 * at("low") + 0.5 * at("high")).alias("m"))
    found = bins.select("b").distinct().join(medians, "b", "left").agg(F.sort_array(F.collect_list("m")).alias("m"), F.count("*").alias("rounds"))  # a number for each round
    names = [f"p{round(q * 100)}" for q in shares]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, n in zip(*(batch.column(c).to_pylist() for c in ("m", "rounds")), strict=True):
                places = [(len(m) - 1) * float(q) for q in shares]
                values = [between(m[math.floor(p)], m[math.ceil(p)], p - math.floor(p)) if m else None for p in places]
                yield pa.RecordBatch.from_arrays([*[pa.array([v], pa.float64()) for v in values], pa.array([n], pa.int64())], [*names, "rounds"])

    return found.mapInArrow(told, ", ".join(f"{c} double" for c in names) + ", rounds long")


def histogram(rows: DataFrame, c: str, low: float, high: float, bins: int) -> DataFrame:
    """bin, n over equal bins; the last one holds its right edge, values outside go."""
    width = (high - low) / bins
    inside = rows.where(F.col(c).between(low, high))
    return inside.groupBy(F.least(F.floor((F.col(c) - low) / width), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
