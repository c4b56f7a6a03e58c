"""Scans of one long ordered sequence: running values and frames without a key.

A window without a key is one task.  Here the rows are sorted into ranges and
numbered, and blocks of equal length of the numbers are the tasks.  A frame is a
window inside a block, to which its neighbours' nearest rows are sent as well.  A
running value is one inside a block, a summary of each block, the summaries combined
in their order (by the same scan where they are many), and what comes before carried
in.  With keys (`by`) rows of a key stand together and values start anew at each, so
a key of any size is parted like a keyless sequence.

Rows that `order` does not tell apart keep some order.  A sequence without rows
gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from karst.operators.lineage import table

#: Rows of a block; two at least.
SIZE = 1 << 16

#: The value of rows, and that of what came before with it; null where there is none.
FOLDS: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "last": (lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("_pos"))), lambda a, b: F.coalesce(b, a)),
}


@dataclass(frozen=True)
class Line:
    """Numbered rows: _pos from 0, over all keys in order; total rows of it, in blocks of size."""

    rows: DataFrame
    total: int
    by: tuple[str, ...] = ()
    size: int = SIZE

    @classmethod
    def of(cls, rows: DataFrame, order: Sequence[str], by: Sequence[str] = (), size: int = SIZE) -> Line:
        keys = [*by, *order]
        sorted_rows = table(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()))
        # an id is its partition's number and the place there: partitions are ranges in order
        part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
        many = sorted(sorted_rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).collect())  # a row for each range
        ends = list(accumulate(r["_n"] for r in many))
        before = rows.sparkSession.createDataFrame([(r["_part"], e - r["_n"]) for r, e in zip(many, ends, strict=True)], "_part long, _before long")
        placed = sorted_rows.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("_pos", F.col("_before") + place)
        total = ends[-1] if ends else 0
        return cls(placed.drop("_id", "_part", "_before"), total, tuple(by), size)

    def _blocks(self) -> DataFrame:
        return self.rows.withColumn("_block", F.floor(F.col("_pos") / self.size)) if "_block" not in self.rows.columns else self.rows

    def near(self, before: int, after: int, columns: Callable[[WindowSpec], dict[str, Column]]) -> Line:
        """With columns of windows that reach so many rows before and after a row; columns gets the window of a block, ordered."""
        last = F.lit(max(self.total - 1, 0) // self.size)
        first, end = (F.floor((F.col("_pos") + d) / self.size) for d in (-after, before))
        sent = self.rows.drop("_block").withColumn("_block", F.explode(F.sequence(F.greatest(first, F.lit(0)), F.least(end, last))))
        known = sent.withColumns(columns(Window.partitionBy(*self.by, "_block").orderBy("_pos")))
        return replace(self, rows=known.where(F.col("_block") == F.floor(F.col("_pos") / self.size)))

    def running(self, exclusive: bool = False, **values: tuple[str, Column]) -> Line:
        """With each named value (a fold of FOLDS, a column) over the rows of the key up to a row, or to the one before it."""
        own = self._blocks()
        sums = own.groupBy(*self.by, "_block").agg(*[FOLDS[f][0](c).alias(k) for k, (f, c) in values.items()])
        folds = {k: f for k, (f, _) in values.items()}
        carried = self._carried(sums, folds)
        w = Window.partitionBy(*self.by, "_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
        inside = own.withColumns({f"_in_{k}": FOLDS[f][0](c).over(w) for k, (f, c) in values.items()})
        a, b = inside.alias("a"), carried.alias("b")
        same = F.col("a._block") == F.col("b._block")
        for k in self.by:
            same &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        joined = a.join(b, same, "left").select("a.*", *[FOLDS[f][1](F.col(f"b._to_{k}"), F.col(f"a._in_{k}")).alias(k) for k, f in folds.items()])
        return replace(self, rows=joined.drop(*[f"_in_{k}" for k in values]))

    def _carried(self, sums: DataFrame, folds: dict[str, str]) -> DataFrame:
        """by, _block, _to_<name>: each value over the blocks before."""
        blocks = -(-self.total // self.size)
        named = {k: F.col(k) for k in folds}
        if not self.by and blocks > self.size:  # a row for each block, again in blocks
            line = Line(sums.withColumnRenamed("_block", "_pos"), blocks, (), self.size)
            out = line.running(True, **{f"_to_{k}": (f, named[k]) for k, f in folds.items()}).rows
            return out.select(F.col("_pos").alias("_block"), *[f"_to_{k}" for k in folds])
        w = Window.partitionBy(*self.by).orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
        over = sums.withColumn("_pos", F.col("_block")).withColumns({f"_to_{k}": FOLDS[f][0](named[k]).over(w) for k, f in folds.items()})
        return over.select(*self.by, "_block", *[f"_to_{k}" for k in folds])

    def done(self) -> DataFrame:
        return self.rows.drop("_pos", "_block")


def arc_length(rows: DataFrame, order: str, axes: Sequence[str], by: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """step, arc: the step from the row before, and all steps summed; the first row has 0."""
    square = lambda w: sum(((F.col(c) - F.lag(c).over(w)) ** 2 for c in axes), F.lit(0.0))
    line = Line.of(rows, [order], by, size).near(1, 0, lambda w: {"step": F.coalesce(F.sqrt(square(w)), F.lit(0.0))})
    return line.running(arc=("sum", F.col("step"))).done()


def gradient(rows: DataFrame, order: str, value: str, name: str = "gradient", by: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """Half the step from the row before to the row after; at the ends the one step there is."""

    def step(w: WindowSpec) -> dict[str, Column]:
        own, a, b = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
        return {name: F.when(F.lag(F.lit(1)).over(w).isNull(), b - own).when(F.lead(F.lit(1)).over(w).isNull(), own - a).otherwise((b - a) / 2)}

    return Line.of(rows, [order], by, size).near(1, 1, step).done()


def islands(rows: DataFrame, order: str, value: str, by: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """run: number of the run of equal values a row stands in, from 1."""
    new = lambda w: F.when(F.lag(F.lit(1)).over(w).isNotNull() & F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    line = Line.of(rows, [order], by, size).near(1, 0, lambda w: {"_new": new(w)})
    return line.running(run=("sum", F.col("_new"))).done().drop("_new")


def sessions(rows: DataFrame, order: str, gap: float, by: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """cluster: a new one begins where a value of order is more than gap after the last, from 0."""
    line = Line.of(rows, [order], by, size).near(1, 0, lambda w: {"_new": F.coalesce((F.col(order) - F.lag(order).over(w) > gap).cast("long"), F.lit(0))})
    return line.running(cluster=("sum", F.col("_new"))).done().drop("_new")


def running_max_flag(rows: DataFrame, order: str, value: str, slack: float, by: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """top: the greatest value before a row; near_top: whether the row is at most slack below it."""
    line = Line.of(rows, [order], by, size).running(True, top=("max", F.col(value)))
    return line.done().withColumn("near_top", F.coalesce(F.col(value) >= F.col("top") - slack, F.lit(True)))


def sinuosity(rows: DataFrame, order: str, axes: Sequence[str], half: int, by: Sequence[str] = (), least: float = 0.9, size: int = SIZE) -> DataFrame:
    """sinuosity: path over chord in a centred window of 2 half + 1 rows; null where less than `least` of the window's rows exist."""
    square = lambda w: sum(((F.col(c) - F.lag(c).over(w)) ** 2 for c in axes), F.lit(0.0))
    stepped = Line.of(rows, [order], by, size).near(1, 0, lambda w: {"step": F.coalesce(F.sqrt(square(w)), F.lit(0.0))})

    def ratio(w: WindowSpec) -> dict[str, Column]:
        w = w.rowsBetween(-half, half)
        path = F.sum("step").over(w) - F.first("step").over(w)  # the first row's step leads into the window
        chord = F.sqrt(sum(((F.last(c).over(w) - F.first(c).over(w)) ** 2 for c in axes), F.lit(0.0)))
        return {"sinuosity": F.when((F.count("*").over(w) >= least * (2 * half + 1)) & (chord > 0), path / chord)}

    return stepped.near(half, half, ratio).running(arc=("sum", F.col("step"))).done()


def median_of_frame(near: Column, place: Column, many: Column, half: int, edge: str) -> Column:
    """Median of a frame of 2 half + 1 rows; near: the structs (v) of those that exist, place and many: the row's place and the rows there are."""
    if edge not in ("nearest", "reflect"):
        raise ValueError("edge is nearest or reflect")

    def at(i: Column) -> Column:
        if edge == "nearest":
            return F.greatest(F.least(i, many - 1), F.lit(0).cast("long"))
        turn = F.pmod(i, 2 * many)  # the rows and their mirror image, again and again
        return F.when(turn < many, turn).otherwise(2 * many - 1 - turn)

    start = F.greatest(place - half, F.lit(0))
    reach = F.sequence(F.lit(-half).cast("long"), F.lit(half).cast("long"))
    values = F.array_sort(F.filter(F.transform(reach, lambda o: F.get(near, (at(place + o) - start).cast("int"))["v"]), lambda v: v.isNotNull()))
    return F.get(values, F.floor((F.size(values) - 1) / 2).cast("int"))


def median_filter(rows: DataFrame, order: str, value: str, half: int, edge: str = "nearest", size: int = SIZE) -> DataFrame:
    """median over 2 half + 1 rows; beyond the ends the end value stands again (nearest), or the rows mirrored with the end one twice (reflect)."""
    line = Line.of(rows, [order], (), size)
    near = lambda w: F.collect_list(F.struct(F.col(value).alias("v"))).over(w.rowsBetween(-half, half))
    many = F.lit(line.total).cast("long")
    return line.near(half, half, lambda w: {"_near": near(w)}).rows.withColumn("median", median_of_frame(F.col("_near"), F.col("_pos"), many, half, edge)).drop("_near", "_pos", "_block")
