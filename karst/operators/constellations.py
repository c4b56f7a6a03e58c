"""Matching of two landmark tables as plans: gates on distances, motions, inliers, the best motion of each set.

A motion carries b's landmarks onto a's.  It is proposed by two landmarks of each
side (four degrees of freedom: a turn about z and a shift) or by three (six), whose
distances agree within the tolerance, and judged by how many landmarks it brings
together.  Landmarks are rows id (unique), x, y, z and, for ties, area, semi_major,
semi_minor and orientation; rows with a null coordinate match nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karst.operators.lineage import table

#: Landmarks of a tile: pairs are joined a pair of tiles at a time.
TILE = 4096
SHAPE = ("area", "semi_major", "semi_minor", "orientation")
TURN = [f"r{i}{j}" for i in range(3) for j in range(3)]
MOTION = [*TURN, "tx", "ty", "tz"]


def _tiles(marks: DataFrame) -> int:
    return max(1, -(-marks.count() // TILE))


def pairs(marks: DataFrame, ordered: bool = True) -> DataFrame:
    """p, q, dist of all pairs: p < q, or both ways round if not ordered. Tiles of landmarks meet, whatever their number."""
    n = _tiles(marks)
    own = marks.select("id", "x", "y", "z").withColumn("at", F.pmod(F.xxhash64("id"), F.lit(n)))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    p = own.select(*[F.col(c).alias(f"p_{c}") for c in ("id", "x", "y", "z")], F.col("at").alias("row"), every.alias("column"))
    q = own.select(*[F.col(c).alias(f"q_{c}") for c in ("id", "x", "y", "z")], F.col("at").alias("column"), every.alias("row"))
    dist = F.sqrt(sum((F.col(f"p_{c}") - F.col(f"q_{c}")) ** 2 for c in "xyz"))
    both = p.join(q, ["row", "column"]).where(F.col("p_id") < F.col("q_id") if ordered else F.col("p_id") != F.col("q_id"))
    return both.select(F.col("p_id").alias("p"), F.col("q_id").alias("q"), dist.alias("dist")).where("dist IS NOT NULL")


def pair_gate(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """a1, a2, b1, b2, da, db: pairs b1 < b2 and a's, both ways round, at distances that agree within tolerance.

    Distances are dealt into bins as wide as the tolerance, so that the range join is an equi-join on three bins.
    """
    width = F.lit(max(tolerance, 1e-9))
    near = F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("dist") / width).cast("long") + k))
    left = pairs(b).select(F.col("p").alias("b1"), F.col("q").alias("b2"), F.col("dist").alias("db"), near.alias("bin"))
    right = pairs(a, ordered=False).select(F.col("p").alias("a1"), F.col("q").alias("a2"), F.col("dist").alias("da"), F.floor(F.col("dist") / width).cast("long").alias("bin"))
    return left.join(right, "bin").where(F.abs(F.col("da") - F.col("db")) <= tolerance).select("a1", "a2", "b1", "b2", "da", "db")


def triplet_gate(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """a1, a2, a3, b1, b2, b3: triplets b1 < b2 < b3 whose three distances agree with those of a's within tolerance."""
    gate = table(pair_gate(a, b, tolerance).select("a1", "a2", "b1", "b2"))
    second = gate.select("a1", "b1", F.col("a2").alias("a3"), F.col("b2").alias("b3"))
    third = gate.select(F.col("a1").alias("a2"), F.col("b1").alias("b2"), F.col("a2").alias("a3"), F.col("b2").alias("b3"))
    found = gate.join(second, ["a1", "b1"]).where("b2 < b3 AND a2 <> a3")
    return found.join(third, ["a2", "b2", "a3", "b3"]).select("a1", "a2", "a3", "b1", "b2", "b3")


def _placed(rows: DataFrame, marks: DataFrame, key: str, side: str) -> DataFrame:
    at = marks.select(F.col("id").alias(key), *[F.col(c).alias(f"{side}{c}") for c in marks.columns if c != "id"])
    return rows.join(at, key)


def _upright(rows: DataFrame, by: list[str]) -> DataFrame:
    """The motion of each group of (bx, by, bz) onto (ax, ay, az): least squares in the plane, the median difference in z."""
    sums = rows.groupBy(*by).agg(
        (F.covar_pop("bx", "ay") - F.covar_pop("by", "ax")).alias("sin"),
        (F.covar_pop("bx", "ax") + F.covar_pop("by", "ay")).alias("cos"),
        *[F.avg(f"{s}{c}").alias(f"m{s}{c}") for s in "ab" for c in "xy"],
        F.median(F.col("az") - F.col("bz")).alias("tz"),
    )
    turn = F.atan2("sin", "cos")
    c, s = F.cos(turn), F.sin(turn)
    zero, one = F.lit(0.0), F.lit(1.0)
    turned = [c, -s, zero, s, c, zero, zero, zero, one]
    shift = [F.col("max") - (c * F.col("mbx") - s * F.col("mby")), F.col("may") - (s * F.col("mbx") + c * F.col("mby")), F.col("tz")]
    return sums.select(*by, *[v.alias(n) for v, n in zip([*turned, *shift], MOTION, strict=True)])


def _free(rows: DataFrame, by: list[str]) -> DataFrame:
    """The proper rotation and shift of each group by least squares: sums by Spark, 3 x 3 decompositions by batches."""
    means = [f"m{s}{c}" for s in "ab" for c in "xyz"]
    cross = [f"h{p}{q}" for p in "xyz" for q in "xyz"]
    sums = rows.groupBy(*by).agg(*[F.avg(m[1:]).alias(m) for m in means], *[F.covar_pop(f"b{p}", f"a{q}").alias(f"h{p}{q}") for p in "xyz" for q in "xyz"])
    kinds = dict(sums.dtypes)

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.column_stack([batch.column(c).to_numpy(False) for c in cross]).reshape(-1, 3, 3)
            to, of = (np.column_stack([batch.column(f"m{s}{c}").to_numpy(False) for c in "xyz"]) for s in "ab")
            u, _, vt = np.linalg.svd(h)
            v = vt.transpose(0, 2, 1).copy()
            v[:, :, 2] *= np.where(np.linalg.det(v @ u.transpose(0, 2, 1)) < 0, -1.0, 1.0)[:, None]
            r = v @ u.transpose(0, 2, 1)
            t = to - np.einsum("nij,nj->ni", r, of)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in by], *[pa.array(x) for x in (*r.reshape(-1, 9).T, *t.T)]], [*by, *MOTION])

    return sums.mapInArrow(turns, ", ".join([*[f"`{k}` {kinds[k]}" for k in by], *[f"{m} double" for m in MOTION]]))


def _moved() -> list[Column]:
    """bx, by, bz after the motion of the same row."""
    return [sum((F.col(f"r{i}{j}") * F.col(f"b{c}") for j, c in enumerate("xyz")), F.col(f"t{t}")) for i, t in enumerate("xyz")]


def inliers(motions: DataFrame, a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """motion, b_id, a_id: each moved landmark of b and its nearest of a within tolerance, the nearer one where two have the same.

    A landmark of b has one nearest of a, so going through the pairs by distance comes to the least for each a.
    """
    n, width = _tiles(b), F.lit(max(tolerance, 1e-9))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("tile")
    asked = b.select(F.col("id").alias("b_id"), *[F.col(c).alias(f"b{c}") for c in "xyz"], F.pmod(F.xxhash64("id"), F.lit(n)).alias("tile"))
    at = motions.select("motion", *MOTION, every).join(asked, "tile").select("motion", "b_id", *[v.alias(c) for v, c in zip(_moved(), "xyz", strict=True)])
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    beside = F.array(*[F.struct(*[(cell(c) + F.lit(k)).alias(f"i{c}") for c, k in zip("xyz", o, strict=True)]) for o in np.ndindex(3, 3, 3)])
    known = a.select(F.col("id").alias("a_id"), *[F.col(c).alias(f"a{c}") for c in "xyz"], F.explode(beside).alias("cell"))
    known = known.select("a_id", "ax", "ay", "az", *[(F.col(f"cell.i{c}") - 1).alias(f"i{c}") for c in "xyz"])
    d2 = sum((F.col(c) - F.col(f"a{c}")) ** 2 for c in "xyz")
    near = at.select("*", *[cell(c).alias(f"i{c}") for c in "xyz"]).join(known, ["ix", "iy", "iz"]).withColumn("d2", d2).where(F.col("d2") <= tolerance * tolerance)
    own = near.groupBy("motion", "b_id").agg(F.min(F.struct("d2", "a_id")).alias("m"))
    return own.groupBy("motion", F.col("m.a_id").alias("a_id")).agg(F.min(F.struct("m.d2", "b_id")).alias("m")).select("motion", F.col("m.b_id").alias("b_id"), "a_id")


def _disagreement() -> Column:
    """0 to 1 of a matched pair: sizes, axis ratios and directions of the long axes once moved."""
    apart = lambda p, q: F.abs(p - q) / F.greatest(p + q, F.lit(1e-9))
    size = [F.greatest(F.col(f"{s}area"), F.lit(1e-9)) for s in "ab"]
    ratio = [F.col(f"{s}semi_major") / F.greatest(F.col(f"{s}semi_minor"), F.lit(1e-9)) for s in "ab"]
    bx, by = F.cos("borientation"), F.sin("borientation")
    ax, ay = F.cos("aorientation"), F.sin("aorientation")
    cosine = F.abs((F.col("r00") * bx + F.col("r01") * by) * ax + (F.col("r10") * bx + F.col("r11") * by) * ay)
    return (apart(*size) + apart(*ratio) + F.acos(F.least(cosine, F.lit(1.0))) / (np.pi / 2)) / 3


def motion_sets(a: DataFrame, b: DataFrame, mode: str = "4dof", tolerance: float = 2.0) -> DataFrame:
    """mode, pairs (b, a), n, rms, shape and the motion, refitted, of each set of landmarks that some motion brings together.

    Motions are judged all at once; equal sets are one row, as the refit hangs on the set alone.
    """
    if mode not in ("4dof", "6dof"):
        raise ValueError("mode is 4dof or 6dof")
    size, fit = (2, _upright) if mode == "4dof" else (3, _free)
    shaped = all(c in d.columns for c in SHAPE for d in (a, b))
    a, b = (table(d.select("id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", *(SHAPE if shaped else ()))]).dropna(subset=["id", "x", "y", "z"])) for d in (a, b))
    gate = pair_gate(a, b, tolerance).where("da > 0") if size == 2 else triplet_gate(a, b, tolerance)
    ends = [F.struct(F.col(f"a{k}").alias("a_id"), F.col(f"b{k}").alias("b_id")) for k in range(1, size + 1)]
    seeds = gate.select(F.array(*ends).alias("motion")).select("motion", F.explode("motion").alias("e")).select("motion", "e.a_id", "e.b_id")
    name = F.concat_ws(",", F.transform("motion", lambda e: F.concat_ws(":", e["a_id"].cast("string"), e["b_id"].cast("string"))))
    seeds = _placed(_placed(seeds.withColumn("motion", name), a, "a_id", "a"), b, "b_id", "b")
    found = table(inliers(table(fit(seeds, ["motion"])), a, b, tolerance))
    sets = found.groupBy("motion").agg(F.array_sort(F.collect_list(F.struct(F.col("b_id").alias("b"), F.col("a_id").alias("a")))).alias("pairs"))
    # one motion stands for its set
    chosen = sets.where(F.size("pairs") >= size).groupBy("pairs").agg(F.min("motion").alias("motion"))
    rows = table(_placed(_placed(chosen.select("motion", F.explode("pairs").alias("e")).select("motion", "e.a", "e.b").toDF("motion", "a_id", "b_id"), a, "a_id", "a"), b, "b_id", "b"))
    refit = fit(rows, ["motion"])
    d2 = sum((v - F.col(f"a{c}")) ** 2 for v, c in zip(_moved(), "xyz", strict=True))
    worth = rows.join(refit, "motion").groupBy("motion").agg(F.sqrt(F.avg(d2)).alias("rms"), (F.avg(_disagreement()) if shaped else F.lit(0.0)).alias("shape"))
    return chosen.join(worth, "motion").join(refit, "motion").select(F.lit(mode).alias("mode"), "pairs", F.size("pairs").alias("n"), "rms", "shape", *MOTION)


def best_motion(a: DataFrame, b: DataFrame, mode: str = "auto", tolerance: float = 2.0, least: int = 3) -> DataFrame:
    """One row or none: mode, pairs, n, margin (over the next set of that mode), rms, shape and the motion.

    The most landmarks win, then the smallest rms, then the best agreement of shapes;
    auto takes six degrees of freedom only where they bring more together. No row:
    no motion brings least landmarks together.
    """
    tried = [motion_sets(a, b, m, tolerance) for m in ("4dof", "6dof") if mode in ("auto", m)]
    if not tried:
        raise ValueError("mode is auto, 4dof or 6dof")
    order = [F.desc("n"), F.round("rms", 6), "shape", "pairs"]
    # two rows of each mode
    top = [t.orderBy(*order).limit(2) for t in tried]
    two = [t.agg(F.sort_array(F.collect_list("n"), asc=False).alias("ns")).select(F.lit(m).alias("mode"), (F.col("ns")[0] - F.coalesce(F.get("ns", F.lit(1)), F.lit(0))).alias("margin")) for t, m in zip(top, [m for m in ("4dof", "6dof") if mode in ("auto", m)], strict=True)]
    all_top, margins = (x[0] if len(x) == 1 else x[0].unionByName(x[1]) for x in (top, two))
    one = all_top.orderBy(F.desc("n"), "mode", *order[1:]).limit(1).where(F.col("n") >= least)
    return one.join(margins, "mode").select("mode", "pairs", "n", "margin", "rms", "shape", *MOTION)
