"""Voids as landmarks: detection on an occupancy grid, matching of two constellations, rigid fits.

Cells are found with rasters; what is left (a row for each void) is small, and
sides of more than MOST_LANDMARKS are refused before anything is collected.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.functions import columns as C
from karst.operators import constellations, geometry, graphs, rasters, stats
from karst.operators.spatial import near_pairs

MOST_LANDMARKS = 500
MOST_6DOF = 25


def occupied(cells: DataFrame, least: float = 1, relative: float | None = None, window: int = 21, smooth: float = 0.0) -> DataFrame:
    """Cells that count as filled: so many points, or a share of the median count around; smooth: of counts after a Gaussian of so many cells."""
    counts = cells.select("ix", "iy", "n")
    if smooth > 0:
        counts = rasters.gaussian(counts, smooth, "n").withColumnRenamed("smooth", "n")
    if relative is None:
        return counts.where(F.col("n") >= least).select("ix", "iy")
    # empty cells count as zero, and none of them is filled but where the median around is zero, too
    full = rasters.dense(counts, "n", F.lit(0))
    near = rasters.median_filter(full, window, "n")
    kept = (full if smooth > 0 else cells).join(near, ["ix", "iy"])
    return kept.where(F.col("n") >= F.lit(relative) * F.col("median")).select("ix", "iy")


def ceiling_cells(cells: DataFrame, jump: float, least: float = 1, relative: float | None = None, window: int = 21, smooth: float = 0.0, size: int = 7) -> DataFrame:
    """Cells where a ceiling is missing or more than jump off its surroundings: the highest point against the median around (empty cells at the median of all), and enclosed empty cells."""
    full = occupied(cells, least, relative, window, smooth)
    heights = full.join(cells.select("ix", "iy", F.col("zmax").cast("double").alias("h")), ["ix", "iy"])
    middle = heights.agg(F.median("h")).first()[0]
    local = rasters.median_filter(rasters.dense(heights, "h", F.lit(float(middle or 0.0))), size, "h")
    off = heights.join(local, ["ix", "iy"]).where(F.abs(F.col("h") - F.col("median")) > jump).select("ix", "iy")
    return off.unionAll(rasters.enclosed(full).select("ix", "iy")).distinct()


def _shapes(named: DataFrame, res: float) -> DataFrame:
    """component, n, x, y, area, radius and ellipse of labelled cells (component, x, y): of fewer than three a circle."""
    shape = named.groupBy("component").agg(*stats.ellipse("x", "y"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    area = F.col("n") * res * res
    circle, few = F.sqrt(area / F.pi()), F.col("n") < 3
    flat = few | ~(F.col("semi_major") > 0)
    return shape.withColumns({"area": area, "radius": circle, "semi_major": F.when(flat, circle).otherwise(F.col("semi_major")), "semi_minor": F.when(flat, circle).otherwise(F.col("semi_minor")), "orientation": F.when(few, F.lit(0.0)).otherwise(F.col("orientation"))})


def holes_of(labelled: DataFrame, cells: DataFrame, res: float, low: tuple[float, float], min_area: float = 0.0, max_area: float = float("inf"), body: DataFrame | None = None, merge: float | None = None) -> DataFrame:
    """component, n, x, y, z, area, radius and ellipse of labelled hole cells (ix, iy, component).

    The level z is the median of mean heights of cells with points in a hole or
    beside it (of all cells where there are none).  With a body (cells), a hole whose
    centre is not in it is left out.  merge: holes whose ellipses, widened by it, reach
    each other become one, also over others, with the cells of all and the mean level
    by cells.
    """
    named = labelled.select("component", "ix", "iy", (F.col("ix") * res + low[0] + res / 2).alias("x"), (F.col("iy") * res + low[1] + res / 2).alias("y")).persist()
    shape = _shapes(named, res).where(F.col("area").between(min_area, max_area))
    if body is not None:
        middle = [F.bround((F.col(c) - low[k] - res / 2) / res).cast("long").alias(f"i{c}") for k, c in enumerate("xy")]
        shape = shape.withColumns({f"i{c}": m for c, m in zip("xy", middle, strict=True)}).join(body, ["ix", "iy"], "left_semi").drop("ix", "iy")
    touching = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in ((0, 0), *rasters.CROSS)])
    heights = cells.where("n > 0").select("ix", "iy", (F.col("zsum") / F.col("n")).alias("h"))
    rim = named.select("component", F.explode(F.transform(touching, lambda o: F.struct((F.col("ix") + o["a"]).alias("ix"), (F.col("iy") + o["b"]).alias("iy")))).alias("c")).select("component", "c.ix", "c.iy").distinct()
    level = rim.join(heights, ["ix", "iy"]).groupBy("component").agg(F.median("h").alias("z"))
    every = heights.agg(F.median("h").alias("_z"))
    shape = shape.join(level, "component", "left").crossJoin(F.broadcast(every)).withColumn("z", F.coalesce("z", "_z")).drop("_z")  # every is one row
    if merge is None:
        return shape
    shape = shape.persist()
    ids = shape.select(F.col("component").alias("id"), "x", "y", "semi_major", "semi_minor", "orientation")
    roots = graphs.components(ids, overlaps(ids, merge)).withColumnRenamed("node", "component")
    level = shape.join(roots, "component").groupBy("root").agg((F.sum(F.col("z") * F.col("n")) / F.sum("n")).alias("z"), F.count("*").alias("merged"))
    pooled = _shapes(named.join(roots, "component").select(F.col("root").alias("component"), "x", "y"), res)
    return pooled.join(level.withColumnRenamed("root", "component"), "component")


def _body(filled: DataFrame, edge: int) -> DataFrame | None:
    for _ in range(edge):
        filled = rasters.erode(filled)
    return filled if edge else None


def voids(cells: DataFrame, res: float, low: tuple[float, float], least: float = 1, min_area: float = 0.0, max_area: float = float("inf"), relative: float | None = None, window: int = 21, edge: int = 0, smooth: float = 0.0, merge: float | None = None) -> DataFrame:
    """Enclosed voids of an occupancy grid, as holes_of gives them; edge: centres within so many cells of the outline are left out."""
    full = occupied(cells, least, relative, window, smooth)
    found = rasters.enclosed(full).persist()
    return holes_of(found, cells, res, low, min_area, max_area, _body(full.unionAll(found.select("ix", "iy")), edge), merge)


def ceiling_holes(cells: DataFrame, res: float, low: tuple[float, float], jump: float = 1.5, least: float = 1, min_area: float = 0.0, max_area: float = float("inf"), relative: float | None = None, window: int = 21, edge: int = 0, smooth: float = 0.0, merge: float | None = None) -> DataFrame:
    """Holes of a ceiling (cells of a cloud turned upright), as holes_of gives them."""
    found = rasters.label(ceiling_cells(cells, jump, least, relative, window, smooth))
    full = occupied(cells, least, relative, window, smooth)
    body = _body(full.unionAll(rasters.enclosed(full).select("ix", "iy")), edge) if edge else None
    return holes_of(found, cells, res, low, min_area, max_area, body, merge)


def overlaps(holes: DataFrame, factor: float) -> DataFrame:
    """a, b: pairs (a < b) whose ellipses, widened by factor, reach each other."""
    largest = holes.agg(F.max(F.greatest("semi_major", "semi_minor"))).first()[0]
    h = holes.select("id", "x", "y", "semi_major", "semi_minor", "orientation")
    # no two reach further than twice the largest: cells as wide as that
    pairs = near_pairs(h, h, max(2 * factor * (largest or 0.0), 1e-9), "xy").where("a.id < b.id")
    toward = F.atan2(F.col("b.y") - F.col("a.y"), F.col("b.x") - F.col("a.x"))
    r = [C.ellipse_radius(F.col(f"{s}.semi_major"), F.col(f"{s}.semi_minor"), F.col(f"{s}.orientation"), toward) for s in "ab"]
    gap = F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))
    return pairs.where(gap <= F.lit(factor) * (r[0] + r[1])).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def gated_pairs(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """a1, a2, b1, b2, da, db: pairs a1 < a2, and b's both ways round, whose distances agree within tolerance."""
    turned = constellations.pair_gate(b, a, tolerance)
    return turned.select(*[F.col(c).alias(n) for c, n in (("b1", "a1"), ("b2", "a2"), ("a1", "b1"), ("a2", "b2"), ("db", "da"), ("da", "db"))])


def distances(marks: DataFrame) -> DataFrame:
    """a, b, dist of all pairs (a < b)."""
    return constellations.pairs(marks).withColumnsRenamed({"p": "a", "q": "b"})


def kabsch(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The proper rotation and shift that best carry source onto target, as 4x4."""
    s, t = source.mean(axis=0), target.mean(axis=0)
    u, _, vt = np.linalg.svd((source - s).T @ (target - t))
    flip = np.ones(source.shape[1])
    flip[-1] = np.sign(np.linalg.det(vt.T @ u.T)) or 1.0
    r = vt.T @ np.diag(flip) @ u.T
    out = np.eye(4)
    k = source.shape[1]
    out[:k, :k], out[:k, 3] = r, t - r @ s
    return out


def upright(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Turn about z and shift in the plane by least squares; the shift in z is the median difference."""
    out = kabsch(source[:, :2], target[:, :2])
    out[2, 3] = np.median(target[:, 2] - source[:, 2])
    return out


@dataclass
class Match:
    """matrix carries b's landmarks onto a's; inliers are (b, a) positions."""

    matrix: np.ndarray
    inliers: list[tuple[int, int]]
    rms: float
    mode: str
    margin: int = 0
    shape: float = 0.0
    warnings: list[str] = field(default_factory=list)


def _assigned(moved: np.ndarray, target: np.ndarray, tolerance: float) -> list[tuple[int, int]]:
    d = np.linalg.norm(moved[:, None] - target[None], axis=2)
    best, out, used = d.argmin(axis=1), [], set()
    for i in np.argsort(d.min(axis=1), kind="stable").tolist():
        if d[i, best[i]] <= tolerance and best[i] not in used:
            used.add(int(best[i]))
            out.append((i, int(best[i])))
    return sorted(out)


def _shape_cost(b: np.ndarray, a: np.ndarray, pairs: list[tuple[int, int]], matrix: np.ndarray, up_a: np.ndarray, up_b: np.ndarray) -> float:
    """Mean disagreement, 0 to 1, of sizes, axis ratios and directions of the long axes once moved; columns after x, y, z: area, semi major, semi minor, orientation."""
    if a.shape[1] < 6 or not pairs:
        return 0.0
    i, j = np.array(pairs).T
    share = lambda p, q: np.abs(p - q) / np.maximum(p + q, 1e-9)
    ratio = lambda v: v[:, 4] / np.maximum(v[:, 5], 1e-9)
    terms = [share(np.maximum(b[i, 3], 1e-9), np.maximum(a[j, 3], 1e-9)), share(ratio(b[i]), ratio(a[j]))]
    if a.shape[1] > 6:
        z = (0, 0, 1)
        axes = [np.column_stack([np.cos(t), np.sin(t), 0 * t]) @ geometry.align(up, z) for t, up in ((b[i, 6], up_b), (a[j, 6], up_a))]
        cosine = np.abs(np.einsum("ij,ij->i", axes[0] @ matrix[:3, :3].T, axes[1]))
        terms.append(np.arccos(np.clip(cosine, 0, 1)) / (np.pi / 2))
    else:
        terms.append(np.zeros(len(i)))
    return float(np.mean(terms))


def match(a: np.ndarray, b: np.ndarray, mode: str = "auto", tolerance: float = 2.0, least: int = 3, up_a: Sequence[float] = (0, 0, 1), up_b: Sequence[float] = (0, 0, 1)) -> Match:
    """Best motion of landmarks b onto a: most inliers, then smallest rms, then best agreement of shapes.

    With four degrees of freedom b's up is first turned to a's and the motion then
    keeps it: a turn about it, a shift across by least squares and along by the median.
    """
    if len(a) > MOST_LANDMARKS or len(b) > MOST_LANDMARKS:
        raise ValueError(f"more than {MOST_LANDMARKS} landmarks")
    if len(a) < 2 or len(b) < 2:
        raise ValueError("matching needs two landmarks on each side")
    up_a, up_b = geometry.unit(up_a), geometry.unit(up_b)
    upright_a, upright_b = (geometry.motion(geometry.align(u, (0, 0, 1)), (0, 0, 0)) for u in (up_a, up_b))

    def kept_up(source: np.ndarray, target: np.ndarray) -> np.ndarray:
        return upright_a.T @ upright(source @ upright_b[:3, :3].T, target @ upright_a[:3, :3].T) @ upright_b

    found: dict[frozenset, Match] = {}
    pa, pb = a[:, :3], b[:, :3]
    for m, size, fit in (("4dof", 2, kept_up), ("6dof", 3, kabsch)):
        if mode not in ("auto", m) or size == 3 and (mode == "auto" and max(len(a), len(b)) > MOST_6DOF or min(len(a), len(b)) < 3):
            continue
        if size == 3 and max(len(a), len(b)) > MOST_6DOF:
            raise ValueError(f"six degrees of freedom need at most {MOST_6DOF} landmarks")
        for s, t in _seeds(pa, pb, size, tolerance):
            matrix = fit(pb[list(s)], pa[list(t)])
            pairs = _assigned(pb @ matrix[:3, :3].T + matrix[:3, 3], pa, tolerance)
            if len(pairs) < size:
                continue
            i, j = map(list, zip(*pairs, strict=True))
            if len(pairs) > size:
                matrix = fit(pb[i], pa[j])
            rms = float(np.sqrt(((pb[i] @ matrix[:3, :3].T + matrix[:3, 3] - pa[j]) ** 2).sum(axis=1).mean()))
            new = Match(matrix, pairs, rms, m, shape=_shape_cost(b, a, pairs, matrix, up_a, up_b))
            old = found.get(frozenset(pairs))
            if old is None or (new.rms, new.shape) < (old.rms - 1e-12, old.shape):
                found[frozenset(pairs)] = new
    ranked = sorted(found.values(), key=lambda x: (-len(x.inliers), round(x.rms, 6), x.shape, x.mode))
    if not ranked or len(ranked[0].inliers) < min(least, len(a), len(b)):
        raise ValueError("no motion brings enough landmarks together")
    best = ranked[0]
    rival = next((x for x in ranked[1:] if frozenset(x.inliers) != frozenset(best.inliers)), None)
    best.margin = len(best.inliers) - (len(rival.inliers) if rival else 0)
    spread = pa[[j for _, j in best.inliers]]
    if best.margin <= 0:
        best.warnings.append("ambiguous: another motion brings as many together")
    if len(best.inliers) == 2:
        best.warnings.append("only two landmarks agree")
    if len(spread) > 2 and np.linalg.svd(spread - spread.mean(axis=0), compute_uv=False)[1] < tolerance:
        best.warnings.append("collinear landmarks")
    if best.rms > tolerance:
        best.warnings.append("rms above the tolerance")
    return best


def _seeds(pa: np.ndarray, pb: np.ndarray, size: int, tolerance: float) -> Iterator[tuple[tuple[int, ...], tuple[int, ...]]]:
    """Pairs or triplets of b with those of a at the same distances; distances of a are looked up in order, not all compared."""
    da, db = (np.linalg.norm(p[:, None] - p[None], axis=2) for p in (pa, pb))
    i, j = np.nonzero(~np.eye(len(pa), dtype=bool))
    order = np.argsort(da[i, j], kind="stable")
    i, j, d = i[order], j[order], da[i, j][order]
    for p, q in combinations(range(len(pb)), 2):
        lo, hi = np.searchsorted(d, [db[p, q] - tolerance, db[p, q] + tolerance], side="left")
        hi = np.searchsorted(d, db[p, q] + tolerance, side="right")
        for u, v in sorted(zip(i[lo:hi].tolist(), j[lo:hi].tolist(), strict=True)):
            if size == 2:
                if da[u, v] > 0:
                    yield (p, q), (u, v)
                continue
            for r in range(q + 1, len(pb)):
                near = (np.abs(da[u] - db[p, r]) <= tolerance) & (np.abs(da[v] - db[q, r]) <= tolerance)
                near[[u, v]] = False
                for w in np.flatnonzero(near).tolist():
                    yield (p, q, r), (u, v, w)


def vertical_residuals(a: np.ndarray, b: np.ndarray, found: Match, up: Sequence[float] = (0, 0, 1)) -> list[float]:
    """How far each matched landmark of b, once moved, is above the one of a."""
    up, m = geometry.unit(up), found.matrix
    return [float((m[:3, :3] @ b[i, :3] + m[:3, 3] - a[j, :3]) @ up) for i, j in found.inliers]


def rim(points: DataFrame, anchors: DataFrame, height: float, radius: float, inflate: float = 1.0, up: Sequence[float] = (0, 0, 1)) -> DataFrame:
    """Points (pid, x, y, z, ...) near their nearest anchor's opening: within the ellipse grown by inflate, or radius where there is none, and a band of height along up.

    anchors: pid, x, y, z and semi_major, semi_minor, mx, my, mz (direction of the
    long axis) or nulls.
    """
    from karst.operators.spatial import nearest

    u = geometry.unit(up)
    flat = geometry.align((0, 0, 1), u) @ np.array([1.0, 0.0, 0.0])
    round_ = F.col("semi_major").isNull()
    long = [F.when(round_, F.lit(float(flat[k]))).otherwise(F.col(f"m{c}")) for k, c in enumerate("xyz")]
    length = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    major = [c / length(long) for c in long]
    cross = [F.lit(float(u[k - 2])) * major[k - 1] - F.lit(float(u[k - 1])) * major[k - 2] for k in range(3)]
    minor = [c / length(cross) for c in cross]
    half = {c: F.when(round_, F.lit(float(radius))).otherwise(F.greatest(F.col(c) * float(inflate), F.lit(1e-6))) for c in ("semi_major", "semi_minor")}
    frame = anchors.select(
        F.col("pid").alias("anchor"), *[F.col(c).alias(f"_{c}") for c in "xyz"], *[major[k].alias(f"_a{k}") for k in range(3)], *[minor[k].alias(f"_b{k}") for k in range(3)], *[v.alias(f"_{c}") for c, v in half.items()]
    )
    own = nearest(points, anchors).select("pid", "anchor").join(frame, "anchor")
    off = [F.col(c) - F.col(f"_{c}") for c in "xyz"]
    along, across = (sum((off[k] * F.col(f"_{v}{k}") for k in range(3)), F.lit(0.0)) for v in "ab")
    lift = sum((off[k] * F.lit(float(u[k])) for k in range(3)), F.lit(0.0))
    inside = ((along / F.col("_semi_major")) ** 2 + (across / F.col("_semi_minor")) ** 2 <= 1) & (F.abs(lift) <= height)
    joined = points.join(own, "pid").where(inside)
    return joined.drop(*[c for c in frame.columns if c != "anchor"])


def refine(source: np.ndarray, target: np.ndarray, start: np.ndarray, dof: int = 4, most_shift: float = 2.0, rounds: int = 50, reach: float = 5.0) -> tuple[np.ndarray, bool]:
    """Point-to-point ICP of rim points; kept only if it lowers the rms and moves no further than most_shift. Returns the motion and whether it changed."""
    if len(source) < 4 or len(target) < 4:
        return start, False

    def nearest(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = [((q[:, None] - target[None]) ** 2).sum(axis=2) for q in np.array_split(p, max(1, len(p) // 512))]
        d = np.concatenate([x.min(axis=1) for x in out])
        return np.sqrt(d), np.concatenate([x.argmin(axis=1) for x in out])

    def moved(m: np.ndarray) -> np.ndarray:
        return source @ m[:3, :3].T + m[:3, 3]

    matrix, fit = start, upright if dof == 4 else kabsch
    for _ in range(rounds):
        d, at = nearest(moved(matrix))
        near = d <= reach
        if near.sum() < 4:
            return start, False
        new = fit(source[near], target[at[near]])
        change = np.abs(new - matrix).max()
        matrix = new
        if change < 1e-9:
            break
    before, after = (float(np.sqrt((np.minimum(nearest(moved(m))[0], reach) ** 2).mean())) for m in (start, matrix))
    shift = np.linalg.norm(moved(matrix).mean(axis=0) - moved(start).mean(axis=0))
    if shift > most_shift or after > before + 1e-9:
        return start, False
    return matrix, True


def up_axis(points: DataFrame, k: int = 30, most: int = 20_000) -> np.ndarray:
    """Direction most surface normals agree on, with z upward; fewer than k + 1 points give (0, 0, 1).

    Normals are those of `most` points, chosen by a hash, and of their neighbours in the
    whole cloud; what goes to the driver is the sum of their outer products.
    """
    import pyarrow as pa

    from karst.operators.kd import nearest_among

    slim = points.select("pid", "x", "y", "z")
    if slim.limit(k + 1).count() < k + 1:
        return np.array([0.0, 0.0, 1.0])
    seeds = slim.orderBy(F.xxhash64("pid"), "pid").limit(most)
    near = nearest_among(seeds, slim, k).select("pid", F.col("other").alias("o"))
    pairs = ("xx", "xy", "xz", "yy", "yz", "zz")
    grouped = near.join(slim.withColumnRenamed("pid", "o"), "o").groupBy("pid").agg(*[F.covar_samp(a, b).alias(a + b) for a, b in pairs])

    def products(batches):
        for batch in batches:
            xx, xy, xz, yy, yz, zz = (batch.column(c).to_numpy() for c in pairs)
            m = np.stack([xx, xy, xz, xy, yy, yz, xz, yz, zz], axis=1).reshape(-1, 3, 3)
            n = np.linalg.eigh(m)[1][:, :, 0]
            yield pa.RecordBatch.from_arrays([pa.array(n[:, "xyz".index(a)] * n[:, "xyz".index(b)]) for a, b in pairs], list(pairs))

    xx, xy, xz, yy, yz, zz = grouped.select(*pairs).mapInArrow(products, ", ".join(f"{c} double" for c in pairs)).agg(*[F.sum(c) for c in pairs]).first()
    total = np.array([[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]])
    up = np.linalg.eigh(total)[1][:, -1]
    return up if up[2] >= 0 else -up
