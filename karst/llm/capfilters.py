"""Embedding near-duplicates by spherical-cap filters of structured random product codes.

A vector's coordinates, turned by each of TURNS fixed random rotations, are cut into
blocks, each with its own random code words; a filter's direction is one word from
each block, so few words make very many filters.  List decoding gives all filters whose
direction a vector exceeds the threshold for: partial sums over the blocks that
cannot reach it are dropped early.  Vectors are joined on filters, and every pair
that meets is verified in double precision.  The threshold follows the largest
label's number of vectors, so that unrelated vectors share a filter with about
BUCKET others at every size; the number of filters then follows from COMMON, how
many filters two vectors at the least similarity share on average (recall by
brute force is above 0.97 in the tests; the contract's least is 0.9).

Equal vectors are one class; a class is compared once.  A filter's group of more
than TILE classes is dealt out in pairs of tiles, so that no task holds more than
two.  A pair is counted in its first common filter alone, and what leaves a task
is a row for each class: its links, and one of a spanning forest.

Defined results: vectors that are null, zero, or hold null or non-finite parts,
and those without a label or id, link with nothing (component_id is their own
vec_id); vectors of different lengths do not link; repeated rows are vectors of
their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import erfc, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.llm.common import group_starts, stored, whole_groups
from karst.llm.components import connected_components
from karst.llm.simhash import Forest

LEAST = 0.93
BUCKET = 32
COMMON = 20.0
TURNS = 4
TILE = 4096
MOST_WORDS = 4096


def _tail(a: float) -> float:
    return erfc(a / sqrt(2)) / 2


def _both(a: float, cosine: float) -> float:
    """Chance that two standard normal numbers of this correlation both exceed a."""
    x = np.linspace(a, a + 8, 4001)
    density = np.exp(-(x**2) / 2) / np.sqrt(2 * np.pi)
    rest = np.array([_tail((a - cosine * v) / sqrt(1 - cosine**2)) for v in x])
    y = density * rest
    return float(((y[1:] + y[:-1]) / 2).sum() * (x[1] - x[0]))


def parameters(n: int, cosine: float) -> tuple[float, int, int]:
    """Threshold (in standard deviations), blocks of a rotation and words in each, for the largest group of n vectors."""
    low, high = 1.0, 8.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if _tail(mid) * n > BUCKET else (low, mid)
    filters = COMMON / TURNS / _both(low, cosine)
    blocks = 2
    while filters ** (1 / blocks) > MOST_WORDS:
        blocks += 1
    return low, blocks, int(np.ceil(filters ** (1 / blocks)))


class ProductCode:
    def __init__(self, dim: int, threshold: float, blocks: int, words: int, seed: int = 11):
        rng = np.random.default_rng([seed, dim])
        self.cuts = [dim * k // blocks for k in range(blocks + 1)]
        self.turns = []
        for _ in range(TURNS):
            turn, code = np.linalg.qr(rng.normal(size=(dim, dim)))[0], []
            for a, b in zip(self.cuts, self.cuts[1:]):
                # orthonormal frames, as many as it takes
                frames = [np.linalg.qr(rng.normal(size=(max(b - a, 1), max(b - a, 1))))[0] for _ in range(-(-words // max(b - a, 1)))]
                code.append(np.concatenate(frames)[:words, : b - a] * sqrt((b - a) / dim))
            self.turns.append((turn, code))
        self.least, self.size = threshold / sqrt(dim), words

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """For each unit vector (a row) the filters it exceeds the threshold for; of a rotation without any, the best one."""
        found = [self._turn(x, t) for t in range(TURNS)]
        return [np.concatenate(f) for f in zip(*found, strict=True)]

    def _turn(self, x: np.ndarray, t: int) -> list[np.ndarray]:
        turn, code = self.turns[t]
        x = x @ turn
        scores = [x[:, a:b] @ w.T for (a, b), w in zip(zip(self.cuts, self.cuts[1:]), code)]
        orders = [np.argsort(-s, axis=1) for s in scores]
        out = []
        for i in range(len(x)):
            ids, sums = np.full(1, t, np.int64), np.zeros(1)
            best = [s[i].max() for s in scores]
            for k, s in enumerate(scores):
                order = orders[k][i]
                # each partial sum takes the words that can still lead over the threshold
                n = np.searchsorted(-s[i][order], sums + sum(best[k + 1 :]) - self.least, side="right")
                base = np.repeat(np.arange(len(sums)), n)
                word = order[np.arange(len(base)) - np.repeat(n.cumsum() - n, n)]
                ids, sums = ids[base] * self.size + word, sums[base] + s[i][word]
            if not len(ids):
                first = t
                for o in orders:
                    first = first * self.size + int(o[i][0])
                ids = np.array([first], np.int64)
            out.append(np.sort(ids))
        return out


@cache
def _code(dim: int, threshold: float, blocks: int, words: int) -> ProductCode:
    return ProductCode(dim, threshold, blocks, words)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    # first by the largest part: squares of very large or small parts would leave the range
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _own_filters(filters: list[np.ndarray], f: int) -> np.ndarray:
    """A row of bits for each member: smaller filters that another member also has."""
    n = [int(np.searchsorted(x, f)) for x in filters]
    less = np.concatenate([x[:k] for x, k in zip(filters, n, strict=True)])
    who = np.repeat(np.arange(len(filters)), n)
    _, which, count = np.unique(less, return_inverse=True, return_counts=True)
    shared = count > 1
    number = shared.cumsum() - 1
    keep = shared[which]
    who, which = who[keep], number[which[keep]]
    bits = np.zeros((len(filters), int(shared.sum()) // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (who, which // 64), np.uint64(1) << (which % 64).astype(np.uint64))
    return bits


def _verify(x: np.ndarray, copies: np.ndarray, bits: np.ndarray, tile: np.ndarray, cross: bool, links: np.ndarray, forest: Forest, rows: np.ndarray, least: float) -> None:
    """Count each pair of members (cross pairs of two tiles) at least so similar, once over all filters."""
    for i in range(0, len(x), 512):
        s = x[i : i + 512] @ x[i:].T
        a, b = np.nonzero(s >= least - 1e-9)
        a, b = a + i, b + i
        ok = (a < b) & ((tile[a] != tile[b]) if cross else True)
        a, b = a[ok], b[ok]
        ok = np.einsum("ij,ij->i", x[a], x[b]) >= least
        a, b = a[ok], b[ok]
        forest.join(rows[a], rows[b])
        new = ~(bits[a] & bits[b]).any(axis=1)
        a, b = a[new], b[new]
        np.add.at(links, rows[a], copies[b])
        np.add.at(links, rows[b], copies[a])


def near_duplicates(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id, kept for each vector."""
    e = F.col("embedding")
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), F.col("label").cast("string").alias("label"))
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~F.exists(e, bad) & F.exists(e, lambda v: v != 0), F.lit(False))
    value = F.transform(e, lambda v: v + F.lit(0).cast(kind[6:-1]))  # one zero
    # classes by 128 bits of label and vector; rows that link with nothing have none
    rows = stored(slim.select("vec_id", "label", F.when(good, value).alias("e")).select("vec_id", "label", "e", F.when(F.col("e").isNotNull(), F.xxhash64("label", "e")).alias("k1"), F.when(F.col("e").isNotNull(), F.xxhash64(F.lit(1), "e", "label")).alias("k2")), "vectors")
    classes = rows.where("k1 is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("e").alias("e"))
    classes = stored(classes.withColumn("space", F.xxhash64("label", F.size("e"))), "classes")
    most = classes.groupBy("space").count().agg(F.max("count")).first()[0] or 1
    code = parameters(most, least)
    small = TURNS * code[2] ** code[1] < 1 << 31
    number, arrow = ("int", pa.int32()) if small else ("long", pa.int64())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            filters: list = [None] * batch.num_rows
            size = np.array([len(v) for v in batch.column("e")])
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                found = _code(int(dim), *code).decode(_unit(_matrix(batch.column("e").take(pa.array(at)))))
                for i, f in zip(at.tolist(), found, strict=True):
                    filters[i] = f
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "copies", "space", "e")), pa.array(filters, pa.list_(arrow))], ["rep", "copies", "space", "e", "filters"])

    coded = stored(classes.select("rep", "copies", "space", "e").mapInArrow(decode, f"rep long, copies long, space long, e {kind}, filters array<{number}>"), "filters")
    each = coded.select("rep", "copies", "space", "e", "filters", F.explode("filters").alias("f"))
    # groups of more than TILE are dealt in pairs of tiles; where there are none, no join is needed
    large = stored(coded.select("space", F.explode("filters").alias("f")).groupBy("space", "f").agg(F.count("*").alias("n")).where(F.col("n") > TILE), "large")
    one = F.lit(0).cast("int")
    if large.head(1):
        each = each.join(large, ["space", "f"], "left")
        tiles = F.coalesce(F.ceil(F.col("n") / TILE), F.lit(1)).cast("int")
        pair = F.transform(F.sequence(one, tiles - 1), lambda t: F.least(t, "tile") * 65536 + F.greatest(t, "tile"))
        dealt = each.withColumn("tile", F.pmod(F.xxhash64("rep"), tiles).cast("int")).withColumn("pair", F.explode(pair))
    else:
        dealt = each.withColumns({"tile": one, "pair": one})
    dealt = dealt.select("space", "f", "pair", "tile", "rep", "copies", "e", "filters")
    keys = ["space", "f", "pair"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            starts = group_starts(table, keys)
            rep, copies, tile, pair, f = (table.column(c).to_numpy() for c in ("rep", "copies", "tile", "pair", "f"))
            found = table.column("filters").combine_chunks()
            ends, flat = found.offsets.to_numpy(), found.values.to_numpy()
            links, forest = np.zeros(len(rep), np.int64), Forest(len(rep))
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                x = _unit(_matrix(table.column("e").slice(a, b - a)))
                s = [flat[ends[i] : ends[i + 1]] for i in range(a, b)]
                _verify(x, copies[a:b], _own_filters(s, int(f[a])), tile[a:b], pair[a] // 65536 != pair[a] % 65536, links, forest, np.arange(a, b), least)
            top = forest.top(np.arange(len(rep)))
            some = np.flatnonzero((links > 0) | (top != np.arange(len(rep))))
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(rep[top[some]]), pa.array(links[some])], ["a", "b", "links"])

    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = stored(dealt.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(verify, "a long, b long, links long"), "met")
    linked = met.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    roots = connected_components(met.select("a", "b")).withColumnRenamed("node", "rep")
    named = classes.select("k1", "k2", "rep", "copies").join(linked, "rep", "left").join(roots, "rep", "left").select("k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("root", "rep").alias("root"))
    out = rows.select("vec_id", "k1", "k2").join(named, ["k1", "k2"], "left")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("root", "vec_id"), F.lit(False)).alias("kept"))


#: All pairs by label; equal wherever no link is missed.
ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) >= 0.93 * sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))),
r AS (SELECT vec_id AS a, vec_id AS root FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.a WHERE r.root < l.b)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, min(root) AS component_id, v.vec_id = min(root) AS kept
FROM v JOIN r ON r.a = v.vec_id GROUP BY v.vec_id
"""
