"""SimHash near-duplicates through shard trees of Burkhard and Keller.

Two fingerprints that differ in at most R bits agree in at least one of R + 1
groups of bits, and in at least k of R + k.  A shard holds the distinct
fingerprints that agree in one choice of k groups, so every link lies inside some
shard.  The groups are as narrow as keeps shards of unrelated fingerprints near
SHARD, so the search is the trees': each shard gets a BK-tree, a node's children
are keyed by their integer Hamming distance to it, and a search follows only the
edges within R of its own distance.  The trees are not broadcast whole, as they
grow with the corpus: a shard's tree lives in the task that holds the shard.

The trees of a task's shards are built and searched together, level by level, as
arrays.  On the way down a fingerprint is linked to every ancestor within R; where
that joins most of a shard (near copies), only what is outside its largest part is
searched for, so such a shard takes no time that grows as its square; one of more
than MOST_TOGETHER is dealt over tasks in tiles.  Only what connects a shard's fingerprints leaves it (a row for each at most), and copies share
one fingerprint, so a large group of copies makes no pairs.

Defined results: null and empty texts have the fingerprint zero and are linked
like any other; repeated rows are each reported; a null doc_id is kept and never a
component's name unless all of its documents lack one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from karst.llm.common import group_starts, stored, whole_groups
from karst.llm.components import connected_components
from karst.llm.decontaminate import spread, word_column

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Shards of unrelated fingerprints shall hold about so many at most.
SHARD = 512
#: Fingerprints whose trees are built together, and (searched, node) steps taken together, about.
TOGETHER, STEPS = 40_000, 2_000_000
#: The most fingerprints of a shard in one task, and how many of them, about, go to all tiles of a larger one.
MOST_TOGETHER, PIVOTS = 500_000, 1_000
_FOLD = np.array([b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256)], np.uint8)


def fingerprints_of(texts: pa.Array, words: int = SHINGLE) -> np.ndarray:
    """64-bit SimHash of each text's shingles of so many words, repeats included."""
    column, counts = word_column(texts, _FOLD)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)
    n = len(column)
    # words again, now one blank apart
    size = np.diff(ends)
    raw = np.full(int(ends[-1]) + n, 32, np.uint8)
    raw[np.arange(int(ends[-1])) + np.repeat(np.arange(n), size)] = np.frombuffer(data, np.uint8)[: int(ends[-1])]
    begin, buf, out = ends[:-1] + np.arange(n), raw.tobytes(), np.zeros(len(counts), np.uint64)
    stop, digest, at = begin + size, xxhash.xxh64_intdigest, 0
    for i, k in enumerate(counts.tolist()):
        if k:
            a = begin[at : at + max(k - words + 1, 1)].tolist()
            b = stop[at + min(words, k) - 1 : at + k].tolist()
            h = np.array([digest(buf[x:y], SEED) for x, y in zip(a, b, strict=True)], np.uint64)
            ones = np.zeros(64, np.int64)
            for j in range(0, len(h), 65536):
                ones += np.unpackbits(h[j : j + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(2 * ones > len(h)).view(">u8")[0]
        at += k
    return out


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id, key (a hash of the text), fp (the 64 bits as a long)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).cumsum()
            i = 0
            while i < len(size):
                j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + 4_000_000, "right")))
                fp = fingerprints_of(batch.column("text").slice(i, j - i), words)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("key").slice(i, j - i), pa.array(fp.view(np.int64))], ["doc_id", "key", "fp"])
                i = j

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    return slim.mapInArrow(make, "doc_id long, key long, fp long")


def shard_masks(n: int, radius: int) -> list[int]:
    """The choices of bit groups for n fingerprints, as masks; one shard where they are few."""
    bits = max(0, (max(n, 1) - 1) // SHARD).bit_length()
    if not bits:
        return [0]
    k = 1
    while k < 4 and bits > k * (64 // (radius + k)):
        k += 1
    width = min(64 // (radius + k), -(-bits // k))
    groups = [((1 << width) - 1) << 64 * i // (radius + k) for i in range(radius + k)]
    return [sum(c) for c in combinations(groups, k)]


class Forest:
    """Sets of equal members, by their numbers."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def top(self, x: np.ndarray) -> np.ndarray:
        y = self.up[x]
        while (y != (z := self.up[y])).any():
            y = z
        self.up[x] = y
        return y

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.top(a), self.top(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hamming distances of rows of one or more 64-bit words."""
    d = np.bitwise_count(x ^ y)
    return d.astype(np.int64) if d.ndim == 1 else d.sum(axis=1, dtype=np.int64)


class BKTrees:
    """A BK-tree for each shard, over rows of code in shard order; a shard's first row is its root.

    parent and edge (the distance to it) of each row; near: (row, ancestor within
    radius), all of them, nearest the root first.  Of rows with equal codes the first
    is a node; the others are its twins, at twins[twin_ends[node] : twin_ends[node + 1]].
    """

    def __init__(self, code: np.ndarray, starts: np.ndarray, radius: int):
        n = len(code)
        self.code, self.radius, self.bits = code, radius, 64 * (1 if code.ndim == 1 else code.shape[1])
        self.root = np.repeat(starts[:-1], np.diff(starts))
        self.parent, self.edge = np.full(n, -1), np.zeros(n, np.int64)
        here, left, near, twin_of = self.root.copy(), np.arange(n), [], np.full(n, -1)
        left = left[left != here]
        while len(left):
            d = distances(code[left], code[here[left]])
            close = d <= radius
            near.append((left[close], here[left[close]]))
            key, first, which = np.unique(here[left] * (self.bits + 1) + d, return_index=True, return_inverse=True)
            child = left[first]
            new, twin = left == child[which], d == 0
            self.parent[left[new & ~twin]], self.edge[left[new & ~twin]] = here[left[new & ~twin]], d[new & ~twin]
            twin_of[left[twin]] = here[left[twin]]
            here[left] = child[which]
            left = left[~new & ~twin]
        self.near = tuple(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in zip(*near, strict=True)) if near else (np.zeros(0, np.int64),) * 2
        twins = np.flatnonzero(twin_of >= 0)
        self.twins = twins[np.argsort(twin_of[twins], kind="stable")]
        self.twin_ends = np.append(0, np.bincount(twin_of[twins], minlength=n).cumsum()) if n else np.zeros(1, np.int64)
        self.children = np.flatnonzero(self.parent >= 0)
        self.children = self.children[np.lexsort((self.edge[self.children], self.parent[self.children]))]
        inner, count = np.unique(self.parent[self.children], return_counts=True)
        self.number = np.full(n, -1)
        self.number[inner] = np.arange(len(inner))
        # at[i, e]: the first child of inner node i with an edge of e or more
        table = np.bincount(self.number[self.parent[self.children]] * (self.bits + 2) + self.edge[self.children] + 1, minlength=len(inner) * (self.bits + 2))
        self.at = table.reshape(len(inner), self.bits + 2).cumsum(axis=1) + (count.cumsum() - count)[:, None]

    def search(self, asked: np.ndarray, earlier: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(asked row, row of its shard within the radius); earlier: only rows before the asked one."""
        size = np.bincount(self.root, minlength=len(self.root))[self.root[asked]] if len(asked) else asked
        cut = np.searchsorted(size.cumsum(), np.arange(1, int(size.sum()) // STEPS + 1) * STEPS)
        for some in np.split(asked, cut):
            q, v = some, self.root[some]
            while len(q):
                if earlier:  # a node stands before all below it
                    keep = v < q
                    q, v = q[keep], v[keep]
                d = distances(self.code[q], self.code[v])
                hit = (d <= self.radius) & (v != q)
                yield q[hit], v[hit]
                i = self.number[v]
                inner = i >= 0
                q, d, i = q[inner], d[inner], i[inner]
                low = self.at[i, np.maximum(d - self.radius, 0)]
                n = self.at[i, np.minimum(d + self.radius, self.bits) + 1] - low
                q, v = np.repeat(q, n), self.children[spread(low, n)]


def shard_links(fp: np.ndarray, shard: np.ndarray, radius: int, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is within radius inside each shard (asked: of pairs with an asked row); rows of a shard stand together."""
    starts = np.append(np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])), len(fp)) if len(fp) else np.zeros(1, np.int64)
    forest, i = Forest(len(fp)), 0
    while i < len(starts) - 1:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + TOGETHER, "right")) - 1)
        _link_trees(fp, starts[i : j + 1], radius, forest, asked)
        i = j
    top = forest.top(np.arange(len(fp)))
    linked = np.flatnonzero(top != np.arange(len(fp)))
    return fp[linked], fp[top[linked]]


def _link_trees(fp: np.ndarray, starts: np.ndarray, radius: int, forest: Forest, asked: np.ndarray | None = None) -> None:
    first, own = int(starts[0]), starts - starts[0]
    trees = BKTrees(fp[first : int(starts[-1])], own, radius)
    forest.join(trees.near[0] + first, trees.near[1] + first)
    everyone = np.arange(int(own[-1]))
    if asked is not None:
        searches = [(everyone[asked[first : int(starts[-1])]], False)]
    else:
        outside, dense = outside_largest(forest.top(everyone + first), trees.root)
        searches = [(everyone[~dense], True), (everyone[outside & dense], False)]
    for some, earlier in searches:
        for q, v in trees.search(some, earlier):
            forest.join(q + first, v + first)


def outside_largest(part: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: whether it is outside the largest part of its shard, and whether that part holds over half of the shard."""
    n = len(part)
    if not n:
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.lexsort((part, shard))
    new = np.concatenate([[True], (part[order][1:] != part[order][:-1]) | (shard[order][1:] != shard[order][:-1])])
    run = np.empty(n, np.int64)
    run[order] = new.cumsum() - 1
    size = np.bincount(run)
    of = shard[order][new]  # the shard of each run
    best = np.lexsort((size, of))
    last = best[np.append(of[best][1:] != of[best][:-1], True)]
    largest = np.full(int(shard.max()) + 1, -1)
    largest[of[last]] = last
    total = np.bincount(shard, minlength=len(largest))
    mine = largest[shard]
    return run != mine, 2 * size[mine] > total[shard]


def links(distinct: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """a, b: links (all within radius, or through others that are) that connect the distinct fingerprints fp as all links do.

    A shard of more than MOST_TOGETHER is dealt in tiles, each with the same pivots
    among its own; then what is outside the shard's largest component goes to all of
    its tiles, so every link between components is found and no task holds the shard.
    """
    masks = shard_masks(n, radius)
    keys = ["mask", "key", "tile"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            starts = group_starts(table, keys)
            shard = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            asked = table.column("asked").to_numpy(zero_copy_only=False) if "asked" in table.column_names else None
            a, b = shard_links(table.column("fp").to_numpy().view(np.uint64), shard, radius, asked)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    choices = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(signed)])).alias("s")
    shards = distinct.select("fp", choices).select("fp", "s.mask", "s.key")
    parts = max(8, n * len(masks) // 200_000, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def linked(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, *keys).sortWithinPartitions(*keys, "fp").mapInArrow(work, "a long, b long")

    one = F.lit(0).cast("int")
    if n <= MOST_TOGETHER:
        return linked(shards.withColumn("tile", one))
    large = stored(shards.groupBy("mask", "key").agg(F.count("*").alias("rows")).where(F.col("rows") > MOST_TOGETHER), "large")
    if not large.head(1):
        return linked(shards.withColumn("tile", one))
    tiles = F.coalesce(F.ceil(F.col("rows") / MOST_TOGETHER), F.lit(1)).cast("int")
    pivot = F.pmod(F.xxhash64("fp", F.lit(1)), F.ceil(F.col("rows") / PIVOTS)) == 0
    every = F.sequence(one, tiles - 1)
    tile = F.when(F.col("rows").isNull(), F.array(one)).when(pivot, every).otherwise(F.array(F.pmod(F.xxhash64("fp"), tiles).cast("int")))
    dealt = shards.join(large, ["mask", "key"], "left").withColumn("tile", F.explode(tile))
    first = stored(linked(dealt.select("fp", *keys)), "links")
    roots = connected_components(first).withColumnRenamed("node", "fp")
    hot = stored(dealt.where("rows is not null").join(roots, "fp", "left").select("fp", *keys, "rows", F.coalesce("root", "fp").alias("root")), "hot")
    sizes = hot.groupBy("mask", "key", "root").agg(F.count("*").alias("size"))
    best = sizes.groupBy("mask", "key").agg(F.max_by("root", F.struct("size", "root")).alias("best"))
    outside = hot.join(best, ["mask", "key"]).where(F.col("root") != F.col("best")).select("fp", "mask", "key", "rows").distinct().withColumn("tile", F.explode(every))
    again = hot.select("fp", *keys, F.lit(False).alias("asked")).unionAll(outside.select("fp", *keys, F.lit(True)))
    return first.unionAll(linked(again))


def _named(docs: DataFrame, radius: int, words: int) -> DataFrame:
    """doc_id, key, fp, component_id, root (a fingerprint) for each document."""
    own = stored(fingerprints(docs, words), "fingerprints")
    classes = stored(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = connected_components(links(classes.select("fp"), classes.count(), radius))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.join(rooted.join(names, "root").select("fp", "component_id", "root"), "fp")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id for each document."""
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return _named(docs, radius, words).select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE) -> DataFrame:
    """The rows of docs with one document of each component: the smallest doc_id, of repeated rows one."""
    return first_of_each(docs, _named(docs, radius, words))


def first_of_each(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of docs with the smallest doc_id of each root; named: doc_id, key, root."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("k_id"), F.col("key").alias("k_text"))
    best = named.groupBy("root").agg(F.min(first).alias("b")).select("b.none", "b.k_id", "b.k_text")
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("k_row"), docs["doc_id"].isNull().alias("none"), F.coalesce(docs["doc_id"].cast("long"), F.lit(0)).alias("k_id"), F.xxhash64(docs["text"].cast("string")).alias("k_text"))
    same = Window.partitionBy("none", "k_id", "k_text").orderBy("none", "k_id", "k_text")
    return keyed.join(best, ["none", "k_id", "k_text"]).withColumn("n", F.row_number().over(same)).where("n = 1").select("k_row.*")
