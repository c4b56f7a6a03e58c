"""SimHash near-duplicates with an exact Jaccard similarity of their five-word shingles.

One 64-bit fingerprint within a few bits can not stand for a similarity of 0.8: sets
so alike differ in every bit with a chance of arccos(2s / (1 + s)) / pi = 0.15, in
about ten of 64.  So each set of shingles gets several SimHash fingerprints, and
shards are choices of a few of their bits, as many choices as let no more than MISS
of the pairs at 0.8 escape all (of closer ones fewer).  Each shard is a BK-tree over
the first 128 bits, searched within RADIUS by following only edges in reach, and
the pairs found are linked if their exact similarity is SIMILAR or more.

Texts with the same set are one node, so copies make no pairs.  Of the pairs in reach
those go first that their parities rule out: the parities of a set's hashes in some
places differ between two sets in no more places than the sets have elements apart.
What is left of a shard's pairs is taken as links for the moment, and a spanning
forest of them, less than one pair for each node, leaves the shard and is compared
exactly.  Shards of which a pair fails are searched again, with what was found to be
alike joined, what failed left out and parities in more places, until none fails; so
no link between components is lost.  From round to round MORE times as many forests,
none with a pair of another, leave such a shard, so rounds are few.

Texts of fewer than five words have one shingle, all their words; those without
words are alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.llm.common import group_starts, slices, stored, whole_groups
from karst.llm.components import connected_components
from karst.llm.decontaminate import spread, word_column
from karst.llm.simhash import _FOLD, SEED, TOGETHER, BKTrees, Forest, first_of_each, outside_largest

WORDS = 5
SIMILAR = 0.8
#: Share of the pairs at the least similarity that no shard may bring together.
MISS = 0.003
#: Nodes of a shard of unrelated ones, about, and the most bits that shards agree in.
SHARD, MOST_BITS = 1024, 14
#: Of 128 bits; sets at the least similarity differ in 19 on average, with a deviation of 4, unrelated ones in 64 of 6.
RADIUS = 34
#: Places of the first parities; later ones have two places or more for each element.
PLACES = 256
MORE, MOST_ROUNDS = 8, 20
#: For each byte a number with its bits as the lowest bits of eight bytes.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view("<u8")[:, 0]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def choices(n: int) -> list[tuple[int, int, int]]:
    """For n nodes the choices of bits that make a shard: fingerprint, first bit, bits."""
    width = min(MOST_BITS, (max(0, n - 1) // SHARD).bit_length())
    if not width:
        return [(0, 0, 0)]
    agree = 1 - acos(2 * SIMILAR / (1 + SIMILAR)) / pi
    groups, each = ceil(log(MISS) / log(1 - agree**width)), 64 // width
    return [(g // each, g % each * width, width) for g in range(groups)]


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes."""
    column, counts = word_column(texts, _FOLD)
    coded = column.dictionary_encode()
    digest = np.array([xxhash.xxh64_intdigest(x, SEED) for x in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
    w = digest[coded.indices.to_numpy()] if len(digest) else digest
    runs = _mix(w[: max(len(w) - words + 1, 0)])
    for k in range(1, words):
        runs = _mix(runs + w[k : k + len(runs)])
    at = 0
    for n in counts.tolist():
        if n >= words:
            yield np.unique(runs[at : at + n - words + 1])
        elif n:
            one = _mix(w[at : at + 1])
            for k in range(1, n):
                one = _mix(one + w[at + k : at + k + 1])
            yield one + np.uint64(n)
        else:
            yield np.zeros(0, np.uint64)
        at += n


def fingerprints_of(sets: list[np.ndarray], number: int) -> np.ndarray:
    """So many 64-bit SimHash fingerprints of each set (a row); zero for an empty one.

    A byte of a hash is looked up as eight counters of a byte each; sums of up to 255
    hashes do not overflow them.
    """
    out = np.zeros((len(sets), number), np.uint64)
    size = np.array([len(s) for s in sets], np.int64)
    some = np.flatnonzero(size)
    if not len(some):
        return out
    every, size = np.concatenate([sets[i] for i in some]), size[some]
    parts = -(-size // 255)
    first = parts.cumsum() - parts
    starts = np.repeat(size.cumsum() - size, parts) + 255 * spread(np.zeros(len(size), np.int64), parts)
    for f in range(number):
        raw = _mix(every + np.uint64((f + 1) * 0x9E3779B97F4A7C15 % (1 << 64))).astype("<u8").view(np.uint8).reshape(-1, 8)
        ones = np.stack([np.add.reduceat(_LANES[raw[:, k]], starts).astype("<u8").view(np.uint8).reshape(-1, 8) for k in range(8)], axis=1)
        ones = np.add.reduceat(ones.reshape(-1, 64), first, axis=0, dtype=np.int64)
        out[some, f] = np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def parities(shingles: np.ndarray, places: int) -> np.ndarray:
    """Of the counts of hashes in each of so many places (a power of two, 64 at least), 64 in a number."""
    return np.packbits(np.bincount((shingles % np.uint64(places)).astype(np.int64), minlength=places) & 1, bitorder="little").view("<u8")


def places_of(size: int) -> int:
    return max(PLACES, 1 << (2 * size - 1).bit_length())


def _node(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) - (1 << 63)


def sketches(docs: DataFrame, number: int) -> DataFrame:
    """doc_id, key (a hash of the text), node (of the set), prints (its fingerprints), mark (two of them, the set's size and first parities), odd (its later parities)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text"), 4_000_000):
                sets = list(shingle_sets(texts))
                prints = fingerprints_of(sets, number)
                mark = [prints[i, :2].tobytes() + len(x).to_bytes(8, "little") + parities(x, PLACES).tobytes() for i, x in enumerate(sets)]
                odd = [parities(x, places_of(len(x))).tobytes() for x in sets]
                columns = [batch.column("doc_id").slice(at, len(texts)), batch.column("key").slice(at, len(texts)), pa.array([_node(x) for x in sets], pa.int64()), pa.array(list(prints.view(np.int64)), pa.list_(pa.int64())), pa.array(mark, pa.binary()), pa.array(odd, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "node", "prints", "mark", "odd"])
                at += len(texts)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    return slim.mapInArrow(make, "doc_id long, key long, node long, prints array<long>, mark binary, odd binary")


def shingles_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """node, shingles (their sorted hashes, as bytes) for the texts that keys (key, node) names."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text"), 4_000_000):
                found = pa.array([s.tobytes() for s in shingle_sets(texts)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(at, len(texts)), found], ["node", "shingles"])
                at += len(texts)

    text = docs.select(F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    return text.join(keys, "key").select("node", "text").mapInArrow(make, "node long, shingles binary").dropDuplicates(["node"])


def compared(pairs: DataFrame, shingles: DataFrame, least: float = SIMILAR) -> DataFrame:
    """a, b, alike: whether the sets of a and b have a Jaccard similarity of at least `least`."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, hit = batch.column("sa"), batch.column("sb"), np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                hit[i] = both >= least * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(hit)], ["a", "b", "alike"])

    one = pairs.join(shingles.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    two = one.join(shingles.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    return two.select("a", "b", "sa", "sb").mapInArrow(keep, "a long, b long, alike boolean")


class Nodes:
    """The nodes of some shards: codes, sizes and parities."""

    def __init__(self, marks: list[bytes], odd: list[bytes] | None = None):
        mark = np.frombuffer(b"".join(marks), "<u8").reshape(len(marks), -1)
        self.code, self.size, self.first = np.ascontiguousarray(mark[:, :2]), mark[:, 2].astype(np.int64), np.ascontiguousarray(mark[:, 3:])
        self.odd: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if odd is not None:  # by the number of places
            n = np.array([len(x) for x in odd])
            self.words = n // 8
            for w in np.unique(self.words).tolist():
                rows = np.flatnonzero(self.words == w)
                number = np.full(len(odd), -1)
                number[rows] = np.arange(len(rows))
                self.odd[w] = number, np.frombuffer(b"".join(odd[i] for i in rows.tolist()), "<u8").reshape(-1, w)

    def may_be_alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs sizes and parities do not rule out."""
        out = np.zeros(len(a), bool)
        for i in range(0, len(a), 1 << 16):
            x, y = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
            low, high = np.minimum(self.size[x], self.size[y]), np.maximum(self.size[x], self.size[y])
            apart = (low + high) * ((1 - SIMILAR) / (1 + SIMILAR)) + 1e-6
            ok = low >= SIMILAR * high - 1e-6
            ok[ok] = np.bitwise_count(self.first[x[ok]] ^ self.first[y[ok]]).sum(axis=1, dtype=np.int64) <= apart[ok]
            if self.odd:
                ok[ok] = self._differ(x[ok], y[ok]) <= apart[ok]
            out[i : i + (1 << 16)] = ok
        return out

    def _differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = np.where(self.words[a] <= self.words[b], a, b), np.where(self.words[a] <= self.words[b], b, a)
        out = np.zeros(len(a), np.int64)
        for w, (number, odd) in self.odd.items():
            for v, (more, wide) in self.odd.items():
                some = np.flatnonzero((self.words[a] == w) & (self.words[b] == v))
                for i in range(0, len(some), max(1, (1 << 22) // v)):
                    k = some[i : i + max(1, (1 << 22) // v)]
                    # places are remainders, so more of them fold into fewer
                    folded = np.bitwise_xor.reduce(wide[more[b[k]]].reshape(len(k), -1, w), axis=1)
                    out[k] = np.bitwise_count(odd[number[a[k]]] ^ folded).sum(axis=1, dtype=np.int64)
        return out


def spanning(nodes: Nodes, starts: np.ndarray, first: int, part: np.ndarray | None = None, bad: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that may be alike and connect, without a cycle, what all such pairs of the shards connect.

    starts: where the shards begin, and the end; first: the row where they do in
    nodes; part: what is connected already; bad: pairs (row * rows + row) that are
    known not to be alike.
    """
    end = first + int(starts[-1])
    trees, forest, found, n = BKTrees(nodes.code[first:end], starts, RADIUS), Forest(end - first), [], len(nodes.size)
    everyone = np.arange(end - first)
    if part is not None:  # by shard: the rows of each part are joined to its first
        _, lead, which = np.unique(np.stack([trees.root, part], axis=1), axis=0, return_index=True, return_inverse=True)
        forest.join(everyone, lead[which.ravel()])

    def take(q: np.ndarray, v: np.ndarray) -> None:
        while len(q):
            a, b = forest.top(q), forest.top(v)
            apart = a != b
            q, v, a, b = q[apart], v[apart], a[apart], b[apart]
            # the larger of two roots hangs on the smaller, by one pair
            high, one = np.unique(np.maximum(a, b), return_index=True)
            forest.up[high] = np.minimum(a, b)[one]
            found.append((q[one], v[one]))

    def look(q: np.ndarray, v: np.ndarray) -> None:
        apart = forest.top(q) != forest.top(v)
        q, v = q[apart], v[apart]
        ok = nodes.may_be_alike(q + first, v + first)
        if bad is not None:
            ok[ok] = ~np.isin((np.minimum(q, v)[ok] + first) * n + np.maximum(q, v)[ok] + first, bad)
        take(q[ok], v[ok])

    look(*trees.near)
    outside, dense = outside_largest(forest.top(everyone), trees.root)
    for asked, earlier in ((everyone[~dense], True), (everyone[outside & dense], False)):
        for q, v in trees.search(asked, earlier):
            look(*with_twins(trees, q, v))
    a, b = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    return a + first, b + first


def with_twins(trees: BKTrees, q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs, and those of q with the rows whose code is v's."""
    n = trees.twin_ends[v + 1] - trees.twin_ends[v]
    if not n.any():
        return q, v
    a, b = np.repeat(q, n), trees.twins[spread(trees.twin_ends[v], n)]
    other = a != b
    return np.concatenate([q, a[other]]), np.concatenate([v, b[other]])


def _search(batches: Iterator[pa.RecordBatch], forests: int = 1) -> Iterator[pa.RecordBatch]:
    """a, b, shard from rows of shard, node, mark and, in later rounds, odd, good and bad (nodes known to be alike and not to be)."""
    for table in whole_groups(batches, ["shard"]):
        starts, node = group_starts(table, ["shard"]), table.column("node").to_numpy()
        later = "odd" in table.column_names
        nodes = Nodes(table.column("mark").to_pylist(), table.column("odd").to_pylist() if later else None)
        i = 0
        while i < len(starts) - 1:
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + TOGETHER, "right")) - 1)
            first, end = int(starts[i]), int(starts[j])
            part = bad = None
            if later:
                good, bad = (_met(table, c, node, starts[i : j + 1]) for c in ("good", "bad"))
                forest = Forest(end - first)
                forest.join(good // len(node) - first, good % len(node) - first)
                part = forest.top(np.arange(end - first))
            a, b = spanning(nodes, starts[i : j + 1] - first, first, part, bad)
            for _ in range(1, forests):
                bad = np.union1d(bad, np.minimum(a, b) * len(node) + np.maximum(a, b))
                more = spanning(nodes, starts[i : j + 1] - first, first, part, bad)
                if not len(more[0]):
                    break
                a, b = np.concatenate([a, more[0]]), np.concatenate([b, more[1]])
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b]), table.column("shard").combine_chunks().take(pa.array(a))], ["a", "b", "shard"])
            i = j


def _met(table: pa.Table, c: str, node: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Pairs (row * rows + row) of the same shard that column c names."""
    pairs: list[int] = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        at = {x: r for r, x in enumerate(node[a:b].tolist(), a)}
        for x, others in zip(at.values(), table.column(c).slice(a, b - a).to_pylist(), strict=True):
            pairs += [min(x, at[y]) * len(node) + max(x, at[y]) for y in others or () if y in at]
    return np.unique(np.array(pairs, np.int64))


def links(docs: DataFrame, own: DataFrame, chosen: list[tuple[int, int, int]]) -> DataFrame:
    """a, b: pairs of nodes with a similarity of SIMILAR or more, enough to connect what all pairs in reach connect."""
    spark = docs.sparkSession
    nodes = own.groupBy("node").agg(F.first("prints").alias("prints"), F.first("mark").alias("mark"))
    shard = [F.shiftrightunsigned(F.get("prints", F.lit(f)), first).bitwiseAND(F.lit((1 << width) - 1).cast("long")) + (g << 32) for g, (f, first, width) in enumerate(chosen)]
    shards = nodes.select("node", "mark", F.explode(F.array(*shard)).alias("shard"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def searched(rows: DataFrame, forests: int = 1) -> DataFrame:
        rows = rows.repartition(n, "shard").sortWithinPartitions("shard", "node").mapInArrow(lambda batches: _search(batches, forests), "a long, b long, shard long")
        return stored(rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shard"), "candidates")

    found, known = searched(shards), None
    # a node that meets nothing in a shard that may be like it need not come there again
    met = found.select(F.col("a").alias("node"), "shard").unionAll(found.select(F.col("b").alias("node"), "shard")).distinct()
    for turn in range(1, MOST_ROUNDS + 1):
        pairs = stored(found.select("a", "b").distinct(), "pairs")
        both = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
        keys = own.join(both, "node", "left_semi").groupBy("node").agg(F.min("key").alias("key"))
        told = stored(compared(pairs, stored(shingles_of(docs, keys), "shingles")), "compared")
        known = told if known is None else known.unionAll(told)
        failed = told.where("not alike").select("a", "b")
        if not failed.head(1):
            return known.where("alike").select("a", "b")
        here = met.join(found.join(failed, ["a", "b"]).select("shard").distinct(), "shard")
        ends = known.select(F.col("a").alias("node"), F.col("b").alias("other"), "alike").unionAll(known.select(F.col("b").alias("node"), F.col("a").alias("other"), "alike"))
        others = ends.groupBy("node").agg(F.collect_list(F.when(F.col("alike"), F.col("other"))).alias("good"), F.collect_list(F.when(~F.col("alike"), F.col("other"))).alias("bad"))
        wide = own.join(here, "node", "left_semi").groupBy("node").agg(F.first("mark").alias("mark"), F.first("odd").alias("odd"))
        found = searched(here.join(wide, "node").join(others, "node", "left").select("shard", "node", "mark", "odd", "good", "bad"), MORE**turn)
    raise RuntimeError(f"shards are not settled after {MOST_ROUNDS} rounds")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs with one document of each component: the smallest doc_id, of repeated rows one."""
    chosen = choices(docs.count())
    own = stored(sketches(docs, max(2, 1 + max(f for f, _, _ in chosen))), "sketches")
    roots = connected_components(links(docs, own, chosen))
    named = own.select("doc_id", "key", "node").join(roots, "node", "left").select("doc_id", "key", F.coalesce("root", "node").alias("root"))
    return first_of_each(docs, named)
