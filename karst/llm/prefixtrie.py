"""Prefix trie of conversations by Patricia construction.

A turn is the MD5 of its role and text (16 bytes; the role's length goes in front),
so a conversation is a byte string and texts never leave the scan.  Equal
conversations are counted first, as one sequence.  The distinct sequences are sorted
over range partitions, and each partition builds its part of the Patricia trie from
the common prefixes of neighbours: only branch, end and leaf points are made, with
compressed edges; counts, leaves and savings go up the compressed points; then each
edge is expanded to the nodes on it, by suffix sums of its bytes.

A node whose sequences stand in several partitions is a prefix of the sequences at
a partition's ends.  There are at most as many of those as the two paths are deep;
each partition gives its sums for them, and one aggregation adds them.  Bytes of a
node are subtracted where it stands first, and its parent counts it there, so all
sums just add up.  So a first turn that a third of all conversations share is parted
over as many tasks as it needs.

The numbers of the conversations that end at a node are hashed in order by ranges:
a range of one sequence becomes one text, and only where a sequence has several are
these put through the hash one after the other, as SHA-256 must be, with nothing
held but its state and one range.

Defined results: rows without conv_id belong to no conversation; turns are ordered
by turn (null first), rows of one turn by the MD5 of role and text, and repeated
rows are turns of their own; a null role or text is empty; the remainder of a
negative conv_id is negative, as in SQL; no conversation, no node; columns beside
the four named ones are not looked at.  A conversation is one row of 24 bytes for each
turn (a million turns: 24 MB), whatever its texts' length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karst.llm.common import stored

#: Bytes of sequences that a range of them holds, about, and conversations that a range of members holds.
RANGE_BYTES, RANGE_ROWS = 4_000_000, 100_000
SHARED, FIRST = 5, 9
NOTHING = hashlib.sha256(b"").hexdigest()
_WIDTH = 16
_NODES = "part int, path binary, above binary, depth long, conv_id long, parent long, n_convs long, n_children long, n_leaves long, saved long, ends string"


def turns(rows: DataFrame) -> DataFrame:
    """conv_id, turns: each conversation's (digest, bytes) in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    slim = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("digest"), F.octet_length(text).alias("bytes")).alias("t"))
    ordered = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes")))
    return slim.groupBy("conv_id").agg(ordered.alias("turns"))


def kept_turns(conv_id: Column, shared: int = FIRST) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % shared).cast("int")


def rebuilt(own: DataFrame, group: int = SHARED, most: int = FIRST) -> DataFrame:
    """conv_id, turns: the first turns of the group's first conversation, then the own turns after as many."""
    base, h = F.col("conv_id") - F.col("conv_id") % group, kept_turns(F.col("conv_id"), most)
    heads = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    none = F.slice("turns", 1, 0)
    # a group's conversations are few, so no base is frequent
    both = own.withColumn("base", base).join(heads, "base", "left")
    return both.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice(F.col("turns"), h + 1, F.size("turns"))).alias("turns"))


def ends(members: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """name, ends: SHA-256 of the ascending conv_ids of each sequence, comma-joined, of members (name, conv_id)."""
    ranged = members.repartitionByRange(max(1, -(-members.count() // range_rows)), "name", "conv_id").withColumn("part", F.spark_partition_id())
    pieces = ranged.groupBy("name", "part").agg(F.min("conv_id").alias("first"), F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))).alias("ids"))
    pieces = stored(pieces, "trie-ends")
    times = pieces.groupBy("name").agg(F.count("*").alias("n"))
    several = times.where("n > 1").select("name")  # at most one for each end of a range

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            for own, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if own != name:
                    if state is not None:
                        yield pa.RecordBatch.from_pylist([{"name": name, "ends": state.hexdigest()}])
                    name, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"name": name, "ends": state.hexdigest()}])

    alone = pieces.join(several, "name", "left_anti").select("name", F.sha2("ids", 256).alias("ends"))
    ordered = pieces.join(several, "name", "left_semi").repartition("name").sortWithinPartitions("name", "first")
    return alone.unionAll(ordered.select("name", "ids").mapInArrow(chained, "name binary, ends string"))


def common_turns(a: bytes, b: bytes) -> int:
    """How many turns two sequences begin with alike."""
    low, high = 0, min(len(a), len(b)) // _WIDTH
    step = 1
    while low < high:  # gallop, then halve
        mid = min(low + step, high)
        if a[low * _WIDTH : mid * _WIDTH] == b[low * _WIDTH : mid * _WIDTH]:
            low, step = mid, step * 2
        elif mid == low + 1:
            break
        else:
            high, step = mid - 1 if step > 1 else low, max(step // 2, 1)
    return low


class Builder:
    """The part of the trie that sorted distinct sequences give, between the sequences before and after them."""

    def __init__(self, before: bytes | None, after: bytes | None):
        self.before, self.after = before, after
        self.rows: list[tuple] = []  # a node each, in the order they close
        self.above: list[int] = []  # of each node: the point above it, or -1 for the next of its own edge
        self.least: list[int] = []  # of each point
        self.parted: dict[int, bytes] = {}  # paths of the points that the partition after holds as well

    def build(self, paths: list[bytes], sizes: list[np.ndarray], n: list[int], conv_id: list[int], hashes: list[str]) -> pa.RecordBatch:
        left = -1 if self.before is None else common_turns(self.before, paths[0])
        right = -1 if self.after is None else common_turns(self.after, paths[-1])
        # a point: depth, conversations, smallest, children, leaves, saved, hash of ends, whether anything is below, number
        self._open: list[list] = [self._point(0)]
        last = b""
        for i, path in enumerate(paths):
            shared = common_turns(last, path) if i else 0
            if i:
                self._close(shared, last, sizes[i - 1], left, -1)
                left = min(left, shared)
            top, depth = self._open[-1], len(path) // _WIDTH
            if depth > top[0]:
                top = self._point(depth)
                self._open.append(top)
            top[1] += n[i]
            top[2] = conv_id[i] if top[2] is None else min(top[2], conv_id[i])
            top[6] = hashes[i]
            last = path
        self._close(-1, last, sizes[-1], left, right)
        return self._table()

    def _point(self, depth: int) -> list:
        self.least.append(0)
        return [depth, 0, None, 0, 0, 0, None, False, len(self.least) - 1]

    def _close(self, shared: int, path: bytes, sizes: np.ndarray, left: int, right: int) -> None:
        """Close the points of path deeper than shared; nodes down to left are parted with the partition before, down to right with the one after."""
        both = max(left, right)
        while self._open and self._open[-1][0] > shared:
            depth, n, least, children, leaves, saved, hashed, below, number = self._open.pop()
            if self._open and self._open[-1][0] < shared:
                self._open.append(self._point(shared))
            end = self._open[-1] if self._open else None
            until = end[0] if end else -1
            if not below and depth > both:  # a node in two parts has something below in one of them
                leaves = 1
            self.least[number] = least
            if depth <= right:
                self.parted[number] = hashlib.md5(path[: depth * _WIDTH]).digest()
            for d in range(depth, until, -1):
                own = d > left  # stands here first
                if d:
                    saved += (n - own) * int(sizes[d - 1])
                cut = d * _WIDTH
                parted = hashlib.md5(path[:cut]).digest() if d <= both else None
                over = hashlib.md5(path[: cut - _WIDTH]).digest() if 0 < d <= both + 1 else None
                self.rows.append((parted, over, d, least, n, children, leaves, saved, hashed if d == depth else None))
                self.above.append(end[8] if end and d == until + 1 else number)
                children = int(own)
            if end:
                end[1] += n
                end[2] = least if end[2] is None else min(end[2], least)
                end[3] += children
                end[4] += leaves
                end[5] += saved
                end[7] = True

    def _table(self) -> pa.RecordBatch:
        path, above, depth, least, n, children, leaves, saved, hashed = zip(*self.rows, strict=True)
        parent = np.array(self.least)[self.above]
        # a root, and what hangs on a node that is not whole here, have no parent yet
        above = [(a or self.parted.get(point)) if d else None for a, d, point in zip(above, depth, self.above, strict=True)]
        unknown = np.array([d == 0 or a is not None for d, a in zip(depth, above, strict=True)])
        made = [pa.array(path, pa.binary()), pa.array(above, pa.binary()), *(pa.array(x, pa.int64()) for x in (depth, least)), pa.array(parent, pa.int64(), mask=unknown)]
        return pa.RecordBatch.from_arrays([*made, *(pa.array(x, pa.int64()) for x in (n, children, leaves, saved)), pa.array(hashed, pa.string())], ["path", "above", "depth", "conv_id", "parent", "n_convs", "n_children", "n_leaves", "saved", "ends"])


def _parts(sequences: DataFrame, range_bytes: int) -> DataFrame:
    """sequences in ranges of path: part, and the last path before and the first after it where it begins and ends."""
    size = sequences.agg(F.sum(F.octet_length("path") + 80)).first()[0] or 0
    ranged = sequences.repartitionByRange(max(1, -(-size // range_bytes)), "path")
    return stored(ranged.withColumn("part", F.spark_partition_id()), "trie-ranges")


def trie(conversations: DataFrame, range_bytes: int = RANGE_BYTES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, turns), turns as `turns` gives them."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    named = conversations.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["bytes"]).alias("sizes"))
    named = stored(named.withColumn("name", F.unhex(F.sha2("path", 256))), "trie-rebuilt")
    # the path is taken again from a sequence's smallest member: what is counted for each are numbers
    counted = named.groupBy("name").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    hashed = counted.join(ends(named.select("name", "conv_id"), range_rows), "name")
    parts = _parts(hashed.join(named.select("conv_id", "path", "sizes"), "conv_id"), range_bytes)
    # a row for each range
    w = Window.orderBy("part")
    borders = parts.groupBy("part").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    borders = borders.select("part", F.lag("high").over(w).alias("before"), F.lead("low").over(w).alias("after"))

    def build(key: tuple, rows: pa.Table, border: pa.Table) -> pa.Table:
        rows = rows.sort_by("path")
        lists = rows.column("sizes").combine_chunks()
        flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        flat_sizes = [flat[a - at[0] : b - at[0]] for a, b in zip(at[:-1], at[1:], strict=True)]
        builder = Builder(border.column("before")[0].as_py(), border.column("after")[0].as_py())
        made = builder.build(rows.column("path").to_pylist(), flat_sizes, *(rows.column(c).to_pylist() for c in ("n", "conv_id", "ends")))
        return pa.Table.from_batches([made]).add_column(0, "part", pa.array(np.full(made.num_rows, key[0].as_py()), pa.int32()))

    slim = parts.select("part", "path", "sizes", "n", "conv_id", "ends")
    nodes = stored(slim.groupBy("part").cogroup(borders.groupBy("part")).applyInArrow(build, _NODES), "trie-nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    whole = nodes.where("path is not null").groupBy("path", "depth").agg(F.first("above").alias("above"), F.min("conv_id").alias("conv_id"), *sums, F.max("ends").alias("ends"))
    # of each node that is parted: its smallest member, for its children wherever they stand
    names = whole.select(F.col("path").alias("above"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent"))
    apart = whole.join(names, ["above", "depth"], "left")
    # the children of one part: not all those of the root in one place
    local = nodes.where("path is not null").select("part", F.col("path").alias("above"), (F.col("depth") + 1).alias("depth")).distinct().join(names, ["above", "depth"])
    hanging = nodes.where("path is null and above is not null").drop("parent").join(local, ["part", "above", "depth"])
    columns = ["conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256")]
    settled = nodes.where("path is null and above is null")
    return settled.select(*columns).unionAll(hanging.select(*columns)).unionAll(apart.select(*columns))


def conversation_trie(rows: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text)."""
    return trie(rebuilt(turns(rows)))


#: CRC-32 bit by bit, its polynomial reversed; the rest as in the docstring.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: list_reduce(list_prepend(xor(a, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda b, z: CASE WHEN b % 2 = 1 THEN xor(b // 2, 3988292384) ELSE b // 2 END)), 4294967295)"
ORACLE_SQL = f"""WITH own AS (SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
 FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT c, turns, ({_CRC}) % {FIRST} AS h FROM own),
conv AS (SELECT a.c, list_concat(coalesce(b.turns[1:a.h], a.turns[1:0]), a.turns[a.h + 1:]) AS turns FROM h a LEFT JOIN own b ON b.c = a.c - a.c % {SHARED}),
step AS (SELECT c, unnest(range(0, len(turns) + 1)) AS d, turns FROM conv),
member AS (SELECT c, d, len(turns) AS n, turns[1:d] AS path, min(c) OVER (PARTITION BY d, turns[1:d]) AS node FROM step),
node AS (SELECT node, d, any_value(path) AS path, count(*) AS n_convs, sha256(coalesce(string_agg(CASE WHEN n = d THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256 FROM member GROUP BY 1, 2),
up AS (SELECT k.node, k.d, p.node AS parent FROM node k JOIN member p ON p.c = k.node AND p.d = k.d - 1),
kids AS (SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM up GROUP BY 1, 2),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * strlen(path[d].t) END AS own FROM node LEFT JOIN kids USING (node, d)),
below AS (SELECT m.node, m.d, sum((f.n_children = 0)::BIGINT) AS n_leaves, sum(f.own) AS saved FROM full_node f JOIN member m ON m.c = f.node AND m.d <= f.d GROUP BY 1, 2)
SELECT f.node AS conv_id, f.d AS depth, up.parent AS parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, ends_sha256
FROM full_node f JOIN below USING (node, d) LEFT JOIN up USING (node, d)"""
