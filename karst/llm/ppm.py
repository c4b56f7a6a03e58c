"""Language-model scores by prediction by partial matching over bytes.

A context trie of ORDER bytes is learnt from all training texts: the counts of
every (ORDER + 1)-byte string fix those of all shorter contexts.  A byte is coded
in its longest known context; where it was never seen there, an escape is coded
(as likely as the context's distinct bytes against its count) and the next shorter
context takes over with the bytes already ruled out excluded.  Escapes and
exclusions depend on the context alone, so they are worked out once for each, and
scoring is a few table look-ups a byte.

Bytes 0xFE (before a text) and 0xFF (its end) occur in no UTF-8 text and serve as
marks; the end is coded, so probabilities are those of whole texts.

The trie keeps every string of all training texts and is never in one place.  Texts
are read once into parts, each with its distinct strings in buckets; a bucket holds
all strings whose last three context bytes have one hash, so it holds every context of
three bytes or more whole.  A bucket's counts are summed over the parts and its strings
get their probabilities.  Shorter contexts need the counts of three-byte strings alone,
at most 256**3 however large the corpus is, and those are what is sent to every task.
Each part then asks each bucket, part after part, and gets its strings' probabilities
back.  So what a task holds is a part or the distinct strings of a bucket, and what is
shuffled are a few bytes for each distinct string of a part.  `train` makes the whole
trie in one place, for corpora that allow it.

The word model beside it counts all words of all training texts; the MOST_WORDS
commonest of up to MOST_BYTES bytes are sent to the tasks, and counts of all others
are joined.

Defined results: null texts count as empty (their end alone is scored); a document
without a doc_id is training text; repeated rows count and are scored each; with
no training text every byte is as likely as any other; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karst.llm.common import slices, stored
from karst.llm.decontaminate import word_column
from karst.llm.simhash import _FOLD

ORDER = 5
MOST_WORDS, MOST_BYTES = 65_536, 64
BEFORE, END = 0xFE, 0xFF
#: All bytes but BEFORE.
SYMBOLS = 255
AT_ONCE = 1_000_000
HELD = 2_000_000
#: Bytes of text of a part.
PART = 12_000_000
#: Documents to a bucket of strings, about, and the bounds of their number.
BUCKET_DOCS, FEWEST, MOST = 20_000, 256, 65_536
#: Contexts of up to so many bytes are held by every task that works out probabilities.
LOW = 2


def strings(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The order + 1 bytes that end at each byte and end mark of all texts, as numbers; how many each text has."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    size = np.diff(at)
    begin = np.concatenate([[0], (size + order + 1).cumsum()[:-1]])
    raw = np.full(int((size + order + 1).sum()), BEFORE, np.uint8)
    if at[-1] > at[0]:
        raw[np.arange(int(size.sum())) + np.repeat(begin + order - (at[:-1] - at[0]), size)] = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    raw[begin + order + size] = END
    raw = raw.astype(np.uint64)
    key = raw.copy()
    for k in range(1, order + 1):
        key[k:] |= raw[:-k] << np.uint64(8 * k)
    return key[raw != BEFORE], size + 1


def _counted(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def string_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """s, n: how often each string of order + 1 bytes stands in the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["s", "n"])

        parts, held = [], 0
        for batch in batches:
            for texts in slices(batch.column("text"), AT_ONCE):
                found, _ = strings(texts, order)
                parts.append(np.unique(found, return_counts=True))
                held += len(parts[-1][0])
                if held > HELD:
                    keys, n = _counted(np.concatenate([keys, *(p[0] for p in parts)]), np.concatenate([n, *(p[1] for p in parts)]))
                    parts, held = [], 0
                    if len(keys) > HELD:
                        yield out()
                        keys, n = keys[:0], n[:0]
        keys, n = _counted(np.concatenate([keys, *(p[0] for p in parts)]), np.concatenate([n, *(p[1] for p in parts)]))
        yield out()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))


def word_counts(docs: DataFrame) -> DataFrame:
    """w, c: how often each word stands in the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("w").aggregate([("c", "sum")]).rename_columns(["w", "c"]).select(["w", "c"])

        for batch in batches:
            for texts in slices(batch.column("text"), 8_000_000):
                coded = word_column(texts, _FOLD)[0].dictionary_encode()
                n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                held.append(pa.table({"w": coded.dictionary.cast(pa.binary()), "c": pa.array(n, pa.int64())}))
                size += len(n)
            if size > 1_000_000:
                held = [merged()]
                size = len(held[0])
                if size > 700_000:
                    yield from held[0].combine_chunks().to_batches()
                    held, size = [], 0
        if held:
            yield from merged().combine_chunks().to_batches()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


@dataclass
class Index:
    """Number of each key, by buckets of a hash."""

    keys: np.ndarray
    number: np.ndarray
    starts: np.ndarray
    shift: np.uint64

    @classmethod
    def of(cls, keys: np.ndarray) -> Index:
        bits = max(4, int(2 * len(keys)).bit_length())
        shift = np.uint64(64 - bits)
        h = (keys * _MIX) >> shift
        order = np.argsort(h, kind="stable")
        starts = np.searchsorted(h[order], np.arange((1 << bits) + 1)).astype(np.int32)
        return cls(np.append(keys[order], _NONE), order.astype(np.int32), starts, shift)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """-1 where there is none."""
        if not len(self.number):
            return np.full(len(wanted), -1, np.int64)
        h = ((wanted * _MIX) >> self.shift).astype(np.int64)
        at = self.starts[h]
        hit = self.keys[at] == wanted
        out = np.where(hit, self.number[np.minimum(at, len(self.number) - 1)], -1).astype(np.int64)
        left = np.flatnonzero(~hit)
        at, end = at[left] + 1, self.starts[h[left] + 1]
        while len(left):
            more = at < end
            left, at, end = left[more], at[more], end[more]
            hit = self.keys[at] == wanted[left]
            out[left[hit]] = self.number[at[hit]]
            left, at, end = left[~hit], at[~hit] + 1, end[~hit]
        return out


_MIX = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass
class Sorted:
    """Number of each key of an ascending array."""

    keys: np.ndarray

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """-1 where there is none."""
        if not len(self.keys):
            return np.full(len(wanted), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, at, -1)


@dataclass
class Trie:
    """By order k: strings of k + 1 bytes (context and symbol) with log10 count and start, contexts with their escapes.

    start: log10 probability of a symbol in its longest known context; escape: of
    an escape there; next and down, kept at the longer context: log10 of the
    denominator, and of an escape, in the next shorter one with exclusions.
    """

    order: int
    strings: list[np.ndarray]
    count: list[np.ndarray]
    start: list[np.ndarray]
    contexts: list[np.ndarray]
    escape: list[np.ndarray]
    next: list[np.ndarray]
    down: list[np.ndarray]
    last: float
    #: Strings, counts, contexts, and the contexts' counts and distinct symbols of the highest order.
    top: tuple | None = None

    @classmethod
    def of(cls, keys: np.ndarray, n: np.ndarray, order: int, low: Trie | None = None) -> Trie:
        """From the counts of all strings; or, on top of the orders of low, of all whose contexts agree in low.order + 1 bytes."""
        t = cls(order, [], [], [], [], [], [], [], math.log10(1 / SYMBOLS))
        lower: tuple | None = None
        if low is not None:
            for own, theirs in zip((t.strings, t.count, t.start, t.contexts, t.escape, t.next, t.down), (low.strings, low.count, low.start, low.contexts, low.escape, low.next, low.down), strict=True):
                own += theirs
            t.last, lower = low.last, low.top
        for k in range(len(t.strings), order + 1):
            s, c = _counted(keys & np.uint64((1 << 8 * (k + 1)) - 1), n)
            x, first = np.unique(s >> np.uint64(8), return_index=True)
            d = np.diff(np.append(first, len(s)))
            total = np.add.reduceat(c, first) if len(s) else c
            of = np.repeat(np.arange(len(x)), d)
            with np.errstate(divide="ignore"):
                t.strings.append(s)
                t.count.append(np.log10(c).astype(np.float32))
                t.start.append(np.log10(c / (total + d)[of]).astype(np.float32))
                t.contexts.append(x)
                t.escape.append(np.log10(d / (total + d)).astype(np.float32))
                if k and len(s):
                    ls, lc, lx, lt, ld = lower
                    taken = np.add.reduceat(lc[np.searchsorted(ls, s & np.uint64((1 << 8 * k) - 1))], first)
                    y = np.searchsorted(lx, x & np.uint64((1 << 8 * (k - 1)) - 1))
                    new = ld[y] - d
                    room = lt[y] - taken + new
                    t.next.append(np.log10(np.maximum(room, 1)).astype(np.float32))
                    t.down.append(np.where(room > 0, np.log10(new / np.maximum(room, 1)), 0).astype(np.float32))
                else:
                    t.next.append(np.zeros(len(x), np.float32))
                    t.down.append(np.zeros(len(x), np.float32))
                    if not k:
                        t.last = math.log10(1 / max(1, SYMBOLS - len(s)))
            lower = s, c, x, total, d
        t.top = lower
        return t

    def indexes(self) -> tuple[list[Index], list[Index]]:
        return [Index.of(s) for s in self.strings], [Index.of(x) for x in self.contexts]

    def sorted(self) -> tuple[list[Sorted], list[Sorted]]:
        return [Sorted(s) for s in self.strings], [Sorted(x) for x in self.contexts]

    def scores(self, texts: pa.Array, indexes: tuple[list[Index], list[Index]]) -> np.ndarray:
        """log10 probability of each text with its end."""
        out = []
        for part in slices(texts, AT_ONCE):
            key, n = strings(part, self.order)
            each = self._score(key, indexes)
            out.append(np.add.reduceat(each, n.cumsum() - n))
        return np.concatenate([*out, np.zeros(0)])

    def _score(self, key: np.ndarray, indexes: tuple[list[Index], list[Index]]) -> np.ndarray:
        out = np.zeros(len(key))
        left = np.arange(len(key))
        above = np.full(len(key), -1, np.int64)  # the next longer context, where it is known
        for k in range(self.order, -1, -1):
            s = key[left] & np.uint64((1 << 8 * (k + 1)) - 1)
            at = indexes[0][k].find(s)
            hit = at >= 0
            i, up, a = left[hit], above[hit], at[hit]
            out[i] += np.where(up >= 0, self.count[k][a] - (self.next[k + 1][up] if k < self.order and len(self.next[k + 1]) else 0), self.start[k][a])
            miss = ~hit
            left, above, s = left[miss], above[miss], s[miss]
            here = indexes[1][k].find(s >> np.uint64(8))
            known = here >= 0
            step = np.where(known, self.escape[k][here] if len(self.escape[k]) else 0.0, 0.0)
            if k < self.order and len(self.down[k + 1]):
                step = np.where(above >= 0, self.down[k + 1][above], step)
            out[left] += step
            above = here
        out[left] += self.last
        return out


def train(docs: DataFrame, order: int = ORDER, most: int | None = None) -> Trie:
    """A trie from all strings of docs; if a bound is given, of more than `most` those above the least count that leaves no more."""
    counts = stored(string_counts(docs, order), "strings")
    if most is not None and counts.count() > most:
        # by descending count, how many strings have it: a few thousand rows
        by = sorted((r["n"], r["k"]) for r in counts.groupBy(F.least("n", F.lit(4096)).alias("n")).agg(F.count("*").alias("k")).collect())
        total, least = 0, 4097
        for n, k in reversed(by):
            if total + k > most:
                break
            total, least = total + k, n
        counts = counts.where(F.col("n") >= least)
    found = counts.toArrow()
    return Trie.of(found.column("s").to_numpy().view(np.uint64), found.column("n").to_numpy(), order)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def _squeezed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _widened(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def bucket_of(keys: np.ndarray, buckets: int, order: int) -> np.ndarray:
    """By a hash of the last LOW + 1 bytes of the context; one bucket if contexts are shorter."""
    if order <= LOW:
        return np.zeros(len(keys), np.int64)
    group = (keys >> np.uint64(8)) & np.uint64((1 << 8 * (LOW + 1)) - 1)
    return ((group * _MIX) >> np.uint64(40)).astype(np.int64) % buckets


def _spelled(keys: np.ndarray) -> bytes:
    return _squeezed(np.diff(keys, prepend=np.uint64(0)).astype("<u8"))


def _read(found: bytes) -> np.ndarray:
    return _widened(found, "<u8").cumsum(dtype=np.uint64)


def parts_of(docs: DataFrame, order: int, buckets: int = FEWEST) -> DataFrame:
    """A row for each part: part, docs (doc_id and text, as Arrow batches), strings (by bucket, ascending there), counts (in training texts), sizes (of the buckets)."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, sink, held, size, rows = TaskContext.get().partitionId() << 32, None, [], 0, 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return _counted(*(np.concatenate(x) for x in zip(*held, strict=True)))

        def done() -> pa.RecordBatch:
            writer.close()
            keys, n = merged()
            bucket = bucket_of(keys, buckets, order)
            by = np.argsort(bucket, kind="stable")
            row = [sink.getvalue().to_pybytes(), _spelled(keys[by]), _squeezed(n[by].astype("<i8")), _squeezed(np.bincount(bucket, minlength=buckets).astype("<i8"))]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in row)], ["part", "docs", "strings", "counts", "sizes"])

        for batch in batches:
            at = 0
            for texts in slices(batch.column("text"), AT_ONCE):
                if sink is None:
                    sink = pa.BufferOutputStream()
                    writer = pa.ipc.new_stream(sink, _DOCS, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                doc_id, out = (batch.column(c).slice(at, len(texts)) for c in ("doc_id", "out"))
                at += len(texts)
                writer.write_batch(pa.RecordBatch.from_arrays([doc_id, texts.cast(pa.large_string())], schema=_DOCS))
                keys, n = strings(texts, order)
                other = np.repeat(out.to_numpy(zero_copy_only=False), n)
                held.append(np.unique(keys[~other], return_counts=True))
                unseen = np.unique(keys[other])
                held.append((unseen, np.zeros(len(unseen), np.int64)))
                rows += sum(len(x[0]) for x in held[-2:])
                size += texts.nbytes
                if rows > HELD:
                    held = [merged()]
                    rows = len(held[0][0])
                if size >= PART or rows > HELD:
                    yield done()
                    number, sink, held, size, rows = number + 1, None, [], 0, 0
        if sink is not None:
            yield done()

    return docs.mapInArrow(sift, "part long, docs binary, strings binary, counts binary, sizes binary")


_DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.large_string())])


def tallied(parts: DataFrame, order: int, buckets: int) -> DataFrame:
    """bucket, strings, counts: several rows a bucket, each the sums over some parts."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def out() -> pa.RecordBatch:
            keys, n = _counted(*(np.concatenate(x) for x in zip(*held, strict=True)))
            bucket = bucket_of(keys, buckets, order)
            by = np.argsort(bucket, kind="stable")
            keys, n = keys[by], n[by]
            cut = np.append(0, np.bincount(bucket, minlength=buckets).cumsum()).tolist()
            some = [b for b in range(buckets) if cut[b + 1] > cut[b]]
            return pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array([_spelled(keys[cut[b] : cut[b + 1]]) for b in some], pa.binary()), pa.array([_squeezed(n[cut[b] : cut[b + 1]].astype("<i8")) for b in some], pa.binary())],
                ["bucket", "strings", "counts"],
            )

        for batch in batches:
            for found, n in zip(batch.column("strings"), batch.column("counts"), strict=True):
                held.append((_read(found.as_py()), _widened(n.as_py(), "<i8")))
                if sum(len(x[0]) for x in held) > HELD:
                    yield out()
                    held = []
        if held:
            yield out()

    return parts.select("strings", "counts").mapInArrow(tally, "bucket int, strings binary, counts binary")


def low_counts(parts: DataFrame, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings of low + 1 bytes and their counts: at most 256 ** (LOW + 1)."""

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for found, more in zip(batch.column("strings"), batch.column("counts"), strict=True):
                keys, n = _counted(np.concatenate([keys, _read(found.as_py()) & np.uint64((1 << 8 * (low + 1)) - 1)]), np.concatenate([n, _widened(more.as_py(), "<i8")]))
        yield pa.RecordBatch.from_arrays([pa.array(keys[n > 0].view(np.int64)), pa.array(n[n > 0])], ["s", "n"])

    few = parts.select("strings", "counts").mapInArrow(shorten, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).orderBy("s").toArrow()
    return few.column("s").to_numpy().view(np.uint64), few.column("n").to_numpy()


def priced(parts: DataFrame, order: int, buckets: int) -> DataFrame:
    """bucket, strings, logs: the log10 probability of each string's last byte after the others."""
    spark, low = parts.sparkSession, min(order, LOW)
    sent = spark.sparkContext.broadcast(low_counts(parts, low))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = Trie.of(*sent.value, low)
        ready = base.sorted()
        for bucket, rows in _by_bucket(batches):
            held, size = [], 0
            for found, n in rows:
                held.append((_read(found), _widened(n, "<i8")))
                size += len(held[-1][0])
                if size > HELD:
                    held = [_counted(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    size = len(held[0][0])
            keys, n = _counted(*(np.concatenate(x) for x in zip(*held, strict=True)))
            trie = base if low == order else Trie.of(keys[n > 0], n[n > 0], order, base)
            finders = tuple([*r, *f[low + 1 :]] for r, f in zip(ready, trie.sorted(), strict=True))
            logs = np.concatenate([np.zeros(0), *(trie._score(keys[i : i + HELD], finders) for i in range(0, len(keys), HELD))])
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([_spelled(keys)], pa.binary()), pa.array([_squeezed(logs.astype("<f4"))], pa.binary())], ["bucket", "strings", "logs"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sums = tallied(parts, order, buckets).repartition(n, "bucket").sortWithinPartitions("bucket")
    return sums.mapInArrow(work, "bucket int, strings binary, logs binary")


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[bytes, bytes]]]]:
    rows = ((b, x.as_py(), y.as_py()) for batch in batches for b, x, y in zip(batch.column("bucket").to_pylist(), batch.column("strings"), batch.column("counts"), strict=True))
    for bucket, some in groupby(rows, key=lambda r: r[0]):
        yield bucket, ((x, y) for _, x, y in some)


def answered(parts: DataFrame, prices: DataFrame) -> DataFrame:
    """part, logs: the logs of each part's strings, in their order."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found, sizes in zip(*(batch.column(c) for c in ("part", "strings", "sizes")), strict=True):
                keys, size = _read(found.as_py()), _widened(sizes.as_py(), "<i8")
                cut = np.append(0, size.cumsum()).tolist()
                some = np.flatnonzero(size).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([part.as_py()] * len(some), pa.int64()), pa.array([_spelled(keys[cut[b] : cut[b + 1]]) for b in some], pa.binary()), pa.nulls(len(some), pa.binary())], ["bucket", "part", "strings", "logs"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = logs = None
        for batch in batches:
            rows = []
            for bucket, part, found, log in zip(batch.column("bucket").to_pylist(), batch.column("part").to_pylist(), batch.column("strings"), batch.column("logs"), strict=True):
                if part is None:  # a bucket's prices come before the parts that ask
                    known, logs = _read(found.as_py()), _widened(log.as_py(), "<f4")
                else:
                    rows.append((part, bucket, _squeezed(logs[np.searchsorted(known, _read(found.as_py()))])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["part", "bucket", "logs"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((p, x.as_py()) for batch in batches for p, x in zip(batch.column("part").to_pylist(), batch.column("logs"), strict=True))
        for part, some in groupby(rows, key=lambda r: r[0]):
            logs = _squeezed(np.concatenate([_widened(x, "<f4") for _, x in some]))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([logs], pa.binary())], ["part", "logs"])

    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = "bucket int, part long, strings binary, logs binary"
    asked = parts.select("part", "strings", "sizes").mapInArrow(ask, kind).unionAll(prices.select("bucket", F.lit(None).cast("long").alias("part"), "strings", "logs"))
    told = asked.repartition(n, "bucket").sortWithinPartitions("bucket", F.asc_nulls_first("part")).mapInArrow(answer, "part long, bucket int, logs binary")
    return told.repartition(n, "part").sortWithinPartitions("part", "bucket").mapInArrow(gather, "part long, logs binary")


def lm_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each document."""
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    training = slim.where(~held_out(F.col("doc_id")))
    documents = slim.select("doc_id").count()
    buckets = min(MOST, max(FEWEST, 1 << (documents // BUCKET_DOCS).bit_length()))
    parts = stored(parts_of(slim.withColumn("out", held_out(F.col("doc_id"))), order, buckets), "parts")
    answers = answered(parts, stored(priced(parts, order, buckets), "priced"))

    words = stored(word_counts(training), "words")
    ends = training.select("doc_id").count()
    seen, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, kinds = seen + ends, distinct + (ends > 0)
    weight = math.log10(total + 0.1 * (kinds + 1))
    top = words.where(F.octet_length("w") <= MOST_BYTES).orderBy(F.desc("c"), "w").limit(MOST_WORDS).toArrow()
    sent = spark.sparkContext.broadcast((pa.array(top.column("w").combine_chunks(), pa.large_binary()), np.asarray(top.column("c").to_numpy(), np.int64)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, often = sent.value
        logs, end = np.append(np.log10(often + 0.1) - weight, 0.0), math.log10(ends + 0.1) - weight
        for batch in batches:
            for row in range(batch.num_rows):
                found, log = (batch.column(c)[row].as_py() for c in ("strings", "logs"))
                index, log = Index.of(_read(found)), _widened(log, "<f4")
                for some in pa.ipc.open_stream(batch.column("docs")[row].as_buffer()):
                    texts = some.column("text")
                    key, n = strings(texts, order)
                    score = np.add.reduceat(log[index.find(key)].astype(np.float64), n.cumsum() - n)
                    column, counts = word_column(texts, _FOLD)
                    coded = column.dictionary_encode()
                    number = pc.fill_null(pc.index_in(coded.dictionary, value_set=common), len(often)).to_numpy(zero_copy_only=False)
                    ids = coded.indices.to_numpy()
                    doc, rank = np.repeat(np.arange(len(counts)), counts), number[ids]
                    base = np.bincount(doc, logs[rank], len(counts)) + end
                    known = np.bincount(doc[rank < len(often)], minlength=len(counts)) + (ends > 0)
                    rare = rank == len(often)
                    spread = np.concatenate([[0], np.bincount(doc[rare], minlength=len(counts)).cumsum()])
                    lists = pa.ListArray.from_arrays(pa.array(spread, pa.int32()), coded.dictionary.take(pa.array(ids[rare])).cast(pa.binary()))
                    yield pa.RecordBatch.from_arrays(
                        [some.column("doc_id"), pa.array(counts + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(base), lists, pa.array(score)],
                        ["doc_id", "n_tokens", "known", "base", "rare", "score"],
                    )

    whole = parts.select("part", "docs", "strings").join(answers, "part").select("docs", "strings", "logs")
    rows = stored(whole.mapInArrow(work, "doc_id long, n_tokens long, known long, base double, rare array<binary>, score double").withColumn("row", F.monotonically_increasing_id()), "scores")
    each = rows.select("row", F.explode("rare").alias("w")).join(words, "w", "left")
    more = each.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.1) - weight).alias("more"), F.count("c").alias("found"))
    return rows.join(more, "row", "left").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )


class Adaptive:
    """The same model byte by byte in plain Python: learnt from texts one after the other, or from the text itself as it is read."""

    def __init__(self, order: int = ORDER):
        self.order, self.counts = order, {}

    def learn(self, text: str) -> None:
        raw = bytes([BEFORE] * self.order) + text.encode() + bytes([END])
        for i in range(self.order, len(raw)):
            self._add(raw, i)

    def _add(self, raw: bytes, i: int) -> None:
        for k in range(self.order + 1):
            own = self.counts.setdefault(raw[i - k : i], {})
            own[raw[i]] = own.get(raw[i], 0) + 1

    def probability(self, raw: bytes, i: int) -> float:
        p, out = 1.0, frozenset()
        for k in range(self.order, -1, -1):
            own = {s: n for s, n in self.counts.get(raw[i - k : i], {}).items() if s not in out}
            if not own:
                continue
            total = sum(own.values()) + len(own)
            if raw[i] in own:
                return p * own[raw[i]] / total
            p *= len(own) / total
            out = out | own.keys()
        return p / max(1, SYMBOLS - len(out))

    def log10(self, text: str, adapt: bool = False) -> float:
        """log10 probability of the text and its end; adapt: each byte is learnt once coded."""
        raw, total = bytes([BEFORE] * self.order) + text.encode() + bytes([END]), 0.0
        for i in range(self.order, len(raw)):
            total += math.log10(self.probability(raw, i))
            if adapt:
                self._add(raw, i)
        return total
