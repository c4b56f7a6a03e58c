"""Token ids as canonical length-limited Huffman codes, in independent blocks.

An output is a folder of three Parquet tables, so that Spark's commit protocol holds
when tasks are lost and any store that Spark knows will do; it can be read without
anything else:

    codes   id, length                 the codebook
    ranges  part, before               ids before each range of doc_ids
    blocks  part, at, block            ids of the range before each block, and the block

A block is one binary record (little-endian):

    magic "KHF2", u32 documents, u64 ids, u32 step, u32 marks
    i64 doc_id * documents, u8 (1: doc_id is null) * documents, u32 ids * documents
    u64 bit offset * marks     one for every `step` ids: where decoding can begin
    code bits, first bit highest, padded with zero bytes

Codes come from global counts by package-merge, at most LONGEST bits; lengths
alone fix the canonical codes, so the codebook is (id, length) rows.  Decoding
looks LONGEST bits up in one table and goes on from all marks of a block at once.

Ranges are parted at about every RANGE_ROWS-th doc_id; a doc_id (or none) that fills
several ranges is dealt over them by a hash of its rows.

Defined results: a null text counts as empty (only its end id); null doc_ids come
first; rows with the same doc_id are all kept, in an order of their own; an empty
table makes no blocks; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from karst.llm.common import shared_dir, slices, small_batches, stored
from karst.llm.tokens import as_bytes, encoder, forget

LONGEST = 20
STEP = 256
BLOCK_IDS = 1 << 17
#: A range of doc_ids is one task's share of the output; about so many documents.
RANGE_ROWS = 16_384
#: Up to so many ranges, the ids before each are sent to all tasks that read (16 bytes each).
MOST_SENT = 1_000_000
BATCH, AT_ONCE = 4_000_000, 1_000_000
_HEAD = struct.Struct("<4sIQII")


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Optimal code lengths of at most `longest` bits by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    n = len(weight)
    if n > 1 << longest:
        raise ValueError(f"{n} symbols need codes of more than {longest} bits")
    levels = []  # for each bit level: which of the sorted items are leaves
    items = weight
    for level in range(longest):
        if level:
            pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
            merged = np.concatenate([weight, pairs])
            by = np.argsort(merged, kind="stable")
            items, leaf = merged[by], by < n
        else:
            leaf = np.ones(n, bool)
        levels.append(leaf)
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for leaf in reversed(levels):
        chosen = leaf[:take]
        lengths[: int(chosen.sum())] += 1
        take = 2 * int(take - chosen.sum())
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes that lengths fix: by length, then by id."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    used = np.flatnonzero(lengths)
    for s in used[np.argsort(lengths[used], kind="stable")].tolist():
        code <<= int(lengths[s]) - last
        last = int(lengths[s])
        codes[s] = code
        code += 1
    return codes


def write_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, step: int) -> tuple[bytes, np.ndarray]:
    """The code bits of ids, and the bit offset of every step-th id."""
    n = lengths[ids].astype(np.int64)
    ends = n.cumsum()
    begins = ends - n
    if not len(ids):
        return b"", begins
    word, room = begins >> 6, 64 - (begins & 63) - n
    code = codes[ids]
    fits = room >= 0
    left = np.where(fits, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
    out = np.zeros((int(ends[-1]) + 63) // 64 + 1, np.uint64)
    firsts = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[firsts]] = np.bitwise_or.reduceat(left, firsts)
    over = np.flatnonzero(~fits)
    out[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8], begins[::step]


@dataclass
class Decoder:
    symbol: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, lengths: np.ndarray) -> Decoder:
        """For each value of LONGEST bits, the id whose code begins it."""
        used = np.flatnonzero(lengths)
        used = used[np.argsort(lengths[used], kind="stable")]
        reach = 1 << (LONGEST - lengths[used].astype(np.int64))
        symbol, length = np.zeros(1 << LONGEST, np.uint32), np.zeros(1 << LONGEST, np.int64)
        total = int(reach.sum())
        symbol[:total] = np.repeat(used, reach)
        length[:total] = np.repeat(lengths[used], reach)
        return cls(symbol, length)

    def read_bits(self, bits: bytes, marks: np.ndarray, n: int, step: int) -> np.ndarray:
        """n ids; every mark is a lane, and all lanes take a step together."""
        if not n:
            return np.zeros(0, np.uint32)
        raw = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint64)
        size = len(raw) - 7
        # 32 bits from each byte on, so that a look needs one gather
        words = (raw[:size] << np.uint64(24)) | (raw[1 : size + 1] << np.uint64(16)) | (raw[2 : size + 2] << np.uint64(8)) | raw[3 : size + 3]
        at = marks.astype(np.int64)
        out = np.zeros((len(at), step), np.uint32)
        last = n - (len(at) - 1) * step
        keep = (1 << LONGEST) - 1
        for k in range(step):
            if k == last:
                at = at[:-1]
                if not len(at):
                    break
            look = (words[at >> 3] >> (32 - LONGEST - (at & 7)).astype(np.uint64)).astype(np.int64) & keep
            out[: len(at), k] = self.symbol[look]
            at = at + self.length[look]
        return out.ravel()[:n]


def _block(ids: list[np.ndarray], docs: list[int | None], lengths: np.ndarray, codes: np.ndarray) -> bytes:
    every = np.concatenate(ids)
    bits, marks = write_bits(every, lengths, codes, STEP)
    return b"".join(
        [
            _HEAD.pack(b"KHF2", len(docs), len(every), STEP, len(marks)),
            np.array([d or 0 for d in docs], "<i8").tobytes(),
            np.array([d is None for d in docs], "u1").tobytes(),
            np.array([len(x) for x in ids], "<u4").tobytes(),
            marks.astype("<u8").tobytes(),
            bits,
        ]
    )


def read_block(block: bytes, decoder: Decoder) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, ids of each, all ids."""
    magic, docs, n, step, marks = _HEAD.unpack_from(block)
    if magic != b"KHF2":
        raise ValueError("not a block of token ids")
    at = _HEAD.size
    names = np.frombuffer(block, "<i8", docs, at)
    null = np.frombuffer(block, "u1", docs, at + 8 * docs)
    sizes = np.frombuffer(block, "<u4", docs, at + 9 * docs).astype(np.int64)
    at += 13 * docs
    offsets = np.frombuffer(block, "<u8", marks, at)
    ids = decoder.read_bits(block[at + 8 * marks :], offsets, n, step)
    return [None if z else d for d, z in zip(names.tolist(), null.tolist(), strict=True)], sizes, ids


def _cuts(docs: DataFrame, rows: int) -> np.ndarray:
    """doc_ids at every `rows`-th row, about; one that fills several ranges stands several times."""
    parts = max(1, docs.count() // rows)
    if parts == 1:
        return np.zeros(0, np.int64)
    at = docs.agg(F.percentile_approx(F.coalesce("doc_id", F.lit(_FIRST)), [k / parts for k in range(1, parts)], max(10_000, 4 * parts))).first()[0]
    return np.array(at or [], np.int64)


_FIRST = -(1 << 63)


def _ranges(doc_id: np.ndarray, salt: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    low, high = (np.searchsorted(cuts, doc_id, side) for side in ("left", "right"))
    share = (salt.view(np.uint64) >> np.uint64(11)) / (1 << 53)
    return np.where(high > low, low + 1 + (share * (high - low)).astype(np.int64), low).astype(np.int32)


def _running(sums: DataFrame) -> DataFrame:
    """part, before: sums of n over all smaller parts, by thousands of parts first."""
    some = sums.withColumn("some", F.floor(F.col("part") / 4096))
    whole = some.groupBy("some").agg(F.sum("n").alias("n")).select("some", (F.sum("n").over(Window.orderBy("some")) - F.col("n")).alias("whole"))
    own = F.sum("n").over(Window.partitionBy("some").orderBy("part")) - F.col("n")
    return some.join(whole, "some").select("part", (F.col("whole") + own).alias("before"))


def write_documents(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, range_rows: int = RANGE_ROWS) -> str:
    """Encode every text, append end_id, and write all ids in ascending doc_id order; the folder written.

    Each text is encoded once and its ids are dealt once: as 16-bit numbers where the
    vocabulary allows, in a range of doc_ids to a task, into a table.  That gives the
    counts, and then, without another shuffle, the blocks.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts = _cuts(slim.select("doc_id"), range_rows)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        wide = enc.tok.get_vocab_size() > 1 << 16 or end_id >= 1 << 16
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            first = 0
            for texts in slices(batch.column("text"), AT_ONCE):
                ids, at = enc.encode_column(texts)
                column, salt = (batch.column(c).slice(first, len(texts)) for c in ("doc_id", "salt"))
                first += len(texts)
                part = _ranges(column.fill_null(_FIRST).to_numpy(zero_copy_only=False), salt.to_numpy(), cuts)
                ended = np.insert(ids, at[1:], end_id).astype("<u4" if wide else "<u2")
                at = at + np.arange(len(at))
                raw, unit = ended.tobytes(), ended.itemsize
                packed = [squeeze(raw[unit * a : unit * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part), column, salt, pa.array(np.diff(at)), pa.array(np.full(len(texts), unit, np.int32)), pa.array(packed, pa.binary())],
                    ["part", "doc_id", "salt", "n", "unit", "ids"],
                )

    salted = slim.withColumn("salt", F.xxhash64("text", F.monotonically_increasing_id()))
    coded = salted.mapInArrow(encode, "part int, doc_id long, salt long, n long, unit int, ids binary").repartition(len(cuts) + 1, "part")
    here = Window.partitionBy("part").orderBy("doc_id", "salt")
    placed = coded.withColumn("at", F.sum("n").over(here.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    with small_batches(spark, BATCH):
        coded = stored(placed.select("part", "at", "doc_id", "n", "unit", "ids"), "ids")
    _running(coded.groupBy("part").agg(F.sum("n").alias("n"))).coalesce(1).write.parquet(f"{path}/ranges")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total, widen = np.zeros(0, np.int64), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            units = batch.column("unit").to_numpy()
            for unit in np.unique(units).tolist():
                some = batch.column("ids").filter(pa.array(units == unit)).to_pylist()
                more = np.bincount(np.frombuffer(b"".join(map(widen, some)), f"<u{unit}"))
                if len(more) > len(total):
                    total, more = more, total
                total[: len(more)] += more
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    with small_batches(spark, 2_000_000):
        found = coded.select("unit", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most a row for each id of the vocabulary
    counts = np.zeros(max((r["id"] for r in found), default=0) + 1, np.int64)
    counts[[r["id"] for r in found]] = [r["n"] for r in found]
    lengths = code_lengths(counts, LONGEST)
    used = np.flatnonzero(lengths).tolist()
    spark.createDataFrame([(i, int(lengths[i])) for i in used], "id int, length int").coalesce(1).write.parquet(f"{path}/codes")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        codes, out, docs_of, ids, size, head = canonical(lengths), [], [], [], 0, None
        widen = zstandard.ZstdDecompressor().decompress

        def flush():
            nonlocal docs_of, ids, size
            if docs_of:
                out.append((*head, _block(ids, docs_of, lengths, codes)))
                docs_of, ids, size = [], [], 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": pa.array([x[0] for x in out], pa.int32()), "at": pa.array([x[1] for x in out], pa.int64()), "block": pa.array([x[2] for x in out], pa.binary())})

        for batch in batches:
            for part, at, doc, unit, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "at", "doc_id", "unit", "ids")), strict=True):
                # a file of the table may be read in pieces, and several files by one task: a block holds neighbours only
                if docs_of and (part != head[0] or at != head[1] + size or size >= BLOCK_IDS):
                    flush()
                if not docs_of:
                    head = (part, at)
                docs_of.append(doc)
                ids.append(np.frombuffer(widen(raw), f"<u{unit}"))
                size += len(ids[-1])
            if len(out) > 16:
                yield done()
                out.clear()
        flush()
        yield done()

    with small_batches(spark, 2_000_000):
        coded.mapInArrow(write, "part int, at long, block binary").write.parquet(f"{path}/blocks")
    return path


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files of the folder alone."""
    rows = spark.read.parquet(f"{path}/codes").collect()  # at most a row for each id of the vocabulary
    lengths = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.uint8)
    lengths[[r["id"] for r in rows]] = [r["length"] for r in rows]
    ranges = spark.read.parquet(f"{path}/ranges")
    ranges = F.broadcast(ranges) if ranges.count() <= MOST_SENT else ranges

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        decoder = Decoder.of(lengths)
        for batch in batches:
            for block, before in zip(batch.column("block"), batch.column("before").to_pylist(), strict=True):
                docs, sizes, ids = read_block(block.as_py(), decoder)
                ends = sizes.cumsum()
                raw = as_bytes(ids)
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(before + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    blocks = spark.read.parquet(f"{path}/blocks").join(ranges, "part").select((F.col("before") + F.col("at")).alias("before"), "block")
    # blocks are large and what is told of them small: they are read here, in small batches, into a table
    with small_batches(spark, 2_000_000):
        return stored(blocks.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long"), "read")
