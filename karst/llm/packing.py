"""Best-fit packing of token sequences by the sum-of-squares rule.

Each document goes where the sum over residual gaps g of N(g)**2 becomes
smallest, N(g) being the number of open sequences with g places left.  Pieces are
stored and counted, dealt by a hash of their place in the stored table into groups
of a bounded size, longest first within a group, and each group is packed by
itself, so no task holds more than a group, whatever ids repeat or miss; only
lengths are stored and shuffled, never texts or ids.

Defined results: a null text counts as empty (its end id alone makes one piece);
a null doc_id is kept as null, and rows without one are dealt like any other;
repeated rows are packed once each; an empty table
gives no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.llm.common import slices, stored
from karst.llm.tokens import as_bytes, encoder

CAPACITY = 2048
GROUP_ROWS = 16_384
AT_ONCE = 8_000_000
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length (1 to capacity), placed in the given order.

    With N(g) open sequences of gap g, moving one from g to g - s changes the sum
    by 2 (N(g-s) - N(g) + 1), filling one up by 1 - 2 N(s), and a new sequence by
    2 N(capacity - s) + 1.  A new one is opened only if no open one fits, which
    leaves no more part-filled sequences than best fit does; of equal places the
    one with the smallest gap is taken.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used = 0
    for i, s in enumerate(lengths.tolist()):
        here = count[s:capacity]
        gap = capacity
        if here.any():
            cost = 2 * (count[: capacity - s] - here + 1)
            cost[0] = 1 - 2 * here[0]
            cost[here == 0] = 1 << 40
            gap = s + int(cost.argmin())
        if gap == capacity:
            at, used = used, used + 1
        else:
            at = open_at[gap].pop()
            count[gap] -= 1
        number[i], offset[i] = at, capacity - gap
        if gap > s:
            open_at[gap - s].append(at)
            count[gap - s] += 1
    return number, offset


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the ids of each text and the end id, cut at capacity."""
    width = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            first = 0
            for texts in slices(batch.column("text"), AT_ONCE):
                ids, at = enc.encode_column(texts)
                docs_of, number, length, crc = [], [], [], []
                for i, doc in enumerate(batch.column("doc_id").slice(first, len(texts)).to_pylist()):
                    raw = bytes(as_bytes(ids[at[i] : at[i + 1]])) + end_id.to_bytes(4, "little")
                    for p in range(0, len(raw), width):
                        part = raw[p : p + width]
                        docs_of.append(doc)
                        number.append(p // width)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                first += len(texts)
                n = np.array(number, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs_of, pa.int64()), pa.array(n.astype(np.int32)), pa.array(n * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(cut: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """Sequence and offset for each row of a stored table with a length; groups: how many are packed apart."""

    def place(table: pa.Table) -> pa.Table:
        length = table.column("length").to_numpy()
        order = np.lexsort((table.column("piece").to_numpy(), table.column("doc_id").fill_null(-1).to_numpy(), -length))
        table = table.take(pa.array(order))
        number, offset = sum_of_squares(length[order], capacity)
        group = table.column("group").to_numpy() if len(table) else np.zeros(0, np.int64)
        kept = table.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return kept.append_column("sequence_id", pa.array((group << 32) + number)).append_column("offset", pa.array(offset))

    # a stored row keeps its number when a lost task is run again
    dealt = cut.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(place, SCHEMA)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Every document (text, then end_id) in sequences of at most capacity ids; only longer ones are cut."""
    cut = stored(pieces(docs, tokenizer, capacity, end_id), "pieces")
    return pack(cut, max(1, cut.count() // group_rows), capacity)
