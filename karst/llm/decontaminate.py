"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by document: each segment holds the terms of some
documents, for each term its ascending positions, and where each document's
positions begin.  All tokens of all documents are stored, so that one index
serves any test set.  A window of test words is looked up in a segment from its
rarest term there: the term's positions less its offset in the window are the
candidates, and the offset-adjusted lists of the other terms, rarest first, are
intersected with them.  Test items come in blocks of BLOCK_CHARS characters, so
that what tasks receive stays bounded however large the benchmark is.  `nearby` returns
proximity matches from the same index.

Defined results: null and empty texts have no words and are not contaminated; an
item without words gives no window, a null item_id is listed as "null"; items with
the same id count as one; repeated documents are each reported; with no items
every document is clean; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.llm.common import stored

WINDOW = 10
#: Positions between documents that hold no term: no span may be longer.
GAP = 64
SEGMENT_BYTES = 8_000_000
BLOCK_CHARS = 2_000_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes of words stay, A-Z become a-z, all others part words.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().translate(_FOLD.tobytes()))


def spread(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (n places) for each range, one after the other."""
    out = np.repeat(starts - np.concatenate([[0], n.cumsum()[:-1]]), n)
    return out + np.arange(len(out))


def word_column(texts: pa.Array, fold: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts as one binary column, and each text's number of words; fold maps bytes that part words to a blank."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = fold[np.frombuffer(data, np.uint8)[at[0] : at[-1]]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    inside = raw != 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = at[:-1][at[:-1] < len(raw)]
    begins[edge] = inside[edge]
    starts = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(starts, at))
    ends = np.append(np.flatnonzero(begins[inside]), int(inside.sum())).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(raw[inside])])
    return column, counts


@dataclass
class Segment:
    """terms[i] has the positions postings[ends[i]:ends[i + 1]]; document d has the positions base[d] to base[d] + n[d]."""

    terms: pa.Array
    ends: np.ndarray
    postings: np.ndarray
    base: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Segment:
        words, n = word_column(texts, _FOLD)
        coded = words.dictionary_encode()
        ids = coded.indices.to_numpy()
        base = np.concatenate([[0], (n + GAP).cumsum()[:-1]]).astype(np.int64)
        order = np.argsort(ids, kind="stable")
        ends = np.concatenate([[0], np.bincount(ids, minlength=len(coded.dictionary)).cumsum()])
        return cls(coded.dictionary, ends, spread(base, n)[order], base, n)

    def pack(self) -> tuple[bytes, bytes, bytes]:
        """Terms, their numbers of positions, and positions as differences within a term."""
        squeeze = zstandard.ZstdCompressor(level=1).compress
        step = np.diff(self.postings, prepend=0)
        first = self.ends[:-1]
        step[first] = self.postings[first]
        size = pc.binary_length(self.terms).to_numpy(zero_copy_only=False).astype("<u4")
        return squeeze(b"".join(self.terms.to_pylist())), squeeze(size.tobytes() + np.diff(self.ends).astype("<u4").tobytes()), squeeze(step.astype("<u4").tobytes())

    @classmethod
    def unpack(cls, terms: bytes, sizes: bytes, steps: bytes, n: np.ndarray) -> Segment:
        widen = zstandard.ZstdDecompressor().decompress
        size, count = np.frombuffer(widen(sizes), "<u4").reshape(2, -1).astype(np.int64)
        at, ends = (np.concatenate([[0], x.cumsum()]) for x in (size, count))
        step = np.frombuffer(widen(steps), "<u4").astype(np.int64)
        run = step.cumsum()
        before = np.concatenate([[0], run])[ends[:-1]]
        column = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(widen(terms))])
        base = np.concatenate([[0], (n + GAP).cumsum()[:-1]]).astype(np.int64)
        return cls(column, ends, run - np.repeat(before, count), base, n)

    def local(self, terms: pa.Array) -> np.ndarray:
        """The number here of each term; -1 if no document has it."""
        return pc.fill_null(pc.index_in(terms, value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def keys(self) -> np.ndarray:
        """(term, position) in one ascending number each."""
        return (np.repeat(np.arange(len(self.ends) - 1), np.diff(self.ends)) << 40) | self.postings

    def phrases(self, windows: np.ndarray, local: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, first position) of every occurrence. windows: term numbers in order, -1 after the last."""
        none = np.zeros(0, np.int64)
        if not len(windows) or not len(self.postings):
            return none, none
        here = np.where(windows >= 0, local[windows], -1)
        which = np.flatnonzero(((here >= 0) | (windows < 0)).all(axis=1))
        here = here[which]
        if not len(which):
            return none, none
        count = np.diff(self.ends)
        rarity = np.where(here >= 0, count[here], np.iinfo(np.int64).max)
        order = np.argsort(rarity, axis=1, kind="stable")
        first = here[np.arange(len(here)), order[:, 0]]
        n = count[first]
        row = np.repeat(np.arange(len(which)), n)
        start = self.postings[spread(self.ends[first], n)] - np.repeat(order[:, 0], n)
        keys = self.keys()
        for k in range(1, windows.shape[1]):
            term = here[row, order[row, k]]
            want = (term << 40) | np.maximum(start + order[row, k], 0)
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            ok = (term < 0) | (keys[at] == want) & (start >= 0)
            row, start = row[ok], start[ok]
        return which[row], start

    def near(self, terms: np.ndarray, span: int) -> np.ndarray:
        """First positions of stretches of at most span positions that hold all the terms (numbers here) in any order; each stretch begins at one of them."""
        if span > GAP:
            raise ValueError(f"a span of more than {GAP} positions")
        terms = np.unique(terms)
        if not len(terms) or (terms < 0).any():
            return np.zeros(0, np.int64)
        lists = sorted((self.postings[self.ends[t] : self.ends[t + 1]] for t in terms), key=len)
        # a stretch holds the rarest term, so it begins within a span before one of its positions
        starts = np.unique(np.concatenate([x[_within(x, lists[0], span)] for x in lists]))
        for x in lists:
            nxt = np.searchsorted(x, starts)
            ok = nxt < len(x)
            ok[ok] &= x[nxt[ok]] < starts[ok] + span
            starts = starts[ok]
        return starts


def _within(x: np.ndarray, rare: np.ndarray, span: int) -> np.ndarray:
    nxt = np.searchsorted(rare, x)
    ok = nxt < len(rare)
    ok[ok] &= rare[nxt[ok]] < x[ok] + span
    return ok


@dataclass
class Windows:
    """The windows of a block of test items: rows of term numbers, and for each the items that have it."""

    terms: pa.Array
    rows: np.ndarray
    owner: list[list[str]]

    @classmethod
    def of(cls, items: Iterable[tuple[object, str | None]], size: int) -> Windows:
        number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], dict[str, None]] = {}
        for name, text in items:
            ids = [number.setdefault(w, len(number)) for w in words_of(text)]
            for k in range(max(len(ids) - size + 1, 1) if ids else 0):
                found.setdefault(tuple(ids[k : k + size]), {})["null" if name is None else str(name)] = None
        rows = np.full((len(found), size), -1, np.int64)
        for r, w in enumerate(found):
            rows[r, : len(w)] = w
        return cls(pa.array([*number], pa.large_binary()), rows, [[*x] for x in found.values()])


INDEX = "segment long, doc_id array<long>, key array<long>, n array<long>, terms binary, sizes binary, steps binary"


def build_index(docs: DataFrame) -> DataFrame:
    """A row for each segment, stored in the shared folder."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, i = batch.column("text"), 0
            size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).cumsum()
            while i < len(texts):
                j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + SEGMENT_BYTES, "right")))
                seg = Segment.of(texts.slice(i, j - i))
                blobs = seg.pack()
                yield pa.RecordBatch.from_pylist([dict(segment=0, doc_id=batch.column("doc_id").slice(i, j - i).to_pylist(), key=batch.column("key").slice(i, j - i).to_pylist(), n=seg.n.tolist(), terms=blobs[0], sizes=blobs[1], steps=blobs[2])], schema=_ARROW)
                i = j

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    return stored(slim.mapInArrow(build, INDEX).withColumn("segment", F.monotonically_increasing_id()), "postings")


_ARROW = pa.schema([("segment", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("key", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("terms", pa.binary()), ("sizes", pa.binary()), ("steps", pa.binary())])


def blocks_of(items: DataFrame) -> Iterator[list[tuple[object, str | None]]]:
    block, size = [], 0
    for r in items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len(r["text"] or "")
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    yield block


def lookup(index: DataFrame, windows: Windows) -> DataFrame:
    """For each document: doc_id, n_words, spans of word numbers that windows cover (merged, end exclusive), items."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n = np.array(r["n"], np.int64)
                seg = Segment.unpack(r["terms"], r["sizes"], r["steps"], n)
                which, start = seg.phrases(windows.rows, seg.local(windows.terms))
                stop = start + (windows.rows[which] >= 0).sum(axis=1)
                doc = np.searchsorted(seg.base, start, "right") - 1
                spans: list[list] = [[] for _ in n]
                items: list[dict] = [{} for _ in n]
                for k in np.lexsort((start, doc)).tolist():
                    d = int(doc[k])
                    a, b = int(start[k] - seg.base[d]), int(stop[k] - seg.base[d])
                    if spans[d] and a <= spans[d][-1]["end"]:
                        spans[d][-1]["end"] = max(b, spans[d][-1]["end"])
                    else:
                        spans[d].append({"start": a, "end": b})
                    items[d].update(dict.fromkeys(windows.owner[which[k]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["segment"]] * len(n), pa.int64()), pa.array(range(len(n)), pa.int32()), pa.array(r["doc_id"], pa.int64()), pa.array(r["key"], pa.int64()), pa.array(n), pa.array(spans, _SPANS), pa.array([[*x] for x in items], pa.list_(pa.string()))],
                    ["segment", "place", "doc_id", "key", "n_words", "spans", "items"],
                )

    return index.mapInArrow(find, "segment long, place int, doc_id long, key long, n_words long, spans array<struct<start:long,end:long>>, items array<string>")


def nearby(index: DataFrame, searches: Iterable[tuple[object, str | None]], span: int) -> DataFrame:
    """Proximity matches: search, doc_id, at (ascending word numbers where stretches of at most span words begin that hold all words of the search, in any order).

    A row for each document and search that match; span is at most GAP; a search
    without words matches nothing.
    """
    if not 0 < span <= GAP:
        raise ValueError(f"a span of 1 to {GAP} words")
    number: dict[bytes, int] = {}
    asked = [("null" if name is None else str(name), [number.setdefault(w, len(number)) for w in words_of(text)]) for name, text in searches]
    asked = [(name, np.array(ids)) for name, ids in asked if ids]
    terms = pa.array([*number], pa.large_binary())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                seg = Segment.unpack(r["terms"], r["sizes"], r["steps"], np.array(r["n"], np.int64))
                local, names, docs, places = seg.local(terms), [], [], []
                for name, ids in asked:
                    start = seg.near(local[ids], span)
                    doc = np.searchsorted(seg.base, start, "right") - 1
                    for d, at in zip(*_grouped(doc, start - seg.base[doc]), strict=True):
                        names.append(name)
                        docs.append(r["doc_id"][d])
                        places.append(at)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(docs, pa.int64()), pa.array(places, pa.list_(pa.int64()))], ["search", "doc_id", "at"])

    return index.mapInArrow(find, "search string, doc_id long, at array<long>")


def _grouped(key: np.ndarray, value: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Ascending keys and the values of each."""
    keys, first = np.unique(key, return_index=True)
    return keys.tolist(), np.split(value, first[1:]) if len(keys) else []


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items for each document."""
    index = build_index(docs)
    blocks = (Windows.of(block, window) for block in blocks_of(items))
    out, second = lookup(index, next(blocks)), next(blocks, None)
    if second is not None:  # a document's spans from several blocks; of each block what it hits is stored, so that the driver holds one block
        parts, hits = stored(out, "hits"), []
        for windows in chain([second], blocks):
            hits.append(stored(lookup(index, windows).where(F.size("spans") > 0), "hits"))
        for x in hits:
            parts = parts.unionAll(x)
        out = parts.groupBy("segment", "place").agg(F.first("doc_id").alias("doc_id"), F.first("key").alias("key"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(x["end"] - F.greatest(x["start"], acc["end"]), F.lit(0))).alias("n"), F.greatest(acc["end"], x["end"]).alias("end")),
        lambda acc: acc["n"],
    )
    names = F.array_sort(F.array_distinct("items"))
    return out.select("doc_id", "n_words", covered.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans", names.alias("items"), "key")


def keep_clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs whose text holds no window of the items."""
    hit = contamination(docs, items, window).where("contaminated").select(F.col("doc_id").alias("k_id"), F.col("key").alias("k_text")).distinct().hint("shuffle_hash")
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("k_row"), docs["doc_id"].cast("long").alias("k_doc"), F.xxhash64(docs["text"].cast("string")).alias("k_key"))
    return keyed.join(hit, F.col("k_doc").eqNullSafe(F.col("k_id")) & (F.col("k_key") == F.col("k_text")), "left_anti").select("k_row.*")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + 9], ' ') AS t FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT n FROM i),
o AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, s)),
h AS (SELECT o.doc_id, o.k, o.n, i.item_id FROM o JOIN i ON i.t = o.t AND i.n = o.n),
p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS q FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""
