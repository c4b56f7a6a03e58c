"""Runs of repeated words, found on harmonic grids with common extensions.

A run of period p and at least four periods holds four grid points jp, (j + 1)p, ...
For each p up to a quarter of a text the words at neighbouring grid points are
compared; only where three neighbours in a row are alike can a run pass.  From each
such pair the longest common extensions forward and backward of jp and (j + 1)p tell
where the stretch of period p begins and ends.  They are range minima, by sparse
tables, over the common prefixes of neighbours in the suffix array of the words, and
in that of the reversed words.  A stretch found with several periods has the
smallest of them: with four periods in it, the others are its multiples.

Grids take n ln n steps for a text of n words, suffix arrays n log n sorts by prefix
doubling; texts whose grids have no three alike neighbours need no suffix array.
Texts are independent: each task goes through its rows in slices, so nothing is
shuffled, and a slice's memory is that of its longest text (near 250 bytes a word).

Defined results: a null or blank text has no words and no runs; a null doc_id has no
checksum, so its words stay as they are; repeated rows give repeated results; other
columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.llm.common import slices

#: Least length of a run, in words and in periods.
WORDS, PERIODS = 6, 4
#: Bytes of text, grid pairs and words of suffix arrays that are looked at together.
AT_ONCE, PAIRS, INDEXED = 4_000_000, 2_000_000, 400_000
_RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Suffixes:
    """Longest common prefixes of any two suffixes of a sequence of numbers."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
        levels, reach = [np.append(rank, -1).astype(np.int32)], 1
        order = np.argsort(rank, kind="stable")
        while n and int(rank.max()) < n - 1:
            after = np.zeros(n, np.int64)
            after[:-reach] = rank[reach:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key)
            sorted_key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], (sorted_key[1:] != sorted_key[:-1]).cumsum()])
            levels.append(np.append(rank, -1).astype(np.int32))
            reach *= 2
        self.rank = rank.astype(np.int32)
        a, b = order[:-1].copy(), order[1:].copy()
        shared = np.zeros(max(n - 1, 0), np.int32)
        while levels:  # alike over 2^k words at a time, from the longest
            level = levels.pop()
            alike = np.flatnonzero(level[a] == level[b])
            step = 1 << len(levels)
            for x in (a, b, shared):
                x[alike] += step
        self.minima = [shared]
        while 2 << len(self.minima) - 1 <= len(shared):
            last, half = self.minima[-1], 1 << len(self.minima) - 1
            self.minima.append(np.minimum(last[:-half], last[half:]))
        self.n = n

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at i and j (not equal); 0 where one is past the end."""
        out = np.zeros(len(i), np.int64)
        inside = np.flatnonzero((i < self.n) & (j < self.n))
        a, b = self.rank[i[inside]], self.rank[j[inside]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        found = np.empty(len(inside), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            found[at] = np.minimum(self.minima[k][low[at]], self.minima[k][high[at] - (1 << k)])
        out[inside] = found
        return out


def grid(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts, places and periods p where words at a grid's neighbours, place and place + p, are alike three times in a row."""
    periods = np.where(sizes >= WORDS, sizes // PERIODS, 0)
    text = np.repeat(np.arange(len(sizes)), periods)
    first = periods.cumsum() - periods
    p = np.arange(len(text)) - first[text] + 1
    many = (sizes[text] - 1) // p
    total = many.cumsum()
    at = 0
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        m, own_p = many[at:end], p[at:end]
        row = np.repeat(np.arange(end - at), m)
        j = np.arange(len(row)) - (m.cumsum() - m)[row]
        step = own_p[row]
        place = starts[text[at:end]][row] + j * step
        alike = codes[place] == codes[place + step]
        thrice = np.flatnonzero(alike[:-2] & alike[1:-1] & alike[2:] & (row[:-2] == row[2:]))
        hit = np.unique(np.concatenate([thrice, thrice + 1, thrice + 2]))
        if len(hit):
            yield text[at:end][row[hit]], place[hit], step[hit]
        at = end


def stretches(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first place, length and period of every run, by text, place and period; places count from the first text's first word."""
    none = np.zeros((4, 0), np.int64)
    found = [np.stack([t, i, p]) for t, i, p in grid(codes, starts, sizes)]
    if not found:
        return tuple(none)
    text, place, period = np.concatenate(found, axis=1)
    order = np.argsort(text, kind="stable")
    text, place, period = text[order], place[order], period[order]
    texts, begins = np.unique(text, return_index=True)
    begins = np.append(begins, len(text))
    out, i = [], 0
    size = sizes[texts].cumsum()
    while i < len(texts):  # as many texts as make a suffix array, one at least
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + INDEXED, "right")))
        some, rows = texts[i:j], slice(begins[i], begins[j])
        ends = (sizes[some] + 1).cumsum()  # each text, and a number of its own after it
        joined = np.empty(ends[-1], np.int64)
        top = int(codes.max()) + 1
        for k, t in enumerate(some.tolist()):
            joined[ends[k] - sizes[t] - 1 : ends[k] - 1] = codes[starts[t] : starts[t] + sizes[t]]
        joined[ends - 1] = top + np.arange(len(some))
        moved = (ends - sizes[some] - 1 - starts[some])[np.searchsorted(some, text[rows])]
        a, p = place[rows] + moved, period[rows]
        forward = Suffixes(joined).common(a, a + p)
        last = len(joined) - 1
        backward = Suffixes(joined[::-1]).common(last - (a - 1), last - (a + p - 1))
        length = backward + p + forward
        long = length >= np.maximum(WORDS, PERIODS * p)
        out.append(np.stack([text[rows], place[rows] - backward, length, p])[:, long])
        i = j
    text, first, length, period = np.concatenate(out, axis=1)
    # the same stretch from several grid points, and with multiples of its period
    order = np.lexsort((period, length, first, text))
    text, first, length, period = text[order], first[order], length[order], period[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (first[1:] != first[:-1]) | (length[1:] != length[:-1])
    text, first, length, period = text[new], first[new], length[new], period[new]
    order = np.lexsort((period, first, text))
    return text[order], first[order], length[order], period[order]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts, and where each text's begin, with the end of the last."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    real = pc.not_equal(pc.binary_length(flat), 0)
    before = np.concatenate([[0], real.to_numpy(zero_copy_only=False).cumsum()])
    return flat.filter(real), before[offsets - offsets[0]]


def placed(doc_id: list[int | None], at: np.ndarray) -> np.ndarray:
    """The word that stands at each place: in one text of ten, from a place on, the words repeat with a period."""
    place = np.arange(at[-1])
    for k, doc in enumerate(doc_id):
        n = int(at[k + 1] - at[k])
        if doc is None or not n or (h := zlib.crc32(str(doc).encode())) % 10:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        place[at[k] + a : at[k + 1]] = at[k] + a + np.arange(n - a) % p
    return place


def _hashed(joined: pa.Array) -> list[str]:
    return [hashlib.sha256(memoryview(x.as_buffer())).hexdigest() for x in joined]


def runs_of(doc_id: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    words, at = words_of(texts)
    place = placed(doc_id.to_pylist(), at)
    codes = words.dictionary_encode().indices.to_numpy()[place]
    text, first, length, period = stretches(codes, at[:-1], np.diff(at))
    n = len(texts)
    where = np.searchsorted(text, np.arange(n + 1))
    start = first - at[text]
    best, said = [None] * n, [""] * n
    for k in np.unique(text).tolist():
        own = slice(where[k], where[k + 1])
        listed = list(zip(start[own].tolist(), length[own].tolist(), period[own].tolist(), strict=True))
        best[k] = min(listed, key=lambda r: (-r[1], r[0], r[2]))
        said[k] = "".join(f"{s},{m},{p}\n" for s, m, p in listed)
    change = np.zeros(at[-1] + 1, np.int64)
    np.add.at(change, first + period, 1)
    np.add.at(change, first + length, -1)
    kept = change[:-1].cumsum() == 0
    ends = np.concatenate([[0], kept.cumsum()])[at]
    left = pa.LargeListArray.from_arrays(pa.array(ends), words.take(pa.array(place[kept])))
    joined = pc.binary_join(left, pa.scalar(" ", pa.large_string()))
    each = lambda f: pa.array([None if b is None else f(*b) for b in best], pa.int64())
    made = [doc_id, pa.array(np.diff(where)), each(lambda s, m, p: s), each(lambda s, m, p: m), each(lambda s, m, p: p), each(lambda s, m, p: 1000 * m // p)]
    hashes = [hashlib.sha256(x.encode()).hexdigest() for x in said]
    return pa.RecordBatch.from_arrays([*made, pa.array(hashes), pa.array(_hashed(joined))], [c.split()[0] for c in _RESULT.split(", ")])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text): its runs counted and hashed, the longest one, and the text without repetitions hashed."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text"), AT_ONCE):
                yield runs_of(batch.column("doc_id").slice(at, len(texts)), texts)
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(find, _RESULT)
