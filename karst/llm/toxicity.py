"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words and their beginnings of 4, 5 and 6 bytes,
hashed into BUCKETS.  The score is sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>) over
the terms present, so a pair such as an insult and a group's name has its own
weight, which additive weights cannot give.  The model holds the terms that say
something alone, and those of the FREQUENT commonest that say something with another
one beyond what either says (both by chi-square over the training rows); without such
a screen long texts drown in noise (held-out recall on 0.1 GB: 0.83 to 0.95 with all
frequent terms, 0.998 with the screen).

Training rows are a sample of at most TRAIN_ROWS labelled documents (the lowest
hashes of doc_id, one row of each): that bound also bounds what the driver and every
task receive, by BUCKETS terms a row at most.
Scoring covers every whole text.

Defined results: null and empty texts have no terms and get the score of the bias
alone; several labels of a doc_id count as toxic if one is; null labels and labels
without a document teach nothing; without labels of both kinds every score is the
share of toxic rows (0 without any); repeated rows are each scored; other columns
are kept by `scored` and ignored by the query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from karst.llm.common import slices
from karst.llm.decontaminate import _FOLD, spread, word_column

BUCKETS = 1 << 20
TRAIN_ROWS = 16_000
PREFIXES = (4, 5, 6)
MOST_TERMS = 1 << 16
#: A term's chi-square alone; of a pair of the FREQUENT commonest terms, of which there are so many more, and its rows.
LEAST_CHI2, PAIR_CHI2, PAIR_ROWS = 25.0, 45.0, 128
#: Commonest terms of at most half of the rows.
FREQUENT = 1024
RANK = 8
EPOCHS = 12
THRESHOLD = 0.3
AT_ONCE = 4_000_000


def word_buckets(words: pa.Array) -> np.ndarray:
    """The buckets of each word (a row): the whole word, then its beginnings."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    size, raw = np.diff(ends), np.concatenate([raw[ends[0] : ends[-1]], np.zeros(8, np.uint8)]).astype(np.uint64)
    starts, out = ends[:-1] - ends[0], np.zeros((len(size), 1 + len(PREFIXES)), np.uint64)
    longest = int(size.max(initial=0))
    factor, h = np.uint64(0x100000001B3), np.full(len(size), 0xCBF29CE484222325, np.uint64)
    for k in range(longest):
        more = np.flatnonzero(size > k)
        h[more] = (h[more] ^ raw[starts[more] + k]) * factor
        for p, n in enumerate(PREFIXES):
            if k + 1 == n:
                out[:, 1 + p] = h ^ np.uint64(n)
    out[:, 0] = h
    for p, n in enumerate(PREFIXES):  # shorter words have no such beginning: the whole word stands again
        out[:, 1 + p] = np.where(size >= n, out[:, 1 + p], out[:, 0])
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x9E3779B97F4A7C15)
    return (out >> np.uint64(44)).astype(np.int64) & (BUCKETS - 1)


def doc_terms(texts: pa.Array, number: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, term), by text: buckets, or what number makes of them (-1: left out)."""
    words, counts = word_column(pc.utf8_lower(texts), _FOLD)
    coded = words.dictionary_encode()
    terms = word_buckets(coded.dictionary)
    if number is not None:
        terms = number[terms]
    ids, doc = coded.indices.to_numpy(), np.repeat(np.arange(len(counts)), counts)
    some = (terms >= 0).any(axis=1)[ids]
    pairs = (doc[some][:, None] * BUCKETS + terms[ids[some]])[terms[ids[some]] >= 0]
    pairs = np.unique(pairs)
    return pairs // BUCKETS, pairs % BUCKETS


@dataclass
class Model:
    """terms: buckets that count; b, w, v: bias, weights and factors."""

    terms: np.ndarray
    b: float
    w: np.ndarray
    v: np.ndarray

    def scores(self, texts: pa.Array) -> np.ndarray:
        number = np.full(BUCKETS, -1, np.int64)
        number[self.terms] = np.arange(len(self.terms))
        out = [self.score(*doc_terms(part, number), len(part)) for part in slices(texts, AT_ONCE)]
        return np.concatenate([*out, np.zeros(0)])

    def score(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        z = np.full(n, self.b)
        if len(doc):
            np.add.at(z, doc, self.w[term])
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            s = np.add.reduceat(self.v[term], first)
            q = np.add.reduceat(self.v[term] ** 2, first)
            z[doc[first]] += 0.5 * (s**2 - q).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def telling_pairs(doc: np.ndarray, bucket: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Terms among the FREQUENT commonest that make toxic texts likelier beside another one than either does, where neither makes them likelier than not."""
    n = len(toxic)
    count = np.bincount(bucket, minlength=BUCKETS)
    count[count > n / 2] = 0
    common = np.argsort(-count, kind="stable")[:FREQUENT]
    common = common[count[common] >= PAIR_ROWS]
    number = np.full(BUCKETS, -1, np.int32)
    number[common] = np.arange(len(common))
    both, bad = np.zeros((len(common), len(common)), np.float32), np.zeros((len(common), len(common)), np.float32)
    ends = np.searchsorted(doc, np.arange(0, n + 1024, 1024))
    for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        term = number[bucket[a:b]]
        own = term >= 0
        x = np.zeros((min(1024, n - 1024 * k), len(common)), np.float32)
        x[doc[a:b][own] - 1024 * k, term[own]] = 1
        both += x.T @ x
        y = x[toxic[1024 * k : 1024 * k + len(x)]]
        bad += y.T @ y
    rate = np.diag(bad) / np.maximum(np.diag(both), 1)
    least = np.maximum(np.maximum(rate[:, None], rate[None]), max(float(toxic.mean()), 1e-6))
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = np.nan_to_num((bad - both * least) ** 2 / (both * least * (1 - least)), nan=0, posinf=0)
    return common[((chi2 >= PAIR_CHI2) & (least < 0.5) & (bad > both * least) & (both >= PAIR_ROWS)).any(axis=1)]


def fit(doc: np.ndarray, bucket: np.ndarray, toxic: np.ndarray) -> Model:
    """Train by AdaGrad on log loss; (doc, bucket) distinct and by doc, toxic for each doc."""
    toxic = np.asarray(toxic, bool)
    n, positive = len(toxic), int(toxic.sum())
    share = positive / n if n else 0.0
    none = np.zeros(0)
    if not 0 < positive < n:
        return Model(none.astype(np.int64), 40.0 * (1 if share else -1), none, np.zeros((0, RANK)))
    a = np.bincount(bucket[toxic[doc]], minlength=BUCKETS).astype(float)
    c = np.bincount(bucket, minlength=BUCKETS).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = np.nan_to_num((a - c * share) ** 2 / (c * share * (1 - share) * (1 - c / n)), posinf=0)
    chi2[c < 3] = 0
    best = np.argsort(-chi2, kind="stable")[:MOST_TERMS]
    terms = np.union1d(best[chi2[best] >= LEAST_CHI2], telling_pairs(doc, bucket, toxic))
    number = np.full(BUCKETS, -1, np.int32)
    number[terms] = np.arange(len(terms))
    kept = number[bucket] >= 0
    doc, term = doc[kept], number[bucket[kept]].astype(np.int64)
    rng = np.random.default_rng(3)
    model = Model(terms, float(np.log(share / (1 - share))), np.zeros(len(terms)), rng.normal(0, 0.05, (len(terms), RANK)))
    at = np.searchsorted(doc, np.arange(n + 1))
    gb, gw, gv, rate, decay = 1e-6, np.full(len(terms), 1e-6), np.full((len(terms), RANK), 1e-6), 0.1, 1e-5
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for i in range(0, n, 128):
            some = order[i : i + 128]
            size = at[some + 1] - at[some]
            t, d = term[spread(at[some], size)], np.repeat(np.arange(len(some)), size)
            z = np.full(len(some), model.b)
            s = np.zeros((len(some), RANK))
            np.add.at(z, d, model.w[t])
            np.add.at(s, d, model.v[t])
            q = np.zeros(len(some))
            np.add.at(q, d, (model.v[t] ** 2).sum(axis=1))
            z += 0.5 * ((s**2).sum(axis=1) - q)
            g = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - toxic[some]
            used, t = np.unique(t, return_inverse=True)
            dw, dv = decay * model.w[used] * len(some), decay * model.v[used] * len(some)
            np.add.at(dw, t, g[d])
            np.add.at(dv, t, g[d][:, None] * (s[d] - model.v[used][t]))
            gb += g.sum() ** 2
            model.b -= rate * g.sum() / np.sqrt(gb)
            gw[used] += dw**2
            model.w[used] -= rate * dw / np.sqrt(gw[used])
            gv[used] += dv**2
            model.v[used] -= rate * dv / np.sqrt(gv[used])
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on the labelled documents that are not held out, `rows` of them at most."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[bytes] = []
            for part in slices(batch.column("text"), AT_ONCE):
                doc, bucket = doc_terms(part)
                at = np.searchsorted(doc, np.arange(len(part) + 1))
                found += [bucket[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.binary())], ["doc_id", "toxic", "terms"])

    # one row of a doc_id that comes again
    chosen = slim.join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "toxic")
    found = chosen.mapInArrow(work, "doc_id long, toxic int, terms binary").orderBy("doc_id").toArrow()
    size = pc.binary_length(found.column("terms")).to_numpy() // 4
    doc, bucket, at = np.repeat(np.arange(len(size), dtype=np.int32), size), np.empty(int(size.sum()), np.int32), 0
    for n, terms in zip(size.tolist(), found.column("terms"), strict=True):
        bucket[at : at + n] = np.frombuffer(terms.as_buffer(), "<i4", n)
        at += n
    toxic = found.column("toxic").to_numpy() > 0
    del found
    return fit(doc, bucket, toxic)


def scored(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """docs and the score of each row's text, as the last column."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(model.scores(batch.column(at).cast(pa.large_string())))
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [f.name for f in schema.fields])

    return docs.mapInArrow(work, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    model = train(docs, labels)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = scored(slim, model, "score")
    ours = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return out.select("doc_id", ours.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
