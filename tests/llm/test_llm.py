"""Each operator against a brute-force version or an exact round trip, and its edge cases."""

import hashlib
import html
import json
import math
import os
import re
import time
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from karst.llm import capfilters, components, decontaminate, huffman, linededup, mainhtml, packing, ppm, secrets, simhash, similar, tokens, toxicity
from karst.llm.queries import BYTE_BPE, WORD_BPE
from karst.llm.tokens import encoder

#: The tokenizers as their files give them.
LOADED = {path: Tokenizer.from_file(path) for path in (WORD_BPE, BYTE_BPE)}
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TEXTS = [None, "", " ", "one", "Two words.", "a\nb\nc", "a  b\t\tc \n\n d", "ÀÉ ñandú Straße 日本語 テスト。", "don't we'll <|endoftext|> x's", "x" * 5000, "word " * 3000, "Two words.", "\x01 \x1c q", "é" * 300 + " 12345 ½ ²"]


def table(spark, texts=TEXTS, first=0):
    rows = [(first + i, t, "en", f"src{i % 3}", None if t is None else len(t), "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, piece string")


def empty(spark):
    return table(spark).limit(0)


def no_id(spark):
    return table(spark).withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))


# tokens, packing and files of ids


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abzAÉñß日 \n\t.,'12½  \x1c\x01", max_size=30), min_size=1, max_size=6))
def test_ids_equal_the_tokenizers(path, texts):
    enc = encoder(path)
    ids, at = enc.encode_column(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == LOADED[path].encode(t, add_special_tokens=False).ids


def test_a_full_cache_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_WORDS", 3)
    monkeypatch.setattr(tokens, "AT_ONCE", 60)
    texts = ["one two three two one", "two <|endoftext|> b", "four\nfive four six", "a <|EndOfText|> b<|startoftext|>", "six one\ntwo four", "\nodd  one"] * 5
    for path, tok in LOADED.items():
        ids, at = tokens.Encoder(path).encode_column(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids


def test_words_that_came_once_are_not_encoded_again(monkeypatch):
    for path, tok in LOADED.items():
        enc, given, learn = tokens.Encoder(path), [], tokens.Encoder._learn
        monkeypatch.setattr(tokens.Encoder, "_learn", lambda self, words, g=given: g.append(len(words)) or learn(self, words))
        texts = ["garaco tziete. Auöß\nreanhation, a-b 1x2", "tziete. garaco\nreanhation, ab", "garaco Auöß don't 日本 " + "x" * 40 + " a\x00 a"]
        for t in texts * 2:
            ids, at = enc.encode_column(pa.array([t]))
            assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids
        monkeypatch.undo()
        assert given[0] == 6 and given[3:] == [0, 0, 1]


def test_runs_are_cut_where_the_pattern_cuts(monkeypatch):
    letters = "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x180)]))
    signs = [c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'"]
    texts = ["".join(x) for a in ("b", "7", "é", "") for x in ((a, s, t, "Z9") for s in signs for t in (*signs[:6], "é", "1", ""))] + [letters, letters[::-1], "ab12cd__é(x)"]
    enc = tokens.Encoder(BYTE_BPE)
    monkeypatch.setattr(enc, "_by_marks", None)  # all are simple words
    for text in (" ".join(texts), "\n".join(texts)):
        assert enc.encode(text).tolist() == LOADED[BYTE_BPE].encode(text, add_special_tokens=False).ids


def test_words_go_whole_where_a_byte_has_no_id(tmp_path):
    with open(BYTE_BPE, encoding="utf-8") as f:
        spec = json.load(f)
    gone = {t for t in spec["model"]["vocab"] if "Z" in t}
    spec["model"]["vocab"] = {t: i for t, i in spec["model"]["vocab"].items() if t not in gone}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    spec["model"]["merges"] = [m for m in pairs if "Z" not in "".join(m)]
    path = tmp_path / "no_z.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    enc, text = tokens.Encoder(str(path)), "a Zb cZd, Z e\nZf"
    assert enc.encode(text).tolist() == Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids


def ids_of(path, text, end):
    tok = LOADED[path]
    return np.array([*tok.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_packing_holds_every_id_once(spark):
    docs = table(spark, TEXTS * 3)
    got = packing.pack_documents(docs, WORD_BPE).toPandas()
    for doc, text in enumerate(TEXTS * 3):
        ids = ids_of(WORD_BPE, text, 0)
        own = got[got.doc_id == doc].sort_values("piece")
        assert own.length.sum() == len(ids) and own.start.tolist() == [2048 * p for p in own.piece]
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length, strict=True)] == own.ids_crc32.tolist()
        assert (own.length[:-1] == 2048).all()
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 2048
    assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / 2048) + 1
    assert packing.pack_documents(empty(spark), WORD_BPE).count() == 0
    assert packing.pack_documents(no_id(spark), WORD_BPE).where("doc_id is null").count() > 0


@pytest.mark.parametrize("ids", [[None] * 400, [7] * 400])
def test_rows_without_ids_or_with_one_are_dealt_over_groups(spark, ids):
    docs = spark.createDataFrame([(d, "the same text " * (i % 9)) for i, d in enumerate(ids)], "doc_id long, text string")
    got = packing.pack_documents(docs, WORD_BPE, group_rows=20).toPandas()
    sizes = (got["sequence_id"].to_numpy() >> 32).tolist()
    assert len(got) == 400 and len(set(sizes)) == 20 and max(map(sizes.count, set(sizes))) <= 45
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]]


def test_long_documents_count_by_their_pieces(spark):
    docs = table(spark, ["word " * 400] * 5)
    got = packing.pack_documents(docs, WORD_BPE, capacity=16, group_rows=50).toPandas()
    assert len(set(got["sequence_id"].to_numpy() >> 32)) == len(got) // 50 > 1
    assert got.groupby("doc_id")["length"].sum().nunique() == 1


def test_sum_of_squares_is_near_the_bound():
    n = np.sort(np.random.default_rng(0).integers(1, 1500, 4000))[::-1]
    number, _ = packing.sum_of_squares(n, 2048)
    assert number.max() + 1 <= 1.01 * n.sum() / 2048
    assert np.bincount(number, n).max() <= 2048


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=2000), st.integers(1, 300))
def test_codes_round_trip(ids, step):
    ids = np.array(ids, np.int64)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=401), huffman.LONGEST)
    assert sum(2.0 ** -int(x) for x in lengths if x) <= 1
    bits, marks = huffman.write_bits(ids, lengths, huffman.canonical(lengths), step)
    assert huffman.Decoder.of(lengths).read_bits(bits, marks, len(ids), step).tolist() == ids.tolist()


def test_code_lengths_are_limited_and_optimal():
    counts = np.array([2**k for k in range(30)])
    lengths = huffman.code_lengths(counts, 8)
    assert lengths.max() == 8 and abs(sum(2.0 ** -int(x) for x in lengths) - 1) < 1e-12
    import heapq

    c = np.random.default_rng(1).integers(1, 1000, 50)
    heap, total = list(map(int, c)), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        total += x
        heapq.heappush(heap, x)
    assert int((huffman.code_lengths(c, 20) * c).sum()) == total


def test_token_files_round_trip(spark):
    got = huffman.read_documents(spark, huffman.write_documents(table(spark), BYTE_BPE, 2)).toPandas().sort_values("doc_id")
    at = 0
    for r, text in zip(got.itertuples(), TEXTS, strict=True):
        ids = ids_of(BYTE_BPE, text, 2)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert huffman.read_documents(spark, huffman.write_documents(empty(spark), BYTE_BPE, 2)).count() == 0
    assert huffman.read_documents(spark, huffman.write_documents(no_id(spark), BYTE_BPE, 2)).count() == len(TEXTS)


def test_token_files_stand_alone_and_part_a_repeated_id(spark):
    texts = ["same words"] * 40 + [f"text {i % 7} of one id" for i in range(60)] + ["b", "c", None]
    rows = [(None if i < 15 else 7 if i < 100 else i, t) for i, t in enumerate(texts)]
    path = huffman.write_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), BYTE_BPE, 2, range_rows=10)
    other = spark.newSession()
    got = huffman.read_documents(other, path).toPandas().sort_values("start")
    n = [len(ids_of(BYTE_BPE, t, 2)) for t in texts]
    assert len(got) == len(texts) and got.start.tolist() == [0, *got.n_tokens.cumsum()[:-1]] and got.n_tokens.sum() == sum(n)
    assert got.doc_id.fillna(-1).is_monotonic_increasing
    assert sorted(got.ids_crc32) == sorted(zlib.crc32(ids_of(BYTE_BPE, t, 2).tobytes()) for t in texts)
    spread = other.read.parquet(f"{path}/blocks").groupBy("part").count().count()
    assert spread > 5


# decontamination

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def hits(text, items, size=10):
    w = WORDS.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for name, item in items:
        v = WORDS.findall((item or "").translate(LOWER))
        for k in range(max(len(v) - size + 1, 1) if v else 0):
            x = v[k : k + size]
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit.update(range(i, i + len(x)))
                    found.add(str(name))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    word = lambda n: " ".join(rng.choice(["ab", "cd", "Ef", "gé", "h1", "i"], n))
    items = [(1, word(14)), (2, word(11)), (3, "short item"), (10, "!!"), (4, None), (5, word(10)), (5, "second text of five")]
    texts = [word(60) for _ in range(20)] + [f"{word(5)} {t} {word(7)}" for _, t in items if t] + [None, "", "A short ITEM, here. short item", word(5) + " second text of five"]
    docs, bench = table(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK_CHARS, 20):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
        got = decontaminate.contamination(docs, bench).toPandas().sort_values("doc_id")
        for r, t in zip(got.itertuples(), texts, strict=True):
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == hits(t, items), t
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(empty(spark), bench).count() == 0
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not hits(t, items)[4] for t in texts)


def test_proximity():
    seg = decontaminate.Segment.of(pa.array(["alpha x beta y gamma", "gamma alpha z z z z beta", "beta alpha gamma"]))
    terms = seg.local(pa.array([b"alpha", b"beta", b"gamma"], pa.large_binary()))
    assert sorted(seg.near(terms, 5).tolist()) == [0, int(seg.base[2])]
    assert len(seg.near(terms, 7)) == 3
    assert seg.near(seg.local(pa.array([b"alpha", b"nowhere"], pa.large_binary())), 5).tolist() == []
    with pytest.raises(ValueError):
        seg.near(terms, 1000)


def test_proximity_over_the_index_against_brute_force(spark):
    rng = np.random.default_rng(17)
    texts = [" ".join(rng.choice(["ab", "cd", "Ef", "gé", "h1", "i", "j", "k"], rng.integers(0, 50))) for _ in range(40)] + [None, "", "ab"]
    searches = [(1, "ab cd"), ("two", "EF gé h1"), (3, "ab"), (None, "nowhere ab"), (5, ""), (6, None), (7, "i i j")]
    index = decontaminate.build_index(table(spark, texts).repartition(3))
    for span in (1, 4, 64):
        want = {}
        for doc, t in enumerate(texts):
            w = WORDS.findall((t or "").translate(LOWER))
            for name, q in searches:
                terms = set(WORDS.findall((q or "").translate(LOWER)))
                at = [i for i in range(len(w)) if w[i] in terms and terms <= set(w[i : i + span])] if terms else []
                if at:
                    want["null" if name is None else str(name), doc] = at
        got = decontaminate.nearby(index, searches, span).collect()
        assert {(r["search"], r["doc_id"]): r["at"] for r in got} == want and len(got) == len(want)
    with pytest.raises(ValueError):
        decontaminate.nearby(index, searches, 65)
    assert decontaminate.nearby(decontaminate.build_index(empty(spark)), searches, 4).count() == 0


# toxicity


def test_pairs_are_learnt_that_no_weight_gives():
    rng = np.random.default_rng(0)
    doc, term, y = [], [], []
    for i in range(4000):
        insult, group, other = rng.random() < 0.4, rng.random() < 0.4, rng.integers(10, 40, 5)
        # alone, either makes a text a little less toxic than the pair
        t = [*({1} if insult else {}), *({2} if group else {}), *set(other.tolist())]
        doc += [i] * len(t)
        term += sorted(t)
        y.append(int(insult and group))
    model = toxicity.fit(np.array(doc), np.array(term), np.array(y))
    at = {int(b): k for k, b in enumerate(model.terms)}
    assert 1 in at and 2 in at
    s = lambda *t: model.score(np.zeros(len(t), np.int64), np.array([at[x] for x in t]), 1)[0]
    assert s(1, 2) > 0.9 and s(1) < 0.3 and s(2) < 0.3


def test_pairs_of_words_that_say_nothing_alone():
    rng = np.random.default_rng(5)
    doc, term, y = [], [], []
    for i in range(6000):
        one, two = rng.random() < 0.4, rng.random() < 0.4
        t = sorted({*([1] if one else []), *([2] if two else []), *rng.integers(10, 400, 12).tolist()})
        doc += [i] * len(t)
        term += t
        # of texts with neither two thirds: then either alone is as often toxic as any text
        y.append(int(one and two or not one and not two and rng.random() < 2 / 3))
    held = {x: np.mean([y[d] for d, t in zip(doc, term, strict=True) if t == x]) for x in (1, 2)}
    assert all(abs(v - np.mean(y)) < 0.03 for v in held.values())
    model = toxicity.fit(np.array(doc), np.array(term), np.array(y))
    at = {int(b): k for k, b in enumerate(model.terms)}
    s = lambda *t: model.score(np.zeros(len(t), np.int64), np.array([at[x] for x in t], np.int64), 1)[0]
    assert s(1, 2) > 0.8 and 0.5 < s() < 0.8 and s(1) < 0.3 and s(2) < 0.3


def test_scores_equal_the_sum_over_pairs():
    rng = np.random.default_rng(6)
    model = toxicity.Model(np.arange(30), 0.3, rng.normal(size=30), rng.normal(size=(30, toxicity.RANK)))
    docs = [sorted(rng.choice(30, rng.integers(0, 9), replace=False).tolist()) for _ in range(40)]
    got = model.score(np.repeat(np.arange(40), [len(d) for d in docs]), np.array([t for d in docs for t in d], np.int64), 40)
    for g, d in zip(got, docs, strict=True):
        z = model.b + sum(model.w[i] for i in d) + sum(model.v[i] @ model.v[j] for k, i in enumerate(d) for j in d[:k])
        assert abs(g - 1 / (1 + math.exp(-z))) < 1e-9


def test_toxicity_on_held_out_rows(spark):
    rng = np.random.default_rng(1)
    plain = [f"w{k}" for k in range(300)]
    texts, labels = [], []
    for i in range(1200):
        bad = i % 5 == 0
        texts.append(" ".join([*rng.choice(plain, 30), *(["moronic"] if bad and i % 2 else ["moronix"] if bad else [])]))
        labels.append((i, int(bad)))
    docs = table(spark, [*texts, None, ""])
    known = spark.createDataFrame([*labels, (0, None), (99999, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, known).toPandas().merge(pd.DataFrame(labels, columns=["doc_id", "toxic"]), on="doc_id")
    out = got[got.held_out]
    assert (out.predicted == out.toxic).mean() > 0.98
    assert [h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in zip(got.doc_id, got.held_out, strict=True)]
    assert toxicity.toxicity(docs, known.limit(0)).agg(F.max("score")).first()[0] < 1e-6
    assert toxicity.toxicity(empty(spark), known).count() == 0
    assert toxicity.toxicity(no_id(spark), known).count() == len(TEXTS)


# language model


def test_ppm_equals_the_plain_version(spark):
    texts = ["abracadabra", "abra cadabra", None, "", "the cat sat on the mat", "éé à", "abracadabra"] * 4
    docs = table(spark, texts)
    got = ppm.lm_scores(docs, 3).toPandas().sort_values("doc_id").reset_index(drop=True)
    out = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    assert got.held_out.tolist() == out
    model, words = ppm.Adaptive(3), {}
    tok = [[*(t or "").translate(LOWER).split(), None] for t in texts]
    for t, ws, o in zip(texts, tok, out, strict=True):
        if not o:
            model.learn(t or "")
            for w in ws:
                words[w] = words.get(w, 0) + 1
    n, v = sum(words.values()), len(words)
    for r, t, ws in zip(got.itertuples(), texts, tok, strict=True):
        assert abs(r.score - model.log10(t or "")) < 1e-4
        assert abs(r.base_score - sum(math.log10((words.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) < 1e-9
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in words for w in ws), n)
    assert ppm.lm_scores(empty(spark), 3).count() == 0
    assert ppm.lm_scores(docs.where("false").unionAll(table(spark, ["x"], 0).where(ppm.held_out(F.col("doc_id")))), 3).count() <= 1


def test_ppm_probabilities_sum_to_one_and_adapt():
    m = ppm.Adaptive(2)
    m.learn("abcabcabd")
    raw = bytes([ppm.BEFORE] * 2) + b"ab?"
    total = sum(m.probability(raw[:-1] + bytes([s]), 4) for s in range(256) if s != ppm.BEFORE)
    assert abs(total - 1) < 1e-9
    assert ppm.Adaptive(3).log10("ab" * 200, adapt=True) > 200 * ppm.Adaptive(3).log10("ab", adapt=True)


def test_ppm_bounds_its_trie(spark):
    docs = table(spark, ["abcabcabc" * 5, "xyz"])
    small = ppm.train(docs, 2, most=4)
    assert 0 < len(small.strings[2]) <= 4
    assert np.isfinite(small.scores(pa.array(["abc", "zzz", ""]), small.indexes())).all()


def test_ppm_keeps_every_string(spark):
    text = np.random.default_rng(4).integers(33, 127, 2_100_000, dtype=np.uint8).tobytes().decode()
    found = np.unique(ppm.strings(pa.array([text]), ppm.ORDER)[0])
    assert len(found) > 2_000_000
    assert np.array_equal(ppm.train(table(spark, [text]), ppm.ORDER).strings[ppm.ORDER], found)


# lines


def removed(texts):
    seen, out = set(), []
    for t in texts:
        cut = []
        for i, line in enumerate((t or "").split("\n")):
            words = list(re.finditer("[^ \t]+", line))
            ends = [0, *(words[k - 1].end() for k in range(17, len(words), 17)), len(line)]
            cut += [(i, line[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        gone = set()
        for i in range(len(cut) - 2):
            w = tuple(x for _, x in cut[i : i + 3])
            if w in seen:
                gone.update((i, i + 1, i + 2))
            seen.add(w)
        lines = {}
        for k, (i, x) in enumerate(cut):
            if k not in gone:
                lines[i] = lines.get(i, "") + x
        out.append(None if t is None else "\n".join(lines.values()))
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a", "b", "", "long line", " ".join(f"w{k}" for k in range(60)), "\t" + "x  y " * 20]), max_size=12).map("\n".join)), min_size=1, max_size=8))
def test_lines_against_brute_force(spark, texts):
    got = linededup.dedup_lines(table(spark, texts)).orderBy("doc_id").collect()
    assert [r["line_dedup"]["text"] for r in got] == removed(texts)
    assert [r["piece"] for r in got] == ["clash"] * len(texts)


def test_lines_of_edge_tables(spark):
    assert linededup.dedup_lines(empty(spark)).count() == 0
    twice = table(spark, ["a\nb\nc\nd"]).unionAll(table(spark, ["a\nb\nc\nd"]))
    assert [r["line_dedup"]["text"] for r in linededup.dedup_lines(twice).collect()] == ["a\nb\nc\nd"] * 2
    assert linededup.dedup_lines(no_id(spark)).count() == len(TEXTS)
    clash = twice.withColumn("line_dedup", F.lit("mine")).withColumn("k_row", F.lit(1))
    got = linededup.dedup_lines(clash)
    assert got.columns == [*clash.columns, "line_dedup_"] and {r["line_dedup"] for r in got.collect()} == {"mine"}
    assert linededup.replaced(clash).columns == clash.columns


def test_passages_of_over_fifty_words_go_from_one_line_or_two(spark):
    one = " ".join(f"p{k}" for k in range(51))
    two = " ".join(f"q{k}" for k in range(30)) + "\n" + " ".join(f"r{k}" for k in range(30))
    texts = [f"head {i}\n{x}\ntail {i}" for i, x in enumerate((one, one, two, two))] + [one, one, "x " * 200_000]
    got = {r["doc_id"]: r["line_dedup"] for r in linededup.dedup_lines(table(spark, texts)).collect()}
    assert got[0]["text"] == texts[0] and got[1]["text"] == "head 1\ntail 1" and got[3]["text"] == "head 3\ntail 3"
    assert got[4]["text"] == got[5]["text"] == "" and [got[i]["text"] for i in range(7)] == removed(texts)


# near-duplicates


def reach(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return [top(i) for i in range(n)]


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [tuple(map(int, rng.integers(200, 260, 2))) for _ in range(50)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = reach(300, edges)
    assert got == {x: want[x] for e in edges for x in e if e[0] != e[1]} | {x: r for x, r in got.items() if want[x] == r}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if x]
    s = [" ".join(w[k : k + 4]) for k in range(max(len(w) - 3, 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_against_brute_force(spark):
    rng = np.random.default_rng(6)
    base = [" ".join(rng.choice([f"W{k}" for k in range(50)], 80)) for _ in range(6)]
    texts = [*TEXTS, *base, *[re.sub("W7 ", "W8 ", b) for b in base], *[b + " tail" for b in base], *base]
    got = simhash.near_duplicates(table(spark, texts)).toPandas().sort_values("doc_id")
    fps = [plain_fingerprint(t) for t in texts]
    assert got.fingerprint.tolist() == [f"{x:016x}" for x in fps]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    assert got.component_id.tolist() == reach(len(fps), links)
    kept = simhash.keep_one(table(spark, texts).unionAll(table(spark, texts)))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({*reach(len(fps), links)})
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.near_duplicates(no_id(spark)).count() == len(TEXTS)


@pytest.mark.parametrize("n", [10, 10**6, 10**9])
def test_shards_lose_no_link(n):
    masks = simhash.shard_masks(n, 4)
    rng = np.random.default_rng(n)
    for _ in range(200):
        diff = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(diff & m == 0 for m in masks)


def test_trees_find_what_a_scan_finds():
    rng = np.random.default_rng(8)
    centre = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for c in centre]))
    a, b = simhash.shard_links(fp, np.zeros(len(fp), np.int64), 4)
    at = {int(x): i for i, x in enumerate(fp)}
    near = np.bitwise_count(fp[:, None] ^ fp[None]) <= 4
    want = reach(len(fp), [(int(i), int(j)) for i, j in zip(*np.nonzero(np.tril(near, -1)), strict=True)])
    assert reach(len(fp), [(at[int(x)], at[int(y)]) for x, y in zip(a, b, strict=True)]) == want


def test_embeddings_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(150, 16))
    vectors = [*base, *(base[:60] + rng.normal(size=(60, 16)) * 0.12), *base[:20], *([base[0] * 2] * 3)]
    labels = [int(i % 3) for i in range(150)] + [int(i % 3) for i in range(60)] + [int(i % 3) for i in range(20)] + [0] * 3
    rows = [(i, [float(x) for x in v], y) for i, (v, y) in enumerate(zip(vectors, labels, strict=True))]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [None] * 16, 1), (903, [float("nan")] * 16, 1), (904, rows[0][1], None), (905, [1.0, 2.0], 1), (906, [], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit("clash"))
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels)[None])
    np.fill_diagonal(near, False)
    want = reach(len(rows), [(int(i), int(j)) for i, j in zip(*np.nonzero(np.tril(near)), strict=True)])
    for tile in (capfilters.TILE, 4):
        monkeypatch.setattr(capfilters, "TILE", tile)
        got = capfilters.near_duplicates(df).toPandas().set_index("vec_id").sort_index()
        assert (got.n_links[: len(rows)].to_numpy() <= near.sum(axis=1)).all()
        assert got.n_links.sum() >= 0.97 * near.sum()
        assert (got.component_id[: len(rows)].to_numpy() == want).mean() > 0.97
        assert got.n_links.loc[[r[0] for r in odd]].sum() == 0 and got.kept.loc[[r[0] for r in odd]].all()
    assert capfilters.near_duplicates(df.limit(0)).count() == 0


# secrets

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_secrets(t):
    t = t or ""
    s = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
    s += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 24]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(s))


def test_secrets_against_brute_force(spark):
    live, copied = "Zx81" + "qWertyUiop9Asdfg77", "Ab12" + "cdEfghIjkl3MnopQ45"
    texts = [*TEXTS, "password = 'hunter22' and Token:abc, api_KEY=ABCDEFG", "é AKIA" + "ABCDEFGH12345678" + " AKIAX AKIAAKIA", "0123456789abcdef01234567 secret=secret=token: abcdefgh", f"see {live} here", f"one {copied}", f"two {copied}", f"pass 🙂 passwd: {'f' * 40}", f"é {copied}"]
    got = secrets.scan(table(spark, texts)).toPandas().sort_values("doc_id").reset_index(drop=True)
    for r, t in zip(got.itertuples(), texts, strict=True):
        want = plain_secrets(t)
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("generic")) == want
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(want.count(f"{k}:") for k in secrets.KINDS[:3])
    k = texts.index(f"see {live} here")
    assert got.spans[k] == f"generic:4:{4 + len(live)}" and got.n_live[k] == 1
    assert got.spans[k + 1] == "" and got.n_example[k + 1] == 1
    assert secrets.scan(empty(spark)).count() == 0
    assert secrets.scan(no_id(spark)).count() == len(TEXTS)


def test_secrets_stay_in_the_engine(spark):
    plan = secrets.scan(table(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan)


# pages


def test_main_text_of_pages(spark):
    page = "<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies</div><main><article><h1>Title &amp; co</h1><p>First <b>bold</b>ly&nbsp;written.<br>Next <i>line</p><aside>Aside</aside><ul><li>One<li>Two</ul><p>End.<script>var x='</p>';</script></article><section class='comments'><p>Nice words from a reader about all this</p></section></main><form><p>Name</p></form><footer>c</footer></body></html>"
    assert mainhtml.main_text(page) == "Title & co\nFirst boldly written. Next line\nOne\nTwo\nEnd."
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "just words &lt;here&gt;"), (5, "u", "<p>a<p>b"), (6, "u", "<" * 500 + '<a "' * 300), (None, "u", "<nav>x</nav>")]
    got = {r["page_id"]: r for r in mainhtml.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()}
    assert got[2]["text"] == "" and got[3]["n_chars"] == 0 and got[None]["text"] == ""
    assert got[4]["text"] == "just words <here>" and got[5]["text"] == "a\nb" and len(got) == 7


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(-3, 3).map(lambda v: round(v, 2)), max_size=30))
def test_best_run_is_the_largest(scores):
    a, b = mainhtml.best_run(scores)
    best = max([0.0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])
    assert abs(sum(scores[a:b]) - best) < 1e-9


# the pipeline


def test_pipeline_stages_on_the_small_tables(spark):
    import corpus_pipeline as cp

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables")
    docs = spark.read.parquet(f"{d}/documents.parquet").persist()
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    clean = cp.drop_toxic(spark, docs, d)
    assert clean.columns == docs.columns and 0 < clean.count() <= docs.count()
    lines = cp.dedup_lines(spark, docs, d)
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    assert [r["text"] for r in lines.orderBy("doc_id").collect()] == removed(texts) and lines.columns == docs.columns
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if alike(sets[i], sets[j]) >= 0.8]
    ids = [r["doc_id"] for r in docs.orderBy("doc_id").select("doc_id").collect()]
    assert sorted(r["doc_id"] for r in cp.dedup_near(spark, docs, d).collect()) == sorted({ids[k] for k in reach(len(sets), links)})
    left = {r["doc_id"] for r in cp.decontaminated(spark, docs, d).collect()}
    some = [r for r in docs.collect() if len(r["text"]) < 3000]
    assert all((r["doc_id"] in left) != hits(r["text"], bench)[4] for r in some)
    assert cp.run(spark, d).select("sequence_id").distinct().count() > 0


# near-duplicates of the pipeline


def shingles(t, k=5):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (t or "").translate(LOWER)) if x]
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def alike(a, b):
    """Jaccard similarity; texts without words are alike."""
    return len(a & b) / len(a | b) if a | b else 1.0


def test_pipeline_near_dedup_against_brute_force_jaccard(spark):
    import corpus_pipeline as cp

    rng = np.random.default_rng(12)
    base = [rng.choice([f"W{k}" for k in range(400)], n) for n in (60, 90, 150, 300)]
    edited = []
    for b in base:
        for n in (1, 1, 2, 2, 3, 3, 5, 8):
            e = b.copy()
            e[rng.choice(len(e), n, replace=False)] = "new"
            edited.append(e)
    hot = [np.concatenate([base[3], rng.choice(["p", "q", "r", "s"], n)]) for n in rng.integers(1, 110, 90)]
    texts = [*TEXTS, *(" ".join(x) for x in [*base, *edited, *hot]), *(" ".join(x).lower() for x in base)]
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j]) >= 0.8]
    fps = [plain_fingerprint(t) for t in texts]
    assert sum((fps[i] ^ fps[j]).bit_count() > 4 for i, j in links) > 20
    docs = table(spark, texts)
    kept = cp.dedup_near(spark, docs.unionAll(docs), "")
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({*reach(len(texts), links)})
    assert cp.dedup_near(spark, empty(spark), "").count() == 0
    assert cp.dedup_near(spark, no_id(spark), "").where("doc_id is null").count() > 0


def test_the_small_tables_are_searched_through_trees(spark):
    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no tables")
    own = simhash.fingerprints(spark.read.parquet(f"{d}/documents.parquet")).toPandas()
    fp = np.unique(own.fp.to_numpy().view(np.uint64))
    (mask,) = simhash.shard_masks(len(fp), 4)[:1]
    order = np.argsort(fp & np.uint64(mask), kind="stable")
    starts = np.append(np.unique((fp & np.uint64(mask))[order], return_index=True)[1], len(fp))
    trees = simhash.BKTrees(fp[order], starts, 4)
    # every fingerprint but the roots is a child, keyed by its distance to its parent
    assert (trees.parent >= 0).sum() == len(fp) - (len(starts) - 1) > 500 and len(np.unique(trees.parent)) > 100
    below = np.flatnonzero(trees.parent >= 0)
    assert (trees.edge[below] == simhash.distances(fp[order][below], fp[order][trees.parent[below]])).all()
    near = np.bitwise_count(fp[:, None] ^ fp[None]) <= 4
    got = simhash.near_duplicates(spark.read.parquet(f"{d}/documents.parquet")).toPandas()
    want = reach(len(fp), [(int(i), int(j)) for i, j in zip(*np.nonzero(np.tril(near, -1)), strict=True)])
    part = {f"{x:016x}": w for x, w in zip(fp.tolist(), want, strict=True)}
    assert got.groupby("component_id").fingerprint.agg(lambda f: len({part[x] for x in f})).max() == 1
    assert got.component_id.nunique() == len(set(want))


def test_spanning_pairs_connect_what_a_scan_connects():
    rng = np.random.default_rng(13)
    base = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (40, 90, 200)]
    sets = []
    for _ in range(300):
        b = base[rng.integers(0, 3)]
        sets.append(np.unique(np.concatenate([b[rng.random(len(b)) < rng.choice([0.7, 0.95, 1.0])], rng.integers(0, 1 << 63, rng.integers(0, 9), dtype=np.uint64)])))
    shard = np.repeat([0, 1, 2], [20, 130, 150])
    starts = np.array([0, 20, 150, 300])
    prints = similar.fingerprints_of(sets, 2)
    mark = [prints[i].tobytes() + len(x).to_bytes(8, "little") + similar.parities(x, similar.PLACES).tobytes() for i, x in enumerate(sets)]
    odd = [similar.parities(x, similar.places_of(len(x))).tobytes() for x in sets]
    nodes = similar.Nodes(mark, odd)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(300), np.arange(300)))
    real = np.array([alike(set(sets[a].tolist()), set(sets[b].tolist())) >= 0.8 for a, b in zip(i, j, strict=True)])
    may = nodes.may_be_alike(i, j)
    assert may[real].all() and may.sum() < 1.2 * real.sum()
    reached = may & (np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1) <= similar.RADIUS) & (shard[i] == shard[j])
    a, b = similar.spanning(nodes, starts, 0)
    want = reach(300, list(zip(i[reached].tolist(), j[reached].tolist(), strict=True)))
    assert reach(300, list(zip(a.tolist(), b.tolist(), strict=True))) == want and len(a) == 300 - len(set(want))
    part, bad = np.array(want), np.unique(np.minimum(a, b)[:5] * 300 + np.maximum(a, b)[:5])
    assert not len(similar.spanning(nodes, starts, 0, part)[0])
    a, b = similar.spanning(nodes, starts, 0, None, bad)
    assert not np.isin(np.minimum(a, b) * 300 + np.maximum(a, b), bad).any()


def test_choices_of_bits_miss_few_similar_sets():
    rng = np.random.default_rng(14)
    for n in (3000, 1 << 18):
        chosen, met = similar.choices(n), 0
        for _ in range(300):
            x = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
            y = np.concatenate([x[11:], rng.integers(0, 1 << 63, 11, dtype=np.uint64)])
            a, b = similar.fingerprints_of([x, y], 8)
            assert 0.8 <= len(np.intersect1d(x, y)) / len(np.union1d(x, y)) < 0.81
            bits = int(simhash.distances(a[None, :2], b[None, :2])[0])
            met += bits <= similar.RADIUS and any((int(a[f]) ^ int(b[f])) >> first & (1 << width) - 1 == 0 for f, first, width in chosen)
        assert met >= 290


def test_pipeline_near_dedup_of_a_dense_group(spark):
    import corpus_pipeline as cp

    rng = np.random.default_rng(15)
    base, texts = rng.choice([f"W{k}" for k in range(900)], 300), []
    for n in rng.integers(1, 7, 240):
        e = base.copy()
        e[rng.choice(300, n, replace=False)] = [f"n{k}" for k in rng.integers(0, 500, n)]
        texts.append(" ".join(e))
    texts += [" ".join([*base, *rng.choice(["p", "q", "r", "s"], n)]) for n in rng.integers(60, 100, 60)]
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if alike(sets[i], sets[j]) >= 0.8]
    want = reach(len(texts), links)
    assert 5 < len(set(want)) < 60 and max(np.bincount(want)) > 200
    got = sorted(r["doc_id"] for r in cp.dedup_near(spark, table(spark, texts), "").collect())
    assert got == sorted(set(want))


def test_ppm_parts_equal_the_whole_trie(spark, monkeypatch):
    rng = np.random.default_rng(16)
    texts = [rng.integers(33, 127, 70_000, dtype=np.uint8).tobytes().decode() for _ in range(33)] + [*TEXTS, "abracadabra é"]
    docs = table(spark, texts).repartition(3)
    training = docs.where(~ppm.held_out(F.col("doc_id")))
    trie = ppm.train(training)
    assert len(trie.strings[ppm.ORDER]) > 2_000_000
    want = trie.scores(pa.array(texts), trie.indexes())
    got = ppm.lm_scores(docs).toPandas().sort_values("doc_id")
    assert np.allclose(got.score.to_numpy(), want, rtol=1e-5, atol=1e-4)
    assert got.held_out.any() and not got.held_out.all()
    assert ppm.parts_of(docs.withColumn("out", F.lit(True)).select("doc_id", "text", "out"), ppm.ORDER).count() == 3


LONG_BODY = "It was a long day at the sea and all of us went back home in the evening, tired but glad that the rain had held off until we reached the house by the hill."


@pytest.mark.parametrize("part", ['<p title="a hidden gem">{}</p>', '<p data-id="ad-12">{}</p>', '<div id="social-security"><p>{}</p></div>', '<div class="big share price">{}</div>', "<fieldset><p>{}</p></fieldset>", '<p class="comment">{}</p>', '<div class="no-sidebar">{}</div>', '<p title="1 > 0">{}</p>'])
def test_paragraphs_of_the_article_stay(part):
    page = f"<html><body><nav><a href=/>Home</a></nav><article><h1>T</h1><p>First one here.</p>{part.format(LONG_BODY)}<p>Last.</p></article><footer>c</footer></body></html>"
    assert mainhtml.main_text(page) == f"T\nFirst one here.\n{LONG_BODY}\nLast."


@pytest.mark.parametrize("part", ['<div class="comments"><p>{}</p></div>', '<section id="user-comments">{}</section>', '<div class="cookie-notice">{}</div>', "<aside>{}</aside>", "<form><p>{}</p></form>", '<div class="ad">{}</div>', '<ul class="menu"><li>{}</ul>', '<div class="related"><ul><li>{}</ul></div>', '<div role="complementary">{}</div>', "<div hidden>{}</div>", '<div style="display: none">{}</div>'])
def test_furniture_goes_wherever_it_stands(part):
    extra = part.format(LONG_BODY)
    page = f"<html><body>{extra}<article><h1>T</h1><p>First one here is a text.</p>{extra}<p>Last words of the text.</p></article>{extra}</body></html>"
    assert mainhtml.main_text(page) == "T\nFirst one here is a text.\nLast words of the text."


def test_labelled_pages_keep_their_main_text():
    pages = list(mainhtml.labelled_pages())
    of = lambda page, words: set(words) & set(re.findall(r"\bm\d+\b", page))
    kept = wanted = other = 0
    for fold in range(5):  # most names of a fold are not met elsewhere
        learnt = mainhtml.learn([p for i, p in enumerate(pages) if i % 5 != fold])
        for page, words in pages[fold::5]:
            main, got = of(page, words), mainhtml.main_text(page, learnt).split()
            wanted, kept, other = wanted + len(main), kept + len(main & set(got)), other + sum(x not in main for x in got)
    assert kept >= 0.99 * wanted and other <= 0.08 * wanted
    assert all(set(mainhtml.main_text(page).split()) == of(page, words) for page, words in pages)


def test_main_text_of_the_small_pages(spark):
    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no tables")
    for r in mainhtml.extract(spark.read.parquet(f"{d}/pages.parquet")).join(spark.read.parquet(f"{d}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", r["html"], re.S)
        blocks = [html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split() for x in re.split("</?(?:p|h1|ul|li|div)>", inner[1])]
        assert r["text"] == "\n".join(" ".join(b) for b in blocks if b) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("page", ['<a "' * 250_000, ("<b>" + "<img>" + "</q>") * 80_000, "a<b>" * 250_000, "<div>x " * 120_000, "<b>" * 100_000 + "<p></p>" * 80_000, '<a =">"' * 140_000, "<" * 1_000_000, "<a \"'>" * 160_000, "<script>" * 120_000, "<ul>" * 100_000 + "<li>x" * 100_000, "</p>" * 250_000, "<![CDATA[" * 100_000, '<a b="' * 150_000 + ">"], ids=range(13))
def test_long_pages_take_time_in_proportion(page):
    mainhtml.weights()
    start = time.process_time()
    mainhtml.main_text(page)
    assert time.process_time() - start < 4


def test_secrets_of_a_long_text_and_of_many_repositories(spark):
    rng = np.random.default_rng(18)
    many = " ".join(f"{x:024x}" for x in rng.integers(0, 1 << 62, 32_000).tolist()) + " token=abcdefgh AKIA" + "B7" * 9
    template = "Zq12" + "wErtYuiOp34AsdfGh"
    texts = [many, *[f"deploy {template} now"] * 8, "deploy Kj98uYtrEw76QasDfGh5 now", "secret: Kj98uYtrEw76QasDfGh6 Kj98uYtrEw76QasDfGh7"]
    docs = spark.createDataFrame([(i, t, "one owner") for i, t in enumerate(texts)], "doc_id long, text string, source string").persist()
    docs.count()
    start = time.time()
    got = secrets.scan(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert time.time() - start < 30
    want = plain_secrets(many)
    assert got.n_hex[0] == 32_000 and got.base_sha256[0] == hashlib.sha256(want.encode()).hexdigest()
    # a value in many repositories of one owner is a copied template
    assert (got.spans[1:9] == "").all() and (got.n_example[1:9] == 1).all() and got.n_live[9] == 1
    # a generic token inside an assigned value is no span of its own
    assert got.spans[10] == "assign:0:28,generic:29:49"


# repeated rows, ties, very long texts and hard tables


def test_repeated_rows_of_one_id(spark):
    texts = ["one two three four five six seven eight nine ten eleven", "other words here", None]
    rows = [(7, t) for t in texts for _ in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    packed = packing.pack_documents(docs, WORD_BPE).toPandas()
    assert sorted(packed.length) == sorted(len(ids_of(WORD_BPE, t, 0)) for _, t in rows) and packed.groupby("sequence_id").length.sum().max() <= 2048
    files = huffman.read_documents(spark, huffman.write_documents(docs, BYTE_BPE, 2)).toPandas().sort_values("start")
    assert files.start.tolist() == [0, *files.n_tokens.cumsum()[:-1]] and sorted(files.n_tokens) == sorted(len(ids_of(BYTE_BPE, t, 2)) for _, t in rows)
    items = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven"), (1, "two three four five six seven eight nine ten eleven")], "item_id long, text string")
    hit = decontaminate.contamination(docs, items).toPandas()
    assert sorted(hit.n_hit) == [0] * 6 + [10] * 3 and len(hit) == 9
    assert decontaminate.keep_clean(docs, items).count() == 6
    known = spark.createDataFrame([(7, 1), (7, 0), (8, 0)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs.unionAll(spark.createDataFrame([(8, "x")], docs.schema)), known).count() == 10
    near = simhash.near_duplicates(docs).toPandas()
    assert len(near) == 9 and set(near.component_id) == {7} and near.groupby("fingerprint").size().tolist() == [3, 3, 3]
    assert ppm.lm_scores(docs, 2).count() == 9


def test_very_long_texts(spark):
    rng = np.random.default_rng(19)
    long = " ".join(rng.choice([f"w{k}" for k in range(5000)], 300_000))
    docs = spark.createDataFrame([(0, long), (1, long + " end"), (2, "short")], "doc_id long, text string")
    got = packing.pack_documents(docs, WORD_BPE).toPandas()
    assert got[got.doc_id == 0].length.sum() == len(ids_of(WORD_BPE, long, 0))
    assert toxicity.toxicity(docs, spark.createDataFrame([(0, 1), (2, 0)], "doc_id long, toxic int")).count() == 3
    import corpus_pipeline as cp

    assert sorted(r["doc_id"] for r in cp.dedup_near(spark, docs, "").collect()) == [0, 2]
    assert simhash.near_duplicates(docs).select("component_id").distinct().count() == 2


def test_pipeline_on_a_hard_table(spark, tmp_path):
    import corpus_pipeline as cp

    rng = np.random.default_rng(20)
    word = lambda n: " ".join(rng.choice([f"v{k}" for k in range(3000)], n))
    passage, item = word(60), word(14)
    plain = [word(40) for _ in range(400)]
    texts = [t + (" moronix" if i % 5 == 0 else "") for i, t in enumerate(plain)]  # toxic ones
    base = word(45)  # two runs and a part: what differs at the end leaves no window that repeats
    near = [base, base.rsplit(" ", 1)[0] + " changed", base + " more"]
    extra = [None, "", *near, f"a head\n{passage}\na tail", f"b head\n{passage}\nb tail", f"{word(20)} {item} {word(5)}", passage]
    rows = [(i, t, "en", "src", None if t is None else len(t), 1, 2) for i, t in enumerate([*texts, *extra])]
    rows += rows[400:402] + [(None, "no id but words", None, None, 3, 1, 2)]
    names = "doc_id long, text string, lang string, source string, n_chars int, line_dedup int, toxicity int"
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = cp.run(spark, str(tmp_path)).toPandas()
    left = {None if pd.isna(x) else int(x) for x in out.doc_id}
    # toxic rows, copies of near, the passage's later places (one text whole) and the item's document go; texts without words are one group
    want = {i for i in range(400) if i % 5} | {400, 402, 405, 406, None}
    assert left == want
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in names.split(", ")]
    assert docs.where("doc_id = 406").first()["text"] == "b head\nb tail" and docs.where("doc_id = 406").first()["n_chars"] == 13
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).limit(0).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    assert cp.run(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("pivots", [1, 20])
def test_large_shards_are_dealt_in_tiles(spark, monkeypatch, pivots):
    rng = np.random.default_rng(21)
    centre = rng.integers(0, 1 << 62, 30, dtype=np.uint64)
    fp = centre[np.minimum(rng.integers(0, 90, 900), 29)]  # one centre has two thirds
    for _ in range(5):
        fp = np.where(rng.random(900) < 0.5, fp ^ (np.uint64(1) << rng.integers(0, 62, 900).astype(np.uint64)), fp)
    fp = np.unique(fp)
    monkeypatch.setattr(simhash, "MOST_TOGETHER", 100)
    monkeypatch.setattr(simhash, "PIVOTS", pivots)
    for shard in (2000, 60):
        monkeypatch.setattr(simhash, "SHARD", shard)
        found = simhash.links(spark.createDataFrame([(int(x),) for x in fp], "fp long"), len(fp)).toPandas()
        at = {int(x): i for i, x in enumerate(fp)}
        near = np.bitwise_count(fp[:, None] ^ fp[None]) <= 4
        want = reach(len(fp), [(int(i), int(j)) for i, j in zip(*np.nonzero(np.tril(near, -1)), strict=True)])
        assert reach(len(fp), [(at[a], at[b]) for a, b in zip(found.a, found.b, strict=True)]) == want
