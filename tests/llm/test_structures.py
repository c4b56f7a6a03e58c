"""Prefix trie, transducer lexicon and periodic runs against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from karst.llm import lexicon, periodic, prefixtrie
from karst.llm.queries import BYTE_BPE, WORD_BPE

LIBRARY = Tokenizer.from_file(WORD_BPE)
MERGER = lexicon.Merger(WORD_BPE)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# prefix trie


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - int(np.fmod(c, 5)), [])[: h[c]] + own[c][h[c] :] for c in own}


def brute_trie(rows):
    convs, members = rebuilt(rows), defaultdict(list)
    for c, ts in sorted(convs.items()):
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        sums[p] = (sum(sums[k][0] for k in kids[p]) or 1, own + sum(sums[k][1] for k in kids[p]))
    ended = lambda p: sha(",".join(str(c) for c in members[p] if len(convs[c]) == len(p)))
    return sorted((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(kids[p]), *sums[p], ended(p)) for p in members)


ROW = "conv_id long, turn long, role string, text string, part int, path string, depth int"


def trie_rows(spark, rows, **sizes):
    table = spark.createDataFrame([(*r, 7, "clash", 3) for r in rows], ROW)
    got = prefixtrie.trie(prefixtrie.rebuilt(prefixtrie.turns(table)), **sizes) if sizes else prefixtrie.conversation_trie(table)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, got.collect()), key=lambda r: r[:2])


def some_conversations(seed, n):
    rng, rows = random.Random(seed), []
    for c in range(n):
        hot = rng.random() < 0.4  # a hot first turn and a group of copies
        for t in range(rng.choice([1, 2, 3, 9, 12])):
            text = "hello" if hot and t < 3 else rng.choice(["a", "b", "é", "", None])
            rows.append((c * 3 - 20, rng.choice([t, t, t, None]), rng.choice(["user", "user", None]), text))
    return [*rows, (None, 0, "user", "nobody's"), (1000, 1, "u", "x"), (1000, 1, "u", "x"), (1000, 1, "a", "x")]


@pytest.mark.parametrize(("seed", "sizes"), [(1, {}), (2, {"range_bytes": 400, "range_rows": 7}), (3, {"range_bytes": 100, "range_rows": 2})])
def test_trie_equals_brute_force(spark, seed, sizes):
    rows = some_conversations(seed, 60)
    assert trie_rows(spark, rows, **sizes) == sorted(brute_trie(rows), key=lambda r: r[:2])


def test_trie_of_prefixes_copies_and_one_long_conversation(spark):
    chain = [(5 * c, t, "u", f"t{t}") for c in range(25) for t in range(c)]  # each a prefix of the next
    copies = [(5 * c, t, "u", f"c{t}") for c in range(30, 60) for t in range(4)]
    long = [(5000, t, "u", str(t % 7)) for t in range(3000)]
    rows = [*chain, *copies, *long]
    assert trie_rows(spark, rows, range_bytes=300, range_rows=4) == sorted(brute_trie(rows), key=lambda r: r[:2])


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert trie_rows(spark, []) == [] and trie_rows(spark, [(None, 1, "u", "x")]) == []
    # conversation 1 keeps nothing of its own beyond its first turns, and 0 is absent
    rows = [(1, 0, None, None)]
    assert trie_rows(spark, rows) == sorted(brute_trie(rows), key=lambda r: r[:2])


def test_trie_sql_equals_brute_force(spark):
    rows = some_conversations(4, 40)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.execute(prefixtrie.ORACLE_SQL).fetchall(), key=lambda r: r[:2]) == sorted(brute_trie(rows), key=lambda r: r[:2])


@given(st.binary(max_size=200), st.binary(max_size=200), st.integers(0, 12))
def test_common_turns(a, b, n):
    a, b = a[: len(a) // 16 * 16], b[: len(b) // 16 * 16]
    a, b = b"s" * 16 * n + a, b"s" * 16 * n + b
    want = next((k for k in range(min(len(a), len(b)) // 16) if a[16 * k : 16 * k + 16] != b[16 * k : 16 * k + 16]), min(len(a), len(b)) // 16)
    assert prefixtrie.common_turns(a, b) == want


# transducer lexicon


def coder(words):
    return lexicon.Coder(MERGER, lexicon.Automaton(lexicon.lexicon([w for w in words if len(w.encode()) <= lexicon.LONGEST_WORD], MERGER)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abzAÉñßΣİ日 \n\t.,'12½ \xa0\x1c\x01éstSTvV가가", max_size=30), min_size=1, max_size=6), st.randoms(use_true_random=False))
def test_ids_and_texts_equal_the_library(texts, rng):
    texts = [t + rng.choice(["", "", "<|endoftext|>", "<|EndOfText|>x", "<|startoftext|><|endoftext|> y"]) for t in texts]
    own = coder([w for t in texts for w in t.split() if rng.random() < 0.5] + ["the", "then", "them", "bathe", "the" * 40])
    ids, at = own.encode(pa.array([*texts, None]))
    decoded, written = own.decode(ids, at).to_pylist(), own.written(ids, at).to_pylist()
    for k, t in enumerate([*texts, ""]):
        want = LIBRARY.encode(t, add_special_tokens=False).ids
        assert ids[at[k] : at[k + 1]].tolist() == want
        assert decoded[k] == LIBRARY.decode(want, skip_special_tokens=False) and written[k] == " ".join(map(str, want))


def test_words_of_any_length_merge_exactly():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghinorst") for _ in range(n)) for n in [1, 2, 5, 20, 63, 64, 65, 66, 200, 5000] * 20]
    ids, many = MERGER.encode(words)
    at = np.concatenate([[0], many.cumsum()])
    for k, w in enumerate(words):
        assert ids[at[k] : at[k + 1]].tolist() == LIBRARY.encode(w, add_special_tokens=False).ids


def right_languages(words):
    """States of the minimal transducer, counted by what may follow each prefix and the ids left to give there."""
    common = lambda xs: next(iter(xs))[: next(k for k in range(10**6) if len({x[k : k + 1] for x in xs}) > 1 or any(len(x) == k for x in xs))]
    futures = set()
    for p in {w[:k] for w in words for k in range(len(w) + 1)}:
        under = {w[len(p) :]: ids for w, ids in words.items() if w.startswith(p)}
        given_ = common(list(under.values())) if p else ()
        futures.add(tuple(sorted((w, ids[len(given_) :]) for w, ids in under.items())))
    return len(futures)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6).map(lambda b: bytes(97 + x % 3 for x in b)), st.lists(st.integers(0, 3), min_size=1, max_size=4).map(tuple), min_size=1, max_size=25))
def test_transducer_is_minimal_and_exact(words):
    numbers = lexicon.compiled(sorted(words.items()))
    auto = lexicon.Automaton(numbers)
    assert len(auto.finals) == right_languages(words)
    asked = [*words, b"", b"abcabcabc", b"zz", *(w + b"a" for w in words), *(w[:-1] for w in words)]
    held, ids, many = auto.walk(pa.array(asked, pa.large_binary()))
    at = np.concatenate([[0], many.cumsum()])
    assert held.tolist() == [w in words for w in asked]
    assert [tuple(ids[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)] == [words.get(w, ()) for w in asked]


def test_suffixes_are_shared():
    words = {w + e: (1, k) for w in (b"walk", b"talk", b"stalk") for k, e in enumerate((b"", b"ed", b"ing", b"s"))}
    assert len(lexicon.Automaton(lexicon.compiled(sorted(words.items()))).finals) < 16


TEXTS = [None, "", " ", "The cat sat.", "The cat sat.", "don't WE'LL <|endoftext|>x", "x" * 30_000, "word " * 20_000, "日本語 テスト É", "\x01 \x1c", "a\n\n\tb"]


def documents(spark, texts=TEXTS):
    rows = [(None if k == 4 else k, t, "ids", "word") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, word string")


@pytest.mark.parametrize("size", [0, 2, lexicon.LEXICON])
def test_round_trip_of_documents(spark, size):
    got = lexicon.bpe_round_trip(documents(spark).repartition(3), WORD_BPE, size).collect()
    want = []
    for k, t in enumerate(TEXTS):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want.append((None if k == 4 else k, len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_nothing_to_encode_and_other_files(spark):
    assert lexicon.bpe_round_trip(documents(spark).limit(0), WORD_BPE).count() == 0
    with pytest.raises(ValueError, match="no tokenizer"):
        lexicon.Merger(BYTE_BPE)


def test_counts_are_of_all_words(spark):
    got = {r["word"]: r["n"] for r in lexicon.word_counts(documents(spark), MERGER.special).collect()}
    assert got["word"] == 20_000 and got["The"] == 2 and got["<|endoftext|>"] == 1 and "x" * 30_000 not in got


def test_the_most_frequent_words_are_taken(spark):
    counts = spark.createDataFrame([(f"w{k}", n) for k, n in enumerate([1] * 3000 + [2] * 50 + [5000] * 30 + [10**9])], "word string, n long")
    n = lambda size: {(r["n"]) for r in lexicon.frequent(counts, size).join(counts, "word").collect()}
    assert lexicon.frequent(counts, 10_000).count() == 3081 and lexicon.frequent(counts, 0).count() == 0
    assert n(1) == {10**9} and n(31) == {10**9, 5000} and n(81) == {10**9, 5000, 2}
    assert abs(lexicon.frequent(counts, 1081).count() - 1081) < 120
    assert lexicon.frequent(counts.limit(0), 5).count() == 0


# periodic runs


def brute_runs(doc, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, runs = len(w), {}
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if n and h % 10 == 0:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            first = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i + p - first >= max(6, 4 * p):
                runs.setdefault((first, i + p), p)
            i += i == first or i + p < n
    listed = sorted(((a, b - a, p) for (a, b), p in runs.items()), key=lambda r: (r[0], r[2]))
    gone = {i for s, m, p in listed for i in range(s + p, s + m)}
    best = min(listed, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    said = "".join(f"{s},{m},{p}\n" for s, m, p in listed)
    return (doc, len(listed), *best, 1000 * best[1] // best[2] if listed else None, sha(said), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def periodic_texts(seed, n):
    rng, out = random.Random(seed), []
    for _ in range(n):
        letters = rng.choice(["a", "ab", "abc", "abcdefgh"])
        words = [rng.choice(letters) for _ in range(rng.randint(0, 70))]
        if rng.random() < 0.5:
            at = rng.randint(0, len(words))
            words[at:at] = [rng.choice(letters) for _ in range(rng.randint(1, 8))] * rng.randint(3, 7)
        out.append((rng.randint(0, 400), rng.choice([" ", "\n", " \t\x0b"]).join(words) + rng.choice(["", " "])))
    return out


@pytest.mark.parametrize("limits", [{}, {"PAIRS": 3, "INDEXED": 5}])
def test_runs_equal_brute_force(monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(periodic, k, v)
    for seed in range(60):
        docs = periodic_texts(seed, 1 + seed % 12)
        got = periodic.runs_of(pa.array([d for d, _ in docs]), pa.array([t for _, t in docs]))
        assert [tuple(r.values()) for r in got.to_pylist()] == [brute_runs(*d) for d in docs]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_common_prefixes(codes):
    x, n = np.array(codes, np.int64), len(codes)
    i, j = (a.ravel() for a in np.meshgrid(np.arange(n + 1), np.arange(n + 1)))
    i, j = i[i != j], j[i != j]
    got = periodic.Suffixes(x).common(i, j)
    for a, b, k in zip(i.tolist(), j.tolist(), got.tolist(), strict=True):
        assert k == next((m for m in range(n) if a + m >= n or b + m >= n or codes[a + m] != codes[b + m]), 0)


def test_runs_of_documents(spark):
    planted = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 10 == 0)
    texts = [(None, "a b " * 9), (planted, " ".join(map(str, range(4000)))), (planted, None), (1, ""), (2, " \n"), (3, "no run here"), (3, "no run here"), (4, "\xa0 \x1c " * 3), (5, " ".join(str(k % 4999) for k in range(20_000)))]
    rows = spark.createDataFrame([(d, t, 1, "x") for d, t in texts], "doc_id long, text string, start int, period string")
    got = sorted(map(tuple, periodic.periodic_runs(rows.repartition(3)).collect()), key=repr)
    assert got == sorted((brute_runs(*t) for t in texts), key=repr)
    assert periodic.periodic_runs(rows.limit(0)).count() == 0
    assert rows.where(F.col("doc_id") == 5).count() == 1
