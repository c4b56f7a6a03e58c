"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

Words (what stands between white space) are counted over the whole corpus.  The
most frequent ones, near LEXICON of them, are encoded once and compiled, in sorted order,
into the minimal subsequential transducer: states with the same future are one, so
suffixes are shared, and ids stand on the arcs as early as the word tells them.  The
automaton is a flat file in the shared folder, which Spark hands to every executor
and its workers map into memory.

A task goes through its texts in slices: each distinct word of a slice walks the
automaton, all words at once, one byte at a time.  Words it does not hold are
normalized, parted and merged here, by the file's merges in their order, many words
at once; what is rare costs time, not exactness.  Decoding joins the ids' tokens, as
the library does for files without a decoder.

Files may differ in vocabulary and merges; the rest must be as in word_bpe_49k.json:
BPE with a suffix at a word's end, NFC, white space and lower case normalized,
words parted by a pattern, bytes as letters, special tokens taken from the text as
it stands.  Other files are refused.

Defined results: a null text is empty and has no ids; repeated rows give repeated
results; a null doc_id stays null; words over LONGEST_WORD bytes are never in the
lexicon, but merged; other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import uuid
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.llm.common import shared_dir, slices, stored

#: Words in the automaton, and their greatest length in bytes.
LEXICON, LONGEST_WORD = 1 << 17, 64
#: Bytes of text that are looked at together.
AT_ONCE = 4_000_000
_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_ODD_SPACE = _SPACE.replace(r"\t-\r ", r"\t\x0b-\r").removesuffix("+")
#: Printable characters before U+0250 that are one lower-case letter each.
_LATIN = re.compile(r"[!-~\u00a1-\u012f\u0131-\u024f]+")
_NONE = np.iinfo(np.int32).max
_RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def split_words(texts: pa.Array, special: Iterable[str] = ()) -> tuple[pa.Array, np.ndarray]:
    """What stands between white space, special tokens by themselves, as one array, and where each text's begin, with the end of the last; some are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    for token in special:
        texts = pc.replace_substring(texts, token, f" {token} ")
    if pc.any(pc.match_substring_regex(texts, _ODD_SPACE)).as_py():
        texts = pc.replace_substring_regex(texts, _SPACE, " ")
    lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    offsets = lists.offsets.to_numpy()
    return lists.flatten(), offsets - offsets[0]


class Merger:
    """Exact BPE of words by a tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, norm = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        kinds = [x["type"] for x in norm.get("normalizers", [])], [x["type"] for x in pre.get("pretokenizers", [])]
        wanted = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        tokens = spec.get("added_tokens", [])
        raw = all(not any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in tokens)
        if model["type"] != "BPE" or kinds != wanted or not (plain and raw and model.get("end_of_word_suffix")) or spec.get("decoder") or spec.get("post_processor"):
            raise ValueError(f"{path} is no tokenizer of the kind that this operator reads")
        self.tok = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in tokens}
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        named = {**{i: t for t, i in vocab.items()}, **{i: t for t, i in self.special.items()}}
        self.tokens = pa.array([named.get(i, "") for i in range(max(named) + 1)], pa.large_string())
        self.decimals = pa.array(list(map(str, range(len(self.tokens)))), pa.large_string())
        # bytes stand as letters: printable ones of Latin-1 as themselves, the others as those from 256 on
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = [b for b in range(256) if b not in printable]
        letters = [chr(b if b in printable else 256 + others.index(b)) for b in range(256)]
        self.letter_bytes = {c: b for b, c in enumerate(letters)}
        self.inner, self.last = (np.array([vocab[c + end] for c in letters], np.int32) for end in ("", suffix))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * len(self.tokens) + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.pattern = regex.compile(pre["pretokenizers"][0]["pattern"]["Regex"])

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place in the order of merges of each pair, _NONE where there is no such merge."""
        key = a.astype(np.int64) * len(self.tokens) + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def _merged(self, sym: np.ndarray) -> np.ndarray:
        """Rows of symbols (-1: none) after all merges: in each round each row's first pair of least rank."""
        wide = sym.shape[1] - 1  # the last column is empty
        rank = np.where(sym[:, 1:] >= 0, self._rank(sym[:, :-1], sym[:, 1:]), _NONE)
        rows, place = np.arange(len(sym)), np.arange(wide)
        while True:
            j = rank[rows].argmin(axis=1)
            least = rank[rows, j]
            some = least < _NONE
            rows, j, least = rows[some], j[some], least[some]
            if not len(rows):
                return sym
            i, after = np.arange(len(rows)), place[None, :] > j[:, None]
            moved, r = sym[rows], rank[rows]
            moved[:, :-1] = np.where(after, moved[:, 1:], moved[:, :-1])  # what stands after the pair moves up
            moved[i, j] = self.made[least]
            moved[:, -1] = -1
            r[:, :-1] = np.where(after[:, :-1], r[:, 1:], r[:, :-1])
            r[:, -1] = _NONE
            right = moved[i, j + 1]
            r[i, j] = np.where(right >= 0, self._rank(moved[i, j], np.maximum(right, 0)), _NONE)
            left = np.flatnonzero(j > 0)
            r[left, j[left] - 1] = self._rank(moved[left, j[left] - 1], moved[left, j[left]])
            sym[rows], rank[rows] = moved, r

    def _long(self, symbols: list[int]) -> list[int]:
        """As _merged, of one long word: a queue of pairs over linked symbols."""
        n = len(symbols)
        sym, left, right = symbols[:], list(range(-1, n - 1)), [*range(1, n), -1]
        ranks = self._rank(np.array(sym[:-1]), np.array(sym[1:])).tolist()
        queue = [(r, i, sym[i], sym[i + 1]) for i, r in enumerate(ranks) if r < _NONE]
        heapq.heapify(queue)
        while queue:
            r, i, a, b = heapq.heappop(queue)
            j = right[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j], right[i] = int(self.made[r]), -1, right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for x in (left[i], i):
                if x >= 0 and right[x] >= 0:
                    key = sym[x] * len(self.tokens) + sym[right[x]]
                    k = int(np.searchsorted(self.keys, key))
                    if k < len(self.keys) and self.keys[k] == key:
                        heapq.heappush(queue, (int(self.ranks[k]), x, sym[x], sym[right[x]]))
        return [s for s in sym if s >= 0]

    def merge(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts of words one after the other, and how many each has."""
        _, offsets, data = pieces.buffers()
        n = len(pieces)
        ends = np.frombuffer(offsets, np.int64)[pieces.offset : pieces.offset + n + 1]
        text = np.frombuffer(data, np.uint8) if n else np.zeros(0, np.uint8)
        size = np.diff(ends)
        order = np.argsort(size, kind="stable")
        many, parts = np.zeros(n, np.int64), [np.zeros(0, np.int32)]
        short = int(np.searchsorted(size[order], LONGEST_WORD, "right"))
        for a in range(0, short, 4096):  # words of similar length at once
            own = order[a : min(a + 4096, short)]
            at = np.arange(int(size[own[-1]]) + 1)
            inside = at[None, :] < size[own][:, None]
            place = np.where(inside, ends[own][:, None] + at[None, :], 0)
            sym = np.where(inside, self.inner[text[place]], np.int32(-1))
            sym[np.arange(len(own)), size[own] - 1] = self.last[text[ends[own] + size[own] - 1]]
            sym = self._merged(sym)
            real = sym >= 0
            many[own] = real.sum(axis=1)
            parts.append(sym[real])
        for k in order[short:].tolist():
            own = text[ends[k] : ends[k + 1]]
            ids = self._long([*self.inner[own[:-1]].tolist(), int(self.last[own[-1]])])
            many[k] = len(ids)
            parts.append(np.array(ids, np.int32))
        # parts stand by length: back to the order of the words
        starts = np.empty(n, np.int64)
        starts[order] = many[order].cumsum() - many[order]
        return np.concatenate(parts)[spread(starts, many)].astype(np.uint32), many

    def parted(self, word: str) -> list[str]:
        """The word's normalized parts."""
        if _LATIN.fullmatch(word):  # composed already, and its letters are the same in all versions of Unicode
            return self.pattern.findall(word.lower())
        pieces = self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(word))
        return [bytes(map(self.letter_bytes.__getitem__, p)).decode() for p, _ in pieces]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words (no special tokens) one after the other, and how many each has."""
        parted = list(map(self.parted, words))
        n = np.fromiter(map(len, parted), np.int64, len(parted))
        flat = pa.array([p for ps in parted for p in ps], pa.large_string()).dictionary_encode()
        ids, many = self.merge(flat.dictionary)
        place = flat.indices.to_numpy()
        starts, size = (many.cumsum() - many)[place], many[place]
        ends = np.concatenate([[0], size.cumsum()])[np.concatenate([[0], n.cumsum()])]
        return ids[spread(starts, size)], np.diff(ends)


def compiled(entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> np.ndarray:
    """The minimal subsequential transducer of sorted, distinct words and their ids, as one array of numbers.

    Only the states of the last word's path are open; a state is closed when a word
    leaves it, and one with the same arcs, targets and ids is taken where there is one.
    """
    register: dict[tuple, int] = {}
    arcs: list[tuple[int, int, int]] = []  # state and byte, target, ids
    finals: list[int] = []
    pool: dict[tuple[int, ...], int] = {(): 0}
    number = lambda ids: pool.setdefault(ids, len(pool))

    def close(state: list) -> int:
        # state: arcs as byte -> [target, ids], ids where a word ends or None
        key = (state[1], tuple((b, t, ids) for b, (t, ids) in state[0].items()))
        at = register.get(key)
        if at is None:
            at = register[key] = len(finals)
            finals.append(0 if state[1] is None else 1 + number(state[1]))
            arcs.extend((at * 256 + b, t, number(ids)) for b, (t, ids) in state[0].items())
        return at

    path: list[list] = [[{}, None]]
    last = b""
    for word, ids in entries:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        for k in range(len(last), shared, -1):
            path[k - 1][0][last[k - 1]][0] = close(path.pop())
        for k in range(shared):
            arc = path[k][0][word[k]]
            had, n = arc[1], 0
            while n < min(len(had), len(ids)) and had[n] == ids[n]:
                n += 1
            if n < len(had):  # ids that this word does not share move on
                rest, arc[1] = had[n:], had[:n]
                after = path[k + 1]
                for other in after[0].values():
                    other[1] = rest + other[1]
                if after[1] is not None:
                    after[1] = rest + after[1]
            ids = ids[n:]
        for k in range(shared, len(word)):
            path[k][0][word[k]] = [-1, ids if k == shared else ()]
            path.append([{}, None])
        path[-1][1] = () if word else ids
        last = word
    for k in range(len(last), 0, -1):
        path[k - 1][0][last[k - 1]][0] = close(path.pop())
    root = close(path[0])
    table = np.array(sorted(arcs), np.int64).reshape(-1, 3)
    outs = list(pool)
    at = np.concatenate([[0], np.cumsum([len(x) for x in outs])])
    head = [root, len(finals), len(table), len(outs), int(at[-1])]
    return np.concatenate([head, *table.T, finals, at, [i for x in outs for i in x]]).astype("<u4")


def lexicon(words: Iterable[str], own: Merger) -> np.ndarray:
    """The transducer of words; special tokens always are among them."""
    some = sorted({w for w in words if w and w not in own.special})
    ids, many = own.encode(some)
    ends = many.cumsum().tolist()
    entries = [(w.encode(), tuple(ids[e - n : e].tolist())) for w, n, e in zip(some, many.tolist(), ends, strict=True)]
    return compiled(sorted([*entries, *((t.encode(), (i,)) for t, i in own.special.items())]))


class Automaton:
    """A compiled transducer, walked by many words at once."""

    def __init__(self, numbers: np.ndarray):
        self.root, states, arcs, outs, ids = map(int, numbers[:5])
        cuts = np.cumsum([5, arcs, arcs, arcs, states, outs + 1, ids])
        self.keys, self.targets, self.outputs, self.finals, self.at, self.ids = (numbers[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))

    @classmethod
    def of_file(cls, path: str) -> Automaton:
        """Mapped, not read: workers of a machine share its pages."""
        return cls(np.memmap(path, "<u4", "r", shape=(os.path.getsize(path) // 4,)))

    def walk(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each word is held; the ids of those that are, one after the other; how many each word has."""
        n = len(words)
        words = words.cast(pa.large_binary())
        _, offsets, data = words.buffers()
        ends = np.frombuffer(offsets, np.int64)[words.offset : words.offset + n + 1]
        text = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        size = np.diff(ends)
        state, held = np.full(n, self.root, np.uint32), size <= LONGEST_WORD
        steps, going, k = [], np.flatnonzero(held), 0
        while True:
            done = size[going] == k
            own = going[done]
            final = self.finals[state[own]]
            held[own[final == 0]] = False
            real = own[final > 0]
            steps.append((real, self.at.dtype.type(0) + final[final > 0] - 1))
            going = going[~done]
            if not len(going) or not len(self.keys):
                held[going] = False
                break
            key = state[going] * np.uint32(256) + text[ends[going] + k]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[arc] == key
            held[going[~found]] = False
            going, arc = going[found], arc[found]
            state[going] = self.targets[arc]
            steps.append((going, self.outputs[arc]))
            k += 1
        row = np.concatenate([r for r, _ in steps])
        out = np.concatenate([o for _, o in steps]).astype(np.int64)
        real = held[row] & (out > 0)
        row, out = row[real], out[real]
        order = np.argsort(row, kind="stable")  # a word's outputs stay in the order of its bytes
        row, out = row[order], out[order]
        many = (self.at[out + 1] - self.at[out]).astype(np.int64)
        return held, np.asarray(self.ids[spread(self.at[out].astype(np.int64), many)]), np.bincount(row, many, n).astype(np.int64)


def spread(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All positions start, start + 1, ... of n places each, one range after the other."""
    out = np.repeat(starts - (n.cumsum() - n), n)
    out += np.arange(len(out))
    return out


class Coder:
    """Encodes and decodes columns of texts: by the automaton, and what it does not hold by merges."""

    def __init__(self, merger: Merger, automaton: Automaton):
        self.merger, self.automaton = merger, automaton

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words one after the other, and how many each has."""
        held, ids, many = self.automaton.walk(words)
        unseen = np.flatnonzero(~held)
        if not len(unseen):
            return ids, many
        more, own = self.merger.encode(words.take(pa.array(unseen)).to_pylist())
        starts = np.empty(len(many), np.int64)
        starts[held] = many[held].cumsum() - many[held]
        starts[unseen] = len(ids) + own.cumsum() - own
        many[unseen] = own
        return np.concatenate([ids, more])[spread(starts, many)], many

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin, with the end of the last."""
        words, at = split_words(texts, self.merger.special)
        coded = words.dictionary_encode()
        ids, many = self._ids(coded.dictionary)
        place = coded.indices.to_numpy()
        starts, n = (many.cumsum() - many)[place], many[place]
        return ids[spread(starts, n)], np.concatenate([[0], n.cumsum()])[at]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The texts that the ids between each two places of at stand for."""
        return _joined(self.merger.tokens, ids, at)

    def written(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The decimal ids, parted by blanks."""
        return _joined(self.merger.decimals, ids, at)


def _joined(names: pa.Array, ids: np.ndarray, at: np.ndarray) -> pa.Array:
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), names.take(pa.array(ids))), pa.scalar(" ", pa.large_string()))


@cache
def merger(path: str) -> Merger:
    """One for each Python worker and file."""
    return Merger(path)


@cache
def _coder(tokenizer: str, file: str) -> Coder:
    return Coder(merger(tokenizer), Automaton.of_file(SparkFiles.get(file)))


def word_counts(docs: DataFrame, special: Iterable[str] = ()) -> DataFrame:
    """word, n over all texts, of the words of up to LONGEST_WORD bytes; each task adds up its own first."""
    special = list(special)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column("text"), AT_ONCE):
                words, _ = split_words(texts, special)
                coded = words.dictionary_encode()
                size = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False)
                n = np.bincount(coded.indices.to_numpy(), minlength=len(size))
                some = np.flatnonzero((size > 0) & (size <= LONGEST_WORD))
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(some)).cast(pa.string()), pa.array(n[some], pa.int64())], ["word", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, size: int) -> DataFrame:
    """Near `size` words: those with the greatest counts, and of the class of counts that is too large a part by hash.

    Counts up to 1,024 are classes of their own, greater ones go by 64ths of a power
    of two, so what tells the classes' sizes is small and no task or driver sorts words.
    """
    classed = counts.withColumn("class", F.when(F.col("n") <= 1024, F.col("n")).otherwise(1024 + F.floor(F.log2(F.col("n") / 1024) * 64)))
    left, least, share = size, 0, 0.0
    for r in sorted(classed.groupBy("class").agg(F.count("*").alias("k")).collect(), reverse=True):  # a few thousand classes
        if r["k"] > left:
            least, share = r["class"], left / r["k"]
            break
        left -= r["k"]
    part = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20))
    return classed.where((F.col("class") > least) | ((F.col("class") == least) & part)).select("word")


def compile_lexicon(docs: DataFrame, tokenizer: str, size: int = LEXICON) -> str:
    """Compile the most frequent words of docs and hand the automaton to all executors; its file's name there."""
    spark, own = docs.sparkSession, merger(tokenizer)
    counts = stored(word_counts(docs, own.special), "words")
    numbers = lexicon((r["word"] for r in frequent(counts, size).collect()), own)  # near so many short words
    folder = f"{shared_dir(spark)}/lexicon-{uuid.uuid4().hex}"
    # a text file's line is written byte for byte: one line is the file, with a line feed after it
    spark.createDataFrame([(numbers.tobytes(),)], "numbers binary").select(F.col("numbers").cast("string")).coalesce(1).write.text(folder)
    file = spark.read.format("binaryFile").load(folder).select("path").first()["path"]
    spark.sparkContext.addFile(file)
    return os.path.basename(file)


def bpe_round_trip(docs: DataFrame, tokenizer: str, size: int = LEXICON) -> DataFrame:
    """A row for each row of docs (doc_id, text): ids counted and hashed, and what they decode to hashed."""
    file = compile_lexicon(docs, tokenizer, size)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(tokenizer, file)
        digests = lambda column: pa.array([hashlib.sha256(memoryview(x.as_buffer())).hexdigest() for x in column])
        for batch in batches:
            first = 0
            for texts in slices(batch.column("text"), AT_ONCE):
                ids, at = coder.encode(texts)
                doc_id = batch.column("doc_id").slice(first, len(texts))
                first += len(texts)
                yield pa.RecordBatch.from_arrays([doc_id, pa.array(np.diff(at)), digests(coder.written(ids, at)), digests(coder.decode(ids, at))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(code, _RESULT)
