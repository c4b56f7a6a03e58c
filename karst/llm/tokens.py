"""Token ids of whole texts by a public tokenizer file, with a cache of words.

The ids are those of `Tokenizer.encode(text, add_special_tokens=False)` of the file
as loaded.  A BPE never joins symbols over the start of a run of white space, so
texts are parted there by Arrow's kernels, each distinct word of a slice goes
through the tokenizer once, and the ids are gathered with NumPy.  Words of at most
23 bytes are kept for later slices in a table of bytes, all at once looked up in it;
MOST_WORDS of them, of which the second half came more than once in a slice.  Of a
byte-level file, words of Latin letters, digits and ASCII signs are cut by Arrow into
the runs that the file's pattern finds, so only the file's merges are left to the
tokenizer.  Texts with other white space than single blanks and line feeds take a
slower way, chunk by chunk, and texts that hold an added token's text go through the
tokenizer whole.
"""

from __future__ import annotations

import ctypes
import gc
import json
import os
import re
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST_WORDS = 400_000
AT_ONCE = 8_000_000
#: New words encoded in one text, and texts handed to the tokenizer at once.
IN_A_TEXT, TEXTS = 256, 64
_WHITE = r"\t-\r \x85\xa0  -     　"
_CHUNK = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
#: Texts that the fast way cannot take: odd or doubled white space, white space at an end, and \x01, which parts words in _learn.
_ODD = r"[\x01\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|\A[ \n]|[ \n]\z|\A\z"
#: Letters, digits and signs that any version of Unicode classes alike; no apostrophe, as contractions are runs of their own.
_RUNS = r"A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{17f}", "0-9", r"!-&(-/:-@\[-`{-~"
_ONE = rf"\A[{_RUNS[0]}]+\z"
_SIMPLE = rf"\A\n?[{''.join(_RUNS)}]+\z"
_RUN = rf"({'|'.join(f' ?[{x}]+' for x in _RUNS)}|\n)"


class Words:
    """Words of at most 23 bytes by number, in the order they were added; for each a key of 24 bytes, the last its length."""

    def __init__(self, most: int):
        self.most, self.bits, self.n = most, (2 * most - 1).bit_length(), 0
        self.place = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.zeros((3, most), np.uint64)

    @staticmethod
    def keys_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The keys of words (large_string), and which words are short enough to have one."""
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        first, size = offsets[:-1] - offsets[0], np.diff(offsets)
        raw = (words.buffers()[2] or b"")[int(offsets[0]) : int(offsets[-1])]
        raw = bytes(raw) + bytes(24)
        eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        kept = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        keys = np.stack([eight[np.minimum(first + at, len(eight) - 1)] & kept[np.clip(size - at, 0, 8)] for at in (0, 8, 16)])
        keys[2] |= size.astype(np.uint64) << np.uint64(56)
        return keys, size < 24

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        h = keys[0] * np.uint64(0x9E3779B97F4A7C15) ^ keys[1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ keys[2] * np.uint64(0x165667B19E3779F9)
        return ((h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key's word, -1 if it is none."""
        out, at, left = np.full(keys.shape[1], -1, np.int64), self._slots(keys), np.arange(keys.shape[1])
        while len(left):
            there = self.place[at[left]]
            left, there = left[there >= 0], there[there >= 0]
            same = (self.keys[:, there] == keys[:, left]).all(axis=0)
            out[left[same]] = there[same]
            left = left[~same]
            at[left] = (at[left] + 1) % len(self.place)
        return out

    def add(self, keys: np.ndarray) -> None:
        """Different keys that are not there get the next numbers."""
        number = np.arange(self.n, self.n + keys.shape[1], dtype=np.int32)
        self.keys[:, number] = keys
        self.n += len(number)
        at, left = self._slots(keys), np.arange(len(number))
        while len(left):
            free = left[self.place[at[left]] < 0]
            self.place[at[free]] = number[free]
            left = left[self.place[at[left]] != number[left]]
            at[left] = (at[left] + 1) % len(self.place)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, norm = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        bpe = model.get("type") == "BPE" and not model.get("dropout") and not spec.get("post_processor")
        inner = [x.get("type") for x in pre.get("pretokenizers", [])]
        if bpe and norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.kind = "byte"
            blank = self.tok.pre_tokenizer.pre_tokenize_str(" ")[0][0]
            vocab = self.tok.get_vocab()
            self.opens = np.zeros(max(vocab.values()) + 1, bool)
            self.opens[[i for t, i in vocab.items() if t.startswith(blank)]] = True
            (self.feed,) = self._whole("\n")
            # the same merges without the pattern: runs are parted already, and each byte is the character that stands for it
            self.merges = Tokenizer(self.tok.model)
            self.merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\x01")
            self.stands = _stands()
            self.bytes = np.zeros(len(self.opens), np.int64)
            for t, i in vocab.items():
                self.bytes[i] = len(t)
            # only where every byte has an id, and ids stand for their bytes alone
            alone = not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
            self.cuts = alone and all(chr(c) in model["vocab"] for c in self.stands.tolist() if c != 1)
        elif bpe and inner == ["Split", "ByteLevel"] and [x.get("type") for x in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            self.kind = "word"
            (self.mark,) = self._whole("\x01")
        else:
            self.kind = "other"
        added = [re.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self.added = f"(?i){'|'.join(added)}" if added else None
        self.known = Words(MOST_WORDS)
        self.size = np.zeros(0, np.int64)
        self.store = np.zeros(0, np.uint32)

    def _whole(self, s: str) -> np.ndarray:
        return np.array(self.tok.encode(s, add_special_tokens=False).ids, dtype=np.uint32)

    def _texts(self, texts: list[str], tok=None) -> np.ndarray:
        """The ids of all texts, one after the other."""
        found = [np.zeros(0, np.uint32)]
        for i in range(0, len(texts), TEXTS):
            found += [np.array(e.ids, np.uint32) for e in (tok or self.tok).encode_batch_fast(texts[i : i + TEXTS], add_special_tokens=False)]
        return np.concatenate(found)

    def _learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, each after the other, and how many each has: many words make a text, and a mark shows where one's ids end."""
        if self.kind == "word":
            every = words.to_pylist()
            ids = self._texts([" \x01 ".join(every[i : i + IN_A_TEXT]) + " \x01" for i in range(0, len(every), IN_A_TEXT)])
            marks = ids == self.mark
            return ids[~marks], np.diff(np.flatnonzero(marks) - np.arange(len(every)), prepend=0)
        if not self.cuts:
            return self._by_marks(words)
        one, simple = (pc.match_substring_regex(words, p).to_numpy(zero_copy_only=False) for p in (_ONE, _SIMPLE))
        size, starts, parts, at = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], 0
        for some, how in ((one, self._by_runs), (simple & ~one, partial(self._by_runs, cut=True)), (~simple, self._by_marks)):
            if some.any():
                ids, n = how(words.filter(pa.array(some)))
                size[some], starts[some] = n, at + n.cumsum() - n
                parts.append(ids)
                at += len(ids)
        return np.concatenate([*parts, np.zeros(0, np.uint32)])[_spread(starts, size)], size

    def _by_runs(self, words: pa.Array, cut: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Simple words, of one run or cut into runs: the first takes the blank before the word, and a line feed is one. A word's ids are as many as take up its bytes."""
        none, blank, end = (pa.scalar(x, pa.large_string()) for x in ("", " ", "\x01"))
        words = pc.if_else(pc.starts_with(words, "\n"), words, pc.binary_join_element_wise(none, words, blank))
        runs = pc.replace_substring_regex(words, _RUN, "\\1\x01") if cut else pc.binary_join_element_wise(words, none, end)
        groups = pa.array(np.append(np.arange(0, len(words), IN_A_TEXT), len(words)), pa.int32())
        texts = pc.binary_join(pa.ListArray.from_arrays(groups, runs.cast(pa.string())), "")
        ids = self._texts([self.stands[np.frombuffer(t.as_buffer(), np.uint8)].tobytes().decode("utf-16-le") for t in texts], self.merges)
        ends = np.searchsorted(self.bytes[ids].cumsum(), pc.binary_length(words).to_numpy(zero_copy_only=False).cumsum()) + 1
        return ids, np.diff(ends, prepend=0)

    def _by_marks(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Any words: a blank or line feed before each shows where its ids begin."""
        fed = pc.starts_with(words, "\n").to_numpy(zero_copy_only=False)
        size, parts = np.zeros(len(words), np.int64), []
        for kind in (True, False):
            some = words.filter(pa.array(fed == kind)).to_pylist()
            ids = self._texts([("" if kind else " ") + ("" if kind else " ").join(some[i : i + IN_A_TEXT]) for i in range(0, len(some), IN_A_TEXT)])
            at = np.flatnonzero(ids == self.feed if kind else self.opens[ids])
            size[fed == kind] = np.diff(at, append=len(ids))
            parts.append((ids, at))
        if not len(parts[0][0]):
            return parts[1][0], size
        starts = np.zeros(len(words), np.int64)
        starts[fed], starts[~fed] = parts[0][1], parts[1][1] + len(parts[0][0])
        return np.concatenate([parts[0][0], parts[1][0]])[_spread(starts, size)], size

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: none) one after the other, and where each text's ids begin, with the end of the last."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        parts, counts, i = [np.zeros(0, np.uint32)], [], 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + AT_ONCE, "right")))
            ids, n = self._some(texts.slice(i, j - i))
            parts.append(ids)
            counts.append(n)
            i = j
        pa.default_memory_pool().release_unused()
        _trimmer()(0)
        return np.concatenate(parts), np.concatenate([[0], *counts]).astype(np.int64).cumsum()

    def encode(self, text: str) -> np.ndarray:
        return self.encode_column(pa.array([text]))[0]

    def _some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "other":
            each = [self._whole(t) for t in texts.to_pylist()]
            return np.concatenate(each), np.array([len(x) for x in each])
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        whole = pc.match_substring_regex(texts, self.added).to_numpy(zero_copy_only=False) if self.added else np.zeros(len(texts), bool)
        odd = odd | whole
        plain = texts.filter(pa.array(~odd))
        ids, n = self._plain(plain) if len(plain) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        if not odd.any():
            return ids, n
        counts = np.zeros(len(texts), np.int64)
        counts[~odd] = n
        end, parts, at = np.concatenate([[0], n.cumsum()]), [], 0
        kept: dict[str, np.ndarray] = {}
        for i, t in zip(np.flatnonzero(odd).tolist(), texts.filter(pa.array(odd)).to_pylist(), strict=True):
            own = [self._whole(t)] if whole[i] else []
            for c in () if whole[i] else _CHUNK.findall(t):
                if len(c) >= 200 or c not in kept:
                    kept[c[:200]] = x = self._whole(c)
                own.append(kept[c] if len(c) < 200 else x)
            before = i - len(parts) // 2  # plain texts before this one
            parts += [ids[at : end[before]], np.concatenate([*own, np.zeros(0, np.uint32)])]
            at = end[before]
            counts[i] = len(parts[-1])
        return np.concatenate([*parts, ids[at:]]), counts

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        byte = self.kind == "byte"
        if byte:  # a line's first word, also of the text, is held with the line feed before it
            texts = pc.replace_substring(pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar("\n", pa.large_string())), "\n", " \n")
            texts = pc.utf8_slice_codeunits(texts, 1)
        else:
            texts = pc.replace_substring(texts, "\n", " ")
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        words, place = coded.dictionary, coded.indices.to_numpy()
        keys, short = Words.keys_of(words)
        number = np.full(len(words), -1, np.int64)
        number[short] = self.known.find(keys[:, short])
        new = np.flatnonzero(number < 0)
        ids, size = self._learn(words.take(pa.array(new)))
        store, sizes = np.concatenate([self.store, ids]), np.concatenate([self.size, size])
        number[new] = len(self.size) + np.arange(len(new))
        starts = sizes.cumsum() - sizes
        keep = short[new]
        if 2 * self.known.n > MOST_WORDS:
            keep &= np.bincount(place, minlength=len(words))[new] > 1
        keep = np.flatnonzero(keep)[: MOST_WORDS - self.known.n]
        self.known.add(keys[:, new[keep]])
        keep += len(self.size)
        self.store = np.concatenate([self.store, store[_spread(starts[keep], sizes[keep])]])
        self.size = np.concatenate([self.size, sizes[keep]])
        place = number[place]
        n = sizes[place]
        offsets = lists.offsets.to_numpy()
        counts = np.add.reduceat(n, (offsets - offsets[0])[:-1])
        ids = store[_spread(starts[place], n)]
        if byte:  # the line feed put before each text
            keep = np.ones(len(ids), bool)
            keep[np.concatenate([[0], counts.cumsum()[:-1]])] = False
            ids, counts = ids[keep], counts - 1
        return ids, counts


def _stands() -> np.ndarray:
    """For each byte, the character that byte-level files write for it; \x01 for itself, as it parts runs."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = np.zeros(256, "<u2")
    out[shown] = shown
    rest = np.setdiff1d(np.arange(256), shown)
    out[rest] = 256 + np.arange(len(rest))
    out[1] = 1
    return out


def _spread(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All positions start, start + 1, ... of n places each, one range after the other."""
    out = np.repeat(starts - np.concatenate([[0], n.cumsum()[:-1]]), n)
    out += np.arange(len(out))
    return out


def as_bytes(ids: np.ndarray) -> memoryview:
    """Little-endian unsigned 32-bit ids."""
    return memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")


@cache
def _trimmer():
    """What gives freed memory back to the system, where the C library can."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker and file."""
    return Encoder(path)


def forget() -> None:
    """Give back what encoding has held in this worker: later steps need none of it."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        gc.collect()
    _trimmer()(0)
