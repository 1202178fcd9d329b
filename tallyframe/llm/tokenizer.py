"""Byte-pair encoding of whole columns with a public vocabulary.

Texts are split into words by the vocabulary's public pattern and each word is encoded by a
contiguous rank array: the boundaries of its parts and the ranks of adjacent pairs lie side by side;
the least rank is sought, the boundary behind it deleted and the two neighbouring ranks refreshed,
until no pair has a rank. All of this runs on arrays over many texts at once:

- The pattern depends only on the class of a character (letter, number, white space, other), its
  neighbours and a few contractions, so word starts are found by comparing shifted arrays.
- Words of a chunk are dictionary-encoded, and each distinct word is encoded once. Words that are
  vocabulary entries are looked up; of the rest, those of about the same length form a matrix with a
  word's rank array in each row, and one step merges a pair in every row.
- Words of more than LONG bytes use a heap over linked parts instead, which stays near linear.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
NONE = np.int32(2**31 - 1)
#: Bytes up to which a word is encoded in a matrix, and code points per chunk of texts.
LONG, CHUNK = 128, 1 << 21
OTHER, LETTER, NUMBER, SPACE, UNKNOWN = 0, 1, 2, 3, 255
#: The code points of the White_Space property.
WHITE_SPACE = frozenset(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_classes = np.full(0x110000, UNKNOWN, np.uint8)


def classes_of(points: np.ndarray) -> np.ndarray:
    """The class of each code point; classes met for the first time are worked out once."""
    c = _classes[points]
    if (new := c == UNKNOWN).any():
        for p in np.unique(points[new]).tolist():
            ch = chr(p)
            major = unicodedata.category(ch)[0]
            _classes[p] = SPACE if ch in WHITE_SPACE else LETTER if major == "L" else NUMBER if major == "N" else OTHER
        c = _classes[points]
    return c


def word_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Positions at which a word of the pattern starts; text_starts: where the non-empty texts start."""
    n = len(points)
    c = classes_of(points)
    first = np.zeros(n, bool)
    first[text_starts] = True
    before = np.empty(n, np.uint8)
    before[0], before[1:] = UNKNOWN, c[:-1]
    before[first] = UNKNOWN
    after_blank = np.zeros(n, bool)
    after_blank[1:] = points[:-1] == 0x20
    after_blank &= ~first
    space = c == SPACE
    last_of_text = np.ones(n, bool)
    last_of_text[:-1] = first[1:]
    before_word = np.zeros(n, bool)
    before_word[:-1] = ~space[1:]
    before_word &= ~last_of_text
    start = np.where(space, (before != SPACE) | before_word, (before != c) & ~after_blank)
    at = np.flatnonzero((points == 0x27) & start)
    if len(at):
        # Padded, so that positions behind the end read as 0; a text's end stops a contraction.
        p = np.concatenate([points, np.zeros(3, points.dtype)])
        f = np.concatenate([first, np.ones(3, bool)])
        a, b = np.where(f[at + 1], 0, p[at + 1]), np.where(f[at + 1] | f[at + 2], 0, p[at + 2])
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        start[at[one | two] + 1] = False
        ends = np.concatenate([at[one] + 2, at[two] + 3])
        start[ends[ends < n]] = True
    return np.flatnonzero(start)


class RankVocabulary:
    """Byte-pair ranks read from a file of base64 tokens and ranks; the rank of a token is its id."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        self.ids = np.array(list(ranks.values()), np.int32)
        self.tokens = pa.array(list(ranks), pa.binary())
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for t, r in ranks.items():
            for i in range(1, len(t)):
                if (x := ranks.get(t[:i])) is not None and (y := ranks.get(t[i:])) is not None:
                    pairs[x << 32 | y] = r
        self.pair_rank = pairs
        # An open hash table of the pairs, filled at most to a quarter; unused slots hold the key -1.
        self.bits = max(8, (4 * len(pairs)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        keys, values = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        slot = self._slot(keys >> 32, keys & 0xFFFFFFFF)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == -1)
            take = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[take]], self.values[slot[take]] = keys[take], values[take]
            left = np.ones(len(keys), bool)
            left[take] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        mixed = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NONE if the pair is not merged."""
        key = left.astype(np.int64) << 32 | right
        slot = self._slot(left, right)
        held = self.keys[slot]
        rank = self.values[slot]
        miss = np.flatnonzero((held != key) & (held != -1))
        rank[held != key] = NONE
        slot = slot[miss]
        while len(miss):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            k, held = key[miss], self.keys[slot]
            hit = held == k
            rank[miss[hit]] = self.values[slot[hit]]
            go = ~hit & (held != -1)
            miss, slot = miss[go], slot[go]
        return rank

    def _matrix(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids and their number for words of similar length, one rank array per row."""
        width = int(length.max())
        cols = np.arange(width)
        inside = cols < length[:, None]
        parts = np.where(inside, self.byte_id[data[np.where(inside, begin[:, None] + cols, 0)]], -1)
        parts = parts.astype(np.int32)
        ranks = np.full(parts.shape, NONE, np.int32)
        pair = inside[:, 1:]
        ranks[:, :-1][pair] = self.ranks_of(parts[:, :-1][pair], parts[:, 1:][pair])
        out, rows = np.full(parts.shape, -1, np.int32), np.arange(len(parts))
        while len(rows):
            j = ranks.argmin(axis=1)
            k = np.arange(len(rows))
            least = ranks[k, j]
            if (done := least == NONE).any():
                out[rows[done], : parts.shape[1]] = parts[done]
                go = ~done
                rows, parts, ranks, j, least = rows[go], parts[go], ranks[go], j[go], least[go]
                if not len(rows):
                    break
                k = np.arange(len(rows))
            # Delete the boundary behind part j: everything after it moves one place to the left.
            source = np.minimum(cols + (cols > j[:, None]), width - 1)
            parts, ranks = np.take_along_axis(parts, source, 1), np.take_along_axis(ranks, source, 1)
            parts[:, -1], ranks[:, -1] = -1, NONE
            parts[k, j] = least
            right = np.where(j + 1 < width, parts[k, np.minimum(j + 1, width - 1)], -1)
            ranks[k, j] = NONE
            at = np.concatenate([np.flatnonzero(right >= 0), np.flatnonzero(j > 0)])
            to = np.where(np.arange(len(at)) < int((right >= 0).sum()), j[at], j[at] - 1)
            ranks[at, to] = self.ranks_of(parts[at, to], parts[at, to + 1])
            width = max(1, int((parts >= 0).sum(axis=1).max()))
            cols, parts, ranks = cols[:width], parts[:, :width], ranks[:, :width]
        return out, (out >= 0).sum(axis=1)

    def _long(self, word: bytes) -> list[int]:
        """The same merges for a long word: a heap of (rank, position) over linked parts."""
        parts: list[int | None] = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda i: self.pair_rank.get(parts[i] << 32 | parts[after[i]]) if after[i] < n else None
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            if parts[i] != a or after[i] >= n or parts[after[i]] != b:
                continue
            gone = after[i]
            parts[i], parts[gone], after[i] = r, None, after[gone]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (q := rank(k)) is not None:
                    heapq.heappush(heap, (q, k, parts[k], parts[after[k]]))
        return [p for p in parts if p is not None]

    def encode_words(self, words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets) of distinct words."""
        n = len(words)
        offsets = np.frombuffer(words.buffers()[1], np.int32, n + 1 + words.offset)[words.offset :].astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        length = np.diff(offsets)
        known = pc.index_in(words, value_set=self.tokens)
        whole = pc.fill_null(known, -1).to_numpy(zero_copy_only=False)
        count = np.ones(n, np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rest = np.flatnonzero(whole < 0)
        low = 0
        for high in (6, 8, 10, 12, 16, 20, 26, 32, 48, 64, 96, LONG):
            at = rest[(length[rest] > low) & (length[rest] <= high)]
            low = high
            for some in np.array_split(at, max(1, len(at) * high // 400_000)):
                if len(some):
                    ids, k = self._matrix(data, offsets[some], length[some])
                    count[some] = k
                    found.append((some, ids, k))
        long_ids = {int(i): self._long(data[offsets[i] : offsets[i + 1]].tobytes()) for i in rest[length[rest] > LONG]}
        for i, x in long_ids.items():
            count[i] = len(x)
        ends = np.concatenate([[0], np.cumsum(count)])
        flat = np.empty(int(ends[-1]), np.int32)
        single = np.flatnonzero(whole >= 0)
        flat[ends[single]] = self.ids[whole[single]]
        for some, ids, k in found:
            flat[np.repeat(ends[some], k) + (np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k))] = ids[ids >= 0]
        for i, x in long_ids.items():
            flat[ends[i] : ends[i + 1]] = x
        return flat, ends

    def encode(self, texts: pa.Array, count_only: bool = False) -> pa.Array:
        """list<int32> of each text's ids, or with count_only int64 of their number; null and empty give none."""
        kind = pa.int64() if count_only else pa.list_(pa.int32())
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if n == 0:
            return pa.array([], kind)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1 + texts.offset)[texts.offset :]
        data = texts.buffers()[2]
        done, at = [], 0
        while at < n:
            upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
            upto = min(n, upto)
            done.append(self._encode_chunk(memoryview(data)[offsets[at] : offsets[upto]] if data else b"", offsets[at : upto + 1] - offsets[at], count_only))
            at = upto
        return pa.concat_arrays(done)

    def _encode_chunk(self, data: memoryview, offsets: np.ndarray, count_only: bool) -> pa.Array:
        n = len(offsets) - 1
        if not len(data):
            return pa.array(np.zeros(n, np.int64)) if count_only else pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.int32()))
        points = np.frombuffer(str(data, "utf-8").encode("utf-32-le"), np.uint32)
        if len(points) == len(data):
            byte_at, text_at = None, offsets
        else:
            byte_at = np.zeros(len(points) + 1, np.int64)
            np.cumsum(1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000), out=byte_at[1:])
            text_at = np.searchsorted(byte_at, offsets)
        starts = word_starts(points, np.unique(text_at[:-1][np.diff(text_at) > 0]))
        begin = np.append(starts if byte_at is None else byte_at[starts], len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(begin), pa.py_buffer(data)]).dictionary_encode()
        which = words.indices.to_numpy(zero_copy_only=False)
        flat, ends = self.encode_words(words.dictionary)
        count = np.diff(ends)[which]
        total = np.concatenate([[0], np.cumsum(count)])
        of_text = total[np.searchsorted(starts, text_at)]
        if count_only:
            return pa.array(np.diff(of_text))
        ids = flat[np.repeat(ends[:-1][which] - total[:-1], count) + np.arange(total[-1])]
        return pa.ListArray.from_arrays(pa.array(of_text.astype(np.int32)), pa.array(ids))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> RankVocabulary:
    """One vocabulary per Python worker, kept for its later tasks."""
    return RankVocabulary(path)


def encode_column(df: DataFrame, key: str, text: str, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """key and ids (array<int>) of every row; null and empty texts give an empty list.

    No special tokens are added and their strings are ordinary text. The whole text is encoded, in
    one narrow pass without a shuffle. path must be readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), v.encode(b.column(1))], names=[key, "ids"])

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, ids array<int>")


def count_column(df: DataFrame, key: str, text: str, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """key and n_ids (bigint), the number of ids of every row's text; 0 for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), v.encode(b.column(1), count_only=True)], names=[key, "n_ids"])

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, n_ids bigint")
