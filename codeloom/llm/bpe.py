"""Byte-pair encoding with a given public vocabulary: vectorised pre-tokenisation, cached merging.

The pre-tokeniser's language (contractions; letters, digits or other characters with an optional leading space; white space) is recognised without
regular expressions. Every code point has a class, and the automaton's state after a code point depends on that code point's class alone: its
transition functions are constant, so their composition is associative and a whole batch is scanned by comparing the class array
with itself shifted by one. What is left are repairs next to class changes: the last space of a run joins the word after it, and contractions
end early.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import regex

LETTER, NUMBER, SPACE, OTHER = range(4)
#: Words whose merges are kept in a worker; the cache starts anew beyond this, which changes no result.
CACHE_WORDS = 400_000
#: Code points in one vectorised scan (a longer text is scanned alone).
BLOCK = 1_000_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Where the vocabulary file lies: in folder, else $CODELOOM_TOKENIZERS, else /opt/tokenizers."""
    return os.path.join(folder or os.environ.get("CODELOOM_TOKENIZERS", "/opt/tokenizers"), name)


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


@lru_cache(1)
def char_classes() -> np.ndarray:
    """The class of every code point, by the general categories L, N and the property White_Space."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = kind
    return table


def word_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """A mask of the code points that begin a word; firsts holds the positions where texts begin."""
    n = len(points)
    cls = char_classes()[points]
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(cls[1:], cls[:-1], out=start[1:])
    first = np.zeros(n + 1, bool)
    first[firsts] = True
    start |= first[:n]
    after = np.flatnonzero(start & (cls != SPACE) & ~first[:n])
    after = after[cls[after - 1] == SPACE]
    start[after - 1] = True
    start[after[points[after - 1] == 32]] = False
    quote = np.flatnonzero(start & (points == 39))
    quote = quote[quote + 1 < n]
    quote = quote[~first[quote + 1]]
    if len(quote):
        padded = np.append(points, 0)
        c1, c2 = padded[quote + 1], np.where(first[quote + 2], 0, padded[np.minimum(quote + 2, n)])
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = ((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e")) | (c1 == ord("l")) & (c2 == ord("l"))
        for hit, size in ((one, 2), (two, 3)):
            at = quote[hit]
            start[at + 1] = False
            end = at + size
            start[end[end < n]] = True
    return start


def merge(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """The ids of one word: the pair of lowest rank is merged first, the leftmost of equals; n log n steps for any length."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, e = heappop(heap)
        if not alive[i] or (m := end[i]) >= n or end[m] != e:
            continue
        end[i], alive[m], before[e] = e, False, i
        if e < n and end[e] - i <= longest and (r := ranks.get(piece[i : end[e]])) is not None:
            heappush(heap, (r, i, end[e]))
        p = before[i]
        if p >= 0 and e - p <= longest and (r := ranks.get(piece[p:e])) is not None:
            heappush(heap, (r, p, e))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class _Words(dict):
    """Numbers of words; a new word is merged and its ids appended to the table."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.longest = ranks, max(map(len, ranks))
        self.ids: list[int] = []
        self.offsets: list[int] = [0]

    def __missing__(self, word: str) -> int:
        self.ids += merge(word.encode(), self.ranks, self.longest)
        self.offsets.append(len(self.ids))
        self[word] = k = len(self.offsets) - 2
        return k


class Encoder:
    def __init__(self, raw: bytes):
        self.ranks = read_ranks(raw)
        self.lengths = np.zeros(max(self.ranks.values()) + 1, np.int64)
        for token, k in self.ranks.items():
            self.lengths[k] = len(token)
        self.words = _Words(self.ranks)

    def _word_numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words of the texts, and the index of the first word of each text and of the end."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        starts = np.flatnonzero(word_starts(np.frombuffer(joined.encode("utf-32-le"), np.uint32), bounds[:-1][sizes > 0]))
        if len(self.words) > CACHE_WORDS:
            self.words = _Words(self.ranks)
        cuts = starts.tolist() + [len(joined)]
        number = self.words.__getitem__
        words = np.fromiter([number(joined[a:b]) for a, b in zip(cuts, cuts[1:])], np.int64, len(starts))
        return words, np.searchsorted(starts, bounds)

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        words, first = self._word_numbers(texts)
        total = np.concatenate([[0], np.cumsum(np.diff(np.asarray(self.words.offsets))[words])])
        return np.diff(total[first])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where those of each text begin (and the last end)."""
        words, first = self._word_numbers(texts)
        offsets = np.asarray(self.words.offsets)
        sizes = np.diff(offsets)[words]
        total = np.concatenate([[0], np.cumsum(sizes)])
        take = np.arange(total[-1]) + np.repeat(offsets[words] - total[:-1], sizes)
        return np.asarray(self.words.ids, np.int32)[take], total[first]

    def decode(self, ids) -> bytes:
        if not hasattr(self, "tokens"):
            self.tokens = {k: t for t, k in self.ranks.items()}
        return b"".join(self.tokens[int(k)] for k in ids)


_encoders: dict[int, Encoder] = {}


def encoder(raw: bytes) -> Encoder:
    """One encoder a vocabulary and worker process."""
    key = hash(raw)
    if key not in _encoders:
        _encoders[key] = Encoder(raw)
    return _encoders[key]


def blocks(texts: list[str]):
    """Slices of the list with about BLOCK characters each."""
    a = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK:
            yield a, i
            a, size = i, 0
        size += len(t)
    yield a, len(texts)
