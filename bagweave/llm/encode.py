"""Encoding with a public byte-level BPE vocabulary (problem 8).

Method: forced boundaries. A byte pair that occurs inside no vocabulary token can never be merged over, so every
such place in a pre-token is a certain cut; the fragments between cuts are encoded independently by byte-pair
merges and their ids concatenated. Fragments repeat, so each worker keeps the ids of recent ones.
"""

from __future__ import annotations

import base64
from functools import cache

import regex
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .columns import per_value

#: Where the vocabulary files lie unless a path is given.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"

# The public pre-token pattern of this vocabulary.
PATTERN = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

#: Distinct pre-tokens and fragments kept per worker, and the characters or bytes of the longest kept; beyond the
#: number, the cache starts anew.
CACHE, CACHED_LENGTH = 200_000, 64


class ByteBpe:
    """Byte-pair encoding by ranks, with forced cuts."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(t): int(k) for t, k in (line.split() for line in f if line.strip())}
        inside = {t[i : i + 2] for t in self.ranks for i in range(len(t) - 1)}
        self.joinable = bytearray(1 << 16)
        for p in inside:
            self.joinable[p[0] << 8 | p[1]] = 1
        self.words: dict[str, list[int]] = {}
        self.parts: dict[bytes, list[int]] = {}

    def fragments(self, word: bytes) -> list[bytes]:
        """``word`` cut wherever its neighbouring bytes occur inside no token."""
        j, cuts = self.joinable, [0]
        cuts += [i for i in range(1, len(word)) if not j[word[i - 1] << 8 | word[i]]]
        return [word[a:b] for a, b in zip(cuts, [*cuts[1:], len(word)])]

    def merge(self, part: bytes) -> list[int]:
        """The ids of one fragment by merges in rank order; a heap keeps long fragments near-linear."""
        ranks = self.ranks
        if len(part) == 1:
            return [ranks[part]]
        if len(part) > 64:
            return self._merge_long(part)
        pieces = [part[i : i + 1] for i in range(len(part))]
        while len(pieces) > 1:
            best, at = None, -1
            for i in range(len(pieces) - 1):
                r = ranks.get(pieces[i] + pieces[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
        return [ranks[p] for p in pieces]

    def _merge_long(self, part: bytes) -> list[int]:
        from heapq import heapify, heappop, heappush

        ranks, n = self.ranks, len(part)
        piece = [part[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, part[i : i + 2]) for i in range(n - 1) if (r := ranks.get(part[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, both = heappop(heap)
            k = right[i] if piece[i] else -1
            if k < 0 or piece[i] + piece[k] != both:
                continue
            piece[i], piece[k] = both, b""
            right[i] = right[k]
            if right[k] >= 0:
                left[right[k]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (r := ranks.get(piece[a] + piece[b])) is not None:
                    heappush(heap, (r, a, piece[a] + piece[b]))
        return [ranks[p] for p in piece if p]

    def word(self, word: str) -> list[int]:
        ids: list[int] = []
        for part in self.fragments(word.encode("utf-8", "replace")):
            known = self.parts.get(part)
            if known is None:
                known = self.merge(part)
                if len(part) <= CACHED_LENGTH:
                    if len(self.parts) >= CACHE:
                        self.parts.clear()
                    self.parts[part] = known
            ids += known
        if len(word) <= CACHED_LENGTH:
            if len(self.words) >= CACHE:
                self.words.clear()
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        get, make, ids = self.words.get, self.word, []
        for w in PATTERN.findall(text):
            known = get(w)
            ids += make(w) if known is None else known
        return ids


@cache
def tokenizer(path: str) -> ByteBpe:
    """The encoder of this worker for a vocabulary file."""
    return ByteBpe(path)


def token_ids(text: Column, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> Column:
    """The ids of ``text`` without special tokens, whose strings are ordinary text; null and '' have no ids: []."""
    name = f"{vocabulary}.tiktoken"
    SparkSession.active().sparkContext.addFile(f"{folder}/{name}")  # the driver's copy; workers need none of their own

    def make():
        encode = tokenizer(SparkFiles.get(name)).encode
        return lambda s: encode(s) if s else []

    return per_value("array<int>", make)(text)


def token_count(text: Column, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> Column:
    """The number of ids of ``text``; 0 for null and ''."""
    return F.size(token_ids(text, vocabulary, folder))
