"""Byte-level BPE over a public rank file, without special tokens.

The rank file and the pattern are the only fixed inputs; nothing is trained.
Tokenizing runs inside Spark tasks over Arrow batches. Each task keeps the ids
of the words it has met, so the merge loop runs once per distinct word.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array

import regex

#: How byte_bpe_50k cuts a text into words before merging.
WORD_PATTERN = r""" ?\p{L}++|'(?:[stmd]|re|ve|ll)| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"""
#: The same for texts of ASCII characters only, where the plain module is faster.
ASCII_PATTERN = r""" ?[A-Za-z]++|'(?:[stmd]|re|ve|ll)| ?[0-9]++| ?[^\sA-Za-z0-9]++|\s+(?!\S)|\s+"""

#: Words kept per task before the memory starts anew; speed only, results do not depend on it.
WORDS_KEPT = 300_000

NO_PAIR = 1 << 60


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: merges the leftmost lowest-rank pair until none is left.

    The ranks of adjacent pairs are the leaves of a segment tree whose nodes
    hold the smaller rank of their children. The root tells the lowest rank, the
    way down its leftmost place, and a merge updates three leaves. n bytes take
    O(n log n), so a single word of a whole text's length is fine.
    """
    n = len(word)
    if n == 1:
        return [ranks[word]]
    get = ranks.get
    leaves = [get(word[i : i + 2], NO_PAIR) for i in range(n - 1)]
    size = 1 << (n - 2).bit_length()
    low = [NO_PAIR] * size + leaves + [NO_PAIR] * (size - n + 1)
    for k in range(size - 1, 0, -1):
        a, b = low[2 * k], low[2 * k + 1]
        low[k] = a if a <= b else b
    end = list(range(1, n + 1))  # end of the token that starts here
    before = list(range(-1, n - 1))  # start of the token before it
    while (best := low[1]) != NO_PAIR:
        k = 1
        while k < size:
            k += k
            if low[k] != best:
                k += 1
        i = k - size
        gone = end[i]
        stop = end[i] = end[gone]
        changed = [(k, NO_PAIR)]
        if stop < n:
            before[stop] = i
            changed = [(k, get(word[i : end[stop]], NO_PAIR)), (gone + size, NO_PAIR)]
        elif gone < n - 1:
            changed.append((gone + size, NO_PAIR))
        if i:
            left = before[i]
            changed.append((left + size, get(word[left:stop], NO_PAIR)))
        for k, rank in changed:
            low[k] = rank
            k >>= 1
            while k:
                a, b = low[k + k], low[k + k + 1]
                if b < a:
                    a = b
                if low[k] == a:
                    break
                low[k] = a
                k >>= 1
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : end[i]]])
        i = end[i]
    return ids


class WordIds(dict):
    """Ids by word, packed as 32-bit integers, computed on first use."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> bytes:
        raw = word.encode("utf-8", "replace")
        whole = self.ranks.get(raw)
        ids = [whole] if whole is not None else merge_word(raw, self.ranks)
        packed = self[word] = array("i", ids).tobytes()
        return packed


class Encoder:
    """Encodes texts with one rank file."""

    def __init__(self, rank_file: bytes):
        pairs = (line.split() for line in rank_file.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.cut_ascii = re.compile(ASCII_PATTERN, re.ASCII).findall
        self.cut = regex.compile(WORD_PATTERN).findall
        self.ids = WordIds(self.ranks)

    def words(self, text: str) -> list[str]:
        """The text cut into words; joined they are the text."""
        if len(self.ids) > WORDS_KEPT:
            self.ids.clear()
        return self.cut_ascii(text) if text.isascii() else self.cut(text)

    def packed(self, text: str) -> bytes:
        """Ids of the text as packed 32-bit integers; empty for the empty text."""
        return b"".join(map(self.ids.__getitem__, self.words(text)))

    def encode(self, text: str) -> list[int]:
        """Ids of the text; none for the empty text."""
        return array("i", self.packed(text)).tolist()

    def count(self, text: str) -> int:
        """Number of ids of the text."""
        return len(self.packed(text)) // 4

    def word_sizes(self, text: str) -> tuple[list[str], list[int]]:
        """The words and four times the number of ids of each."""
        words = self.words(text)
        return words, list(map(len, map(self.ids.__getitem__, words)))


_made: dict[str, Encoder] = {}


def encoder_of(rank_file: bytes) -> Encoder:
    """The encoder of a rank file, kept for the life of the worker process."""
    key = hashlib.sha256(rank_file).hexdigest()
    if key not in _made:
        _made[key] = Encoder(rank_file)
    return _made[key]


def rank_file_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed public vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path(name)
