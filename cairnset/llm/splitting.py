"""Oversized texts into overlapping pieces at natural boundaries (problem 8)."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnset.llm.encode import rank_file
from cairnset.llm.tokenizer import Encoder, encoder_of

LIMIT = 512
OVERLAP = 64

#: Strength of a boundary, strongest first.
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, INSIDE = 5, 4, 3, 2, 1, 0
UNSPLIT = "unsplit"  #: boundary of a text that could not be cut within the limit
NAMES = {5: "paragraph", 4: "line", 3: "sentence", 2: "clause", 1: "word", 0: "inside"}
SENTENCE_ENDS = (".", "!", "?", "。", "！", "？", "…", '."', ".)")
CLAUSE_ENDS = (",", ";", ":", "、", "，", "；", "：", ")", "]", "}")


@dataclass
class Units:
    """A text as units that are never cut: words, long words in slices.

    ``chars`` and ``tokens`` are the running sums before each unit, and
    ``inner`` tells which units begin inside a word, where the sum of tokens is
    only an estimate.
    """

    text: str
    words: list[str]
    chars: list[int]
    tokens: list[int]
    inner: list[bool]

    @classmethod
    def of(cls, text: str, encoder: Encoder, most: int) -> Units:
        words, sizes = encoder.word_sizes(text)
        units, tokens, inner = [], [], []
        slice_chars = max(1, most // 4)
        for word, size in zip(words, sizes):
            if size <= 4 * most:
                units.append(word)
                tokens.append(size // 4)
                inner.append(False)
                continue
            for a in range(0, len(word), slice_chars):
                part = word[a : a + slice_chars]
                units.append(part)
                tokens.append(encoder.count(part))
                inner.append(a > 0)
        inner.append(False)
        return cls(text, units, [0, *accumulate(map(len, units))], [0, *accumulate(tokens)], inner)

    def strength(self, i: int) -> int:
        """How natural a cut before unit ``i`` is."""
        if self.inner[i]:
            return INSIDE
        here = self.words[i] if i < len(self.words) else ""
        lines, k = 0, i - 1
        while k >= 0 and self.words[k].isspace():
            lines += self.words[k].count("\n")
            k -= 1
        if here.isspace() and here != "":
            return INSIDE  # better after the blanks than among them
        if lines >= 2:
            return PARAGRAPH
        if lines:
            return LINE
        last = self.words[k] if k >= 0 else ""
        apart = k < i - 1 or here[:1] == " " or last.endswith(("。", "！", "？", "、", "，"))
        if not apart:
            return INSIDE
        return SENTENCE if last.endswith(SENTENCE_ENDS) else CLAUSE if last.endswith(CLAUSE_ENDS) else WORD


def snap(units: Units, target: float, low: int, high: int) -> int:
    """The unit from ``low`` to ``high`` before which the cut is strongest, then nearest to ``target`` tokens."""
    return max(range(low, high + 1), key=lambda i: (units.strength(i), -abs(units.tokens[i] - target), -i))


def place_cuts(units: Units, count: int, limit: int, overlap: int) -> list[tuple[int, int]] | None:
    """``count`` pieces as (first unit, unit after the last), or None if a limit fails."""
    n, tokens = len(units.words), units.tokens
    step = (tokens[n] - overlap) / count
    slack = max(1.0, step / 5)
    pieces, start = [], 0
    for j in range(1, count + 1):
        if j == count:
            end = n
        else:
            target = j * step + overlap
            most = bisect_right(tokens, tokens[start] + limit) - 1
            low = max(start + 1, bisect_left(tokens, target - slack))
            high = min(most, bisect_right(tokens, target + slack) - 1, n - 1)
            if high < low:  # no unit begins so near the target: the last that fits
                low = high = min(most, n - 1)
            if high <= start:
                return None
            end = snap(units, target, low, high)
        if tokens[end] - tokens[start] > limit:
            return None
        pieces.append((start, end))
        if end < n:
            want = tokens[end] - overlap
            low = max(start + 1, bisect_left(tokens, want - overlap / 4))
            high = min(end, bisect_right(tokens, want + overlap / 4) - 1)
            start = snap(units, want, low, high) if low <= high else max(start + 1, min(end, bisect_left(tokens, want)))
    return pieces


@dataclass
class Piece:
    start: int
    end: int
    n_tokens: int
    shared: int
    boundary: str


def split_text(text: str, encoder: Encoder, limit: int = LIMIT, overlap: int = OVERLAP) -> list[Piece]:
    """Pieces of a text, in order, each of at most ``limit`` tokens when encoded by itself.

    A text within the limit, the empty one too, is one piece. Else the smallest
    number of pieces that can hold the text with the overlap is tried first,
    with targets at equal distances; each cut goes to the strongest boundary
    near its target, each next start to the strongest near ``overlap`` tokens
    before it. Where a limit fails, one more piece is tried. A text that no number
    of pieces brings within the limit is one piece with the boundary UNSPLIT.
    """
    units = Units.of(text, encoder, max(1, min(overlap, (limit - overlap) // 4)))
    total, n = units.tokens[-1], len(units.words)
    if not any(units.inner) and total <= limit:
        return [Piece(0, len(text), total, 0, "end")]
    if any(units.inner) and (whole := encoder.count(text)) <= limit:
        return [Piece(0, len(text), whole, 0, "end")]
    count = max(2, -(-(total - overlap) // (limit - overlap)))
    while count <= 8 * n + 8:
        cuts = place_cuts(units, count, limit, overlap)
        made = cuts and finish(units, cuts, encoder, limit)
        if made:
            return made
        count += 1
    return [Piece(0, len(text), encoder.count(text), 0, UNSPLIT)]


def finish(units: Units, cuts: list[tuple[int, int]], encoder: Encoder, limit: int) -> list[Piece] | None:
    """Pieces with their true sizes, or None if one that is cut inside a word is too large."""
    pieces, before = [], 0
    for a, b in cuts:
        # Blanks at the end of a piece are cut into words anew, and so is a word that is cut.
        tail = b
        if any(units.inner[a : b + 1]):
            tail = a
        while tail > a and units.words[tail - 1].isspace():
            tail -= 1
        size = units.tokens[tail] - units.tokens[a] + encoder.count(units.text[units.chars[tail] : units.chars[b]])
        if size > limit:
            return None
        boundary = "end" if b == len(units.words) else NAMES[units.strength(b)]
        shared = max(0, units.tokens[before] - units.tokens[a]) if pieces else 0
        pieces.append(Piece(units.chars[a], units.chars[b], size, shared, boundary))
        before = b
    return pieces


def split_texts(
    df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, path: str | None = None
) -> DataFrame:
    """Pieces of every text: key, piece_no, n_pieces, char_start, char_end, n_tokens, shared_tokens, boundary, piece.

    ``piece`` is the text from char_start to char_end, counted in characters, so
    the text can be put together again. Null texts give no piece, empty ones one
    empty piece; repeated rows are split each by itself. ``limit`` must be at
    least 16 and ``overlap`` at most half of it. One narrow stage, no shuffle.
    """
    if limit < 16 or not 0 < overlap <= limit // 2:
        raise ValueError("limit must be 16 or more, overlap from 1 to half of it")
    ranks = rank_file(df.sparkSession, path)
    kind = df.schema[key].dataType.simpleString()
    schema = (
        f"`{key}` {kind}, piece_no int, n_pieces int, char_start bigint, char_end bigint, "
        "n_tokens int, shared_tokens int, boundary string, piece string"
    )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(ranks.value)
        for batch in batches:
            rows, place = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                pieces = split_text(t, encoder, limit, overlap)
                place += [i] * len(pieces)
                rows += [
                    (k, len(pieces), p.start, p.end, p.n_tokens, p.shared, p.boundary, t[p.start : p.end])
                    for k, p in enumerate(pieces)
                ]
            columns = list(zip(*rows)) or [()] * 8
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            arrays = [batch.column(0).take(pa.array(place, pa.int64()))]
            arrays += [pa.array(c, kind) for c, kind in zip(columns, types)]
            names = [key, "piece_no", "n_pieces", "char_start", "char_end", "n_tokens", "shared_tokens", "boundary", "piece"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.where(F.col(text).isNotNull()).select(key, text).mapInArrow(split, schema)


def oversized(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Keys of the texts that had to be cut.

    A token holds at least one byte, so texts of up to ``limit`` bytes need no
    tokenizing and are left out before Python.
    """
    long = df.where(F.octet_length(F.col(text)) > limit)
    return split_texts(long, key, text, limit, overlap).where(f"piece_no = 1 OR boundary = '{UNSPLIT}'").select(key)
