"""Pieces: exact limits, whole coverage, overlap and natural boundaries."""

import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnset.llm import splitting, tokenizer

ENCODER = tokenizer.Encoder(Path(tokenizer.rank_file_path()).read_bytes())


def check(text, limit=512, overlap=64):
    pieces = splitting.split_text(text, ENCODER, limit, overlap)
    assert (len(pieces) > 1) == (ENCODER.count(text) > limit)
    assert pieces[0].start == 0 and pieces[-1].end == len(text)
    for p in pieces:
        assert ENCODER.count(text[p.start : p.end]) == p.n_tokens <= limit
    for a, b in zip(pieces, pieces[1:]):
        assert a.start < b.start <= a.end < b.end
    return pieces


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word", " and", "\n", "\n\n", ". ", "é世", "    ", "longword" * 40, "x=1;", "😀"]), max_size=900))
def test_any_text(parts):
    check("".join(parts), 64, 16)


@pytest.mark.parametrize("text", ["a" * 9000, " " * 4000, "\n" * 3000, "世" * 3000, "qZx9" * 3000, "x" * 2000 + " word" * 900])
def test_texts_without_boundaries(text):
    check(text)


def test_overlap_and_boundaries():
    rnd = random.Random(3)
    sentences = [" ".join(rnd.choice("alpha beta gamma delta report check".split()) for _ in range(9)).capitalize() + "." for _ in range(400)]
    text = "".join(s + rnd.choice([" ", " ", " ", "\n", "\n\n"]) for s in sentences)
    pieces = check(text)
    assert {p.boundary for p in pieces[:-1]} <= {"paragraph", "line", "sentence"}
    assert all(32 <= p.shared <= 96 for p in pieces[1:])
    assert len(pieces) <= 1 + -(-(ENCODER.count(text) - 64) // 448)


def test_short_and_empty():
    assert [(p.start, p.end, p.n_tokens) for p in check("")] == [(0, 0, 0)]
    assert len(check("one")) == 1


def test_rows(spark):
    rows = [(1, "word " * 2000, 7), (2, None, 8), (3, "", 9), (1, "word " * 2000, 7), (4, "short", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece int")
    got = splitting.split_texts(df, "doc_id", "text").orderBy("doc_id", "piece_no").collect()
    assert {r.doc_id for r in got} == {1, 3, 4}
    first = [r for r in got if r.doc_id == 1]
    assert len(first) == 2 * first[0].n_pieces and all(r.piece == ("word " * 2000)[r.char_start : r.char_end] for r in first)
    assert [r.doc_id for r in splitting.oversized(df, "doc_id", "text").collect()] == [1, 1]
    assert splitting.split_texts(df.limit(0), "doc_id", "text").count() == 0
    with pytest.raises(ValueError):
        splitting.split_texts(df, "doc_id", "text", 8, 2)


def test_no_count_of_pieces_is_skipped(monkeypatch):
    tried, plain = [], splitting.place_cuts
    monkeypatch.setattr(splitting, "place_cuts", lambda u, count, *a: tried.append(count) or (plain(u, count, *a) if len(tried) > 5 else None))
    check("word and more. " * 800, 32, 8)
    assert tried[0] >= 100 and tried == list(range(tried[0], tried[0] + len(tried)))


def test_a_text_that_cannot_be_split_is_one_marked_piece(spark, monkeypatch):
    text = "word " * 400
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    with monkeypatch.context() as m:
        m.setattr(splitting, "finish", lambda *a: None)
        pieces = splitting.split_text(text, ENCODER, 64, 8)
    assert [(p.start, p.end, p.boundary, p.n_tokens) for p in pieces] == [(0, len(text), splitting.UNSPLIT, ENCODER.count(text))]
    assert splitting.oversized(df, "doc_id", "text", 64, 8).count() == 1
