"""Encoding beside the public library, exact round trips, and defined results for odd texts."""

import base64
from pathlib import Path

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnset.llm import encode, tokenizer

RANKS = Path(tokenizer.rank_file_path()).read_bytes()
ENCODER = tokenizer.Encoder(RANKS)
PAIRS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
PUBLIC = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=PAIRS, special_tokens={})
BYTES = {v: k for k, v in PAIRS.items()}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" '\n\tsaé世²\x1c\x85<|>")), max_size=60))
def test_same_as_public_library(text):
    ids = ENCODER.encode(text)
    assert ids == PUBLIC.encode_ordinary(text)
    assert b"".join(BYTES[i] for i in ids).decode() == text
    assert ENCODER.count(text) == len(ids)


def test_long_words():
    for word in ("a" * 5000, "xyzzy" * 4000, " " * 3000, "世" * 2000, "aAbB9" * 1000):
        assert ENCODER.encode(word) == PUBLIC.encode_ordinary(word)


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(tokenizer, "WORDS_KEPT", 5)
    small = tokenizer.Encoder(RANKS)
    texts = [f"word{i} other{i} third" for i in range(50)]
    assert [small.encode(t) for t in texts] == [PUBLIC.encode_ordinary(t) for t in texts]
    assert len(small.ids) < 20


def test_rows(spark):
    rows = [(1, "hello world", "x"), (2, None, "y"), (3, "", None), (None, "a", "z"), (1, "hello world", "x"), (5, "<|endoftext|>", "ids")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, r.ids) for r in encode.encode_texts(df, "doc_id", "text").collect()), key=str)
    assert got == sorted(((d, PUBLIC.encode_ordinary(t) if t else []) for d, t, _ in rows), key=str)
    assert encode.encode_texts(df.limit(0), "doc_id", "text").collect() == []
    counts = {r.doc_id: r.n_tokens for r in encode.count_tokens(df, ["doc_id"], "text").collect()}
    assert counts == {1: 2, 2: 0, 3: 0, None: 1, 5: len(PUBLIC.encode_ordinary("<|endoftext|>"))}
