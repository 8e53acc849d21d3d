"""Queries that SQL cannot express, on whole tables beside plain Python."""

import collections

import oracle
from cairnset.llm import queries, splitting

FOLDER = "/root/testdata/sf0.001"


def test_twins(spark):
    for name in queries.SQL:
        assert ": same " in oracle.compare(spark, FOLDER, name)


def test_counts_are_the_lengths_of_the_ids(spark):
    ids = {r.doc_id: len(r.ids) for r in queries.p6_ids(spark, FOLDER).collect()}
    counts = {r.doc_id: r.n_tokens for r in queries.p6_counts(spark, FOLDER).collect()}
    assert {k: v or 0 for k, v in counts.items()} == ids and len(ids) == 100


def test_shares_follow_from_the_mixture(spark):
    mixed = queries.p7_mix(spark, FOLDER).collect()
    used, uses, shards = collections.Counter(), collections.Counter(), collections.Counter()
    for r in mixed:
        used[r.source] += r.n_tokens
        shards[r.shard] += r.n_tokens
        uses[r.source] = max(uses[r.source], r.copy_no + 1)
    shares = queries.p7_shares(spark, FOLDER).collect()
    assert {r.source: (r.used, r.most_uses) for r in shares} == {r.source: (used[r.source], uses[r.source]) for r in shares}
    assert all(abs(r.share - used[r.source] / sum(used.values())) < 1e-12 and r.largest_shard == max(shards.values()) for r in shares)
    assert all(r.most_uses <= r.max_repeats for r in shares)


def test_pieces_put_the_texts_together(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    pieces = collections.defaultdict(list)
    for r in queries.p8_pieces(spark, FOLDER).collect():
        pieces[r.doc_id].append(r)
    assert set(pieces) == {k for k, t in texts.items() if t is not None}
    for doc, rows in pieces.items():
        rows.sort(key=lambda r: r.piece_no)
        assert [r.piece_no for r in rows] == list(range(rows[0].n_pieces)) and rows[0].char_start == 0 and rows[-1].char_end == len(texts[doc])
        assert all(r.n_tokens <= splitting.LIMIT and r.piece == texts[doc][r.char_start : r.char_end] for r in rows)
        assert all(a.char_start < b.char_start <= a.char_end < b.char_end for a, b in zip(rows, rows[1:]))

