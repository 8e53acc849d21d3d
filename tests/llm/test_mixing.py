"""Mixtures: exact quotas, capped repeats, disjoint shards, reported shares."""

from collections import Counter

import pytest

from cairnset.llm import mixing

DOCS = "doc_id long, text string, source string, n_tokens string"
TARGETS = "source string, weight double, max_repeats int"


def docs(spark, sizes):
    rows, n = [], 0
    for source, count in sizes:
        for _ in range(count):
            rows.append((n, "word " * (5 + n % 40), source, "x"))
            n += 1
    return spark.createDataFrame(rows, DOCS)


def test_shares_and_repeats(spark):
    d = docs(spark, [("A", 600), (" a ", 200), ("b", 150), ("B\n", 50), ("c", 40), ("other", 100), (None, 20), ("", 5)])
    d = d.unionAll(spark.createDataFrame([(9001, None, "a", ""), (9002, "", "b", "")], DOCS))
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("C", 0.1, 3), ("none", 0.1, 5)], TARGETS)
    plan = mixing.MixPlan(block_tokens=200, shard_tokens=4000)
    mixed, quotas = mixing.mix_documents(d, t, plan)
    rows = mixed.collect()
    uses = Counter((r.doc_id, r.source) for r in rows)
    assert max(n for (_, s), n in uses.items() if s == "a") == 1
    assert max(n for (_, s), n in uses.items() if s == "c") <= 3
    assert len({(r.doc_id, r.copy_no) for r in rows}) == len(rows)
    assert len({(r.shard, r.pos) for r in rows}) == len(rows)
    assert {r.source for r in rows} == {"a", "b", "c"}
    shares = {r.source: r for r in mixing.mix_shares(mixed, quotas).collect()}
    for s in "abc":
        assert abs(shares[s].share - shares[s].wanted_share) < 0.01
        assert abs(shares[s].used - shares[s].wanted) <= 60
    assert shares["none"].used == 0 and shares["none"].share == 0
    assert shares["c"].most_uses == 3 and shares["c"].used == 3 * shares["c"].available
    by_shard = Counter()
    for r in rows:
        by_shard[r.shard] += r.n_tokens
    assert len(by_shard) > 3 and max(by_shard.values()) < 3 * min(by_shard.values())
    again = mixing.mix_documents(d.repartition(7), t, plan)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_total_that_cannot_be_met(spark):
    d = docs(spark, [("a", 50), ("b", 5)])
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], TARGETS)
    mixed, quotas = mixing.mix_documents(d, t, mixing.MixPlan(total_tokens=800))
    r = {x.source: x for x in mixing.mix_shares(mixed, quotas).collect()}
    assert r["b"].used == 2 * r["b"].available < 400 and abs(r["a"].used - 400) <= 25


@pytest.mark.parametrize("seed", range(5))
def test_splitting_tree_gives_each_block_once(seed):
    counts, shards = [7, 0, 130, 22], 9
    seats = [[], [], [], []]
    for k in range(shards):
        first, number = mixing.split_quotas(counts, shards, k, seed)
        assert abs(sum(number) - sum(counts) / shards) <= 5
        for s in range(4):
            seats[s] += range(first[s], first[s] + number[s])
    assert seats == [list(range(n)) for n in counts]


def test_empty(spark):
    d, t = docs(spark, [("a", 3)]), spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    for dd, tt in ((d.limit(0), t), (d, t.limit(0)), (d, spark.createDataFrame([("z", 1.0, 1)], TARGETS))):
        mixed, quotas = mixing.mix_documents(dd, tt)
        assert mixed.count() == 0
        assert mixing.mix_shares(mixed, quotas).where("used > 0").count() == 0
