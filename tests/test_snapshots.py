"""Snapshot changes: defined results for nulls, gaps, repeats, empty tables and foreign columns."""

import itertools

import pytest
from pyspark.sql import functions as F

from cairnset.operators import snapshots

ENTRIES = "snapshot_no int, entry_row long, identity_key string, status string, best string"
ANCHORS = "entry_row long, sha256 string, snapshot_no int"


def sha(x):
    return "sha256:" + f"{x:064x}"


def changes(spark, entries, anchors=()):
    e = spark.createDataFrame([(*r, "x") for r in entries], ENTRIES)
    a = spark.createDataFrame([(r, s, 0) for r, s in anchors], ANCHORS)
    return sorted(tuple(r) for r in snapshots.baseline_changes(e, a).collect())


def test_added_removed_changed_and_gaps(spark):
    rows = [(1, 1, sha(1), "open"), (3, 2, sha(1), "closed"), (5, 3, sha(2), "open"), (9, 4, sha(1), "open")]
    assert changes(spark, rows) == [
        (3, sha(1), "changed"),
        (5, sha(1), "removed"),
        (5, sha(2), "added"),
        (9, sha(1), "added"),
        (9, sha(2), "removed"),
    ]


def test_spellings_agree_and_null_keys_never_count(spark):
    rows = [
        (1, 1, " " + sha(10).upper().replace("SHA256:", "sha256:") + "\n", "Open "),
        (2, 2, f"{10:064x}", "open"),
        (1, 3, None, "a"),
        (2, 4, " ", "b"),
        (2, 5, "", "b"),
        (None, 6, sha(3), "b"),
    ]
    assert changes(spark, rows) == []


def test_last_row_of_a_snapshot_counts_and_null_status_is_a_state(spark):
    rows = [(1, 1, sha(1), "a"), (1, 5, sha(1), None), (2, 2, sha(1), " "), (2, 7, sha(2), "x"), (3, 8, sha(1), "b"), (3, 9, sha(2), "x")]
    assert changes(spark, rows) == [(2, sha(2), "added"), (3, sha(1), "changed")]


def test_anchor_sets_ignore_order_repeats_and_nulls(spark):
    rows = [(1, 1, sha(1), "a"), (2, 2, sha(1), "a"), (3, 3, sha(1), "a")]
    anchors = [(1, sha(7)), (1, sha(8)), (2, sha(8)), (2, f"{7:064X}"), (2, sha(8)), (2, None), (2, ""), (3, sha(7)), (99, sha(1)), (None, sha(1))]
    assert changes(spark, rows, anchors) == [(3, sha(1), "changed")]


def test_empty_tables(spark):
    assert changes(spark, []) == []
    assert changes(spark, [], [(1, sha(1))]) == []
    assert changes(spark, [(1, 1, sha(1), "a")]) == []


@pytest.mark.parametrize("seed", range(3))
def test_against_plain_python(spark, seed):
    import random

    rnd = random.Random(seed)
    rows = [(rnd.choice([1, 2, 4, 5]), i, sha(rnd.randrange(6)), rnd.choice(["a", "b", None])) for i in range(60)]
    anchors = [(rnd.randrange(60), rnd.choice([sha(1), sha(2), None])) for _ in range(60)]
    state = {}
    for s, i, k, v in sorted(rows, key=lambda r: r[1]):
        state[s, k] = (v, frozenset(x for r, x in anchors if r == i and x))
    want = []
    snaps = sorted({r[0] for r in rows})
    for a, b in itertools.pairwise(snaps):
        for k in {r[2] for r in rows}:
            x, y = state.get((a, k)), state.get((b, k))
            if x != y:
                want.append((b, k, "added" if x is None else "removed" if y is None else "changed"))
    assert changes(spark, rows, anchors) == sorted(want)


def test_intervals_partition_presence(spark):
    e = spark.createDataFrame([(s, s, sha(1), "a" if s < 3 else "b", "x") for s in (1, 2, 3, 5)], ENTRIES)
    a = spark.createDataFrame([], ANCHORS)
    got = snapshots.validity_intervals(snapshots.entry_states(e, a), "identity_key").orderBy("valid_from")
    assert [(r.valid_from, r.valid_to, r.ended_before) for r in got.collect()] == [(1, 2, 3), (3, 5, None)]


def test_many_snapshots_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(snapshots, "BROADCAST_SNAPSHOTS", 1)
    assert changes(spark, [(1, 1, sha(1), "a"), (2, 2, sha(1), "b")]) == [(2, sha(1), "changed")]


def test_row_hash_tells_null_from_text(spark):
    df = spark.createDataFrame([(None, "a"), ("~", "a"), ("", "a"), ("=", "a")], "x string, y string")
    assert df.select(snapshots.row_hash(F.col("x"), F.col("y"))).distinct().count() == 4
