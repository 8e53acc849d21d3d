"""Batches beside a plain loop over arrivals."""

import collections
import os
import random

import numpy as np
import pytest

from cairnset.llm import incremental

ANCHOR = "struct<locator:string,path:string,sha256:string,symbol:string,symbol_sha256:string>"
SCHEMA = f"entry_id long, batch_no int, identity_key string, anchors array<{ANCHOR}>, key string, digests int"


def canon(x):
    x = (x or "").strip(" \t\r\n").lower().removeprefix("sha256:").strip(" \t\r\n")
    return x or None


def brute(rows):
    keys, sets, where, out = {}, {}, collections.defaultdict(list), set()
    for e, _, k, anchors, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] if r[1] is not None else -1, r[0])):
        k, s = canon(k), {canon(a[i]) for a in anchors or [] if a for i in (2, 4)} - {None}
        hits = {keys[k]} if k in keys and k else set()
        for a, n in collections.Counter(a for d in s for a in where[d]).items():
            if 3 * n >= len(s) + len(sets[a]):
                hits.add(a)
        out |= {(a, e) for a in hits}
        if not hits:
            if k:
                keys[k] = e
            sets[e] = s
            for d in s:
                where[d].append(e)
    return out


def found(spark, rows):
    got = [tuple(r) for r in incremental.repeated_entries(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got))
    return set(got)


def made(seed, n, batches, digests):
    rnd = random.Random(seed)
    rows = []
    for e in range(1, n + 1):
        pool = [f"sha256:{rnd.randrange(digests):064x}" for _ in range(rnd.choice([0, 1, 1, 2, 3, 8]))]
        anchors = [("l", "p", rnd.choice([d, d.upper(), None]), None, rnd.choice([None, "", f"{rnd.randrange(digests):064x}"])) for d in pool]
        key = rnd.choice([None, " ", f"{rnd.randrange(n):064x}", f"SHA256:{rnd.randrange(n):064X} "])
        batch = 0 if e < n // 2 else 1 + (e - n // 2) * batches // n
        rows.append((e, batch, key, rnd.choice([anchors, anchors, anchors, None, anchors + [None]]), "x", 1))
    return rows


def test_against_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(incremental, "BUCKET_PRINTS", 200)
    rows = made(4, 300, 2, 60)
    assert found(spark, rows) == brute(rows)


def test_copies_of_one_entry_and_empty_sets(spark):
    one = [("l", "p", "sha256:" + "a" * 64, None, None)]
    rows = [(e, e % 2, None, one, "x", 1) for e in range(1, 40)] + [(e, 1, None, None, "x", 1) for e in range(50, 60)]
    rows += [(70, 1, "k" * 64, None, "x", 1), (71, 1, "K" * 64, None, "x", 1), (None, 1, "k" * 64, one, "x", 1), (72, None, "k" * 64, None, "x", 1)]
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == set()


def test_winnowing_never_misses():
    rnd = random.Random(9)
    for _ in range(3000):
        n, m = rnd.choice([1, 2, 3, 5, 8, 17, 23, 40, 90]), rnd.choice([1, 2, 4, 6, 9, 18, 30, 61, 100])
        if not n <= 2 * m <= 4 * n:
            continue
        shared = -(-(n + m) // 3)
        if shared > min(n, m):
            continue
        universe = rnd.sample(range(10_000), n + m - shared)
        x = sorted(universe[:n])
        y = sorted(universe[n - shared :])
        assert len(set(x) & set(y)) == shared
        px = dict(incremental.winnow(n))[incremental.size_class(m)]
        py = dict(incremental.winnow(m))[incremental.size_class(n)]
        assert set(x[:px]) & set(y[:py])


def test_a_store_opens_again_and_reads_what_a_batch_touches(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(incremental, "BUCKET_PRINTS", 50)
    rows = made(7, 900, 1, 4000)
    batches = [[r for r in rows if r[1] == b] for b in (0, 1)]
    last = [batches[0][3][:1] + (9,) + batches[0][3][2:], (5000, 9, None, [("l", "p", "f" * 64, None, None)], "x", 1)]
    last[0] = (4000, *last[0][1:])
    first = incremental.Store(spark, str(tmp_path))
    got = set()
    for batch in batches:
        got |= {tuple(r) for r in incremental.add_batch(first, spark.createDataFrame(batch, SCHEMA)).collect()}

    read, plain = collections.Counter(), incremental.Store.read

    def noted(store, name, parts):
        df = plain(store, name, parts)
        read[name] += sum(os.path.getsize(f.removeprefix("file:").replace("///", "/")) for f in df.inputFiles())
        return df

    again = incremental.Store.open(spark.newSession(), str(tmp_path))
    assert [(s.number, s.entries, s.buckets) for s in again.segments] == [(s.number, s.entries, s.buckets) for s in first.segments]
    monkeypatch.setattr(incremental.Store, "read", noted)
    got |= {tuple(r) for r in incremental.add_batch(again, again.spark.createDataFrame(last, SCHEMA)).collect()}
    assert got == brute(rows + last)
    whole = sum(f.stat().st_size for s in first.segments for f in (tmp_path / str(s.number)).rglob("*.parquet"))
    assert min(s.buckets for s in first.segments[:1]) > 20 and 0 < sum(read.values()) < whole / 4


def test_filters_let_few_pass_by_chance(spark, tmp_path):
    store = incremental.Store(spark, str(tmp_path))
    incremental.add_batch(store, spark.createDataFrame(made(8, 600, 1, 10_000), SCHEMA)).count()
    values = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 20_000)
    buckets = incremental.bucket_of(values.view(np.uint64), store.segments[0].buckets)
    probes = spark.createDataFrame([(1, int(b), int(v)) for b, v in zip(buckets, values)], "segment int, bucket int, probe long")
    assert store.screen(probes).count() < 0.02 * len(values)


def test_a_batch_takes_few_spark_actions(spark, tmp_path):
    def last_action():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark._jsparkSession.sharedState().statusStore().executionsList().last().executionId()

    rows = made(5, 400, 1, 300)
    store, later = incremental.Store(spark, str(tmp_path)), [r for r in rows if r[1] == 1][:40]
    got = {tuple(r) for r in incremental.add_batch(store, spark.createDataFrame([r for r in rows if r[1] == 0], SCHEMA)).collect()}
    before = last_action()
    found = incremental.add_batch(store, spark.createDataFrame(later, SCHEMA))
    assert last_action() - before <= 16  # 19 where the driver asks for what could be noted
    assert got | {tuple(r) for r in found.collect()} == brute([r for r in rows if r[1] == 0] + later)


def test_a_version_of_the_manifest_is_written_once(spark, tmp_path):
    store = incremental.Store(spark, str(tmp_path))
    store.commit([])
    with pytest.raises(FileExistsError):
        incremental.Store(spark, str(tmp_path)).commit([])
    assert incremental.Store.open(spark, str(tmp_path)).version == 1
