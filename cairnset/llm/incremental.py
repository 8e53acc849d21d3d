"""New batches against all history (problem 5).

An entry repeats an accepted one if their keys are equal or at least half of the
digests found in either are found in both. Accepted entries live in a store
below the shared folder that any later session can open again (``Store.open``).
It is a list of segments, each written once:

* ``prints``: fingerprints of keys and of winnowed digest sets, by bucket,
* ``entries``: key and digests of each accepted entry, by bucket of its id,
* ``filters``: one Bloom filter per bucket of fingerprints.

A batch is fingerprinted, prescreened against the filters of the buckets it
falls in, and only the positives are looked up, in the buckets that hold them.
Shared coverage is then verified on the digests and the order of arrival is
resolved inside the batch. What is accepted becomes a new segment, together with
the segments that are not much larger; so there are few of them, each is at
least twice the size of the next, and an entry is written again only as often as
the store doubles. A new segment chooses its buckets, filters and order for what
it holds. A version of the manifest, written last, makes the batch count.

Winnowing keeps, for every size that a partner can have, just the first digests
in a fixed order of the set: two sets of n and m digests that agree enough share
ceil((n + m) / 3), so their first n - that + 1 and m - that + 1 digests meet. The
order takes the rarest digests first, by a count sketch of fixed size of all
digests of the segment. It only steers the cost; no match is lost.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cairnset.functions.digest import canonical_digest
from cairnset.session import cut, cut_noting, scratch_path, write_file

EXACT_SIZES = 16  #: sets of more digests are grouped by size, each group a quarter larger than the one before
SKETCH_BITS = 20  #: the count sketch of a segment has so many bits of a digest as places, one byte each
BUCKET_PRINTS = 50_000  #: fingerprints of a segment per bucket
MOST_BUCKETS = 16_384  #: buckets of a segment; beyond, they hold more fingerprints and have larger filters
BLOOM_BITS = 12  #: bits per fingerprint, of each filter's own number: with 5 hashes 0.5 % pass by chance
BLOOM_HASHES = 5
GROWTH = 2  #: a segment is written again with what is added once it is less than so many times as large


def prepare(entries: DataFrame) -> DataFrame:
    """entry_id, batch_no, hashes of key and digest set, and the sorted digests.

    Keys (``key``), sets (``set_id``) and digests are named by 128-bit hashes,
    keys and sets null where there is none. Null anchors, null elements and
    null or blank digests count for nothing. Rows without entry_id are left out.
    """
    both = F.transform("anchors", lambda a: F.array(canonical_digest(a["sha256"]), canonical_digest(a["symbol_sha256"])))
    found = F.filter(F.flatten(F.filter(both, lambda x: x.isNotNull())), lambda x: x.isNotNull())
    digests = F.array_sort(F.array_distinct(F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda x: F.md5(x))))
    key = canonical_digest(F.col("identity_key"))
    named = entries.where("entry_id IS NOT NULL").select(
        "entry_id",
        F.coalesce(F.col("batch_no"), F.lit(-1)).alias("batch_no"),
        F.unhex(F.md5(F.concat(F.lit("k"), key))).alias("key"),
        digests.alias("digests"),
    )
    return named.withColumn("set_id", F.when(F.size("digests") > 0, F.unhex(F.md5(F.array_join("digests", ",")))))


def size_class(n: int) -> int:
    """Class of a set's size: exact up to EXACT_SIZES, then growing by a quarter."""
    return n if n <= EXACT_SIZES else EXACT_SIZES + 1 + int(math.log(n / EXACT_SIZES, 1.25))


def smallest_of(c: int) -> int:
    """A size no member of the class is below."""
    return c if c <= EXACT_SIZES else max(EXACT_SIZES + 1, math.floor(EXACT_SIZES * 1.25 ** (c - EXACT_SIZES - 1)))


def winnow(n: int) -> list[tuple[int, int]]:
    """(size class of a partner, how many first digests can meet it) for a set of n digests."""
    kept = []
    for c in range(size_class((n + 1) // 2), size_class(2 * n) + 1):
        least = max(smallest_of(c), (n + 1) // 2)
        shared = -(-(n + least) // 3)
        if shared <= n:
            kept.append((c, n - shared + 1))
    return kept


def scramble(x: np.ndarray, salt: int) -> np.ndarray:
    """Hashes 64-bit values, differently for each salt."""
    x = (x ^ np.uint64(salt * 0xD1342543DE82EF95 % (1 << 64))) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def bucket_of(prints: np.ndarray, buckets: int) -> np.ndarray:
    return (scramble(prints, 3) % np.uint64(buckets)).astype(np.int32)


def bloom_places(prints: np.ndarray, bits: int) -> np.ndarray:
    """Bit places of fingerprints, one row per hash function."""
    low, high = prints & np.uint64(0xFFFFFFFF), (prints >> np.uint64(32)) | np.uint64(1)
    return np.array([(low + np.uint64(i) * high) % np.uint64(bits) for i in range(BLOOM_HASHES)]).astype(np.int64)


def leading_bits(values: pa.Array) -> np.ndarray:
    """The first 64 bits of digests given as 32 hex digits."""
    digits = np.array(values.to_pylist(), dtype="S32").view(np.uint8).reshape(-1, 32)[:, :16]
    nibbles = np.where(digits >= 97, digits - 87, digits - 48).astype(np.uint64)
    return (nibbles << np.arange(60, -1, -4, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def set_prints(digests: pa.ListArray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of digest sets, the rarest digests first: place of the set, print to store, print to look up."""
    n = np.diff(digests.offsets.to_numpy()) * digests.is_valid().to_numpy(zero_copy_only=False)
    made = [(np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64))]
    if n.sum():
        first = leading_bits(digests.flatten())
        often = order[(first >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
        first = first[np.lexsort((first, often, np.repeat(np.arange(len(n)), n)))]
        starts = np.cumsum(n) - n
        for size in np.unique(n[n > 0]).tolist():
            rows = np.flatnonzero(n == size)
            sets, own = first[starts[rows][:, None] + np.arange(size)], size_class(size)
            for other, kept in winnow(size):
                d = sets[:, :kept].ravel()
                made.append((np.repeat(rows, kept), scramble(d, own << 16 | other), scramble(d, other << 16 | own)))
    return tuple(map(np.concatenate, zip(*made)))


def key_prints(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Place and fingerprint of the 16-byte keys that are not null."""
    rows = np.flatnonzero(keys.is_valid().to_numpy(zero_copy_only=False))
    held = np.frombuffer(b"".join(k for k in keys.to_pylist() if k is not None), dtype=np.uint64)
    return rows, scramble(held[::2], 0)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def units_of(prepared: DataFrame, *within: str) -> DataFrame:
    """Distinct units of entries, by the columns ``within``: keys (with null digests) and digest sets."""
    none = F.lit(None).cast("array<string>")
    both = F.array(F.struct(F.col("key").alias("unit"), none.alias("digests")), F.struct(F.col("set_id").alias("unit"), F.col("digests")))
    rows = prepared.select(*within, F.explode(both).alias("u")).select(*within, "u.*").where("unit IS NOT NULL")
    return rows.groupBy(*within, "unit").agg(F.any_value("digests").alias("digests"))


@dataclass
class Segment:
    """Part of a store: its number, how many entries, digests of entries and buckets it has, and the order of its digests."""

    number: int
    entries: int
    digests: int
    buckets: int
    order: np.ndarray

    def shared(self, spark: SparkSession) -> Broadcast:
        """The order, sent to each executor once: 1 MiB at any size of the store."""
        if not hasattr(self, "_shared"):
            self._shared = spark.sparkContext.broadcast(self.order)
        return self._shared


def count_order(rows: DataFrame) -> np.ndarray:
    """The order of digests by a count sketch: a place for each SKETCH_BITS first bits, with the binary logarithm of its count.

    What comes to the driver is the sketch, at most 2^SKETCH_BITS counters
    whatever the number of rows.
    """
    place = F.conv(F.substring("d", 1, SKETCH_BITS // 4), 16, 10).cast("int").alias("place")
    counted = rows.select(F.explode("digests").alias("d")).groupBy(place).count().toArrow()
    order = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    order[counted.column(0).to_numpy()] = np.log2(counted.column(1).to_numpy())
    return order


def batch_prints(units: DataFrame, stored: list[Segment]) -> DataFrame:
    """Fingerprints of units: of the batch itself (segment 0, fp and probe) and to look up in each stored segment.

    Among itself the batch takes the order of the largest segment; the first
    batch counts its own digests.
    """
    spark = units.sparkSession
    orders = [(s.number, s.shared(spark), s.buckets) for s in stored]
    own = orders[0][1] if stored else spark.sparkContext.broadcast(count_order(units))
    orders.insert(0, (0, own, 1))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, digests = batch.columns
            is_key = digests.is_null()
            where = np.flatnonzero(is_key.to_numpy(zero_copy_only=False))
            _, key_probe = key_prints(unit.filter(is_key))
            for number, order, buckets in orders:
                row, fp, probe = set_prints(digests, order.value)
                if number:  # equal keys of one batch meet by the key itself
                    row, fp, probe = np.r_[where, row], np.r_[key_probe, fp], np.r_[key_probe, probe]
                columns = [pa.array(np.full(len(row), number, np.int32)), unit.take(pa.array(row))]
                columns += [signed(fp), signed(probe), pa.array(bucket_of(probe, buckets))]
                yield pa.RecordBatch.from_arrays(columns, names=["segment", "unit", "fp", "probe", "bucket"])

    return units.select("unit", "digests").mapInArrow(pick, "segment int, unit binary, fp bigint, probe bigint, bucket int")


def covers(x: Column, y: Column) -> Column:
    """At least half of the digests found in either are found in both."""
    return 3 * F.size(F.array_intersect(x, y)) >= F.size(x) + F.size(y)


def parts_of(segment: str, part: str) -> Column:
    """The distinct (segment, part) of the rows with a segment, as an aggregate: at most as many as there are buckets."""
    return F.collect_set(F.when(F.col(segment) > 0, F.col(segment).cast("bigint") * MOST_BUCKETS + F.col(part)))


SCHEMAS = {
    "prints": "segment int, fp bigint, id bigint, home int",
    "entries": "id bigint, key binary, digests array<string>",
    "filters": "segment int, bucket int, bits binary",
}
MANIFEST = pa.schema(
    [("place", pa.int32()), ("segment", pa.int32()), ("entries", pa.int64()), ("digests", pa.int64()), ("buckets", pa.int32()), ("sketch", pa.binary())]
)


@dataclass
class Store:
    """Accepted entries and their fingerprints; see the module."""

    spark: SparkSession
    path: str
    version: int = 0
    segments: list[Segment] = field(default_factory=list)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Store:
        """The store as its last whole batch left it, in this or any later session."""
        rows = spark.read.parquet(f"{path}/manifest")
        last = rows.agg(F.max("version")).first()[0]
        held = sorted(rows.where(F.col("version") == last).collect(), key=lambda r: r["place"])
        segments = [
            Segment(r["segment"], r["entries"], r["digests"], r["buckets"], np.frombuffer(zlib.decompress(r["sketch"]), dtype=np.uint8)) for r in held if r["segment"]
        ]
        return cls(spark, path, last, segments)

    def commit(self, segments: list[Segment]) -> None:
        """Makes ``segments`` the store, by one new version of the manifest."""
        rows = [(n, s.number, s.entries, s.digests, s.buckets, zlib.compress(s.order.tobytes())) for n, s in enumerate(segments)]
        rows = rows or [(0, 0, 0, 0, 0, b"")]  # nothing accepted yet
        made = pa.BufferOutputStream()
        pq.write_table(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), MANIFEST.types)], schema=MANIFEST), made)
        write_file(self.spark, f"{self.path}/manifest/version={self.version + 1}/segments.parquet", made.getvalue().to_pybytes())
        self.version, self.segments = self.version + 1, segments

    def read(self, name: str, parts: list[int]) -> DataFrame:
        """The rows of ``parts`` as parts_of() gives them."""
        paths = [f"{self.path}/{p // MOST_BUCKETS}/{name}/part={p % MOST_BUCKETS}" for p in sorted(parts)]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    def screen(self, prints: DataFrame, parts: list[int] | None = None) -> DataFrame:
        """The distinct (segment, bucket, probe) that the bucket's Bloom filter may hold; ``parts`` of prints, where they are known."""
        probes = prints.where("segment > 0").select("segment", "bucket", "probe")
        filters = self.read("filters", probes.agg(parts_of("segment", "bucket")).first()[0] if parts is None else parts)

        def test(mine: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            if mine.empty or filters.empty:
                return mine.iloc[:0]
            held = np.frombuffer(filters["bits"].iloc[0], dtype=np.uint8)
            at = bloom_places(mine["probe"].to_numpy().view(np.uint64), 8 * len(held))
            return mine[(held[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=0)]

        keys = ["segment", "bucket"]
        return probes.distinct().groupBy(*keys).cogroup(filters.groupBy(*keys)).applyInPandas(test, "segment int, bucket int, probe bigint")

    def lookup(self, prints: DataFrame, parts: list[int], units: DataFrame) -> DataFrame:
        """(unit, id): accepted entries that share the key, or cover the set, of a unit.

        Only buckets that hold a positive are read, and of the entries only the
        buckets of ids that a positive names.
        """
        positive, noted = cut_noting(self.screen(prints, parts), parts=parts_of("segment", "bucket"))
        there = self.read("prints", noted["parts"])
        probe = ["segment", "probe"]
        hits = there.withColumnRenamed("fp", "probe").join(positive.select(*probe), probe)
        candidates, noted = cut_noting(prints.join(hits, probe).select("unit", "segment", "home", "id").distinct(), parts=parts_of("segment", "home"))
        held = self.read("entries", noted["parts"])
        joined = candidates.select("unit", "id").join(held, "id").join(units.withColumnRenamed("digests", "mine"), "unit")
        same = F.when(F.col("mine").isNull(), F.col("key") == F.col("unit")).otherwise(covers(F.col("mine"), F.col("digests")))
        return joined.where(same).select("unit", "id")

    def add(self, accepted: DataFrame, size: int, digests: int) -> None:
        """Adds ``size`` entries (id, key, digests), with the segments that are not much larger written into the same new one.

        A segment that takes in others counts its digests anew; one that holds
        this batch alone keeps the order of the largest segment.
        """
        kept, rows = list(self.segments), [accepted.select("id", "key", "digests")]
        while size and kept and kept[-1].entries < GROWTH * size:
            old = kept.pop()
            rows.append(self.spark.read.schema(SCHEMAS["entries"]).parquet(f"{self.path}/{old.number}/entries").select("id", "key", "digests"))
            size, digests = size + old.entries, digests + old.digests
        if size:
            merged = reduce(DataFrame.unionAll, rows)
            order = kept[0].order if kept and len(rows) == 1 else count_order(merged)
            made = Segment(self.version + 1, size, digests, min(MOST_BUCKETS, -(-(size + 3 * digests) // BUCKET_PRINTS)), order)
            self.write_segment(made, merged)
            kept.append(made)
        self.commit(kept)

    def write_segment(self, made: Segment, rows: DataFrame) -> None:
        """The files of a new segment of rows (id, key, digests); they are not part of the store before ``commit``."""
        path, number, buckets, order = f"{self.path}/{made.number}", made.number, made.buckets, made.shared(self.spark)

        def write(table: DataFrame, name: str) -> None:
            table.write.mode("overwrite").partitionBy("part").parquet(f"{path}/{name}")

        def read(name: str) -> DataFrame:
            return self.spark.read.schema(f"{SCHEMAS[name]}, part int").parquet(f"{path}/{name}")

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, fp, _ = set_prints(batch.column(2), order.value)
                key_row, key_fp = key_prints(batch.column(1))
                at, fps = pa.array(np.r_[key_row, row]), np.r_[key_fp, fp]
                columns = [pa.array(np.full(len(fps), number, np.int32)), signed(fps), batch.column(0).take(at), batch.column(3).take(at)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(bucket_of(fps, buckets))], names=["segment", "fp", "id", "home", "part"])

        def build(mine: pd.DataFrame) -> pd.DataFrame:
            held = np.zeros(-(-BLOOM_BITS * len(mine) // 64) * 8, dtype=np.uint8)
            at = np.unique(bloom_places(mine["fp"].to_numpy().view(np.uint64), 8 * len(held)))
            np.bitwise_or.at(held, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
            bucket = mine["part"].iloc[0]
            return pd.DataFrame({"segment": [number], "bucket": [bucket], "bits": [held.tobytes()], "part": [bucket]})

        write(rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")).hint("rebalance", "part"), "entries")
        prints = read("entries").mapInArrow(pick, f"{SCHEMAS['prints']}, part int")
        # A fingerprint that very many entries share makes its bucket large: such a bucket is written by several tasks.
        write(prints.hint("rebalance", "part").sortWithinPartitions("part", "fp"), "prints")
        distinct = read("prints").select("part", "fp").distinct()
        write(distinct.groupBy("part").applyInPandas(build, f"{SCHEMAS['filters']}, part int"), "filters")


def batch_links(prints: DataFrame, units: DataFrame) -> DataFrame:
    """(set_a, set_b), both ways: different digest sets of one batch that cover each other."""
    own = prints.where("segment = 0")
    meet = F.expr("a.probe = b.fp AND a.unit < b.unit")
    pairs = own.alias("a").join(own.alias("b"), meet).select(F.col("a.unit").alias("set_a"), F.col("b.unit").alias("set_b")).distinct()
    sets = units.where("digests IS NOT NULL")
    checked = pairs.join(sets.toDF("set_a", "x"), "set_a").join(sets.toDF("set_b", "y"), "set_b").where(covers(F.col("x"), F.col("y")))
    both = F.explode(F.array(F.struct("set_a", "set_b"), F.struct(F.col("set_b").alias("set_a"), F.col("set_a").alias("set_b"))))
    return checked.select(both.alias("p")).select("p.*")


def contenders(prepared: DataFrame, reach: DataFrame) -> DataFrame:
    """(entry_id, unit, own): what the entries that can still be accepted own, and the linked sets they reach.

    Of entries with equal key and set only the first can be accepted, and none
    of those that own a unit with a stored ``id`` in ``reach`` (unit, other, id).
    A unit an entry owns comes once for each set it is linked to, or else once.
    """
    first = prepared.where("key IS NOT NULL OR set_id IS NOT NULL").groupBy("key", "set_id").agg(F.min("entry_id").alias("entry_id"))
    stored = reach.where("id IS NOT NULL")
    for unit in ("key", "set_id"):
        first = first.join(stored.select(F.col("unit").alias(unit)), unit, "left_anti")
    own = first.select("entry_id", F.explode(F.array("key", "set_id")).alias("unit")).where("unit IS NOT NULL")
    near = own.join(reach.where("other IS NOT NULL").select("unit", "other"), "unit", "left")
    both = F.array(F.struct("unit", F.lit(True).alias("own")), F.struct(F.col("other").alias("unit"), F.lit(False).alias("own")))
    return near.select("entry_id", F.explode(both).alias("r")).select("entry_id", "r.*").where("unit IS NOT NULL")


def first_come(spark: SparkSession, reached: DataFrame, path: str) -> DataFrame:
    """entry_id of those accepted when the contenders are taken in order of entry_id.

    In each round an entry looks at the first owner, not yet out, of each unit it
    reaches: if none comes before it, it is accepted; if the earliest of them is
    accepted, it is out; else it waits. Rounds are as many as the longest chain
    of entries that wait for each other. Entries of one unit wait for its first
    owner and are never paired.
    """
    left, number = reached, 0
    while True:
        first = left.where("own").groupBy("unit").agg(F.min("entry_id").alias("first"))
        seen = left.join(first, "unit").groupBy("entry_id").agg(F.min("first").alias("before"))
        waiting = Observation()
        seen.observe(waiting, F.count_if(F.expr("before < entry_id")).alias("n")).write.mode("overwrite").parquet(f"{path}/{number}")
        state = spark.read.schema("entry_id bigint, before bigint").parquet(f"{path}/{number}")
        won = state.where("before = entry_id").select(F.col("entry_id").alias("before"))
        if waiting.get["n"] == 0 or state.where("before < entry_id").join(won, "before", "left_anti").isEmpty():
            return won.select(F.col("before").alias("entry_id"))
        out = state.where("before < entry_id").join(won, "before").select("entry_id")
        left = reached.join(state.select("entry_id").join(out, "entry_id", "left_anti"), "entry_id", "left_semi")
        number += 1


def accept_batch(store: Store, prepared: DataFrame, units: DataFrame) -> DataFrame:
    """Checks a prepared batch, with its units, against the store, adds what is accepted, and gives (accepted_id, entry_id).

    What the driver needs to know of a table is noted while that is written:
    each Spark action less is memory and time of the driver, whatever the size.

    A batch that failed on the way has changed nothing and is given again.
    """
    spark, path = store.spark, f"{store.path}/found/version={store.version + 1}"
    prints, noted = cut_noting(batch_prints(units, store.segments), parts=parts_of("segment", "bucket"))
    reach = batch_links(prints, units).select(F.col("set_a").alias("unit"), F.col("set_b").alias("other"), F.lit(None).cast("bigint").alias("id"))
    if store.segments:
        reach = reach.unionByName(store.lookup(prints, noted["parts"], units), allowMissingColumns=True)
    reach = cut(reach)
    won = first_come(spark, cut(contenders(prepared, reach)), scratch_path(spark, "rounds"))
    unnamed = prepared.where("key IS NULL AND set_id IS NULL").select("entry_id")
    kept = prepared.join(won.unionAll(unnamed), "entry_id", "left_semi").select(F.col("entry_id").alias("id"), "key", "set_id", "digests")
    accepted, sizes = cut_noting(kept, entries=F.count("*"), digests=F.coalesce(F.sum(F.size("digests")), F.lit(0)))

    owned = accepted.select("id", F.explode(F.array("key", "set_id")).alias("unit")).where("unit IS NOT NULL").select("unit", "id")
    near = reach.where("other IS NOT NULL").select(F.col("unit").alias("to"), F.col("other").alias("unit")).join(owned, "unit").select("to", "id")
    now = owned.unionAll(near).withColumn("stored", F.lit(False))
    hits = now.unionAll(reach.where("id IS NOT NULL").select("unit", "id", F.lit(True)))
    asked = prepared.select("entry_id", F.explode(F.array("key", "set_id")).alias("unit"))
    found = asked.join(hits, "unit").where("stored OR id < entry_id").select(F.col("id").alias("accepted_id"), "entry_id")
    found.distinct().write.mode("overwrite").parquet(path)
    store.add(accepted, sizes["entries"], sizes["digests"])
    return spark.read.schema("accepted_id bigint, entry_id bigint").parquet(path)


def add_batch(store: Store, entries: DataFrame) -> DataFrame:
    """One arriving batch of intake entries against an open store: (accepted_id, entry_id)."""
    prepared = cut(prepare(entries).drop("batch_no"))
    return accept_batch(store, prepared, cut(units_of(prepared)))


def repeated_entries(entries: DataFrame) -> DataFrame:
    """(accepted_id, entry_id) over all batches in order of batch_no and entry_id, through one store.

    A null batch_no comes first. Batches are listed on the driver and taken one
    after the other; each reads only its own rows and what its positives touch.
    What does not depend on the store, the units of each batch, is made before.
    An empty table gives no rows.
    """
    spark = entries.sparkSession
    path = scratch_path(spark, "intake")

    def by_batch(name: str, rows: DataFrame) -> DataFrame:
        rows.write.partitionBy("batch_no").parquet(f"{path}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{path}/{name}")

    prepared = by_batch("prepared", prepare(entries))
    units = by_batch("units", units_of(prepared, "batch_no"))
    store = Store(spark, f"{path}/store")
    for number in sorted(r[0] for r in prepared.select("batch_no").distinct().collect()):
        accept_batch(store, *(rows.where(F.col("batch_no") == number).drop("batch_no") for rows in (prepared, units)))
    found = [f"{store.path}/found/version={v + 1}" for v in range(store.version)]
    schema = "accepted_id bigint, entry_id bigint"
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)
