"""Near-duplicate records with small edits (problem 3): a chosen-path join.

Records are sets of word shingles. Each set is embedded once into COORDINATES
MinHash values; two sets agree on one with probability equal to their Jaccard
similarity. A run sends every set into the bucket named by one sampled value, a
token that the members of the bucket share. Buckets of at most BUCKET sets are
compared by brute force; larger ones are split again on further values sampled
for that bucket, which are taken from the set's 256-bit sketch (4 bits of each
MinHash value), up to LEVELS times. Each split costs recall, so the splits that
took place are counted, and runs are repeated for the sets that need more until
a pair at the threshold is met with the target recall; each repetition embeds
those sets anew, so its values are independent of the ones before. Pairs that
meet are screened by the sketch inside the join and verified exactly on their texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnset.session import cut

COORDINATES = 64  #: MinHash values per set; each gives 4 bits of the sketch
MOST_RUNS = 16  #: runs of one embedding at most, each named by one value; the other values split large buckets
BUCKET = 1024  #: a bucket of at most so many sets is compared by brute force
HOT_BUCKETS = 10_000  #: at most so many buckets are split before their rows are brought together
FANOUT = 4  #: pairs of values sampled in each bucket that is split again
LEVELS = 4  #: splits of a bucket at most; what is left then is compared in blocks of BUCKET by BUCKET sets
TARGET_RECALL = 0.98  #: of pairs exactly at the threshold, however often their buckets are split
SWEPT_ROWS = 60_000  #: rows that a task compares in one go; speed only
RUN = 255  #: low bits of a bucket that hold its run
SCREEN_SIGMAS = 3.5  #: pairs at the threshold pass the sketch but for so many standard deviations
PAIR_BLOCK = 1_000  #: pairs of a large group are made in blocks of about so many by so many records

WORD = re.compile("[a-z0-9]+")  #: fixed value: a word of a lower-cased text
WORDS_KEPT = 300_000  #: word hashes kept per task; speed only


class WordHashes(dict):
    """64-bit hash by word, computed on first use."""

    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """Scrambles 64-bit values."""
    x = (x ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def embed(texts: DataFrame, size: int, least_words: int, runs: int, seed: int = 0) -> DataFrame:
    """Texts (id, text) become id, seq_a and seq_b (a hash of the words in order), mins of each run, and the sketch s0 to s3.

    Another ``seed`` gives independent values.

    Texts of fewer than ``least_words`` words, null and empty ones among them,
    are left out. Whole texts are read once, in Arrow batches.
    """
    rng = np.random.default_rng(7 + seed)
    factors = rng.integers(1, 1 << 31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    names = ["id", "seq_a", "seq_b", "mins", "s0", "s1", "s2", "s3"]
    least = max(least_words, size)

    def some(codes: list[int], ends: list[int]) -> tuple[np.ndarray, ...]:
        flat = np.array(codes, dtype=np.uint64)
        stops = np.array(ends)
        starts = np.r_[0, stops[:-1]]
        place = (np.arange(len(flat)) - np.repeat(starts, stops - starts)).astype(np.uint64)
        ordered = flat + place * np.uint64(0xD1342543DE82EF95)
        runs_of_words = np.r_[flat, np.zeros(size, np.uint64)]
        shingles = runs_of_words[: len(flat)].copy()
        for k in range(1, size):
            shingles = shingles * np.uint64(0x9FB21C651E98DF25) + runs_of_words[k : k + len(flat)]
        # Every other segment holds the runs that would reach into the next text.
        segments = np.column_stack([starts, stops - size + 1]).ravel() if size > 1 else starts
        step = 2 if size > 1 else 1
        base = (mix(shingles, 0) >> np.uint64(32)).astype(np.uint32)
        mins = np.empty((len(starts), COORDINATES), dtype=np.uint32)
        hashed = np.empty_like(base)
        for k in range(COORDINATES):
            np.multiply(base, factors[k], out=hashed)
            mins[:, k] = np.minimum.reduceat(hashed, segments)[::step]
        return np.add.reduceat(mix(ordered, 1), starts), np.bitwise_xor.reduceat(mix(ordered, 2), starts), mins

    def embed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            kept, made, codes, ends = [], [], [], []
            if len(hashes) > WORDS_KEPT:
                hashes.clear()
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = WORD.findall(text.lower()) if text else []
                if len(words) < least:
                    continue
                codes += map(hashes.__getitem__, words)
                kept.append(i)
                ends.append(len(codes))
                if len(codes) > 32_768:  # what fits into the processor's cache
                    made.append(some(codes, ends))
                    codes, ends = [], []
            if ends:
                made.append(some(codes, ends))
            if not made:
                continue
            a, b, mins = (np.concatenate(x) for x in zip(*made))
            nibbles = (mins >> np.uint32(8) & np.uint32(15)).astype(np.uint64).reshape(-1, 4, 16)
            sketch = (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64).view(np.int64)
            paths = np.ascontiguousarray(mins[:, :runs]).view(np.int32)
            offsets = pa.array(np.arange(0, paths.size + 1, runs, dtype=np.int32))
            columns = [
                batch.column(0).take(pa.array(kept)),
                pa.array(a.view(np.int64)),
                pa.array(b.view(np.int64)),
                pa.ListArray.from_arrays(offsets, pa.array(paths.ravel())),
                *[pa.array(np.ascontiguousarray(sketch[:, k])) for k in range(4)],
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "id bigint, seq_a bigint, seq_b bigint, mins array<int>, s0 bigint, s1 bigint, s2 bigint, s3 bigint"
    return texts.select("id", "text").mapInArrow(embed_batches, schema)


def met(threshold: float, splits: int, agree: float | None = None) -> float:
    """Chance that a pair at the threshold is compared in a run that splits its bucket so many times.

    ``agree`` is the share of the split values that agree; as expected if not
    given. Of the FANOUT branches of a split each goes on if both values agree,
    so the chances do not simply multiply.
    """
    agree, below = threshold + (1 - threshold) / 16 if agree is None else agree, 1.0
    for _ in range(splits):
        below = 1 - (1 - agree**2 * below) ** FANOUT
    return threshold * below


@lru_cache(maxsize=None)
def run_loss(threshold: float, splits: int, recall: float) -> float:
    """By how much the logarithm of the chance to miss a pair falls with a run of so many splits.

    The runs of one embedding split by the same values, of which more or fewer
    agree from pair to pair. So the chance to miss is taken over that spread, and
    a run counts as its share of those it takes to reach the recall.
    """
    n, p = COORDINATES - MOST_RUNS, threshold + (1 - threshold) / 16
    shares = [(math.comb(n, x) * p**x * (1 - p) ** (n - x), met(threshold, splits, x / n)) for x in range(n + 1)]

    def missed(runs: float) -> float:
        return sum(w * (1 - m) ** runs for w, m in shares)

    few, many = 0.0, 1.0
    while missed(many) > 1 - recall:
        many *= 2
    for _ in range(50):
        few, many = ((few + many) / 2, many) if missed((few + many) / 2) > 1 - recall else (few, (few + many) / 2)
    return -math.log(1 - recall) / many


def runs_needed(threshold: float, recall: float) -> int:
    """Runs of the first round: enough where no bucket is split more than once. ``repeated_runs`` adds to them."""
    return min(MOST_RUNS, math.ceil(-math.log(1 - recall) / run_loss(threshold, 1, recall)))


def agreements(a: str, b: str) -> Column:
    """How many of the 64 four-bit values of two sketches agree."""
    ones = F.lit(0x1111111111111111)

    def differing(k: int) -> Column:
        x = F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))
        any_bit = reduce(lambda y, s: y.bitwiseOR(F.shiftrightunsigned(x, s)), (1, 2, 3), x)
        return F.bit_count(any_bit.bitwiseAND(ones))

    return F.lit(COORDINATES) - reduce(lambda x, y: x + y, map(differing, range(4)))


def least_agreements(threshold: float, values: int = COORDINATES) -> int:
    """Agreements of ``values`` that a pair at the threshold has but for SCREEN_SIGMAS standard deviations."""
    p = threshold + (1 - threshold) / 16
    return math.floor(values * p - SCREEN_SIGMAS * math.sqrt(values * p * (1 - p)))


def compare_buckets(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs of buckets of at most BUCKET sets that pass the sketch, and the rows of larger buckets.

    Rows (bucket, id, s0 to s3) are brought together by bucket and sorted, and
    one pass over each partition compares every row with those that follow it in
    its bucket. Never more than about SWEPT_ROWS and BUCKET rows are held. Pairs come out
    as (null, id_a, id_b), rows of larger buckets as (bucket, id, null, s0 to s3).
    """
    least, size = least_agreements(threshold), BUCKET
    least_half = least_agreements(threshold, COORDINATES // 2)
    ones = np.uint64(0x1111111111111111)

    def agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        d = x ^ y
        d |= d >> np.uint64(1)
        d |= d >> np.uint64(2)
        return 16 * x.shape[1] - np.bitwise_count(d & ones).sum(axis=1, dtype=np.int64)

    def sweep(held: np.ndarray) -> pa.RecordBatch:
        """Rows sorted by bucket, all buckets whole (or cut off beyond size)."""
        bucket, ids = np.ascontiguousarray(held[:, 0]), held[:, 1]
        sketch = np.ascontiguousarray(held[:, 2:]).view(np.uint64)
        half = np.ascontiguousarray(sketch[:, :2])
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        n = np.diff(np.r_[starts, len(bucket)])
        many = np.repeat(n > size, n)
        left, right, at = [], [], np.flatnonzero(~many)
        for d in range(1, size):
            at = at[at + d < len(bucket)]
            at = at[bucket[at] == bucket[at + d]]
            if not len(at):
                break
            near = at[agree(half[at], half[at + d]) >= least_half]
            near = near[agree(sketch[near], sketch[near + d]) >= least]
            left.append(ids[near])
            right.append(ids[near + d])
        none = np.empty(0, dtype=np.int64)
        a, b = np.concatenate([none, *left]), np.concatenate([none, *right])
        return together(np.minimum(a, b), np.maximum(a, b), held[many])

    def together(a: np.ndarray, b: np.ndarray, large: np.ndarray) -> pa.RecordBatch:
        mask = np.r_[np.ones(len(a), bool), np.zeros(len(large), bool)]
        pad = np.zeros(len(a), dtype=np.int64)
        columns = [pa.array(np.r_[pad, large[:, 0]], mask=mask), pa.array(np.r_[a, large[:, 1]])]
        columns += [pa.array(np.r_[b, np.zeros(len(large), np.int64)], mask=~mask)]
        columns += [pa.array(np.r_[pad, large[:, k]], mask=mask) for k in range(2, 6)]
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "id", "other", "s0", "s1", "s2", "s3"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        held, n = [], 0
        for batch in batches:
            held.append(np.column_stack([c.to_numpy() for c in batch.columns]))
            n += len(held[-1])
            if n >= SWEPT_ROWS:
                yield np.concatenate(held)
                held, n = [], 0
        if n:
            yield np.concatenate(held)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.empty((0, 6), dtype=np.int64)
        over = None  # a large bucket whose first rows have gone out
        none = np.empty(0, dtype=np.int64)
        for rows in gathered(batches):
            if over is not None:
                more = rows[:, 0] == over
                if more.any():
                    yield together(none, none, rows[more])
                    rows = rows[~more]
            held = np.concatenate([kept, rows])
            if not len(held):
                continue
            last = int(np.searchsorted(held[:, 0], held[-1, 0], "left"))
            if len(held) - last > size:
                over, last = int(held[-1, 0]), len(held)
            if last:
                yield sweep(held[:last])
            kept = held[last:]
        if len(kept):
            yield sweep(kept)

    columns = ["bucket", "id", "s0", "s1", "s2", "s3"]
    schema = "bucket bigint, id bigint, other bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint"
    return rows.select(columns).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(compare, schema)


def split_rows(rows: DataFrame, level: int, runs: int) -> DataFrame:
    """Rows of large buckets in the buckets below, by FANOUT pairs of sketch values sampled for each bucket."""
    sketch = ["s0", "s1", "s2", "s3"]

    def sampled(k: int) -> Column:
        place = F.pmod(F.xxhash64("bucket", F.lit(level), F.lit(k)), F.lit(COORDINATES - runs)) + runs
        return place.cast("int")

    pairs = F.array(*[F.struct(sampled(2 * k).alias("i"), sampled(2 * k + 1).alias("j")) for k in range(FANOUT)])
    chosen = rows.select("id", "bucket", *sketch, F.explode(F.array_distinct(pairs)).alias("p"))
    values = [sketch_value(F.col("p.i")), sketch_value(F.col("p.j"))]
    return chosen.select(with_run(F.xxhash64("bucket", "p", *values), F.col("bucket")).alias("bucket"), "id", *sketch)


def with_run(bucket: Column, run: Column) -> Column:
    """A bucket whose low bits are those of ``run``."""
    return bucket.bitwiseAND(F.lit(~RUN)).bitwiseOR(run.cast("bigint").bitwiseAND(F.lit(RUN)))


def hot_buckets(rows: DataFrame) -> DataFrame:
    """Buckets that hold a large part of all rows, judged by the ids of every 64th hash.

    Their rows are split before they are brought together, so that no task gets
    them whole. At most HOT_BUCKETS can reach the share; a wrong guess costs only
    time, as every bucket is either compared or split, and each split is counted.
    """
    counted = rows.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(64)) == 0).groupBy("bucket").count()
    total = counted.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    return counted.where(F.col("count") > max(BUCKET, total / HOT_BUCKETS)).select("bucket")


def chosen_path_pairs(sets: DataFrame, threshold: float, runs: int) -> tuple[DataFrame, list[DataFrame]]:
    """Candidate pairs of ``sets`` (id, mins, s0 to s3), and the splits that took place as rows (id, run, at).

    ``mins`` names the buckets, one run for each value; splits sample the values
    from ``runs`` on. ``at`` is one bit for each time that rows are split.
    """
    sketch = ["s0", "s1", "s2", "s3"]
    named = sets.select("id", *sketch, F.posexplode("mins").alias("r", "m"))
    rows = named.select(with_run(F.xxhash64("r", "m"), F.col("r")).alias("bucket"), "id", *sketch)
    found, splits = [], []

    def note(split: DataFrame, at: int) -> None:
        splits.append(split.select("id", F.col("bucket").bitwiseAND(F.lit(RUN)).alias("run"), F.lit(1 << at).alias("at")))

    for level in range(LEVELS):
        hot = [tuple(r) for r in hot_buckets(rows).limit(HOT_BUCKETS).collect()]
        if hot:
            known = F.broadcast(rows.sparkSession.createDataFrame(hot, "bucket bigint"))
            cold = rows.join(known, "bucket", "left_anti")
            split = rows.join(known, "bucket", "left_semi")
            note(split, level + LEVELS)
            rows = cold.unionAll(split_rows(split, level + LEVELS, runs))
        compared = cut(compare_buckets(rows, threshold))
        found.append(compared.where("id < other").select(F.col("id").alias("id_a"), F.col("other").alias("id_b")))
        large = compared.where("other IS NULL").select("bucket", "id", *sketch)
        if large.isEmpty():
            break
        note(large, level)
        rows = split_rows(large, level, runs)
    else:
        leaves = cut(rows)
        n = leaves.groupBy("bucket").agg(F.ceil(F.count("*") / BUCKET).alias("n_a")).withColumn("n_b", F.col("n_a"))
        counted = leaves.join(n.withColumn("same", F.lit(True)), "bucket")
        found.append(in_blocks(counted, counted, ["bucket"], sketch, agreements("x", "y") >= least_agreements(threshold)).toDF("id_a", "id_b"))
    return reduce(DataFrame.unionAll, found), splits


def short_of_recall(sets: DataFrame, splits: list[DataFrame], threshold: float, recall: float, runs: int) -> DataFrame:
    """Sets (id, loss, deepest) that have not yet reached the recall after ``runs`` more runs.

    ``sets`` has id and loss, the logarithm of the chance to miss a pair at the
    threshold in the runs before. A run counts with all the times that any of a
    set's rows were split in it, which is at least the number on any one path. A
    pair is missed no more often than either of its sets allows, so it is enough
    to go on with pairs of sets that are both short.
    """
    loss = [-run_loss(threshold, k, recall) for k in range(2 * LEVELS + 1)]
    more = F.get(F.array(*[F.lit(x - loss[0]) for x in loss]), F.col("times"))
    times = F.bit_count(F.bit_or("at")).alias("times")
    by_run = reduce(DataFrame.unionAll, splits).groupBy("id", "run").agg(times)
    split = by_run.groupBy("id").agg(F.sum(more).alias("more"), F.max("times").alias("deepest"))
    after = F.col("loss") + runs * loss[0] + F.coalesce("more", F.lit(0.0))
    all_short = sets.join(split, "id", "left").select("id", after.alias("loss"), F.coalesce("deepest", F.lit(0)).alias("deepest"))
    return all_short.where(F.col("loss") > math.log(1 - recall) + 1e-9)


def repeated_runs(
    sets: DataFrame, again: Callable[[DataFrame, int], DataFrame], threshold: float, recall: float, runs: int
) -> DataFrame:
    """Distinct candidate pairs of ``sets`` (id, mins, s0 to s3), with as many runs as their splits call for.

    The first ``runs`` values of ``mins`` name the buckets of all sets; those that
    come short of the recall go through further runs among themselves, embedded
    anew by ``again`` (ids and the number of the round).
    """
    allowed, rounds, found = math.log(1 - recall), 0, []
    left = sets.select("id", F.lit(0.0).alias("loss"))
    while True:
        now = sets.withColumn("mins", F.slice("mins", 1, runs))
        pairs, splits = chosen_path_pairs(now, threshold, runs)
        found.append(pairs)
        if not rounds and len(splits) <= 1 and runs * -run_loss(threshold, len(splits), recall) <= allowed + 1e-9:
            break  # nobody was split more often than the first round allows for
        nothing = left.select("id", F.lit(0).cast("bigint").alias("run"), F.lit(0).alias("at")).limit(0)
        left = cut(short_of_recall(left, [nothing, *splits], threshold, recall, runs))
        worst, deepest = left.agg(F.max("loss"), F.max("deepest")).first()
        if worst is None:
            break
        rounds += 1
        runs = min(MOST_RUNS, math.ceil((worst - allowed) / run_loss(threshold, deepest, recall)))
        left = left.select("id", "loss")
        sets = cut(again(left.select("id"), rounds))
    return reduce(DataFrame.unionAll, found).distinct()


def sketch_value(i: Column) -> Column:
    """The i-th of the 64 four-bit values of a sketch."""
    word = F.get(F.array("s0", "s1", "s2", "s3"), F.floor(i / 16).cast("int"))
    return F.call_function("shiftrightunsigned", word, (i % 16) * 4).bitwiseAND(F.lit(15))


def verify_pairs(pairs: DataFrame, texts: DataFrame, threshold: float, size: int) -> DataFrame:
    """The pairs whose Jaccard similarity of shingles, from the texts (id, text), reaches the threshold.

    A task takes the pairs of one text after the other and makes its shingles once.
    """

    def runs_of(text: str) -> set[tuple[str, ...]]:
        words = WORD.findall(text.lower())
        return set(zip(*[words[k:] for k in range(size)]))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, y = None, set()
        for batch in batches:
            same = []
            for a, b, i in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(1).to_pylist()):
                if i != last:
                    last, y = i, runs_of(b)
                x = runs_of(a)
                common = len(x & y)
                same.append(common >= threshold * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(same, pa.bool_()))

    ends = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    needed = ends.join(texts, "id")
    both = pairs.join(needed.toDF("id_a", "text_a"), "id_a").join(needed.toDF("id_b", "text_b"), "id_b")
    ordered = both.select("id_a", "id_b", "text_a", "text_b").sortWithinPartitions("id_b")
    return ordered.mapInArrow(verify, "id_a bigint, id_b bigint")


def equal_texts(embedded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first record of each class of equal texts, with its size, and members (id, rep, copies).

    Records with the same words in the same order are one class, represented by
    the smallest id. The work of a class is in proportion to its size.
    """
    first = F.min(F.struct("id", "mins", "s0", "s1", "s2", "s3")).alias("first")
    equal = cut(embedded.groupBy("seq_a", "seq_b").agg(first, F.count("*").alias("copies")))
    classes = equal.select("seq_a", "seq_b", F.col("first.id").alias("rep"), "copies")
    return equal, embedded.select("id", "seq_a", "seq_b").join(classes, ["seq_a", "seq_b"]).select("id", "rep", "copies")


def similar_texts(
    texts: DataFrame, threshold: float, size: int, least_words: int, recall: float | None = None
) -> tuple[DataFrame, DataFrame]:
    """Links between representatives of equal texts (id_a < id_b), and members (id, rep, copies).

    ``texts`` holds id and text. Texts of fewer than ``least_words`` words, or
    fewer than ``size``, take no part. The recall aimed at is TARGET_RECALL if none is given.
    """
    recall = TARGET_RECALL if recall is None else recall
    runs = runs_needed(threshold, recall)
    equal, members = equal_texts(cut(embed(texts, size, least_words, MOST_RUNS)))
    members = cut(members)

    def again(ids: DataFrame, number: int) -> DataFrame:
        return embed(texts.join(ids, "id"), size, least_words, MOST_RUNS, number).drop("seq_a", "seq_b")

    candidates = repeated_runs(equal.select("first.*"), again, threshold, recall, runs)
    return cut(verify_pairs(candidates, texts, threshold, size)), members


def in_blocks(left: DataFrame, right: DataFrame, keys: list[str], carried: list[str] | None = None, keep: Column | None = None) -> DataFrame:
    """Pairs (a, b) of a ``left`` and a ``right`` row that agree on ``keys``, at most one block by one block in a task.

    Both sides hold the keys, id, and n_a and n_b, the number of blocks into which
    each side of the key is cut. Where both are the same set (``same``), each pair
    comes once. ``keep`` chooses pairs by the ``carried`` columns, as x and y.
    """
    own = lambda n: F.pmod(F.xxhash64("id", F.lit(5)), F.col(n))
    every = lambda n, first=0: F.explode(F.sequence(F.lit(first).cast("bigint"), F.col(n) - 1))
    both = (lambda name: [F.struct(*carried).alias(name)]) if carried else (lambda name: [])
    x = left.select(*keys, "same", *both("x"), F.col("id").alias("a"), own("n_a").alias("i"), every("n_b").alias("j"))
    y = right.select(*keys, *both("y"), F.col("id").alias("b"), own("n_b").alias("j"), every("n_a").alias("i"))
    # Of the same set only blocks with i <= j meet, and in one block only a < b.
    once = F.expr("NOT same OR i < j OR (i = j AND a < b)")
    met_once = x.where("NOT same OR i <= j").join(y, [*keys, "i", "j"]).where(once)
    return (met_once if keep is None else met_once.where(keep)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def every_pair(links: DataFrame, members: DataFrame) -> DataFrame:
    """Every pair (a < b) of linked or equal records, in groups of any size.

    What is written grows with the square of a group; ``links`` and ``members``
    say the same in proportion to the records. Large groups are cut into blocks,
    so that no task gets all pairs of one.
    """
    sizes = members.where("id = rep").select("rep", F.ceil(F.col("copies") / PAIR_BLOCK).alias("n"), "copies")
    equal = sizes.where("copies > 1").selectExpr("rep AS id_a", "rep AS id_b", "n AS n_a", "n AS n_b", "true AS same")
    n = sizes.select("rep", "n")
    linked = links.join(n.toDF("id_a", "n_a"), "id_a").join(n.toDF("id_b", "n_b"), "id_b")
    both = linked.withColumn("same", F.lit(False)).unionByName(equal)
    grouped = members.select("id", "rep")
    left = both.join(grouped.toDF("id", "id_a"), "id_a")
    right = both.drop("same").join(grouped.toDF("id", "id_b"), "id_b")
    return in_blocks(left, right, ["id_a", "id_b"])


def claim_texts(claims: DataFrame) -> DataFrame:
    """id and text of each claim: title, one space, raw text; nulls are empty."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "raw_text")]
    return claims.where("claim_ord IS NOT NULL").select(F.col("claim_ord").alias("id"), F.concat_ws(" ", *parts).alias("text"))


def similar_claims(claims: DataFrame, threshold: float = 0.5, size: int = 3, least_words: int = 20) -> tuple[DataFrame, DataFrame]:
    """Links and members of claims that largely say the same; see ``similar_texts``.

    Whole texts count. Null and empty texts have no words and match nothing.
    """
    return similar_texts(claim_texts(claims), threshold, size, least_words)


def claim_members(claims: DataFrame, size: int = 3, least_words: int = 20) -> DataFrame:
    """Members (id, rep, copies) alone, without the search for links; one row per claim of enough words."""
    return equal_texts(cut(embed(claim_texts(claims), size, least_words, 1)))[1]
