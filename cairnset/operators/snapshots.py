"""What changed between consecutive full snapshots (gaps and islands)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnset.functions.digest import blank_to_null, canonical_digest

#: Up to so many distinct snapshot numbers are sent to every task; beyond, they are joined by shuffle.
BROADCAST_SNAPSHOTS = 50_000


def snapshot_index(df: DataFrame, snapshot: str) -> DataFrame:
    """The distinct snapshot numbers with their rank, next and last rank.

    One row per snapshot, so the window over all of them is as small as the
    number of deliveries. Null numbers belong to no snapshot.
    """
    distinct = df.select(snapshot).where(F.col(snapshot).isNotNull()).distinct()
    order = W.orderBy(snapshot)
    return distinct.select(
        snapshot,
        F.row_number().over(order).alias("snap_idx"),
        F.lead(snapshot).over(order).alias("next_snapshot"),
    )


def _with_index(df: DataFrame, index: DataFrame, snapshot: str) -> DataFrame:
    """Adds rank and successor of the snapshot; broadcasts only a checked size."""
    known = index.limit(BROADCAST_SNAPSHOTS + 1).collect()
    if len(known) <= BROADCAST_SNAPSHOTS:
        small = df.sparkSession.createDataFrame(known, index.schema)
        return df.join(F.broadcast(small), snapshot)
    return df.join(index, snapshot)


def current_rows(df: DataFrame, snapshot: str, key: str, order: str, keep: list[str]) -> DataFrame:
    """Per snapshot and key the row with the largest ``order``; null keys are left out.

    A plain aggregation with partial maxima, so a key that holds a third of all
    rows arrives as one row per input task.
    """
    best = F.max(F.struct(F.col(order), *[F.col(c) for c in keep])).alias("best")
    return (
        df.where(F.col(key).isNotNull() & F.col(snapshot).isNotNull())
        .groupBy(snapshot, key)
        .agg(best)
        .select(snapshot, key, f"best.{order}", *[f"best.{c}" for c in keep])
    )


def member_set_state(members: DataFrame, owner: str, member: Column) -> DataFrame:
    """Per owner an order-free state of the set of its non-null members.

    Members travel as two 64-bit hashes, of which the second reads the member from
    another start, so members that agree in one differ in the other. Repeats vanish in a first aggregation
    on (owner, member), which also spreads an owner with very many members.
    """
    hashed = (
        members.select(owner, member.alias("_m"))
        .where(F.col("_m").isNotNull() & F.col(owner).isNotNull())
        .select(owner, F.xxhash64("_m").alias("_x"), F.xxhash64(F.lit(1), "_m").alias("_y"))
    )
    return (
        hashed.distinct()
        .groupBy(owner)
        .agg(
            F.count(F.lit(1)).alias("set_n"),
            F.bit_xor("_x").alias("set_x"),
            F.bit_xor("_y").alias("set_y"),
        )
    )


def row_hash(*state: Column) -> Column:
    """128-bit hash of a row's state; null differs from every text, and nulls agree."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in state]
    return F.unhex(F.md5(F.concat_ws("|", *[F.regexp_replace(p, r"([\\|])", r"\\$1") for p in parts])))


def validity_intervals(states: DataFrame, key: str, snapshot: str = "snapshot_no") -> DataFrame:
    """Islands of equal ``row_hash`` per key over consecutive snapshots.

    ``states`` holds one row per key and snapshot with ``snap_idx``,
    ``next_snapshot`` and ``row_hash``. A key has at most one row per snapshot,
    so each window is as long as the number of snapshots, never longer.

    Gives per interval the first and last snapshot, what follows
    (``next_snapshot`` after the last one, null at the newest) and whether the
    interval before or after touches it.
    """
    by_key = W.partitionBy(key).orderBy("snap_idx")
    seen = states.select(
        key,
        snapshot,
        "snap_idx",
        "next_snapshot",
        F.lag("snap_idx").over(by_key).alias("_before"),
        F.lead("snap_idx").over(by_key).alias("_after"),
        F.lag("row_hash").over(by_key).alias("_hash_before"),
        F.lead("row_hash").over(by_key).alias("_hash_after"),
        "row_hash",
    )
    touches_before = F.coalesce(F.col("_before") == F.col("snap_idx") - 1, F.lit(False))
    touches_after = F.coalesce(F.col("_after") == F.col("snap_idx") + 1, F.lit(False))
    edges = seen.select(
        key,
        snapshot,
        "snap_idx",
        "next_snapshot",
        touches_before.alias("touches_before"),
        touches_after.alias("touches_after"),
        (~(touches_before & F.col("_hash_before").eqNullSafe(F.col("row_hash")))).alias("starts"),
        (~(touches_after & F.col("_hash_after").eqNullSafe(F.col("row_hash")))).alias("ends"),
    ).where("starts OR ends")
    # Only first and last rows of islands are left: a start is followed by its own end.
    closing = F.when(F.col("ends"), F.struct(snapshot, "next_snapshot", "touches_after")).otherwise(
        F.lead(F.struct(snapshot, "next_snapshot", "touches_after")).over(by_key)
    )
    return (
        edges.withColumn("_end", closing)
        .where("starts")
        .select(
            key,
            F.col(snapshot).alias("valid_from"),
            F.col(f"_end.{snapshot}").alias("valid_to"),
            F.col("_end.next_snapshot").alias("ended_before"),
            F.col("snap_idx").alias("from_idx"),
            "touches_before",
            F.col("_end.touches_after").alias("touches_after"),
        )
    )


def change_events(intervals: DataFrame, key: str, snapshot: str = "snapshot_no") -> DataFrame:
    """Turns interval starts, ends and adjacencies into change events.

    A start that touches the interval before it is a change; any other start is
    an addition, unless it lies in the very first snapshot. An end that nothing
    touches is a removal in the next snapshot, unless there is none.
    """
    started = F.when(F.col("touches_before"), "changed").when(F.col("from_idx") > 1, "added")
    ended = F.when(~F.col("touches_after") & F.col("ended_before").isNotNull(), "removed")
    both = F.array(
        F.struct(F.col("valid_from").alias(snapshot), started.alias("change_kind")),
        F.struct(F.col("ended_before").alias(snapshot), ended.alias("change_kind")),
    )
    return (
        intervals.select(key, F.explode(both).alias("e"))
        .where("e.change_kind IS NOT NULL")
        .select(F.col(f"e.{snapshot}").alias(snapshot), key, "e.change_kind")
    )


def entry_states(entries: DataFrame, anchors: DataFrame) -> DataFrame:
    """State per snapshot and canonical key: status and the set of anchor digests.

    Of repeated rows the largest ``entry_row`` counts. Status ignores letter
    case and surrounding blanks, a blank one is null. Null digests are no
    members; an entry without any has the empty set. Anchors of missing entries
    and columns besides those named are ignored.
    """
    keyed = entries.select(
        "snapshot_no",
        "entry_row",
        canonical_digest(F.col("identity_key")).alias("identity_key"),
        F.lower(blank_to_null(F.col("status"))).alias("status"),
    )
    current = current_rows(keyed, "snapshot_no", "identity_key", "entry_row", ["status"])
    sets = member_set_state(anchors, "entry_row", canonical_digest(F.col("sha256")))
    indexed = _with_index(current, snapshot_index(entries, "snapshot_no"), "snapshot_no")
    joined = indexed.join(sets, "entry_row", "left")
    n, x, y = (F.coalesce(F.col(c), F.lit(0)) for c in ("set_n", "set_x", "set_y"))
    return joined.select(
        "snapshot_no",
        "snap_idx",
        "next_snapshot",
        "identity_key",
        row_hash(F.col("status"), n, x, y).alias("row_hash"),
    )


def baseline_changes(entries: DataFrame, anchors: DataFrame) -> DataFrame:
    """Added, removed and changed identity keys between consecutive snapshots.

    Empty tables, or a single snapshot, give no rows.
    """
    intervals = validity_intervals(entry_states(entries, anchors), "identity_key")
    events = change_events(intervals, "identity_key")
    return events.select(F.col("snapshot_no").cast("int").alias("snapshot_no"), "identity_key", "change_kind")
