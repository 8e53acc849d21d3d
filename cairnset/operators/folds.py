"""Three-valued folds, keyed snapshots and their rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def combine(verdict: Column) -> Column:
    """Aggregate of verdicts: nothing or any unverifiable is unverifiable, then any contradicted, else verified.

    A null verdict counts as unverifiable: what was not checked has not passed.
    """
    open_ = F.bool_or(verdict.isNull() | (verdict == "unverifiable"))
    return (
        F.when((F.count(F.lit(1)) == 0) | open_, "unverifiable")
        .when(F.bool_or(verdict == "contradicted"), "contradicted")
        .otherwise("verified")
    )


def last_write(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the largest ``order`` per key, by partial maxima; ties are settled by the other columns."""
    others = [c for c in rows.columns if c not in (*keys, order)]
    best = rows.groupBy(*keys).agg(F.max(F.struct(order, *others)).alias("b"))
    return best.select(*keys, "b.*")


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key is not in it."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def span_state(anchor_hash: Column, now_hash: Column, symbol_then: Column, symbol_now: Column) -> Column:
    """absent, unchanged, moved or changed: the cited text and the function around it, then and now.

    Without a digest today the span is absent. Equal text is unchanged unless a
    recorded function digest differs now; other text has moved if the function
    is the same.
    """
    rewritten = symbol_then.isNotNull() & ~symbol_now.eqNullSafe(symbol_then)
    return (
        F.when(now_hash.isNull(), "absent")
        .when(now_hash.eqNullSafe(anchor_hash) & ~rewritten, "unchanged")
        .when(now_hash.eqNullSafe(anchor_hash), "changed")
        .when(symbol_now.isNotNull() & symbol_now.eqNullSafe(symbol_then), "moved")
        .otherwise("changed")
    )


def entry_state(known: Column, spans: Column, broken: Column) -> Column:
    """new, stale or carried: no entry; no spans or any absent or changed; else carried."""
    return F.when(known.isNull(), "new").when((F.coalesce(spans, F.lit(0)) == 0) | (broken > 0), "stale").otherwise("carried")
