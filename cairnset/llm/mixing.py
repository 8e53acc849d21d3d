"""Mixing sources to target weights (problem 7).

Documents fall into blocks by hash, and each source gets an exact quota of
blocks (the last one in part). A splitting tree deals the quotas to the output
shards: at each node the left half draws its share of blocks without
replacement, so the counts by source follow the multivariate hypergeometric
distribution and add up exactly. Which blocks they are follows from a keyed
permutation; inside a shard documents are shuffled by hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnset.functions.digest import blank_to_null
from cairnset.llm.encode import count_tokens
from cairnset.session import cut, fits_broadcast

#: Targets are a parameter table; more rows than this are refused.
MOST_SOURCES = 10_000
#: Block plans of up to so many rows (about 40 bytes each) are sent to every task; larger ones are joined by shuffle.
BROADCAST_BLOCKS = 100_000


@dataclass(frozen=True)
class MixPlan:
    """Sizes of a mixture; all work with their defaults."""

    total_tokens: int | None = None  #: None: the most at which every source that has documents keeps its weight
    block_tokens: int = 16_384
    shard_tokens: int = 1_000_000
    most_blocks: int = 1 << 20  #: blocks of one source
    most_shards: int = 1 << 16
    seed: int = 42


@dataclass(frozen=True)
class Quota:
    """What one source can and shall give."""

    source: str
    weight: float
    max_repeats: int
    docs: int
    available: int
    tokens: int

    @property
    def passes(self) -> int:
        return self.tokens // self.available if self.available else 0

    @property
    def rest(self) -> int:
        return self.tokens % self.available if self.available else 0


def read_targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """Weight and repeats by source, letter case and blanks aside.

    Rows without source, weight or repeats, or not above 0, give no share; of
    rows that spell the same source the weights add up and the fewer repeats hold.
    """
    rows = (
        targets.select(F.lower(blank_to_null(F.col("source"))).alias("s"), "weight", "max_repeats")
        .where("s IS NOT NULL AND weight > 0 AND max_repeats > 0")
        .groupBy("s")
        .agg(F.sum("weight"), F.min("max_repeats"))
        .limit(MOST_SOURCES + 1)
        .collect()
    )
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    return {s: (float(w), int(r)) for s, w, r in sorted(rows)}


def sized_documents(docs: DataFrame, targets: dict[str, tuple[float, int]], plan: MixPlan) -> DataFrame:
    """doc_id, source, n_tokens and a keyed hash of each document of a listed source.

    Documents without a single token (null or empty texts) cannot add to any
    share and are left out. Written to the shared folder, as it is read twice.
    """
    source = F.lower(blank_to_null(F.col("source")))
    listed = docs.select("doc_id", source.alias("source"), "text").where(F.col("source").isin([*targets]))
    sized = count_tokens(listed.where(F.length("text") > 0), ["doc_id", "source"], "text")
    return cut(sized.withColumn("h", F.xxhash64("doc_id", F.lit(plan.seed))))


def set_quotas(sized: DataFrame, targets: dict[str, tuple[float, int]], plan: MixPlan) -> list[Quota]:
    """Tokens each source shall give; one row per source comes to the driver.

    Weights are taken among the sources that have documents. Without a total the
    mixture is as large as the scarcest source allows with all its repeats; with
    one, a source that cannot give its part gives all repeats it may.
    """
    have = {s: (n, t) for s, n, t in sized.groupBy("source").agg(F.count("*"), F.sum("n_tokens")).collect()}
    weights = {s: w for s, (w, _) in targets.items() if s in have}
    whole = sum(weights.values())
    caps = {s: have[s][1] * targets[s][1] for s in weights}
    total = plan.total_tokens
    if total is None:
        total = min((caps[s] * whole / w for s, w in weights.items()), default=0)
    quotas = []
    for s, (w, repeats) in targets.items():
        docs, available = have.get(s, (0, 0))
        tokens = min(caps[s], round(total * w / whole)) if s in have else 0
        quotas.append(Quota(s, w, repeats, docs, available, tokens))
    return quotas


def block_quotas(sized: DataFrame, quotas: list[Quota], plan: MixPlan) -> tuple[DataFrame, DataFrame]:
    """Documents with their block, and the chosen blocks: source, block, copy_no, tokens, rest.

    Every full pass takes all blocks of a source; the last pass takes blocks in
    permuted order up to the quota. ``rest`` is set for the block that the quota
    cuts: so many tokens of it are wanted.
    """
    spark = sized.sparkSession
    rows = [
        (q.source, min(plan.most_blocks, -(-q.available // plan.block_tokens)), q.passes, q.rest) for q in quotas if q.tokens
    ]
    per_source = F.broadcast(spark.createDataFrame(rows, "source string, n_blocks bigint, passes int, pass_rest bigint"))
    placed = sized.join(per_source, "source").withColumn("block", F.pmod("h", "n_blocks")).drop("n_blocks")
    totals = placed.groupBy("source", "block", "passes", "pass_rest").agg(F.sum("n_tokens").alias("tokens"))
    passes = totals.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("passes"))))
    order = W.partitionBy("source", "copy_no").orderBy(F.xxhash64("source", "block", "copy_no", F.lit(plan.seed)), "block")
    reach = F.sum("tokens").over(order)
    last = F.col("copy_no") == F.col("passes")
    chosen = (
        passes.withColumn("before", F.when(last, reach - F.col("tokens")))
        .where(~last | (F.col("before") < F.col("pass_rest")))
        .withColumn("rest", F.when(F.col("before") + F.col("tokens") > F.col("pass_rest"), F.col("pass_rest") - F.col("before")))
        .select("source", "block", "copy_no", "tokens", "rest")
    )
    return placed.drop("passes", "pass_rest"), chosen


def split_quotas(counts: list[int], shards: int, shard: int, seed: int) -> tuple[list[int], list[int]]:
    """First block and number of blocks of each source in one shard.

    Walks from the root to the leaf. The draw at a node depends only on the
    counts, its range of shards and the seed, so all leaves agree on it.
    """
    left, first = np.array(counts, dtype=np.int64), np.zeros(len(counts), dtype=np.int64)
    low, high = 0, shards
    while high - low > 1:
        middle = (low + high) // 2
        take = int(left.sum()) * (middle - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        drawn = rng.multivariate_hypergeometric(left, take, method="marginals")
        if shard < middle:
            left, high = drawn, middle
        else:
            left, first, low = left - drawn, first + drawn, middle
    return first.tolist(), left.tolist()


def deal_blocks(chosen: DataFrame, plan: MixPlan) -> DataFrame:
    """The chosen blocks with their shard, by the splitting tree."""
    spark = chosen.sparkSession
    chosen = cut(chosen)
    counted = chosen.groupBy("source").agg(F.count("*"), F.sum(F.coalesce("rest", "tokens"))).collect()
    sources, counts = [r[0] for r in counted], [r[1] for r in counted]
    shards = max(1, min(plan.most_shards, sum(counts), -(-sum(r[2] for r in counted) // plan.shard_tokens)))
    seed = plan.seed

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(int(i), *split_quotas(counts, shards, int(i), seed)) for i in batch["id"]]
            yield pd.DataFrame(
                [(i, s, a, n) for i, first, number in made for s, a, n in zip(sources, first, number) if n],
                columns=["shard", "source", "first", "n"],
            )

    parts = max(1, min(shards // 64, spark.sparkContext.defaultParallelism))
    shares = spark.range(0, shards, 1, parts).mapInPandas(leaves, "shard int, source string, first bigint, n bigint")
    seats = shares.select("shard", "source", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("seat"))
    order = W.partitionBy("source").orderBy(F.xxhash64("block", "copy_no", F.lit(plan.seed + 1)), "block", "copy_no")
    ranked = chosen.withColumn("seat", F.row_number().over(order).cast("bigint") - 1)
    return ranked.join(seats, ["source", "seat"]).select("source", "block", "copy_no", "rest", "shard")


def mix_documents(docs: DataFrame, targets: DataFrame, plan: MixPlan = MixPlan()) -> tuple[DataFrame, list[Quota]]:
    """The mixture (shard, pos, doc_id, copy_no, source, n_tokens) and the quotas behind it.

    ``copy_no`` counts the uses of a document from 0 and stays below
    max_repeats. Sources not listed and documents without tokens are left out;
    a listed source without documents gets nothing, which the shares report.
    Each row of ``docs`` is one document. Used tokens differ from the quota by at
    most half of one document. Empty tables give no rows.
    """
    wanted = read_targets(targets)
    sized = sized_documents(docs, wanted, plan)
    quotas = set_quotas(sized, wanted, plan)
    placed, chosen = block_quotas(sized, quotas, plan)
    dealt = cut(deal_blocks(chosen, plan))
    if fits_broadcast(dealt, BROADCAST_BLOCKS):
        dealt = F.broadcast(dealt)
    used = placed.join(dealt, ["source", "block"])
    whole = used.where("rest IS NULL")
    in_block = W.partitionBy("source", "block", "copy_no").orderBy("h", "doc_id", "n_tokens")
    before = F.sum("n_tokens").over(in_block) - F.col("n_tokens")
    part = (
        used.where("rest IS NOT NULL")
        .withColumn("before", before)
        .where("before < rest AND before + n_tokens - rest <= rest - before")
        .drop("before")
    )
    in_shard = W.partitionBy("shard").orderBy(F.xxhash64("doc_id", "copy_no", F.lit(plan.seed + 2)), "doc_id", "copy_no")
    mixed = whole.unionByName(part).select(
        "shard",
        (F.row_number().over(in_shard) - 1).alias("pos"),
        "doc_id",
        F.col("copy_no").cast("int").alias("copy_no"),
        "source",
        "n_tokens",
    )
    return mixed, quotas


def mix_shares(mixed: DataFrame, quotas: list[Quota]) -> DataFrame:
    """Per listed source: weight, tokens there, wanted and used, share wanted among sources with documents, share reached, most uses.

    ``largest_shard`` gives the tokens of the largest shard of the whole mixture:
    more than ``shard_tokens`` where ``most_shards`` makes shards larger.
    """
    spark = mixed.sparkSession
    whole = sum(q.weight for q in quotas if q.available) or 1.0
    rows = [
        (q.source, q.weight, q.max_repeats, q.docs, q.available, q.tokens, q.weight / whole if q.available else 0.0) for q in quotas
    ]
    names = "source string, weight double, max_repeats int, docs bigint, available bigint, wanted bigint, wanted_share double"
    dealt = cut(mixed.groupBy("shard", "source").agg(F.sum("n_tokens").alias("used"), F.max("copy_no").alias("copy_no")))
    largest = dealt.groupBy("shard").agg(F.sum("used").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    used = dealt.groupBy("source").agg(F.sum("used").alias("used"), (F.max("copy_no") + 1).alias("most_uses"))
    whole_used = F.sum("used").over(W.partitionBy())
    return (
        spark.createDataFrame(rows, names)
        .join(used, "source", "left")
        .na.fill(0, ["used", "most_uses"])
        .withColumn("share", F.when(whole_used > 0, F.col("used") / whole_used).otherwise(0.0))
        .withColumn("largest_shard", F.lit(largest).cast("bigint"))
    )
