"""The queue that people work off: one item per identity, its members, and the totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnset.operators import folds, identity

#: The questions about a claim, in their order; the second, fourth and fifth need a model.
QUESTIONS = ["component_present", "construct_present", "reachable", "attacker_controlled", "mitigation_present"]


def assessments(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every question of every claim (ord), in the fixed order; what no one has answered is not established."""
    asked = claims.select("ord", F.posexplode(F.array(*map(F.lit, QUESTIONS))).alias("question_no", "question"))
    joined = asked.join(evidence.select("ord", "question", "answer"), ["ord", "question"], "left")
    return joined.select("ord", "question_no", "question", F.coalesce("answer", F.lit("not_established")).alias("answer"))


def items(named: DataFrame, claims: DataFrame, evidence: DataFrame, citations: DataFrame) -> DataFrame:
    """One row per identity: its first claim with title and answers, the number of members, and its state.

    An item that came in one run only is new. One that earlier runs had is
    carried while everything that its first claim cites resolves, else stale.
    ``claims`` has ord, title, run_id; ``citations`` ord and resolution. Groups
    are reduced to counts and minima before they are shuffled.
    """
    grouped = named.select("ord", "identity_key", "kind").join(claims.select("ord", "run_id"), "ord")
    first = grouped.groupBy("identity_key", "kind").agg(
        F.min("ord").alias("ord"), F.count("*").alias("members"), F.min("run_id").alias("r"), F.max("run_id").alias("s")
    )
    spans = citations.groupBy("ord").agg(F.count("*").alias("spans"), F.count_if(F.col("resolution") != "resolves").alias("broken"))
    answers = evidence.groupBy("ord").agg(
        F.count_if(F.col("answer") != "not_established").alias("settled"), F.count_if(F.col("answer") == "supports").alias("candidates")
    )
    known = F.when(F.col("r") < F.col("s"), True)
    joined = first.join(claims.select("ord", "title"), "ord").join(spans, "ord", "left").join(answers, "ord", "left")
    return joined.select(
        "identity_key", "kind", "ord", "title", "members", F.coalesce("settled", F.lit(0)).alias("settled"),
        F.coalesce("candidates", F.lit(0)).alias("candidates"), folds.entry_state(known, F.col("spans"), F.col("broken")).alias("state"),
    )


def members(named: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Members of each item in order of arrival, by ord: claim ids repeat. Only the first is assessed, the others stand bare."""
    settled = evidence.groupBy("ord").agg(F.count_if(F.col("answer") != "not_established").alias("settled"))
    numbered = identity.numbered_items(named).join(claims.select("ord", "claim_id"), "ord").join(settled, "ord", "left")
    return numbered.select("identity_key", "n", "ord", "claim_id", F.when(F.col("n") == 1, F.col("settled")).alias("settled"))


def totals(queue: DataFrame, related: DataFrame) -> DataFrame:
    """One row: claims, items, merges, items of each state, and related sites."""
    rows = queue.select("members", "state").unionByName(related.select(F.lit(None).cast("bigint").alias("members"), F.lit("related_sites").alias("state")))
    states = [F.count_if(F.col("state") == s).alias(s) for s in ("new", "carried", "stale", "related_sites")]
    return rows.agg(
        F.coalesce(F.sum("members"), F.lit(0)).alias("claims_in"), F.count("members").alias("items"), F.count_if(F.col("members") > 1).alias("merges"), *states
    )
