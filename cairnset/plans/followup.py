"""Queries that follow from the triage tables: titles of merges, checks, replays, candidates, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnset.functions.digest import blank_to_null, canonical_digest
from cairnset.operators import folds, snapshots
from cairnset.plans import triage
from cairnset.plans.numbered import STATES_SQL, digest_sql
from cairnset.plans.sites import GRAPH, SITES, GivenSites, claim_rows
from cairnset.sources.tables import table


def merge_titles(spark: SparkSession, d: str) -> DataFrame:
    """Distinct titles of each group of at least two claims, by first occurrence; rows, as a group has no bound."""
    titled = GivenSites(spark, d).named.select("ord", "identity_key").join(claim_rows(spark, d).select("ord", "title"), "ord")
    titles = titled.groupBy("identity_key", "title").agg(F.min("ord").alias("first_ord"), F.count("*").alias("copies"))
    merged = titles.groupBy("identity_key").agg(F.sum("copies").alias("n")).where("n > 1")
    return titles.where("title <> ''").join(merged, "identity_key", "left_semi")


def context_position(spark: SparkSession, d: str) -> DataFrame:
    """Per claim the first cited position inside a function, else the first that resolves."""
    around = GivenSites(spark, d).around
    order = F.struct(F.col("name").isNull(), "pos")
    first = around.groupBy("ord").agg(F.min_by(F.struct("pos", "line", F.col("name").alias("function")), order).alias("p"))
    return first.select("ord", "p.*")


def unreferenced_functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions that are no entry points and that nothing but themselves calls."""
    sites = GivenSites(spark, d)
    called = sites.calls.where("NOT endswith(caller, concat('::', callee))").select(F.col("callee").alias("name")).distinct()
    return sites.functions.where("NOT is_entry").select("path", "seq", "name").join(called, "name", "left_anti")


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return triage.evidence(GivenSites(spark, d)).where("answer = 'supports'").select("ord", "question")


def settled_questions(spark: SparkSession, d: str) -> DataFrame:
    settled, supports = F.count_if(F.col("answer") != "not_established"), F.count_if(F.col("answer") == "supports")
    return triage.evidence(GivenSites(spark, d)).groupBy("ord").agg(settled.alias("settled"), supports.alias("candidates"))


def dedupe_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Claims and identities per run, summed by tool: an identity counts once in each run."""
    rows = GivenSites(spark, d).named.select("ord", "identity_key").join(claim_rows(spark, d).select("ord", "tool", "run_id"), "ord")
    by_run = rows.groupBy("tool", "run_id").agg(F.count("*").alias("claims"), F.count_distinct("identity_key").alias("identities"))
    sums = [F.sum(c).alias(c) for c in ("claims", "identities")]
    return by_run.groupBy("tool").agg(F.count("*").alias("runs"), *sums)


def effective_status(spark: SparkSession, d: str) -> DataFrame:
    """Entries of each snapshot by the status in force: the recorded one where it is carried, else undetermined."""
    keyed = table(spark, d, "baseline_entries").select(
        "snapshot_no", "entry_row", canonical_digest(F.col("identity_key")).alias("identity_key"), F.lower(blank_to_null(F.col("status"))).alias("status")
    )
    current = snapshots.current_rows(keyed, "snapshot_no", "identity_key", "entry_row", ["status"]).select("snapshot_no", "identity_key", "status")
    in_force = F.coalesce(F.when(F.col("state") == "carried", F.col("status")), F.lit("undetermined"))
    stated = triage.baseline_state(spark, d).join(current, ["snapshot_no", "identity_key"])
    return stated.groupBy("snapshot_no", in_force.alias("status")).agg(F.count("*").alias("items"))


def verify_checks(spark: SparkSession, d: str) -> DataFrame:
    """Each recorded span beside the next snapshot's: a missing digest on either side is unverifiable."""
    pairs = triage.span_pairs(spark, d)
    verdict = (
        F.when(F.col("sha_then").isNull() | F.col("sha").isNull(), "unverifiable")
        .when(F.col("sha_then") == F.col("sha"), "verified")
        .otherwise("contradicted")
    )
    return pairs.select("snapshot_no", "identity_key", "locator", verdict.alias("verdict"))


def verify_entries(spark: SparkSession, d: str) -> DataFrame:
    checks = verify_checks(spark, d).groupBy("snapshot_no", "identity_key")
    return checks.agg(F.count("*").alias("checks"), folds.combine(F.col("verdict")).alias("verdict"))


def replay_lookup(spark: SparkSession, d: str) -> DataFrame:
    """What was last recorded under the key of each intake entry; a key that is null or never recorded is a miss."""
    recorded = triage.last_writer_wins(spark, d)
    asked = table(spark, d, "intake_entries").select("entry_id", canonical_digest(F.col("identity_key")).alias("identity_key"))
    outcome = F.when(F.col("entry_row").isNull(), "not_recorded").otherwise("recorded")
    return asked.join(recorded, "identity_key", "left").select("entry_id", outcome.alias("outcome"), "status")


_NAMED, _SPANS = triage.NAMED, triage.SPANS
_CHECKS = f"""{_SPANS}, checks AS (
  SELECT n.snapshot_no, t.identity_key, t.locator, CASE WHEN t.sha IS NULL OR w.sha IS NULL THEN 'unverifiable'
    WHEN t.sha = w.sha THEN 'verified' ELSE 'contradicted' END AS verdict
  FROM anch t JOIN snaps n ON n.i = t.i + 1 LEFT JOIN anch w ON w.i = t.i + 1 AND w.identity_key = t.identity_key AND w.locator = t.locator)"""

SQL = {
    "merge_titles": f"""WITH {_NAMED}, t AS (
      SELECT identity_key, title, min(ord) AS first_ord, count(*) AS copies FROM idn GROUP BY identity_key, title)
      SELECT identity_key, title, first_ord, copies FROM t
      WHERE title <> '' AND identity_key IN (SELECT identity_key FROM idn GROUP BY identity_key HAVING count(*) > 1)""",
    "context_position": f"""WITH {SITES}, {GRAPH} SELECT ord, pos, line, function FROM enc
      QUALIFY row_number() OVER (PARTITION BY ord ORDER BY function IS NULL, pos) = 1""",
    "unreferenced_functions": f"""WITH {SITES}, {GRAPH} SELECT path, seq, name FROM fn
      WHERE NOT is_entry AND name NOT IN (SELECT callee FROM cl WHERE NOT ends_with(caller, '::' || callee))""",
    "candidates": f"WITH {triage.EVIDENCE} SELECT ord, question FROM ev WHERE answer = 'supports'",
    "settled_questions": f"""WITH {triage.EVIDENCE} SELECT ord, count_if(answer <> 'not_established')::BIGINT AS settled,
      count_if(answer = 'supports')::BIGINT AS candidates FROM ev GROUP BY ord""",
    "dedupe_rollup": f"""WITH {_NAMED} SELECT tool, count(*) AS runs, sum(claims)::BIGINT AS claims, sum(identities)::BIGINT AS identities
      FROM (SELECT tool, run_id, count(*) AS claims, count(DISTINCT identity_key) AS identities FROM idn GROUP BY tool, run_id) GROUP BY tool""",
    "effective_status": f"""WITH {_SPANS} SELECT snapshot_no, coalesce(CASE WHEN state = 'carried' THEN status END, 'undetermined') AS status, count(*) AS items
      FROM states JOIN cur USING (snapshot_no, identity_key) GROUP BY 1, 2""",
    "verify_checks": f"WITH {_CHECKS} SELECT snapshot_no, identity_key, locator, verdict FROM checks",
    "verify_entries": f"""WITH {_CHECKS} SELECT snapshot_no, identity_key, count(*) AS checks, CASE WHEN bool_or(verdict = 'unverifiable') THEN 'unverifiable'
      WHEN bool_or(verdict = 'contradicted') THEN 'contradicted' ELSE 'verified' END AS verdict FROM checks GROUP BY snapshot_no, identity_key""",
    "replay_lookup": f"""WITH {STATES_SQL}, rec AS (
      SELECT identity_key AS k, entry_row, status FROM keyed WHERE identity_key IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY identity_key ORDER BY entry_row DESC) = 1)
      SELECT entry_id, CASE WHEN entry_row IS NULL THEN 'not_recorded' ELSE 'recorded' END AS outcome, status
      FROM (SELECT entry_id, {digest_sql('identity_key')} AS k FROM intake_entries) LEFT JOIN rec USING (k)""",
}
QUERIES = {
    f.__name__: f
    for f in (
        merge_titles, context_position, unreferenced_functions, candidates, settled_questions, dedupe_rollup, effective_status,
        verify_checks, verify_entries, replay_lookup,
    )
}
