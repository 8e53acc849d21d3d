"""Queries of the general problems: snapshots (1) and nested reports (4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnset.operators import nested, snapshots
from cairnset.sources.tables import table

TRIM = "' ' || chr(9) || chr(10) || chr(13)"


def digest_sql(c: str) -> str:
    """Canonical digest form in the oracle's SQL."""
    bare = f"nullif(trim(regexp_replace(lower(trim({c}, {TRIM})), '^sha256:', ''), {TRIM}), '')"
    return f"'sha256:' || {bare}"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.baseline_changes(table(spark, d, "baseline_entries"), table(spark, d, "span_anchors"))


def p1_intervals(spark: SparkSession, d: str) -> DataFrame:
    states = snapshots.entry_states(table(spark, d, "baseline_entries"), table(spark, d, "span_anchors"))
    return snapshots.validity_intervals(states, "identity_key").select("identity_key", "valid_from", "valid_to")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.report_locations(table(spark, d, "sarif_reports"))


def p4_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = nested.report_tables(table(spark, d, "sarif_reports"))["runs"]
    return runs.select("report_id", F.col("pos").alias("run_no"), "tool", "tool_version")


def p4_results(spark: SparkSession, d: str) -> DataFrame:
    results = nested.report_tables(table(spark, d, "sarif_reports"))["results"]
    return results.select(
        "report_id",
        F.col("parent_label")[0].alias("run_no"),
        F.col("pos").alias("result_no"),
        F.array_join("label", ".").alias("label"),
        "rule_id",
        "level",
        "message",
    )


def p4_rejected(spark: SparkSession, d: str) -> DataFrame:
    return nested.rejected_reports(table(spark, d, "sarif_reports"))


STATES_SQL = f"""
keyed AS (
  SELECT snapshot_no, entry_row, {digest_sql('identity_key')} AS identity_key,
         nullif(lower(trim(status, {TRIM})), '') AS status
  FROM baseline_entries),
cur AS (
  SELECT * FROM keyed WHERE identity_key IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY snapshot_no, identity_key ORDER BY entry_row DESC) = 1),
sets AS (
  SELECT entry_row, string_agg(x, ',' ORDER BY x) AS xs
  FROM (SELECT DISTINCT entry_row, {digest_sql('sha256')} AS x FROM span_anchors)
  WHERE x IS NOT NULL GROUP BY entry_row),
snaps AS (
  SELECT snapshot_no, row_number() OVER (ORDER BY snapshot_no) AS i
  FROM (SELECT DISTINCT snapshot_no FROM baseline_entries)),
st AS (
  SELECT i, cur.snapshot_no, identity_key, coalesce(status, '~') || '|' || coalesce(xs, '') AS s
  FROM cur JOIN snaps USING (snapshot_no) LEFT JOIN sets USING (entry_row))
"""

P1_SQL = f"""WITH {STATES_SQL}
SELECT n.snapshot_no::INT AS snapshot_no, coalesce(a.identity_key, b.identity_key) AS identity_key,
       CASE WHEN a.identity_key IS NULL THEN 'added' WHEN b.identity_key IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM (SELECT i - 1 AS i0, * FROM st) b
FULL JOIN st a ON a.identity_key = b.identity_key AND a.i = b.i0
JOIN snaps n ON n.i = coalesce(b.i, a.i + 1)
WHERE n.i > 1 AND (a.identity_key IS NULL OR b.identity_key IS NULL OR a.s <> b.s)"""

INTERVALS_SQL = f"""WITH {STATES_SQL},
grp AS (
  SELECT *, i - row_number() OVER (PARTITION BY identity_key, s ORDER BY i) AS island FROM st)
SELECT identity_key, min(snapshot_no) AS valid_from, max(snapshot_no) AS valid_to
FROM grp GROUP BY identity_key, s, island"""


def _list_sql(x: str) -> str:
    """An array's elements, a single object as an array of one, anything else as none."""
    return (
        f"CASE json_type({x}) WHEN 'ARRAY' THEN CAST({x} AS JSON[]) WHEN 'OBJECT' THEN [{x}] ELSE [] END"
    )


def _line_sql(x: str) -> str:
    return f"""CASE WHEN json_type({x}) IN ('UBIGINT', 'BIGINT', 'VARCHAR')
      THEN nullif(regexp_extract(json_extract_string({x}, '$'), '^0*([1-9][0-9]*)$', 1), '') END"""


def _walk_sql(parent: str, cols: str, source: str, expr: str, pos: str, out: str) -> str:
    return f"""SELECT {cols}, unnest(range(len(l)))::INT AS {pos}, unnest(l) AS {out}
      FROM (SELECT *, {_list_sql(expr)} AS l FROM {source}) {parent}"""


P4_TABLES_SQL = f"""
roots AS (
  SELECT report_id, payload::JSON AS j FROM sarif_reports
  WHERE json_valid(payload) AND json_type(CASE WHEN json_valid(payload) THEN payload END) = 'OBJECT'),
runs AS ({_walk_sql('p', 'report_id', 'roots', "j->'runs'", 'run_no', 'run')}),
results AS ({_walk_sql('p', 'report_id, run_no', 'runs', "run->'results'", 'result_no', 'res')})
"""

P4_SQL = f"""WITH {P4_TABLES_SQL},
plain AS (
  SELECT report_id, run_no, result_no, branch, unnest(range(len(l)))::INT AS loc_no, unnest(l) AS loc FROM (
    SELECT *, 'locations' AS branch, {_list_sql("res->'locations'")} AS l FROM results
    UNION ALL SELECT *, 'relatedLocations', {_list_sql("res->'relatedLocations'")} FROM results)),
f1 AS ({_walk_sql('p', 'report_id, run_no, result_no', 'results', "res->'codeFlows'", 'a', 'cf')}),
f2 AS ({_walk_sql('p', 'report_id, run_no, result_no, a', 'f1', "cf->'threadFlows'", 'b', 'tf')}),
f3 AS ({_walk_sql('p', 'report_id, run_no, result_no, a, b', 'f2', "tf->'locations'", 'c', 'step')}),
allloc AS (
  SELECT * FROM plain UNION ALL
  SELECT report_id, run_no, result_no, 'codeFlows',
         (row_number() OVER (PARTITION BY report_id, run_no, result_no ORDER BY a, b, c) - 1)::INT, step->'location' FROM f3),
flat AS (
  SELECT report_id, run_no, result_no, branch, loc_no,
         CASE WHEN json_type(loc->'physicalLocation'->'artifactLocation'->'uri') = 'VARCHAR'
              THEN loc->'physicalLocation'->'artifactLocation'->>'uri' END AS uri,
         {_line_sql("(loc->'physicalLocation'->'region'->'startLine')")} AS s,
         {_line_sql("(loc->'physicalLocation'->'region'->'endLine')")} AS e FROM allloc)
SELECT report_id, run_no, result_no, branch, loc_no,
       uri || CASE WHEN s IS NULL THEN '' WHEN e IS NULL OR e = s THEN ':' || s ELSE ':' || s || '-' || e END AS locator
FROM flat WHERE trim(uri, {TRIM}) <> ''"""

P4_RUNS_SQL = f"""WITH {P4_TABLES_SQL}
SELECT report_id, run_no, run->'tool'->'driver'->>'name' AS tool, run->'tool'->'driver'->>'version' AS tool_version FROM runs"""

P4_RESULTS_SQL = f"""WITH {P4_TABLES_SQL}
SELECT report_id, run_no, result_no, run_no || '.' || result_no AS label, res->>'ruleId' AS rule_id,
       res->>'level' AS level, res->'message'->>'text' AS message FROM results"""

QUERIES = {
    "p1_found": p1_found,
    "p1_intervals": p1_intervals,
    "p4_found": p4_found,
    "p4_rejected": p4_rejected,
    "p4_runs": p4_runs,
    "p4_results": p4_results,
}
SQL = {
    "p4_rejected": """SELECT report_id, CASE WHEN payload IS NULL THEN 'null' WHEN NOT json_valid(payload) THEN 'not valid JSON as a whole' ELSE 'no object on top' END AS reason
      FROM (SELECT report_id, payload FROM sarif_reports)
      WHERE payload IS NULL OR NOT json_valid(payload) OR json_type(CASE WHEN json_valid(payload) THEN payload END) <> 'OBJECT'""",
    "p1_found": P1_SQL,
    "p1_intervals": INTERVALS_SQL,
    "p4_found": P4_SQL,
    "p4_runs": P4_RUNS_SQL,
    "p4_results": P4_RESULTS_SQL,
}
