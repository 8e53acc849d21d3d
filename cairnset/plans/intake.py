"""Queries of the readers over the given tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnset.functions.digest import text_digest
from cairnset.functions.jsontext import canonical_json
from cairnset.functions.text import LINE_END
from cairnset.operators import audits
from cairnset.plans.numbered import P4_TABLES_SQL, TRIM, _line_sql, _list_sql
from cairnset.plans.sites import DocumentTree
from cairnset.session import cut
from cairnset.sources import documents, findings, loader
from cairnset.sources.tables import table



def report_claims(spark: SparkSession, d: str) -> DataFrame:
    claims = findings.report_claims(table(spark, d, "sarif_reports"))
    return claims.select(
        "report_id", "run_no", "result_no", "claim_id", "title", "weakness", "severity", "tool", "tool_version",
        F.array_join("locators", "|").alias("locators"),
    )


def format_sniff(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sarif_reports").select("report_id", findings.sniff(F.col("payload")).alias("format"))


_SIGNATURE = "CASE WHEN claim_ord % 5 = 0 THEN 'codex-security/' || claim_id WHEN claim_ord % 7 <> 0 THEN claim_id END"


def feed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Claims written as JSON lines of a feed: some name a list of weaknesses, some have a finding_id in place of a signature."""
    given = table(spark, d, "claims").selectExpr("*", f"{_SIGNATURE} AS signature", "CASE WHEN claim_ord % 7 = 0 THEN claim_id END AS finding_id")
    shared = ["signature", "finding_id", "title", "severity", F.col("locators").alias("code_paths")]
    one, many = (F.to_json(F.struct(*shared, c.alias("cwe"))) for c in (F.col("weakness"), F.array("weakness", F.lit("CWE-1"))))
    return given.select("claim_ord", F.when(F.col("claim_ord") % 3 == 0, many).otherwise(one).alias("line"))


def feed_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims written as JSON lines of a feed and read again."""
    read = findings.feed_claims(feed_lines(spark, d), "claim_ord", "line")
    return read.select("claim_ord", "claim_id", "title", "weakness", "severity", "tool", F.array_join("locators", "|").alias("locators"))


def findings_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims written as findings documents and read again."""
    place = F.transform("locators", lambda x: F.struct(F.regexp_replace(x, ":.*", "").alias("path"), F.nullif(F.regexp_extract(x, ":([0-9]+)", 1), F.lit("")).cast("int").alias("startLine")))
    severity = F.struct(F.col("severity").alias("level"))
    one = F.struct(F.col("claim_id").alias("findingId"), F.col("weakness").alias("ruleId"), F.col("title").alias("summary"), severity.alias("severity"), place.alias("locations"))
    document = F.to_json(F.struct(F.lit("findings").alias("documentType"), F.array(one).alias("findings")))
    read = findings.findings_claims(table(spark, d, "claims").select("claim_ord", document.alias("doc")), "claim_ord", "doc")
    return read.select("claim_ord", "claim_id", "title", "weakness", "severity", F.array_join("locators", "|").alias("locators"))


def finding_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of every format: the reports, the documents as texts, and a feed of two lines per claim, every tenth one row spread over two."""
    reports = table(spark, d, "sarif_reports").select(F.concat(F.lit("report/"), "report_id").alias("file"), F.col("payload").alias("text"))
    texts = table(spark, d, "documents").select(F.concat(F.lit("text/"), "doc_id"), "text")
    whole = F.concat_ws("\n", "line", F.lit(""), F.lit('{"signature": "second"}'))
    spread = F.when(F.col("claim_ord") % 10 == 0, F.lit('{"signature":\n"x"}')).otherwise(whole)
    feeds = feed_lines(spark, d).select(F.concat(F.lit("feed/"), "claim_ord"), spread)
    return reports.unionAll(texts).unionAll(feeds)


def loaded_claims(spark: SparkSession, d: str) -> DataFrame:
    known = loader.sniffed(finding_files(spark, d))
    return loader.claims_of(known).select("file", "place", "claim_id", "format")


def load_problems(spark: SparkSession, d: str) -> DataFrame:
    return loader.problems(loader.sniffed(finding_files(spark, d)))


def baseline_documents(spark: SparkSession, d: str) -> DataFrame:
    """Entries and anchors written as baseline documents, one per entry, and read again with their times."""
    spans = table(spark, d, "span_anchors").groupBy("entry_row").agg(F.sort_array(F.collect_list(F.struct("pos", "locator", "path", "sha256"))).alias("anchors"))
    entries = table(spark, d, "baseline_entries").join(spans, "entry_row", "left")
    one = F.struct(
        F.struct(F.col("identity_key").alias("key"), F.col("identity_kind").alias("kind")).alias("identity"), "title", "status",
        documents.iso_text(F.col("decided_at")).alias("decided_at"), "anchors",
    )
    text = F.to_json(F.struct(F.lit("baseline-1").alias("format"), F.array(one).alias("entries")))
    written = entries.select("entry_row", text.alias("doc"))
    tables = documents.tables_of(written, "entry_row", "doc", documents.BASELINE, "baseline-1")
    counts = tables["anchors"].groupBy("entry_row").agg(F.count("*").alias("anchors"), F.min("locator").alias("first_locator"))
    read = tables["entries"].select("entry_row", F.col("key").alias("identity_key"), "title", "status", documents.iso_time(F.col("decided_at")).cast("timestamp_ntz").alias("decided_at"))
    return read.join(counts, "entry_row", "left").na.fill(0, ["anchors"])


def canonical_digests(spark: SparkSession, d: str) -> DataFrame:
    """A digest of each report that does not depend on how its JSON is laid out."""
    return table(spark, d, "sarif_reports").select("report_id", text_digest(canonical_json(F.col("payload"))).alias("digest"))


def audit_findings(spark: SparkSession, d: str) -> DataFrame:
    """Audits over the documents that are Python; every fifth counts as a test file."""
    files = DocumentTree(spark, d).files.where("path LIKE '%.py'").selectExpr("path", "text", "doc % 5 = 1 AS in_test")
    return audits.findings(cut(audits.file_facts(files)))


def audit_counts(spark: SparkSession, d: str) -> DataFrame:
    return audits.by_kind(audit_findings(spark, d))


def text_claims(spark: SparkSession, d: str) -> DataFrame:
    return findings.text_claims(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "claim_id", "title")


_TEXT = "CASE WHEN json_type({x}) = 'VARCHAR' THEN json_extract_string({x}, '$') END"


def _text(x: str) -> str:
    return _TEXT.format(x=f"({x})")


_S, _E = (_line_sql(f"(l->'physicalLocation'->'region'->'{k}')") for k in ("startLine", "endLine"))
_URI = "nullif(" + _text("l->'physicalLocation'->'artifactLocation'->'uri'") + ", '')"
_FEED_ID = f"coalesce(nullif({_SIGNATURE}, ''), nullif(CASE WHEN claim_ord % 7 = 0 THEN claim_id END, ''), 'feed-' || sha256(claim_ord || ' ' || coalesce(title, ''))[1:16])"
_SNIFF = f"""SELECT report_id, CASE WHEN coalesce(trim(payload, {TRIM}), '') = '' THEN 'empty' WHEN trim(payload, {TRIM})[1] <> '{{' THEN 'text'
      WHEN NOT json_valid(payload) THEN 'unknown'
      WHEN json_exists(payload, '$."$schema"') OR (json_exists(payload, '$.version') AND json_exists(payload, '$.runs')) THEN 'sarif' ELSE 'unknown' END AS format
      FROM (SELECT report_id, payload FROM sarif_reports)"""
SQL = {
    "report_claims": f"""WITH {P4_TABLES_SQL},
      x AS (SELECT report_id, run_no, result_no, coalesce({_text("res->'message'->'text'")}, '') AS raw, nullif({_text("res->'ruleId'")}, '') AS weakness,
        nullif({_text("res->'level'")}, '') AS severity, {_list_sql("res->'locations'")} AS locs FROM results WHERE json_type(res) = 'OBJECT'),
      t AS (SELECT report_id, run_no, coalesce(nullif({_text("run->'tool'->'driver'->'name'")}, ''), 'unknown') AS tool,
        nullif({_text("run->'tool'->'driver'->'version'")}, '') AS tool_version FROM runs)
      SELECT report_id, run_no, result_no, 'sarif-' || sha256(report_id || ' ' || coalesce(weakness, '') || ' ' || raw)[1:16] AS claim_id,
        CASE WHEN raw <> '' THEN string_split_regex(raw, '{LINE_END}')[1] ELSE coalesce(weakness, '') END AS title,
        weakness, severity, tool, tool_version,
        coalesce(array_to_string(list_filter(list_transform(locs, lambda l: {_URI} || CASE WHEN ({_S}) IS NULL THEN ''
          WHEN ({_E}) IS NULL OR ({_E}) = ({_S}) THEN ':' || ({_S}) ELSE ':' || ({_S}) || '-' || ({_E}) END), lambda u: u IS NOT NULL), '|'), '') AS locators
      FROM x JOIN t USING (report_id, run_no)""",
    "format_sniff": _SNIFF,
    "feed_claims": f"""SELECT claim_ord, {_FEED_ID} AS claim_id, coalesce(title, '') AS title,
      nullif(CASE WHEN claim_ord % 3 = 0 THEN coalesce(weakness || ', ', '') || 'CWE-1' ELSE weakness END, '') AS weakness, nullif(severity, '') AS severity,
      CASE WHEN claim_ord % 5 = 0 AND claim_id IS NOT NULL THEN 'Codex Security' ELSE 'Mantis' END AS tool, coalesce(array_to_string(locators, '|'), '') AS locators FROM claims""",
    "findings_claims": f"""SELECT claim_ord, coalesce(nullif(claim_id, ''), 'finding-' || sha256(coalesce(weakness, '') || ' ' || coalesce(title, ''))[1:16]) AS claim_id,
      CASE WHEN coalesce(title, '') = '' THEN '' ELSE string_split_regex(title, '{LINE_END}')[1] END AS title, nullif(weakness, '') AS weakness, nullif(severity, '') AS severity,
      coalesce(array_to_string(list_transform(locators, lambda x: regexp_replace(x, ':.*', '') || CASE WHEN regexp_extract(x, ':([0-9]+)', 1) = '' THEN '' ELSE ':' || regexp_extract(x, ':([0-9]+)', 1) END), '|'), '') AS locators FROM claims""",
    "load_problems": f"""SELECT 'report/' || report_id AS file, NULL::BIGINT AS line_no, 'neither a JSON document nor JSON lines' AS reason FROM ({_SNIFF}) WHERE format = 'unknown'
      UNION ALL SELECT 'feed/' || claim_ord, unnest([1, 2]), 'not a JSON object' FROM claims WHERE claim_ord % 10 = 0
      UNION ALL SELECT 'text/' || doc_id, NULL, 'neither a JSON document nor JSON lines' FROM documents WHERE trim(text, {TRIM})[1] = '{{' AND NOT json_valid(text)
        AND NOT list_bool_and(list_transform(list_filter(string_split_regex(text, '{LINE_END}'), lambda x: trim(x) <> ''), lambda x: json_valid(x) AND trim(x)[1] = '{{'))""",
    "baseline_documents": """SELECT e.entry_row, identity_key, title, status, decided_at, coalesce(n, 0) AS anchors, first_locator FROM baseline_entries e
      LEFT JOIN (SELECT entry_row, count(*) AS n, min(locator) AS first_locator FROM span_anchors GROUP BY entry_row) a ON a.entry_row = e.entry_row""",
    "text_claims": f"""SELECT doc_id, 'text-' || sha256(text)[1:16] AS claim_id,
      regexp_replace(list_filter(string_split_regex(text, '{LINE_END}'), lambda x: trim(x, {TRIM}) <> '')[1], '^[# ]+', '') AS title
      FROM documents WHERE trim(text, {TRIM}) <> ''""",
}
QUERIES = {
    f.__name__: f
    for f in (
        report_claims, format_sniff, feed_claims, findings_claims, text_claims, loaded_claims, load_problems, baseline_documents,
        canonical_digests, audit_findings, audit_counts,
    )
}
