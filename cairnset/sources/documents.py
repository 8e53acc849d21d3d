"""Readers of the documents that triage keeps: baselines, records, manifests and recordings.

Each document becomes flat tables by the labels of ``operators.nested``. A
document of another format is an error when its rows are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnset.operators import folds, nested
from cairnset.operators.nested import NodeTable

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def iso_text(at: Column) -> Column:
    """A time without zone, taken as UTC, in ISO 8601."""
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def iso_time(text: Column) -> Column:
    """The time in UTC of an ISO 8601 text with an offset or ``Z``, with or without a fraction; else null."""
    return F.try_to_timestamp(F.nullif(F.regexp_replace(text, "Z$", "+00:00"), F.lit("")))


def strings(*paths: str) -> dict[str, tuple[str, str]]:
    return {p.rsplit(".", 1)[-1] if "." in p else p: (p, "string") for p in paths}


BASELINE = [
    NodeTable("entries", None, {"entries": ["entries"]}, strings(
        "identity.key", "identity.kind", "identity.basis", "title", "status", "justification", "impact_statement", "reason", "decided_by", "decided_at", "override_reason", "commit")),
    NodeTable("anchors", "entries", {"anchors": ["anchors"]}, strings("locator", "path", "sha256", "symbol", "symbol_sha256")),
]
RECORDS = [
    NodeTable("records", None, {"records": ["records"]}, strings("claim.claim_id", "claim.title", "disposition.status", "recorded_at", "target.commit")),
    NodeTable("locators", "records", {"locators": ["locators"]}, strings("locator", "path", "resolution", "content_hash")),
    NodeTable("candidates", "records", {"candidates": ["assessment", "candidates"]}, strings("justification")),
]
MANIFEST = [
    NodeTable("artifacts", None, {"artifacts": ["artifacts"]}, {**strings("role", "path", "sha256"), "size": ("size", "bigint")}),
    NodeTable("quoted_spans", None, {"quoted_spans": ["quoted_spans"]}, {**strings("claim_id", "locator", "path", "sha256"), "start_line": ("start_line", "bigint"), "end_line": ("end_line", "bigint"), "truncated": ("truncated", "boolean")}),
]


def tables_of(documents: DataFrame, key: str, text: str, tables: list[NodeTable], format_name: str | None = None) -> dict[str, DataFrame]:
    """Tables by name, with the key, label, parent_label and pos. With ``format_name`` any other ``format`` is an error."""
    if format_name is not None:
        said = F.try_variant_get(nested.parse_whole(F.col(text)), "$.format", "string")
        wrong = F.raise_error(F.concat(F.col(key).cast("string"), F.lit(f" is not of format {format_name}"))).cast("string")
        documents = documents.withColumn(text, F.when(said.eqNullSafe(F.lit(format_name)), F.col(text)).otherwise(wrong))
    return {n: t.drop("node", "branch") for n, t in nested.shred(documents, [key], text, tables).items()}


def record_lists(documents: DataFrame, text: str) -> DataFrame:
    """Record files are bare lists: wrapped, so that they read as documents; the text of each record stays beside it (``records.node``)."""
    return documents.withColumn(text, F.concat(F.lit('{"records": '), F.col(text), F.lit("}")))


def records_with_text(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Typed rows of records and, beside each, the record as JSON text: members that no column names are only there."""
    made = nested.shred(record_lists(documents, text), [key], text, RECORDS[:1])["records"]
    return made.withColumn("raw", F.try_variant_get("node", "$", "string")).drop("node", "branch")


def recordings(lines: DataFrame, order: str, line: str) -> DataFrame:
    """The last recording of each request: request_hash, order, provider, model, response; blank and unreadable lines are passed over."""
    node = nested.parse_whole(F.col(line))
    rows = lines.select(order, *[F.try_variant_get(node, f"$.{p}", "string").alias(p) for p in ("request_hash", "provider", "model", "response")])
    return folds.last_write(rows.where("request_hash IS NOT NULL"), ["request_hash"], order)


def baseline_entries(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Entries of baseline documents by identity key; of a key that comes twice in a document the later one wins."""
    rows = tables_of(documents, key, text, BASELINE)["entries"].where("key IS NOT NULL").withColumnRenamed("key", "identity_key")
    return folds.last_write(rows.drop("label", "parent_label"), [key, "identity_key"], "pos")


def write_rows(rows: DataFrame, path: str, *order: str) -> None:
    """Writes rows as JSON lines, nulls kept, sorted by ``order``."""
    line = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    rows.orderBy(*order).select(line.alias("value")).write.text(path)
