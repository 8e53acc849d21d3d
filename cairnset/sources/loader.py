"""One loader for finding files of every format, and what it cannot read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnset.functions.text import split_lines
from cairnset.operators import nested
from cairnset.session import cut
from cairnset.sources import findings

COLUMNS = "file string, place bigint, claim_id string, title string, raw_text string, locators array<string>, weakness string, severity string, tool string, tool_version string, format string"


def file_lines(files: DataFrame) -> DataFrame:
    """file, line_no (from 1) and line of the non-blank lines."""
    lines = files.select("file", F.posexplode(split_lines(F.col("text"))).alias("i", "line"))
    return lines.where(F.trim("line") != "").select("file", (F.col("i") + 1).cast("bigint").alias("line_no"), "line")


def sniffed(files: DataFrame) -> DataFrame:
    """Files (file, text) with their format, found once."""
    return cut(files.select("file", "text", findings.sniff(F.col("text")).alias("format")))


def problems(known: DataFrame) -> DataFrame:
    """(file, line_no, reason) of sniffed files: formats that are not known, and lines of a feed that are no JSON object."""
    unknown = known.where("format = 'unknown'").select("file", F.lit(None).cast("bigint").alias("line_no"), F.lit("neither a JSON document nor JSON lines").alias("reason"))
    line = F.coalesce(nested.is_object(nested.parse_whole(F.col("line"))), F.lit(False))
    bad = file_lines(known.where("format = 'feed'")).where(~line)
    return unknown.unionAll(bad.select("file", "line_no", F.lit("not a JSON object").alias("reason")))


def claims_of(known: DataFrame) -> DataFrame:
    """Claims of sniffed files; empty files and lines that cannot be read give none (see ``problems``).

    ``place`` is the claim's number in a document, its line in a feed, 0 in a text.
    """
    of = lambda kind: known.where(F.col("format") == kind)
    reports = findings.report_claims(of("sarif"), "file", "text")
    feed = findings.feed_claims(file_lines(of("feed")), ["file", "line_no"], "line")
    parts = [
        reports.withColumn("place", (F.col("run_no") * 1_000_000 + F.col("result_no")).cast("bigint")).withColumn("format", F.lit("sarif")),
        findings.findings_claims(of("findings"), "file", "text").withColumn("format", F.lit("findings")),
        feed.withColumnRenamed("line_no", "place").withColumn("format", F.lit("feed")),
        findings.text_claims(of("text"), "file", "text").withColumn("place", F.lit(0).cast("bigint")).withColumn("format", F.lit("text")),
    ]
    made = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return made.select(*[c.split()[0] for c in COLUMNS.split(", ")]).withColumn("locators", F.coalesce("locators", F.array().cast("array<string>")))


def load_claims(files: DataFrame) -> DataFrame:
    """Claims of files (file, text) of any format; an error that names the file and the line if one cannot be read."""
    known = sniffed(files)
    first = problems(known).orderBy("file", "line_no").first()
    if first is not None:
        raise ValueError(f"{first['file']}{'' if first['line_no'] is None else ':' + str(first['line_no'])}: {first['reason']}")
    return claims_of(known)
