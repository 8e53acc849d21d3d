"""Binding records to the bytes they speak of, and checking them later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnset.functions.digest import bytes_digest
from cairnset.operators import folds, locators


def artifacts(expected: DataFrame, files: DataFrame) -> DataFrame:
    """Digest and size of each expected (role, path) from files (path, content).

    A file that is missing or cannot be read (null content) has a null digest
    and size, never a placeholder that would later count as contradicted.
    """
    read = files.select("path", bytes_digest(F.col("content")).alias("sha256"), F.octet_length("content").cast("bigint").alias("size"))
    return expected.select("role", "path").join(read, "path", "left")


def compared(recorded: Column, now: Column) -> Column:
    """verified or contradicted; unverifiable where either digest is missing."""
    return F.when(recorded.isNull() | now.isNull(), "unverifiable").when(recorded == now, "verified").otherwise("contradicted")


def check_artifacts(recorded: DataFrame, files: DataFrame) -> DataFrame:
    """Recorded artifacts (role, path, sha256) with their verdict by the files as they are now."""
    now = files.select("path", bytes_digest(F.col("content")).alias("now"))
    checked = recorded.select("role", "path", "sha256").join(now, "path", "left")
    return checked.select("role", "path", compared(F.col("sha256"), F.col("now")).alias("verdict"))


def check_spans(recorded: DataFrame, cells: DataFrame | None) -> DataFrame:
    """Recorded spans (ord, pos, locator, sha256), each resolved again; without a tree none can be verified."""
    if cells is None:
        return recorded.select("ord", "pos", "locator", F.lit("unverifiable").alias("verdict"))
    now = locators.resolve(recorded.select("ord", "pos", "locator"), cells).select("ord", "pos", F.col("content_hash").alias("now"))
    return recorded.join(now, ["ord", "pos"]).select("ord", "pos", "locator", compared(F.col("sha256"), F.col("now")).alias("verdict"))


def bindings(named: DataFrame, checks: DataFrame, key: str) -> DataFrame:
    """One verdict per binding: of all its checks (key, verdict); one without any check is unverifiable."""
    folded = checks.groupBy(key).agg(F.count("*").alias("checks"), folds.combine(F.col("verdict")).alias("verdict"))
    joined = named.select(key).join(folded, key, "left")
    return joined.select(key, F.coalesce("checks", F.lit(0)).alias("checks"), F.coalesce("verdict", F.lit("unverifiable")).alias("verdict"))
