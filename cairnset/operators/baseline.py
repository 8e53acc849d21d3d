"""Anchors of decisions, and what became of the anchored text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnset.functions.digest import text_digest
from cairnset.operators import callgraph, folds, locators


def quoted_citations(resolved: DataFrame) -> DataFrame:
    """Citations that resolve and have a digest: only those have text to compare."""
    return resolved.where("resolution = 'resolves' AND content_hash IS NOT NULL")


def body_digests(spans: DataFrame, cells: DataFrame) -> DataFrame:
    """file, first, last and the digest of the lines between, for distinct spans."""
    return locators.span_texts(spans, cells).select("file", "first", "last", text_digest(F.col("text")).alias("symbol_sha256"))


def anchor_rows(resolved: DataFrame, functions: DataFrame, cells: DataFrame) -> DataFrame:
    """Anchors (ord, pos, locator, path, file, sha256, symbol, symbol_sha256) of the quoted citations.

    The symbol is the innermost function around the first cited line, its digest
    that of all its lines; both are null where no function is around it.
    """
    quoted = quoted_citations(resolved)
    points = quoted.select("ord", "pos", F.col("file").alias("path"), F.col("start_line").alias("line"))
    around = callgraph.enclosing(points, functions).where("name IS NOT NULL")
    named = around.selectExpr("ord", "pos", "path AS file", "name AS symbol", "start_line AS first", "end_line AS last")
    symbols = named.join(body_digests(named, cells), ["file", "first", "last"], "left").select("ord", "pos", "symbol", "symbol_sha256")
    return quoted.select("ord", "pos", "locator", "path", "file", F.col("content_hash").alias("sha256")).join(symbols, ["ord", "pos"], "left")


def digests_by_name(wanted: DataFrame, functions: DataFrame, cells: DataFrame) -> DataFrame:
    """(file, symbol, symbol_now) for wanted (file, symbol): the function of that name, wherever it is now.

    Only a name that its file defines exactly once can answer. Functions are
    counted before they meet anything, so the join never multiplies rows.
    """
    once = functions.groupBy(F.col("path").alias("file"), F.col("name").alias("symbol")).agg(
        F.count("*").alias("n"), F.min("start_line").alias("first"), F.min("end_line").alias("last")
    )
    found = wanted.select("file", "symbol").distinct().join(once.where("n = 1").drop("n"), ["file", "symbol"])
    digests = body_digests(found, cells).withColumnRenamed("symbol_sha256", "symbol_now")
    return found.join(digests, ["file", "first", "last"]).select("file", "symbol", "symbol_now")


def anchor_states(anchors: DataFrame, functions: DataFrame, cells: DataFrame) -> DataFrame:
    """Each anchor with sha_now, symbol_now and its state in the tree as it is now.

    The locator is resolved again, so the cap on quoted lines and the rules for
    paths are the same then and now; the function is looked up by its name.
    """
    again = locators.resolve(anchors.select("ord", "pos", "locator"), cells).select("ord", "pos", F.col("content_hash").alias("sha_now"))
    named = digests_by_name(anchors.where("symbol_sha256 IS NOT NULL"), functions, cells)
    state = folds.span_state(F.col("sha256"), F.col("sha_now"), F.col("symbol_sha256"), F.col("symbol_now"))
    joined = anchors.join(again, ["ord", "pos"]).join(named, ["file", "symbol"], "left")
    return joined.select("ord", "pos", "locator", "sha256", "sha_now", "symbol", "symbol_sha256", "symbol_now", state.alias("span_state"))
