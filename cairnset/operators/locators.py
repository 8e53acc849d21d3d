"""Do citations point at text that exists?

Texts are split into lines once, by ``line_cells``: a table of files in cells of
64 lines. Citations meet only the number of lines of their file; the lines
themselves are read where a span is quoted, from the one or two cells it lies in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnset.functions.digest import text_digest
from cairnset.functions.text import QUOTED_LINES, clean_path, parse_locator, split_lines

RESOLUTIONS = ["resolves", "path_absent", "line_out_of_range", "not_a_locator"]
LINES_PER_CELL = 64
SHOWN_UNRESOLVED = 5


def parsed(citations: DataFrame) -> DataFrame:
    """Citations (ord, pos, locator) with path, start_line and end_line."""
    return citations.select("ord", "pos", "locator", *[c.alias(n) for n, c in parse_locator(F.col("locator")).items()])


def line_cells(files: DataFrame) -> DataFrame:
    """Files (path, text) as rows (file, cell, line_count, lines) of 64 lines each, the path cleaned.

    A null text, of a file that is no text, gives one cell without count and
    lines; an empty one a cell with count 0. Of two texts of one path the rows of
    both come out, so paths must be distinct.
    """
    split = files.select(clean_path(F.col("path")).alias("file"), split_lines(F.col("text")).alias("all"))
    count = F.size(F.col("all")).cast("bigint")
    last = F.greatest(F.lit(0), F.floor((F.coalesce(count, F.lit(0)) - 1) / LINES_PER_CELL)).cast("int")
    laid = split.select("file", "all", F.when(F.col("all").isNotNull(), count).alias("line_count"), F.explode(F.sequence(F.lit(0), last)).alias("cell"))
    return laid.select("file", "cell", "line_count", F.slice("all", F.col("cell") * LINES_PER_CELL + 1, LINES_PER_CELL).alias("lines"))


def file_counts(cells: DataFrame) -> DataFrame:
    """file and line_count of each file."""
    return cells.where("cell = 0").select("file", "line_count")


def resolutions(citations: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per citation: its parts, file, line_count and resolution; no text is read.

    ``counts`` has file and line_count, null for a file that is no text. Paths
    meet without ``.``, ``x/..`` and empty steps and come out as spelled;
    citations of a very popular file are spread by the adaptive skew join.
    """
    named = parsed(citations).withColumn("file", clean_path(F.col("path")))
    joined = named.join(counts.select("file", "line_count", F.lit(True).alias("there")), "file", "left")
    start, end, count = F.col("start_line"), F.col("end_line"), F.col("line_count")
    state = (
        F.when(F.col("path").isNull(), "not_a_locator")
        .when(F.col("there").isNull(), "path_absent")
        .when(start.isNull(), "resolves")
        .when(end < start, "line_out_of_range")
        .when((start > count) | (end > count), "line_out_of_range")
        .otherwise("resolves")
    )
    shown = F.when(start.isNotNull(), count).alias("line_count")
    return joined.select("ord", "pos", "locator", "path", "file", "start_line", "end_line", shown, state.alias("resolution"))


def span_texts(spans: DataFrame, cells: DataFrame) -> DataFrame:
    """Distinct spans (file, first, last) with their ``text``: lines joined by line feeds.

    Spans meet the cells they touch by file and cell, so a span brings together
    no more than its own lines.
    """
    touched = F.sequence(*[F.floor((F.col(c) - 1) / LINES_PER_CELL).cast("int") for c in ("first", "last")])
    wanted = spans.select("file", "first", "last").distinct().withColumn("cell", F.explode(touched))
    before = F.col("cell") * LINES_PER_CELL
    lower = F.greatest(F.col("first") - before, F.lit(1))
    piece = F.slice("lines", lower.cast("int"), (F.least(F.col("last") - before, F.lit(LINES_PER_CELL)) - lower + 1).cast("int"))
    pieces = wanted.join(cells.select("file", "cell", "lines"), ["file", "cell"]).select("file", "first", "last", "cell", F.array_join(piece, "\n").alias("t"))
    listed = F.array_sort(F.collect_list(F.struct("cell", "t")))
    return pieces.groupBy("file", "first", "last").agg(F.array_join(F.transform(listed, lambda x: x["t"]), "\n").alias("text"))


def quoted_end() -> Column:
    """The last line that a citation quotes: at most 40 lines."""
    return F.least("end_line", F.col("start_line") + QUOTED_LINES - 1)


def is_quoted() -> Column:
    """Whether a citation has a quotation: it resolves, names a line, and its file is text."""
    return (F.col("resolution") == "resolves") & F.col("line_count").isNotNull()


def resolve(citations: DataFrame, cells: DataFrame) -> DataFrame:
    """``resolutions`` with the quoted text (40 lines at most), its digest, and whether it was cut off.

    A citation without a line, or of a file that is no text, resolves without a quotation.
    """
    found = resolutions(citations, file_counts(cells)).withColumn("last", F.when(is_quoted(), quoted_end()))
    spans = found.where("last IS NOT NULL").selectExpr("file", "start_line AS first", "last")
    texts = span_texts(spans, cells).select("file", F.col("first").alias("start_line"), "last", F.col("text").alias("quoted_text"))
    cut_off = F.coalesce(F.col("last").isNotNull() & (F.col("end_line") > F.col("last")), F.lit(False))
    return found.join(texts, ["file", "start_line", "last"], "left").select(
        "ord", "pos", "locator", "path", "file", "start_line", "end_line", "resolution", "line_count", "quoted_text",
        text_digest(F.col("quoted_text")).alias("content_hash"), cut_off.alias("truncated"),
    )


def resolution_counts(resolved: DataFrame) -> DataFrame:
    """Per claim the number of citations and of each resolution, zero where there is none."""
    counts = [F.count_if(F.col("resolution") == r).alias(r) for r in RESOLUTIONS]
    return resolved.groupBy("ord").agg(F.count("*").alias("total"), *counts)


def fully_unresolved(resolved: DataFrame) -> DataFrame:
    """Claims that cite something of which nothing resolves."""
    return resolution_counts(resolved).where("total > 0 AND resolves = 0").select("ord")


def first_quoted(resolved: DataFrame) -> DataFrame:
    """Per claim the first resolved citation with a quotation, else the first resolved."""
    rank = F.struct(F.when(is_quoted(), 0).otherwise(1).alias("q"), "pos")
    pick = F.min_by(F.struct("pos", "locator"), rank).alias("p")
    return resolved.where("resolution = 'resolves'").groupBy("ord").agg(pick).select("ord", "p.pos", "p.locator")


def shown_unresolved(resolved: DataFrame, most: int = SHOWN_UNRESOLVED) -> DataFrame:
    """Per claim the number of unresolved citations and the first ``most`` of them in the order given.

    A claim's citations are one list of a row, so a group is as large as a row.
    """
    open_ = resolved.where("resolution <> 'resolves'").groupBy("ord")
    first = F.slice(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("locator", F.lit("")).alias("l")))), 1, most)
    return open_.agg(F.count("*").alias("unresolved"), F.transform(first, lambda x: x["l"]).alias("shown"))
