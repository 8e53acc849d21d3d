"""Readers of finding files: reports, findings documents, feeds of JSON lines and plain text.

Each takes rows of whole texts (or lines), so the same reader serves files, a
table's column or a stream. Claims come out with id, claim_id, title, raw_text,
locators, weakness, severity, tool, tool_version. A member that is not a string
counts as missing where a string is wanted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnset.functions.digest import strip_blanks
from cairnset.functions.jsontext import pretty_json
from cairnset.functions.text import first_line, split_lines
from cairnset.operators import nested

#: Members that tell the formats apart.
FEED_KEYS = ["signature", "code_paths", "finding_id"]
#: The tool of a feed by the prefix of a row's signature, and where none fits.
FEED_TOOLS = {"codex-security/": "Codex Security"}
FEED_TOOL = "Mantis"
#: Folders that a source scan passes over.
SKIPPED_FOLDERS = [".venv", "site-packages", "__pycache__", ".git"]
LARGEST_FILE = 1_000_000


def text_of(node: Column, path: str) -> Column:
    """The string at a path; null if there is none or it is no string."""
    found = nested.member(node, path)
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(found, "$", "string"))


def filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def sniff(raw: Column) -> Column:
    """empty, text, sarif, findings, feed or unknown, by content; null counts as empty."""
    node = nested.parse_whole(raw)
    keys = F.map_keys(F.try_variant_get(node, "$", "map<string,variant>"))
    has = lambda *names: F.arrays_overlap(keys, F.array(*map(F.lit, names)))
    lines = F.filter(split_lines(raw), lambda x: F.trim(x) != "")
    all_objects = F.forall(lines, lambda x: nested.is_object(F.try_parse_json(x)))
    kind = (
        F.when(F.coalesce(strip_blanks(raw), F.lit("")) == "", "empty")
        .when(~F.startswith(strip_blanks(raw), F.lit("{")), "text")
        .when(has("$schema") | (has("version") & has("runs")), "sarif")
        .when(has("findings") & has("documentType"), "findings")
        .when(has(*FEED_KEYS), "feed")
    )
    return F.coalesce(kind, F.when(node.isNull() & all_objects, "feed"), F.lit("unknown"))


def digest_id(prefix: str, *parts: Column) -> Column:
    """A stable id: the prefix and 16 hex digits over the parts, missing ones empty."""
    joined = F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.encode(joined, "UTF-8"), 256), 1, 16))


def place_of(location: Column) -> Column:
    """Locator of a report's location; null without a uri."""
    uri = filled(text_of(location, "physicalLocation.artifactLocation.uri"))
    lines = [nested.line_number(nested.member(location, f"physicalLocation.region.{k}")) for k in ("startLine", "endLine")]
    return nested.locator_text(uri, *lines)


def report_claims(reports: DataFrame, key: str = "report_id", payload: str = "payload") -> DataFrame:
    """One claim per result of each run; elements that are no objects are passed over."""
    results = nested.shred(reports, [key], payload, nested.REPORT_TABLES[:2])
    tools = results["runs"].select(
        key, F.col("label").alias("parent_label"),
        F.coalesce(filled(text_of(F.col("node"), "tool.driver.name")), F.lit("unknown")).alias("tool"),
        filled(text_of(F.col("node"), "tool.driver.version")).alias("tool_version"),
    )
    places = F.filter(F.transform(nested.walk(F.col("node"), ["locations"]), place_of), lambda x: x.isNotNull())
    rows = results["results"].where(nested.is_object(F.col("node"))).select(
        key, "parent_label", F.col("pos").alias("result_no"),
        F.coalesce(text_of(F.col("node"), "message.text"), F.lit("")).alias("raw_text"),
        filled(text_of(F.col("node"), "ruleId")).alias("weakness"),
        filled(text_of(F.col("node"), "level")).alias("severity"),
        places.alias("locators"),
    )
    title = F.when(F.col("raw_text") != "", first_line(F.col("raw_text"))).otherwise(F.coalesce("weakness", F.lit("")))
    return rows.join(tools, [key, "parent_label"]).select(
        key, F.col("parent_label")[0].alias("run_no"), "result_no", digest_id("sarif", F.col(key).cast("string"), F.col("weakness"), F.col("raw_text")).alias("claim_id"),
        title.alias("title"), "raw_text", "locators", "weakness", "severity", "tool", "tool_version",
    )


def string_list(node: Column, path: str) -> Column:
    """The strings of a list; a single string counts as a list of one."""
    items = F.coalesce(F.try_variant_get(nested.member(node, path), "$", nested.VARIANT_ARRAY), F.array().cast(nested.VARIANT_ARRAY))
    texts = F.filter(F.transform(items, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))), lambda x: x.isNotNull())
    return F.when(text_of(node, path).isNotNull(), F.array(text_of(node, path))).otherwise(texts)


def feed_claims(lines: DataFrame, key: str | list[str], line: str) -> DataFrame:
    """One claim per JSON line that is an object: signature, else finding_id, else a digest of key and title names it.

    The tool follows from the signature's prefix. The raw text is the row in one
    fixed form, so that it is the same however the row was spelled.
    """
    keys = [key] if isinstance(key, str) else key
    rows = lines.select(*keys, line, nested.parse_whole(F.col(line)).alias("node"))
    n = F.col("node")
    signature, title = filled(text_of(n, "signature")), F.coalesce(text_of(n, "title"), F.lit(""))
    named = F.coalesce(signature, filled(text_of(n, "finding_id")), digest_id("feed", F.col(keys[0]).cast("string"), title))
    tool = reduce(lambda other, x: F.when(F.startswith(signature, F.lit(x[0])), x[1]).otherwise(other), FEED_TOOLS.items(), F.lit(FEED_TOOL))
    return rows.where(nested.is_object(n)).select(
        *keys, named.alias("claim_id"), title.alias("title"), pretty_json(F.col(line)).alias("raw_text"),
        string_list(n, "code_paths").alias("locators"), filled(F.array_join(string_list(n, "cwe"), ", ")).alias("weakness"),
        filled(text_of(n, "severity")).alias("severity"), tool.alias("tool"),
    )


def findings_claims(documents: DataFrame, key: str, payload: str) -> DataFrame:
    """One claim per finding of a findings document; severity may be a string or an object with a level."""
    table = nested.NodeTable("findings", None, {"findings": ["findings"]})
    rows = nested.shred(documents, [key], payload, [table])["findings"].where(nested.is_object(F.col("node")))
    n = F.col("node")

    def place(x: Column) -> Column:
        return nested.locator_text(filled(text_of(x, "path")), *[nested.line_number(nested.member(x, k)) for k in ("startLine", "endLine")])

    summary = F.coalesce(text_of(n, "summary"), F.lit(""))
    named = F.coalesce(filled(text_of(n, "findingId")), digest_id("finding", text_of(n, "ruleId"), summary))
    return rows.select(
        key, named.alias("claim_id"), first_line(summary).alias("title"), F.try_variant_get(n, "$", "string").alias("raw_text"),
        F.filter(F.transform(nested.walk(n, ["locations"]), place), lambda x: x.isNotNull()).alias("locators"),
        F.coalesce(filled(text_of(n, "identity.cwe")), filled(text_of(n, "ruleId"))).alias("weakness"),
        F.coalesce(filled(text_of(n, "severity")), filled(text_of(n, "severity.level"))).alias("severity"),
    )


def text_claims(texts: DataFrame, key: str, text: str) -> DataFrame:
    """One claim without locators per non-blank text; its title is the first non-blank line without ``#`` and blanks before it."""
    lines = F.filter(split_lines(F.col(text)), lambda x: F.length(strip_blanks(x)) > 0)
    title = F.regexp_replace(F.get(lines, F.lit(0)), "^[# ]+", "")
    rows = texts.where(F.length(strip_blanks(F.col(text))) > 0)
    return rows.select(key, digest_id("text", F.col(text)).alias("claim_id"), title.alias("title"), F.col(text).alias("raw_text"))


def source_tree(spark: SparkSession, root: str, pattern: str = "*.py") -> DataFrame:
    """path (below the root), text and state of source files: ``text``, ``not_utf8`` or ``too_large``.

    The usual generated folders are passed over. A file above a megabyte has a
    null text like one that is not UTF-8, so citations of it resolve without a
    quotation; size and path are looked at before any content is read.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    skipped = "(^|/)(" + "|".join(x.replace(".", "\\.") for x in SKIPPED_FOLDERS) + ")/"
    below = F.regexp_replace(F.col("path"), "^.*?" + root.rstrip("/").replace(".", "\\.") + "/", "")
    named = read.withColumn("path", below).where(~F.col("path").rlike(skipped))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    small = named.where(F.col("length") <= LARGEST_FILE).select("path", text.alias("text"))
    large = named.where(F.col("length") > LARGEST_FILE).select("path", F.lit(None).cast("string").alias("text"), F.lit("too_large").alias("state"))
    return small.withColumn("state", F.when(F.col("text").isNull(), "not_utf8").otherwise("text")).unionAll(large)
