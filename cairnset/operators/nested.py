"""Nested JSON into related flat tables (Dewey labels).

Every element of a table gets a label: the ordinals on the way from the root to
it. The label of the parent is the label cut to the parent's depth, so tables
join by truncation and need no generated keys. Elements are grouped into tables
by their schema path. All steps are Spark's own VARIANT expressions and
explodes inside one stage: no shuffle, and no state beyond one document.

A VARIANT holds strings of up to 20 million characters and 128 MiB in all. A
document that could go beyond is taken apart in Arrow batches, by the same
steps, into elements that do not hold the elements of tables below them; these
become VARIANTs one by one. What still is too large is reported, not lost.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnset.functions.digest import strip_blanks

VARIANT_ARRAY = "array<variant>"
LARGE_DOCUMENT = 16_000_000  #: a document of more bytes is taken apart before it becomes VARIANTs
LARGEST_ELEMENT = 100_000_000  #: bytes of an element, without the elements of tables below it, that a VARIANT holds for certain
LONG_STRINGS = {"maxStringLen": "2000000000"}


@dataclass(frozen=True)
class NodeTable:
    """One flat table: the elements found below each element of ``parent``.

    ``branches`` maps a branch name to the steps that lead from a parent element
    to its elements: each step names a member whose array (or single object) is
    entered; a step that starts with ``.`` is a plain member and adds no level.
    ``fields`` gives scalar columns as (path, type). With one branch the label
    grows by one ordinal, with several by the branch's ordinal and the element's.
    """

    name: str
    parent: str | None
    branches: dict[str, list[str]]
    fields: dict[str, tuple[str, str]] = field(default_factory=dict)


def member(node: Column, path: str) -> Column:
    """The member at ``path``; null where it is missing or the node is no object."""
    return F.try_variant_get(node, f"$.{path}", "variant")


def is_object(node: Column) -> Column:
    """True for a JSON object, false for anything else, null included."""
    return F.try_variant_get(node, "$", "map<string,variant>").isNotNull()


def elements(node: Column) -> Column:
    """The elements of an array; a single object counts as an array of one; else none."""
    return F.when(is_object(node), F.array(node)).otherwise(
        F.coalesce(F.try_variant_get(node, "$", VARIANT_ARRAY), F.array().cast(VARIANT_ARRAY))
    )


def _enter(found: Column, step: str) -> Column:
    if step.startswith("."):
        return F.transform(found, lambda x: member(x, step[1:]))
    return F.flatten(F.transform(found, lambda x: elements(member(x, step))))


def walk(node: Column, steps: list[str]) -> Column:
    """All elements that the steps reach, in document order."""
    return reduce(_enter, steps, F.array(node))


def _numbered(found: Column, branch: str, branch_no: int) -> Column:
    """Elements with their branch and position."""
    return F.transform(
        found,
        lambda x, i: F.struct(
            F.lit(branch).alias("branch"),
            F.lit(branch_no).alias("branch_no"),
            i.cast("int").alias("pos"),
            x.alias("node"),
        ),
    )


def parse_whole(payload: Column) -> Column:
    """The VARIANT of a text that is valid JSON as a whole; null for anything else.

    Spark's parser stops after the first value and ignores what follows. So the
    text is parsed as the first of two elements, the second a hash of the text
    that the text itself cannot hold: only if both come back is it whole.
    """
    mark = F.md5(payload)
    parsed = F.try_parse_json(F.concat(F.lit("["), payload, F.lit(',"'), mark, F.lit('"]')))

    def first(both: Column) -> Column:
        whole = (F.try_variant_get(both, "$[1]", "string") == mark) & F.try_variant_get(both, "$[2]", "variant").isNull()
        return F.when(whole, F.try_variant_get(both, "$[0]", "variant"))

    # A lambda's argument is computed once, wherever the optimizer moves the expression.
    return F.get(F.transform(F.array(parsed), first), F.lit(0))


def last_key_counts(df: DataFrame, make) -> DataFrame:
    """``make()`` with JSON parsed so that of a repeated key the last one counts: that is valid JSON.

    The parser takes this setting when the expression is made, so the session gets its own back.
    """
    conf, name = df.sparkSession.conf, "spark.sql.variant.allowDuplicateKeys"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        return make()
    finally:
        conf.set(name, before)


def parse_documents(df: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """Root nodes; payloads that are not valid JSON as a whole have a null one.

    Null, blank, truncated and otherwise invalid payloads, and roots that are no
    object, have no members, so they give no rows to any table. They are not
    filtered here: a filter would parse each payload once more. Where an object
    repeats a key, the last one counts.
    """
    label = F.array().cast("array<int>").alias("label")
    return last_key_counts(df, lambda: df.select(*keys, parse_whole(F.col(payload)).alias("node"), label))


def not_json(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def inner_elements(node: object) -> list:
    """What ``elements`` gives, of a parsed document."""
    return node if isinstance(node, list) else [node] if isinstance(node, dict) else []


def reached(node: object, steps: list[str]) -> list:
    """What ``walk`` gives, of a parsed document."""
    found = [node]
    for step in steps:
        inside = [x.get(step.removeprefix(".")) if isinstance(x, dict) else None for x in found]
        found = inside if step.startswith(".") else [y for x in inside for y in inner_elements(x)]
    return found


def take_apart(text: str, tables: list[NodeTable], largest: int) -> Iterator[tuple]:
    """Elements (table, label, parent_label, branch, pos, node) of one document, the node as JSON.

    Nodes are without the members that lead to tables below them. A document or
    an element that gives no row comes out with the table ``rejected`` and the
    reason as its branch.
    """
    try:
        root = json.loads(text, parse_constant=not_json)
    except (ValueError, RecursionError):
        yield "rejected", None, None, "not valid JSON as a whole", None, None
        return
    if not isinstance(root, dict):
        yield "rejected", None, None, "no object on top", None, None
        return
    level: dict[str | None, list[tuple[list[int], object]]] = {None: [([], root)]}
    for t in tables:
        level[t.name] = []
        below = {steps[0] for u in tables if u.parent == t.name for steps in u.branches.values()}
        for above, parent in level[t.parent]:
            for n, (branch, steps) in enumerate(t.branches.items()):
                for pos, node in enumerate(reached(parent, steps)):
                    label = [*above, n, pos] if len(t.branches) > 1 else [*above, pos]
                    level[t.name].append((label, node))
                    own = json.dumps({k: v for k, v in node.items() if k not in below}, ensure_ascii=False) if isinstance(node, dict) else None
                    if own and len(own) * 4 > largest and len(own.encode(errors="surrogatepass")) > largest:
                        yield "rejected", label, above, f"an element of {t.name} is too large", pos, None
                        own = None
                    yield t.name, label, above, branch, pos, own


ELEMENT_SCHEMA = "`table` string, label array<int>, parent_label array<int>, branch string, pos int, node string"


def large_elements(df: DataFrame, keys: list[str], payload: str, tables: list[NodeTable]) -> DataFrame:
    """Elements of the large documents, one document in memory at a time."""
    names = ["table", "label", "parent_label", "branch", "pos", "node"]
    at_once, largest = LARGE_DOCUMENT, LARGEST_ELEMENT
    kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.int32(), pa.string()]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows: list[tuple] = []
                size = 0
                for row in take_apart(batch.column(len(keys))[i].as_py(), tables, largest):
                    rows.append(row)
                    size += len(row[5] or "") + 100
                    if size > at_once:
                        yield made(batch, i, rows)
                        rows, size = [], 0
                if rows:
                    yield made(batch, i, rows)

    def made(batch: pa.RecordBatch, i: int, rows: list[tuple]) -> pa.RecordBatch:
        own = [batch.column(k).take(pa.array([i] * len(rows))) for k in range(len(keys))]
        return pa.RecordBatch.from_arrays([*own, *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)]], names=[*keys, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    large = df.where(F.octet_length(payload) > LARGE_DOCUMENT)
    return large.select(*keys, payload).mapInArrow(split, f"{schema}, {ELEMENT_SCHEMA}")


def rejected_documents(df: DataFrame, keys: list[str], payload: str, tables: list[NodeTable]) -> DataFrame:
    """Keys and ``reason`` of documents that give no rows, or not all: null, not valid JSON, no object on top, an element too large."""
    small = df.where(F.col(payload).isNull() | (F.octet_length(payload) <= LARGE_DOCUMENT))
    roots = parse_documents(small.select(*keys, F.col(payload).alias("_p")), [*keys, "_p"], "_p")
    reason = (
        F.when(F.col("_p").isNull(), "null").when(F.col("node").isNull(), "not valid JSON as a whole").when(~is_object(F.col("node")), "no object on top")
    )
    found = large_elements(df, keys, payload, tables).where("table = 'rejected'").select(*keys, F.col("branch").alias("reason"))
    return roots.select(*keys, reason.alias("reason")).where("reason IS NOT NULL").unionAll(found.distinct())


def shred(df: DataFrame, keys: list[str], payload: str, tables: list[NodeTable]) -> dict[str, DataFrame]:
    """Flat tables by name, each with keys, ``label``, ``parent_label``, ``branch``, ``pos`` and fields.

    ``node`` keeps the element itself for further projection. Elements of an
    unexpected type keep their position and give null fields. ``tables`` must
    list parents before children. In documents of more than LARGE_DOCUMENT bytes
    ``node`` is without the members that lead to tables below.
    """
    small = df.where(F.octet_length(payload) <= LARGE_DOCUMENT)
    made: dict[str | None, DataFrame] = {None: parse_documents(small, keys, payload)}
    split = large_elements(df, keys, payload, tables)
    parsed = F.from_json("node", "variant", LONG_STRINGS)
    large = last_key_counts(df, lambda: split.withColumn("node", parsed))
    shown = {}
    for t in tables:
        several = len(t.branches) > 1
        parts = [_numbered(walk(F.col("node"), s), b, n) for n, (b, s) in enumerate(t.branches.items())]
        inner = made[t.parent].select(*keys, F.col("label").alias("parent_label"), F.explode(F.concat(*parts)).alias("e"))
        step = F.array("e.branch_no", "e.pos") if several else F.array("e.pos")
        made[t.name] = inner.select(*keys, F.concat("parent_label", step).alias("label"), "parent_label", "e.branch", "e.pos", "e.node")
        both = made[t.name].unionByName(large.where(F.col("table") == t.name).select(*made[t.name].columns))
        shown[t.name] = both.select("*", *[F.try_variant_get("node", f"$.{p}", kind).alias(c) for c, (p, kind) in t.fields.items()])
    return shown


def parent_of(label: Column, depth: int) -> Column:
    """A label cut to ``depth`` ordinals."""
    return F.slice(label, 1, depth)


def line_number(node: Column) -> Column:
    """A whole number above 0, written as a number or as a string of digits; else null.

    Leading zeros do not count; fractions, signs, blanks and booleans give null.
    """
    kind, text = F.schema_of_variant(node), F.try_variant_get(node, "$", "string")
    number = F.try_variant_get(node, "$", "decimal(38,6)")
    digits = F.when(kind == "STRING", F.nullif(F.regexp_extract(text, "^0*([1-9][0-9]*)$", 1), F.lit("")))
    whole = F.when(
        (kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")) & (number > 0) & (number == F.floor(number)),
        number.cast("decimal(38,0)").cast("string"),
    )
    return F.coalesce(digits, whole)


def locator_text(uri: Column, start: Column, end: Column) -> Column:
    """``uri``, ``uri:n`` or ``uri:n-m``; an end without a start, or equal to it, adds nothing."""
    tail = F.when(start.isNull(), "").when(end.isNull() | (end == start), F.concat(F.lit(":"), start))
    return F.concat(uri, tail.otherwise(F.concat(F.lit(":"), start, F.lit("-"), end)))


REPORT_TABLES = [
    NodeTable(
        "runs",
        None,
        {"runs": ["runs"]},
        {"tool": ("tool.driver.name", "string"), "tool_version": ("tool.driver.version", "string")},
    ),
    NodeTable(
        "results",
        "runs",
        {"results": ["results"]},
        {"rule_id": ("ruleId", "string"), "level": ("level", "string"), "message": ("message.text", "string")},
    ),
    NodeTable(
        "locations",
        "results",
        {
            "locations": ["locations"],
            "relatedLocations": ["relatedLocations"],
            "codeFlows": ["codeFlows", "threadFlows", "locations", ".location"],
        },
    ),
]


def report_tables(reports: DataFrame) -> dict[str, DataFrame]:
    """Runs, results and locations of reports, linked by label.

    A report delivered twice under two ids stays two reports. Of the other
    columns of ``reports`` only ``report_id`` and ``payload`` are read.
    """
    made = shred(reports, ["report_id"], "payload", REPORT_TABLES)
    place = "physicalLocation"
    uri = member(F.col("node"), f"{place}.artifactLocation.uri")
    text = F.when(F.schema_of_variant(uri) == "STRING", F.try_variant_get(uri, "$", "string"))
    made["locations"] = made["locations"].select(
        "*",
        text.alias("uri"),
        line_number(member(F.col("node"), f"{place}.region.startLine")).alias("start_line"),
        line_number(member(F.col("node"), f"{place}.region.endLine")).alias("end_line"),
    )
    return {name: t.drop("node") for name, t in made.items()}


def rejected_reports(reports: DataFrame) -> DataFrame:
    """report_id and reason of each report that gives no rows, or not all of its rows."""
    return rejected_documents(reports, ["report_id"], "payload", REPORT_TABLES)


def report_locations(reports: DataFrame) -> DataFrame:
    """One row per location with a usable uri: its place in the report and its locator."""
    found = report_tables(reports)["locations"].where(F.length(strip_blanks(F.col("uri"))) > 0)
    return found.select(
        "report_id",
        F.col("parent_label")[0].alias("run_no"),
        F.col("parent_label")[1].alias("result_no"),
        "branch",
        F.col("pos").alias("loc_no"),
        locator_text(F.col("uri"), F.col("start_line"), F.col("end_line")).alias("locator"),
    )
