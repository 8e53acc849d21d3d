"""Audits over syntax trees: what is declared and never used, raised or able to fail."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnset.operators.callgraph import LARGEST_FILE

#: Bases of an enumeration, and of an exception class.
ENUM_BASES = {"Enum", "StrEnum", "IntEnum", "Flag", "IntFlag"}
ERROR_BASES = {"Exception", "ValueError", "RuntimeError", "TypeError", "OSError"}
SCHEMA = "path string, kind string, name string, line int, in_test boolean"


def last_name(node: ast.AST | None) -> str | None:
    """The name of a plain or dotted expression, of what is called if it is a call."""
    node = node.func if isinstance(node, ast.Call) else node
    return getattr(node, "id", None) or getattr(node, "attr", None)


def class_facts(node: ast.ClassDef) -> Iterator[tuple[str, str, int]]:
    if ENUM_BASES & set(map(last_name, node.bases)):
        targets = [t for s in node.body if isinstance(s, ast.Assign) for t in s.targets if isinstance(t, ast.Name)]
        yield from (("member", f"{node.name}.{t.id}", t.lineno) for t in targets if t.id.isupper())
    plain = {b.id for b in node.bases if isinstance(b, ast.Name)}
    if node.name.endswith(("Error", "Exception")) or ERROR_BASES & plain:
        yield "error_class", node.name, node.lineno


def cannot_fail(test: ast.AST) -> str | None:
    """Why a test function cannot fail, or None: its assertions are all of literals, or it neither asserts, expects an error nor calls."""
    inside = list(ast.walk(test))
    asserts = [n for n in inside if isinstance(n, ast.Assert)]
    if asserts:
        live = (ast.Name, ast.Call, ast.Attribute, ast.Subscript)
        dead = not any(isinstance(x, live) for a in asserts for x in ast.walk(a.test))
        return "literal_assertions" if dead else None
    return None if any(isinstance(n, ast.Call) for n in inside) else "nothing_checked"


def facts(path: str, text: str, in_test: bool) -> list[tuple]:
    """(path, kind, name, line, in_test) of one file; nothing if it is not Python."""
    try:
        nodes = list(ast.walk(ast.parse(text)))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    found: list[tuple[str, str, int]] = []
    for node in nodes:
        if isinstance(node, ast.ClassDef):
            found += class_facts(node)
        elif isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name):
            found.append(("reference", f"{node.value.id}.{node.attr}", node.lineno))
        elif isinstance(node, ast.Raise) and last_name(node.exc):
            found.append(("raise", last_name(node.exc), node.lineno))
        elif in_test and isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) and node.name.startswith("test") and cannot_fail(node):
            found.append((cannot_fail(node), node.name, node.lineno))
    return [(path, *f, in_test) for f in found]


def file_facts(files: DataFrame) -> DataFrame:
    """Facts of Python files (path, text, in_test) of up to a megabyte; larger ones give one row of kind ``too_large``."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            yield pd.DataFrame([r for p, t, i in zip(batch["path"], batch["text"], batch["in_test"]) for r in facts(p, t, bool(i))], columns=names)

    size = F.octet_length("text")
    parsed = files.where(size <= LARGEST_FILE).select("path", "text", "in_test").mapInPandas(parse, SCHEMA)
    large = files.where(size > LARGEST_FILE).selectExpr("path", "'too_large' AS kind", "path AS name", "1 AS line", "in_test")
    return parsed.unionAll(large)


def findings(found: DataFrame) -> DataFrame:
    """(kind, name, path, line): members that no code outside tests refers to, error classes it never raises, tests that cannot fail."""
    code = found.where("NOT in_test")

    def declared(kind: str, used: str, name: str) -> DataFrame:
        names = code.where(F.col("kind") == used).select("name").distinct()
        rows = code.where(F.col("kind") == kind).groupBy("name").agg(F.max(F.struct("path", "line")).alias("at"))
        return rows.join(names, "name", "left_anti").select(F.lit(name).alias("kind"), "name", "at.path", "at.line")

    tests = found.where("in_test AND kind IN ('literal_assertions', 'nothing_checked')").select(F.lit("test_cannot_fail").alias("kind"), "name", "path", "line")
    return declared("member", "reference", "unused_member").unionAll(declared("error_class", "raise", "never_raised")).unionAll(tests)


def by_kind(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count("*").alias("n"))
