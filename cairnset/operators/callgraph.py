"""Functions, calls and what is reachable."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Parts of a decorator's text, and names, that mark an entry point.
ENTRY_DECORATORS = [
    "route", "get", "post", "put", "patch", "delete", "websocket", "task", "command", "handler",
    "on_event", "middleware", "subscribe", "listener", "app.", "router.", "celery", "lambda_handler",
]
ENTRY_NAMES = ["main", "handler", "lambda_handler"]
LARGEST_FILE = 1_000_000
MOST_CALLERS = 8
LINES_PER_CELL = 64

NODE_SCHEMA = (
    "path string, kind string, seq int, name string, start_line int, end_line int, at_margin boolean, "
    "decorators array<string>, caller string, callee string"
)


def syntax_nodes(path: str, text: str) -> list[dict]:
    """Functions and calls of one file in the order they are met; a single failure row if it is not Python."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [{"path": path, "kind": "failure"}]
    rows: list[dict] = []
    waiting: list[tuple[ast.AST, str]] = [(tree, "<module>")]
    while waiting:
        node, inside = waiting.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            inside = node.name
            rows.append(
                {
                    "path": path, "kind": "function", "seq": len(rows), "name": node.name, "start_line": node.lineno,
                    "end_line": node.end_lineno, "at_margin": node.col_offset == 0,
                    "decorators": [ast.unparse(d) for d in node.decorator_list],
                }
            )
        elif isinstance(node, ast.Call):  # a plain name or the last part of a dotted one; other calls have no name
            callee = getattr(node.func, "id", None) or getattr(node.func, "attr", None)
            if callee:
                rows.append({"path": path, "kind": "call", "caller": f"{path}::{inside}", "callee": callee})
        waiting.extend((child, inside) for child in reversed(list(ast.iter_child_nodes(node))))
    return rows


def parse_files(files: DataFrame) -> DataFrame:
    """Syntax nodes of files (path, text); null texts are passed over.

    A file of more than a megabyte is not parsed and gives one row of kind
    ``too_large``, so that what it holds counts as not determinable.
    """
    columns = [c.split()[0] for c in NODE_SCHEMA.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for p, t in zip(batch["path"], batch["text"]) for r in syntax_nodes(p, t)]
            frame = pd.DataFrame(rows, columns=columns).astype(object)
            yield frame.where(frame.notna(), None)

    size = F.octet_length("text")
    parsed = files.where(size <= LARGEST_FILE).select("path", "text").mapInPandas(parse, NODE_SCHEMA)
    large = files.where(size > LARGEST_FILE).select("path", F.lit("too_large").alias("kind"))
    return parsed.unionByName(large, allowMissingColumns=True)


def functions_of(nodes: DataFrame) -> DataFrame:
    """path, seq, name, start_line, end_line, is_entry."""
    marks = F.exists("decorators", lambda d: F.lower(d).rlike("|".join(m.replace(".", "\\.") for m in ENTRY_DECORATORS)))
    entry = F.coalesce(marks, F.lit(False)) | (F.col("name").isin(ENTRY_NAMES) & F.col("at_margin"))
    return nodes.where("kind = 'function'").select("path", "seq", "name", "start_line", "end_line", entry.alias("is_entry"))


def calls_of(nodes: DataFrame) -> DataFrame:
    """Distinct (caller, callee)."""
    return nodes.where("kind = 'call'").select("caller", "callee").distinct()


def failures_of(nodes: DataFrame) -> DataFrame:
    """Files whose functions are not known: no Python, or too large to parse."""
    return nodes.where("kind IN ('failure', 'too_large')").select("path")


def enclosing(points: DataFrame, functions: DataFrame) -> DataFrame:
    """Points (ord, pos, path, line) with the innermost function around them, null where there is none.

    Intervals are laid over cells of 64 lines, so the join is on equality of
    path and cell, and a file with very many functions and citations falls into
    many join keys.
    """
    cell = F.floor(F.col("line") / LINES_PER_CELL)
    cells = F.sequence(F.floor(F.col("start_line") / LINES_PER_CELL), F.floor(F.col("end_line") / LINES_PER_CELL))
    laid = functions.where("end_line >= start_line").withColumn("cell", F.explode(cells)).withColumnRenamed("path", "f_path")
    placed = points.withColumn("p_cell", cell)
    inside = (
        (F.col("path") == F.col("f_path")) & (F.col("p_cell") == F.col("cell"))
        & (F.col("line") >= F.col("start_line")) & (F.col("line") <= F.col("end_line"))
    )
    joined = placed.join(laid, inside, "left")
    innermost = F.min_by(
        F.struct("name", "start_line", "end_line", "is_entry"), F.struct(F.col("end_line") - F.col("start_line"), "seq", "name")
    )
    return joined.groupBy("ord", "pos", "path", "line").agg(innermost.alias("f")).select("ord", "pos", "path", "line", "f.*")


def callers(functions: DataFrame, calls: DataFrame, most: int = MOST_CALLERS) -> DataFrame:
    """Per function name the first ``most`` callers in order, and how many there are.

    A caller of the same bare name, in any file, does not count. Callers are
    distinct rows; Spark limits the window's groups to the first few before the
    shuffle, so a name that everything calls is never brought together.
    """
    names = functions.select(F.col("name").alias("callee")).distinct()
    own = F.endswith(F.col("caller"), F.concat(F.lit("::"), F.col("callee")))
    met = calls.join(names, "callee").where(~own)
    counts = met.groupBy("callee").agg(F.count("*").alias("n_callers"))
    first = met.withColumn("n", F.row_number().over(W.partitionBy("callee").orderBy("caller"))).where(F.col("n") <= most)
    shown = first.groupBy("callee").agg(F.array_sort(F.collect_list("caller")).alias("callers"))
    return counts.join(shown, "callee").withColumnRenamed("callee", "name")


def reachability(points: DataFrame, functions: DataFrame, calls: DataFrame, failures: DataFrame, suffix: str = ".py") -> DataFrame:
    """Verdict per point: not_determinable, reachable_from or no_caller_found, in this order of checks."""
    around = enclosing(points, functions)
    known = callers(functions, calls).select("name", "n_callers")
    failed = failures.select("path", F.lit(True).alias("failed")).distinct()
    joined = around.join(known, "name", "left").join(failed, "path", "left")
    verdict = (
        F.when(~F.endswith("path", F.lit(suffix)) | F.col("failed").isNotNull() | F.col("name").isNull(), "not_determinable")
        .when(F.col("is_entry"), "reachable_from")
        .when(F.col("n_callers") > 0, "reachable_from")
        .otherwise("no_caller_found")
    )
    return joined.select("ord", "pos", "path", "line", F.col("name").alias("function"), verdict.alias("verdict"))
