"""String functions of the triage operators, all inside Spark's code generation."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a title that tell nothing apart.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "before", "by", "can", "for", "from", "in", "into",
    "is", "it", "its", "of", "on", "or", "that", "the", "this", "through", "to", "via", "with", "without",
]

#: Fixed value: what ends a line, the two-character form first.
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]"
#: Fixed value: a path on one line, with an optional line or line range, numbers without leading zero.
LOCATOR = "^([^\\n]+?)(?::([1-9][0-9]*)(?:-([1-9][0-9]*))?)?$"
#: Fixed value: how a weakness number is spelled.
WEAKNESS = "cwe[-_ ]?([0-9]{1,5})"
QUOTED_LINES = 40


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once: a lambda's argument is, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def split_lines(text: Column) -> Column:
    """Lines of a text; a line end at the very end opens no further line; null stays null."""

    def closed(parts: Column) -> Column:
        return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)

    return once(F.split(text, LINE_END, -1), closed)


def first_line(text: Column) -> Column:
    """The first line; empty for an empty text."""
    return F.coalesce(F.get(split_lines(text), F.lit(0)), F.when(text.isNotNull(), ""))


def join_lines(lines: Column, start: Column, count: Column) -> Column:
    """``count`` lines from the 1-based ``start``, joined by line feeds."""
    return F.array_join(F.slice(lines, start, count), "\n")


def parse_locator(locator: Column) -> dict[str, Column]:
    """path, start_line and end_line of a locator as spelled; blank gives null throughout."""
    trimmed = F.regexp_replace(locator, "^\\s+|\\s+$", "")
    part = [F.nullif(F.regexp_extract(trimmed, LOCATOR, k), F.lit("")) for k in (1, 2, 3)]
    path = F.nullif(F.trim(part[0]), F.lit(""))
    start = part[1].cast("bigint")
    return {"path": path, "start_line": start, "end_line": F.coalesce(part[2].cast("bigint"), start)}


def clean_path(path: Column) -> Column:
    """A path without empty and ``.`` steps, ``x/..`` taken out; null stays null.

    A path that starts at the root, or leaves the tree by ``..``, keeps what tells so
    and matches no file of the tree.
    """
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        back = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.element_at(F.concat(F.array(F.lit("..")), done), -1), F.lit("..")) != "..")
        return F.when(part.isin("", "."), done).when(back, F.slice(done, 1, F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))

    joined = F.array_join(F.aggregate(F.split(path, "/"), none, step), "/")
    return F.when(F.startswith(path, F.lit("/")), F.concat(F.lit("/"), joined)).otherwise(joined)


def normalise_weakness(value: Column) -> Column:
    """``CWE-n`` for each number named, distinct, in numeric order, joined by ``+``; none gives null."""
    found = F.regexp_extract_all(F.lower(value), F.lit(WEAKNESS), F.lit(1))
    numbers = F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))
    return F.nullif(F.array_join(F.transform(numbers, lambda n: F.concat(F.lit("CWE-"), n.cast("string"))), "+"), F.lit(""))


def title_tokens(title: Column, raw_text: Column) -> Column:
    """Sorted distinct words of the title, stop words aside; without a title of the text's first 200 characters."""
    source = F.coalesce(F.nullif(title, F.lit("")), F.substring(raw_text, 1, 200), F.lit(""))
    words = F.regexp_extract_all(F.lower(source), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_sort(F.array_except(words, F.array(*map(F.lit, STOP_WORDS))))


def neutralise_fence(text: Column) -> Column:
    """Breaks every run of three or more backticks with zero-width spaces, so that no fence can close."""
    return F.regexp_replace(text, "`(?=``)|(?<=`)`(?=`)", "`​")


def fenced(text: Column, label: str) -> Column:
    """The text between marker lines of ``label``, which must be 1 to 32 of ``A-Z 0-9 -``; markers inside it are broken first.

    Any marker is broken, of whatever label and letter case, so no text can close
    its own fence or open another one.
    """
    if not re.fullmatch("[A-Z0-9-]{1,32}", label):
        raise ValueError(f"not a label: {label!r}")
    inner = F.regexp_replace(neutralise_fence(text), "(?i)<(?=/?[a-z0-9-]{1,32}>)", "<\u200b")
    return F.concat(F.lit(f"<{label}>\n"), inner, F.lit(f"\n</{label}>"))
