"""Digests and identity keys: ``sha256:`` plus 64 hex digits, however spelled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n"


def strip_blanks(c: Column) -> Column:
    """Without spaces, tabs and line breaks around it; null stays null."""
    return F.btrim(c, F.lit(BLANKS))


def blank_to_null(c: Column) -> Column:
    """Trimmed, and null if nothing is left."""
    return F.nullif(strip_blanks(c), F.lit(""))


def canonical_digest(c: Column) -> Column:
    """The lower-case ``sha256:`` form; null and blank give null.

    Spellings that differ in letter case, surrounding blanks or the prefix
    agree. A prefix with nothing behind it counts as blank.
    """
    bare = blank_to_null(F.regexp_replace(F.lower(strip_blanks(c)), "^sha256:", ""))
    return F.concat(F.lit("sha256:"), bare)


def text_digest(c: Column) -> Column:
    """``sha256:`` digest of the UTF-8 bytes of a string."""
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(c, "UTF-8"), 256))


def is_digest(c: Column) -> Column:
    """Strict syntax check: lower-case hex only, prefix present; null is false."""
    return F.coalesce(c.rlike("^sha256:[0-9a-f]{64}$"), F.lit(False))


def bytes_digest(c: Column) -> Column:
    """``sha256:`` digest of binary content; null stays null."""
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def digest_holds(expected: Column, content: Column) -> Column:
    """Whether binary content has the expected digest; an expectation that is no digest is an error."""
    wrong = F.raise_error(F.concat(F.lit("not a digest: "), F.coalesce(expected, F.lit("null"))))
    return F.when(is_digest(expected), bytes_digest(content) == expected).otherwise(wrong.cast("boolean"))
