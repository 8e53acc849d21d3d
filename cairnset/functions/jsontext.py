"""JSON texts in one fixed form, in Arrow batches: Spark writes JSON, but not with sorted keys."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _written(text: str | None, **form) -> str | None:
    try:
        return None if text is None else json.dumps(json.loads(text), sort_keys=True, **form)
    except (ValueError, RecursionError):
        return None


def canonical_json(text: Column) -> Column:
    """Sorted keys, no blanks, ASCII with escapes; null for null and for what is no JSON."""

    @F.pandas_udf("string")
    def canonical(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _written(t, separators=(",", ":")))

    return canonical(text)


def pretty_json(text: Column) -> Column:
    """Sorted keys, a member per line, two blanks for each level; null for null and for what is no JSON."""

    @F.pandas_udf("string")
    def pretty(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _written(t, indent=2))

    return pretty(text)
