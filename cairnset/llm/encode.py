"""Encoding and sizing of whole texts (problem 6)."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from cairnset.llm.tokenizer import encoder_of, rank_file_path


def rank_file(spark: SparkSession, path: str | None = None) -> Broadcast:
    """The rank file's bytes on every executor; a vocabulary of fixed size, under 1 MB."""
    return spark.sparkContext.broadcast(Path(path or rank_file_path()).read_bytes())


def encode_texts(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``key`` and ``ids``: the token ids of every text, unchanged and whole.

    Null and empty texts give an empty list; a null key stays null, repeated
    rows stay repeated, and other columns are not read. One narrow stage: rows
    go through Python once, in Arrow batches, and nothing is shuffled.
    """
    ranks = rank_file(df.sparkSession, path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(ranks.value)
        for batch in batches:
            packed = [encoder.packed(t) if t else b"" for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, packed)], dtype=np.int64) // 4
            values = np.frombuffer(b"".join(packed), dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(encode, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text: str, path: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``; null and empty texts have none."""
    ranks = rank_file(df.sparkSession, path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(ranks.value)
        for batch in batches:
            sizes = [encoder.count(t) if t else 0 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sizes, pa.int64())], names=[*keep, "n_tokens"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(text, *keep).mapInArrow(count, f"{kinds}, n_tokens bigint")
