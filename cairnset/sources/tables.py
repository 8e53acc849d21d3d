"""The Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnset.session import ship_package


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of the folder; a single file or a folder of parts."""
    ship_package(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
