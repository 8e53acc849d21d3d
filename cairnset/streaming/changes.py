"""Snapshots as they arrive: the newest state per key as a table, its changes as a stream of tables.

An extension: the batch operators stay the reference for results. Each micro
batch is folded into a new version of the state table, so a batch that is run
again after a failure writes the same version again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairnset.operators.folds import last_write


def keep_newest(stream: DataFrame, keys: list[str], order: str, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that keeps the row with the largest ``order`` per key below ``path``, one version per batch.

    ``path/state/n`` is the whole state after batch n, ``path/changed/n`` the
    rows that batch n put in. Rows with a null key are left out; late rows lose
    to what is there. Runs through what is available and stops.
    """
    schema = stream.schema

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keyed = batch.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
        before = spark.read.schema(schema).parquet(f"{path}/state/{number - 1}") if number else spark.createDataFrame([], schema)
        after = last_write(before.unionByName(keyed), keys, order).select(*schema.names)
        after.write.mode("overwrite").parquet(f"{path}/state/{number}")
        now = spark.read.schema(schema).parquet(f"{path}/state/{number}")
        same = before.select(*keys, F.col(order).alias("_o"))
        changed = now.join(same, keys, "left").where(~F.col("_o").eqNullSafe(F.col(order))).drop("_o")
        changed.write.mode("overwrite").parquet(f"{path}/changed/{number}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
