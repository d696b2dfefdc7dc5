"""Incremental posting lists: each micro-batch is packed and merged by OR into the stored bitmaps of its keys.

An extension of batch posting lists. A batch is written under its own number, so a batch that runs twice after a failure
replaces its own output and nothing else; reading merges the batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pack_keys(rows: DataFrame) -> DataFrame:
    """(set_id, id) -> (set_id, bucket, bitmap)."""
    v = F.col("id") + 1
    return rows.groupBy("set_id", F.bitmap_bucket_number(v).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(v)).alias("bitmap"))


def start(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Starts the query; stream has set_id and id."""

    def put(batch: DataFrame, number: int) -> None:
        pack_keys(batch.select("set_id", "id")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The lists as of all batches so far."""
    return spark.read.parquet(path).groupBy("set_id", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Batches merged into one, elsewhere."""
    current(spark, path).write.mode("overwrite").parquet(f"{to}/batch=0")
