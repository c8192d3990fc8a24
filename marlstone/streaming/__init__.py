"""Appending ledgers as they arrive, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import Digest, sha512half, tx_id


def read_transactions(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def checked(tx: DataFrame, digest: Digest = sha512half) -> DataFrame:
    """Transactions with ok: whether the hash is that of the blob. Stateless, so it runs in any output mode."""
    return tx.withColumn("ok", tx_id(F.col("tx_blob"), digest).eqNullSafe(F.col("tx_hash")))


def once(tx: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """Each transaction once, however often it is delivered within the watermark's delay."""
    return tx.withWatermark(time, delay).dropDuplicatesWithinWatermark(["tx_hash"])


def counts(tx: DataFrame, time: str, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Transactions by window, given out when the watermark has passed it."""
    return tx.withWatermark(time, delay).groupBy(F.window(time, width)).agg(F.count(F.lit(1)).alias("n"))


def append(tx: DataFrame, path: str, checkpoint: str):
    """A running query that appends to the lake's tx folder; exactly once by the sink's log."""
    return tx.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
