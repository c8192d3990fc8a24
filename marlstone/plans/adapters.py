"""Ledgers made of the driver's tables: events become transactions, users' last events the state.

Every frame has a twin in sql.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import Digest, sha256, tx_id
from ..staging import importable

LAST = 29


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = F.datediff(F.col("ts").cast("timestamp_ntz").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint")
    return e.select("event_id", "user_id", "event_type", "ts", "props", day.alias("ledger_seq"), F.round(F.col("value") * 100).cast("bigint").alias("cents"))


def tx(spark: SparkSession, sf_dir: str, digest: Digest = sha256) -> DataFrame:
    """event_id, user_id, ledger_seq, tx_hash, tx_blob, meta_blob."""
    e = events(spark, sf_dir)
    blob = F.encode(F.concat_ws("|", F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.coalesce("event_type", F.lit("")), F.coalesce(F.col("cents").cast("string"), F.lit("")), F.coalesce("props", F.lit(""))), "UTF-8")
    rows = e.select("event_id", "user_id", "ledger_seq", blob.alias("tx_blob"), F.encode(F.coalesce("event_type", F.lit("")), "UTF-8").alias("meta_blob"))
    return rows.withColumn("tx_hash", tx_id(F.col("tx_blob"), digest))


def objects(spark: SparkSession, sf_dir: str, digest: Digest = sha256) -> DataFrame:
    """key, valid_from, valid_to (null: to the end), hash, content: a user's object after each day's last event, none after an error."""
    e = events(spark, sf_dir)
    daily = e.groupBy("user_id", "ledger_seq").agg(F.max_by(F.struct("event_id", "event_type", "cents"), F.struct("ts", "event_id")).alias("x"))
    w = Window.partitionBy("user_id").orderBy("ledger_seq")
    rows = daily.withColumn("valid_to", F.lead("ledger_seq").over(w)).where("x.event_type <> 'error'")
    key = digest(F.encode(F.col("user_id").cast("string"), "UTF-8"))
    rows = rows.select(key.alias("key"), F.col("ledger_seq").alias("valid_from"), "valid_to", "x.event_id", "x.cents")
    content = F.encode(F.concat_ws("|", F.col("event_id").cast("string"), F.col("cents").cast("string"), F.lower(F.hex("key"))), "UTF-8")
    rows = rows.withColumn("content", content)
    return rows.select("key", "valid_from", "valid_to", digest(F.col("content")).alias("hash"), "content")


def states(spark: SparkSession, sf_dir: str, digest: Digest = sha256, first: int = 0, last: int = LAST) -> DataFrame:
    """ledger_seq, key, hash, content: the objects at each ledger."""
    o = objects(spark, sf_dir, digest)
    upto = F.least(F.coalesce(F.col("valid_to") - 1, F.lit(last)), F.lit(last)).cast("bigint")
    start = F.greatest("valid_from", F.lit(first).cast("bigint"))
    return o.where(start <= upto).select(F.explode(F.sequence(start, upto)).alias("ledger_seq"), "key", "hash", "content")


def leaf_delta(spark: SparkSession, sf_dir: str, digest: Digest = sha256) -> DataFrame:
    """ledger_seq, op, hash, content: the set difference of each ledger's leaf hashes with the ledger before."""
    s = states(spark, sf_dir, digest).select("ledger_seq", "hash", "content").distinct()
    next_ = s.select((F.col("ledger_seq") + 1).alias("ledger_seq"), "hash", "content")
    added = s.where("ledger_seq > 0").join(next_.select("ledger_seq", "hash"), ["ledger_seq", "hash"], "left_anti")
    gone = next_.where(F.col("ledger_seq") <= LAST).join(s.select("ledger_seq", "hash"), ["ledger_seq", "hash"], "left_anti")
    row = lambda d, op: d.select("ledger_seq", F.lit(op).alias("op"), "hash", F.lit(1).cast("tinyint").alias("node_type"), "content")
    return row(added, "add").unionByName(row(gone, "del"))


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hash, node_type, content, shard_ord: transactions in two shards by event_id % 2, multiples of ten in both; shard 1 lacks what % 7 says can't be decoded."""
    t = tx(spark, sf_dir).select("event_id", F.col("tx_hash").alias("hash"), F.lit(4).cast("tinyint").alias("node_type"), F.col("tx_blob").alias("content"))
    own = t.withColumn("shard_ord", (F.col("event_id") % 2).cast("int"))
    both = own.unionByName(t.where("event_id % 10 = 0").withColumn("shard_ord", F.lit(1)))
    return both.withColumn("content", F.when((F.col("event_id") % 7 == 0) & (F.col("shard_ord") == 0), F.lit(None).cast("binary")).otherwise(F.col("content")))
