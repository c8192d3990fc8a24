"""Inspection: summaries, one ledger, one transaction, lookups and chunk layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A node's record without its content: hash and type (the count published with chunks); with the length field it is 35.
RECORD_OVERHEAD = 33


def summary(headers: DataFrame, delta: DataFrame, tx: DataFrame) -> DataFrame:
    """One row per ledger: ledger_hash, added, deleted, txns, drops."""
    d = delta.groupBy("ledger_seq").agg(F.count(F.when(F.col("op") == "add", 1)).alias("added"), F.count(F.when(F.col("op") == "del", 1)).alias("deleted"))
    t = tx.groupBy("ledger_seq").agg(F.count(F.lit(1)).alias("txns"))
    rows = headers.join(d, "ledger_seq", "left").join(t, "ledger_seq", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return rows.select("ledger_seq", F.lower(F.hex("ledger_hash")).alias("ledger_hash"), zero("added"), zero("deleted"), zero("txns"), F.col("drops").cast("bigint").alias("drops"))


def in_order(tx: DataFrame) -> DataFrame:
    """tx with idx, its place among the ledger's transactions in order of hash, from 0."""
    w = Window.partitionBy("ledger_seq").orderBy("tx_hash")
    return tx.withColumn("idx", F.row_number().over(w).cast("bigint") - 1)


def ledger(tx: DataFrame, seq: int) -> DataFrame:
    """The transactions of a ledger: idx, tx_hash, sizes."""
    rows = in_order(tx.where(F.col("ledger_seq") == seq))
    return rows.select("idx", F.lower(F.hex("tx_hash")).alias("tx_hash"), F.length("tx_blob").cast("bigint").alias("blob_bytes"), F.length("meta_blob").cast("bigint").alias("meta_bytes"))


def transaction(tx: DataFrame, seq: int, idx: int) -> DataFrame:
    """Blob and metadata of one transaction, in hexadecimal."""
    rows = in_order(tx.where(F.col("ledger_seq") == seq)).where(F.col("idx") == idx)
    low = lambda c: F.lower(F.hex(c)).alias(c)
    return rows.select("ledger_seq", "idx", low("tx_hash"), low("tx_blob"), low("meta_blob"))


def by_hash(tx: DataFrame, tx_hash: bytes) -> DataFrame:
    return tx.where(F.col("tx_hash") == F.lit(bytearray(tx_hash)))


def by_account(tx: DataFrame, account: str, start: int, end: int, column: str = "account") -> DataFrame:
    """Transactions of an account, a column that the caller supplies, in a range of ledgers."""
    return tx.where((F.col(column) == account) & F.col("ledger_seq").between(start, end))


def sizes(delta: DataFrame) -> DataFrame:
    """Bytes of each ledger's added nodes."""
    added = delta.where("op = 'add'")
    return added.groupBy("ledger_seq").agg(F.count(F.lit(1)).alias("added"), F.sum(F.length("content") + RECORD_OVERHEAD).cast("bigint").alias("bytes"))


def chunk_of(seq: str, chunk: int, start: int = 0):
    """First ledger of the chunk of a ledger."""
    return (F.floor((F.col(seq) - start) / chunk) * chunk + start).cast("bigint")
