"""Replay of deltas, states at a ledger, validity intervals and root discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import children
from ..types import INNER

#: Ledgers that one task carries a root through.
SPAN = 100_000


def changes(checkpoint: DataFrame, delta: DataFrame, start: int) -> DataFrame:
    """The checkpoint as additions at start, and the deltas; a hash that a ledger both deletes and adds is added."""
    first = checkpoint.select(F.lit(start).cast("bigint").alias("ledger_seq"), F.lit("add").alias("op"), "hash", "node_type", "content")
    # What a deletion held is asked for by nobody.
    content = F.when(F.col("op") == "add", F.col("content")).alias("content")
    return first.unionByName(delta.select("ledger_seq", "op", "hash", "node_type", content))


def replay(checkpoint: DataFrame, delta: DataFrame, start: int, upto: int | None = None) -> DataFrame:
    """hash, node_type, content, since: the live nodes after the last ledger (or upto). Needs no order: the last change of a hash decides."""
    rows = changes(checkpoint, delta, start)
    if upto is not None:
        rows = rows.where(F.col("ledger_seq") <= upto)
    last = rows.groupBy("hash").agg(F.max_by(F.struct("op", "node_type", "content", "ledger_seq"), F.struct("ledger_seq", F.col("op") == "add")).alias("x"))
    return last.where("x.op = 'add'").select("hash", "x.node_type", "x.content", F.col("x.ledger_seq").alias("since"))


def intervals(checkpoint: DataFrame, delta: DataFrame, start: int) -> DataFrame:
    """hash, valid_from, valid_to (null: still live): a row for each time that a hash lives."""
    rows = changes(checkpoint, delta, start).groupBy("hash", "ledger_seq").agg(F.max_by(F.struct("op", "node_type", "content"), F.col("op") == "add").alias("x"))
    w = Window.partitionBy("hash").orderBy("ledger_seq")
    rows = rows.withColumn("before", F.lag("x.op").over(w)).where("before is null or before <> x.op")
    rows = rows.withColumn("valid_to", F.lead("ledger_seq").over(w))
    return rows.where("x.op = 'add'").select("hash", "x.node_type", "x.content", F.col("ledger_seq").alias("valid_from"), "valid_to")


def state_at(held: DataFrame, ledger: int) -> DataFrame:
    """Nodes of intervals() that live at a ledger."""
    return held.where((F.col("valid_from") <= ledger) & (F.col("valid_to").isNull() | (F.col("valid_to") > ledger)))


def root_candidates(delta: DataFrame) -> DataFrame:
    """ledger_seq, hash: added full inner nodes that no other added full inner node of the ledger refers to."""
    inner = delta.where((F.col("op") == "add") & (F.col("node_type") == INNER) & (F.length("content") == 512))
    referred = inner.select("ledger_seq", F.explode(F.filter(children(F.col("node_type"), F.col("content")), lambda h: h.isNotNull())).alias("hash")).distinct()
    return inner.select("ledger_seq", "hash").distinct().join(referred, ["ledger_seq", "hash"], "left_anti")


def roots(delta: DataFrame, ledgers: DataFrame, checkpoint_root: bytes | None = None) -> DataFrame:
    """ledger_seq, root for each ledger of ledgers: the candidate, else the root before; several raise."""
    found = root_candidates(delta).groupBy("ledger_seq").agg(F.count(F.lit(1)).alias("n"), F.max("hash").alias("own"))
    rows = ledgers.select("ledger_seq").distinct().join(found, "ledger_seq", "left")
    own = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("several roots at ledger "), F.col("ledger_seq").cast("string"))).cast("binary")).otherwise(F.col("own"))
    seed = F.lit(bytearray(checkpoint_root)) if checkpoint_root else F.lit(None).cast("binary")
    # Carried on within spans of ledgers, and from span to span, so that no task sees all ledgers.
    rows = rows.withColumn("own", own).withColumn("span", F.floor(F.col("ledger_seq") / SPAN))
    upto = Window.partitionBy("span").orderBy("ledger_seq").rowsBetween(Window.unboundedPreceding, 0)
    spans = rows.groupBy("span").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("ledger_seq"))).alias("last"))
    before = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)  # one row per SPAN ledgers
    spans = spans.select("span", F.last("last", ignorenulls=True).over(before).alias("carried"))
    return rows.join(spans, "span").select("ledger_seq", F.coalesce(F.last("own", ignorenulls=True).over(upto), "carried", seed).alias("root"))
