"""Checks as a table of violations: check, ledger_seq, hash, expected, got (hashes in lower-case hexadecimal)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import Digest, children, children_compressed, inner_content, inner_hash, is_inner, ledger_hash, sha512half, tx_id
from ..types import INNER, INNER_COMPRESSED


def _row(check: str, ledger: Column, hash_: Column, expected: Column, got: Column) -> list[Column]:
    low = lambda c: F.lower(F.hex(c))
    return [F.lit(check).alias("check"), ledger.cast("bigint").alias("ledger_seq"), low(hash_).alias("hash"), low(expected).alias("expected"), low(got).alias("got")]


def tx_ids(tx: DataFrame, digest: Digest = sha512half) -> DataFrame:
    """Each transaction's hash is that of its blob."""
    got = tx_id(F.col("tx_blob"), digest)
    return tx.where(~got.eqNullSafe(F.col("tx_hash"))).select(*_row("tx_id", F.col("ledger_seq"), F.col("tx_hash"), got, F.col("tx_hash")))


def node_hashes(nodes: DataFrame, digest: Digest = sha512half, leaves: bool = True) -> DataFrame:
    """Each node's hash is that of its content: of inner nodes with their prefix, compressed ones in full form, of leaves plain."""
    full = inner_content(children_compressed(F.col("content")))
    got = F.when(F.col("node_type") == INNER, inner_hash(F.col("content"), digest)).when(F.col("node_type") == INNER_COMPRESSED, inner_hash(full, digest)).otherwise(digest(F.col("content")))
    rows = nodes if leaves else nodes.where(is_inner(F.col("node_type")))
    ledger = F.col("ledger_seq") if "ledger_seq" in nodes.columns else F.lit(None)
    return rows.where(~got.eqNullSafe(F.col("hash"))).select(*_row("node_hash", ledger, F.col("hash"), got, F.col("hash")))


def state_roots(headers: DataFrame, roots: DataFrame) -> DataFrame:
    """The root found for each ledger is the header's account_hash."""
    both = headers.select("ledger_seq", "account_hash").join(roots.select("ledger_seq", "root"), "ledger_seq", "left")
    return both.where(~F.col("root").eqNullSafe(F.col("account_hash"))).select(*_row("state_root", F.col("ledger_seq"), F.col("account_hash"), F.col("account_hash"), F.col("root")))


def chain(headers: DataFrame, tx_roots: DataFrame, digest: Digest = sha512half, anchor: bytes | None = None) -> DataFrame:
    """Each ledger's hash is made of its header and the stored hash before it. The first one needs an anchor, its parent's hash, else it is not checked."""
    zero = F.unhex(F.lit("00" * 32))
    headers = headers.select("ledger_seq", "ledger_hash", "account_hash", "drops", "parent_close_time", "close_time", "close_time_resolution", "close_flags")
    rows = headers.join(tx_roots.select("ledger_seq", F.col("root").alias("tx_root")), "ledger_seq", "left").withColumn("tx_root", F.coalesce("tx_root", zero))
    before = headers.select((F.col("ledger_seq") + 1).alias("ledger_seq"), F.col("ledger_hash").alias("parent_hash"))
    rows = rows.join(before, "ledger_seq", "left")
    if anchor is not None:
        first = headers.agg(F.min("ledger_seq").alias("first_seq"))
        rows = rows.join(F.broadcast(first), F.col("ledger_seq") == F.col("first_seq"), "left")
        rows = rows.withColumn("parent_hash", F.when(F.col("first_seq").isNotNull(), F.lit(bytearray(anchor))).otherwise(F.col("parent_hash")))
    got = ledger_hash({c: F.col(c) for c in ("ledger_seq", "drops", "parent_hash", "tx_root", "account_hash", "parent_close_time", "close_time", "close_time_resolution", "close_flags")}, digest)
    rows = rows.where("parent_hash is not null").withColumn("made", got)
    return rows.where("not (made <=> ledger_hash)").select(*_row("ledger_hash", F.col("ledger_seq"), F.col("ledger_hash"), F.col("made"), F.col("ledger_hash")))


def checkpoint_root(checkpoint: DataFrame, headers: DataFrame) -> DataFrame:
    """The first ledger's account_hash is among the checkpoint's nodes."""
    first = headers.select("ledger_seq", "account_hash").orderBy("ledger_seq").limit(1)
    return first.join(checkpoint.select(F.col("hash").alias("account_hash")), "account_hash", "left_anti").select(*_row("checkpoint_root", F.col("ledger_seq"), F.col("account_hash"), F.col("account_hash"), F.lit(None).cast("binary")))


def sequence(headers: DataFrame, delta_ledgers: DataFrame, start: int, end: int) -> DataFrame:
    """Ledgers of the range without a header, or headers and deltas out of it; no bytes, so hash is null."""
    none = F.lit(None).cast("binary")
    spark = headers.sparkSession
    wanted = spark.range(start, end + 1).select(F.col("id").alias("ledger_seq"))
    missing = wanted.join(headers.select("ledger_seq"), "ledger_seq", "left_anti").select(*_row("missing_header", F.col("ledger_seq"), none, none, none))
    beyond = headers.where(~F.col("ledger_seq").between(start, end)).select(*_row("header_out_of_range", F.col("ledger_seq"), none, none, none))
    odd = delta_ledgers.select("ledger_seq").distinct().where(~F.col("ledger_seq").between(start + 1, end)).select(*_row("delta_out_of_range", F.col("ledger_seq"), none, none, none))
    return missing.unionByName(beyond).unionByName(odd)


def closure(live: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Each child of a live inner node is live. live: groups, hash, node_type, content."""
    groups = groups or []
    kids = live.where(is_inner(F.col("node_type"))).select(*groups, F.col("hash").alias("parent"), F.explode(F.filter(children(F.col("node_type"), F.col("content")), lambda h: h.isNotNull())).alias("hash"))
    lost = kids.join(live.select(*groups, "hash"), [*groups, "hash"], "left_anti")
    ledger = F.col("ledger_seq") if "ledger_seq" in groups else F.lit(None)
    return lost.select(*_row("closure", ledger, F.col("parent"), F.col("hash"), F.lit(None).cast("binary")))


def chunk_links(manifest: DataFrame, headers: DataFrame) -> DataFrame:
    """Chunks follow each other without gaps, and checkpoint_hash is the hash of the chunk's first ledger. manifest: start_ledger, end_ledger, checkpoint_hash."""
    none = F.lit(None).cast("binary")
    w = Window.orderBy("start_ledger")  # one row per chunk
    gaps = manifest.withColumn("before", F.lag("end_ledger").over(w)).where("before is not null and start_ledger > before + 1").select(*_row("chunk_gap", F.col("start_ledger"), none, none, none))
    own = manifest.join(headers.select(F.col("ledger_seq").alias("start_ledger"), "ledger_hash"), "start_ledger", "left")
    wrong = own.where("not (ledger_hash <=> checkpoint_hash)").select(*_row("checkpoint_hash", F.col("start_ledger"), F.col("checkpoint_hash"), F.col("ledger_hash"), F.col("checkpoint_hash")))
    return gaps.unionByName(wrong)


def anchors(headers: DataFrame, known: DataFrame) -> DataFrame:
    """Headers have the hashes that others vouch for. known: ledger_seq, ledger_hash."""
    both = known.select("ledger_seq", F.col("ledger_hash").alias("wanted")).join(headers.select("ledger_seq", "ledger_hash"), "ledger_seq")
    return both.where("not (wanted <=> ledger_hash)").select(*_row("anchor", F.col("ledger_seq"), F.col("ledger_hash"), F.col("wanted"), F.col("ledger_hash")))


def violations(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def require(found: DataFrame) -> None:
    """Raise on the first violation."""
    first = found.head(1)
    if first:
        raise ValueError(f"verification failed: {first[0].asDict()}")
