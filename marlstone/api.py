"""Whole tasks: export a ledger range from nodes and an index, import a chunk, inspect one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.expr import Digest, ledger_hash, sha512half, value_of_wire, wire
from .operators import history, report, trie, verify
from .operators.merkle import build_trie, tx_items, tx_trie_nodes
from .sources import hashstore, register
from .sources.chunk import write_chunk
from .staging import stage
from .types import INNER, INNER_COMPRESSED


def open_stores(spark: SparkSession, paths: list[str]) -> DataFrame:
    """hash, node_type, content: the nodes of several stores, the first store's copy where several hold one."""
    register(spark)
    values = spark.read.format("hashstore").option("path", ",".join(paths)).load()
    return trie.first_of_shards(hashstore.decoded(values)).select("hash", "node_type", "content")


def check_index(index: DataFrame, digest: Digest = sha512half) -> DataFrame:
    """Violations of an index: each hash is made of its row, and parent_hash is the hash before."""
    h = {c: F.col(c) for c in ("ledger_seq", "drops", "parent_hash", "tx_root", "account_hash", "parent_close_time", "close_time", "close_time_resolution", "close_flags")}
    rows = index.withColumn("made", ledger_hash(h, digest))
    low = lambda c: F.lower(F.hex(c))
    wrong = rows.where("not (made <=> ledger_hash)").select(F.lit("ledger_hash").alias("check"), "ledger_seq", low("ledger_hash").alias("hash"), low("made").alias("expected"), low("ledger_hash").alias("got"))
    before = index.select((F.col("ledger_seq") + 1).alias("ledger_seq"), F.col("ledger_hash").alias("before"))
    links = index.join(before, "ledger_seq").where("before <> parent_hash")
    return wrong.unionByName(links.select(F.lit("parent_hash").alias("check"), "ledger_seq", low("parent_hash").alias("hash"), low("before").alias("expected"), low("parent_hash").alias("got")))


@dataclass
class Range:
    headers: DataFrame
    checkpoint: DataFrame
    delta: DataFrame
    tx: DataFrame
    start: int
    end: int


def collect_range(nodes: DataFrame, index: DataFrame, start: int, end: int, digest: Digest = sha512half) -> Range:
    """What a chunk holds: the first ledger's whole state, each later ledger's difference, all transactions. A wrong index raises."""
    if end <= start:
        raise ValueError("a range ends after it starts")
    nodes = stage(trie.distinct_nodes(nodes), "export-nodes")
    index = stage(index.where(F.col("ledger_seq").between(start, end)), "export-index")
    if index.count() != end - start + 1:
        raise ValueError("the index lacks ledgers of the range")
    verify.require(check_index(index, digest))
    checkpoint = trie.reachable(nodes, index.where(F.col("ledger_seq") == start).select("ledger_seq", F.col("account_hash").alias("root")), ["ledger_seq"]).select("hash", "node_type", "content")
    pairs = index.select((F.col("ledger_seq") + 1).alias("ledger_seq"), F.col("account_hash").alias("old")).join(index.select("ledger_seq", F.col("account_hash").alias("new")), "ledger_seq")
    delta = trie.diff(nodes, pairs, ["ledger_seq"]).select("ledger_seq", "op", "hash", "node_type", "content")
    tx = trie.transactions(nodes, index.select("ledger_seq", F.col("tx_root").alias("root")), ["ledger_seq"])
    return Range(index.drop("parent_hash", "tx_root"), checkpoint, delta, tx, start, end)


def export_chunk(nodes: DataFrame, index: DataFrame, start: int, end: int, folder: str, network_id: int = 1, digest: Digest = sha512half) -> tuple[str, bytes]:
    r = collect_range(nodes, index, start, end, digest)
    return write_chunk(r.headers, r.checkpoint, r.delta, r.tx, start, end, folder, network_id)


def read_chunk(spark: SparkSession, path: str) -> Range:
    register(spark)
    part = lambda s: spark.read.format("ledgerchunk").option("section", s).load(path)
    head = part("chunk").collect()
    if len(head) != 1:
        raise ValueError("one chunk at a time")
    # Each section is one pass over the file, with its digest; it is read several times from here on.
    return Range(*(stage(part(s), f"chunk-{s}") for s in ("header", "checkpoint", "delta", "tx")), head[0]["start_ledger"], head[0]["end_ledger"])


def state_roots(r: Range) -> DataFrame:
    """ledger_seq, root after each ledger of a range, found from the nodes alone."""
    first = r.headers.where(F.col("ledger_seq") == r.start).select("account_hash").collect()[0][0]
    return history.roots(r.delta, r.headers, bytes(first))


def check_range(r: Range, digest: Digest = sha512half, leaves: bool = True, anchor: bytes | None = None) -> DataFrame:
    """All violations of a range: ids, node contents, roots, chain, sequence, and a closed last state."""
    tx_roots = build_trie(tx_items(r.tx, digest), ["ledger_seq"], digest, nodes=False).roots
    live = history.replay(r.checkpoint, r.delta, r.start)
    nodes = r.checkpoint.withColumn("ledger_seq", F.lit(r.start).cast("bigint")).unionByName(r.delta.where("op = 'add'").select("hash", "node_type", "content", "ledger_seq"))
    return verify.violations(
        verify.tx_ids(r.tx, digest),
        verify.node_hashes(nodes, digest, leaves),
        verify.state_roots(r.headers, state_roots(r)),
        verify.chain(r.headers, tx_roots, digest, anchor),
        verify.checkpoint_root(r.checkpoint, r.headers),
        verify.sequence(r.headers, r.delta, r.start, r.end),
        verify.closure(live),
    )


def import_chunk(spark: SparkSession, path: str, folder: str | None = None, check: bool = True, digest: Digest = sha512half, leaves: bool = True) -> DataFrame:
    """Replay a chunk: hash, node_type, content of the last state and of all transactions' trees; folder: write them as a store.

    Format, sequence and the checkpoint's root are always checked, the rest unless check is False.
    """
    r = read_chunk(spark, path)
    always = verify.violations(verify.checkpoint_root(r.checkpoint, r.headers), verify.sequence(r.headers, r.delta, r.start, r.end))
    verify.require(check_range(r, digest, leaves) if check else always)
    _, tx_nodes = tx_trie_nodes(r.tx, digest)
    whole = stage(trie.distinct_nodes(history.replay(r.checkpoint, r.delta, r.start), tx_nodes), "imported")
    if folder is not None:
        from .functions.expr import children_compressed, inner_content

        full = F.when(F.col("node_type") == INNER_COMPRESSED, inner_content(children_compressed(F.col("content")))).otherwise(F.col("content"))
        kind = F.when(F.col("node_type") == INNER_COMPRESSED, INNER).otherwise(F.col("node_type")).cast("tinyint")
        hashstore.write_store(whole.select("hash", value_of_wire(wire(kind, full)).alias("value")), folder)
    return whole


def inspect(spark: SparkSession, path: str, ledger: int | None = None, tx: int | None = None) -> DataFrame:
    """A chunk's ledgers; one ledger's transactions; or one transaction."""
    if tx is not None and ledger is None:
        raise ValueError("a transaction needs its ledger")
    r = read_chunk(spark, path)
    if ledger is None:
        return report.summary(r.headers, r.delta, r.tx)
    if r.headers.where(F.col("ledger_seq") == ledger).isEmpty():
        raise ValueError(f"ledger {ledger} is not in the chunk")
    return report.ledger(r.tx, ledger) if tx is None else report.transaction(r.tx, ledger, tx)


def write_lake(r: Range, path: str, chunk: int = 1_000_000) -> None:
    """The native layout: checkpoint, delta, header and tx as Parquet, those by ledger in folders of chunk ledgers; each is read alone."""
    for name, df in (("delta", r.delta), ("header", r.headers), ("tx", r.tx)):
        parted = df.withColumn("chunk", report.chunk_of("ledger_seq", chunk))
        parted.repartition("chunk", F.pmod(F.hash("ledger_seq"), F.lit(64))).sortWithinPartitions("ledger_seq").write.partitionBy("chunk").mode("append").parquet(f"{path}/{name}")
    r.checkpoint.withColumn("ledger_seq", F.lit(r.start).cast("bigint")).sortWithinPartitions("hash").write.mode("append").parquet(f"{path}/checkpoint")


def lake_state(spark: SparkSession, path: str, ledger: int, chunk: int = 1_000_000) -> DataFrame:
    """hash, node_type, content, since: the nodes that live at a ledger, from the native layout. Folders and row groups after it are not read."""
    first = spark.read.parquet(f"{path}/checkpoint").where(F.col("ledger_seq") <= ledger)
    start = first.agg(F.max("ledger_seq")).collect()[0][0]
    if start is None:
        raise ValueError(f"no checkpoint at or before ledger {ledger}")
    after = F.col("chunk").between(start // chunk * chunk, ledger // chunk * chunk) & F.col("ledger_seq").between(start + 1, ledger)
    return history.replay(first.where(F.col("ledger_seq") == start), spark.read.parquet(f"{path}/delta").where(after), start)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a manifest's list of chunks."""
    whole = spark.read.option("multiLine", True).json(path)
    return whole.select(F.explode("chunks").alias("c")).select("c.*")


def write_manifest(chunks: DataFrame, path: str) -> None:
    """chunks, one row each, as the list of a manifest."""
    low = [F.lower(F.hex(c)).alias(c) if t == "binary" else F.col(c) for c, t in chunks.dtypes]
    chunks.select(F.struct(*low).alias("c")).agg(F.sort_array(F.collect_list("c")).alias("chunks")).coalesce(1).write.mode("overwrite").json(path)
