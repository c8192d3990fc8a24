"""Queries over the driver's tables, one for each operator, all over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import history, merkle, report, trie, verify
from ..sources import chunk, hashstore
from ..staging import new_folder, stage
from ..types import INNER, STATE, ZERO_HASH
from . import adapters as A


def low(c: str | Column) -> Column:
    return F.lower(F.hex(c))


# Transactions and their tries


def tx_ids(spark: SparkSession, d: str) -> DataFrame:
    return A.tx(spark, d).select("event_id", "ledger_seq", low("tx_hash").alias("tx_hash"))


def _tx_trie(spark: SparkSession, d: str, nodes: bool, digest=X.sha256) -> merkle.Trie:
    return merkle.build_trie(merkle.tx_items(A.tx(spark, d, digest), digest), ["ledger_seq"], digest, nodes)


def ledger_tx_roots(spark: SparkSession, d: str) -> DataFrame:
    t = _tx_trie(spark, d, False)
    n = t.leaves.groupBy("ledger_seq").agg(F.count(F.lit(1)).alias("n_tx"))
    return n.join(t.roots, "ledger_seq").select("ledger_seq", "n_tx", low("root").alias("root"))


def sha512half_roots(spark: SparkSession, d: str) -> DataFrame:
    return _tx_trie(spark, d, False, X.sha512half).roots.select("ledger_seq", low("root").alias("root"))


def trie_node_counts(spark: SparkSession, d: str) -> DataFrame:
    return _tx_trie(spark, d, True).inner.groupBy("ledger_seq", F.col("depth").cast("bigint").alias("depth")).agg(F.count(F.lit(1)).alias("inner_nodes"))


def leaf_placement(spark: SparkSession, d: str) -> DataFrame:
    leaves = merkle.place_leaves(merkle.tx_items(A.tx(spark, d), X.sha256).select("ledger_seq", "key", "leaf_hash"), ["ledger_seq"])
    return leaves.select("ledger_seq", low("key").alias("tx_hash"), F.col("depth").cast("bigint").alias("depth"), X.nibble(F.col("key"), F.col("depth")).cast("bigint").alias("slot"), low("leaf_hash").alias("leaf_hash"))


def tx_leaf_parse(spark: SparkSession, d: str) -> DataFrame:
    t = A.tx(spark, d).withColumn("leaf", X.tx_leaf(F.col("tx_blob"), F.col("meta_blob"), F.col("tx_hash")))
    return t.select("event_id", X.tx_leaf_read(F.col("leaf")).alias("x")).select("event_id", low("x.tx_blob").alias("tx_blob"), low("x.meta_blob").alias("meta_blob"), low("x.tx_hash").alias("tx_hash"))


def trie_transactions(spark: SparkSession, d: str) -> DataFrame:
    """Transactions collected again from the trie's nodes, root by root."""
    roots, nodes = merkle.tx_trie_nodes(A.tx(spark, d), X.sha256)
    got = trie.transactions(nodes, roots, ["ledger_seq"])
    return got.select("ledger_seq", low("tx_hash").alias("tx_hash"), F.length("tx_blob").cast("bigint").alias("blob_bytes"))


# Headers and chains


_HEADERS: dict[tuple[str, str], DataFrame] = {}


def headers(spark: SparkSession, d: str, state_roots: DataFrame | None = None) -> DataFrame:
    """A row per ledger, made once in an application: the fixture of several queries. state_roots: those of the state's tries, where they are made already."""
    key = spark.sparkContext.applicationId, d
    if key not in _HEADERS:
        _HEADERS[key] = _headers(spark, d, state_roots)
    return _HEADERS[key]


def _headers(spark: SparkSession, d: str, state_roots: DataFrame | None) -> DataFrame:
    """Making a chain is a fold over its ledgers, thirty here; checking one is not."""
    tx_roots = _tx_trie(spark, d, False).roots.withColumnRenamed("root", "tx_root")
    if state_roots is None:
        states = A.states(spark, d).select("ledger_seq", "key", F.col("hash").alias("leaf_hash"))
        state_roots = merkle.build_trie(states, ["ledger_seq"], X.sha256, False).roots
    acc = state_roots.withColumnRenamed("root", "account_hash")
    n = A.events(spark, d).groupBy("ledger_seq").agg(F.count(F.lit(1)).alias("n"))
    rows = spark.range(A.LAST + 1).select(F.col("id").alias("ledger_seq")).join(n, "ledger_seq", "left").join(tx_roots, "ledger_seq", "left").join(acc, "ledger_seq", "left")
    zero = X.raw(ZERO_HASH)
    w = Window.orderBy("ledger_seq").rowsBetween(Window.unboundedPreceding, 0)  # one row per ledger
    seq = F.col("ledger_seq")
    rows = rows.select(
        "ledger_seq", F.coalesce("tx_root", zero).alias("tx_root"), F.coalesce("account_hash", zero).alias("account_hash"), (F.lit(10**17) - 10 * F.sum(F.coalesce("n", F.lit(0))).over(w)).cast("bigint").alias("drops"),
        (seq * 86400).alias("parent_close_time"), ((seq + 1) * 86400).alias("close_time"), F.lit(10).cast("smallint").alias("close_time_resolution"), F.lit(0).cast("smallint").alias("close_flags"),
    )
    fields = rows.columns
    whole = rows.agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("rows"))
    step = lambda acc, r: F.concat(acc, F.array(X.ledger_hash({c: r[c] for c in fields} | {"parent_hash": F.element_at(acc, -1)}, X.sha256)))
    chained = whole.withColumn("hashes", F.aggregate("rows", F.array(zero), step))
    out = chained.select(F.posexplode("rows").alias("i", "r"), "hashes").select("r.*", F.col("hashes")[F.col("i")].alias("parent_hash"), F.col("hashes")[F.col("i") + 1].alias("ledger_hash"))
    return stage(out, "headers")


def ledger_headers(spark: SparkSession, d: str) -> DataFrame:
    h = headers(spark, d)
    return h.select("ledger_seq", "drops", *[low(c).alias(c) for c in ("tx_root", "account_hash", "parent_hash", "ledger_hash")])


def chain_violations(spark: SparkSession, d: str) -> DataFrame:
    """Ledger 11's drops and ledger 20's stored hash are altered."""
    h = headers(spark, d)
    bad = h.withColumn("drops", F.col("drops") + F.when(F.col("ledger_seq") == 11, 1).otherwise(0)).withColumn("ledger_hash", F.when(F.col("ledger_seq") == 20, X.sha256(F.col("ledger_hash"))).otherwise(F.col("ledger_hash")))
    return verify.chain(bad.drop("tx_root", "parent_hash"), h.select("ledger_seq", F.col("tx_root").alias("root")), X.sha256)


def chain_summary(spark: SparkSession, d: str) -> DataFrame:
    """Ledgers checked and wrong ones of the untouched chain, anchored at its start."""
    h = headers(spark, d)
    bad = verify.chain(h.drop("tx_root", "parent_hash"), h.select("ledger_seq", F.col("tx_root").alias("root")), X.sha256, anchor=ZERO_HASH)
    return h.agg(F.count(F.lit(1)).alias("ledgers")).crossJoin(bad.agg(F.count(F.lit(1)).alias("wrong")))  # one row each


def tx_id_violations(spark: SparkSession, d: str) -> DataFrame:
    """The blobs of errors are altered."""
    t = A.tx(spark, d)
    t = t.withColumn("tx_blob", F.when(F.decode("meta_blob", "UTF-8") == "error", F.concat("tx_blob", X.raw(b"!"))).otherwise(F.col("tx_blob")))
    return verify.tx_ids(t, X.sha256)


def sequence_violations(spark: SparkSession, d: str) -> DataFrame:
    """Ledgers 0 to 29 against a range that is said to be 2 to 31."""
    t = A.tx(spark, d).select("ledger_seq").distinct()
    return verify.sequence(t, t, 2, 31).select("check", "ledger_seq")


# States, deltas and replay


def checkpoint_state(spark: SparkSession, d: str) -> DataFrame:
    return history.state_at(A.objects(spark, d), 0).select(low("key").alias("key"), low("hash").alias("hash"))


def state_at_ledger(spark: SparkSession, d: str) -> DataFrame:
    return history.state_at(A.objects(spark, d), 15).select(low("key").alias("key"), low("hash").alias("hash"), F.decode("content", "UTF-8").alias("content"))


def delta_added(spark: SparkSession, d: str) -> DataFrame:
    return A.leaf_delta(spark, d).where("op = 'add'").select("ledger_seq", low("hash").alias("hash"))


def delta_deleted(spark: SparkSession, d: str) -> DataFrame:
    return A.leaf_delta(spark, d).where("op = 'del'").select("ledger_seq", low("hash").alias("hash"))


def _checkpoint(spark: SparkSession, d: str) -> DataFrame:
    return A.states(spark, d, last=0).select("hash", F.lit(STATE).cast("tinyint").alias("node_type"), "content")


def replay_final_state(spark: SparkSession, d: str) -> DataFrame:
    return history.replay(_checkpoint(spark, d), A.leaf_delta(spark, d), 0).select(low("hash").alias("hash"), F.decode("content", "UTF-8").alias("content"))


def replay_mid_state(spark: SparkSession, d: str) -> DataFrame:
    return history.replay(_checkpoint(spark, d), A.leaf_delta(spark, d), 0, upto=15).select(low("hash").alias("hash"))


def validity_intervals(spark: SparkSession, d: str) -> DataFrame:
    return history.intervals(_checkpoint(spark, d), A.leaf_delta(spark, d), 0).select(low("hash").alias("hash"), "valid_from", "valid_to")


def delta_summary(spark: SparkSession, d: str) -> DataFrame:
    return report.summary(headers(spark, d), A.leaf_delta(spark, d), A.tx(spark, d))


def running_totals(spark: SparkSession, d: str) -> DataFrame:
    s = report.sizes(A.leaf_delta(spark, d))
    n = A.tx(spark, d).groupBy("ledger_seq").agg(F.count(F.lit(1)).alias("txns"))
    rows = spark.range(A.LAST + 1).select(F.col("id").alias("ledger_seq")).join(s, "ledger_seq", "left").join(n, "ledger_seq", "left").na.fill(0)
    w = Window.orderBy("ledger_seq").rowsBetween(Window.unboundedPreceding, 0)  # one row per ledger
    return rows.select("ledger_seq", *[F.sum(c).over(w).cast("bigint").alias(f"total_{c}") for c in ("added", "bytes", "txns")])


def delta_averages(spark: SparkSession, d: str) -> DataFrame:
    rows = A.leaf_delta(spark, d)
    s = rows.agg(F.count(F.when(F.col("op") == "add", 1)).alias("added"), F.count(F.when(F.col("op") == "del", 1)).alias("deleted"), F.sum(F.when(F.col("op") == "add", F.length("content") + report.RECORD_OVERHEAD)).cast("bigint").alias("bytes"))
    return s.select("added", "deleted", "bytes", F.expr(f"added div {A.LAST}").alias("added_per_ledger"), F.expr(f"bytes div {A.LAST}").alias("bytes_per_ledger"))


def section_sizes(spark: SparkSession, d: str) -> DataFrame:
    return report.sizes(A.leaf_delta(spark, d))


# Node tables


def _state_nodes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(roots: ledger_seq, root; nodes: ledger_seq, hash, node_type, content) of the state's tries at all ledgers."""
    s = A.states(spark, d)
    t = merkle.build_trie(s.select("ledger_seq", "key", F.col("hash").alias("leaf_hash")), ["ledger_seq"], X.sha256)
    leaves = s.select("ledger_seq", "hash", F.lit(STATE).cast("tinyint").alias("node_type"), "content")
    nodes = t.inner.select("ledger_seq", "hash", F.lit(INNER).cast("tinyint").alias("node_type"), "content").unionByName(leaves)
    return t.roots, stage(nodes, "state-nodes")


def trie_reachable(spark: SparkSession, d: str) -> DataFrame:
    roots, nodes = _state_nodes(spark, d)
    return trie.reachable(nodes, roots, ["ledger_seq"]).select("ledger_seq", low("hash").alias("hash"), F.col("node_type").cast("bigint").alias("node_type"))


def _state_delta(spark: SparkSession, d: str, state: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    roots, nodes = state or _state_nodes(spark, d)
    every = spark.range(1, A.LAST + 1).select(F.col("id").alias("ledger_seq"))
    pairs = every.join(roots.select((F.col("ledger_seq") + 1).alias("ledger_seq"), F.col("root").alias("old")), "ledger_seq", "left").join(roots.select("ledger_seq", F.col("root").alias("new")), "ledger_seq", "left")
    return trie.diff(nodes, pairs, ["ledger_seq"])


def trie_diff(spark: SparkSession, d: str) -> DataFrame:
    return _state_delta(spark, d).select("ledger_seq", "op", low("hash").alias("hash"))


def root_candidates(spark: SparkSession, d: str) -> DataFrame:
    return history.root_candidates(_state_delta(spark, d)).select("ledger_seq", low("hash").alias("hash"))


def closure_violations(spark: SparkSession, d: str) -> DataFrame:
    """Nodes whose hash begins with 00 or 7 are taken away from every ledger's state."""
    _, nodes = _state_nodes(spark, d)
    gone = low("hash").startswith("00") | low("hash").startswith("7")
    return verify.closure(nodes.where(~gone), ["ledger_seq"]).select("ledger_seq", F.col("hash").alias("parent"), F.col("expected").alias("child"))


def node_hash_violations(spark: SparkSession, d: str) -> DataFrame:
    """The content of leaves at odd ledgers is altered."""
    _, nodes = _state_nodes(spark, d)
    odd = (F.col("node_type") == STATE) & (F.col("ledger_seq") % 2 == 1)
    bad = nodes.withColumn("content", F.when(odd, F.concat("content", X.raw(b"!"))).otherwise(F.col("content")))
    return verify.node_hashes(bad, X.sha256).select("ledger_seq", "hash", "expected")


def dedup_nodes(spark: SparkSession, d: str) -> DataFrame:
    c = A.copies(spark, d).where("content is not null")
    return trie.distinct_nodes(c.where("shard_ord = 0"), c.where("shard_ord = 1")).select(low("hash").alias("hash"), F.length("content").cast("bigint").alias("bytes"))


def shard_priority(spark: SparkSession, d: str) -> DataFrame:
    return trie.first_of_shards(A.copies(spark, d)).select(low("hash").alias("hash"), F.col("shard_ord").cast("bigint").alias("shard_ord"))


# Store layout and codecs


def _prefixed(spark: SparkSession, d: str) -> DataFrame:
    t = A.tx(spark, d)
    return t.withColumn("nhash", F.conv(F.substring(F.hex("tx_hash"), 1, 12), 16, 10).cast("bigint"))


def bucket_placement(spark: SparkSession, d: str) -> DataFrame:
    rows = _prefixed(spark, d)
    n = hashstore.bucket_count(rows.count())
    return rows.select(low("tx_hash").alias("tx_hash"), "nhash", X.bucket_of(F.col("nhash"), n).alias("bucket"))


def spill_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Eight buckets for all transactions, so that they spill."""
    rows = _prefixed(spark, d).withColumn("bucket", X.bucket_of(F.col("nhash"), 8))
    return hashstore.blocks(rows, order=("nhash", "tx_hash")).select(low("tx_hash").alias("tx_hash"), "bucket", "block", "slot")


def record_offsets(spark: SparkSession, d: str) -> DataFrame:
    rows = A.tx(spark, d).select(F.col("tx_hash").alias("hash"), F.length("tx_blob").cast("bigint").alias("size"))
    return hashstore.with_offsets(rows, F.col("size") + 38, hashstore.DAT_HEADER).select(low("hash").alias("hash"), "size", "offset")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    """event_id, mask, and one hash for each bit of the mask."""
    e = A.events(spark, d).select("event_id", F.expr("(event_id * 40503) % 65536").alias("mask"))
    one = lambda i: F.sha2(F.encode(F.concat_ws(":", F.col("event_id").cast("string"), i.cast("string")), "UTF-8"), 256)
    n = F.bit_count("mask")
    return e.withColumn("hashes", F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), one)).otherwise(F.array().cast("array<string>")))


def sparse_inner_decode(spark: SparkSession, d: str) -> DataFrame:
    p = _packed(spark, d)
    kids = X.sparse_children(F.col("mask"), F.unhex(F.array_join("hashes", "")))
    return p.select("event_id", F.bit_count("mask").cast("bigint").alias("children"), F.sha2(X.inner_content(kids), 256).alias("content_sha256"))


def compressed_inner_decode(spark: SparkSession, d: str) -> DataFrame:
    """The same children as (hash, place) records; the place of the n-th is its bit's."""
    p = _packed(spark, d)
    places = F.filter(F.sequence(F.lit(0), F.lit(15)), lambda i: F.col("mask").cast("int").bitwiseAND(F.call_function("shiftright", F.lit(32768), i)) != 0)
    records = F.array_join(F.transform(F.arrays_zip(F.col("hashes").alias("h"), places.alias("at")), lambda z: F.concat(z["h"], F.lpad(F.hex(z["at"].cast("bigint")), 2, "0"))), "")
    return p.select("event_id", F.sha2(X.inner_content(X.children_compressed(F.unhex(records))), 256).alias("content_sha256"))


def value_codecs(spark: SparkSession, d: str) -> DataFrame:
    """Values in three codecs and two broken ones, decoded to wire bytes."""
    p = _packed(spark, d)
    packed = F.unhex(F.array_join("hashes", ""))
    content = X.inner_content(X.sparse_children(F.col("mask"), packed))
    kinds = {
        "full": F.concat(X.raw(b"\3"), content),
        "raw": X.value_of_wire(X.wire(F.lit(INNER), content)),
        "short": F.concat(X.raw(b"\2"), X.be(F.col("mask"), 2), packed, X.raw(b"\0")),
        "sparse": F.concat(X.raw(b"\2"), X.be(F.col("mask"), 2), packed),
        "unknown": F.concat(X.raw(b"\7"), content),
    }
    values = p.select("event_id", F.explode(F.array(*[F.struct(F.lit(k).alias("codec"), v.alias("v")) for k, v in kinds.items()])).alias("x"))
    w = X.value_wire(F.col("x.v"))
    return values.select("event_id", "x.codec", F.sha2(w, 256).alias("wire_sha256"))


def lz4_values(spark: SparkSession, d: str) -> DataFrame:
    """Objects packed with LZ4 blocks, decoded, against the same object in the raw codec."""
    t = A.tx(spark, d)
    rows = t.select(F.col("tx_hash").alias("hash"), X.value_of_wire(X.wire(F.lit(STATE), F.col("tx_blob"))).alias("plain"), "tx_blob")
    out = hashstore.decoded(rows.withColumn("value", hashstore.lz4_packed("plain")))
    return out.select(low("hash").alias("hash"), F.col("node_type").cast("bigint").alias("node_type"), (F.col("content") == F.col("tx_blob")).alias("same"))


def vl_lengths(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")
    rows = docs.select("doc_id", n.alias("n")).withColumn("prefix", X.vl_length(F.col("n")))
    width, back = X.vl_read(F.col("prefix"), F.lit(1))
    return rows.select("doc_id", "n", low("prefix").alias("prefix"), width.cast("bigint").alias("width"), back.alias("decoded"))


def xxh64_prefix(spark: SparkSession, d: str) -> DataFrame:
    return A.tx(spark, d).select(low("tx_hash").alias("tx_hash"), X.store_hash(F.col("tx_hash"), hashstore.SALT).alias("nhash"))


# Inspection


def tx_by_hash(spark: SparkSession, d: str) -> DataFrame:
    t = A.tx(spark, d)
    first = t.agg(F.min("tx_hash").alias("tx_hash"))
    return t.join(F.broadcast(first), "tx_hash").select("event_id", "ledger_seq", low("tx_hash").alias("tx_hash"), F.decode("tx_blob", "UTF-8").alias("blob"))  # one row


def tx_by_ledger_index(spark: SparkSession, d: str) -> DataFrame:
    return report.transaction(A.tx(spark, d), 7, 3)


def ledger_detail(spark: SparkSession, d: str) -> DataFrame:
    return report.ledger(A.tx(spark, d), 7)


def canonical_order(spark: SparkSession, d: str) -> DataFrame:
    return report.in_order(A.tx(spark, d)).select("ledger_seq", "idx", low("tx_hash").alias("tx_hash"))


def account_ledgers(spark: SparkSession, d: str) -> DataFrame:
    t = A.tx(spark, d).withColumn("account", F.col("user_id").cast("string"))
    return report.by_account(t, "3", 5, 20).groupBy("ledger_seq").agg(F.count(F.lit(1)).alias("txns"), low(F.min("tx_hash")).alias("first_hash"))


def chunk_index(spark: SparkSession, d: str) -> DataFrame:
    t = A.tx(spark, d).groupBy(report.chunk_of("ledger_seq", 10).alias("start_ledger")).agg(F.count(F.lit(1)).alias("txns"), F.countDistinct("ledger_seq").alias("ledgers"), F.max("ledger_seq").alias("last_ledger"))
    name = F.format_string(chunk.filename("1", 0, 1).replace(f"{0:010}", "%010d", 1).replace(f"{1:010}", "%010d"), F.col("start_ledger"), F.col("start_ledger") + 9)
    return t.select("start_ledger", "last_ledger", "ledgers", "txns", name.alias("file"))


def wire_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes to wire bytes and back, leaves of all ledgers' states."""
    s = A.states(spark, d).select("ledger_seq", "hash", "content")
    w = X.wire(F.lit(STATE), F.col("content"))
    return s.select("ledger_seq", low("hash").alias("hash"), F.sha2(w, 256).alias("wire_sha256"), X.wire_type(w).cast("bigint").alias("node_type"), low(X.sha256(X.wire_content(w))).alias("back"))


# Files


def _range(spark: SparkSession, d: str):
    from ..api import Range

    roots, nodes = state = _state_nodes(spark, d)
    h = headers(spark, d, roots)
    first = nodes.where("ledger_seq = 0").select("hash", "node_type", "content")
    delta = _state_delta(spark, d, state).select("ledger_seq", "op", "hash", "node_type", "content")
    tx = A.tx(spark, d).select("ledger_seq", "tx_hash", "tx_blob", "meta_blob")
    return Range(h, first, delta, tx, 0, A.LAST)


def _local(folder: str) -> str:
    """A shared folder as the file sources and sinks open it."""
    return folder.removeprefix("file://")


def chunk_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A chunk of all ledgers written, read and summarised."""
    from ..api import inspect
    from ..sources.chunk import write_chunk

    r = _range(spark, d)
    path, _ = write_chunk(r.headers, r.checkpoint, r.delta, r.tx, r.start, r.end, _local(new_folder(spark, "files")))
    return inspect(spark, path)


def range_violations(spark: SparkSession, d: str) -> DataFrame:
    """All checks of a whole range with a fault for each: violations by check.

    Ledger 0's, 12's account_hash, a transaction of ledger 3 and the leaves added at 7 are
    altered; the header of 25 and the leaves added at the last ledger are missing.
    """
    from ..api import check_range

    r = _range(spark, d)
    seq = F.col("ledger_seq")
    r.headers = stage(r.headers.where(seq != 25).withColumn("account_hash", F.when(seq.isin(0, 12), X.sha256(F.col("account_hash"))).otherwise(F.col("account_hash"))), "bad-headers")
    least = r.tx.where(seq == 3).agg(F.min("tx_hash")).collect()[0][0]  # one hash
    one = (seq == 3) & (F.col("tx_hash") == F.lit(least))
    r.tx = r.tx.withColumn("tx_blob", F.when(one, F.concat("tx_blob", X.raw(b"!"))).otherwise(F.col("tx_blob")))
    leaf = (F.col("op") == "add") & (F.col("node_type") == STATE)
    bad = F.when(leaf & (seq == 7), F.concat("content", X.raw(b"!"))).otherwise(F.col("content"))
    r.delta = stage(r.delta.where(~(leaf & (seq == A.LAST))).withColumn("content", bad), "bad-delta")
    return check_range(r, X.sha256, anchor=ZERO_HASH).groupBy("check").agg(F.count(F.lit(1)).alias("n"))


def range_is_clean(spark: SparkSession, d: str) -> DataFrame:
    """The number of violations of the untouched range."""
    from ..api import check_range

    return check_range(_range(spark, d), X.sha256, anchor=ZERO_HASH).agg(F.count(F.lit(1)).alias("violations"))


def index_violations(spark: SparkSession, d: str) -> DataFrame:
    """An index whose drops at ledger 9 and parent_hash at ledger 20 are altered."""
    from ..api import check_index

    h = headers(spark, d)
    bad = h.withColumn("drops", F.col("drops") + F.when(F.col("ledger_seq") == 9, 1).otherwise(0)).withColumn("parent_hash", F.when(F.col("ledger_seq") == 20, X.sha256(F.col("parent_hash"))).otherwise(F.col("parent_hash")))
    return check_index(bad, X.sha256)


def chunk_link_violations(spark: SparkSession, d: str) -> DataFrame:
    """Three chunks: the second ends a ledger early and has a wrong checkpoint_hash."""
    h = headers(spark, d)
    second = F.col("ledger_seq") == 10
    chunks = h.where("ledger_seq % 10 = 0").select(F.col("ledger_seq").alias("start_ledger"), (F.col("ledger_seq") + F.when(second, 8).otherwise(9)).alias("end_ledger"), F.when(second, X.sha256(F.col("ledger_hash"))).otherwise(F.col("ledger_hash")).alias("checkpoint_hash"))
    return verify.chunk_links(chunks, h)


def _values(nodes: DataFrame) -> DataFrame:
    return nodes.select("hash", X.value_of_wire(X.wire(F.col("node_type"), F.col("content"))).alias("value"))


def _shown(nodes: DataFrame) -> DataFrame:
    return nodes.select(low("hash").alias("hash"), F.col("node_type").cast("bigint").alias("node_type"), F.sha2("content", 256).alias("content_sha256"))


def store_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """All nodes of the last state written as a store and read again."""
    from ..api import open_stores

    nodes = _state_nodes(spark, d)[1].where(F.col("ledger_seq") == A.LAST).select("hash", "node_type", "content").dropDuplicates(["hash"])
    dat, _ = hashstore.write_store(_values(nodes), _local(new_folder(spark, "files")))
    return _shown(open_stores(spark, [dat]))


def export_import(spark: SparkSession, d: str) -> DataFrame:
    """All ledgers' nodes in two stores and their index, exported as a chunk, imported with all checks, written as a store and read again."""
    from ..api import export_chunk, import_chunk, open_stores

    _, tx_nodes = merkle.tx_trie_nodes(A.tx(spark, d), X.sha256)
    roots, state_nodes = _state_nodes(spark, d)
    nodes = stage(trie.distinct_nodes(state_nodes, tx_nodes), "all-nodes")
    folder = _local(new_folder(spark, "files"))
    half = F.pmod(F.hash("hash"), F.lit(3))
    stores = [hashstore.write_store(_values(nodes.where(x)), folder, name)[0] for name, x in (("a", half > 0), ("b", half < 2))]
    path, _ = export_chunk(open_stores(spark, stores), headers(spark, d, roots), 0, A.LAST, folder, digest=X.sha256)
    import_chunk(spark, path, f"{folder}/imported", digest=X.sha256)
    return _shown(open_stores(spark, [f"{folder}/imported/store.dat"]))


def lake_state(spark: SparkSession, d: str) -> DataFrame:
    """The state at ledger 15, read from the native layout."""
    from ..api import lake_state as state
    from ..api import write_lake

    folder = new_folder(spark, "lake")
    write_lake(_range(spark, d), folder, 10)
    return _shown(state(spark, folder, 15, 10))


def digest_vectors(spark: SparkSession, d: str) -> DataFrame:
    """SHA-512/half of the test vectors of FIPS 180-2: the first half of the published digests."""
    rows = spark.createDataFrame([("abc",), ("",), ("abcdefghbcdefghicdefghijdefghijkefghijklfghijklmghijklmnhijklmnoijklmnopjklmnopqklmnopqrlmnopqrsmnopqrstnopqrstu",)], "message string")
    return rows.select("message", low(X.sha512half(F.encode("message", "UTF-8"))).alias("digest"))


def everything() -> list:
    return [
        tx_ids, ledger_tx_roots, sha512half_roots, trie_node_counts, leaf_placement, tx_leaf_parse, trie_transactions,
        ledger_headers, chain_violations, chain_summary, tx_id_violations, sequence_violations,
        checkpoint_state, state_at_ledger, delta_added, delta_deleted, replay_final_state, replay_mid_state, validity_intervals, delta_summary, running_totals, delta_averages, section_sizes,
        trie_reachable, trie_diff, root_candidates, closure_violations, node_hash_violations, dedup_nodes, shard_priority,
        bucket_placement, spill_blocks, record_offsets, sparse_inner_decode, compressed_inner_decode, value_codecs, lz4_values, vl_lengths, xxh64_prefix,
        tx_by_hash, tx_by_ledger_index, ledger_detail, canonical_order, account_ledgers, chunk_index, wire_nodes,
        chunk_roundtrip, range_violations, range_is_clean, store_roundtrip, index_violations, chunk_link_violations, export_import, lake_state, digest_vectors,
    ]


__all__ = ["everything"]
