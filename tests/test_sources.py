"""Chunk files, stores and the index: round trips, broken files, and whole tasks."""

import hashlib
import sqlite3

import pyarrow as pa
import pytest
import xxhash
from marlstone import api
from marlstone.functions import expr as X
from marlstone.operators import merkle, report, verify
from marlstone.sources import chunk, hashstore, register
from marlstone.sources.batches import joined
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def half(b):
    return hashlib.sha512(b).digest()[:32]


def b(x):
    return bytearray(x)


NODE = "hash binary, node_type tinyint, content binary"
DELTA = "ledger_seq bigint, op string, hash binary, node_type tinyint, content binary"
HEADER = "ledger_seq bigint, ledger_hash binary, account_hash binary, drops decimal(20,0), parent_close_time bigint, close_time bigint, close_time_resolution smallint, close_flags smallint"
TX = "ledger_seq bigint, tx_hash binary, tx_blob binary, meta_blob binary"


def leaf(n):
    c = bytes([n]) * 16
    return half(c), c


def inner(slot, h):
    c = bytes(32 * slot) + h + bytes(32 * (15 - slot))
    return half(b"MIN\0" + c), c


@pytest.fixture(scope="module")
def two(spark):
    """A chunk of two ledgers: one leaf replaced by another."""
    from decimal import Decimal

    (ha, ca), (hb, cb) = leaf(0xAA), leaf(0xBB)
    (r0, c0), (r1, c1) = inner(3, ha), inner(3, hb)
    checkpoint = spark.createDataFrame([(b(ha), 1, b(ca)), (b(r0), 2, b(c0))], NODE)
    delta = spark.createDataFrame([(101, "add", b(hb), 1, b(cb)), (101, "add", b(r1), 2, b(c1)), (101, "del", b(ha), None, None), (101, "del", b(r0), None, None)], DELTA)
    txs = [(100, b"txA", b"metaA"), (101, b"txB", b"metaB")]
    tx = spark.createDataFrame([(s, b(half(b"TXN\0" + x)), b(x), b(m)) for s, x, m in txs], TX)
    root = {r.ledger_seq: bytes(r.root) for r in merkle.build_trie(merkle.tx_items(tx), ["ledger_seq"], nodes=False).roots.collect()}
    h0 = b"\x99" * 32
    be = lambda n, w: n.to_bytes(w, "big")
    h1 = half(b"LWR\0" + be(101, 4) + be(100000005000, 8) + h0 + root[101] + r1 + be(1010, 4) + be(1020, 4) + be(10, 1) + be(0, 1))
    headers = spark.createDataFrame([(100, b(h0), b(r0), Decimal(100000000000), 1000, 1010, 10, 0), (101, b(h1), b(r1), Decimal(100000005000), 1010, 1020, 10, 0)], HEADER)
    return api.Range(headers, checkpoint, delta, tx, 100, 101)


def written(r, folder):
    return chunk.write_chunk(r.headers, r.checkpoint, r.delta, r.tx, r.start, r.end, str(folder))


def test_chunk_round_trip_and_replay(spark, two, tmp_path):
    path, digest = written(two, tmp_path)
    assert path.endswith(chunk.filename(1, 100, 101)) and "_1_0000000100_0000000101." in path
    data = open(path, "rb").read()
    assert data[:5] == chunk.MAGIC + b"\2" and data[-4:] == chunk.FOOTER and data[49:81] == digest == half(data[81:])
    got = api.read_chunk(spark, path)
    for name in ("headers", "checkpoint", "tx"):
        assert sorted(map(str, getattr(got, name).collect())) == sorted(map(str, getattr(two, name).select(*getattr(got, name).columns).collect()))
    assert got.delta.where("op = 'add'").count() == 2 and got.delta.where("op = 'del'").count() == 2
    assert api.check_range(got).count() == 0
    live = api.import_chunk(spark, path, str(tmp_path / "store"))
    assert live.where("node_type in (1, 2)").count() == 2 + 2 and live.where("node_type = 4").count() == 2
    back = api.open_stores(spark, [str(tmp_path / "store" / "store.dat")])
    key = lambda d: sorted(map(str, d.select("hash", "node_type", "content").collect()))
    assert key(back) == key(live)
    assert written(two, tmp_path / "again")[1] == digest


def test_every_changed_byte_is_noticed(spark, two, tmp_path):
    path, _ = written(two, tmp_path)
    data = open(path, "rb").read()
    register(spark)
    for at in (0, 4, 60, 90, len(data) // 2, len(data) - 1):
        broken = tmp_path / f"broken{at}.bin"
        broken.write_bytes(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
        with pytest.raises(Exception, match="chunk|version|digest"):
            spark.read.format("ledgerchunk").option("section", "tx").load(str(broken)).collect()
    (tmp_path / "short.bin").write_bytes(data[:50])
    with pytest.raises(Exception, match="end of file"):
        spark.read.format("ledgerchunk").load(str(tmp_path / "short.bin")).collect()


def test_altered_ranges_are_noticed(two):
    wrong = lambda **k: {r.check for r in api.check_range(api.Range(**{**two.__dict__, **k})).collect()}
    last = F.col("ledger_seq") == 101
    assert wrong(headers=two.headers.withColumn("ledger_hash", F.when(last, F.reverse(F.hex("ledger_hash")).cast("binary")).otherwise(F.col("ledger_hash")))) == {"ledger_hash"}
    assert wrong(headers=two.headers.withColumn("drops", F.col("drops") + 1)) == {"ledger_hash"}
    assert wrong(tx=two.tx.withColumn("tx_blob", F.concat("tx_blob", X.raw(b"!")))) >= {"tx_id", "ledger_hash"}
    assert wrong(delta=two.delta.withColumn("content", F.when(F.col("node_type") == 1, F.concat("content", X.raw(b"!"))).otherwise(F.col("content")))) == {"node_hash"}
    assert "closure" in wrong(delta=two.delta.where("node_type is null or node_type = 2"))
    assert "checkpoint_root" in wrong(checkpoint=two.checkpoint.where("node_type = 1"))
    assert "missing_header" in wrong(headers=two.headers.where("ledger_seq = 100"))
    with pytest.raises(ValueError, match="verification failed"):
        verify.require(verify.tx_ids(two.tx.withColumn("tx_blob", X.raw(b"?"))))


def test_inspect(spark, two, tmp_path):
    path, _ = written(two, tmp_path)
    rows = api.inspect(spark, path).orderBy("ledger_seq").collect()
    assert [(r.added, r.deleted, r.txns) for r in rows] == [(0, 0, 1), (2, 2, 1)]
    assert api.inspect(spark, path, 101).collect()[0].blob_bytes == 3
    assert api.inspect(spark, path, 101, 0).collect()[0].tx_blob == b"txB".hex()
    with pytest.raises(ValueError, match="needs its ledger"):
        api.inspect(spark, path, tx=0)
    with pytest.raises(ValueError, match="not in the chunk"):
        api.inspect(spark, path, 102)


def test_lake_and_manifest(spark, two, tmp_path):
    api.write_lake(two, str(tmp_path / "lake"), 10)
    assert spark.read.parquet(str(tmp_path / "lake/tx")).where("chunk = 100").count() == 2
    path, _ = written(two, tmp_path)
    register(spark)
    head = spark.read.format("ledgerchunk").load(path)
    api.write_manifest(head, str(tmp_path / "manifest"))
    got = api.read_manifest(spark, str(tmp_path / "manifest")).collect()
    assert len(got) == 1 and got[0].start_ledger == 100
    assert verify.chunk_links(head, two.headers).count() == 0
    assert verify.chunk_links(head.withColumn("checkpoint_hash", X.raw(bytes(32))), two.headers).count() == 1


def entries(spark, rows):
    return spark.createDataFrame([(b(h), b(v)) for h, v in rows], "hash binary, value binary")


@pytest.mark.parametrize("n", [0, 1, 50, 500])
def test_store_round_trip(spark, tmp_path, n):
    rows = [(n_.to_bytes(2, "big") + bytes(29) + b"\x5a", bytes([n_ % 251]) * 20) for n_ in range(n)]
    dat, key = hashstore.write_store(entries(spark, rows), str(tmp_path))
    register(spark)
    got = spark.read.format("hashstore").option("path", dat).option("buckets", 2).load().collect()
    assert {bytes(r.hash): bytes(r.value) for r in got} == dict(rows) and len(got) == n
    scanned = spark.read.format("hashstore").option("path", str(tmp_path)).option("mode", "scan").load().collect()
    assert {bytes(r.hash): bytes(r.value) for r in scanned} == dict(rows)
    assert hashstore.KeyFile(key).buckets == hashstore.bucket_count(n)


def test_store_that_spills(spark, tmp_path):
    keys = [i.to_bytes(4, "big") * 8 for i in range(6000)]
    keys = [k for k in keys if (xxhash.xxh64_intdigest(k, hashstore.SALT) >> 16) % 4 == 0][:700]
    dat, key = hashstore.write_store(entries(spark, [(k, k[:5]) for k in keys]), str(tmp_path), buckets=3)
    k = hashstore.KeyFile(key)
    body = open(key, "rb").read()[k.block : 2 * k.block]
    found, spill = hashstore.entries(body)
    assert len(found) == hashstore.CAPACITY and spill
    assert {h for h, _, _ in hashstore.read_buckets(dat, k, 0, 3)} == set(keys)


def test_store_files_that_are_none(tmp_path):
    (tmp_path / "x.key").write_bytes(bytes(5000))
    with pytest.raises(hashstore.StoreError):
        hashstore.KeyFile(str(tmp_path / "x.key"))
    (tmp_path / "x.dat").write_bytes(bytes(5000))
    with pytest.raises(hashstore.StoreError):
        list(hashstore.scan_records(str(tmp_path / "x.dat")))


def test_stores_that_are_cut_or_altered(spark, tmp_path):
    """Whatever a store lacks raises, be it in a bucket, a spill or a record; nothing is read as less."""
    keys = [i.to_bytes(4, "big") * 8 for i in range(700)]
    dat, key = hashstore.write_store(entries(spark, [(k, k[:5]) for k in keys]), str(tmp_path), buckets=2)
    whole, buckets = open(dat, "rb").read(), open(key, "rb").read()
    read = lambda: list(hashstore.read_buckets(dat, hashstore.KeyFile(key), 0, 2))
    assert len(read()) == 700

    def altered(path, data):
        before = open(path, "rb").read()
        open(path, "wb").write(data)
        try:
            with pytest.raises(hashstore.StoreError):
                read()
        finally:
            open(path, "wb").write(before)

    for n in (1, 150, len(whole) // 2, len(whole) - 100):
        altered(dat, whole[: len(whole) - n])
    for n in (1, hashstore.BLOCK - 1, hashstore.BLOCK + 7):
        altered(key, buckets[: len(buckets) - n])
    at = hashstore.DAT_HEADER
    altered(dat, whole[: at + 5] + b"\6" + whole[at + 6 :])  # a record's size
    altered(dat, whole[: at + 6] + bytes([whole[at + 6] ^ 1]) + whole[at + 7 :])  # its key
    full = hashstore.BLOCK
    altered(key, buckets[:full] + (300).to_bytes(2, "big") + buckets[full + 2 :])  # more entries than a bucket has
    _, spill = hashstore.entries(buckets[full : 2 * full])
    loop = whole[: spill + 2] + spill.to_bytes(6, "big") + whole[spill + 8 :]
    altered(dat, loop)
    register(spark)
    open(dat, "wb").write(whole[:-150])
    with pytest.raises(Exception, match="cut short"):
        spark.read.format("hashstore").option("path", dat).load().collect()


def test_compressed_inner_nodes_are_checked(spark):
    h = half(b"x")
    full = bytes(32 * 3) + h + bytes(32 * 12)
    rows = [(b(half(b"MIN\0" + full)), 3, b(h + b"\3")), (b(h), 3, b(h + b"\3"))]
    found = verify.node_hashes(spark.createDataFrame(rows, NODE)).collect()
    assert [r.hash for r in found] == [h.hex()] and found[0].expected == half(b"MIN\0" + full).hex()


def test_state_from_the_native_layout(spark, two, tmp_path):
    api.write_lake(two, str(tmp_path / "lake"), 1)
    first = {bytes(r.hash) for r in api.lake_state(spark, str(tmp_path / "lake"), 100, 1).collect()}
    assert first == {bytes(r.hash) for r in two.checkpoint.collect()}
    last = {bytes(r.hash) for r in api.lake_state(spark, str(tmp_path / "lake"), 101, 1).collect()}
    assert last == {bytes(r.hash) for r in two.delta.where("op = 'add'").collect()}
    with pytest.raises(ValueError, match="no checkpoint"):
        api.lake_state(spark, str(tmp_path / "lake"), 99, 1)


def test_command_line(spark, two, tmp_path, capsys):
    from marlstone.__main__ import main

    path, _ = written(two, tmp_path)
    main(["inspect", path, "--ledger", "101"])
    main(["import", path, "--store", str(tmp_path / "store")])
    out = capsys.readouterr().out
    assert bytes(two.tx.where("ledger_seq = 101").collect()[0].tx_hash).hex() in out and "6 nodes" in out
    assert (tmp_path / "store" / "store.dat").exists()


def test_roots_are_carried_over_spans(spark, monkeypatch):
    from marlstone.operators import history

    monkeypatch.setattr(history, "SPAN", 3)
    adds = {2: inner(1, b"\1" * 32), 9: inner(2, b"\2" * 32)}
    delta = spark.createDataFrame([(k, "add", b(h), 2, b(c)) for k, (h, c) in adds.items()], DELTA)
    ledgers = spark.range(14).select(F.col("id").alias("ledger_seq"))
    found = {r.ledger_seq: bytes(r.root) for r in history.roots(delta, ledgers, b"\7" * 32).collect()}
    assert found == {k: b"\7" * 32 if k < 2 else adds[2][0] if k < 9 else adds[9][0] for k in range(14)}


def test_export_from_stores_and_index(spark, two, tmp_path):
    """Nodes in two stores and headers in an index make the chunk that import reads."""
    roots, tx_nodes = merkle.tx_trie_nodes(two.tx)
    state = two.checkpoint.unionByName(two.delta.where("op = 'add'").select("hash", "node_type", "content"))
    nodes = state.unionByName(tx_nodes.select("hash", "node_type", "content"))
    value = nodes.select("hash", X.value_of_wire(X.wire(F.col("node_type"), F.col("content"))).alias("value"))
    half_of = F.pmod(F.hash("hash"), F.lit(2))
    a = hashstore.write_store(value.where(half_of == 0), str(tmp_path), "a")[0]
    c = hashstore.write_store(value, str(tmp_path), "b")[0]
    tx_root = {r.ledger_seq: bytes(r.root).hex() for r in roots.collect()}
    heads = {r.ledger_seq: r for r in two.headers.collect()}
    db = tmp_path / "ledger.db"
    with sqlite3.connect(db) as s:
        s.execute("CREATE TABLE Ledgers (LedgerHash TEXT, LedgerSeq INT, PrevHash TEXT, TotalCoins INT, ClosingTime INT, PrevClosingTime INT, CloseTimeRes INT, CloseFlags INT, AccountSetHash TEXT, TransSetHash TEXT)")
        h0 = heads[100]
        anchor = half(b"LWR\0" + (100).to_bytes(4, "big") + int(h0.drops).to_bytes(8, "big") + bytes(32) + bytes.fromhex(tx_root[100]) + bytes(h0.account_hash) + (1000).to_bytes(4, "big") + (1010).to_bytes(4, "big") + b"\x0a\0")
        h1 = heads[101]
        second = half(b"LWR\0" + (101).to_bytes(4, "big") + int(h1.drops).to_bytes(8, "big") + anchor + bytes.fromhex(tx_root[101]) + bytes(h1.account_hash) + (1010).to_bytes(4, "big") + (1020).to_bytes(4, "big") + b"\x0a\0")
        for h, own, parent in ((h0, anchor, bytes(32)), (h1, second, anchor)):
            s.execute("INSERT INTO Ledgers VALUES (?,?,?,?,?,?,?,?,?,?)", (own.hex().upper() + " ", h.ledger_seq, parent.hex(), int(h.drops), h.close_time, h.parent_close_time, 10, 0, bytes(h.account_hash).hex(), tx_root[h.ledger_seq]))
    register(spark)
    index = spark.read.format("ledgerdb").option("path", str(db)).load()
    assert index.count() == 2 and spark.read.format("ledgerdb").option("path", str(db)).option("start", 101).option("end", 101).load().count() == 1
    held = api.open_stores(spark, [a, c])
    path, _ = api.export_chunk(held, index, 100, 101, str(tmp_path / "out"))
    assert api.import_chunk(spark, path).count() == 6
    with pytest.raises(ValueError, match="lacks"):
        api.export_chunk(held, index, 100, 105, str(tmp_path / "out"))
    with pytest.raises(ValueError, match="verification failed"):
        api.export_chunk(held, index.withColumn("drops", F.col("drops") + 1), 100, 101, str(tmp_path / "out"))


def test_anchors(two):
    known = two.headers.select("ledger_seq", "ledger_hash")
    assert verify.anchors(two.headers, known).count() == 0
    assert [r.ledger_seq for r in verify.anchors(two.headers, known.withColumn("ledger_hash", X.raw(bytes(32)))).orderBy("ledger_seq").collect()] == [100, 101]


def test_range_limits(two, tmp_path):
    with pytest.raises(ValueError, match="ends after"):
        chunk.write_chunk(two.headers, two.checkpoint, two.delta, two.tx, 100, 100, str(tmp_path))
    with pytest.raises(ValueError, match="one header"):
        chunk.write_chunk(two.headers, two.checkpoint, two.delta, two.tx, 100, 103, str(tmp_path))


def test_a_ledger_of_more_transactions_than_two_bytes_count(spark, two, tmp_path):
    n = 1 << 16
    blob = F.encode(F.col("id").cast("string"), "UTF-8")
    many = spark.range(n).select(F.lit(101).cast("bigint").alias("ledger_seq"), X.sha256(blob).alias("tx_hash"), blob.alias("tx_blob"), blob.alias("meta_blob"))
    tx = two.tx.where("ledger_seq = 100").unionByName(many.select(*two.tx.columns))
    path, digest = chunk.write_chunk(two.headers, two.checkpoint, two.delta, tx, 100, 101, str(tmp_path))
    data = open(path, "rb").read()
    assert data[4] == chunk.WIDE_VERSION and digest == data[49:81] == half(data[:5] + data[81:])
    got = api.read_chunk(spark, path).tx
    assert got.count() == n + 1 and got.exceptAll(tx.select(*got.columns)).isEmpty()
    assert {r.ledger_seq: r.txns for r in api.inspect(spark, path).collect()} == {100: 1, 101: n}
    other = tmp_path / "two.bin"
    other.write_bytes(data[:4] + b"\2" + data[5:])
    with pytest.raises(Exception, match="digest"):
        spark.read.format("ledgerchunk").load(str(other)).collect()


def test_report_sizes(two):
    assert report.sizes(two.delta).collect()[0].bytes == 16 + 512 + 2 * 33


def test_streaming(spark, two, tmp_path):
    from marlstone import streaming

    two.tx.unionByName(two.tx).withColumn("at", F.timestamp_seconds(F.col("ledger_seq") * 86400)).repartition(2).write.parquet(str(tmp_path / "in"))
    live = streaming.read_transactions(spark, str(tmp_path / "in"), TX + ", at timestamp")
    q = streaming.append(streaming.checked(streaming.once(live, "at", "10 days")), str(tmp_path / "out"), str(tmp_path / "mark"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 2 and got.where("not ok").count() == 0
    counted = streaming.counts(live, "at").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    counted.awaitTermination(120)
    assert sorted(r.n for r in spark.table("counted").collect()) == [2, 2]


def test_a_range_of_buckets_reads_little_beside_its_records(spark, tmp_path):
    """Reading a range once read the whole file, so all ranges together its square."""
    rows = [(hashlib.sha256(str(i).encode()).digest(), bytes(1000)) for i in range(6000)]
    dat, key = hashstore.write_store(entries(spark, rows), str(tmp_path), buckets=60)
    read = lambda: int(open("/proc/self/io").read().split()[1])
    before = read()
    found = list(hashstore.read_buckets(dat, hashstore.KeyFile(key), 0, 1))
    assert 0 < len(found) < 300
    assert read() - before < 1 << 20


def test_batches_that_end_within_a_bucket_give_the_same_store(spark, tmp_path):
    rows = [(hashlib.sha256(str(i).encode()).digest(), bytes(i % 50)) for i in range(1500)]
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    files = {}
    try:
        for most in (held, "7"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            files[most] = [open(p, "rb").read() for p in hashstore.write_store(entries(spark, rows), str(tmp_path / most), buckets=3)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert files[held] == files["7"]
    dat, key = str(tmp_path / "7" / "store.dat"), hashstore.KeyFile(str(tmp_path / "7" / "store.key"))
    parts = hashstore.StoreReader([dat], 2, "buckets", to_arrow_schema(spark.createDataFrame([], "hash binary, value binary, shard_ord int, bucket bigint").schema))
    batches = [b for p in parts.partitions() for b in parts.read(p)]
    assert all(isinstance(b, pa.RecordBatch) for b in batches)
    assert sorted((r["hash"], r["value"]) for b in batches for r in b.to_pylist()) == sorted(rows)


def test_a_null_record_is_not_left_out_of_a_file(spark):
    with pytest.raises(Exception, match="a record to be written is null"):
        list(joined(spark.createDataFrame([(b(b"a"),), (None,)], "data binary")))
