"""Tries, differences and replay against plain recursion and sets."""

import hashlib
import random

import pytest
from marlstone.functions import expr as X
from marlstone.operators import history, merkle, trie, verify
from pyspark.sql import functions as F


def half(b):
    return hashlib.sha512(b).digest()[:32]


def build(items, nodes, depth=0):
    """The trie of {key: leaf hash} by recursion; nodes gets hash: content."""
    slots = {}
    for k, h in items.items():
        n = k[depth // 2] >> (0 if depth % 2 else 4) & 15
        slots.setdefault(n, {})[k] = h
    content = b""
    for n in range(16):
        own = slots.get(n, {})
        content += bytes(32) if not own else next(iter(own.values())) if len(own) == 1 else build(own, nodes, depth + 1)
    h = half(b"MIN\0" + content)
    nodes[h] = content
    return h


def frame(spark, groups):
    rows = [(g, bytearray(k), bytearray(h)) for g, items in groups.items() for k, h in items.items()]
    return spark.createDataFrame(rows, "g long, key binary, leaf_hash binary")


def keys(n, seed):
    r = random.Random(seed)
    return [r.randbytes(32) for _ in range(n)]


def test_roots_and_nodes(spark):
    long = bytes(31)
    groups = {
        1: {k: half(k) for k in keys(400, 1)},
        2: {b"\x42" * 32: half(b"x")},
        3: {b"\x10" + bytes(31): half(b"a"), b"\x11" + bytes(31): half(b"b")},
        4: {long + b"\0": half(b"a"), long + b"\1": half(b"b"), long[:-1] + b"\7\0": half(b"c"), b"\xff" * 32: half(b"d")},
    }
    t = merkle.build_trie(frame(spark, groups), ["g"])
    want, nodes = {}, {}
    for g, items in groups.items():
        own = {}
        want[g] = build(items, own)
        nodes[g] = own
    assert {r.g: bytes(r.root) for r in t.roots.collect()} == want
    found = {}
    for r in t.inner.collect():
        found.setdefault(r.g, {})[bytes(r.hash)] = bytes(r.content)
    assert found == nodes
    only = merkle.build_trie(frame(spark, groups), ["g"], nodes=False)
    assert {r.g: bytes(r.root) for r in only.roots.collect()} == want


def test_order_does_not_matter(spark):
    d = frame(spark, {1: {k: half(k) for k in keys(200, 3)}})
    a = merkle.build_trie(d.repartition(5), ["g"], nodes=False).roots.collect()
    assert a == merkle.build_trie(d.orderBy(F.desc("key")), ["g"], nodes=False).roots.collect()


def test_nothing_and_repeated_keys(spark):
    d = frame(spark, {1: {b"\1" * 32: half(b"x")}})
    assert merkle.build_trie(d.limit(0), ["g"]).roots.count() == 0
    with pytest.raises(Exception, match="occurs twice"):
        merkle.build_trie(d.union(d), ["g"])


def test_leaf_reference_is_its_hash_and_its_place_the_key(spark):
    tx = spark.createDataFrame([(7, bytearray(b"\x42" * 32), bytearray(b"blob"), bytearray(b"meta"))], "ledger_seq long, tx_hash binary, tx_blob binary, meta_blob binary")
    _, nodes = merkle.tx_trie_nodes(tx)
    inner = bytes(nodes.where("node_type = 2").collect()[0].content)
    leaf = half(b"SND\0\4blob\4meta" + b"\x42" * 32)
    assert inner[4 * 32 : 5 * 32] == leaf and inner.replace(leaf, b"") == bytes(480)


def steps(count, seed):
    """States of a trie that changes, leaves moving up and down as siblings come and go."""
    r = random.Random(seed)
    state = {k: r.randbytes(8) for k in (bytes([r.randrange(4)]) + r.randbytes(31) for _ in range(60))}
    out = [dict(state)]
    for _ in range(count):
        for k in r.sample(sorted(state), 3):
            state[k] = r.randbytes(8)
        for _ in range(2):
            state[bytes([r.randrange(4)]) + r.randbytes(31)] = r.randbytes(8)
        del state[r.choice(sorted(state))]
        out.append(dict(state))
    return out


@pytest.fixture(scope="module")
def moving(spark):
    states, nodes, roots, per = steps(12, 5), {}, [], []
    for s in states:
        own = {half(k + v): k + v for k, v in s.items()}
        inner = {}
        roots.append(build({k: half(k + v) for k, v in s.items()}, inner))
        nodes |= {h: (1, c) for h, c in own.items()} | {h: (2, c) for h, c in inner.items()}
        per.append(set(own) | set(inner))
    d = spark.createDataFrame([(bytearray(h), t, bytearray(c)) for h, (t, c) in nodes.items()], "hash binary, node_type tinyint, content binary")
    return d, roots, per


def test_reachable(spark, moving):
    nodes, roots, per = moving
    r = spark.createDataFrame([(i, bytearray(h)) for i, h in enumerate(roots)], "ledger_seq long, root binary")
    found = {}
    for x in trie.reachable(nodes, r, ["ledger_seq"]).collect():
        assert bytes(x.hash) not in found.setdefault(x.ledger_seq, set())
        found[x.ledger_seq].add(bytes(x.hash))
    assert [found[i] for i in range(len(roots))] == per
    zero = spark.createDataFrame([(0, bytearray(32))], "ledger_seq long, root binary")
    assert trie.reachable(nodes, zero, ["ledger_seq"]).count() == 0
    with pytest.raises(Exception, match="not found"):
        trie.reachable(nodes.where("node_type = 2"), r, ["ledger_seq"])
    assert trie.reachable(nodes.where("node_type = 2"), r, ["ledger_seq"], tolerate_missing=True).count() > 0


def delta(spark, moving):
    nodes, roots, _ = moving
    pairs = spark.createDataFrame([(i, bytearray(roots[i - 1]), bytearray(roots[i])) for i in range(1, len(roots))], "ledger_seq long, old binary, new binary")
    return nodes, pairs


def test_difference_is_that_of_sets(spark, moving):
    nodes, pairs = delta(spark, moving)
    per = moving[2]
    found = {}
    for x in trie.diff(nodes, pairs, ["ledger_seq"]).collect():
        found.setdefault((x.ledger_seq, x.op), set()).add(bytes(x.hash))
    for i in range(1, len(per)):
        assert found.get((i, "add"), set()) == per[i] - per[i - 1] and found.get((i, "del"), set()) == per[i - 1] - per[i]
    raw = trie.raw_diff(nodes, pairs, ["ledger_seq"]).groupBy("ledger_seq", "hash").count().where("count > 1")
    assert raw.count() > 0  # leaves did move


def test_difference_with_nothing(spark, moving):
    nodes, roots, per = moving
    pairs = spark.createDataFrame([(1, None, bytearray(roots[0])), (2, bytearray(roots[0]), None), (3, bytearray(roots[0]), bytearray(roots[0])), (4, bytearray(32), None)], "ledger_seq long, old binary, new binary")
    got = {(r.ledger_seq, r.op): r["count"] for r in trie.diff(nodes, pairs, ["ledger_seq"]).groupBy("ledger_seq", "op").count().collect()}
    assert got == {(1, "add"): len(per[0]), (2, "del"): len(per[0])}


def test_replay_intervals_roots_and_closure(spark, moving):
    nodes, pairs = delta(spark, moving)
    _, roots, per = moving
    d = trie.diff(nodes, pairs, ["ledger_seq"]).cache()
    first = nodes.join(spark.createDataFrame([(bytearray(h),) for h in per[0]], "hash binary"), "hash")
    held = history.intervals(first, d, 0).cache()
    for i in (0, 5, len(per) - 1):
        live = {bytes(r.hash) for r in history.replay(first, d, 0, upto=i).collect()}
        assert live == per[i] == {bytes(r.hash) for r in history.state_at(held, i).collect()}
    ledgers = spark.range(len(per)).select(F.col("id").alias("ledger_seq"))
    assert [bytes(r.root) for r in history.roots(d, ledgers, roots[0]).orderBy("ledger_seq").collect()] == roots
    last = history.replay(first, d, 0)
    assert verify.closure(last).count() == 0 and verify.closure(last.where("node_type = 2")).count() > 0
    assert verify.node_hashes(last).count() == 0
    two = d.unionByName(d.where("ledger_seq = 3 and op = 'add' and node_type = 2").limit(1).withColumn("ledger_seq", F.lit(4).cast("long")))
    if history.root_candidates(two).where("ledger_seq = 4").count() > 1:
        with pytest.raises(Exception, match="several roots"):
            history.roots(two, ledgers, roots[0]).collect()


def test_first_shard_that_can_be_decoded(spark):
    rows = [(b"a", 1, None, 0), (b"a", 1, b"second", 1), (b"b", 1, b"first", 0), (b"b", 1, b"second", 1), (b"c", 1, None, 0)]
    d = spark.createDataFrame([(bytearray(h), t, None if c is None else bytearray(c), s) for h, t, c, s in rows], "hash binary, node_type tinyint, content binary, shard_ord int")
    assert {bytes(r.hash): bytes(r.content) for r in trie.first_of_shards(d).collect()} == {b"a": b"second", b"b": b"first"}


def moved(spark, run):
    """(bytes shuffled, bytes written) by run(), without broadcasts that Spark chooses by itself."""
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        all_ = [stages.apply(i) for i in range(stages.size())]
        return sum(s.shuffleWriteBytes() for s in all_), sum(s.outputBytes() for s in all_)

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = total()
        run()
        return tuple(b - a for a, b in zip(before, total(), strict=True))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_walks_move_contents_once(spark, tmp_path):
    """Leaves of 4,000 random bytes: they went through a shuffle and a file for each level of a walk."""
    r, rows, roots, size = random.Random(3), [], [], 0
    items = {k: r.randbytes(4000) for k in keys(300, 4)}
    for n in (200, 300):
        own, inner = dict(list(items.items())[:n]), {}
        roots.append(build({k: half(c) for k, c in own.items()}, inner))
        rows += [(bytearray(h), 2, bytearray(c)) for h, c in inner.items()]
    rows += [(bytearray(half(c)), 1, bytearray(c)) for c in items.values()]
    spark.createDataFrame(rows, "hash binary, node_type tinyint, content binary").write.parquet(str(tmp_path / "nodes"))
    nodes = spark.read.parquet(str(tmp_path / "nodes"))
    size = sum(len(c) for _, _, c in rows)
    one = spark.createDataFrame([(0, bytearray(roots[1]))], "g long, root binary")
    shuffled, written = moved(spark, lambda: trie.reachable(nodes, one, ["g"]).count())
    assert shuffled < 1.3 * size and written < 1.3 * size
    pair = spark.createDataFrame([(1, bytearray(roots[0]), bytearray(roots[1]))], "g long, old binary, new binary")
    shuffled, written = moved(spark, lambda: trie.diff(nodes, pair, ["g"]).count())
    assert shuffled < 1.3 * size and written < 1.3 * size


def test_nodes_may_repeat(spark, moving):
    nodes, pairs = delta(spark, moving)
    r = pairs.select("ledger_seq", F.col("new").alias("root"))
    key = lambda d: sorted(map(str, d.collect()))
    assert key(trie.reachable(nodes.union(nodes), r, ["ledger_seq"])) == key(trie.reachable(nodes, r, ["ledger_seq"]))
    leaves = trie.reachable(nodes, r, ["ledger_seq"], leaves=True)
    assert key(leaves) == key(trie.reachable(nodes, r, ["ledger_seq"]).where("node_type = 1"))
    with pytest.raises(Exception, match="not found"):
        trie.reachable(nodes.where("node_type = 2"), r, ["ledger_seq"], leaves=True)


def test_building_moves_keys_not_paths(spark, tmp_path):
    """A leaf is a key and a hash of 32 random bytes each; its path of 64 digits went with it."""
    n = 20_000
    d = spark.range(n).select(F.lit(1).alias("g"), X.sha256(F.encode(F.concat(F.lit("k"), F.col("id").cast("string")), "UTF-8")).alias("key"), X.sha256(F.encode(F.col("id").cast("string"), "UTF-8")).alias("leaf_hash"))
    d.write.parquet(str(tmp_path / "items"))
    shuffled, written = moved(spark, lambda: merkle.build_trie(spark.read.parquet(str(tmp_path / "items")), ["g"], X.sha256, nodes=False).roots.collect())
    assert written < 90 * n and shuffled < 200 * n, (written / n, shuffled / n)
