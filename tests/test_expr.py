"""Column functions against hashlib and plain Python."""

import hashlib
import random

import pytest
import xxhash
from marlstone.functions import expr as X
from marlstone.sources import hashstore
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0][0]


def half(b):
    return hashlib.sha512(b).digest()[:32]


def test_digests(spark):
    assert bytes(one(spark, X.sha512half(X.raw(b"abc")))) == half(b"abc")
    assert bytes(one(spark, X.sha256(X.raw(b"abc")))) == hashlib.sha256(b"abc").digest()


@pytest.mark.parametrize(("n", "width"), [(0, 1), (255, 1), (65535, 2), (2**32 - 1, 4), (10**17, 8), (2**63 - 1, 8)])
def test_big_endian(spark, n, width):
    assert bytes(one(spark, X.be(F.lit(n).cast("bigint"), width))) == n.to_bytes(width, "big")


@pytest.mark.parametrize(("n", "width"), [(256, 1), (-1, 4), (65536, 2), (2**32, 4)])
def test_what_does_not_fit_raises(spark, n, width):
    with pytest.raises(Exception, match="does not fit"):
        one(spark, X.be(F.lit(n).cast("bigint"), width))


def prefix(n):
    if n <= 192:
        return bytes([n])
    if n <= 12480:
        return bytes([193 + (n - 193 >> 8), n - 193 & 255])
    m = n - 12481
    return bytes([241 + (m >> 16), m >> 8 & 255, m & 255])


@pytest.mark.parametrize("n", [0, 1, 192, 193, 240, 448, 449, 12480, 12481, 70000, 918744])
def test_length_prefix(spark, n):
    got = bytes(one(spark, X.vl_length(F.lit(n).cast("bigint"))))
    assert got == prefix(n)
    width, length = X.vl_read(X.raw(got + b"x"), F.lit(1))
    assert (one(spark, width), one(spark, length)) == (len(got), n)


def test_length_prefix_ends(spark):
    with pytest.raises(Exception, match="too long"):
        one(spark, X.vl_length(F.lit(918745).cast("bigint")))
    assert one(spark, X.vl_read(X.raw(b"\xff\0\0"), F.lit(1))[1]) is None


def test_common_prefix(spark):
    r = random.Random(1)
    rows = []
    for _ in range(300):
        a = "".join(r.choice("0123456789ABCDEF") for _ in range(64))
        k = r.choice([0, 1, 2, 3, 7, 15, 16, 17, 40, 63, 64])
        b = a if k == 64 else a[:k] + ("0" if a[k] != "0" else "F") + "".join(r.choice("0123456789ABCDEF") for _ in range(63 - k))
        rows.append((a, b, k))
    rows += [("F00", "0FF", 0), ("ABC", "ABD", 2), ("ABC", "ABC", 3), (None, "A", None)]
    d = spark.createDataFrame(rows, "a string, b string, k int")
    assert d.where(~X.common_prefix(F.col("a"), F.col("b")).eqNullSafe(F.col("k"))).count() == 0


def test_transaction_leaf(spark):
    blob, meta, key = b"b" * 500, b"m" * 13000, bytes(range(32))
    leaf = X.tx_leaf(X.raw(blob), X.raw(meta), X.raw(key))
    assert bytes(one(spark, leaf)) == b"SND\0" + prefix(500) + blob + prefix(13000) + meta + key
    back = one(spark, X.tx_leaf_read(leaf))
    assert (bytes(back.tx_blob), bytes(back.meta_blob), bytes(back.tx_hash)) == (blob, meta, key)
    for broken in (b"SNX\0" + b"\1b\1m" + key, b"SND\0" + b"\1b\1m" + key[1:], b"SND\0"):
        with pytest.raises(Exception, match="malformed"):
            one(spark, X.tx_leaf_read(X.raw(broken)))


def test_children(spark):
    kids = [None] * 16
    kids[0], kids[7], kids[15] = b"\1" * 32, b"\2" * 32, b"\3" * 32
    full = b"".join(k or bytes(32) for k in kids)
    plain = lambda rows: [None if x is None else bytes(x) for x in rows]
    assert plain(one(spark, X.children_full(X.raw(full)))) == kids
    packed = b"".join(k + bytes([i]) for i, k in enumerate(kids) if k)
    assert plain(one(spark, X.children_compressed(X.raw(packed)))) == kids
    # The first child's bit is the highest.
    mask = sum(0x8000 >> i for i, k in enumerate(kids) if k)
    assert plain(one(spark, X.sparse_children(F.lit(mask), X.raw(b"".join(k for k in kids if k))))) == kids
    assert plain(one(spark, X.sparse_children(F.lit(0x4000), X.raw(b"\4" * 32))))[1] == b"\4" * 32
    for f, bad in ((X.children_full, full[1:]), (X.children_compressed, packed[1:]), (X.children_compressed, bytes(32) + b"\x10")):
        with pytest.raises(Exception, match="inner node"):
            one(spark, f(X.raw(bad)))


def test_values(spark):
    content = bytes(range(256)) * 2
    wire = lambda v: (lambda x: None if x is None else bytes(x))(one(spark, X.value_wire(X.raw(v))))
    assert wire(b"\3" + content) == content + b"\2"
    assert wire(b"\0" + bytes(8) + b"\3" + b"state") == b"state\1"
    assert wire(b"\0" + bytes(8) + b"\4" + b"tx") == b"tx\4"
    assert wire(b"\0" + bytes(8) + b"\0MIN\0" + content) == content + b"\2"
    for nothing in (b"", b"\3" + content[1:], b"\2\0", b"\2\x80\0" + bytes(31), b"\7x", b"\0" + bytes(8) + b"\1header", b"\0" + bytes(8) + b"\x09x", b"\0short"):
        assert wire(nothing) is None
    for w in (content + b"\2", b"leaf\1", b"tx\4"):
        assert wire(bytes(one(spark, X.value_of_wire(X.raw(w))))) == w
    for no in (b"tx\0", b"x" * 33 + b"\3"):
        with pytest.raises(Exception, match="can't be stored"):
            one(spark, X.value_of_wire(X.raw(no)))


def test_store_hash(spark):
    r = random.Random(2)
    for salt in (0, 1, 42, hashstore.SALT, 2**64 - 1):
        keys = [r.randbytes(32) for _ in range(10)]
        d = spark.createDataFrame([(bytearray(k),) for k in keys], "k binary")
        got = [x[0] for x in d.select(X.store_hash(F.col("k"), salt)).collect()]
        assert got == [xxhash.xxh64_intdigest(k, salt) >> 16 for k in keys]


def test_bucket_folds_back(spark):
    d = spark.range(100).select(F.col("id"), X.bucket_of(F.col("id"), 5).alias("b"))
    for r in d.collect():
        n = r.id % 8
        assert r.b == (n - 4 if n >= 5 else n)


def test_compressed_nodes_of_costly_contents(spark):
    """A content is made once a row, not once for each of its places: 2,000 rows took over 30 s before."""
    import time

    record = lambda i: F.concat(F.sha2(F.encode(F.concat(F.col("id").cast("string"), i.cast("string")), "UTF-8"), 256), F.lpad(F.hex(i), 2, "0"))
    content = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(15).cast("bigint") + F.col("id") * 0), record), ""))
    kids = X.children_compressed(content)
    began = time.monotonic()
    rows = spark.range(0, 2000, 1, 1).select("id", kids.alias("kids")).where(F.size(F.filter("kids", lambda k: k.isNotNull())) == 16).collect()
    assert len(rows) == 2000 and time.monotonic() - began < 15
    assert all(bytes(k) == hashlib.sha256(f"{rows[7].id}{i}".encode()).digest() for i, k in enumerate(rows[7].kids))
    twice = X.raw(b"\1" * 32 + b"\3" + b"\2" * 32 + b"\3")
    assert bytes(one(spark, X.children_compressed(twice))[3]) == b"\2" * 32  # the last of a place


def test_sparse_nodes_of_costly_hashes(spark):
    """What is packed is made once a row: a thousand digests each, 2,000 rows, 16 places."""
    import time

    packed = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(999) + F.col("id").cast("int") * 0), lambda i: F.sha2(F.encode(F.concat(F.col("id").cast("string"), i.cast("string")), "UTF-8"), 256)), ""))
    began = time.monotonic()
    rows = spark.range(0, 2000, 1, 1).select(X.sparse_children(F.lit(0xFFFF), packed).alias("kids")).where(F.size(F.filter("kids", lambda k: k.isNotNull())) == 16).collect()
    assert len(rows) == 2000 and time.monotonic() - began < 15
