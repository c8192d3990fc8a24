"""Native column functions: digests, big-endian integers, length prefixes, nibbles and node codecs.

Everything is built from Spark's own functions and stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import INNER, INNER_COMPRESSED, PREFIX_INNER, PREFIX_LEDGER, PREFIX_TX_ID, PREFIX_TX_NODE, STATE, TX_META, ZERO_HASH

Digest = Callable[[Column], Column]
HEX = "0123456789ABCDEF"


def sha512half(b: Column) -> Column:
    """The first 32 bytes of SHA-512: the product's digest."""
    return F.unhex(F.substring(F.sha2(b, 512), 1, 64))


def sha256(b: Column) -> Column:
    """The digest of queries that are checked by SQL."""
    return F.unhex(F.sha2(b, 256))


DIGESTS: dict[str, Digest] = {"sha512half": sha512half, "sha256": sha256}


def raw(b: bytes) -> Column:
    return F.lit(bytearray(b))


def be(n: Column, width: int) -> Column:
    """An unsigned integer as big-endian bytes; raises where it doesn't fit."""
    n = n.cast("bigint") if width < 8 else n
    fits = (n >= 0) & (n < F.lit(1 << (8 * width))) if width < 8 else n >= 0
    return F.when(fits | n.isNull(), F.unhex(F.lpad(F.hex(n.cast("bigint")), 2 * width, "0"))).otherwise(F.raise_error(F.lit(f"does not fit {width} unsigned bytes")).cast("binary"))


def unsigned(b: Column, start: int | Column, width: int) -> Column:
    """width bytes (7 at most) from start (from 1), big-endian, as bigint."""
    start = F.lit(start) if isinstance(start, int) else start
    return F.conv(F.hex(F.substring(b, start, F.lit(width))), 16, 10).cast("bigint")


#: Lengths up to these take one, two and three bytes (fixed values of the format).
VL_ONE, VL_TWO, VL_THREE = 192, 12480, 918744


def vl_length(n: Column) -> Column:
    """The length prefix of n bytes."""
    return (
        F.when(n <= VL_ONE, be(n, 1))
        .when(n <= VL_TWO, be(F.lit(193 << 8) + n - (VL_ONE + 1), 2))
        .when(n <= VL_THREE, be(F.lit(241 << 16) + n - (VL_TWO + 1), 3))
        .otherwise(F.raise_error(F.lit("too long for a length prefix")).cast("binary"))
    )


def vl(b: Column) -> Column:
    return F.concat(vl_length(F.length(b)), b)


def vl_read(b: Column, start: Column) -> tuple[Column, Column]:
    """(bytes of the prefix, length of the value) at start (from 1); null where there is no prefix."""
    b0 = unsigned(b, start, 1)
    width = F.when(b0 <= 192, 1).when(b0 <= 240, 2).when(b0 <= 254, 3)
    length = (
        F.when(b0 <= 192, b0)
        .when(b0 <= 240, unsigned(b, start, 2) - (193 << 8) + (VL_ONE + 1))
        .when(b0 <= 254, unsigned(b, start, 3) - (241 << 16) + (VL_TWO + 1))
    )
    return width, length


def path_of(key: Column) -> Column:
    """A key's path from the root: its hexadecimal digits in capitals."""
    return F.hex(key)


def nibble(key: Column, depth: Column | int) -> Column:
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.conv(F.substring(F.hex(key), depth + 1, F.lit(1)), 16, 10).cast("int")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common beginning of two paths of equal length."""
    # The first 16 digits are compared as numbers; the rest only if these are equal.
    number = lambda p: F.conv(F.rpad(F.substring(p, 1, 16), 16, "0"), 16, -10).cast("bigint")
    x = number(a).bitwiseXOR(number(b))
    fast = F.floor((F.lit(64) - F.length(F.bin(x))) / 4).cast("int")
    rest = F.transform(F.sequence(F.lit(17), F.length(a) + 1), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    at = F.array_position(rest, True)
    slow = F.when(at > 0, at.cast("int") + 15).otherwise(F.length(a))
    same = F.substring(a, 1, 16) == F.substring(b, 1, 16)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("int")).when(same & (F.length(a) <= 16), F.length(a)).when(same, slow).otherwise(fast)


def tx_id(blob: Column, digest: Digest) -> Column:
    return digest(F.concat(raw(PREFIX_TX_ID), blob))


def tx_leaf(blob: Column, meta: Column, tx_hash: Column) -> Column:
    """Content of a transaction's leaf; its digest is the leaf's hash."""
    return F.concat(raw(PREFIX_TX_NODE), vl(blob), vl(meta), tx_hash)


def tx_leaf_read(content: Column) -> Column:
    """struct<tx_blob, meta_blob, tx_hash> of a transaction's leaf; raises where it is malformed."""
    w1, n1 = vl_read(content, F.lit(5))
    at2 = F.lit(5) + w1 + n1
    w2, n2 = vl_read(content, at2)
    end = (at2 + w2 + n2).cast("int")
    fine = (F.substring(content, 1, 4) == raw(PREFIX_TX_NODE)) & (F.length(content) - end + 1 == 32)
    part = lambda at, n: F.substring(content, at.cast("int"), n.cast("int"))
    good = F.struct(part(F.lit(5) + w1, n1).alias("tx_blob"), part(at2 + w2, n2).alias("meta_blob"), part(end, F.lit(32)).alias("tx_hash"))
    return F.when(F.coalesce(fine, F.lit(False)), good).otherwise(F.raise_error(F.lit("malformed transaction leaf")).cast("struct<tx_blob:binary,meta_blob:binary,tx_hash:binary>"))


def inner_hash(content: Column, digest: Digest) -> Column:
    return digest(F.concat(raw(PREFIX_INNER), content))


def ledger_hash(h: dict[str, Column], digest: Digest) -> Column:
    """h: ledger_seq, drops, parent_hash, tx_root, account_hash, parent_close_time, close_time, close_time_resolution, close_flags."""
    return digest(
        F.concat(
            raw(PREFIX_LEDGER), be(h["ledger_seq"], 4), be(h["drops"], 8), h["parent_hash"], h["tx_root"], h["account_hash"],
            be(h["parent_close_time"], 4), be(h["close_time"], 4), be(h["close_time_resolution"], 1), be(h["close_flags"], 1),
        )
    )


def held(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value made once a row: an expression named in a lambda is made again for each element."""
    return F.transform(F.array(value), body)[0]


def children_full(content: Column) -> Column:
    """16 hashes of an inner node's 512 bytes, null where there is none."""
    ok = F.length(content) == 512
    kids = held(content, lambda b: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.nullif(F.substring(b, i * 32 + 1, F.lit(32)), raw(ZERO_HASH))))
    return F.when(ok, kids).otherwise(F.raise_error(F.lit("inner node is not 512 bytes")).cast("array<binary>"))


def children_compressed(content: Column) -> Column:
    """The same of (hash, place) records of 33 bytes; of several with one place the last counts."""
    empty = F.array().cast("array<binary>")

    def kids(b: Column) -> Column:
        n = (F.length(b) / 33).cast("int")
        places = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(b, i * 33, F.lit(1)))).otherwise(empty)
        return held(F.struct(n.alias("n"), F.reverse(places).alias("at")), lambda x: slots(b, x))

    def slots(b: Column, x: Column) -> Column:
        from_end = lambda i: F.array_position(x["at"], raw(bytes([i]))).cast("int")
        one = lambda at: F.when(at > 0, F.nullif(F.substring(b, (x["n"] - at) * 33 + 1, F.lit(32)), raw(ZERO_HASH)))
        ok = (F.length(b) % 33 == 0) & ~F.exists(x["at"], lambda p: p > raw(b"\x0f"))
        return F.when(ok, F.array(*[held(from_end(i), one) for i in range(16)]))

    return F.coalesce(held(content, kids), F.raise_error(F.lit("malformed compressed inner node")).cast("array<binary>"))


def children(node_type: Column, content: Column) -> Column:
    """16 child hashes of an inner node, null for leaves."""
    return F.when(node_type == INNER, children_full(content)).when(node_type == INNER_COMPRESSED, children_compressed(content))


def inner_content(kids: Column) -> Column:
    """512 bytes of 16 child hashes."""
    return F.unhex(F.array_join(F.transform(kids, lambda h: F.coalesce(F.hex(h), F.lit("0" * 64))), ""))


def sparse_children(mask: Column, packed: Column) -> Column:
    """16 hashes from a 16-bit mask, the first child's bit the highest, and the hashes that are there."""
    def kids(x: Column) -> Column:
        bit = lambda i: x["mask"].bitwiseAND(F.call_function("shiftright", F.lit(32768), i)) != 0
        rank = lambda i: F.bit_count(F.call_function("shiftrightunsigned", x["mask"], F.lit(16) - i))
        return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.when(bit(i), F.substring(x["packed"], rank(i) * 32 + 1, F.lit(32))))

    return held(F.struct(mask.cast("int").alias("mask"), packed.alias("packed")), kids)


def wire(node_type: Column, content: Column) -> Column:
    """Content and, last, the type's byte."""
    return F.concat(content, be(node_type, 1))


def wire_type(w: Column) -> Column:
    return unsigned(w, F.length(w), 1).cast("tinyint")


def wire_content(w: Column) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - 1)


def is_inner(node_type: Column) -> Column:
    return node_type.isin(INNER, INNER_COMPRESSED)


def is_leaf(node_type: Column) -> Column:
    return ~is_inner(node_type)


#: Codec bytes of stored values (fixed values of the format).
CODEC_RAW, CODEC_LZ4, CODEC_SPARSE, CODEC_FULL = 0, 1, 2, 3
#: Kinds of objects in a raw value (fixed values of the format).
OBJECT_UNKNOWN, OBJECT_LEDGER, OBJECT_STATE, OBJECT_TX = 0, 1, 3, 4


def object_wire(blob: Column) -> Column:
    """Wire bytes of an encoded object (8 bytes unused, a kind, then the prefixed payload); null for ledger headers and unknown kinds."""
    kind = unsigned(blob, 9, 1)
    payload = F.substring(blob, F.lit(10), F.length(blob) - 9)
    inner = F.when(F.length(blob) >= 525, F.concat(F.substring(blob, 14, 512), be(F.lit(INNER), 1)))
    return (
        F.when(F.length(blob) < 9, F.lit(None).cast("binary"))
        .when(kind == OBJECT_UNKNOWN, inner)
        .when(kind == OBJECT_STATE, F.concat(payload, be(F.lit(STATE), 1)))
        .when(kind == OBJECT_TX, F.concat(payload, be(F.lit(TX_META), 1)))
    )


def value_wire(value: Column, unpacked: Column | None = None) -> Column:
    """Wire bytes of a stored value; unpacked: the decompressed object where the codec is LZ4. Null where it can't be decoded."""
    codec = unsigned(value, 1, 1)
    full = F.when(F.length(value) == 513, F.concat(F.substring(value, 2, 512), be(F.lit(INNER), 1)))
    mask = unsigned(value, 2, 2)
    packed = F.substring(value, F.lit(4), F.greatest(F.length(value) - 3, F.lit(0)))
    sparse = F.when((F.length(value) >= 3) & (F.length(packed) == F.bit_count(mask) * 32), F.concat(inner_content(sparse_children(mask, packed)), be(F.lit(INNER), 1)))
    body = F.substring(value, F.lit(2), F.greatest(F.length(value) - 1, F.lit(0)))
    out = F.when(codec == CODEC_RAW, object_wire(body)).when(codec == CODEC_SPARSE, sparse).when(codec == CODEC_FULL, full)
    return out if unpacked is None else out.when(codec == CODEC_LZ4, object_wire(unpacked))


def value_of_wire(w: Column) -> Column:
    """A stored value (raw codec) of wire bytes; inner nodes must be in full form."""
    kind = wire_type(w)
    head = lambda k: raw(bytes([CODEC_RAW]) + bytes(8) + bytes([k]))
    return (
        F.when((kind == INNER) & (F.length(w) == 513), F.concat(head(OBJECT_UNKNOWN), raw(PREFIX_INNER), wire_content(w)))
        .when(kind == STATE, F.concat(head(OBJECT_STATE), wire_content(w)))
        .when(kind == TX_META, F.concat(head(OBJECT_TX), wire_content(w)))
        .otherwise(F.raise_error(F.lit("node can't be stored")).cast("binary"))
    )


_M, _P1, _P2, _P3, _P4, _P5 = (1 << 64) - 1, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def _signed(x: int) -> int:
    x &= _M
    return x - (1 << 64) if x >> 63 else x


def seed_word(seed: int) -> int:
    """The x with xxh64 of the long x under seed 42 equal to seed, by inverting each step.

    Spark's xxhash64(a, b) hashes b with the hash of a as its seed; so any seed can be had.
    """
    h = seed & _M
    h ^= h >> 32
    h = h * pow(_P3, -1, 1 << 64) & _M
    h ^= (h >> 29) ^ (h >> 58)
    h = h * pow(_P2, -1, 1 << 64) & _M
    h ^= h >> 33
    h = (h - _P4) * pow(_P1, -1, 1 << 64) & _M
    h = (h >> 27 | h << 37) & _M
    h ^= 42 + _P5 + 8 & _M
    k = h * pow(_P1, -1, 1 << 64) & _M
    k = (k >> 31 | k << 33) & _M
    return _signed(k * pow(_P2, -1, 1 << 64))


def store_hash(key: Column, salt: int) -> Column:
    """The 48 high bits of XXH64(key) with seed salt."""
    return F.call_function("shiftrightunsigned", F.xxhash64(F.lit(seed_word(salt)).cast("bigint"), key), F.lit(16))


def bucket_of(nhash: Column, buckets: int) -> Column:
    """Linear hashing: modulo the next power of two, folded back where that bucket isn't there yet."""
    modulus = 1
    while modulus < buckets:
        modulus *= 2
    b = nhash % F.lit(modulus).cast("bigint")
    return F.when(b >= buckets, b - modulus // 2).otherwise(b).cast("bigint")
