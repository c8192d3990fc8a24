"""The hash-table key-value store: a .dat file of records and a .key file of buckets; source and sink.

spark.read.format("hashstore").option("path", folder or comma-separated .dat files): rows
hash, value, shard_ord, bucket. Buckets are read in ranges, a partition each, and every
entry's record with it; that replaces lookups one by one by a scan and a join.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.expr import be, bucket_of, store_hash, value_wire, wire_content, wire_type
from ..staging import stage
from .batches import batched, joined, joined_by

#: Values of the file format (fixed values).
DAT_MAGIC, KEY_MAGIC, STORE_VERSION = b"nudb.dat", b"nudb.key", 2
DAT_HEADER, BLOCK, KEY_SIZE, ENTRY, BUCKET_HEAD = 92, 4096, 32, 18, 8
CAPACITY = (BLOCK - BUCKET_HEAD) // ENTRY
SALT = 0x58524C4158524C41
SCAN_LIMIT = 65536


class StoreError(ValueError):
    """A store file that is not what its format says."""


class KeyFile:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            h = f.read(64)
        if h[:8] != KEY_MAGIC:
            raise StoreError(f"not a key file: {path}")
        if int.from_bytes(h[26:28], "big") != KEY_SIZE:
            raise StoreError(f"key size is not {KEY_SIZE}: {path}")
        self.path, self.salt, self.block = path, int.from_bytes(h[28:36], "big"), int.from_bytes(h[44:46], "big")
        if not self.block:
            raise StoreError(f"block size is zero: {path}")
        size = os.path.getsize(path)
        if size < self.block or size % self.block:
            raise StoreError(f"a bucket is cut short: {path}")
        self.buckets = size // self.block - 1


def entries(body: bytes) -> tuple[list[tuple[int, int, int]], int]:
    """(offset, size, hash prefix) of a bucket, and where it spills to."""
    n = int.from_bytes(body[:2], "big")
    if len(body) < BUCKET_HEAD + n * ENTRY:
        raise StoreError("a bucket is cut short")
    cut = lambda at: int.from_bytes(body[at : at + 6], "big")
    return [(cut(b), cut(b + 6), cut(b + 12)) for b in range(BUCKET_HEAD, BUCKET_HEAD + n * ENTRY, ENTRY)], cut(2)


def _exactly(f: BinaryIO, n: int, what: str) -> bytes:
    got = f.read(n)
    if len(got) < n:
        raise StoreError(f"{what} is cut short: {f.name}")
    return got


def read_buckets(dat: str, key: KeyFile, first: int, last: int) -> Iterator[tuple[bytes, bytes, int]]:
    """(hash, value, bucket) of the buckets first to last - 1, through their spills; records in the order of the file.

    What is cut short, a spill that comes back to itself, and a record that is not its entry's raise.
    Records of a range of buckets lie all over the file: each is read by itself, and nothing beside it.
    """
    import xxhash

    with open(key.path, "rb", buffering=1 << 20) as k, open(dat, "rb", buffering=0) as d:
        if d.read(8) != DAT_MAGIC:
            raise StoreError(f"not a data file: {dat}")
        found: list[tuple[int, int, int, int]] = []
        for bucket in range(first, last):
            k.seek(key.block * (bucket + 1))
            own, spill = entries(_exactly(k, key.block, "a bucket"))
            found += [(*e, bucket) for e in own]
            seen = set()
            while spill:
                if spill in seen:
                    raise StoreError(f"spills run in a circle: {dat}")
                seen.add(spill)
                d.seek(spill)
                head = _exactly(d, BUCKET_HEAD, "a spill")
                own, spill = entries(head + _exactly(d, int.from_bytes(head[:2], "big") * ENTRY, "a spill"))
                found += [(*e, bucket) for e in own]
        for offset, size, prefix, bucket in sorted(found):
            d.seek(offset)
            record = _exactly(d, 6 + KEY_SIZE + size, "a record")
            hash_ = record[6 : 6 + KEY_SIZE]
            if int.from_bytes(record[:6], "big") != size or xxhash.xxh64_intdigest(hash_, key.salt) >> 16 != prefix:
                raise StoreError(f"a record is not that of its entry: {dat}")
            yield hash_, record[6 + KEY_SIZE :], bucket


def scan_records(dat: str) -> Iterator[tuple[bytes, bytes]]:
    """Records from the start of a .dat file until something that is none: recovery without a key file."""
    with open(dat, "rb", buffering=1 << 20) as d:
        if d.read(8) != DAT_MAGIC:
            raise StoreError(f"not a data file: {dat}")
        d.seek(DAT_HEADER)
        while len(head := d.read(6 + KEY_SIZE)) == 6 + KEY_SIZE:
            size = int.from_bytes(head[:6], "big")
            if not 0 < size <= SCAN_LIMIT:
                return
            value = d.read(size)
            if len(value) < size:
                return
            yield head[6:], value


class _Buckets(InputPartition):
    def __init__(self, dat: str, shard: int, first: int, last: int):
        self.dat, self.shard, self.first, self.last = dat, shard, first, last


class StoreReader(DataSourceReader):
    def __init__(self, dats: list[str], size: int, mode: str, schema: pa.Schema):
        self.dats, self.size, self.mode, self.schema = dats, size, mode, schema

    def partitions(self) -> list[InputPartition]:
        if self.mode == "scan":
            return [_Buckets(d, i, 0, 0) for i, d in enumerate(self.dats)]
        return [_Buckets(d, i, a, min(a + self.size, n)) for i, d in enumerate(self.dats) for n in [KeyFile(d[:-4] + ".key").buckets] for a in range(0, n, self.size)]

    def _rows(self, partition: InputPartition) -> Iterator[tuple]:
        if self.mode == "scan":
            return ((h, v, partition.shard, None) for h, v in scan_records(partition.dat))
        key = KeyFile(partition.dat[:-4] + ".key")
        return ((h, v, partition.shard, b) for h, v, b in read_buckets(partition.dat, key, partition.first, partition.last))

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from batched(self._rows(partition), self.schema)


class StoreSource(DataSource):
    """Options: path, buckets (per partition, 1024), mode (buckets or scan)."""

    @classmethod
    def name(cls) -> str:
        return "hashstore"

    def schema(self) -> str:
        return "hash binary, value binary, shard_ord int, bucket bigint"

    def reader(self, schema) -> DataSourceReader:
        dats = []
        for p in self.options["path"].split(","):
            p = p.strip().removeprefix("file://")
            dats += [os.path.join(p, x) for x in sorted(os.listdir(p)) if x.endswith(".dat")] if os.path.isdir(p) else [p]
        if not dats:
            raise StoreError("no store given")
        return StoreReader(dats, int(self.options.get("buckets", "1024")), self.options.get("mode", "buckets"), to_arrow_schema(schema))


def _varint(b: bytes) -> tuple[int, int]:
    n = 0
    for i, x in enumerate(b[:10]):
        n |= (x & 0x7F) << (7 * i)
        if x < 0x80:
            return n, i + 1
    raise ValueError("truncated")


def _unpacked(value: pd.Series) -> pd.Series:
    def one(v: bytes | None) -> bytes | None:
        if not v or v[0] != 1:
            return None
        try:
            size, at = _varint(v[1:])
            return pa.decompress(v[1 + at :], decompressed_size=size, codec="lz4_raw", asbytes=True)
        except (ValueError, OSError, pa.ArrowException):
            return None

    return value.map(one)


def _packed(value: pd.Series) -> pd.Series:
    def one(v: bytes) -> bytes:
        n, size = len(v) - 1, b""
        while n >= 0x80:
            size, n = size + bytes([n & 0x7F | 0x80]), n >> 7
        return b"\1" + size + bytes([n]) + pa.compress(v[1:], codec="lz4_raw", asbytes=True)

    return value.map(one)


def lz4_unpacked(value: Column | str) -> Column:
    """The object of a value with the LZ4 codec, null for others and for those that can't be unpacked."""
    return F.pandas_udf(_unpacked, "binary")(value)


def lz4_packed(value: Column | str) -> Column:
    """A value with the raw codec in the LZ4 one."""
    return F.pandas_udf(_packed, "binary")(value)


def decoded(values: DataFrame, lz4: bool = True) -> DataFrame:
    """values (hash, value, ...) with node_type and content, null where a value can't be decoded."""
    # Other values are not sent to Python.
    unpacked = lz4_unpacked(F.when(F.substring("value", 1, 1) == F.lit(bytearray(b"\x01")), F.col("value"))) if lz4 else None
    rows = values.withColumn("__w", value_wire(F.col("value"), unpacked))
    has = F.col("__w").isNotNull()
    return rows.withColumn("node_type", F.when(has, wire_type(F.col("__w")))).withColumn("content", F.when(has, wire_content(F.col("__w")))).drop("__w", "value")


def bucket_count(rows: int) -> int:
    """Buckets for half-full blocks."""
    return max(1, -(-rows * 2 // CAPACITY))


def placed(rows: DataFrame, buckets: int, salt: int = SALT) -> DataFrame:
    """entries (hash, value) with nhash and bucket."""
    return rows.withColumn("nhash", store_hash(F.col("hash"), salt)).withColumn("bucket", bucket_of(F.col("nhash"), buckets))


def blocks(rows: DataFrame, capacity: int = CAPACITY, bucket: str = "bucket", order: tuple[str, ...] = ("nhash", "hash")) -> DataFrame:
    """rows with block (0: the bucket itself, then its spills) and slot in it."""
    rn = F.row_number().over(Window.partitionBy(bucket).orderBy(*order)) - 1  # a bucket holds half a block on average
    return rows.withColumn("block", F.floor(rn / capacity).cast("bigint")).withColumn("slot", (rn % capacity).cast("bigint"))


def with_offsets(rows: DataFrame, size: Column, first: int, order: str = "hash", partitions: int | None = None) -> DataFrame:
    """rows with offset: first and the sizes of all rows before in order. Sums of partitions are added up first, so that no task sees all rows."""
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(rows.withColumn("__size", size.cast("bigint")).repartitionByRange(n, order).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id()), "offsets")
    sums = ranged.groupBy("__part").agg(F.sum("__size").alias("s")).orderBy("__part").collect()  # one row per partition
    before, at = {}, first
    for r in sums:
        before[r["__part"]], at = at, at + r["s"]
    base = F.coalesce(*[F.when(F.col("__part") == k, F.lit(v)) for k, v in before.items()], F.lit(first)).cast("bigint")
    own = F.sum("__size").over(Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size")
    return ranged.withColumn("offset", base + own).drop("__size", "__part")


def write_store(rows: DataFrame, folder: str, name: str = "store", salt: int = SALT, buckets: int | None = None) -> tuple[str, str]:
    """Write entries (hash, value), one per hash, in order of hash. Placement is computed in parallel, the two files are streamed by one writer."""
    import xxhash

    rows = stage(rows.select("hash", "value"), "store-entries")
    n = buckets or bucket_count(rows.count())
    sizes = with_offsets(rows.select("hash", F.length("value").cast("bigint").alias("size")), F.col("size") + 6 + KEY_SIZE, DAT_HEADER)
    placed_rows = placed(sizes, n, salt).select("bucket", "nhash", "hash", F.concat(be(F.col("offset"), 6), be(F.col("size"), 6), be(F.col("nhash"), 6)).alias("entry"))
    os.makedirs(folder, exist_ok=True)
    dat, key = os.path.join(folder, f"{name}.dat"), os.path.join(folder, f"{name}.key")
    fixed = STORE_VERSION.to_bytes(2, "big") + (1).to_bytes(8, "big") * 2 + KEY_SIZE.to_bytes(2, "big")
    u48 = lambda x: x.to_bytes(6, "big")

    def body(own: bytes, spill: int) -> bytes:
        return (len(own) // ENTRY).to_bytes(2, "big") + u48(spill) + own

    with open(dat, "wb", buffering=1 << 20) as d, open(key, "wb", buffering=1 << 20) as k:
        d.write((DAT_MAGIC + fixed).ljust(DAT_HEADER, b"\0"))
        end = DAT_HEADER
        for part in joined(rows.orderBy("hash").select(F.concat(be(F.length("value"), 6), "hash", "value").alias("data"))):
            d.write(part)
            end += len(part)
        head = KEY_MAGIC + fixed + salt.to_bytes(8, "big") + xxhash.xxh64_intdigest(b"", salt).to_bytes(8, "big") + BLOCK.to_bytes(2, "big") + (0x8000).to_bytes(2, "big")
        k.write(head.ljust(BLOCK, b"\0"))
        done = 0

        def put(own: bytes) -> None:
            nonlocal end, done
            spill, whole = 0, CAPACITY * ENTRY
            for at in reversed(range(whole, len(own), whole)):  # the last block first: each one names the next
                b = body(own[at : at + whole], spill)
                d.write(bytes(6) + len(b).to_bytes(2, "big") + b)
                spill, end = end + 8, end + 8 + len(b)
            k.write(body(own[:whole], spill).ljust(BLOCK, b"\0"))
            done += 1

        now, own = 0, b""
        for bucket, part in joined_by(placed_rows.orderBy("bucket", "nhash", "hash").select("bucket", "entry")):
            while now < bucket:
                put(own)
                now, own = now + 1, b""
            own += part
        while done < n:
            put(own)
            own = b""
    return dat, key
