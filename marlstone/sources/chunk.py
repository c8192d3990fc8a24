"""Chunk files: canonical, ordered, digested binary files of a ledger range; source and sink.

spark.read.format("ledgerchunk").option("section", ...).load(path or glob): sections chunk,
checkpoint, delta, header and tx. A file is one partition; its digest is checked by a
streaming pass before anything is parsed, and no file is held in memory. Paths must be
readable where tasks run.

Version 2 has two bytes for a ledger's number of transactions. A range with a ledger of more
than 65,535 is written as version 3, which has four, and whose digest begins with the magic
and the version; it is the same otherwise.
"""

from __future__ import annotations

import glob
import hashlib
import os
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.expr import be
from ..types import DELTA, HEADER, NODE, TX_ROW
from .batches import batched, joined

#: Values of the file format (fixed values).
MAGIC, FOOTER, VERSION, WIDE_VERSION = b"XRLA", b"ENDX", 2, 3
#: Bytes of a ledger's number of transactions, by version.
TX_COUNT = {VERSION: 2, WIDE_VERSION: 4}
NAME = "xrla_{}_{:010}_{:010}.xrla"
HEADER_BYTES, DIGEST_AT = 81, 49
SCHEMAS = {
    "chunk": "path string, network_id bigint, start_ledger bigint, end_ledger bigint, checkpoint_hash binary, chunk_hash binary, checkpoint_nodes bigint",
    "checkpoint": NODE,
    "delta": DELTA,
    "header": HEADER,
    "tx": TX_ROW,
}


class ChunkError(ValueError):
    """A chunk file that is not what its format says."""


def filename(network_id: int, start: int, end: int) -> str:
    return NAME.format(network_id, start, end)


def exactly(f: BinaryIO, n: int) -> bytes:
    b = f.read(n)
    if len(b) != n:
        raise ChunkError("unexpected end of file")
    return b


def number(f: BinaryIO, width: int) -> int:
    return int.from_bytes(exactly(f, width), "big")


def read_head(f: BinaryIO) -> dict:
    if exactly(f, 4) != MAGIC:
        raise ChunkError("not a chunk file")
    version = number(f, 1)
    if version not in TX_COUNT:
        raise ChunkError(f"unsupported version {version}")
    head = {"version": version, "network_id": number(f, 4), "start_ledger": number(f, 4), "end_ledger": number(f, 4), "checkpoint_hash": exactly(f, 32), "chunk_hash": exactly(f, 32)}
    if head["end_ledger"] < head["start_ledger"]:
        raise ChunkError("the range ends before it starts")
    return head


def new_digest(version: int):
    return hashlib.sha512(b"" if version == VERSION else MAGIC + bytes([version]))


def check_digest(f: BinaryIO, head: dict) -> None:
    h = new_digest(head["version"])
    while part := f.read(1 << 20):
        h.update(part)
    if h.digest()[:32] != head["chunk_hash"]:
        raise ChunkError(f"digest mismatch: expected {head['chunk_hash'].hex()}, got {h.digest()[:32].hex()}")
    f.seek(HEADER_BYTES)


def _node(f: BinaryIO) -> tuple[bytes, int, bytes]:
    hash_, kind = exactly(f, 32), number(f, 1)
    if kind > 4:
        raise ChunkError(f"unknown node type {kind}")
    return hash_, kind, exactly(f, number(f, 2))


def rows_of(f: BinaryIO, path: str, section: str) -> Iterator[tuple]:
    head = read_head(f)
    check_digest(f, head)
    start, end = head["start_ledger"], head["end_ledger"]
    count = number(f, 4)
    if section == "chunk":
        yield (path, head["network_id"], start, end, head["checkpoint_hash"], head["chunk_hash"], count)
        return
    for _ in range(count):
        node = _node(f)
        if section == "checkpoint":
            yield node
    if section == "checkpoint":
        return
    for seq in range(start + 1, end + 1):
        if number(f, 4) != seq:
            raise ChunkError(f"delta out of order at ledger {seq}")
        for _ in range(number(f, 4)):
            node = _node(f)
            if section == "delta":
                yield (seq, "add", *node)
        for _ in range(number(f, 4)):
            gone = exactly(f, 32)
            if section == "delta":
                yield (seq, "del", gone, None, None)
    if section == "delta":
        return
    from decimal import Decimal

    for seq in range(start, end + 1):
        if number(f, 4) != seq:
            raise ChunkError(f"transactions out of order at ledger {seq}")
        ledger_hash, account_hash = exactly(f, 32), exactly(f, 32)
        if seq == start and ledger_hash != head["checkpoint_hash"]:
            raise ChunkError("checkpoint_hash is not the hash of the first ledger")
        header = (seq, ledger_hash, account_hash, Decimal(number(f, 8)), number(f, 4), number(f, 4), number(f, 1), number(f, 1))
        if section == "header":
            yield header
        for _ in range(number(f, TX_COUNT[head["version"]])):
            tx = (seq, exactly(f, 32), exactly(f, number(f, 4)), exactly(f, number(f, 4)))
            if section == "tx":
                yield tx
    if exactly(f, 4) != FOOTER or f.read(1):
        raise ChunkError("the file does not end with its footer")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ChunkReader(DataSourceReader):
    def __init__(self, paths: list[str], section: str, schema: pa.Schema):
        self.paths, self.section, self.schema = paths, section, schema

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb", buffering=1 << 20) as f:
            yield from batched(rows_of(f, partition.path, self.section), self.schema)


class ChunkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ledgerchunk"

    def schema(self) -> str:
        section = self.options.get("section", "chunk")
        if section not in SCHEMAS:
            raise ValueError(f"section is one of {', '.join(SCHEMAS)}")
        return SCHEMAS[section]

    def reader(self, schema) -> DataSourceReader:
        path = self.options["path"].removeprefix("file://")
        paths = sorted(glob.glob(path)) if glob.has_magic(path) else [os.path.join(path, p) for p in sorted(os.listdir(path)) if p.endswith(os.path.splitext(NAME)[1])] if os.path.isdir(path) else [path]
        if not paths:
            raise FileNotFoundError(path)
        return ChunkReader(paths, self.options.get("section", "chunk"), to_arrow_schema(schema))


def _record(rows: DataFrame, part: int, ledger, sub: int, key, data) -> DataFrame:
    return rows.select(F.lit(part).alias("part"), ledger.cast("bigint").alias("ledger_seq"), F.lit(sub).alias("sub"), key.alias("key"), data.alias("data"))


def node_record() -> F.Column:
    return F.concat("hash", be(F.col("node_type"), 1), be(F.length("content"), 2), "content")


def segments(headers: DataFrame, checkpoint: DataFrame, delta: DataFrame, tx: DataFrame, start: int, end: int, version: int = VERSION) -> DataFrame:
    """All records of a chunk's body with the order they are written in: part, ledger_seq, sub, key, data."""
    none = F.lit(None).cast("binary")
    seq = F.col("ledger_seq")
    inside = seq.between(start, end)
    first = F.lit(start)
    every = headers.where(inside)
    added, gone = delta.where(inside & (F.col("op") == "add")), delta.where(inside & (F.col("op") == "del"))
    txs = tx.where(inside)
    sums = every.select("ledger_seq").distinct().join(added.groupBy("ledger_seq").agg(F.count(F.lit(1)).alias("a")), "ledger_seq", "left").join(gone.groupBy("ledger_seq").agg(F.count(F.lit(1)).alias("d")), "ledger_seq", "left").na.fill(0, ["a", "d"]).where(seq > start)
    with_n = every.join(txs.groupBy("ledger_seq").agg(F.count(F.lit(1)).alias("n")), "ledger_seq", "left").na.fill(0, ["n"])
    head = F.concat(be(seq, 4), "ledger_hash", "account_hash", be(F.col("drops"), 8), be(F.col("parent_close_time"), 4), be(F.col("close_time"), 4), be(F.col("close_time_resolution"), 1), be(F.col("close_flags"), 1), be(F.col("n"), TX_COUNT[version]))
    parts = [
        _record(checkpoint.agg(F.count(F.lit(1)).alias("n")), 0, first, 0, none, be(F.col("n"), 4)),
        _record(checkpoint, 0, first, 1, F.col("hash"), node_record()),
        _record(sums, 1, seq, 0, none, F.concat(be(seq, 4), be(F.col("a"), 4))),
        _record(added, 1, seq, 1, F.col("hash"), node_record()),
        _record(sums, 1, seq, 2, none, be(F.col("d"), 4)),
        _record(gone, 1, seq, 3, F.col("hash"), F.col("hash")),
        _record(with_n, 2, seq, 0, none, head),
        _record(txs, 2, seq, 1, F.col("tx_hash"), F.concat("tx_hash", be(F.length("tx_blob"), 4), "tx_blob", be(F.length("meta_blob"), 4), "meta_blob")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_chunk(headers: DataFrame, checkpoint: DataFrame, delta: DataFrame, tx: DataFrame, start: int, end: int, folder: str, network_id: int = 1) -> tuple[str, bytes]:
    """Write the canonical file of a range; returns its path and digest. Records are made and sorted in parallel; the digest needs them in order, so one writer streams them."""
    if end <= start:
        raise ValueError("a chunk ends after it starts")
    found = headers.where(F.col("ledger_seq").between(start, end)).agg(F.count(F.lit(1)), F.countDistinct("ledger_seq"), F.max(F.when(F.col("ledger_seq") == start, F.col("ledger_hash")))).collect()[0]
    if found[0] != end - start + 1 or found[1] != found[0]:
        raise ValueError("a range needs one header for each ledger")
    most = tx.where(F.col("ledger_seq").between(start, end)).groupBy("ledger_seq").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).collect()[0][0] or 0
    version = VERSION if most < 1 << 8 * TX_COUNT[VERSION] else WIDE_VERSION
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, filename(network_id, start, end))
    digest = new_digest(version)
    ordered = segments(headers, checkpoint, delta, tx, start, end, version).orderBy("part", "ledger_seq", "sub", "key").select("data")
    with open(path, "wb", buffering=1 << 20) as f:
        f.write(MAGIC + bytes([version]) + b"".join(x.to_bytes(4, "big") for x in (network_id, start, end)) + bytes(found[2]) + bytes(32))
        for part in joined(ordered):
            digest.update(part)
            f.write(part)
        digest.update(FOOTER)
        f.write(FOOTER)
        f.seek(DIGEST_AT)
        f.write(digest.digest()[:32])
    return path, digest.digest()[:32]
