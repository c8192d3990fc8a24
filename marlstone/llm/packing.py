"""Packing by power-of-two decomposition.

A document's ids and an end id are cut, from the start, into pieces of 1024 ids and then
into the powers of two that make up the rest, largest first. Each piece fills a sequence
of its own length, sequences of equal length form a bucket, and so no sequence crosses
documents or holds padding. No shuffle is needed: a document is cut where it is read, and
write_buckets() brings equal lengths together in files.

Null and empty texts give the end id alone. Rows are packed one by one; repeated rows and
null ids are packed like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import importable, slices, table
from .pretokens import batch_ids, json_ids, special_strings, with_pieces

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces_of(lengths: np.ndarray, most: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(document, length) of the pieces of documents of these lengths, in order."""
    sizes = np.array([most >> k for k in range(most.bit_length())], np.int64)
    times = (lengths[:, None] % most & sizes[None, :]) > 0
    times = times.astype(np.int64)
    times[:, 0] = lengths // most
    return np.repeat(np.arange(len(lengths)), times.sum(axis=1)), np.repeat(np.tile(sizes, len(lengths)), times.ravel())


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, most: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, bucket, sequence_id, offset."""
    if most & (most - 1):
        raise ValueError("most must be a power of two")
    path = path or vocabulary_path()
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = json_ids(path)
        for b in slices(batches):
            tokens, bounds = batch_ids(b.column("__pieces"), b.column("__whole"), ids)
            lengths = np.diff(bounds) + 1
            last = np.cumsum(lengths) - 1
            own = np.full(len(tokens) + b.num_rows, end_id, "<u4")
            inside = np.ones(len(own), bool)
            inside[last] = False
            own[inside] = tokens
            doc, size = pieces_of(lengths, most)
            begin = np.cumsum(size) - size
            ends = np.concatenate([begin, [len(own)]]).astype(np.int32) * 4
            data = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends), pa.py_buffer(own)])
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(doc)), pa.array(begin - (last - lengths + 1)[doc]), pa.array(size), data, pa.array(lengths[doc])], ["doc_id", "start", "length", "ids", "doc_tokens"])

    cut = with_pieces(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", special_strings(path)).select("id", "__pieces", "__whole")
    kind = cut.schema["id"].dataType.simpleString()
    pieces = cut.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long")
    return pieces.select(F.col("doc_id").alias(id_col), "start", "length", "ids", "doc_tokens", F.log2("length").cast("int").alias("bucket"), F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """pack()'s rows as a Parquet folder for each bucket, without a shuffle: a reader of one has sequences of one length."""
    pieces.write.partitionBy("bucket").parquet(path)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
