"""Shared helpers of the training-data operators."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import importable, new_folder, shared_folder, stage, unstage

__all__ = ["anti", "asked", "build_filter", "copies", "hashed_sample", "importable", "may_contain", "new_folder", "release", "salted", "shared_folder", "slices", "spread_join", "stage", "table", "text_of", "unstage"]

#: A membership filter has FILTER_BITS bits for each key, at most FILTER_MAX_BITS (8 MB in all).
FILTER_BITS, FILTER_MAX_BITS, BITMAP_BITS = 16, 1 << 26, 32768
#: Settings of a JVM: the percentage of its heap that is free after a collection, at least and at most.
_FREE = ("MinHeapFreeRatio", "MaxHeapFreeRatio")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each row of a column of texts or of lists; 0 for others."""
    if pa.types.is_list(column.type):
        ends = np.asarray(column.offsets, np.int64)
        inner = np.concatenate([[0], np.cumsum(8 + _sizes(column.values))])
        return inner[ends[1:]] - inner[ends[:-1]]
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        return np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
    return np.zeros(len(column), np.int64)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at most rows rows and most bytes, or of one row, so that what is made of one stays small."""
    for b in batches:
        size = np.cumsum(sum((_sizes(c) for c in b.columns), np.zeros(b.num_rows, np.int64)))
        at = 0
        while at < b.num_rows:
            before = size[at - 1] if at else 0
            end = min(at + rows, max(at + 1, int(np.searchsorted(size, before + most, "right"))), b.num_rows)
            yield b.slice(at, end - at)
            at = end
        pa.default_memory_pool().release_unused()


def release(spark: SparkSession) -> None:
    """Let the driver drop what ran before and give its memory back: Spark removes shuffle files and broadcasts when its frames are collected as garbage, here and in its JVM.

    A JVM keeps a heap of more than three times what lives in it; while this collection runs, a fifth more has to do.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    jvm = spark._jvm
    try:
        beans = jvm.java.lang.management.ManagementFactory
        kind = jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean")
        flags = beans.newPlatformMXBeanProxy(beans.getPlatformMBeanServer(), "com.sun.management:type=HotSpotDiagnostic", kind)
        least, most = (flags.getVMOption(n).getValue() for n in _FREE)
    except Py4JError:  # another JVM
        jvm.System.gc()
        return
    try:
        flags.setVMOption(_FREE[0], "5")
        flags.setVMOption(_FREE[1], "20")
        jvm.System.gc()
    finally:
        flags.setVMOption(_FREE[1], most)
        flags.setVMOption(_FREE[0], least)


def text_of(name: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def anti(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows whose id is in dropped (one column); rows without an id stay.

    dropped is written first: where it is small, Spark then knows and doesn't shuffle docs.
    """
    gone = stage(dropped.toDF("__gone").distinct(), "dropped")
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")


def build_filter(keys: DataFrame, key: str, n: int) -> tuple[DataFrame, int]:
    """A bitmap of n keys as rows (__bucket, __bitmap), and its bits: FILTER_MAX_BITS at most, whatever the input."""
    bits = BITMAP_BITS
    while bits < min(FILTER_MAX_BITS, FILTER_BITS * n):
        bits *= 2
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    rows = keys.select((slot / BITMAP_BITS).cast("long").alias("__bucket"), (slot % BITMAP_BITS).alias("__slot"))
    return rows.groupBy("__bucket").agg(F.bitmap_construct_agg("__slot").alias("__bitmap")), bits


def asked(rows: DataFrame, filters: list[tuple[DataFrame, int]], key: str) -> DataFrame:
    """rows and __maybe: whether a filter has the bit of the key, as all keys of its table do and few others. No shuffle of rows.

    The bitmaps are broadcast. Beyond FILTER_MAX_BITS they let more rows through, so what is asked of the rows must be asked again.
    """
    out = rows.withColumn("__maybe", F.lit(False))
    for bitmap, bits in filters:
        slot = F.pmod(F.xxhash64(key), F.lit(bits))
        out = out.withColumn("__slot", slot % BITMAP_BITS).withColumn("__bucket", (slot / BITMAP_BITS).cast("long")).join(F.broadcast(bitmap), "__bucket", "left")
        byte = F.conv(F.hex(F.substring("__bitmap", (F.col("__slot") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        bit = F.call_function("shiftright", byte, (F.col("__slot") % 8).cast("int")).bitwiseAND(1) == 1
        out = out.withColumn("__maybe", F.col("__maybe") | F.coalesce(bit, F.lit(False))).drop("__slot", "__bucket", "__bitmap")
    return out


def may_contain(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key may be in keys: all whose key is there and few others, without a shuffle of rows."""
    return asked(rows, [build_filter(keys, key, keys.count())], key).where("__maybe").drop("__maybe")


def spread_join(rows: DataFrame, table_: DataFrame, key: list[str], weight: str, parts: int = 1000) -> DataFrame:
    """rows left joined with table_ (one row a key; weight: how many rows the key has). Both are written tables.

    Keys of one in parts of the rows or more, so parts of them at most, are broadcast; the
    rest, none of which is hot, are joined by a shuffle. Rows with a null key stay where they are.
    """
    total = table_.agg(F.sum(weight)).collect()[0][0] or 0  # one number
    hot = F.col(weight) * parts >= total
    first = rows.join(F.broadcast(table_.where(hot).withColumn("__hot", F.lit(True))), key, "left")
    null = F.lit(False)
    for k in key:
        null = null | F.col(k).isNull()
    rest = first.where(F.col("__hot").isNull() & ~null).select(*rows.columns).join(table_.where(~hot), key, "left")
    return first.where(F.col("__hot") | null).select(*rest.columns).unionByName(rest)


def salted(rows: DataFrame, key: str, salt: str, split: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(rows, a written table, with a salt; key and __parts): the rows of a key have so many salts that about split of them at most share one."""
    many = stage(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")), "salts")
    parts = F.ceil(F.col("__n") / split).cast("int")
    dealt = spread_join(rows, many, [key], "__n").withColumn(salt, F.pmod(F.xxhash64(*rows.columns), parts).cast("int")).drop("__n")
    return dealt, many.select(key, parts.alias("__parts"))


def copies(table_: DataFrame, parts: DataFrame, key: str, salt: str) -> DataFrame:
    """The rows of table_ whose key is in parts, once for each of its salts."""
    return table_.join(parts, key).withColumn(salt, F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")


def hashed_sample(rows: DataFrame, key: Column, n: int) -> DataFrame:
    """The n rows with the smallest hashes of key, or fewer.

    A threshold on the hash lets about 2 * n rows of the table through, so what tasks send
    to the driver does not grow with their number.
    """
    total = rows.count()
    h = F.xxhash64(key)
    hashed = rows.withColumn("__h", h)
    if total > 2 * n:
        hashed = hashed.where(F.call_function("shiftrightunsigned", "__h", F.lit(33)) < int(2 * n / total * 2**31))
    return hashed.orderBy("__h").limit(n).drop("__h")
