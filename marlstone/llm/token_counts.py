"""Token counts from distinct pre-tokens.

The distinct pre-tokens of the table are counted over all documents and each is given to
the library once. A document's count is the sum of its pre-tokens' counts times their
frequencies. The frequencies meet the counts in two joins: the most frequent pre-tokens,
HEAVY of them and HEAVY * HEAVY_BYTES bytes at most, are looked up where the document is
read, and the rest are joined by a shuffle and summed; no ids are kept anywhere. So no key
of the shuffle is frequent, however long it is. Pre-tokens of more than LONG bytes never
travel: the library counts them where they stand.

Null counts as empty. Rows count one by one, repeated ones too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import importable, slices, stage, table, text_of
from .packing import vocabulary_path
from .pretokens import special_strings, texts_of, tokenizer, with_pieces

#: Pre-tokens looked up in each task: so many at most, of HEAVY_BYTES at most on average.
HEAVY, HEAVY_BYTES, LONG = 200_000, 24, 4096
#: Distinct pre-tokens that a task holds before it passes them on.
HELD = 300_000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, int] = {}

    def out() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["piece", "n"])
        held.clear()
        return got

    for b in slices(batches):
        coded = b.column("__pieces").flatten().dictionary_encode()
        n = np.bincount(np.asarray(coded.indices), minlength=len(coded.dictionary)).tolist()
        short = np.asarray(pc.less_equal(pc.binary_length(coded.dictionary), LONG)).tolist()
        for p, k, ok in zip(texts_of(coded.dictionary), n, short, strict=True):
            if ok:
                held[p] = held.get(p, 0) + k
        if len(held) > HELD:
            yield out()
    yield out()


def piece_counts(docs: DataFrame, text_col: str, path: str) -> DataFrame:
    """piece, n (occurrences in the table), k (tokens): each distinct pre-token goes to the library once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in slices(batches, 20_000):
            k = [len(e) for e in t.encode_batch_fast(texts_of(b.column("piece")), add_special_tokens=False)] if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column("piece"), b.column("n"), pa.array(k, pa.int64())], ["piece", "n", "k"])

    cut = with_pieces(docs.select(F.col(text_col).alias("text")), "text", special_strings(path)).select("__pieces")
    return stage(cut.mapInArrow(_counted, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).mapInArrow(count, "piece string, n long, k long"), "piece-counts")


def heavy_pieces(counts: DataFrame, heavy: int) -> DataFrame:
    """piece, k of the most frequent pre-tokens, within both bounds: all above a frequency."""
    found = counts.where("n > 0").withColumn("level", F.floor(F.log2("n") * 8))
    levels = found.groupBy("level").agg(F.count(F.lit(1)).alias("c"), F.sum(F.octet_length("piece")).alias("size")).collect()  # eight for each doubling of the frequency
    least, total, size = None, 0, 0
    for r in sorted(levels, key=lambda r: -r["level"]):
        total, size = total + r["c"], size + r["size"]
        if total > heavy or size > heavy * HEAVY_BYTES:
            break
        least = r["level"]
    return (found.where(F.col("level") >= least) if least is not None else found.where(F.lit(False))).select("piece", "k")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, heavy: int = HEAVY) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens. path: a .json file whose pre-tokenizer is the public byte-level one."""
    path = path or vocabulary_path()
    spark = docs.sparkSession
    importable(spark)
    counts = piece_counts(docs, text_col, path)
    top = heavy_pieces(counts, heavy).toPandas()  # bounded: heavy rows, heavy * HEAVY_BYTES bytes
    known = spark.sparkContext.broadcast(dict(zip(top["piece"].tolist(), top["k"].tolist(), strict=True)))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, t = known.value.get, tokenizer(path)
        for b in slices(batches):
            n = b.num_rows
            pieces = b.column("__pieces")
            offsets = np.asarray(pieces.offsets, dtype=np.int64)
            coded = pieces.flatten().dictionary_encode()
            k = np.fromiter((get(p, -1) for p in texts_of(coded.dictionary)), np.int64, len(coded.dictionary))
            for i in np.flatnonzero(np.asarray(pc.greater(pc.binary_length(coded.dictionary), LONG))).tolist():
                k[i] = len(t.encode(coded.dictionary[i].as_py(), add_special_tokens=False))
            at = np.asarray(coded.indices, dtype=np.int64)
            doc = np.repeat(np.arange(n), np.diff(offsets))
            known_k = k[at]
            sums = np.bincount(doc, weights=np.maximum(known_k, 0), minlength=n).astype(np.int64)
            for i, text in enumerate(b.column("__whole").to_pylist()):
                if text is not None:
                    sums[i] = len(t.encode(text, add_special_tokens=False))
            # Pre-tokens that are not among the heavy ones: a row for each with its frequency in the document.
            rare = known_k < 0
            pair, freq = np.unique(doc[rare] * max(1, len(k)) + at[rare], return_counts=True)
            uid = np.asarray(b.column("uid"))
            row, piece = pair // max(1, len(k)), pair % max(1, len(k))
            none = pa.nulls
            m = len(pair)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([b.column("uid"), pa.array(uid[row], pa.int64())]),
                    pa.concat_arrays([b.column("id"), none(m, b.schema.field("id").type)]),
                    pa.concat_arrays([b.column("n_bytes"), none(m, pa.int64())]),
                    pa.concat_arrays([pa.array(sums), pa.array(freq, pa.int64())]),
                    # A row of the document itself: a key that no pre-token can be, as digits never follow that character in one.
                    pa.concat_arrays([pc.binary_join_element_wise("\0", pc.cast(b.column("uid"), pa.string()), ""), pc.take(coded.dictionary, pa.array(piece))]),
                ],
                ["uid", "id", "n_bytes", "n", "piece"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = with_pieces(rows.withColumn("uid", F.monotonically_increasing_id()).withColumn("n_bytes", F.octet_length(text_of("text")).cast("long")), "text", special_strings(path))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.select("uid", "id", "n_bytes", "__pieces", "__whole").mapInArrow(look_up, f"uid long, id {kind}, n_bytes long, n long, piece string")
    found = found.join(counts.select("piece", "k"), "piece", "left")
    out = found.groupBy("uid").agg(F.max("id").alias(id_col), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("n") * F.coalesce("k", F.lit(1))).alias("n_tokens"))
    return out.drop("uid")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return c.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
