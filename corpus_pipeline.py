"""A corpus pipeline: language identification, exact and near dedup, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept and
returns a DataFrame, which is written as Parquet and read again before the next one. All
but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import anti, release, stage, table
from marlstone.llm.exact_dedup import exact_dedup
from marlstone.llm.language_id import identify
from marlstone.llm.minhash_dedup import near_dedup
from marlstone.llm.packing import pack
from marlstone.llm.secret_scan import redact


#: Rows in a batch for Python workers, as all stages share them and their memory.
BATCH, _ROWS = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def _ready(spark: SparkSession) -> None:
    release(spark)
    spark.conf.set(_ROWS, BATCH)


def _column(docs: DataFrame, name: str):
    return F.col(name) if name in docs.columns else None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or that no language explains, go. Rows without an id stay."""
    _ready(spark)
    found = identify(docs, "doc_id", "text", host=_column(docs, "source"))
    return anti(docs, found.where("not kept").select("doc_id"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays; of rows repeated with id and text, one does. Rows without an id stay."""
    _ready(spark)
    found = stage(exact_dedup(docs.select("doc_id", "text")), "pipeline-exact")
    kept = anti(docs, found.where("not kept and doc_id is not null and (keep_id is null or keep_id <> doc_id)").select("doc_id"))
    repeated = found.where("not kept and keep_id = doc_id").select("doc_id").distinct()
    if repeated.isEmpty():
        return kept
    again = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return anti(kept, repeated).unionByName(again)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays, that of the smallest id."""
    _ready(spark)
    found = near_dedup(docs)
    return anti(docs, found.where("not kept").select("doc_id"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark, and n_chars with it; no document goes."""
    _ready(spark)
    clean = redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("minhash_near_dedup", near),
    ("secret_scan", secrets),
    ("packing", packing),
]

#: No SQL: language models, hashing and merges can't be put in it; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other; the session's setting for batches is as before when they are done."""
    docs = table(spark, sf_dir, "documents")
    held = spark.conf.get(_ROWS)
    try:
        for name, step in STAGES:
            docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    finally:
        spark.conf.set(_ROWS, held)
    return docs
