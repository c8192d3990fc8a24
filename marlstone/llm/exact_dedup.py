"""Exact dedup by a log-structured merge index (DataFrame operations only).

Index keeps digests in levels of runs on disk. A batch's memtables, its partitions, are
sorted by digest and flushed; they are merged to one run of level 0 that has each digest
once, with its smallest entry and the number of entries. Every run is written with a filter,
a bitmap of its digests. When a level has FANOUT runs, compaction merges them to one run
of the next level, which again keeps the smallest identifiers.

Hits are digests with several entries. Within a run their number tells; between runs the
rows of each are asked of the filters that were written with the others, and only what
passes is merged. The hits get a filter of their own: rows that it rules out are unique and
take part in no shuffle, the others are joined with the hits. Hits receive byte
verification: the smallest and the largest text of a digest are equal if and only if all
its texts are. Digests whose texts differ are grouped anew by whole texts.

Null texts count as empty. Of equal texts the smallest id stays; rows without an id come
last, and of rows repeated with the same id one is kept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import asked, build_filter, new_folder, spread_join, stage, table, text_of

FANOUT = 4


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def _head() -> Column:
    return F.struct(F.col("id").isNull().alias("no_id"), "id", "uid")


@dataclass
class Run:
    """A sorted run: digest, head (its smallest entry) and n (its entries), and its filter."""

    path: str
    keys: int
    bits: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/run")

    def filter(self, spark: SparkSession) -> tuple[DataFrame, int]:
        return spark.read.parquet(f"{self.path}/filter"), self.bits


class Index:
    """Levels of runs in a folder. Their list is a table there too, a version for each change, so an index can be opened again."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.folder = folder or new_folder(spark, "lsm")
        self.levels: list[list[Run]] = []
        self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, folder: str, fanout: int = FANOUT) -> Index:
        out = cls(spark, folder, fanout)
        held = spark.read.parquet(f"{folder}/versions")
        out.version = held.agg(F.max("version")).collect()[0][0]
        for r in held.where(F.col("version") == out.version).orderBy("at").collect():  # a row for each run: fanout a level at most
            while len(out.levels) <= r["level"]:
                out.levels.append([])
            out.levels[r["level"]].append(Run(r["path"], r["keys"], r["bits"]))
        return out

    def runs(self) -> list[Run]:
        return [r for level in self.levels for r in level]

    def _note(self) -> None:
        self.version += 1
        rows = [(self.version, k, i, r.path, r.keys, r.bits) for k, level in enumerate(self.levels) for i, r in enumerate(level)]
        self.spark.createDataFrame(rows, "version long, level int, at int, path string, keys long, bits long").coalesce(1).write.mode("append").parquet(f"{self.folder}/versions")

    def _write(self, entries: DataFrame, level: int) -> None:
        """entries (digest, head, n) as one run of a level, with its filter."""
        path = f"{self.folder}/level{level}-{self.version}"
        merged = entries.groupBy("digest").agg(F.min("head").alias("head"), F.sum("n").alias("n"))
        merged.sortWithinPartitions("digest").write.parquet(f"{path}/run")
        rows = self.spark.read.parquet(f"{path}/run")
        keys = rows.count()
        bitmap, bits = build_filter(rows, "digest", keys)
        bitmap.write.parquet(f"{path}/filter")
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(Run(path, keys, bits))

    def add(self, memtables: DataFrame) -> None:
        """Flush memtables (digest, id, uid) as a run of level 0, and compact what is full."""
        self._write(memtables.select("digest", _head().alias("head"), F.lit(1).cast("long").alias("n")), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1
        self._note()

    def compact(self, level: int) -> None:
        """Merge the runs of a level to one of the next."""
        old, self.levels[level] = self.levels[level], []
        entries = old[0].rows(self.spark)
        for r in old[1:]:
            entries = entries.unionByName(r.rows(self.spark))
        self._write(entries, level + 1)

    def hits(self) -> DataFrame:
        """digest, head, n of digests with several entries. Runs meet where the filters of the others let rows through."""
        runs, parts = self.runs(), []
        for r in runs:
            rows = asked(r.rows(self.spark), [o.filter(self.spark) for o in runs if o is not r], "digest")
            parts.append(rows.where("__maybe or n > 1").drop("__maybe"))
        if len(parts) == 1:
            return parts[0]
        entries = parts[0]
        for p in parts[1:]:
            entries = entries.unionByName(p)
        return entries.groupBy("digest").agg(F.min("head").alias("head"), F.sum("n").alias("n")).where("n > 1")


def memtables(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column] = sha256, batch: int = 0) -> DataFrame:
    """id, digest, sha and uid of a batch's rows, each partition in order of digest. batch: a number of its own for each batch of an index."""
    rows = docs.select(F.col(id_col).alias("id"), normalised(text_of(text_col)).alias("text")).select("id", digest(F.col("text")).alias("digest"), sha256(F.col("text")).alias("sha"))
    return stage(rows.withColumn("uid", F.struct(F.lit(batch).alias("batch"), F.monotonically_increasing_id().alias("at"))).sortWithinPartitions("digest"), "lsm-memtables")


def torn(docs: DataFrame, hit_filter: tuple[DataFrame, int], text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """Digests that stand for different texts, found by comparing the bytes of all hits."""
    rows = docs.select(normalised(text_of(text_col)).alias("text")).select(digest(F.col("text")).alias("digest"), "text")
    ends = asked(rows, [hit_filter], "digest").where("__maybe").groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("most"))
    return stage(ends.where("least <> most").select("digest"), "lsm-torn")


def resolve(index: Index, rows: DataFrame, docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of rows, memtables() of all batches of the index: id, keep_id, group_size, kept, text_sha256. docs: the documents of all batches."""
    hits = stage(index.hits(), "lsm-hits")
    bitmap, bits = build_filter(hits, "digest", hits.count())
    hit_filter = (stage(bitmap, "lsm-hit-filter"), bits)
    bad = torn(docs, hit_filter, text_col, digest)
    split = not bad.isEmpty()
    good = rows.join(bad, "digest", "left_anti") if split else rows
    flagged = asked(good, [hit_filter], "digest")
    one = flagged.where("not __maybe").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("kept"), "sha")
    met = spread_join(flagged.where("__maybe").drop("__maybe"), hits, ["digest"], "n")
    several = F.col("n").isNotNull()
    out = one.unionByName(met.select("id", F.when(several, F.col("head.id")).otherwise(F.col("id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("n"), (~several | (F.col("uid") == F.col("head.uid"))).alias("kept"), "sha"))
    if split:
        text = normalised(text_of(text_col))
        again = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("digest", digest(F.col("text"))).join(bad, "digest", "left_semi")
        again = stage(again.withColumn("uid", F.monotonically_increasing_id()), "lsm-again")
        groups = again.groupBy("text").agg(F.min(_head()).alias("head"), F.count(F.lit(1)).alias("n"))
        again = again.join(groups, "text")
        out = out.unionByName(again.select("id", F.col("head.id").alias("keep_id"), "n", (F.col("uid") == F.col("head.uid")).alias("kept"), sha256(F.col("text")).alias("sha")))
    return out.select(F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256. digest: of a normalised text."""
    rows = memtables(docs, id_col, text_col, digest)
    index = Index(docs.sparkSession)
    index.add(rows)
    return resolve(index, rows, docs, id_col, text_col, digest)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""
