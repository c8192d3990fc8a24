"""MinHash near-dedup with min-max hashing.

Each of HASHES permutations gives two signature values, the least and the largest hash of
a document's shingles, so 2 * HASHES values cost HASHES evaluations. Bands of BAND values
are the buckets. Documents with equal sequences of words form a class first, and only one
of a class goes on. In each of ROUNDS rounds every class of a bucket that is not yet in one component with
the bucket's hub is compared with it; the hub is the smallest id, then another member in
each round, and what is linked is one component from then on. So the pairs of a round grow
with a bucket, not with its square, and large groups of near copies become one component.
Where a bucket still holds several components after that, their members are compared with
each other: in blocks of BLOCK members, by counts of shingles in BINS bins first, as two
sets share no more than the sum of the smaller counts. So every pair that shares a bucket
is linked, or joined by links, or was found too different. Links are confirmed on whole
shingle sets. Least and largest hash of a permutation both agree where two different
shingles of the union are shared, so a pair at the threshold of 0.8 shares no bucket with a
probability of (1 - 0.64 ** 2) ** 24, about three in a million, if it has many shingles,
and of (1 - 0.6 ** 2) ** 24, about two in a hundred thousand, if it has five in all.
The rows of a frequent bucket and the partners of one hub are dealt over several tasks.

Shingles are WIDTH consecutive words as they stand, after lower-casing A-Z; a text with
fewer words is one shingle. Null and empty texts have no shingles and no links. Rows with
the same id are the same document. Ties: the smallest id represents a class.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import copies, importable, may_contain, release, salted, slices, spread_join, stage, table, text_of
from .components import components

HASHES, BAND, WIDTH, PERCENT, ROUNDS = 48, 4, 5, 80, 2
BINS, BLOCK, CHUNK = 512, 1024, 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_WORDS = 200_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _WORDS:
            self.clear()
        self[word] = got = xxhash.xxh3_64_intdigest(word)
        return got


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space alone


def word_hashes(text: str, known: _Words) -> tuple[np.ndarray, bytes]:
    """The 64-bit hashes of the words, and a SHA-256 of their sequence; CHUNK bytes at a time, cut between words."""
    data = text.encode("utf-8", "surrogatepass").lower()
    digest, parts, at = hashlib.sha256(), [], 0
    while at < len(data):
        end = at + CHUNK
        if end < len(data):
            gap = _GAP.search(data, end)
            end = gap.start() if gap else len(data)
        words = data[at:end].split()
        digest.update(b" ".join(words) + b" " if words else b"")
        parts.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), digest.digest()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(w: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles of words with these hashes."""
    if not len(w):
        return w
    n = min(width, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - n + 1 + i])
    return np.unique(h)


def multipliers(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    x = _mixed(np.arange(1, 2 * hashes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:hashes] | np.uint64(1), x[hashes:]


def min_max_bands(h: np.ndarray, hashes: int = HASHES, band: int = BAND) -> np.ndarray:
    """A hash for each band of the signature (min 0, max 0, min 1, max 1, ...)."""
    a, b = multipliers(hashes)
    least, most = np.full(hashes, np.uint64(2**64 - 1)), np.zeros(hashes, np.uint64)
    for at in range(0, len(h), 4096):
        x = h[at : at + 4096, None] * a + b
        x ^= x >> np.uint64(32)
        np.minimum(least, x.min(axis=0), out=least)
        np.maximum(most, x.max(axis=0), out=most)
    values = np.stack([least, most], axis=1).reshape(-1, band)
    out = np.arange(len(values), dtype=np.uint64)
    for i in range(band):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + values[:, i])
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, hashes: int = HASHES, band: int = BAND) -> DataFrame:
    """id, class (of equal words, by a SHA-256 of them), n_shingles, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for b in slices(batches):
            n, classes, flat = [], [], []
            for t in b.column("text").to_pylist():
                words, sequence = word_hashes(t, known)
                h = shingle_hashes(words, width)
                n.append(len(h))
                classes.append(sequence if len(h) else None)
                flat.append(min_max_bands(h, hashes, band).view(np.int64) if len(h) else np.zeros(0, np.int64))
            offsets = np.cumsum([0, *map(len, flat)])
            bands = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(classes, pa.binary()), pa.array(n, pa.int64()), bands], ["id", "class", "n_shingles", "bands"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, class binary, n_shingles long, bands array<long>")


def confirmed(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, hot: bool) -> DataFrame:
    """ca, cb of the pairs (a, b, ca, cb) whose shingle sets are similar enough; texts are read for documents in pairs alone.

    A b may have any number of partners, an a too if it is hot, else no more than there are bands.
    """

    def shingles(text: str) -> set:
        w = words_of(text)
        return set(zip(*(w[i:] for i in range(width)), strict=False)) if len(w) >= width else {tuple(w)} if w else set()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, set()
        for b in slices(batches):
            right, texts, others = b.column("b").to_pylist(), b.column("text_a"), b.column("text_b")
            ok = []
            for i in range(b.num_rows):
                if right[i] != last:
                    last, last_set = right[i], shingles(others[i].as_py())
                s = shingles(texts[i].as_py())
                both = len(s & last_set)
                ok.append(bool(s) and 100 * both >= percent * (len(s) + len(last_set) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("ca").filter(keep), b.column("cb").filter(keep)], ["a", "b"])

    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    texts = stage(may_contain(texts, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id"), "minhash-texts")
    kind = docs.schema[id_col].dataType.simpleString()
    one, two = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    dealt, parts = salted(pairs, "b", "sb")
    two = copies(two, parts, "b", "sb")
    if hot:
        dealt, parts = salted(stage(dealt, "minhash-dealt"), "a", "sa")
        both = dealt.join(two, ["b", "sb"]).join(copies(one, parts, "a", "sa"), ["a", "sa"])
    else:
        both = dealt.join(two, ["b", "sb"]).join(one, "a")
    both = both.select("b", "ca", "cb", "text_a", "text_b")
    return both.mapInArrow(run, f"a {kind}, b {kind}")


def bin_counts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """rep and bins, the number of its shingles in each of BINS bins as bytes, of the documents in ids (rep); null where a number exceeds a byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for b in slices(batches):
            out = []
            for t in b.column("text").to_pylist():
                n = np.bincount((shingle_hashes(word_hashes(t, known)[0], width) % np.uint64(BINS)).astype(np.int64), minlength=BINS)
                out.append(n.astype(np.uint8).tobytes() if n.max() < 256 else None)
            yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array(out, pa.binary())], ["rep", "bins"])

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("rep"), text_of(text_col).alias("text"))
    kind = rows.schema["rep"].dataType.simpleString()
    return may_contain(rows, ids, "rep").mapInArrow(run, f"rep {kind}, bins binary").dropDuplicates(["rep"])


def across(member: DataFrame, kind: str, percent: int) -> DataFrame:
    """(a, b, ca, cb): pairs of a bucket's members of different components whose sizes and bins allow the similarity. member: band, value, rep, n, c, bins."""
    groups = ["band", "value", "i", "j"]

    def pairs(f: pd.DataFrame) -> pd.DataFrame:
        rep, n, c, own = (f[x].to_numpy() for x in ("rep", "n", "c", "own"))
        bins = np.stack([np.frombuffer(x, np.uint8) if x is not None else np.full(BINS, 255, np.uint8) for x in f["bins"]])
        loose = f["bins"].isna().to_numpy()
        cross = f["i"].iloc[0] != f["j"].iloc[0]
        found: tuple[list, ...] = ([], [], [], [])
        for x in range(len(f) - 1):
            y = np.arange(x + 1, len(f))
            y = y[(c[y] != c[x]) & (100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x]))]
            if cross:
                y = y[own[y] != own[x]]
            if not loose[x] and len(y):
                shared = np.minimum(bins[x], bins[y]).sum(axis=1, dtype=np.int64)
                # 100 * s >= percent * (n + m - s)
                y = y[loose[y] | ((100 + percent) * shared >= percent * (n[x] + n[y]))]
            for k in y:
                hi, lo = (x, k) if rep[x] > rep[k] else (k, x)
                for column, value in zip(found, (rep[hi], rep[lo], c[hi], c[lo]), strict=True):
                    column.append(value)
        return pd.DataFrame(dict(zip(("a", "b", "ca", "cb"), found, strict=True)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for f in frames:
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            if not len(f):
                continue
            k = f[groups].to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(np.any(k[1:] != k[:-1], axis=1)) + 1])
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                if hi - lo > 1:
                    yield pairs(f.iloc[lo:hi])
            held = f.iloc[starts[-1] :]
        if held is not None and len(held) > 1:
            yield pairs(held)

    sizes = stage(member.groupBy("band", "value").agg(F.count(F.lit(1)).alias("size")), "minhash-sizes")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    cells = spread_join(member, sizes, ["band", "value"], "size").withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("band", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "n", "c", "bins")
    return cells.repartition(*groups).sortWithinPartitions(*groups).mapInPandas(run, f"a {kind}, b {kind}, ca {kind}, cb {kind}")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, hashes: int = HASHES, band: int = BAND) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept."""
    importable(docs.sparkSession)
    docs = docs.select(id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = stage(signatures(docs, id_col, text_col, width, hashes, band), "minhash-rows")
    full = rows.where("class is not null and id is not null")
    classes = stage(full.groupBy("class").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "minhash-classes")
    buckets = classes.select("rep", "n", F.posexplode("bands").alias("band", "value"))
    hubs = stage(buckets.groupBy("band", "value").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "minhash-buckets")
    open_ = spread_join(buckets, hubs, ["band", "value"], "size").where("size is not null").select("band", "value", "rep", "n")
    found = classes.select("rep", F.col("rep").alias("c"))
    near = lambda n, m: 100 * F.least(n, m) >= percent * F.greatest(n, m)  # noqa: E731  sizes that the similarity allows
    bucket = ["band", "value"]
    for k in range(ROUNDS + 1):
        release(docs.sparkSession)
        # Members of buckets that still hold several components, with these.
        member = stage(open_.join(found, "rep"), "minhash-members")
        order = F.xxhash64("rep", F.lit(k)) if k else F.col("rep")
        heads = member.groupBy(*bucket).agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min_by(F.struct("rep", "n", "c"), order).alias("hub"), F.count(F.lit(1)).alias("size")).where("c0 < c1")
        heads = stage(heads.select(*bucket, "hub", "size"), "minhash-heads")
        member = stage(spread_join(member, heads, bucket, "size").where("size is not null").drop("size"), "minhash-open")
        if member.isEmpty():
            break
        if k < ROUNDS:
            pairs = member.where((F.col("c") != F.col("hub.c")) & near(F.col("n"), F.col("hub.n"))).select(F.col("rep").alias("a"), F.col("hub.rep").alias("b"), F.col("c").alias("ca"), F.col("hub.c").alias("cb"))
        else:
            counts = bin_counts(docs, member.select("rep").distinct(), id_col, text_col, width)
            pairs = across(stage(member.select(*bucket, "rep", "n", "c").join(counts, "rep"), "minhash-bins"), kind, percent)
        links = stage(confirmed(stage(pairs.distinct(), "minhash-pairs"), docs, id_col, text_col, width, percent, k == ROUNDS), "minhash-links")
        joined = components(links)
        found = stage(found.join(joined.withColumnRenamed("node", "c"), "c", "left").select("rep", F.coalesce("component", "c").alias("c")), "minhash-components")
        open_ = member.select(*bucket, "rep", "n")
    by_class = classes.join(found, "rep").select("class", F.col("c").alias("component_id"))
    out = rows.drop("bands").join(by_class, "class", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), width=2)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, hash(x) AS h, x FROM (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END) AS x FROM w)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.h = b.h AND a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
p AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, p.b FROM reach JOIN p ON p.a = reach.b),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, component_id, documents.doc_id = component_id AS kept FROM documents JOIN c ON c.a = documents.doc_id LEFT JOIN n ON n.doc_id = documents.doc_id
"""
