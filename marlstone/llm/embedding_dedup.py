"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

Rotations are learned on at most SAMPLE vectors: principal axes, then alternating signs and
the orthogonal matrix that brings the vectors nearest to them, from several random starts.
Signs of the rotated, centred vector are its code. Substrings of the code are keys of
tables; two vectors of a label are candidates when they meet in a table and the first
FILTER bits of their codes don't differ in more than pairs at the least cosine do.

Width and number of the tables follow from the least cosine and the label's rows: a longer
substring keeps buckets small, and then so many more tables are kept, from as many
rotations as they need, that pairs at the least cosine meet with a probability of RECALL
whatever the size. This is measured on partners made for vectors of the sample. Labels of
some ten thousand rows and less have one table of one bucket: all their pairs are compared.
Candidates are reranked by the cosine of the original vectors in double precision. Vectors
of each length have rotations and tables of their own; those of different lengths don't link.

Vectors equal in all components and label form a class and one of them goes on; its number
counts in the links. Null, zero or not finite vectors, and null labels, link with nothing.
Rows with equal ids are copies of each other. Ties: the smallest id represents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import copies, hashed_sample, importable, salted, spread_join, stage, table
from .components import components

SAMPLE, ROUNDS, COSINE = 20_000, 40, 0.93
#: Share of the pairs at the least cosine that meet in a table, and bits of a code that are compared.
RECALL, FILTER = 0.99, 128
#: Synthetic partners that the share is measured on, and what a row in a table costs, in compared pairs.
PARTNERS, ROW = 2000, 3000
#: Labels of half as many rows or fewer always have one bucket.
SMALL = 1 << 14
#: Rows of one bucket that are compared at once; larger buckets are compared in blocks.
BLOCK = 1024


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Quantiser:
    """Mean and rotations of iterative quantisation: as many as bits are asked for, each from its own random start."""

    def __init__(self, x: np.ndarray, rounds: int = ROUNDS, seed: int = 7):
        self.mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        self.rounds, self.seed, self.rotations = rounds, seed, []
        v = x - self.mean
        d = x.shape[1]
        _, axes = np.linalg.eigh(v.T @ v + 1e-9 * np.eye(d))
        self.axes = axes[:, ::-1]
        self.fitted = v @ self.axes

    def __getstate__(self) -> dict:
        return self.__dict__ | {"fitted": self.fitted[:0]}  # the rotations go to tasks, not the sample

    def extend(self, bits: int) -> None:
        p, d = self.fitted, len(self.mean)
        while len(self.rotations) * d < bits:
            r, _ = np.linalg.qr(np.random.default_rng(self.seed + len(self.rotations)).normal(size=(d, d)))
            for _ in range(self.rounds if len(p) > d else 0):
                u, _, w = np.linalg.svd(np.where(p @ r >= 0, 1.0, -1.0).T @ p)
                r = (u @ w).T
            self.rotations.append(self.axes @ r)

    def bits(self, x: np.ndarray, n: int) -> np.ndarray:
        self.extend(n)
        v = x - self.mean
        return np.concatenate([np.zeros((len(x), 0), bool), *[v @ r >= 0 for r in self.rotations[: -(-n // len(self.mean))]]], axis=1)[:, :n]


def unfitted(d: int) -> Quantiser:
    """Random rotations, for lengths with too few vectors in the sample to learn on."""
    return Quantiser(np.zeros((0, d)))


def partners(x: np.ndarray, least: float, n: int = PARTNERS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """n pairs of unit vectors at cosine least: rows of x, moved one half anyhow, the other along differences of rows."""
    r = np.random.default_rng(seed)
    a = x[r.integers(len(x), size=n)]
    away = r.normal(size=a.shape)
    away[::2] = (x[r.integers(len(x), size=n)] - x[r.integers(len(x), size=n)])[::2]
    away -= np.einsum("ij,ij->i", away, a)[:, None] * a
    size = np.linalg.norm(away, axis=1)
    some = size > 1e-6
    a, away = a[some], away[some] / size[some, None]
    return a, least * a + math.sqrt(max(0.0, 1 - least * least)) * away


def _tables_for(width: int, flip: float, recall: float) -> float:
    """How many tables of independent bits it takes, if a bit differs with a probability of flip."""
    meet = (1 - flip) ** width
    return 1 if meet >= recall else math.ceil(math.log(1 - recall) / math.log1p(-meet)) if meet > 1e-12 else math.inf


def plan_tables(rows: int, q: Quantiser, x: np.ndarray, least: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Width and number of the tables for a label of rows vectors: the cheapest that hold the recall, by bits' theory and on partners of x."""
    flip = math.acos(max(-1.0, min(1.0, least))) / math.pi
    cost = {k: _tables_for(k, flip, recall) * (ROW + rows / 2 ** (k + 1)) for k in range(33)}
    a, b = partners(x, least) if len(x) else (x, x)
    for k in range(min(cost, key=cost.get), 0, -1):
        n = int(_tables_for(k, flip, recall))
        most = 2 * n
        met = (q.bits(a, k * most) == q.bits(b, k * most)).reshape(len(a), most, k).all(axis=2)
        shares = np.logical_or.accumulate(met, axis=1).mean(axis=0) if len(a) else np.ones(most)
        enough = np.flatnonzero(shares >= recall)
        if len(enough):
            return k, max(n, int(enough[0]) + 1)
    return 0, 1


def most_bits(q: Quantiser, x: np.ndarray, least: float = COSINE) -> int:
    """Bits of FILTER in which a pair at cosine least may differ: five deviations above the mean, by theory and on partners of x."""
    flip = math.acos(max(-1.0, min(1.0, least))) / math.pi
    most = FILTER * flip + 5 * math.sqrt(FILTER * flip * (1 - flip))
    if len(x):
        a, b = partners(x, least)
        if len(a):
            n = (q.bits(a, FILTER) != q.bits(b, FILTER)).sum(axis=1)
            most = max(most, n.mean() + 5 * n.std())
    return min(FILTER, math.ceil(most))


def _blocks(n: int) -> list[tuple[int, int]]:
    return [(i, min(n, i + BLOCK)) for i in range(0, n, BLOCK)]


def candidate_pairs(codes: DataFrame, kind: str, max_bits: int) -> DataFrame:
    """(a, b): pairs that meet in a table, each once. codes: key (of label, table and substring), rep, c0, c1 (FILTER bits)."""

    def compare(reps: np.ndarray, codes: np.ndarray) -> Iterator[pd.DataFrame]:
        for lo, hi in _blocks(len(reps)):
            x = codes[lo:hi]
            for u, v in _blocks(len(reps) - lo):
                y = codes[lo + u : lo + v]
                differs = np.bitwise_count(x[:, 0, None] ^ y[None, :, 0]) + np.bitwise_count(x[:, 1, None] ^ y[None, :, 1])
                i, j = np.nonzero(differs <= max_bits)
                if u == 0:  # the block itself: each pair once
                    i, j = i[j > i], j[j > i]
                a, b = reps[lo + i], reps[lo + u + j]
                other = a != b
                if other.any():
                    a, b = a[other], b[other]
                    yield pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # rows of the last key, which may go on
        for f in frames:
            if not len(f):
                continue
            k = f["key"].to_numpy()
            if held and held[-1]["key"].iat[-1] == k[0] == k[-1]:
                held.append(f)
                continue
            f = pd.concat([*held, f], ignore_index=True)
            k = f["key"].to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1])
            held = [f.iloc[starts[-1] :]]
            yield from groups(f, starts)
        if held:
            f = pd.concat(held, ignore_index=True)
            yield from groups(f, np.array([0, len(f)]))

    def groups(f: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        reps, codes = f["rep"].to_numpy(), f[["c0", "c1"]].to_numpy().view(np.uint64)
        out, n = [], 0
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            if hi - lo > 1:
                for pairs in compare(reps[lo:hi], codes[lo:hi]):
                    out.append(pairs)
                    n += len(pairs)
                    if n > 100_000:
                        yield pd.concat(out)
                        out, n = [], 0
        if out:
            yield pd.concat(out)

    return codes.repartition("key").sortWithinPartitions("key").mapInPandas(meet, f"a {kind}, b {kind}").distinct()


def rerank(pairs: DataFrame, vectors: DataFrame, kind: str, least: float) -> DataFrame:
    """The pairs, a written table, of one label and length whose cosine is at least least."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for _, g in f.groupby(f["va"].map(len)) if len(f) else ():
                x, y = (np.stack(g[c].to_numpy()).astype(np.float64) for c in ("va", "vb"))
                cos = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
                yield g.loc[cos >= least, ["a", "b"]]

    one = vectors.select(F.col("rep").alias("a"), F.col("v").alias("va"), F.col("label").alias("la"))
    two = vectors.select(F.col("rep").alias("b"), F.col("v").alias("vb"), F.col("label").alias("lb"))
    dealt, parts_a = salted(pairs, "a", "sa")
    dealt, parts_b = salted(stage(dealt, "embedding-dealt"), "b", "sb")
    both = dealt.join(copies(one, parts_a, "a", "sa"), ["a", "sa"]).join(copies(two, parts_b, "b", "sb"), ["b", "sb"])
    return both.where("la = lb and size(va) = size(vb)").select("a", "b", "va", "vb").mapInPandas(run, f"a {kind}, b {kind}")


def embedding_dedup(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """One row per row: id, n_links, component_id, kept."""
    importable(rows.sparkSession)
    rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    kind = rows.schema["id"].dataType.simpleString()
    good = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    # A class by a digest of the label and all components, 0.0 for -0.0: whole vectors need not meet again.
    digest = F.sha2(F.to_json(F.struct("label", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))), 256)
    rows = rows.withColumn("class", F.when(good & F.col("id").isNotNull() & F.col("label").isNotNull(), digest))
    vectors = stage(rows.where("class is not null").groupBy("class").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "embedding-classes")
    rows = stage(rows.select("id", "class"), "embedding-rows")
    done = rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    taken = hashed_sample(vectors.select("v", "rep"), F.col("rep"), sample).toPandas()  # bounded: sample vectors
    if not len(taken):
        return done
    lengths = taken["v"].map(len)
    fitted = {int(d): unit(np.stack(taken["v"][lengths == d].to_numpy())) for d in lengths.unique()}
    fitted = {d: x for d, x in fitted.items() if len(x) > d}
    fits = {d: Quantiser(x) for d, x in fitted.items()}
    counts = vectors.groupBy("label", F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("c"))
    sizes = {(r["label"], r["d"]): math.ceil(math.log2(r["c"])) for r in counts.where(F.col("c") > SMALL // 2).collect()}  # 2 * rows / SMALL labels and lengths at most
    by_size = {}
    for d, n in {(d, n) for (_, d), n in sizes.items()}:
        q = fits.setdefault(d, unfitted(d))
        by_size[d, n] = plan_tables(1 << n, q, fitted.get(d, np.zeros((0, d))), least)
    for d, q in fits.items():
        q.extend(max([FILTER, *[k * m for (e, _), (k, m) in by_size.items() if e == d]]))
    max_bits = max([most_bits(q, fitted.get(d, np.zeros((0, d))), least) for d, q in fits.items()], default=most_bits(unfitted(1), np.zeros((0, 1)), least))
    plans = {key: by_size[key[1], n] for key, n in sizes.items() if by_size[key[1], n] != (0, 1)}
    held = rows.sparkSession.sparkContext.broadcast((fits, plans))  # rotations by length, and plans of large labels

    def code(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fits, plans = held.value
        for f in frames:
            lengths = f["v"].map(len)
            keys = pd.Series([(d, *plans.get((label, d), (0, 1))) for label, d in zip(f["label"], lengths, strict=True)], index=f.index, dtype=object)
            for (d, k, n), g in f.groupby(keys):
                q = fits[d] if d in fits else unfitted(d)
                bits = q.bits(unit(np.stack(g["v"].to_numpy()).astype(np.float64)), max(FILTER, k * n))
                c = np.packbits(bits[:, :FILTER], axis=1).view(np.int64)
                weights = 1 << np.arange(k, dtype=np.int64)
                for t in range(n):
                    yield pd.DataFrame({"label": g["label"].to_numpy(), "d": d, "t": t, "s": bits[:, t * k : (t + 1) * k].astype(np.int64) @ weights, "rep": g["rep"].to_numpy(), "c0": c[:, 0], "c1": c[:, 1]})

    codes = vectors.select("rep", "label", "v").mapInPandas(code, f"label string, d int, t int, s long, rep {kind}, c0 long, c1 long")
    codes = codes.select(F.xxhash64("label", "d", "t", "s").alias("key"), "rep", "c0", "c1")
    links = stage(rerank(stage(candidate_pairs(codes, kind, max_bits), "embedding-pairs"), vectors, kind, least), "embedding-links")
    number = vectors.select("rep", F.col("n").alias("other"))
    each = links.select(F.col("a").alias("rep"), F.col("b").alias("to")).unionByName(links.select(F.col("b").alias("rep"), F.col("a").alias("to")))
    counts = each.join(number.withColumnRenamed("rep", "to"), "to").groupBy("rep").agg(F.sum("other").alias("linked"))
    found = components(links)
    by_class = vectors.select("class", "rep", "n").join(counts, "rep", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    by_class = stage(by_class.select("class", "n", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component_id")), "embedding-result")
    out = spread_join(rows, by_class, ["class"], "n")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, p.b FROM reach JOIN p ON p.a = reach.b),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
