"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are multiplied: the text's likelihood under a model of letter
trigrams for each language, the declared markup language, the address suffix, and a prior
of the host. The trigram model is fitted on about SAMPLE labelled rows at most, as many of
each language where there are enough, those with the smallest hashes of their ids. All other statistics come from grouped aggregation over the
whole table: a document counts with its posterior under text and declaration for each
language; a host's prior is smoothed towards that of its address suffix, this towards the
whole table's; how often a declaration stands with a language gives its likelihood.

A text's log likelihood is taken as that of EFFECTIVE trigrams at most, as trigrams of a
text depend on each other. Text in a language outside the fit is a class of its own,
"und". Its odds are those of a level of likelihood a trigram to the likelihood under all
languages mixed, so that text in several of them is not unknown. The level lies halfway
between what the mixture gives to low ones of a language's texts, held out of the fit, and
to texts of a language that is left out of the mixture.
A document is rejected when it holds no letters, or when no language reaches MIN_POSTERIOR
beside the others and "und". Nulls: a null text is empty, null declarations and hosts
are no evidence. Rows are judged one by one, repeated ones alike; ties go to the language
that comes first in alphabetical order. Without labelled rows there is nothing to tell
languages by: all is "und" with a posterior of 0, and what holds letters is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import importable, slices, spread_join, stage, table, text_of

SAMPLE, BINS, SMOOTH, CHUNK = 2000, 1 << 16, 0.05, 1 << 20
EFFECTIVE, MIN_POSTERIOR = 60, 0.5
#: The prior of text in no language of the fit, and the share of a language's own texts that counts as low.
UNKNOWN, LOW = 0.01, 0.01
HOST_WEIGHT, SUFFIX_WEIGHT = 20.0, 50.0


def trigram_bins(text: str) -> tuple[np.ndarray, int]:
    """Bins of the trigrams that hold letters, and how many letters there are."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if not len(x):
        return np.zeros(0, np.uint16), 0
    letter = np.zeros(len(x), bool)
    low = x < 128
    letter[low] = (x[low] >= 97) & (x[low] <= 122)
    high = np.flatnonzero(~low)
    if len(high):
        seen, back = np.unique(x[high], return_inverse=True)
        letter[high] = np.array([chr(int(c)).isalpha() for c in seen], bool)[back]
    x = np.where(letter, x, 32)
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)  # one space between words
    x = np.concatenate([[32], x[keep], [32]]).astype(np.uint64)
    h = (x[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (x[2:] * np.uint64(0x165667B19E3779F9))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(40)) % np.uint64(BINS)).astype(np.uint16), int(letter.sum())


def text_bins(text: str) -> tuple[np.ndarray, int]:
    """trigram_bins of a whole text, CHUNK characters at a time: what is made of a long text stays small."""
    parts = [trigram_bins(text[at : at + CHUNK]) for at in range(0, len(text), CHUNK)] or [trigram_bins("")]
    return np.concatenate([x for x, _ in parts]), sum(n for _, n in parts)


class TrigramModel:
    def __init__(self, rows: list[tuple[str, str]]):
        """rows: language, text."""
        self.languages = sorted({lang for lang, _ in rows})
        owner = np.array([self.languages.index(lang) for lang, _ in rows], int)
        bins = [text_bins(text)[0] for _, text in rows]
        turn: dict[int, int] = {}
        halves = np.full((2, len(self.languages), BINS), 0.0)  # every other text of a language
        for i, x in zip(owner.tolist(), bins, strict=True):
            np.add.at(halves[turn.get(i, 0) % 2, i], x, 1)
            turn[i] = turn.get(i, 0) + 1
        self.log = self._logs(halves.sum(axis=0))
        self.mixed = self._mixed(self.log) if rows else np.zeros(BINS)
        self.level = self._levels(owner, bins, halves)

    @staticmethod
    def _logs(counts: np.ndarray) -> np.ndarray:
        counts = counts + SMOOTH
        return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)

    @staticmethod
    def _mixed(logs: np.ndarray) -> np.ndarray:
        return np.logaddexp.reduce(logs.astype(float), axis=0) - math.log(max(1, len(logs)))

    def _levels(self, owner: np.ndarray, bins: list[np.ndarray], halves: np.ndarray) -> np.ndarray:
        """For each language, the log likelihood a trigram below which texts that are likeliest in it are rather unknown."""
        n = len(self.languages)
        own: list[list[float]] = [[] for _ in range(n)]
        other: list[list[float]] = [[] for _ in range(n)]
        for half in (0, 1):  # its texts under the model of the other half
            fitted = np.flatnonzero(halves[1 - half].sum(axis=1))
            logs = self._logs(halves[1 - half])
            whole = self._mixed(logs[fitted])
            for i in fitted.tolist():
                rest = fitted[fitted != i]
                without = self._mixed(logs[rest]) if len(rest) else np.full(BINS, -math.log(BINS))
                for x in [bins[r] for r in np.flatnonzero(owner == i)[half::2]]:
                    if len(x):
                        own[i].append(whole[x].mean())
                        other[i].append(without[x].mean())
        nearest = max((np.median(x) for x in other if x), default=-math.log(BINS))
        low = [np.quantile(x, LOW) if x else -math.log(BINS) for x in own]
        return np.array([min(x, (x + nearest) / 2) for x in low])

    def score(self, text: str) -> tuple[list[float], int]:
        """Log likelihoods in the order of languages and then of unknown text, and the number of letters."""
        bins, letters = text_bins(text)
        if not letters:
            return [0.0] * (len(self.languages) + 1), 0
        each = np.array([x[bins].mean(dtype=float) for x in self.log])
        unknown = each.max() + self.level[each.argmax()] - self.mixed[bins].mean()
        return (np.append(each, unknown) * min(len(bins), EFFECTIVE)).tolist(), letters


def fit(docs: DataFrame, text_col: str, label_col: str, id_col: str, sample: int = SAMPLE) -> TrigramModel:
    if label_col not in docs.columns:
        return TrigramModel([])
    labelled = docs.where(F.col(label_col).isNotNull() & (F.col(label_col) != "") & F.col(text_col).isNotNull())
    labelled = labelled.select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.lower(label_col).alias("label"), F.col(text_col).alias("text"))
    counts = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("c"))
    n = max(1, counts.count())
    share = -(-sample // n)
    # A threshold on the hash lets about 2 * share rows of a language through before they are put in order.
    let = F.call_function("shiftrightunsigned", "h", F.lit(33)) < F.lit(2.0 * share + 20) / F.col("c") * 2.0**31
    first = Window.partitionBy("label").orderBy("h")
    rows = labelled.join(F.broadcast(counts), "label").where(let).withColumn("k", F.row_number().over(first)).where(F.col("k") <= share)
    return TrigramModel([(r["label"], r["text"]) for r in rows.orderBy("label", "k").collect()])


def _text_posterior(ll: list[float]) -> list[float]:
    """Under the text alone, unknown text the last."""
    x = np.array(ll)
    x[-1] += math.log(UNKNOWN)
    x = np.exp(x - x.max())
    return (x / x.sum()).tolist()


def suffix_of(host: Column) -> Column:
    """The address suffix: what follows the last dot of a host, or null."""
    return F.when(host.contains("."), F.lower(F.substring_index(host, ".", -1)))


def text_evidence(docs: DataFrame, model: TrigramModel, id_col: str, text_col: str, declared: Column, host: Column, suffix: Column) -> DataFrame:
    """id, declared, host, suffix, ll (log likelihoods, the last of unknown text), under (posteriors by them), letters: written once, then used by every count."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # languages x BINS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [held.value.score(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("id", "declared", "host", "suffix")] + [pa.array([x for x, _ in got], pa.list_(pa.float64())), pa.array([_text_posterior(x) for x, _ in got], pa.list_(pa.float64())), pa.array([n for _, n in got], pa.int64())], ["id", "declared", "host", "suffix", "ll", "under", "letters"])

    rows = docs.select(F.col(id_col).alias("id"), F.lower(declared.cast("string")).alias("declared"), host.cast("string").alias("host"), suffix.cast("string").alias("suffix"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return stage(rows.mapInArrow(run, f"id {kind}, declared string, host string, suffix string, ll array<double>, under array<double>, letters long"), "language-text")


def _shares(counts: DataFrame, n: int, key: str, above: Column, weight: float) -> DataFrame:
    """key, docs and p_key: its shares, smoothed towards above, an array, with a weight in documents."""
    total = sum((F.col(f"s{i}") for i in range(1, n)), F.col("s0"))
    return counts.select(key, "docs", F.array(*[(F.col(f"s{i}") + weight * above[i]) / (total + weight) for i in range(n)]).alias(f"p_{key}"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None, host: Column | None = None, suffix: Column | None = None, model: TrigramModel | None = None, label_col: str = "lang") -> DataFrame:
    """One row per row: id, language, posterior, letters, kept."""
    importable(docs.sparkSession)
    none = F.lit(None).cast("string")
    declared, host = (none if c is None else c for c in (declared, host))
    own_suffix = suffix is not None
    suffix = suffix if own_suffix else suffix_of(host.cast("string"))
    model = model or fit(docs, text_col, label_col, id_col)
    langs = model.languages
    if not langs:
        letters = F.length(F.regexp_replace(text_of(text_col), r"\P{L}", "")).cast("long")
        return docs.select(F.col(id_col), F.lit("und").alias("language"), F.lit(0.0).alias("posterior"), letters.alias("letters"), (letters > 0).alias("kept"))
    n = len(langs)
    rows = text_evidence(docs, model, id_col, text_col, declared, host, suffix)

    # A document's weight for each language in the counts: its posterior under the text, without letters the declaration.
    under = [F.col("under")[i] for i in range(n + 1)]
    soft = [F.when(F.col("letters") > 0, p).otherwise(F.coalesce((F.col("declared") == lang).cast("double"), F.lit(1.0 / n))) for lang, p in zip(langs, under[:n], strict=True)]
    soft.append(F.when(F.col("letters") > 0, under[n]).otherwise(0.0))
    weighed = rows.select("declared", "host", "suffix", *[s.alias(f"w{i}") for i, s in enumerate(soft)])
    sums = [F.sum(f"w{i}").alias(f"s{i}") for i in range(n)]
    known = F.when(F.col("declared").isin(langs), F.col("declared")).otherwise("other")
    table_ = weighed.where("declared is not null").groupBy(known.alias("d")).agg(*sums, F.sum(f"w{n}").alias(f"s{n}")).collect()  # languages and "other": n + 1 rows at most
    seen = {r["d"]: [r[f"s{i}"] for i in range(n + 1)] for r in table_}
    totals = [sum(v[i] for v in seen.values()) for i in range(n + 1)]
    whole = weighed.agg(*sums).collect()[0]
    everything = sum((whole[f"s{i}"] or 0.0) for i in range(n))
    world = F.lit([((whole[f"s{i}"] or 0.0) + 1.0) / (everything + n) for i in range(n)])
    kinds = [*langs, "other"]
    declared_log = {d: [math.log((seen.get(d, [0.0] * (n + 1))[i] + 0.5) / (totals[i] + 0.5 * len(kinds))) for i in range(n + 1)] for d in kinds}

    docs_ = F.count(F.lit(1)).alias("docs")
    by_suffix = stage(_shares(weighed.where("suffix is not null").groupBy("suffix").agg(docs_, *sums), n, "suffix", world, SUFFIX_WEIGHT), "language-suffix")
    hosts = stage(weighed.where("host is not null").groupBy("host").agg(F.min("suffix").alias("suffix"), docs_, *sums), "language-hosts")
    hosts = spread_join(hosts, by_suffix.withColumnRenamed("docs", "d"), ["suffix"], "d")
    by_host = stage(_shares(hosts, n, "host", F.coalesce("p_suffix", world), HOST_WEIGHT), "language-host")

    fused = spread_join(rows, by_host, ["host"], "docs").drop("docs")
    if own_suffix:  # else rows without a host have no suffix either
        fused = spread_join(fused, by_suffix, ["suffix"], "docs").drop("docs").withColumn("p_host", F.coalesce("p_host", "p_suffix"))
    # Arrays in the order of languages, unknown text the last.
    add = lambda x, y: F.zip_with(x, y, lambda p, q: p + q)
    prior = F.concat(F.transform(F.coalesce("p_host", world), lambda p: F.log(p * (1 - UNKNOWN))), F.array(F.lit(math.log(UNKNOWN))))
    said = F.when(F.col("declared").isNull(), F.lit([0.0] * (n + 1))).otherwise(F.coalesce(*[F.when(known == d, F.lit(declared_log[d])) for d in kinds]))
    post = fused.select("id", "letters", add(add(F.col("ll"), prior), said).alias("logs"))
    post = post.select("id", "letters", F.transform("logs", lambda x: F.exp(x - F.array_max("logs"))).alias("odds"))
    post = post.select("id", "letters", F.transform("odds", lambda x: x / F.aggregate("odds", F.lit(0.0), lambda p, q: p + q)).alias("q"))
    post = post.select("id", "letters", F.slice("q", 1, n).alias("q"), F.col("q")[n].alias("none")).withColumn("best", F.array_max("q"))
    unknown = (F.col("letters") == 0) | (F.col("none") > F.col("best"))
    name = F.when(unknown, "und").otherwise(F.element_at(F.lit(langs), F.array_position("q", F.col("best")).cast("int")))
    sure = F.when((F.col("letters") > 0) & unknown, F.col("none")).otherwise(F.col("best"))
    kept = (F.col("letters") > 0) & (F.col("best") >= MIN_POSTERIOR)
    return post.select(F.col("id").alias(id_col), name.alias("language"), sure.alias("posterior"), "letters", kept.alias("kept"))


def identify_pages(pages: DataFrame, model: TrigramModel) -> DataFrame:
    """Raw pages: the text between tags, <html lang>, and host and suffix from the url."""
    lang = F.regexp_extract("html", r"(?i)<html[^>]*\slang=[\"']?([A-Za-z]+)", 1)
    host = F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1))
    text = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    text = F.regexp_replace(text, r"&(#?\w+);", " ")  # names of characters are in no language
    rows = pages.select("page_id", text.alias("text"), F.when(lang != "", lang).alias("declared"), F.when(host != "", host).alias("host"))
    return identify(rows, "page_id", "text", F.col("declared"), F.col("host"), model=model)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: evidence is the text and the source, as host. The column lang labels the rows of the fit, and so is none."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, "doc_id", "text", host=F.col("source"))


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, with all four kinds of evidence; the trigram model is fitted on documents."""
    model = fit(table(spark, sf_dir, "documents"), "text", "lang", "doc_id")
    return identify_pages(table(spark, sf_dir, "pages"), model)
