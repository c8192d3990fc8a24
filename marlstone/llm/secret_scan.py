"""Secret scans: fixed patterns, and strings that a primed zstandard can't compress.

Besides the patterns' spans, words of MIN_LENGTH characters or more that mix letters and
digits are candidates where a sensitive name stands at most NEAR characters before. A
candidate's novelty is the number of bytes by which it lengthens the compressed form of what
surrounds it, AROUND characters on each side, by its length in bytes. zstandard is primed
with a dictionary of identifiers: the DICTIONARY words that stand most often in such
surroundings in the whole table, by grouped counts, after the common names below. Words that
repeat the surroundings or are made of identifiers cost few bytes; candidates at or above
MIN_NOVELTY are reported as kind novel.

Null counts as empty. Rows are scanned one by one. Offsets are code points.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import importable, slices, table, text_of

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs of 32 or more; a shorter run holds no longer one
#: Names after which a value may be a secret, and common identifiers (fixed values).
SENSITIVE = re.compile(r"(?i:passw|passphrase|secret|token|api_?key|credential|private_?key|access_?key|auth|bearer|signature|pwd)", re.A)
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key client_id client_secret username user "
    "credential authorization bearer signature session cookie config settings environment variable default value "
    "example test production staging database connection string localhost server host port http https www com "
    "function return class import export const public static void int long double boolean null true false none "
    "self this print format request response header body content type application json text html utf-8 abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 "
)
#: Each match of SENSITIVE and ASSIGN holds one of these in lower case: texts without them need no search.
NAMES = ("passw", "passphrase", "secret", "token", "api", "credential", "private", "access", "auth", "bearer", "signature", "pwd")
MIN_LENGTH, NEAR, AROUND, MIN_NOVELTY, LEVEL, DICTIONARY = 16, 40, 512, 0.7, 19, 1000
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_LENGTH},}}", re.A)
WORD = re.compile(r"(?<![A-Za-z0-9+/=-])[A-Za-z_]{4,32}(?![A-Za-z0-9+/=-])", re.A)


@lru_cache(4)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    history = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    history.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=history, write_content_size=False, write_checksum=False, write_dict_id=False)


def novelty(text: str, start: int, end: int, dictionary: bytes = IDENTIFIERS.encode()) -> float:
    """Marginal compressed bytes of text[start:end] by its length.

    Measured in the whole surroundings and in a quarter of them, and the larger taken:
    where zstandard begins to pack letters by their frequency, or changes its tables, bytes
    are saved that have nothing to do with the candidate.
    """
    size = lambda b: len(_compressor(dictionary).compress(b))
    own, out = text[start:end].encode("utf-8", "surrogatepass"), 0
    for n in (AROUND, AROUND // 4):
        head = (text[end : end + n] + text[max(0, start - n) : start]).encode("utf-8", "surrogatepass")
        out = max(out, size(head + own) - size(head))
    return out / len(own)


def named(text: str) -> bool:
    """Whether a sensitive name may stand in the text."""
    low = text.lower()
    return any(n in low for n in NAMES)


def identifiers(docs: DataFrame, text_col: str, most: int = DICTIONARY) -> bytes:
    """The dictionary: common names, then the words that surround sensitive names most often, the commonest last."""
    importable(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return got

        for b in batches:
            for t in b.column("text").to_pylist():
                done = 0
                for m in SENSITIVE.finditer(t) if named(t) else ():
                    first, last = max(done, m.start() - AROUND), m.end() + AROUND
                    if last > done:  # what two surroundings share counts once
                        for w in WORD.findall(t[first:last]):
                            held[w] = held.get(w, 0) + 1
                        done = last
                if len(held) > 100_000:
                    yield out()
        yield out()

    words = docs.select(text_of(text_col).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = words.orderBy(F.desc("n"), "word").limit(most).collect()  # most words of 32 characters at most
    return (IDENTIFIERS + " ".join(r["word"] for r in reversed(top))).encode()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns, kinds by their place in KINDS."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8] if named(text) else []
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def novel_spans(text: str, base: list[tuple[int, int, int]], dictionary: bytes = IDENTIFIERS.encode()) -> list[tuple[int, int, int]]:
    names = [m.end() for m in SENSITIVE.finditer(text)] if named(text) else []
    found = []
    for m in CANDIDATE.finditer(text) if names else ():
        a, b = m.span()
        k = bisect_right(names, a)
        if not k or names[k - 1] < a - NEAR:
            continue
        mixed = any(x.isdigit() for x in m[0]) and any(x.isalpha() for x in m[0])
        if not mixed:
            continue
        at = bisect_right(base, (a, 9, 0))
        near = base[max(0, at - 3) : at + 1]  # spans of one kind don't overlap: at most one of each kind begins before a and ends after it
        if not any(x < b and a < y for x, _, y in near) and novelty(text, a, b, dictionary) >= MIN_NOVELTY:
            found.append((a, 3, b))
    return found


def secret_scan(docs: DataFrame, text_col: str = "text", dictionary: bytes | None = None) -> DataFrame:
    """docs' columns but the text's, and spans: array<struct<start, kind, end>> ordered by start, then kind as in KINDS, in the place of a column of that name."""
    dictionary = identifiers(docs, text_col) if dictionary is None else dictionary
    keep = [c for c in docs.columns if c not in (text_col, "spans")]
    named = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, named, strict=True)], text_of(text_col).alias("text"))
    span = pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for t in b.column("text").to_pylist():
                base = base_spans(t)
                out.append([{"start": s, "kind": KINDS[k], "end": e} for s, k, e in sorted(base + novel_spans(t, base, dictionary))])
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in named), pa.array(out, pa.list_(span))], [*named, "spans"])

    schema = "".join(f"{n} {rows.schema[n].dataType.simpleString()}, " for n in named)
    return rows.mapInArrow(run, f"{schema}spans array<struct<start: bigint, kind: string, end: bigint>>").toDF(*keep, "spans")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", dictionary: bytes | None = None) -> DataFrame:
    """docs with every span of a secret replaced by mark; overlapping spans as one. Texts without secrets, null ones too, stay as they are."""
    dictionary = identifiers(docs, text_col) if dictionary is None else dictionary
    schema = docs.schema
    at = docs.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        base = base_spans(text)
        spans = sorted((s, e) for s, _, e in base + novel_spans(text, base, dictionary))
        out, done = [], 0
        for s, e in spans:
            if s >= done:
                out += [text[done:s], mark]
            done = max(done, e)
        return "".join([*out, text[done:]]) if spans else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            arrays = b.columns
            arrays[at] = pa.array([clean(t) for t in arrays[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(arrays, b.schema.names)

    named = [f"c{i}" for i in range(len(docs.columns))]
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(named, schema.fields, strict=True))
    return docs.toDF(*named).mapInArrow(run, kinds).toDF(*docs.columns)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"] != "novel")
    return s.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(F.encode(text(base), "UTF-8"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
