"""Pre-tokens of byte-level BPE: texts are cut by Spark, pieces are looked up by distinct value in Arrow batches."""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: White space, the property of that name (fixed values).
_S = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: The public pattern of these vocabularies with the white space written out, as \s is ASCII in Java.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Entries of a worker's memory of pieces.
MEMO = 400_000


#: Pre-tokens that are looked up at once: what is made of a long text stays small.
STEP = 1_000_000


@cache
def special_strings(path: str) -> tuple[str, ...]:
    """The special strings of a .json file: only the library may cut texts with one of them."""
    with open(path, encoding="utf-8") as f:
        return tuple(x["content"] for x in json.load(f).get("added_tokens") or ())


def with_pieces(docs: DataFrame, text_col: str, special: tuple[str, ...] = ()) -> DataFrame:
    """docs and __pieces, the pre-tokens, or __whole, the text itself where only the library may cut it.

    That holds for texts with a special string, or with code points that Java's Unicode tables don't know.
    """
    text = text_of(text_col)
    odd: Column = text.rlike(r"\p{Cn}")
    for s in special:
        odd = odd | text.contains(s)
    return docs.withColumn("__whole", F.when(odd, text)).withColumn("__pieces", F.when(odd, F.array().cast("array<string>")).otherwise(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))))


def texts_of(column: pa.Array) -> list[str]:
    """A column without nulls as a list."""
    return column.to_numpy(zero_copy_only=False).tolist()


def packed(ids: list[int]) -> bytes:
    """Ids as 32-bit integers."""
    return array("i", ids).tobytes()


class PieceIds:
    """Ids of pieces, as packed; encode maps a list of new pieces to them, whole a text that isn't cut.

    What was used since the memory was last half full survives when it is full.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], whole: Callable[[str], bytes], most: int = MEMO):
        self.encode, self.whole, self.most = encode, whole, most // 2
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def of(self, pieces: list[str]) -> list[bytes]:
        if len(self.memo) > self.most:
            self.memo, self.old = {}, self.memo
        memo, old = self.memo, self.old
        new = []
        for p in pieces:
            if p not in memo:
                got = old.get(p)
                if got is None:
                    new.append(p)
                else:
                    memo[p] = got
        memo.update(zip(new, self.encode(new), strict=True))
        return [memo[p] for p in pieces]


def batch_ids(pieces: pa.ListArray, whole: pa.Array, ids: PieceIds) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch, document by document, and the offsets of the documents."""
    n = len(pieces)
    offsets = np.asarray(pieces.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    flat = pieces.flatten()
    parts, counts = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for start in range(0, len(flat), STEP):
        coded = flat.slice(start, STEP).dictionary_encode()
        lists = ids.of(texts_of(coded.dictionary))
        lens = np.fromiter(map(len, lists), np.int32, len(lists)) >> 2
        held = np.frombuffer(b"".join(lists), np.int32)
        at = np.asarray(coded.indices)
        each = lens[at]
        ends = np.cumsum(each)
        take = np.repeat(((np.cumsum(lens) - lens)[at] - (ends - each)).astype(np.int32), each)
        take += np.arange(len(take), dtype=np.int32)
        parts.append(held[take])
        counts.append(each)
    tokens, bounds = np.concatenate(parts), np.cumsum(np.concatenate(counts))[offsets]
    if whole.null_count < n:  # rare: put the library's ids of whole texts in their place
        odd = {i: np.frombuffer(ids.whole(t), np.int32) for i, t in enumerate(whole.to_pylist()) if t is not None}
        parts = [odd[i] if i in odd else tokens[bounds[i] : bounds[i + 1]] for i in range(n)]
        tokens, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return tokens, bounds


_HELD: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizers library's encoder of a .json file, one for each worker."""
    if path not in _HELD:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        held = Tokenizer.from_file(path)
        held.no_padding()
        held.no_truncation()
        _HELD[path] = held
    return _HELD[path]


#: A byte as the character that stands for it in a byte-level vocabulary: those that can be seen stand for themselves.
_SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = {b: chr(b) for b in _SEEN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_SEEN)))}
#: Pieces of code points below this one are cut alike by all Unicode tables.
STABLE = "\u0250"


def json_ids(path: str) -> PieceIds:
    """Pieces go to the library's model itself, where nothing else of it touches them; it is spared to cut a piece again."""
    t = tokenizer(path)
    each = lambda texts: [packed(e.ids) for e in t.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
    whole = lambda text: each([text])[0]
    cut, model = t.pre_tokenizer, t.model
    if type(cut).__name__ != "ByteLevel" or cut.add_prefix_space or t.normalizer is not None or t.post_processor is not None:
        return PieceIds(each, whole)

    def encode(pieces: list[str]) -> list[bytes]:
        out = [packed([x.id for x in model.tokenize(p.encode().decode("latin-1").translate(BYTES))]) if p.isascii() or max(p) < STABLE else None for p in pieces]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, each([pieces[i] for i in rest]), strict=True):
            out[i] = x
        return out

    return PieceIds(encode, whole)
