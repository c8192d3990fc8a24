"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

An encoding is right exactly if each two neighbouring tokens encode to themselves when
joined, so the last token of each prefix of a piece is fixed by the token before it. The
nondeterministic machine holds, for every place where an unfinished token may begin, the
node of the vocabulary's trie it has reached and the token before that place. A state of
the determinised machine is the tuple of these items, each with its tokens not yet
emitted; tokens that all items share are emitted, which happens after a bounded number of
bytes. Transitions are made when met often and kept in a table of bounded size; where one is
missing, the nondeterministic machine takes the piece to its end, depth first, so that rare
pieces don't fill the table.

Decoding maps ids to bytes and follows UTF-8 with a state machine that keeps an unfinished
character between calls. The machine's steps are tabled for whole tokens too, so that a
list of ids is followed token by token; where a fault is met it goes on byte by byte.

Null and empty texts give no ids. Rows are encoded one by one.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import importable, slices, table
from .packing import vocabulary_path
from .pretokens import PieceIds, batch_ids, packed, with_pieces

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Transitions kept by a worker; beyond them the table starts anew.
TABLE = 150_000
#: How often a transition is met before it is kept: making one costs more than walking some pieces to their end.
OFTEN = 8
#: Pieces whose ids a worker keeps, beside the table.
MEMO = 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The definition: join the neighbours of the lowest rank, leftmost first, until none can be joined."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    def __init__(self, ranks: dict[bytes, int], most: int = TABLE):
        self.ranks, self.most = ranks, most
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.edges: dict[int, int] = {}  # node << 8 | byte: node
        self.token_at: list[int] = [-1]
        for b, r in ranks.items():
            node = 0
            for x in b:
                key = node << 8 | x
                node = self.edges.get(key, 0)
                if not node:
                    node = self.edges[key] = len(self.token_at)
                    self.token_at.append(-1)
            self.token_at[node] = r
        self.parts: dict[bytes, tuple[bytes, bytes]] = {}
        self.edge_of: dict[int, list[tuple[bytes, int]]] = {}
        self.reset()

    def reset(self) -> None:
        start = ((0, -1, ()),)  # node, token before, tokens not emitted
        self.states, self.number = [start], {start: 0}
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.met: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}

    def split(self, token: bytes) -> tuple[bytes, bytes]:
        """The two parts that the last merge of a token joins."""
        got = self.parts.get(token)
        if got is None:
            whole = self.ranks[token]
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                rank, i = min((r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1], whole)) < whole)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            got = self.parts[token] = (parts[0], parts[1])
        return got

    def edge(self, token: int, right: bool) -> list[tuple[bytes, int]]:
        """The parts that stand at one end of a token while it is made, each with the rank at which it is joined further."""
        key = token << 1 | right
        got = self.edge_of.get(key)
        if got is None:
            part, limit, got = self.bytes_of[token], 1 << 60, []
            while True:
                got.append((part, limit))
                if len(part) == 1:
                    break
                limit = self.ranks[part]
                part = self.split(part)[1 if right else 0]
            self.edge_of[key] = got
        return got

    def follows(self, before: int, token: int) -> bool:
        """Whether the two stay as they are when joined: no merge across their border comes before its parts are joined elsewhere."""
        if before < 0:
            return True
        key = before << 24 | token
        got = self.pairs.get(key)
        if got is None:
            got = self.pairs[key] = self._apart(before, token)
        return got

    def _apart(self, before: int, token: int) -> bool:
        rank_of = self.ranks.get
        rights = self.edge(token, False)
        for left, left_limit in self.edge(before, True):
            for right, right_limit in rights:
                rank = rank_of(left + right)
                # Of equal ranks the leftmost goes first.
                if rank is not None and rank < left_limit and rank <= right_limit:
                    return False
        return True

    def step(self, state: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        """The next state and what is emitted on the way to it."""
        items, last = [], None
        edges, token_at = self.edges, self.token_at
        for node, before, chain in state:
            to = edges.get(node << 8 | byte)
            if to is None:
                continue
            items.append((to, before, chain))
            if last is None:
                token = token_at[to]
                if token >= 0 and self.follows(before, token):
                    last = (0, token, (*chain, token))
        if last is None:
            raise ValueError("a byte is missing from the vocabulary")
        items.append(last)
        first = items[0][2]
        shared = 0
        while shared < len(first) and all(len(c) > shared and c[shared] == first[shared] for _, _, c in items):
            shared += 1
        if not shared:
            return tuple(items), ()
        return tuple((n, b, c[shared:]) for n, b, c in items), first[:shared]

    def finish(self, before: int, rest: bytes) -> list[int]:
        """The tokens of what is left of a piece after a token (-1: none), by the nondeterministic machine: nothing is kept for later.

        It is walked depth first, the longest token first. As a prefix has one encoding, a place
        from which the walk has come back is no border of tokens, and is not entered again.
        """
        edge, token_at, pairs, n = self.edges.get, self.token_at, self.pairs, len(rest)
        ids: list[int] = []
        path: list[tuple[int, int, list[tuple[int, int]]]] = []
        at, closed, left = 0, set(), None
        while at < n:
            if left is None:  # the tokens that begin here, each with its end
                left, node = [], 0
                for end in range(at, n):
                    node = edge(node << 8 | rest[end])
                    if node is None:
                        break
                    token = token_at[node]
                    if token >= 0:
                        left.append((end + 1, token))
            while left:
                end, token = left.pop()
                if end in closed:
                    continue
                ok = before < 0 or pairs.get(before << 24 | token)
                if ok or ok is None and self.follows(before, token):
                    path.append((at, before, left))
                    ids.append(token)
                    at, before, left = end, token, None
                    break
            else:
                if not path:
                    raise ValueError("a byte is missing from the vocabulary")
                closed.add(at)
                at, before, left = path.pop()
                ids.pop()
        return ids

    def encode(self, piece: bytes) -> list[int]:
        if len(self.steps) > self.most or len(self.met) > 4 * self.most:
            self.reset()
        if len(self.pairs) > 2 * self.most:
            self.pairs.clear()
        steps, states = self.steps, self.states
        state, ids = 0, []
        for i, x in enumerate(piece):
            key = state << 8 | x
            got = steps.get(key)
            if got is None:
                times = self.met[key] = self.met.get(key, 0) + 1
                if times < OFTEN:  # a transition enters the table when it is met often
                    return ids + self.finish(ids[-1] if ids else -1, piece[sum(len(self.bytes_of[t]) for t in ids) :])
                to, out = self.step(states[state], x)
                number = self.number.get(to)
                if number is None:
                    number = self.number[to] = len(states)
                    states.append(to)
                got = steps[key] = (number, out)
            state, out = got
            if out:
                ids += out
        return ids + list(states[state][-1][2])  # what the item that ends here has not emitted


#: States of UTF-8 (fixed values of the encoding): 0 between characters; 1 to 3 so many bytes to come;
#: 4 to 7 after E0, ED, F0 and F4, where the next byte is narrowed; BAD for a byte that can't follow.
BAD = 8
_NEXT = {4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2), 1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2)}
_LEADS = ((0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7))


def _utf8_steps() -> np.ndarray:
    steps = np.full((BAD + 1, 256), BAD, np.uint8)
    for low, high, to in _LEADS:
        steps[0, low : high + 1] = to
    for state, (low, high, to) in _NEXT.items():
        steps[state, low : high + 1] = to
    return steps


UTF8 = _utf8_steps()


class Utf8Decoder:
    """Streaming decoding, byte by byte: feed() returns the text of what is complete, a faulty sequence as U+FFFD."""

    STEPS = [row.tolist() for row in UTF8]

    def __init__(self) -> None:
        self.state, self.held = 0, b""

    def feed(self, data: bytes, final: bool = False) -> str:
        data = self.held + data
        state, at, begin, good, out = self.state, len(self.held), 0, 0, []
        while at < len(data):
            to = self.STEPS[state][data[at]]
            if to == BAD:
                out += [data[begin:good].decode(), "\ufffd"]
                at += not state  # a byte that can't begin a character is one fault; else it is looked at again
                begin = good = at
                state = 0
                continue
            at += 1
            state = to
            if not to:
                good = at
        out.append(data[begin:good].decode())
        self.state, self.held = state, data[good:]
        if final and self.held:
            self.state, self.held = 0, b""
            out.append("\ufffd")
        return "".join(out)


class TokenDecoder:
    """The bytes of tokens, and the UTF-8 machine's steps by whole tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        n = max(ranks.values()) + 1
        of = [b""] * n
        for b, r in ranks.items():
            of[r] = b
        self.data = np.frombuffer(b"".join(of), np.uint8)
        self.lens = np.fromiter(map(len, of), np.int64, n)
        self.starts = np.cumsum(self.lens) - self.lens
        self.after = np.repeat(np.arange(BAD + 1, dtype=np.uint8)[:, None], n, axis=1)
        for k in range(int(self.lens.max())):
            longer = np.flatnonzero(self.lens > k)
            self.after[:, longer] = UTF8[self.after[:, longer], self.data[self.starts[longer] + k]]

    def bytes_of(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes, and where those of each list begin and end."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lens) or not self.lens[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        each = self.lens[ids]
        ends = np.cumsum(each)
        take = np.repeat(self.starts[ids] - (ends - each), each)
        take += np.arange(len(take))
        return self.data[take], np.concatenate([[0], ends])[bounds]

    def faulty(self, ids: np.ndarray, bounds: np.ndarray) -> set[int]:
        """The lists that the machine does not leave between characters."""
        odd = np.flatnonzero(self.after[0][ids])  # where a token does not lead from between characters to there
        out, done = set(), 0
        for i, doc in zip(odd.tolist(), (np.searchsorted(bounds, odd, "right") - 1).tolist(), strict=True):
            if i < done:
                continue
            state, done, end = 0, i, int(bounds[doc + 1])
            while done < end:
                state = self.after[state, ids[done]]
                done += 1
                if state == BAD:
                    done = end
                elif not state:
                    break
            if state:
                out.add(doc)
        return out


_HELD: dict[str, Transducer] = {}
_DECODERS: dict[str, TokenDecoder] = {}


def transducer(path: str) -> Transducer:
    if path not in _HELD:
        _HELD[path] = Transducer(load_ranks(path))
    return _HELD[path]


def token_decoder(path: str) -> TokenDecoder:
    if path not in _DECODERS:
        _DECODERS[path] = TokenDecoder(load_ranks(path))
    return _DECODERS[path]


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """docs' columns but the text's, and ids: array<int>, in the place of a column of that name."""
    path = path or vocabulary_path(VOCABULARY)
    importable(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (text_col, "ids")]
    named = [f"c{i}" for i in range(len(keep))]
    cut = with_pieces(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, named, strict=True)], F.col(text_col).alias("text")), "text").select(*named, "__pieces", "__whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import regex

        t = transducer(path)
        split = regex.compile(public_tokenizers.PATTERN)
        each = t.encode
        ids = PieceIds(lambda pieces: [packed(each(p.encode())) for p in pieces], lambda text: packed([x for p in split.findall(text) for x in each(p.encode())]), MEMO)
        for b in slices(batches):
            gc.disable()  # nothing made here is in a cycle, and the tables are long to look through
            try:
                tokens, bounds = batch_ids(b.column("__pieces"), b.column("__whole"), ids)
            finally:
                gc.enable()
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(tokens, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in named), lists], [*named, "ids"])

    schema = "".join(f"{n} {cut.schema[n].dataType.simpleString()}, " for n in named)
    return cut.mapInArrow(run, f"{schema}ids array<int>").toDF(*keep, "ids")


def decode(docs: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """docs' columns and decoded_text, in the place of a column of that name: the text of the ids' bytes, a faulty sequence as U+FFFD.

    A null list gives null, a null id or one that is not in the vocabulary an error.
    """
    path = path or vocabulary_path(VOCABULARY)
    importable(docs.sparkSession)
    docs = docs.drop("decoded_text")
    keep = docs.columns
    named = [f"c{i}" for i in range(len(keep))]
    at = named[keep.index(ids_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = token_decoder(path)
        for b in slices(batches):
            lists = b.column(at)
            flat = lists.flatten()
            if flat.null_count:
                raise ValueError("an id is null")
            ids = np.asarray(flat)
            bounds = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64))])
            data, ends = decoder.bytes_of(ids, bounds)
            faulty = decoder.faulty(ids, bounds)
            if faulty or lists.null_count:
                null = set(np.flatnonzero(np.asarray(lists.is_null())).tolist())
                part = lambda i: data[ends[i] : ends[i + 1]].tobytes()
                texts = pa.array([None if i in null else Utf8Decoder().feed(part(i), True) if i in faulty else part(i).decode() for i in range(b.num_rows)], pa.string())
            else:
                texts = pa.Array.from_buffers(pa.string(), b.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in named), texts], [*named, "decoded_text"])

    renamed = docs.toDF(*named)
    schema = "".join(f"{n} {renamed.schema[n].dataType.simpleString()}, " for n in named)
    return renamed.mapInArrow(run, f"{schema}decoded_text string").toDF(*keep, "decoded_text")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    joined = F.encode(F.array_join("ids", " "), "UTF-8")
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2(F.encode("decoded_text", "UTF-8"), 256).alias("decoded_sha256"))
