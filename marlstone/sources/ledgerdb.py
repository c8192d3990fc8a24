"""The ledger index, a table of an SQLite file: a range query instead of a lookup for each ledger.

spark.read.format("ledgerdb").option("path", file).option("start", ...).option("end", ...).
Paths must be readable where tasks run.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Table and columns of the index (fixed values).
QUERY = "SELECT LedgerSeq, LedgerHash, PrevHash, AccountSetHash, TransSetHash, TotalCoins, PrevClosingTime, ClosingTime, CloseTimeRes, CloseFlags FROM Ledgers WHERE LedgerSeq BETWEEN ? AND ? ORDER BY LedgerSeq"
STEP = 100_000


def hash_of(text: str) -> bytes:
    b = bytes.fromhex(text.strip())
    if len(b) != 32:
        raise ValueError(f"a hash has 32 bytes, not {len(b)}")
    return b


class _Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class IndexReader(DataSourceReader):
    def __init__(self, path: str, start: int | None, end: int | None):
        self.path, self.start, self.end = path, start, end

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        start, end = self.start, self.end
        if start is None or end is None:
            with self._open() as db:
                low, high = db.execute("SELECT min(LedgerSeq), max(LedgerSeq) FROM Ledgers").fetchone()
            start, end = (low if start is None else start), (high if end is None else end)
        if start is None:
            return [_Range(0, -1)]
        return [_Range(a, min(a + STEP - 1, end)) for a in range(start, end + 1, STEP)] or [_Range(0, -1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with self._open() as db:
            for seq, *hashes, coins, parent, close, resolution, flags in db.execute(QUERY, (partition.start, partition.end)):
                yield (seq, *map(hash_of, hashes), Decimal(coins), parent, close, resolution, flags)


class IndexSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ledgerdb"

    def schema(self) -> str:
        return "ledger_seq bigint, ledger_hash binary, parent_hash binary, account_hash binary, tx_root binary, drops decimal(20,0), parent_close_time bigint, close_time bigint, close_time_resolution smallint, close_flags smallint"

    def reader(self, schema) -> DataSourceReader:
        number = lambda k: int(self.options[k]) if k in self.options else None
        return IndexReader(self.options["path"].removeprefix("file://"), number("start"), number("end"))
