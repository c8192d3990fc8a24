"""Arrow batches between Spark and the files' readers and writers: no row is handed over by itself."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of a reader's batch.
ROWS = 2000


def batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches of a schema."""
    rows = iter(rows)
    while part := list(islice(rows, ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)


def _bytes_of(column: pa.Array) -> bytes:
    if column.null_count:
        raise ValueError("a record to be written is null")
    return b"".join(column.to_pylist())


def joined(rows: DataFrame) -> Iterator[bytes]:
    """The bytes of sorted rows of one binary column, in their order, joined by batch where they were sorted."""
    name = rows.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_bytes_of(b.column(0))], pa.binary())], [name])

    for row in rows.mapInArrow(run, f"{name} binary").toLocalIterator(prefetchPartitions=True):
        yield bytes(row[0])


def joined_by(rows: DataFrame) -> Iterator[tuple[int, bytes]]:
    """The same of rows (number, bytes of one width) sorted by the number: the bytes of each number; it comes again where a batch ends within it."""
    key, name = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            at, data = np.asarray(b.column(0)), _bytes_of(b.column(1))
            width = len(data) // b.num_rows
            first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
            ends = [*first[1:].tolist(), b.num_rows]
            own = [data[i * width : j * width] for i, j in zip(first.tolist(), ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at[first], pa.int64()), pa.array(own, pa.binary())], [key, name])

    for row in rows.mapInArrow(run, f"{key} bigint, {name} binary").toLocalIterator(prefetchPartitions=True):
        yield row[0], bytes(row[1])
