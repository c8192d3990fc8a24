"""python -m marlstone export | import | inspect: the tasks of api.py from a command line."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import api
from .sources import register
from .staging import importable


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="marlstone", description="Chunk files of a ledger range: make, replay and show them.")
    task = p.add_subparsers(dest="task", required=True)
    e = task.add_parser("export", help="make a chunk from stores and an index")
    e.add_argument("--store", action="append", required=True, help=".dat file or folder; the first store's copy of a node counts")
    e.add_argument("--index", required=True, help="SQLite index of ledgers")
    e.add_argument("--start", type=int, required=True)
    e.add_argument("--end", type=int, required=True)
    e.add_argument("--out", required=True, help="folder of the chunk file")
    e.add_argument("--network-id", type=int, default=1)
    i = task.add_parser("import", help="check and replay a chunk")
    i.add_argument("chunk")
    i.add_argument("--store", help="folder to write the nodes to, as a store")
    i.add_argument("--no-check", action="store_true", help="check format, sequence and the checkpoint's root alone")
    s = task.add_parser("inspect", help="show a chunk, a ledger or a transaction")
    s.add_argument("chunk")
    s.add_argument("--ledger", type=int)
    s.add_argument("--tx", type=int)
    return p


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("marlstone").getOrCreate()
    importable(spark)
    register(spark)
    if a.task == "export":
        index = spark.read.format("ledgerdb").option("path", a.index).option("start", a.start).option("end", a.end).load()
        path, digest = api.export_chunk(api.open_stores(spark, a.store), index, a.start, a.end, a.out, a.network_id)
        print(path, digest.hex())
    elif a.task == "import":
        print(api.import_chunk(spark, a.chunk, a.store, not a.no_check).count(), "nodes")
    else:
        found = api.inspect(spark, a.chunk, a.ledger, a.tx)
        found.orderBy(found.columns[0]).show(1000, truncate=False)


if __name__ == "__main__":
    main()
