"""File formats as Spark data sources."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..staging import importable


def register(spark: SparkSession) -> None:
    """Make ledgerchunk, hashstore and ledgerdb known to a session."""
    importable(spark)
    from .chunk import ChunkSource
    from .hashstore import StoreSource
    from .ledgerdb import IndexSource

    for source in (ChunkSource, StoreSource, IndexSource):
        spark.dataSource.register(source)
