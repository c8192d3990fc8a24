"""Tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one on a single machine, an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="marlstone-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder of its own in the shared one; it goes when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    fs, where = _files(spark, path)
    fs.deleteOnExit(where)
    return path


def stage(df: DataFrame, name: str, by: tuple[str, ...] = (), **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage, survives lost executors. by: columns that folders are made of."""
    path = new_folder(df.sparkSession, name)
    df.write.options(**{"compression": "zstd"} | options).partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def unstage(df: DataFrame) -> None:
    """Remove a staged table that nothing reads any more; other frames are left alone."""
    path = _PATHS.pop(df, None)
    if path:
        fs, where = _files(df.sparkSession, path)
        fs.delete(where, True)


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it; on a cluster it is installed on all machines."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
