"""Folders for tables that a plan writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all machines share; Hadoop removes it when the application ends.
    Where that is unset, a local session gets a folder of its own; on a cluster that is an error, as machines would not
    see each other's files."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        shared = _own.setdefault("dir", tempfile.mkdtemp(prefix="tributary-"))
    path = f"{shared}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """df written to a new folder and read back: later steps read it instead of computing it again."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
