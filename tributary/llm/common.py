"""Shared pieces of the training-data operators: tables, scratch tables, Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch that Spark hands to Python at once, so that long texts stay within memory.
BATCH_ROWS = 1000
_own: dict = {}
_kept: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all machines share (spark.checkpoint.dir). Where it is unset, a local session gets a folder of its
    own; on a cluster that is an error, as machines would not see each other's files."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if not shared and "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="tributary-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return shared or _own["dir"]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; Hadoop removes it when the application ends."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stashed = path
    return out


def free(*stashed: DataFrame) -> None:
    """Remove tables of `stash` that no later step reads."""
    for df in stashed:
        spark = df.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stashed)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def kept(owner: str) -> dict:
    """What this worker keeps from one task to the next for a module's functions."""
    return _kept.setdefault(owner, {})


def release(owner: str) -> None:
    """Give back what the worker has kept for modules other than owner: Spark runs other stages in the same workers."""
    others = [k for k in _kept if k != owner]
    if others:
        for k in others:
            del _kept[k]
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def map_arrow(df: DataFrame, function, schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """mapInArrow with batches of `rows` at most."""
    owner = function.__module__

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(owner)

        def cut():
            for b in batches:
                for at in range(0, b.num_rows, rows):
                    yield b.slice(at, rows)

        yield from function(cut())

    return df.mapInArrow(small, schema)


def documents(df: DataFrame) -> DataFrame:
    """doc_id and text only, whatever other columns there are."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
