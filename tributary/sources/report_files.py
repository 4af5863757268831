"""Merged reports as files in order, for reports that are larger than a row, and reading them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.plans.scratch import stash
from tributary.sources.reports import numbered_lines, small

_NONE = "__HIVE_DEFAULT_PARTITION__"  # what Spark calls the folder of a null and of an empty text
_FILES = "path string, modificationTime timestamp, length long, content binary, set_id string"


def write_reports(pieces: DataFrame, path: str) -> DataFrame:
    """Write pieces of formats.(...)_pieces as text files, a folder per set below path, and return the manifest
    (set_id string, file_no, file, length): a set's files one behind the other are its report, as one text.

    Pieces are cut in ranges of set and place, so a large set is written by many tasks, each of which sorts its own range
    (on disk, if need be), and small sets share a task. Nothing but a piece has to fit a row. The column of folders can't
    be null, else Spark would sort anew by it alone. Ranges come from a sample of keys, which reads pieces one more time."""
    rows = pieces.withColumn("set_id", F.coalesce(F.nullif(F.col("set_id").cast("string"), F.lit("")), F.lit(_NONE))).filter("size(lines) > 0")
    order = ["set_id", "part", "ord", "tie"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.select("set_id", F.array_join("lines", "\n").alias("value")).write.mode("overwrite").partitionBy("set_id").text(path)
    return manifest(pieces.sparkSession, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(set_id, file_no, file, length) of what write_reports wrote: file is a name below path. Files are listed, not read,
    and ordered by their task's number, then by their number in the task."""
    files = spark.read.schema(_FILES).format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    name = F.regexp_extract("path", "([^/]*/[^/]*)$", 1)
    task, nth = (F.regexp_extract("path", p, 1).cast("long") for p in (r"/part-(\d+)-[^/]*$", r"[.-]c(\d+)\.txt$"))
    no = F.row_number().over(Window.partitionBy("set_id").orderBy(task, nth)) - 1
    return files.select("set_id", no.alias("file_no"), name.alias("file"), "length")


def written_lines(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """Lines of the reports of a manifest as reports.report_lines gives them: a set's files are one input, 0, whose splits
    are those of all its files. A line's number goes on from file to file, and a report may be parsed by many tasks."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path)
    at = F.monotonically_increasing_id().alias("at")
    name = F.regexp_extract(F.col("_metadata.file_path"), "([^/]*/[^/]*)$", 1)
    rows = read.select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("file"), F.col("_metadata.file_block_start").alias("at_byte"), at, F.is_valid_utf8("value").alias("valid"), F.make_valid_utf8("value").alias("line"))
    before = F.sum("length").over(Window.partitionBy("set_id").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1))
    inputs = files.select("set_id", F.lit(0).alias("input_index"), F.col("set_id").alias("source_id"), F.col("set_id").alias("path"), F.col("file").alias("file"), F.coalesce(before, F.lit(0)).alias("first_byte"))
    rows = stash(rows.join(small(inputs), "file").withColumn("split", F.col("first_byte") + F.col("at_byte")).drop("file", "first_byte", "at_byte"), "written-lines")
    keys = ["set_id", "input_index", "source_id", "path"]
    return numbered_lines(rows, keys)
