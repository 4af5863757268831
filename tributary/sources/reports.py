"""Reading report files, numbering them, and telling their formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.plans.scratch import stash

HEAD_BYTES = 4096
#: Numbers of so many files are broadcast (some 200 bytes each), so that no content is shuffled; those of more are joined.
BROADCAST_FILES = 200_000
# File names and first bytes of each format.
NAME_PREFIXES = {"DEP5_": "dep5", "ReadMe_OSS_": "readmeoss", "SPDX3JSON_": "spdx3json", "CYCLONEDX_JSON_": "cyclonedx", "CLIXML_": "clixml"}
DEBIAN_HEAD = "Format: https://www.debian.org/doc/packaging-manuals/copyright-format/"


def _empty_files(files: DataFrame) -> list[str]:
    """Paths of empty files, which Spark lists but makes no rows of; names are looked at only where there are such."""
    listed = files.inputFiles()
    if len(listed) == files.select("path").count():
        return []
    jvm, seen = files.sparkSession.sparkContext._jvm, {r["path"] for r in files.select("path").collect()}
    names = {jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(x)).toString() for x in listed}
    return sorted(names - seen)


def small(table: DataFrame) -> DataFrame:
    """A table of a row a file or split, marked for a broadcast if it has at most BROADCAST_FILES rows, so that lines that
    are joined with it stay where they are; Spark decides about a larger one."""
    return F.broadcast(table) if table.count() <= BROADCAST_FILES else table


def read_reports(spark: SparkSession, *globs: str, set_id: str | None = None) -> DataFrame:
    """raw(set_id, input_index, source_id, path, content): all files of the globs, numbered by path within a set (their
    folder's name unless set_id is given). No glob, or one that matches nothing, is an error. A content is read by the
    tasks that use it."""
    if not globs:
        raise ValueError("no inputs")
    raw = spark.read.format("binaryFile").load(list(globs))
    empty = _empty_files(raw)
    raw = raw.select("path", "content")
    if empty:
        raw = raw.unionByName(spark.createDataFrame([(p, bytearray()) for p in empty], "path string, content binary"))
    folder = F.lit(set_id) if set_id else F.regexp_extract("path", "([^/]*)/[^/]*$", 1)
    raw = raw.withColumn("set_id", folder).withColumn("source_id", F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"(?<=.)\.[^.]*$", ""))
    # Only names are listed and ordered; contents get their numbers back by path.
    index = (F.row_number().over(Window.partitionBy("set_id").orderBy("path")) - 1).alias("input_index")
    numbers = raw.select("set_id", "path").select("path", index)
    if raw.select("path").count() <= BROADCAST_FILES:
        numbers = F.broadcast(numbers)
    return raw.join(numbers, "path").select("set_id", "input_index", "source_id", "path", "content")


def report_inputs(spark: SparkSession, *globs: str, set_id: str | None = None) -> DataFrame:
    """(path, set_id, source_id, input_index) of all files of the globs, numbered as in read_reports; only names are read."""
    if not globs:
        raise ValueError("no inputs")
    binary = spark.read.format("binaryFile").load(list(globs))
    files = binary.select(F.col("_metadata.file_path").alias("path"))
    if empty := _empty_files(binary):
        files = files.unionByName(spark.createDataFrame([(p,) for p in empty], "path string"))
    folder = F.lit(set_id) if set_id else F.regexp_extract("path", "([^/]*)/[^/]*$", 1)
    files = files.withColumn("set_id", folder).withColumn("source_id", F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"(?<=.)\.[^.]*$", ""))
    return files.withColumn("input_index", F.row_number().over(Window.partitionBy("set_id").orderBy("path")) - 1)


def report_lines(spark: SparkSession, *globs: str, set_id: str | None = None) -> DataFrame:
    """lines(set_id, input_index, source_id, path, split, line_no, line, valid) of all files of the globs, numbered as in
    read_reports. Spark reads a large file in splits of spark.sql.files.maxPartitionBytes, a task each, and cuts them at
    line ends; split is a split's first byte. A line's number is its place in its split after the lines of the splits
    before, from a table of one row a split. What is not UTF-8 becomes U+FFFD, and valid is false; lines end with LF, CR
    or both."""
    files = report_inputs(spark, *globs, set_id=set_id)
    read = spark.read.text(list(globs))
    at = F.monotonically_increasing_id().alias("at")  # grows within a split, as a split is read in one go
    rows = stash(read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), at, F.is_valid_utf8("value").alias("valid"), F.make_valid_utf8("value").alias("line")), "report-lines")
    return numbered_lines(rows, ["path"], files)


def numbered_lines(rows: DataFrame, keys: list[str], files: DataFrame | None = None) -> DataFrame:
    """rows(keys, split, at, valid, line), of a written table, with line_no by split and at; columns of files by path."""
    splits = rows.groupBy(*keys, "split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select(*keys, "split", "first", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = rows.join(small(splits if files is None else splits.join(files, "path")), [*keys, "split"])
    return numbered.select("set_id", "input_index", "source_id", "path", "split", (F.col("before") + F.col("at") - F.col("first")).alias("line_no"), "line", "valid")


def with_format(raw: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """raw with format by file name, then first bytes, then extension; null if none fits."""
    name, suffix = F.regexp_extract(path, "([^/]*)$", 1), F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    head = F.make_valid_utf8(F.substring(content, 1, HEAD_BYTES).cast("string"))
    bare = F.ltrim(head, F.lit(" \t\r\n"))
    by_name = [F.when(name.startswith(p), f) for p, f in NAME_PREFIXES.items()]
    found = F.coalesce(
        *by_name, F.when(head.startswith(DEBIAN_HEAD), "dep5"), F.when(bare.startswith("=" * 20), "readmeoss"),
        F.when(suffix == ".json", F.when(bare.startswith("["), "spdx3json").when(head.contains('"bomFormat"') | head.contains('"specVersion"'), "cyclonedx")),
        F.when((suffix == ".xml") & head.contains("<ComponentLicenseInformation"), "clixml"), F.when(suffix == ".spdx", "spdx2tv"),
    )
    return raw.withColumn("format", found)


def set_formats(raw: DataFrame) -> DataFrame:
    """Per set its format: null if an input has none or inputs differ."""
    agg = raw.groupBy("set_id").agg(F.count_if(F.col("format").isNull()).alias("_none"), F.min("format").alias("_lo"), F.max("format").alias("_hi"))
    return agg.select("set_id", F.when((F.col("_none") == 0) & (F.col("_lo") == F.col("_hi")), F.col("_lo")).alias("format"))


def format_mismatches(raw: DataFrame, expected: str) -> DataFrame:
    """Inputs of another format than expected; an unknown format is no mismatch."""
    return raw.filter(F.col("format").isNotNull() & (F.col("format") != expected))


def texts(raw: DataFrame) -> DataFrame:
    """raw with text in place of content; bytes that are not UTF-8 become U+FFFD (see checks.invalid_utf8)."""
    return raw.withColumn("text", F.make_valid_utf8(F.col("content").cast("string"))).drop("content")
