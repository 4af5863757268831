"""Provenance records: one JSON document per set, written beside its result and read back as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "aggregate_id string, format string, created_at string, inputs array<struct<input_index:int,source_id:string>>, field_provenance map<string,array<string>>, "
    "conflicts array<struct<path:string,values:array<struct<source:string,value:string>>,resolution:string,chosen:string>>, "
    "edits array<struct<seq:bigint,who:string,`when`:string,op:string,path:string,value:string,from_path:string,reason:string,summary:string>>"
)


def provenance_records(sets: DataFrame, inputs: DataFrame, provenance: DataFrame, conflicts: DataFrame, edits: DataFrame) -> DataFrame:
    """(set_id, json): sets(set_id, format, created_at) with all that belongs to them."""
    def gather(df: DataFrame, name: str, *columns: str) -> DataFrame:
        return df.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))

    fields = provenance.groupBy("set_id").agg(F.map_from_entries(F.collect_list(F.struct("path", "sources"))).alias("field_provenance"))
    rows = sets.join(gather(inputs, "inputs", "input_index", "source_id"), "set_id", "left").join(fields, "set_id", "left")
    rows = rows.join(gather(conflicts, "conflicts", "path", "values", "resolution", "chosen"), "set_id", "left")
    rows = rows.join(gather(edits, "edits", "seq", "who", F.col("when").cast("string").alias("when"), "op", "path", "value", "from_path", "reason", "summary"), "set_id", "left")
    time = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at")
    return rows.select("set_id", F.to_json(F.struct(F.col("set_id").alias("aggregate_id"), "format", time, "inputs", "field_provenance", "conflicts", "edits")).alias("json"))


def write_provenance(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    records.select(F.col("json").alias("value")).write.mode(mode).text(path)


def parse_provenance(records: DataFrame, json: str = "json") -> dict[str, DataFrame]:
    """Tables inputs, provenance, conflicts and edits of records; what is not such a record is left out."""
    doc = records.select(F.from_json(json, SCHEMA, {"mode": "PERMISSIVE"}).alias("d")).filter("d.aggregate_id is not null").select("d.*").withColumnRenamed("aggregate_id", "set_id")
    return {
        "inputs": doc.select("set_id", F.inline("inputs")), "provenance": doc.select("set_id", F.explode("field_provenance").alias("path", "sources")),
        "conflicts": doc.select("set_id", F.inline("conflicts")), "edits": doc.select("set_id", F.inline("edits")),
    }


def read_provenance(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return parse_provenance(spark.read.text(path).withColumnRenamed("value", "json"))
