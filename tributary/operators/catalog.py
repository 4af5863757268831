"""The catalogue of merged sets, and searches in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.operators import text_index


def catalog(sets: DataFrame, inputs: DataFrame, conflicts: DataFrame, edits: DataFrame, key: str = "set_id") -> DataFrame:
    """sets with their inputs (array, in order) and the numbers of inputs, conflicts and edits."""
    n = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    own = inputs.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("input_index", "source_id"))), lambda x: x["source_id"]).alias("inputs"))
    out = sets.join(own, key, "left").join(n(conflicts, "n_conflicts"), key, "left").join(n(edits, "n_edits"), key, "left")
    return out.withColumn("n_inputs", F.coalesce(F.size("inputs"), F.lit(0)).cast("long")).na.fill(0, ["n_conflicts", "n_edits"])


def write_catalog(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).parquet(path)


def list_catalog(rows: DataFrame, key: str = "set_id") -> DataFrame:
    """Newest first."""
    return rows.orderBy(F.desc("created_at"), key)


def set_conflicts(conflicts: DataFrame, set_id, key: str = "set_id") -> DataFrame:
    return conflicts.filter(F.col(key) == F.lit(set_id))


def _catalog_text(key: str) -> Column:
    return F.concat_ws("\n", F.col(key).cast("string"), "format", "output_filename", F.col("created_at").cast("string"), F.array_join("inputs", "\n"))


def _chosen(rows: DataFrame, format: str | None, status: str) -> DataFrame:
    rule = {"all": "true", "conflicts": "n_conflicts > 0", "edits": "n_edits > 0", "either": "n_conflicts > 0 or n_edits > 0"}[status]
    return (rows.filter(F.col("format") == format) if format else rows).filter(rule)


def search_catalog(rows: DataFrame, term: str = "", format: str | None = None, status: str = "all", key: str = "set_id") -> DataFrame:
    """Sets whose id, format, file name, date or inputs hold term, in any case. status: all, conflicts, edits or either."""
    return _chosen(rows.filter(F.lower(_catalog_text(key)).contains(F.lower(F.lit(term)))), format, status)


def index_catalog(rows: DataFrame, path: str, key: str = "set_id", **sizes: int) -> text_index.TextIndex:
    return text_index.build(rows, _catalog_text(key), path, **sizes)


def search_indexed_catalog(index: text_index.TextIndex, term: str = "", format: str | None = None, status: str = "all") -> DataFrame:
    """search_catalog of an index_catalog."""
    return _chosen(index.search(term), format, status)


def _edit_text() -> Column:
    return F.concat_ws("\n", "who", F.col("when").cast("string"), "reason", "summary", "op", "path", "value")


def search_edits(edits: DataFrame, term: str) -> DataFrame:
    """Edits of which any column holds term, in any case."""
    return edits.filter(F.lower(_edit_text()).contains(F.lower(F.lit(term))))


def index_edits(edits: DataFrame, path: str, **sizes: int) -> text_index.TextIndex:
    """An index whose search is search_edits."""
    return text_index.build(edits, _edit_text(), path, **sizes)


def format_facets(rows: DataFrame) -> DataFrame:
    return rows.select("format").distinct()
