"""References between entries: namespacing, rewriting, redirecting, relationships and what hangs on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions import text as fx

INPUT = ["set_id", "input_index"]


def namespace(entries: DataFrame, columns: list[str]) -> DataFrame:
    """References that entries declare themselves, as their input's own: a projection, no join."""
    return entries.withColumns({c: fx.namespaced_ref(c, "input_index") for c in columns})


def declared_refs(entries: DataFrame, ref: str) -> DataFrame:
    """ref_map(set_id, input_index, old_ref, new_ref) of the references that entries declare: for columns whose target
    may not be declared."""
    return entries.filter(F.col(ref).isNotNull()).select(*INPUT, F.col(ref).alias("old_ref"), fx.namespaced_ref(ref, "input_index").alias("new_ref")).distinct()


def namespace_known(df: DataFrame, columns: list[str], embedded: list[str] = (), known: str = "_known") -> DataFrame:
    """References in columns, and reference tokens inside the texts or lists of texts of embedded, as their input's own
    where known, an array, has them: rewrite_refs and rewrite_embedded_refs for rows that bring what their input declares."""
    mapping = F.map_from_arrays(known, F.transform(known, lambda r: fx.namespaced_ref(r, "input_index")))
    out = df.withColumns({c: F.when(F.array_contains(known, F.col(c)), fx.namespaced_ref(c, "input_index")).otherwise(F.col(c)) for c in columns})
    lists = {c for c in embedded if df.schema[c].dataType.typeName() == "array"}
    new = {c: F.transform(c, lambda x: fx.rewrite_embedded(x, mapping)) if c in lists else fx.rewrite_embedded(c, mapping) for c in embedded}
    return out.withColumns({c: F.when(F.size(known) > 0, v).otherwise(F.col(c)) for c, v in new.items()}).drop(known)


def rewrite_refs(df: DataFrame, ref_map: DataFrame, columns: list[str], by: list[str] = INPUT) -> DataFrame:
    """Replace the references in columns by ref_map(by..., old_ref, new_ref); what it does not name stays."""
    for i, c in enumerate(columns):
        m = ref_map.select(*[F.col(k).alias(f"_k{i}{k}") for k in by], F.col("old_ref").alias(f"_o{i}"), F.col("new_ref").alias(f"_n{i}"))
        on = F.col(c) == F.col(f"_o{i}")
        for k in by:
            on = on & (F.col(k) == F.col(f"_k{i}{k}"))
        df = df.join(m, on, "left").withColumn(c, F.coalesce(f"_n{i}", c)).drop(*[f"_k{i}{k}" for k in by], f"_o{i}", f"_n{i}")
    return df


def rewrite_embedded_refs(df: DataFrame, ref_map: DataFrame, columns: str | list[str], row_key: list[str], by: list[str] = INPUT) -> DataFrame:
    """Replace reference tokens inside texts, or lists of texts. Tokens of all columns are exploded, joined with the map
    once and put back by place, so neither side has to be small; rows without tokens are not touched."""
    columns = [columns] if isinstance(columns, str) else columns
    lists = {c for c in columns if df.schema[c].dataType.typeName() == "array"}
    tokens_of = lambda c: F.flatten(F.transform(F.coalesce(c, F.array().cast("array<string>")), fx.embedded_refs)) if c in lists else F.coalesce(fx.embedded_refs(c), F.array().cast("array<string>"))
    key = list(dict.fromkeys([*row_key, *by]))
    tokens = df.select(*key, F.explode(F.array_distinct(F.concat(*[tokens_of(c) for c in columns]))).alias("old_ref"))
    moved = tokens.join(ref_map.select(*by, "old_ref", "new_ref"), [*by, "old_ref"]).groupBy(*row_key).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("old_ref", "new_ref")))).alias("_map"))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in row_key]
    out = df.join(moved.withColumnsRenamed({k: f"_k_{k}" for k in row_key}), on, "left").drop(*[f"_k_{k}" for k in row_key])
    for c in columns:
        new = F.transform(c, lambda x: fx.rewrite_embedded(x, "_map")) if c in lists else fx.rewrite_embedded(c, "_map")
        out = out.withColumn(c, F.when(F.col("_map").isNull(), F.col(c)).otherwise(new))
    return out.drop("_map")


#: A string of a JSON text with its quotes, and the colon behind it if it is a key.
_JSON_STRING = r'"(?:[^"\\]|\\.)*"(?:\s*:)?'


def rewrite_json_refs(nodes: DataFrame, ref_map: DataFrame, row_key: list[str], column: str = "json", by: list[str] = INPUT) -> DataFrame:
    """Replace references in the values of a JSON text: whole strings, fragments of IRIs, and tokens inside others.
    Keys and what the map does not name stay."""
    inner = lambda t: F.substring(t, F.lit(2), F.length(t) - 2)
    strings = F.filter(F.regexp_extract_all(column, F.lit(f"({_JSON_STRING})"), F.lit(1)), lambda t: ~t.endswith(":"))
    values = F.transform(strings, inner)
    found = F.concat(values, F.transform(F.filter(values, lambda v: v.contains("#")), lambda v: F.substring_index(v, "#", -1)), F.flatten(F.transform(values, fx.embedded_refs)))
    key = list(dict.fromkeys([*row_key, *by]))
    tokens = nodes.select(*key, F.explode(F.array_distinct(found)).alias("old_ref"))
    moved = tokens.join(ref_map.select(*by, "old_ref", "new_ref"), [*by, "old_ref"]).groupBy(*row_key).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("old_ref", "new_ref")))).alias("_map"))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in row_key]
    out = nodes.join(moved.withColumnsRenamed({k: f"_k_{k}" for k in row_key}), on, "left").drop(*[f"_k_{k}" for k in row_key])
    plain = lambda v: F.when(fx.rewrite_iri(v, "_map") != v, fx.rewrite_iri(v, "_map")).otherwise(fx.rewrite_embedded(v, "_map"))
    pieces = F.regexp_extract_all(column, F.lit(f"({_JSON_STRING})"), F.lit(1))
    new = F.transform(pieces, lambda t: F.when(t.endswith(":"), t).otherwise(F.concat(F.lit('"'), plain(inner(t)), F.lit('"'))))
    joined = F.array_join(F.zip_with(F.split(column, _JSON_STRING, -1), new, lambda b, t: F.concat(b, F.coalesce(t, F.lit("")))), "")
    return out.withColumn(column, F.when(F.col("_map").isNull(), F.col(column)).otherwise(joined)).drop("_map")


def redirect_to_survivors(df: DataFrame, aliases: DataFrame, columns: list[str], by: list[str] = ["set_id"]) -> DataFrame:  # noqa: B006
    """References to merged-away entries point at what they were merged into."""
    return rewrite_refs(df, aliases.select(*by, F.col("loser_ref").alias("old_ref"), F.col("winner_ref").alias("new_ref")), columns, by)


def attach_relationships(entries: DataFrame, relationships: DataFrame, ref: str) -> DataFrame:
    """A row for each entry and relationship (src, type, dst) that names it at either end; a self-edge once. Two
    equi-joins instead of one join on either end, which could only be a nested loop."""
    ends = [relationships.withColumn("_end", F.col(c)) for c in ("src", "dst")]
    keys = [k for k in INPUT if k in entries.columns and k in relationships.columns]
    rows = [entries.join(e.withColumnRenamed("_end", ref), [*keys, ref]) for e in ends]
    return rows[0].unionByName(rows[1].filter("src <> dst"))


def merged_relationships(relationships: DataFrame, packages: DataFrame, ref: str, document: str = "SPDXRef-DOCUMENT") -> DataFrame:
    """Distinct (set_id, src, type, dst); DESCRIBES is made anew, from the document to each package."""
    kept = relationships.filter("type <> 'DESCRIBES'").select("set_id", "src", "type", "dst")
    new = packages.select("set_id", F.lit(document).alias("src"), F.lit("DESCRIBES").alias("type"), F.col(ref).alias("dst"))
    return kept.unionByName(new).distinct()


def verification_codes(contains: DataFrame, files: DataFrame, package: str, file: str, digest: str) -> DataFrame:
    """Per package: SHA-1 of the sorted digests of the files that it contains; repeated edges count once."""
    rows = contains.select(package, file).distinct().join(files.select(file, digest), file)
    joined = F.array_join(F.array_sort(F.collect_list(digest)), "")
    return rows.groupBy(package).agg(F.count(F.lit(1)).alias("n_files"), F.sha1(joined).alias("verification_code"))


def expression_refs(entries: DataFrame, columns: list[str], ref: str) -> DataFrame:
    """(set_id, ref): distinct references inside licence expressions, which are texts or lists of texts."""
    text = [F.array_join(c, " ") if entries.schema[c].dataType.typeName() == "array" else F.coalesce(c, F.lit("")) for c in columns]
    return entries.select("set_id", F.explode(fx.embedded_refs(F.concat_ws(" ", *text))).alias(ref)).distinct()


def dangling_refs(relationships: DataFrame, ids: DataFrame, ref: str, expressions: DataFrame | None = None) -> DataFrame:
    """Ends of relationships, and references of expressions(set_id, ref), that no entry declares."""
    ends = relationships.select("set_id", F.explode(F.array("src", "dst")).alias(ref)).distinct()
    ends = ends if expressions is None else ends.unionByName(expressions.select("set_id", ref)).distinct()
    return ends.join(ids.select("set_id", ref).distinct(), ["set_id", ref], "left_anti")


def attach_satellites(nodes: DataFrame, satellites: DataFrame) -> DataFrame:
    """satellites(set_id, input_index, node_id, subject, ...) with the node they belong to: by subject, or by the
    part of their own id before #."""
    ids = nodes.select(*INPUT, F.col("node_id").alias("owner")).distinct()
    by_subject = satellites.withColumn("owner", F.col("subject"))
    by_prefix = satellites.filter(F.col("node_id").contains("#")).withColumn("owner", F.regexp_extract("node_id", "^(.*)#[^#]*$", 1))
    rows = [s.join(ids, [*INPUT, "owner"]) for s in (by_subject, by_prefix)]
    return rows[0].unionByName(rows[1]).dropDuplicates([*INPUT, "owner", "node_id"])
