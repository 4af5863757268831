"""Merging entries of many inputs by identity, under a policy for each field, in one shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The policies of each format; fields that are not named are first-writer.
POLICIES = {
    "cyclonedx": {"category": "graph", "ref": "bom-ref", "union": ["licenses", "hashes"], "conflict": ["copyright", "description", "name"]},
    "spdx2tv": {"category": "graph", "ref": "SPDXID", "union": ["LicenseInfoInFile", "externalRefs"], "conflict": ["PackageName", "PackageVersion", "PackageCopyrightText"]},
    "spdx3json": {"category": "graph", "ref": "spdxId", "union": ["verifiedUsing"], "conflict": ["name", "software_copyrightText"]},
    "dep5": {"category": "stanza", "ref": None, "union": ["files"], "conflict": ["copyright"]},
    "readmeoss": {"category": "stanza", "ref": None, "union": [], "conflict": []},
    "clixml": {"category": "stanza", "ref": None, "union": ["Files", "FileHash", "Acknowledgements", "Licenses"], "conflict": ["ComponentName", "ComponentVersion", "Community", "ComponentId", "ReviewedBy", "License/@type", "GeneralAssessment", "CriticalFilesFound", "DependencyNotes"]},
}


#: Columns of the entry tables that hold a policy's field under another name.
COLUMNS = {
    "spdx3json": {"verifiedUsing": "hashes", "software_copyrightText": "copyright"},
    "clixml": {"Files": "files", "FileHash": "hashes", "Acknowledgements": "acknowledgements", "Licenses": "licenses", "License/@type": "type"},
}


def field_policies(format: str) -> tuple[list[str], list[str]]:
    """The union and the conflict-checked columns of a format's entry table; all others are first-writer. A format that
    POLICIES does not know has none."""
    spec, names = POLICIES.get(format, {"union": [], "conflict": []}), COLUMNS.get(format, {})
    return tuple([names.get(f, f) for f in spec[policy]] for policy in ("union", "conflict"))


def load_policies(spark: SparkSession) -> DataFrame:
    """(format, field, policy) of all formats: a table of fixed size."""
    rows = [(name, field, policy) for name, p in POLICIES.items() for policy in ("union", "conflict") for field in p[policy]]
    return spark.createDataFrame(rows, "format string, field string, policy string")


def check_policies(union: list[str], conflict: list[str]) -> None:
    both = sorted(set(union) & set(conflict))
    if both:
        raise ValueError(f"fields with two policies: {', '.join(both)}")


def collect_entries(*frames: DataFrame) -> DataFrame:
    """All entries of all inputs; columns that an input lacks are null."""
    if not frames:
        raise ValueError("no inputs")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def unique_source_ids(inputs: DataFrame) -> DataFrame:
    """inputs(set_id, input_index, source_id) whose repeated source ids get _index from their second use on."""
    nth = F.row_number().over(Window.partitionBy("set_id", "source_id").orderBy("input_index"))
    return inputs.withColumn("_nth", nth).withColumn("source_id", F.when(F.col("_nth") > 1, F.concat_ws("_", "source_id", "input_index")).otherwise(F.col("source_id"))).drop("_nth")


def _is_array(df: DataFrame, field: str) -> bool:
    return df.schema[field].dataType.typeName() == "array"


def agg_union(values: Column, is_array: bool) -> Column:
    """Sorted distinct values of a group; nulls are skipped."""
    lists = F.collect_set(values) if not is_array else F.flatten(F.collect_set(values))
    return F.array_sort(F.array_distinct(F.filter(lists, lambda x: x.isNotNull())))


def agg_first_writer(value: Column, order: Column) -> Column:
    """The value of the first entry that has one."""
    return F.min_by(F.when(value.isNotNull(), value), F.when(value.isNotNull(), order))


def agg_disagrees(value: Column) -> Column:
    """Whether a group has several values; no distinct count, so the aggregate stays a single shuffle."""
    return F.coalesce(F.min(value) != F.max(value), F.lit(False))


def merge_entries(entries: DataFrame, keys: list[str], order: list[str], union: list[str] = (), conflict: list[str] = (), first: list[str] | None = None, source: str = "source_id") -> DataFrame:
    """One row per key. Columns: the keys, n_entries, sources (in order of first writing), source_id (they, comma-
    joined), each field merged by its policy, and <field>_conflict for conflict-checked ones.

    order ranks writers and must be unique in a group. All aggregates are partial ones, so a hot identity is combined
    before the shuffle. A null is a field that an entry lacks."""
    check_policies(list(union), list(conflict))
    if first is None:
        first = [c for c in entries.columns if c not in (*keys, *order, source, *union, *conflict)]
    rank = F.struct(*order)
    aggs = [F.count(F.lit(1)).alias("n_entries"), F.collect_set(F.struct(F.col(order[0]).alias("at"), F.col(source).alias("id"))).alias("_sources")]
    aggs += [agg_union(F.col(f), _is_array(entries, f)).alias(f) for f in union]
    aggs += [agg_first_writer(F.col(f), rank).alias(f) for f in (*conflict, *first)]
    aggs += [agg_disagrees(F.col(f)).alias(f"{f}_conflict") for f in conflict]
    merged = entries.groupBy(*keys).agg(*aggs)
    sources = F.array_distinct(F.transform(F.array_sort("_sources"), lambda s: s["id"]))
    return merged.withColumn("sources", sources).withColumn("source_id", F.array_join("sources", ",")).drop("_sources")


def _state_fields(union: list[str], conflict: list[str], first: list[str]) -> list[tuple[str, str]]:
    return [*[(f, "union") for f in union], *[(f, "first") for f in (*conflict, *first)], *[(f, "range") for f in conflict]]


def entry_states(entries: DataFrame, keys: list[str], order: list[str], union: list[str], conflict: list[str], first: list[str], source: str = "source_id") -> DataFrame:
    """What is needed of a key's entries to merge them with others later: counts, sources, sets of union fields, first
    values with their ranks, least and greatest values. finish_states(entry_states(e)) is merge_entries(e)."""
    check_policies(list(union), list(conflict))
    rank, aggs = F.struct(*order), {"first": [], "union": [], "range": []}
    for f, kind in _state_fields(union, conflict, first):
        value, at = F.col(f), F.when(F.col(f).isNotNull(), rank)
        if kind == "union":
            aggs[kind].append(agg_union(value, _is_array(entries, f)).alias(f"set_{f}"))
        elif kind == "first":
            aggs[kind] += [F.min(at).alias(f"rank_{f}"), F.min_by(value, at).alias(f"first_{f}")]
        else:
            aggs[kind] += [F.min(value).alias(f"least_{f}"), F.max(value).alias(f"most_{f}")]
    writers = F.collect_set(F.struct(F.col(order[0]).alias("at"), F.col(source).alias("id"))).alias("writers")
    return entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_entries"), writers, *aggs["union"], *aggs["first"], *aggs["range"])


def combine_states(states: DataFrame, keys: list[str], union: list[str], conflict: list[str], first: list[str]) -> DataFrame:
    """States of the same keys as one state each. Every part is associative and commutative, so neither the order of
    batches nor how they were combined before matters."""
    together = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    aggs = [F.sum("n_entries").alias("n_entries"), together("writers").alias("writers")]
    for f, kind in _state_fields(union, conflict, first):
        if kind == "union":
            aggs.append(F.array_sort(together(f"set_{f}")).alias(f"set_{f}"))
        elif kind == "first":
            aggs += [F.min(f"rank_{f}").alias(f"rank_{f}"), F.min_by(f"first_{f}", f"rank_{f}").alias(f"first_{f}")]
        else:
            aggs += [F.min(f"least_{f}").alias(f"least_{f}"), F.max(f"most_{f}").alias(f"most_{f}")]
    return states.groupBy(*keys).agg(*aggs)


def finish_states(states: DataFrame, keys: list[str], union: list[str], conflict: list[str], first: list[str]) -> DataFrame:
    """The merged rows, with the columns of merge_entries, of states with one row per key."""
    sources = F.array_distinct(F.transform(F.array_sort("writers"), lambda s: s["id"]))
    own = [F.col(f"set_{f}").alias(f) for f in union] + [F.col(f"first_{f}").alias(f) for f in (*conflict, *first)]
    clash = [F.coalesce(F.col(f"least_{f}") != F.col(f"most_{f}"), F.lit(False)).alias(f"{f}_conflict") for f in conflict]
    return states.select(*keys, "n_entries", *own, *clash, sources.alias("sources")).withColumn("source_id", F.array_join("sources", ","))


def _long(entries: DataFrame, keys: list[str], fields: list[str], order: list[str], source: str) -> DataFrame:
    """One row per entry and field that it has."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return entries.select(*keys, F.struct(*order).alias("rank"), F.col(source).alias("source"), F.inline(pairs)).filter("value is not null")


def conflicts(entries: DataFrame, keys: list[str], order: list[str], fields: list[str], source: str = "source_id") -> DataFrame:
    """A row per key and conflict-checked field with several values: path, chosen (the first writer's) and values, an
    array of (source, value) in writing order; a source's second value is source#2 and so on."""
    rows = _long(entries, keys, fields, order, source)
    groups = rows.groupBy(*keys, "field").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.min_by("value", "rank").alias("chosen")).filter("_lo <> _hi").drop("_lo", "_hi")
    # Only entries of disagreeing fields are numbered and gathered, each value of a source once.
    own = rows.join(groups, [*keys, "field"]).groupBy(*keys, "field", "chosen", "source", "value").agg(F.min("rank").alias("rank"))
    nth = F.row_number().over(Window.partitionBy(*keys, "field", "source").orderBy("rank"))
    own = own.withColumn("nth", nth).withColumn("source", F.when(F.col("nth") > 1, F.concat_ws("#", "source", "nth")).otherwise(F.col("source")))
    values = F.transform(F.array_sort(F.collect_list(F.struct("rank", "source", "value"))), lambda x: F.struct(x["source"].alias("source"), x["value"].alias("value")))
    out = own.groupBy(*keys, "field", "chosen").agg(values.alias("values"))
    return out.withColumn("path", path_of(keys, "field")).withColumn("resolution", F.lit("first-writer"))


def path_of(keys: list[str], field: str | None = None) -> Column:
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys] + ([F.col(field)] if field else [])
    return F.concat(*[x for p in parts for x in (F.lit("/"), p)])


def provenance(entries: DataFrame, keys: list[str], order: list[str], fields: dict[str, str], source: str = "source_id") -> DataFrame:
    """Rows (keys, field, sources): a null field names the sources of the whole entry, for every key; fields only for
    keys of two entries or more. fields maps names to policies: a union has every source that has the field, a
    conflict-checked field those that agree with the chosen value, a first-writer field the first.

    One partial aggregate gives all of a key, so entries move once and a hot identity is combined before it."""
    rank, by = F.struct(*order), F.col(source)
    aggs, named = [F.collect_set(source).alias("_whole"), F.count(F.lit(1)).alias("_n")], []
    for i, (f, policy) in enumerate(fields.items()):
        value = F.col(f).cast("string")
        has = value.isNotNull()
        if policy == "union":
            aggs += [F.collect_set(F.when(has, by)).alias(f"_s{i}"), F.bool_or(has).alias(f"_f{i}")]
            own, there = F.col(f"_s{i}"), F.col(f"_f{i}")
        else:
            aggs.append(F.min(F.when(has, F.struct(rank.alias("rank"), by.alias("source"), value.alias("value")))).alias(f"_f{i}"))
            own, there = F.array(F.col(f"_f{i}")["source"]), F.col(f"_f{i}").isNotNull()
        if policy == "conflict":
            # Distinct pairs of a value and a source: those of the first value agree with it.
            aggs.append(F.collect_set(F.when(has & by.isNotNull(), F.struct(value.alias("value"), by.alias("source")))).alias(f"_s{i}"))
            chosen = F.col(f"_f{i}")["value"]
            own = F.transform(F.filter(f"_s{i}", lambda x: x["value"] == chosen), lambda x: x["source"])  # noqa: B023
        named.append(F.when(there & (F.col("_n") > 1), F.struct(F.lit(f).alias("field"), F.array_sort(own).alias("sources"))))
    whole = F.struct(F.lit(None).cast("string").alias("field"), F.array_sort("_whole").alias("sources"))
    out = entries.groupBy(*keys).agg(*aggs).select(*keys, F.inline(F.array_compact(F.array(whole, *named))))
    return out.withColumn("path", F.when(F.col("field").isNull(), path_of(keys)).otherwise(path_of(keys, "field")))


def merge_tags(entries: DataFrame, keys: list[str], order: list[str], column: str = "tags") -> DataFrame:
    """keys and column, an array of (tag, values): of each tag what the first entry that has it says."""
    rank = F.struct(*order)
    each = entries.select(*keys, rank.alias("_rank"), F.inline(column)).groupBy(*keys, "tag").agg(F.min_by("values", "_rank").alias("values"))
    return each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("tag", "values"))).alias(column))


def join_keys(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns of other, null keys being equal."""
    renamed = other.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return df.join(renamed, on, "left").drop(*[f"_k_{k}" for k in keys])


def last_writer_name(entries: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """keys and the non-empty name that the last entry gives."""
    rank = F.struct(*order)
    return entries.filter(F.coalesce(F.col(name), F.lit("")) != "").groupBy(*keys).agg(F.max_by(name, rank).alias(name))


def winning_value(column: str, order: list[str], last_writer: bool | Column = False) -> Column:
    """Aggregate: the non-empty value of the first entry that has one, or of the last one where last_writer holds
    (which must be the same for all entries of a group)."""
    rank = F.struct(*order)
    has = F.col(column).isNotNull() & (F.col(column) != "")
    first, last = (by(F.when(has, F.col(column)), F.when(has, rank)) for by in (F.min_by, F.max_by))
    if isinstance(last_writer, bool):
        return last if last_writer else first
    return F.when(F.bool_or(last_writer), last).otherwise(first)


def alias_map(entries: DataFrame, keys: list[str], order: list[str], ref: str, last_writer: bool | Column = False) -> DataFrame:
    """(keys, loser_ref, winner_ref) of references whose entry was merged into one with another reference."""
    has = F.col(ref).isNotNull() & (F.col(ref) != "")
    winners = entries.groupBy(*keys).agg(winning_value(ref, order, last_writer).alias("winner_ref"))
    return entries.filter(has).select(*keys, F.col(ref).alias("loser_ref")).join(winners, keys).filter("loser_ref <> winner_ref").distinct()


def primary_rows(rows: DataFrame, set_key: str = "set_id") -> DataFrame:
    """Rows (headers, footers, metadata) of the first input of each set."""
    first = rows.groupBy(set_key).agg(F.min("input_index").alias("_first"))
    return rows.join(first, set_key).filter("input_index = _first").drop("_first")


def merge_comment(headers: DataFrame, inputs: DataFrame, set_key: str = "set_id") -> DataFrame:
    """headers with a last line in Comment that names the merged sources in order."""
    names = inputs.groupBy(set_key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("input_index", "source_id"))), lambda x: x["source_id"]), ", ").alias("_names"))
    line = F.concat(F.lit("merged from: "), F.col("_names"))
    return headers.join(names, set_key).withColumn("Comment", F.concat_ws("\n", F.nullif(F.col("Comment"), F.lit("")), line)).drop("_names")


def dedup_stats(entries: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Per `by`: entries in, entries out and merged groups. Groups are counted first, so no distinct count is needed."""
    groups = entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.groupBy(*by).agg(F.sum("n").alias("entries_in"), F.count(F.lit(1)).alias("entries_out"), F.count_if(F.col("n") > 1).alias("merged_groups"))
