"""The one-call merge: from report files to merged entries, provenance, conflicts and merged reports, lazily."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import text as fx
from tributary.operators import checks, refs
from tributary.operators import merge as ops
from tributary.plans.scratch import stash
from tributary.sources import formats, provenance, report_files, reports

KEYS = ["set_id", "kind", "identity_key"]
ORDER = ["input_index", "entry_ord"]
#: Columns of an entry that place or rank it; they are no fields.
PLACE = {"entry_ord", "input_index", "source_id", "ord", "tags"}
DOCUMENT = "SPDXRef-DOCUMENT"


def _namespaced(entries: DataFrame, texts: DataFrame, format: str) -> tuple[DataFrame, DataFrame | None]:
    """Entries of a graph format with all references as their input's own, and the map of what inputs declare."""
    if format == "cyclonedx":
        return refs.namespace(entries, ["ref", "upload_ref"]), None
    if "_known" in entries.columns:
        return refs.namespace(refs.namespace_known(entries, [], formats.EXPRESSIONS), ["ref", "SPDXID", "LicenseID"]), None
    ref_map = refs.declared_refs(entries, "ref")
    if format == "spdx2tv":
        entries = refs.rewrite_embedded_refs(entries, ref_map, formats.EXPRESSIONS, ["set_id", "input_index", "entry_ord"])
        return refs.namespace(entries, ["ref", "SPDXID", "LicenseID"]), ref_map
    ref_map = refs.declared_refs(formats.nodes_from_spdx3(texts).filter("kind <> 'meta'").withColumnRenamed("node_id", "ref"), "ref")
    entries = refs.rewrite_json_refs(entries, ref_map, ["set_id", "input_index", "entry_ord"])
    return refs.namespace(entries, ["ref"]), ref_map


def merge_texts(texts: DataFrame, format: str, folder: str | None = None, check: Callable[[DataFrame], None] = lambda entries: None, whole: bool = True, lines: DataFrame | None = None) -> dict[str, DataFrame]:
    """Merge texts (set_id, input_index, source_id, text) of one format: tables entries, merged, conflicts, provenance,
    for formats with references aliases and (tag-value only) relationships, and reports: a text per set; without whole,
    pieces in its place, the reports cut in lines that stand together. lines, of tag-value reports only, are those of
    reports.report_lines, and texts then need no text: so neither what is read nor what is written must fit a row.

    With a folder the tables are written below it one by one, so that none is computed twice; without, nothing runs until
    a table is used, and each parses the texts anew. check gets the entries before anything is merged. References are namespaced by input before the merge and point at the merged entries
    after it. A licence text of a tag-value report takes id and name of its last writer."""
    if format not in formats.PARSERS:
        raise ValueError(f"no such format: {format}")

    def kept(df: DataFrame, name: str) -> DataFrame:
        if not folder:
            return df
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

    union, conflict = ops.field_policies(format)
    if lines is not None and format != "spdx2tv":
        raise ValueError(f"{format} is not read line by line")
    parsed = None
    if lines is not None:
        entries = formats.entries_from_tagvalue_lines(lines)
    elif formats.PARSERS[format] is formats.entries_from_tagvalue:
        # Entries and relationships come from one reading of the texts.
        parsed = formats.tagvalue_rows(texts)
        parsed = stash(parsed, "tag-value-rows") if folder else parsed
        entries = formats.entries_of_tagvalue_rows(parsed)
    else:
        entries = formats.PARSERS[format](texts)
    graph = ops.POLICIES.get(format, {}).get("category") == "graph"
    ref_map = None
    if graph:
        entries, ref_map = _namespaced(entries, texts, format)
    entries = kept(entries, "entries")
    check(entries)
    keys = [*KEYS, "component"] if format == "clixml" else KEYS
    union, conflict = ([f for f in fields if f in entries.columns] for fields in (union, conflict))
    first = [c for c in entries.columns if c not in (*keys, *PLACE, *union, *conflict)]
    merged = ops.merge_entries(entries.withColumn("ord", F.struct(*ORDER)), keys, ORDER, union, conflict, [*first, "ord"])
    out = {"entries": entries}
    last_writer: bool | Column = False
    if format == "spdx2tv":
        last_writer = F.col("kind") == "license_text"
        merged = ops.join_keys(merged, ops.merge_tags(entries, keys, ORDER), keys)
        named = entries.filter(last_writer).groupBy(*keys).agg(*[ops.winning_value(c, ORDER, True).alias(f"_{c}") for c in ("LicenseID", "LicenseName")])
        merged = ops.join_keys(merged, named, keys)
        merged = merged.withColumns({c: F.coalesce(f"_{c}", c) for c in ("LicenseID", "LicenseName")} | {"ref": F.coalesce("_LicenseID", "ref")}).drop("_LicenseID", "_LicenseName")
    out["conflicts"] = ops.conflicts(entries, keys, ORDER, conflict) if conflict else None
    policy = {**dict.fromkeys(union, "union"), **dict.fromkeys(conflict, "conflict")}
    out["provenance"] = ops.provenance(entries, keys, ORDER, policy) if policy else entries.groupBy(*keys).agg(F.array_sort(F.collect_set("source_id")).alias("sources")).withColumn("path", ops.path_of(keys))
    if format in formats.CONFLICT_HOOKS:
        out["overlaps"] = formats.CONFLICT_HOOKS[format](entries)
    if graph:
        out["aliases"] = kept(ops.alias_map(entries, keys, ORDER, "ref", last_writer), "aliases")
        survivors = out["aliases"].select("set_id", F.col("loser_ref").alias("old_ref"), F.col("winner_ref").alias("new_ref")).distinct()
    if format == "cyclonedx":
        merged = refs.rewrite_refs(merged, survivors, ["upload_ref"], ["set_id"])
    if format == "spdx2tv":
        merged = refs.rewrite_embedded_refs(merged, survivors, formats.EXPRESSIONS, keys, ["set_id"])
        merged = merged.withColumn("LicenseInfoInFile", F.array_sort(F.array_distinct("LicenseInfoInFile")))
        if parsed is not None:
            rels = refs.namespace_known(formats.relationships_of_tagvalue_rows(parsed), ["src", "dst"])
        else:
            rels = formats.relationships_from_tagvalue(texts) if lines is None else formats.relationships_from_tagvalue_lines(lines)
            rels = refs.rewrite_refs(rels, ref_map, ["src", "dst"])
        rels = refs.rewrite_refs(rels, survivors, ["src", "dst"], ["set_id"])
        merged = kept(merged, "redirected")
        out["relationships"] = kept(refs.merged_relationships(rels, merged.filter("kind = 'package'"), "ref", DOCUMENT), "relationships")
        out["dangling"] = refs.dangling_refs(out["relationships"], merged.select("set_id", "ref").unionByName(merged.select("set_id", F.lit(DOCUMENT).alias("ref"))), "ref", refs.expression_refs(merged, formats.EXPRESSIONS, "ref"))
        merged = _with_codes(merged, out["relationships"])
    out["merged"] = kept(merged, "merged")
    out["reports" if whole else "pieces"] = _render(texts, out, format, ref_map, survivors if graph else None, whole)
    return out


def _with_codes(merged: DataFrame, relationships: DataFrame) -> DataFrame:
    """Packages with the verification code of the files that they contain after the merge, in tags."""
    files = merged.filter("kind = 'file'").select(F.concat_ws("\0", "set_id", "ref").alias("file"), F.try_element_at("checksums", F.lit("SHA1")).alias("digest")).filter("digest is not null")
    contains = relationships.filter("type = 'CONTAINS'").select(F.concat_ws("\0", "set_id", "src").alias("package"), F.concat_ws("\0", "set_id", "dst").alias("file"))
    codes = refs.verification_codes(contains, files, "package", "file", "digest").select(F.col("package").alias("_p"), "verification_code")
    rows = merged.join(codes, F.when(F.col("kind") == "package", F.concat_ws("\0", "set_id", "ref")) == F.col("_p"), "left").drop("_p")
    code = F.array(F.struct(F.lit("PackageVerificationCode").alias("tag"), F.array("verification_code").alias("values")))
    others = F.filter(F.coalesce("tags", F.array().cast("array<struct<tag:string,values:array<string>>>")), lambda t: t["tag"] != "PackageVerificationCode")
    return rows.withColumn("tags", F.when(F.col("verification_code").isNotNull(), F.concat(others, code)).otherwise(F.col("tags"))).drop("verification_code")


def _render(texts: DataFrame, tables: dict[str, DataFrame], format: str, ref_map: DataFrame | None, survivors: DataFrame | None, whole: bool = True) -> DataFrame | None:
    """(set_id, text) of the merged reports, or their pieces; None for formats that were registered without a renderer."""
    merged = tables["merged"]
    if format == "cyclonedx":
        return (formats.render_cyclonedx if whole else formats.cyclonedx_pieces)(merged)
    if format == "spdx2tv":
        fixed = [("SPDXVersion", "SPDX-2.3"), ("DataLicense", "CC0-1.0"), ("SPDXID", DOCUMENT), ("DocumentName", "Merged Report"), ("Creator", "Tool: tributary")]
        pair = lambda t, v: F.struct(F.lit(t).alias("tag"), v.alias("value"))
        sets = texts.select("set_id").distinct()
        documents = sets.select("set_id", F.array(*[pair(t, F.lit(v)) for t, v in fixed], pair("DocumentNamespace", F.concat(F.lit("urn:tributary:"), F.md5(F.col("set_id").cast("string"))))).alias("tags"))
        return (formats.render_tagvalue if whole else formats.tagvalue_pieces)(documents, tables["relationships"], merged)
    if format == "spdx3json":
        nodes = formats.nodes_from_spdx3(texts)
        rest = nodes.filter("kind in ('meta', 'satellite')")
        place = ["set_id", "input_index", "node_ord"]
        rest = refs.rewrite_json_refs(rest, ref_map, place).withColumn("node_id", F.when(F.col("kind") == "meta", F.col("node_id")).otherwise(fx.namespaced_ref("node_id", "input_index")))
        fields = F.from_json("json", "map<string,variant>")
        hashes = F.create_map(F.lit("verifiedUsing"), F.parse_json(F.to_json("hashes")))
        own = F.when(F.size("hashes") > 0, F.to_json(F.map_concat(F.map_filter(fields, lambda k, _: k != "verifiedUsing"), hashes))).otherwise(F.col("json"))
        kept = merged.select("set_id", F.col("ord.input_index").alias("input_index"), F.col("ord.entry_ord").alias("node_ord"), F.col("ref").alias("node_id"), "type", "kind", own.alias("json"))
        rows = kept.unionByName(rest.select(*place, "node_id", "type", "kind", "json"))
        return (formats.render_spdx3 if whole else formats.spdx3_pieces)(formats.assemble_spdx3(refs.rewrite_json_refs(rows, survivors, place, by=["set_id"])))
    if format == "dep5":
        headers = ops.primary_rows(formats.header_from_dep5(texts)).select("set_id", *[F.col(f"`{f}`") for f in formats.HEADER_FIELDS])
        inputs = texts.select("set_id", "input_index", "source_id")
        return (formats.render_dep5 if whole else formats.dep5_pieces)(ops.merge_comment(headers, inputs), merged)
    if format == "readmeoss":
        headers = ops.primary_rows(formats.header_from_notice(texts)).select("set_id", "package_name")
        footers = ops.primary_rows(formats.footer_from_notice(texts)).select("set_id", "copyright_notices", "notices")
        ends = headers.select("set_id").join(footers, "set_id", "left").na.fill("", ["copyright_notices", "notices"])
        return (formats.render_notice if whole else formats.notice_pieces)(headers, merged, ends)
    if format == "clixml":
        if not whole:
            return formats.clixml_pieces(merged)
        return formats.render_clixml(formats.regroup_components(merged.withColumn("entry_ord", F.col("ord"))))
    return None


def merge(spark: SparkSession, *globs: str, format: str | None = None, output: str | None = None, validate: bool = True, whole: bool = True) -> dict[str, DataFrame]:
    """Read reports, tell their format (or hold them to the one given), and merge them.

    With validate, entries without an identity, reports without entries, bytes that are not UTF-8 and what breaks the
    format's own rules (formats.violations) are errors, told before anything is merged. With output, a folder, the
    entries, the tables, the merged reports (a folder per set) and a provenance record per set are written in a folder
    beside it and put in their places when all of them are there: a call that fails leaves output as it was. The
    tables returned are those written.

    Without whole, which needs an output, the merged reports are ordered files (report_files.write_reports) with their
    manifest as table report_files, and there are no reports and no provenance records, which are a row per set. If
    moreover format is given as spdx2tv, the inputs are read line by line: then neither an input nor a set must fit a
    row, only an entry must, and the format is not told from first bytes."""
    if not whole and not output:
        raise ValueError("reports in files need an output")
    if not whole and format == "spdx2tv":
        return _merge_lines(spark, globs, output, validate)
    raw = reports.with_format(reports.read_reports(spark, *globs))
    found = [r[0] for r in reports.set_formats(raw).select("format").distinct().take(3)]
    if format is None:
        if len(found) != 1 or found[0] is None:
            raise ValueError(f"the inputs have no one format: {found}")
        format = found[0]
    bad = reports.format_mismatches(raw, format).select("path")
    checks.assert_valid(format_mismatches=bad)
    texts = reports.texts(raw)

    def check(entries: DataFrame) -> None:
        rules = {"invalid_utf8": checks.invalid_utf8(raw).select("path"), "missing_identity": checks.missing_identity(entries), "empty_reports": checks.empty_reports(texts.select("set_id", "input_index", "path"), entries)}
        checks.assert_valid(**rules, **formats.violations(texts, entries, format))

    if not output:
        return merge_texts(texts, format, None, check) if validate else merge_texts(texts, format)
    return _publish_merged(spark, texts, format, output, whole, check=check if validate else _unchecked)


def _unchecked(entries: DataFrame) -> None:
    """No rule."""


def _merge_lines(spark: SparkSession, globs: tuple[str, ...], output: str, validate: bool) -> dict[str, DataFrame]:
    inputs, lines = reports.report_inputs(spark, *globs), reports.report_lines(spark, *globs)

    def check(entries: DataFrame) -> None:
        checks.assert_valid(
            invalid_utf8=lines.filter(~F.col("valid")).select("path").distinct(), missing_identity=checks.missing_identity(entries), empty_reports=checks.empty_reports(inputs.select("set_id", "input_index", "path"), entries),
            duplicate_refs=checks.duplicate_refs(entries, "ref"), lines=checks.malformed_lines(lines.drop("valid")),
        )

    return _publish_merged(spark, inputs, "spdx2tv", output, False, check=check if validate else _unchecked, lines=lines)


def _publish_merged(spark: SparkSession, texts: DataFrame, format: str, output: str, whole: bool, **options) -> dict[str, DataFrame]:
    staging = f"{output.rstrip('/')}.staging-{uuid.uuid4().hex}"
    try:
        tables = write_merged(merge_texts(texts, format, staging, whole=whole, **options), texts, format, staging)
        publish(spark, staging, output)
    finally:
        _files(spark, staging)[0].delete(_files(spark, staging)[1], True)
    return {name: df and spark.read.schema(df.schema).parquet(f"{output}/{name}") for name, df in tables.items()}


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def publish(spark: SparkSession, staging: str, output: str) -> None:
    """Put all folders of staging in the place of those of output. Each is renamed, and what was there is removed last."""
    fs, at = _files(spark, staging)
    old = f"{staging}-old"
    for path in (output, old):
        fs.mkdirs(_files(spark, path)[1])
    for name in sorted(f.getPath().getName() for f in fs.listStatus(at)):
        new, place = (_files(spark, f"{x}/{name}")[1] for x in (staging, output))
        if fs.exists(place) and not fs.rename(place, _files(spark, f"{old}/{name}")[1]):
            raise OSError(f"{place} can't be replaced")
        if not fs.rename(new, place):
            raise OSError(f"{place} can't be written")
    fs.delete(_files(spark, old)[1], True)


def write_merged(tables: dict[str, DataFrame], texts: DataFrame, format: str, output: str) -> dict[str, DataFrame]:
    """Write the tables of merge_texts(..., folder=output) that are not there yet, merged reports, and a provenance
    record for each, or, where there are pieces of reports, the files of these and their manifest; return the tables as
    read back."""
    spark, out = texts.sparkSession, dict(tables)
    if "pieces" in out:
        pieces = out.pop("pieces")
        tables = {k: df for k, df in tables.items() if k != "pieces"}
        if pieces is not None:
            tables["report_files"] = report_files.write_reports(pieces, f"{output}/report")

    def write(name: str) -> None:
        tables[name].write.mode("overwrite").parquet(f"{output}/{name}")
        out[name] = spark.read.schema(tables[name].schema).parquet(f"{output}/{name}")

    written = ("entries", "aliases", "relationships", "merged")
    with ThreadPoolExecutor(checks.JOBS) as pool:  # they do not hang on each other
        list(pool.map(write, [name for name, df in tables.items() if df is not None and name not in written]))
    if "reports" not in tables:
        return out
    if out["reports"] is not None:
        out["reports"].select("set_id", F.col("text").alias("value")).write.mode("overwrite").partitionBy("set_id").text(f"{output}/report")
    sets = texts.select("set_id").distinct().select("set_id", F.lit(format).alias("format"), F.current_timestamp().alias("created_at"))
    none = spark.createDataFrame([], "set_id string, path string, values array<struct<source:string,value:string>>, resolution string, chosen string")
    clashes = out["conflicts"].select(*none.columns) if out.get("conflicts") is not None else none
    edits = spark.createDataFrame([], "set_id string, seq long, who string, `when` string, op string, path string, value string, from_path string, reason string, summary string")
    records = provenance.provenance_records(sets, texts.select("set_id", "input_index", "source_id"), out["provenance"].select("set_id", "path", "sources"), clashes, edits)
    provenance.write_provenance(records, f"{output}/provenance_records")
    return out
