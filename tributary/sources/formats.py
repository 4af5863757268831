"""The six report layouts: parsers from texts to entry tables, and renderers back. A parser takes rows (set_id,
input_index, source_id, text) of many sets and inputs; a renderer gives one text per set, and ..._pieces the same report
as rows (set_id, part, ord, tie, lines), which report_files.write_reports puts in files whatever a report's size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tributary.functions import text as fx
from tributary.operators import checks
from tributary.operators.lines import lines as line_table
from tributary.operators.merge import join_keys
from tributary.plans.scratch import stash
from tributary.sources import sections as sc
from tributary.sources import tagvalue

INPUT = ["set_id", "input_index", "source_id"]


def _lines(texts: DataFrame) -> DataFrame:
    return line_table(texts.select(*INPUT, F.replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")).alias("text")), INPUT)


def _piece(df: DataFrame, part: Column | int, lines: Column, ord_: Column, tie: Column | None = None) -> DataFrame:
    """Pieces of reports: lines that stand together, placed by part, ord and tie."""
    part = part if isinstance(part, Column) else F.lit(part)
    return df.select("set_id", part.cast("int").alias("part"), ord_.alias("ord"), (F.lit("") if tie is None else tie).alias("tie"), lines.alias("lines"))


def _nowhere(df: DataFrame, column: str = "ord") -> Column:
    """A null of the column's type: the place of pieces that their part alone places."""
    return F.lit(None).cast(df.schema[column].dataType)


def _tie(df: DataFrame) -> Column:
    return F.concat_ws("\0", *[c for c in ("kind", "identity_key") if c in df.columns])


def _listed(items: DataFrame, head: str, tail: str) -> DataFrame:
    """Pieces with one line each as a JSON list: commas before all but a set's first, head and tail around them."""
    at = F.struct("part", "ord", "tie")
    firsts = items.groupBy("set_id").agg(F.min(at).alias("_first"))
    comma = F.when(at.eqNullSafe(F.col("_first")), "").otherwise(",")
    rows = join_keys(items, firsts, ["set_id"])
    rows = _piece(rows, F.col("part"), F.transform("lines", lambda x: F.concat(comma, x)), F.col("ord"), F.col("tie"))
    ends = [_piece(firsts.select("set_id"), n, _array(text), _nowhere(items)) for n, text in ((-1, head), (1 << 20, tail))]
    return ends[0].unionByName(rows).unionByName(ends[1])


def _emit(pieces: DataFrame, key: str = "set_id") -> DataFrame:
    """Pieces as one text per set, in order of part, ord and tie."""
    row = F.struct("part", "ord", "tie", "lines")
    return pieces.groupBy(key).agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["lines"])), "\n").alias("text"))


def _pair(tag: str, value: Column) -> Column:
    """[Tag: value], or nothing for a null or empty value."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.array(F.concat(F.lit(f"{tag}: "), value))).otherwise(F.array().cast("array<string>"))


def _pairs(tag: str, values: Column) -> Column:
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.concat(F.lit(f"{tag}: "), v))


def _array(*texts: str) -> Column:
    return F.array(*[F.lit(t) for t in texts])


# --- component JSON ---------------------------------------------------------------------------------------------

_HASHES = "array<struct<alg:string,content:string>>"
_LICENSES = "array<struct<license:struct<id:string,name:string>>>"
_COMPONENT = f"struct<type:string,name:string,`bom-ref`:string,hashes:{_HASHES},licenses:{_LICENSES},copyright:string,description:string>"
COMPONENT_DOCUMENT = f"bomFormat string, specVersion string, version int, metadata struct<component:{_COMPONENT}>, components array<{_COMPONENT}>"


def entries_from_cyclonedx(texts: DataFrame) -> DataFrame:
    """metadata.component as a package entry, components as file entries that name the upload's reference."""
    doc = texts.select(*INPUT, F.from_json("text", COMPONENT_DOCUMENT).alias("d"))
    upload = doc.filter("d.metadata.component is not null").select(*INPUT, F.lit(0).alias("entry_ord"), F.lit("package").alias("kind"), F.col("d.metadata.component").alias("c"), F.lit(None).cast("string").alias("upload_ref"))
    files = doc.select(*INPUT, F.posexplode("d.components").alias("p", "c"), F.col("d.metadata.component.bom-ref").alias("upload_ref")).select(*INPUT, (F.col("p") + 1).alias("entry_ord"), F.lit("file").alias("kind"), "c", "upload_ref")
    rows = upload.unionByName(files)
    ids = F.transform("c.licenses", lambda x: F.coalesce(x["license"]["id"], x["license"]["name"]))
    return rows.select(
        *INPUT, "entry_ord", "kind", F.col("c.type").alias("type"), F.col("c.name").alias("name"), F.col("c.bom-ref").alias("ref"), F.col("c.hashes").alias("hashes"),
        ids.alias("licenses"), F.col("c.copyright").alias("copyright"), F.col("c.description").alias("description"), "upload_ref", fx.checksum_identity("c.hashes").alias("identity_key"),
    )


def cyclonedx_headers(texts: DataFrame) -> DataFrame:
    return texts.select(*INPUT, F.from_json("text", COMPONENT_DOCUMENT).alias("d")).select(*INPUT, "d.bomFormat", "d.specVersion", "d.version", F.size("d.components").alias("n_components"))


def assemble_cyclonedx(merged: DataFrame) -> DataFrame:
    """Merged entries with uploads as libraries and, on files, a property that names their upload."""
    prop = F.array(F.struct(F.lit("upload-bom-ref").alias("name"), F.col("upload_ref").alias("value")))
    return merged.withColumn("type", F.when(F.col("kind") == "package", "library").otherwise(F.col("type"))).withColumn("properties", F.when((F.col("kind") != "package") & F.col("upload_ref").isNotNull(), prop))


_COMPONENTS_HEAD, _COMPONENTS_TAIL = '{"bomFormat":"CycloneDX","specVersion":"1.4","version":1,"components":[', "]}"


def _component_json() -> Column:
    licenses = F.transform("licenses", lambda x: F.struct(F.struct(x.alias("id")).alias("license")))
    return F.to_json(F.struct("type", "name", F.col("ref").alias("bom-ref"), "hashes", licenses.alias("licenses"), "copyright", "description", "properties"))


def render_cyclonedx(merged: DataFrame, order: str = "ord") -> DataFrame:
    rows = assemble_cyclonedx(merged).groupBy("set_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), _component_json().alias("j")))), lambda x: x["j"]).alias("parts"))
    return rows.select("set_id", F.concat(F.lit(_COMPONENTS_HEAD), F.array_join("parts", ","), F.lit(_COMPONENTS_TAIL)).alias("text"))


def cyclonedx_pieces(merged: DataFrame) -> DataFrame:
    """A component a line."""
    rows = assemble_cyclonedx(merged)
    return _listed(_piece(rows, 0, F.array(_component_json()), F.col("ord"), _tie(rows)), _COMPONENTS_HEAD, _COMPONENTS_TAIL)


# --- typed nodes (JSON array) -----------------------------------------------------------------------------------

# Node types that are entries, and those that describe the document.
PACKAGE, FILE, LICENSE = "software_Package", "software_File", "expandedlicensing_CustomLicense"
META_TYPES = ("CreationInfo", "SpdxDocument", "Tool", "Organization", "Person", "SoftwareAgent", "Agent")


def nodes_from_spdx3(texts: DataFrame) -> DataFrame:
    """Every node: (input, node_ord, node_id, type, kind, name, hashes, license_text, copyright, subject, from_ref, to_refs,
    elements, json). kind is package, file, license_text, meta or satellite. Tabs count as blanks."""
    clean = F.replace("text", F.lit("\t"), F.lit(" "))
    rows = texts.select(*INPUT, F.posexplode(F.from_json(clean, "array<variant>")).alias("node_ord", "v"))
    get = lambda path, kind="string": F.try_variant_get("v", f"$.{path}", kind)
    type_ = get("type")
    kind = F.when(type_ == PACKAGE, "package").when(type_ == FILE, "file").when(type_ == LICENSE, "license_text").when(type_.isin(*META_TYPES), "meta").otherwise("satellite")
    return rows.select(
        *INPUT, "node_ord", F.coalesce(get("spdxId"), F.try_variant_get("v", "$['@id']", "string")).alias("node_id"), type_.alias("type"), kind.alias("kind"), get("name").alias("name"),
        get("verifiedUsing", "array<struct<algorithm:string,hashValue:string>>").alias("hashes"), get("simplelicensing_licenseText").alias("license_text"), get("software_copyrightText").alias("copyright"),
        get("subject").alias("subject"), get("from").alias("from_ref"), F.coalesce(get("to", "array<string>"), F.when(get("to").isNotNull(), F.array(get("to")))).alias("to_refs"), get("element", "array<string>").alias("elements"), F.to_json("v").alias("json"),
    )


def entries_from_spdx3(texts: DataFrame) -> DataFrame:
    rows = nodes_from_spdx3(texts).filter("kind in ('package', 'file', 'license_text')")
    identity = F.when(F.col("kind") == "license_text", fx.text_identity(fx.strip_text_tag(F.coalesce("license_text", F.lit(""))))).otherwise(fx.verified_identity("hashes"))
    return rows.withColumn("identity_key", identity).withColumnsRenamed({"node_ord": "entry_ord", "node_id": "ref"})


def assemble_spdx3(nodes: DataFrame) -> DataFrame:
    """Output nodes (set_id, section, ord, node_id, json): meta nodes of the first input, then entry nodes and
    satellites, each id once, relationships last."""
    first = F.min("input_index").over(Window.partitionBy("set_id"))
    section = F.when(F.col("kind") == "meta", 0).when(F.col("type").contains("Relationship"), 3).when(F.col("kind") == "satellite", 2).otherwise(1)
    rows = nodes.withColumn("_first", first).withColumn("section", section).filter("kind <> 'meta' or input_index = _first")
    rows = rows.withColumn("_id", F.coalesce("node_id", F.concat_ws(":", F.lit("\0"), "input_index", "node_ord")))
    nth = F.row_number().over(Window.partitionBy("set_id", "_id").orderBy("section", "input_index", "node_ord"))
    return rows.withColumn("_n", nth).filter("_n = 1").select("set_id", "section", F.struct("input_index", "node_ord").alias("ord"), "node_id", "json")


def render_spdx3(nodes: DataFrame) -> DataFrame:
    rows = nodes.groupBy("set_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("section", "ord", "json"))), lambda x: x["json"]).alias("parts"))
    return rows.select("set_id", F.concat(F.lit("["), F.array_join("parts", ","), F.lit("]")).alias("text"))


def spdx3_pieces(nodes: DataFrame) -> DataFrame:
    """A node of assemble_spdx3 a line."""
    return _listed(_piece(nodes, F.col("section"), F.array("json"), F.col("ord"), F.coalesce("node_id", F.lit(""))), "[", "]")


# --- component XML, several roots in a file ---------------------------------------------------------------------

ROOT = "ComponentLicenseInformation"
_XML = (
    "_componentSHA1 string, _component string, GeneralInformation struct<ComponentName:string,ComponentVersion:string,Community:string,ComponentId:string,ReviewedBy:string>, "
    "AssessmentSummary struct<GeneralAssessment:string,CriticalFilesFound:string,DependencyNotes:string>, "
    "License array<struct<_type:string,_name:string,_spdxidentifier:string,Content:string,Acknowledgements:string,Files:string,FileHash:string>>, "
    "Copyright array<struct<Content:string,Files:string,FileHash:string>>, Obligation array<struct<Topic:string,Text:string,Licenses:struct<License:array<string>>>>, "
    "ExportRestrictions array<struct<Content:string>>, Patents array<struct<Content:string>>"
)


#: Columns of component entries, and where they stand in a root.
COMPONENT_FIELDS = {
    "ComponentName": "GeneralInformation", "ComponentVersion": "GeneralInformation", "Community": "GeneralInformation", "ComponentId": "GeneralInformation", "ReviewedBy": "GeneralInformation",
    "GeneralAssessment": "AssessmentSummary", "CriticalFilesFound": "AssessmentSummary", "DependencyNotes": "AssessmentSummary",
}


def roots_from_clixml(texts: DataFrame) -> DataFrame:
    roots = texts.select(*INPUT, F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s)(<{ROOT}[ >].*?</{ROOT}>)"), F.lit(1))).alias("root_ord", "xml"))
    return roots.select(*INPUT, "root_ord", F.from_xml("xml", _XML).alias("r"))


def entries_from_clixml(texts: DataFrame) -> DataFrame:
    """(input, entry_ord, kind, section, component, identity_key, name, type, content, acknowledgements, files, hashes,
    topic, licenses, and COMPONENT_FIELDS of components): each root is a component; its children come with it unless it
    has no SHA-1. acknowledgements is a list of one or none."""
    roots = roots_from_clixml(texts).withColumn("component", F.lower("r._componentSHA1"))
    empty = F.array().cast("array<string>")
    text = F.lit(None).cast("string")

    def rows(df, section, kind, ord_, identity, name=text, type_=text, content=text, ack=text, files=empty, hashes=empty, topic=text, licenses=empty):
        return df.select(*INPUT, F.struct(F.col("root_ord"), F.lit(section).alias("section"), ord_.alias("ord")).alias("entry_ord"), F.lit(kind).alias("kind"), F.lit(section).alias("section"), "component", identity.alias("identity_key"), name.alias("name"), type_.alias("type"), content.alias("content"), F.when(F.coalesce(ack, F.lit("")) != "", F.array(ack)).otherwise(empty).alias("acknowledgements"), files.alias("files"), hashes.alias("hashes"), topic.alias("topic"), licenses.alias("licenses"), *[(F.col(f"r.{g}.{f}") if kind == "package" else text).alias(f) for f, g in COMPONENT_FIELDS.items()])

    out = rows(roots, "Component", "package", F.lit(0), F.nullif(F.col("component"), F.lit("")), name=F.coalesce(F.col("r.GeneralInformation.ComponentName"), F.col("r._component")))
    have = roots.filter("component <> ''")
    content_id = lambda c: fx.text_identity(fx.norm_cdata(c))
    lic = have.select(*INPUT, "root_ord", "component", F.posexplode("r.License").alias("ord", "x"))
    out = out.unionByName(rows(lic, "License", "license_text", F.col("ord"), content_id("x.Content"), F.col("x._name"), F.col("x._type"), F.coalesce(F.col("x.Content"), F.lit("")), F.col("x.Acknowledgements"), fx.split_list("x.Files"), fx.split_hashes("x.FileHash")))
    for section in ("Copyright", "ExportRestrictions", "Patents"):
        one = have.select(*INPUT, "root_ord", "component", F.posexplode(f"r.{section}").alias("ord", "x"))
        out = out.unionByName(rows(one, section, "stanza", F.col("ord"), content_id("x.Content"), content=F.coalesce(F.col("x.Content"), F.lit(""))))
    ob = have.select(*INPUT, "root_ord", "component", F.posexplode("r.Obligation").alias("ord", "x"))
    names = F.coalesce(F.col("x.Licenses.License"), empty)
    return out.unionByName(rows(ob, "Obligation", "stanza", F.col("ord"), fx.obligation_identity("x.Topic", "x.Text", names), content=F.col("x.Text"), topic=F.col("x.Topic"), licenses=names))


def regroup_components(merged: DataFrame) -> DataFrame:
    """Per set and component its children in order, and whether a licence of it has acknowledgements. A licence that
    two components share is a child of both."""
    child = F.struct("entry_ord", "section", "name", "type", "content", "acknowledgements", "files", "hashes", "topic", "licenses")
    kids = F.array_sort(F.collect_list(F.when(F.col("kind") != "package", child)))
    ack = F.bool_or((F.col("section") == "License") & (F.size("acknowledgements") > 0))
    own = lambda c: (F.max(F.when(F.col("kind") == "package", F.col(c))) if c in merged.columns else F.max(F.lit(None).cast("string"))).alias(c)
    return merged.groupBy("set_id", "component").agg(own("name"), *[own(f) for f in COMPONENT_FIELDS], kids.alias("children"), F.coalesce(ack, F.lit(False)).alias("includes_acknowledgements"))


def _xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _xml_attr(name: str, c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(F.lit(f' {name}="'), _xml_escape(c), F.lit('"'))).otherwise("")


def _root_head() -> Column:
    """A root's start tag and the sections that are about the component."""
    def general(group):
        fields = F.concat(*[F.when(F.col(f).isNotNull(), F.concat(F.lit(f"<{f}>"), _xml_escape(F.col(f)), F.lit(f"</{f}>"))).otherwise("") for f, g in COMPONENT_FIELDS.items() if g == group])
        return F.when(fields != "", F.concat(F.lit(f"<{group}>"), fields, F.lit(f"</{group}>"))).otherwise("")

    return F.concat(
        F.lit(f"<{ROOT}"), _xml_attr("component", F.col("name")), _xml_attr("componentSHA1", F.col("component")),
        F.when(F.col("includes_acknowledgements"), ' includesAcknowledgements="true"').otherwise(""), F.lit(">"), *[general(g) for g in dict.fromkeys(COMPONENT_FIELDS.values())],
    )


def _root_child(x) -> Column:
    """The element of a child x: a struct, or a function from names to columns."""
    tag = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"<{name}>"), fx.escape_cdata(c), F.lit(f"</{name}>"))).otherwise("")
    licenses = F.when(F.size(x["licenses"]) > 0, F.concat(F.lit("<Licenses>"), F.array_join(F.transform(x["licenses"], lambda n: F.concat(F.lit("<License>"), _xml_escape(n), F.lit("</License>"))), ""), F.lit("</Licenses>"))).otherwise("")
    body = F.when(x["section"] == "Obligation", F.concat(tag("Topic", x["topic"]), tag("Text", x["content"]), licenses)).otherwise(F.concat(F.lit("<Content>"), fx.escape_cdata(x["content"]), F.lit("</Content>"), tag("Acknowledgements", F.array_join(x["acknowledgements"], "\n")), tag("Files", F.array_join(x["files"], "\n")), tag("FileHash", F.array_join(x["hashes"], "\n"))))
    return F.concat(F.lit("<"), x["section"], _xml_attr("type", x["type"]), _xml_attr("name", x["name"]), F.lit(">"), body, F.lit("</"), x["section"], F.lit(">"))


_DECLARATION = '<?xml version="1.0" encoding="UTF-8"?>'


def render_clixml(components: DataFrame) -> DataFrame:
    """One text per set: a declaration and a root per component of regroup_components."""
    root = F.concat(F.lit(f"{_DECLARATION}\n"), _root_head(), F.array_join(F.transform("children", _root_child), ""), F.lit(f"</{ROOT}>\n"))
    rows = components.withColumn("_x", root).groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("component", "_x"))).alias("_r"))
    return rows.select("set_id", F.array_join(F.transform("_r", lambda r: r["_x"]), "").alias("text"))


def clixml_pieces(merged: DataFrame) -> DataFrame:
    """Merged entries as roots of which head, children and end are pieces: no component is gathered."""
    ack = F.coalesce(F.bool_or((F.col("section") == "License") & (F.size("acknowledgements") > 0)), F.lit(False))
    own = [F.max(F.when(F.col("kind") == "package", F.col(c))).alias(c) for c in ("name", *COMPONENT_FIELDS)]
    roots = merged.groupBy("set_id", "component").agg(*own, ack.alias("includes_acknowledgements"))
    at = lambda n, o: F.struct(F.col("component"), F.lit(n).alias("n"), o.alias("at"))
    nowhere = _nowhere(merged)
    head = _piece(roots, 0, F.array(F.lit(_DECLARATION), _root_head()), at(0, nowhere))
    kids = merged.filter("kind <> 'package'")
    child = _root_child({c: F.col(c) for c in ("section", "name", "type", "content", "acknowledgements", "files", "hashes", "topic", "licenses")})
    return head.unionByName(_piece(kids, 0, F.array(child), at(1, F.col("ord")), _tie(kids))).unionByName(_piece(roots, 0, _array(f"</{ROOT}>"), at(2, nowhere)))


# --- tag-value text ---------------------------------------------------------------------------------------------

TAGS_ONCE = ["PackageName", "SPDXID", "PackageVersion", "PackageCopyrightText", "PackageLicenseConcluded", "PackageLicenseDeclared", "FileName", "LicenseConcluded", "LicenseID", "LicenseName", "ExtractedText"]
TAGS_MANY = ["LicenseInfoInFile", "Creator", "PackageChecksum", "FileChecksum", "ExternalRef"]
#: Of these fields the values are licence expressions, which may hold references to licence texts.
EXPRESSIONS = ["PackageLicenseConcluded", "PackageLicenseDeclared", "LicenseConcluded", "LicenseInfoInFile"]


def tagvalue_sections(texts: DataFrame) -> DataFrame:
    """Tags with the section that they stand in: (input, line_no, section, kind, tag, value). A section starts at
    ##Package, ##File, LicenseID, or a PackageName outside a package; before the first it is the document's."""
    return _tagvalue_sections(sc.fold_text_blocks(_lines(texts), INPUT))


def _tagvalue_sections(rows: DataFrame, split: str | None = None) -> DataFrame:
    bare = F.trim("line")
    opened = F.when(bare == "##Package", "package").when(bare.startswith("##File"), "file").when(bare.startswith("LicenseID:"), "license_text").when(bare.rlike("^## License Information"), "none")
    rows = sc.running(rows.withColumn("_open", opened), INPUT, lasts={"_before": F.col("_open")}, split=split, before=True)
    rows = stash(rows, "tag-value-lines") if split else rows
    # An implicit package also starts at a second PackageName after another section.
    implicit = bare.startswith("PackageName:") & (F.coalesce("_before", F.lit("document")) != "package")
    rows = rows.withColumn("_open", F.when(implicit, "package").otherwise(F.col("_open")))
    rows = sc.running(rows, INPUT, {"section": F.when(F.col("_open").isNotNull(), 1).otherwise(0)}, {"kind": F.col("_open")}, split)
    return sc.key_values(rows.withColumn("kind", F.coalesce("kind", F.lit("document")))).select(*INPUT, "line_no", "section", "kind", "tag", "value")


def entries_from_tagvalue(texts: DataFrame) -> DataFrame:
    """Packages, files and licence texts with their tags, checksums as a map, identity_key and ref. Tags that have no
    column of their own are in tags, an array of (tag, values); external references are a list."""
    return entries_of_tagvalue_rows(tagvalue_rows(texts)).drop("_known")


def tagvalue_rows(texts: DataFrame) -> DataFrame:
    """What tag-value reports hold, each read whole by one task in one pass (tagvalue.parse): a row for each entry and
    for each relationship, from which the two functions below make tables. To be written where both are wanted."""
    rows = texts.filter("text is not null").select(*INPUT, "text")
    fields = [*rows.schema.fields[:3], *StructType.fromDDL(tagvalue.row_schema(TAGS_ONCE, TAGS_MANY)).fields]
    once, many = list(TAGS_ONCE), list(TAGS_MANY)
    return rows.mapInArrow(lambda batches: tagvalue.parse(batches, once, many, EXPRESSIONS), StructType(fields))


def entries_of_tagvalue_rows(rows: DataFrame) -> DataFrame:
    """entries_from_tagvalue of tagvalue_rows, and _known, an entry's references that its report declares."""
    return _identified(rows.filter("kind <> 'relationship'").drop("src", "type", "dst").withColumnRenamed("ExternalRef", "externalRefs"))


def relationships_of_tagvalue_rows(rows: DataFrame) -> DataFrame:
    """relationships_from_tagvalue of tagvalue_rows, and _known, those of both ends that their report declares."""
    return rows.filter("kind = 'relationship'").select(*INPUT, F.col("section").cast("int").alias("rel_ord"), "src", "type", "dst", "_known")


def entries_from_tagvalue_lines(lines: DataFrame) -> DataFrame:
    """The same of reports.report_lines(...): a report of any size is parsed by as many tasks as it has splits; only an
    entry, and a value from <text> to </text>, must fit a row."""
    rows = sc.fold_split_blocks(lines.select(*INPUT, "split", "line_no", "line"), INPUT, "split")
    return _tagvalue_entries(_tagvalue_sections(rows, "split"))


def _tagvalue_entries(sections: DataFrame) -> DataFrame:
    kv = sections.filter("kind in ('package', 'file', 'license_text') and tag <> 'Relationship'")
    key = [*INPUT, "section", "kind"]
    other = ~F.col("tag").isin(*TAGS_ONCE, *TAGS_MANY)
    rest = F.array_sort(F.collect_list(F.when(other, F.struct("line_no", "tag", "value")))).alias("_rest")
    names = F.array_distinct(F.transform("_rest", lambda x: x["tag"]))
    tags = F.transform(names, lambda n: F.struct(n.alias("tag"), F.transform(F.filter("_rest", lambda x: x["tag"] == n), lambda x: x["value"]).alias("values")))
    rows = sc.gather_tags(kv, key, TAGS_ONCE, TAGS_MANY, more=[rest]).withColumn("tags", tags).drop("_rest").withColumnRenamed("ExternalRef", "externalRefs")
    return _identified(rows)


def _identified(rows: DataFrame) -> DataFrame:
    sums = F.filter(F.transform(F.concat("PackageChecksum", "FileChecksum"), lambda c: F.struct(F.trim(F.substring_index(c, ":", 1)).alias("k"), F.trim(F.substring(c, F.instr(c, ":") + 1, F.length(c))).alias("v"))), lambda x: x["k"] != "")
    rows = rows.withColumn("checksums", F.map_from_entries(F.array_distinct(sums)))
    identity = F.when(F.col("kind") == "license_text", fx.text_identity(F.coalesce("ExtractedText", F.lit("")))).otherwise(fx.checksum_map_identity("checksums"))
    return rows.withColumn("identity_key", identity).withColumn("ref", F.coalesce("SPDXID", "LicenseID")).withColumnRenamed("section", "entry_ord").drop("PackageChecksum", "FileChecksum")


def relationships_from_tagvalue(texts: DataFrame) -> DataFrame:
    """(input, rel_ord, src, type, dst); lines of fewer than three words are left to checks.malformed_lines."""
    return relationships_from_tagvalue_lines(_lines(texts))


def relationships_from_tagvalue_lines(lines: DataFrame) -> DataFrame:
    """The same of reports.report_lines(...)."""
    rows = sc.key_values(lines).filter("tag = 'Relationship'").withColumn("w", F.split("value", " ")).filter("size(w) >= 3")
    return rows.select(*INPUT, F.col("line_no").alias("rel_ord"), F.get("w", F.lit(0)).alias("src"), F.get("w", F.lit(1)).alias("type"), F.get("w", F.lit(2)).alias("dst"))


def render_tagvalue(documents: DataFrame, relationships: DataFrame, entries: DataFrame) -> DataFrame:
    """documents(set_id, tags array<struct<tag,value>>), relationships(set_id, src, type, dst) and merged entries
    (set_id, ord, kind, tags of entries_from_tagvalue) as one text per set."""
    return _emit(tagvalue_pieces(documents, relationships, entries))


def tagvalue_pieces(documents: DataFrame, relationships: DataFrame, entries: DataFrame) -> DataFrame:
    """The same in pieces: a relationship or an entry each."""
    nowhere = _nowhere(entries)
    head = _piece(documents, 0, F.concat(F.transform(F.filter("tags", lambda t: t["value"] != ""), lambda t: F.concat_ws(": ", t["tag"], t["value"])), _array("")), nowhere)
    line = F.concat_ws(" ", F.lit("Relationship:"), "src", "type", "dst")
    rel = _piece(relationships, 1, F.array(line), nowhere, line).unionByName(_piece(relationships.select("set_id").distinct(), 2, _array(""), nowhere))
    part = F.when(F.col("kind") == "package", 3).when(F.col("kind") == "file", 4).otherwise(6)
    mark = F.when(F.col("kind") == "package", _array("##Package", "")).when(F.col("kind") == "file", _array("##File", "")).otherwise(F.array().cast("array<string>"))
    sums = F.transform(F.array_sort(F.map_entries("checksums")), lambda x: F.concat(F.when(F.col("kind") == "package", "PackageChecksum: ").otherwise("FileChecksum: "), x["key"], F.lit(": "), x["value"]))
    sums = F.coalesce(sums, F.array().cast("array<string>"))
    many = [_pairs(t, F.col(c)) for t, c in (("LicenseInfoInFile", "LicenseInfoInFile"), ("Creator", "Creator"), ("ExternalRef", "externalRefs")) if c in entries.columns]
    if "tags" in entries.columns:
        pair = lambda t: F.transform(F.filter(t["values"], lambda v: v != ""), lambda v: F.concat(t["tag"], F.lit(": "), v))
        many.append(F.flatten(F.transform(F.coalesce("tags", F.array().cast("array<struct<tag:string,values:array<string>>>")), pair)))
    body = F.concat(mark, *[_pair(t, F.col(t)) for t in TAGS_ONCE if t in entries.columns], *many, sums, _array(""))
    rows = _piece(entries, part, body, F.col("ord"), _tie(entries))
    rule = "##-------------------------"
    title = _piece(entries.filter("kind = 'license_text'").select("set_id").distinct(), 5, _array(rule, "## License Information", rule, ""), nowhere)
    return head.unionByName(rel).unionByName(rows).unionByName(title)


# --- Debian copyright text --------------------------------------------------------------------------------------

HEADER_FIELDS = ["Format", "Upstream-Name", "Disclaimer", "Comment"]


def _dep5_sections(texts: DataFrame) -> DataFrame:
    rows = _lines(texts)
    starts = F.col("line").rlike(r"^\s*Files:")
    blank = F.trim("line") == ""
    w = Window.partitionBy(*INPUT).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    # A paragraph of its own: License: at the start of a line that no Files stanza holds.
    last = F.last(F.when(starts, "files").when(blank, "none"), ignorenulls=True).over(w)
    rows = rows.withColumn("_in", F.coalesce(last, F.lit("none")))
    opened = F.when(starts, "stanza").when(F.col("line").startswith("License:") & (F.col("_in") == "none"), "license_text")
    rows = sc.number_sections(rows.withColumn("_open", opened), INPUT, F.col("_open").isNotNull())
    kind = F.first("_open", ignorenulls=True).over(Window.partitionBy(*INPUT, "section"))
    return rows.withColumn("kind", F.coalesce(kind, F.lit("header"))).drop("_open", "_in")


def header_from_dep5(texts: DataFrame) -> DataFrame:
    rows = sc.fold_text_blocks(_dep5_sections(texts).filter("kind = 'header'"), INPUT)
    kv = sc.key_values(sc.fold_comment_blocks(rows, INPUT)).filter(F.col("tag").isin(*HEADER_FIELDS))
    return sc.gather_tags(kv, INPUT, HEADER_FIELDS)


def entries_from_dep5(texts: DataFrame) -> DataFrame:
    """(input, entry_ord, kind, identity_key, files, copyright, license, comment, name, text). Continuation lines of a
    licence text lose their blank, a lone ` .` is an empty line and ` ..` a line that begins with a dot."""
    rows = _dep5_sections(texts)
    stanza = rows.filter("kind = 'stanza' and trim(line) <> ''")
    paths = F.when(F.col("line").rlike("^( {7}|\t)"), F.trim(F.col("line"))).when(F.col("line").rlike(r"^\s*Files:"), F.trim(F.regexp_extract("line", r"Files:\s*(.*)$", 1)))
    files = F.transform(F.array_sort(F.collect_list(F.when(F.coalesce(paths, F.lit("")) != "", F.struct("line_no", paths.alias("p"))))), lambda x: x["p"])
    lists = stanza.groupBy(*INPUT, "section").agg(files.alias("files"))
    kv = sc.key_values(sc.fold_comment_blocks(stanza.filter(~F.col("line").rlike("^( {7}|\t)")).select(*INPUT, "section", "line_no", "line"), [*INPUT, "section"]))
    tags = sc.gather_tags(kv, [*INPUT, "section"], ["Copyright", "License", "Comment"])
    stanzas = lists.join(tags, [*INPUT, "section"], "left")
    none = F.lit(None).cast("string")
    stanzas = stanzas.select(*INPUT, F.col("section").alias("entry_ord"), F.lit("stanza").alias("kind"), fx.stanza_identity("License", "files").alias("identity_key"), "files", F.col("Copyright").alias("copyright"), F.col("License").alias("license"), F.col("Comment").alias("comment"), none.alias("name"), none.alias("text"))
    first = F.min("line_no").over(Window.partitionBy(*INPUT, "section"))
    body = rows.filter("kind = 'license_text'").withColumn("_first", first)
    plain = F.regexp_replace("line", "^[ \t]+", "")
    body = body.withColumn("line", F.when(F.col("line_no") == F.col("_first"), F.col("line")).when(plain == ".", "").when(plain.startswith(".."), F.substring(plain, 2, 1 << 30)).otherwise(plain))
    name = F.max(F.when(F.col("line_no") == F.col("_first"), F.trim(F.regexp_extract("line", r"License:\s*(.*)$", 1))))
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("line_no") > F.col("_first"), F.struct("line_no", "line")))), lambda x: x["line"])
    lic = body.groupBy(*INPUT, "section").agg(name.alias("name"), F.trim(F.array_join(lines, "\n"), F.lit("\n ")).alias("text"))
    lic = lic.select(*INPUT, F.col("section").alias("entry_ord"), F.lit("license_text").alias("kind"), fx.text_identity("text").alias("identity_key"), F.array().cast("array<string>").alias("files"), none.alias("copyright"), none.alias("license"), none.alias("comment"), "name", "text")
    return stanzas.unionByName(lic)


def _continued(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), lambda x: F.when(x == "", " .").when(x.startswith("."), F.concat(F.lit(" ."), x)).otherwise(F.concat(F.lit(" "), x)))


def render_dep5(headers: DataFrame, entries: DataFrame) -> DataFrame:
    """headers(set_id, HEADER_FIELDS) and merged entries (set_id, ord, ...) as one text per set."""
    return _emit(dep5_pieces(headers, entries))


def dep5_pieces(headers: DataFrame, entries: DataFrame) -> DataFrame:
    """The same in pieces: an entry each."""
    def block(tag: str, value: Column) -> Column:
        rest = F.slice(_continued(value), 2, F.greatest(F.size(F.split(value, "\n", -1)) - 1, F.lit(0)))
        return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.concat(F.array(F.concat(F.lit(f"{tag}: "), F.substring_index(value, "\n", 1))), rest))

    head = _piece(headers, 0, F.concat(*[block(f, F.col(f"`{f}`")) for f in HEADER_FIELDS], _array("")), _nowhere(entries))
    paths = F.transform("files", lambda f, i: F.concat(F.when(i == 0, "Files: ").otherwise("       "), f))
    stanza = F.concat(paths, block("Copyright", F.col("copyright")), block("License", F.col("license")), block("Comment", F.col("comment")), _array(""))
    text = F.when(F.coalesce("text", F.lit("")) != "", _continued(F.col("text"))).otherwise(F.array().cast("array<string>"))
    lic = F.concat(F.array(F.concat(F.lit("License: "), F.coalesce("name", F.lit("")))), text, _array(""))
    rows = _piece(entries, F.when(F.col("kind") == "stanza", 1).otherwise(2), F.when(F.col("kind") == "stanza", stanza).otherwise(lic), F.col("ord"), _tie(entries))
    return head.unionByName(rows)


def glob_overlaps(stanzas: DataFrame) -> DataFrame:
    """(set_id, path, chosen, values): file paths that stanzas give different licences. Expressions are compared with
    that of the path's first holder (by source and place); chosen is the smaller one."""
    rows = stanzas.filter("kind = 'stanza' and license is not null").select("set_id", "source_id", "entry_ord", "license", F.explode("files").alias("path"))
    w = Window.partitionBy("set_id", "path").orderBy("source_id", "entry_ord", "license")
    rows = rows.withColumn("_l", F.first("license").over(w)).withColumn("_s", F.first("source_id").over(w)).filter("license <> _l")
    pair = lambda s, v: F.struct(F.col(s).alias("source"), F.col(v).alias("value"))
    return rows.select("set_id", "path", F.least("_l", "license").alias("chosen"), F.array(pair("_s", "_l"), pair("source_id", "license")).alias("values")).distinct()


# --- notice text ------------------------------------------------------------------------------------------------

WIDTH = 120
SECTION_ORDER = ["MAIN LICENSES", "OTHER LICENSES", "ACKNOWLEDGEMENTS"]
COPYRIGHT_MARK, NOTICES_MARK = "<Copyright notices>", "<notices>"


def _notice_lines(texts: DataFrame, least: int = 3) -> DataFrame:
    """Lines with the number of the major rule before them (0, 1 the header, then sections) and of the minor rule in
    it, and whether the footer has begun. A separator is `least` or more of one sign."""
    rows = _lines(texts)
    major, minor = F.trim("line").rlike(f"^={{{least},}}$"), F.trim("line").rlike(f"^-{{{least},}}$")
    rows = sc.number_sections(rows, INPUT, major, "section")
    rows = sc.number_sections(rows, [*INPUT, "section"], minor, "block")
    footer = F.trim("line").isin(COPYRIGHT_MARK, NOTICES_MARK)
    rows = sc.number_sections(rows, INPUT, footer, "footer")
    return rows.withColumn("rule", major | minor)


def header_from_notice(texts: DataFrame) -> DataFrame:
    """(input, package_name): the first line that isn't blank after the first major rule."""
    rows = _notice_lines(texts).filter("section = 1 and block = 0 and not rule and trim(line) <> ''")
    return rows.groupBy(*INPUT).agg(F.trim(F.min_by("line", "line_no")).alias("package_name"))


def footer_from_notice(texts: DataFrame) -> DataFrame:
    """(input, copyright_notices, notices): what stands under the two marks, or the mark itself."""
    rows = _notice_lines(texts).filter("footer > 0 and not rule")
    mark = F.first(F.when(F.trim("line").isin(COPYRIGHT_MARK, NOTICES_MARK), F.trim(F.col("line"))), ignorenulls=True).over(Window.partitionBy(*INPUT, "footer"))
    rows = rows.withColumn("_mark", mark).filter(~F.trim("line").isin(COPYRIGHT_MARK, NOTICES_MARK))
    under = lambda m, name: F.coalesce(F.nullif(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_mark") == m, F.struct("line_no", "line")))), lambda x: x["line"]), "\n"), F.lit("\n ")), F.lit("")), F.lit(m)).alias(name)
    return rows.groupBy(*INPUT).agg(under(COPYRIGHT_MARK, "copyright_notices"), under(NOTICES_MARK, "notices"))


def entries_from_notice(texts: DataFrame, least: int = 3) -> DataFrame:
    """(input, entry_ord, kind, section, name, text, identity_key): blocks of the sections. A section begins with its
    name and a minor rule; a block with its name, up to the next rule or the footer."""
    rows = _notice_lines(texts, least).filter("section >= 2 and footer = 0 and not rule")
    titles = rows.filter("block = 0 and trim(line) <> ''").groupBy(*INPUT, "section").agg(F.trim(F.min_by("line", "line_no")).alias("title"))
    body = rows.filter("block > 0")
    first = F.min(F.when(F.trim("line") != "", F.col("line_no"))).over(Window.partitionBy(*INPUT, "section", "block"))
    body = body.withColumn("_first", first).filter("_first is not null")
    text = F.transform(F.array_sort(F.collect_list(F.when(F.col("line_no") > F.col("_first"), F.struct("line_no", "line")))), lambda x: x["line"])
    name = F.max(F.when(F.col("line_no") == F.col("_first"), F.trim("line")))
    blocks = body.groupBy(*INPUT, "section", "block").agg(name.alias("name"), F.trim(F.array_join(text, "\n"), F.lit("\n ")).alias("text"))
    out = blocks.join(titles, [*INPUT, "section"], "left")
    return out.select(*INPUT, F.struct("section", "block").alias("entry_ord"), F.lit("license_text").alias("kind"), F.coalesce("title", F.lit("")).alias("section"), "name", "text", fx.text_identity(fx.strip_export_prefix("text")).alias("identity_key"))


def ordered_sections(blocks: DataFrame, order: list[str] = SECTION_ORDER) -> DataFrame:
    """blocks with section_first, the least ord of their section, and section_rank: the known sections first, in order,
    the others by their first block."""
    known = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("section"))
    rows = join_keys(blocks, blocks.groupBy("set_id", "section").agg(F.min("ord").alias("section_first")), ["set_id", "section"])
    return rows.withColumn("section_rank", F.struct(F.when(known > 0, known).otherwise(len(order) + 1).alias("known"), F.when(known > 0, F.lit(None)).otherwise(F.col("section_first")).alias("first")))


def render_notice(headers: DataFrame, blocks: DataFrame, footers: DataFrame | None = None) -> DataFrame:
    """headers(set_id, package_name), blocks(set_id, ord, section, name, text), footers(set_id, copyright_notices,
    notices) as one text per set."""
    return _emit(notice_pieces(headers, blocks, footers))


def notice_pieces(headers: DataFrame, blocks: DataFrame, footers: DataFrame | None = None) -> DataFrame:
    """The same in pieces: a block each."""
    major, minor = "=" * WIDTH, "-" * WIDTH
    ranked = ordered_sections(blocks)
    title = F.concat(F.array(F.lit(major), F.lit(""), F.concat(F.lit(" "), F.col("section"), F.lit(" ")), F.lit(""), F.lit(minor), F.lit("")))
    text = F.when(F.coalesce("text", F.lit("")) != "", F.split("text", "\n", -1)).otherwise(F.array().cast("array<string>"))
    lines = F.concat(F.when(F.col("ord") == F.col("section_first"), title).otherwise(_array(minor, "")), F.array(F.col("name"), F.lit("")), text, _array(""))
    body = _piece(ranked, F.col("section_rank.known"), lines, F.struct(F.col("section_rank.first").alias("first"), F.col("ord").alias("own")), _tie(ranked))
    nowhere = _nowhere(body)
    head = _piece(headers, 0, F.array(F.lit(major), F.lit(""), F.coalesce("package_name", F.lit("")), F.lit(""), F.lit(minor), F.lit("")), nowhere)
    ends = headers.select("set_id") if footers is None else footers
    value = lambda c, mark: F.array().cast("array<string>") if footers is None else F.when(F.col(c).isin("", mark), F.array().cast("array<string>")).otherwise(F.split(c, "\n", -1))
    foot = _piece(ends, len(SECTION_ORDER) + 2, F.concat(_array(minor, "", COPYRIGHT_MARK), value("copyright_notices", COPYRIGHT_MARK), _array("", NOTICES_MARK), value("notices", NOTICES_MARK), _array("")), nowhere)
    return head.unionByName(body).unionByName(foot)


def violations(texts: DataFrame, entries: DataFrame, format: str) -> dict[str, DataFrame]:
    """What breaks a format's own rules, by rule: wrong headers, components without name or type, nodes without a type,
    malformed lines, fields that a stanza may not have, references that an input declares twice."""
    out = {}
    if format in ("cyclonedx", "spdx2tv", "spdx3json"):
        out["duplicate_refs"] = checks.duplicate_refs(entries, "ref")
    if format == "cyclonedx":
        out["headers"] = checks.required_fields(cyclonedx_headers(texts), [], {"bomFormat": "CycloneDX", "specVersion": "1.4"})
        out["components"] = checks.required_fields(entries, ["name", "type"]).select(*INPUT, "ref", "field")
    elif format == "spdx3json":
        out["nodes"] = checks.required_fields(nodes_from_spdx3(texts), ["type"]).select(*INPUT, "node_ord", "field")
    elif format == "spdx2tv":
        out["lines"] = checks.malformed_lines(_lines(texts))
    elif format == "dep5":
        out["fields"] = checks.unknown_stanza_fields(_dep5_sections(texts).filter("kind = 'stanza'"))
    return out


#: Parsers by format; register_format adds others.
PARSERS = {"cyclonedx": entries_from_cyclonedx, "spdx3json": entries_from_spdx3, "clixml": entries_from_clixml, "spdx2tv": entries_from_tagvalue, "dep5": entries_from_dep5, "readmeoss": entries_from_notice}
CONFLICT_HOOKS = {"dep5": glob_overlaps}


def register_format(name: str, parser, conflicts=None) -> None:
    """Add a format: a function from texts to entries, and optionally one from entries to conflicts."""
    PARSERS[name] = parser
    if conflicts:
        CONFLICT_HOOKS[name] = conflicts
