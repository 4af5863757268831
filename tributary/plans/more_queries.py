"""More queries of the merge library: one-call merges, edits, sources and the functions that the others do not reach."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions import text as fx
from tributary.operators import catalog as cat
from tributary.operators import checks, edits, lines, merge, refs, text_index, tree
from tributary.operators.large_edits import apply_large_edits
from tributary.plans.merge import merge as merge_files
from tributary.plans.merge import merge_texts
from tributary.plans.queries import _BODY, _CATALOG, _ORDER, ITEMS, _PAIRS, _bodies, _catalog, _event_edits, _join, _order_docs, _pairs, _t, item_entries, query, text_entries
from tributary.plans.scratch import folder, stash
from tributary.sources import formats, report_files, reports, sections
from tributary.streaming.merge_stream import GraphTable, remerge

# --- whole merges: every order is a report of its customer -------------------------------------------------------


def _order_reports(spark, sf_dir: str) -> DataFrame:
    """Orders with their number within the customer and their parts, one per line number."""
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    li = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p_partkey"))
    li = li.join(_t(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")
    own = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_partkey", "p_name"))).alias("parts"))  # a few lines each
    return o.withColumn("n", nth).join(own, F.col("l_orderkey") == F.col("o_orderkey"))


_REPORTS = """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders),
i AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p_partkey FROM lineitem GROUP BY 1, 2),
f AS (SELECT o_custkey AS set_id, n, l_linenumber AS k, p_partkey, p_name, o_orderpriority AS lic, o_orderstatus AS status, sha1(CAST(p_partkey AS VARCHAR)) AS id FROM i JOIN o ON o_orderkey = l_orderkey JOIN part USING (p_partkey)),
g AS (SELECT DISTINCT set_id, n, lic, status FROM f) """


def _tag_texts(spark, sf_dir: str) -> DataFrame:
    """Every input calls its package, its files and its licence by the same names."""
    part = lambda p: F.concat(F.lit("##File\n\nFileName: "), p["p_name"], F.lit("\nSPDXID: SPDXRef-f"), p["l_linenumber"].cast("string"), F.lit("\nFileChecksum: SHA1: "), F.upper(F.sha1(p["p_partkey"].cast("string"))), F.lit("\nLicenseConcluded: LicenseRef-A OR Zlib\nLicenseInfoInFile: LicenseRef-A\nFileComment: line "), p["l_linenumber"].cast("string"), F.lit("\n\n"))
    edge = lambda p: F.concat(F.lit("Relationship: SPDXRef-p CONTAINS SPDXRef-f"), p["l_linenumber"].cast("string"), F.lit("\n"))
    text = F.concat(
        F.lit("SPDXVersion: SPDX-2.3\n"), F.array_join(F.transform("parts", edge), ""), F.lit("\n##Package\n\nPackageName: "), F.col("o_orderstatus"), F.lit("\nSPDXID: SPDXRef-p\nPackageChecksum: SHA1: "), F.sha1(F.col("o_orderkey").cast("string")), F.lit("\n\n"),
        F.array_join(F.transform("parts", part), ""), F.lit("LicenseID: LicenseRef-A\nLicenseName: name "), F.col("n").cast("string"), F.lit("\nExtractedText: <text>"), F.col("o_orderpriority"), F.lit("</text>\n"),
    )
    return _order_reports(spark, sf_dir).select(F.col("o_custkey").alias("set_id"), F.col("n").alias("input_index"), F.concat(F.lit("in"), F.col("n").cast("string")).alias("source_id"), text.alias("text"))


def _tag_merge(spark, sf_dir: str) -> dict[str, DataFrame]:
    return merge_texts(_tag_texts(spark, sf_dir), "spdx2tv", folder(spark, "merge-tagvalue"))


_FILES = _REPORTS + """, l AS (SELECT set_id, lic, max(n) AS last FROM g GROUP BY 1, 2),
m AS (SELECT set_id, id, count(*) AS n_entries, min(row(n, k)) AS first FROM f GROUP BY 1, 2),
w AS (SELECT m.*, f.lic, p_name, 'input' || last || '-LicenseRef-A' AS first_ref FROM m JOIN f ON f.set_id = m.set_id AND f.id = m.id AND row(f.n, f.k) = m.first JOIN l ON l.set_id = m.set_id AND l.lic = f.lic),
r AS (SELECT f.set_id, f.id, array_to_string(list_sort(list(DISTINCT 'input' || last || '-LicenseRef-A')), '|') AS licenses FROM f JOIN l USING (set_id, lic) GROUP BY 1, 2) """


@query(_FILES + """SELECT w.set_id, w.id AS identity_key, n_entries, 'SPDXRef-input' || first[1] || '-f' || first[2] AS ref, p_name AS name, first_ref || ' OR Zlib' AS concluded, licenses, 'line ' || first[2] AS comment FROM w JOIN r ON r.set_id = w.set_id AND r.id = w.id""")
def merge_tagvalue_files(spark, sf_dir):
    """Files that reports of a customer share; their licence expressions name the merged licence texts."""
    m = _tag_merge(spark, sf_dir)["merged"].filter("kind = 'file'")
    comment = F.get(F.get(F.filter("tags", lambda t: t["tag"] == "FileComment"), F.lit(0))["values"], F.lit(0))
    return m.select("set_id", "identity_key", "n_entries", "ref", F.col("FileName").alias("name"), F.col("LicenseConcluded").alias("concluded"), _join("LicenseInfoInFile").alias("licenses"), comment.alias("comment"))


@query(_REPORTS + """SELECT set_id, md5('<text>' || lic || '</text>') AS identity_key, 'input' || max(n) || '-LicenseRef-A' AS ref, 'name ' || max(n) AS name, count(*) AS n_entries FROM g GROUP BY 1, lic""")
def merge_tagvalue_licenses(spark, sf_dir):
    """Licence texts take the id and the name of their last writer."""
    m = _tag_merge(spark, sf_dir)["merged"].filter("kind = 'license_text'")
    return m.select("set_id", "identity_key", "ref", F.col("LicenseName").alias("name"), "n_entries")


@query(_REPORTS + """, w AS (SELECT set_id, id, min(row(n, k)) AS first FROM f GROUP BY 1, 2)
SELECT DISTINCT f.set_id, 'SPDXRef-input' || n || '-p' AS src, 'CONTAINS' AS type, 'SPDXRef-input' || first[1] || '-f' || first[2] AS dst FROM f JOIN w USING (set_id, id)
UNION ALL SELECT set_id, 'SPDXRef-DOCUMENT', 'DESCRIBES', 'SPDXRef-input' || n || '-p' FROM g""")
def merge_tagvalue_relationships(spark, sf_dir):
    """Relationships of all inputs at the merged entries; none of them, and no licence expression, dangles."""
    t = _tag_merge(spark, sf_dir)
    checks.assert_valid(dangling=t["dangling"])
    return t["relationships"].select("set_id", "src", "type", "dst")


@query(_FILES + """SELECT w.set_id, w.id AS identity_key, w.lic AS license_text FROM w""")
def merge_tagvalue_rendered(spark, sf_dir):
    """The merged reports, parsed again: each file with the text that its first licence reference names."""
    t = formats.entries_from_tagvalue(_tag_merge(spark, sf_dir)["reports"].select("set_id", F.lit(0).alias("input_index"), F.lit("m").alias("source_id"), "text"))
    licences = t.filter("kind = 'license_text'").select("set_id", F.col("LicenseID").alias("_id"), fx.strip_text_tag("ExtractedText").alias("license_text"))
    files = t.filter("kind = 'file'").select("set_id", "identity_key", F.substring_index("LicenseConcluded", " ", 1).alias("_id"))
    return files.join(licences, ["set_id", "_id"]).select("set_id", "identity_key", "license_text")


def _component_texts(spark, sf_dir: str) -> DataFrame:
    one = lambda kind, name, ref, digest, licence: F.struct(F.lit(kind).alias("type"), name.alias("name"), ref.alias("bom-ref"), F.array(F.struct(F.lit("SHA-1").alias("alg"), digest.alias("content"))).alias("hashes"), F.array(F.struct(F.struct(licence.alias("id")).alias("license"))).alias("licenses"))
    main = one("application", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), F.lit("top"), F.sha1(F.col("o_orderkey").cast("string")), F.lit("MIT"))
    parts = F.transform("parts", lambda p: one("file", p["p_name"], F.concat(F.lit("part"), p["l_linenumber"].cast("string")), F.sha1(p["p_partkey"].cast("string")), F.col("o_orderstatus")))
    doc = F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.4").alias("specVersion"), F.lit(1).alias("version"), F.struct(main.alias("component")).alias("metadata"), parts.alias("components")))
    return _order_reports(spark, sf_dir).select(F.col("o_custkey").alias("set_id"), F.col("n").alias("input_index"), F.concat(F.lit("in"), F.col("n").cast("string")).alias("source_id"), doc.alias("text"))


@query(_REPORTS + """, m AS (SELECT set_id, id, min(row(n, k)) AS first, array_to_string(list_sort(list(DISTINCT status)), '|') AS licenses FROM f GROUP BY 1, 2)
SELECT set_id, 'input' || first[1] || '-part' || first[2] AS ref, 'file' AS type, licenses, 'input' || first[1] || '-top' AS upload FROM m UNION ALL SELECT set_id, 'input' || n || '-top', 'library', 'MIT', NULL FROM g""")
def merge_components(spark, sf_dir):
    """Component reports that all use the same references, merged, rendered and read back with their properties."""
    out = merge_texts(_component_texts(spark, sf_dir), "cyclonedx", folder(spark, "merge-components"))["reports"]
    part = "struct<type:string,`bom-ref`:string,licenses:array<struct<license:struct<id:string>>>,properties:array<struct<name:string,value:string>>>"
    c = out.select("set_id", F.explode(F.from_json("text", f"components array<{part}>")["components"]).alias("c"))
    return c.select("set_id", F.col("c.bom-ref").alias("ref"), F.col("c.type").alias("type"), F.array_join(F.transform("c.licenses", lambda x: x["license"]["id"]), "|").alias("licenses"), F.get("c.properties", F.lit(0))["value"].alias("upload"))


@query(_REPORTS + """, m AS (SELECT set_id, id, min(row(n, k)) AS first FROM f GROUP BY 1, 2), e AS (SELECT f.set_id, f.n, f.k, 'urn:d#SPDXRef-input' || first[1] || '-f' || first[2] AS dst FROM f JOIN m USING (set_id, id))
SELECT set_id, 'urn:d#SPDXRef-input' || n || '-r' || k AS ref, 'urn:d#SPDXRef-input' || n || '-p' AS src, dst FROM e""")
def merge_nodes(spark, sf_dir):
    """Typed-node reports: relationships of all inputs at the merged nodes."""
    ref = lambda *x: F.concat(F.lit("urn:d#SPDXRef-"), *[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    checked = lambda d: F.array(F.struct(F.lit("sha1").alias("algorithm"), d.alias("hashValue"))).alias("verifiedUsing")
    files = F.transform("parts", lambda p: F.to_json(F.struct(F.lit(formats.FILE).alias("type"), ref("f", p["l_linenumber"]).alias("spdxId"), p["p_name"].alias("name"), checked(F.sha1(p["p_partkey"].cast("string"))))))
    rels = F.transform("parts", lambda p: F.to_json(F.struct(F.lit("Relationship").alias("type"), ref("r", p["l_linenumber"]).alias("spdxId"), ref("p").alias("from"), F.array(ref("f", p["l_linenumber"])).alias("to"))))
    package = F.to_json(F.struct(F.lit(formats.PACKAGE).alias("type"), ref("p").alias("spdxId"), F.col("o_orderstatus").alias("name"), checked(F.sha1(F.col("o_orderkey").cast("string")))))
    text = F.concat(F.lit("["), F.array_join(F.concat(F.array(package), files, rels), ","), F.lit("]"))
    texts = _order_reports(spark, sf_dir).select(F.col("o_custkey").alias("set_id"), F.col("n").alias("input_index"), F.lit("in").alias("source_id"), text.alias("text"))
    out = merge_texts(texts, "spdx3json", folder(spark, "merge-nodes"))["reports"].select("set_id", F.lit(0).alias("input_index"), F.lit("m").alias("source_id"), "text")
    return formats.nodes_from_spdx3(out).filter("type = 'Relationship'").select("set_id", F.col("node_id").alias("ref"), F.col("from_ref").alias("src"), F.get("to_refs", F.lit(0)).alias("dst"))


@query(_REPORTS + "SELECT set_id, 'urn:' || k AS node_id, count(*) AS n FROM f GROUP BY 1, k HAVING count(*) > 1")
def duplicate_nodes(spark, sf_dir):
    """Node ids that one array of nodes has more than once."""
    node = lambda p: F.to_json(F.struct(F.lit("x").alias("type"), F.concat(F.lit("urn:"), p["l_linenumber"].cast("string")).alias("spdxId")))
    rows = _order_reports(spark, sf_dir).groupBy(F.col("o_custkey").alias("set_id")).agg(F.flatten(F.collect_list(F.transform("parts", node))).alias("nodes"))
    texts = rows.select("set_id", F.lit(0).alias("input_index"), F.lit("in").alias("source_id"), F.concat(F.lit("["), F.array_join("nodes", ","), F.lit("]")).alias("text"))
    return checks.duplicate_refs(formats.nodes_from_spdx3(texts), "node_id").select("set_id", "node_id", "n")


_PROGRESS = ITEMS + """, d AS (SELECT identity_key, arg_max(status || '!', row(i, o)) AS status FROM e WHERE flags = 'R' GROUP BY 1)
SELECT identity_key, count(*) AS n_entries, coalesce(any_value(d.status), arg_min(e.status, row(i, o))) AS status, array_to_string(list_sort(list(DISTINCT flags)), '|') AS flags FROM e LEFT JOIN d USING (identity_key) GROUP BY 1"""


@query(_PROGRESS)
def remerge_replay(spark, sf_dir):
    """The first four inputs, then the others, merged anew, and a log of edits replayed on the result."""
    e = item_entries(spark, sf_dir)
    log = e.filter("flags = 'R'").select("identity_key", F.struct("input_index", "entry_ord").alias("seq"), F.lit("status").alias("field"), F.lit("replace").alias("op"), F.concat("status", F.lit("!")).alias("value"))
    merged, _ = remerge(e.filter("input_index <= 4"), e.filter("input_index > 4"), ["identity_key"], _ORDER, log, union=["flags"], first=["status"])
    return merged.select("identity_key", "n_entries", "status", _join("flags").alias("flags"))


@query(ITEMS + "SELECT source, count(*) AS n_entries, count(*) FILTER (WHERE i <= 3) AS n_status FROM e GROUP BY 1")
def collected_entries(spark, sf_dir):
    """Entries of inputs with different columns."""
    e = item_entries(spark, sf_dir)
    every = merge.collect_entries(e.filter("input_index <= 3"), e.filter("input_index > 3").drop("status"))
    return every.groupBy(F.col("source_id").alias("source")).agg(F.count(F.lit(1)).alias("n_entries"), F.count("status").alias("n_status"))


@query(ITEMS + """, f AS (SELECT identity_key, min(row(i, l_orderkey)) AS first FROM (SELECT concat_ws('-', l_partkey, l_suppkey) AS identity_key, l_linenumber AS i, l_orderkey FROM lineitem) GROUP BY 1),
r AS (SELECT DISTINCT concat_ws('-', l_partkey, l_suppkey) AS identity_key, l_orderkey, l_linenumber FROM lineitem)
SELECT DISTINCT 'o' || l_orderkey AS src, first[1] || '-' || first[2] || '-' || identity_key AS dst FROM r JOIN f USING (identity_key)""")
def redirected_arrivals(spark, sf_dir):
    """Items of orders arrive in three batches, those of the highest priority last; each order's relationships to them
    at the survivors of all."""
    li = _t(spark, sf_dir, "lineitem").select(F.lit("s").alias("set_id"), F.concat_ws("-", "l_partkey", "l_suppkey").alias("identity_key"), F.col("l_linenumber").alias("input_index"), F.col("l_orderkey").alias("entry_ord"), F.concat(F.lit("in"), "l_linenumber").alias("source_id"))
    e = li.withColumn("ref", F.concat_ws("-", "input_index", "entry_ord", "identity_key"))
    target = GraphTable(spark, folder(spark, "arriving-graph"), ["set_id", "identity_key"], ["input_index", "entry_ord"], fan_in=2)
    for n, some in enumerate(("input_index > 4", "input_index between 3 and 4", "input_index < 3")):
        own = e.filter(some)
        target.update(own, own.select("set_id", F.concat(F.lit("o"), "entry_ord").alias("src"), F.lit("CONTAINS").alias("type"), F.col("ref").alias("dst")), n)
        target.compact()
    return target.relationships().select("src", "dst")


# --- the one call, from files to merged tables ------------------------------------------------------------------

#: Documents by source and doc_id range, three files a set; texts repeat within and across files.
_FILED = r"""WITH b AS (SELECT 's' || regexp_replace(source, '[^A-Za-z0-9]', '_', 'g') || '-' || doc_id // 1280 AS name_, doc_id % 3 AS n, doc_id, 'n' || doc_id AS name, 'body ' || coalesce(lang, '-') || ' ' || n_chars % 9 AS text, 'f' || doc_id % 4 AS file FROM documents),
m AS (SELECT 'set=' || name_ AS set_id, text, arg_min(name, row(n, doc_id)) AS name, count(*) AS n_entries, array_to_string(list_sort(list(DISTINCT file)), '|') AS files FROM b GROUP BY 1, 2) """


def _merged_files(spark, sf_dir: str, format: str, head, one, end: str = "") -> DataFrame:
    """The table merged of one call of the merge over files of a format."""
    path = folder(spark, f"files-{format}")
    d = _t(spark, sf_dir, "documents")
    rows = d.select(F.concat(F.lit("s"), F.regexp_replace("source", "[^A-Za-z0-9]", "_"), F.lit("-"), F.floor(F.col("doc_id") / 1280).cast("string")).alias("set"), F.pmod("doc_id", F.lit(3)).alias("n"), "doc_id", F.concat(F.lit("n"), "doc_id").alias("name"), F.concat(F.lit("body "), F.coalesce("lang", F.lit("-")), F.lit(" "), F.pmod("n_chars", F.lit(9)).cast("string")).alias("text"), F.concat(F.lit("f"), F.pmod("doc_id", F.lit(4)).cast("string")).alias("file"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", one(rows).alias("t")))), lambda x: x["t"]), "")
    reports_ = rows.groupBy("set", "n").agg(F.concat(F.lit(head), parts, F.lit(end)).alias("value"))
    reports_.repartition("n", "set").write.partitionBy("n", "set").text(path)
    return merge_files(spark, f"{path}/*/*/*.txt", format=format, output=folder(spark, f"merged-{format}"))["merged"]


@query(_FILED + "SELECT set_id, text, name, n_entries FROM m")
def merge_dep5_files(spark, sf_dir):
    m = _merged_files(spark, sf_dir, "dep5", reports.DEBIAN_HEAD + "1.0/\nUpstream-Name: u\n", lambda r: F.concat(F.lit("\nLicense: "), "name", F.lit("\n "), "text", F.lit("\n")))
    return m.select("set_id", "text", "name", "n_entries")


@query(_FILED + "SELECT set_id, text, name, n_entries FROM m")
def merge_notice_files(spark, sf_dir):
    rule, thin = "=" * 120, "-" * 120
    m = _merged_files(spark, sf_dir, "readmeoss", f"{rule}\n\npkg\n\n{thin}\n\n{rule}\n\n MAIN LICENSES \n\n{thin}\n\n", lambda r: F.concat("name", F.lit("\n\n"), "text", F.lit(f"\n\n{thin}\n\n")), "<Copyright notices>\n(c)\n\n<notices>\n")
    return m.select("set_id", "text", "name", "n_entries")


@query(_FILED + "SELECT set_id, text, name, n_entries, files FROM m")
def merge_clixml_files(spark, sf_dir):
    one = lambda r: F.concat(F.lit('<License type="t" name="'), "name", F.lit('"><Content><![CDATA['), "text", F.lit("]]></Content><Files>"), "file", F.lit("</Files></License>"))
    m = _merged_files(spark, sf_dir, "clixml", '<ComponentLicenseInformation component="c" componentSHA1="AB">', one, "</ComponentLicenseInformation>")
    return m.filter("section = 'License'").select("set_id", F.col("content").alias("text"), "name", "n_entries", _join("files").alias("files"))


@query("SELECT format, field, policy FROM (VALUES " + ", ".join(f"('{f}', '{x}', '{k}')" for f, p in merge.POLICIES.items() for k in ("union", "conflict") for x in p[k]) + """) v(format, field, policy) UNION ALL
SELECT c_mktsegment, 'policy of ' || c_custkey, 'first-writer' FROM customer""")
def loaded_policies(spark, sf_dir):
    """The policies as a table, and fields of the given tables that it does not name, which are first-writer."""
    known = merge.load_policies(spark)
    asked = _t(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("format"), F.concat(F.lit("policy of "), "c_custkey").alias("field"))
    return known.unionByName(asked.join(known, ["format", "field"], "left").select("format", "field", F.coalesce("policy", F.lit("first-writer")).alias("policy")))


@query("""SELECT doc_id FROM documents WHERE text IS NOT NULL AND length(text) > 0 AND doc_id % 3 = 1""")
def invalid_utf8(spark, sf_dir):
    """Of all texts as bytes, every third with a byte that UTF-8 does not have, those that are told."""
    d = _t(spark, sf_dir, "documents").filter("length(text) > 0")
    content = F.when(F.pmod("doc_id", F.lit(3)) == 1, F.concat(F.lit(b"\xff"), F.col("text").cast("binary"))).otherwise(F.col("text").cast("binary"))
    return checks.invalid_utf8(d.withColumn("content", content)).select("doc_id")


@query("""SELECT o_orderkey AS set_id, l_linenumber AS seq, CASE WHEN l_returnflag = 'R' THEN CASE WHEN o_orderstatus = 'F' THEN 'ok' ELSE 'failed' END WHEN l_returnflag = 'A' THEN 'missing' ELSE 'ok' END AS status
FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2) JOIN orders ON o_orderkey = l_orderkey""")
def edit_statuses(spark, sf_dir):
    """A log of tests, of edits to paths that are not there, and of replacements: what becomes of each."""
    li = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("set_id"), F.col("l_linenumber").alias("seq")).agg(F.min("l_returnflag").alias("flag"))
    op = F.when(F.col("flag") == "R", "test").when(F.col("flag") == "A", "remove").otherwise("replace")
    path = F.when(F.col("flag") == "R", "/status").when(F.col("flag") == "A", "/nowhere").otherwise("/priority")
    log = li.select("set_id", "seq", op.alias("op"), path.alias("path"), F.when(F.col("flag") == "R", '"F"').when(F.col("flag") != "A", '"new"').alias("value"), F.lit(None).cast("string").alias("from_path"))
    return edits.apply_edits(tree.field_tree(_order_docs(spark, sf_dir, False)), log)[1].select("set_id", F.col("seq").cast("int").alias("seq"), "status")


@query(ITEMS + """, g AS (SELECT DISTINCT identity_key FROM e WHERE i <= 3), a AS (SELECT identity_key, i, o, CASE WHEN flags = 'R' THEN 'replace' WHEN flags = 'A' THEN 'remove' ELSE 'add' END AS op FROM e)
SELECT identity_key, i AS input_index, o[1] AS orderkey, CASE WHEN op <> 'add' AND g.identity_key IS NOT NULL THEN 'ok' ELSE 'missing' END AS status FROM a LEFT JOIN g USING (identity_key)""")
def remerge_statuses(spark, sf_dir):
    """A log of edits against the merge of the first inputs: ok, or missing where the entry or the operation is not there."""
    e = item_entries(spark, sf_dir)
    op = F.when(F.col("flags") == "R", "replace").when(F.col("flags") == "A", "remove").otherwise("add")
    log = e.select("identity_key", F.struct("input_index", "entry_ord").alias("seq"), F.lit("status").alias("field"), op.alias("op"), F.lit("x").alias("value"))
    _, status = remerge(e.filter("input_index <= 2"), e.filter("input_index = 3"), ["identity_key"], _ORDER, log, union=["flags"], first=["status"])
    return status.select("identity_key", "seq.input_index", F.col("seq.entry_ord.l_orderkey").alias("orderkey"), "status")


@query(_BODY)
def split_tagvalue(spark, sf_dir):
    """All texts of a source in large tag-value files, which are read line by line in splits and parsed."""
    path = folder(spark, "split-tagvalue")
    b = _bodies(spark, sf_dir).withColumn("source", F.col("set_id.source"))
    entry = F.concat(F.lit("LicenseID: LicenseRef-"), "name", F.lit("\nLicenseName: "), "source", F.lit("\nExtractedText: <text>"), "text", F.lit("</text>\n"))
    b.select("source", F.pmod("ord", F.lit(4)).alias("n"), entry.alias("value")).repartition("source", "n").drop("n").write.partitionBy("source").text(path)
    out = formats.entries_from_tagvalue_lines(reports.report_lines(spark, f"{path}/*/*.txt"))
    return out.select(F.col("LicenseName").alias("set_id"), F.substring("LicenseID", 12, 40).alias("name"), F.md5(fx.strip_text_tag("ExtractedText")).alias("text_md5"))


@query(_BODY.replace(" AS text_md5", " AS text_md5, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth"))
def reports_in_files(spark, sf_dir):
    """All texts of a source as one report, written as files in order and read back in splits; nth is the place there."""
    path = folder(spark, "reports-in-files")
    b = _bodies(spark, sf_dir).withColumn("set_id", F.col("set_id.source"))
    e = b.select("set_id", "ord", F.lit("license_text").alias("kind"), F.concat(F.lit("LicenseRef-"), "name").alias("LicenseID"), F.concat(F.lit("<text>"), "text", F.lit("</text>")).alias("ExtractedText"), F.lit(None).cast("map<string,string>").alias("checksums"))
    d = e.select("set_id").distinct().select("set_id", F.array(F.struct(F.lit("SPDXVersion").alias("tag"), F.lit("SPDX-2.3").alias("value"))).alias("tags"))
    r = d.select("set_id", F.lit("SPDXRef-DOCUMENT").alias("src"), F.lit("DESCRIBES").alias("type"), F.lit("SPDXRef-p").alias("dst"))
    files = report_files.write_reports(formats.tagvalue_pieces(d, r, e), path)
    out = formats.entries_from_tagvalue_lines(report_files.written_lines(spark, path, files))
    # The title before the texts is a section of its own.
    return out.select("set_id", F.substring("LicenseID", 12, 40).alias("name"), F.md5(fx.strip_text_tag("ExtractedText")).alias("text_md5"), (F.col("entry_ord") - 1).cast("long").alias("nth"))


# --- searches by an index ----------------------------------------------------------------------------------------

#: Frequent, rare and short terms, one that crosses words, one with signs, and one that no text has.
TERMS = ["license", "apache", " of the", "@", "ing.", "zzzqqqx"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS term, doc_id FROM documents WHERE contains(lower(text), '{t}')" for t in TERMS))
def indexed_search(spark, sf_dir):
    """All texts by an index of runs of letters: which documents hold each term."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "text")
    index = text_index.build(d.select("doc_id", F.col("text").alias("body")), F.col("body"), folder(spark, "text-index"))
    found = [index.search(t.upper()).select(F.lit(t).alias("term"), "doc_id") for t in TERMS]
    return reduce(DataFrame.unionByName, found)


@query("SELECT event_id AS seq FROM events WHERE lower(event_type) LIKE '%click%'")
def indexed_edits(spark, sf_dir):
    index = cat.index_edits(edits.summarize_edits(_event_edits(spark, sf_dir)), folder(spark, "edit-index"))
    return index.search("CLICK").select("seq")


@query(_CATALOG + "SELECT set_id FROM k WHERE (n_conflicts > 0 OR n_edits > 0) AND (lower(c_name) LIKE '%er#00000001%' OR inputs LIKE '%er#00000001%')")
def indexed_catalog(spark, sf_dir):
    index = cat.index_catalog(_catalog(spark, sf_dir), folder(spark, "catalog-index"))
    return cat.search_indexed_catalog(index, "ER#00000001", status="either").select("set_id")


@query(_PAIRS + "SELECT pair_id, side, count(*) AS n FROM (SELECT pair_id, 'left' AS side, line FROM l UNION ALL SELECT pair_id, 'right', line FROM r) WHERE lower(line) LIKE '%license%' GROUP BY 1, 2")
def indexed_diff(spark, sf_dir):
    """Lines of both sides by indexes, and their rows in the diff."""
    a, b = _pairs(spark, sf_dir)
    found = [text_index.build(t, F.col("line"), folder(spark, "line-index")).search("License") for t in (a, b)]
    return lines.search_diff(lines.opcodes(a, b), *found, "License", limit=None).groupBy("pair_id", "side").agg(F.count(F.lit(1)).alias("n"))


# --- sources -----------------------------------------------------------------------------------------------------


@query("SELECT regexp_extract(html, 'lang=\"([a-z]*)\"', 1) AS set_id, count(*) AS n_lines, CAST(sum(CAST('0x' || substr(md5(line), 1, 8) AS BIGINT)) AS BIGINT) AS checksum FROM (SELECT html, unnest(string_split(html, chr(10))) AS line FROM pages WHERE html IS NOT NULL) WHERE line <> '' GROUP BY 1")
def read_reports(spark, sf_dir):
    """Pages written as text files, a folder per language, and read as reports of one set each."""
    path = folder(spark, "reports")
    p = _t(spark, sf_dir, "pages").filter("html is not null").select(F.regexp_extract("html", 'lang="([a-z]*)"', 1).alias("lang"), F.col("html").alias("value"))
    p.withColumn("lang", F.concat(F.lit("x"), "lang")).write.partitionBy("lang").text(path)
    raw = reports.texts(reports.read_reports(spark, f"{path}/*/*.txt"))
    rows = lines.lines(raw, ["set_id"]).filter("line <> ''").withColumn("set_id", F.substring_index("set_id", "=x", -1))
    return rows.groupBy("set_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.conv(F.substring(F.md5("line"), 1, 8), 16, 10).cast("long")).alias("checksum"))


@query("SELECT page_id, CASE WHEN url LIKE 'https%' THEN 'cyclonedx' ELSE 'clixml' END AS format FROM pages WHERE url LIKE 'https%' OR url LIKE '%/'")
def format_mismatches(spark, sf_dir):
    """Inputs that are not the notices that they are taken for."""
    p = _t(spark, sf_dir, "pages")
    https = F.col("url").startswith("https")
    name = F.when(https, "CYCLONEDX_JSON_a").when(F.col("url").endswith("/"), "CLIXML_a").otherwise("a.txt")
    raw = p.select("page_id", F.concat(F.lit("/in/"), name).alias("path"), F.lit("x").cast("binary").alias("content"))
    return reports.format_mismatches(reports.with_format(raw), "readmeoss").select("page_id", "format")


@query("""SELECT p_partkey, p_name || chr(10) || chr(10) || p_type AS comment, p_brand || '|' || p_size AS brands FROM part""")
def folded_comments(spark, sf_dir):
    """Comments of several lines, and tags that repeat."""
    text = F.concat(F.lit("Comment: "), "p_name", F.lit("\n .\n ."), "p_type", F.lit("\nBrand: "), "p_brand", F.lit("\nBrand: "), F.col("p_size").cast("string"), F.lit("\n"))
    rows = lines.lines(_t(spark, sf_dir, "part").withColumn("text", text), ["p_partkey"])
    kv = sections.key_values(sections.fold_comment_blocks(rows, ["p_partkey"]))
    return sections.gather_tags(kv, ["p_partkey"], ["Comment"], ["Brand"]).select("p_partkey", F.col("Comment").alias("comment"), _join("Brand").alias("brands"))


@query("SELECT p_brand AS set_id, p_partkey, CASE p_size % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END AS known FROM part")
def section_ranks(spark, sf_dir):
    """Sections of a notice in their order: known ones first, others behind."""
    name = F.when(F.col("p_size") % 3 == 0, formats.SECTION_ORDER[0]).when(F.col("p_size") % 3 == 1, formats.SECTION_ORDER[1]).otherwise("THE REST")
    b = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("set_id"), "p_partkey", F.col("p_partkey").alias("ord"), name.alias("section"))
    return formats.ordered_sections(b).select("set_id", "p_partkey", F.col("section_rank.known").cast("long").alias("known"))


@query("SELECT page_id, CASE WHEN url LIKE 'https%' THEN 'unknown field' ELSE 'relationship' END AS problem FROM pages WHERE url LIKE 'https%' OR url LIKE '%/'")
def malformed_stanzas(spark, sf_dir):
    """Fields that a Files stanza may not have, and relationships that lack a word."""
    p = _t(spark, sf_dir, "pages")
    good = F.when(F.col("url").endswith("/") & ~F.col("url").startswith("https"), "Relationship: a b").otherwise("Copyright: x")
    rows = p.withColumn("line", F.when(F.col("url").startswith("https"), "Copyrihgt: x").otherwise(good))
    stanza = checks.unknown_stanza_fields(rows.select("page_id", "line").filter("line not like 'Relationship%'")).select("page_id", "problem")
    return stanza.unionByName(checks.malformed_lines(rows).select("page_id", "problem"))


# --- functions ---------------------------------------------------------------------------------------------------


@query(r"""SELECT p_partkey, p_name AS stripped, p_name || chr(10) || 'x' AS cdata, lower(p_brand) AS hash, p_brand || '|' || p_type AS list, 'ab|cd' AS hashes FROM part""")
def notice_functions(spark, sf_dir):
    """Export marks, CDATA, hash prefixes and lists of lines."""
    p = _t(spark, sf_dir, "part")
    return p.select(
        "p_partkey", fx.strip_export_prefix(F.concat(F.col("p_type"), F.lit(fx.EXPORT_MARK + "\n\n"), F.col("p_name"))).alias("stripped"), fx.norm_cdata(F.concat(F.lit("<![CDATA["), "p_name", F.lit(" \r\nx\t]]>\n"))).alias("cdata"),
        fx.strip_hash_prefix(F.concat(F.lit(" SHA1:"), "p_brand", F.lit(" "))).alias("hash"), _join(fx.split_list(F.concat(F.lit("\n "), "p_brand", F.lit("\n\n"), "p_type", F.lit(" \n")))).alias("list"), _join(fx.split_hashes(F.lit("md5:AB\nSHA256:cd"))).alias("hashes"),
    )


@query(r"""SELECT p_partkey, 'http://h/d#SPDXRef-' || p_size AS iri, '{"a":' || p_size || ',"b":{"c":1,"d":' || p_partkey || '}}' AS key, p_name AS name, 'file' AS kind, CAST(p_partkey AS VARCHAR) AS identity, 'a/' || p_brand AS field FROM part""")
def reference_functions(spark, sf_dir):
    """IRIs, canonical keys, display names and identity paths."""
    p = _t(spark, sf_dir, "part")
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    m = F.create_map(F.lit("frag"), F.concat(F.lit("SPDXRef-"), size))
    path = fx.split_identity_path(F.concat(F.lit("/file/"), key, F.lit("/a/"), "p_brand"))
    json = F.concat(F.lit('{"b": {"d": '), key, F.lit(', "c": 1}, "a": '), size, F.lit("}"))
    return p.select("p_partkey", fx.rewrite_iri(F.lit("http://h/d#frag"), m).alias("iri"), fx.stable_key(json).alias("key"), fx.display_name(F.lit(""), F.lit(None).cast("string"), "p_name").alias("name"), path["kind"].alias("kind"), path["identity_key"].alias("identity"), path["field"].alias("field"))


@query("""SELECT p_partkey, '/a~1b/' || p_size AS path, 'a/b|' || p_size AS tokens, 'a/b' AS plain FROM part""")
def pointer_functions(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    path = F.concat(F.lit("/"), fx.pointer_escape(F.lit("a/b")), F.lit("/"), F.col("p_size").cast("string"))
    return p.select("p_partkey", path.alias("path"), _join(fx.pointer_tokens(path)).alias("tokens"), fx.pointer_unescape(F.lit("a~1b")).alias("plain"))


@query("""SELECT p_partkey, 'input' || p_size || '-LicenseRef-' || p_partkey || '|MIT|LicenseRef-' || p_partkey || '-x' AS licenses FROM part""")
def license_lists(spark, sf_dir):
    """References inside lists of expressions."""
    p = _t(spark, sf_dir, "part")
    old = F.concat(F.lit("LicenseRef-"), F.col("p_partkey").cast("string"))
    rows = p.select("p_partkey", F.lit("s").alias("set_id"), F.col("p_size").alias("input_index"), F.array(old, F.lit("MIT"), F.concat(old, F.lit("-x"))).alias("licenses"))
    m = rows.select("set_id", "input_index", F.get("licenses", F.lit(0)).alias("old_ref")).withColumn("new_ref", fx.namespaced_ref("old_ref", "input_index"))
    return refs.rewrite_embedded_refs(rows, m, ["licenses"], ["p_partkey"]).select("p_partkey", _join("licenses").alias("licenses"))


# --- edits, trees, catalogue -------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT *, length(event_type) % 3 AS k FROM events), l AS (SELECT user_id, max(event_id) AS last FROM e WHERE k = 0 GROUP BY 1)
SELECT user_id AS set_id, event_id AS seq, event_type AS reason FROM e WHERE k = 0 UNION ALL
SELECT e.user_id, coalesce(last, 0) + row_number() OVER (PARTITION BY e.user_id ORDER BY ts, event_type, event_id), event_type FROM e LEFT JOIN l ON l.user_id = e.user_id WHERE k <> 0""")
def recorded_edits(spark, sf_dir):
    """Edits added to a log get the numbers after each document's last one."""
    e = _event_edits(spark, sf_dir)
    kind = F.length("reason") % 3
    new = e.filter(kind != 0).withColumn("path", F.concat_ws(":", "reason", F.lpad(F.col("seq").cast("string"), 12, "0"))).drop("seq")
    return edits.record_edit(e.filter(kind == 0), new).select("set_id", "seq", "reason")


@query("""WITH u AS (SELECT min(user_id) AS k FROM events), x AS (SELECT max(event_id) AS last FROM events, u WHERE user_id = k) SELECT event_id AS seq FROM events, u, x WHERE user_id = k AND event_id <> last""")
def undone_edits(spark, sf_dir):
    """The log of one document, listed, without its last edit."""
    log = _event_edits(spark, sf_dir)
    first = log.agg(F.min("set_id")).first()[0]
    return edits.list_edits(edits.undo(log, first), first).select("seq")


@query("""WITH d AS (SELECT coalesce(source, 'und') AS set_id, doc_id, lang, md5(coalesce(text, '')) AS h FROM documents),
c AS (SELECT *, row_number() OVER (PARTITION BY set_id, h ORDER BY doc_id) > 1 AS copy, '/docs/' || doc_id AS place FROM d),
k AS (SELECT DISTINCT set_id, h FROM c WHERE copy)
SELECT set_id, 'remove' AS op, place AS path, NULL AS value FROM c WHERE copy UNION ALL
SELECT set_id, 'replace', place || '/lang', '"und"' FROM c WHERE lang IS NULL AND NOT copy UNION ALL
SELECT set_id, 'add', place || '/first', 'true' FROM c JOIN k USING (set_id, h) WHERE NOT copy""")
def diff_of_large_trees(spark, sf_dir):
    """Edits between two trees of each source's documents: copies go, their first gets a mark, a missing language is und."""
    d = _t(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("und")).alias("set_id"), "doc_id", "lang", F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    first = d.groupBy("set_id", "h").agg(F.min("doc_id").alias("doc_id"), (F.count(F.lit(1)) > 1).alias("first")).select("doc_id", "first")
    d = d.join(first, "doc_id", "left").withColumn("at", F.concat(F.lit("/docs/"), "doc_id"))
    row = lambda name, kind, value: F.struct(F.concat("at", F.lit(name)).alias("path"), F.lit(kind).alias("value_type"), value.cast("string").alias("value"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    own, digest, lang = row("", "object", F.lit(None)), row("/digest", "string", quoted(F.col("h"))), F.coalesce("lang", F.lit("null"))
    old = d.select("set_id", F.inline(F.array(own, digest, row("/lang", "string", F.when(F.col("lang").isNull(), "null").otherwise(quoted(lang))))))
    new = d.filter("first is not null").select("set_id", F.inline(F.array_compact(F.array(own, digest, row("/lang", "string", quoted(F.coalesce("lang", F.lit("und")))), F.when(F.col("first"), row("/first", "boolean", F.lit("true")))))))
    return edits.diff_to_edits(old, new.withColumn("json", F.col("value")), levels=(2,)).select("set_id", "op", "path", "value")


def _month_edits(spark, sf_dir):
    """Nodes of one document per month, a list of its orders, and a log: pending orders are taken off one after the
    other, urgent ones are put in at every second place, as far as the list goes."""
    o = _t(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("set_id"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    at = Window.partitionBy("set_id").orderBy("o_orderkey")
    o = o.withColumn("i", F.row_number().over(at) - 1)
    items = o.select("set_id", F.concat(F.lit("/list/"), "i").alias("path"), F.col("o_orderkey").cast("string").alias("value"), F.lit("number").alias("value_type"), F.lit(0).alias("child_count"))
    heads = o.groupBy("set_id").agg(F.count(F.lit(1)).cast("int").alias("child_count")).select("set_id", F.lit("/list").alias("path"), F.lit(None).cast("string").alias("value"), F.lit("array").alias("value_type"), "child_count")
    step = lambda rows, first, op, index, value: rows.withColumn("j", F.row_number().over(at) - 1).select("set_id", (F.lit(first) + F.col("i")).cast("long").alias("seq"), F.lit(op).alias("op"), F.concat(F.lit("/list/"), index).alias("path"), value.alias("value"), F.lit(None).cast("string").alias("from_path"))
    off = step(o.filter("o_orderstatus = 'P'"), 1, "remove", F.col("i") - F.col("j"), F.lit(None).cast("string"))
    on = step(o.filter("o_orderpriority = '1-URGENT'"), 1 << 32, "add", F.col("j") * 2, F.to_json(F.struct(F.col("o_orderkey").alias("k"))))
    return items.unionByName(heads), off.unionByName(on)


_MONTHS = """WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS set_id, o_orderkey AS k, o_orderstatus = 'P' AS off, o_orderpriority = '1-URGENT' AS ins FROM orders),
s AS (SELECT set_id, count(*) FILTER (NOT off) AS n, count(*) FILTER (off) AS n_off, count(*) FILTER (ins) AS m, least(count(*) FILTER (ins), 1 + count(*) FILTER (NOT off)) AS used FROM o GROUP BY 1),
old AS (SELECT set_id, k, row_number() OVER (PARTITION BY set_id ORDER BY k) - 1 AS r FROM o WHERE NOT off),
new AS (SELECT set_id, k, row_number() OVER (PARTITION BY set_id ORDER BY k) - 1 AS r FROM o WHERE ins)"""


@query(_MONTHS + """ SELECT set_id, '/list' AS path, '[]' AS value FROM s UNION ALL
SELECT set_id, '/list/' || (CASE WHEN r < used THEN 2 * r + 1 ELSE r + used END), CAST(k AS VARCHAR) FROM old JOIN s USING (set_id) UNION ALL
SELECT set_id, '/list/' || (2 * r), '{}' FROM new JOIN s USING (set_id) WHERE r < used UNION ALL
SELECT set_id, '/list/' || (2 * r) || '/k', CAST(k AS VARCHAR) FROM new JOIN s USING (set_id) WHERE r < used""")
def large_list_edits(spark, sf_dir):
    """Removals and inserts in long lists, each at the index that earlier edits left it."""
    return apply_large_edits(*_month_edits(spark, sf_dir))[0].select("set_id", "path", "value")


@query(_MONTHS + """ SELECT set_id, 'ok' AS status, n_off + used AS n FROM s WHERE n_off + used > 0 UNION ALL SELECT set_id, 'missing', m - used FROM s WHERE m > used""")
def large_edit_statuses(spark, sf_dir):
    """How many edits of a month could be applied; an insert behind a list's end could not."""
    return apply_large_edits(*_month_edits(spark, sf_dir))[1].groupBy("set_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey AS set_id, unnest(['/p2', '/priority', '/s2', '/tags', '/tags/0', '/tags/1', '/tags/2']) AS path, unnest(['"' || o_orderpriority || '"', '"' || o_orderpriority || '"', '"' || o_orderstatus || '"', '[]', '"urgent"', CAST(o_custkey AS VARCHAR), '"first"']) AS value FROM orders""")
def edit_operations(spark, sf_dir):
    """Add into a list, copy, move, and tests that hold and that fail."""
    t = tree.field_tree(_order_docs(spark, sf_dir, False), with_json=True)
    one = lambda n, op, path, value=None, source=None: F.struct(F.lit(n).cast("long").alias("seq"), F.lit(op).alias("op"), F.lit(path).alias("path"), (F.lit(value).cast("string") if value is None or isinstance(value, str) else value).alias("value"), F.lit(source).cast("string").alias("from_path"))
    steps = F.array(one(1, "add", "/tags/1", F.col("o_custkey").cast("string")), one(2, "copy", "/p2", None, "/priority"), one(3, "move", "/s2", None, "/status"), one(4, "test", "/tags/0", '"urgent"'), one(5, "test", "/tags/0", '"no"'), one(6, "remove", "/gone"))
    log = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("set_id"), F.inline(steps))
    return edits.apply_edits(t, log)[0].select("set_id", "path", "value")


@query("""SELECT o_orderkey AS set_id, CASE WHEN o_orderpriority LIKE '1%' THEN '' ELSE '/status' END AS path FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderstatus = 'O'""")
def verified_edits(spark, sf_dir):
    """Edits that do not make the new text give way to one that replaces the document; others stay."""
    old, new = (stash(tree.field_tree(_order_docs(spark, sf_dir, x), with_json=True), "order-nodes") for x in (False, True))
    diff = stash(edits.diff_to_edits(old, new), "order-edits")
    log = diff.filter("path = '/status'")
    # Orders of priority 1 keep the second tag; a wrong edit takes it from them.
    wrong = _t(spark, sf_dir, "orders").filter("o_orderpriority like '1%'").select(F.col("o_orderkey").alias("set_id"), F.lit(99).cast("long").alias("seq"), F.lit("remove").alias("op"), F.lit("/tags/1").alias("path"), F.lit(None).cast("string").alias("value"))
    right = diff.filter("path <> '/status'").join(wrong.select("set_id"), "set_id", "left_anti")
    whole = _order_docs(spark, sf_dir, True)
    out = edits.edits_or_replacement(old, new, log.unionByName(wrong).unionByName(right), whole)
    return out.filter("path in ('', '/status')").select("set_id", "path")


@query("""SELECT conv_id AS set_id, '/turns/' || n AS path, 'object' AS value_type, 2 AS child_count FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS n FROM conversations)
UNION ALL SELECT conv_id, '/turns/' || n || '/role', 'string', 0 FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS n FROM conversations)
UNION ALL SELECT conv_id, '/turns/' || n || '/text', 'string', 0 FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS n FROM conversations)
UNION ALL SELECT conv_id, '/turns', 'array', CAST(count(*) AS INTEGER) FROM conversations GROUP BY 1 UNION ALL SELECT DISTINCT conv_id, '/conv', 'number', 0 FROM conversations""")
def nested_tree(spark, sf_dir):
    """Conversations as documents of three levels."""
    c = _t(spark, sf_dir, "conversations")
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    docs = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(turn)), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    docs = docs.select(F.col("conv_id").alias("set_id"), F.to_json(F.struct(F.col("conv_id").alias("conv"), "turns")).alias("json"))
    return tree.field_tree(docs).select("set_id", "path", "value_type", "child_count")


@query("""WITH e AS (SELECT o_orderkey AS set_id, o_orderstatus, o_orderpriority FROM orders) SELECT set_id, 'conflicts' AS mode, '/status' AS path FROM e WHERE o_orderstatus = 'F' UNION ALL SELECT set_id, 'edited', '/priority' FROM e WHERE o_orderpriority LIKE '2%'""")
def tree_modes(spark, sf_dir):
    """Nodes in conflict, and nodes that edits touch."""
    t = tree.field_tree(_order_docs(spark, sf_dir, False))
    o = _t(spark, sf_dir, "orders")
    marked = t.join(o.select(F.col("o_orderkey").alias("set_id"), "o_orderstatus"), "set_id").withColumn("in_conflict", (F.col("path") == "/status") & (F.col("o_orderstatus") == "F"))
    log = o.filter("o_orderpriority like '2%'").select(F.col("o_orderkey").alias("set_id"), F.lit("/priority").alias("path"))
    out = tree.filter_tree(marked, "conflicts").select("set_id", F.lit("conflicts").alias("mode"), "path")
    return out.unionByName(tree.filter_tree(t, "edited", edits=log).select("set_id", F.lit("edited").alias("mode"), "path"))


@query("SELECT c_custkey AS set_id, c_mktsegment AS format, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey * 7919 % 1000 DESC, c_custkey) AS place FROM customer")
def listed_catalog(spark, sf_dir):
    """The listing, newest first, with each set's place in it among those of its format."""
    listed = cat.list_catalog(_catalog(spark, sf_dir)).withColumn("at", F.monotonically_increasing_id())
    return listed.select("set_id", "format", F.row_number().over(Window.partitionBy("format").orderBy("at")).cast("long").alias("place"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)")
def conflicts_of_a_set(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "set_id")
    return cat.set_conflicts(o, o.agg(F.min("set_id")).first()[0]).select("o_orderkey", "o_orderstatus")


@query("SELECT doc_id, source FROM documents WHERE CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) = 1 UNION ALL SELECT arg_min(doc_id, doc_id), 'merged' FROM documents")
def selected_source(spark, sf_dir):
    """The entries of one input, and what stands for the merged report."""
    e = text_entries(spark, sf_dir)
    first = e.agg(F.min("doc_id").alias("doc_id"))
    own = lines.select_source(e, first, "input:1").select("doc_id", F.col("source_id").alias("source"))
    return own.unionByName(lines.select_source(e, first, "merged").select("doc_id", F.lit("merged").alias("source")))
