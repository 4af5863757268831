"""Queries of the merge library over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions import text as fx
from tributary.operators import catalog as cat
from tributary.operators import checks, edits, lines, merge, refs, tree
from tributary.plans.scratch import folder
from tributary.sources import formats, provenance, reports
from tributary.streaming.merge_stream import MergeTable, arrivals

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _t(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _join(c) -> F.Column:
    return F.array_join(c, "|")


# --- documents as licence texts of one report per source ---------------------------------------------------------


def text_entries(spark, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents")
    index = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    return d.select(F.lit("docs").alias("set_id"), F.lit("license_text").alias("kind"), fx.text_identity("text").alias("identity_key"), index.alias("input_index"), F.col("doc_id").alias("entry_ord"), F.col("source").alias("source_id"), "doc_id", "lang", "n_chars")


TEXTS = r"""WITH e AS (SELECT md5(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+(\n|$)', '\1', 'g')) AS identity_key,
  CAST(regexp_extract(source, '(\d+)$', 1) AS INTEGER) AS input_index, doc_id, lang, source, n_chars FROM documents) """
_KEYS, _ORDER = ["set_id", "kind", "identity_key"], ["input_index", "entry_ord"]


@query(TEXTS + """SELECT identity_key, count(*) AS n_entries, arg_min(doc_id, row(input_index, doc_id)) AS doc_id,
  array_to_string(list_sort(list(DISTINCT lang) FILTER (WHERE lang IS NOT NULL)), '|') AS langs, min(n_chars) <> max(n_chars) AS n_chars_conflict, arg_min(n_chars, row(input_index, doc_id)) AS n_chars,
  array_to_string(list_transform(list_sort(list(DISTINCT row(input_index, source))), lambda x: x[2]), ',') AS source_id FROM e GROUP BY identity_key""")
def merge_documents(spark, sf_dir):
    m = merge.merge_entries(text_entries(spark, sf_dir), _KEYS, _ORDER, union=["lang"], conflict=["n_chars"], first=["doc_id"])
    return m.select("identity_key", "n_entries", "doc_id", _join("lang").alias("langs"), "n_chars_conflict", "n_chars", "source_id")


@query(TEXTS + "SELECT identity_key, arg_max(lang, row(input_index, doc_id)) FILTER (WHERE lang <> '') AS lang FROM e GROUP BY identity_key HAVING count(*) FILTER (WHERE lang <> '') > 0")
def last_writer_names(spark, sf_dir):
    return merge.last_writer_name(text_entries(spark, sf_dir), _KEYS, _ORDER, "lang").select("identity_key", "lang")


@query(TEXTS + """, r AS (SELECT *, 'input' || input_index || '-LicenseRef-' || doc_id AS ref FROM e), w AS (SELECT identity_key, arg_min(ref, row(input_index, doc_id)) AS winner_ref FROM r GROUP BY 1)
SELECT DISTINCT identity_key, ref AS loser_ref, winner_ref FROM r JOIN w USING (identity_key) WHERE ref <> winner_ref""")
def alias_map(spark, sf_dir):
    e = text_entries(spark, sf_dir).withColumn("ref", fx.namespaced_ref(F.concat(F.lit("LicenseRef-"), F.col("doc_id").cast("string")), "input_index"))
    return merge.alias_map(e, _KEYS, _ORDER, "ref").select("identity_key", "loser_ref", "winner_ref")


@query(TEXTS + ", g AS (SELECT identity_key, count(*) AS n FROM e GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS entries_in, count(*) AS entries_out, count(*) FILTER (WHERE n > 1) AS merged_groups FROM g")
def dedup_stats(spark, sf_dir):
    return merge.dedup_stats(text_entries(spark, sf_dir), _KEYS, ["set_id", "kind"]).select("entries_in", "entries_out", "merged_groups")


# --- lineitem as file entries with policies ----------------------------------------------------------------------


def item_entries(spark, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")
    return li.select(F.concat_ws("-", "l_partkey", "l_suppkey").alias("identity_key"), F.col("l_linenumber").alias("input_index"), F.struct("l_orderkey", "l_linestatus", "l_returnflag", "l_quantity").alias("entry_ord"), F.concat(F.lit("in"), "l_linenumber").alias("source_id"), F.col("l_returnflag").alias("flags"), F.col("l_linestatus").alias("status"), F.col("l_quantity").alias("quantity"))


ITEMS = """WITH e AS (SELECT concat_ws('-', l_partkey, l_suppkey) AS identity_key, l_linenumber AS i, row(l_orderkey, l_linestatus, l_returnflag, l_quantity) AS o, 'in' || l_linenumber AS source, l_returnflag AS flags, l_linestatus AS status, l_quantity AS quantity FROM lineitem) """


@query(ITEMS + """SELECT identity_key, count(*) AS n_entries, array_to_string(list_sort(list(DISTINCT flags)), '|') AS flags, arg_min(status, row(i, o)) AS status, min(status) <> max(status) AS status_conflict, arg_min(quantity, row(i, o)) AS quantity FROM e GROUP BY 1""")
def merge_lineitem_policies(spark, sf_dir):
    m = merge.merge_entries(item_entries(spark, sf_dir), ["identity_key"], _ORDER, union=["flags"], conflict=["status"], first=["quantity"])
    return m.select("identity_key", "n_entries", _join("flags").alias("flags"), "status", "status_conflict", "quantity")


@query(ITEMS + """, c AS (SELECT identity_key, arg_min(status, row(i, o)) AS chosen FROM e GROUP BY 1 HAVING min(status) <> max(status)),
v AS (SELECT e.identity_key, chosen, source, status, min(row(i, o)) AS r FROM e JOIN c USING (identity_key) GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY identity_key, source ORDER BY r) AS k FROM v)
SELECT '/' || identity_key || '/status' AS path, chosen, string_agg(source || CASE WHEN k > 1 THEN '#' || k ELSE '' END || '=' || status, '|' ORDER BY r) AS vals FROM n GROUP BY 1, 2""")
def conflict_rows(spark, sf_dir):
    c = merge.conflicts(item_entries(spark, sf_dir), ["identity_key"], _ORDER, ["status"])
    return c.select("path", "chosen", _join(F.transform("values", lambda v: F.concat_ws("=", v["source"], v["value"]))).alias("vals"))


@query(ITEMS + """, f AS (SELECT *, count(*) OVER (PARTITION BY identity_key) AS n, first_value(status) OVER (PARTITION BY identity_key ORDER BY i, o) AS chosen FROM e)
SELECT '/' || identity_key AS path, array_to_string(list_sort(list(DISTINCT source)), '|') AS sources FROM f GROUP BY 1
UNION ALL SELECT '/' || identity_key || '/status', array_to_string(list_sort(list(DISTINCT source)), '|') FROM f WHERE n > 1 AND status = chosen GROUP BY 1
UNION ALL SELECT '/' || identity_key || '/flags', array_to_string(list_sort(list(DISTINCT source)), '|') FROM f WHERE n > 1 GROUP BY 1""")
def provenance_rows(spark, sf_dir):
    p = merge.provenance(item_entries(spark, sf_dir), ["identity_key"], _ORDER, {"flags": "union", "status": "conflict"})
    return p.select("path", _join("sources").alias("sources"))


@query(ITEMS + """, u AS (SELECT DISTINCT identity_key, source FROM e) SELECT source, count(*) AS n_values FROM u GROUP BY 1""")
def source_contribution(spark, sf_dir):
    p = item_entries(spark, sf_dir).groupBy("identity_key").agg(F.collect_set("source_id").alias("sources")).withColumn("set_id", F.lit("s"))
    return tree.source_contribution(p).select("source", "n_values")


@query("""SELECT l_partkey AS path, least(f, l_returnflag) AS chosen, fs || '=' || f || '|' || s || '=' || l_returnflag AS vals FROM (SELECT DISTINCT l_partkey, l_returnflag, s, f, fs FROM
 (SELECT *, 'in' || l_linenumber AS s, first_value(l_returnflag) OVER w AS f, first_value('in' || l_linenumber) OVER w AS fs FROM lineitem WINDOW w AS (PARTITION BY l_partkey ORDER BY 'in' || l_linenumber, l_orderkey, l_returnflag)) WHERE l_returnflag <> f)""")
def glob_overlap(spark, sf_dir):
    s = _t(spark, sf_dir, "lineitem").select(F.lit("s").alias("set_id"), F.lit("stanza").alias("kind"), F.concat(F.lit("in"), "l_linenumber").alias("source_id"), F.col("l_orderkey").alias("entry_ord"), F.col("l_returnflag").alias("license"), F.array("l_partkey").alias("files"))
    return formats.glob_overlaps(s).select("path", "chosen", _join(F.transform("values", lambda v: F.concat_ws("=", v["source"], v["value"]))).alias("vals"))


@query("""SELECT c_nationkey AS set_id, c_custkey AS input_index, CASE WHEN row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) > 1 THEN c_mktsegment || '_' || c_custkey ELSE c_mktsegment END AS source_id FROM customer""")
def unique_source_ids(spark, sf_dir):
    i = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("set_id"), F.col("c_custkey").alias("input_index"), F.col("c_mktsegment").alias("source_id"))
    return merge.unique_source_ids(i)


@query("""SELECT o_custkey AS set_id, o_orderkey AS input_index, o_orderpriority AS header FROM (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE o_orderkey = m""")
def primary_headers(spark, sf_dir):
    h = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("set_id"), F.col("o_orderkey").alias("input_index"), F.col("o_orderpriority").alias("header"))
    return merge.primary_rows(h)


@query("""SELECT n_nationkey AS set_id, n_name || chr(10) || 'merged from: ' || string_agg(s_name, ', ' ORDER BY s_suppkey) AS "Comment" FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name""")
def merge_comments(spark, sf_dir):
    h = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("set_id"), F.col("n_name").alias("Comment"))
    i = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("set_id"), F.col("s_suppkey").alias("input_index"), F.col("s_name").alias("source_id"))
    return merge.merge_comment(h, i)


# --- orders, parts and suppliers as a graph ----------------------------------------------------------------------


def _graph(spark, sf_dir: str) -> DataFrame:
    """Orders contain parts; a customer is a set, a line number an input."""
    o, li = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(F.col("o_custkey").alias("set_id"), F.col("l_linenumber").alias("input_index"), F.concat(F.lit("SPDXRef-o"), "l_orderkey").alias("src"), F.lit("CONTAINS").alias("type"), F.concat(F.lit("SPDXRef-p"), "l_partkey").alias("dst"), "l_partkey")


_G = "WITH g AS (SELECT o_custkey AS set_id, l_linenumber AS i, 'SPDXRef-o' || l_orderkey AS src, 'SPDXRef-p' || l_partkey AS dst, l_partkey, l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) "


@query(_G + "SELECT set_id, i AS input_index, 'SPDXRef-input' || i || '-o' || l_orderkey AS src, 'CONTAINS' AS type, 'SPDXRef-input' || i || '-p' || l_partkey AS dst FROM g")
def namespaced_refs(spark, sf_dir):
    # Both ends are declared by the row itself, so their own names are a projection.
    return refs.namespace(_graph(spark, sf_dir), ["src", "dst"]).drop("l_partkey")


@query(_G + """, w AS (SELECT set_id, l_partkey, min(row(i, dst)) AS k, arg_min('SPDXRef-input' || i || '-p' || l_partkey, row(i, l_orderkey)) AS winner FROM g GROUP BY 1, 2)
SELECT DISTINCT g.set_id, src, 'CONTAINS' AS type, winner AS dst FROM g JOIN w USING (set_id, l_partkey)""")
def redirected_rels(spark, sf_dir):
    g = _graph(spark, sf_dir).withColumn("dst", fx.namespaced_ref("dst", "input_index"))
    order = F.regexp_extract("src", r"(\d+)$", 1).cast("long")
    e = g.select("set_id", F.col("l_partkey").alias("identity_key"), "input_index", order.alias("entry_ord"), F.col("dst").alias("ref"))
    a = merge.alias_map(e, ["set_id", "identity_key"], _ORDER, "ref").drop("identity_key")
    return refs.redirect_to_survivors(g, a, ["dst"]).select("set_id", "src", "type", "dst").distinct()


@query(_G + "SELECT DISTINCT set_id, src AS ref FROM g UNION SELECT DISTINCT set_id, dst FROM g WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def dangling_refs(spark, sf_dir):
    g = _graph(spark, sf_dir)
    small = _t(spark, sf_dir, "part").filter("p_size <= 25").select(F.concat(F.lit("SPDXRef-p"), "p_partkey").alias("ref"))
    ids = g.select("set_id", F.col("dst").alias("ref")).distinct().join(small, "ref", "left_semi")
    return refs.dangling_refs(g, ids, "ref")


@query(_G + "SELECT set_id, dst AS ref, count(*) AS n FROM g GROUP BY 1, 2 UNION ALL SELECT set_id, src, count(*) FROM g GROUP BY 1, 2")
def attached_relationships(spark, sf_dir):
    g = _graph(spark, sf_dir).select("set_id", "src", "type", "dst")
    e = g.select("set_id", F.explode(F.array("src", "dst")).alias("ref")).distinct()
    return refs.attach_relationships(e, g, "ref").groupBy("set_id", "ref").agg(F.count(F.lit(1)).alias("n"))


@query(_G + "SELECT DISTINCT set_id, src, 'CONTAINS' AS type, dst FROM g UNION ALL SELECT DISTINCT set_id, 'SPDXRef-DOCUMENT', 'DESCRIBES', src FROM g")
def merged_relationships(spark, sf_dir):
    g = _graph(spark, sf_dir).select("set_id", "src", "type", "dst")
    return refs.merged_relationships(g, g.select("set_id", F.col("src").alias("ref")).distinct(), "ref")


@query("SELECT l_orderkey, count(*) AS n_files, sha1(string_agg(h, '' ORDER BY h)) AS verification_code FROM (SELECT DISTINCT l_orderkey, l_partkey, md5(p_name) AS h FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1")
def verification_codes(spark, sf_dir):
    files = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.md5("p_name").alias("h"))
    return refs.verification_codes(_t(spark, sf_dir, "lineitem"), files, "l_orderkey", "l_partkey", "h")


@query("SELECT n_regionkey, n_nationkey AS input_index, s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def attached_satellites(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("set_id"), F.col("n_nationkey").alias("input_index"), F.concat(F.lit("urn:n"), "n_nationkey").alias("node_id"))
    s = _t(spark, sf_dir, "supplier").join(n.select("set_id", "input_index"), F.col("s_nationkey") == F.col("input_index"))
    s = s.select("set_id", "input_index", F.concat(F.lit("urn:n"), "s_nationkey", F.lit("#s"), "s_suppkey").alias("node_id"), F.lit(None).cast("string").alias("subject"), "s_suppkey")
    return refs.attach_satellites(n, s).select(F.col("set_id").alias("n_regionkey"), "input_index", "s_suppkey")


# --- checks ------------------------------------------------------------------------------------------------------


@query("SELECT o_custkey AS set_id, o_orderpriority AS ref, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_refs(spark, sf_dir):
    return checks.duplicate_refs(_t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("set_id"), F.col("o_orderpriority").alias("ref")), "ref", ["set_id"])


@query("SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '[0-9a-f]{32}')")
def missing_identity(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").withColumn("identity_key", F.regexp_extract("text", "([0-9a-f]{32})", 1))
    return checks.missing_identity(d).select("doc_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def empty_reports(spark, sf_dir):
    e = _t(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return checks.empty_reports(_t(spark, sf_dir, "orders"), e, ["o_orderkey"]).select("o_orderkey")


@query("SELECT page_id, 'lang' AS field FROM pages WHERE regexp_extract(html, 'lang=\"([a-z]*)\"', 1) <> 'en'")
def required_fields(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").withColumn("lang", F.regexp_extract("html", 'lang="([a-z]*)"', 1))
    return checks.required_fields(p, ["url"], {"lang": "en"}).select("page_id", "field")


@query("""SELECT user_id, event_type FROM (SELECT user_id, event_type, CASE WHEN value > 50 THEN 'list' ELSE 'scalar' END AS t FROM events WHERE value IS NOT NULL) GROUP BY 1, 2 HAVING min(t) <> max(t)""")
def union_type_mismatch(spark, sf_dir):
    e = _t(spark, sf_dir, "events").filter("value is not null")
    v = F.when(F.col("value") > 50, F.concat(F.lit("["), F.col("value").cast("string"), F.lit("]"))).otherwise(F.col("value").cast("string"))
    f = e.select(F.col("user_id").alias("set_id"), F.lit("k").alias("kind"), F.col("event_type").alias("identity_key"), F.lit("value").alias("field"), v.alias("value"))
    return checks.union_type_mismatch(f).select(F.col("set_id").alias("user_id"), F.col("identity_key").alias("event_type"))


def _event_edits(spark, sf_dir: str) -> DataFrame:
    """Events as an edit log: the user is the document, views replace, clicks remove, the rest add a path without a
    slash (which is invalid)."""
    e = _t(spark, sf_dir, "events")
    kind = F.length("event_type") % 3
    op = F.when(kind == 0, "replace").when(kind == 1, "remove").otherwise("add")
    path = F.when(kind == 2, F.col("event_type")).otherwise(F.concat(F.lit("/"), "event_type"))
    return e.select(F.col("user_id").alias("set_id"), F.col("event_id").alias("seq"), F.lit("who").alias("who"), F.col("ts").alias("when"), op.alias("op"), path.alias("path"), F.col("value").cast("decimal(18,4)").cast("string").alias("value"), F.lit(None).cast("string").alias("from_path"), F.col("event_type").alias("reason"))


@query("SELECT event_id AS seq, 'path' AS problem FROM events WHERE length(event_type) % 3 = 2 UNION ALL SELECT event_id, 'value' FROM events WHERE length(event_type) % 3 = 0 AND value IS NULL")
def invalid_edits(spark, sf_dir):
    return checks.invalid_edits(_event_edits(spark, sf_dir)).select("seq", "problem")


# --- functions ---------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, md5(trim(p_type) || chr(0) || array_to_string(list_sort([trim(p_name), trim(p_brand)]), chr(0))) AS identity_key FROM part""")
def stanza_identity(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", fx.stanza_identity("p_type", F.array("p_brand", "p_name")).alias("identity_key"))


@query("""SELECT p_partkey, md5(p_name || '||' || p_type || '||' || array_to_string(list_sort([p_name, p_brand]), '|')) AS identity_key FROM part""")
def obligation_identity(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", fx.obligation_identity("p_name", "p_type", F.array("p_brand", "p_name")).alias("identity_key"))


@query("""SELECT doc_id, 'LicenseRef-' || doc_id || '|SPDXRef-' || source AS refs FROM documents""")
def embedded_refs(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    text = F.concat(F.lit("(LicenseRef-"), F.col("doc_id").cast("string"), F.lit(") "), F.coalesce("text", F.lit("")), F.lit(" SPDXRef-"), F.col("source"))
    return d.select("doc_id", _join(fx.embedded_refs(text)).alias("refs"))


@query("""SELECT p_partkey, '(LicenseRef-input' || p_size || '-' || p_partkey || ' AND MIT) OR LicenseRef-' || p_partkey || '-x' AS expression FROM part""")
def license_expr_rewrite(spark, sf_dir):
    p = _t(spark, sf_dir, "part").withColumn("key", F.col("p_partkey").cast("string"))
    old = F.concat(F.lit("LicenseRef-"), "key")
    rows = p.select("p_partkey", F.lit("s").alias("set_id"), F.col("p_size").alias("input_index"), F.concat(F.lit("("), old, F.lit(" AND MIT) OR "), old, F.lit("-x")).alias("expression"))
    m = p.select(F.lit("s").alias("set_id"), F.col("p_size").alias("input_index"), old.alias("old_ref"), F.concat(F.lit("LicenseRef-input"), "p_size", F.lit("-"), "key").alias("new_ref"))
    return refs.rewrite_embedded_refs(rows, m, "expression", ["p_partkey"]).select("p_partkey", "expression")


@query(r"""SELECT page_id, trim(regexp_replace(url, '[^A-Za-z0-9_.-]', '_', 'g'), '._') AS safe, replace(replace(url, '~', '~0'), '/', '~1') AS escaped, CASE WHEN length(html) > 120 THEN left(html, 119) || '…' ELSE html END AS preview,
 CAST((length(lower(html)) - length(replace(lower(html), 'the', ''))) / 3 AS INTEGER) AS n_the FROM pages""")
def text_functions(spark, sf_dir):
    p = _t(spark, sf_dir, "pages")
    return p.select("page_id", fx.safe_name("url").alias("safe"), fx.pointer_escape("url").alias("escaped"), fx.preview("html").alias("preview"), fx.count_matches("html", F.lit("The")).alias("n_the"))


# --- formats: rendered from a table and parsed back --------------------------------------------------------------


#: Documents of a source in one report, at most; a source may hold a large share of all documents.
REPORT_DOCS = 64


def _texts(rendered: DataFrame) -> DataFrame:
    return rendered.select("set_id", F.lit(0).alias("input_index"), F.lit("in").alias("source_id"), "text")


def _bodies(spark, sf_dir: str) -> DataFrame:
    """Documents as blocks: texts without blank ends, line ends only as LF, no line that looks like a separator. A set is
    a source and up to REPORT_DOCS documents of it, those whose numbers follow each other."""
    d = _t(spark, sf_dir, "documents").filter("text is not null")
    body = F.trim(fx.norm_text(F.regexp_replace("text", r"\n\s*", "\n")))
    part = F.coalesce(F.floor(F.col("doc_id") / REPORT_DOCS), F.xxhash64("text")).alias("part")
    return d.select(F.struct("source", part).alias("set_id"), F.col("doc_id").alias("ord"), F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("name"), F.concat(F.lit("x"), body).alias("text"))


_BODY = r"SELECT source AS set_id, 'n' || doc_id AS name, md5('x' || trim(regexp_replace(regexp_replace(text, '\n\s*', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'))) AS text_md5 FROM documents WHERE text IS NOT NULL"


@query(_BODY)
def notice_roundtrip(spark, sf_dir):
    b = _bodies(spark, sf_dir)
    h = b.select("set_id").distinct().withColumn("package_name", F.col("set_id.source"))
    out = formats.entries_from_notice(_texts(formats.render_notice(h, b.withColumn("section", F.lit("MAIN LICENSES")))))
    return out.select(F.col("set_id.source").alias("set_id"), "name", F.md5("text").alias("text_md5"))


@query(_BODY)
def dep5_roundtrip(spark, sf_dir):
    b = _bodies(spark, sf_dir)
    h = b.select("set_id").distinct().select("set_id", F.lit(reports.DEBIAN_HEAD + "1.0/").alias("Format"), F.col("set_id.source").alias("Upstream-Name"), F.lit(None).cast("string").alias("Disclaimer"), F.lit(None).cast("string").alias("Comment"))
    none = F.lit(None).cast("string")
    e = b.select("set_id", "ord", F.lit("license_text").alias("kind"), F.array().cast("array<string>").alias("files"), none.alias("copyright"), none.alias("license"), none.alias("comment"), "name", "text")
    return formats.entries_from_dep5(_texts(formats.render_dep5(h, e))).select(F.col("set_id.source").alias("set_id"), "name", F.md5("text").alias("text_md5"))


@query(_BODY)
def tagvalue_roundtrip(spark, sf_dir):
    b = _bodies(spark, sf_dir)
    e = b.select("set_id", "ord", F.lit("license_text").alias("kind"), F.concat(F.lit("LicenseRef-"), "name").alias("LicenseID"), F.concat(F.lit("<text>"), "text", F.lit("</text>")).alias("ExtractedText"), F.lit(None).cast("map<string,string>").alias("checksums"))
    d = b.select("set_id").distinct().select("set_id", F.array(F.struct(F.lit("SPDXVersion").alias("tag"), F.lit("SPDX-2.3").alias("value"))).alias("tags"))
    r = d.select("set_id", F.lit("SPDXRef-DOCUMENT").alias("src"), F.lit("DESCRIBES").alias("type"), F.lit("SPDXRef-p").alias("dst"))
    out = formats.entries_from_tagvalue(_texts(formats.render_tagvalue(d, r, e)))
    return out.select(F.col("set_id.source").alias("set_id"), F.substring("LicenseID", 12, 40).alias("name"), F.md5(fx.strip_text_tag("ExtractedText")).alias("text_md5"))


@query(_BODY)
def clixml_roundtrip(spark, sf_dir):
    b = _bodies(spark, sf_dir)
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    e = b.select("set_id", F.col("ord").alias("entry_ord"), F.lit("license_text").alias("kind"), F.lit("License").alias("section"), F.sha1("set_id.source").alias("component"), "name", none.alias("type"), F.col("text").alias("content"), empty.alias("acknowledgements"), empty.alias("files"), empty.alias("hashes"), none.alias("topic"), empty.alias("licenses"))
    out = formats.entries_from_clixml(_texts(formats.render_clixml(formats.regroup_components(e))))
    return out.filter("section = 'License'").select(F.col("set_id.source").alias("set_id"), "name", F.md5(F.col("content")).alias("text_md5"))


@query("SELECT p_brand AS set_id, p_name AS name, md5(p_name || p_partkey) AS identity_key, p_type AS license FROM part")
def cyclonedx_roundtrip(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    e = p.select(F.col("p_brand").alias("set_id"), F.col("p_partkey").alias("ord"), F.lit("file").alias("kind"), F.lit("file").alias("type"), F.col("p_name").alias("name"), F.col("p_partkey").cast("string").alias("ref"), F.array(F.struct(F.lit("MD5").alias("alg"), F.upper(F.md5(F.concat("p_name", "p_partkey"))).alias("content"))).alias("hashes"), F.array("p_type").alias("licenses"), F.lit(None).cast("string").alias("copyright"), F.lit(None).cast("string").alias("description"), F.lit("1").alias("upload_ref"))
    out = formats.entries_from_cyclonedx(_texts(formats.render_cyclonedx(e)))
    return out.select("set_id", "name", "identity_key", F.get("licenses", F.lit(0)).alias("license"))


@query("SELECT p_brand AS set_id, 'SPDXRef-' || p_partkey AS ref, p_name AS name, md5(p_name || p_partkey) AS identity_key FROM part")
def spdx3_roundtrip(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    node = F.to_json(F.struct(F.lit(formats.FILE).alias("type"), F.concat(F.lit("SPDXRef-"), "p_partkey").alias("spdxId"), F.col("p_name").alias("name"), F.array(F.struct(F.lit("MD5").alias("algorithm"), F.md5(F.concat("p_name", "p_partkey")).alias("hashValue"))).alias("verifiedUsing")))
    n = p.select(F.col("p_brand").alias("set_id"), F.lit(1).alias("section"), F.struct(F.lit(0).alias("i"), F.col("p_partkey").alias("o")).alias("ord"), node.alias("json"))
    return formats.entries_from_spdx3(_texts(formats.render_spdx3(n))).select("set_id", "ref", "name", "identity_key")


@query(r"""SELECT page_id, CASE WHEN url LIKE '%?%' THEN 'readmeoss' WHEN url LIKE 'https%' THEN 'cyclonedx' WHEN url LIKE '%/' THEN 'clixml' END AS format FROM pages""")
def sniff_formats(spark, sf_dir):
    p = _t(spark, sf_dir, "pages")
    notice, https = F.col("url").contains("?"), F.col("url").startswith("https")
    name = F.when(notice, "a.txt").when(https, "a.json").when(F.col("url").endswith("/"), "a.xml").otherwise("a.txt")
    head = F.when(notice, F.concat(F.repeat(F.lit("="), F.lit(120)), "html")).when(https, F.concat(F.lit('{"bomFormat":"'), "html")).otherwise(F.concat(F.lit("<ComponentLicenseInformation>"), "html"))
    raw = p.select("page_id", F.concat(F.lit("/in/"), name).alias("path"), head.cast("binary").alias("content"))
    return reports.with_format(raw).select("page_id", "format")


# --- edits -------------------------------------------------------------------------------------------------------


def _order_fields(spark, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.inline(F.array(F.struct(F.lit("status").alias("field"), F.col("o_orderstatus").alias("value")), F.struct(F.lit("priority").alias("field"), F.col("o_orderpriority").alias("value")))))


@query("""WITH f AS (SELECT o_orderkey, 'status' AS field, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders),
l AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'status' ELSE 'priority' END AS field, arg_max(row(CASE WHEN l_linenumber = 7 THEN 'remove' ELSE 'replace' END, l_linestatus), row(l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS e FROM lineitem GROUP BY 1, 2)
SELECT o_orderkey, f.field, CASE WHEN e IS NOT NULL THEN e[2] ELSE value END AS value FROM f LEFT JOIN l ON l_orderkey = o_orderkey AND l.field = f.field WHERE e IS NULL OR e[1] <> 'remove'""")
def keyed_edits(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    e = li.select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") == "R", "status").otherwise("priority").alias("field"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("seq"), F.when(F.col("l_linenumber") == 7, "remove").otherwise("replace").alias("op"), F.col("l_linestatus").alias("value"))
    return edits.apply_keyed_edits(_order_fields(spark, sf_dir), e, ["o_orderkey", "field"])


def _order_docs(spark, sf_dir: str, edited: bool) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "open").otherwise(F.col("o_orderstatus")) if edited else F.col("o_orderstatus")
    tags = F.when(F.col("o_orderpriority").startswith("1"), F.array(F.lit("urgent"), F.lit("first"))).otherwise(F.array(F.lit("urgent"))) if edited else F.array(F.lit("urgent"), F.lit("first"))
    return o.select(F.col("o_orderkey").alias("set_id"), F.to_json(F.struct(status.alias("status"), F.col("o_orderpriority").alias("priority"), tags.alias("tags"))).alias("json"))


@query("""SELECT o_orderkey AS set_id, 'replace' AS op, '/status' AS path, '"open"' AS value FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, 'remove', '/tags/1', NULL FROM orders WHERE o_orderpriority NOT LIKE '1%'""")
def diff_to_edits(spark, sf_dir):
    old, new = (tree.field_tree(_order_docs(spark, sf_dir, x), with_json=True) for x in (False, True))
    return edits.diff_to_edits(old, new).select("set_id", "op", "path", "value")


@query("""SELECT o_orderkey AS set_id, '/priority' AS path, '"' || o_orderpriority || '"' AS value FROM orders UNION ALL SELECT o_orderkey, '/status', '"' || CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE o_orderstatus END || '"' FROM orders
UNION ALL SELECT o_orderkey, '/tags', '[]' FROM orders UNION ALL SELECT o_orderkey, '/tags/0', '"urgent"' FROM orders UNION ALL SELECT o_orderkey, '/tags/1', '"first"' FROM orders WHERE o_orderpriority LIKE '1%'""")
def edit_fold(spark, sf_dir):
    old, new = (tree.field_tree(_order_docs(spark, sf_dir, x), with_json=True) for x in (False, True))
    log = edits.diff_to_edits(old, new).withColumn("from_path", F.lit(None).cast("string"))
    return edits.apply_edits(old, log)[0].select("set_id", "path", "value")


@query("""SELECT event_id AS seq, CASE length(event_type) % 3 WHEN 0 THEN 'null → ' || coalesce(CAST(CAST(value AS DECIMAL(18,4)) AS VARCHAR), 'null') || ' at /' || event_type WHEN 1 THEN 'Removed /' || event_type ELSE 'Added ' || coalesce(CAST(CAST(value AS DECIMAL(18,4)) AS VARCHAR), 'null') || ' at ' || event_type END AS summary FROM events""")
def summarized_edits(spark, sf_dir):
    return edits.summarize_edits(_event_edits(spark, sf_dir)).select("seq", "summary")


@query("SELECT event_id AS seq FROM events WHERE lower(event_type) LIKE '%click%'")
def searched_edits(spark, sf_dir):
    e = edits.summarize_edits(_event_edits(spark, sf_dir))
    return cat.search_edits(e, "CLICK").select("seq")


# --- trees -------------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT event_id, unnest(json_keys(props)) AS name, props FROM events WHERE props IS NOT NULL) SELECT event_id AS set_id, '/' || name AS path, lower(json_type(props, '$.' || name)) IN ('object', 'array') AS is_container FROM p""")
def field_tree(spark, sf_dir):
    d = _t(spark, sf_dir, "events").select(F.col("event_id").alias("set_id"), F.col("props").alias("json"))
    return tree.field_tree(d, hide=False).filter("depth = 1").select("set_id", "path", (~F.col("is_leaf")).alias("is_container"))


@query("""WITH e AS (SELECT o_custkey AS set_id, o_orderpriority AS field, o_orderstatus AS src FROM orders), p AS (SELECT set_id, field, array_to_string(list_sort(list(DISTINCT src)), '|') AS sources, min(src) <> max(src) AS in_conflict FROM e GROUP BY 1, 2) SELECT set_id, field, sources, in_conflict FROM p""")
def tree_overlay(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("set_id"), F.lit("id").alias("identity_key"), F.col("o_orderpriority").alias("field"), F.col("o_orderstatus").alias("src"))
    p = o.groupBy("set_id", "identity_key", "field").agg(F.collect_set("src").alias("sources"), F.min("src").alias("lo"), F.max("src").alias("hi"))
    t = tree.overlay(o.select("set_id", "identity_key", "field").distinct(), p.select("set_id", "identity_key", "field", "sources"), p.filter("lo <> hi").select("set_id", "identity_key", "field"))
    return t.select("set_id", "field", _join("sources").alias("sources"), "in_conflict")


# --- lines and diffs ---------------------------------------------------------------------------------------------


def _pair_texts(spark, sf_dir: str) -> DataFrame:
    """Every document (left) and the next one of its source (right). Only ids are put in order."""
    d = _t(spark, sf_dir, "documents")
    nxt = F.lead("doc_id").over(Window.partitionBy("source").orderBy("doc_id"))
    ids = d.select("source", "doc_id").select("doc_id", nxt.alias("next_id")).filter("next_id is not null")
    p = d.select("doc_id", "text").join(ids, "doc_id").join(d.select(F.col("doc_id").alias("next_id"), F.col("text").alias("other")), "next_id")
    return p.filter("other is not null and text is not null").select(F.col("doc_id").alias("pair_id"), F.col("text").alias("left"), F.col("other").alias("right"))


def _pairs(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The lines of both sides of a pair."""
    p = _pair_texts(spark, sf_dir)
    return lines.lines(p, ["pair_id"], "left"), lines.lines(p, ["pair_id"], "right")


_PAIRS = """WITH p AS (SELECT doc_id AS pair_id, text, lead(text) OVER (PARTITION BY source ORDER BY doc_id) AS other FROM documents), q AS (SELECT * FROM p WHERE other IS NOT NULL AND text IS NOT NULL),
l AS (SELECT pair_id, unnest(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10))) AS line FROM q WHERE text <> ''), r AS (SELECT pair_id, unnest(string_split(regexp_replace(other, chr(10) || '$', ''), chr(10))) AS line FROM q WHERE other <> ''),
lc AS (SELECT pair_id, line, count(*) AS a FROM l GROUP BY 1, 2), rc AS (SELECT pair_id, line, count(*) AS b FROM r GROUP BY 1, 2) """


#: After _PAIRS: lcs(pair_id, n, m, n_equal), with the length of a longest common subsequence of both sides' lines. Line by
#: line of the left side, tails[k] is the least right line at which a common subsequence of k lines ends.
_LCS = """, li AS (SELECT pair_id, CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)) END AS s, CASE WHEN other = '' THEN [] ELSE string_split(regexp_replace(other, chr(10) || '$', ''), chr(10)) END AS t FROM q),
""" + (_STEPS := """z AS (SELECT pair_id, 0::BIGINT AS i, []::BIGINT[] AS tails FROM li UNION ALL
  SELECT pair_id, i + 1, list_reduce(list_transform(list_filter(range(len(t)::BIGINT, 0, -1), lambda j: t[j] = s[i + 1]), lambda j: [j]), lambda a, x: a[1:len(list_filter(a, lambda v: v < x[1]))] || x || a[len(list_filter(a, lambda v: v < x[1])) + 2:], tails) FROM z JOIN li USING (pair_id) WHERE i < len(s)),
lcs AS (SELECT pair_id, len(s)::BIGINT AS n, len(t)::BIGINT AS m, len(tails)::BIGINT AS n_equal FROM z JOIN li USING (pair_id) WHERE i = len(s)) """)
_RECURSIVE_PAIRS = _PAIRS.replace("WITH", "WITH RECURSIVE", 1)


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(len(string_split(text, chr(10))) - CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN 1 ELSE 0 END AS BIGINT) AS n_lines FROM documents")
def line_stats(spark, sf_dir):
    return lines.source_stats(_t(spark, sf_dir, "documents"), ["doc_id"])


@query("WITH x AS (SELECT doc_id, string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)) AS s FROM documents WHERE text <> ''), y AS (SELECT doc_id, unnest(range(len(s))) AS line_no, s FROM x) SELECT doc_id, line_no, s[line_no + 1] AS line FROM y WHERE line_no BETWEEN 2 AND 5")
def line_window(spark, sf_dir):
    return lines.line_window(lines.lines(_t(spark, sf_dir, "documents"), ["doc_id"]), 2, 4).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query(_PAIRS + "SELECT pair_id, CAST(sum(greatest(coalesce(a, 0) - coalesce(b, 0), 0)) AS BIGINT) AS removed, CAST(sum(greatest(coalesce(b, 0) - coalesce(a, 0), 0)) AS BIGINT) AS added FROM lc FULL JOIN rc USING (pair_id, line) GROUP BY 1")
def changed_line_counts(spark, sf_dir):
    return lines.changed_line_counts(*_pairs(spark, sf_dir))


def _checked_runs(ops: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Per pair what must hold of any shortest script: how many lines it keeps, whether its runs cover both sides without
    gaps and start at the rows that the runs before them end at, and whether those called equal have equal lines."""
    w = Window.partitionBy("pair_id").orderBy("op_no")
    start = lambda c: F.coalesce(F.lag(c).over(w), F.lit(0))
    span = F.greatest(F.col("i2") - F.col("i1"), F.col("j2") - F.col("j1"))
    after = F.coalesce(F.lag(F.col("row_start") + span).over(w), F.lit(0))
    good = (F.col("i1") == start("i2")) & (F.col("j1") == start("j2")) & (F.col("row_start") == after) & ((F.col("tag") != "equal") | (F.col("i2") - F.col("i1") == F.col("j2") - F.col("j1")))
    kept = F.sum(F.when(F.col("tag") == "equal", F.col("i2") - F.col("i1")).otherwise(0)).cast("long")
    runs = ops.withColumn("good", good).groupBy("pair_id").agg(F.max("i2").cast("long").alias("left_lines"), F.max("j2").cast("long").alias("right_lines"), kept.alias("n_equal"), F.bool_and("good").alias("without_gaps"))
    wrong = lines.diff_rows(ops, a, b).filter("type = 'equal' and not (left <=> right)").select("pair_id").distinct().withColumn("_wrong", F.lit(True))
    return runs.join(wrong, "pair_id", "left").withColumn("equals_match", F.col("_wrong").isNull()).drop("_wrong")


_RUNS = "SELECT pair_id, n AS left_lines, m AS right_lines, n_equal, true AS without_gaps, true AS equals_match FROM lcs WHERE n + m > 0"


@query(_RECURSIVE_PAIRS + _LCS + _RUNS)
def opcodes(spark, sf_dir):
    a, b = _pairs(spark, sf_dir)
    return _checked_runs(lines.opcodes(a, b), a, b)


@query("WITH RECURSIVE c AS (SELECT c_nationkey, list(c_mktsegment ORDER BY c_custkey) AS x FROM customer GROUP BY 1), li AS (SELECT c.c_nationkey AS pair_id, c.x AS s, d.x AS t FROM c JOIN c d ON d.c_nationkey = c.c_nationkey + 1), " + _STEPS + _RUNS)
def aligned_segments(spark, sf_dir):
    """The customers' segments of a nation and of the next one as lines: five different ones, over and over."""
    c = _t(spark, sf_dir, "customer").select("c_nationkey", F.col("c_mktsegment").alias("line"), (F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1).alias("line_no"))
    nations = c.select(F.col("c_nationkey").alias("n")).distinct()
    a = c.join(nations, F.col("n") == F.col("c_nationkey") + 1, "left_semi").select(F.col("c_nationkey").alias("pair_id"), "line_no", "line")
    b = c.join(nations, F.col("n") == F.col("c_nationkey") - 1, "left_semi").select((F.col("c_nationkey") - 1).alias("pair_id"), "line_no", "line")
    return _checked_runs(lines.opcodes(a, b), a, b)


@query(_RECURSIVE_PAIRS + _LCS + """, x AS (SELECT pair_id, 'left' AS side, unnest(range(len(s))) AS line_no, unnest(s) AS line FROM li UNION ALL SELECT pair_id, 'right', unnest(range(len(t))), unnest(t) FROM li)
SELECT pair_id, side, line_no, line, n_equal FROM x JOIN lcs USING (pair_id)""")
def diff_rows(spark, sf_dir):
    """Both sides read back from the rows of the diff, with the number of rows that are equal."""
    a, b = _pairs(spark, sf_dir)
    rows = lines.diff_rows(lines.opcodes(a, b), a, b)
    equal = rows.groupBy("pair_id").agg(F.count_if((F.col("type") == "equal") & (F.col("left") == F.col("right"))).alias("n_equal"))
    side = lambda n: rows.filter(F.col(f"{n}_no").isNotNull()).select("pair_id", F.lit(n).alias("side"), F.col(f"{n}_no").cast("long").alias("line_no"), F.col(n).alias("line"))
    return side("left").unionByName(side("right")).join(equal, "pair_id")


@query(_RECURSIVE_PAIRS + _LCS + "SELECT pair_id, n AS left_lines, m AS right_lines, n_equal, n + m - 2 * n_equal AS n_changed FROM lcs WHERE n + m > 0")
def diff_sizes(spark, sf_dir):
    """Rows per tag, and the changed lines of both sides that they stand for."""
    a, b = _pairs(spark, sf_dir)
    ops = lines.opcodes(a, b)
    changed = ops.filter("tag <> 'equal'").groupBy("pair_id").agg(F.sum(F.col("i2") - F.col("i1") + F.col("j2") - F.col("j1")).cast("long").alias("n_changed"))
    m = lines.diff_meta(ops).filter("n_equal + n_replace + n_insert + n_delete = n_rows")
    return m.join(changed, "pair_id", "left").select("pair_id", "left_lines", "right_lines", "n_equal", F.coalesce("n_changed", F.lit(0)).cast("long").alias("n_changed"))


@query(_PAIRS + "SELECT pair_id, side, count(*) AS n FROM (SELECT pair_id, 'left' AS side, line FROM l UNION ALL SELECT pair_id, 'right', line FROM r) WHERE lower(line) LIKE '%license%' GROUP BY 1, 2")
def search_diff(spark, sf_dir):
    a, b = _pairs(spark, sf_dir)
    return lines.search_diff(lines.opcodes(a, b), a, b, "License", limit=None).groupBy("pair_id", "side").agg(F.count(F.lit(1)).alias("n"))


@query(TEXTS + """, m AS (SELECT identity_key, arg_min(doc_id, row(input_index, doc_id)) AS v FROM e GROUP BY 1), s AS (SELECT source, identity_key, min(doc_id) AS v FROM e GROUP BY 1, 2)
SELECT source, s.identity_key, s.v AS left_value, m.v AS right_value, 'changed' AS status FROM s JOIN m USING (identity_key) WHERE s.v IS DISTINCT FROM m.v""")
def diff_entries(spark, sf_dir):
    e = text_entries(spark, sf_dir)
    m = merge.merge_entries(e, ["identity_key"], _ORDER, first=["doc_id"]).select("identity_key", F.col("doc_id").alias("value"))
    s = e.groupBy("source_id", "identity_key").agg(F.min_by("doc_id", "entry_ord").alias("value"))
    right = s.select("source_id", "identity_key").join(m, "identity_key")
    return lines.diff_entries(s, right, ["source_id", "identity_key"]).withColumnRenamed("source_id", "source")


# --- catalogue ---------------------------------------------------------------------------------------------------


def _catalog(spark, sf_dir: str) -> DataFrame:
    sets = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("set_id"), F.col("c_mktsegment").alias("format"), F.expr("timestamp'2024-01-01' + make_dt_interval(0, 0, c_custkey * 7919 % 1000)").alias("created_at"), F.col("c_name").alias("output_filename"))
    o = _t(spark, sf_dir, "orders")
    inputs = o.select(F.col("o_custkey").alias("set_id"), F.col("o_orderkey").alias("input_index"), F.concat(F.lit("o"), "o_orderkey").alias("source_id"))
    return cat.catalog(sets, inputs, o.filter("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "set_id"), o.filter("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "set_id"))


_CATALOG = """WITH k AS (SELECT c_custkey AS set_id, c_mktsegment AS format, c_name, count(o_orderkey) AS n_inputs, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_conflicts, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_edits,
  coalesce(string_agg('o' || o_orderkey, '|' ORDER BY o_orderkey), '') AS inputs FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3) """


@query(_CATALOG + "SELECT set_id, format, n_inputs, n_conflicts, n_edits, inputs FROM k")
def catalog_summary(spark, sf_dir):
    return _catalog(spark, sf_dir).select("set_id", "format", "n_inputs", "n_conflicts", "n_edits", F.coalesce(_join("inputs"), F.lit("")).alias("inputs"))


@query(_CATALOG + "SELECT set_id FROM k WHERE (n_conflicts > 0 OR n_edits > 0) AND (lower(c_name) LIKE '%1%' OR CAST(set_id AS VARCHAR) LIKE '%1%' OR inputs LIKE '%1%' OR format LIKE '%1%' OR '2024-01-01 00:00:00' LIKE '%1%')")
def catalog_search(spark, sf_dir):
    return cat.search_catalog(_catalog(spark, sf_dir), "1", status="either").select("set_id")


@query("SELECT DISTINCT c_mktsegment AS format FROM customer")
def format_facets(spark, sf_dir):
    return cat.format_facets(_catalog(spark, sf_dir))


@query("SELECT o_custkey AS set_id, '/' || o_orderkey AS path, o_orderstatus AS sources FROM orders")
def provenance_roundtrip(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumn("set_id", F.col("o_custkey").cast("string"))
    sets = o.select("set_id").distinct().withColumns({"format": F.lit("f"), "created_at": F.lit("2024-01-01").cast("timestamp")})
    p = o.select("set_id", F.concat(F.lit("/"), "o_orderkey").alias("path"), F.array("o_orderstatus").alias("sources"))
    c = o.select("set_id", F.lit("p").alias("path"), F.array(F.struct(F.lit("s").alias("source"), F.lit("v").alias("value"))).alias("values"), F.lit("first-writer").alias("resolution"), F.lit("v").alias("chosen"))
    e = edits.summarize_edits(_event_edits(spark, sf_dir)).withColumn("set_id", F.col("set_id").cast("string"))
    i = o.select("set_id", F.col("o_orderkey").alias("input_index"), F.col("o_orderpriority").alias("source_id"))
    back = provenance.parse_provenance(provenance.provenance_records(sets, i, p, c, e))["provenance"]
    return back.select(F.col("set_id").cast("long").alias("set_id"), "path", _join("sources").alias("sources"))


# --- arriving entries --------------------------------------------------------------------------------------------


def _events(spark, sf_dir: str) -> DataFrame:
    """The events as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet")  # a pattern: the table may be one file


@query("SELECT user_id, event_type, count(*) AS n_entries, arg_min(value, event_id) FILTER (WHERE value IS NOT NULL) AS value FROM events GROUP BY 1, 2")
def merge_stream(spark, sf_dir):
    """Events as entries that arrive through a stream; the merged table after the last batch."""
    path = folder(spark, "merge-stream")
    stream = _events(spark, sf_dir)
    target = MergeTable(spark, path, ["user_id", "event_type"], ["input_index", "event_id"], first=["value"])
    ready = lambda df: df.select("user_id", "event_type", F.lit(0).alias("input_index"), "event_id", F.lit("in").alias("source_id"), "value")
    target.start(stream, f"{path}/checkpoint", ready).awaitTermination()
    return target.merged().select("user_id", "event_type", "n_entries", "value")


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n_entries FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """Events as a stream; each batch brings the counts of all windows up to date."""
    path = folder(spark, "event-windows")
    counted = arrivals(_events(spark, sf_dir), "ts", by=["event_type"])
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{path}/counts")
    counted.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(f"{path}/counts").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# --- more of edits, trees, checks and sources --------------------------------------------------------------------


@query("SELECT c_custkey AS set_id, coalesce(arg_max(o_orderpriority, o_orderkey), c_name) AS text FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey, c_name")
def replaced_documents(spark, sf_dir):
    texts = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("set_id"), F.col("c_name").alias("text"))
    log = _t(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("set_id"), F.col("o_orderkey").alias("seq"), F.lit("replace").alias("op"), F.lit("/").alias("path"), F.col("o_orderpriority").alias("value"))
    return edits.replace_documents(texts, log)


@query("""SELECT o_orderkey AS set_id, l_linenumber AS seq, '"' || o_orderstatus || '"' AS old_value FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'""")
def resolved_edits(spark, sf_dir):
    t = tree.field_tree(_order_docs(spark, sf_dir, False))
    path = F.when(F.col("l_returnflag") == "R", "/status").otherwise("/nowhere")
    log = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("set_id"), F.col("l_linenumber").alias("seq"), path.alias("path"))
    return edits.value_at(edits.path_exists(log, t), t).select("set_id", "seq", "old_value")


@query("""WITH t AS (SELECT o_orderkey AS set_id, unnest(['/priority', '/status', '/tags', '/tags/0', '/tags/1']) AS path FROM orders) SELECT set_id, path, true AS truncated FROM t WHERE path < '/tags/0'""")
def truncated_tree(spark, sf_dir):
    return tree.truncate_tree(tree.field_tree(_order_docs(spark, sf_dir, False)), 3).select("set_id", "path", "truncated")


@query("""SELECT o_orderkey AS set_id, '/priority' AS path FROM orders WHERE lower(o_orderpriority) LIKE '%urgent%' UNION ALL SELECT o_orderkey, '/tags/0' FROM orders""")
def filtered_tree(spark, sf_dir):
    return tree.filter_tree(tree.field_tree(_order_docs(spark, sf_dir, False)), "all", "URGENT").select("set_id", "path")


@query("SELECT page_id FROM pages WHERE len(string_split(rtrim(regexp_replace(url, '[?&#]+', ' ', 'g')), ' ')) < 3")
def malformed_lines(spark, sf_dir):
    line = F.concat(F.lit("Relationship: "), F.regexp_replace("url", "[?&#]+", " "))
    return checks.malformed_lines(_t(spark, sf_dir, "pages").withColumn("line", line)).select("page_id")


@query("SELECT lang AS set_id, CASE WHEN min(f) = max(f) THEN min(f) END AS format FROM (SELECT regexp_extract(html, 'lang=\"([a-z]*)\"', 1) AS lang, CASE WHEN url LIKE 'https%' THEN 'dep5' ELSE 'clixml' END AS f FROM pages) GROUP BY 1")
def set_formats(spark, sf_dir):
    p = _t(spark, sf_dir, "pages")
    name = F.when(F.col("url").startswith("https"), "/x/DEP5_a.txt").otherwise("/x/CLIXML_a.xml")
    raw = p.select(F.regexp_extract("html", 'lang="([a-z]*)"', 1).alias("set_id"), name.alias("path"), F.col("html").cast("binary").alias("content"))
    return reports.set_formats(reports.with_format(raw))


@query(_RECURSIVE_PAIRS + _LCS + """, h AS (SELECT pair_id, len(list_filter(s, lambda v: starts_with(v, '--'))) + len(list_filter(t, lambda v: starts_with(v, '++'))) AS n_headers FROM li)
SELECT pair_id, n + m - 2 * n_equal AS n_changed, CASE WHEN text = other THEN 'same' WHEN n + m = 2 * n_equal THEN 'line ends' ELSE 'lines' END AS kind, true AS fits FROM lcs JOIN q USING (pair_id) JOIN h USING (pair_id) WHERE n_headers = 0""")
def text_diff_summary(spark, sf_dir):
    """Summaries of pairs without lines that read as a diff's header (those are left out of a summary): how many changed
    lines each speaks of, what kind it is, and whether it is short."""
    a, b = _pairs(spark, sf_dir)
    said = lines.summarize_text_diff(lines.opcodes(a, b), a, b, _pair_texts(spark, sf_dir))
    headers = a.filter(F.col("line").startswith("--")).select("pair_id").unionByName(b.filter(F.col("line").startswith("++")).select("pair_id"))
    kind = F.when(F.col("summary") == "(no textual change)", "same").when(F.col("summary") == "Document updated", "line ends").when(F.col("summary").rlike("^[-+]"), "lines")
    said = said.join(headers.distinct(), "pair_id", "left_anti")
    return said.select("pair_id", "n_changed", kind.alias("kind"), (F.length("summary") <= 400).alias("fits"))
