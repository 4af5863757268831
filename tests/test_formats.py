import json

import pytest
from pyspark.sql import functions as F

from tributary.plans.merge import merge, merge_texts
from tributary.sources import formats as fm
from tributary.sources import provenance, reports


def texts(spark, *bodies):
    return spark.createDataFrame([("s", i, f"in{i}", b) for i, b in enumerate(bodies)], "set_id string, input_index int, source_id string, text string")


DEBIAN = """Format: https://www.debian.org/doc/packaging-manuals/copyright-format/1.0/
Comment: a
 .b

Files: a.c
       b.c
Copyright: me
License: MIT

License: MIT
 text
 .
 ..hidden line
"""


def test_debian_copyright(spark):
    rows = {r["kind"]: r for r in fm.entries_from_dep5(texts(spark, DEBIAN)).collect()}
    assert (rows["stanza"]["files"], rows["stanza"]["license"], rows["license_text"]["text"]) == (["a.c", "b.c"], "MIT", "text\n\n.hidden line")
    (h,) = fm.header_from_dep5(texts(spark, DEBIAN.replace("\n", "\r\n"))).collect()
    assert h["Comment"] == "a\nb"


def test_overlapping_globs(spark):
    out = merge_texts(texts(spark, DEBIAN, DEBIAN.replace("MIT", "GPL-2.0-only")), "dep5")
    got = {(r["path"], r["chosen"]) for r in out["overlaps"].collect()}
    assert got == {("a.c", "GPL-2.0-only"), ("b.c", "GPL-2.0-only")}
    assert out["merged"].filter("kind = 'license_text'").count() == 1


def test_tag_values(spark):
    body = "PackageName: p\nSPDXID: SPDXRef-p\nPackageChecksum: SHA1: AB\nPackageCopyrightText: <text> x\nKey: inside\ny </text>\n##File\nFileName: f\nSPDXID: SPDXRef-f\nFileChecksum: MD5: CD\nLicenseInfoInFile: MIT\nLicenseInfoInFile: GPL\nLicenseID: LicenseRef-1\nExtractedText: <text> t </text>\n"
    rows = {r["kind"]: r for r in fm.entries_from_tagvalue(texts(spark, body)).collect()}
    assert rows["package"]["PackageCopyrightText"] == "<text> x\nKey: inside\ny </text>" and rows["package"]["identity_key"] == "ab"
    assert rows["file"]["LicenseInfoInFile"] == ["MIT", "GPL"] and rows["file"]["identity_key"] == "cd"
    assert rows["license_text"]["ref"] == "LicenseRef-1"


def test_component_xml_with_several_roots(spark):
    one = '<?xml version="1.0"?>\n<ComponentLicenseInformation component="{0}" componentSHA1="{1}"><License name="MIT"><Content><![CDATA[same ]]></Content><Files>a\nb</Files></License><Obligation><Topic>t</Topic><Text>x</Text><Licenses><License>z</License><License>y</License></Licenses></Obligation></ComponentLicenseInformation>\n'
    e = fm.entries_from_clixml(texts(spark, one.format("c1", "AA") + one.format("c2", "BB") + one.format("c3", "").replace(' componentSHA1=""', "")))
    assert e.groupBy("section").count().collect().__len__() == 3
    assert {r["section"]: r["count"] for r in e.groupBy("section").count().collect()} == {"Component": 3, "License": 2, "Obligation": 2}
    again = fm.entries_from_clixml(texts(spark, fm.render_clixml(fm.regroup_components(e.filter("component is not null"))).first()["text"]))
    pick = lambda d: {(r["section"], r["component"], r["identity_key"], r["name"]) for r in d.filter("component is not null").collect()}
    assert pick(again) == pick(e)


def test_nodes(spark):
    nodes = [{"type": "CreationInfo", "@id": "_:c"}, {"type": "software_Package", "spdxId": "u#SPDXRef-p", "name": "p", "verifiedUsing": [{"algorithm": "SHA1", "hashValue": "AB"}]}, {"type": "Relationship", "spdxId": "r", "from": "a", "to": ["b"]}, {"type": "Annotation", "spdxId": "n", "subject": "u#SPDXRef-p"}]
    n = fm.nodes_from_spdx3(texts(spark, json.dumps(nodes).replace(" ", "\t"), json.dumps(nodes)))
    assert fm.entries_from_spdx3(texts(spark, json.dumps(nodes))).first()["identity_key"] == "ab"
    (row,) = fm.render_spdx3(fm.assemble_spdx3(n)).collect()
    assert [x["type"] for x in json.loads(row["text"])] == ["CreationInfo", "software_Package", "Annotation", "Relationship"]


def test_components_with_equal_references(spark):
    """Two reports name a lamp and its bulb alike, but mean four things."""
    part = lambda kind, name, ref, digest: {"type": kind, "name": name, "bom-ref": ref, "hashes": [{"alg": "MD5", "content": digest}]}
    doc = lambda n: json.dumps({"bomFormat": "CycloneDX", "specVersion": "1.4", "metadata": {"component": part("device", "lamp", "lamp", f"c{n}")}, "components": [part("file", "bulb", "lamp/bulb", f"d{n}")]})
    merged = merge_texts(texts(spark, doc(0), doc(1)), "cyclonedx")["merged"].collect()
    assert {(r["ref"], r["upload_ref"]) for r in merged} == {(f"input{n}-lamp", None) for n in range(2)} | {(f"input{n}-lamp/bulb", f"input{n}-lamp") for n in range(2)}


def test_files(spark, tmp_path):
    for name, body in {"b.spdx": "PackageName: y\nSPDXID: SPDXRef-1\nPackageChecksum: SHA1: 02\n", "a.spdx": "PackageName: x\nSPDXID: SPDXRef-1\nPackageChecksum: SHA1: 01\n"}.items():
        (tmp_path / name).write_text(body)
    raw = reports.with_format(reports.read_reports(spark, f"{tmp_path}/*.spdx"))
    assert [(r["input_index"], r["source_id"], r["format"]) for r in raw.orderBy("input_index").collect()] == [(0, "a", "spdx2tv"), (1, "b", "spdx2tv")]
    assert merge(spark, f"{tmp_path}/*.spdx")["merged"].count() == 2
    with pytest.raises(ValueError):
        merge(spark, f"{tmp_path}/*.spdx", format="dep5")
    with pytest.raises(ValueError):
        reports.read_reports(spark)


def test_own_format(spark):
    fm.register_format("mine", lambda t: t.select("set_id", "input_index", "source_id", F.lit(0).alias("entry_ord"), F.lit("k").alias("kind"), F.md5("text").alias("identity_key")))
    try:
        assert merge_texts(texts(spark, "a", "a", "b"), "mine")["merged"].count() == 2
    finally:
        del fm.PARSERS["mine"]


def test_provenance_records(spark, tmp_path):
    sets = spark.sql("select 's' as set_id, 'dep5' as format, timestamp'2024-01-01' as created_at")
    inputs = spark.sql("select 's' as set_id, 0 as input_index, 'a' as source_id")
    p = spark.sql("select 's' as set_id, '/k/i' as path, array('a') as sources")
    c = spark.sql("select 's' as set_id, '/k/i/f' as path, array(named_struct('source','a','value','1')) as values, 'first-writer' as resolution, '1' as chosen")
    e = spark.sql("select 's' as set_id, 1L as seq, 'w' as who, timestamp'2024-01-01' as when, 'remove' as op, '/x' as path, cast(null as string) as value, cast(null as string) as from_path, 'r' as reason, 's' as summary")
    provenance.write_provenance(provenance.provenance_records(sets, inputs, p, c, e), str(tmp_path / "p"))
    with open(tmp_path / "p" / "part-bad.txt", "w") as f:
        f.write("not a record\n")
    back = provenance.read_provenance(spark, str(tmp_path / "p"))
    assert {k: v.count() for k, v in back.items()} == {"inputs": 1, "provenance": 1, "conflicts": 1, "edits": 1}
