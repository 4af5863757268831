"""The one-call merge of every format: references, policies, rendered reports; and tables that arrive bit by bit."""

import json

import pytest

from tributary.operators import checks
from tributary.plans.merge import merge, merge_texts
from tributary.sources import formats, provenance
from tributary.streaming.merge_stream import MergeTable, remerge

TEXTS = "set_id string, input_index int, source_id string, text string"


def tag_report(n: int, name: str, licence: str, more: str = "") -> str:
    """Every report calls its licence LicenseRef-A and its elements by the same ids."""
    return f"""SPDXVersion: SPDX-2.3
SPDXID: SPDXRef-DOCUMENT
Creator: Tool: t{n}

Relationship: SPDXRef-DOCUMENT DESCRIBES SPDXRef-p
Relationship: SPDXRef-p CONTAINS SPDXRef-f
Relationship: SPDXRef-p CONTAINS SPDXRef-g

##Package

PackageName: tool
SPDXID: SPDXRef-p
PackageDownloadLocation: https://host/{n}
PackageLicenseConcluded: (LicenseRef-A OR Zlib)
PackageLicenseDeclared: LicenseRef-A
PackageChecksum: SHA1: 00{n}
ExternalRef: SECURITY cpe{n} x
ExternalRef: SECURITY all x

##File

FileName: main.c
SPDXID: SPDXRef-f
FileChecksum: SHA1: FFEE
LicenseConcluded: LicenseRef-A AND Zlib
LicenseInfoInFile: LicenseRef-A
FileCopyrightText: <text>2019 A.
2020 B.</text>
{more}
##File

FileName: own{n}.c
SPDXID: SPDXRef-g
FileChecksum: SHA1: AB{n}
LicenseInfoInFile: Zlib

LicenseID: LicenseRef-A
LicenseName: {name}
LicenseComments: comment {n}
ExtractedText: <text>{licence}</text>
"""


def tag_texts(spark):
    return spark.createDataFrame([("s", 0, "a", tag_report(0, "first", "the same")), ("s", 1, "b", tag_report(1, "last", "the same")), ("s", 2, "c", tag_report(2, "other", "another one", "FileComment: only here"))], TEXTS)


def test_tag_value_references_and_fields(spark, tmp_path):
    t = merge_texts(tag_texts(spark), "spdx2tv", str(tmp_path))
    rows = {(r["kind"], r["identity_key"]): r for r in t["merged"].collect()}
    assert len(rows) == 3 + 4 + 2
    ids = {r["ref"] for r in rows.values()}
    assert len(ids) == len(rows) and all(i.startswith(("SPDXRef-input", "input")) for i in ids)
    same = next(r for r in rows.values() if r["kind"] == "license_text" and "same" in r["ExtractedText"])
    assert (same["LicenseID"], same["ref"], same["LicenseName"]) == ("input1-LicenseRef-A", "input1-LicenseRef-A", "last")
    packages = [rows["package", f"00{n}"] for n in range(3)]
    assert [p["PackageLicenseConcluded"] for p in packages] == [f"({x} OR Zlib)" for x in ("input1-LicenseRef-A", "input1-LicenseRef-A", "input2-LicenseRef-A")]
    assert packages[0]["SPDXID"] == "SPDXRef-input0-p" and sorted(packages[0]["externalRefs"]) == ["SECURITY all x", "SECURITY cpe0 x"]
    shared = rows["file", "ffee"]
    assert shared["LicenseConcluded"] == "input1-LicenseRef-A AND Zlib" and shared["LicenseInfoInFile"] == ["input1-LicenseRef-A", "input2-LicenseRef-A"]
    assert {x["tag"]: x["values"] for x in shared["tags"]} == {"FileCopyrightText": ["<text>2019 A.\n2020 B.</text>"], "FileComment": ["only here"]}
    assert t["dangling"].count() == 0
    assert {tuple(r)[1:] for r in t["relationships"].filter("type = 'CONTAINS'").collect()} == {(f"SPDXRef-input{n}-p", "CONTAINS", x) for n in range(3) for x in ("SPDXRef-input0-f", f"SPDXRef-input{n}-g")}
    assert t["conflicts"].count() == 0


def test_rendered_reports_merge_to_themselves(spark, tmp_path):
    t = merge_texts(tag_texts(spark), "spdx2tv", str(tmp_path / "a"))
    (report,) = t["reports"].collect()
    for tag in ("PackageDownloadLocation: https://host/2", "LicenseComments: comment 0", "PackageVerificationCode: ", "FileComment: only here", "ExternalRef: SECURITY cpe1 x"):
        assert tag in report["text"], tag
    again = merge_texts(spark.createDataFrame([("s", 0, "m", report["text"])], TEXTS), "spdx2tv", str(tmp_path / "b"))
    strip = lambda rows, c: sorted((r["kind"], r["identity_key"], str(r[c])) for r in rows)
    for c in ("tags", "externalRefs", "LicenseName", "FileName"):
        assert strip(again["merged"].collect(), c) == strip(t["merged"].collect(), c)
    assert again["dangling"].count() == 0 and again["aliases"].count() == 0


def component(ref: str, name: str, digest: str, licence: str, **more) -> dict:
    return {"type": "file", "name": name, "bom-ref": ref, "hashes": [{"alg": "SHA-1", "content": digest}, *more.get("hashes", [])], "licenses": [{"license": {"id": licence}}], "copyright": more.get("copyright")}


def test_components(spark):
    def doc(n, extra):
        main = component("main", f"m{n}", f"0{n}", "MIT")
        return json.dumps({"bomFormat": "CycloneDX", "specVersion": "1.4", "metadata": {"component": main}, "components": [component("x", "shared", "AA", "Zlib" if n else "MIT", hashes=[extra], copyright=f"c{n}"), component("y", "own", f"B{n}", "MIT")]})

    docs = [("s", n, f"in{n}", doc(n, {"alg": "SHA-256", "content": f"5{n}"})) for n in range(2)]
    t = merge_texts(spark.createDataFrame(docs, TEXTS), "cyclonedx")
    rows = {r["identity_key"]: r for r in t["merged"].collect()}
    assert set(rows) == {"00", "01", "aa", "b0", "b1"} and len({r["ref"] for r in rows.values()}) == 5
    assert rows["aa"]["licenses"] == ["MIT", "Zlib"] and {h["content"] for h in rows["aa"]["hashes"]} == {"AA", "50", "51"}
    assert {r["upload_ref"] for k, r in rows.items() if k[0] in "ab"} <= {rows["00"]["ref"], rows["01"]["ref"]}
    assert [(r["path"], r["chosen"]) for r in t["conflicts"].collect()] == [("/s/file/aa/copyright", "c0")]
    out = json.loads(t["reports"].collect()[0]["text"])
    assert len(out["components"]) == 5 and len({c["bom-ref"] for c in out["components"]}) == 5


def test_nodes(spark):
    def doc(n):
        file = {"type": "software_File", "spdxId": "urn:doc#SPDXRef-f", "name": "f", "verifiedUsing": [{"algorithm": "sha1", "hashValue": "ab"}, {"algorithm": "sha256", "hashValue": f"{n}"}]}
        package = {"type": "software_Package", "spdxId": "urn:doc#SPDXRef-p", "name": f"p{n}", "verifiedUsing": [{"algorithm": "sha1", "hashValue": f"0{n}"}]}
        rel = {"type": "Relationship", "spdxId": f"urn:doc#SPDXRef-r{n}", "from": "urn:doc#SPDXRef-p", "to": ["urn:doc#SPDXRef-f"], "relationshipType": "contains"}
        return json.dumps([{"type": "SpdxDocument", "spdxId": "urn:doc#SPDXRef-DOCUMENT", "name": "d"}, package, file, rel])

    t = merge_texts(spark.createDataFrame([("s", n, f"in{n}", doc(n)) for n in range(2)], TEXTS), "spdx3json")
    out = json.loads(t["reports"].collect()[0]["text"])
    by = {x["spdxId"]: x for x in out}
    files = [x for x in out if x["type"] == "software_File"]
    assert len(files) == 1 and {h["hashValue"] for h in files[0]["verifiedUsing"]} == {"ab", "0", "1"}
    rels = [x for x in out if x["type"] == "Relationship"]
    assert len(rels) == 2 and all(x["from"] in by and x["to"] == [files[0]["spdxId"]] for x in rels) and rels[0]["from"] != rels[1]["from"]
    assert sum(x["type"] == "SpdxDocument" for x in out) == 1


def test_copyright_notice_and_xml_reports(spark):
    dep5 = [f"Format: https://www.debian.org/doc/packaging-manuals/copyright-format/1.0/\nUpstream-Name: u{n}\n\nFiles: a.c\n       b{n}.c\nCopyright: me\nLicense: L{n}\n\nLicense: N{n}\n body\n" for n in range(2)]
    t = merge_texts(spark.createDataFrame([("s", n, f"in{n}", x) for n, x in enumerate(dep5)], TEXTS), "dep5")
    text = t["reports"].collect()[0]["text"]
    assert text.count("License: N") == 1 and text.count("Files: a.c") == 2 and "Upstream-Name: u0" in text and "merged from: in0, in1" in text
    assert t["overlaps"].count() == 1
    rule, thin = "=" * 120, "-" * 120
    notice = [f"{rule}\n\npkg{n}\n\n{thin}\n\n{rule}\n\n MAIN LICENSES \n\n{thin}\n\nname{n}\n\nshared text\n\n{thin}\n\n<Copyright notices>\n(c) {n}\n\n<notices>\n" for n in range(2)]
    text = merge_texts(spark.createDataFrame([("s", n, f"in{n}", x) for n, x in enumerate(notice)], TEXTS), "readmeoss")["reports"].collect()[0]["text"]
    assert text.count("shared text") == 1 and "pkg0" in text and "(c) 0" in text
    xml = [f'<ComponentLicenseInformation component="c" componentSHA1="AB"><GeneralInformation><ComponentVersion>{n}</ComponentVersion></GeneralInformation><License type="t" name="n"><Content><![CDATA[text]]></Content><Acknowledgements>ack{n}</Acknowledgements><Files>f{n}</Files></License></ComponentLicenseInformation>' for n in range(2)]
    t = merge_texts(spark.createDataFrame([("s", n, f"in{n}", x) for n, x in enumerate(xml)], TEXTS), "clixml")
    (licence,) = t["merged"].filter("section = 'License'").collect()
    assert licence["files"] == ["f0", "f1"] and licence["acknowledgements"] == ["ack0", "ack1"]
    assert [r["field"] for r in t["conflicts"].collect()] == ["ComponentVersion"]
    text = t["reports"].collect()[0]["text"]
    assert "<ComponentVersion>0</ComponentVersion>" in text and 'includesAcknowledgements="true"' in text and "ack0\nack1" in text


def test_files_in_reports_and_records_out(spark, tmp_path):
    for n in range(2):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"r{n}.spdx").write_text(tag_report(n, f"n{n}", "same"))
    out = merge(spark, str(tmp_path / "in" / "*.spdx"), output=str(tmp_path / "out"))
    assert out["merged"].count() == 2 + 3 + 1
    written = spark.read.text(str(tmp_path / "out" / "report" / "*" / "*.txt"), wholetext=True).collect()
    assert len(written) == 1 and "LicenseName: n1" in written[0][0]
    record = provenance.read_provenance(spark, str(tmp_path / "out" / "provenance_records"))
    assert record["inputs"].count() == 2 and record["provenance"].filter("size(sources) = 2").count() > 0
    (tmp_path / "in" / "bad.spdx").write_text("##Package\n\nPackageName: x\nSPDXID: SPDXRef-q\n")
    (tmp_path / "in" / "none.spdx").write_text("SPDXVersion: SPDX-2.3\n")
    with pytest.raises(checks.InvalidReports, match="(?s)missing_identity.*empty_reports"):
        merge(spark, str(tmp_path / "in" / "*.spdx"))
    # A call that fails leaves what an earlier one has written, and nothing beside it; one that works replaces it.
    with pytest.raises(checks.InvalidReports):
        merge(spark, str(tmp_path / "in" / "*.spdx"), output=str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "merged")).count() == 6 and not list(tmp_path.glob("out.*"))
    again = merge(spark, str(tmp_path / "in" / "r0.spdx"), output=str(tmp_path / "out"))
    assert again["merged"].count() == 1 + 2 + 1 and not list(tmp_path.glob("out.*"))
    assert len(spark.read.text(str(tmp_path / "out" / "report" / "*" / "*.txt"), wholetext=True).collect()) == 1


@pytest.mark.parametrize(("kind", "text", "rule"), [
    ("spdx2tv", "##Package\n\nPackageName: x\nSPDXID: SPDXRef-x\nPackageChecksum: SHA1: 01\n\nRelationship: SPDXRef-x CONTAINS\n", "lines"),
    ("spdx2tv", "##Package\n\nPackageName: x\nSPDXID: SPDXRef-x\nPackageChecksum: SHA1: 01\n\n##Package\n\nPackageName: y\nSPDXID: SPDXRef-x\nPackageChecksum: SHA1: 02\n", "duplicate_refs"),
    ("dep5", "Format: f\n\nFiles: a\nCopyrihgt: me\nLicense: MIT\n", "fields"),
    ("cyclonedx", json.dumps({"bomFormat": "CycloneDX", "specVersion": "1.3", "components": [component("r", "n", "AA", "MIT")]}), "headers"),
    ("cyclonedx", json.dumps({"bomFormat": "CycloneDX", "specVersion": "1.4", "components": [component("r", "", "AA", "MIT")]}), "components"),
    ("spdx3json", json.dumps([{"type": "software_File", "spdxId": "f", "verifiedUsing": [{"algorithm": "sha1", "hashValue": "ab"}]}, {"spdxId": "g"}]), "nodes"),
])
def test_broken_reports_are_told(spark, kind, text, rule):
    texts = spark.createDataFrame([("s", 0, "a", text)], TEXTS)
    with pytest.raises(checks.InvalidReports, match=rule):
        checks.assert_valid(**formats.violations(texts, formats.PARSERS[kind](texts), kind))


def test_a_new_process_goes_on_from_the_last_batch(spark, tmp_path):
    frame = lambda *rows: spark.createDataFrame(rows, "k string, input_index int, source_id string, v string")
    new = lambda: MergeTable(spark, str(tmp_path / "t"), ["k"], ["input_index"], fan_in=2, first=["v"])
    assert new().merged() is None
    new().update(frame().limit(0), -1)
    assert new().merged() is None
    new().update(frame(("a", 5, "s5", "late"), ("b", 1, "s1", "b"), (None, 1, "s1", "none")), 0)
    new().update(frame(("c", 1, "s1", "c"), ("a", 1, "s1", "early")), 1)
    new().update(frame(("c", 1, "s1", "c"), ("a", 1, "s1", "early")), 1)  # lost after it was written, and run again
    new().update(frame().limit(0), 2)
    new().update(frame((None, 0, "s0", "sooner")), 3)
    assert {(r["k"], r["v"], r["source_id"], r["n_entries"]) for r in new().merged().collect()} == {("a", "early", "s1,s5", 2), ("b", "b", "s1", 1), ("c", "c", "s1", 1), (None, "sooner", "s0,s1", 2)}


def test_edits_are_replayed(spark):
    schema = "k string, input_index int, source_id string, v string, u string, n int"
    old = spark.createDataFrame([("a", 0, "s0", "x", "l", 1), ("b", 0, "s0", "y", None, 2)], schema)
    new = spark.createDataFrame([("c", 1, "s1", "z", "m", 3), ("a", 1, "s1", "w", "k", 4)], schema)
    log = [("a", 1, "v", "replace", "edited"), ("a", 2, "u", "replace", '["q"]'), ("b", 3, "n", "replace", "7"), ("b", 4, "v", "replace", "no"), ("b", 5, "v", "remove", None), ("gone", 6, "v", "replace", "x"), ("c", 7, "none", "remove", None)]
    merged, status = remerge(old, new, ["k"], ["input_index"], spark.createDataFrame(log, "k string, seq int, field string, op string, value string"), union=["u"], first=["v", "n"])
    got = {r["k"]: (r["v"], r["u"], r["n"]) for r in merged.collect()}
    assert got == {"a": ("edited", ["q"], 1), "b": (None, [], 7), "c": ("z", ["m"], 3)}
    assert {r["seq"]: r["status"] for r in status.collect()} == {1: "ok", 2: "ok", 3: "ok", 4: "ok", 5: "ok", 6: "missing", 7: "missing"}
