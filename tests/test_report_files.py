"""Merged reports in ordered files: equal to the texts of a row, whatever the number of tasks and files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tributary.plans.merge import merge, merge_texts
from tributary.sources import formats, report_files, reports

from test_merge_call import TEXTS, tag_report
from test_splits import report, rows


def written(tmp_path, files):
    """Text per set by the manifest."""
    out = {}
    for r in sorted(files.collect(), key=lambda r: (str(r["set_id"]), r["file_no"])):
        data = (tmp_path / r["file"]).read_bytes()
        assert len(data) == r["length"]
        out[r["set_id"]] = out.get(r["set_id"], "") + data.decode()
    return out


@pytest.fixture
def many_ranges(spark):
    """No joining of small ranges, so that one set is written by several tasks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_files_are_the_report(spark, tmp_path, many_ranges):
    """Sets with odd names, a set of many files, entries with lines, nulls and ties; all as rendered in a row."""
    rng = random.Random(2)
    sets = ["big"] * 400 + ["a/b %2F+c", "", None, "é", "x=1"] * 3
    data = [(s, k // 2, rng.choice(["package", "file", "license_text"]), f"n{k}\nline {k}", rng.choice([None, "", "MIT"])) for k, s in enumerate(sets)]
    entries = spark.createDataFrame(data, "set_id string, ord long, kind string, ExtractedText string, LicenseConcluded string").withColumns({"identity_key": F.col("ExtractedText"), "checksums": F.create_map(F.lit("SHA1"), F.lit("x")), "LicenseInfoInFile": F.array(F.lit("A"), F.lit("B"))})
    documents = entries.select("set_id").distinct().withColumn("tags", F.array(F.struct(F.lit("Creator").alias("tag"), F.lit("me").alias("value"))))
    rels = entries.filter("set_id = 'big'").select("set_id", F.col("kind").alias("src"), F.lit("CONTAINS").alias("type"), F.substring("ExtractedText", 1, 2).alias("dst"))
    files = report_files.write_reports(formats.tagvalue_pieces(documents, rels, entries.repartition(3)), str(tmp_path))
    assert files.filter("set_id = 'big'").count() > 1
    want = {r["set_id"] or None: r["text"] for r in formats.render_tagvalue(documents, rels, entries.filter("set_id <> ''")).collect() if r["set_id"]}
    got = written(tmp_path, files)
    assert set(got) == {*want, None}  # an empty name and none share the folder of a null
    assert {k: v for k, v in got.items() if k} == {k: v + "\n" for k, v in want.items()}


def test_written_reports_are_read_in_splits(spark, tmp_path, many_ranges):
    entries = spark.range(3000).select(F.when(F.col("id") % 10 == 0, "a b").otherwise("hot").alias("set_id"), F.col("id").alias("ord"), F.lit("license_text").alias("kind"), F.col("id").cast("string").alias("LicenseID"), F.concat(F.lit("<text>of\n"), F.repeat(F.lit("many lines\n"), 20), "id", F.lit("</text>")).alias("ExtractedText"), F.lit(None).cast("map<string,string>").alias("checksums"))
    documents = entries.select("set_id").distinct().withColumn("tags", F.array().cast("array<struct<tag:string,value:string>>"))
    none = spark.createDataFrame([], "set_id string, src string, type string, dst string")
    files = report_files.write_reports(formats.tagvalue_pieces(documents, none, entries), str(tmp_path))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")
    try:
        lines = report_files.written_lines(spark, str(tmp_path), files)
        assert lines.filter("set_id = 'hot'").select("split").distinct().count() > files.count() > 2
        texts = spark.createDataFrame([(s, 0, s, t) for s, t in written(tmp_path, files).items()], TEXTS)
        split, want = formats.entries_from_tagvalue_lines(lines), formats.entries_from_tagvalue(texts)
        assert want.count() == 3000 and rows(split.drop("entry_ord")) == rows(want.drop("entry_ord"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_merge_of_lines_is_that_of_texts(spark, tmp_path):
    """Read line by line and written in files: the same tables and the same report as a merge of whole texts."""
    folder = tmp_path / "in" / "s"
    folder.mkdir(parents=True)
    for n, (name, text) in enumerate((("first", "the same"), ("last", "the same"), ("other", "another one"))):
        (folder / f"r{n}.spdx").write_text(tag_report(n, name, text))
    glob = str(tmp_path / "in" / "*" / "*.spdx")
    want = merge(spark, glob, format="spdx2tv", output=str(tmp_path / "a"))
    got = merge(spark, glob, format="spdx2tv", output=str(tmp_path / "b"), whole=False)
    for name in ("aliases", "relationships", "dangling", "conflicts"):
        assert sorted(map(str, got[name].collect())) == sorted(map(str, want[name].collect())), name
    assert rows(got["merged"].drop("ord")) == rows(want["merged"].drop("ord"))
    assert written(tmp_path / "b" / "report", got["report_files"]) == {"s": want["reports"].first()["text"] + "\n"}
    (folder / "r3.spdx").write_bytes(b"Relationship: two words\n\xff\n")
    (folder / "r4.spdx").write_bytes(b"")
    with pytest.raises(ValueError) as e:
        merge(spark, glob, format="spdx2tv", output=str(tmp_path / "b"), whole=False)
    assert all(rule in str(e.value) for rule in ("invalid_utf8", "empty_reports", "lines"))
    assert written(tmp_path / "b" / "report", got["report_files"])


@pytest.mark.parametrize("format", ["cyclonedx", "spdx3json", "dep5", "readmeoss", "clixml"])
def test_pieces_of_formats(spark, tmp_path, format, many_ranges):
    rule, thin, digits = "=" * 120, "-" * 120, lambda n: f"{n:040x}"
    part = lambda n: {"type": "file", "name": f"f{n}", "bom-ref": f"r{n}", "hashes": [{"alg": "SHA-1", "content": digits(n)}], "licenses": [], "copyright": "c"}
    node = lambda n: {"type": "software_File", "spdxId": f"urn:f{n}", "name": f"f{n}", "verifiedUsing": [{"algorithm": "sha1", "hashValue": digits(n)}]}
    text = {
        "cyclonedx": lambda i: json.dumps({"bomFormat": "CycloneDX", "specVersion": "1.4", "components": [part(n) for n in range(i, i + 30)]}),
        "spdx3json": lambda i: json.dumps([{"type": "SpdxDocument", "spdxId": "urn:doc", "name": "d"}, *[node(n) for n in range(i, i + 30)], {"type": "Relationship", "spdxId": f"urn:r{i}", "from": f"urn:f{i}", "to": [f"urn:f{i + 1}"]}]),
        "dep5": lambda i: "Format: https://www.debian.org/doc/packaging-manuals/copyright-format/1.0/\n" + "".join(f"\nFiles: {n}.c\nCopyright: me\nLicense: L{n}\n\nLicense: N{n}\n body {n}\n .\n ..dot\n" for n in range(i, i + 30)),
        "readmeoss": lambda i: f"{rule}\n\npkg\n\n{thin}\n\n{rule}\n\n ODD \n\n{thin}\n\nodd\n\nx{i}\n\n{rule}\n\n MAIN LICENSES \n\n" + "".join(f"{thin}\n\nname{n}\n\ntext {n}\n\n" for n in range(i, i + 30)) + f"{thin}\n\n<Copyright notices>\n(c)\n\n<notices>\n",
        "clixml": lambda i: "".join(f'<ComponentLicenseInformation component="c{n % 3}" componentSHA1="{digits(n % 3)}"><License type="x" name="n{n}" spdxidentifier="x"><Content><![CDATA[text {n}\nmore]]></Content><Files>a{n}</Files></License></ComponentLicenseInformation>\n' for n in range(i, i + 30)),
    }[format]
    texts = spark.createDataFrame([("s", i, f"in{i}", text(i * 20)) for i in range(3)] + [("t", 0, "in0", text(5))], TEXTS)
    whole = merge_texts(texts, format, str(tmp_path / "a"))["reports"]
    pieces = merge_texts(texts, format, str(tmp_path / "b"), whole=False)["pieces"]
    got = written(tmp_path / "c", report_files.write_reports(pieces, str(tmp_path / "c")))
    want = {r["set_id"]: r["text"] for r in whole.collect()}
    assert set(got) == set(want) == {"s", "t"}
    if format in ("cyclonedx", "spdx3json"):
        assert {s: json.loads(t) for s, t in got.items()} == {s: json.loads(t) for s, t in want.items()}
    elif format == "clixml":
        assert {s: t.replace("\n", "") for s, t in got.items()} == {s: t.replace("\n", "") for s, t in want.items()}
    else:
        assert got == {s: t + "\n" for s, t in want.items()}


def test_inputs_are_numbered(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.spdx").write_text(report(random.Random(1), 5))
    (tmp_path / "s" / "b.spdx").write_text("")
    got = reports.report_inputs(spark, str(tmp_path / "*" / "*.spdx"))
    assert sorted((r["set_id"], r["input_index"], r["source_id"]) for r in got.collect()) == [("s", 0, "a"), ("s", 1, "b")]
