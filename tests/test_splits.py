"""Large reports read by many tasks: equal to the parser of texts that are one row each."""

import random

from pyspark.sql import functions as F

from tributary.sources import formats, reports


def report(rng, n):
    """A tag-value report with blocks of several lines, odd lines, implicit packages and unclosed blocks."""
    out = ["SPDXVersion: SPDX-2.3", "Creator: Tool: x"]
    text = lambda: "<text>" + "\n".join(rng.choice(["a", "", "FileName: no", "##File", "é b"]) for _ in range(rng.randrange(1, 7))) + "</text>"
    for i in range(n):
        kind = rng.randrange(7)
        if kind == 0:
            out += ["##Package", "", f"PackageName: p{i}", f"SPDXID: SPDXRef-p{i}", f"PackageChecksum: SHA1: {i:04x}", f"PackageCopyrightText: {text()}"]
        elif kind in (1, 2):
            out += ["##File", f"FileName: f{i}", f"SPDXID: SPDXRef-f{i}", f"FileChecksum: SHA1: {i:05x}", f"LicenseInfoInFile: L{i % 3}", f"LicenseInfoInFile: M{i % 2}", f"FileComment: {text()}"]
        elif kind == 3:
            out += [f"LicenseID: LicenseRef-{i}", f"ExtractedText: {text()}", f"LicenseName: n{i}"]
        elif kind == 4:
            out += [f"PackageName: implicit{i}", f"PackageVersion: {i}\r", "not a tag", "FileNotice: a\rFileNotice: b"]
        elif kind == 5:
            out += ["## License Information", f"Relationship: SPDXRef-p{i} CONTAINS SPDXRef-f{i}", ""]
        else:
            out += [f"ExternalRef: SECURITY x{i} y", rng.choice(["odd</text>", "FileNotice: <text>one line</text>", "FileNotice: <text>opens"])]
    return "\n".join(out) + rng.choice(["", "\n"])


def rows(df):
    tags = F.array_sort(F.transform("tags", lambda t: F.concat_ws("=", t["tag"], F.array_join(t["values"], "|"))))
    columns = [c for c in df.columns if c not in ("tags", "checksums")]
    return sorted(map(str, df.select(*columns, tags.alias("tags"), F.array_sort(F.map_entries("checksums")).alias("checksums")).collect()))


def test_splits_are_as_whole_texts(spark, tmp_path):
    rng = random.Random(5)
    for s in ("one", "two"):
        (tmp_path / s).mkdir()
    files = {("one", 0): report(rng, 900), ("one", 1): report(rng, 3), ("two", 0): report(rng, 200), ("two", 1): "", ("two", 2): "PackageName: x\r\nSPDXID: SPDXRef-x"}
    for (s, n), text in files.items():
        (tmp_path / s / f"r{n}.spdx").write_bytes(text.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        lines = reports.report_lines(spark, str(tmp_path / "*" / "*.spdx"))
        assert lines.filter("set_id = 'one' and input_index = 0").select("split").distinct().count() > 15
        got = {(r["set_id"], r["input_index"]): r["t"] for r in lines.groupBy("set_id", "input_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("t")).collect()}
        for key, text in files.items():
            assert got.get(key, "") == text.replace("\r\n", "\n").replace("\r", "\n").removesuffix("\n"), key
        texts = reports.texts(reports.read_reports(spark, str(tmp_path / "*" / "*.spdx")))
        want = formats.entries_from_tagvalue(texts)
        split = formats.entries_from_tagvalue_lines(lines)
        assert split.columns == want.columns and rows(split) == rows(want) and want.count() > 400
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
