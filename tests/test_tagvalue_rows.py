"""Tag-value reports read in one pass against the same lines as rows of a table."""

import random

from tributary.operators import merge, refs
from tributary.plans.merge import merge_texts
from tributary.sources import formats, tagvalue

TEXTS = "set_id string, input_index int, source_id string, text string"
PARTS = [
    "##Package", " ##Package ", "##File", "##Files: x", "## License Information", "#", "", " ", "\t", "LicenseID: LicenseRef-A", "  LicenseID: LicenseRef-b ", "PackageName: p", " PackageName:", "\tPackageName: q", "SPDXID: SPDXRef-p", "SPDXID: SPDXRef-f1",
    "LicenseConcluded: LicenseRef-A OR (SPDXRef-f1 AND LicenseRef-A-x)", "LicenseInfoInFile: LicenseRef-A", "LicenseInfoInFile:LicenseRef-b", "FileChecksum: SHA1: 01", "PackageChecksum: MD5:AB", "ExternalRef: a b c", "Other-1: x", "Other-1: y  ", "Other:  z\u0085", "no tag", "a b: c",
    "Relationship: SPDXRef-p CONTAINS SPDXRef-f1", "Relationship: a b", " Relationship:  a b c", "ExtractedText: <text>one</text>", "ExtractedText: <text>two", "FileComment: <text>x ", "end</text> ", "Creator: <text></text> x", "</text> ", "<text>a</text>", "SPDXID: SPDXRef-p <text>", "x  </text>\x0b", "FileName: \x1cname\x1f",
]


def test_one_pass_reads_what_lines_do(spark):
    rng = random.Random(7)
    body = lambda: "".join(rng.choice(PARTS) + rng.choice(["\n", "\n", "\r\n", "\r"]) for _ in range(rng.randrange(0, 40)))[: rng.choice([None, -1])]
    rows = [("s", k, "in", body()) for k in range(400)] + [("s", 400, "in", None), ("s", 401, "in", ""), ("s", 402, "in", "\n")]
    texts = spark.createDataFrame(rows, TEXTS).repartition(3)
    plain = lambda r: tuple(sorted(v.items()) if isinstance(v, dict) else v for v in r)
    # Two different digests of one kind are an error of both ways, and none of PARTS.
    got, want = formats.entries_from_tagvalue(texts), formats._tagvalue_entries(formats.tagvalue_sections(texts))
    assert got.schema.names == want.schema.names and got.dtypes == want.dtypes
    assert sorted(map(repr, map(plain, got.collect()))) == sorted(map(repr, map(plain, want.collect())))
    assert "Window" not in got._jdf.queryExecution().toString()
    rows, want_rels = formats.tagvalue_rows(texts), formats.relationships_from_tagvalue(texts)
    rels = formats.relationships_of_tagvalue_rows(rows)
    assert sorted(map(repr, rels.drop("_known").collect())) == sorted(map(repr, want_rels.collect()))
    # References of its own input, with and without a join.
    ref_map = refs.declared_refs(want, "ref")
    joined = refs.rewrite_embedded_refs(want, ref_map, formats.EXPRESSIONS, ["set_id", "input_index", "entry_ord"])
    known = refs.namespace_known(formats.entries_of_tagvalue_rows(rows), [], formats.EXPRESSIONS)
    cols = ["input_index", "entry_ord", *formats.EXPRESSIONS]
    assert sorted(map(repr, known.select(cols).collect())) == sorted(map(repr, joined.select(cols).collect()))
    ends = ["input_index", "rel_ord", "src", "type", "dst"]
    assert sorted(map(repr, refs.namespace_known(rels, ["src", "dst"]).select(ends).collect())) == sorted(map(repr, refs.rewrite_refs(want_rels, ref_map, ["src", "dst"]).select(ends).collect()))
    assert merge.POLICIES["spdx2tv"]["ref"] in tagvalue.row_schema(formats.TAGS_ONCE, formats.TAGS_MANY)


def test_texts_are_read_once(spark, tmp_path):
    """A merge that writes its tables reads each text once, for entries, relationships and what inputs declare."""
    seen = spark.sparkContext.accumulator(0)
    text = "##Package\n\nPackageName: p\nSPDXID: SPDXRef-p\nPackageChecksum: SHA1: 01\n\nRelationship: SPDXRef-p CONTAINS SPDXRef-p\n"

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    texts = spark.createDataFrame([("s", k, f"in{k}", text) for k in range(5)], TEXTS)
    counted = texts.mapInArrow(count, texts.schema)
    merge_texts(counted, "spdx2tv", str(tmp_path))["relationships"].collect()
    assert seen.value == 5
