import pytest

from tributary.operators import checks, merge
from tributary.plans.merge import merge_texts
from tributary.streaming.merge_stream import MergeTable

ROWS = [("k", 0, 0, "s1", "C", "v1", "first"), ("k", 0, 1, "s1", "A", "v2", None), ("k", 1, 0, "s2", "B", "v1", "second"), ("q", 1, 1, "s2", None, None, None)]
SCHEMA = "identity_key string, input_index int, entry_ord int, source_id string, u string, c string, f string"


def entries(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_policies(spark):
    got = {r["identity_key"]: r for r in merge.merge_entries(entries(spark), ["identity_key"], ["input_index", "entry_ord"], ["u"], ["c"]).collect()}
    k = got["k"]
    assert (k["u"], k["c"], k["c_conflict"], k["f"], k["sources"], k["source_id"], k["n_entries"]) == (["A", "B", "C"], "v1", True, "first", ["s1", "s2"], "s1,s2", 3)
    assert (got["q"]["u"], got["q"]["c"], got["q"]["c_conflict"]) == ([], None, False)
    with pytest.raises(ValueError):
        merge.merge_entries(entries(spark), ["identity_key"], ["input_index"], ["u"], ["u"])


def test_conflicts_number_a_sources_values(spark):
    (row,) = merge.conflicts(entries(spark), ["identity_key"], ["input_index", "entry_ord"], ["c"]).collect()
    assert row["path"] == "/k/c" and row["chosen"] == "v1"
    assert [tuple(v) for v in row["values"]] == [("s1", "v1"), ("s1#2", "v2"), ("s2", "v1")]


def test_merging_twice_changes_nothing(spark):
    e = entries(spark)
    keys, order = ["identity_key"], ["input_index", "entry_ord"]
    again = e.selectExpr("identity_key", "input_index + 10 as input_index", "entry_ord", "source_id", "u", "c", "f")
    pick = lambda df: {(r["identity_key"], tuple(r["u"]), r["c"], r["f"]) for r in df.collect()}
    assert pick(merge.merge_entries(e.unionByName(again), keys, order, ["u"], ["c"])) == pick(merge.merge_entries(e, keys, order, ["u"], ["c"]))


def test_empty(spark):
    e = entries(spark).limit(0)
    assert merge.merge_entries(e, ["identity_key"], ["input_index", "entry_ord"], ["u"], ["c"]).count() == 0
    assert merge.conflicts(e, ["identity_key"], ["input_index", "entry_ord"], ["c"]).count() == 0


def test_checks(spark):
    refs = spark.createDataFrame([("s", 0, "a"), ("s", 0, "a"), ("s", 1, "a")], "set_id string, input_index int, ref string")
    assert [tuple(r) for r in checks.duplicate_refs(refs, "ref").collect()] == [("s", 0, "a", 2)]
    with pytest.raises(checks.InvalidReports):
        checks.assert_valid(duplicates=checks.duplicate_refs(refs, "ref"))
    lines = spark.createDataFrame([("Relationship: a b",), ("PackageChecksum: x",), ("Relationship: a b c",)], "line string")
    assert [r["problem"] for r in checks.malformed_lines(lines).collect()] == ["relationship", "checksum"]
    raw = spark.createDataFrame([(bytearray(b"\xff"),), (bytearray(b"ok"),)], "content binary")
    assert checks.invalid_utf8(raw).count() == 1


PACKAGE = "##Package\n\nPackageName: {name}\nSPDXID: SPDXRef-1\nPackageChecksum: SHA1: {p}\n\n##File\n\nFileName: f\nSPDXID: SPDXRef-f\nFileChecksum: SHA1: {f}\nLicenseInfoInFile: {lic}\n\nRelationship: SPDXRef-1 CONTAINS SPDXRef-f\n"


def test_equal_ids_stay_apart_and_shared_files_meet(spark):
    texts = spark.createDataFrame([("s", 0, "a", PACKAGE.format(name="x", p="AA", f="FF", lic="MIT")), ("s", 1, "b", PACKAGE.format(name="y", p="BB", f="ff", lic="Apache-2.0"))], "set_id string, input_index int, source_id string, text string")
    t = merge_texts(texts, "spdx2tv")
    kinds = {(r["kind"], r["identity_key"]): r for r in t["merged"].collect()}
    assert set(kinds) == {("package", "aa"), ("package", "bb"), ("file", "ff")}
    assert kinds["file", "ff"]["LicenseInfoInFile"] == ["Apache-2.0", "MIT"]
    rels = {tuple(r)[1:] for r in t["relationships"].collect()}
    assert ("SPDXRef-input0-1", "CONTAINS", "SPDXRef-input0-f") in rels and ("SPDXRef-input1-1", "CONTAINS", "SPDXRef-input0-f") in rels
    ids = {r["ref"] for r in t["merged"].select("ref").collect()} | {"SPDXRef-DOCUMENT"}
    assert all(a in ids and b in ids for a, _, b in rels)


def test_arriving_entries_replace_by_priority(spark, tmp_path):
    t = MergeTable(spark, str(tmp_path), ["k"], ["input_index"], first=["v"])
    frame = lambda *rows: spark.createDataFrame(rows, "k string, input_index int, source_id string, v string")
    t.update(frame(("a", 5, "s5", "late"), ("b", 1, "s1", "b")), 0)
    t.update(frame(("a", 1, "s1", "early")), 1)
    t.update(frame(("a", 1, "s1", "early")), 1)
    assert {(r["k"], r["v"], r["source_id"]) for r in t.merged().collect()} == {("a", "early", "s1,s5"), ("b", "b", "s1")}
