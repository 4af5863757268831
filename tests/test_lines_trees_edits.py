import random

import numpy as np
import pytest

from tributary.operators import edits, lines, tree


def side(spark, texts):
    return lines.lines(spark.createDataFrame(texts, "pair_id int, text string"), ["pair_id"])


def test_a_moved_line_and_repeated_ones(spark):
    """One line moves from the top to the end, another is new, blank lines repeat: all others stay matched."""
    left = ["moved", "", "north", "", "east", "south", "", "west"]
    right = ["", "north", "", "new", "east", "south", "", "west", "moved"]
    a, b = (side(spark, [(1, "\n".join(x) + "\n")]) for x in (left, right))
    ops = lines.opcodes(a, b)
    got = [(r["tag"], r["i1"], r["i2"], r["j1"], r["j2"]) for r in ops.orderBy("op_no").collect()]
    assert got == [("delete", 0, 1, 0, 0), ("equal", 1, 4, 0, 3), ("insert", 4, 4, 3, 4), ("equal", 4, 8, 4, 8), ("insert", 8, 8, 8, 9)]
    rows = lines.diff_rows(ops, a, b)
    assert rows.count() == 10 and rows.filter("type = 'equal' and left <> right").count() == 0
    found = lines.search_diff(ops, a, b, "MOVED", limit=None).orderBy("row").collect()
    assert [(r["side"], r["row"], r["line_no"]) for r in found] == [("left", 0, 0), ("right", 9, 8)]
    assert [r["side"] for r in lines.search_diff(ops, a, b, "st", limit=2).orderBy("row", "side").collect()] == ["left", "right"]
    with pytest.raises(ValueError):
        lines.line_window(a, 0, 5001)


def test_longest_chain():
    rng = random.Random(2)
    for _ in range(200):
        x = [rng.randrange(9) for _ in range(rng.randrange(9))]
        best = max((len(c) for k in range(1 << len(x)) if (c := [v for n, v in enumerate(x) if k >> n & 1]) == sorted(set(c))), default=0)
        got = [x[k] for k in lines.longest_chain(x)]
        assert got == sorted(set(got)) and len(got) == best


def test_deep_documents(spark):
    deep = '{"a":' * 30 + "1" + "}" * 30
    df = spark.createDataFrame([(1, deep), (2, '{"q":"[[[{\\"","_h":{"x":1},"e":{},"l":[[],[1,null]]}'), (3, "7"), (4, None)], "set_id int, json string")
    rows = {(r["set_id"], r["path"]): r for r in tree.field_tree(df).collect()}
    assert sum(k == 1 for k, _ in rows) == 30 and rows[1, "/a" * 30]["value"] == "1"
    assert {p for k, p in rows if k == 2} == {"/q", "/e", "/l", "/l/0", "/l/1", "/l/1/0", "/l/1/1"}
    assert rows[2, "/l"]["child_count"] == 2 and rows[2, "/l/1/1"]["value"] == "null" and rows[2, "/l/1/1"]["is_leaf"]
    cut = {r["path"]: r for r in tree.field_tree(df.filter("set_id = 1"), max_depth=3).collect()}
    assert len(cut) == 3 and cut["/a/a/a"]["child_count"] == 1 and not cut["/a/a/a"]["is_leaf"]
    assert tree.field_tree(df.filter("set_id > 2")).count() == 0


def test_opcodes_turn_left_into_right(spark):
    rng = random.Random(4)
    texts = [(k, [rng.choice("abcde") for _ in range(rng.randrange(12))], [rng.choice("abcde") for _ in range(rng.randrange(12))]) for k in range(40)]
    join = lambda x: "".join(f"{c}\n" for c in x)
    ops = lines.opcodes(side(spark, [(k, join(a)) for k, a, _ in texts]), side(spark, [(k, join(b)) for k, _, b in texts])).orderBy("pair_id", "op_no").collect()
    for k, a, b in texts:
        out, i = [], 0
        for o in (o for o in ops if o["pair_id"] == k):
            assert o["i1"] == i and o["j1"] == len(out)
            if o["tag"] == "equal":
                assert a[o["i1"] : o["i2"]] == b[o["j1"] : o["j2"]]
            out += b[o["j1"] : o["j2"]]
            i = o["i2"]
        assert out == b and i == len(a)


def docs(spark, *json):
    return tree.field_tree(spark.createDataFrame(list(enumerate(json)), "set_id int, json string"), with_json=True)


def test_edits(spark):
    t = docs(spark, '{"a":1,"b":[10,20,30],"c":{"d":null}}', '{"x":1}')
    rows = [(0, 1, "add", "/b/1", "15", None), (0, 2, "remove", "/b/0", None, None), (0, 3, "remove", "/zz", None, None), (0, 4, "move", "/m", None, "/c"), (0, 5, "test", "/b", "[15,20,30]", None), (0, 6, "test", "/a", "7", None), (0, 7, "add", "/b/9", "1", None)]
    log = spark.createDataFrame(rows, "set_id int, seq long, op string, path string, value string, from_path string")
    nodes, status = edits.apply_edits(t, log)
    assert [r["status"] for r in status.orderBy("seq").collect()] == ["ok", "ok", "missing", "ok", "ok", "failed", "missing"]
    got = {r["path"]: r["value"] for r in nodes.filter("set_id = 0").collect()}
    assert got == {"/a": "1", "/b": "[]", "/b/0": "15", "/b/1": "20", "/b/2": "30", "/m": "{}", "/m/d": "null"}
    assert {r["path"] for r in nodes.filter("set_id = 1").collect()} == {"/x"}
    assert [r["status"] for r in edits.apply_edits(t, log, on_error="fail")[1].orderBy("seq").collect()][3:] == ["not run"] * 4


def test_diff_of_documents_applies(spark):
    old = docs(spark, '{"a":1,"b":[1,2,3],"c":{"d":{"e":1}}}', '{"k":"x"}')
    new = docs(spark, '{"a":"1","b":[1],"c":{"d":[1]},"n":{}}', '{"k":"x"}')
    log = edits.diff_to_edits(old, new)
    assert edits.verify_edits(old, new, log).count() == 0
    assert log.filter("set_id = 1").count() == 0


def test_log(spark):
    log = spark.createDataFrame([(1, 1, "w", "replace", "/a", "1", None), (1, 2, "w", "remove", "/b", None, None)], "set_id int, seq long, who string, op string, path string, value string, from_path string")
    assert [r["seq"] for r in edits.undo(log, 1).collect()] == [1]
    assert [r["seq"] for r in edits.undo(log, 1, 1).collect()] == [2]
    with pytest.raises(IndexError):
        edits.undo(log, 1, 3)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("pairs_a_line", [0, 8])
def test_alignments_are_longest(monkeypatch, pairs_a_line):
    """Common subsequences of random lists, of few values and of many, by both ways of finding them."""
    monkeypatch.setattr(lines, "PAIRS_A_LINE", pairs_a_line)
    rng = random.Random(pairs_a_line)
    for n in range(400):
        kinds = rng.choice([1, 2, 3, 10, 60])
        a, b = ([rng.randrange(kinds) for _ in range(rng.choice([0, 1, 5, 40, 130]))] for _ in range(2))
        if n % 3 == 0:
            b = [x for x in a if rng.random() < 0.9] + b[:3]
        i, j = lines.longest_common(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64))
        assert (np.diff(i) > 0).all() and (np.diff(j) > 0).all() and [a[k] for k in i] == [b[k] for k in j]
        assert len(i) == lcs(a, b), (a, b)


def test_large_alignments():
    """Thousands of lines: a shuffled file of few values, and one that is nearly the same."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 20, 6000), rng.integers(0, 20, 6000)
    i, j = lines.longest_common(a, b)
    assert len(i) == int(lines._common_lengths(a, b)[-1]) and (a[i] == b[j]).all() and 1500 < len(i) < 6000
    a = rng.integers(0, 1 << 40, 200_000)
    b = np.delete(a, rng.integers(0, len(a), 500))
    i, j = lines.longest_common(a, np.append(b[::-1][:100], b))
    assert len(i) == len(b)


def test_summaries(spark):
    pairs = [(1, "a\nb\n", "a\nb\n"), (2, "a\nb\n", "a\r\nb"), (3, "a\nx\ny\nc\n", "a\nz\nc\nd\n"), (4, "".join(f"l{i}\n" for i in range(20)), ""), (5, "q" * 900, "w" * 900), (6, "--\nk\n", "++\nk\n"), (7, "", "")]
    texts = spark.createDataFrame(pairs, "pair_id int, left string, right string")
    a, b = (lines.lines(texts, ["pair_id"], c) for c in ("left", "right"))
    got = {r["pair_id"]: (r["n_changed"], r["summary"]) for r in lines.summarize_text_diff(lines.opcodes(a, b), a, b, texts).collect()}
    assert got[1] == got[7] == (0, "(no textual change)") and got[2] == (0, "Document updated") and got[6] == (0, "Document updated")
    assert got[3] == (4, "-x\n-y\n+z\n+d")
    assert got[4] == (20, "\n".join(f"-l{i}" for i in range(8)) + "\n… (12 more changed lines)")
    assert got[5][0] == 2 and len(got[5][1]) == 400 and got[5][1].endswith("q…")
