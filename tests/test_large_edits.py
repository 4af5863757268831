"""Edits of large documents against edits of plain values, one after the other."""

import copy
import json
import random

import pytest

from tributary.operators import edits, large_edits, tree

LOG = "set_id int, seq long, op string, path string, value string, from_path string"


def steps(path):
    return [t.replace("~1", "/").replace("~0", "~") for t in path.split("/")[1:]]


def inside(doc, path):
    for t in steps(path):
        if isinstance(doc, list) and t.isdigit() and str(int(t)) == t and int(t) < len(doc):
            doc = doc[int(t)]
        elif isinstance(doc, dict) and t in doc:
            doc = doc[t]
        else:
            raise KeyError(path)
    return doc


def add(doc, path, value):
    if not path:
        return value
    *above, last = steps(path)
    here, at = doc, 0
    while at < len(above) and (isinstance(here, list) or (isinstance(here, dict) and above[at] in here)):
        here, at = inside(here, "/" + above[at].replace("~", "~0").replace("/", "~1")), at + 1
    if isinstance(here, list):
        if not (last.isdigit() and str(int(last)) == last and int(last) <= len(here)):
            raise KeyError(path)
        here.insert(int(last), value)
        return doc
    if not isinstance(here, dict):
        raise KeyError(path)
    for t in above[at:]:
        here = here.setdefault(t, {})
    here[last] = value
    return doc


def remove(doc, path):
    inside(doc, path)
    holder, last = inside(doc, path.rpartition("/")[0]), steps(path)[-1]
    del holder[int(last) if isinstance(holder, list) else last]
    return doc


def same(a, b):
    return json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True)


def run(doc, log, on_error="skip"):
    """The document and statuses, with a whole copy at every step."""
    out, stopped = [], False
    for op, path, value, source in log:
        new, status = copy.deepcopy(doc), "ok"
        if stopped:
            out.append("not run")
            continue
        try:
            path, source = "" if path == "/" else path, "" if source == "/" else source
            if op in ("copy", "move"):
                moved = copy.deepcopy(inside(new, source))
                if op == "move" and (path.startswith(source + "/") or not source):
                    raise KeyError
                new = add(remove(new, source) if op == "move" else new, path, moved)
            elif op == "test":
                status = "ok" if same(inside(new, path), json.loads(value)) else "failed"
            elif op == "remove":
                if not path:
                    raise KeyError
                new = remove(new, path)
            elif op == "replace":
                inside(new, path)
                holder, last = (inside(new, path.rpartition("/")[0]), steps(path)[-1]) if path else (None, None)
                if path:
                    holder[int(last) if isinstance(holder, list) else last] = json.loads(value)
                else:
                    new = json.loads(value)
            else:
                new = add(new, path, json.loads(value))
        except (KeyError, TypeError):
            status = "missing"
        doc = new if status == "ok" else doc
        stopped = on_error == "fail" and status != "ok"
        out.append(status)
    return doc, out


def nodes_of(doc):
    out, left = [], [(doc, "")]
    while left:
        v, path = left.pop()
        members = list(v.items()) if isinstance(v, dict) else list(enumerate(v)) if isinstance(v, list) else []
        kind = "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "string" if isinstance(v, str) else "boolean" if isinstance(v, bool) else "null" if v is None else "number"
        out.append((path, "{}" if kind == "object" else "[]" if kind == "array" else json.dumps(v, ensure_ascii=False), kind))
        left += [(x, f"{path}/{str(k).replace('~', '~0').replace('/', '~1')}") for k, x in members]
    return sorted(x for x in out if x[0])


def made(rng, depth):
    kind = rng.random()
    if depth and kind < 0.4:
        return {rng.choice("ab~/1"): made(rng, depth - 1) for _ in range(rng.randrange(4))}
    if depth and kind < 0.8:
        return [made(rng, depth - 1) for _ in range(rng.randrange(5))]
    return rng.choice([None, True, rng.randrange(9), "x", "é"])


def made_log(rng, doc, n):
    """Edits at places that are there when they come, or near such."""
    log = []
    for _ in range(n):
        paths = [""] + [p for p, *_ in nodes_of(doc)]
        at = lambda: rng.choice(paths) + rng.choice(["", "", "", "/0", "/1", "/a", "/b/a", "/7", "/~1", "/01"])  # noqa: E731, B023
        op = rng.choice(["add", "add", "remove", "replace", "copy", "move", "test", "jump"])
        path = at()
        if not path and rng.random() < 0.95:  # the whole document is replaced now and then only
            path = "/a"
        value = made(rng, 3)
        if op == "test" and rng.random() < 0.7:
            try:
                value = inside(doc, path)
            except KeyError:
                pass
        log.append((op, path, json.dumps(value) if op in ("add", "replace", "test") else None, at() if op in ("copy", "move") else None))
        if op == "jump":
            log[-1] = ("remove", path, None, None)
        new = run(doc, log[-1:])[0]
        doc = new if len(nodes_of(new)) < 400 and isinstance(new, dict) else doc
        if doc is not new:
            log.pop()
    return log


def edited(spark, docs, logs, on_error="skip", f=large_edits.apply_large_edits):
    t = tree.field_tree(spark.createDataFrame([(i, json.dumps(d, ensure_ascii=False)) for i, d in docs], "set_id int, json string"), hide=False)
    rows = [(i, k + 1, op, path, value, source) for i, log in logs for k, (op, path, value, source) in enumerate(log)]
    nodes, status = f(t, spark.createDataFrame(rows, LOG), on_error=on_error)
    out, said = {}, {}
    for r in nodes.collect():
        out.setdefault(r["set_id"], []).append((r["path"], r["value"], r["value_type"]))
    for r in status.orderBy("seq").collect():
        said.setdefault(r["set_id"], []).append(r["status"])
    return {k: sorted(v) for k, v in out.items()}, said


@pytest.mark.parametrize("on_error", ["skip", "fail"])
def test_random_logs(spark, on_error):
    rng = random.Random(on_error)
    docs = [(i, {"a": [made(rng, 4) for _ in range(4)], "b": {"a": made(rng, 4), "k": [1, [2, {"a": 3}]]}}) for i in range(60)]
    logs = [(i, made_log(rng, d, rng.randrange(1, 25))) for i, d in docs if i % 6]
    got, said = edited(spark, docs, logs, on_error)
    whole, seen = dict(logs), set()
    for i, d in docs:
        want, status = run(d, whole.get(i, []), on_error)
        assert said.get(i, []) == status, (i, d, whole[i])
        assert got.get(i, []) == nodes_of(want), (i, d, whole.get(i))
        seen |= set(status)
    assert ({"ok", "missing", "failed"} if on_error == "skip" else {"ok", "not run"}) <= seen


def test_a_long_list(spark, monkeypatch):
    """A list of 200,000 elements, of which no task sees more than the log; leaves of few runs, so that they split."""
    monkeypatch.setattr(large_edits, "LEAF", 8)
    n = 200_000
    t = spark.range(n).selectExpr("1 as set_id", "concat('/list/', id) as path", "cast(id as string) as value", "'number' as value_type", "0 as child_count")
    t = t.unionByName(spark.createDataFrame([(1, "/list", None, "array", n)], "set_id int, path string, value string, value_type string, child_count int"))
    rng, want, log = random.Random(5), list(range(n)), []
    for k in range(300):
        at = rng.randrange(len(want))
        op = rng.choice(["add", "remove", "replace", "move"])
        log.append((1, k + 1, op, f"/list/{at}", None if op in ("remove", "move") else str(-k), "/list/7" if op == "move" else None))
        if op == "add":
            want.insert(at, -k)
        elif op == "replace":
            want[at] = -k
        elif op == "remove":
            del want[at]
        else:
            want.insert(at, want.pop(7))
    nodes, status = large_edits.apply_large_edits(t, spark.createDataFrame(log, LOG))
    assert status.filter("status = 'ok'").count() == 300
    got = {r["path"]: r["value"] for r in nodes.collect()}
    assert got.pop("/list") == "[]" and got == {f"/list/{i}": str(v) for i, v in enumerate(want)}
    with pytest.raises(ValueError):
        large_edits.apply_large_edits(t, spark.createDataFrame(log, LOG), on_error="stop")


def test_odd_logs(spark):
    """Nulls, pointers that are none, documents without log and logs without document; as the fold of small documents."""
    log = [(None, "/a", "1", None), ("add", None, "1", None), ("add", "/n", None, None), ("test", "/a", None, None), ("copy", "/z", None, None), ("add", "a", "1", None), ("hop", "/a", "1", None), ("add", "/x/y/z", "[1]", None), ("copy", "/x/y/w", None, "/x/y")]
    docs = [(0, {"a": 1}), (1, {"a": [1, {"b": None}]}), (2, {})]
    got, said = edited(spark, docs, [(0, log), (2, log[:1]), (3, log[:1])])
    assert said == {0: ["missing"] * 3 + ["failed"] + ["missing"] * 3 + ["ok"] * 2}
    assert got == {0: nodes_of({"a": 1, "x": {"y": {"z": [1], "w": {"z": [1]}}}}), 1: nodes_of(docs[1][1])}
    small, fold = edited(spark, docs, [(0, log[:5] + log[7:])], f=edits.apply_edits)
    assert small[0] == got[0] and fold[0] == said[0][:5] + said[0][7:]  # log[5] is no pointer, log[6] no operation
    none = edited(spark, docs, [])
    assert none == ({0: nodes_of(docs[0][1]), 1: nodes_of(docs[1][1])}, {})


def test_equal_branches_are_left_out(spark):
    """Diffs with and without digests are equal, and what is joined is in proportion to the changes."""
    rng = random.Random(3)
    docs = [(i, {k: made(rng, 5) for k in "abcd"} | {"list": [made(rng, 3) for _ in range(300)]}) for i in range(4)]
    changed = [(i, run(d, made_log(rng, d, 3) + [("remove", "/list/299", None, None), ("replace", "/list/7", "[1]", None)])[0] if i % 2 else d) for i, d in docs]
    a, b = (tree.field_tree(spark.createDataFrame([(i, json.dumps(d)) for i, d in x], "set_id int, json string"), hide=False, with_json=True) for x in (docs, changed))
    rows = lambda t: sorted(map(tuple, t.collect()), key=str)
    plain = rows(edits.diff_to_edits(a, b))
    assert plain and rows(edits.diff_to_edits(a, b, levels=(2,))) == plain == rows(edits.diff_to_edits(a, b, levels=(1, 2, 4)))
    left, _ = edits.differing_branches(a, b, levels=(1, 2, 4))
    assert {r[0] for r in left.select("set_id").distinct().collect()} <= {1, 3}
    one = [(0, {"list": [{"v": [i]} for i in range(2000)]}), (1, {"list": [{"v": [i if i != 77 else -1]} for i in range(2000)]})]
    a, b = (tree.field_tree(spark.createDataFrame([(0, json.dumps(d))], "set_id int, json string"), with_json=True) for _, d in one)
    assert [t.count() for t in edits.differing_branches(a, b, levels=(2,))] == [3, 3]
    assert [r["path"] for r in edits.diff_to_edits(a, b, levels=(2,)).collect()] == ["/list/77/v/0"]
