"""Long logs of edits of large documents: what they cost does not grow with the square of the log."""

import random

from pyspark.sql import functions as F

from tributary.operators import large_edits

LOG = "set_id int, seq long, op string, path string, value string, from_path string"


def test_array_is_a_list():
    """Random edits of runs against a list; leaves stay small, also where elements are only taken off."""
    rng = random.Random(4)
    plain = [f"/{k}" for k in range(5000)]
    array = large_edits._Array([([(0, "", 0, 5000)], [5000])])
    for n in range(6000):
        op, at = ("remove", "insert", "put")[rng.randrange(3)] if n > 3000 else "remove", rng.randrange(len(plain))
        if n > 3000 and not n % 7:
            op, at = "insert", len(plain)
        node = (n, "x")
        if op == "remove":
            array.remove(at)
            del plain[at]
        elif op == "insert":
            array.insert(at, node)
            plain.insert(at, node)
        else:
            array.put(at, node)
            plain[at] = node
        if n == 3000:
            assert max(len(items) for items, _ in array.leaves) <= large_edits.LEAF
    assert len(array) == len(plain)
    got = [array.get(k) for k in range(len(plain))]
    assert got == [(0, x) if isinstance(x, str) else x for x in plain]
    assert all(sum(lengths) == sum(i[3] - i[2] if len(i) == 4 else 1 for i in items) for items, lengths in array.leaves)


def test_a_list_is_folded_once(spark, monkeypatch):
    """The containers that a log names are known before its first round; logs are dealt to tasks, small as they are."""
    written = []

    def stash(df, name, f=large_edits.stash):
        written.append((name, df.rdd.getNumPartitions() if name == "edit-places" else 0))
        return f(df, name)

    monkeypatch.setattr(large_edits, "stash", stash)
    nodes = spark.range(200).select((F.col("id") % 2).cast("int").alias("set_id"), F.concat(F.lit("/a/list/"), F.floor(F.col("id") / 2)).alias("path"), F.col("id").cast("string").alias("value"), F.lit("number").alias("value_type"), F.lit(0).alias("child_count"))
    heads = spark.createDataFrame([(s, p, None, k, n) for s in (0, 1) for p, k, n in (("/a", "object", 1), ("/a/list", "array", 100))], "set_id int, path string, value string, value_type string, child_count int")
    log = [(s, k + 1, "remove", f"/a/list/{k}", None, None) for s in (0, 1) for k in range(50)] + [(0, 60, "add", "/a/b", "1", None), (1, 60, "remove", "/a/c", None, None)]
    after, status = large_edits.apply_large_edits(nodes.unionByName(heads), spark.createDataFrame(log, LOG))
    assert [n for n in written if n[0] == "edit-places"] == [("edit-places", 4)]
    got = {(r["set_id"], r["path"]): r["value"] for r in after.collect()}
    assert {v for (s, p), v in got.items() if s == 1 and p.startswith("/a/list/")} == {str(2 * k + 1) for k in range(1, 100, 2)}
    assert got[0, "/a/b"] == "1" and (1, "/a/b") not in got
    assert sorted(r["status"] for r in status.filter("seq = 60").collect()) == ["missing", "ok"]


def test_short_runs_meet_no_other_runs(spark):
    """A list cut at every second place: each element is joined with the run that it lies in, not with its neighbours'."""
    n = 256
    nodes = spark.range(n).select(F.lit(1).alias("set_id"), F.lit(0).cast("long").alias("src"), F.concat(F.lit("/l/"), "id").alias("path"), F.col("id").cast("string").alias("value"), F.lit("number").alias("value_type"))
    rows = [(1, "run", 0, "/l", k, k + 1, k + 1, "/l", None, None, 1) for k in range(n // 2)] + [(1, "run", 0, "/l", n // 2 + 1, n, n, "/l", None, None, 1)]
    places = spark.createDataFrame(rows, f"set_id int, {large_edits._ROW}")
    out = large_edits._moved(nodes, places, "set_id")
    assert {r["path"]: int(r["value"]) for r in out.collect()} == {f"/l/{2 * k + 1}": k for k in range(n // 2)} | {f"/l/{k + n}": k for k in range(n // 2 + 1, n)}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        again = large_edits._moved(nodes, places, "set_id")
        again.collect()
        joins, left = [], [again._jdf.queryExecution().executedPlan()]
        while left:
            p = left.pop()
            if "Join" in p.nodeName() and p.metrics().contains("numOutputRows"):
                joins.append(p.metrics().apply("numOutputRows").value())
            left += [p.children().apply(k) for k in range(p.children().size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert joins and max(joins) <= 2 * n
