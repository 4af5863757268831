"""A table that is kept up batch by batch: equal to a merge from scratch, and no batch reads what came before it."""

import random

import pytest

from tributary.operators import merge as ops
from tributary.operators import refs
from tributary.streaming.merge_stream import GraphTable, MergeTable

SCHEMA = "k string, part int, input_index int, entry_ord int, source_id string, tags array<string>, name string, note string, size int"
POLICIES = {"union": ["tags"], "conflict": ["name", "size"], "first": ["note"]}
KEYS, ORDER = ["k", "part"], ["input_index", "entry_ord"]


def entries(spark, rng, n, hot=0.3):
    some = lambda *x: rng.choice([*x, None])
    rows = []
    for i in range(n):
        at = rng.randrange(40)
        rows.append(("hot" if rng.random() < hot else some(*"abcdefgh"), some(0, 1), at, i + 1000 * rng.randrange(50), f"s{at % 7}", some(["x", None, "y"], [], [rng.choice("zwv")]), some("n1", "n2"), some("p", "q", "r"), some(1, 2)))
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted((str(r.asDict()) for r in df.collect()))


@pytest.mark.parametrize("fan_in", [2, 3])
def test_batches_equal_one_merge(spark, tmp_path, fan_in):
    rng = random.Random(fan_in)
    table = lambda: MergeTable(spark, str(tmp_path / "t"), KEYS, ORDER, fan_in=fan_in, **POLICIES)
    batches = [entries(spark, rng, n) for n in (40, 0, 1, 60, 25, 30, 10)]
    for n, batch in enumerate(batches):
        table().update(batch, n)
        if n in (2, 5):
            table().update(batch, n)  # lost after it was written, and run again
        if n % 2:
            table().compact()
    table().compact()
    want = ops.merge_entries(ops.collect_entries(*batches), KEYS, ORDER, **POLICIES)
    got = table().merged()
    assert got.columns == want.columns and rows(got) == rows(want)
    assert len(table().runs()) < 6 and table().entries().count() == 166
    table().vacuum()
    assert rows(table().merged()) == rows(want)


def test_a_batch_before_a_compaction_runs_again(spark, tmp_path):
    rng = random.Random(1)
    t = MergeTable(spark, str(tmp_path), KEYS, ORDER, fan_in=2, **POLICIES)
    batches = [entries(spark, rng, 20) for _ in range(4)]
    for n, batch in enumerate(batches):
        t.update(batch, n)
    assert t.compact() == 3 and len(t.runs()) == 1
    t.vacuum()
    t.update(batches[3], 3)
    want = ops.merge_entries(ops.collect_entries(*batches), KEYS, ORDER, **POLICIES)
    assert rows(t.merged()) == rows(want)


def test_a_batch_reads_no_history(spark, tmp_path):
    """Bytes that a batch reads, by the file system's own count (one JVM here): as many for the 12th as for the 2nd."""
    statistics = lambda: sum(s.getBytesRead() for s in spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())
    t = MergeTable(spark, str(tmp_path), KEYS, ORDER, fan_in=8, **POLICIES)
    rng, read = random.Random(2), []
    for n in range(12):
        batch = entries(spark, rng, 3000, hot=0.9)
        before = statistics()
        t.update(batch, n)
        read.append(statistics() - before)
    assert read[0] > 1000 and max(read[-3:]) < 1.15 * max(read[1:4]), read
    assert t.merged().agg({"n_entries": "sum"}).first()[0] == 36000
    assert len(t.runs()) == 12 and t.compact() == 11 and len(t.runs()) == 1
    assert len(t._versions()) <= 2 * t.KEPT


def test_states_are_a_merge(spark):
    rng = random.Random(4)
    e = entries(spark, rng, 300)
    args = (POLICIES["union"], POLICIES["conflict"], POLICIES["first"])
    one = ops.finish_states(ops.entry_states(e, KEYS, ORDER, *args), KEYS, *args)
    parts = ops.entry_states(e, [*KEYS, "input_index"], ["input_index", "entry_ord"], *args).drop("input_index")
    many = ops.finish_states(ops.combine_states(parts, KEYS, *args), KEYS, *args)
    want = rows(ops.merge_entries(e, KEYS, ORDER, **POLICIES))
    assert rows(one) == want and rows(many) == want


def test_relationships_follow_survivors(spark, tmp_path):
    """Inputs arrive from the lowest priority to the highest, so every batch changes survivors; after each batch the
    relationships are those of a merge from scratch, and none dangles."""
    rng = random.Random(7)
    entry = "set_id string, identity_key string, input_index int, entry_ord int, source_id string, ref string, name string"
    keys, order = ["set_id", "identity_key"], ["input_index", "entry_ord"]
    batches = []
    for n in (2, 1, 0):
        rows = [(s, f"k{rng.randrange(6)}", n, i, f"in{n}", f"input{n}-{s}{i}", f"n{n}") for s in "ab" for i in range(8)]
        own = [[r[5] for r in rows if r[0] == s] for s in "ab"]
        edges = [(s, rng.choice(own[k]), "CONTAINS", rng.choice(own[k])) for k, s in enumerate("ab") for _ in range(12)]
        batches.append((spark.createDataFrame(rows, entry), spark.createDataFrame(edges, "set_id string, src string, type string, dst string")))
    survivors = []
    for n, (e, r) in enumerate(batches):
        GraphTable(spark, str(tmp_path / "g"), keys, order, fan_in=2).update(e, r, n)
        t = GraphTable(spark, str(tmp_path / "g"), keys, order, fan_in=2)
        t.update(e, r, n)  # twice
        t.compact()
        every = ops.collect_entries(*[b[0] for b in batches[: n + 1]])
        edges = ops.collect_entries(*[b[1] for b in batches[: n + 1]])
        want = refs.redirect_to_survivors(edges, ops.alias_map(every, keys, order, "ref"), ["src", "dst"]).distinct()
        assert rows_of(t.relationships()) == rows_of(want) and t.dangling().count() == 0
        survivors.append({r["ref"] for r in t.merged().collect()})
        assert "all_refs" not in t.merged().columns
    assert not survivors[0] & survivors[2]
    with pytest.raises(ValueError):
        GraphTable(spark, str(tmp_path / "x"), ["k"], order)


def rows_of(df):
    return sorted(map(tuple, df.collect()))
