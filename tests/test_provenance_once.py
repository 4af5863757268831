"""Provenance in one shuffle, against plain Python."""

import random

from tributary.operators import merge

ENTRIES = "k string, input_index int, entry_ord int, source_id string, u string, c int, f string"


def test_provenance_moves_entries_once(spark):
    rng = random.Random(11)
    rows = [(rng.choice(["a", "b", "c", "d", None, "x" + str(n % 40)]), n % 5, n, f"s{n % 5}", rng.choice([None, "v"]), rng.choice([None, 1, 2]), rng.choice([None, "p", "q"])) for n in range(300)]
    df = spark.createDataFrame(rows, ENTRIES).repartition(4)
    out = merge.provenance(df, ["k"], ["input_index", "entry_ord"], {"u": "union", "c": "conflict", "f": "first"})
    assert out.columns == ["k", "field", "sources", "path"]
    want = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        want[key, None] = sorted({r[3] for r in own})
        for at, field in ((4, "u"), (5, "c"), (6, "f")):
            has = [r for r in own if r[at] is not None]
            if len(own) > 1 and has:
                agreed = {"u": has, "c": [r for r in has if r[at] == has[0][at]], "f": has[:1]}[field]
                want[key, field] = sorted({r[3] for r in agreed})
    assert {(r["k"], r["field"]): r["sources"] for r in out.collect()} == want
    assert {r["path"] for r in out.filter("k is null").collect()} == {"/"} | {f"//{f}" for k, f in want if k is None and f}
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("HashAggregate") == 2  # a partial one and a final one, so that there is one exchange
    assert "Join" not in plan
