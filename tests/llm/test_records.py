"""Archives, vectors, conversations and the pipeline."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tributary.llm import chat, common, components, decontaminate, embeddings, jaccard, packing, pii, registry, warc

SF = "/root/testdata/sf0.001"


def test_archives_come_back(spark, tmp_path):
    odd = "a\r\n\r\nWARC/1.1\r\nb"
    pages = [(1, "http://a.com/x", odd), (2, "http://a.com/x", odd), (3, None, None), (None, "u v", ""), (4, "http://b", "\r\n\r\n"), (5, "q", odd + odd), (6, "q", odd[1:-1]), (7, "q", "\r\n\r\nWARC/1.1"), (8, "q", "ü\r\n"), (3, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "timestamp'2024-01-01' as captured_at", "'x' as payload_digest_extra").repartition(2)
    for compression in ("none", "gzip"):
        path = str(tmp_path / compression)
        warc.write_archives(df, path, compression)
        got = warc.read_archives(spark, path).collect()
        assert len(got) == len(pages)
        texts = {p: h or "" for p, _, h in pages}
        for r in got:
            if r["record_type"] == "response":
                assert r["payload"] == texts[r["page_id"]] and r["refers_to"] is None
            else:
                assert r["payload"] is None and r["refers_to"] < (r["page_id"] or 99)
            assert r["payload_bytes"] == len(texts[r["page_id"]].encode())
        assert sorted(r["page_id"] or 0 for r in got if r["record_type"] == "revisit") == [0, 2]


def test_histories_are_in_global_order(spark):
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(9)}" if rng.random() < 0.9 else "hot", rng.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t int, page_id long").repartition(5)
    df = df.select(F.col("k").alias("url"), F.timestamp_seconds("t").alias("captured_at"), "page_id", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), F.lit(1).cast("long").alias("payload_bytes"), F.lit("d").alias("payload_digest"))
    old = warc.RUN_ROWS, warc.MERGE_ROWS
    warc.MERGE_ROWS = 700
    try:
        got = warc.merge_runs(warc.capture_runs(df)).orderBy("range_no", "position").collect()
    finally:
        warc.RUN_ROWS, warc.MERGE_ROWS = old
    keys = [(r["url_key"], r["captured_at"], r["page_id"]) for r in got]
    assert keys == sorted(keys) and len(keys) == 3000 and len({r["range_no"] for r in got}) > 1


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(rng.randrange(20) for _ in range(rng.randrange(15))) for _ in range(k)]
    assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 24))
    v = np.concatenate([b + rng.standard_normal((int(rng.integers(1, 20)), 24)) * rng.choice([0.1, 0.2, 0.25]) for b in base]).astype(np.float32)
    v = np.concatenate([v, v[:30], v[:10] * 2])
    ids = rng.permutation(len(v))
    df = spark.createDataFrame([(int(i), [float(y) for y in x], "clash") for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<float>, node string")
    u = v.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = ids.copy()
    while (new := np.minimum(label, np.where(near, label[None, :], 10**9).min(axis=1))).tolist() != label.tolist():
        label = new
    want = sorted((int(i), int(n), int(c), bool(i == c)) for i, n, c in zip(ids, near.sum(axis=1), label, strict=True))
    for width, cells in ((16, 12_000), (8, 100)):
        assert sorted(tuple(r) for r in embeddings.near_duplicates(df, width=width, cell_rows=cells).collect()) == want


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [inf, 1.0]), (7, [nan, 1.0]), (9, [1.0, -0.3]), (9, [1.0, -0.3]), (None, [1.0, 0.0]), (10, [1e-30, 0.0]), (11, [-1.0, 0.0])]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(i, 0, i, True) for i in (3, 4, 5, 6, 7, 11)] + [(1, 5, 1, True), (2, 5, 1, False), (10, 5, 1, False), (None, 5, 1, False), (9, 5, 1, False), (9, 5, 1, False)], key=str)
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (5, 5), (20, 19), (19, 18), (18, 17), (17, 3)]
    got = dict(tuple(r) for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**dict.fromkeys((1, 2, 3, 17, 18, 19, 20), 1), **dict.fromkeys((6, 7, 8, 9), 6), 5: 5}


EVENTS = "conv_id long, turn long, message_id long, role string, kind string, seq long, text string"


def test_fold(spark):
    rows = [
        (1, 0, 0, "user", "message", 0, "hel"), (1, 0, 0, "user", "delta", 1, "lo"), (1, 1, 1, "assistant", "message", 2, ""), (1, 1, 1, "assistant", "delta", 4, "B"), (1, 1, 1, "assistant", "delta", 3, "A"),
        (1, 2, 2, "user", "message", 5, "later"), (1, 1, 1, "assistant", "regenerate", 6, None), (1, 1, 1, "assistant", "delta", 7, "new"), (1, 0, 0, "user", "edit", 8, "bye"), (1, 0, 0, "user", "delta", 9, "!"),
        (2, 0, 3, "assistant", "delta", 1, "x"), (2, 0, 3, "assistant", "what", 2, "ignored"), (None, None, 4, None, "message", 0, None),
    ]
    got = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in chat.fold(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == {(1, 0): ("user", "bye!"), (1, 1): ("assistant", "new"), (2, 0): ("assistant", "x"), (None, None): ("", "")}


def test_regenerations_take_back_later_turns(spark, monkeypatch):
    monkeypatch.setattr(chat, "TURNS", 3)
    rng = random.Random(4)
    rows, want = [], set()
    for conv in (None, 1, 2):
        n, seq, began, again = 20, 0, {}, []
        for turn in range(n):
            began[turn] = seq
            rows.append((conv, turn, turn, "user", "message", seq, f"t{turn}"))
            seq += 1
            if rng.random() < 0.25:
                back = rng.randrange(turn + 1)
                again.append((back, seq))
                rows += [(conv, back, back, "user", "regenerate", seq, None), (conv, back, back, "user", "delta", seq + 1, "new")]
                seq += 2
        want |= {(conv, t) for t in range(n) if not any(b < t and s > began[t] for b, s in again)}
    rng.shuffle(rows)
    got = chat.fold(spark.createDataFrame(rows, EVENTS)).collect()
    assert {(r["conv_id"], r["turn"]) for r in got} == want and len(got) == len(want)


def test_conversations_come_back(spark):
    odd = ["<s>[user]\nhi</s>\n", "\\", "\\l", "[", "]\n", "", None, "é" * 5000, "</s>[INST] ok [/INST]"]
    rows = [(i % 3, i, ("user", "assistant", "a]\n<b", None)[i % 4], t) for i, t in enumerate(odd)] + [(0, 0, "user", odd[0])]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    rendered = chat.render(chat.fold(chat.event_log(talk)))
    for c in chat.assemble(rendered).collect():
        want = sorted(((t, r or "", x or "") for k, t, r, x in rows if k == c["conv_id"]))
        assert list(chat.parse(c["formatted"])) == [(r, x) for _, r, x in want]
        learnt = [chat.unescape(c["formatted"][s["start"] : s["end"]]) for s in c["loss_spans"]]
        assert learnt == [x for _, r, x in want if r == "assistant"]
    assert chat.digest(rendered).count() == 3
    assert chat.digest(chat.render(chat.fold(chat.event_log(talk.limit(0))))).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "conversations", "documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    q = con.execute(registry.ORACLES[name])
    names = [d[0] for d in q.description]
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(q.fetchall())


def test_pipeline(spark):
    """Stage by stage on what the one before kept: near-duplicates and benchmark passages against brute force, personal
    data by what must not be left, packing by its places and lengths."""
    docs = common.table(spark, SF, "documents")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(common.stash(stage(spark, steps[-1], SF), "stage"))
    assert all(s.columns == docs.columns for s in steps[:-1])
    texts = [{r["doc_id"]: r["text"] for r in s.select("doc_id", "text").collect()} for s in steps[:-1]]
    ids = [set(t) for t in texts]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    assert len(ids[1]) > 0.8 * len(ids[0]) and all(texts[0][d] == t for d, t in texts[1].items())
    assert ids[2] == {d for d, _, c in jaccard.brute_force(sorted(texts[1].items())) if d == c}
    items = [tuple(r) for r in common.table(spark, SF, "benchmark").select("item_id", "text").collect()]
    found = {r[0]: r for r in decontaminate.brute_force(sorted(texts[2].items()), items)}
    assert {d for d in ids[2] if texts[3].get(d) != texts[2][d]} == {d for d, r in found.items() if r[2] > 0}
    assert not any(r[2] for r in decontaminate.brute_force(sorted(texts[3].items()), items) if found[r[0]][2] == 0)
    assert ids[4] == ids[3] and not any(pii.base_spans(t or "") for t in texts[4].values())
    kept = [t for d, t in texts[4].items() if t != texts[3][d]]
    assert all("<" in t for t in kept) and kept
    placed = steps[5].collect()
    assert {r["doc_id"] for r in placed} == ids[4]
    runs: dict = {}
    for r in placed:
        runs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in runs.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False)) and sum(n for _, n in places) <= packing.CAPACITY


def test_stages_take_any_columns(spark):
    """Ties, repeated rows, nulls, and extra columns with the names that operators use inside."""
    rows = [(1, "red fox runs in the old wood by day", "en"), (1, "red fox runs in the old wood by day", "en"), (2, "red fox runs in the old wood by day", None), (3, None, "en"), (4, "mail a@b.org or 10.0.0.1 at once please", "en"), (5, "", "de"), (6, "12345 67", "en")]
    extra = {"component": "c", "th": "1", "f": "2", "spans": "s", "_key": "k", "score": "0.1", "lang_pred": "xx", "_items": "i", "label": "l"}
    docs = spark.createDataFrame([(*r, "s", 1, *extra.values()) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra))
    for cut in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, cut, SF)
            assert out.columns == docs.columns
            got = out.collect()
            assert all(r["component"] == "c" and r["_key"] == "k" and r["spans"] == "s" for r in got)
        corpus_pipeline.STAGES[-1][1](spark, cut, SF).collect()
    near = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in near) == [1, 3, 4, 5, 6]
