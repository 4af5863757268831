"""Inputs at the edges of formats and blocks: archive borders, repeated items, sets of any size, tiles of long sets."""

import numpy as np

from tributary.llm import decontaminate, jaccard, warc


def test_payloads_that_look_like_borders(spark, tmp_path):
    v, n = "WARC/1.1", "\r\n"
    odd = [v, v + n, n + v + n, n + n + v, n + n + v + n, "x" + n + n + v, "x" + n + v, n, n + n, "WA" + v, v + v, "0" + n + n, v + n + n + "0" + n + n + v + n, "X" + n + v + n + n + n + v + n, "é" + v + n, "a" * 70_000 + n + n + v]
    rows = [(i, f"http://h/{i}", x) for i, x in enumerate(odd)]
    for parts in (1, 5):
        path = str(tmp_path / str(parts))
        warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "timestamp'2024-01-01' as captured_at").repartition(parts), path)
        got = {r["page_id"]: r["payload"] for r in warc.read_archives(spark, path).collect()}
        assert got == dict(enumerate(odd))


def test_archives_of_nothing(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string, captured_at timestamp"), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).collect() == []


def test_repeated_items_are_one(spark):
    items = [(7, "one two three four five " * 50)] * 500 + [(8, f"item number {i} " * 30) for i in range(40)]
    blocks = list(decontaminate.blocks(spark.createDataFrame(items, "item_id long, text string"), 10, 8_000))
    sizes = [sum(len(w) + 1 for words in b.words for w in words) for b in blocks]
    assert len(blocks) > 1 and sum(len(b.items) for b in blocks) == 41 and max(sizes) < 30_000


def test_bands_of_any_size():
    assert jaccard._TOPS[-1] > 10**11 and (np.diff(jaccard._TOPS) > 0).all() and len(jaccard._TOPS) < 1 << jaccard.BAND_BITS
    assert jaccard.band_parts(np.array([99]))[0] < 1 << 62


def test_tiles_of_long_sets(spark, monkeypatch):
    """Tiles cut by features: the same classes as brute force."""
    monkeypatch.setattr(jaccard, "TILE_FEATURES", 300)
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(60):
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 7)):
            words[at] = f"x{i}_{at}"
        docs.append((i, " ".join(words)))
    got = jaccard.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == jaccard.brute_force(docs)
