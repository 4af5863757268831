"""Hard cases of the operators on texts: colliding hashes, very long texts, hot passages, hard lengths, ties."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tributary.llm import common, decontaminate, embeddings, jaccard, langid, packing, quality, substring, textvec

SF = "/root/testdata/sf0.001"


def morse(n: int, a: str, b: str) -> str:
    """A word of 2**n letters, on which polynomial hashes modulo a power of two are weak."""
    x, y = a, b
    for _ in range(n):
        x, y = x + y, y + x
    return x


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_words_of_regular_patterns_differ(spark):
    x, y = morse(10, "a", "b"), morse(10, "b", "a")
    (w,) = list(textvec.chunks(pa.array([f"{x} {y}"]), textvec.BLANK_SEPARATED))
    assert len(set(w.hashes().tolist())) == 2
    (w,) = list(textvec.chunks(pa.array([" ".join([*morse(6, "a", "b"), *morse(6, "b", "a")])]), textvec.BLANK_SEPARATED))
    assert len(set(textvec.window_hashes(w.hashes(), 64).tolist())) > 60
    rng = random.Random(1)
    own = [f"w{rng.randrange(400)}" for _ in range(60)]
    one, two = list(own), list(own)
    one[10:50:5], two[10:50:5] = [x] * 8, [y] * 8
    rows = [(1, " ".join(one)), (2, " ".join(two)), (3, " ".join(one))]
    assert sorted(map(tuple, jaccard.jaccard_classes(frame(spark, rows)).drop("th").collect())) == sorted(jaccard.brute_force(rows))
    rows = [(1, " ".join([*own, x, *own])), (2, " ".join([*own, y, *own])), (3, " ".join([*own, x]))]
    assert sorted(map(tuple, substring.remove_copies(frame(spark, rows)).collect())) == sorted(substring.brute_force(rows))


def test_edges_of_one_hash_but_other_words_are_no_copies(spark):
    rows = [(5, None, 1, 10, 0, 1, 70), (5, None, 2, 20, 0, 1, 70), (5, None, 3, 30, 4, 1, 71)]
    repeated = spark.createDataFrame(rows, substring.EDGES)
    got = {r["d"]: r["spans"][0] for r in substring.path_spans(repeated).collect()}
    assert {d: (s["od"], s["oth"], s["oidx"], s["plain"]) for d, s in got.items()} == {1: (1, 10, 0, False), 2: (1, 10, 0, False), 3: (3, 30, 4, False)}


def test_very_long_texts(spark):
    """One text of millions of bytes beside short ones, and one word of a million letters."""
    rng = random.Random(2)
    kinds = [f"w{i}" for i in range(3000)]
    long = " ".join(rng.choices(kinds, k=700_000))
    piece = " ".join(long.split(" ")[500_000:500_080])
    rows = [(1, long), (2, piece), (3, long + " end"), (4, "z" * 1_000_000 + " " + piece), (5, None), (6, "")]
    df = frame(spark, rows)
    got = {r["doc_id"]: r for r in jaccard.jaccard_classes(df).collect()}
    assert got[3]["component_id"] == 1 and got[2]["component_id"] == 2 and got[4]["component_id"] == 2 and got[1]["n_shingles"] > 690_000
    removed = {r["doc_id"]: r["n_removed"] for r in substring.remove_copies(df).collect()}
    assert removed == {1: 0, 2: 80, 3: 700_000, 4: 80, 5: 0, 6: 0}
    bench = spark.createDataFrame([(7, piece)], "item_id long, text string")
    hits = {r["doc_id"]: sum(s["last"] - s["first"] + 1 for s in r["hit_spans"]) for r in decontaminate.contamination(df, bench).collect()}
    assert hits == {1: 80, 2: 80, 3: 80, 4: 80, 5: 0, 6: 0}
    model = langid.fit(["ka lo mi"] * 5 + ["ser ton vix"] * 5, ["aa"] * 5 + ["bb"] * 5)
    langs = langid.identify(frame(spark, [(1, "ka lo mi " * 300_000), (2, "ser ton"), (3, "ka " + "lo" * 400_000)]), model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in langs}[1] == "aa" and len(langs) == 3
    assert quality.weights(df, spark.createDataFrame([(2,)], "doc_id long")).filter("log_weight <> 0").count() == 4


def test_a_passage_in_every_document(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(75)]
    texts = []
    for _ in range(400):
        x = list(passage)
        if rng.random() < 0.3:
            x[rng.randrange(75)] = "changed"
        texts.append(" ".join([*[word() for _ in range(rng.randrange(90))], *x, *[word() for _ in range(rng.randrange(90))]]))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert sorted(map(tuple, substring.remove_copies(frame(spark, rows)).collect())) == sorted(substring.brute_force(rows))


def test_a_large_group_of_near_copies_takes_comparisons_in_proportion(spark, monkeypatch):
    made = []
    verified = jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, sets: (made.append(pairs.count()), verified(pairs, sets))[1])
    for n in (150, 600):
        rng = random.Random(4)
        base = [f"w{rng.randrange(900)}" for _ in range(120)]
        rows = []
        for k in range(n):
            x = list(base)
            for i in rng.sample(range(120), 2):
                x[i] = f"n{k}.{i}"
            rows.append((k, " ".join(x)))
        before = sum(made)
        got = jaccard.jaccard_classes(frame(spark, rows)).collect()
        assert {r["component_id"] for r in got} == {0} and len(got) == n
        assert sum(made) - before <= n * jaccard.ROUNDS


@pytest.mark.parametrize(("low", "high"), [(400, 1099), (600, 800)])
def test_the_genetic_algorithm_beats_best_fit_decreasing(low, high):
    """On lengths that best fit packs badly, one island saves more than a hundredth of the bins."""
    rng = random.Random(5)
    lengths = [rng.randrange(low, high + 1) for _ in range(3000)]
    order = sorted(range(3000), key=lambda i: -lengths[i])
    plain = packing.best_fit_decreasing(order, lengths, 2048)
    assert len(plain) > -(-sum(lengths) // 2048)
    best = packing.evolve(lengths, [], 2048, random.Random(1))
    assert sorted(i for b in best for i in b) == list(range(3000)) and all(sum(lengths[i] for i in b) <= 2048 for b in best)
    assert len(best) < 0.99 * len(plain)
    again = packing.evolve(lengths, [best], 2048, random.Random(2))
    assert len(again) <= len(best)  # elites stay
    child = packing.crossover(best, plain, lengths, 2048, random.Random(3))
    assert sorted(i for b in child for i in b) == list(range(3000))


def test_hard_lengths_over_shards(spark):
    rng = random.Random(6)
    lengths = [rng.randrange(400, 1100) for _ in range(1500)]
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length int")
    got = packing.pack(items, capacity=2048, shard_pieces=500).collect()
    fill: dict = {}
    for r in got:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], lengths[r["item"]]))
    assert sorted(r["item"] for r in got) == list(range(1500))
    for x in fill.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 2048
    plain = packing.best_fit_decreasing(sorted(range(1500), key=lambda i: -lengths[i]), lengths, 2048)
    assert len(fill) < len(plain)


def test_every_shard_above_its_bound_evolves(spark, monkeypatch):
    """One shard or many, of all pieces at once: only those that best fit packs into as few bins as their sum allows rest."""
    rng = random.Random(19)
    lengths = [rng.randrange(60, 900) for _ in range(4800)]
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length int")
    for shard_pieces in (1600, 4800):
        seen, epoch = [], packing._epoch
        monkeypatch.setattr(packing, "_epoch", lambda evolved, *a, seen=seen, epoch=epoch: seen.append(evolved) or epoch(evolved, *a))
        got = packing.pack(items, capacity=2048, shard_pieces=shard_pieces).collect()
        monkeypatch.undo()
        shards: dict = {}
        dealt = items.selectExpr("pmod(xxhash64(item, 0), %d)" % (4800 // shard_pieces), "length")
        for shard, length in dealt.collect():
            shards.setdefault(shard, []).append(length)
        above = {s for s, x in shards.items() if len(packing.best_fit_decreasing(sorted(range(len(x)), key=lambda i: -x[i]), x, 2048)) > -(-sum(x) // 2048)}
        assert above and seen and {r[0] for r in seen[0].select("shard").distinct().collect()} == above
        assert sorted(r["item"] for r in got) == list(range(4800))


def test_pieces_are_the_tokenizers_own(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(7)
    texts = [" ".join(f"word{rng.randrange(99)}" for _ in range(rng.randrange(900))) for _ in range(12)] + ["", None, "Ünïcode — 12"]
    rows = list(enumerate(texts))
    want = set()
    for d, t in rows:
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 256):
            part = ids[k : k + 256]
            want.add((d, k // 256, k, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    got = packing.pack_documents(frame(spark, rows), capacity=256).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)


def test_vectors_of_many_cells_and_lengths(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((300, 16))
    v = np.concatenate([base, base[:200] + rng.standard_normal((200, 16)) * 0.08, base[:100] + rng.standard_normal((100, 16)) * 0.08])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    rows = [(i, [float(y) for y in x]) for i, x in enumerate(v)] + [(1000, [1.0, 0.0]), (1001, [3.0, 0.1]), (1002, [1.0]), (1003, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for cells in (12_000, 20):
        got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, cell_rows=cells, width=4).collect()}
        assert [got[i]["n_links"] for i in range(600)] == near.sum(axis=1).tolist()
        assert [(got[i]["n_links"], got[i]["component_id"]) for i in (1000, 1001, 1002, 1003)] == [(1, 1000), (1, 1000), (0, 1002), (0, 1003)]


@pytest.mark.parametrize("cells", [1, 2, 3, 8, 9])
def test_each_pair_of_cells_meets_once(cells):
    for a, b in itertools.combinations(range(cells), 2):
        assert embeddings.visits(np.array([a]), b, cells)[0] != embeddings.visits(np.array([b]), a, cells)[0]
    assert not any(embeddings.visits(np.array([a]), a, cells)[0] for a in range(cells))


def test_forward_backward_is_the_sum_over_all_label_sequences():
    rng = np.random.default_rng(9)
    sizes, m = [4, 1, 3, 0, 5], 3
    first = np.append(0, np.cumsum(sizes))
    scores = rng.standard_normal((first[-1], m)).astype(np.float32)
    moves, start = rng.standard_normal((m, m)).astype(np.float32), rng.standard_normal(m).astype(np.float32)
    gamma, moved, began = langid.forward_backward(scores, first, moves, start, pairs=True)
    want, want_moved, want_began = np.zeros_like(scores, dtype=float), np.zeros((m, m)), np.zeros(m)
    for a, n in zip(first, sizes, strict=False):
        if not n:
            continue
        paths = list(itertools.product(range(m), repeat=n))
        odds = np.array([start[p[0]] + sum(scores[a + t, y] for t, y in enumerate(p)) + sum(moves[x, y] for x, y in zip(p, p[1:], strict=False)) for p in paths], dtype=float)
        share = np.exp(odds - odds.max())
        share /= share.sum()
        for p, s in zip(paths, share, strict=True):
            want_began[p[0]] += s
            for t, y in enumerate(p):
                want[a + t, y] += s
            for x, y in zip(p, p[1:], strict=False):
                want_moved[x, y] += s
    assert np.abs(gamma - want).max() < 1e-4 and np.abs(moved - want_moved).max() < 1e-3 and np.abs(began - want_began).max() < 1e-3


def test_a_prediction_hangs_on_its_own_text_only():
    model = langid.fit(["ka lo mi ka", "ser ton vix"] * 4, ["aa", "bb"] * 4)
    texts = ["ka", "ser", "lo", "vix", "kaser", "", None, "mi"]
    langs, scores = langid.predict(pa.array(texts), model)
    alone = [langid.predict(pa.array([t], pa.string()), model) for t in texts]
    assert langs == [x[0][0] for x in alone] and np.allclose(scores, [x[1][0] for x in alone])


def test_weights_by_brute_force(spark):
    rng = random.Random(10)
    rows = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(12)))) for i in range(60)] + [(60, None), (61, "A-b 7é")]
    target = {i for i in range(0, 60, 3)}
    got = {r["doc_id"]: r["log_weight"] for r in quality.weights(frame(spark, rows), spark.createDataFrame([(i,) for i in target], "doc_id long")).collect()}

    def grams(text):
        words = decontaminate.item_words(text)
        h = [int(textvec.span_hashes(np.frombuffer(w, dtype=np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in words]
        pairs = [int(textvec.window_hashes(np.array(x, dtype=np.uint64), 2)[0]) for x in zip(h, h[1:], strict=False)]
        return [x % quality.BUCKETS for x in h + pairs]

    raw, hit = (np.full(quality.BUCKETS, quality.SMOOTHING) for _ in range(2))
    for d, t in rows:
        for b in grams(t):
            raw[b] += 1
            hit[b] += d in target
    ratio = np.log(hit / hit.sum()) - np.log(raw / raw.sum())
    assert all(abs(got[d] - sum(ratio[b] for b in grams(t))) < 1e-9 for d, t in rows)


def test_top_k_settles_ties_without_ranking(spark, monkeypatch):
    monkeypatch.setattr(quality, "_SEEN", 3)
    monkeypatch.setattr(quality, "_STEPS", 4)
    rng = random.Random(11)
    rows = [(rng.randrange(40) if rng.random() < 0.9 else None, rng.choice([0.0, 1.5, -2.0, 1e9])) for _ in range(120)] + [(7, 1.5)] * 30
    df = spark.createDataFrame(rows, "doc_id long, log_weight double").repartition(4)
    for k in (0, 1, 17, 90, 149, 150):
        out = quality.gumbel_top_k(df, k).collect()
        chosen = [r for r in out if r["selected"]]
        assert len(out) == 150 and len(chosen) == k
        if 0 < k < 150:
            assert min(r["score"] for r in chosen) >= max(r["score"] for r in out if not r["selected"])
    values = spark.createDataFrame([(x,) for x in (-(2**63), 2**63 - 1, 5, 5, 6, -7)], "v long")
    assert [quality.kth(values, F.col("v"), k) for k in (1, 2, 3, 5, 6)] == [(-(2**63), 0, 1), (-7, 1, 1), (5, 2, 2), (6, 4, 1), (2**63 - 1, 5, 1)]


def test_stages_take_nulls_empty_tables_and_repeated_rows(spark):
    docs = common.table(spark, SF, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", None, "s", 0), (3, "  \t", None, "s", 3), (4, "x", "en", None, 1), (4, "x", "en", None, 1)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        few = stage(spark, odd, SF)
        assert name == "best-fit packing" or few.columns == docs.columns
        few.collect()
        assert stage(spark, docs.limit(0), SF).count() == 0
    kept = corpus_pipeline.near_duplicates(spark, odd, SF).collect()
    assert sum(r["doc_id"] == 4 for r in kept) == 1 and len(kept) == 5
    packed = corpus_pipeline.pack(spark, odd, SF).collect()
    assert len(packed) == 6 and all(r["start"] == 0 for r in packed)
