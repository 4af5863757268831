"""Collocations, license scans and spelling variants: brute force on small texts, and hard cases."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tributary.llm import collocations, licenses, registry, spelling

SCHEMA = "doc_id long, text string, lang string, word string, n long, found string, part int"


def frame(spark, rows, parts=3):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, lang, "x", 7, "y", 1) for d, t, lang in rows], SCHEMA).repartition(parts)


def against_sql(spark, tmp_path, name, rows):
    frame(spark, rows).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    df = registry.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    q = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in q.description]
    got = sorted(map(tuple, df.select(*columns).collect()), key=str)
    assert got == sorted(q.fetchall(), key=str)
    return [dict(zip(columns, r, strict=True)) for r in got]


def phrases_of(docs, threshold, top):
    """The contract of collocations, by dictionaries."""
    f, out = {}, []
    for lang, text in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            for n in (1, 2, 3):
                for i in range(len(w) - n + 1):
                    f.setdefault(lang or "und", Counter())[tuple(w[i : i + n])] += 1
    for lang, c in f.items():
        n, found = sum(v for k, v in c.items() if len(k) == 1), []
        for p, a in c.items():
            if len(p) > 1 and a >= threshold:
                score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                if not any(len(q) > len(p) and b >= threshold and 100 * b >= 50 * a and p in (q[:2], q[1:]) for q, b in c.items()):
                    found.append((-score, -a, " ".join(p), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p, -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("mass", [1 << 24, 300])
def test_collocations(spark, monkeypatch, mass):
    monkeypatch.setattr(collocations, "MASS", mass)
    monkeypatch.setattr(collocations, "HELD", 50)
    rng = random.Random(mass)
    word = lambda: rng.choice(["a", "B", "the", "Éa", "x\0y", "in", "of", "zu"] if rng.random() < 0.8 else [f"w{rng.randrange(400)}"])
    rows = [(i, "".join(word() + rng.choice(["  ", "\t", " ", " ", ". ", "\n", ","]) for _ in range(rng.randrange(60))), rng.choice(["en", "en", "en", "und", None])) for i in range(120)]
    rows += [(200, None, "en"), (201, "", None), (202, " . ,", "de"), (203, "hot dog " * 400, "en"), (200, "hot dog stand", "en"), (204, "of", "fr")]
    got = collocations.collocations(frame(spark, rows, 7), top=15).collect()
    assert sorted(map(tuple, got)) == phrases_of([(lang, t) for _, t, lang in rows], 10, 15)
    assert any(r["lang"] == "und" for r in got) and any(r["phrase"] == "dog hot dog" for r in got)


def test_collocations_of_nothing(spark):
    for rows in ([], [(1, None, None)], [(1, "one two three", "en")]):
        assert collocations.collocations(frame(spark, rows)).collect() == []


def test_summary_loses_nothing_frequent():
    """Random streams of partial summaries, against exact counts; capacities down to one."""
    rng = np.random.default_rng(5)
    for capacity in (1, 5, 60, 400):
        summary, true = collocations.Summary(capacity, 10), Counter()
        for _ in range(60):
            ids, n = np.unique(rng.zipf(1.3, 200) % 5000, return_counts=True)
            summary.add(ids.astype(np.uint64), n.astype(np.int64))
            true.update(dict(zip(ids.tolist(), n.tolist(), strict=True)))
        left = set(summary.survivors().tolist())
        assert {k for k, v in true.items() if v >= 10} <= left <= {k for k, v in true.items() if v + 0 >= 10 - summary.spent}
        assert summary.spent < 10 and all(0 <= true[i] - c <= summary.spent for i, c in zip(summary.ids.tolist(), summary.counts.tolist(), strict=True))


def test_summary_is_bounded_by_mass():
    rng = np.random.default_rng(6)
    mass = 40 * 5000
    summary = collocations.Summary(mass // 10 + 1, 10)
    for _ in range(40):
        ids, n = np.unique(rng.integers(0, 1 << 40, 5000), return_counts=True)
        summary.add(ids.astype(np.uint64), n.astype(np.int64))
    summary.merge()
    assert summary.capacity == mass // 10 + 1 and len(summary.ids) <= summary.capacity


def test_full_filter_changes_nothing(spark, monkeypatch):
    rows = [(i, f"red fox number {i % 7} runs", "en") for i in range(90)]
    want = sorted(map(tuple, collocations.collocations(frame(spark, rows)).collect()))
    monkeypatch.setattr(collocations, "MOST_BITS", 8)
    assert sorted(map(tuple, collocations.collocations(frame(spark, rows)).collect())) == want and want


def test_licenses(spark, tmp_path):
    mit = next(p.text for p in licenses.PASSAGES if "deal in the software" in p.text)
    rows = [
        (1, "Released under the MIT License.", "en"), (2, None, "en"), (3, "", None), (4, "Apache License, Version 2.0; apache license version 2", "en"),
        (5, "CC BY-NC 4.0 and under\nthe-mit--license", "de"), (6, mit.title(), "en"), (7, "under the mit", "en"), (7, "license", "en"), (None, "cc by nc cc by nc", "en"),
        (8, "under the MİT license, under the mit liKense", "en"), (9, "x " * 30000 + "under the mit license " + "y " * 30000, "en"), (10, "to deal in the software without restriction", "en"),
        (11, "..." + mit.replace("granted", "given"), "en"), (12, "GNU General Public License, version 3", "en"), (13, "of the GNU General Public Licence version 3", "en"), (14, "under the mit license " * 300, "en"), (15, "!!", "en"),
    ]
    got = against_sql(spark, tmp_path, "op12_license_scan", rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] not in (7,)}
    assert len(got) == len(rows)
    assert (by[1]["base_labels"], by[1]["first_word"], by[1]["score"]) == ("mit", 1, 1.0)
    assert by[2]["n_words"] == by[3]["n_base"] == 0 and by[2]["labels"] == "" and by[2]["first_word"] is None and by[2]["score"] == 0
    assert by[4]["n_base"] == 2 and by[5]["base_labels"] == "cc-by-nc,mit" and by[None]["n_base"] == 2
    assert by[6]["n_base"] == 0 and by[6]["labels"] == "mit" and by[11]["labels"] == "mit" and by[11]["score"] < 1
    assert by[8]["n_base"] == 0 and by[9]["first_word"] == 30000 and by[14]["n_base"] == 300 and by[12]["labels"] == "gpl-3" and by[13]["labels"] == ""


def test_licenses_of_an_empty_table(spark):
    assert licenses.scan(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        licenses.Passage("x", "a b", ("b a",)).must()


def near(a, b):
    """By definition: one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    s, w = sorted((a, b), key=len)
    return len(w) == len(s) + 1 and any(w[:i] + w[i + 1 :] == s for i in range(len(w)))


def variants_of(counts, ratio=5):
    out = {}
    for w, n in counts.items():
        close = [v for v in counts if v != w and near(w, v)]
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        out[w] = (n, len(close), best if best and counts[best] >= ratio * n else None)
    rows = []
    for w, (n, m, form) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        rows.append((w, form, root, n, m, counts[form] if form else None))
    return sorted(rows)


@pytest.mark.parametrize("block,letters", [(1024, 1 << 16), (8, 1 << 16), (2, 40)])
def test_variants(spark, monkeypatch, block, letters):
    """Words over few letters, so that groups are large; also cut in tiles, and blocks of few letters."""
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block)
    monkeypatch.setattr(spelling, "BLOCK_LETTERS", letters)
    rng = random.Random(block)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(6, 9))) for _ in range(150)} | {"z" * k for k in (6, 7, 8, 9, 300, 301)} | {"abcdefg" * 9, "abcdefg" * 9 + "x", "x" + "abcdefg" * 9}
    counts = {w: rng.choice([5, 6, 24, 25, 124, 125, 130, 700, 3125]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got)) == variants_of(counts)
    assert any(r["root"] != r["form"] for r in got if r["form"])


def test_spelling_query(spark, tmp_path):
    rng = random.Random(3)
    base = ["kitchen", "garden", "gardén", "gardens", "SCHOOL", "École×", "÷division", "Mädchen"]
    rows = [(rng.choice([i, 7, None]), " ".join(rng.choice(base) + rng.choice([" ", "-", "1", "Ā", "\n"]) for _ in range(80)), "en") for i in range(400)] + [(1, None, "en"), (2, "", "en"), (3, "short", "en"), (4, "a" * 20000 + " " + "kitchen " * 50, "en")]
    counts = Counter()
    for d, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{low}".encode())
            word = low[: h % len(low)] + low[h % len(low) + 1 :] if h % 199 == 0 else low
            counts[word] += len(word) >= 6
    counts = {w: n for w, n in counts.items() if n >= 5}
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = spelling.op13_spelling_variants(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == variants_of(counts) and any(r["form"] for r in got)
    against_sql(spark, tmp_path, "op13_spelling_variants", [r for r in rows if r[0] is not None])
    assert spelling.variants(spelling.vocabulary(frame(spark, []))).collect() == []


def test_collocations_sql(spark, tmp_path):
    against_sql(spark, tmp_path, "op11_collocations", [(i, f"Good morning, dear\tteam {i % 3}: good Morning dear team!\x0bgood", "en" if i % 4 else None) for i in range(40)] + [(99, None, "fr")])
