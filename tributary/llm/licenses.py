"""License scans: a positional index of rare words finds the places where a license passage may stand.

Every passage names phrases that it must hold. The rarest of their words, by document frequency in the scanned texts, is
the passage's entry in the index, with its position. Where a file has that word, the file's words are laid beside the
passage's at the same relative positions: mandatory phrases must stand letter by letter, and of all words, weighted by
rarity, half must agree. As the entry is itself mandatory, no place is missed. All of it is DataFrame functions on one
row at a time; only document frequencies of the passages' own words are shuffled."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import common

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A passage stands where words of at least this share of its weight agree, in percent.
LEAST_PERCENT = 50


@dataclass(frozen=True)
class Passage:
    """Words of a license's text or notice, and the phrases in it that must stand exactly."""

    label: str
    text: str
    phrases: tuple[str, ...]
    base: bool = False

    def must(self) -> list[bool]:
        """For each word, whether it is in a mandatory phrase."""
        words, out = self.text.split(), [False] * len(self.text.split())
        for phrase in self.phrases:
            p = phrase.split()
            at = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
            if not at:
                raise ValueError(f"{phrase!r} is not in {self.text!r}")
            out[at[0] : at[0] + len(p)] = [True] * len(p)
        return out


def _whole(label: str, text: str, base: bool = False) -> Passage:
    return Passage(label, text, (text,), base)


#: Phrases whose places are counted (fixed values).
BASE = (
    _whole("mit", "under the mit license", True),
    _whole("apache-2", "apache license version 2", True),
    _whole("cc-by-nc", "cc by nc", True),
)
#: Wordings of public licenses and of the notices that name them (fixed values), without punctuation.
PASSAGES = (
    Passage("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    Passage("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("not use this file except in compliance with the license",)),
    _whole("apache-2", "spdx license identifier apache 2 0"),
    Passage("bsd-2", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation", ("must reproduce the above copyright notice this list of conditions",)),
    Passage("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", ("endorse or promote products derived from this software",)),
    Passage("bsl-1", "distributed under the boost software license version 1 0", ("boost software license",)),
    Passage("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Passage("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    Passage("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Passage("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Passage("cc0", "released under the cc0 1 0 universal public domain dedication", ("cc0 1 0 universal",)),
    Passage("epl-2", "made available under the terms of the eclipse public license v 2 0", ("eclipse public license",)),
    Passage("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Passage("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Passage("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license as published by", "version 3 of the license")),
    Passage("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee is hereby granted",)),
    Passage("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    Passage("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("to deal in the software without restriction",)),
    _whole("mit", "spdx license identifier mit"),
    Passage("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Passage("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


def with_words(docs: DataFrame) -> DataFrame:
    """docs with _w: the words of text in lower case; a null has none.

    Only A-Z matter, as passages are ASCII: of all other letters the Kelvin sign alone has an ASCII one as its lower case."""
    parts = F.split(F.lower(F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("\u212a"), F.lit("\ufffd"))), SEPARATORS, -1)
    # Only the first and the last part can be empty.
    ends = lambda at: F.when(F.element_at("_parts", at) == "", 1).otherwise(0)
    inner = F.slice("_parts", F.lit(1) + ends(1), F.greatest(F.size("_parts") - ends(1) - ends(-1), F.lit(0)))
    return docs.withColumn("_parts", parts).withColumn("_w", inner).drop("_parts")


def weights(docs: DataFrame, passages: tuple[Passage, ...]) -> dict[str, int]:
    """For each word of the passages the binary length of (rows + 1) div (rows that have it + 1): a whole-number IDF.

    One aggregate over all rows, combined before it is shuffled. What comes to the driver is bounded by the passages."""
    vocabulary = sorted({w for p in passages for w in p.text.split()})
    own = F.array_distinct(F.filter("_w", lambda w: w.isin(*vocabulary)))
    rows = with_words(docs.select("text")).select(F.explode(F.concat(F.array(F.lit("")), own)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    df = {r["w"]: r["n"] for r in rows.collect()}
    n = df.get("", 0)
    return {w: ((n + 1) // (df.get(w, 0) + 1)).bit_length() for w in vocabulary}


def index(passages: tuple[Passage, ...], weight: dict[str, int]) -> list[dict]:
    """Each passage with its entry: the rarest word of its mandatory phrases (ties: the smallest word, then the first)."""
    out = []
    for p in passages:
        words, must = p.text.split(), p.must()
        at = min((k for k in range(len(words)) if must[k]), key=lambda k: (-weight[words[k]], words[k], k))
        out.append({"label": p.label, "base": p.base, "entry": words[at], "at": at, "words": [{"w": w, "weight": weight[w], "must": m} for w, m in zip(words, must, strict=True)], "total": sum(weight[w] for w in words)})
    return out


_INDEX = "array<struct<label:string,base:boolean,entry:string,at:int,words:array<struct<w:string,weight:int,must:boolean>>,total:int>>"


def scan(docs: DataFrame, passages: tuple[Passage, ...] = BASE + PASSAGES) -> DataFrame:
    """docs with n_words and found: an array of (label, base, start, percent6), one for each place where a passage stands.

    start counts words from 0 and may be negative where a text begins inside a passage; percent6 is the share of the
    passage's weight that agrees, in millionths. Rows stand for themselves: repeated rows and null ids are scanned like
    others, a null or empty text has no words and nothing found, all other columns stay (n_words and found are
    replaced if there). A text is scanned within its row, so it takes memory in proportion to its words."""
    if not passages:
        raise ValueError("no passages")
    entries = index(passages, weights(docs, passages))
    table = F.from_json(F.lit(json.dumps(entries)), _INDEX)
    looked_up = sorted({e["entry"] for e in entries})

    def agreeing(words: Column, c: Column) -> Column:
        """Weight of the words that stand where the passage has them; below 0 if a mandatory one does not."""
        one = F.transform(c["p"]["words"], lambda x, k: F.when(F.get(words, c["start"] + k) == x["w"], x["weight"]).when(x["must"], F.lit(-1_000_000)).otherwise(0))
        return F.aggregate(one, F.lit(0), lambda a, b: a + b)

    places = F.filter(F.transform("_w", lambda w, i: F.when(w.isin(*looked_up), i)), lambda i: i.isNotNull())
    rows = with_words(docs).withColumn("_at", F.when(F.exists("_w", lambda w: w.isin(*looked_up)), places).otherwise(F.array().cast("array<int>")))
    meet = F.flatten(F.transform("_at", lambda i: F.transform(F.filter(table, lambda p: p["entry"] == F.get(F.col("_w"), i)), lambda p: F.struct(p.alias("p"), (i - p["at"]).alias("start")))))
    told = F.transform(meet, lambda c: F.struct(c["p"]["label"].alias("label"), c["p"]["base"].alias("base"), c["start"].alias("start"), agreeing(F.col("_w"), c).alias("sum"), c["p"]["total"].alias("total")))
    good = F.filter(told, lambda x: x["sum"] * 100 >= x["total"] * LEAST_PERCENT)
    found = F.transform(good, lambda x: F.struct(x["label"].alias("label"), x["base"].alias("base"), x["start"].alias("start"), F.floor(x["sum"].cast("long") * 1_000_000 / x["total"]).alias("percent6")))
    return rows.withColumn("n_words", F.size("_w").cast("long")).withColumn("found", found).drop("_w", "_at")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License places and labels of every document; score is the best agreement found (0 if none)."""
    rows = scan(common.documents(common.table(spark, sf_dir, "documents")))
    base = F.filter("found", lambda x: x["base"])
    labels = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda x: x["label"]))), ",")
    start = F.transform(base, lambda x: x["start"].cast("long"))
    best = F.coalesce(F.array_max(F.transform("found", lambda x: x["percent6"])), F.lit(0)) / 1_000_000
    return rows.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("found")).alias("labels"), best.cast("double").alias("score"))


def _oracle() -> str:
    every = BASE + PASSAGES
    words = ", ".join(f"({t}, {k}, '{w}', {m})" for t, p in enumerate(every) for k, (w, m) in enumerate(zip(p.text.split(), p.must(), strict=True)))
    labels = ", ".join(f"({t}, '{p.label}', {p.base})" for t, p in enumerate(every))
    return rf"""
WITH tw(t, k, word, must) AS (VALUES {words}), tl(t, label, base) AS (VALUES {labels}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT r, unnest(range(len(w))) AS p, unnest(w) AS word FROM d),
f AS (SELECT word, count(DISTINCT r) AS df FROM x SEMI JOIN tw USING (word) GROUP BY 1),
tx AS (SELECT tw.*, length(bin(((SELECT count(*) FROM d) + 1) // (coalesce(df, 0) + 1))) AS weight FROM tw LEFT JOIN f USING (word)),
tt AS (SELECT t, sum(weight)::BIGINT AS total, count(*) FILTER (must) AS n_must FROM tx GROUP BY 1),
m AS (SELECT r, t, p - k AS start, sum(weight)::BIGINT AS s, count(*) FILTER (must) AS n_must FROM x JOIN tx USING (word) GROUP BY 1, 2, 3),
g AS (SELECT r, label, base, start, s * 1000000 // total AS percent6 FROM m JOIN tt USING (t, n_must) JOIN tl USING (t) WHERE s * 100 >= total * {LEAST_PERCENT}),
a AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(percent6) / 1000000 AS score FROM g GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN a USING (r)
"""


ORACLE = _oracle()
