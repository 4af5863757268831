"""Phrase collocations: n-grams that occur often, and how much oftener than their parts.

First pass: n-grams are hashed, and each hash partition keeps a Misra-Gries summary. Tasks send their counts as partial
summaries; they are merged by adding, and beyond the capacity the same amount is taken from every counter. A capacity
above mass / threshold keeps what is taken below the threshold in all; the merge also keeps account of it, so that
every n-gram with threshold occurrences survives whatever the data. Second pass: survivors are counted exactly, as
texts. A Bloom filter of bounded size tells the second pass what survived; what it lets through by mistake is counted
and then dropped, so hashes never decide a result."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.llm import common, textvec

LONGEST, THRESHOLD, COVERED_PERCENT, TOP = 3, 10, 50, 2000
SCALE = 1_000_000
UNKNOWN = "und"
#: N-gram occurrences of one hash partition, about; its summary has a THRESHOLD-th of that.
MASS = 1 << 24
#: Distinct n-grams that a task of the first pass holds before it sends them on.
HELD = 1 << 21
#: Of the Bloom filter: bits for each survivor, and in all (32 MB). Beyond, it lets more through, and results stay.
BITS, MOST_BITS = 12, 1 << 28
_PROBES = 4
_BREAKS = np.isin(np.arange(256), list(b".,;:!?\n\x0b\x0c\r"))
WORDS = textvec.byte_table(lambda b: b not in b" \t.,;:!?\n\x0b\x0c\r", lower=True)


@dataclass
class Level:
    """Distinct n-grams of a chunk: the (n-1)-gram each begins with, its last word, its hash, and its occurrences.
    Of the first level `before` is the language."""

    before: np.ndarray
    last: np.ndarray
    ids: np.ndarray
    counts: np.ndarray


def levels(words: textvec.Words, langs: np.ndarray, lang_hashes: np.ndarray, longest: int) -> tuple[list[Level], np.ndarray]:
    """N-grams of 1 to longest words within pieces, by language, and for each distinct word a place where it stands.
    Words are told apart by 128 bits; n-grams by their words."""
    hashes, again = words.hashes(0), words.hashes(1)
    _, place, code = np.unique(hashes, return_index=True, return_inverse=True)
    if (again != again[place][code]).any():
        _, place, code = np.unique(np.stack([hashes, again], axis=1), axis=0, return_index=True, return_inverse=True)
        code = code.ravel()
    own, kinds = hashes[place], max(1, len(place))
    piece = np.cumsum(_BREAKS[words.raw], dtype=np.int64)[words.starts] if len(words.starts) else np.zeros(0, dtype=np.int64)
    out: list[Level] = []
    gram, known = langs[words.rows], lang_hashes
    for n in range(1, longest + 1):
        live = np.arange(len(code) - n + 1) if len(code) >= n else np.zeros(0, dtype=np.int64)
        live = live[(words.rows[live] == words.rows[live + n - 1]) & (piece[live] == piece[live + n - 1])]
        keys, inverse, counts = np.unique(gram[live] * kinds + code[live + n - 1], return_inverse=True, return_counts=True)
        before, last = keys // kinds, keys % kinds
        with np.errstate(over="ignore"):
            ids = textvec.mix(known[before] * np.uint64(0x9E3779B97F4A7C15) + own[last] + np.uint64(n))
        out.append(Level(before, last, ids, counts))
        gram = np.full(len(code), -1, dtype=np.int64)
        gram[live], known = inverse, ids
    return out, place


def _chunks(batch: pa.RecordBatch, longest: int) -> Iterator[tuple[list[str], list[Level], np.ndarray, textvec.Words]]:
    """For each chunk of batch(lang, text) its languages, its n-grams, and where its words stand."""
    coded = batch.column(0).dictionary_encode()
    names = coded.dictionary.to_pylist()
    lang = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    hashes = np.array([textvec.span_hashes(np.frombuffer(x.encode(), dtype=np.uint8), np.array([0]), np.array([len(x.encode())]))[0] for x in names], dtype=np.uint64)
    for words in textvec.chunks(batch.column(1), WORDS):
        yield names, *levels(words, lang[words.lo : words.hi], hashes, longest), words


def _summed(ids: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids in order, and the sums of their counts."""
    every, n = np.concatenate(ids), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    every, n = every[order], n[order]
    new = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, dtype=np.int64)
    return every[new], np.add.reduceat(n, new) if len(new) else n


def _part(ids: np.ndarray, parts: int) -> np.ndarray:
    """The hash partition of each id, growing with the id."""
    return ((ids >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


class Summary:
    """Misra-Gries counters of one hash partition. Each is at most `spent` below the true count, and never above it;
    spent stays below the threshold: where taking more would pass it, the capacity doubles instead."""

    def __init__(self, capacity: int, threshold: int):
        self.capacity, self.threshold, self.spent = max(1, capacity), threshold, 0
        self.ids, self.counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self._more: list[tuple[np.ndarray, np.ndarray]] = []
        self._waiting = 0

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """Merge another summary; ids are distinct."""
        self._more.append((ids, counts))
        self._waiting += len(ids)
        if self._waiting > self.capacity:
            self.merge()

    def merge(self) -> None:
        self.ids, self.counts = _summed([self.ids, *[i for i, _ in self._more]], [self.counts, *[c for _, c in self._more]])
        self._more, self._waiting = [], 0
        while len(self.ids) > self.capacity:
            at = len(self.ids) - self.capacity - 1
            take = int(np.partition(self.counts, at)[at])
            if self.spent + take >= self.threshold:
                self.capacity *= 2
                continue
            self.spent += take
            left = self.counts > take
            self.ids, self.counts = self.ids[left], self.counts[left] - take

    def survivors(self) -> np.ndarray:
        """All ids that may have threshold occurrences, in order."""
        self.merge()
        return self.ids[self.counts + self.spent >= self.threshold]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))


def survivors(docs: DataFrame, longest: int = LONGEST, threshold: int = THRESHOLD, mass: int | None = None) -> DataFrame:
    """(part, parts, ids, n): for each hash partition the hashes of n-grams of 2 to longest words that may occur
    threshold times, as little-endian 64-bit numbers in order. None that does is missing."""
    texts = _texts(docs)
    # Words take two signs each at least, so there are at most so many n-grams of each length.
    signs = texts.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    most = (longest - 1) * signs // 2 + 1
    parts = -(-most // (mass or MASS))
    capacity = most // parts // threshold + 1

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            ids, counts = _summed([i for i, _ in held], [c for _, c in held])
            cuts = np.searchsorted(_part(ids, parts), np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                i, c = ids[cuts[p] : cuts[p + 1]], counts[cuts[p] : cuts[p + 1]]
                yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "once": pa.array([i[c == 1].tobytes()], pa.binary()), "ids": pa.array([i[c > 1].tobytes()], pa.binary()), "counts": pa.array([c[c > 1].astype("<i8").tobytes()], pa.binary())})

        for batch in batches:
            for _, found, _, _ in _chunks(batch, longest):
                held += [(x.ids, x.counts) for x in found[1:]]
                size += sum(len(x.ids) for x in found[1:])
                if size > HELD:
                    yield from send()
                    held, size = [], 0
        if held:
            yield from send()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary, part = Summary(capacity, threshold), None
        for batch in batches:
            for p, once, ids, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = p
                one, more = np.frombuffer(once, dtype="<u8"), np.frombuffer(ids, dtype="<u8")
                summary.add(np.concatenate([one, more]), np.concatenate([np.ones(len(one), dtype=np.int64), np.frombuffer(counts, dtype="<i8")]))
        if part is not None:
            left = summary.survivors()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "parts": pa.array([parts], pa.int32()), "ids": pa.array([left.tobytes()], pa.binary()), "n": pa.array([len(left)], pa.int64())})

    sent = common.map_arrow(texts, local, "part int, once binary, ids binary, counts binary")
    return common.map_arrow(sent.repartitionById(parts, F.col("part")), merged, "part int, parts int, ids binary, n long")


def _probes(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    """Places of each id among the bits of its partition."""
    a = textvec.mix(ids ^ np.uint64(0xA0761D6478BD642F))
    lo, hi = a & np.uint64(0xFFFFFFFF), (a >> np.uint64(32)) | np.uint64(1)
    return [((lo + hi * np.uint64(k)) % np.uint64(bits)).astype(np.int64) for k in range(_PROBES)]


class Filter:
    """A Bloom filter in one segment for each hash partition."""

    def __init__(self, segments: dict[int, bytes], parts: int, bits: int):
        self.parts, self.bits = parts, bits
        self.bytes = np.zeros((parts, bits // 8), dtype=np.uint8)
        for p, s in segments.items():
            self.bytes[p] = np.frombuffer(s, dtype=np.uint8)

    def holds(self, ids: np.ndarray) -> np.ndarray:
        part, out = _part(ids, self.parts), np.ones(len(ids), dtype=bool)
        for at in _probes(ids, self.bits):
            out &= (self.bytes[part, at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def bloom(left: DataFrame) -> Filter | None:
    """The filter of a (written) table of survivors; None if there are none. The driver gets its segments: MOST_BITS at
    most, or eight bytes a partition where that is more."""
    n, parts = left.agg(F.sum("n"), F.max("parts")).first()
    if not n:
        return None
    bits = max(64, min(BITS * n, MOST_BITS) // parts // 8 * 8)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ids in batch.column(1).to_pylist():
                on = np.zeros(bits, dtype=bool)
                for at in _probes(np.frombuffer(ids, dtype="<u8"), bits):
                    on[at] = True
                out.append(np.packbits(on, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["part", "bits"])

    rows = common.map_arrow(left.select("part", "ids"), segments, "part int, bits binary").collect()
    return Filter({r["part"]: r["bits"] for r in rows}, parts, bits)


def _phrases(found: list[Level], n: int, at: np.ndarray, names: list[str], words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Languages and texts of the n-grams at `at` of the n-th level."""
    last = []
    for level in reversed(found[:n]):
        last.append(words.take(pa.array(level.last[at])))
        at = level.before[at]
    text = last[0] if n == 1 else pc.binary_join_element_wise(*reversed(last), pa.scalar(" ", pa.string()))
    return pa.array(names, pa.string()).take(pa.array(at)), text


def counts(docs: DataFrame, known: Filter | None, longest: int = LONGEST, threshold: int = THRESHOLD) -> DataFrame:
    """(lang, phrase, words, f): exact counts of all words, and of the n-grams that occur threshold times."""
    texts = _texts(docs)
    sent = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = sent.value
        for batch in batches:
            for names, found, place, words in _chunks(batch, longest):
                starts, ends = words.starts[place].tolist(), words.ends[place].tolist()
                own = pa.array([words.data[a:b].tobytes().replace(b"\xff", b"\0") for a, b in zip(starts, ends, strict=True)], pa.binary()).cast(pa.string())
                for n, level in enumerate(found, 1):
                    at = np.arange(len(level.ids)) if n == 1 else np.flatnonzero(passes.holds(level.ids)) if passes else np.zeros(0, dtype=np.int64)
                    if len(at):
                        lang, text = _phrases(found, n, at, names, own)
                        yield pa.RecordBatch.from_arrays([lang, text, pa.array(np.full(len(at), n), pa.int32()), pa.array(level.counts[at], pa.int64())], ["lang", "phrase", "words", "f"])

    rows = common.map_arrow(texts, run, "lang string, phrase string, words int, f long")
    return rows.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).filter((F.col("words") == 1) | (F.col("f") >= threshold))


def scored(table: DataFrame, longest: int = LONGEST, threshold: int = THRESHOLD) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of all candidates of a table of counts: of the cuts in two that with the
    least score floor(SCALE * a * a / (l * r)), ties by the shortest first part. Whole-number decimals, so exact."""
    words = F.split("phrase", " ", -1)
    many = table.filter(F.col("words") > 1).select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = many.select("*", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice(words, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"))
    part = table.filter((F.col("f") >= threshold) & (F.col("words") < longest))  # a part occurs as often as the whole at least
    both = cut.join(part.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr(f"(cast(a as decimal(18,0)) * cast(a as decimal(18,0)) * {SCALE}) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    best = both.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    return best.select("lang", "phrase", "words", "a", "x.l", "x.r", "x.score")


def uncovered(found: DataFrame, percent: int = COVERED_PERCENT) -> DataFrame:
    """Candidates without those that stand inside a longer candidate which has at least `percent` of their occurrences.
    Longer ones name what they hold, so this is an equi-join."""
    words = F.split("phrase", " ", -1)
    shorter = found.filter("words > 2").select("lang", F.col("a").alias("b"), "words", words.alias("w"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inside = shorter.select("lang", "b", "size", "w", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    longer = inside.groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase")).agg(F.max("b").alias("b"))
    return found.join(longer, ["lang", "phrase"], "left").filter(F.col("b").isNull() | (F.col("b") * 100 < F.col("a") * percent)).drop("b")


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` of each language by score, then a, both descending, then phrase. Counts of score ranges say first
    which range the last of them is in, so that only rows from there up are sorted."""
    level = F.floor(F.col("score") / 1000)
    sizes = found.groupBy("lang", level.alias("level")).agg(F.count(F.lit(1)).alias("n"))
    above = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1))
    lowest = sizes.withColumn("above", F.coalesce(above, F.lit(0))).filter(F.col("above") < top).groupBy("lang").agg(F.min("level").alias("lowest"))
    upper = found.join(lowest, "lang").filter(level >= F.col("lowest")).drop("lowest")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return upper.withColumn("rank", rank).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, longest: int = LONGEST, threshold: int = THRESHOLD, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of docs(lang, text): the first `top` phrases of each language.

    A null lang is `und`, a null or empty text has no words, repeated rows count again, extra columns are ignored; without
    frequent phrases the result is empty. Phrases do not cross .,;:!? or line ends. A text is one chunk of work."""
    left = common.stash(survivors(docs, longest, threshold), "survivors")
    table = common.stash(counts(docs, bloom(left), longest, threshold), "phrase-counts")
    found = common.stash(scored(table, longest, threshold), "collocations")
    mass = table.filter("words = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    rows = ranked(uncovered(found), top).join(mass, "lang")
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of two and three words in all documents, by language."""
    return collocations(common.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, unnest(regexp_extract_all(text, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, 1 AS size, unnest(w) AS phrase FROM w UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
f AS MATERIALIZED (SELECT lang, phrase, size, count(*) AS f FROM g GROUP BY ALL),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
k AS (SELECT *, unnest(range(1, size)) AS k FROM c),
h AS MATERIALIZED (SELECT lang, phrase, size, w, f AS a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest FROM k),
lf AS MATERIALIZED (SELECT lang, phrase AS first, f AS l FROM f WHERE f >= 10), rf AS MATERIALIZED (SELECT lang, phrase AS rest, f AS r FROM f WHERE f >= 10),
s AS MATERIALIZED (SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM h JOIN lf USING (lang, first) JOIN rf USING (lang, rest)),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
t AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, f FROM c WHERE size = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), f FROM c WHERE size = 3) GROUP BY 1, 2),
u AS (SELECT b.* FROM b LEFT JOIN t USING (lang, phrase) WHERE t.f IS NULL OR 100 * t.f < 50 * b.a),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM u JOIN n USING (lang) QUALIFY rank <= 2000
"""
