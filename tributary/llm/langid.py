"""Language identification: a linear-chain conditional random field labels the words of code-switched text.

A word's score for each language is a sum of learned weights of hashed features: itself (lexicon), its prefixes and
suffixes (affixes), and the byte n-grams in it. Transitions between languages are learned too. Forward-backward gives
each word's marginals; a text's language is the one with the largest share of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm import common, textvec

#: Labelled texts that the model is fitted on, about: an equal number of each language, those of the smallest hashes.
FIT_ROWS = 1000
#: Of each language at least about so many, or all it has; with more than FIT_ROWS / LEAST_ROWS languages the sample is larger.
LEAST_ROWS = 25
_HASHES = 1 << 40
BUCKETS = 1 << 16
ROUNDS, RATE = 14, 0.2
UNKNOWN = "und"
WORDS = textvec.byte_table(lambda b: 97 <= b <= 122 or b >= 128, lower=True)
_GRAMS, _AFFIXES = (1, 2, 3), (2, 3)


@dataclass
class Model:
    langs: list[str]
    grams: np.ndarray  # (3 * BUCKETS, languages): weights of n-grams in words
    whole: np.ndarray  # (5 * BUCKETS, languages): weights of whole words, two prefixes and two suffixes
    moves: np.ndarray  # (languages, languages): log weights of transitions
    start: np.ndarray


def gram_ids(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(3, bytes): buckets of the 1- to 3-grams that begin at each byte; what is beyond a word's end (ends, exclusive)
    counts as 0."""
    n = len(data)
    pad = np.zeros(n + 2, dtype=np.uint32)
    pad[:n] = data
    last = np.zeros(n + 1, dtype=bool)
    last[ends - 1] = True
    a, b = pad[:n], np.where(last[:n], 0, pad[1 : n + 1]).astype(np.uint32)
    c = np.where((b == 0) | last[1:], 0, pad[2:]).astype(np.uint32)
    out = np.empty((3, n), dtype=np.int32)
    for k, x in enumerate((a, a * np.uint32(257) + b + np.uint32(1), (a * np.uint32(257) + b) * np.uint32(263) + c + np.uint32(7))):
        out[k] = ((x * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int32) + k * BUCKETS
    return out


def word_ids(w: textvec.Words) -> np.ndarray:
    """(5, words): buckets of each word itself, its 2- and 3-byte prefixes and suffixes."""
    out = np.empty((5, len(w.starts)), dtype=np.int32)
    spans = [(w.starts, w.ends)]
    for n in _AFFIXES:
        spans += [(w.starts, np.minimum(w.ends, w.starts + n)), (np.maximum(w.starts, w.ends - n), w.ends)]
    for k, (a, b) in enumerate(spans):
        out[k] = (textvec.span_hashes(w.data, a, b) >> np.uint64(48)).astype(np.int32) + k * BUCKETS
    return out


#: Bytes of text whose n-grams are looked up at once.
_SLICE_BYTES = 1 << 18


def emissions(w: textvec.Words, model: Model) -> np.ndarray:
    """(words, languages): each word's score."""
    n = len(model.langs)
    score = np.zeros((len(w.starts), n), dtype=np.float32)
    if not len(w.starts):
        return score
    for ids in word_ids(w):
        score += model.whole[ids]
    cut = [0, *(np.flatnonzero(np.diff(w.starts // _SLICE_BYTES)) + 1).tolist(), len(w.starts)]
    for lo, hi in zip(cut, cut[1:], strict=False):
        begin = w.starts[lo]
        data = w.data[begin : w.ends[hi - 1]]
        at = gram_ids(data, w.ends[lo:hi] - begin)
        total = model.grams[at[0]]
        total += model.grams[at[1]]
        total += model.grams[at[2]]
        total[data == 0] = 0
        score[lo:hi] += np.add.reduceat(total, w.starts[lo:hi] - begin, axis=0)
    return score


def forward_backward(scores: np.ndarray, first: np.ndarray, moves: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Marginals of all words of all rows (row r has words first[r] to first[r + 1]); rows go side by side, the long
    ones first, word by word. With pairs also the expected counts of transitions and of starts."""
    m = len(start)
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = first[:-1][order], sizes[order]
    e = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
    step = np.exp(moves - moves.max()).astype(np.float32)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    longest = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(longest), side="left")  # rows with more than t words
    now = None
    for t in range(longest):
        at = begin[: live[t]] + t
        now = e[at] * (np.exp(start - start.max()).astype(np.float32) if t == 0 else now[: live[t]] @ step)
        now /= now.sum(axis=1, keepdims=True)
        alpha[at] = now
    after = np.zeros((0, m), dtype=np.float32)
    for t in range(longest - 1, 0, -1):
        at = begin[: live[t]] + t
        b = np.ones((live[t], m), dtype=np.float32)
        b[: len(after)] = after
        after = (e[at] * b) @ step.T
        after /= after.sum(axis=1, keepdims=True)
        beta[at - 1] = after
    gamma = alpha * beta
    gamma /= np.maximum(gamma.sum(axis=1, keepdims=True), 1e-30)
    if not pairs:
        return gamma
    second = np.ones(len(e), dtype=bool)
    second[first[:-1][np.diff(first) > 0]] = False
    second = np.flatnonzero(second)
    before, here = alpha[second - 1], e[second] * beta[second]
    before /= np.maximum(((before @ step) * here).sum(axis=1, keepdims=True), 1e-30)
    return gamma, step * (before.T @ here), gamma[first[:-1][np.diff(first) > 0]].sum(axis=0)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


@dataclass
class Part:
    """Some training texts: bucket numbers of their features, and the sequences made of their words."""

    words: np.ndarray  # (5, words)
    grams: np.ndarray  # (3, bytes in words)
    starts: np.ndarray  # for each word its first place in grams
    order: np.ndarray  # words in the order of the sequences
    cut: np.ndarray  # where sequences begin in order, and its end
    labels: np.ndarray  # for each place in order

    def scores(self, model: Model) -> np.ndarray:
        total = model.grams[self.grams[0]] + model.grams[self.grams[1]] + model.grams[self.grams[2]]
        out = np.add.reduceat(total, self.starts, axis=0)
        for ids in self.words:
            out += model.whole[ids]
        return out


def _part(texts: list[str], labels: list[int], rng: np.random.Generator) -> Part | None:
    joined = "\n".join(texts)
    raw = np.frombuffer(joined.encode(), dtype=np.uint8)
    w = textvec.split(raw, np.array([0, len(raw)]), WORDS, 0, 1)
    if not len(w.starts):
        return None
    text_of = np.searchsorted(np.cumsum([0] + [len(t.encode()) + 1 for t in texts]), w.starts, "right") - 1
    spans = []
    for a, b in zip(*(np.searchsorted(text_of, np.arange(len(texts)), side) for side in ("left", "right")), strict=True):
        while a < b:
            z = min(b, a + int(rng.integers(5, 41)))
            spans.append((a, z))
            a = z
    rng.shuffle(spans)
    order = np.concatenate([np.arange(a, b) for a, b in spans])
    lengths = np.array([b - a for a, b in spans])
    cut = np.append(0, np.cumsum(np.add.reduceat(lengths, np.arange(0, len(lengths), 4))))
    inside = np.flatnonzero(w.data != 0)
    return Part(word_ids(w), gram_ids(w.data, w.ends)[:, inside], np.searchsorted(inside, w.starts), order, cut, np.array(labels)[text_of][order])


def fit(texts: list[str], langs: list[str], rounds: int = ROUNDS, seed: int = 11, part_chars: int = 1 << 18) -> Model:
    """Fit on labelled texts. Sequences are spans of 5 to 40 words of texts of any languages set side by side, so
    that changes of language are seen; all words of a text count as words of its language. Texts are taken in parts of
    about part_chars (or one text), which bounds the memory that a round needs."""
    names = sorted(set(langs))
    n, rng = len(names), np.random.default_rng(seed)
    model = Model(names, np.zeros((3 * BUCKETS, n), np.float32), np.zeros((5 * BUCKETS, n), np.float32), np.zeros((n, n), np.float32), np.zeros(n, np.float32))
    shuffled, parts, some, size = rng.permutation(len(texts)), [], [], 0
    for k, i in enumerate(shuffled):
        some.append(i)
        size += len(texts[i])
        if size >= part_chars or k == len(texts) - 1:
            parts.append(_part([texts[j] for j in some], [names.index(langs[j]) for j in some], rng))
            some, size = [], 0
    parts = [p for p in parts if p]
    if not parts:
        return model
    weights = [model.grams, model.whole, model.moves, model.start]
    square, mean = [np.zeros_like(x) for x in weights], [np.zeros_like(x) for x in weights]
    total = sum(len(p.order) for p in parts)
    for r in range(1, rounds + 1):
        slopes = [np.zeros_like(x) for x in weights]
        for p in parts:
            gamma, moved, started = forward_backward(p.scores(model)[p.order], p.cut, model.moves, model.start, pairs=True)
            truth = np.eye(n, dtype=np.float32)[p.labels]
            first = np.zeros(len(p.order), dtype=bool)
            first[p.cut[:-1]] = True
            later = np.flatnonzero(~first)
            seen = np.zeros((n, n), dtype=np.float32)
            np.add.at(seen, (p.labels[later - 1], p.labels[later]), 1)
            slopes[2] += seen - moved
            slopes[3] += truth[first].sum(axis=0) - started
            slope = np.empty((len(p.order), n))
            slope[p.order] = truth - gamma  # in the order of the texts
            spread = np.repeat(slope, np.diff(np.append(p.starts, p.grams.shape[1])), axis=0)
            for k in range(n):
                for ids in p.words:
                    slopes[1][:, k] += np.bincount(ids, slope[:, k], len(model.whole)).astype(np.float32)
                for ids in p.grams:
                    slopes[0][:, k] += np.bincount(ids, spread[:, k], len(model.grams)).astype(np.float32)
        for x, g, m, v in zip(weights, slopes, mean, square, strict=True):
            g /= total**0.5
            g -= 1e-3 * x
            m += 0.3 * (g - m)
            v += 0.05 * (g * g - v)
            x += RATE * (m / (1 - 0.7**r)) / (np.sqrt(v / (1 - 0.95**r)) + 1e-3)
    return model


def train(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on about fit_rows different texts with a lang that aren't held out, about as many of each language, picked by
    a hash of text and lang. Every language of such a text is in the sample, however rare it is."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    rows = rows.select("text", F.col("lang").cast("string").alias("lang")).withColumn("_h", F.pmod(F.xxhash64("text", "lang"), F.lit(_HASHES)))
    langs = rows.groupBy("lang").agg(F.approx_count_distinct("_h").alias("n"), F.min("_h").alias("least")).collect()
    each = max(LEAST_ROWS, fit_rows // max(1, len(langs)))
    if not langs:
        return fit([], [])
    below = F.create_map(*[F.lit(x) for r in langs for x in (r["lang"], max(r["least"] + 1, _HASHES if r["n"] <= each else _HASHES * each // r["n"]))])
    some = rows.filter(F.col("_h") < F.element_at(below, F.col("lang"))).dropDuplicates(["lang", "_h"]).select("text", "lang")
    got = sorted((t, x) for t, x in some.collect())
    return fit([t for t, _ in got], [x for _, x in got])


def predict(texts: pa.Array, model: Model) -> tuple[list[str], list[float]]:
    """Language and score of each text: the largest share of its words' marginals."""
    langs, scores = [], []
    for w in textvec.chunks(texts, WORDS):
        share = np.zeros((w.hi - w.lo, len(model.langs)))
        if len(model.langs):
            gamma = forward_backward(emissions(w, model), w.first, model.moves, model.start)
            some = np.flatnonzero(np.diff(w.first))
            if len(some):
                share[some] = np.add.reduceat(gamma, w.first[some], axis=0) / np.diff(w.first)[some][:, None]
        ascii_letters = np.zeros(w.hi - w.lo, dtype=np.int64)
        np.add.at(ascii_letters, w.rows, w.data[w.starts] < 128)
        for row in range(w.hi - w.lo):
            best = int(share[row].argmax()) if len(model.langs) else -1
            has = ascii_letters[row] > 0 or any(c.isalpha() for c in w.raw[w.offsets[row] : w.offsets[row + 1]].tobytes().decode())
            known = best >= 0 and has
            langs.append(model.langs[best] if known else UNKNOWN)
            scores.append(min(1.0, float(share[row][best])) if known else 0.0)
    return langs, scores


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs plus lang_pred and score (0 to 1). Texts that are null or have no letter are UNKNOWN with
    score 0, as is every text if nothing was learned. Columns of docs with these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score")
    at = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = predict(batch.column(at), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", lang_pred string, score double"
    return common.map_arrow(kept, run, schema)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = common.table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"))
    return identify(rows, train(docs)).select("doc_id", "held_out", "lang_pred", "score")
