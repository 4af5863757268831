"""Spelling variants: words that differ in exactly one code point, found with bit-sliced position indexes.

An index holds, for each (position, letter), the set of vocabulary words that have the letter there, as bits. A query
walks through its letters once; word-parallel recurrences keep the sets of words that agree so far without an error,
and with one replaced, one more or one letter less, whose positions are shifted by one.

The vocabulary is dealt so that words with one difference meet. A word is cut in three parts; one difference leaves two
of them as they are. Words that share the other two letter by letter form a group, for each part and each length of the
shorter word; groups are indexed together in blocks of bounded size, and a group beyond it is dealt in tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import common

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[^A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_TIMES, RATIO, NOISE = 6, 5, 5, 199
#: Words of one index; a group of more words is dealt into tiles of about this size.
BLOCK_WORDS = 1024
#: Words of a block times letters of its longest word, at most (but one word of any length).
BLOCK_LETTERS = 1 << 16


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_times: int = LEAST_TIMES) -> DataFrame:
    """(word, n): words of at least least_letters letters that occur least_times times in docs(doc_id, text).

    Words are runs of Latin letters, A-Z in lower case. Where NOISE divides crc32 of "doc_id:word", one letter is left
    out (the one at crc32 modulo length). A null text has no words; a null doc_id is written as nothing; repeated
    rows count again. One aggregate, combined before it is shuffled."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.split("text", SEPARATORS, -1)).alias("r")).filter(F.length("r") >= least_letters)
    low = runs.withColumn("r", F.translate("r", _UPPER, _LOWER))
    noisy = low.withColumn("h", F.crc32(F.concat("d", F.lit(":"), "r").cast("binary")))
    at = F.pmod(F.col("h"), F.length("r").cast("long")).cast("int")
    word = F.when(F.pmod("h", F.lit(NOISE)) == 0, F.concat(F.substring("r", F.lit(1), at), F.substring("r", at + 2, F.length("r")))).otherwise(F.col("r"))
    words = noisy.select(word.alias("word")).filter(F.length("word") >= least_letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_times)


def _groups(words: DataFrame) -> DataFrame:
    """(key, base, part, word, n): for base (the shorter word's length) the word's own length and one less, and each of
    three parts of it, what the word has before and behind that part."""
    base = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("base")).filter(F.col("base") >= 1)
    rows = base.select("*", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("part"))
    before, behind = F.floor(F.col("part") * F.col("base") / 3).cast("int"), F.floor((F.col("part") + 1) * F.col("base") / 3).cast("int")
    rest = F.substring("word", behind + 1 + F.length("word") - F.col("base"), F.length("word"))
    key = F.concat_ws("|", F.lpad(F.col("base").cast("string"), 10, "0"), "part", F.substring("word", F.lit(1), before), rest)
    return rows.select(key.alias("key"), "base", "part", "word", "n")


def _tiles(words: DataFrame) -> DataFrame:
    """(key, a, b, side, base, part, word, n): groups of several words; a large one is cut into slices by hash, and each
    pair of slices is a tile of its own, so that no group is one task's."""
    rows = _groups(words)
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    dealt = rows.join(sizes, "key").withColumn("slices", F.ceil(F.col("size") / (BLOCK_WORDS // 2)).cast("int"))
    own = dealt.withColumn("own", F.pmod(F.xxhash64("word"), F.col("slices")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    return own.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), F.col("own").alias("side"), "base", "part", "word", "n")


def near_in_block(letters: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(pairs, 2): places q, v of words that differ by exactly one letter. letters: (words, longest), -1 behind a word."""
    count, longest = letters.shape
    width = -(-count // 64)
    full = np.zeros((count + 63) // 64 * 64, dtype=bool)

    def bits(rows: np.ndarray) -> np.ndarray:
        full[:] = False
        full[rows] = True
        return np.packbits(full, bitorder="little").view(np.uint64)

    # has[position][letter]: the set of words; one more letter that no word has, for places behind a word.
    kinds, coded = np.unique(letters, return_inverse=True)
    coded = coded.reshape(letters.shape)
    has = np.zeros((longest + 1, len(kinds), width), dtype=np.uint64)
    for p in range(longest):
        for c in np.unique(coded[:, p]).tolist():
            if kinds[c] >= 0:
                has[p, c] = bits(np.flatnonzero(coded[:, p] == c))
    of_length = {n: bits(np.flatnonzero(lengths == n)) for n in {*lengths.tolist()}}
    none = np.zeros(width, dtype=np.uint64)
    same = np.full((count, width), bits(np.arange(count)), dtype=np.uint64)  # no error so far
    replaced, less, more = np.zeros_like(same), np.zeros_like(same), same.copy()  # one letter replaced; the word has one letter less, or more
    out = []
    for i in range(longest):
        c = coded[:, i]
        here = has[i, c]
        replaced = (replaced & here) | (same & ~here)
        less = (less & has[i - 1, c] if i else less) | same
        same = same & here
        more = (more & has[i + 1, c]) | same
        done = np.flatnonzero(lengths == i + 1)
        if len(done):
            found = (replaced[done] & of_length.get(i + 1, none)) | (less[done] & of_length.get(i, none)) | (more[done] & of_length.get(i + 2, none))
            q, v = np.nonzero(np.unpackbits(found.view(np.uint8), axis=1, bitorder="little")[:, :count])
            out.append(np.stack([done[q], v], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), dtype=np.int64)


def _block_pairs(block: pa.Table) -> np.ndarray:
    """Places q, v of near words in tiles of a block. A pair that several parts bring together counts in one of them
    alone: that of its first difference."""
    words = block.column("word").to_pylist()
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    letters = np.full((len(words), int(lengths.max())), -1, dtype=np.int64)
    for i, w in enumerate(words):
        letters[i, : len(w)] = np.frombuffer(w.encode("utf-32-le"), dtype="<u4")
    pairs = near_in_block(letters, lengths)
    q, v = pairs[:, 0], pairs[:, 1]
    tile = np.cumsum(_starts(block)) if len(block) else np.zeros(0)
    base, part, a, b, side = (block.column(c).to_numpy() for c in ("base", "part", "a", "b", "side"))
    good = (tile[q] == tile[v]) & (np.minimum(lengths[q], lengths[v]) == base[q]) & ((a[q] == b[q]) | (side[q] != side[v]))
    q, v = q[good], v[good]
    first = np.minimum(np.argmax(letters[q] != letters[v], axis=1), base[q] - 1)
    own = part[q] == (first >= base[q] // 3).astype(int) + (first >= 2 * base[q] // 3)
    return np.stack([q[own], v[own]], axis=1)


def _starts(block: pa.Table) -> np.ndarray:
    """Whether a row begins a new tile."""
    new = np.ones(len(block), dtype=np.int64)
    if len(block) > 1:
        key, a, b = (block.column(c).combine_chunks() for c in ("key", "a", "b"))
        codes = key.dictionary_encode().indices.to_numpy()
        new[1:] = (codes[1:] != codes[:-1]) | (np.diff(a.to_numpy()) != 0) | (np.diff(b.to_numpy()) != 0)
    return new


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n): each pair of words(word, n) that differ by one inserted, deleted or replaced code point,
    from both sides, once."""
    rows = _tiles(words)
    rows = rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = longest = 0

        def close() -> Iterator[pa.RecordBatch]:
            block = pa.concat_tables(held).combine_chunks()
            pairs = _block_pairs(block)
            word, n = block.column("word"), block.column("n")
            got = pa.table({"word": word.take(pa.array(pairs[:, 0])), "near": word.take(pa.array(pairs[:, 1])), "near_n": n.take(pa.array(pairs[:, 1]))})
            yield from got.combine_chunks().to_batches()

        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            cuts = [*np.flatnonzero(_starts(table)).tolist(), table.num_rows]
            most = np.fromiter((len(w) for w in table.column("word").to_pylist()), dtype=np.int64, count=table.num_rows)
            for lo, hi in zip(cuts[:-2], cuts[1:-1], strict=True):  # the last tile may go on in the next batch
                long = max(longest, int(most[lo:hi].max()))
                if held and (size + hi - lo > BLOCK_WORDS or (size + hi - lo) * long > BLOCK_LETTERS):
                    yield from close()
                    held, size, longest = [], 0, 0
                    long = int(most[lo:hi].max())
                held.append(table.slice(lo, hi - lo))
                size, longest = size + hi - lo, long
            rest = table.slice(cuts[-2])
        if rest is not None and rest.num_rows:
            held.append(rest)
        if held:
            yield from close()

    return common.map_arrow(rows, run, "word string, near string, near_n long")


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root) of forms(word, form): where following form to form ends, after at most `steps` of them. Each round
    doubles how far a row sees, so there are as many rounds as steps has bits."""
    seen = common.stash(forms.select("word", F.col("form").alias("root")), "forms")
    for _ in range(max(0, steps - 1).bit_length()):
        ahead = seen.select(F.col("word").alias("root"), F.col("root").alias("further"))
        seen = common.stash(seen.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "forms")
    return seen


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """words(word, n) with n_near, form, form_n and root.

    form is the near word with the largest n (ties: the smallest in code-point order), if that is at least ratio times
    the word's own; root is the end of the chain of forms. Without words the result is empty; words and counts are
    taken as they are, words once each."""
    words = common.stash(words.select("word", "n"), "vocabulary")
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near"))).alias("best"))
    good = -F.col("best.m") >= F.col("n") * ratio
    told = common.stash(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.m")).alias("form_n")), "variants")
    most, steps = words.agg(F.max("n"), F.min("n")).first(), 0
    reach = (most[1] or 1) * ratio
    while most[0] and reach <= most[0] and ratio > 1:  # each form has ratio times as many
        reach, steps = reach * ratio, steps + 1
    ends = roots(told.filter("form is not null"), steps)
    return told.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents that is long and frequent enough, with its near words, form and root."""
    words = vocabulary(common.documents(common.table(spark, sf_dir, "documents")))
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")


#: crc32 is a fold over the bytes of a text with a table of 256 values, which is made by its rule first. Near words
#: share what is left when one letter is taken out of both at the same place, or out of the longer one.
ORACLE = r"""
WITH RECURSIVE step(b, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM step WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM step WHERE k = 8),
r AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS m FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents) WHERE length(w) >= 6 GROUP BY 1, 2),
b AS (SELECT *, hex(encode(doc_id || ':' || w)) AS x FROM r),
h AS (SELECT w, m, xor(list_reduce(list_transform(range(1, length(x)::BIGINT, 2), lambda i: ('0x' || x[i:i + 1])::BIGINT), lambda c, v: xor(c >> 8, t[xor(c & 255, v) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM b, tab),
v AS MATERIALIZED (SELECT word, sum(m)::BIGINT AS n FROM (SELECT m, CASE WHEN h % 199 = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word FROM h) WHERE length(word) >= 6 GROUP BY 1 HAVING sum(m) >= 5),
s AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM s a JOIN s b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT s.word, v.word, v.n FROM s JOIN v ON s.rest = v.word UNION SELECT v.word, s.word, s.n FROM s JOIN v ON s.rest = v.word),
f AS MATERIALIZED (SELECT v.word, v.n, count(near) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM v LEFT JOIN p USING (word) GROUP BY 1, 2),
g AS MATERIALIZED (SELECT word, n, n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM f),
c(word, root) AS (SELECT word, word FROM g UNION ALL SELECT c.word, g.form FROM c JOIN g ON c.root = g.word WHERE g.form IS NOT NULL)
SELECT g.word, form, root, n, n_near, form_n FROM g JOIN (SELECT c.word, c.root FROM c JOIN g ON c.root = g.word WHERE g.form IS NULL) USING (word)
"""
