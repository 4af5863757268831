"""Quality by importance resampling: each text weighs as much more as a hashed n-gram model of the target texts finds
it likelier than one of all texts; a sample without replacement is the top k of the weights plus Gumbel noise."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm import common, textvec

BUCKETS = 10_000
SMOOTHING = 1.0
#: Share of all texts that a sample has by default: about that of good texts among labelled ones.
KEEP_SHARE = 0.8
#: Target texts that the target model is fitted on, about at most: those of the smallest hashes of their ids. Their ids
#: are broadcast, so texts are not shuffled; the model of raw text is of all texts.
TARGET_ROWS = 20_000
SEED = 1729
#: Values among which the driver finds the k-th by itself, and steps in which a task counts those of more.
_SEEN, _STEPS = 50_000, 4096


def bucket_numbers(w: textvec.Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and pairs of words next to each other, and the row of each."""
    h = w.hashes()
    pairs = np.flatnonzero(w.rows[:-1] == w.rows[1:]) if len(h) > 1 else np.zeros(0, dtype=np.int64)
    both = np.concatenate((h, textvec.window_hashes(h, 2, pairs)))
    return (both % np.uint64(BUCKETS)).astype(np.int64), np.concatenate((w.rows, w.rows[pairs]))


def counts(docs: DataFrame, target: DataFrame, target_rows: int = TARGET_ROWS) -> np.ndarray:
    """(2, BUCKETS): n-grams of all docs, and of about target_rows at most of those in target(doc_id). Each task sums
    into its own BUCKETS counters, so what is shuffled is that many rows a task at most, whatever the texts."""
    ids = target.select(F.col("doc_id").cast("long").alias("_t")).filter("_t is not null").distinct()
    part = min(1.0, target_rows / max(1, ids.count()))
    some = ids.filter(F.pmod(F.xxhash64("_t"), F.lit(1_000_000)) < int(np.ceil(1_000_000 * part))).limit(2 * target_rows)
    marked = docs.join(F.broadcast(some), F.col("doc_id") == F.col("_t"), "left").select("text", F.col("_t").isNotNull().alias("is_target"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            wanted = batch.column(1).to_numpy(zero_copy_only=False)
            for w in textvec.chunks(batch.column(0), textvec.ALNUM_LOWER):
                b, rows = bucket_numbers(w)
                total[0] += np.bincount(b, minlength=BUCKETS)
                total[1] += np.bincount(b[wanted[w.lo + rows]], minlength=BUCKETS)
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0][some]), pa.array(total[1][some])], ["bucket", "raw", "target"])

    sums = common.map_arrow(marked, run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target"))
    out = np.zeros((2, BUCKETS))
    for b, raw, hit in sums.collect():  # BUCKETS rows at most
        out[:, b] = raw, hit
    return out


def weights(docs: DataFrame, target: DataFrame) -> DataFrame:
    """All columns of docs plus log_weight: the log-likelihood ratio of target to raw text, summed over the n-grams.
    Null texts and those without words have 0; so has every text if target names none of the docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    raw, hit = counts(rows, target)
    share = lambda c: np.log((c + SMOOTHING) / (c.sum() + SMOOTHING * BUCKETS))
    shared = docs.sparkSession.sparkContext.broadcast(share(hit) - share(raw) if hit.sum() else np.zeros(BUCKETS))
    kept = docs.drop("log_weight")
    at = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for w in textvec.chunks(batch.column(at), textvec.ALNUM_LOWER):
                b, rows = bucket_numbers(w)
                out[w.lo : w.hi] = np.bincount(rows, shared.value[b], w.hi - w.lo)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "log_weight"])

    return common.map_arrow(kept, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", log_weight double")


def kth(rows: DataFrame, value: Column, k: int) -> tuple:
    """The k-th smallest of a number (double or long, not null) over rows, how many are smaller, and how many equal.

    Values are counted in steps of equal width, then those of the step that has the k-th in narrower ones, until a step
    has no more than the driver may see or one value only: so neither a task nor the driver ever orders them all."""
    rows = rows.select(value.alias("v"))
    low, high = rows.agg(F.min("v"), F.max("v")).first()
    below = 0
    while low != high:
        width = float(high - low) / _STEPS
        way = (F.col("v").cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")).cast("double") if isinstance(low, int) else F.col("v") - F.lit(low)
        inside = rows.filter((F.col("v") >= low) & (F.col("v") <= high))
        steps = inside.groupBy(F.least(F.lit(_STEPS - 1), F.floor(way / width)).cast("int").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        for step in sorted(steps, key=lambda r: r["s"]):
            if below + step["n"] >= k:
                low, high, n = step["lo"], step["hi"], step["n"]
                break
            below += step["n"]
        if low != high and n <= _SEEN:
            seen = sorted(r[0] for r in rows.filter((F.col("v") >= low) & (F.col("v") <= high)).collect())
            v = seen[k - below - 1]
            return v, below + seen.index(v), seen.count(v)
    return low, below, rows.filter(F.col("v") == F.lit(low)).count()


def gumbel_top_k(rows: DataFrame, k: int | None = None, share: float = KEEP_SHARE, temperature: float = 1.0, seed: int = SEED) -> DataFrame:
    """rows(doc_id, log_weight, ...) plus score (log_weight / temperature plus Gumbel noise) and selected: the k
    highest scores (or `share` of all rows), exactly; ties go to the smaller doc_id (null last), then to the smaller
    hash of the row, and among rows that are the same in all to any.

    The noise is a hash of the row and the seed, so a task that runs again draws the same. What parts the selected from
    the others is found by counts (see kth): no task ranks rows, however many have one score."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "log_weight"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    scored = rows.withColumn("score", F.col("log_weight") / temperature - F.log(-F.log(u)))
    scored = common.stash(scored, "gumbel-scores")
    n = scored.count()
    k = min(n, round(n * share) if k is None else k)
    if not k:
        return scored.withColumn("selected", F.lit(False))
    # The last two tell apart rows that are the same in all columns.
    keys = [-F.col("score"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), F.xxhash64(*rows.columns), F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index")]
    chosen, tied, need, pool = F.lit(False), F.lit(True), k, scored
    for key in keys:
        v, below, equal = kth(pool, key, need)
        chosen, need = chosen | (tied & (key < v)), need - below
        tied = tied & (key == v)
        if equal == need:
            break
        pool = pool.filter(key == v)
    return scored.withColumn("selected", chosen | tied)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Weight, score and draw of every document; the target is what the labels call good and not toxic."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").filter("quality = 1 and coalesce(toxic, 0) = 0")
    weighed = weights(docs, labels).select("doc_id", "log_weight")
    return gumbel_top_k(weighed)
