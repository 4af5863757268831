"""Benchmark decontamination: word windows of test items, looked up in a hash set while training texts are scanned."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm import common, textvec

WINDOW = 10
#: Bytes of item text in one broadcast set. A larger benchmark is cut into blocks, and the
#: documents are scanned once for each block, so that no set outgrows this bound; an item of more than half of it is cut
#: into pieces that overlap by a window less one word.
BLOCK_BYTES = 16 << 20
_FILTER_BITS = 22


@dataclass
class Sequences:
    """Distinct windows of one length, by hash: hash k has the sequences first[k] to first[k + 1]; a sequence has one
    place (item and word number) at which its words stand, and the numbers of all items that have it."""

    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    at: np.ndarray
    owners_first: np.ndarray
    owners: np.ndarray
    seen: np.ndarray  # bitmap over the top bits of the hashes


@dataclass
class Block:
    """Windows of some items."""

    items: list  # item_id of each item (or piece of one)
    words: list  # words of each item, as bytes
    sequences: dict  # length -> Sequences


def item_words(text: str | None) -> list[bytes]:
    w = next(textvec.chunks(pa.array([text or ""]), textvec.ALNUM_LOWER))
    blob = w.data.tobytes()
    return [blob[a:b] for a, b in zip(w.starts, w.ends, strict=True)]


def build(items: list[tuple], window: int = WINDOW) -> Block:
    """items: (item_id, text). An item shorter than the window is one window; an item without words has none."""
    words, found = [], {}
    for number, (_, text) in enumerate(items):
        w = next(textvec.chunks(pa.array([text or ""]), textvec.ALNUM_LOWER))
        blob = w.data.tobytes()
        words.append([blob[a:b] for a, b in zip(w.starts, w.ends, strict=True)])
        n = min(window, len(w.starts))
        if n:
            h = textvec.window_hashes(w.hashes(), n)
            found.setdefault(n, []).append((h, textvec.window_hashes(w.hashes(), n, which=2), np.full(len(h), number), np.arange(len(h))))
    sequences = {}
    for n, parts in found.items():
        h, other, item, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((item, other, h))
        h, other, item, at = h[order], other[order], item[order], at[order]
        new = np.append(True, (h[1:] != h[:-1]) | (other[1:] != other[:-1]))
        begin = np.flatnonzero(new)
        one = new | np.append(True, item[1:] != item[:-1])  # an item's first place of each sequence
        keys, first = np.unique(h[begin], return_index=True)
        bits = np.zeros(1 << _FILTER_BITS, dtype=bool)
        bits[(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        owners_first = np.append(np.searchsorted(np.flatnonzero(one), begin), one.sum())
        sequences[n] = Sequences(keys, np.append(first, len(begin)), item[begin], at[begin], owners_first, item[one], np.packbits(bits, bitorder="little"))
    return Block([i for i, _ in items], words, sequences)


def scan(w: textvec.Words, block: Block) -> tuple[np.ndarray, dict[int, set]]:
    """Which words of the chunk are hit, and for each row (from w.lo) the numbers of the items found in it. A hit is
    compared word by word with one place of its sequence, however many items have it."""
    hit = np.zeros(len(w.starts) + 1, dtype=np.int64)
    found: dict[int, set] = {}
    h, blob = w.hashes(), w.data.tobytes()
    for n, s in block.sequences.items():
        if len(h) < n:
            continue
        wh = textvec.window_hashes(h, n)
        top = (wh >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)
        may = (s.seen[top >> 3] >> (top & 7).astype(np.uint8)) & 1
        may &= w.rows[: len(wh)] == w.rows[n - 1 :]
        here = np.flatnonzero(may)
        k = np.searchsorted(s.keys, wh[here])
        same = (k < len(s.keys)) & (s.keys[np.minimum(k, len(s.keys) - 1)] == wh[here])
        for i, k in zip(here[same].tolist(), k[same].tolist(), strict=True):
            text = [blob[w.starts[j] : w.ends[j]] for j in range(i, i + n)]
            good = [q for q in range(s.first[k], s.first[k + 1]) if block.words[s.item[q]][s.at[q] : s.at[q] + n] == text]
            if good:
                hit[i] += 1
                hit[i + n] -= 1
                found.setdefault(int(w.rows[i]), set()).update((n, q) for q in good)
    items = {row: {int(x) for n, q in qs for s in (block.sequences[n],) for x in s.owners[s.owners_first[q] : s.owners_first[q + 1]]} for row, qs in found.items()}
    return np.cumsum(hit[:-1]) > 0, items


def cut_items(benchmark: DataFrame, window: int, most: int) -> DataFrame:
    """(item_id, text) with items of more than `most` bytes in pieces; each window of an item is whole in one of them."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(text.encode()) <= most:
                    ids.append(name)
                    texts.append(text)
                    continue
                w = next(textvec.chunks(pa.array([text]), textvec.ALNUM_LOWER))
                lo = 0
                while lo < len(w.starts):
                    hi = max(lo + window, int(np.searchsorted(w.ends, w.starts[lo] + most, "right")))
                    hi = min(hi, len(w.starts))
                    ids.append(name)
                    texts.append(w.raw[w.starts[lo] : w.ends[hi - 1]].tobytes().decode())
                    if hi == len(w.starts):
                        break
                    lo = hi - window + 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["item_id", "text"])

    return common.map_arrow(rows, run, "item_id string, text string")


def blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[Block]:
    """The benchmark in blocks of about block_bytes. Equal rows count once, so a block's size follows from the hash."""
    sized = cut_items(benchmark, window, block_bytes // 2).distinct()
    total = sized.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        yield build([tuple(r) for r in sized.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()], window)


HITS = "_n_words long, _hits array<struct<start:long,end:long,first:long,last:long>>, _items array<string>"
_HITS = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "end", "first", "last")]))


def scanned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of docs with _n_words, _hits (runs of hit words: byte offsets start and end, exclusive, and word
    numbers first and last) and _items (distinct item_ids found, sorted).

    One block of the benchmark is broadcast at a time. With several, each pass is written to the shared folder and the
    next one adds to what it found, so neither the driver nor an executor holds more than a block."""
    out = docs.drop("_n_words", "_hits", "_items")
    at, plain = out.columns.index("text"), len(out.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema) + ", " + HITS

    def passing(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                earlier = [batch.column(i).to_pylist() for i in (plain + 1, plain + 2)] if batch.num_columns > plain else None
                n_words, spans, names = [], [], []
                for w in textvec.chunks(batch.column(at), textvec.ALNUM_LOWER):
                    hit, found = scan(w, shared.value)
                    for row in range(w.hi - w.lo):
                        a, z = w.first[row], w.first[row + 1]
                        mine = {shared.value.items[i] for i in found.get(row, ()) if shared.value.items[i] is not None}
                        if earlier:
                            mine.update(earlier[1][w.lo + row])
                            for r in earlier[0][w.lo + row]:
                                hit[a + r["first"] : a + r["last"] + 1] = True
                        runs = []
                        if hit[a:z].any():
                            edge = np.flatnonzero(np.diff(np.concatenate(([0], hit[a:z].astype(np.int8), [0]))))
                            for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                                runs.append({"start": int(w.starts[a + x] - w.offsets[row]), "end": int(w.ends[a + y - 1] - w.offsets[row]), "first": x, "last": y - 1})
                        n_words.append(int(z - a))
                        spans.append(runs)
                        names.append(sorted(mine))
                more = [pa.array(n_words, pa.int64()), pa.array(spans, _HITS), pa.array(names, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:plain], *more], [*batch.schema.names[:plain], "_n_words", "_hits", "_items"])

        return run

    last = None
    for block in blocks(benchmark, window, block_bytes):
        if last is not None:  # another block follows
            out = common.stash(out, "benchmark-pass")
            last.unpersist()
        last = docs.sparkSession.sparkContext.broadcast(block)
        out = common.map_arrow(out, passing(last), schema)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text, n_words, hit_spans and items of docs(doc_id, text); see scanned.

    Words: A-Z in lower case, runs of ASCII letters and digits and all that is not ASCII. A null text or item has
    no words; items of equal id count once; repeated documents give repeated rows; an empty benchmark hits nothing."""
    found = scanned(common.documents(docs), benchmark, window, block_bytes)
    return found.select("doc_id", "text", F.col("_n_words").alias("n_words"), F.col("_hits").alias("hit_spans"), F.col("_items").alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "spans", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without what they share with the benchmark. mode "spans" cuts the hit words out of the texts
    (and what parts them), "documents" drops every document that has a hit; all columns of docs stay."""
    if mode not in ("spans", "documents"):
        raise ValueError(mode)
    found = scanned(docs, benchmark, window, block_bytes)
    if mode == "documents":
        return found.filter(F.size("_hits") == 0).select(*docs.columns)
    # Hits are in order and apart; what stands between them is kept, by bytes.
    raw = F.col("text").cast("string").cast("binary")
    n = F.size("_hits")
    start = lambda i: F.when(i == 0, 0).otherwise(F.get("_hits", i - 1)["end"])
    end = lambda i: F.when(i < n, F.get("_hits", i)["start"]).otherwise(F.octet_length(raw))
    kept = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(raw, (start(i) + 1).cast("int"), (end(i) - start(i)).cast("int")).cast("string"))
    return found.withColumn("text", F.when(n > 0, F.array_join(kept, "")).otherwise(F.col("text"))).select(*docs.columns)


def op3_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Hit words and items of every document."""
    found = contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"] + 1)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS win FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM (SELECT *, least(10, len(w)) AS n FROM i WHERE len(w) > 0))),
dw AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT DISTINCT doc_id, n, k, item_id FROM dw JOIN iw USING (n, win)),
c AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The same by comparing every window with every other; for tests."""
    lists = [(str(i), item_words(t)) for i, t in items]
    out = []
    for doc_id, text in docs:
        words, hit, names = item_words(text), set(), set()
        for name, w in lists:
            n = min(window, len(w))
            own = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in own:
                    hit.update(range(i, i + n))
                    names.add(name)
        out.append((doc_id, len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out
