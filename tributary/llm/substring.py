"""Removal of long passages that other documents have too, by a compacted sparse De Bruijn graph.

Nodes are token k-mers picked as window minima (so any two copies of a passage pick the same ones inside it); an
edge is the run of words from one picked k-mer to the next. Edges that several documents have are the repeated part
of the graph. Those that follow each other wherever they occur compact into nonbranching paths, named by their place in
the first document that has them; windows of words inside a path are settled by that document alone. Where documents
go along one document's edges from path to path, span for span, their windows are copies of that document's. Only
windows that cross a branch otherwise, and whose sure edges are all repeated, are compared as windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm import common, textvec

WINDOW = 50
_NULL_ID = 2**63 - 1


def parameters(window: int) -> tuple[int, int]:
    """k and the number of k-mers of which the least is picked: every window of words then holds two whole picking
    windows side by side, and so two picked k-mers and the edge between them."""
    pick = max(1, (window - 1) * 2 // 5)
    return window + 1 - 2 * pick, pick


def _slide(a: np.ndarray, width: int, best) -> np.ndarray:
    """best(a[i : i + width]) for each i at which the width fits."""
    done, out = 1, a
    while done * 2 <= width:
        out = best(out[:-done], out[done:])
        done *= 2
    if done < width:
        out = best(out[: len(out) - (width - done)], out[width - done :])
    return out


def picked(h: np.ndarray, rows: np.ndarray, k: int, pick: int) -> np.ndarray:
    """Places of the words at which picked k-mers begin: the least of any `pick` k-mers in a row of one text."""
    n = len(h) - k + 1
    if n < pick:
        return np.zeros(0, dtype=np.int64)
    kh = textvec.window_hashes(h, k)
    least = _slide(kh, pick, np.minimum)
    least[rows[: len(least)] != rows[pick + k - 2 :]] = 0
    padded = np.zeros(len(least) + 2 * (pick - 1), dtype=np.uint64)
    padded[pick - 1 : pick - 1 + len(least)] = least
    return np.flatnonzero((_slide(padded, pick, np.maximum) == kh) & (kh != 0))


def sure_picks(h: np.ndarray, k: int, pick: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of words the places of the first and the last k-mer in it that are picked for what is inside it:
    the leftmost least of its first picking window, the rightmost least of its last. All picks from the one to the
    other are picked in every text that has these words; those beside them may hang on what stands around."""
    kh = textvec.window_hashes(h, k)
    at = np.arange(len(kh))
    left = _slide(at, pick, lambda a, b: np.where(kh[b] < kh[a], b, a))
    right = _slide(at, pick, lambda a, b: np.where(kh[b] <= kh[a], b, a))
    last = window - k + 1 - pick
    return left[: max(0, len(left) - last)], right[last:]


def edges_of(w: textvec.Words, window: int) -> tuple:
    """Hashes, first words, ends (exclusive) and rows of the edges of a chunk, and hashes of its words."""
    k, pick = parameters(window)
    h = w.hashes()
    at = picked(h, w.rows, k, pick)
    pairs = np.flatnonzero(w.rows[at[:-1]] == w.rows[at[1:]]) if len(at) > 1 else np.zeros(0, dtype=np.int64)
    starts, ends = at[pairs], at[pairs + 1] + k if len(at) > 1 else at[pairs]
    with np.errstate(over="ignore"):
        e = textvec.mix(textvec.window_hashes(h, ends - starts, starts) + (ends - starts).astype(np.uint64))
    return e, starts, ends, w.rows[starts], h


def _keyed(docs: DataFrame) -> DataFrame:
    """d (doc_id, or a number beyond all others for null) and th (hash of the text): the key of a row here."""
    rows = common.documents(docs)
    return rows.select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("d"), F.xxhash64("text").alias("th"), "text")


EDGES = "e long, next long, d long, th long, idx int, run int, proof long"


def edge_rows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The edges of every row: e, the edge after it there, the row's key, its number there, run: how often it follows
    itself from there on, and proof: a second hash of its words, made of their bytes anew. So text that repeats a few
    words over and over gives one row, not many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for w in textvec.chunks(batch.column(2), textvec.BLANK_SEPARATED):
                e, starts, ends, rows, _ = edges_of(w, window)
                if not len(e):
                    continue
                e = e.view(np.int64)
                proof = textvec.window_hashes(w.hashes(1), ends - starts, starts, which=2).view(np.int64)
                new = np.append(True, rows[1:] != rows[:-1])
                begin = np.flatnonzero(new)
                idx = np.arange(len(e)) - np.repeat(begin, np.diff(np.append(begin, len(e))))
                at = np.flatnonzero(new | np.append(True, e[1:] != e[:-1]))
                length = np.diff(np.append(at, len(e)))
                e, rows, new = e[at], rows[at], new[at]
                last = np.append(new[1:], True)
                yield pa.RecordBatch.from_arrays([pa.array(e), pa.array(np.append(e[1:], 0), mask=last), pa.array(d[w.lo + rows]), pa.array(th[w.lo + rows]), pa.array(idx[at].astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(proof[at])], [x.split()[0] for x in EDGES.split(", ")])

    return common.map_arrow(_keyed(docs), run, EDGES)


def repeated_edges(edges: DataFrame) -> DataFrame:
    """Occurrences of the edges that two or more documents have. Which these are is counted by sums that are combined
    before they are shuffled; a join, which Spark splits where an edge is in very many documents, finds their rows."""
    repeated = edges.groupBy("e").agg(F.min("d").alias("_lo"), F.max("d").alias("_hi")).filter("_lo <> _hi").select("e")
    return edges.join(repeated, "e")


def paths(repeated: DataFrame) -> DataFrame:
    """The repeated edges (e) with their place in the first document that has them (od, oth, oidx, orun, oproof: its key,
    the edge's number, run and proof there), the number of the first edge of their nonbranching path there (head), and
    plain: whether the edge never follows itself and has one proof wherever it occurs.

    An edge goes on in its path if one and the same edge follows wherever it occurs, and that one occurs as often: so
    neither occurs without the other, and all documents that have one edge of a path have all of it."""
    edges = repeated.groupBy("e").agg(
        F.min(F.struct("d", "th", "idx", "run", "proof")).alias("first"), F.count(F.lit(1)).alias("n"), F.count("next").alias("followed"), F.min("next").alias("lo"), F.max("next").alias("hi"),
        F.max("run").alias("most"), (F.min("proof") == F.max("proof")).alias("proven"),
    )
    plain = ((F.col("most") == 1) & F.col("proven")).alias("plain")
    only = F.when((F.col("n") == F.col("followed")) & (F.col("lo") == F.col("hi")) & (F.col("most") == 1), F.col("lo")).alias("only")
    own = edges.select("e", F.col("first.d").alias("od"), F.col("first.th").alias("oth"), F.col("first.idx").alias("oidx"), F.col("first.run").alias("orun"), F.col("first.proof").alias("oproof"), plain, "n", only)
    w = Window.partitionBy("od", "oth").orderBy("oidx")
    joined = F.col("plain") & (F.lag("only").over(w) == F.col("e")) & (F.lag("n").over(w) == F.col("n"))
    own = own.withColumn("head", F.when(F.coalesce(joined, F.lit(False)), None).otherwise(F.col("oidx")))
    head = F.last("head", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return own.select("e", "od", "oth", "oidx", "orun", "oproof", "plain", head.alias("head"))


def path_spans(repeated: DataFrame) -> DataFrame:
    """Per row key its spans along one path: an array of (first, last: numbers of edges here; reach: the last edge up
    to which the first document goes on alike; od, oth, oidx: where the span is in that document; plain). Edges are
    held against the first document's at these places by their proofs."""
    placed = repeated.select("e", "d", "th", "idx", "run", "proof").join(paths(repeated), "e")
    # What fails the proof at its place in the first document is only like itself; its windows stay open.
    like = F.col("proof") == F.col("oproof")
    placed = placed.withColumns({o: F.when(like, F.col(o)).otherwise(F.col(own)) for o, own in (("od", "d"), ("oth", "th"), ("oidx", "idx"), ("orun", "run"))})
    w = Window.partitionBy("d", "th").orderBy("idx")
    before = lambda c: F.lag(c).over(w)
    goes_on = (before("idx") + before("run") == F.col("idx")) & (before("run") == before("orun")) & (before("oidx") + before("orun") == F.col("oidx"))
    goes_on = goes_on & (before("od") == F.col("od")) & (before("oth") == F.col("oth")) & (before("head") == F.col("head"))
    placed = placed.dropDuplicates(["d", "th", "idx"]).withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    placed = placed.withColumn("span", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = placed.groupBy("d", "th", "span").agg(
        F.min("idx").alias("first"), F.max(F.col("idx") + F.col("run") - 1).alias("last"), F.max(F.col("idx") + F.least("run", "orun") - 1).alias("reach"),
        F.first("od").alias("od"), F.first("oth").alias("oth"), F.min("oidx").alias("oidx"), F.bool_and("plain").alias("plain"),
    )
    return spans.groupBy("d", "th").agg(F.array_sort(F.collect_list(F.struct("first", "last", "reach", "od", "oth", "oidx", "plain"))).alias("spans"))


FOUND = "h1 long, h2 long, d long, th long, start int, end int"


def settle(docs: DataFrame, spans: DataFrame, window: int = WINDOW) -> DataFrame:
    """For rows that have spans: ranges of words that are copies (start, end; no hashes), and the windows that are
    still open (h1 and h2: 128 bits of hash; start; end null).

    Spans that follow each other here as they do in the first document make one range; windows inside it are copies
    of that document's if its id is smaller. Windows inside one plain path need nothing else: whatever has them has
    the path, so its first document is their first. Every other window is open whose edges between sure picks are
    all repeated: it, and its equal in the smallest document, are both in the result, for both have these edges."""
    rows = _keyed(docs).join(spans, ["d", "th"]).select("d", "th", "text", "spans")
    k, pick = parameters(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, th, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()
            for w in textvec.chunks(batch.column(2), textvec.BLANK_SEPARATED):
                _, starts, ends, rows, h = edges_of(w, window)
                begin = np.searchsorted(rows, np.arange(w.hi - w.lo + 1))
                sure = sure_picks(h, k, pick, window)
                open_at, copies = [], []
                for row in range(w.hi - w.lo):
                    lo, n = w.first[row], int(w.first[row + 1] - w.first[row])
                    key = (d[w.lo + row], th[w.lo + row])
                    a, z = (x[begin[row] : begin[row + 1]] - lo for x in (starts, ends))
                    alone = np.ones(len(a), dtype=bool)
                    chains: list = []
                    maybe = np.ones(max(0, n - window + 1), dtype=bool)
                    for s in lists[w.lo + row]:
                        alone[s["first"] : s["last"] + 1] = False
                        start, end = int(a[s["first"]]), int(z[s["reach"]])
                        if s["plain"]:
                            maybe[start : max(start, end - window + 1)] = False
                        c = chains[-1] if chains else None
                        if c and c["od"] == s["od"] and c["oth"] == s["oth"] and c["reach"] + 1 == s["first"] and c["oidx"] + s["first"] - c["first"] == s["oidx"]:
                            c["reach"], c["end"] = s["reach"], end
                        else:
                            chains.append({**s, "start": start, "end": end})
                    for c in chains:
                        if c["od"] < key[0] and c["end"] - c["start"] >= window:
                            maybe[c["start"] : c["end"] - window + 1] = False
                            copies.append((*key, c["start"], c["end"]))
                    found = np.flatnonzero(maybe)
                    if len(found):
                        # Edge i is from pick i of the row to the next; between sure picks all must be repeated.
                        first, last = (np.searchsorted(a, x[lo + found] - lo) for x in sure)
                        count = np.append(0, np.cumsum(alone))
                        found = found[count[last] == count[first]]
                    if len(found):
                        open_at.append((row, found + lo))
                if copies:
                    x, y, s, e = (np.array(c, dtype=np.int64) for c in zip(*copies, strict=True))
                    yield _found(None, None, x, y, s, e)
                if open_at:
                    at = np.concatenate([x for _, x in open_at])
                    row = np.repeat([r for r, _ in open_at], [len(x) for _, x in open_at])
                    h1, h2 = (textvec.window_hashes(x, window, at, which).view(np.int64) for which, x in ((1, h), (2, w.hashes(1))))
                    for i in range(0, len(at), 100_000):
                        some = slice(i, i + 100_000)
                        r = row[some]
                        yield _found(h1[some], h2[some], np.array([d[w.lo + x] for x in r]), np.array([th[w.lo + x] for x in r]), at[some] - w.first[r], None)

    return common.map_arrow(rows, run, FOUND)


def _found(h1, h2, d, th, start, end) -> pa.RecordBatch:
    none = lambda x, kind: pa.nulls(len(d), kind) if x is None else pa.array(x.astype(kind.to_pandas_dtype()))
    columns = [none(h1, pa.int64()), none(h2, pa.int64()), pa.array(d, pa.int64()), pa.array(th, pa.int64()), none(start, pa.int32()), none(end, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in FOUND.split(", ")])


def copied_ranges(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row key (d, th) that has any: ranges, an array of (start, end) in words, that documents of smaller id have."""
    repeated = common.stash(repeated_edges(edge_rows(docs, window)), "repeated-edges")
    found = settle(docs, path_spans(repeated), window)
    least = found.filter("end is null").groupBy("h1", "h2").agg(F.min("d").alias("least"), F.max("d").alias("most")).filter("least <> most").select("h1", "h2", "least")
    windows = found.filter("end is null").join(least, ["h1", "h2"]).filter("least < d").select("d", "th", "start", (F.col("start") + window).alias("end"))
    copies = found.filter("end is not null").select("d", "th", "start", "end").unionByName(windows)
    # A text's ranges are no more than its words.
    return copies.groupBy("d", "th").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("ranges"))


KEPT = "doc_id long, n_words long, n_removed long, text string"


def remove_copies(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, text) with n_words, n_removed and text: the kept words joined by one space.

    Words are runs of anything but ASCII white space. A word goes if it is in a window of `window` words whose
    sequence also begins in a row of smaller doc_id, as the input has it. Rows of one doc_id (repeated rows too) do
    not count against each other; a null doc_id is beyond all others. Null and blank texts have no words and an empty
    text; texts of fewer words than the window stay whole; extra columns are ignored."""
    rows = _keyed(docs).join(copied_ranges(docs, window), ["d", "th"], "left").select("d", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (text or "").encode().split()
                n_words.append(len(words))
                if ranges:
                    gone = np.zeros(len(words) + 1, dtype=np.int32)
                    np.add.at(gone, [r["start"] for r in ranges], 1)
                    np.add.at(gone, [r["end"] for r in ranges], -1)
                    words = [w for w, x in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not x]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            ids = pa.array([None if x == _NULL_ID else x for x in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    return common.map_arrow(rows, run, KEPT)


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """What stays of every document."""
    return remove_copies(common.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, k, array_to_string(w[k : k + 49], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d WHERE len(w) >= 50)),
f AS (SELECT win, min(doc_id) AS least FROM x GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS p FROM x JOIN f USING (win) WHERE least < doc_id),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
o AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM p ANTI JOIN g USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)
"""


def brute_force(docs: list[tuple], window: int = WINDOW) -> list[tuple]:
    """(doc_id, n_words, n_removed, text) with every window of every document in one dictionary; for tests."""
    lists = [(d, (t or "").encode().split()) for d, t in docs]
    first: dict = {}
    for d, words in lists:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, words in lists:
        gone: set = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return out
