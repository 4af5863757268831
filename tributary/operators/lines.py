"""Line tables and line diffs of many pairs of texts at once."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

MAX_WINDOW = 5000


def select_source(raw: DataFrame, merged: DataFrame, spec: str) -> DataFrame:
    """Rows of `merged` or of `input:<index>`; any other spec is an error."""
    if spec == "merged":
        return merged
    kind, _, index = spec.partition(":")
    if kind != "input" or not index.isdigit():
        raise ValueError(f"no such source: {spec}")
    return raw.filter(F.col("input_index") == int(index))


def lines(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, line_no from 0, line): lines without their end (LF, or CR LF); a last empty line is none."""
    parts = F.split(F.col(text), "\n", -1)
    n = F.size(parts)
    kept = F.when(F.get(parts, n - 1) == "", F.slice(parts, 1, n - 1)).otherwise(parts)
    rows = texts.select(*key, F.posexplode(kept).alias("line_no", "line"))
    return rows.withColumn("line", F.regexp_replace("line", "\r$", ""))


def lossy_text(content) -> Column:
    """Bytes as text; what is not UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(F.col(content).cast("string"))


def source_stats(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    return texts.select(*key, F.octet_length(text).cast("long").alias("n_bytes"), (F.size(F.split(F.col(text), "\n", -1)) - F.when(F.col(text).endswith("\n") | (F.col(text) == ""), 1).otherwise(0)).cast("long").alias("n_lines"))


def line_window(rows: DataFrame, start: int, count: int) -> DataFrame:
    """Lines start .. start + count - 1, counted from 0; count from 1 to MAX_WINDOW."""
    if start < 0 or not 1 <= count <= MAX_WINDOW:
        raise ValueError(f"window {start}, {count}")
    return rows.filter(F.col("line_no").between(start, start + count - 1))


def longest_chain(j: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence."""
    tails, ends, before = [], [], []  # of chains of each length the least end, its place; for each place the one before
    for at, x in enumerate(j):
        n = bisect_left(tails, x)
        before.append(ends[n - 1] if n else -1)
        if n == len(tails):
            tails.append(x)
            ends.append(at)
        else:
            tails[n], ends[n] = x, at
    out, at = [], ends[-1] if ends else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def _masks(b: np.ndarray):
    """For a value the places where b has it, as the bits of a number; made anew each time, but kept for values that b
    has often."""
    order = np.argsort(b, kind="stable")
    values, first = np.unique(b[order], return_index=True)
    ends = np.append(first[1:], len(b))
    where = {v: order[x:y] for v, x, y in zip(values.tolist(), first.tolist(), ends.tolist(), strict=True)}
    often, kept = max(8, int(len(b) ** 0.5)), {}

    def mask(v: int) -> int:
        if v in kept:
            return kept[v]
        at = where.get(v)
        if at is None:
            return 0
        if len(at) == 1:
            return 1 << int(at[0])
        bits = np.zeros(len(b), dtype=np.uint8)
        bits[at] = 1
        out = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        if len(at) >= often:
            kept[v] = out
        return out

    return mask


def _common_lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of a with b[:0], b[:1], ... b: rows of the usual table as bits of
    one number, so that a step of a takes len(b) / 64 machine words."""
    full = (1 << len(b)) - 1
    row, mask = full, _masks(b)
    for v in a.tolist():
        same = row & mask(v)
        if same:
            row = ((row + same) | (row - same)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(b)]
    return np.append(0, np.cumsum(1 - bits.astype(np.int64)))


#: So many pairs of equal lines for each line are chained one by one; more are counted by bits.
PAIRS_A_LINE = 8


def longest_common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b of a longest common subsequence, in order. Memory grows with the lines: where equal lines are
    few, pairs of them are chained; else a is halved, and b is cut where the halves have most in common with its parts."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a1, a2, b1, b2 = work.pop()
        x, y = a[a1:a2], b[b1:b2]
        n = min(len(x), len(y))
        head = int(np.argmin(np.append(x[:n] == y[:n], False)))
        tail = int(np.argmin(np.append((x[len(x) - n + head :] == y[len(y) - n + head :])[::-1], False))) if head < n else 0
        if head:
            found.append((np.arange(a1, a1 + head), np.arange(b1, b1 + head)))
        if tail:
            found.append((np.arange(a2 - tail, a2), np.arange(b2 - tail, b2)))
        a1, a2, b1, b2 = a1 + head, a2 - tail, b1 + head, b2 - tail
        x, y = a[a1:a2], b[b1:b2]
        if not len(x) or not len(y):
            continue
        order = np.argsort(y, kind="stable")
        lo, hi = np.searchsorted(y[order], x, "left"), np.searchsorted(y[order], x, "right")
        pairs = int((hi - lo).sum())
        if pairs <= PAIRS_A_LINE * (len(x) + len(y)) or len(x) == 1:
            i = np.repeat(np.arange(len(x)), hi - lo)
            # Of a line's partners the last comes first, so that a chain takes one of them at most.
            j = order[np.repeat(hi - 1, hi - lo) - (np.arange(pairs) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo))]
            chain = np.array(longest_chain(j.tolist()), dtype=np.int64)
            found.append((a1 + i[chain], b1 + j[chain]))
            continue
        half = len(x) // 2
        cut = int(np.argmax(_common_lengths(x[:half], y) + _common_lengths(x[half:][::-1], y[::-1])[::-1]))
        work += [(a1, a1 + half, b1, b1 + cut), (a1 + half, a2, b1 + cut, b2)]
    i, j = (np.sort(np.concatenate([f[k] for f in found])) if found else np.zeros(0, dtype=np.int64) for k in (0, 1))
    return i, j


def matches(left: DataFrame, right: DataFrame, pair: str = "pair_id") -> DataFrame:
    """(pair, i, j): equal lines in the same order on both sides, as many as there can be.

    Lines that both sides have get a number, by equi-joins; lines that only one side has match nothing. Only numbers are
    brought together, a pair's in one task, which holds those of one pair at a time."""
    firsts = left.groupBy(pair, "line").agg(F.min("line_no").alias("id"))
    known = firsts.join(right.select(pair, "line").distinct(), [pair, "line"])
    side = lambda t, n: t.select(pair, "line", "line_no").join(known, [pair, "line"]).select(pair, F.lit(n).alias("side"), "line_no", "id")
    rows = side(left, 0).unionByName(side(right, 1)).repartition(pair).sortWithinPartitions(pair, "side", "line_no")
    out = StructType([rows.schema[pair], StructField("i", IntegerType()), StructField("j", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def finish() -> Iterator[pa.RecordBatch]:
            own = pa.concat_tables(held).combine_chunks()
            sides, nos, ids = (own.column(c).to_numpy() for c in (1, 2, 3))
            cut = int(np.searchsorted(sides, 1))
            i, j = longest_common(ids[:cut], ids[cut:])
            key = own.column(0).take(pa.array(np.zeros(len(i), dtype=np.int64)))
            yield from pa.table([key, pa.array(nos[:cut][i], pa.int32()), pa.array(nos[cut:][j], pa.int32())], names=out.names).combine_chunks().to_batches()

        last = None
        for b in batches:
            keys = b.column(0).to_pylist()
            cuts = [k for k in range(1, len(keys)) if keys[k] != keys[k - 1]]
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if hi == lo:
                    continue
                if held and keys[lo] != last:
                    yield from finish()
                    held = []
                last = keys[lo]
                held.append(pa.Table.from_batches([b.slice(lo, hi - lo)]))
        if held:
            yield from finish()

    return rows.mapInArrow(run, out)


def opcodes(left: DataFrame, right: DataFrame, pair: str = "pair_id") -> DataFrame:
    """Runs (pair, op_no, tag, i1, i2, j1, j2, row_start) that turn left into right: equal, replace, delete or insert,
    ends exclusive: a shortest script, no other keeps more lines (see matches). A pair is one window partition here, which
    streams through its runs: a very large pair takes time, not memory. row_start is the run's first row in diff_rows."""
    m = matches(left, right, pair)
    count = lambda rows, name: rows.groupBy(pair).agg(F.count(F.lit(1)).alias(name))
    sizes = count(left, "n").join(count(right, "m"), pair, "full_outer").select(pair, F.coalesce("n", F.lit(0)).cast("int").alias("i"), F.coalesce("m", F.lit(0)).cast("int").alias("j"))
    order = Window.partitionBy(pair).orderBy("i", "j")
    points = m.withColumn("last", F.lit(False)).unionByName(sizes.withColumn("last", F.lit(True)))
    points = points.withColumn("pi", F.coalesce(F.lag("i").over(order) + 1, F.lit(0))).withColumn("pj", F.coalesce(F.lag("j").over(order) + 1, F.lit(0)))
    gap = points.filter("i > pi or j > pj").select(pair, F.when(F.col("i") == F.col("pi"), "insert").when(F.col("j") == F.col("pj"), "delete").otherwise("replace").alias("tag"), F.col("pi").alias("i1"), F.col("i").alias("i2"), F.col("pj").alias("j1"), F.col("j").alias("j2"))
    same = points.filter("not last").withColumn("new", F.when((F.col("i") == F.col("pi")) & (F.col("j") == F.col("pj")) & F.lag("i").over(order).isNotNull(), 0).otherwise(1))
    same = same.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = same.groupBy(pair, "run").agg(F.min("i").alias("i1"), (F.max("i") + 1).alias("i2"), F.min("j").alias("j1"), (F.max("j") + 1).alias("j2")).withColumn("tag", F.lit("equal"))
    every = gap.unionByName(runs.select(pair, "tag", "i1", "i2", "j1", "j2"))
    by = Window.partitionBy(pair).orderBy("i1", "j1", "i2", "j2")
    span = F.greatest(F.col("i2") - F.col("i1"), F.col("j2") - F.col("j1"))
    every = every.withColumn("op_no", F.row_number().over(by) - 1)
    return every.withColumn("row_start", F.coalesce(F.sum(span).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))


def diff_rows(ops: DataFrame, left: DataFrame, right: DataFrame, pair: str = "pair_id") -> DataFrame:
    """(pair, row, type, left_no, right_no, left, right): both texts side by side; a run takes as many rows as its
    longer side has lines."""
    span = F.greatest(F.col("i2") - F.col("i1"), F.col("j2") - F.col("j1"))
    rows = ops.withColumn("k", F.explode(F.sequence(F.lit(0), span - 1))).select(
        pair, (F.col("row_start") + F.col("k")).alias("row"), F.col("tag").alias("type"),
        F.when(F.col("i1") + F.col("k") < F.col("i2"), F.col("i1") + F.col("k")).alias("left_no"), F.when(F.col("j1") + F.col("k") < F.col("j2"), F.col("j1") + F.col("k")).alias("right_no"),
    )
    side = lambda t, n: t.select(pair, F.col("line_no").alias(f"{n}_no"), F.col("line").alias(n))
    return rows.join(side(left, "left"), [pair, "left_no"], "left").join(side(right, "right"), [pair, "right_no"], "left").select(pair, "row", "type", "left_no", "right_no", "left", "right")


def diff_window(rows: DataFrame, start: int, count: int) -> DataFrame:
    if start < 0 or not 1 <= count <= MAX_WINDOW:
        raise ValueError(f"window {start}, {count}")
    return rows.filter(F.col("row").between(start, start + count - 1))


def diff_meta(ops: DataFrame, pair: str = "pair_id") -> DataFrame:
    """Rows per tag, in all, and lines of both sides."""
    span = F.greatest(F.col("i2") - F.col("i1"), F.col("j2") - F.col("j1"))
    tag = lambda t: F.coalesce(F.sum(F.when(F.col("tag") == t, span)), F.lit(0)).cast("long").alias(f"n_{t}")
    return ops.groupBy(pair).agg(*[tag(t) for t in ("equal", "replace", "insert", "delete")], F.sum(span).cast("long").alias("n_rows"), F.max("i2").cast("long").alias("left_lines"), F.max("j2").cast("long").alias("right_lines"))


def search_diff(ops: DataFrame, left: DataFrame, right: DataFrame, query: str, case_sensitive: bool = False, limit: int | None = 500, pair: str = "pair_id") -> DataFrame:
    """(pair, row, side, line_no, line) of lines that hold query, the first `limit` of each pair by row and side, or
    all of them for None. An empty query finds nothing."""
    if limit is not None and not 1 <= limit <= MAX_WINDOW:
        raise ValueError(f"limit {limit}")
    found = []
    for side, rows, lo, hi in (("left", left, "i1", "i2"), ("right", right, "j1", "j2")):
        line = F.col("line") if case_sensitive else F.lower("line")
        hits = rows.filter(line.contains(query if case_sensitive else query.lower()) & F.lit(bool(query))).select(pair, "line_no", "line", F.lit(1).alias("_kind"))
        runs = ops.filter(F.col(lo) < F.col(hi)).select(pair, F.col(lo).alias("line_no"), F.lit(0).alias("_kind"), F.struct(F.col(lo).alias("lo"), "row_start").alias("_run"))
        # A hit's run is the last one that begins at or before it: both are merged by line, so no hit meets other runs.
        w = Window.partitionBy(pair).orderBy("line_no", "_kind").rowsBetween(Window.unboundedPreceding, 0)
        placed = hits.unionByName(runs, allowMissingColumns=True).withColumn("_run", F.last("_run", ignorenulls=True).over(w)).filter("_kind = 1")
        found.append(placed.select(pair, (F.col("_run.row_start") + F.col("line_no") - F.col("_run.lo")).alias("row"), F.lit(side).alias("side"), "line_no", "line"))
    every = found[0].unionByName(found[1])
    if limit is None:
        return every
    nth = F.row_number().over(Window.partitionBy(pair).orderBy("row", "side"))
    return every.withColumn("_n", nth).filter(F.col("_n") <= limit).drop("_n")


def changed_line_counts(left: DataFrame, right: DataFrame, pair: str = "pair_id") -> DataFrame:
    """(pair, removed, added): lines that one side has more often than the other, in any order."""
    count = lambda t, n: t.groupBy(pair, F.xxhash64("line").alias("_h"), "line").agg(F.count(F.lit(1)).alias(n))
    both = count(left, "a").join(count(right, "b"), [pair, "_h", "line"], "full_outer").na.fill(0, ["a", "b"])
    return both.groupBy(pair).agg(F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("removed"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("added"))


def diff_entries(left: DataFrame, right: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, left_value, right_value, status) of two field tables; what is equal is left out."""
    a = left.select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("_l"))
    b = right.select(*keys, F.col(value).alias("right_value"), F.lit(True).alias("_r"))
    both = a.join(b, keys, "full_outer").filter(~F.col("left_value").eqNullSafe(F.col("right_value")) | F.col("_l").isNull() | F.col("_r").isNull())
    status = F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "removed").otherwise("changed")
    return both.select(*keys, "left_value", "right_value", status.alias("status"))


def summarize_text_diff(ops: DataFrame, left: DataFrame, right: DataFrame, texts: DataFrame, pair: str = "pair_id", most: int = 8, length: int = 400) -> DataFrame:
    """(pair, n_changed, summary) for every row of texts(pair, left, right), the whole texts.

    summary has the first `most` removed (-) and added (+) lines, those of a run's left side first, and how many more
    there are, cut to `length` letters. Equal texts and texts that differ in line ends alone are said to be so. As in a
    unified diff, lines that then begin with --- or +++ would read as its header and are left out."""
    def side(rows: DataFrame, sign: str, lo: str, hi: str, nth: int) -> DataFrame:
        runs = ops.filter(f"tag <> 'equal' and {lo} < {hi}").select(pair, "op_no", F.explode(F.sequence(F.col(lo), F.col(hi) - 1)).alias("line_no"))
        return runs.join(rows.select(pair, "line_no", "line"), [pair, "line_no"]).select(pair, F.struct("op_no", F.lit(nth).alias("side"), "line_no").alias("at"), F.concat(F.lit(sign), "line").alias("line"))

    changed = side(left, "-", "i1", "i2", 0).unionByName(side(right, "+", "j1", "j2", 1)).filter(~F.col("line").rlike(r"^(---|\+\+\+)"))
    counted = changed.withColumn("nth", F.row_number().over(Window.partitionBy(pair).orderBy("at")))
    first = F.array_sort(F.collect_list(F.when(F.col("nth") <= most, F.struct("nth", "line"))))
    told = counted.groupBy(pair).agg(F.count(F.lit(1)).alias("n"), first.alias("first"))
    more = F.when(F.col("n") > most, F.concat(F.lit("\n… ("), (F.col("n") - most).cast("string"), F.lit(" more changed lines)"))).otherwise("")
    shown = F.concat(F.array_join(F.transform("first", lambda x: x["line"]), "\n"), more)
    cut = F.when(F.length(shown) > length, F.concat(F.substring(shown, 1, length - 1), F.lit("…"))).otherwise(shown)
    out = texts.select(pair, F.col("left").eqNullSafe(F.col("right")).alias("same")).join(told, pair, "left")
    summary = F.when(F.col("same"), "(no textual change)").when(F.col("n").isNull(), "Document updated").otherwise(cut)
    return out.select(pair, F.coalesce("n", F.lit(0)).cast("long").alias("n_changed"), summary.alias("summary"))
