"""N-gram Jaccard join by PartEnum signatures: every pair of sets as similar as asked shares signatures."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm import common, components, textvec

SHINGLE = 5
#: Two sets link when DEN * intersection >= NUM * union.
NUM, DEN = 75, 100
BAND_BITS = 8


def band_top(band: int) -> int:
    """Largest set size of a band; sizes of one band and of linked sets differ by a factor of DEN / NUM at most."""
    top = 3
    for _ in range(band):
        top = max(top + 1, top * DEN // NUM)
    return top


#: Up to sets of 10 ** 12 features, more than a text can have.
_TOPS = np.array([band_top(b) for b in range(100)], dtype=np.int64)


def band_parts(band) -> np.ndarray:
    """Parts of the feature domain in a band: about 2.5 features of a set in each, fewer in small sets."""
    top = _TOPS[band]
    return np.where(top <= 24, 4 * top, (2 * top) // 5 + 8)


def band_extra(band) -> np.ndarray:
    """Signatures beyond those that must be had to share one: two linked sets share this many more."""
    return np.where(_TOPS[band] < 28, 0, _TOPS[band] // 28)


def shingle_sets(w: textvec.Words, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows of a chunk, and where each row's begin (one more at the end).
    A row of fewer words has its whole sequence as one shingle; a row without words has none."""
    h = w.hashes()
    counts = np.diff(w.first)
    at = np.arange(len(h))
    keep = np.flatnonzero(w.first[w.rows + 1] - at >= shingle) if len(h) else at
    wh, rows = textvec.window_hashes(h, shingle, keep), w.rows[keep]
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    if len(short):
        wh = np.concatenate((wh, textvec.window_hashes(h, counts[short], w.first[short])))
        rows = np.concatenate((rows, short))
    order = np.lexsort((wh, rows))
    wh, rows = wh[order], rows[order]
    new = np.ones(len(wh), dtype=bool)
    new[1:] = (wh[1:] != wh[:-1]) | (rows[1:] != rows[:-1])
    wh, rows = wh[new], rows[new]
    return wh, np.searchsorted(rows, np.arange(len(counts) + 1))


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 of values between starts (the last runs to the end); no segment is empty."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values, out=total[1:])
        return total[np.append(starts[1:], len(values))] - total[starts]


def fingerprints(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each row's set; 0 for the empty set."""
    total = np.zeros(len(sets) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(textvec.mix(sets ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
        f = textvec.mix(total[first[1:]] - total[first[:-1]] + np.uint64(1))
    return np.where(np.diff(first) > 0, np.where(f == 0, np.uint64(1), f), np.uint64(0))


def signatures(sets: np.ndarray, first: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, fingerprint) rows of all sets.

    In a band, the domain is split into parts by a hash, and a set's features in a part are its projection there.
    Linked sets a and b differ in H <= (|a| + |b|)/7 features, so in all but H parts their projections are equal.
    Each set ranks its parts by projection (more features first: they are the rarest), and takes the first
    H + 1 + extra. A part where both agree is ranked behind no more than H others in either list, so both take
    1 + extra of the same. Empty projections come last and are hardly ever taken. A set takes signatures in its own
    band and, as the smaller of a pair, in the next one."""
    sizes = np.diff(first)
    live = np.flatnonzero(sizes > 0)
    out_sig, out_f = [], []
    if not len(live):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    own = np.searchsorted(_TOPS, sizes)
    for step in (0, 1):
        band = own + step
        most = np.minimum(_TOPS[band], sizes * DEN // NUM)  # size of the largest partner
        use = (sizes > 0) & ((step == 0) | (most > _TOPS[own]))
        differ = (DEN - NUM) * (sizes + most) // (DEN + NUM)
        take = differ + 1 + band_extra(band)
        rows = np.flatnonzero(use)
        if not len(rows):
            continue
        row_of = np.repeat(np.arange(len(sizes)), sizes)
        here = use[row_of]
        s, r = sets[here], row_of[here]
        b = band[r]
        parts = band_parts(b)
        with np.errstate(over="ignore"):
            spread = textvec.mix(s + b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        part = ((spread >> np.uint64(33)) % parts.astype(np.uint64)).astype(np.int64)
        key = r * (1 << 33) + part
        order = np.argsort(key, kind="stable")
        key, spread = key[order], spread[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.diff(np.append(starts, len(key)))
        r, part = key[starts] >> 33, key[starts] & ((1 << 33) - 1)
        with np.errstate(over="ignore"):
            sig = textvec.mix(segment_sums(spread, starts) + part.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        order = np.lexsort((sig, -count, r))
        r, sig = r[order], sig[order]
        begin = np.searchsorted(r, np.arange(len(sizes) + 1))
        rank = np.arange(len(r)) - begin[r]
        good = rank < take[r]
        mask = np.uint64((1 << BAND_BITS) - 1)
        out_sig.append((sig[good] & ~mask) | band[r[good]].astype(np.uint64))
        out_f.append(f[r[good]])
        # Too few projections that aren't empty: the first empty parts serve as well.
        for row in rows[(begin[rows + 1] - begin[rows]) < take[rows]].tolist():
            full = {int(p) for p in np.unique(_parts_of(sets[first[row] : first[row + 1]], int(band[row])))}
            empty = [p for p in range(int(band_parts(band[row]))) if p not in full][: int(take[row] - (begin[row + 1] - begin[row]))]
            e = textvec.mix(np.array(empty, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(77))
            out_sig.append((e & ~mask) | np.uint64(band[row]))
            out_f.append(np.full(len(empty), f[row]))
    return np.concatenate(out_sig), np.concatenate(out_f)


def _parts_of(s: np.ndarray, band: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        spread = textvec.mix(s + np.uint64(band) * np.uint64(0x9E3779B97F4A7C15))
    return (spread >> np.uint64(33)) % np.uint64(band_parts(band))


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def identities(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles and f (fingerprint of the set) of every row."""
    rows = common.documents(docs).withColumn("th", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, fs = [], []
            for w in textvec.chunks(batch.column(1), textvec.BLANK_SEPARATED_LOWER):
                sets, first = shingle_sets(w, shingle)
                n.append(np.diff(first))
                fs.append(fingerprints(sets, first))
            if n:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.concatenate(n).astype(np.int64)), _long(np.concatenate(fs))], ["doc_id", "th", "n_shingles", "f"])

    return common.map_arrow(rows, run, "doc_id long, th long, n_shingles long, f long")


def signature_rows(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(sig, f) of every row; equal sets of a batch give their rows once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set = set()
            for w in textvec.chunks(batch.column(0), textvec.BLANK_SEPARATED_LOWER):
                sets, first = shingle_sets(w, shingle)
                f = fingerprints(sets, first)
                new = np.zeros(len(f), dtype=bool)
                for i, x in enumerate(f.tolist()):
                    if x and x not in seen:
                        seen.add(x)
                        new[i] = True
                sizes = np.where(new, np.diff(first), 0)
                sets = sets[np.repeat(new, np.diff(first))]
                sig, owner = signatures(sets, np.append(0, np.cumsum(sizes)), f)
                for at in range(0, len(sig), 100_000):
                    yield pa.RecordBatch.from_arrays([_long(sig[at : at + 100_000]), _long(owner[at : at + 100_000])], ["sig", "f"])

    return common.map_arrow(docs.select(F.col("text").cast("string").alias("text")), run, "sig long, f long")


def shared_buckets(rows: DataFrame) -> DataFrame:
    """The distinct (sig, f) rows whose sig has two or more fs: a stream over sorted rows that holds one row back,
    so a bucket of any size takes constant memory."""
    dealt = rows.repartition("sig").sortWithinPartitions("sig", "f")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_s = held_f = np.zeros(0, dtype=np.int64)
        held_has = False  # the held row has an earlier one in its bucket
        for b in batches:
            s, f = np.concatenate((held_s, b.column(0).to_numpy())), np.concatenate((held_f, b.column(1).to_numpy()))
            new = np.ones(len(s), dtype=bool)
            new[1:] = (s[1:] != s[:-1]) | (f[1:] != f[:-1])
            s, f = s[new], f[new]
            if not len(s):
                continue
            same = s[1:] == s[:-1]
            before = np.append(held_has if len(held_s) else False, same)
            good = before[:-1] | same
            held_s, held_f, held_has = s[-1:], f[-1:], bool(before[-1])
            if good.any():
                yield pa.RecordBatch.from_arrays([pa.array(s[:-1][good]), pa.array(f[:-1][good])], ["sig", "f"])
        if len(held_s) and held_has:
            yield pa.RecordBatch.from_arrays([pa.array(held_s), pa.array(held_f)], ["sig", "f"])

    return dealt.mapInArrow(run, "sig long, f long")


def _needed(band: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(band_extra(b)) + 1) for b in range(len(_TOPS))]), band + 1)


def sets_of(docs: DataFrame, ids: DataFrame, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(f, shingles array<long>) of the fingerprints in wanted(f); the text of one document stands for each."""
    chosen = ids.join(wanted, "f", "left_semi").groupBy("f").agg(F.min(F.struct("doc_id", "th")).alias("x")).select(F.col("x.doc_id").alias("_d"), F.col("x.th").alias("_th"))
    rows = common.documents(docs).withColumn("th", F.xxhash64("text"))
    rows = rows.join(chosen, rows["th"].eqNullSafe(F.col("_th")) & rows["doc_id"].eqNullSafe(F.col("_d"))).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in textvec.chunks(batch.column(0), textvec.BLANK_SEPARATED_LOWER):
                sets, first = shingle_sets(w, shingle)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), _long(sets))
                yield pa.RecordBatch.from_arrays([_long(fingerprints(sets, first)), lists], ["f", "shingles"])

    return common.map_arrow(rows, run, "f long, shingles array<long>").dropDuplicates(["f"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b) with shared (features in both), n_a and n_b."""
    left, right = sets.select(F.col("f").alias("a"), F.col("shingles").alias("_a")), sets.select(F.col("f").alias("b"), F.col("shingles").alias("_b"))
    joined = pairs.join(right, "b").join(left, "a")
    return joined.select("a", "b", F.size(F.array_intersect("_a", "_b")).alias("shared"), F.size("_a").alias("n_a"), F.size("_b").alias("n_b"))


#: Rounds in which each set of an open bucket meets one pivot, before the rest meets in tiles.
ROUNDS = 2


def jaccard_groups(docs: DataFrame, ids: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, component) of all fingerprints that link with another: the components that all linked pairs make.

    A bucket's pivot is its set with the most shared signatures, the likely original of a group of copies. In a round
    each set meets one pivot, the heaviest of its buckets, so a group of n copies costs n comparisons; sets that link
    become one component, and buckets that hold a single component are done. What is open after ROUNDS meets all that
    have the same pivot, in tiles of bounded size."""
    buckets = common.stash(shared_buckets(signature_rows(docs, shingle)), "buckets")
    band = F.col("sig").bitwiseAND((1 << BAND_BITS) - 1).cast("int").alias("band")
    enough = buckets.groupBy("f", band).agg(F.count(F.lit(1)).alias("weight")).filter(F.col("weight") >= _needed(F.col("band")))
    live = common.stash(buckets.withColumn("band", band).join(enough, ["f", "band"]).select("sig", "f", "weight"), "live-buckets")
    heaviest = F.max(F.struct("weight", "f")).alias("top")
    pivots = live.groupBy("sig").agg(heaviest, F.min("f").alias("_lo"), F.max("f").alias("_hi")).filter("_lo <> _hi").select("sig", F.col("top.weight").alias("weight"), F.col("top.f").alias("pivot"))
    members = common.stash(live.select("sig", "f").join(pivots, "sig").select("sig", "f", "weight", "pivot"), "bucket-members")
    sets = common.stash(sets_of(docs, ids, members.select("f").distinct(), shingle), "shingle-sets")
    common.free(buckets, live)
    linked = F.col("shared") * DEN >= NUM * (F.col("n_a") + F.col("n_b") - F.col("shared"))
    rest, links, tried = members.filter("f <> pivot"), None, None
    for _ in range(ROUNDS):
        stars = rest.select("f", "weight", "pivot").distinct()
        if tried is not None:
            stars = stars.join(tried.select(F.col("b").alias("f"), F.col("a").alias("pivot")), ["f", "pivot"], "left_anti")
        tried = common.stash(stars.groupBy("f").agg(F.max(F.struct("weight", "pivot")).alias("top")).select(F.col("top.pivot").alias("a"), F.col("f").alias("b")), "stars")
        found = verified(tried, sets).filter(linked).select("a", "b")
        links = common.stash(found if links is None else found.unionByName(groups.select(F.col("component").alias("a"), F.col("node").alias("b"))), "star-links")
        groups = components.connected(links)
        members, done = open_members(members, groups), members
        common.free(done)
        if members.isEmpty():
            return groups
        rest = members.filter("apart")
    more = tile_links(members, sets)
    return components.connected(more.unionByName(groups.select(F.col("component").alias("a"), F.col("node").alias("b"))))


def open_members(members: DataFrame, groups: DataFrame) -> DataFrame:
    """The members(sig, f, weight, pivot) of buckets whose sets are not all of one component yet, with apart: whether
    a set is of another component than its bucket's pivot."""
    label = groups.select(F.col("node").alias("f"), F.col("component").alias("c"))
    rows = members.select("sig", "f", "weight", "pivot").join(label, "f", "left").withColumn("c", F.coalesce("c", "f"))
    # A pivot is a member of its own bucket: the component of the bucket's one row with f = pivot is the pivot's.
    rows = common.stash(rows, "labelled-members")
    state = rows.groupBy("sig").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi"), F.max(F.when(F.col("f") == F.col("pivot"), F.col("c"))).alias("pc")).filter("_lo <> _hi")
    out = common.stash(rows.join(state, "sig").select("sig", "f", "weight", "pivot", (F.col("c") != F.col("pc")).alias("apart")), "open-members")
    common.free(rows)
    return out


#: Sets on either side of a tile, at most about: those apart from their pivot, and all of the pivot's. And features of
#: either side (or those of one set, if it has more).
TILE_APART, TILE_ALL = 500, 1000
TILE_FEATURES = 1 << 22
_FEATURES = 2048


def tile_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among sets of open buckets of one pivot, of which at least one is of another component than the pivot.
    Sets of a bucket have one pivot, so no pair of a bucket is left out. A pivot's sets are dealt by a hash into tiles;
    a tile of bounded sets and features counts what all pairs share by products of 0/1 matrices and emits only links that join something, so what
    is emitted grows with the sets, not with their pairs."""
    rows = members.groupBy(F.col("pivot").alias("a"), F.col("f").alias("b")).agg(F.bool_or("apart").alias("apart"))
    rows = rows.join(sets.select(F.col("f").alias("b"), F.size("shingles").cast("long").alias("_m")), "b")
    features = F.sum("_m").alias("m"), F.sum(F.when(F.col("apart"), F.col("_m")).otherwise(0)).alias("um")
    sizes = rows.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.count_if("apart").alias("u"), *features).filter("u > 0")
    rows = common.stash(rows.drop("_m").join(sizes, "a"), "apart-sets")
    pieces = lambda n, most, m: F.greatest(F.ceil(F.col(n) / most), F.ceil(F.col(m) / TILE_FEATURES)).cast("int")
    across, down = pieces("u", TILE_APART, "um"), pieces("n", TILE_ALL, "m")
    h = F.xxhash64("b")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    left = rows.filter("apart").select("a", "b", F.lit(True).alias("apart"), F.pmod(h, across).cast("int").alias("i"), F.explode(every(down)).alias("j"))
    right = rows.select("a", "b", F.lit(False).alias("apart"), F.explode(every(across)).alias("i"), F.pmod(h, down).cast("int").alias("j"))
    dealt = left.unionByName(right).join(sets.withColumnRenamed("f", "b"), "b")
    return dealt.groupBy("a", "i", "j").applyInArrow(_tile, "a long, b long")


def _tile(table: pa.Table) -> pa.Table:
    apart = table.column("apart").to_numpy()
    f = table.column("b").to_numpy()
    lists = table.column("shingles").combine_chunks()
    first = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
    _, feature, count = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(f)), np.diff(first))
    use = count[feature] > 1
    rank = np.cumsum(count > 1) - 1
    feature, owner = rank[feature[use]], owner[use]
    left, right = np.flatnonzero(apart), np.flatnonzero(~apart)
    place = np.zeros(len(f), dtype=np.int64)
    place[left], place[right] = np.arange(len(left)), np.arange(len(right))
    shared = np.zeros((len(left), len(right)), dtype=np.float32)
    order = np.argsort(feature, kind="stable")
    feature, owner = feature[order], owner[order]
    for lo in range(0, int(feature[-1]) + 1 if len(feature) else 0, _FEATURES):
        s = slice(*np.searchsorted(feature, (lo, lo + _FEATURES)))
        x, who = feature[s] - lo, owner[s]
        sides = []
        for side, n in ((apart, len(left)), (~apart, len(right))):
            m = np.zeros((n, _FEATURES), dtype=np.float32)
            mine = side[who]
            m[place[who[mine]], x[mine]] = 1
            sides.append(m)
        shared += sides[0] @ sides[1].T
    n = np.diff(first)
    i, j = np.nonzero(shared * (DEN + NUM) >= NUM * (n[left][:, None] + n[right][None, :]).astype(np.float32))
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    a, b = [], []
    for x, y in zip(f[left[i]].tolist(), f[right[j]].tolist(), strict=True):
        if (p := root(x)) != (q := root(y)):
            up[p] = q
            a.append(x)
            b.append(y)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def jaccard_classes(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, th (hash of the text), n_shingles and component_id, the smallest doc_id
    reachable by links.

    Words are runs of anything but ASCII white space, A-Z in lower case. Rows with equal sets are linked; empty
    sets (null or blank texts) link with nothing and are their own component; null ids are never a component's id
    unless all its rows have none. Repeated rows are kept; extra columns are ignored; an empty table gives an empty one."""
    ids = common.stash(identities(docs, shingle), "set-ids")
    groups = jaccard_groups(docs, ids, shingle)
    placed = ids.join(groups.withColumnRenamed("node", "f"), "f", "left").withColumn("component", F.coalesce("component", "f"))
    placed = common.stash(placed.select("doc_id", "th", "n_shingles", "component"), "set-classes")
    least = placed.filter("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    out = placed.join(least, "component", "left")
    return out.select("doc_id", "th", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest doc_id stays (of repeated rows with
    it, one). Texts without words are no near-duplicates of anything and stay. All columns stay as they are."""
    found = jaccard_classes(docs, shingle).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    empty = found.filter("n_shingles = 0").select("doc_id", "th").distinct()
    first = found.filter("n_shingles > 0").groupBy("component_id").agg(F.min("th").alias("th")).select(F.col("component_id").alias("doc_id"), "th")
    stay = empty.unionByName(first).select(F.col("doc_id").alias("_d"), F.col("th").alias("_th"))
    key = next(name for k in range(len(docs.columns) + 1) if (name := f"_key{k}") not in docs.columns)
    rows = docs.withColumn(key, F.xxhash64(F.col("text").cast("string")))
    kept = rows.join(stay, rows[key].eqNullSafe(F.col("_th")) & rows["doc_id"].cast("long").eqNullSafe(F.col("_d")), "left_semi")
    return kept.dropDuplicates([key, "doc_id"]).drop(key)


def op9_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """The class of every document."""
    return jaccard_classes(common.table(spark, sf_dir, "documents")).drop("th")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
b AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_have >= 75 * (x.n + y.n - both_have)),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.seen FROM r JOIN l ON r.doc_id = l.a),
c AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def brute_force(docs: list[tuple], shingle: int = SHINGLE) -> list[tuple]:
    """The same by comparing all pairs; for tests."""
    sets = []
    for _, text in docs:
        words = [w for w in (text or "").encode().lower().split()] if (text or "").isascii() else _words(text or "")
        sets.append({tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set())
    label = list(range(len(docs)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and DEN * len(a & b) >= NUM * len(a | b):
                label[root(i)] = root(j)
    least: dict = {}
    for i, (doc, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), math.inf), doc)
    return [(doc, len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(docs)]


def _words(text: str) -> list[bytes]:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
