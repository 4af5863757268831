"""Best-fit packing of tokenized documents into fixed-length sequences by a grouping genetic algorithm."""

from __future__ import annotations

import bisect
import os
import random
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm import common

CAPACITY = 2048
END_ID = 0
#: Pieces of one shard, about: a packing problem that one task solves.
SHARD_PIECES = 8192
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 4, 3, 24, 6
#: Bins at least so full are well filled: a crossover may give them away whole.
WELL_FILLED = 0.995
#: Bins less full than this are opened again and packed with those of other shards, as long as that saves a tenth of them.
REOPEN_BELOW, WORTHWHILE = 0.97, 0.1
#: Lower-cased words and parts of words whose ids a worker keeps, about at most (some 200 bytes each).
_CACHE_WORDS = 2_000_000
#: Text that is tokenized at once, about.
TEXT_BYTES = 8_000_000
#: A class of re, see _tokenizer.
PLAIN = "\x09-\x0d\x20-\x84\x86-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u024f\u2010-\u2027\u2030-\u203e"


def _tokenizer(path: str | None):
    """The worker's tokenizer, its cache of ids by word, and the patterns."""
    _worker = common.kept(__name__)
    if _worker.get("path") != (path or ""):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if not path:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
            _worker["path"] = ""
        else:
            _worker["path"] = path
        _worker["tokenizer"] = Tokenizer.from_file(path)
        _worker["model"], _worker["ids"] = _worker["tokenizer"].model, {}
        # Fixed value: the tokenizer's own pattern of parts of words, for the plain characters below.
        _worker["pattern"] = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
        # Characters for which lower() and the tokenizer's normalizer do the same, and re's and Arrow's classes and its
        # own are the same; texts with others go to it whole.
        _worker["plain"] = re.compile(f"[{PLAIN}]*")
        # How its model wants a plain character, lower-cased: by the alphabet of bytes.
        shown = _worker["tokenizer"].pre_tokenizer.pre_tokenize_str
        _worker["letters"] = {ord(c.lower()): "".join(x for x, _ in shown(c.lower())) for c in map(chr, range(0x2040)) if _worker["plain"].fullmatch(c) and not c.isspace()}
    return _worker


def _learn(words: list[str], w: dict) -> None:
    """Put the ids of lower-cased words, and of the parts that the tokenizer cuts them into, in the worker's cache.

    A part is a word of its own, too. The model alone is asked, once a part: the tokenizer's other steps are done."""
    known, find, model, letters = w["ids"], w["pattern"].findall, w["model"].tokenize, w["letters"]

    def learn(part: str) -> bytes:
        ids = [t.id for t in model(part.translate(letters))]
        known[part] = out = struct.pack(f"<{len(ids)}I", *ids)
        return out

    for x in words:
        if x.isalpha():
            if x not in known:
                learn(x)
        elif (head := x[:-1]).isalpha():  # letters and one sign or digit
            known[x] = (known.get(head) or learn(head)) + (known.get(x[-1]) or learn(x[-1]))
        elif x:
            parts = find(x)
            known[x] = b"".join([known.get(y) or learn(y) for y in parts]) if len(parts) > 1 else known.get(x) or learn(x)
        else:
            known[x] = b""


def tokenize(texts: list[str], path: str | None = None) -> list[bytes]:
    """Token ids of each text as little-endian unsigned 32-bit numbers, as the tokenizer gives them for whole texts.

    It tokenizes the parts of a text apart from each other and never across white space. So Arrow cuts the texts at white
    space and numbers their distinct words, only these are looked up, and numpy deals their ids out to their places;
    words and parts that the bounded cache does not have are tokenized once."""
    w = _tokenizer(path)
    plain = [w["plain"].fullmatch(t) is not None and "<|" not in t for t in texts]
    cut = pc.utf8_split_whitespace(pc.utf8_lower(pa.array([t if p else "" for t, p in zip(texts, plain, strict=True)], pa.string())))
    words = cut.flatten().dictionary_encode()
    every, known = words.dictionary.to_numpy(zero_copy_only=False).tolist(), w["ids"]
    if len(known) > _CACHE_WORDS:
        known.clear()
    found = list(map(known.get, every))
    new = [k for k, ids in enumerate(found) if ids is None]
    _learn([every[k] for k in new], w)
    for k in new:
        found[k] = known[every[k]]
    # Of each word: where its ids begin among those of the distinct words, and how many they are.
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    pool, begins = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
    at = words.indices.to_numpy()
    n = sizes[at]
    ends = np.concatenate([[0], np.cumsum(n)])
    small = np.int32 if ends[-1] < 2**31 else np.int64
    places = np.repeat((begins[at] - ends[:-1]).astype(small), n)
    places += np.arange(ends[-1], dtype=small)
    blob = pool[places].tobytes()
    edges = (4 * ends[np.concatenate([[0], np.cumsum(pc.list_value_length(cut).to_numpy())])]).tolist()
    whole = lambda t: np.array(w["tokenizer"].encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
    return [blob[a:b] if p else whole(t) for t, p, a, b in zip(texts, plain, edges, edges[1:], strict=False)]


def _by_bytes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of some TEXT_BYTES of column 1 each, so that what is made of a slice stays within memory."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)) // TEXT_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


PIECES = "doc_id long, piece int, start long, length int, ids binary"


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None) -> DataFrame:
    """Token pieces of docs(doc_id, text): each document's ids and a closing END_ID, cut every `capacity` ids.

    Null texts are empty: one piece that is END_ID alone. Repeated documents give repeated pieces."""
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _by_bytes(batch):
                rows: list[tuple] = []
                for doc, ids in zip(some.column(0).to_pylist(), tokenize([t or "" for t in some.column(1).to_pylist()], tokenizer_path), strict=True):
                    ids += end
                    rows += [(doc, k, k * capacity, len(part) // 4, part) for k in range(-(-len(ids) // 4 // capacity)) if (part := ids[4 * k * capacity : 4 * (k + 1) * capacity])]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    return common.map_arrow(common.documents(docs), run, PIECES, 10 * common.BATCH_ROWS)


class Bins:
    """Bins by free space; best fit finds the fullest bin that still holds a piece by one look at a bitmask."""

    def __init__(self, capacity: int):
        self.free_mask, self.by_free = 0, [[] for _ in range(capacity + 1)]
        self.capacity, self.bins, self.free = capacity, [], []

    def add(self, members: list[int], total: int) -> None:
        self.bins.append(members)
        self.free.append(self.capacity - total)
        self._file(len(self.bins) - 1)

    def _file(self, b: int) -> None:
        f = self.free[b]
        if f:
            self.by_free[f].append(b)
            self.free_mask |= 1 << f

    def best_fit(self, item: int, length: int) -> None:
        fits = self.free_mask >> length
        if not fits:
            self.add([item], length)
            return
        f = length + (fits & -fits).bit_length() - 1
        b = self.by_free[f].pop()
        if not self.by_free[f]:
            self.free_mask &= ~(1 << f)
        self.bins[b].append(item)
        self.free[b] -= length
        self._file(b)


def best_fit_decreasing(order, lengths, capacity: int, start: list | None = None) -> list[list[int]]:
    bins = Bins(capacity)
    for members in start or ():
        bins.add(members, sum(lengths[i] for i in members))
    for i in order:
        bins.best_fit(i, lengths[i])
    return bins.bins


def fitness(bins: list[list[int]], lengths, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    return -len(bins), sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins)


def exchange(bins: list[list[int]], loose: list[int], lengths, capacity: int) -> list[list[int]]:
    """Best fit for displaced pieces after an exchange: a bin with room gives a piece for a longer displaced one, or two
    pieces for one, that still fits; so bins get fuller and what is left over is shorter and easier to place."""
    loose = sorted(loose, key=lambda i: lengths[i])
    sizes = [lengths[i] for i in loose]

    def longest(least: int, most: int) -> int | None:
        """Place of the longest displaced piece of a length in least + 1 .. most."""
        at = bisect.bisect_right(sizes, most) - 1
        return at if at >= 0 and sizes[at] > least else None

    def put(i: int) -> None:
        at = bisect.bisect_left(sizes, lengths[i])
        sizes.insert(at, lengths[i])
        loose.insert(at, i)

    for b in bins:
        free = capacity - sum(lengths[i] for i in b)
        if not free or not loose:
            continue
        best = (0, -1, ())  # gain, place among the displaced, what goes out
        outs = [(lengths[i], (i,)) for i in b] + [(lengths[i] + lengths[j], (i, j)) for n, i in enumerate(b) for j in b[n + 1 :]][:64]
        for out, gone in outs:
            at = longest(out, out + free)
            if at is not None and sizes[at] - out > best[0]:
                best = (sizes[at] - out, at, gone)
        if best[0]:
            _, at, gone = best
            b.append(loose.pop(at))
            sizes.pop(at)
            for i in gone:
                b.remove(i)
                put(i)
    return best_fit_decreasing(loose[::-1], lengths, capacity, bins)


def crossover(mine: list, other: list, lengths, capacity: int, rng: random.Random) -> list:
    """Inject some of the other parent's well-filled bins whole, drop my bins that hold the same pieces, and put
    the displaced pieces back by best fit. If it has few such bins, its fullest tenth counts as well filled."""
    filled = sorted(((sum(lengths[i] for i in b), k) for k, b in enumerate(other)), reverse=True)
    full = [k for n, (total, k) in enumerate(filled) if total >= WELL_FILLED * capacity or n * 10 < len(filled)]
    gifts = [list(other[k]) for k in full if rng.random() < 0.5]
    got = {i for b in gifts for i in b}
    kept, displaced = gifts, []
    for b in mine:
        if got.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in got]
    return exchange(kept, displaced, lengths, capacity)


def mutate(mine: list, lengths, capacity: int, rng: random.Random) -> list:
    """Open the least full bins and a few others, and pack their pieces anew."""
    filled = sorted(range(len(mine)), key=lambda b: sum(lengths[i] for i in mine[b]))
    opened = set(filled[: max(2, len(mine) // 50)]) | {rng.randrange(len(mine)) for _ in range(max(2, len(mine) // 50))}
    return exchange([list(b) for k, b in enumerate(mine) if k not in opened], [i for b in opened for i in mine[b]], lengths, capacity)


def evolve(lengths: list[int], seeds: list, capacity: int, rng: random.Random, generations: int = GENERATIONS) -> list:
    """The best packing that an island finds, from seed packings and noisy best-fit-decreasing ones.

    No packing has fewer bins than the pieces' sum over the capacity, rounded up; where best fit alone comes to that
    bound, as it does on many short pieces, nothing is left to gain and no generation runs."""
    least = -(-sum(lengths) // capacity)
    people = [list(map(list, s)) for s in seeds] or [best_fit_decreasing(sorted(range(len(lengths)), key=lambda i: -lengths[i]), lengths, capacity)]
    score = lambda p: fitness(p, lengths, capacity)
    if min(map(len, people)) > least:
        while len(people) < POPULATION:
            noise = [x * (1 + 0.05 * rng.random()) for x in lengths]
            people.append(best_fit_decreasing(sorted(range(len(lengths)), key=lambda i: -noise[i]), lengths, capacity))
        people = sorted(((score(p), k, p) for k, p in enumerate(people)), reverse=True)
        for number in range(generations):
            if len(people[0][2]) <= least:
                break
            a, b = rng.sample(range(len(people)), 2)
            child = crossover(people[min(a, b)][2], people[max(a, b)][2], lengths, capacity, rng)
            if rng.random() < 0.5:
                child = mutate(child, lengths, capacity, rng)
            people = sorted([*people, (score(child), -1 - number, child)], reverse=True)[:POPULATION]
        return people[0][2]
    return max(people, key=score)


def _bins(numbers) -> list[list[int]]:
    out: dict[int, list[int]] = {}
    for i, b in enumerate(numbers):
        out.setdefault(int(b), []).append(i)
    return list(out.values())


def _epoch(items: DataFrame, capacity: int, epoch: int) -> DataFrame:
    """One epoch on every island of every shard. items: shard, item, length and bins (a bin number for each island);
    each island starts from its own elite and that of its neighbour, which migrates to it. more: an island of the shard
    has saved a bin, and there are still more than the sum of lengths needs."""
    schema = "shard long, island int, item long, length int, bin int, more boolean"

    def run(key, pdf):
        pdf = pdf.sort_values("item", kind="stable")
        lengths = pdf["length"].tolist()
        seeds = [_bins(pdf[c]) for c in ("own", "migrant") if pdf[c].notna().all()]
        rng = random.Random(f"{key[0]}/{key[1]}/{epoch}")
        best = evolve(lengths, seeds, capacity, rng)
        number = np.zeros(len(lengths), dtype=np.int32)
        for b, members in enumerate(best):
            number[members] = b
        more = -(-sum(lengths) // capacity) < len(best) < min(map(len, seeds))
        return pdf[["shard", "island", "item", "length"]].assign(bin=number, more=more)

    island = F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island")
    dealt = items.select("shard", "item", "length", "bins", island)
    at = lambda i: F.get("bins", i)
    dealt = dealt.select("shard", "island", "item", "length", at(F.col("island")).alias("own"), at((F.col("island") + ISLANDS - 1) % ISLANDS).alias("migrant"))
    done = dealt.groupBy("shard", "island").applyInPandas(run, schema)
    bins = F.transform(F.array_sort(F.collect_list(F.struct("island", "bin"))), lambda x: x["bin"])
    return common.stash(done.groupBy("shard", "item", "length").agg(bins.alias("bins"), F.bool_or("more").alias("more")), "packing-epoch")


def _first_fit(capacity: int):
    """Best-fit-decreasing bins of a shard, and whether they are good as they are: as few as the sum of lengths allows.
    That is asked of every shard alike, however many there are."""

    def fit(pdf):
        pdf = pdf.sort_values("item", kind="stable")
        lengths = pdf["length"].tolist()
        bins = best_fit_decreasing(sorted(range(len(lengths)), key=lambda i: -lengths[i]), lengths, capacity)
        number = np.zeros(len(lengths), dtype=np.int32)
        for b, members in enumerate(bins):
            number[members] = b
        return pdf[["shard", "item", "length"]].assign(bin=number, good=len(bins) <= -(-sum(lengths) // capacity))

    return fit


def _chooser(capacity: int):
    """The best island's bins of a shard, with offsets; keep is false for bins that may be opened again."""

    def choose(pdf):
        pdf = pdf.sort_values("item", kind="stable")
        lengths = pdf["length"].tolist()
        best = max((_bins([b[i] for b in pdf["bins"]]) for i in range(len(pdf["bins"].iloc[0]))), key=lambda p: fitness(p, lengths, capacity))
        number, offset, keep = (np.zeros(len(lengths), dtype=np.int64) for _ in range(3))
        for b, members in enumerate(best):
            at = 0
            for i in members:
                number[i], offset[i] = b, at
                at += lengths[i]
            keep[members] = at >= REOPEN_BELOW * capacity
        return pdf[["shard", "item", "length"]].assign(bin=number, offset=offset, keep=keep == 1)

    return choose


def pack(items: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """items(item, length), item unique and 0 < length <= capacity, with sequence_id and offset.

    Pieces are dealt evenly into shards by a hash, whatever documents they are of. Where best fit alone leaves more bins
    than the sum of lengths needs, the shard's islands evolve from it and exchange elites, until an epoch saves no bin. Bins that stay less than REOPEN_BELOW full are opened and packed again with those of other shards,
    until one shard holds them all or that saves less than WORTHWHILE of them: then their lengths fill no bins better,
    whatever shard they are in. An empty table gives an empty one."""
    done = items.filter(F.col("length") >= capacity).select("item", (F.col("item") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, level, before = items.filter(F.col("length") < capacity).select("item", F.col("length").cast("int").alias("length")), 0, None
    while True:
        n = rest.count()
        if not n:
            return done
        shards = -(-n // shard_pieces)
        dealt = rest.select(F.pmod(F.xxhash64("item", F.lit(level)), F.lit(shards)).alias("shard"), "item", "length")
        first = common.stash(dealt.groupBy("shard").applyInPandas(_first_fit(capacity), "shard long, item long, length int, bin int, good boolean"), "packing-first")
        now, hard = first.filter("good").select("shard", "item", "length", F.array("bin").alias("bins")), first.filter("not good")
        if not hard.isEmpty():
            evolved = hard.select("shard", "item", "length", F.array_repeat("bin", ISLANDS).alias("bins"))
            for epoch in range(EPOCHS):
                evolved = _epoch(evolved, capacity, epoch)
                more = F.col("more") if epoch < EPOCHS - 1 else F.lit(False)
                now = now.unionByName(evolved.filter(~more).drop("more"))
                evolved = evolved.filter(more)
                if evolved.isEmpty():
                    break
        chosen = common.stash(now.groupBy("shard").applyInPandas(_chooser(capacity), "shard long, item long, length int, bin long, offset long, keep boolean"), "packing-level")
        bins, still_open = chosen.filter("offset = 0").agg(F.count(F.lit(1)), F.count_if(~F.col("keep"))).first()
        last = shards == 1 or (before is not None and bins > (1 - WORTHWHILE) * before)
        # Odd ids; level, shard and bin are told apart by ranges.
        number = (((F.lit(level).cast("long") * 2**36 + F.col("shard")) * (shard_pieces * 4) + F.col("bin")) * 2 + 1).alias("sequence_id")
        done = done.unionByName((chosen if last else chosen.filter("keep")).select("item", number, "offset"))
        if last:
            return done
        rest, level, before = chosen.filter(~F.col("keep")).select("item", "length"), level + 1, still_open


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None, with_ids: bool = True) -> DataFrame:
    """The pieces of docs with sequence_id and offset (and their ids). Pieces are tokenized once, into a table in
    the shared folder; only their numbers and lengths are packed and shuffled."""
    made = pieces(docs, capacity, tokenizer_path).withColumn("item", F.monotonically_increasing_id()).withColumn("ids_crc32", F.crc32("ids"))
    made = common.stash(made if with_ids else made.drop("ids"), "pieces")
    return made.join(pack(made.select("item", "length"), capacity), "item").drop("item")


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: sequence_id, ids (binary, its pieces joined in order) and length; needs with_ids."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("rows"), F.sum("length").alias("length"))
    return rows.select("sequence_id", F.aggregate("rows", F.lit(b""), lambda s, r: F.concat(s, r["ids"])).alias("ids"), "length")


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place."""
    packed = pack_documents(common.table(spark, sf_dir, "documents"), with_ids=False)
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
