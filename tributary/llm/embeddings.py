"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine c or more are within squared distance 2 - 2c. After a random rotation their coordinates are
cut into blocks; at least one block has no more than its proportional share of that distance. Each block is range-
joined under its share, and what comes out is verified in all dimensions, each pair in the first block that has it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm import common, components

LEAST_COSINE = 0.95
BLOCK_DIMENSIONS = 16
#: Vectors of a cell, about: what a task holds, while those that come from other cells stream past.
CELL_ROWS = 12_000
#: Vectors on which the cells' borders are fitted, about: so many, or so many for each cell if that is more (a bound on
#: what the driver sees; every vector is joined).
FIT_ROWS, FIT_CELL_ROWS = 20_000, 16
#: For rounding: of a share itself (in single precision), and of the faster formula that finds candidates.
_SLACK, _LOOSE = 1e-6, 2e-5


def rotation(dimensions: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(20240501).standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def blocks_of(dimensions: int, width: int = BLOCK_DIMENSIONS) -> list[tuple[int, int]]:
    return [(a, min(dimensions, a + width)) for a in range(0, dimensions, width)]


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members(vec_id, key) of all rows (key null where the vector links with nothing), and vectors(key, v, copies):
    one unit vector in double precision for each distinct one."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    fine = F.col("v").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    # Scaled by the largest component first: squares neither overflow nor vanish.
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    rows = rows.withColumn("v", F.when(fine, F.transform("v", lambda x: x / top + F.lit(0.0))))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.withColumn("key", F.when(F.col("v").isNotNull(), F.sha2(F.to_json(F.struct("v")), 256))).withColumn("v", F.transform("v", lambda x: x / norm))
    members = common.stash(rows.select("vec_id", "key"), "vector-members")
    unique = rows.filter("key is not null").groupBy("key").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"))
    return members, common.stash(unique.withColumn("node", F.monotonically_increasing_id()), "unit-vectors")


def fit_cells(sample: np.ndarray, rows: int, cell_rows: int) -> list:
    """Borders of a k-d split of a block: nested (axis, border, below, above) down to cells of about cell_rows."""

    def split(x: np.ndarray, n: float):
        if n <= cell_rows or len(x) < 4:
            return None
        axis = int(np.argmax(x.var(axis=0)))
        border = float(np.median(x[:, axis]))
        low = x[:, axis] < border
        if not low.any() or low.all():
            return None
        return axis, border, split(x[low], n * low.mean()), split(x[~low], n * (~low).mean())

    return split(sample, rows)


def leaves(tree) -> int:
    return 1 if tree is None else leaves(tree[2]) + leaves(tree[3])


def reached(tree, x: np.ndarray, radius2: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each cell the places in x of the vectors that are within the radius of its box, and which of them are in it."""

    def walk(t, number, at, gaps, inside):
        if not len(at):
            return
        if t is None:
            yield number, at, inside
            return
        axis, border, below, above = t
        left = x[at, axis] < border
        step = (x[at, axis] - border) ** 2
        for child, first, mine in ((below, number, left), (above, number + leaves(below), ~left)):
            # Beyond a border the gap along its axis is at least the way to it; an earlier gap on the axis is no larger.
            g = gaps.copy()
            g[~mine, axis] = np.maximum(g[~mine, axis], step[~mine])
            near = g.sum(axis=1) <= radius2
            yield from walk(child, first, at[near], g[near], (inside & mine)[near])

    yield from walk(tree, 0, np.arange(len(x)), np.zeros_like(x), np.ones(len(x), dtype=bool))


def visits(home: np.ndarray, cell: int, cells: int) -> np.ndarray:
    """Whether vectors of the cells `home` go to `cell`, and not the other way: round the circle of cells, to the half
    behind it, so each cell has about as many visitors."""
    step = (home - cell) % cells
    return (step > 0) & ((2 * step < cells) | ((2 * step == cells) & (home > cell)))


def compare(a: np.ndarray, b: np.ndarray, block: int, spans: list, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into a and b: rotated unit vectors) with cosine >= least whose first block within its share is
    `block`; so each pair comes from one tile of one block only."""
    total = 2 - 2 * least
    lo, hi = spans[block]
    share = [total * (z - y) / a.shape[1] + _SLACK for y, z in spans]
    single_a, single_b = a.astype(np.float32), b.astype(np.float32)
    xb = single_b[:, lo:hi]
    nb = (xb**2).sum(axis=1)
    for at in range(0, len(a), 256):
        xa = single_a[at : at + 256, lo:hi]
        near = xa @ (-2 * xb.T)
        near += nb[None, :]
        i, j = np.nonzero(near <= (share[block] + _LOOSE - (xa**2).sum(axis=1))[:, None])
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for part in range(0, len(i), 65_536):
            p, q = i[part : part + 65_536], j[part : part + 65_536]
            for k in range(block, -1, -1):
                y, z = spans[k]
                d = single_a[p, y:z] - single_b[q, y:z]
                within = np.einsum("ij,ij->i", d, d) <= share[k]
                use = within if k == block else ~within
                p, q = p[use], q[use]
            good = np.einsum("ij,ij->i", a[p], b[q]) >= least
            if good.any():
                yield p[good], q[good]


class Forest:
    """Union-find over the vectors of a tile."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        top = x
        while (y := self.up.get(top, top)) != top:
            top = y
        while x != top:
            self.up[x], x = top, self.up.get(x, x)
        return top

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


TILE = "node long, other long, n_links long"
DEALT = "block int, cell int, visitor boolean, node long, v array<double>, copies long"


def tile_links(unique: DataFrame, least: float = LEAST_COSINE, width: int = BLOCK_DIMENSIONS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Rows (node, other, n_links) of all cells: either a link that joins components (other), or how many vectors
    (copies counted) a node links with in one cell. No cell emits its pairs: their number may grow with the square of
    a group, but what is emitted grows with its vectors. Vectors of different lengths have no cosine and never link."""
    sizes = [r[0] for r in unique.select(F.size("v").alias("n")).distinct().collect()]
    out = unique.sparkSession.createDataFrame([], TILE)
    for n in sorted(sizes):
        own = unique if len(sizes) == 1 else unique.filter(F.size("v") == n)
        out = out.unionByName(_links_of_length(own, n, least, width, cell_rows))
    return out


def _links_of_length(unique: DataFrame, dimensions: int, least: float, width: int, cell_rows: int) -> DataFrame:
    """tile_links for vectors of one length. They are rotated once, so that all cells see the same numbers; rotation
    leaves cosines as they are. A vector goes to its own cell of each block, and as a visitor to those other cells whose
    box is within the block's radius of the vector itself, each pair of cells in one direction only."""
    n, spans, turn = unique.count(), blocks_of(dimensions, width), rotation(dimensions)
    wanted = max(FIT_ROWS, FIT_CELL_ROWS * (n // cell_rows))
    part = min(1.0, wanted / n)
    sample = unique.select("v").filter(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(np.ceil(1_000_000 * part))).limit(2 * wanted)
    sample = np.array([r[0] for r in sample.collect()]).reshape(-1, dimensions) @ turn
    trees = [fit_cells(sample[:, a:z], n, cell_rows) for a, z in spans]
    shared = unique.sparkSession.sparkContext.broadcast((trees, turn))
    radius2 = [(2 - 2 * least) * (z - a) / dimensions + _SLACK for a, z in spans]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, turn = shared.value
        for b in batches:
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            rotated = v @ turn
            flat = pa.FixedSizeListArray.from_arrays(pa.array(rotated.ravel()), dimensions).cast(pa.list_(pa.float64()))
            for block, (lo, hi) in enumerate(spans):
                cells, home = leaves(trees[block]), np.zeros(len(v), dtype=np.int64)
                near = list(reached(trees[block], rotated[:, lo:hi], radius2[block]))
                for cell, at, inside in near:
                    home[at[inside]] = cell
                for cell, at, inside in near:
                    goes = inside | visits(home[at], cell, cells)
                    at, inside = at[goes], inside[goes]
                    if len(at):
                        i = pa.array(at)
                        columns = [pa.array(np.full(len(at), block, np.int32)), pa.array(np.full(len(at), cell, np.int32)), pa.array(~inside), b.column(0).take(i), flat.take(i), b.column(2).take(i)]
                        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in DEALT.split(", ")])

    dealt = common.map_arrow(unique.select("node", "v", "copies"), deal, DEALT)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of block, cell and visitor: a cell's own vectors are held, its visitors stream past them."""
        now, held, closed = None, [], None

        def found(block, mine, theirs=None):
            sides = [mine] if theirs is None else [mine, theirs]
            node, copies = (np.concatenate([s[k] for s in sides]) for k in (0, 2))
            count, forest, joined = np.zeros(len(node), dtype=np.int64), Forest(), []
            for p, q in compare(mine[1], sides[-1][1], block, spans, least, theirs is None):
                q = q if theirs is None else q + len(mine[0])
                np.add.at(count, p, copies[q])
                np.add.at(count, q, copies[p])
                joined += [(int(node[x]), int(node[y])) for x, y in zip(p.tolist(), q.tolist(), strict=True) if forest.join(x, y)]
            has = np.flatnonzero(count)
            a, b = ([x[k] for x in joined] for k in (0, 1))
            columns = [pa.array(node[has].tolist() + a, pa.int64()), pa.array([None] * len(has) + b, pa.int64()), pa.array(count[has].tolist() + [0] * len(joined), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["node", "other", "n_links"])

        def own():
            return tuple(np.concatenate([h[k] for h in held]) if held else np.zeros((0, dimensions) if k == 1 else 0) for k in range(3))

        for b in batches:
            keys = b.column(0).to_numpy().astype(np.int64) << 32 | b.column(1).to_numpy()
            visitor = b.column(2).to_numpy(zero_copy_only=False)
            v = b.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            node, copies = b.column(3).to_numpy(), b.column(5).to_numpy()
            cut = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (visitor[1:] != visitor[:-1])))
            for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(keys)], strict=True):
                if keys[lo] != now:
                    if now is not None and closed is None:
                        yield found(now >> 32, own())
                    now, held, closed = int(keys[lo]), [], None
                rows = (node[lo:hi], v[lo:hi], copies[lo:hi])
                if not visitor[lo]:
                    held.append(rows)
                    continue
                if closed is None:
                    closed = own()
                    yield found(now >> 32, closed)
                yield found(now >> 32, closed, rows)
        if now is not None and closed is None:
            yield found(now >> 32, own())

    return common.map_arrow(dealt.repartition("block", "cell").sortWithinPartitions("block", "cell", "visitor"), links, TILE)


def near_duplicates(vectors: DataFrame, least: float = LEAST_COSINE, width: int = BLOCK_DIMENSIONS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Per row of vectors(vec_id, embedding): vec_id, n_links, component_id and kept.

    Vectors link when their cosine in double precision is `least` or more. Null or zero vectors and those that hold
    null or non-finite components link with nothing. Exact copies are one node with a count; repeated rows are rows
    of their own. A component's id is its smallest vec_id; a null vec_id is kept only as its own component.
    Vectors of different lengths do not link; an empty table gives an empty one; extra columns are ignored."""
    members, unique = classes(vectors)
    tiles = common.stash(tile_links(unique, least, width, cell_rows), "tile-links")
    groups = components.connected(tiles.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = tiles.groupBy("node").agg(F.sum("n_links").alias("others"))
    nodes = unique.select("key", "node", "copies").join(counts, "node", "left").join(groups, "node", "left")
    nodes = nodes.select("key", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    placed = common.stash(members.join(nodes, "key", "left").select("vec_id", "n_links", "component"), "vector-classes")
    smallest = placed.groupBy("component").agg(F.min("vec_id").alias("least"))
    out = placed.join(smallest, "component", "left")
    component = F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def op4_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The links and class of every vector."""
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
f AS (SELECT * FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
r(vec_id, seen) AS (SELECT vec_id, vec_id FROM e UNION SELECT l.b, r.seen FROM r JOIN l ON r.vec_id = l.a),
c AS (SELECT vec_id, min(seen) AS component_id FROM r GROUP BY vec_id)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept
FROM e JOIN c ON e.vec_id = c.vec_id
"""
