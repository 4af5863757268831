"""Edits of documents that are larger than a row: only the log of a document meets in one task, never its nodes.

The fold over a log works on an overlay: what no edit touched stays a reference to a place of the old document (or of an
edit's value), and an array's elements are runs of old places, so that an insert or a removal cuts a run and shifts
nothing. What the fold must know of a place (its kind and number of children) it asks for: a round assumes what it does
not know, notes it, and is done again when joins have found it. The overlay of the last round says where each untouched
branch goes; nodes find their branch by an equi-join and are renamed."""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tributary.operators import tree as trees
from tributary.operators.edits import ARRAY, OBJECT
from tributary.plans.scratch import stash

#: Elements of a whole block of a run, and shares of a branch that is moved whole.
BLOCK, SHARES = 64, 16
#: Most items of a leaf of an array's list.
LEAF = 256
_ROW = "what string, src long, path string, lo long, hi long, shift long, dest string, seq long, text string, id int"
_FIELDS = [pa.field(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[t]) for n, t in (c.split() for c in _ROW.split(", "))]
_DOC = 0


class _Array:
    """Elements as runs (src, path, first, end) of old places, or (node,) for single ones, in leaves: lists of items and of
    their lengths. Sums of the leaves' lengths in a tree (Fenwick's) find the leaf of an element in logarithmic time."""

    def __init__(self, leaves):
        self.leaves = leaves
        self._sum()

    def __len__(self):
        return self.n

    def _sum(self):
        self.sums = [0, *(sum(lengths) for _, lengths in self.leaves)]
        self.n = sum(self.sums)
        for k in range(1, len(self.sums)):
            if (above := k + (k & -k)) < len(self.sums):
                self.sums[above] += self.sums[k]

    def _find(self, at: int):
        """(leaf number, place in it, offset in the item) of an element; behind the last one is the end of the last leaf."""
        sums, k, step = self.sums, 0, 1 << (len(self.leaves).bit_length() - 1)
        while step:
            if k + step < len(sums) and sums[k + step] <= at:
                k += step
                at -= sums[k]
            step >>= 1
        if k == len(self.leaves):
            return k - 1, len(self.leaves[-1][0]), 0
        ends = list(accumulate(self.leaves[k][1]))
        place = bisect_right(ends, at)
        return k, place, at - (ends[place - 1] if place else 0)

    def _change(self, k: int, place: int, offset: int, gone: int, new: tuple | None):
        """Put new (or nothing) in the place of so many elements, one or none, at offset of an item."""
        items, lengths = self.leaves[k]
        parts = [(new, 1)] if new else []
        if place < len(items) and (offset or gone):
            item, n = items[place], lengths[place]
            if len(item) == 4:
                src, path, a, _ = item
                cut = [((src, path, a + x, a + y), y - x) for x, y in ((0, offset), (offset + gone, n))]
                parts = [p for p in (cut[0], *parts, cut[1]) if p[1]]
            items[place : place + 1], lengths[place : place + 1] = [p[0] for p in parts], [p[1] for p in parts]
        else:
            items[place:place], lengths[place:place] = [p[0] for p in parts], [p[1] for p in parts]
        by = (new is not None) - gone
        self.n += by
        at = k + 1
        while by and at < len(self.sums):
            self.sums[at] += by
            at += at & -at
        if len(items) > LEAF:
            half = len(items) // 2
            self.leaves[k : k + 1] = [(items[:half], lengths[:half]), (items[half:], lengths[half:])]
            self._sum()

    def get(self, at: int):
        k, place, offset = self._find(at)
        item = self.leaves[k][0][place]
        return item[0] if len(item) == 1 else (item[0], f"{item[1]}/{item[2] + offset}")

    def put(self, at: int, node):
        self._change(*self._find(at), 1, (node,))

    def remove(self, at: int):
        self._change(*self._find(at), 1, None)

    def insert(self, at: int, node):
        self._change(*self._find(at), 0, (node,))


class _Object:
    """The members of an old place (src, path) but those in gone, and those in own; n is their number."""

    def __init__(self, base, n, gone, own):
        self.base, self.n, self.gone, self.own = base, n, gone, own


def _index(token: str, end: int) -> int | None:
    return int(token) if token.isascii() and token.isdigit() and str(int(token)) == token and int(token) < end else None


class _Fold:
    """One document's overlay; a node is an _Array, an _Object or a place (src, path) that no edit has touched."""

    def __init__(self, facts: dict):
        self.facts, self.needs, self.root = facts, set(), (_DOC, "")

    def look(self, place, hint: str | None = None):
        """(kind, value, n) of an old place, None if it isn't there; what is unknown is assumed to suit the next token."""
        if place in self.facts:
            return self.facts[place]
        self.needs.add(place)
        return ("array" if hint is not None and hint.isdigit() else "object", None, 1 << 40)

    def kind(self, node, hint=None):
        if isinstance(node, _Array):
            return "array", None, len(node)
        return ("object", None, node.n) if isinstance(node, _Object) else self.look(node, hint)

    def child(self, node, token):
        kind, _, n = self.kind(node, token)
        if kind == "array":
            at = _index(token, n)
            return None if at is None else node.get(at) if isinstance(node, _Array) else (node[0], f"{node[1]}/{token}")
        if kind != "object":
            return None
        if isinstance(node, _Object):
            if token in node.own or token in node.gone or node.base is None:
                return node.own.get(token)
            node = node.base
        place = (node[0], f"{node[1]}/{token}")
        return place if self.look(place) else None

    def find(self, tokens):
        node = self.root
        for t in tokens:
            if (node := self.child(node, t)) is None:
                return None
        return node

    def opened(self, tokens, last):
        """The container at tokens, which is there, as one whose member `last` can be changed; so are those above it."""
        above, out = None, None
        for depth in range(len(tokens) + 1):
            node = self.root if depth == 0 else self.child(above, tokens[depth - 1])
            if isinstance(node, tuple):
                kind, _, n = self.look(node, tokens[depth] if depth < len(tokens) else last)
                out = _Array([([(*node, 0, n)], [n])]) if kind == "array" else _Object(node, n, set(), {})
                if depth == 0:
                    self.root = out
                else:
                    self.put(above, tokens[depth - 1], out)
            else:
                out = node
            above = out
        return out

    @staticmethod
    def put(holder, token, node):
        if isinstance(holder, _Array):
            holder.put(int(token), node)
        else:
            holder.own[token] = node

    def replace(self, tokens, node):
        if tokens:
            self.put(self.opened(tokens[:-1], tokens[-1]), tokens[-1], node)
        else:
            self.root = node

    def remove(self, tokens):
        holder = self.opened(tokens[:-1], tokens[-1])
        if isinstance(holder, _Array):
            holder.remove(int(tokens[-1]))
        else:
            holder.own.pop(tokens[-1], None)
            holder.gone.add(tokens[-1])
            holder.n -= 1

    def add(self, tokens, node) -> bool:
        """Make room in an array or take an object's key; missing parents below an object become objects."""
        if not tokens:
            self.root = node
            return True
        above, depth = self.root, 0
        while depth < len(tokens) - 1 and (below := self.child(above, tokens[depth])) is not None:
            above, depth = below, depth + 1
        kind, _, n = self.kind(above, tokens[depth])
        if kind == "array":
            if depth < len(tokens) - 1 or _index(tokens[-1], n + 1) is None:
                return False
            self.opened(tokens[:-1], tokens[-1]).insert(int(tokens[-1]), node)
            return True
        if kind != "object":
            return False
        known = self.child(above, tokens[depth]) is not None
        holder = self.opened(tokens[:depth], tokens[depth])
        for token in reversed(tokens[depth + 1 :]):
            node = _Object(None, 1, set(), {token: node})
        holder.n += not known
        holder.own[tokens[depth]] = node
        return True

    def clone(self, node):
        """A copy whose touched parts are its own; no recursion, as documents may be deep."""
        top = [node]
        left = [(node, top, 0)]
        while left:
            node, holder, at = left.pop()
            if isinstance(node, _Array):
                new = _Array([(list(items), list(lengths)) for items, lengths in node.leaves])
                for items, _ in new.leaves:
                    for k, item in enumerate(items):
                        if len(item) == 1 and not isinstance(item[0], tuple):
                            left.append((item[0], items, k))
            elif isinstance(node, _Object):
                new = _Object(node.base, node.n, set(node.gone), dict(node.own))
                left += [(x, new.own, k) for k, x in node.own.items() if not isinstance(x, tuple)]
            else:
                continue
            holder[at] = (new,) if isinstance(node, (_Array, _Object)) and isinstance(holder, list) and holder is not top else new
        return top[0]

    def equal(self, tokens, nodes) -> bool:
        """Whether the branch at tokens is a value with these nodes (path, kind, value, n)."""
        for path, kind, value, n in nodes:
            here = self.find(tokens + path.split("/")[1:])
            got = here and self.kind(here)
            if not got or got[0] != kind or (got[2] != n if kind in ("object", "array") else got[1] != value):
                return False
        return bool(nodes)

    def apply(self, op, path, source, seq, has_value, nodes) -> str:
        if path is None or (path and path[0] != "/"):
            return "missing"
        tokens = path.split("/")[1:]
        if op == "add":
            good = has_value and self.add(tokens, (seq, ""))
        elif op in ("remove", "replace"):
            good = (tokens if op == "remove" else has_value) and self.find(tokens) is not None
            if good:
                self.remove(tokens) if op == "remove" else self.replace(tokens, (seq, ""))
        elif op == "test":
            good = self.find(tokens) is not None
            if good and not (has_value and self.equal(tokens, nodes)):
                return "failed"
        elif op in ("copy", "move") and source is not None and (not source or source[0] == "/"):
            origin = source.split("/")[1:]
            node = self.find(origin)
            good = node is not None and (op == "copy" or not path.startswith(source + "/"))
            if good and op == "copy":
                good = self.add(tokens, self.clone(node))
            elif good and origin:
                self.remove(origin)
                good = self.add(tokens, node)
                if not good:
                    self.add(origin, node)
        else:
            good = False
        return "ok" if good else "missing"

    def places(self):
        """Rows that say where everything is in the end: branches, runs of elements, members of objects, open containers."""
        left, number = [(self.root, "")], 0
        row = lambda what, src=None, path=None, lo=None, hi=None, shift=None, dest=None, text=None: (what, src, path, lo, hi, shift, dest, None, text, number)
        while left:
            node, dest = left.pop()
            number += 1
            if isinstance(node, tuple):
                yield row("whole", *node, dest=dest)
            elif isinstance(node, _Object):
                yield row("node", path=dest, text=OBJECT)
                left += [(x, f"{dest}/{t}") for t, x in node.own.items()]
                if node.base:
                    yield row("rest", *node.base, dest=dest)
                    for t in node.gone | node.own.keys():
                        yield row("except", text=t)
            else:
                yield row("node", path=dest, text=ARRAY)
                at = 0
                for item in (i for items, _ in node.leaves for i in items):
                    if len(item) == 1:
                        left.append((item[0], f"{dest}/{at}"))
                        at += 1
                    else:
                        src, path, a, b = item
                        yield row("run", src, path, a, b, at - a, dest)
                        at += b - a


def _fold(log: pa.Table, facts: pa.Table, key: str, on_error: str) -> pa.Table:
    out = pa.schema([log.schema.field(key), *_FIELDS])
    if not log.num_rows:
        return out.empty_table()
    known, tests = {}, defaultdict(list)
    for src, path, kind, value, n in zip(*(facts.column(c).to_pylist() for c in ("src", "path", "value_type", "value", "n")), strict=True):
        known[src, path] = None if kind is None else (kind, value, n)
        if src != _DOC:
            tests[src].append((path, kind, value, n))
    fold, done, stopped = _Fold(known), [], False
    for seq, op, path, source, has_value in zip(*(log.sort_by("seq").column(c).to_pylist() for c in ("seq", "op", "path", "source", "has_value")), strict=True):
        status = "not run" if stopped else fold.apply(op, path, source, seq, has_value, tests[seq] if op == "test" else [])
        stopped = stopped or (status != "ok" and on_error == "fail")
        done.append((seq, status))
    rows = [("need", src, path, *[None] * 7) for src, path in fold.needs]
    if not rows:
        rows = list(fold.places())
        rows += [("status", None, None, None, None, None, None, seq, status, None) for seq, status in done]
    owner = log.column(key).slice(0, 1).combine_chunks().take(pa.array([0] * len(rows), pa.int32()))
    return pa.table([owner, *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FIELDS, strict=True))], schema=out)


def _moved(nodes: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """(key, path, value, value_type) of nodes(key, src, path, ...) at their places. A node looks for a place only at
    those depths where its document has any. Elements look for their run by index: a run is its whole blocks of BLOCK
    elements and, at both ends, single ones, so each node meets what it lies in alone, however short runs are. Others look
    by shares, so that no branch of a document is hot; an edit's value fits a row and needs none."""
    depth = F.size(F.split("path", "/", -1)) - 1
    place = places.filter(F.col("what").isin("whole", "rest", "run")).withColumn("depth", depth).withColumn("runs", F.col("what") == "run")
    share = F.when(F.col("src") == _DOC, F.pmod(F.xxhash64("path"), F.lit(SHARES))).otherwise(0).cast("long")
    shares = F.when(F.col("src") == _DOC, F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    depths = place.groupBy(key, "src").agg(F.collect_set(F.struct("depth", "runs")).alias("_at")).withColumn("_share", F.explode(shares))
    # Whole blocks are numbered from -1 downwards, elements from 0 upwards.
    first, end = F.ceil(F.col("lo") / BLOCK), F.floor(F.col("hi") / BLOCK)
    span = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
    lo, hi = F.col("lo"), F.col("hi")
    cut = F.when(first < end, F.concat(span(lo, first * BLOCK), F.transform(span(first, end), lambda b: -b - 1), span(end * BLOCK, hi))).otherwise(span(lo, hi))
    place = place.select(key, "src", F.col("path").alias("anchor"), "runs", "what", "shift", "dest", "id", F.explode(F.when(F.col("runs"), cut).otherwise(shares)).alias("_block"))
    seen = nodes.withColumn("_share", share).join(depths, [key, "src", "_share"]).withColumn("_a", F.explode("_at"))
    seen = seen.withColumn("runs", F.col("_a.runs")).withColumn("anchor", F.expr("substring_index(path, '/', _a.depth + 1)"))
    seen = seen.filter((depth > F.col("_a.depth")) | ((depth == F.col("_a.depth")) & ~F.col("runs")))
    tail = F.substring(F.col("path"), F.length("anchor") + 1, F.length("path"))
    token = F.substring_index(F.substring(tail, F.lit(2), F.length("path")), "/", 1)
    seen = seen.withColumn("tail", tail).withColumn("token", token).withColumn("at", F.when(F.col("runs"), F.col("token").try_cast("long")))
    blocks = F.when(F.col("runs"), F.array(F.col("at"), -F.floor(F.col("at") / BLOCK) - 1)).otherwise(F.array(F.col("_share")))
    seen = seen.select(key, "src", "anchor", "runs", "tail", "token", "at", "value", "value_type", F.explode(blocks).alias("_block"))
    found = seen.join(place, [key, "src", "anchor", "runs", "_block"]).filter((F.col("what") != "rest") | (F.col("tail") != ""))
    gone = places.filter("what = 'except'").select(key, "id", F.col("text").alias("token"), F.lit("rest").alias("what"))
    found = found.join(gone, [key, "id", "token", "what"], "left_anti")
    behind = F.substring(F.col("tail"), F.length("token") + 2, F.length("tail"))
    new: Column = F.when(F.col("what") == "run", F.concat("dest", F.lit("/"), (F.col("at") + F.col("shift")).cast("string"), behind)).otherwise(F.concat("dest", "tail"))
    return found.select(key, new.alias("path"), "value", "value_type")


def apply_large_edits(tree: DataFrame, edits: DataFrame, key: str = "set_id", on_error: str = "skip") -> tuple[DataFrame, DataFrame]:
    """apply_edits for documents of any size: (key, path, value, value_type) after all edits in order of seq, and (key,
    seq, status). tree is a field tree (child_count is read), edits(key, seq from 1, op, path, value as JSON, from_path).

    A log meets in one task, a document never does: an insert into a long array is a few rows of places, and its elements
    are renumbered by a join. Parents that are missing become objects below an object alone; elsewhere such an add is
    missing. Null ops, paths or values are missing too. Nodes of edited documents are written once."""
    if on_error not in ("skip", "fail"):
        raise ValueError(on_error)
    spark = tree.sparkSession
    root = lambda c: F.when(F.col(c) == "/", "").otherwise(F.col(c))
    mark = lambda kind, value: F.when(kind == "object", OBJECT).when(kind == "array", ARRAY).otherwise(value)
    keys = edits.select(key).distinct()
    plain = tree.filter("path <> ''").select(key, "path", mark(F.col("value_type"), F.col("value")).alias("value"), "value_type", F.col("child_count").cast("long").alias("n"))
    docs = stash(plain.join(keys, key, "left_semi"), "edited-nodes")
    known = docs.groupBy(key).agg(F.count_if(~F.substring("path", 2, 1 << 30).contains("/")).alias("n"))
    log = edits.join(known, key, "left_semi").select(key, F.col("seq").cast("long").alias("seq"), "op", root("path").alias("path"), root("from_path").alias("source"), "value")
    log = stash(log, "edits")
    values = log.filter("value is not null").select(F.struct(F.col(key).alias("k"), F.col("seq").alias("s")).alias("_id"), F.col("value").alias("json"), "op")
    inner = trees.field_tree(values.select("_id", "json"), "_id", hide=False)
    parsed = F.to_json(F.parse_json("json"))
    kind = trees._kind(parsed)
    size = F.when(kind == "object", F.size(F.json_object_keys(parsed))).when(kind == "array", F.json_array_length(parsed)).otherwise(0).cast("long")
    tops = values.select("_id", F.lit("").alias("path"), mark(kind, parsed).alias("value"), kind.alias("value_type"), size.alias("n"))
    inner = inner.select("_id", "path", mark(F.col("value_type"), F.col("value")).alias("value"), "value_type", F.col("child_count").cast("long").alias("n")).unionByName(tops)
    inner = stash(inner.select(F.col("_id.k").alias(key), F.col("_id.s").alias("src"), "path", "value", "value_type", "n"), "edit-values")
    roots = known.select(key, F.lit(_DOC).cast("long").alias("src"), F.lit("").alias("path"), F.lit(OBJECT).alias("value"), F.lit("object").alias("value_type"), "n")
    nodes = docs.withColumn("src", F.lit(_DOC).cast("long")).unionByName(inner)
    schema = StructType([StructField(key, tree.schema[key].dataType), *StructType.fromDDL(_ROW).fields])
    steps = log.withColumn("has_value", F.col("value").isNotNull()).drop("value")
    # What most rounds would ask for first: the containers above the paths of the log, and members that no number names.
    pointers = steps.select(key, F.explode(F.array("path", "source")).alias("path")).filter("path like '/%'").withColumn("t", F.split("path", "/", -1))
    above = F.transform(F.sequence(F.lit(1), F.size("t") - F.when(F.element_at("t", -1).rlike("^[0-9]+$"), 1).otherwise(0)), lambda n: F.array_join(F.slice("t", F.lit(1), n), "/"))
    asked = pointers.select(key, F.lit(_DOC).cast("long").alias("src"), F.explode(above).alias("path")).distinct()
    known_places = docs.withColumn("src", F.lit(_DOC).cast("long")).unionByName(roots)
    tests = inner.join(log.filter("op = 'test'").select(key, F.col("seq").alias("src")), [key, "src"], "left_semi")
    facts = stash(tests.unionByName(asked.join(known_places, [key, "src", "path"], "left")), "edit-facts")
    pending, done = steps, []
    # Small logs are much work: so many partitions by name, which are not coalesced by their bytes.
    dealt = lambda t: t.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)
    while True:
        folded = dealt(pending).groupBy(key).cogroup(dealt(facts).groupBy(key)).applyInArrow(lambda a, b: _fold(a, b, key, on_error), schema)
        folded = stash(folded, "edit-places")
        needs = folded.filter("what = 'need'").select(key, "src", "path")
        done.append(folded.filter("what <> 'need'"))
        if needs.isEmpty():
            break
        new = needs.join(nodes.unionByName(roots), [key, "src", "path"], "left")
        open_keys = needs.select(key).distinct()
        facts = stash(facts.join(open_keys, key, "left_semi").unionByName(new), "edit-facts")
        pending = steps.join(open_keys, key, "left_semi")
    places = done[0]
    for more in done[1:]:
        places = places.unionByName(more)
    made = places.filter("what = 'node'").select(key, "path", F.col("text").alias("value"), F.when(F.col("text") == OBJECT, "object").otherwise("array").alias("value_type"))
    rest = plain.join(keys, key, "left_anti").select(key, "path", "value", "value_type")
    after = _moved(nodes, places, key).unionByName(made).filter("path <> ''").unionByName(rest)
    return after, places.filter("what = 'status'").select(key, "seq", F.col("text").alias("status"))
