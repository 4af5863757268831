"""An append-only log of edits by JSON pointer, applied to trees of path rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions import text as fx
from tributary.operators import tree as trees
from tributary.plans.scratch import stash

OBJECT, ARRAY = "{}", "[]"


def record_edit(log: DataFrame, new: DataFrame, key: str = "set_id") -> DataFrame:
    """log plus the edits of new(key, who, when, op, path, value, from_path, reason), numbered on from each set's last
    seq, in order of when; summaries are made by summarize_edits."""
    last = log.groupBy(key).agg(F.max("seq").alias("_last"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("when", "path", "op"))
    added = new.join(last, key, "left").withColumn("seq", (F.coalesce("_last", F.lit(0)) + nth).cast("long")).drop("_last")
    return log.unionByName(summarize_edits(added), allowMissingColumns=True)


def list_edits(log: DataFrame, set_id, key: str = "set_id") -> DataFrame:
    return log.filter(F.col(key) == F.lit(set_id)).orderBy("seq")


def undo(log: DataFrame, set_id, index: int | None = None, key: str = "set_id") -> DataFrame:
    """The log without a set's last edit, or its index-th (from 1); an index that isn't there is an error."""
    own = log.filter(F.col(key) == F.lit(set_id)).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("seq")))
    n = own.count()
    at = n if index is None else index
    if not 1 <= at <= n:
        raise IndexError(f"edit {at} of {n}")
    return log.filter(~F.coalesce(F.col(key) == F.lit(set_id), F.lit(False))).unionByName(own.filter(F.col("_n") != at).drop("_n"))


def _state(tree: DataFrame, key: str) -> DataFrame:
    """Per document a map of path to JSON; containers are {} or [], their children rows of their own."""
    mark = F.when(F.col("value_type") == "object", OBJECT).when(F.col("value_type") == "array", ARRAY).otherwise(F.col("value"))
    return tree.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("path", mark))).alias("m"))


def _under(m: Column, path: Column) -> Column:
    return F.map_filter(m, lambda k, _: (k == path) | k.startswith(F.concat(path, F.lit("/"))))


def _without(m: Column, path: Column) -> Column:
    return F.map_filter(m, lambda k, _: (k != path) & ~k.startswith(F.concat(path, F.lit("/"))))


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def _shift(m: Column, parent: Column, least: Column, by: int) -> Column:
    """Move the elements of an array from `least` on by one place."""

    def key(k: Column, _: Column) -> Column:
        rest = F.substring(k, F.length(parent) + 2, F.length(k))
        number = F.substring_index(rest, "/", 1)
        tail = F.substring(rest, F.length(number) + 1, F.length(rest))
        moved = F.concat(parent, F.lit("/"), (number.try_cast("int") + by).cast("string"), tail)
        return F.when(k.startswith(F.concat(parent, F.lit("/"))) & (number.try_cast("int") >= least), moved).otherwise(k)

    return F.transform_keys(m, key)


def _reroot(sub: Column, old: Column, new: Column) -> Column:
    return F.transform_keys(sub, lambda k, _: F.concat(new, F.substring(k, F.length(old) + 1, F.length(k))))


def _same(a: Column, b: Column) -> Column:
    return F.array_sort(F.map_entries(a)) == F.array_sort(F.map_entries(b))


def _remove(m: Column, path: Column) -> Column:
    """Delete a node; the elements of an array behind it close up."""
    parent, number = _parent(path), F.substring_index(path, "/", -1).try_cast("int")
    left = _without(m, path)
    return F.when(F.try_element_at(m, parent) == ARRAY, _shift(left, parent, number + 1, -1)).otherwise(left)


def _add(m: Column, path: Column, sub: Column) -> Column:
    """Put a subtree (its paths below "") at path: in an array it makes room, in an object it takes a key's place;
    missing parents become objects."""
    parent, number = _parent(path), F.substring_index(path, "/", -1).try_cast("int")
    room = F.when(F.try_element_at(m, parent) == ARRAY, _shift(m, parent, number, 1)).otherwise(_without(m, path))
    tokens = F.split(parent, "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda n: F.array_join(F.slice(tokens, 1, n), "/"))
    new = F.filter(above, lambda p: ~F.map_contains_key(room, p))
    room = F.map_concat(room, F.map_from_arrays(new, F.transform(new, lambda _: F.lit(OBJECT))))
    return F.map_concat(room, _reroot(sub, F.lit(""), path))


def _fits(m: Column, path: Column) -> Column:
    """Whether add can put a value at path: an array takes indexes up to its length."""
    parent, last = _parent(path), F.substring_index(path, "/", -1)
    length = F.size(F.map_filter(m, lambda k, _: k.startswith(F.concat(parent, F.lit("/"))) & ~F.substring(k, F.length(parent) + 2, F.length(k)).contains("/")))
    holder = F.try_element_at(m, parent)
    return F.when(holder == ARRAY, F.coalesce((last.try_cast("int") >= 0) & (last.try_cast("int") <= length), F.lit(False))).otherwise(holder.isNull() | (holder == OBJECT))


def apply_edits(tree: DataFrame, edits: DataFrame, key: str = "set_id", on_error: str = "skip") -> tuple[DataFrame, DataFrame]:
    """Apply all edits in order of seq, per document: (key, path, value, value_type) after them, and (key, seq,
    status): ok, missing (a path that isn't there or doesn't fit), failed (a test), or not run.

    edits(key, seq, op, path, value as JSON, from_path). on_error skip goes on after a bad edit, fail stops there. The
    fold is built-in expressions over a map of the document's nodes; for large documents see large_edits. Documents without edits stay as they are."""
    if on_error not in ("skip", "fail"):
        raise ValueError(on_error)
    root = lambda c: F.when(c == "/", "").otherwise(c)
    values = edits.filter("value is not null").select(key, "seq", F.struct(F.col(key).alias("k"), F.col("seq").alias("s")).alias("_id"), "value")
    below = trees.field_tree(values.select("_id", F.col("value").alias("json")), "_id", hide=False, piece=None)
    kind = trees._kind(F.to_json(F.parse_json("value")))
    top = values.select("_id", F.lit("").alias("path"), kind.alias("value_type"), F.to_json(F.parse_json("value")).alias("value"))
    subs = _state(below.select("_id", "path", "value_type", "value").unionByName(top), "_id").select(F.col("_id.k").alias(key), F.col("_id.s").alias("seq"), F.col("m").alias("sub"))
    pointer = (F.col("path") == "") | F.col("path").startswith("/")  # no other path is one
    steps = edits.join(subs, [key, "seq"], "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", F.when(pointer, F.col("op")).alias("op"), F.coalesce(root(F.col("path")), F.lit("\0")).alias("path"), root(F.col("from_path")).alias("source"), "sub")), lambda x, y: F.sign(x["seq"] - y["seq"]).cast("int")).alias("steps"))

    def step(s: Column, e: Column) -> Column:
        m, op, path, sub = s["m"], e["op"], e["path"], e["sub"]
        has = F.map_contains_key(m, path) | (path == "")
        source = F.coalesce(e["source"], F.lit("\0"))
        moved = _reroot(_under(m, source), source, F.lit(""))
        after = (
            F.when(op.isin("add", "replace") & (path == ""), sub).when(op == "add", _add(m, path, sub)).when(op == "remove", _remove(m, path))
            .when(op == "replace", F.map_concat(_without(m, path), _reroot(sub, F.lit(""), path))).when(op == "copy", _add(m, path, moved)).when(op == "move", _add(_remove(m, source), path, moved)).otherwise(m)
        )
        holds = F.map_contains_key(m, source)
        good = (
            F.when(op == "add", sub.isNotNull() & ((path == "") | _fits(m, path))).when(op == "remove", has & (path != "")).when(op == "replace", has & sub.isNotNull())
            .when(op == "copy", holds & _fits(m, path)).when(op == "move", holds & ~path.startswith(F.concat(source, F.lit("/"))) & _fits(_remove(m, source), path)).when(op == "test", has).otherwise(False)
        )
        equal = _same(F.transform_keys(F.when(path == "", m).otherwise(_under(m, path)), lambda k, _: F.substring(k, F.length(path) + 1, F.length(k))), F.coalesce(sub, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
        status = F.when(s["stopped"], "not run").when(~F.coalesce(good, F.lit(False)), "missing").when((op == "test") & ~equal, "failed").otherwise("ok")
        result = F.struct(F.when(status == "ok", after).otherwise(m).alias("m"), F.concat(s["status"], F.array(F.struct(e["seq"].alias("seq"), status.alias("status")))).alias("status"), (s["stopped"] | ((status != "ok") & F.lit(on_error == "fail"))).alias("stopped"))
        return result

    docs = _state(tree.filter("path <> ''"), key).withColumn("m", F.map_concat("m", F.create_map(F.lit(""), F.lit(OBJECT))))
    start = F.struct(F.col("m"), F.array().cast("array<struct<seq:bigint,status:string>>").alias("status"), F.lit(False).alias("stopped"))
    steps = steps.withColumn("steps", F.transform("steps", lambda e: F.struct(e["seq"].cast("long").alias("seq"), e["op"].alias("op"), e["path"].alias("path"), e["source"].alias("source"), e["sub"].alias("sub"))))
    done = docs.join(steps, key, "left").select(key, F.when(F.col("steps").isNull(), start).otherwise(F.aggregate("steps", start, step)).alias("s"))
    nodes = done.select(key, F.explode("s.m").alias("path", "value")).filter("path <> ''").withColumn("value_type", trees._kind(F.col("value")))
    return nodes, done.select(key, F.inline("s.status"))


def apply_keyed_edits(fields: DataFrame, edits: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """The path that scales: fields(keys, value) after replace and remove edits(keys, seq, op, value); the last edit of
    a key wins. One aggregate and one join; a key with most edits is combined before the shuffle."""
    last = edits.filter(F.col("op").isin("replace", "remove")).groupBy(*keys).agg(F.max_by(F.struct(F.col("op"), F.col(value).alias("v")), "seq").alias("_e"))
    out = fields.join(last, keys, "left").filter("_e is null or _e.op <> 'remove'")
    return out.withColumn(value, F.when(F.col("_e").isNotNull(), F.col("_e.v")).otherwise(F.col(value))).drop("_e")


def path_exists(edits: DataFrame, tree: DataFrame, key: str = "set_id") -> DataFrame:
    """Edits whose path is a node of their document."""
    return edits.join(tree.select(key, "path"), [key, "path"], "left_semi")


def value_at(edits: DataFrame, tree: DataFrame, key: str = "set_id") -> DataFrame:
    """Edits with old_value, the value at their path or null."""
    return edits.join(tree.select(key, "path", F.col("value").alias("old_value")), [key, "path"], "left")


def differing_branches(old: DataFrame, new: DataFrame, key: str = "set_id", levels: tuple[int, ...] = (2, 4)) -> tuple[DataFrame, DataFrame]:
    """The nodes of both field trees that lie in branches which differ, seen level by level: of a branch only the digest
    is shuffled, an exclusive or over the nodes of both trees, which is zero where they are the same (paths are unique;
    128 bits of hash). What is left, nodes above a level that are equal among them, grows with the changes."""
    for level in levels:
        branch = F.substring_index("path", "/", level + 1)
        node = [F.col("path"), F.col("value_type"), F.coalesce("value", F.lit(""))]
        both = old.select(key, "path", "value_type", "value").unionByName(new.select(key, "path", "value_type", "value"))
        digest = both.groupBy(key, branch.alias("_b")).agg(F.bit_xor(F.xxhash64(*node)).alias("x"), F.bit_xor(F.xxhash64(F.lit("second"), *node)).alias("y"))
        open_ = stash(digest.filter("x <> 0 or y <> 0").select(key, "_b"), "branches")
        kept = [t.withColumn("_b", branch).join(open_, [key, "_b"], "left_semi").drop("_b") for t in (old, new)]
        old, new = (stash(t, "branch-nodes") for t in kept)
    return old, new


def diff_to_edits(old: DataFrame, new: DataFrame, key: str = "set_id", levels: tuple[int, ...] = ()) -> DataFrame:
    """Edits (key, seq, op, path, value) that turn old into new; both are field trees with_json. Only the topmost
    change of a branch counts; lists are compared by index, and what is taken off them goes from the end. With levels,
    branches that are equal in both are left out before nodes are joined: for large trees with few changes."""
    old, new = differing_branches(old, new, key, levels)
    a = old.select(key, "path", F.col("value_type").alias("ta"), F.col("value").alias("va"), F.lit(1).alias("ia"))
    b = new.select(key, "path", F.col("value_type").alias("tb"), F.col("value").alias("vb"), F.col("json").alias("jb"), F.lit(1).alias("ib"))
    both = a.join(b, [key, "path"], "full_outer")
    changed = both.filter(F.col("ia").isNull() | F.col("ib").isNull() | (F.col("ta") != F.col("tb")) | ~F.col("va").eqNullSafe(F.col("vb")))
    parents = changed.select(F.col(key).alias("_k"), F.col("path").alias("_p"))
    top = changed.join(parents, (F.col(key) == F.col("_k")) & (_parent(F.col("path")) == F.col("_p")), "left_anti")
    op = F.when(F.col("ia").isNull(), "add").when(F.col("ib").isNull(), "remove").otherwise("replace")
    number = F.substring_index("path", "/", -1).try_cast("int")
    rank = F.when(op == "replace", 0).when(op == "remove", 1).otherwise(2)
    order = Window.partitionBy(key).orderBy(rank, _parent(F.col("path")), F.when(op == "remove", -number).otherwise(number), "path")
    return top.select(key, F.row_number().over(order).cast("long").alias("seq"), op.alias("op"), "path", F.when(op != "remove", F.col("jb")).alias("value"))


def verify_edits(old: DataFrame, new: DataFrame, edits: DataFrame, key: str = "set_id") -> DataFrame:
    """Keys of the documents that edits do not turn from old into new: nodes of both sides are counted against each
    other in one aggregate, so the edits are applied once."""
    got, _ = apply_edits(old, edits.withColumn("from_path", F.lit(None).cast("string")) if "from_path" not in edits.columns else edits, key)
    row = lambda t: t.select(key, "path", "value_type", F.when(~F.col("value_type").isin("object", "array"), F.col("value")).alias("value"))
    both = row(got).withColumn("_n", F.lit(1)).unionByName(row(new).withColumn("_n", F.lit(-1)))
    return both.groupBy(key, "path", "value_type", "value").agg(F.sum("_n").alias("_n")).filter("_n <> 0").select(key).distinct()


def edits_or_replacement(old: DataFrame, new: DataFrame, edits: DataFrame, whole: DataFrame, key: str = "set_id") -> DataFrame:
    """The edits of documents that they turn from old into new; for each other document one edit that replaces it by
    whole(key, json), the new text."""
    bad = stash(verify_edits(old, new, edits, key), "unverified")
    good = edits.join(bad, key, "left_anti").select(key, "seq", "op", "path", "value")
    texts = whole.join(bad, key, "left_semi").select(key, F.lit(1).cast("long").alias("seq"), F.lit("replace").alias("op"), F.lit("").alias("path"), F.col("json").alias("value"))
    return good.unionByName(texts)


def replace_documents(texts: DataFrame, edits: DataFrame, key: str = "set_id") -> DataFrame:
    """texts(key, text) after whole-document edits: a replace at / whose value is the new text; the last one wins."""
    last = edits.filter((F.col("op") == "replace") & F.col("path").isin("", "/")).groupBy(key).agg(F.max_by("value", "seq").alias("_v"))
    return texts.join(last, key, "left").withColumn("text", F.coalesce("_v", "text")).drop("_v")


def summarize_edits(edits: DataFrame, most: int = 400) -> DataFrame:
    """edits with a short summary; old_value is used where there is one."""
    old = F.col("old_value") if "old_value" in edits.columns else F.lit(None).cast("string")
    shown = lambda c: fx.preview(F.coalesce(c, F.lit("null")))
    whole = (F.col("op") == "replace") & F.col("path").isin("", "/")
    text = (
        F.when(whole, F.concat(F.lit("Replaced the document ("), F.length("value").cast("string"), F.lit(" characters)")))
        .when(F.col("op") == "replace", F.concat(shown(old), F.lit(" → "), shown(F.col("value")), F.lit(" at "), F.col("path")))
        .when(F.col("op") == "add", F.concat(F.lit("Added "), shown(F.col("value")), F.lit(" at "), F.col("path")))
        .when(F.col("op") == "remove", F.concat(F.lit("Removed "), F.when(old.isNotNull(), F.concat(shown(old), F.lit(" at "))).otherwise(""), F.col("path")))
        .when(F.col("op").isin("move", "copy"), F.concat(F.initcap("op"), F.lit(" "), F.col("from_path"), F.lit(" → "), F.col("path")))
        .otherwise(F.concat(F.lit("Tested "), F.col("path")))
    )
    return edits.withColumn("summary", fx.preview(text, most))
