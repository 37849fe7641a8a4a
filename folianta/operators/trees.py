"""Trees as adjacency lists (doc_id, id, parent_id): depths, paths, filters and reachability, one join a level, each written before the next, until a level has no rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import Tables

#: Levels at which outlines and structure trees are refused.
OUTLINE_DEPTH, TAG_DEPTH = 32, 128


def levels(tree: DataFrame, depth: int | None = None, strict: bool = True) -> DataFrame:
    """Adds depth (roots 0) to nodes under a root; nodes whose parent isn't there are left out.

    More than ``depth`` levels are an error, and so are nodes that hang in a cycle. With ``strict`` it is raised; else ``error`` is added and says so on every row of that document, of which
    the nodes within the limit and outside cycles stay, and other documents are left as they are.
    """
    tables = Tables(tree.sparkSession)
    level = tables.keep(tree.where("parent_id is null").withColumn("depth", F.lit(0)))
    out, rest, d, deep = level, tables.keep(tree.where("parent_id is not null")), 0, None
    while level.take(1):
        d += 1
        up = level.select("doc_id", F.col("id").alias("parent_id"))
        level = tables.keep(rest.join(up, ["doc_id", "parent_id"]).select(*tree.columns).withColumn("depth", F.lit(d)))
        if depth is not None and d > depth and level.take(1):
            if strict:
                raise ValueError(f"more than {depth} levels")
            deep = level.select("doc_id").distinct()
            break
        out = out.unionByName(level)
    left = tables.keep(rest.join(out.select("doc_id", "id"), ["doc_id", "id"], "left_anti"))
    if deep is not None:
        left = tables.keep(left.join(deep, "doc_id", "left_anti"))
    while left.take(1):
        held = tables.keep(left.join(left.select("doc_id", F.col("id").alias("parent_id")).distinct(), ["doc_id", "parent_id"], "left_semi").select(*tree.columns))
        if held.count() == left.count():
            if strict:
                raise ValueError("nodes hang in a cycle")
            break
        left = held
    if strict:
        return out
    errors = left.select("doc_id").distinct().withColumn("error", F.lit("nodes hang in a cycle"))
    if deep is not None:
        errors = errors.unionByName(deep.withColumn("error", F.lit(f"more than {depth} levels")))
    return out.join(errors, "doc_id", "left").select(*out.columns, "error")


def walk(tree: DataFrame, place: str = "place") -> DataFrame:
    """Nodes that hang below a root, with ``path``: the places and ids from the root down. Paths sort as a walk meets the nodes: a node before its children, children by their places, equal places by id. Nodes in a cycle aren't met."""
    tables = Tables(tree.sparkSession)
    own = F.struct(F.col(place).alias("place"), F.col("id").alias("id"))
    level = tables.keep(tree.where("parent_id is null").withColumn("path", F.array(own)))
    rest, out = tables.keep(tree.where("parent_id is not null")), level
    while True:
        up = level.select("doc_id", F.col("id").alias("parent_id"), F.col("path").alias("_above"))
        level = tables.keep(rest.join(up, ["doc_id", "parent_id"]).select(*tree.columns, F.concat("_above", F.array(own)).alias("path")))
        if not level.take(1):
            return out
        out = out.unionByName(level)


def ancestors(tree: DataFrame, depth: int = TAG_DEPTH) -> DataFrame:
    """(doc_id, id, ancestor, distance, cut): every node with each node above it, up to ``depth`` - 1 levels away; ``cut`` marks documents that have more, as in a cycle."""
    tables = Tables(tree.sparkSession)
    edges = tables.keep(tree.where("parent_id is not null").select("doc_id", "id", F.col("parent_id").alias("ancestor")).join(tree.select("doc_id", F.col("id").alias("ancestor")), ["doc_id", "ancestor"], "left_semi").select("doc_id", "id", "ancestor"))
    level, d = edges.withColumn("distance", F.lit(1)), 1
    out, up = level, edges.select("doc_id", F.col("id").alias("_at"), F.col("ancestor").alias("_up"))
    while level.take(1):
        d += 1
        level = tables.keep(level.withColumnRenamed("ancestor", "_at").join(up, ["doc_id", "_at"]).select("doc_id", "id", F.col("_up").alias("ancestor"), F.lit(d).alias("distance")))
        if d >= depth:
            break
        out = out.unionByName(level)
    deep = level.select("doc_id").distinct().withColumn("cut", F.lit(True)) if d >= depth else None
    if deep is None:
        return out.withColumn("cut", F.lit(False))
    return out.join(deep, "doc_id", "left").select(*out.columns, F.coalesce("cut", F.lit(False)).alias("cut"))


def filtered(tree: DataFrame, hit) -> DataFrame:
    """(doc_id, id, is_hit): nodes for which ``hit`` (a predicate) holds and their ancestors."""
    from .comments import with_ancestors

    return with_ancestors(tree.where(hit), tree)


def nearest_above(nodes: DataFrame, levels_: int = 9) -> DataFrame:
    """Adds parent_seq: the last earlier heading (doc_id, seq, level) of a higher level. A running maximum for each level, no join."""
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    above = [F.when(F.col("level") > k, F.max(F.when(F.col("level") == k, F.col("seq"))).over(w)) for k in range(1, levels_)]
    return nodes.withColumn("parent_seq", F.greatest(*above))


def role_of(tags: DataFrame, role_map: DataFrame) -> DataFrame:
    """Adds standard_role: a tag's role followed through the role map (doc_id, role, to), which may chain, until no entry is left or a role comes again. Of two entries of one role the first ``to`` counts.

    A document's entries are followed once, in one list, which its tags are joined with.
    """

    @F.arrow_udf("map<string,string>")
    def ends(entries: pa.Array) -> pa.Array:
        out, known = [], {}
        for pairs in entries.to_pylist():
            key = tuple((p["role"], p["to"]) for p in pairs)
            if key not in known:
                to = dict(reversed(key))
                found = {}
                for role in to:
                    at, seen = role, {role}
                    while (then := to.get(at)) is not None and then not in seen:
                        seen.add(at := then)
                    found[role] = at
                if len(known) > 1_000:
                    known.clear()
                known[key] = list(found.items())
            out.append(known[key])
        return pa.array(out, pa.map_(pa.string(), pa.string()))

    entry = F.when(F.col("role").isNotNull() & F.col("to").isNotNull(), F.struct("role", "to"))
    maps = role_map.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("_entries")).select("doc_id", ends("_entries").alias("_ends"))
    joined = tags.join(maps, "doc_id", "left").withColumn("standard_role", F.coalesce(F.try_element_at("_ends", "role"), F.col("role")))
    return joined.select(*tags.columns, "standard_role")


def reachable(objects: DataFrame, references: DataFrame, roots: DataFrame) -> DataFrame:
    """Objects (doc_id, obj_id) that the roots reach by references (doc_id, obj_id, to), however far, renumbered from 1 in the old order. Each round follows only what is new."""
    tables = Tables(objects.sparkSession)
    edges = references.select("doc_id", "obj_id", "to")
    new = tables.keep(roots.select("doc_id", "obj_id").distinct())
    found = new
    while new.take(1):
        new = tables.keep(new.join(edges, ["doc_id", "obj_id"]).select("doc_id", F.col("to").alias("obj_id")).distinct().join(found, ["doc_id", "obj_id"], "left_anti"))
        found = found.unionByName(new)
    kept = objects.join(found, ["doc_id", "obj_id"], "left_semi")
    return kept.withColumn("new_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("obj_id")))


def tag_text(content: DataFrame) -> DataFrame:
    """(doc_id, page, mcid, text): text within marked content, from a stream (seq, op: begin, end or text; mcid, text). Text in nested content counts for the innermost."""
    w = Window.partitionBy("doc_id", "page").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    depth = F.sum(F.when(F.col("op") == "begin", 1).when(F.col("op") == "end", -1).otherwise(0)).over(w)
    rows = content.withColumn("_d", depth)
    owner = F.last(F.when(F.col("op") == "begin", F.col("mcid")), ignorenulls=True).over(Window.partitionBy("doc_id", "page", "_d").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    text = rows.withColumn("_m", owner).where("op = 'text' and _d > 0")
    return text.groupBy("doc_id", "page", F.col("_m").alias("mcid")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("text"))
