"""Comments: threads, review states, filters and batches, over (doc_id, seq, id, page, type, author, modified, text, reply_to, review_state)."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..tables import Tables, cut


def threads(comments: DataFrame) -> DataFrame:
    """Comments with root flag, replies and status: the last state in document order among a comment's replies. A reply to a comment that isn't there is a root."""
    parents = comments.select("doc_id", F.col("id").alias("reply_to"), F.lit(True).alias("_there"))
    linked = comments.join(parents, ["doc_id", "reply_to"], "left")
    below = linked.where("_there").groupBy("doc_id", F.col("reply_to").alias("id")).agg(F.count(F.lit(1)).alias("replies"), F.max_by("review_state", F.when(F.col("review_state").isNotNull(), F.col("seq"))).alias("status"))
    return linked.join(below, ["doc_id", "id"], "left").withColumn("is_root", F.col("_there").isNull()).withColumn("replies", F.coalesce("replies", F.lit(0))).drop("_there")


def latest_state(comments: DataFrame) -> DataFrame:
    """(doc_id, id, state): of a comment's replies with a state the newest by time; undated ones are oldest, ties go to the later entry."""
    states = comments.where("reply_to is not null and review_state is not null")
    order = F.struct(F.col("modified").isNotNull().alias("dated"), F.col("modified"), F.col("seq"))
    return states.groupBy("doc_id", F.col("reply_to").alias("id")).agg(F.max_by("review_state", order).alias("state"))


def flat_threads(comments: DataFrame, depth: int | None = None) -> DataFrame:
    """Threads in pre-order: each comment with its depth and a sortable path. One join a level, each computed once, until a level has no rows or down to ``depth``; what hangs in a cycle has no root and is
    left out."""
    key = lambda seq: tx.padded(seq, 10)
    parents = comments.select("doc_id", F.col("id").alias("reply_to"), F.lit(True).alias("_there"))
    marked = comments.join(parents, ["doc_id", "reply_to"], "left")
    level = cut(marked.where("_there is null").drop("_there").withColumn("depth", F.lit(0)).withColumn("path", key(F.col("seq"))))
    out, rest = level, cut(marked.where("_there").drop("_there"))
    for d in count(1) if depth is None else range(1, depth + 1):
        up = level.select("doc_id", F.col("id").alias("reply_to"), F.col("path").alias("_up"))
        level = rest.join(up, ["doc_id", "reply_to"]).withColumn("depth", F.lit(d)).withColumn("path", F.concat("_up", F.lit("/"), key(F.col("seq")))).drop("_up")
        level = cut(level)
        if not level.take(1):
            break
        out = out.unionByName(level)
    return out


def with_ancestors(hits: DataFrame, tree: DataFrame) -> DataFrame:
    """(doc_id, id, is_hit): rows that match and all above them, in a tree of (doc_id, id, parent_id). Levels are followed until nothing new is above."""
    tables = Tables(tree.sparkSession)
    edges = tree.select("doc_id", "id", "parent_id")
    level = tables.keep(hits.select("doc_id", "id").distinct().join(edges, ["doc_id", "id"]))
    found = out = level.select("doc_id", "id")
    out = out.withColumn("hit", F.lit(1))
    while level.take(1):
        up = level.where("parent_id is not null").select("doc_id", F.col("parent_id").alias("id")).distinct()
        level = tables.keep(up.join(found, ["doc_id", "id"], "left_anti").join(edges, ["doc_id", "id"]))
        found = found.unionByName(level.select("doc_id", "id"))
        out = out.unionByName(level.select("doc_id", "id", F.lit(0).alias("hit")))
    return out.groupBy("doc_id", "id").agg((F.max("hit") == 1).alias("is_hit"))


def review_filter(comments: DataFrame, query: str = "", author: str | None = None, type_: str | None = None, status: str | None = None) -> Column:
    """A predicate over comments with a ``state`` column; `none` as status means without a state."""
    keep = F.lit(True)
    if query:
        keep = keep & F.contains(F.lower("text"), F.lit(query.lower()))
    if author is not None:
        keep = keep & (F.col("author") == author)
    if type_ is not None:
        keep = keep & (F.col("type") == type_)
    if status is not None:
        keep = keep & (F.col("state").isNull() if status == "none" else F.col("state").eqNullSafe(F.lit(status)))
    return keep


def sort_comments(comments: DataFrame, by: str = "page") -> DataFrame:
    """By page, author (blank last, in the order of the language) or date (newest first, undated last)."""
    blank = F.coalesce(F.trim("author"), F.lit("")) == ""
    keys = {"page": ["doc_id", "page", "seq"], "author": [blank, F.collate("author", "UNICODE"), "doc_id", "seq"], "date": [F.col("modified").desc_nulls_last(), "doc_id", "seq"]}
    return comments.orderBy(*keys[by])


def upsert(target: DataFrame, source: DataFrame, last_page: DataFrame) -> DataFrame:
    """Imports comments: those of the same name on the page are replaced, redactions and pages beyond the target's stay out. ``last_page``: (doc_id, pages)."""
    fits = source.where("type <> 'Redact'").join(last_page, "doc_id").where("page between 1 and pages").drop("pages")
    return target.join(fits.select("doc_id", "page", "id"), ["doc_id", "page", "id"], "left_anti").unionByName(fits)


def summary_csv(flat: DataFrame) -> DataFrame:
    """(doc_id, path, line) of a comment summary; replies are typed Reply."""
    kind = F.when(F.col("depth") > 0, "Reply").otherwise(F.col("type"))
    cells = [F.col("page").cast("string"), kind, F.coalesce("author", F.lit("")), F.coalesce(F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("")), F.coalesce("text", F.lit(""))]
    return flat.select("doc_id", "path", F.concat_ws(",", *[tx.csv_field(c) for c in cells]).alias("line"))

