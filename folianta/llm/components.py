"""Connected components of edge tables, with every round written to the shared folder.

Every step is a grouped minimum and a join on the node, so a node with very many neighbours is pre-aggregated where its edges lie, and a join on it may be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    near = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", tables: Tables | None = None) -> DataFrame:
    """(node, root): the least node of each linked node's component; the roots themselves have no row. Edges between a node and itself and repeated edges do nothing.

    Alternating large-star and small-star steps; the number of rounds grows with the logarithm of the longest chain.
    """
    tables = tables or Tables(edges.sparkSession)
    now = tables.keep(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = None
    while True:
        said = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if said == mark or not said[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark, old = said, now
        now = tables.keep(_small_star(_large_star(now)))
        tables.drop(old)


def forest_roots(edges: DataFrame, tables: Tables) -> DataFrame:
    """(node, root) of edges (a, b, weight) from b up to a, whose ``weight`` grows on every way up, so that they form no cycle. Roots have no row.

    Each node first follows its heaviest edge; halving these ways gives trees. Edges that lead from one tree to another are few by then and go through :func:`components`.
    """
    held = tables.keep(edges.groupBy(F.col("b").alias("node")).agg(F.max_by("a", F.struct("weight", "a")).alias("root")))
    moved = True
    while moved:
        up, old = held.select("node", "root"), held
        over = up.select(F.col("node").alias("root"), F.col("root").alias("_far"))
        held = tables.keep(up.join(over, "root", "left").select("node", F.coalesce("_far", "root").alias("root"), F.col("_far").isNotNull().alias("moved")))
        tables.drop(old)
        moved = bool(held.where("moved").take(1))
    up = held.select("node", "root")
    ends = edges.select("a", "b")
    for side in "ab":
        ends = ends.join(up.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
    last = components(ends.where("root_a <> root_b"), "root_a", "root_b", tables)
    linked = up.unionByName(last.select("node", F.col("node").alias("root")))
    return tables.keep(linked.join(last.select(F.col("node").alias("root"), F.col("root").alias("_last")), "root", "left").select("node", F.coalesce("_last", "root").alias("root")).where("node <> root"))
