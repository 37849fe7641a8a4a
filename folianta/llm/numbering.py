"""Places of rows in an order within their group, with no group sorted in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Tables


def met(a: DataFrame, b: DataFrame, on: dict[str, str], how: str = "inner") -> DataFrame:
    """Rows of a with the other columns of b where a's columns (keys of ``on``) equal b's; null equals null."""
    other = b.select(*(F.col(c).alias(f"{c}__") for c in b.columns))
    equal = reduce(Column.__and__, (F.col(x).eqNullSafe(F.col(f"{y}__")) for x, y in on.items()))
    return a.join(other, equal, how).select(*a.columns, *(F.col(f"{c}__").alias(c) for c in b.columns if c not in on.values()))


def numbered(rows: DataFrame, group: list[str], order: list[str], tables: Tables) -> DataFrame:
    """Adds ``nth`` (from 0, without gaps) and ``among`` (rows of the group) to a stored table.

    The rows are dealt out by ranges of (group, order), so a group of any size goes to as many tasks as it needs; rows in a task are counted as they lie, and only one count for a task
    and group is added up. ``order`` must tell rows apart, or a hot value lands in one range. Nulls come first, strings in the order of their bytes.
    """
    keys = [*group, *order]
    placed = tables.keep(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    counts = placed.groupBy("part", *group).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "part", *group, "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), F.sum("rows").over(Window.partitionBy(*group)).alias("among")
    )
    joined = met(placed, starts, {c: c for c in ("part", *group)})
    return joined.select(*rows.columns, (F.col("at") - F.col("first") + F.col("before")).alias("nth"), "among")
