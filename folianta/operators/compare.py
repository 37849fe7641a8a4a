"""Comparison of two versions of documents, page by page and text by text."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_PAGES = 500


def page_keys(pages: DataFrame) -> DataFrame:
    """Pages with a key of their size and text."""
    cols = [F.col(c).cast("string") for c in ("width", "height") if c in pages.columns]
    return pages.withColumn("key", F.sha2(F.concat_ws(":", *cols, F.col("text")), 256))


def common_rows(x: list, y: list) -> Iterator[tuple[int, int]]:
    """Places (i, j) of a longest common sequence of two lists; where leaving out an item of either list is as good, that of the first goes.

    The lengths for all suffixes of ``y`` fit in one whole number of as many bits for each suffix of ``x``, from which the next is made by a few operations on all bits at once. Of these
    numbers every square-root-th is kept and those between are made again when the walk gets there, so n and m items take n * m / 64 steps and sqrt(n) * m / 4 bytes.
    """
    n, m, every = len(x), len(y), isqrt(len(x)) + 1
    where: dict = {}
    for p, key in enumerate(reversed(y)):
        where.setdefault(key, []).append(p)
    full = (1 << m) - 1

    def before(bits: int, key) -> int:
        hit = 0
        for p in where.get(key, ()):
            hit |= 1 << p
        u = bits & hit
        return ((bits + u) | (bits - u)) & full if u else bits

    kept, bits = {n: full}, full
    for i in range(n - 1, -1, -1):
        bits = before(bits, x[i])
        if i % every == 0:
            kept[i] = bits
    rows: dict[int, int] = {}

    def length(i: int, j: int) -> int:
        low = (1 << (m - j)) - 1
        return (m - j) - (rows[i] & low).bit_count()

    i = j = 0
    while i < n and j < m:
        if i + 1 not in rows or i not in rows:
            end = min(n, (i // every + 1) * every)
            rows = {end: kept[end]}
            for k in range(end - 1, i - 1, -1):
                rows[k] = before(rows[k + 1], x[k])
        if x[i] == y[j]:
            yield i, j
            i, j = i + 1, j + 1
        elif length(i + 1, j) >= length(i, j + 1):
            i += 1
        else:
            j += 1


def align(before: DataFrame, after: DataFrame, by: str = "doc_id", limit: int | None = MAX_PAGES) -> DataFrame:
    """(by, before_page, after_page, status): equal pages are matched in order by the longest common sequence, the gaps between pair up as changed, and what is left is added or removed.

    Only page numbers and keys travel. A pair of documents of more than ``limit`` pages is an error (None: no limit); tens of thousands of pages take seconds and some megabytes.
    """

    def pair(x: list, y: list) -> Iterator[tuple[int | None, int | None, str]]:
        i = j = 0
        for p, q in [*common_rows(x, y), (len(x), len(y))]:
            both = min(p - i, q - j)
            for k in range(max(p - i, q - j)):
                yield (i + k if i + k < p else None), (j + k if j + k < q else None), "changed" if k < both else "removed" if p - i > both else "added"
            if p < len(x):
                yield p, q, "unchanged"
            i, j = p + 1, q + 1

    @F.arrow_udf("array<struct<before_page:int,after_page:int,status:string>>")
    def paired(before: pa.Array, after: pa.Array) -> pa.Array:
        ends, left, right, status = [0], [], [], []
        for a, b in zip(before, after, strict=True):
            (m, x), (n, y) = ((v.values.field("page").to_pylist(), v.values.field("key").to_pylist()) for v in (a, b))
            if limit is not None and max(len(x), len(y)) > limit:
                raise ValueError(f"more than {limit} pages")
            for p, q, s in pair(x, y):
                left.append(None if p is None else m[p])
                right.append(None if q is None else n[q])
                status.append(s)
            ends.append(len(status))
        fields = [pa.array(left, pa.int32()), pa.array(right, pa.int32()), pa.array(status, pa.string())]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["before_page", "after_page", "status"]))

    cut = lambda d, own: d.select(by, F.lit(own).alias("_own"), F.struct("page", "key").alias("_p"))
    of = lambda own: F.array_sort(F.collect_list(F.when(F.col("_own") == own, F.col("_p"))))
    sides = cut(before, True).unionByName(cut(after, False)).groupBy(by).agg(of(True).alias("_a"), of(False).alias("_b"))
    return sides.select(by, paired("_a", "_b").alias("_r")).select(by, F.inline("_r"))


def totals(aligned: DataFrame, by: str = "doc_id") -> DataFrame:
    return aligned.groupBy(by, "status").agg(F.count(F.lit(1)).alias("n"))


CHANGE = T.StructType([T.StructField(c, T.StringType()) for c in ("prefix", "removed", "added", "suffix")])


def _shared(a: str, b: str) -> int:
    """Length of the longest common beginning, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


@F.pandas_udf(CHANGE)
def text_change(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    """Struct (prefix, removed, added, suffix) of the one edit that turns a text into another."""
    rows = []
    for a, b in zip(before, after, strict=True):
        if a is None or b is None:
            rows.append((None, None, None, None))
            continue
        head = _shared(a, b)
        x, y = a[head:], b[head:]
        tail = _shared(x[::-1], y[::-1])
        rows.append((a[:head], x[: len(x) - tail], y[: len(y) - tail], x[len(x) - tail :]))
    return pd.DataFrame(rows, columns=CHANGE.names)


def shown(aligned: DataFrame, hide_unchanged: bool = True) -> DataFrame:
    return aligned.where("status <> 'unchanged'") if hide_unchanged else aligned


def listed(pairs: DataFrame, text: bool = True, visual: bool = True, only_changes: bool = False) -> DataFrame:
    """Pairs of pages (status, before_text, after_text) with their kind of change, of the kinds asked for. Added and removed pages always stay, unchanged ones unless only changes are wanted."""
    changed = F.col("status") == "changed"
    same = F.coalesce("before_text", F.lit("")) == F.coalesce("after_text", F.lit(""))
    rows = pairs.withColumn("kind", F.when(changed & same, "visual").when(changed, "text"))
    return rows.where(F.when(F.col("status") == "unchanged", not only_changes).when(F.col("kind") == "text", text).when(F.col("kind") == "visual", visual).otherwise(True))
