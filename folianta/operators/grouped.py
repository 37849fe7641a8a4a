"""Rows dealt by document and sorted once, so that a task gets whole documents, many at a time, as Arrow batches. A task holds a batch and one document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def runs(keys: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different keys one after another, and where each begins (and the last ends)."""
    found = pc.run_end_encode(keys, run_end_type=pa.int64())
    return found.values, np.append(0, found.run_ends.to_numpy(zero_copy_only=False))


def whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The rows again, no key's in two batches."""
    held: list[pa.RecordBatch] = []

    def out(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sum(p.num_rows for p in parts):
            yield from pa.Table.from_batches(parts).combine_chunks().to_batches()

    for b in batches:
        if not b.num_rows:
            continue
        last = int(runs(b.column(key))[1][-2])
        if held and (last or not held[-1].column(key)[-1].equals(b.column(key)[0])):
            first = int(runs(b.column(key))[1][1]) if held[-1].column(key)[-1].equals(b.column(key)[0]) else 0
            yield from out([*held, b.slice(0, first)])
            held, b, last = [], b.slice(first), last - first
        if last > 0:
            yield b.slice(0, last)
            b = b.slice(last)
        held.append(b)
    yield from out(held)


def by_document(rows: DataFrame, look: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: T.StructType, *order: str, key: str = "doc_id") -> DataFrame:
    """What ``look`` makes of batches of whole documents, their rows in this order."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole(batches, key):
            yield from look(b)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(each, schema)
