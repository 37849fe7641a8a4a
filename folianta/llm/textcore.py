"""Vectorised words and hashes over the UTF-8 buffers of Arrow string columns.

A *part* is a few whole documents side by side: their bytes, where each starts and ends, and the words in
them. Everything here is numpy over a part, with no loop over documents, words or bytes. A part holds
``PART_BYTES`` of text, or one longer document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PART_BYTES = 1_000_000
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_power = np.ones(1, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser in which each input bit reaches each output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _power
    if len(_power) < n:
        with np.errstate(over="ignore"):
            _power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1024), _BASE, np.uint64)]))
    return _power[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    n = len(column)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offs


def parts(column: pa.Array, limit: int = PART_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of each part of a column."""
    data, offs = buffers(column)
    n, a = len(offs) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def words(data: np.ndarray, offs: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (maximal runs of bytes that aren't ``white``, ASCII white space) and the document of each."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    ink = ~white[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    first = ink.copy()
    first[1:] &= ~ink[:-1] | edge[1:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, none of them empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = ends - starts
    total = int(n.sum())
    at = np.cumsum(n) - n
    rel = np.arange(total) - np.repeat(at, n)
    flat = data[rel + np.repeat(starts, n)].astype(np.uint64) + np.uint64(1)
    flat *= powers(int(n.max()) + 1)[rel]
    return mix64(np.add.reduceat(flat, at) + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def grams(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words, and whether all k are of one document; one for each word but the last k - 1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out = np.zeros(n, np.uint64)
    base = np.uint64(_BASE)
    for i in range(k):
        out *= base
        out += hashes[i : i + n]
    return mix64(out), doc[:n] == doc[k - 1 :]


def per_doc(doc: np.ndarray, n_docs: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights, minlength=n_docs)


def covered(starts: np.ndarray, width: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n places lie in a span that begins at one of the starts."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:-1]) > 0


def repeated_within(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which values (64-bit hashes) occur again in their own document."""
    n = len(values)
    if not n:
        return np.zeros(0, bool)
    key = values ^ mix64(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    v = key[order]
    same = np.zeros(n + 1, bool)
    same[1:-1] = v[1:] == v[:-1]
    out = np.zeros(n, bool)
    out[order] = same[:-1] | same[1:]
    return out
