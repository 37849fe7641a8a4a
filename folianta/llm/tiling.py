"""Benchmark decontamination by greedy string tiling.

Tokens are lower-cased runs of letters and digits (and of all bytes beyond ASCII). A document and a benchmark item that share a seed, ``MIN_TILE`` consecutive
tokens, are compared by greedy string tiling: the longest matches that do not overlap earlier ones are marked, again and again, down to tiles of ``MIN_TILE`` tokens; matches are found by running
Karp-Rabin over the parts of the document that seeds cover. The share of the item's tokens in tiles is its coverage, whatever the order of the tiles, so
reordered passages count; at ``COVERAGE`` or more the document is contaminated. What common seeds cover of an item bounds its coverage: items that can neither reach
``COVERAGE`` nor be covered most are not tiled, so a phrase in very many items costs one look a document.

The items' seeds go to the tasks in slices by item_id of about ``SLICE_BYTES`` at most; a benchmark beyond one slice is looked up slice
by slice, of which one at a time is gathered and sent; each reads the texts anew and writes only what it finds. Matches that lie within longer ones are never looked at, so words that repeat in item and text cost the
product of their numbers at most. item_id is an integer.

Cases: null or empty texts and items match nothing, nor do items of fewer than ``MIN_TILE`` tokens; repeated documents each get a row, repeated items count each; of
items with equal coverage the smallest item_id is named; an empty table on either side gives no rows, or no contaminated ones; other columns are carried
by :func:`clean_rows`.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore as tc
from .shared import Tables, small

MIN_TILE = 5
COVERAGE = 0.5
#: A benchmark up to this goes to the tasks whole, a larger one in slices of about half as much.
SLICE_BYTES = 16_000_000
SEPARATORS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_MOD, _RADIX = (1 << 61) - 1, 1_000_003


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of a part and their documents."""
    low = tc.LOWER[data]
    starts, ends, doc = tc.words(low, offs, SEPARATORS)
    return tc.span_hashes(low, starts, ends), doc


def _windows(seq: list[int], marked: list[bool], size: int):
    """(start, running Karp-Rabin hash) of each window of unmarked tokens."""
    drop = pow(_RADIX, size, _MOD)
    value = run = 0
    for i, x in enumerate(seq):
        if marked[i]:
            value = run = 0
            continue
        value = (value * _RADIX + x) % _MOD
        run += 1
        if run > size:
            value = (value - seq[i - size] * drop) % _MOD
        if run >= size:
            yield i - size + 1, value


def _matches(item: list[int], p_marked: list[bool], text: list[int], t_marked: list[bool], size: int) -> list[tuple[int, int, int]]:
    """(length, place in item, place in text) of the unmarked matches of ``size`` tokens or more that cannot be extended on either side; each pair of equal places is looked at once."""
    at = defaultdict(list)
    for j, h in _windows(text, t_marked, size):
        at[h].append(j)
    out = []
    for i, h in _windows(item, p_marked, size):
        for j in at.get(h, ()):
            if i and j and item[i - 1] == text[j - 1] and not p_marked[i - 1] and not t_marked[j - 1]:
                continue
            k = 0
            while i + k < len(item) and j + k < len(text) and item[i + k] == text[j + k] and not p_marked[i + k] and not t_marked[j + k]:
                k += 1
            if k >= size:
                out.append((k, i, j))
    return out


def tiles(item: list[int], text: list[int], least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in text, length), longest first. ``None`` tokens in the text match nothing."""
    p_marked, t_marked = [False] * len(item), [x is None for x in text]
    text = [0 if x is None else x for x in text]
    found, size = [], max(least, min(len(item), 32))
    while True:
        hidden = False
        for k, i, j in sorted(_matches(item, p_marked, text, t_marked, size), key=lambda m: (-m[0], m[1], m[2])):
            if any(p_marked[i : i + k]) or any(t_marked[j : j + k]):
                hidden = True
                continue
            p_marked[i : i + k] = t_marked[j : j + k] = [True] * k
            found.append((i, j, k))
        if hidden:
            continue
        if size == least:
            return found
        size = max(least, size // 2)


class Slice:
    """Benchmark items and their seeds, sorted, with a first test by 16 bits of the hash."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        hashes, doc = tokens(*tc.buffers(pa.array([t for _, t in items], pa.string())))
        self.ids = [i for i, _ in items]
        bounds = np.searchsorted(doc, np.arange(len(items) + 1))
        self.items = [[int(x) for x in hashes[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)]
        seeds, whole = tc.grams(hashes, doc, MIN_TILE)
        at = np.flatnonzero(whole)
        order = np.argsort(seeds[at], kind="stable")
        self.seeds, self.of, self.place = seeds[at][order], doc[at][order], (at - bounds[doc[at]])[order]
        ends = np.searchsorted(doc[at], np.arange(len(items) + 1))
        self.own = [seeds[at[x:y]] for x, y in zip(ends, ends[1:], strict=False)]
        self.size = np.diff(bounds)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.seeds & np.uint64(0xFFFF)).astype(np.int64)] = True

    def _bounds(self, doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, the most of it that tiles can cover) for documents and items with a common seed, the best first: no tile lies outside the item's tokens that common seeds cover."""
        order = np.lexsort((low, doc))
        doc, low, high = doc[order], low[order], high[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (low[1:] != low[:-1])
        doc, low, n = doc[new], low[new], (high - low)[new]
        at = np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)
        d, k, p = np.repeat(doc, n), self.of[at], self.place[at]
        order = np.lexsort((p, k, d))
        d, k, p = d[order], k[order], p[order]
        same = np.zeros(len(d), bool)
        same[:-1] = (d[1:] == d[:-1]) & (k[1:] == k[:-1])
        reach = np.full(len(d), MIN_TILE)
        reach[:-1] = np.where(same[:-1], np.minimum(p[1:] - p[:-1], MIN_TILE), MIN_TILE)
        heads = np.flatnonzero(np.concatenate([[True], ~same[:-1]])) if len(d) else np.zeros(0, np.int64)
        d, k, most = d[heads], k[heads], (np.add.reduceat(reach, heads) if len(heads) else np.zeros(0, np.int64))
        share = most / np.maximum(self.size[k], 1)
        order = np.lexsort((k, -share, d))
        return d[order], k[order], share[order]

    @staticmethod
    def _parts(hashes: np.ndarray, starts: list[int]) -> list[int | None]:
        """The tokens that seeds at these places cover, with a gap before each run."""
        text, last = [], -1
        for i in starts:
            if i > last:
                text.append(None)
            text += [int(x) for x in hashes[max(i, last) : i + MIN_TILE]]
            last = i + MIN_TILE
        return text

    def best(self, column: pa.Array) -> list[tuple]:
        """(best item, its coverage, its tokens in tiles, items at or above the threshold) of each text."""
        out = [(None, 0.0, 0, 0)] * len(column)
        if not len(self.seeds):
            return out
        for a, b, data, offs in tc.parts(column):
            hashes, doc = tokens(data, offs)
            seeds, whole = tc.grams(hashes, doc, MIN_TILE)
            at = np.flatnonzero(whole & self.maybe[(seeds & np.uint64(0xFFFF)).astype(np.int64)]) if len(seeds) else np.zeros(0, np.int64)
            low, high = np.searchsorted(self.seeds, seeds[at]), np.searchsorted(self.seeds, seeds[at], side="right")
            hit = high > low
            at, low, high = at[hit], low[hit], high[hit]
            of = doc[at]
            of_doc, item, most = self._bounds(of, low, high)
            firsts, texts = np.searchsorted(of_doc, np.arange(b - a + 1)), np.searchsorted(of, np.arange(b - a + 1))
            for d in np.flatnonzero(np.diff(firsts)).tolist():
                places = at[texts[d] : texts[d + 1]]
                own = seeds[places]
                for k, bound in zip(item[firsts[d] : firsts[d + 1]].tolist(), most[firsts[d] : firsts[d + 1]].tolist(), strict=True):
                    old = out[a + d]
                    if bound < COVERAGE and old[0] is not None and (bound < old[1] or (bound == old[1] and self.ids[k] >= old[0])):
                        break
                    n = sum(t[2] for t in tiles(self.items[k], self._parts(hashes, places[np.isin(own, self.own[k])].tolist())))
                    share = n / len(self.items[k])
                    better = old[0] is None or share > old[1] or (share == old[1] and self.ids[k] < old[0])
                    out[a + d] = (*((self.ids[k], share, n) if better else old[:3]), old[3] + (share >= COVERAGE))
        return out


def _n_slices(benchmark: DataFrame) -> int:
    """Into how many slices the items' bytes, each with one for its end, call for."""
    total = benchmark.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    return 1 if total <= SLICE_BYTES else 2 * -(-total // SLICE_BYTES)


def _slice(benchmark: DataFrame, i: int, n: int) -> Slice:
    """Slice i of n, gathered on its own: the driver holds one at a time."""
    ids = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    own = ids.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i)
    return Slice([tuple(r) for r in own.orderBy("item_id", "text").collect()])


FOUND = [T.StructField("item_id", T.LongType()), T.StructField("coverage", T.DoubleType()), T.StructField("n_covered", T.LongType()), T.StructField("n_items", T.LongType())]


def _findings(docs: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """doc_id, text hash and what slices of a large benchmark find, for documents that share a seed with an item: texts are read from the input for each slice, and only what is found is written."""
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"))
    kind, tables, parts = T.StructType([own.schema["doc_id"], T.StructField("_h", T.LongType()), *FOUND]), Tables(docs.sparkSession), []
    for i in range(n):
        shared = docs.sparkSession.sparkContext.broadcast(_slice(benchmark, i, n))

        def look(batches, shared=shared):
            for b in batches:
                best = shared.value.best(b.column(1))
                some = [k for k, x in enumerate(best) if x[0] is not None]
                columns = [pa.array([best[k][j] for k in some], t) for j, t in enumerate((pa.int64(), pa.float64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some, pa.int64())), b.column(2).take(pa.array(some, pa.int64())), *columns], kind.names)

        parts.append(tables.keep(own.mapInArrow(look, kind)))
        shared.destroy()
    every = reduce(DataFrame.unionByName, parts).dropDuplicates(["doc_id", "_h", "item_id"])
    best = F.max_by(F.struct("item_id", "coverage", "n_covered"), F.struct("coverage", -F.col("item_id"))).alias("_b")
    return tables.keep(every.groupBy("doc_id", "_h").agg(best, F.sum("n_items").alias("n_items")).select("doc_id", "_h", "_b.*", "n_items"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id (the item that the document covers most), coverage, n_covered, n_items (at or above the threshold), contaminated.

    With more than one slice one is sent out at a time, and what the slices find meets by doc_id and text.
    """
    n = _n_slices(benchmark)
    if n > 1:
        found = _findings(docs, benchmark, n).withColumnRenamed("doc_id", "_id").withColumnRenamed("_h", "_g")
        own = docs.select("doc_id", F.xxhash64("text").alias("_h"))
        rows = own.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_g")), "left")
        rows = rows.select("doc_id", "item_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_covered", "n_items")))
        return rows.withColumn("contaminated", F.col("n_items") > 0)
    shared = docs.sparkSession.sparkContext.broadcast(_slice(benchmark, 0, 1))
    kind = T.StructType([docs.schema["doc_id"], *FOUND])

    def look(batches):
        for b in batches:
            best = shared.value.best(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[j] for x in best], t) for j, t in enumerate((pa.int64(), pa.float64(), pa.int64(), pa.int64())))], kind.names)

    return docs.select("doc_id", "text").mapInArrow(look, kind).withColumn("contaminated", F.col("n_items") > 0)


def clean_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that aren't contaminated, with the input's columns. With more than one slice, texts meet the ids of contaminated documents only."""
    at, n = docs.columns.index("text"), _n_slices(benchmark)
    if n > 1:
        gone = small(_findings(docs, benchmark, n).where("n_items > 0").select(F.col("doc_id").alias("_id"), F.col("_h").alias("_g")), "_id")
        return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_g")), "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(_slice(benchmark, 0, 1))

    def keep(batches):
        for b in batches:
            yield b.filter(pa.array([not x[3] for x in shared.value.best(b.column(at))], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
