"""Trees of tags (doc_id, id, parent_id, seq, role, alt, actual_text), whole documents at a time: which rules they break and whether they are trees.

Tags are shuffled and sorted once; ids become numbers of nodes, and a task goes up or down one level of all its documents in one step. A task holds a batch and one document, some hundred bytes a tag.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import grouped
from .trees import TAG_DEPTH

# Roles that may stand in lists, tables and rows.
ITEM_PARTS, TABLE_PARTS, ROW_PARTS = ("Lbl", "LBody"), ("TR", "THead", "TBody", "TFoot", "Caption"), ("TH", "TD")
RULES = ("heading-nesting", "list-items", "list-bodies", "table-rows", "table-cells", "table-headers", "nested-alt", "other-alt")


def _said(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.not_equal(texts, ""), False).to_numpy(zero_copy_only=False)


def _ups(child: np.ndarray, parent: np.ndarray, nodes: int, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Nodes with their ancestors, one distance after another up to ``depth`` - 1. An id that occurs again may have several parents."""
    edge = np.unique(child * nodes + parent)
    child, parent = edge // nodes, edge % nodes
    first = np.searchsorted(child, np.arange(nodes + 1))
    node, at = child, parent
    for _ in range(1, depth):
        if not len(node):
            return
        yield node, at
        n = first[at + 1] - first[at]
        node = np.repeat(node, n)
        at = parent[np.arange(len(node)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at], n)]
        if len(edge) > np.count_nonzero(np.diff(first)):
            pairs = np.unique(node * nodes + at)
            node, at = pairs // nodes, pairs % nodes


def _broken(doc: np.ndarray, node: np.ndarray, parent: np.ndarray, hangs: np.ndarray, docs: int, nodes: int, depth: int) -> np.ndarray:
    """Documents with more than ``depth`` levels, or with nodes in a cycle, as :func:`trees.levels` has them. ``hangs`` marks rows that have a parent, which may not be there (-1)."""
    deep, reached, level, d = np.zeros(docs, bool), np.zeros(nodes + 1, bool), np.zeros(nodes + 1, bool), 0
    level[node[~hangs]] = True
    rest = np.flatnonzero(hangs & (parent >= 0))
    while True:
        level[-1] = False
        reached |= level
        rows = rest[level[parent[rest]]]
        if not len(rows):
            break
        d += 1
        if d > depth:
            deep[doc[rows]] = True
            break
        level = np.zeros(nodes + 1, bool)
        level[node[rows]] = True
    left = np.flatnonzero(hangs & ~reached[node] & ~deep[doc])
    while True:
        there = np.zeros(nodes + 1, bool)
        there[node[left]] = True
        there[-1] = False
        kept = left[there[parent[left]]]
        if len(kept) == len(left):
            break
        left = kept
    deep[doc[left]] = True
    return deep


def looked_at(tags: DataFrame, depth: int = TAG_DEPTH) -> DataFrame:
    """(doc_id, tags, bare, broken, and a column for each of ``RULES``): of every document how many tags there are and how many break each rule, whether some have no role, and whether it has too many levels or nodes in a cycle."""
    schema = T.StructType([tags.schema["doc_id"], T.StructField("tags", T.LongType()), T.StructField("bare", T.BooleanType()), T.StructField("broken", T.BooleanType()), *(T.StructField(r, T.LongType()) for r in RULES)])

    def look(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names, starts = grouped.runs(b.column("doc_id"))
        n, docs = b.num_rows, len(names)
        doc = np.repeat(np.arange(docs), np.diff(starts))
        ids = b.column("id")
        both = pa.concat_arrays([ids, b.column("parent_id").cast(ids.type)])
        hangs, known = ~b.column("parent_id").is_null().to_numpy(zero_copy_only=False), both.is_valid().to_numpy(zero_copy_only=False)
        code = pc.fill_null(both.dictionary_encode().indices, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        place = np.append(doc, doc) * (int(code.max()) + 1) + code
        nodes = np.unique(place[:n][known[:n]])
        at = np.minimum(np.searchsorted(nodes, place), max(len(nodes) - 1, 0))
        found = known & (nodes[at] == place) if len(nodes) else np.zeros(2 * n, bool)
        at = np.where(found, at, -1)
        node, parent, k = at[:n], at[n:], len(nodes)

        kinds = b.column("role").dictionary_encode()
        of = pc.fill_null(kinds.indices, len(kinds.dictionary)).to_numpy(zero_copy_only=False)
        role = lambda *allowed: np.append(np.isin(np.array(kinds.dictionary.to_pylist(), object), allowed), False)[of]
        named = of < len(kinds.dictionary)
        bare = np.append(np.array([not r.strip(" ") for r in kinds.dictionary.to_pylist()], bool), True)[of]
        level = np.append(np.array([int(r[1]) if len(r) == 2 and r[0] == "H" and r[1] in "123456" else 0 for r in kinds.dictionary.to_pylist()], np.int64), 0)[of]
        said = _said(b.column("alt"))

        kid = np.flatnonzero((parent >= 0) & named)
        count = lambda which: np.append(np.bincount(parent[kid][which[kid]], minlength=k), 0)[node]
        none = count(named) == 0
        other = lambda *allowed: count(~role(*allowed)) > 0
        ever = lambda which: np.bincount(node[which & (node >= 0)], minlength=k) > 0
        tables, heads, alts = ever(role("Table")), ever(role("TH")), ever(said)
        nested, headed = np.zeros(k + 1, bool), np.zeros(k + 1, bool)
        edge = (node >= 0) & (parent >= 0)
        for low, high in _ups(node[edge], parent[edge], max(k, 1), depth):
            nested[low[alts[high]]] = True
            hit = heads[low] & tables[high]
            headed[high[hit]] = True
            heads[low[hit]] = False
        nested[-1] = headed[-1] = False
        row = np.arange(n)
        last = np.append(-1, np.maximum.accumulate(np.where(level > 0, row, -1))[:-1])
        last = np.where(last >= starts[doc], level[last], 0)
        rules = (
            (level > 0) & (level > last + 1),
            role("L") & (none | other("LI")),
            role("LI") & ((count(role("LBody")) != 1) | other(*ITEM_PARTS)),
            role("Table") & (none | other(*TABLE_PARTS)),
            role("TR") & (none | other(*ROW_PARTS)),
            role("Table") & ~headed[node],
            said & nested[node],
            role("Formula") & ~said & ~_said(b.column("actual_text")),
        )
        broken = _broken(doc, node, parent, hangs, docs, k, depth)
        some = lambda which: np.add.reduceat(which.astype(np.int64), starts[:-1])
        yield pa.RecordBatch.from_arrays([names, pa.array(np.diff(starts)), pa.array(some(bare) > 0), pa.array(broken), *(pa.array(some(r)) for r in rules)], schema.names)

    return grouped.by_document(tags.select("doc_id", "id", "parent_id", "seq", "role", "alt", "actual_text"), look, schema, "seq")
