"""Substring deduplication of words by level-wise doubling.

Windows that occur in two documents or more at one length alone are extended to twice that length, until the wanted width is reached (:func:`levels`; the last level overlaps its halves where it
is less than twice the one before) or nothing survives. At the first level a window of the wanted width is stood for by its anchor of :mod:`blockwise`; at each later one by the longer run of words
that the anchor's place grows to within the window. A window lives on only if that run is in two documents, so a level looks only at what the level before left. At the last level the run is the window:
its smallest document is found, and a word goes if a window that covers it also starts in a document with a smaller id. Windows are judged on the input, and copies within one document stay.

Blocks send the distinct runs that they hold, whether they hold them in two documents, and at the last level the smallest and largest of their documents, so a passage of a third of all documents is one
entry a block. Hashes have 64 bits.

Cases: a null or empty text has no words; texts shorter than the width keep all; rows with one doc_id are one document and rows without one come after all others; repeated rows each get a row; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blockwise as bw
from . import textcore as tc
from .shared import stored

WIDTH = 13
FIRST = 4


def levels(width: int, first: int = FIRST) -> list[int]:
    """Lengths of the levels: ``first``, twice as much each time, and ``width`` at last."""
    out = [min(first, width)]
    while out[-1] < width:
        out.append(min(2 * out[-1], width))
    return out


@dataclass
class Part:
    """Windows of a part of a block: the part's first row, words' documents and hashes, the places where living windows start and where their runs of the level do."""

    row: int
    doc: np.ndarray
    hashes: np.ndarray
    at: np.ndarray
    run: np.ndarray

    def distinct(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs, one for neighbouring windows with the same run, and for each window which of them is its own."""
        new = np.ones(len(self.run), bool)
        new[1:] = self.run[1:] != self.run[:-1]
        return tc.grams(self.hashes, self.doc, size)[0][self.run[new]], np.cumsum(new) - 1


def _living(texts: pa.Array, sizes: list[int], width: int, bits: np.ndarray) -> list[Part]:
    """A block's parts at the level ``sizes[-1]``; bits: the answers of the levels before, one after the other."""
    out = []
    for a, b, data, offs in tc.parts(texts):
        starts, ends, doc = tc.words(data, offs)
        hashes = tc.span_hashes(data, starts, ends)
        bounds = np.searchsorted(doc, np.arange(b - a + 1))
        begin, end, anchor = bw.anchor_runs(tc.grams(hashes, doc, sizes[0])[0], bounds, width, sizes[0])
        n = end - begin
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else begin
        out.append(Part(a, doc, hashes, at, np.repeat(anchor, n)))
    for size, longer in zip(sizes, sizes[1:], strict=False):
        sent = [(bw.short(h), which) for h, which in (p.distinct(size) for p in out)]
        known = np.unique(np.concatenate([np.zeros(0, np.uint64), *(v for v, _ in sent)]))
        own, bits = bits[: len(known)], bits[len(known) :]
        for p, (v, which) in zip(out, sent, strict=True):
            live = own[np.searchsorted(known, v)][which]
            p.at, p.run = p.at[live], p.run[live]
            p.run = np.minimum(p.run, p.at + width - longer)
    return out


def repeated_words(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each document."""
    sizes, n = levels(width), bw.n_buckets(docs)
    blocks = stored(bw.document_blocks(docs))

    def begin(batches):
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield candidates(block, blob, sizes[:1], np.zeros(0, bool))

    def grow(upto: int):
        def cut(own: pa.Table, replies: pa.Table) -> pa.Table:
            return pa.Table.from_batches([candidates(own.column("block")[0].as_py(), own.column("payload")[0], sizes[: upto + 1], bw.bits_in_order(replies))])

        return cut

    def candidates(block: int, blob: pa.Scalar, upto: list[int], bits: np.ndarray) -> pa.RecordBatch:
        _, ids, texts = bw.read_block(blob.as_py())
        found = _living(texts, upto, width, bits)
        hs, who = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for p in found:
            hashes, which = p.distinct(upto[-1])
            hs.append(hashes)
            who.append(ids[p.row + p.doc[p.at[np.searchsorted(which, np.arange(len(hashes)))]]])
        h, d = np.concatenate(hs), np.concatenate(who)
        if upto[-1] < width:
            v, many = bw.distinct(bw.short(h), d)
            return bw.by_bucket(block, v, 24, n, many)
        order = np.argsort(h)
        h, d = h[order], d[order]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        least, most = (np.minimum.reduceat(d, at), np.maximum.reduceat(d, at)) if len(h) else (d, d)
        return bw.by_bucket(block, h[at], 0, n, least, most)

    def smallest(table: pa.Table) -> pa.Table:
        sent = [bw.unpack(x.as_py()) for x in table.column("payload")]
        values = [bw.ungap(s[0]) for s in sent]
        every, least = np.concatenate(values), np.concatenate([s[1] for s in sent])
        order = np.argsort(every)
        v = every[order]
        new = np.concatenate([[True], v[1:] != v[:-1]])
        first = np.minimum.reduceat(least[order], np.flatnonzero(new))
        mine = np.empty(len(v), np.int64)
        mine[order] = first[np.cumsum(new) - 1]
        out, at = [], 0
        for x, s in zip(values, sent, strict=True):
            m = mine[at : at + len(x)]
            at += len(x)
            goes = m < s[2]
            out.append(bw.pack(x[goes], m[goes]))
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "payload": pa.array(out, pa.binary())})

    id_type = docs.schema["doc_id"].dataType

    def remove(own: pa.Table, replies: pa.Table) -> pa.Table:
        table, ids, texts = bw.read_block(own.column("payload")[0].as_py())
        sent = [bw.unpack(x.as_py()) for x in replies.column("payload")]
        h = np.concatenate([np.zeros(0, np.uint64), *(s[0] for s in sent)])
        least = np.concatenate([np.zeros(0, np.int64), *(s[1] for s in sent)])
        order = np.argsort(h)
        h, least = h[order], least[order]
        n_words, n_removed, digest = [], [], []
        for a, b, data, offs in tc.parts(texts):
            starts, ends, doc = tc.words(data, offs)
            whole, one = tc.grams(tc.span_hashes(data, starts, ends), doc, width)
            gone = np.zeros(len(starts), bool)
            if len(h) and len(whole):
                at = np.minimum(np.searchsorted(h, whole), len(h) - 1)
                hit = np.flatnonzero(one & (h[at] == whole) & (least[at] < ids[a + doc[: len(whole)]]))
                gone = tc.covered(hit, width, len(starts))
            bounds = np.searchsorted(doc, np.arange(b - a + 1))
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[bounds])
            for i in range(b - a):
                x, y = bounds[i], bounds[i + 1]
                text = data[offs[i] : offs[i + 1]].tobytes()
                ws = text.split()
                if removed[i]:
                    ws = [w for w, g in zip(ws, gone[x:y].tolist(), strict=True) if not g]
                digest.append(hashlib.sha256(b" ".join(ws)).hexdigest())
            n_words.append(np.diff(bounds))
            n_removed.append(removed)
        return pa.table({"doc_id": table.column("doc_id"), "n_words": np.concatenate(n_words), "n_removed": np.concatenate(n_removed), "kept_sha256": digest})

    kind = T.StructType([T.StructField("doc_id", id_type), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    found, replies = blocks.mapInArrow(begin, bw.ROWS), None
    for i in range(1, len(sizes)):
        answer = bw.repeated_grams(found).withColumn("bucket", F.col("bucket") + (i - 1) * n)
        replies = answer if replies is None else replies.union(answer)
        found = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(grow(i), bw.ROWS)
    answers = found.groupBy("bucket").applyInArrow(smallest, bw.ROWS)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(remove, kind)
