"""Substring deduplication of bytes by blockwise suffix sorting with a difference cover.

Which suffixes can share ``WIDTH`` bytes with one of another document is settled first, at the anchors of :mod:`blockwise`. The suffixes that are left travel with the bytes that they are compared on: a run of
neighbouring suffixes with one anchor goes to the anchor's bucket as one string. A bucket then sorts its suffixes, a slice of anchors at a time, so that memory is bounded:

* places are counted from the anchor, and those whose number modulo 7 lies in the difference cover {0, 1, 3} are the cover sample. Their ranks by 7, 14 and 28 bytes are computed once for the slice, each
  from the pairs of ranks before it;
* a suffix is sorted by the ranks of two sample places that together with at most three bytes before and after span all its ``WIDTH`` bytes, so that no tie, however long, is resolved byte by byte.

Neighbours in that order with equal keys agree in ``WIDTH`` bytes. The smallest document of each such run is the answer, and bytes go that a suffix covers which also starts in a smaller document.
Equal strings are one entry a block, and one in the bucket: copies are not sorted again and again.

Cases: a null text is empty; texts shorter than the width keep all; rows with one doc_id are one document and rows without one come after all others; repeated rows each get a row; an empty table gives no
rows; other columns are not looked at. Strings are the bytes of the UTF-8 form and may begin or end within a character.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import blockwise as bw
from . import textcore as tc
from .shared import stored

WIDTH, GRAM = 50, 16
COVER, PERIOD = (0, 1, 3), 7
#: Suffixes of a bucket that are sorted at a time, if one anchor has no more.
SLICE = 400_000
_SHIFT = 10 * PERIOD


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the 16 bytes from each place."""
    if len(data) < GRAM:
        return np.zeros(0, np.uint64)
    data = np.ascontiguousarray(data)
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).astype(np.uint64)
    return tc.mix64(eight[:-8] * np.uint64(0x9E3779B97F4A7C15) + (eight[8:] ^ (eight[8:] >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93))


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.uint64)


def suffix_classes(text: np.ndarray, starts: np.ndarray, place: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Class numbers, in suffix order, of the suffixes at ``starts`` of a text of strings: equal where the first ``width`` bytes are.

    ``place``: every byte's place counted from its string's anchor; only suffixes at one place are compared.
    """
    mod = np.mod(place + _SHIFT, PERIOD)
    sample = np.flatnonzero(np.isin(mod, COVER))
    index = np.cumsum(np.isin(mod, COVER)) - 1
    pad = np.concatenate([text, np.zeros(4 * PERIOD + 8, np.uint8)])
    rank = np.zeros(len(sample), np.uint64)
    for k in range(PERIOD):
        rank = (rank << np.uint64(8)) | pad[sample + k].astype(np.uint64)
    rank = _ranks(rank)
    for step in (PERIOD, 2 * PERIOD):
        there = sample + step
        inside = there < len(text)
        there = np.minimum(there, len(text) - 1)
        ok = inside & (sample[index[there]] == there)
        other = np.where(ok, rank[index[there]] + np.uint64(1), np.uint64(0))
        rank = _ranks((rank << np.uint64(32)) | other)
    to_next = np.array([min((c - m) % PERIOD for c in COVER) for m in range(PERIOD)])
    to_last = np.array([min((m - c) % PERIOD for c in COVER) for m in range(PERIOD)])
    head = to_next[mod[starts]]
    back = width - 4 * PERIOD
    second = starts + back - to_last[mod[starts + back]]
    pair = (rank[index[starts + head]] << np.uint64(32)) | rank[index[second]]
    ends = np.zeros(len(starts), np.uint64)
    for k in range(3):
        ends = (ends << np.uint64(8)) | np.where(k < head, pad[starts + k], 0).astype(np.uint64)
    for k in range(3):
        at = second + 4 * PERIOD + k
        ends = (ends << np.uint64(8)) | np.where(at < starts + width, pad[np.minimum(at, len(pad) - 1)], 0).astype(np.uint64)
    ends = (ends << np.uint64(8)) | (place[starts] + _SHIFT).astype(np.uint64)
    order = np.lexsort((ends, pair))
    p, e = pair[order], ends[order]
    new = np.concatenate([[False], (p[1:] != p[:-1]) | (e[1:] != e[:-1])])
    out = np.empty(len(starts), np.int64)
    out[order] = np.cumsum(new)
    return out


def smallest_documents(anchor: np.ndarray, left: np.ndarray, size: np.ndarray, least: np.ndarray, text: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """For strings sorted by anchor: the smallest document of each suffix of each string, side by side, and where each string's begin."""
    n = size - width + 1
    first = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    out = np.repeat(least, n)
    offs = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    group = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1], [True]])) if len(anchor) else np.zeros(1, np.int64)
    many = np.diff(group) > 1
    done = np.searchsorted(first[group[:-1]], np.arange(0, first[-1] + SLICE, SLICE)) if len(anchor) else []
    for x, y in zip(done[:-1], done[1:], strict=False):
        chosen = [np.arange(group[g], group[g + 1]) for g in range(x, y) if many[g]]
        if not chosen:
            continue
        some = np.concatenate(chosen)
        count = size[some]
        begin = np.cumsum(count) - count
        rel = np.arange(int(count.sum())) - np.repeat(begin, count)
        part = text[rel + np.repeat(offs[some], count)]
        place = rel - np.repeat(left[some].astype(np.int64), count)
        k = n[some]
        nth = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        starts = np.repeat(begin, k) + nth
        same = suffix_classes(part, starts, place, width)
        where = np.repeat(first[some], k) + nth
        low = np.full(int(same.max()) + 1, bw.LAST)
        np.minimum.at(low, same, out[where])
        out[where] = low[same]
    return out, first


def _runs(texts: pa.Array, ids: np.ndarray):
    """The block's text, its runs of suffixes (first, end, anchor) at places in it, their anchors' hashes and their documents' order numbers."""
    data, offs = tc.buffers(texts)
    base = offs[0] if len(offs) else 0
    data, offs = data[base : offs[-1]], offs - base
    out = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for a, _, part, own in tc.parts(texts):
        h = gram_hashes(part)
        begin, end, p = bw.anchor_runs(h, own, WIDTH, GRAM)
        doc = ids[a + np.searchsorted(own, begin, side="right") - 1]
        out.append((begin + offs[a], end + offs[a], p + offs[a], h[p], doc))
    return (data, offs, *(np.concatenate(x) for x in zip(*out, strict=True)))


def _strings(data, begin, end, p, h, doc, n):
    """Distinct strings of runs, in the order of buckets: (bucket, anchor, key, left, size, first run, least, most), and the string of each run."""
    anchor = tc.mix64(h)
    left, size = p - begin, end - begin + WIDTH - 1
    key = tc.mix64(tc.span_hashes(data, begin, begin + size) + (left * 128 + size).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) if len(begin) else np.zeros(0, np.uint64)
    order = np.lexsort((doc, key, anchor))
    if not len(order):
        return (np.zeros(0, np.int64), anchor, key, left, size, order, doc, doc), order
    k, a = key[order], anchor[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (a[1:] != a[:-1])])
    at = np.flatnonzero(new)
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    run = order[at]
    d = doc[order]
    return (bw.bucket_of(anchor[run], n), anchor[run], key[run], left[run], size[run], run, np.minimum.reduceat(d, at), np.maximum.reduceat(d, at)), of


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""
    n = bw.n_buckets(docs)
    blocks = stored(bw.document_blocks(docs))

    def anchors(batches):
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, ids, texts = bw.read_block(blob.as_py())
                _, _, _, _, _, h, doc = _runs(texts, ids)
                v, many = bw.distinct(bw.short(h), doc)
                yield bw.by_bucket(block, v, 24, n, many)

    def live_runs(own: pa.Table, bits: np.ndarray):
        table, ids, texts = bw.read_block(own.column("payload")[0].as_py())
        data, offs, begin, end, p, h, doc = _runs(texts, ids)
        t = bw.short(h)
        live = bits[np.searchsorted(np.unique(t), t)] if len(t) else np.zeros(0, bool)
        strings, of = _strings(data, begin[live], end[live], p[live], h[live], doc[live], n)
        return table, ids, data, offs, begin[live], end[live], doc[live], strings, of

    def send(own: pa.Table, replies: pa.Table) -> pa.Table:
        block = own.column("block")[0].as_py()
        bits = bw.bits_in_order(replies)
        _, _, data, _, begin, _, _, (bucket, anchor, key, left, size, run, least, most), _ = live_runs(own, bits)
        at = np.searchsorted(bucket, np.arange(n + 1))
        rows = [(-1 - block, bw.pack(np.packbits(bits), np.array([len(bits)])))]
        for b in np.flatnonzero(np.diff(at)):
            s = slice(at[b], at[b + 1])
            count = size[s]
            rel = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            text = data[rel + np.repeat(begin[run[s]], count)]
            rows.append((int(b), bw.pack(bw.gaps(anchor[s]), key[s], left[s].astype(np.uint8), count.astype(np.uint8), least[s], most[s], text)))
        return pa.table({"block": pa.array([block] * len(rows), pa.int64()), "bucket": pa.array([b for b, _ in rows], pa.int64()), "payload": pa.array([x for _, x in rows], pa.binary())})

    def sort_bucket(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return table
        sent = [bw.unpack(x.as_py()) for x in table.column("payload")]
        anchor = np.concatenate([bw.ungap(s[0]) for s in sent])
        key, left, size, least, most = (np.concatenate([s[i] for s in sent]) for i in range(1, 6))
        size = size.astype(np.int64)
        text = np.concatenate([s[6] for s in sent])
        offs = np.cumsum(size) - size
        order = np.lexsort((key, anchor))
        k, a = key[order], anchor[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (a[1:] != a[:-1])])
        at = np.flatnonzero(new)
        one = order[at]
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        count = size[one]
        rel = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        low, first = smallest_documents(anchor[one], left[one], count, np.minimum.reduceat(least[order], at), text[rel + np.repeat(offs[one], count)])
        cut = np.zeros(len(low), bool)
        cut[first[:-1]] = True
        cut[1:] |= low[1:] != low[:-1]
        run = np.flatnonzero(cut)
        stop = np.concatenate([run[1:], [len(low)]])
        per = np.searchsorted(run, first)
        out, done = [], 0
        for s in sent:
            m = len(s[1])
            mine = of[done : done + m]
            c = (per[1:] - per[:-1])[mine]
            string = np.repeat(np.arange(m), c)
            r = per[mine][string] + np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
            goes = low[run[r]] < most[done : done + m][string]
            r, string = r[goes], string[goes]
            base = first[mine[string]]
            out.append(bw.pack(string.astype(np.uint32), (run[r] - base).astype(np.uint8), (stop[r] - base).astype(np.uint8), low[run[r]]))
            done += m
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "payload": pa.array(out, pa.binary())})

    def remove(own: pa.Table, replies: pa.Table) -> pa.Table:
        buckets = replies.column("bucket").to_numpy()
        blobs = replies.column("payload")
        marks = np.flatnonzero(buckets < 0)
        bits = np.zeros(0, bool)
        if len(marks):
            raw, size = bw.unpack(blobs[int(marks[0])].as_py())
            bits = np.unpackbits(raw, count=int(size[0])).astype(bool)
        table, ids, data, offs, begin, end, doc, (bucket, *_), of = live_runs(own, bits)
        base = np.searchsorted(bucket, np.arange(n + 1))
        string, x, y, low = [], [], [], []
        for i in np.argsort(buckets, kind="stable"):
            if buckets[i] >= 0:
                s = bw.unpack(blobs[int(i)].as_py())
                string.append(s[0].astype(np.int64) + base[buckets[i]])
                x.append(s[1]), y.append(s[2]), low.append(s[3])
        edge = np.zeros(len(data) + 1, np.int32)
        if string and len(of):
            string, x, y, low = (np.concatenate(v) for v in (string, x, y, low))
            per = np.searchsorted(string, np.arange(len(bucket) + 1))
            c = (per[1:] - per[:-1])[of]
            which = np.repeat(np.arange(len(of)), c)
            r = per[of][which] + np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
            goes = low[r] < doc[which]
            which, r = which[goes], r[goes]
            np.add.at(edge, begin[which] + x[r], 1)
            np.add.at(edge, begin[which] + y[r] + WIDTH - 1, -1)
        np.cumsum(edge, out=edge)
        gone = edge[:-1] > 0
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[offs])
        head = gone.copy()
        head[1:] &= ~gone[:-1]
        head[offs[:-1][np.diff(offs) > 0]] |= gone[offs[:-1][np.diff(offs) > 0]]
        spans = np.diff(np.concatenate([[0], np.cumsum(head)])[offs])
        digest = [hashlib.sha256(data[p:q][~gone[p:q]] if r else data[p:q]).hexdigest() for p, q, r in zip(offs.tolist(), offs[1:].tolist(), removed.tolist(), strict=False)]
        return pa.table({"doc_id": table.column("doc_id"), "n_bytes": np.diff(offs), "n_removed": removed, "n_spans": spans, "kept_sha256": digest})

    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])
    live = bw.repeated_grams(blocks.mapInArrow(anchors, bw.ROWS))
    strings = blocks.groupBy("block").cogroup(live.groupBy("block")).applyInArrow(send, bw.ROWS)
    answers = strings.groupBy("bucket").applyInArrow(sort_bucket, bw.ROWS)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(remove, kind)
