"""Repeated windows over sequences of symbols (bytes or words), found block by block and bucket by bucket.

Documents are packed into *blocks* of bounded size, stored once. A window is ``width`` symbols of one document. Of all the short runs of symbols (*grams*) in a window, the one with the least hash is its
anchor: equal windows have equal anchors at equal places, so a window can only repeat if its anchor's gram does. Blocks send the hashes of their anchors (a few hundredths of all places) to *buckets* by
hash; buckets answer each block with one bit an anchor, whether the gram is in two documents or more. What blocks send is distinct within the block, so a gram that is in a third of
all documents is one entry a block.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore as tc

BLOCK_BYTES = 12_000_000
BUCKET_BYTES = 8_000_000
LAST = np.iinfo(np.int64).max
ROWS = T.StructType([T.StructField("block", T.LongType()), T.StructField("bucket", T.LongType()), T.StructField("payload", T.BinaryType())])


def planes(a: np.ndarray) -> bytes:
    """An array's first bytes, then its second bytes, and so on: small numbers' upper bytes compress to nothing."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()


def from_planes(raw: bytes, kind: str | type, size: int, at: int = 0) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, size, at).reshape(kind.itemsize, -1).T).view(kind).ravel()


def pack(*arrays: np.ndarray, planar: bool = False) -> bytes:
    """Arrays side by side, each with the name of its type, compressed; ``planar`` ones as :func:`planes`, smaller but copied when they are read."""
    heads = b"".join(struct.pack("<2sq", a.dtype.str[1:].encode(), a.nbytes) for a in arrays)
    return zstandard.ZstdCompressor(1).compress(struct.pack("<?q", planar, len(arrays)) + heads + b"".join(planes(a) if planar else a.tobytes() for a in arrays))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (planar, n), at, out = struct.unpack_from("<?q", raw), 9, []
    heads = [struct.unpack_from("<2sq", raw, at + 10 * i) for i in range(n)]
    at += 10 * n
    for kind, size in heads:
        kind = np.dtype("<" + kind.decode())
        out.append(from_planes(raw, kind, size, at) if planar else np.frombuffer(raw, kind, size // kind.itemsize, at))
        at += size
    return out


def gaps(sorted_values: np.ndarray) -> np.ndarray:
    """Differences of sorted numbers, in 4 bytes where they fit."""
    d = np.diff(np.concatenate([np.zeros(1, np.uint64), sorted_values]))
    return d.astype(np.uint32) if not len(d) or d.max() < 2**32 else d


def ungap(d: np.ndarray) -> np.ndarray:
    return np.cumsum(d, dtype=np.uint64)


def n_buckets(docs: DataFrame) -> int:
    """Two for each shuffle partition, and one for each ``BUCKET_BYTES`` of text at least, so that a bucket does not grow with the input."""
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // BUCKET_BYTES))


def bucket_of(g: np.ndarray, n: int) -> np.ndarray:
    """Buckets in the order of the (well mixed) hashes."""
    return ((g >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def document_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, payload): whole documents (doc_id and text) of about ``block_bytes``, as one compressed Arrow stream."""

    def build(batches):
        task, seq, kept, size = TaskContext.get().partitionId(), 0, [], 0

        def row():
            table = pa.Table.from_batches(kept)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_table(table)
            blob = zstandard.ZstdCompressor(3).compress(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) | seq], pa.int64()), pa.array([blob], pa.binary())], ["block", "payload"])

        for batch in batches:
            _, offs = tc.buffers(batch.column(1))
            a = 0
            while a < len(batch):
                b = max(a + 1, int(np.searchsorted(offs, offs[a] + block_bytes - size, side="right")) - 1)
                kept.append(batch.slice(a, b - a))
                size += int(offs[b] - offs[a])
                a = b
                if size >= block_bytes * 0.8:
                    yield row()
                    seq, kept, size = seq + 1, [], 0
        if kept:
            yield row()

    return docs.select("doc_id", "text").mapInArrow(build, "block long, payload binary")


def read_block(blob: bytes) -> tuple[pa.Table, np.ndarray, pa.Array]:
    """The block's rows, its documents' ids as order numbers (null: after all others) and its texts."""
    table = pa.ipc.open_stream(pa.BufferReader(zstandard.ZstdDecompressor().decompress(blob))).read_all()
    ids = table.column("doc_id").combine_chunks().cast(pa.int64())
    return table, ids.fill_null(LAST).to_numpy(zero_copy_only=False), table.column("text").combine_chunks()


def slide(op, x: np.ndarray, w: int) -> np.ndarray:
    """op over every w consecutive values, by doubling."""
    k, y = 1, x
    while 2 * k <= w:
        y = op(y[:-k], y[k:])
        k *= 2
    return op(y[: len(y) - (w - k)], y[w - k :]) if k < w else y


def anchor_runs(h: np.ndarray, offs: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, end window, anchor's place) of each run of windows with one anchor.

    h: hashes of the grams, by place; offs: where documents begin and end.
    """
    w = width - gram + 1
    none = np.zeros(0, np.int64)
    if len(h) < w:
        return none, none, none
    h = np.maximum(h, np.uint64(1))
    least = slide(np.minimum, h, w)
    edge = np.zeros(len(least) + 1, np.int32)
    fits = np.flatnonzero(np.diff(offs) >= width)
    edge[offs[fits]] += 1
    edge[offs[fits + 1] - width + 1] -= 1
    valid = np.cumsum(edge[:-1]) > 0
    least[~valid] = 0
    pad = np.zeros(w - 1, np.uint64)
    chosen = np.flatnonzero(slide(np.maximum, np.concatenate([pad, least, pad]), w) == h)
    if not len(chosen):
        return none, none, none
    new = valid.copy()
    own = np.zeros(len(h), bool)
    own[chosen] = True
    new[1:] &= (least[1:] != least[:-1]) | (own[: len(least) - 1] & (h[: len(least) - 1] == least[:-1]))
    begin = np.flatnonzero(new)
    stop = np.flatnonzero(~valid | new)
    end = np.concatenate([stop, [len(least)]])[np.searchsorted(stop, begin, side="right")]
    j = np.searchsorted(chosen, begin)
    open_ = np.arange(len(begin))
    while len(open_):
        open_ = open_[h[chosen[j[open_]]] != least[begin[open_]]]
        j[open_] += 1
    return begin, end, chosen[j]


def short(h: np.ndarray) -> np.ndarray:
    """40 bits of an anchor's hash, mixed anew since anchors have small hashes. Hashes that agree in them only cost work."""
    return tc.mix64(h) >> np.uint64(24)


def distinct(t: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and whether each is in two documents or more; doc has an order number for each."""
    order = np.argsort(t)
    v, d = t[order], doc[order]
    if not len(v):
        return v, np.zeros(0, bool)
    at = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    return v[at], np.minimum.reduceat(d, at) < np.maximum.reduceat(d, at)


def by_bucket(block: int, t: np.ndarray, shift: int, n: int, *columns: np.ndarray) -> pa.RecordBatch:
    """Rows for the buckets of sorted hashes of 64 - shift bits."""
    bucket = bucket_of(t << np.uint64(shift), n)
    at = np.searchsorted(bucket, np.arange(n + 1))
    some = np.flatnonzero(np.diff(at))
    blobs = [pack(gaps(t[at[b] : at[b + 1]]), *(c[at[b] : at[b + 1]] for c in columns)) for b in some]
    return pa.RecordBatch.from_arrays([pa.array([block] * len(some), pa.int64()), pa.array(some, pa.int64()), pa.array(blobs, pa.binary())], ROWS.names)


def repeated_grams(anchors: DataFrame) -> DataFrame:
    """(block, bucket, payload): for each block and bucket, one bit for each of the block's anchors in order."""

    def answer(table: pa.Table) -> pa.Table:
        sent = [unpack(x.as_py()) for x in table.column("payload")]
        values = [ungap(s[0]) for s in sent]
        every, many = np.concatenate(values), np.concatenate([s[1] for s in sent]).astype(bool)
        order = np.argsort(every)
        v = every[order]
        at = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        run = np.cumsum(np.concatenate([[True], v[1:] != v[:-1]])) - 1
        repeated = (np.diff(np.concatenate([at, [len(v)]])) > 1) | np.logical_or.reduceat(many[order], at)
        bit = np.empty(len(v), bool)
        bit[order] = repeated[run]
        ends = np.cumsum([len(x) for x in values])
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "payload": pa.array([pack(np.packbits(bit[e - len(x) : e]), np.array([len(x)])) for x, e in zip(values, ends, strict=True)], pa.binary())})

    return anchors.groupBy("bucket").applyInArrow(answer, ROWS)


def bits_in_order(replies: pa.Table) -> np.ndarray:
    """A block's answers, put together in the order of its sorted anchors."""
    order = np.argsort(replies.column("bucket").to_numpy())
    out = [np.zeros(0, bool)]
    for i in order:
        bits, n = unpack(replies.column("payload")[int(i)].as_py())
        out.append(np.unpackbits(bits, count=int(n[0])).astype(bool))
    return np.concatenate(out)
