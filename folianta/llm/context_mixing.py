"""Language-model scores by online logistic context mixing.

A text is coded as its style, one of ``STYLES`` clusters of byte frequencies, then its lower-cased words and one end, each word as its bytes and a space, each byte as the binary decisions on the path to it in a prefix code of the training bytes. For every
decision, several predictors look up what the training corpus did in a hashed context: up to three bytes before, within texts of the style or in all, and the word's whole beginning, again in either. A gate, chosen by how often the long contexts
were seen and by the place in the word, selects the weights by which the predictors' log-odds are mixed; the weights are learned online, step by step, from decisions that leave their own
occurrence out of the counts. A last stage refines the mixed probability by what followed such probabilities in training. The sum over a word's decisions is its log10-probability by itself.

From the running text comes what the word before says: with c(v, w) and c(v) the training counts of a pair and of its first word, where a document's first word follows its end, a word has the chance
(c(v, w) + K p(w)) / (c(v) + K), p being the mix's. K is the one of ``PULLS`` under which the training documents are likeliest when each token leaves its own occurrence out of both counts; the scores themselves
leave nothing out, so equal texts have equal scores, whether they were learned from or not.
The sum over words and the style's share is the text's log10-probability; with its bytes it gives bits per byte.

Spark gathers all of it from the whole corpus. The styles come from Lloyd's iterations over all training documents' byte frequencies. Documents are packed into blocks of tokens as indices into the block's own words; the words go to buckets by hash, where their counts over all blocks meet. Contexts,
weights and refinement come from the buckets' words with their counts, the contexts' tables are of fixed size; the scores of a bucket's words go back to the blocks that hold them. So the cost of the
mix follows the number of distinct words, and no vocabulary is ever in one place. A block's distinct pairs of words go to buckets by their own hash of ``PAIR_BITS`` bits, so that a frequent word's pairs spread over all
buckets, and their counts over all blocks come back.

Cases: a null text is empty and has one token, the end; every doc_id that is null counts as training; repeated rows each count and get a row; without training rows counts are 0 and the untrained mix scores; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blockwise as bw
from . import textcore as tc
from .shared import Tables, stored

BLOCK_BYTES = 8_000_000
TABLE_BITS = 20
ORDERS = 7
SHORT, LONG = 5, 6
STYLES = 8
LLOYD = 4
START_ROWS = 2000
N_GATES = 36
STRETCHES = 33
SMOOTH = 0.1
BATCH_WORDS = 1024
WORD_BITS, PAIR_BITS = 40, 44
#: How much the mix counts beside a word's followers, as a number of occurrences; the best for the training documents is taken.
PULLS = tuple(float(8**i) for i in range(6))
#: Words whose log10-probability lies below are added in logarithms where no pair counts beside them.
LEAST_LOG = -250.0


def held_out(doc_id: Column, folds: int = 10, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


# Styles


def frequencies(column: pa.Array) -> np.ndarray:
    """Square roots of the shares of letters and of bytes beyond ASCII in each text."""
    out = [np.zeros((0, DIMENSIONS), np.float32)]
    for a, b, data, offs in tc.parts(column):
        place = KIND[tc.LOWER[data]]
        doc = np.repeat(np.arange(b - a), np.diff(offs))
        n = np.bincount((doc * (DIMENSIONS + 1) + place)[place < DIMENSIONS], minlength=(b - a) * (DIMENSIONS + 1)).reshape(b - a, -1)[:, :DIMENSIONS]
        out.append(np.sqrt(n / np.maximum(n.sum(1, keepdims=True), 1)).astype(np.float32))
    return np.concatenate(out)


DIMENSIONS = 26 + 128
KIND = np.full(256, DIMENSIONS)
KIND[97:123], KIND[128:] = np.arange(26), np.arange(26, DIMENSIONS)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)


def _summed(parts: DataFrame, sizes: list[int]) -> list[np.ndarray]:
    """Sums of vectors that tasks have made (one binary column of doubles, the vectors of ``sizes`` side by side), added up in groups before the driver sees 16 of them; always in one order, so that reruns agree."""

    def add(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("task").to_numpy(), kind="stable")
        total = sum(np.frombuffer(table.column("v")[int(i)].as_py()) for i in order)
        return pa.table({"g": table.column("g")[:1], "v": pa.array([total.tobytes()], pa.binary())})

    total = np.zeros(sum(sizes))
    task = F.spark_partition_id()
    for r in sorted(parts.select((task % 16).alias("g"), task.alias("task"), "v").groupBy("g").applyInArrow(add, "g int, v binary").collect()):
        total += np.frombuffer(r["v"])
    return np.split(total, np.cumsum(sizes)[:-1])


def _lloyd(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = nearest(points, centres)
    n = np.bincount(k, minlength=len(centres)).astype(float)
    total = np.zeros(centres.shape)
    np.add.at(total, k, points)
    return total, n


def styles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Centres and shares of the styles. Seeds are drawn from ``START_ROWS`` rows; the iterations run over all training documents."""
    train = docs.where(~held_out(F.col("doc_id")))

    def measure(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float16).tobytes() for x in frequencies(b.column(0))], pa.binary())], ["f"])

    tables = Tables(docs.sparkSession)
    points = tables.keep(train.select("text").mapInArrow(measure, "f binary"))
    some = [r["f"] for r in points.orderBy(F.xxhash64("f"), "f").limit(START_ROWS).collect()]
    if not some:
        return np.zeros((STYLES, DIMENSIONS)), np.full(STYLES, 1 / STYLES)
    x, rng, best = np.frombuffer(b"".join(some), np.float16).reshape(-1, DIMENSIONS).astype(float), np.random.default_rng(5), None
    for _ in range(6):
        centres = x[rng.integers(len(x), size=1)]
        while len(centres) < STYLES:
            far = np.maximum(((x[:, None] - centres[None]) ** 2).sum(2).min(1), 1e-12)
            centres = np.concatenate([centres, x[rng.choice(len(x), 1, p=far / far.sum())]])
        for _ in range(12):
            total, n = _lloyd(x, centres)
            centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
        loss = ((x[:, None] - centres[None]) ** 2).sum(2).min(1).sum()
        if best is None or loss < best[0]:
            best = (loss, centres)
    centres = best[1]
    for _ in range(LLOYD):

        def assign(batches, centres=centres):
            total, n = np.zeros(centres.shape), np.zeros(len(centres))
            for b in batches:
                if len(b):
                    t, m = _lloyd(np.frombuffer(b"".join(b.column(0).to_pylist()), np.float16).reshape(-1, DIMENSIONS).astype(float), centres)
                    total, n = total + t, n + m
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([total.ravel(), n]).tobytes()], pa.binary())], ["v"])

        total, n = _summed(points.mapInArrow(assign, "v binary"), [centres.size, STYLES])
        total = total.reshape(centres.shape)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    tables.drop(points)
    return centres, (n + 0.5) / (n.sum() + 0.5 * STYLES)


# Blocks and buckets. A key is a style's digit and a word.


def _pack(words: list[bytes], *arrays: np.ndarray) -> bytes:
    body = [b" ".join(words), *(bw.planes(a) for a in arrays)]
    return zstandard.ZstdCompressor(3).compress(struct.pack(f"<q{len(body)}q", len(words), *map(len, body)) + b"".join(body))


def _unpack(blob: bytes, *kinds: type) -> tuple[list[bytes], list[np.ndarray]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, *sizes = struct.unpack_from(f"<{2 + len(kinds)}q", raw)
    at = 8 * (2 + len(kinds))
    words = raw[at : at + sizes[0]].split(b" ") if n else []
    at += sizes[0]
    out = []
    for kind, size in zip(kinds, sizes[1:], strict=True):
        out.append(bw.from_planes(raw, kind, size, at))
        at += size
    return words, out


def bucket_of(keys: list[bytes], n: int) -> np.ndarray:
    """By the word alone, so that a word's keys meet."""
    return np.fromiter((zlib.crc32(w[1:]) % n for w in keys), np.int64, len(keys))


def key_hashes(keys: list[bytes]) -> np.ndarray:
    """Hashes of the keys' words, each with its space, of ``WORD_BITS`` bits."""
    end = np.cumsum(np.fromiter(map(len, keys), np.int64, len(keys)))
    return tc.span_hashes(np.frombuffer(b" ".join([w[1:] for w in keys]) + b" ", np.uint8), np.concatenate([[0], end[:-1]]), end) >> np.uint64(64 - WORD_BITS)


def word_pairs(tokens: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct pairs of keys: their hashes, ascending; each token's pair; and the key before each token. The document's end is before its first token."""
    first = np.cumsum(sizes) - sizes
    before = np.concatenate([tokens[:1], tokens[:-1]])
    before[first] = tokens[first + sizes - 1]
    pair, of = np.unique((before.astype(np.int64) << 32) | tokens, return_inverse=True)
    h = tc.mix64(hashes[pair >> 32] * np.uint64(0x9E3779B97F4A7C15) + hashes[pair & 0xFFFFFFFF]) >> np.uint64(64 - PAIR_BITS)
    order = np.argsort(h, kind="stable")
    place = np.empty(len(h), np.int64)
    place[order] = np.arange(len(h))
    return h[order], place[of], before


PACKED = T.StructType([T.StructField("block", T.LongType()), T.StructField("bucket", T.LongType()), T.StructField("payload", T.BinaryType())])


def blocks(docs: DataFrame, n_buckets: int, centres: np.ndarray) -> DataFrame:
    """Rows of (block, bucket, payload): for each block and bucket the block's keys with their counts in training documents; bucket -1 holds the documents' ids, folds, styles and tokens as ranks of the block's
    keys by frequency, and these keys' places in the order of their buckets and hashes."""

    def pack(batches):
        task, seq = TaskContext.get().partitionId(), 0
        ids, held, kinds, sizes, tokens, index, size = [], [], [], [], [], {}, 0

        def rows():
            start, words = {}, []
            for k, style in index.items():
                start[k] = len(words)
                words += [b"%d" % k + w for w in style]
            bucket = bucket_of(words, n_buckets)
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(words), np.uint32)
            place[order] = np.arange(len(words), dtype=np.uint32)
            n = np.array(sizes, np.int64)
            flat = place[np.concatenate(tokens) + np.repeat(np.array([start[k] for k in kinds]), n)]
            train = np.repeat(~np.array(held, bool), n)
            counts = np.bincount(flat[train], minlength=len(words)).astype(np.uint32)
            edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            found = [(b, _pack([words[i] for i in order[x:y]], counts[x:y])) for b, (x, y) in enumerate(zip(edges, edges[1:], strict=False)) if y > x]
            hashes = key_hashes([words[i] for i in order])
            often = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable").astype(np.uint32)
            rank = np.empty(len(words), np.uint32)
            rank[often] = np.arange(len(words), dtype=np.uint32)
            head = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(held), pa.array(kinds, pa.int32())], ["doc_id", "held_out", "style"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, head.schema) as w:
                w.write_batch(head)
            found.append((-1, _pack([], np.frombuffer(sink.getvalue(), np.uint8), n, rank[flat], often, hashes)))
            block = (task << 32) | seq
            return pa.RecordBatch.from_arrays([pa.array([block] * len(found), pa.int64()), pa.array([b for b, _ in found], pa.int64()), pa.array([p for _, p in found], pa.binary())], PACKED.names)

        for batch in batches:
            near = nearest(frequencies(batch.column(1)).astype(np.float16).astype(float), centres).tolist()
            for doc_id, text, fold, k in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), near, strict=True):
                style = index.setdefault(k, {})
                got = [style.setdefault(w, len(style)) for w in (text or b"").lower().split()]
                got.append(style.setdefault(b"", len(style)))
                ids.append(doc_id)
                kinds.append(k)
                held.append(fold)
                sizes.append(len(got))
                tokens.append(np.array(got, np.uint32))
                size += len(text or b"") + 64
                if size >= BLOCK_BYTES:
                    yield rows()
                    seq += 1
                    ids, held, kinds, sizes, tokens, index, size = [], [], [], [], [], {}, 0
        if ids:
            yield rows()

    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(pack, PACKED)


def _open(blob: bytes) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A block's documents, their numbers of tokens, the tokens as indices into the block's keys in order of their buckets, and the keys' hashes."""
    _, (head, sizes, ranks, often, hashes) = _unpack(blob, np.uint8, np.int64, np.uint32, np.uint32, np.uint64)
    return pa.ipc.open_stream(pa.BufferReader(head.tobytes())).read_all(), sizes, often[ranks], hashes


def pair_rows(heads: DataFrame, n_buckets: int) -> DataFrame:
    """(block, bucket, payload): each block's distinct pairs with their counts in training documents, in buckets from n_buckets on."""

    def send(batches):
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, sizes, tokens, hashes = _open(blob.as_py())
                pairs, of, _ = word_pairs(tokens, sizes, hashes)
                train = np.repeat(~rows.column("held_out").to_numpy(), sizes)
                counts = np.bincount(of[train], minlength=len(pairs)).astype(np.uint32)
                edges = np.searchsorted(bw.bucket_of(pairs << np.uint64(64 - PAIR_BITS), n_buckets), np.arange(n_buckets + 1))
                found = [(n_buckets + b, bw.pack(bw.gaps(pairs[x:y]), counts[x:y], planar=True)) for b, (x, y) in enumerate(zip(edges, edges[1:], strict=False)) if y > x]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(found), pa.int64()), pa.array([b for b, _ in found], pa.int64()), pa.array([p for _, p in found], pa.binary())], PACKED.names)

    return heads.select("block", "payload").mapInArrow(send, PACKED)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(block, bucket, payload): for each block and bucket of pairs, the pairs' training counts over all blocks, in the block's order."""

    def add(table: pa.Table) -> pa.Table:
        sent = [bw.unpack(x.as_py()) for x in table.column("payload")]
        h, counts = np.concatenate([bw.ungap(s[0]) for s in sent]), np.concatenate([s[1] for s in sent]).astype(np.int64)
        order = np.argsort(h)
        new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
        total = np.empty(len(h), np.int64)
        total[order] = np.add.reduceat(counts[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        ends = np.cumsum([len(s[1]) for s in sent])
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "payload": pa.array([bw.pack(total[e - len(s[1]) : e], planar=True) for s, e in zip(sent, ends, strict=True)], pa.binary())})

    return pairs.groupBy("bucket").applyInArrow(add, PACKED)


def word_table(packed: DataFrame) -> DataFrame:
    """(bucket, payload, places, n, v): a bucket's distinct keys, sorted, with their counts over all blocks, and for each block which of them it sent; n sums the counts and v counts the words with any."""

    def merge(table: pa.Table) -> pa.Table:
        total: dict[bytes, int] = {}
        sent = sorted(zip(table.column("block").to_pylist(), table.column("payload"), strict=True), key=lambda x: x[0])
        for _, blob in sent:
            words, (counts,) = _unpack(blob.as_py(), np.uint32)
            for w, c in zip(words, counts.tolist(), strict=True):
                total[w] = total.get(w, 0) + c
        words = sorted(total)
        counts = np.fromiter((total[w] for w in words), np.int64, len(words))
        at, places = dict(zip(words, range(len(words)), strict=True)), []
        for _, blob in sent:
            own, _ = _unpack(blob.as_py(), np.uint32)
            places.append(np.fromiter((at[w] for w in own), np.uint32, len(own)))
        places = bw.pack(np.array([b for b, _ in sent], np.int64), np.array([len(x) for x in places], np.int64), np.concatenate(places), planar=True)
        return pa.table({"bucket": table.column("bucket")[:1], "payload": pa.array([_pack(words, counts)], pa.binary()), "places": pa.array([places], pa.binary()), "n": [int(counts.sum())], "v": [len({w[1:] for w, c in total.items() if c})]})

    return packed.groupBy("bucket").applyInArrow(merge, "bucket long, payload binary, places binary, n long, v long")


# The model


def prefix_code(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length, decisions and tree nodes of each byte's code, a Huffman code of the counts (all bytes get one)."""
    heap = [(float(c) + 1e-3, i, (i,)) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    length = np.zeros(256, np.int64)
    bits, nodes = np.zeros((256, 256), np.uint8), np.zeros((256, 256), np.int64)
    node = 256
    while len(heap) > 1:
        (x, _, a), (y, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        for side, leaves in ((0, a), (1, b)):
            for i in leaves:
                bits[i, length[i]], nodes[i, length[i]] = side, node - 255
                length[i] += 1
        heapq.heappush(heap, (x + y, node, a + b))
        node += 1
    for i in range(256):
        bits[i, : length[i]], nodes[i, : length[i]] = bits[i, : length[i]][::-1].copy(), nodes[i, : length[i]][::-1].copy()
    return length, bits, nodes


class Coder:
    """Decisions, contexts' slots and gates' places of words."""

    def __init__(self, counts: np.ndarray) -> None:
        self.length, self.bits, self.nodes = prefix_code(counts)

    def events(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bit, slot in each order's table, place in the word (3 at most) and key of each decision."""
        style = np.fromiter((w[0] for w in words), np.uint64, len(words)) << np.uint64(50)
        data = np.frombuffer(b" ".join([w[1:] for w in words]) + b" ", np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size) - size
        word = np.repeat(np.arange(len(words)), size)
        rel = np.arange(len(data)) - start[word]
        code = data.astype(np.uint64) + np.uint64(1)
        ctx = np.zeros((ORDERS, len(data)), np.uint64)
        for k in range(1, 4):
            back = np.zeros(len(data), np.uint64)
            back[k:] = code[: len(data) - k]
            back[rel < k] = 0
            ctx[k:4] += back << np.uint64(9 * (k - 1))
        weigh = code * tc.powers(int(size.max()) + 1)[rel]
        run = np.concatenate([[np.uint64(0)], np.cumsum(weigh, dtype=np.uint64)[:-1]])
        ctx[4] = ctx[3]
        ctx[SHORT] = run - run[start][word] + rel.astype(np.uint64)
        ctx[LONG] = tc.mix64(ctx[SHORT])
        ctx[[0, 1, 2, 3, LONG]] += style[word]
        ctx = tc.mix64(ctx * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, ORDERS + 1, dtype=np.uint64)[:, None])
        n = self.length[data]
        of = np.repeat(np.arange(len(data)), n)
        step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        byte = data[of]
        node = self.nodes[byte, step].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        slot = ((ctx[:, of] + node) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - TABLE_BITS)).astype(np.int32)
        return self.bits[byte, step], slot, np.minimum(rel[of], 3), word[of]


def _level(n: np.ndarray) -> np.ndarray:
    return (n > 0).astype(np.int64) + (n > 2)


def _inputs(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log-odds of a predictor from its counts, less where they are few."""
    n = n0 + n1
    return np.log((n1 + SMOOTH) / (n0 + SMOOTH)) * (n + 0.1) / (n + 0.6)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -16, 16)))


def _refine_at(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower of the two neighbouring marks on the log-odds scale, and the part of the way to the next."""
    y = (np.clip(x, -8, 8) + 8) * (STRETCHES - 1) / 16
    low = np.minimum(y.astype(np.int64), STRETCHES - 2)
    return low, y - low


class Mixer:
    def __init__(self, weights: np.ndarray | None = None, seen: np.ndarray | None = None) -> None:
        self.weights = np.full((N_GATES, ORDERS + 1), 0.2) if weights is None else weights
        self.weights[:, -1] = self.weights[:, -1] if weights is not None else 0.0
        self.seen = np.zeros((N_GATES, STRETCHES, 2)) if seen is None else seen

    def learn(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, weight: np.ndarray, rate: float) -> None:
        z = (self.weights[gate] * x).sum(1)
        p = _squash(z)
        low, part = _refine_at(z)
        for at, share in ((low, 1 - part), (low + 1, part)):
            np.add.at(self.seen, (gate, at, bit), weight * share)
        miss = weight * (bit - p)
        mass = np.bincount(gate, weight, minlength=N_GATES)
        some = mass > 0
        for k in range(x.shape[1]):
            g = np.bincount(gate, miss * x[:, k], minlength=N_GATES)
            self.weights[some, k] += rate * g[some] / mass[some]

    def chance(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Probability of a 1: the mean of the mixed and the refined one."""
        z = (self.weights[gate] * x).sum(1)
        p = _squash(z)
        low, part = _refine_at(z)
        marks = (np.arange(STRETCHES) * 16 / (STRETCHES - 1)) - 8
        table = (self.seen[:, :, 1] + 4 * _squash(marks)) / (self.seen.sum(2) + 4)
        fine = table[gate, low] * (1 - part) + table[gate, low + 1] * part
        return np.clip((p + fine) / 2, 1e-6, 1 - 1e-6)


def _open_array(blob: bytes, kind: str, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind).reshape(shape)


class Sent:
    """An array that travels compressed: tables are mostly empty for small corpora."""

    def __init__(self, array: np.ndarray) -> None:
        self.array = array

    def __reduce__(self):
        return _sent, (zstandard.ZstdCompressor(3).compress(np.ascontiguousarray(self.array).tobytes()), self.array.dtype.str, self.array.shape)


def _sent(blob: bytes, kind: str, shape: tuple[int, ...]) -> Sent:
    return Sent(_open_array(blob, kind, shape))


class Model:
    def __init__(self, coder: Coder, tables: np.ndarray, mixer: Mixer) -> None:
        self.coder, self.mixer = coder, mixer
        n = tables.sum(2)
        self.odds = Sent(_inputs(tables[:, :, 0], tables[:, :, 1]).astype(np.float16))
        self.level = Sent(_level(n[[SHORT, LONG]]).astype(np.uint8))

    def score(self, words: list[bytes], at_once: int = 8192) -> np.ndarray:
        """log10-probability of each word with its space."""
        out = [np.zeros(0)]
        for a in range(0, len(words), at_once):
            some = words[a : a + at_once]
            bit, slot, place, word = self.coder.events(some)
            x = np.ones((len(bit), ORDERS + 1))
            for o in range(ORDERS):
                x[:, o] = self.odds.array[o][slot[o]]
            gate = (self.level.array[1][slot[LONG]] * 3 + self.level.array[0][slot[SHORT]]).astype(np.int64) * 4 + place
            p = self.mixer.chance(x, gate)
            out.append(np.bincount(word, np.log10(np.where(bit, p, 1 - p)), minlength=len(some)))
        return np.concatenate(out)


def _byte_counts(words: DataFrame) -> np.ndarray:
    def count(batches):
        total = np.zeros(256)
        for b in batches:
            for blob in b.column(0):
                ws, (counts,) = _unpack(blob.as_py(), np.int64)
                data = np.frombuffer(b" ".join([w[1:] for w in ws]) + b" ", np.uint8)
                if ws:
                    total += np.bincount(data, np.repeat(counts, np.fromiter(map(len, ws), np.int64, len(ws))), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(total)], ["byte", "n"])

    got = words.select("payload").mapInArrow(count, "byte int, n double").groupBy("byte").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(256)
    for r in got:
        out[r["byte"]] = r["n"]
    return out


def context_tables(words: DataFrame, coder: Coder) -> np.ndarray:
    """Counts of both outcomes in each slot of each order: [order, slot, bit]. A task adds up its words' decisions and ships its tables, of fixed size, in ranges."""
    shared, ranges = words.sparkSession.sparkContext.broadcast(coder), 16

    def count(batches):
        total = np.zeros((ORDERS, 2 << TABLE_BITS))
        for b in batches:
            for blob in b.column(0):
                ws, (counts,) = _unpack(blob.as_py(), np.int64)
                keep = np.flatnonzero(counts)
                for a in range(0, len(keep), 8192):
                    some = keep[a : a + 8192]
                    bit, slot, _, word = shared.value.events([ws[i] for i in some])
                    weight = counts[some][word].astype(float)
                    for o in range(ORDERS):
                        np.add.at(total[o], slot[o] * 2 + bit, weight)
        if total.any():
            each = total.reshape(ORDERS * ranges, -1).astype(np.float32)
            zip_ = zstandard.ZstdCompressor(1)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(each)), pa.int32()), pa.array([zip_.compress(x.tobytes()) for x in each], pa.binary())], ["part", "payload"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros((2 << TABLE_BITS) // ranges)
        for blob in table.column("payload"):
            total += np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_py()), np.float32)
        return pa.table({"part": table.column("part")[:1], "payload": pa.array([zstandard.ZstdCompressor(1).compress(total.astype(np.float32).tobytes())], pa.binary())})

    kind = "part int, payload binary"
    out = np.zeros((ORDERS * ranges, (2 << TABLE_BITS) // ranges), np.float32)
    for r in words.select("payload").mapInArrow(count, kind).groupBy("part").applyInArrow(add, kind).collect():
        out[r["part"]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["payload"]), np.float32)
    shared.destroy()
    return out.reshape(ORDERS, 1 << TABLE_BITS, 2)


def learn_mixer(words: DataFrame, coder: Coder, tables: np.ndarray) -> Mixer:
    """Online learning over each task's words in turn; the tasks' weights are averaged by the occurrences that each gate had, and the refinements' counts added."""
    shared = words.sparkSession.sparkContext.broadcast((coder, Sent(tables)))

    def learn(batches):
        code, counts_of = shared.value[0], shared.value[1].array
        mixer, step = Mixer(), 0
        for b in batches:
            for blob in b.column(0):
                ws, (counts,) = _unpack(blob.as_py(), np.int64)
                keep = np.flatnonzero(counts)
                for a in range(0, len(keep), BATCH_WORDS):
                    some = keep[a : a + BATCH_WORDS]
                    bit, slot, place, word = code.events([ws[i] for i in some])
                    x = np.ones((len(bit), ORDERS + 1))
                    seen = {}
                    for o in range(ORDERS):
                        n = counts_of[o][slot[o]]
                        n[np.arange(len(bit)), bit] -= 1
                        np.maximum(n, 0, out=n)
                        x[:, o] = _inputs(n[:, 0], n[:, 1])
                        if o in (SHORT, LONG):
                            seen[o] = _level(n.sum(1))
                    mixer.learn(x, (seen[LONG] * 3 + seen[SHORT]) * 4 + place, bit, counts[some][word].astype(float), 0.3 / (1 + step / 50) + 0.02)
                    step += 1
        mass = mixer.seen.sum((1, 2))
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([(mixer.weights * mass[:, None]).ravel(), mixer.seen.ravel(), mass]).tobytes()], pa.binary())], ["v"])

    weights, seen, mass = _summed(words.select("payload").mapInArrow(learn, "v binary"), [N_GATES * (ORDERS + 1), N_GATES * STRETCHES * 2, N_GATES])
    weights, seen, mass = weights.reshape(N_GATES, -1), seen.reshape(N_GATES, STRETCHES, 2), mass[:, None]
    shared.destroy()
    fresh = Mixer().weights
    return Mixer(np.where(mass > 0, weights / np.maximum(mass, 1e-9), fresh), seen)


def train(words: DataFrame) -> Model:
    coder = Coder(_byte_counts(words))
    tables = context_tables(words, coder)
    return Model(coder, tables, learn_mixer(words, coder, tables))


def score_documents(docs: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    spark = docs.sparkSession
    n_buckets = n_buckets or bw.n_buckets(docs)
    centres, shares = styles(docs)
    packed = stored(blocks(docs, n_buckets, centres))
    own_words, heads = packed.where("bucket >= 0"), packed.where("bucket = -1")
    words = stored(word_table(own_words))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    n_train, n_distinct = int(total[0]), int(total[1])
    model = spark.sparkContext.broadcast(train(words))

    def answer(batches):
        for batch in batches:
            for bucket, payload, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                ws, (counts,) = _unpack(payload.as_py(), np.int64)
                whole: dict[bytes, int] = {}
                for w, c in zip(ws, counts.tolist(), strict=True):
                    whole[w[1:]] = whole.get(w[1:], 0) + c
                every, scores = np.fromiter((whole[w[1:]] for w in ws), np.int64, len(ws)), model.value.score(ws).astype(np.float32)
                blocks_, sizes, at = bw.unpack(places.as_py())
                blobs = [_pack([], every[i], scores[i]) for i in np.split(at, np.cumsum(sizes)[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(blocks_), pa.array([bucket] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())], PACKED.names)

    replies = words.select("bucket", "payload", "places").mapInArrow(answer, PACKED).unionByName(pair_counts(pair_rows(heads, n_buckets)))
    id_type = docs.schema["doc_id"].dataType
    kind = T.StructType([T.StructField("doc_id", id_type), T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), T.StructField("base_score", T.DoubleType()), *(T.StructField(f"{c}_{i}", T.DoubleType()) for c in ("score", "fit") for i in range(len(PULLS)))])
    arrow_id = pa.int64() if isinstance(id_type, T.LongType) else None

    def total_up(own: pa.Table, back: pa.Table) -> pa.Table:
        rows, sizes, tokens, hashes = _open(own.column("payload")[0].as_py())
        buckets = back.column("bucket").to_numpy()
        by = np.argsort(buckets)
        blobs = [back.column("payload")[int(i)].as_py() for i in by]
        cut_at = int((buckets < n_buckets).sum())
        got = [_unpack(x, np.int64, np.float32)[1] for x in blobs[:cut_at]]
        every, scores = (np.concatenate([g[k] for g in got]) for k in (0, 1))
        _, of, before = word_pairs(tokens, sizes, hashes)
        both = np.concatenate([bw.unpack(x)[0] for x in blobs[cut_at:]])[of]
        counts = every[tokens]
        base = np.log10((counts + 0.1) / (n_train + 0.1 * (n_distinct + 1)))
        first = np.cumsum(sizes) - sizes
        ids = rows.column("doc_id") if arrow_id is None else rows.column("doc_id").cast(arrow_id)
        above = every[before]
        both = np.minimum(both, above)
        mixed, share, totals = (10 ** np.maximum(scores, LEAST_LOG).astype(float))[tokens], np.log10(shares)[rows.column("style").to_numpy()], {}
        deep = np.minimum(scores.astype(float) - LEAST_LOG, 0.0)
        if deep.any():
            share = share + np.add.reduceat(np.where(both == 0, deep[tokens], 0.0), first)
        learned = np.repeat(~rows.column("held_out").to_numpy(), sizes).astype(np.float32)
        own, under, by_itself = np.maximum(both - 1, 0).astype(np.float32), np.maximum(above - 1, 0).astype(np.float32), np.maximum(mixed, 1e-37).astype(np.float32)
        for i, k in enumerate(PULLS):
            chance = k * mixed
            chance += both
            chance /= above + k
            totals[f"score_{i}"] = np.add.reduceat(np.log(chance, out=chance), first) / np.log(10) + share
            fit = np.float32(k) * by_itself
            fit += own
            fit /= under + np.float32(k)
            np.log(fit, out=fit)
            fit *= learned
            totals[f"fit_{i}"] = np.zeros(len(sizes))
            totals[f"fit_{i}"][0] = fit.sum(dtype=float)
        return pa.table({"doc_id": ids, "held_out": rows.column("held_out"), "n_tokens": sizes, "n_known": np.add.reduceat((counts > 0).astype(np.int64), first), "train_tokens": np.full(len(sizes), n_train), "base_score": np.add.reduceat(base, first), **totals})

    out = stored(heads.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(total_up, kind))
    fits = out.agg(*(F.coalesce(F.sum(f"fit_{i}"), F.lit(0.0)) for i in range(len(PULLS)))).first()
    return out.select(*kind.names[: -2 * len(PULLS)], F.col(f"score_{int(np.argmax(fits))}").alias("score"))


def bits_per_byte(score: Column, text: Column) -> Column:
    """Total bits per byte of a text from its log10-probability."""
    return -score / F.lit(float(np.log10(2))) / F.greatest(F.octet_length(text), F.lit(1))
