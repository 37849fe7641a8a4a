"""Packs tokenised documents into sequences of one window.

Documents are cut into whole windows and a rest. How many rests there are of each length is a histogram of fewer bins than a window has tokens, whatever the corpus, so the plan is made
from it alone: combinations of one length taken several times and at most one other that fill a window exactly are enumerated, non-negative least squares finds how often to repeat each so
that together they use up the histogram, the counts are rounded to what there is, and this is done again for what is left while it places much. The rest is packed greedily, longest first:
sequences are filled one after another and only the piece that passes the edge is cut. The last, partial sequence is cut at powers of two, which need no padding.

A piece finds its sequence and its place in it from its number among the pieces of its length and the plan, by arithmetic; pieces are counted by ranges (:mod:`.numbering`), so a length
that a third of all documents share goes to many tasks. Token ids are written once, with the rests, and read again only for those that are cut.

The vocabulary is a file that every machine has at the same path; it is a parameter. Byte-level pair merges whose ids are their ranks are run by ``tiktoken``, which gives the ids that
``tokenizers`` gives for the file, several times faster (tested against it); other files are run by ``tokenizers``. Strings of special tokens are ordinary text.

Cases: a null or empty text is its end token alone; a null ``doc_id`` and repeated rows are packed like others; other columns of the input are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbering import numbered
from .shared import Tables, small

WINDOW = 2048
END_ID = 1
#: Steps of the least-squares solver and how often it is run on what the run before left.
STEPS, ROUNDS = 600, 3
#: Fixed value: the public pattern that cuts a text before byte-level merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """The byte for which each character of a byte-level vocabulary stands: itself if it can be printed, else the next free one from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """From a text to its ids by this vocabulary, without special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    vocab, byte_of = model.get("vocab", {}), _byte_of()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    plain = model["type"] == "BPE" and not model.get("ignore_merges") and not spec.get("normalizer") and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
    if plain and len(vocab) == 256 + len(merges) and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)) and all(c in byte_of for w in vocab for c in w):
        import tiktoken

        ranks = {bytes(byte_of[c] for c in w): i for w, i in vocab.items()}
        fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        return lambda text: np.array(fast.encode_ordinary(text), "<u4")
    import tokenizers

    slow = tokenizers.Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, "<u4")


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, doc_tokens, start, length, ids_crc32 and, for pieces shorter than the window, ``ids`` (two bytes each where the piece's ids allow it, else four)."""
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("doc_tokens", "start", "length", "ids_crc32")), T.StructField("ids", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.array([end_id], "<u4")
        for batch in batches:
            rows, of = [], []
            for i, text in enumerate(batch.column("text")):
                ids = np.concatenate([encode(text.as_py() or ""), end])
                for a in range(0, len(ids), window):
                    part = ids[a : a + window]
                    kept = None if len(part) == window else (part.astype("<u2") if part.max() < 65536 else part).tobytes()
                    rows.append((len(ids), a, len(part), zlib.crc32(part.tobytes()), kept))
                    of.append(i)
            cols = [batch.column("doc_id").take(pa.array(of, pa.int64()))]
            cols += [pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:4]] + [pa.array([r[4] for r in rows], pa.binary())] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays(cols, schema.names)

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def combinations(counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, k, b) with k * a + b = window, of lengths that there are; b is 0 where none is needed."""
    there = np.flatnonzero(counts)
    a = np.repeat(there, window // there)
    k = np.arange(len(a)) - np.repeat(np.cumsum(window // there) - window // there, window // there) + 1
    b = window - k * a
    ok = (counts[b] > 0) & (b != a) & ((k > 1) | (b < a)) | (b == 0)
    return a[ok], k[ok], b[ok]


def least_squares(counts: np.ndarray, a: np.ndarray, k: np.ndarray, b: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """How often to repeat each combination: non-negative x of least squared error between the lengths used and those that there are, by accelerated projected gradients."""
    n = len(counts)
    norm = np.sqrt(k * k + (b > 0))
    one, two = k / norm, (b > 0) / norm

    def use(x: np.ndarray) -> np.ndarray:
        return np.bincount(a, one * x, n) + np.bincount(b, two * x, n)

    def back(r: np.ndarray) -> np.ndarray:
        return one * r[a] + two * r[b]

    v = np.ones(len(a))
    for _ in range(40):
        v = back(use(v))
        top = float(np.linalg.norm(v))
        v /= top
    x = y = np.zeros(len(a))
    pace = 1.0
    for _ in range(steps):
        z = np.maximum(0.0, y - back(use(y) - counts) / (1.05 * top))
        after = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        y = z + (pace - 1) / after * (z - x)
        x, pace = z, after
    return x / norm


@dataclass(frozen=True)
class Plan:
    """Where pieces go, by their number among all of them, ordered by length: runs of numbers that begin at ``first``."""

    window: int
    base: np.ndarray  #: number of the first piece of each length
    first: np.ndarray  #: first number of each run, ascending
    length: np.ndarray  #: length of the run's pieces
    per: np.ndarray  #: pieces of this run in one sequence; 0 for what is packed greedily
    sequence: np.ndarray  #: the run's first sequence, or its first place in the greedy stream
    at: np.ndarray  #: offset of the first piece of the run in its sequence
    edges: np.ndarray  #: places in the greedy stream where the sequences after its whole windows end
    planned: int  #: sequences before the greedy ones
    whole: int  #: whole windows of the greedy stream


def plan(histogram: dict[int, int], window: int = WINDOW, rounds: int = ROUNDS) -> Plan:
    """The plan for a histogram of lengths from 1 to the window."""
    left = np.zeros(window + 1, np.int64)
    for n, c in histogram.items():
        left[n] = c
    base = np.cumsum(left) - left
    used, runs, sequences = base.copy(), [], int(left[window])
    if left[window]:
        runs.append((base[window], window, 1, 0, 0))
    left[window] = 0
    for _ in range(rounds):
        if not left.any():
            break
        a, k, b = combinations(left, window)
        if not len(a):
            break
        x = least_squares(left.astype(float), a, k, b)
        before = sequences
        for j in np.argsort(-x, kind="stable"):
            if x[j] < 0.5:
                break
            la, lk, lb = int(a[j]), int(k[j]), int(b[j])
            times = min(int(round(x[j])), int(left[la]) // lk, int(left[lb]) if lb else int(left[la]) // lk)
            if times:
                for n, per, at in ((la, lk, 0), (lb, 1, la * lk)):
                    if n:
                        runs.append((used[n], n, per, sequences, at))
                        used[n] += per * times
                        left[n] -= per * times
                sequences += times
        if sequences == before:
            break
    stream = 0
    for n in range(window - 1, 0, -1):
        if left[n]:
            runs.append((used[n], n, 0, stream, 0))
            stream += n * int(left[n])
    rest, edge, edges = stream % window, stream - stream % window, []
    for bit in range(window.bit_length(), -1, -1):
        if rest >> bit & 1:
            edge += 1 << bit
            edges.append(edge)
    runs.sort()
    first, length, per, sequence, at = (np.array(c, np.int64) for c in zip(*runs, strict=True)) if runs else (np.zeros(0, np.int64),) * 5
    return Plan(window, base, first, length, per, sequence, at, np.array(edges, np.int64), sequences, stream // window)


def places(p: Plan, length: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, ...]:
    """(piece, begin, size, sequence, offset): where the parts of pieces go, by their length and their number in it; a piece not cut has one part."""
    number = p.base[length] + nth
    run = np.searchsorted(p.first, number, side="right") - 1
    inner = number - p.first[run]
    fixed = np.flatnonzero(p.per[run])
    r, i = run[fixed], inner[fixed]
    out = [(fixed, np.zeros(len(fixed), np.int64), length[fixed], p.sequence[r] + i // p.per[r], p.at[r] + i % p.per[r] * length[fixed])]
    who = np.flatnonzero(p.per[run] == 0)
    start = p.sequence[run[who]] + inner[who] * length[who]
    begin, end_all = start.copy(), start + length[who]
    while len(who):
        tail = begin >= p.whole * p.window
        step = np.searchsorted(p.edges, begin, side="right")
        low = np.where(tail, np.concatenate([[p.whole * p.window], p.edges])[step], begin // p.window * p.window)
        high = np.where(tail, np.concatenate([p.edges, [0]])[step], low + p.window)
        end = np.minimum(end_all, high)
        out.append((who, begin - start, end - begin, p.planned + np.where(tail, p.whole + step, begin // p.window), begin - low))
        on = end < end_all
        who, start, begin, end_all = who[on], start[on], end[on], end_all[on]
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    tables = Tables(docs.sparkSession)
    cut = tables.keep(pieces(docs, path, window, end_id).withColumn("row", F.monotonically_increasing_id()))
    made = plan({r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}, window)
    counted = numbered(cut.drop("ids"), ["length"], ["doc_id", "start", "row"], tables)
    schema = T.StructType([*(cut.schema[c] for c in ("doc_id", "doc_tokens", "start", "length", "ids_crc32", "row")), *(T.StructField(n, T.LongType()) for n in ("begin", "sequence_id", "offset"))])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            piece, begin, size, sequence, offset = places(made, batch.column("length").to_numpy(), batch.column("nth").to_numpy())
            rows = batch.take(pa.array(piece))
            whole = size == rows.column("length").to_numpy()
            crc = pa.array(rows.column("ids_crc32").to_numpy(), mask=~whole)
            first = rows.column("start").to_numpy() + begin
            cols = [rows.column("doc_id"), rows.column("doc_tokens"), pa.array(first), pa.array(size), crc, rows.column("row"), pa.array(begin), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    placed = tables.keep(counted.mapInArrow(put, schema))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    halves = small(placed.where(F.col("ids_crc32").isNull()), "row").join(cut.where(F.col("length") < window).select("row", "ids", F.col("length").alias("of")), "row")
    parted = T.StructType([halves.schema[c] for c in names])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = []
            for ids, n, begin, size in zip(*(batch.column(c).to_pylist() for c in ("ids", "of", "begin", "length")), strict=True):
                crc.append(zlib.crc32(np.frombuffer(ids, f"<u{len(ids) // n}")[begin : begin + size].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(crc, pa.int64()) if c == "ids_crc32" else batch.column(c) for c in names], names)

    return placed.where(F.col("ids_crc32").isNotNull()).select(names).unionByName(halves.mapInArrow(sums, parted))
