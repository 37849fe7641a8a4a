"""Phrases of two to five words that occur together more often than their parts explain, by vertical positional inverted lists.

Texts of one language lie in blocks of some megabytes. In its block a word or phrase has a list of the positions at which it begins; between pieces (parts of a text between break
characters) a position is left out, so neighbours are always words of one piece. The list of a phrase is extended by merge-joining its positions with the postings of the words that follow:
a list for each following word. The length of a list is the phrase's exact frequency in the block, and frequencies of all blocks are added up by phrase. What is frequent goes back to the
blocks that hold it, and only these lists are extended at the next level; a word's posting stays only where a frequent phrase ends, so both parts of a longer candidate, without its last
and without its first word, are frequent before it is counted. Phrases are dealt over ranges of a hash, as many as the text is long: a block sends what it counted as one packed row a range,
with the words themselves, and gets one packed row a range back, so a task adds up one range of all blocks.

Most words and pairs of words are rare, so before they are counted by name their counts are added up by slot of a hash, as a few packed rows a block: a slot's sum is no less than the
count of anything in it, so what lies in a light slot is rare, and nothing frequent is lost. The slots grow with the input. What the packed rows hold is never more than each block's
different pairs.

Blocks stay whole rows with their lists (codes in the order of the text, from which a task sorts the lists again) and get smaller with each level; nothing of a word's occurrences is sent
for itself. Frequencies are of the words themselves or of numbers given to frequent phrases, not of hashes. Parts of a candidate are found along the links to the phrases without its last
and its first word, so all cuts come with two joins a level.

Cases: a null language is ``und``; null and empty texts have no words; a phrase never crosses a break or a document; repeated documents count each time; an empty table gives no rows; other
columns of the input are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore
from .shared import Tables

LEAST, MAX_WORDS, TOP = 100, 5, 2000
#: Bytes of text in one block, or one longer document.
BLOCK_BYTES = 32_000_000
#: A range has 2^24 slots; there is one for so many bytes of text, and there are some at least.
SLOT_BITS, RANGE_BYTES, LEAST_RANGES = 24, 64_000_000, 16
#: Ranks are first taken within so many parts of a language.
RANK_PARTS = 64
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"]] = True
_BREAK[0x0A:0x0E] = True



def _schema(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


_LONG, _STRING, _BYTES = T.LongType(), T.StringType(), T.BinaryType()
_BLOCK = _schema(block=_LONG, lang=_STRING, n=_LONG, range=T.IntegerType(), packed=_BYTES)
_COUNTED = _schema(block=_LONG, lang=_STRING, range=T.IntegerType(), packed=_BYTES)
_FREQUENT = _schema(id=_LONG, lang=_STRING, prefix=_LONG, first=_STRING, word=_STRING, suffix=_LONG, f=_LONG, block=_LONG, packed=_BYTES)


def _pack(arrays: list[np.ndarray], words: list[str] | None = None) -> bytes:
    """Arrays of numbers from -1 on and words without line ends, compressed."""
    most = [a.max(initial=0) for a in arrays]
    width = [2 if m < 65_535 else 4 if m < 0xFFFFFFFF else 8 for m in most]
    body = b"".join((a + 1).astype(f"<u{w}").tobytes() for a, w in zip(arrays, width, strict=True)) + "\n".join(words or []).encode()
    head = np.array([len(arrays), len(words or []), len(body), *width, *(len(a) for a in arrays)], np.int64)
    return head.tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def _unpacked(packed: bytes) -> tuple[list[np.ndarray], int, bytes]:
    """The arrays, the number of words and the words, one a line."""
    n, n_words, size = np.frombuffer(packed, np.int64, 3).tolist()
    heads = np.frombuffer(packed, np.int64, 2 * n, 24).tolist()
    body = pa.decompress(packed[24 + 16 * n :], decompressed_size=size, codec="zstd", asbytes=True)
    arrays, a = [], 0
    for width, length in zip(heads[:n], heads[n:], strict=True):
        arrays.append(np.frombuffer(body, f"<u{width}", length, a).astype(np.int64 if width > 2 else np.int32) - 1)
        a += length * width
    return arrays, n_words, body[a:]


def _unpack(packed: bytes) -> tuple[list[np.ndarray], list[str]]:
    arrays, n_words, lines = _unpacked(packed)
    return arrays, lines.decode().split("\n") if n_words else []


def _rows(schema: T.StructType, n: int, /, **cols) -> pa.RecordBatch:
    """A batch in which columns that aren't given are null and single values stand in all rows."""
    kinds = {"long": pa.int64(), "integer": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    out = []
    for field in schema:
        kind, value = kinds[field.dataType.typeName()], cols.get(field.name)
        if value is None:
            out.append(pa.nulls(n, kind))
        else:
            out.append(value.cast(kind) if isinstance(value, pa.Array) else pa.array(value if isinstance(value, (list, np.ndarray)) else [value] * n, kind))
    return pa.RecordBatch.from_arrays(out, schema.names)


def word_codes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """The code of the word at each position and the words, of documents side by side; a position is left out (-1) before each piece."""
    low = textcore.LOWER[data]
    starts, ends, doc = textcore.words(low, offs, _GAP | _BREAK)
    if not len(starts):
        return np.zeros(0, np.int32), []
    breaks = np.searchsorted(np.flatnonzero(_BREAK[low]), starts)
    fresh = np.zeros(len(starts), bool)
    fresh[1:] = (breaks[1:] != breaks[:-1]) | (doc[1:] != doc[:-1])
    at = np.arange(len(starts)) + np.cumsum(fresh)
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    each = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(low[~(_GAP | _BREAK)[low]])]).dictionary_encode()
    by_position = np.full(int(at[-1]) + 1, -1, np.int32)
    by_position[at] = each.indices.to_numpy()
    return by_position, each.dictionary.to_pylist()


def word_pairs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, code of the next word, times) of the pairs of neighbours."""
    both = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0))
    key, times = np.unique(codes[both].astype(np.int64) << 32 | codes[both + 1], return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, times


def slots(lang: str, words: list[str], one: np.ndarray, two: np.ndarray, n_slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the words and of the pairs."""
    data, offs = textcore.buffers(pa.array(words, pa.large_string()))
    seed = np.uint64(crc32(lang.encode()) + 1)
    h = textcore.mix64(textcore.span_hashes(data, offs[:-1], offs[1:]) ^ textcore.mix64(np.array([seed])))
    pair = textcore.mix64(h[one] * np.uint64(0x9E3779B97F4A7C15) + h[two])
    return (h % np.uint64(n_slots)).astype(np.int64), (pair % np.uint64(n_slots)).astype(np.int64)


def blocks(docs: DataFrame, n_ranges: int, least: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row with the words of each block (``n`` in all), and a row with its counts by slot for each range of slots that it uses."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 12, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            texts = pa.concat_arrays([t for t, _ in held])
            langs = pa.concat_arrays([g for _, g in held]).dictionary_encode()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                data, offs = textcore.buffers(texts.filter(pc.equal(langs.indices, i)))
                codes, words = word_codes(data[offs[0] : offs[-1]], offs - offs[0])
                if words:
                    yield _rows(_BLOCK, 1, block=number, lang=lang, n=int((codes >= 0).sum()), packed=[_pack([codes], words)])
                    one, two, times = word_pairs(codes)
                    slot = np.concatenate(slots(lang, words, one, two, n_ranges << SLOT_BITS))
                    used, which = np.unique(slot, return_inverse=True)
                    sums = np.minimum(np.bincount(which, np.concatenate([np.bincount(codes[codes >= 0]), times])), least).astype(np.int64)
                    ends = np.searchsorted(used, np.arange(n_ranges + 1) << SLOT_BITS)
                    full = np.flatnonzero(np.diff(ends))
                    packed = [_pack([np.diff(used[a:b], prepend=used[a]), sums[a:b], used[a : a + 1] & (1 << SLOT_BITS) - 1]) for a, b in zip(ends[full], ends[full + 1], strict=True)]
                    yield _rows(_BLOCK, len(full), block=number, range=full, packed=packed)
                number += 1
                if not number & 0xFFF:
                    raise ValueError("a partition has 4,096 blocks: use more partitions or larger blocks")

        for batch in batches:
            text, lang = batch.column("text"), batch.column("lang")
            for a, b, data, _ in textcore.parts(text, block_bytes // 4):
                held.append((text.slice(a, b - a).cast(pa.large_string()), lang.slice(a, b - a)))
                size += len(data)
                if size >= block_bytes:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang")).mapInArrow(cut, _BLOCK)


def heavy(held: DataFrame, least: int) -> DataFrame:
    """For each block and range one bit for each slot that it uses there: whether the slot's sum over all blocks is ``least`` or more."""
    schema = _schema(block=_LONG, range=T.IntegerType(), packed=_BYTES)

    def weigh(rows: pa.Table) -> pa.Table:
        sums = np.zeros(1 << SLOT_BITS, np.uint32)
        places = []
        for packed in rows["packed"].to_pylist():
            step, count, first = _unpack(packed)[0]
            places.append((np.cumsum(step) + first).astype(np.int32))
            sums[places[-1]] += count.astype(np.uint32)
        return pa.table({"block": rows["block"], "range": rows["range"], "packed": pa.array([np.packbits(sums[p] >= least).tobytes() for p in places], pa.binary())})

    return held.where(F.col("range").isNotNull()).select("block", "range", "packed").groupBy("range").applyInArrow(weigh, schema)


def _dealt(block: int, lang: str | None, ranges: np.ndarray, prefix: np.ndarray, word: np.ndarray, suffix: np.ndarray, count: np.ndarray, words: list[str], first: bool) -> pa.RecordBatch:
    """A row for each range with what a block counted there, in order of ranges: number of the first, prefixes (codes of ``words`` if ``first``), words, suffixes, counts."""
    cut = np.flatnonzero(np.diff(ranges, prepend=-1))
    packed = []
    for a, b in zip(cut, [*cut[1:], len(ranges)], strict=True):
        own, codes = np.unique(np.concatenate([word[a:b], prefix[a:b]]) if first else word[a:b], return_inverse=True)
        codes -= int(own[0] < 0)
        names = [words[i] for i in own[own >= 0].tolist()]
        packed.append(_pack([np.array([a]), codes[b - a :] if first else prefix[a:b], codes[: b - a], suffix[a:b], count[a:b]], names))
    return _rows(_COUNTED, len(cut), block=block, lang=lang, range=ranges[cut], packed=packed)


def _named(n_ranges: int, with_lists: bool):
    """From a block and its bits to the words and pairs that may be frequent, by name, and the lists of these pairs."""

    def name(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            block, lang = left["block"][0].as_py(), left["lang"][0].as_py()
            (codes,), words = _unpack(left["packed"][0].as_py())
            one, two, times = word_pairs(codes)
            slot1, slot2 = slots(lang, words, one, two, n_ranges << SLOT_BITS)
            used = np.unique(np.concatenate([slot1, slot2]))
            size = np.diff(np.searchsorted(used, np.arange(n_ranges + 1) << SLOT_BITS))
            bits = dict(zip(right["range"].to_pylist(), right["packed"].to_pylist(), strict=True))
            up = np.concatenate([np.unpackbits(np.frombuffer(bits[r], np.uint8), count=n) for r, n in enumerate(size.tolist()) if n]).astype(bool)
            good, pair = np.flatnonzero(up[np.searchsorted(used, slot1)]), np.flatnonzero(up[np.searchsorted(used, slot2)])
            if len(good) + len(pair):
                ranges = np.concatenate([slot1[good], slot2[pair]]) >> SLOT_BITS
                order = np.argsort(ranges, kind="stable")
                prefix, word = np.concatenate([np.full(len(good), -1), one[pair]])[order], np.concatenate([good, two[pair]])[order]
                count = np.concatenate([np.bincount(codes[codes >= 0], minlength=len(words))[good], times[pair]])[order]
                out.append(_dealt(block, lang, ranges[order], prefix, word, np.full(len(order), -1), count, words, True))
            if len(pair) and with_lists:
                number = np.empty(len(order), np.int32)
                number[order] = np.arange(len(order))
                both = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0))
                key, want = codes[both].astype(np.int64) << 32 | codes[both + 1], one[pair] << 32 | two[pair]
                found = np.minimum(np.searchsorted(want, key), len(want) - 1)
                lists = np.full(len(codes), -1, np.int32)
                lists[both] = np.where(want[found] == key, number[len(good) + found], -1)
                out.append(_rows(_COUNTED, 1, block=block, lang=lang, packed=[_state(codes, lists, 2, words)]))
        return pa.Table.from_batches(out) if out else pa.Table.from_batches([_rows(_COUNTED, 0)])

    return name


def _state(codes: np.ndarray, lists: np.ndarray, k: int, words: list[str]) -> bytes:
    """Lists of phrases of k words by position, with the postings of the words that end one of them."""
    ends = np.zeros(len(codes), bool)
    ends[np.flatnonzero(lists >= 0) + k - 1] = True
    used, now = np.unique(np.where(ends, codes, -1), return_inverse=True)
    if len(used) and used[0] < 0:
        used, now = used[1:], now - 1
    return _pack([now, lists], [words[i] for i in used.tolist()])


def extended(words: np.ndarray, lists: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lists of phrases of k words, given as the code of the phrase that begins at each position (-1: none), extended by the words that follow.

    Returns the positions of the longer lists, one list after another, the number of the list of each, and for each list the code of its phrase, of the word that follows and of the
    phrase that begins with the second word.
    """
    at = np.flatnonzero(lists >= 0)
    at = at[np.argsort(lists[at], kind="stable")]
    at = at[at + k < len(words)]
    postings = np.flatnonzero(words >= 0)
    found = np.searchsorted(postings, at + k)
    found[found == len(postings)] = 0
    at = at[postings[found] == at + k] if len(postings) else at[:0]
    at = at[lists[at + 1] >= 0]
    key = lists[at].astype(np.int64) << 32 | words[at + k]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    one = at[head]
    return at, np.cumsum(head) - 1, lists[one], words[one + k], lists[one + 1]


def _step(k: int, n_ranges: int, last: bool):
    """From the lists of phrases of k words, of which those named by the reply are frequent, to those of one word more."""

    def step(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            block = left["block"][0].as_py()
            (codes, lists), words = _unpack(left["packed"][0].as_py())
            part, ids = (np.concatenate(x) for x in zip(*(_unpack(p)[0] for p in right["packed"].to_pylist()), strict=True))
            index = np.full(int(max(lists.max(initial=-1), part.max())) + 2, -1, np.int64)
            index[part] = np.arange(len(part))
            lists = index[lists]
            ends = np.zeros(len(codes), bool)
            ends[np.flatnonzero(lists >= 0) + k - 1] = True
            at, number, prefix, word, suffix = extended(np.where(ends, codes, -1), lists, k)
            if len(at):
                data, offs = textcore.buffers(pa.array(words, pa.large_string()))
                h = textcore.mix64(textcore.span_hashes(data, offs[:-1], offs[1:])[word] ^ textcore.mix64(ids[prefix].astype(np.uint64)))
                ranges = (h % np.uint64(n_ranges)).astype(np.int64)
                order = np.argsort(ranges, kind="stable")
                out.append(_dealt(block, None, ranges[order], ids[prefix][order], word[order], ids[suffix][order], np.bincount(number)[order], words, False))
                if not last:
                    place = np.empty(len(order), np.int64)
                    place[order] = np.arange(len(order))
                    longer = np.full(len(codes), -1, np.int64)
                    longer[at] = place[number]
                    out.append(_rows(_COUNTED, 1, block=block, packed=[_state(codes, longer, k + 1, words)]))
        return pa.Table.from_batches(out) if out else pa.Table.from_batches([_rows(_COUNTED, 0)])

    return step


def frequent(counted: DataFrame, n_ranges: int, least: int, first: bool) -> DataFrame:
    """The phrases that are frequent over all blocks, a row each, and a packed row with the numbers of these phrases in a block, and their ids, for each block and range.

    ``first``: the phrases are words (without ``first``) and pairs of words; otherwise a prefix's id and a word.
    """

    def add(rows: pa.Table) -> pa.Table:
        each = [_unpacked(p) for p in rows["packed"].to_pylist()]
        begin, prefix, word, suffix, count = (np.concatenate(x) for x in zip(*(arrays for arrays, _, _ in each), strict=True))
        size = np.array([len(arrays[1]) for arrays, _, _ in each])
        names = pc.split_pattern(pa.array([lines for _, _, lines in each], pa.large_binary()).cast(pa.large_string()), "\n").flatten().dictionary_encode()
        ahead = np.repeat(np.cumsum([0, *(n for _, n, _ in each[:-1])]), size)
        name = names.indices.to_numpy().astype(np.int64)
        word = name[word + ahead]
        if first:
            prefix = np.where(prefix < 0, -1, name[np.maximum(prefix, 0) + ahead])
        langs = rows["lang"].combine_chunks().dictionary_encode()
        lang = np.repeat(langs.indices.fill_null(0).to_numpy().astype(np.int64), size)
        key = word * max(1, len(langs.dictionary)) + lang
        order = np.lexsort((key, prefix))
        head = np.ones(len(order), bool)
        head[1:] = (np.diff(key[order]) != 0) | (np.diff(prefix[order]) != 0)
        at = np.flatnonzero(head)
        f = np.add.reduceat(count[order].astype(np.int64), at)
        good = f >= least
        ids = np.cumsum(good) * n_ranges + rows["range"][0].as_py()
        of = np.empty(len(order), np.int64)
        of[order] = np.where(good, ids, -1)[np.cumsum(head) - 1]
        one = order[at[good]]
        texts, out = names.dictionary.cast(pa.string()), []
        if len(one):
            parts = {"first": texts.take(pa.array(prefix[one], mask=prefix[one] < 0)), "lang": langs.dictionary.take(pa.array(lang[one]))} if first else {"prefix": prefix[one], "suffix": suffix[one]}
            out.append(_rows(_FREQUENT, len(one), id=ids[good], word=texts.take(pa.array(word[one])), f=f[good], **parts))
            if first:
                of[prefix < 0] = -1
            blocks, packed = rows["block"].to_pylist(), []
            for a, b, start in zip(np.cumsum(size) - size, np.cumsum(size), begin, strict=True):
                there = np.flatnonzero(of[a:b] >= 0)
                packed.append(_pack([there + start, of[a:b][there]]) if len(there) else None)
            kept = [i for i, p in enumerate(packed) if p]
            out.append(_rows(_FREQUENT, len(kept), block=[blocks[i] for i in kept], packed=[packed[i] for i in kept]))
        return pa.Table.from_batches(out) if out else pa.Table.from_batches([_rows(_FREQUENT, 0)])

    return counted.where(F.col("range").isNotNull()).groupBy("range").applyInArrow(add, _FREQUENT)


def phrases(docs: DataFrame, tables: Tables, least: int = LEAST, max_words: int = MAX_WORDS, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """All frequent phrases of two words or more, and the number of words of each language.

    A phrase has id, lang, phrase, a, ``pre`` and ``suf`` (frequencies of its first 1, 2, ... and of its last 1, 2, ... words, without itself) and ``within`` (a longer frequent phrase that
    holds it is as frequent).
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_ranges = max(LEAST_RANGES, -(-size // RANGE_BYTES))
    whole = tables.keep(blocks(docs, n_ranges, least, block_bytes))
    totals = tables.keep(whole.where(F.col("range").isNull()).groupBy("lang").agg(F.sum("n").alias("n")))
    bits = tables.keep(heavy(whole, least))
    texts = whole.where(F.col("range").isNull()).select("block", "lang", "packed")
    held = tables.keep(texts.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(_named(n_ranges, max_words > 2), _COUNTED))
    tables.drop(whole, bits)
    levels = []
    for k in range(2, max_words + 1):
        reply = tables.keep(frequent(held, n_ranges, least, k == 2))
        own = reply.where(F.col("id").isNotNull())
        if k == 2:
            words = own.where(F.col("first").isNull())
            one = words.select("lang", F.col("word").alias("first"), F.col("f").alias("f1"))
            two = words.select("lang", "word", F.col("f").alias("f2"))
            both = own.where(F.col("first").isNotNull()).select("id", "lang", "first", "word", "f").join(one, ["lang", "first"]).join(two, ["lang", "word"])
            level = both.select("id", "lang", F.concat_ws(" ", "first", "word").alias("phrase"), "f", F.array("f1").alias("pre"), F.array("f2").alias("suf"), F.lit(None).cast("long").alias("prefix"), F.lit(None).cast("long").alias("suffix"))
        else:
            first = levels[-1].select(F.col("id").alias("prefix"), "lang", "phrase", F.concat("pre", F.array("f")).alias("pre"))
            second = levels[-1].select(F.col("id").alias("suffix"), F.concat("suf", F.array("f")).alias("suf"))
            level = own.drop("lang").join(first, "prefix").join(second, "suffix").select("id", "lang", F.concat_ws(" ", "phrase", "word").alias("phrase"), "f", "pre", "suf", "prefix", "suffix")
        levels.append(tables.keep(level))
        if k == max_words or levels[-1].isEmpty():
            break
        lists = held.where(F.col("range").isNull()).select("block", "packed")
        asked = reply.where(F.col("block").isNotNull()).select("block", "packed")
        longer = lists.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_step(k, n_ranges, k + 1 == max_words), _COUNTED)
        before, held = held, tables.keep(longer)
        tables.drop(before, reply)
    out = None
    for level, longer in zip(levels, [*levels[1:], None], strict=True):
        if longer is None:
            marked = level.withColumn("within", F.lit(False))
        else:
            holds = longer.select(F.explode(F.array("prefix", "suffix")).alias("id"), F.col("f").alias("as")).groupBy("id").agg(F.max("as").alias("most"))
            marked = level.join(holds, "id", "left").withColumn("within", F.coalesce(F.col("most") == F.col("f"), F.lit(False)))
        rows = marked.select("id", "lang", "phrase", F.col("f").alias("a"), "pre", "suf", "within")
        out = rows if out is None else out.unionByName(rows)
    return out, totals


def collocations(docs: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of each language by score, frequency and text.

    The score of a cut is floor(1000 * a * n / (l * r)) in exact decimal arithmetic (frequencies up to 10^15); that of a phrase is its lowest cut's, the shortest first part's among equal ones.
    """
    found, totals = phrases(docs, Tables(docs.sparkSession), least, max_words, block_bytes)
    d = "decimal(15,0)"
    cut = f"""array_min(transform(sequence(1, size(pre)), k -> struct(
        (1000 * cast(a as {d}) * cast(n as {d})) div (cast(element_at(pre, k) as {d}) * cast(element_at(suf, size(pre) - k + 1) as {d})) as score,
        k as k, element_at(pre, k) as l, element_at(suf, size(pre) - k + 1) as r)))"""
    scored = found.where(~F.col("within")).join(totals, "lang").select("id", "lang", "phrase", "a", "n", F.expr(cut).alias("cut"))
    rows = scored.select("id", "lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = rows.withColumn("some", F.pmod(F.xxhash64("id"), F.lit(RANK_PARTS)))
    near = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "some").orderBy(*order))).where(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
