"""Merkle manifests, packing and phrase mining against brute force, on awkward rows."""

import collections
import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from folianta.llm import collocations, merkle, packing
from folianta.llm.queries import VOCABULARY

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, nth int, row string, block string, f int, id string, length int"


def row(doc_id, text, lang="en", source="s1"):
    return (doc_id, text, lang, source, None if text is None else len(text), "x", 1, "y", "z", 2, "i", 3)


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and very long texts, ties, repeated rows and ids, several scripts, hot words."""
    rng = random.Random(5)
    words = ["Alpha", "beta", "GAMMA", "delta", "épsilon", "漢字", "zeta's", "eta-theta", "x"]
    out = [row(None, None), row(None, "No id"), row(1, None), row(2, ""), row(3, " \t\n.;"), row(4, "one"), row(4, "Two"), row(4, "Two"), row(5, "\x00 \x1f nul"), row(6, "ab ab ab ab ab")]
    for i in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", " ", "  ", ". ", "\n", "\t", ","]) for _ in range(rng.randint(1, 60)))
        out.append(row(100 + i, text, rng.choice(["en", "en", "de", "und", None]), rng.choice(["s1", None, ""])))
    out += [row(500 + i, "the very same words, the very same words", None) for i in range(40)]
    out += [row(900, "Long " * 30_000 + "end"), row(901, "a" * 50_000), row(902, "x <|endoftext|> y")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def climbed(nodes):
    """The levels of a tree, and for each node the digests of its run on each level with its place there."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    paths = []
    for i in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            path.append((run, i % 8))
            i //= 8
        paths.append(path)
    return levels[-1][0], paths


def by_hand(rows):
    def leaf(r, text):
        return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))

    groups = collections.defaultdict(list)
    for r in rows:
        other = lower(r[1]) if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r[1]
        groups[r[2]].append((r[0], leaf(r, r[1]), leaf(r, other)))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = climbed([x[1] for x in groups[g]])
    root, tops = climbed([trees[g][0] for g in langs])
    out = []
    for g, top in zip(langs, tops, strict=True):
        for (doc_id, own, now), path in zip(groups[g], trees[g][1], strict=True):
            proof = H(*(d for run, at in path + top for i, d in enumerate(run) if i != at))
            for run, at in path + top:
                now = H(*run[:at], now, *run[at + 1 :])
            out.append((doc_id, own, trees[g][0], root, proof, now, now == root))
    return out


def order(x):
    return sorted(x, key=repr)


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_manifest_equals_a_plain_tree(docs, rows, empty):
    got = [tuple(r) for r in merkle.manifest(docs).select(NAMES).collect()]
    assert order(got) == order(by_hand(rows))
    assert {r[-1] for r in got} == {True, False}
    assert merkle.manifest(empty).count() == 0


def test_manifest_of_several_floors(spark):
    n = 4_700
    texts = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text "), "id").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(7).cast("long").alias("n_chars"))
    got = [tuple(r) for r in merkle.manifest(texts).select(NAMES).collect()]
    assert order(got) == order(by_hand([(i, f"Text {i}", "en", "s", 7) for i in range(n)]))


def test_siblings_lead_from_leaf_to_root(docs):
    for r in merkle.manifest(docs, with_siblings=True).collect():
        assert H(*r["siblings"]) == r["proof_sha256"]
    one = merkle.manifest(docs.where("doc_id = 1"), with_siblings=True).first()
    assert one["siblings"] == [] and one["leaf"] == one["subroot"] == one["root"] == one["folded_root"]


def test_text_ids_are_taken(spark):
    docs = spark.createDataFrame([("b", "x", "en", "s", 1), ("a", "y", "en", "s", 1)], "doc_id string, text string, lang string, source string, n_chars long")
    assert order(tuple(r) for r in merkle.manifest(docs).select(NAMES).collect()) == order(by_hand([("a", "y", "en", "s", 1), ("b", "x", "en", "s", 1)]))


@pytest.fixture(scope="module")
def tokens():
    import tokenizers

    t = tokenizers.Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_ids_are_those_of_the_file(tokens, rows):
    odd = ["don't  STOP\r\n\n  'll 12345 ½     \U0001f600", " " * 999, "\t\n" * 99, "ª²³ ǅ ́", "'" * 50]
    for text in [*(r[1] or "" for r in rows), *odd]:
        assert packing.encoder(VOCABULARY)(text).tolist() == tokens(text)[:-1]


@pytest.mark.parametrize("window", [2048, 64])
def test_packing_goes_there_and_back(docs, rows, empty, tokens, window):
    got = [r.asDict() for r in packing.pack(docs, VOCABULARY, window).collect()]
    want = collections.Counter()
    texts = collections.defaultdict(list)
    for r in rows:
        ids = tokens(r[1])
        texts[r[0]].append(ids)
        want[r[0]] += len(ids)
    have, sequences = collections.Counter(), collections.defaultdict(list)
    for p in got:
        have[p["doc_id"]] += p["length"]
        sequences[p["sequence_id"]].append(p)
        cut = [np.array(t[p["start"] : p["start"] + p["length"]], "<u4").tobytes() for t in texts[p["doc_id"]] if len(t) == p["doc_tokens"]]
        assert p["ids_crc32"] in {zlib.crc32(c) for c in cut}
    assert have == want
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        end = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == end and p["length"] > 0
            end += p["length"]
        assert end == window or end & (end - 1) == 0 and end < window
    alone = collections.defaultdict(list)
    for p in got:
        if p["doc_id"] is not None and p["doc_id"] >= 100:
            alone[p["doc_id"]].append(p)
    for parts in alone.values():
        end = 0
        for p in sorted(parts, key=lambda p: p["start"]):
            assert p["start"] == end
            end += p["length"]
        assert end == parts[0]["doc_tokens"]
    assert packing.pack(empty, VOCABULARY).count() == 0


def test_plan_uses_each_piece_once():
    rng = random.Random(1)
    for histogram in ({}, {1: 1}, {2048: 3}, {1000: 500}, {1024: 7}, {n: rng.randint(0, 30) for n in range(1, 2049)}, {500: 10_000, 48: 2_500, 3: 1}):
        histogram = {n: c for n, c in histogram.items() if c}
        p = packing.plan(histogram)
        if not histogram:
            assert not len(p.first)
            continue
        length = np.concatenate([np.full(c, n) for n, c in histogram.items()])
        nth = np.concatenate([np.arange(c) for c in histogram.values()])
        piece, begin, size, sequence, offset = packing.places(p, length, nth)
        assert np.array_equal(np.bincount(piece, size, len(length)), length)
        taken = np.sort(sequence * 2048 + offset)
        at = np.argsort(sequence * 2048 + offset)
        ends = (sequence * 2048 + offset + size)[at]
        assert (taken[1:] >= ends[:-1]).all()
        fill = np.bincount(sequence, size).astype(int)
        assert all(f == 2048 or f & (f - 1) == 0 for f in fill)
        if len(histogram) > 1000:
            assert p.planned > 0.7 * len(fill)


def test_least_squares_fits_what_can_be_fitted():
    counts = np.zeros(2049)
    counts[[500, 48, 1024]] = [4000, 1000, 600]
    a, k, b = packing.combinations(counts, 2048)
    x = packing.least_squares(counts, a, k, b)
    used = np.bincount(a, k * x, 2049) + np.bincount(b, (b > 0) * x, 2049)
    assert (x >= 0).all() and np.abs(used - counts).max() < 1


def mined(rows, least, top):
    import re

    n, f = collections.Counter(), collections.Counter()
    for r in rows:
        lang = r[2] or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(r[1] or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, 6) for i in range(len(w) - m + 1))
    good = {k: c for k, c in f.items() if c >= least and len(k[1]) > 1}
    out = collections.defaultdict(list)
    for (lang, p), a in good.items():
        longer = [q for (g, q), c in good.items() if g == lang and len(q) > len(p) and c >= a]
        if any(q[i : i + len(p)] == p for q in longer for i in range(len(q) - len(p) + 1)):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, every in out.items() for i, (s, a, p, left, right) in enumerate(sorted(every)[:top])]


@pytest.mark.parametrize(("least", "top", "size"), [(3, 2000, 16_000_000), (3, 5, 500), (100, 2000, 2_000)])
def test_phrases_equal_brute_force(docs, rows, empty, least, top, size):
    got = [tuple(r) for r in collocations.collocations(docs, least, top=top, block_bytes=size).collect()]
    assert order(got) == order(mined(rows, least, top)) and got
    assert collocations.collocations(empty).count() == 0


def test_blocks_send_packed_rows_not_one_a_phrase(spark, monkeypatch):
    rng = random.Random(5)
    names = [f"w{i}" for i in range(24)]
    rows = [(i, "en", " ".join(rng.choices(names, k=400))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4)
    made, keep = [], collocations.Tables.keep

    def counted(self, df):
        out = keep(self, df)
        made.append(out.count())
        return out

    monkeypatch.setattr(collocations.Tables, "keep", counted)
    found, _ = collocations.phrases(docs, collocations.Tables(spark), 20, 3, 1_500)
    n_blocks, n_phrases = 60, found.count()
    assert n_phrases > 500
    assert max(made) <= n_blocks * (collocations.LEAST_RANGES + 1) + n_phrases + len(names)


def test_scores_pass_64_bits(spark):
    d = "decimal(15,0)"
    a, n, left, right = 9 * 10**14, 10**15 - 1, 7, 3 * 10**14 + 1
    got = spark.range(1).selectExpr(f"(1000 * cast({a} as {d}) * cast({n} as {d})) div (cast({left} as {d}) * cast({right} as {d})) as x").first()[0]
    assert got == 1000 * a * n // (left * right)


def test_lists_are_merged_with_adjacent_postings():
    words = np.array([0, 1, 0, 1, -1, 0, 1, 2])
    at, number, prefix, word, suffix = collocations.extended(words, words, 1)
    assert at.tolist() == [0, 2, 5, 1, 6] and number.tolist() == [0, 0, 0, 1, 2]
    assert list(zip(prefix.tolist(), word.tolist(), suffix.tolist(), strict=True)) == [(0, 1, 1), (1, 0, 0), (1, 2, 2)]
